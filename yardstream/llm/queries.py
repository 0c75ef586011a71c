"""The registered queries of this folder and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardstream.llm import chat_format, dual_tree, fim_frames, gated_rnn, language_mix, minhash, pfair, pii, quality_mil, simhash, suffix_decontam, token_store, url_lm
from yardstream.llm.common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    return found.select("doc_id", *map(count, range(5)), F.sha2(pii.span_text(F.col("spans"), True), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = suffix_decontam.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", suffix_decontam.item_digest().alias("items_sha256"), "contaminated")


def chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    hard = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat_format.read_back(chat_format.format_chats(turns))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    learned = language_mix.learn(documents.filter(crc_mod("doc_id", 4) != 2))
    found = language_mix.identify(documents, learned)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    weights = quality_mil.learn(documents, _table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 3) != 1))
    found = quality_mil.score(documents, weights)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_documents(_table(spark, sf_dir, "documents"))


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in a mix by sources, weighted by the square root of their sizes."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    weights = pfair.tempered_weights(documents, 0.5)
    return pfair.schedule(documents, weights).drop("text")


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encode_to_store(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: Fixed rules of the URL filter: (verdict, host, start of the path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    weights = gated_rnn.learn(documents, _table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2))
    found = gated_rnn.score(documents, weights)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_frames.fill_in_middle(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_personal_data": personal_data, "op2_decontaminate": decontaminate, "op3_chat_round_trip": chat_round_trip, "op4_language_id": language_id,
    "op5_quality": quality, "op6_fingerprints": fingerprints, "op7_simhash": simhash_groups, "op8_source_mix": source_mix, "op9_token_ids": token_ids,
    "op10_url_filter": url_filter, "op11_ranked_search": ranked_search, "op12_toxicity": toxicity, "op13_fill_in_middle": fill_in_middle, "pipeline": pipeline,
}

_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_MARKS = r"([|]im_start[|]>|[|]im_end[|]>|[|]endoftext[|]>|/?s>|/?INST\])"

#: Only these can be written in SQL: the others need 64-bit hashes, models, positions of matches or the tokenizer.
ORACLE: dict[str, str] = {
    "op2_decontaminate": f"""
with d as (select doc_id, coalesce({_WORDS}, []) as w from documents), b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark where text is not null),
win as (select distinct item, least(10, len(w)) as n, array_to_string(w[i+1 : i+least(10, len(w))], ' ') as s from (select *, unnest(range(0, len(w) - least(10, len(w)) + 1)) as i from b where len(w) > 0)),
own as (select doc_id, n, i, array_to_string(w[i+1 : i+n], ' ') as s from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as i from d, (select distinct n from win))),
hit as (select doc_id, i, own.n, item from own join win using (n, s)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from hit) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)""",
    "op3_chat_round_trip": rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(text, '([<\[])(\\*){_MARKS}', '\1\2\\\3', 'g') as quoted from t),
c as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as every, coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss,
  sum(length('<|im_start|>') + length(role) + 1 + length(quoted) + length('<|im_end|>') + 1) as formatted_chars, count(*) filter (quoted <> text) as n_escaped from e group by 1)
select conv_id, n_turns, sha256(every) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars::bigint as formatted_chars, n_escaped, true as round_trip from c""",
    "op13_fill_in_middle": """
with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
h as (select *, ('0x' || substr(x, 1, 8))::bigint as h1, ('0x' || substr(x, 9, 8))::bigint as h2, ('0x' || substr(x, 17, 8))::bigint as h3, ('0x' || substr(x, 25, 8))::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
s as (select *, substr(text, 1, a) as p, substr(text, a + 1, b - a) as m, substr(text, b + 1) as s from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end::bigint as prefix_chars, case when form <> 'plain' then b - a end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256
from s""",
    "op11_ranked_search": r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents where text is not null),
i as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark where text is not null),
s as (select count(*)::bigint as n_docs, sum(len(w))::bigint as n_words from d where len(w) > 0),
c as (select r, doc_id, n, t, count(*)::bigint as tf from (select r, doc_id, len(w)::bigint as n, unnest(w) as t from d) where t in (select t from i) group by 1, 2, 3, 4),
f as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w from c, s group by t, n_docs),
p as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_words))))::bigint as score from c join f using (t) join i using (t), s group by 1, 2, 3)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from p where score > 0) where rank <= 50""",
}
