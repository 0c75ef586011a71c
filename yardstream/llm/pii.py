"""Personal data: patterns, and the terms that give away whom they belong to.

Sanitisation by information content: an entity is a found value (an address, a
number).  A term discloses an entity as far as meeting the term tells that the
entity is near.  With the corpus as the source of probabilities that is the
pointwise mutual information PMI(e; t) = log N n(e,t) / (n(e) n(t)), taken as a
share of the entity's information content IC(e) = log N / n(e): 1 if the term
never occurs without the entity, 0 if it occurs independently of it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardstream.llm.common import arrow_schema, map_batches, own_prefix, staged, text_slices

KINDS = ["email", "ip", "card", "phone", "term"]
#: Words on either side of an entity that count as its context.
REACH = 10
#: Different contexts that an entity and a term must share.
LEAST = 3
#: Disclosure (PMI / IC) from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.6, 0.9
#: Text hashes that the sketch of a term keeps.
SKETCH, MERGES = 64, 512
#: Candidate terms that a pass over the documents looks for; more take further passes.
PASS_TERMS = 1_000_000

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{2,}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of emails, ip addresses, card and phone numbers, by start, then kind.

    The local part of an address is read backwards from the @ and the other
    patterns start where a run of digits does, so every text takes linear time.
    """
    out, done = [], 0
    for m in _AT.finditer(text) if "@" in text else ():
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, 0, m.end()))
            done = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= len(digits := _digits(m.group())) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity_of(kind: int, value: str) -> str:
    """One name for the spellings of a value."""
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else value if kind == 1 else _digits(value)}"


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, list[str]]]:
    """(entity, lower-case terms within REACH words) of each span; words inside any span don't count."""
    out = []
    for start, kind, end in spans:
        terms = []
        for side, (low, high) in enumerate(((max(0, start - 60 * REACH), start), (end, end + 60 * REACH))):
            words = [m for m in _WORD.finditer(text, low, min(high, len(text)))]
            if side == 0 and words and low and words[0].start() == low:
                words = words[1:]  # may be cut
            words = words[-REACH:] if side == 0 else words[:REACH]
            terms += [w.group().lower() for w in words if not any(s < w.end() and w.start() < e for s, _, e in spans)]
        out.append((entity_of(kind, text[start:end]), terms))
    return out


_FOUND = "doc_id long, text_hash long, spans array<struct<start:long,kind:int,end:long>>, near array<struct<entity:string,place:long,terms:array<string>>>"


def _find_spans(rows: DataFrame) -> DataFrame:
    schema = arrow_schema(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            out = []
            for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))):
                text = text or ""
                spans = base_spans(text)
                near = [(e, xxhash.xxh64_intdigest(" ".join(t).encode("utf-8", "surrogatepass")) >> 1, sorted(set(t))) for e, t in contexts(text, spans)]
                out.append({"doc_id": doc, "text_hash": mark, "spans": [dict(zip(("start", "kind", "end"), s)) for s in spans], "near": [dict(zip(("entity", "place", "terms"), n)) for n in near]})
            yield pa.RecordBatch.from_pylist(out, schema)

    return map_batches(rows, run, _FOUND)


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _candidates(found: DataFrame) -> DataFrame:
    """(entity, term, n_et, n_e): pairs that share LEAST different contexts.

    Contexts are told apart by the hash of their words, so a passage that is
    copied into many documents counts once.
    """
    near = found.select(F.explode("near").alias("n")).select("n.entity", "n.place", "n.terms")
    places = near.groupBy("entity", "place").agg(F.first("terms").alias("terms"))
    places = staged(places, "entity-contexts")
    entities = places.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= LEAST)
    pairs = places.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_et")).filter(F.col("n_et") >= LEAST)
    return pairs.join(entities, "entity")


def _rough_counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_t): about how many different texts hold each candidate term, by bottom-k sketches of all texts.

    A task keeps the SKETCH smallest text hashes of a term: one row, however
    common the term.  Sketches are merged in two steps, so that none holds
    those of all tasks.  Below SKETCH the count is exact.
    """
    n = terms.count()
    passes = -(-n // PASS_TERMS)
    spark, out = documents.sparkSession, None
    for i in range(passes):
        sent = spark.sparkContext.broadcast({r.term for r in terms.filter(F.pmod(F.xxhash64("term"), F.lit(passes)) == i).collect()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            wanted, least = sent.value, {}
            for batch in text_slices(batches, "text"):
                for mark, text in zip(batch.column("text_hash").to_pylist(), batch.column("text").to_pylist()):
                    for term in wanted.intersection(_WORD.findall((text or "").lower())):
                        marks = least.setdefault(term, [])
                        if len(marks) < SKETCH or mark < marks[-1]:
                            at = bisect_left(marks, mark)
                            if at == len(marks) or marks[at] != mark:
                                marks.insert(at, mark)
                                del marks[SKETCH:]
            task = TaskContext.get().partitionId() % MERGES
            yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.string()), pa.array([task] * len(least), pa.int32()), pa.array(list(least.values()), pa.list_(pa.int64()))], ["term", "task", "marks"])

        got = map_batches(_keyed(documents), run, "term string, task int, marks array<long>")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], "term string, n_t double")
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("marks")))), 1, SKETCH).alias("marks")
    merged = out.groupBy("term", "task").agg(smallest).groupBy("term").agg(smallest)
    share = (F.array_max("marks").cast("double") + 2.0**63) / 2.0**64
    return merged.select("term", F.when(F.size("marks") < SKETCH, F.size("marks")).otherwise((SKETCH - 1) / share).cast("double").alias("n_t"))


def _worth_counting(candidates: DataFrame, rough: DataFrame, n_texts: int) -> DataFrame:
    """Candidate terms that may reach GENERALISE for some entity, with a wide margin for the rough counts.

    PMI / IC >= g means n(t) <= n(e,t) (N / n(e)) ** (1 - g).
    """
    total = F.greatest(F.lit(float(max(n_texts, 2))), F.col("n_e") + 1)
    bound = 2.5 * F.col("n_et") * F.pow(total / F.col("n_e"), F.lit(1 - GENERALISE))
    return candidates.join(rough, "term").filter(F.col("n_t") <= bound).select("term").distinct()


def _postings(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text_hash, term, starts, ends): where the candidate terms stand.

    The terms travel to the tasks in portions of PASS_TERMS, one pass over the documents each.
    """
    n = terms.count()
    passes = -(-n // PASS_TERMS)
    spark, out = documents.sparkSession, None
    schema = "doc_id long, text_hash long, term string, starts array<long>, ends array<long>"
    form = arrow_schema(schema)

    for i in range(passes):
        part = terms.filter(F.pmod(F.xxhash64("term"), F.lit(passes)) == i)
        sent = spark.sparkContext.broadcast({r.term for r in part.collect()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            wanted = sent.value
            for batch in text_slices(batches, "text"):
                rows = []
                for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))):
                    at: dict[str, list] = {}
                    for m in _WORD.finditer(text or ""):
                        if (word := m.group().lower()) in wanted:
                            at.setdefault(word, []).append(m.span())
                    rows += [{"doc_id": doc, "text_hash": mark, "term": t, "starts": [a for a, _ in x], "ends": [b for _, b in x]} for t, x in at.items()]
                yield pa.RecordBatch.from_pylist(rows, form)

        got = map_batches(_keyed(documents), run, schema)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], schema)


def disclosing_terms(candidates: DataFrame, postings: DataFrame, n_texts: int) -> DataFrame:
    """(term, disclosure, action) of the terms that exceed a threshold for some entity.

    n(t) counts the different texts that hold the term, n(e) and n(e,t) the
    different contexts; N is the number of texts.
    """
    texts = postings.groupBy("term", "text_hash").agg(F.lit(1).alias("one")).groupBy("term").agg(F.count("*").alias("n_t"))
    joined = candidates.join(texts, "term")
    total = F.lit(float(max(n_texts, 2)))
    content = F.log(F.greatest(total, F.col("n_e") + 1) / F.col("n_e"))
    pmi = F.log(F.greatest(total, F.col("n_e") + 1) * F.col("n_et") / (F.col("n_e") * F.greatest("n_t", "n_et")))
    worst = joined.groupBy("term").agg(F.max(pmi / content).alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)
    return worst.withColumn("action", F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise"))


def find_personal_data(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans) for every row of ``documents`` (doc_id, text).

    spans: array of (start, kind, end, action) in code points, by start, then in
    the order of KINDS.  Kinds 0 to 3 are the patterns (action "remove"); kind 4
    are terms that disclose an entity.  Terms are judged over the whole corpus
    and marked wherever they stand outside pattern spans.

    Null texts count as empty, repeated rows each give a row, an empty table
    none.  A corpus in which no entity recurs in LEAST different contexts has no
    such terms.
    """
    found = staged(_find_spans(_keyed(documents)), "personal-data")
    candidates = staged(_candidates(found), "candidate-terms")
    n_texts = found.agg(F.approx_count_distinct("text_hash", 0.02)).first()[0]
    rough = staged(_rough_counts(documents, candidates.select("term").distinct()), "term-counts")
    postings = staged(_postings(documents, _worth_counting(candidates, rough, n_texts)), "term-places")
    terms = disclosing_terms(candidates, postings, n_texts)
    marks = postings.join(terms, "term").select("doc_id", "text_hash", "action", F.explode(F.arrays_zip("starts", "ends")).alias("p"))
    marks = marks.select("doc_id", "text_hash", F.struct(F.col("p.starts").alias("start"), F.lit(4).alias("kind"), F.col("p.ends").alias("end"), "action").alias("mark"))
    # Rows that repeat doc_id and text have the same marks: the set keeps each once.
    marks = marks.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_set("mark").alias("marks"))
    rows = found.join(staged(marks, "term-marks"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit("remove").alias("action")))
    free = F.filter(F.coalesce("marks", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,action:string>>")), lambda m: ~F.exists("spans", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    return rows.select("doc_id", "text_hash", F.array_sort(F.concat(base, free)).alias("spans"))


def span_text(spans, only_base: bool = False):
    """kind:start:end, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"] < 4) if only_base else spans
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: str, spans: list) -> str:
    """The text with patterns named ([email]), removed terms taken out and generalised ones reduced to their kind of word."""
    out, at = [], 0
    for s in spans:
        if s["start"] < at:  # inside the span before
            at = max(at, s["end"])
            continue
        out.append(text[at : s["start"]])
        if s["kind"] < 4:
            out.append(f"[{KINDS[s['kind']]}]")
        elif s["action"] == "generalise":
            out.append("[Name]" if text[s["start"]].isupper() else "[word]")
        at = s["end"]
    return "".join([*out, text[at:]])


def sanitise(documents: DataFrame) -> DataFrame:
    """``documents`` with the texts sanitised (see ``find_personal_data`` and ``replaced``); other columns stay.

    Null texts stay null.  Rows are matched by doc_id and text, so repeated rows
    get the same text.  Other columns may have any name.
    """
    names, p = documents.columns, own_prefix(documents.columns)
    doc, key, marks = f"{p}doc", f"{p}hash", f"{p}spans"
    spans = find_personal_data(documents).groupBy("doc_id", "text_hash").agg(F.first("spans").alias(marks))
    spans = spans.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(key), marks)
    rows = documents.join(spans, documents["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(documents["text"]) == F.col(key)), "left")
    at, kinds = names.index("text"), documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, f"{p}{at}"):
            texts = [t if t is None or not s else replaced(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(marks).to_pylist())]
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    # Names with dots do not pass the map, so its input is numbered.
    return map_batches(rows.select(*[F.col(f"`{c}`").alias(f"{p}{i}") for i, c in enumerate(names)], marks), run, kinds)
