import pytest
from test_jaccard import brute_groups
from test_suffix_decontam import brute as brute_hits
from test_token_store import brute as brute_tokens

import corpus_pipeline as C
from yardstream.llm import pfair

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def after(spark, tmp_path_factory):
    """The rows that each stage returns, each stage reading what the one before wrote."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, root = [docs], tmp_path_factory.mktemp("stages")
    for i, (name, stage) in enumerate(C.STAGES):
        path = f"{root}/{i}"
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(after):
    assert len(C.STAGES) == 5
    assert all(df.columns == after[0].columns for df in after[1:-1])


def test_language_stage_keeps_clean_documents(after):
    assert ids(after[1]) == ids(after[0])


def test_near_duplicates_against_brute_force(after):
    groups = brute_groups([(r.doc_id, r.text) for r in after[1].collect()])
    assert ids(after[2]) == sorted({least for _, least in groups})


def test_leaks_against_brute_force(spark, after):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(after[3]) == sorted(r.doc_id for r in after[2].collect() if not brute_hits(r.text, items)[-1])
    assert after[3].count() < after[2].count()


def test_mixture_against_target_shares(after):
    weights = pfair.tempered_weights(after[3], C.MIX_POWER)
    n, total = after[3].count(), sum(weights.values())
    have = {r.source or "": r["count"] for r in after[3].groupBy("source").count().collect()}
    got = {r.source or "": r["count"] for r in after[4].groupBy("source").count().collect()}
    for k, w in weights.items():
        assert got[k] == min(have[k], got[k]) and abs(got[k] - min(have[k], w / total * n)) <= pfair.BLOCK + n / pfair.PERIOD + 1


def test_tokens_against_brute_force(after):
    rows = sorted((r.doc_id, r.text) for r in after[4].collect())
    assert sorted(tuple(r) for r in after[5].collect()) == brute_tokens(rows)


def test_run_gives_the_last_stage(spark, after):
    assert sorted(map(tuple, C.run(spark, SF).collect())) == sorted(map(tuple, after[-1].collect()))


def test_odd_rows_pass_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (900, None, "en", None, None), (901, "", None, "x", 0), (902, "!!", "de", "x", 2), (None, "the words of that", "en", "x", 1), (0, "the and of", None, "src0", 3)], docs.schema)
    for i, table in enumerate((docs.union(odd), docs.union(odd).limit(0))):
        for k, (_, stage) in enumerate(C.STAGES):
            stage(spark, table, SF).write.parquet(f"{tmp_path}/{i}-{k}")
            table = spark.read.parquet(f"{tmp_path}/{i}-{k}")
        assert (table.count() > 0) == (i == 0)
