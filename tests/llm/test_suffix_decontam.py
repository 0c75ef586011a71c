import hashlib
import random
import re

import pytest

from yardstream.llm import suffix_decontam as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(name))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def run(spark, df, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = S.contamination_report(df, bench).select("doc_id", "n_words", "n_hit", "n_items", S.item_digest().alias("d"), "contaminated").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_against_brute_force(spark, documents, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = sorted(((r.doc_id, *brute(r.text, items)) for r in documents.collect()), key=str)
    assert run(spark, documents, items) == want
    assert any(w[-1] for w in want)


@pytest.mark.parametrize("seed", range(6))
def test_few_words(spark, docs_of, seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("ab" if seed % 2 else "abc") for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 14, 30]))) for i in range(12 if seed else 3)]
    if seed > 1:
        items = [(i, "q " + t) for i, t in items if len(t) > 12]
    docs = [(i, text(rng.randrange(60)) + (" Q " + items[0][1].upper() if i % 3 == 0 and items else "")) for i in range(25)]
    want = sorted(((d, *brute(t, items)) for d, t in docs), key=str)
    assert run(spark, docs_of(docs), items) == want


def test_edge_rows(spark, docs_of):
    docs = [(1, None), (2, ""), (None, "one"), (3, "ONE-two"), (3, "ONE-two"), (4, "été x"), (5, "...")]
    items = [(1, None), (2, "..."), (3, "one"), (3, "two"), (4, "été X")]
    assert run(spark, docs_of(docs), items) == sorted(((d, *brute(t, items)) for d, t in docs), key=str)
    assert all(r[2] == 0 for r in run(spark, docs_of(docs), []))
    assert run(spark, docs_of([]), items) == []


def test_longest_match_and_places(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(20))
    doc = "x y " + " ".join(f"w{i}" for i in range(3, 17)) + " z"
    r = S.contamination_report(docs_of([(1, doc)]), spark.createDataFrame([(8, item)], "item_id long, text string")).first()
    assert r.longest == 14
    assert [tuple(p) for p in r.places] == [("8", 3, 2, 14)]


def test_removal_keeps_clean_rows_and_columns(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(12))
    df = docs_of([(1, "a " + item), (2, None), (3, "clean text"), (3, "clean text"), (4, item.upper())])
    bench = spark.createDataFrame([(1, item), (2, "something else that is not there at all in any of them")], "item_id long, text string")
    for block in (S.BLOCK_BYTES, 30):
        out = S.decontaminate(df, bench, block)
        assert out.columns == df.columns
        assert sorted(r.doc_id for r in out.collect()) == [2, 3, 3]


def test_large_benchmark_is_refused_by_the_report(spark, docs_of):
    with pytest.raises(ValueError):
        S.contamination_report(docs_of([]), spark.createDataFrame([(1, "abc")], "item_id long, text string"), max_bytes=2)
