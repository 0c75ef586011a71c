import hashlib
import random

import pytest
import xxhash

from yardstream.llm import minhash as M

MASK = (1 << 64) - 1


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] or [""]


def chained(parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), h)
    return h


def brute_bins(text):
    w = words(text)
    runs = [w] if len(w) <= 5 else [w[i : i + 5] for i in range(len(w) - 4)]
    low, bins = (1 << 56) - 1, [None] * 256
    for run in runs:
        h = chained(run)
        b, v = (h ^ (1 << 63)) >> 56, h & low
        if v != low and (bins[b] is None or v < bins[b]):
            bins[b] = v
    out = list(bins)
    for b in range(256):
        if bins[b] is None:
            out[b] = next(bins[at] for t in range(256) if bins[at := M.probe(b, t)] is not None)
    return out


def brute_print(text):
    return "".join("%x" % (v & 15) for v in brute_bins(text))


def brute_likeness(a, b):
    same = sum(x == y for x, y in zip(a, b)) / 256
    return 1.0 if a == b else max(0.0, (same - 1 / 16) / (15 / 16))


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc, text) in enumerate(order):
        other = order[(i + 1) % len(order)][1] or ""
        text = text or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        a, b, c = brute_print(text), brute_print(edited), brute_print(other)
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, brute_likeness(a, b), brute_likeness(a, c))
    return out


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: tuple(r)[1:] for r in M.fingerprint_documents(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for doc, w in want.items():
        assert got[doc][:4] == w[:4], doc
        assert got[doc][4:] == pytest.approx(w[4:])


def test_against_brute_force(documents):
    check(documents)


@pytest.mark.parametrize("slice_rows", [2, 30, 10_000])
def test_slices_do_not_change_the_neighbours(docs_of, monkeypatch, slice_rows):
    monkeypatch.setattr(M, "SLICE_ROWS", slice_rows)
    ids = [*range(0, 50), 10**12, 10**12 + 7, -5, 333, *range(1000, 1020)]
    check(docs_of([(i, f"text number {i} " * (i % 7)) for i in ids]))


def test_edge_texts(docs_of):
    check(docs_of([(1, None), (2, ""), (3, " "), (4, "one"), (5, "a b c d e"), (6, "a b c d e f"), (7, "\U0001f600 é ß \U0001f600 x y z"), (8, "w " * 3000)]))
    check(docs_of([(1, "alone with itself and some more words")]))
    assert M.fingerprint_documents(docs_of([])).count() == 0


def test_repeated_and_null_ids(docs_of):
    rows = [(1, "same words here"), (1, "same words here"), (None, "x y"), (None, None), (2, "a b")]
    got = M.fingerprint_documents(docs_of(rows)).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, -1, 1, 1, 2]
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1


def test_likeness_estimates_jaccard(docs_of, spark):
    from pyspark.sql import functions as F

    base = [f"w{i}" for i in range(1200)]
    for share in (0.9, 0.7, 0.4):
        keep = int(1200 * share)
        other = base[:keep] + [f"z{i}" for i in range(1200 - keep)]
        a, b = ({tuple(x[i : i + 5]) for i in range(1196)} for x in (base, other))
        true = len(a & b) / len(a | b)
        df = spark.createDataFrame([(" ".join(base), " ".join(other))], "a string, b string")
        got = df.select(M.likeness(M.fingerprint(F.col("a")), M.fingerprint(F.col("b"))).alias("x")).first().x
        assert abs(got - true) < 0.12


def shuffled_bytes(spark, run):
    """Bytes that the stages of ``run()`` write to shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(spark._jvm.double, 0)

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = written()
    run()
    return sum(b for stage, b in written().items() if stage not in before)


def test_each_text_is_shuffled_once(spark, docs_of):
    """Random texts longer than a compressed block, so that compression does not hide a second copy."""
    draw = random.Random(6)
    rows = [(i, " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=15)) for _ in range(8_000))) for i in range(40)]
    df = docs_of(rows)
    size = shuffled_bytes(spark, lambda: df.repartition(8, "doc_id").write.format("noop").mode("overwrite").save())
    assert size > 1_000_000
    assert shuffled_bytes(spark, lambda: M.fingerprint_documents(df).write.format("noop").mode("overwrite").save()) < 1.5 * size


def test_a_next_row_without_text_is_still_the_next(docs_of):
    got = {r.doc_id: r.following.text for r in M.with_next(docs_of([(1, "a"), (2, None), (3, "c")]).select("doc_id", "text"), {}).collect()}
    assert got == {3: None, 2: "a", 1: "c"}
