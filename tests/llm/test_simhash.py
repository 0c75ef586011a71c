import random

import numpy as np
import xxhash

from yardstream.llm import simhash


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (doc_id, fingerprint) -> doc_id -> smallest reachable doc_id."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(prints):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return [least[root(i)] for i in range(len(prints))]


def check(df, bucket=simhash.BUCKET):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    want = sorted(zip([d for d, _ in rows], ["%016x" % p for _, p in prints], brute_components(prints)))
    got = simhash.near_duplicates(df, bucket).select("doc_id", simhash.hex64("fp").alias("h"), "component_id").collect()
    assert sorted(map(tuple, got)) == want


def test_against_brute_force(documents):
    check(documents)


def test_edge_texts(docs_of):
    words = [f"w{i}" for i in range(300)]
    near = [" ".join(words[:k] + ["x"] + words[k + 1 :]) for k in range(3)]
    check(docs_of([(9, " ".join(words)), (3, near[0]), (4, near[1]), (5, near[2]), (7, None), (1, ""), (2, " \n\t"), (6, "one two"), (8, "ONE Two"), (8, "one two"), (10, "é ß"), (11, "a b c d"), (12, "a\x85b c d")]))


def test_hot_bucket_is_cut_into_pairs_of_blocks(docs_of):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(400)] = f"z{rng.randrange(9)}"
        rows.append((1000 - i, " ".join(own)))
    check(docs_of(rows), bucket=8)


def test_bands_are_exact_at_every_size():
    for n in (1, 10**7, 10**10, 10**12):
        masks = simhash._bands(n)
        rng = random.Random(n)
        for _ in range(200):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flips & m == 0 for m in masks)


def test_link_roots_against_all_pairs():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**64, 6, dtype=np.uint64)
    values = centre[rng.integers(0, 6, 500)]
    for _ in range(3):
        values = values ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    bucket = np.sort(rng.integers(0, 4, 500))
    got = simhash.link_roots(values, bucket)
    for b in range(4):
        at = np.flatnonzero(bucket == b)
        want = brute_components([(int(i), int(values[i])) for i in at])
        assert list(got[at]) == want


def test_keep_one(docs_of):
    text = " ".join(f"w{i}" for i in range(50))
    df = docs_of([(5, text), (4, text), (4, text), (None, text), (None, "other words here"), (9, "quite another text with seven words")])
    kept = sorted((r.doc_id if r.doc_id is not None else -1) for r in simhash.keep_one_per_group(df).collect())
    assert kept == [-1, -1, 4, 9]
    assert simhash.keep_one_per_group(df).columns == df.columns


def test_rows_without_id_do_not_share_a_task(spark, docs_of):
    from pyspark.sql import functions as F

    df = docs_of([(None, f"text {i}") for i in range(400)] + [(1, "one two")]).repartition(8)
    kept = simhash.keep_one_per_group(df).withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in kept.filter("doc_id is null").groupBy("part").count().collect()]
    assert sum(sizes) == 400 and max(sizes) < 200


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    assert simhash.keep_one_per_group(docs_of([])).count() == 0


def test_clashing_columns(docs_of):
    from pyspark.sql import functions as F

    df = docs_of([(1, "a b"), (2, "a b")]).withColumns({"fp": F.lit("x"), "component_id": F.lit(7)})
    out = simhash.keep_one_per_group(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [1]
