import random
from collections import Counter, defaultdict

import pytest

from yardstream.llm import pfair as P


@pytest.mark.parametrize("seed", range(8))
def test_deviation_stays_below_one_block(seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.random() ** 3 + 1e-3 for i in range(rng.randrange(1, 40))}
    blocks = P.quantised(weights, 512)
    period = sum(blocks.values())
    assert period == 512 and min(blocks.values()) >= 1
    served = Counter()
    for k, n, release, deadline, slot in P.period_schedule(blocks):
        assert release <= slot < deadline and n == served[k]
        served[k] += 1
        for s, b in blocks.items():
            assert abs(served[s] - b * (slot + 1) / period) < 1
    assert served == blocks


def test_quantised_follows_the_weights():
    assert P.quantised({"a": 3, "b": 1}, 8) == {"a": 6, "b": 2}
    assert P.quantised({"a": 1, "b": 0}, 8) == {"a": 8}
    many = P.quantised({f"s{i}": 1.0 for i in range(5000)}, 16)
    assert sum(many.values()) == 20_000 and set(many.values()) == {4}
    skew = P.quantised({"big": 1e9, **{f"s{i}": 1e-9 for i in range(10)}}, 64)
    assert sum(skew.values()) == 64 and skew["s3"] == 1
    with pytest.raises(ValueError):
        P.quantised({})


def brute(rows, weights, block, period):
    """Each source's order by its own ranks, then a plain earliest-deadline-first run over as many slots as are needed."""
    blocks = P.quantised(weights, period)
    period = sum(blocks.values())
    need = defaultdict(int)
    for r in rows:
        need[r.source or ""] = max(need[r.source or ""], r.mix_rank // block + 1)
    slot, served, place = 0, Counter(), {}
    while any(served[k] < need[k] for k in blocks):
        ready = [((-(-(served[k] + 1) * period // b)), k) for k, b in blocks.items() if served[k] * period // b <= slot]
        deadline, k = min(ready)
        place[k, served[k]] = (served[k] * period // blocks[k], deadline, slot)
        served[k] += 1
        slot += 1
    return place


@pytest.mark.parametrize("slice_rows", [3, 20_000])
def test_places_against_a_plain_run(docs_of, monkeypatch, slice_rows):
    monkeypatch.setattr(P, "SLICE_ROWS", slice_rows)
    rng = random.Random(2)
    rows = [(i, f"t{i % 37}", "en", rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(300)]
    weights = {"a": 1.0, "b": 2.0, "c": 0.5, "": 0.5}
    got = P.schedule(docs_of(rows), weights, block=3, period=32).collect()
    assert sorted(r.doc_id for r in got) == list(range(300))
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r.mix_rank)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = brute(got, weights, 3, 32)
    for r in got:
        assert (r.mix_release, r.mix_deadline, r.mix_slot) == want[r.source or "", r.mix_block]


def test_mix_holds_back_the_large_source_only(docs_of):
    rows = [(i, f"t{i}", "en", "big" if i < 800 else f"s{i % 4}") for i in range(1000)]
    df = docs_of(rows)
    out = P.mix(df, {"big": 0.5, "s0": 0.125, "s1": 0.125, "s2": 0.125, "s3": 0.125}, block=4)
    assert out.columns == df.columns
    got = Counter(r.source for r in out.collect())
    assert 500 <= got["big"] <= 504 and all(got[f"s{k}"] == 50 for k in range(4))
    head = Counter(r.source for r in out.collect()[:200])
    assert abs(head["big"] - 100) < 4 and all(abs(head[f"s{k}"] - 25) < 4 for k in range(4))
    even = P.mix(df, P.tempered_weights(df, 1.0))
    assert even.count() == 1000


def test_edges(docs_of):
    rows = [(1, "x", "en", "a"), (1, "x", "en", "a"), (None, None, None, None), (2, None, "en", "zz")]
    got = P.schedule(docs_of(rows), {"a": 1.0, "": 1.0}, block=1, period=4).collect()
    assert len(got) == 4 and sorted(r.mix_rank for r in got if r.source == "a") == [0, 1]
    assert [r.mix_slot for r in got if r.source == "zz"] == [None]
    assert P.schedule(docs_of([]), {"a": 1.0}).count() == 0
    assert P.tempered_weights(docs_of(rows), 0.0) == {"a": 1.0, "": 1.0, "zz": 1.0}


def test_columns_of_any_name_keep_their_values(docs_of):
    from pyspark.sql import functions as F

    rows = [(i, f"t{i}", "en", "ab"[i % 2]) for i in range(40)]
    clash = ["_source", "_slice", "_nth", "_per", "_order", "_n", "_in", "_turn", "_most", "_before", "_slot", "__source", "mix_rank", "mix_slot", "a.b"]
    df = docs_of(rows).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in clash})
    out = P.mix(df, {"a": 1.0, "b": 1.0}, block=2, period=8)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    got = P.schedule(df, {"a": 1.0, "b": 1.0}, block=2, period=8)
    assert len(set(got.columns)) == len(got.columns) and got.schema["mix_rank"].dataType.simpleString() == "bigint"
    assert all(r["_source"] == f"_source{r.doc_id}" and r["__source"] == f"__source{r.doc_id}" for r in got.collect())
