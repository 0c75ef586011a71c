import math
import random
import re

import numpy as np
import pytest

from yardstream.llm import dual_tree as D
from yardstream.llm.queries import QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, items, top=50):
    """The contract in plain whole numbers, every item against every document."""
    words = [(d, TERM.findall((t or "").translate(ASCII_LOWER))) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n_docs, total = len(words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    wanted = {}
    for k, text in items:
        wanted.setdefault(k, set()).update(TERM.findall((text or "").translate(ASCII_LOWER)))
    out = []
    for k, terms in wanted.items():
        rows = []
        for d, w in words:
            m = 100 - 50 + (50 * len(w) * n_docs) // total
            score = 0
            for t in terms & set(w):
                tf = w.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                rows.append((-score, d is None, d, score))
        rows.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(k, i + 1, r[2], r[3]) for i, r in enumerate(rows[:top])]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def item_rows(spark, rows):
    return spark.createDataFrame(rows, "item_id int, text string")


def test_query_against_brute_force(spark, small, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = brute([(r.doc_id, r.text) for r in documents.collect()], items)
    assert got(QUERIES["op11_ranked_search"](spark, small)) == want


@pytest.mark.parametrize("cells,block,top", [(6_000_000, 50_000, 50), (100, 40, 3), (100, 7, 1)])
def test_odd_rows_small_trees_and_blocks(spark, docs_of, monkeypatch, cells, block, top):
    monkeypatch.setattr(D, "CELLS", cells)
    rng = random.Random(cells)
    vocabulary = [f"w{i}" for i in range(40)] + ["Éa", "éa", "x1", "日本"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 30)))) for i in range(300)]
    docs += [(None, "w1 w2 w3"), (None, None), (5, "w1 w2 w3"), (5, "w1 w2 w3"), (900, ""), (901, "--"), (902, "W1-w2_w3 日本"), (903, "w7 " * 5000)]
    docs += [(1000 + i, "w1 w2 w3") for i in range(80)]  # ties beyond the top
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9)))) for i in range(30)]
    items += [(31, None), (32, ""), (33, "nowhere"), (34, "w1 w2 w3"), (34, "w4"), (None, "w5 W6"), (35, "éa"), (36, "ÉA")]
    found = got(D.rank_documents(docs_of(docs), item_rows(spark, items), top, block))
    assert found == brute(docs, items, top)


def test_empty_tables_and_clashing_columns(spark, docs_of):
    none, one = docs_of([]), docs_of([(1, "a b")])
    assert got(D.rank_documents(none, item_rows(spark, [(1, "a")]))) == []
    assert got(D.rank_documents(one, item_rows(spark, []))) == []
    odd = spark.createDataFrame([(1, "a b c", 7, 8, 9, 10)], "doc_id long, text string, _utf8 int, n int, terms int, rank int")
    names = spark.createDataFrame([("i", "a", 1, 2)], "item_id string, text string, term int, score int")
    assert [tuple(r)[:3] for r in D.rank_documents(odd, names).collect()] == [("i", 1, 1)]


def test_node_pairs_are_pruned_exactly():
    rng = np.random.default_rng(3)
    groups, each, n = 20, 400, 100
    own = [rng.choice(n, 5, replace=False) + g * n for g in range(groups) for _ in range(8)]
    weights = rng.integers(1, 9000, groups * n)
    tree = D.Items([np.sort(t) for t in own], weights)
    search = D.Search(tree, np.zeros(len(own), np.int64), 10)
    terms = np.concatenate([rng.choice(n, 20, replace=False) + g * n for g in range(groups) for _ in range(each)])
    rows, values = np.repeat(np.arange(groups * each), 20), rng.integers(1, 10**6, 20 * groups * each)
    search.add(rows, terms, values, np.arange(groups * each), np.zeros(groups * each, bool))
    points = np.zeros((groups * each, groups * n), np.int64)
    points[rows, terms] = values
    item, score, ids, _ = search.rows()
    for i, t in enumerate(own):
        exact = points[:, t] @ weights[t]
        best = np.lexsort((np.arange(len(exact)), -exact))[:10]
        assert ids[item == i].tolist() == [b for b in best.tolist() if exact[b] > 0]
    assert search.scored < 0.05 * len(own) * groups * each
