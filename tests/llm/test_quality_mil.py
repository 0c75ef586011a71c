import numpy as np

from yardstream.llm import quality_mil as M
from yardstream.llm.common import crc_mod


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    sizes, labels = np.array([3, 1, 5]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(9, M.FEATURES))
    net = M.Network.start(np.zeros(M.FEATURES), np.ones(M.FEATURES))

    def loss():
        p = net.forward(x, sizes)["p"]
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).sum()

    f = net.forward(x, sizes)
    for k, g in net.gradients(f, f["p"] - labels).items():
        at = tuple(rng.integers(0, n) for n in net.w[k].shape)
        keep = net.w[k][at]
        net.w[k][at] = keep + 1e-5
        up = loss()
        net.w[k][at] = keep - 1e-5
        down = loss()
        net.w[k][at] = keep
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4, k


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights = M.learn(documents, labels.filter(crc_mod("doc_id", 3) != 1))
    held = labels.filter(crc_mod("doc_id", 3) == 1)
    rows = M.score(documents, weights).join(held, "doc_id").collect()
    assert len(rows) > 80
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows]) >= 0.95
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([s < 0.5 for s in bad]) >= 0.85


def test_attention_finds_the_odd_passage():
    good = " ".join(f"word{i} and" for i in range(32)).encode()
    junk = b"*** $$$ %%% &&& " * 16
    bags = [(b" ".join([good] * 4), 1.0), (b" ".join([good, good, junk, good]), 0.0)] * 20
    x, n = M.encode_passages([t for t, _ in bags])
    net = M.fit(x.astype(np.float64), n, np.array([y for _, y in bags]))
    f = net.forward(x, n)
    assert ((f["p"] >= 0.5) == np.array([y == 1 for _, y in bags])).all()


def test_whole_texts_and_edges(docs_of, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(99, 1), (None, 1), (1, None)], "doc_id long, quality int")
    texts = docs_of([(i, "fine words here and there" if i % 2 else "$$$ ### !!!") for i in range(40)] + [(50, None), (51, ""), (52, " \n"), (None, "fine words"), (0, "$$$ ### !!!")])
    weights = M.learn(texts, labels)
    rows = M.score(texts, weights).collect()
    assert len(rows) == 45 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[1] > 0.5 > by[2] and by[50] == by[51] == by[52]
    assert {r.score for r in M.score(texts, None).collect()} == {0.5}
    assert M.learn(texts, labels.filter("false")) is None
    assert M.score(docs_of([]), weights).count() == 0
    long = " ".join(f"w{i}" for i in range(10_000))
    assert M.score(docs_of([(1, long)]), weights).first().passages == -(-10_000 // M.PASSAGE)


def test_pooling_uses_all_passages():
    x = np.arange(600, dtype=float).reshape(300, 2)
    pooled, n = M._pooled(x, np.array([300 - 5, 5]))
    assert n.tolist() == [M.SAMPLE_PASSAGES, 5] and len(pooled) == M.SAMPLE_PASSAGES + 5
    assert np.allclose(pooled[-5:], x[-5:])
