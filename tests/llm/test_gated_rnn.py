import random
import re

import numpy as np
import pytest

from yardstream.llm import gated_rnn as G
from yardstream.llm.common import crc_mod
from yardstream.llm.queries import QUERIES


def brute_words(text):
    """Words in plain Python: runs of letters, digits and bytes from 128 on, cut to WORD bytes."""
    return [m[i : i + G.WORD] for m in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode()) for i in range(0, len(m), G.WORD)]


def brute_windows(words):
    if len(words) <= G.WINDOW:
        return [words]
    starts = list(range(0, len(words) - G.WINDOW, G.STRIDE)) + [len(words) - G.WINDOW]
    return [words[s : s + G.WINDOW] for s in starts]


def some_texts():
    rng = random.Random(4)
    letters = "abcdefgé日 ß.,!0"
    return ["", " ", "one", "a b", "x" * 100, "日本語" * 60, *("".join(rng.choices(letters, k=rng.randrange(1, 900))) for _ in range(30)), " ".join(f"w{i % 50}" for i in range(G.WINDOW)), " ".join(map(str, range(G.WINDOW + 1)))]


def test_words_and_windows_against_plain_python():
    texts = some_texts()
    raw = [t.lower().encode() for t in texts]
    words = G.Words(raw, [True] * len(raw))
    line = words.bytes.tobytes()
    owner, numbers, _ = words.windows([True] * len(raw))
    named = [line[a:b] for a, b in zip(words.start, words.end)]
    name_of = dict(zip(words.number.tolist(), named))
    assert all(name_of[k] == w for k, w in zip(words.number.tolist(), named))  # equal numbers, equal words
    got = [(int(o), [name_of[k] for k in row if k < len(words.cells)]) for o, row in zip(owner, numbers.tolist())]
    assert got == [(i, w) for i, t in enumerate(texts) for w in brute_windows(brute_words(t))]


def test_grams_against_plain_python():
    words = G.Words([b"ab lowei z"], [True])
    own = {words.bytes.tobytes()[words.start[i] : words.end[i]]: n for i, n in enumerate(words.number)}
    first = np.cumsum(words.gram_count) - words.gram_count

    def cell(gram):
        code = 0
        for byte in gram:
            code = (code * 257 + byte) % (1 << 64)
        return int(G._finished(np.array([code], np.uint64))[0] % np.uint64(G.GRAM_CELLS))

    for word, n in own.items():
        padded = b"  " + word + b" "
        assert words.grams[first[n] : first[n] + words.gram_count[n]].tolist() == [cell(padded[i : i + 4]) for i in range(len(padded) - 3)]


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    words = G.Words([b"one two three two one four", b"five one six"], [True] * 2)
    _, numbers, _ = words.windows([True] * 2)
    net = G.Network({k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in G.Network.start().w.items()})
    labels = np.array([1.0, 0.0])

    def loss():
        x = net.forward(net.inputs(net.embed(words)).astype(np.float64), numbers)[0].astype(np.float64)
        return float((np.logaddexp(0, x) - labels * x).sum())

    embedded = net.embed(words)
    logits, kept = net.forward(net.inputs(embedded), numbers, True)
    grads, by_word = net.gradients(kept, embedded, numbers, G._sigmoid(logits) - labels)
    grads["word"] = G._summed(words.cells, by_word[:, : G.WORD_DIM], G.WORD_CELLS)
    grads["gram"] = G._summed(words.grams, np.repeat(by_word[:, G.WORD_DIM :] / words.gram_count[:, None], words.gram_count, axis=0), G.GRAM_CELLS)
    for k, g in grads.items():
        flat, at = net.w[k].reshape(-1), np.unravel_index(np.abs(g).argmax(), g.shape)
        i = int(np.ravel_multi_index(at, g.shape))
        kept_value, step = flat[i], 2e-2
        flat[i] = kept_value + step
        up = loss()
        flat[i] = kept_value - step
        down = loss()
        flat[i] = kept_value
        assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=0.05, abs=2e-3), k


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(2)
    return G.Network({k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in G.Network.start().w.items()})


def brute_score(net, text):
    """One window at a time, one text at a time, with the plain formulas."""
    out = []
    for window in brute_windows(brute_words(text)):
        words = G.Words([b" ".join(window)], [True])
        embedded = net.embed(words)[words.number]
        states = []
        for side in (0, 1):
            h, seen = np.zeros(G.HIDDEN), []
            for e in embedded if side == 0 else embedded[::-1]:
                x, u = e @ net.w["X"][side] + net.w["x"][side], h @ net.w["U"][side]
                z, r = (1 / (1 + np.exp(-(x[i * G.HIDDEN : (i + 1) * G.HIDDEN] + u[i * G.HIDDEN : (i + 1) * G.HIDDEN]))) for i in (0, 1))
                h = z * h + (1 - z) * np.tanh(x[2 * G.HIDDEN :] + r * u[2 * G.HIDDEN :])
                seen.append(h)
            states.append(seen if side == 0 else seen[::-1])
        both = np.hstack([np.array(s).reshape(-1, G.HIDDEN) for s in states])
        focus = np.exp(np.tanh(both @ net.w["A"] + net.w["a"]) @ net.w["v"])
        pooled = (focus[:, None] * both).sum(axis=0) / max(focus.sum(), 1e-30)
        out.append(float(pooled @ net.w["c"] + net.w["b"][0]))
    return max(out), len(out)


def test_scores_against_one_window_at_a_time(net, spark, docs_of):
    texts = some_texts() + [None]
    want = [brute_score(net, t) for t in texts]
    got, many = G.score_texts(net, texts)
    assert many.tolist() == [n for _, n in want] and np.allclose(got, [x for x, _ in want], atol=1e-4)
    rows = G.score(docs_of([(i, t) for i, t in enumerate(texts)] + [(None, "x"), (0, "")]), net.w).collect()
    assert len(rows) == len(texts) + 2 and all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("piece", [64, 257, 1000, 5000])
def test_long_texts_go_piece_by_piece(net, monkeypatch, piece):
    texts = some_texts() + ["lorem ipsum dolor " * 700, "longrunwithoutanyspace" * 300, "., " * 900 + "end"]
    monkeypatch.setattr(G, "PIECE", 1 << 30)
    want, many = G.score_texts(net, texts)
    monkeypatch.setattr(G, "PIECE", piece)
    got, count = G.score_texts(net, texts)
    assert count.tolist() == many.tolist() and np.allclose(got, want, atol=1e-5)


def test_held_out_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op12_toxicity"](spark, sf)
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows.count() == documents.count()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = rows.filter("held_out").join(labels, "doc_id").select("doc_id", "toxic", "score", "predicted").collect()
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in found)
    # 45 labelled toxic documents only, a few of them without any toxic word
    assert sum(r.predicted == r.toxic for r in found) / len(found) >= 0.85
    assert rows.filter(~crc_mod("doc_id", 4).eqNullSafe(2)).filter("held_out").count() == 0


def test_the_fit_is_bounded_and_blind_to_held_out_labels(spark, docs_of):
    bad, good = "you utter scumbag of a fool " * 4, "a pleasant walk in the green park " * 4
    docs = docs_of([(i, bad if i % 2 else good) for i in range(80)] + [(1, "another text")] * 50 + [(None, bad)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(5, 0), (7, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    seen = []
    fitted, G.fit = G.fit, lambda texts, y, share: seen.append((texts, y, share))
    try:
        G.learn(docs, labels, sample=20)
        G.learn(docs, labels, sample=20, sample_chars=1000)
    finally:
        G.fit = fitted
    assert 30 <= len(seen[0][0]) <= 40 and sum(map(len, seen[1][0])) <= 1000 and len(seen[1][0]) >= 5
    assert G.learn(docs, labels.limit(0)) is None and G.learn(docs_of([]), labels) is None
    got = {r.doc_id: r.score for r in G.score(docs_of([(1, bad), (2, good), (3, None), (4, "new words only")]), G.learn(docs, labels)).collect()}
    assert got[1] > 0.5 > got[2] and 0 <= got[3] <= 1
    assert [r.score for r in G.score(docs_of([(1, "x"), (2, None)]), None).collect()] == [0.5, 0.5]
    assert G.score(docs_of([]), None).collect() == []


def test_clashing_columns(spark, net):
    odd = spark.createDataFrame([("k", "text", 1, 2, 3)], "doc_id string, text string, _text int, score int, windows int")
    assert [(r.doc_id, r.windows) for r in G.score(odd, net.w).collect()] == [("k", 1)]
    labels = spark.createDataFrame([("k", 1, "t", 5)], "doc_id string, toxic int, text string, _label int")
    assert G.learn(odd, labels) is not None
