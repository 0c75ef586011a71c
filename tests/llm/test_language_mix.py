import numpy as np
import pytest

from yardstream.llm import language_mix as L
from yardstream.llm.common import crc_mod


@pytest.fixture(scope="module")
def learned(documents):
    return L.learn(documents.filter(crc_mod("doc_id", 4) != 2))


def memory_of(learned):
    return L.Memory(L.Model(learned[0], np.frombuffer(learned[1], np.int64).reshape(len(learned[0]), L.CELLS)))


def test_held_out_accuracy(documents, learned):
    held = documents.filter(crc_mod("doc_id", 4) == 2)
    rows = L.identify(held, learned).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) >= 40
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_counts_against_plain_counting(docs_of):
    rows = [(1, "Ab ab, x1y", "en"), (2, "ab", "en"), (3, "äb", "de"), (4, "ignored", None), (5, None, "fr"), (6, "123", "es")]
    names, table = L.learn(docs_of(rows))
    counts = np.frombuffer(table, np.int64).reshape(len(names), L.CELLS)
    totals = dict(zip(names, counts.sum(axis=1).tolist()))
    assert totals["en"] == 2 + 2 + 2 + 2 and totals["de"] == 2  # "x1y" is two words of one trigram each
    first = L._trigrams(["ab"])[0]
    assert counts[names.index("en")][first].tolist() == [3, 3]


def test_mixed_document_gets_both_languages(documents, learned):
    texts = {r.lang: r.text for r in documents.filter("length(text) between 2000 and 6000").collect()}
    en, de = texts["en"].split()[:200], texts["de"].split()[:100]
    lang, score, known, shares = L.infer([" ".join(en + de)], memory_of(learned))[0]
    assert lang == "en" and set(shares) == {"en", "de"}
    assert abs(shares["de"] - 1 / 3) < 0.1 and abs(score - shares["en"]) < 1e-9
    alone = L.infer([" ".join(en)], memory_of(learned))[0]
    assert set(alone[3]) == {"en"}


def test_five_languages_in_one_document():
    alphabets = ["abcdef", "ghijkl", "mnopqr", "stuvwx", "йцукен"]
    words = [[a + b + c for a in x for b in x for c in x] for x in alphabets]
    counts = np.stack([np.bincount(L._trigrams(w)[0], minlength=L.CELLS) for w in words])
    names = [f"l{i}" for i in range(5)]
    text = " ".join(w for x, n in zip(words, (120, 100, 80, 60, 40)) for w in x[:n])
    lang, score, _, shares = L.infer([text], memory_of((names, counts.tobytes())))[0]
    assert lang == "l0" and set(shares) == set(names)
    assert abs(score - 0.3) < 0.02 and abs(shares["l4"] - 0.1) < 0.02


def test_em_raises_the_likelihood_to_the_best_share():
    rng = np.random.default_rng(1)
    w = rng.random((300, 2)).astype(np.float32) + 0.01
    count = np.ones(300, np.float32)
    share = np.full((1, 2), 0.5)
    for _ in range(40):
        share, likely = L._em(w, count, np.zeros(300, int), np.array([0]), share)
    grid = [np.log(w @ np.array([p, 1 - p])).sum() for p in np.linspace(0, 1, 2001)]
    assert likely[0] >= max(grid) - 1e-2


def test_edges(docs_of, learned):
    odd = [(1, None), (2, ""), (3, "12 34 !"), (4, "²"), (5, "der"), (6, "x" * 100_000), (7, "中文 文字"), (None, "the of and"), (5, "der")]
    got = {(r.doc_id, r.lang_pred): r for r in L.identify(docs_of(odd), learned).collect()}
    assert [k[1] for k in sorted(got, key=str) if k[0] in (1, 2, 3, 4)] == ["und"] * 4
    assert all(got[(i, "und")].score == 0 for i in (1, 2, 3, 4))
    assert L.identify(docs_of([]), learned).count() == 0
    kept = [r.doc_id for r in L.keep_known_languages(docs_of(odd), learned).collect()]
    assert 5 in kept and None in kept and not {1, 2, 3, 4, 7} & set(kept)
    nothing = L.learn(docs_of([]))
    assert L.identify(docs_of([(1, "abc")]), nothing).first().lang_pred == "und"
    assert L.keep_known_languages(docs_of([(1, "abc")]), nothing).count() == 1


def test_memory_can_be_emptied(documents, learned, monkeypatch):
    texts = [r.text for r in documents.limit(60).collect()]
    want = L.infer(texts, memory_of(learned))
    monkeypatch.setattr(L, "MEMO", 50)
    memory, got = memory_of(learned), []
    for i in range(0, 60, 7):
        got += L.infer(texts[i : i + 7], memory)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-4)
