import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from yardstream.llm import token_store as S
from yardstream.llm.common import shared_path

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["a,b c,. d", "Ab, É É, J\u030c, ΑΣ ΣΑ, İ", "<|endoftext|> x<|endoftext|>y <|startoftext|>", "it's don't,'ve 's .'s", "x .\u0301 y, \u0301z", "\x1c \x85 a b\xa0c 12,3 ١٢ ²", "", "hello,  world. \n\nA.B. (x), y!) z", None, "\U0001f600\U0001f600 # \" #", "x" * 5000]


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def brute(rows):
    out, start = [], 0
    for doc, text in rows:
        ids = ids_of(text)
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def result(df):
    return [tuple(r) for r in df.orderBy("start").collect()]


def test_against_the_tokenizer(documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    assert result(S.encode_to_store(documents, PATH)) == brute(rows)


def test_hard_texts(docs_of):
    rows = [(i * 10, t) for i, t in enumerate(HARD)]
    assert result(S.encode_to_store(docs_of(rows[::-1]), PATH)) == brute(rows)


@pytest.mark.parametrize("limits", [(64, 16_384), (1 << 20, 3)])
def test_small_shards_and_keyed_access(spark, docs_of, limits):
    rows = [(i * i, f"text number {i} with words") for i in range(60)] + [(7, "seven one"), (7, "seven two"), (7, "seven two")]
    path = shared_path(spark, "store")
    S.write_store(docs_of(rows), path, PATH, *limits)
    assert spark.read.parquet(f"{path}/shards").count() > 5
    got = result(S.read_store(spark, path))
    assert [g[0] for g in got] == sorted(r[0] for r in rows)
    assert sorted(g[2:] for g in got) == sorted(b[2:] for b in brute(rows))
    keys = spark.createDataFrame([(0,), (49,), (7,), (8,), (3481,), (10**9,), (-1,), (None,), (49,)], "doc_id long")
    found = sorted((r.doc_id, tuple(r.ids)) for r in S.lookup(spark, path, keys).collect())
    want = sorted((d, tuple(ids_of(t))) for d, t in rows if d in (0, 49, 7, 3481))
    assert found == want


def test_edges(spark, docs_of):
    rows = [(None, "none"), (1, None), (1, None), (2, ""), (None, None)]
    got = result(S.encode_to_store(docs_of(rows), PATH))
    assert [g[0] for g in got] == [None, None, 1, 1, 2] and [g[2] for g in got if g[0]] == [1, 1, 1]
    path = shared_path(spark, "store")
    S.write_store(docs_of([]), path, PATH)
    assert S.read_store(spark, path).count() == 0
    assert S.lookup(spark, path, spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_index_is_minimal_and_perfect():
    for n in (1, 2, 7, 1000, 16_384):
        hashes = S.key_hashes([f"k{i}" for i in range(n)])
        seeds, slots = S.build_index(hashes)
        assert sorted(slots) == list(range(n))
        assert (S.find_slots(hashes, seeds, n) == slots).all()


def test_memory_may_run_over(monkeypatch):
    texts = [f"w{i} q{i % 7}, And." for i in range(300)]
    want = [np.array(ids_of(t)[:-1], "<u2").tobytes() for t in texts]
    monkeypatch.setattr(S, "MEMO", 20)
    encoder = S.Encoder(PATH, 2)
    assert [x for i in range(0, 300, 50) for x in encoder.encode(texts[i : i + 50])] == want
