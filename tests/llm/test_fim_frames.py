import hashlib

import pytest
import zstandard

from yardstream.llm import fim_frames as M
from yardstream.llm.queries import QUERIES


def brute(doc_id, text):
    """The contract in plain strings."""
    text = text or ""
    n, hexed = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, sha("<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]), sha(text)
    return doc_id, n, "psm", a, b - a, sha("<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]), sha(text)


def key(row):
    return tuple((x is None, x) for x in row)


ODD = [None, "", "x", "é🤦🏼‍♂️" * 7, "ends with <", "<P>", "a <M> b", "<<S", "S><P", "\n\t ", "ß" * 1000, "longer text of words " * 50]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, M.FRAME])
def test_odd_texts_against_plain_strings(spark, docs_of, tmp_path, size):
    rows = [(i, t) for i, t in enumerate(ODD * 6)] + [(None, "no id"), (None, None), (3, "repeated id"), (3, "repeated id")]
    got = M.fill_in_middle(docs_of(rows), f"{tmp_path}/store", size)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((brute(*r) for r in rows), key=key)


def test_query_against_plain_strings(spark, small, documents):
    got = sorted(tuple(r) for r in QUERIES["op13_fill_in_middle"](spark, small).collect())
    assert got == sorted(brute(r.doc_id, r.text) for r in documents.collect())
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_rearranged_texts_are_real(docs_of):
    rows = [(i, f"document {i} of some words " * (i + 1)) for i in range(40)]
    store = M.to_frames(docs_of(rows), 16)
    out = {r.doc_id: r.text for r in M.texts(M.rearrange(store, size=16)).collect()}
    assert [hashlib.sha256(out[i].encode()).hexdigest() for i, _ in rows] == [brute(*r)[5] for r in rows]
    assert {r.doc_id: r.text for r in M.texts(store).collect()} == dict(rows)


def test_only_cut_frames_are_decompressed():
    text = "".join(f"{i:05d}" for i in range(200))
    pack, writer = zstandard.ZstdCompressor(), M.FrameWriter(zstandard.ZstdCompressor(), 10)
    writer.text(text)
    writer.flush()

    class Counting:
        calls = 0

        def decompress(self, frame):
            Counting.calls += 1
            return zstandard.ZstdDecompressor().decompress(frame)

    out = M.FrameWriter(pack, 10)
    M.rearranged(M.Frames(writer.ends, writer.frames, Counting()), "psm", 333, 777, out)
    assert Counting.calls == 4  # each of two cut frames, from both sides
    assert len(set(out.frames) & set(writer.frames)) == 98 and out.ends[-1] == 1009


def test_very_long_text_and_rates(docs_of):
    text = "".join(map(chr, range(0x20, 0xD7FF))) * 40  # two million code points, marks nowhere
    store = M.to_frames(docs_of([(1, text), (2, "short")]))
    for fim, spm, form in ((0, 0, "plain"), (100, 0, "psm"), (100, 100, "spm")):
        got = M.digests(M.rearrange(store, fim, spm, "other salt")).collect()
        assert [r.form for r in got] == [form] * 2
        assert {r.restored_sha256 for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in (text, "short")}


def test_empty_table_and_clashing_columns(spark, docs_of):
    assert M.digests(M.rearrange(M.to_frames(docs_of([])))).collect() == []
    odd = spark.createDataFrame([("k", "some text", "a", "b", 3, "c")], "doc_id string, text string, _utf8 string, frames string, n int, form string")
    row = M.digests(M.rearrange(M.to_frames(odd))).first()
    assert (row.doc_id, row.n, row.restored_sha256) == ("k", 9, hashlib.sha256(b"some text").hexdigest())
