import hashlib
import random
import re

import pytest

from yardstream.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


def test_patterns_against_plain_regular_expressions(documents):
    for r in documents.collect():
        assert P.base_spans(r.text or "") == brute(r.text or "")
    for text in ["a@b.c@d.e", "@b.c@d.e", "x@@b.c", "a@b@c.d", "a@b..c", "1.2.3.4.5", "256.1.1.1", "00001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111-", "0000 0000 0000", "+1 (023) 555-0174.", "+1+22 333 444 555", "é1.2.3.4ü@x.y", "+123456789012345", "+1234567890123456", "1.2.3.4@5.6.7.8"]:
        assert P.base_spans(text) == brute(text), text


@pytest.mark.parametrize("seed", range(4))
def test_patterns_on_random_text(seed):
    rng = random.Random(seed)
    for _ in range(4000):
        text = "".join(rng.choice("a@.+1-0 (59%é") for _ in range(rng.randrange(40)))
        assert P.base_spans(text) == brute(text), text


def test_long_texts_take_linear_time():
    for piece in ("a", "1", "1.", "1 ", "a@", "+1", "+1(", "%"):
        P.base_spans(piece * 200_000)


def spans_of(df):
    return {(r.doc_id, i): [tuple(s) for s in r.spans] for i, r in enumerate(P.find_personal_data(df).collect())}


def corpus():
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi") for b in ("ra", "te", "no") for c in ("sa", "du", "pi", "x")]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{fill(30)}.") for i in range(200)]
    for i in range(6):  # "Falcon" stands only with one address, "harbour" mostly, the rest anywhere
        rows.append((1000 + i, f"{fill(12)} Falcon {fill(2)} bob@mail.example {fill(1)} harbour {fill(20)}"))
    rows += [(2000 + i, f"{fill(10)} harbour {fill(10)}") for i in range(8)]
    return rows


def test_disclosing_terms_are_found_and_replaced(docs_of):
    rows = corpus()
    found = P.find_personal_data(docs_of(rows)).collect()
    marked = {}
    for r in found:
        text = dict(rows)[r.doc_id]
        for s in r.spans:
            if s["kind"] == 4:
                marked.setdefault(text[s["start"] : s["end"]], set()).add(s["action"])
    assert marked == {"Falcon": {"remove"}, "harbour": {"generalise"}}
    out = {r.doc_id: r.text for r in P.sanitise(docs_of(rows)).collect()}
    assert "Falcon" not in out[1000] and "harbour" not in out[1000] and "[email]" in out[1000] and "[word]" in out[1000]
    assert "[word]" in out[2000] and out[0] == rows[0][1]


def test_disclosure_against_plain_counting(docs_of):
    rows = corpus()
    n = len({t for _, t in rows})
    import math

    def disclosure(term):
        e = sum("bob@mail.example" in t for _, t in rows)
        both = sum("bob@mail.example" in t and term in t.lower() for _, t in rows)
        alone = sum(term in t.lower().split() for _, t in rows)
        return math.log(n * both / (e * alone)) / math.log(n / e)

    found = P._find_spans(P._keyed(docs_of(rows)))
    candidates = P._candidates(found)
    got = {r.term: r.disclosure for r in P.disclosing_terms(candidates, P._postings(docs_of(rows), candidates.select("term").distinct()), n).collect()}
    assert got == pytest.approx({"falcon": disclosure("falcon"), "harbour": disclosure("harbour")})


def test_copies_of_one_passage_disclose_nothing(docs_of):
    text = "the Falcon wrote to bob@mail.example about the harbour"
    rows = [(i, text) for i in range(50)] + [(100 + i, f"{text} {i}.") for i in range(50)] + [(200 + i, f"other words {i}") for i in range(50)]
    assert all(s["kind"] == 0 for r in P.find_personal_data(docs_of(rows)).collect() for s in r.spans)


def test_rough_counts(docs_of, monkeypatch):
    df = docs_of(corpus())
    terms = df.sparkSession.createDataFrame([("falcon",), ("harbour",), ("bara",), ("basa",), ("nowhere",)], "term string")
    exact = {t: len({x for _, x in corpus() if t in x.lower().replace(".", " ").split()}) for t in ("falcon", "harbour")}
    got = {r.term: r.n_t for r in P._rough_counts(df, terms).collect()}
    assert got == exact
    monkeypatch.setattr(P, "SKETCH", 8)
    got = {r.term: r.n_t for r in P._rough_counts(df, terms).collect()}
    assert got["falcon"] == 6 and 5 < got["harbour"] < 45


def test_terms_in_several_passes(docs_of, monkeypatch):
    df = docs_of(corpus())
    want = sorted(map(str, spans_of(df).values()))
    monkeypatch.setattr(P, "PASS_TERMS", 1)
    assert sorted(map(str, spans_of(df).values())) == want


def test_edges(docs_of):
    rows = [(1, None), (2, ""), (None, "x@y.zz"), (None, "x@y.zz"), (3, "call +1 (023) 555-0174"), (3, "call +1 (023) 555-0174"), (4, "\U0001f600 a@b.c")]
    df = docs_of(rows)
    got = P.find_personal_data(df).select("doc_id", P.span_text(P.F.col("spans")).alias("s")).collect()
    assert sorted((str(r.doc_id), r.s) for r in got) == sorted([("1", ""), ("2", ""), ("None", "email:0:6"), ("None", "email:0:6"), ("3", "phone:5:22"), ("3", "phone:5:22"), ("4", "email:2:7")])
    clean = P.sanitise(df)
    assert clean.columns == df.columns and clean.count() == 7
    assert {r.text for r in clean.collect()} == {None, "", "[email]", "call [phone]", "\U0001f600 [email]"}
    assert P.find_personal_data(docs_of([])).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_columns_of_any_name_keep_their_values(docs_of):
    from pyspark.sql import functions as F

    df = docs_of([(1, "write to a@b.org", "en", "s"), (None, None, "en", "s"), (1, "other", "en", "s")])
    clash = ["_doc", "_hash", "_spans", "text_hash", "spans", "marks", "a.b"]
    df = df.withColumns({c: F.lit(c) for c in clash})
    out = P.sanitise(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert all(r[c] == c for r in rows for c in clash)
    assert sorted(str(r.text) for r in rows) == ["None", "other", "write to [email]"]
