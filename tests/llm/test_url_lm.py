import math
import re
from collections import defaultdict

import pytest
import xxhash

from yardstream.llm import url_lm as U

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    best = None
    for kind, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, kind)
    return best or (None, None)


def brute(urls):
    """url -> (host, path, rule, verdict, score), by dictionaries of counts."""
    counts = {"a": defaultdict(int), "r": defaultdict(int)}
    known, held = {}, {}
    for u in urls:
        known[u] = rule(*parts(u))[1]
        h = xxhash.xxh64_intdigest((u or "").encode(), 42)
        held[u] = (h - (1 << 64) if h >> 63 else h) % 4 == 0
        if known[u] and not held[u]:
            text = "\x02" * 4 + (u or "")
            for i in range(len(u or "")):
                for k in range(1, 6):
                    counts["a" if known[u] == "allow" else "r"][text[i + 5 - k : i + 5]] += 1
    sums, kinds = {c: defaultdict(int) for c in "ar"}, {c: defaultdict(int) for c in "ar"}
    for c in "ar":
        for g, n in counts[c].items():
            sums[c][len(g), g[:-1]] += n
            kinds[c][len(g), g[:-1]] += 1

    def prob(c, gram):
        q = 1 / 256
        for k in range(1, 6):
            g = gram[5 - k :]
            n, t = sums[c][k, g[:-1]], kinds[c][k, g[:-1]]
            q = (counts[c][g] + t * q) / (n + t) if n + t else q
        return q

    score = {}
    for u in set(urls):
        text = "\x02" * 4 + (u or "")
        logs = [math.log(prob("a", text[i : i + 5])) - math.log(prob("r", text[i : i + 5])) for i in range(len(u or ""))]
        score[u] = sum(logs) / len(logs) if logs else None
    stats = {}
    for kind in ("allow", "block"):
        x = [score[u] for u in set(urls) if held[u] and known[u] == kind and score[u] is not None]
        if x:
            m = sum(x) / len(x)
            stats[kind] = (m, (sum((v - m) ** 2 for v in x) / len(x)) ** 0.5)
    line = None
    if len(stats) == 2:
        (ma, sa), (mr, sr) = stats["allow"], stats["block"]
        line = (ma * sr + mr * sa) / (sa + sr) if sa + sr else (ma + mr) / 2
    return {u: (*parts(u), rule(*parts(u))[0], known[u] or ("block" if line is not None and score[u] is not None and score[u] < line else "allow"), score[u]) for u in set(urls)}


def check(df):
    rows = df.collect()
    want = brute([r.url for r in rows])
    got = U.filter_urls(df, RULES).collect()
    assert sorted(r.page_id for r in got if r.page_id is not None) == sorted(r.page_id for r in rows if r.page_id is not None) and len(got) == len(rows)
    url = {r.page_id: r.url for r in rows}
    for r in got:
        w = want[url[r.page_id]]
        assert (r.host, r.path, r.rule, r.verdict) == w[:4], url[r.page_id]
        assert r.score == pytest.approx(w[4]) if w[4] is not None else r.score is None
    return got


def test_against_brute_force(spark, small):
    check(spark.read.parquet(f"{small}/pages.parquet"))
    got = check(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_edge_urls(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://WWW.EXAMPLE.ORG/ES/", "http://example.org/es/", "http://example.org", "http://example.org?x=/es/", "http://notexample.org/es/", "http://org/", "x://a.com/fr/b://c.com/de/", "http://ÄB.com/de/\u0301", "http://a.com:80/de/", "http://a.org/en/1#y", "http://b.example.org/en/12", "http://a.com/de/" + "z" * 20_000, "http://example.org/es/"]
    check(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_without_a_class_everything_else_is_allowed(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.net/{i}") for i in range(20)] + [(None, "http://x.org/1")], "page_id long, url string")
    assert {r.verdict for r in U.filter_urls(df, RULES).collect()} == {"allow"}


def test_learns_what_the_rules_show(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = U.filter_urls(pages, RULES).collect()
    scored = {"allow": [], "block": []}
    for r in got:
        if r.rule:
            scored[r.verdict].append(r.score)
    mean = {k: sum(v) / len(v) for k, v in scored.items()}
    assert mean["allow"] > 0 > mean["block"]
