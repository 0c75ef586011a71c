"""URL filter: rules first, then the ratio of two character language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardstream.llm.common import staged

#: Longest gram: a character after up to four others.
ORDER = 5
#: Equally likely characters below the shortest context.
ALPHABET = 256.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands before the first character, so that every character has ORDER - 1 before it.
_PAD = "\x02" * (ORDER - 1)


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased (no such mark: empty)."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end (no :// : empty)."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one.

    ``rules`` holds (verdict, host, path).  A rule fits its host and all
    subdomains if the path starts with the rule's.  Of equally long rules the
    first listed wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones are longer and override
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _grams(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per character of ``_model`` with its gram: itself after the ORDER - 1 before it."""
    padded = F.concat(F.lit(_PAD), "_model")
    places = F.sequence(F.lit(1), F.length("_model"))
    return pages.filter(F.length("_model") > 0).select(*keep, F.explode(F.transform(places, lambda i: F.substring(padded, i, F.lit(ORDER)))).alias("gram"))


def gram_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log P(last character | the others) under the accepted minus the rejected model.

    ``counts`` has gram, a and r: how often accepted and rejected URLs show it.
    A context of k characters gives the smoothed estimate (Witten-Bell)
    (n + t * shorter) / (total + t), with t the number of different characters
    seen after it and ``shorter`` the estimate with one character less; contexts
    never seen hand over to the shorter one.  Everything here works on distinct
    grams, not on URLs.
    """
    levels = {}
    for k in range(1, ORDER + 1):
        by = counts.groupBy(F.substring("gram", ORDER - k + 1, k).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        levels[k] = staged(by, f"grams-{k}")
    total = {c: F.sum(c).alias(f"n{c}") for c in "ar"}
    kinds = {c: F.count_if(F.col(c) > 0).alias(f"t{c}") for c in "ar"}
    below = None
    for k in range(1, ORDER + 1):
        context = F.substring("g", 1, k - 1)
        sums = levels[k].groupBy(context.alias("h")).agg(*total.values(), *kinds.values())
        rows = levels[k].join(sums, context == F.col("h"))
        if below is None:
            rows = rows.withColumns({"qa": F.lit(1 / ALPHABET), "qr": F.lit(1 / ALPHABET)})
        else:
            shorter = below.select(F.col("g").alias("s"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
            rows = rows.join(shorter, F.substring("g", 2, k - 1) == F.col("s"))
        smooth = lambda c: F.when(F.col(f"n{c}") + F.col(f"t{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"q{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(F.col(f"q{c}"))
        below = rows.select("g", smooth("a").alias("pa"), smooth("r").alias("pr"))
    return below.select(F.col("g").alias("gram"), (F.log("pa") - F.log("pr")).alias("ratio"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, score) for every row of ``pages`` (key, url).

    The URLs that a rule decides train the two models (three quarters of them by
    hash of the URL) and calibrate the threshold (the rest: where the two
    classes' mean scores are equally many standard deviations away).  Other URLs
    are allowed when their score, the log-likelihood difference per character,
    reaches it.  ``rules`` is a short list that becomes part of the plan.

    Rows are scored by text, so repeated URLs are judged once and share a
    verdict.  A null or empty URL has empty host and path, no rule, no score,
    and is allowed, as is every URL without a rule when the rules decide no URL
    or only one way: there is nothing to hold against it.
    """
    urls = pages.groupBy("url").agg(F.count("*").alias("times")).withColumn("_model", F.coalesce(F.col("url"), F.lit("")))
    host, path = url_host(F.col("_model")), url_path(F.col("_model"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "known": verdict})
    urls = staged(urls.withColumn("held", F.pmod(F.xxhash64("_model"), F.lit(4)) == 0), "urls")
    learns = ~F.col("held") & F.col("known").isNotNull()
    counts = _grams(urls, "times", "known", "held").groupBy("gram").agg(
        F.sum(F.when(learns & (F.col("known") == "allow"), F.col("times")).otherwise(0)).alias("a"),
        F.sum(F.when(learns & (F.col("known") == "block"), F.col("times")).otherwise(0)).alias("r"))
    ratios = staged(gram_ratios(staged(counts, "grams")), "gram-ratios")
    scores = _grams(urls, "url").join(ratios, "gram").groupBy("url").agg(F.avg("ratio").alias("score")).withColumnRenamed("url", "_url")
    scored = staged(urls.join(scores, F.col("url") == F.col("_url"), "left").drop("_url", "_model"), "url-scores")
    line = threshold(scored.filter("held and known is not null"))
    verdict = F.coalesce("known", F.when(F.col("score") < F.lit(line).cast("double"), "block").otherwise("allow"))
    judged = scored.select(F.col("url").alias("_url"), "host", "path", "rule", verdict.alias("verdict"), "score")
    return pages.select(key, "url").join(judged, F.col("url").eqNullSafe(F.col("_url"))).select(key, "host", "path", "rule", "verdict", "score")


def threshold(labelled: DataFrame) -> float | None:
    """Score at which both classes (known: allow, block) are equally many deviations from their means.

    None when a class is missing.  Four numbers come to the driver.
    """
    stats = {r["known"]: (r["m"], r["s"] or 0.0) for r in labelled.filter("score is not null").groupBy("known").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()}
    if len(stats) < 2:
        return None
    (ma, sa), (mr, sr) = stats["allow"], stats["block"]
    return (ma * sr + mr * sa) / (sa + sr) if sa + sr > 0 else (ma + mr) / 2
