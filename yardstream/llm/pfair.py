"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yardstream.llm.common import own_prefix, staged

#: Documents in a block: the unit that is scheduled.
BLOCK = 8
#: Slots of a period; weights are rounded to multiples of 1 / PERIOD.
PERIOD = 4096
#: Rows that a numbering task should meet.
SLICE_ROWS = 2_000
#: Columns that ``schedule`` adds.
PLACES = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_rank")


def quantised(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Blocks per period for each source, summing to the period (largest remainders; one block at least).

    The period is widened to four slots a source where there are very many.
    """
    named = {k: Fraction(w).limit_denominator(10**12) for k, w in weights.items() if w > 0}
    if not named:
        raise ValueError("no source has a positive weight")
    period = max(period, 4 * len(named))
    total = sum(named.values())
    exact = {k: w / total * period for k, w in named.items()}
    out = {k: max(1, int(x)) for k, x in exact.items()}
    by_rest = sorted(out, key=lambda k: (int(exact[k]) - exact[k], k))
    rest, i = period - sum(out.values()), 0
    while rest:
        k = by_rest[i % len(by_rest)] if rest > 0 else max(out, key=lambda x: (out[x] - exact[x] if out[x] > 1 else -1, x))
        out[k] += 1 if rest > 0 else -1
        rest += -1 if rest > 0 else 1
        i += 1
    return out


def period_schedule(blocks: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, nth, release, deadline, slot) for the blocks of one period, earliest deadline first.

    With weight w = blocks / period, block n (from 0) may run from floor(n / w)
    on and must be done by ceil((n + 1) / w).  One slot serves one block, so
    the windows can always be met and at every time each source has had within
    one block of its share.  All windows end with the period: the same pattern
    repeats for ever.
    """
    period = sum(blocks.values())
    window = lambda k, n: (n * period // blocks[k], -(-(n + 1) * period // blocks[k]))
    waiting = [(0, k, 0) for k in blocks]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, k, n = heapq.heappop(waiting)
            heapq.heappush(ready, (window(k, n)[1], k, n, release))
        deadline, k, n, release = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a window was missed")
        out.append((k, n, release, deadline, slot))
        if n + 1 < blocks[k]:
            heapq.heappush(waiting, (window(k, n + 1)[0], k, n + 1))
    return out


def source_key():
    """The source, with one name for null."""
    return F.coalesce(F.col("source"), F.lit(""))


def schedule(documents: DataFrame, weights: dict[str, float], block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """``documents`` with mix_block, mix_release, mix_deadline, mix_slot and mix_rank.

    A source's documents are put in a fixed pseudo-random order (a hash of
    doc_id and text; identical rows are interchangeable) and cut into blocks of
    ``block``.  Block n of a source gets release, deadline and slot from
    ``period_schedule``; reading in the order (mix_slot, mix_rank) keeps every
    source within one block of its target share as long as no source has run
    out.  Slots of a source that has run out stay empty: the others go on in
    their proportions.  mix_rank numbers the documents of a source from 0.

    Only one period of slots is simulated, whatever the data's size: the table
    that is broadcast has ``period`` rows.  Numbering works per (source, slice of
    the hash), so a source with most rows is spread.

    A null source counts as ''.  A source without weight gets no slot (null in
    all columns but mix_rank and mix_block).  Repeated rows are documents of
    their own; an empty table stays empty.  Columns of ``documents`` named like
    one of the five are replaced, others stay whatever their names.
    """
    names = [c for c in documents.columns if c.lower() not in PLACES]
    rows = documents.select(*[F.col(f"`{c}`") for c in names])
    placed, p = _placed(rows, weights, block, period)
    return placed.select(*[F.col(f"`{c}`") for c in names], *[F.col(f"{p}{c}").alias(c) for c in PLACES])


def _placed(documents: DataFrame, weights: dict[str, float], block: int, period: int) -> tuple[DataFrame, str]:
    """``documents`` with the places of ``schedule`` and the source key, and the prefix that keeps these names apart from those of ``documents``."""
    spark, p = documents.sparkSession, own_prefix(documents.columns)
    source, nth, slice_, order = f"{p}source", f"{p}nth", f"{p}slice", f"{p}order"
    pattern = period_schedule(quantised(weights, period))
    period = len(pattern)
    sizes: dict[str, int] = {}
    for row in pattern:
        sizes[row[0]] = sizes.get(row[0], 0) + 1
    table = spark.createDataFrame(pattern, f"{source} string, {nth} long, {p}release long, {p}deadline long, {p}slot long")
    per = spark.createDataFrame(list(sizes.items()), f"{source} string, {p}per long")
    keyed = documents.withColumns({source: source_key(), order: F.xxhash64("doc_id", "text")})
    n_slices = max(1, documents.count() // SLICE_ROWS + 1)
    cut = F.floor((F.shiftright(F.col(order), 1).cast("double") / 2.0**63 + 0.5) * n_slices)
    keyed = keyed.withColumn(slice_, F.least(cut, F.lit(n_slices - 1)))
    counts = keyed.groupBy(source, slice_).agg(F.count("*").alias(f"{p}n"))
    before = Window.partitionBy(source).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(counts.select(source, slice_, F.coalesce(F.sum(f"{p}n").over(before), F.lit(0)).alias(f"{p}before")), "mix-offsets")
    inner = Window.partitionBy(source, slice_).orderBy(order)
    ranked = keyed.withColumn(f"{p}in", F.row_number().over(inner) - 1).join(offsets, [source, slice_])
    ranked = ranked.withColumn(f"{p}mix_rank", (F.col(f"{p}before") + F.col(f"{p}in")).cast("long")).withColumn(f"{p}mix_block", F.floor(F.col(f"{p}mix_rank") / block))
    ranked = ranked.join(F.broadcast(per), source, "left")
    ranked = ranked.withColumns({f"{p}turn": F.floor(F.col(f"{p}mix_block") / F.col(f"{p}per")), nth: F.col(f"{p}mix_block") % F.col(f"{p}per")})
    placed = ranked.join(F.broadcast(table), [source, nth], "left")
    at = lambda c: (F.col(f"{p}turn") * period + F.col(f"{p}{c}")).cast("long")
    return placed.withColumns({f"{p}mix_release": at("release"), f"{p}mix_deadline": at("deadline"), f"{p}mix_slot": at("slot")}), p


def tempered_weights(documents: DataFrame, power: float) -> dict[str, float]:
    """Target weights from the sources' sizes, n ** power (1: as they are, 0: equal).

    One row per source comes to the driver: sources are a catalogue, and the
    weights have to be named there.
    """
    counts = documents.groupBy(source_key().alias("source")).count().collect()
    return {r["source"]: float(r["count"]) ** power for r in counts}


def mix(documents: DataFrame, weights: dict[str, float], block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """``documents`` in the order of the mix, without what exceeds a source's target share.

    The mix is as long as the input.  A source larger than its share of it ends
    there (less than one block beyond); a smaller one is used wholly and its
    empty slots are closed up.  A source without weight goes.  Rows are dealt out by ranges of the slot, so reading
    the written files in order gives the mix.  Columns are those of the input, whatever their names.
    """
    blocks, n = quantised(weights, period), documents.count()
    placed, p = _placed(documents, weights, block, period)
    most = documents.sparkSession.createDataFrame([(k, c * n / sum(blocks.values()) + block) for k, c in blocks.items()], f"{p}source string, {p}most double")
    kept = placed.join(F.broadcast(most), f"{p}source").filter(f"{p}mix_rank < {p}most").select(*[F.col(f"`{c}`") for c in documents.columns], f"{p}mix_slot", f"{p}mix_rank")
    turn = f"{p}mix_slot", f"{p}mix_rank"
    return kept.repartitionByRange(*turn).sortWithinPartitions(*turn).drop(*turn)
