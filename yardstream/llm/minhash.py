"""Document fingerprints: one-permutation MinHash, densified, packed to a few bits per bin."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardstream.llm.common import let, staged

SHINGLE, BINS, BITS = 5, 256, 4
_SHIFT = 64 - 8  # a hash's upper bits name its bin, the others are its value
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents that a task should meet when neighbours are looked up.
SLICE_ROWS = 2_000


def shingle_hashes(text: Column) -> Column:
    """Hashes of the runs of SHINGLE words (A-Z lower-cased, white space apart); fewer words are one run."""
    words = F.split(F.btrim(F.translate(text, _UPPER, _LOWER), F.lit(" \t\n\x0b\f\r")), "[ \\t\\n\\u000b\\f\\r]+")
    run = lambda w, i: F.xxhash64(*[w[i + k] for k in range(SHINGLE)])
    return let(words, lambda w: F.when(F.size(w) <= SHINGLE, F.array(F.xxhash64(w))).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: run(w, i))))


def _sorted_minima(hashes: Column) -> Column:
    """The smallest value of every bin in the order of the bins; an empty bin shows the largest value there is."""
    low = F.array(*[F.lit(((b - BINS // 2) << _SHIFT) + (1 << _SHIFT) - 1) for b in range(BINS)])
    bin_of = lambda x: F.shiftright(x, _SHIFT)
    return let(F.sort_array(F.concat(hashes, low)), lambda v: F.filter(v, lambda x, i: (i == 0) | (bin_of(x) != bin_of(v[F.greatest(i - 1, F.lit(0))]))))


def probe(b: int, t: int) -> int:
    """Bin that empty bin ``b`` looks at in step ``t``: first + t * step, with both hashed from ``b`` and the step odd."""
    h = (b + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    return ((h >> 40) + t * ((h >> 20) | 1)) % BINS


def _densified(minima: Column) -> Column:
    """Values of all bins; an empty bin takes that of a full bin chosen by its own probe sequence.

    A probe sequence meets every bin in BINS steps, each full bin is as likely
    as any other, and the choice does not depend on what neighbours hold.  The
    first steps are a table made from the rule; ``coalesce`` stops at the first
    full bin.  Only where all of them are empty the rest of the sequence is made.
    """
    top, near = F.lit((1 << _SHIFT) - 1), 24
    table = F.from_json(F.lit(json.dumps([probe(b, t) for b in range(BINS) for t in range(near)])), "array<int>")
    first = F.from_json(F.lit(json.dumps([probe(b, 0) for b in range(BINS)])), "array<int>")
    step = F.from_json(F.lit(json.dumps([(probe(b, 1) - probe(b, 0)) % BINS for b in range(BINS)])), "array<int>")
    values = F.transform(minima, lambda x: F.nullif(x.bitwiseAND(top), top))

    def fill(x: Column, b: Column, m: Column) -> Column:
        later = F.transform(F.sequence(F.lit(near), F.lit(BINS - 1)), lambda t: m[(first[b] + t * step[b]).bitwiseAND(F.lit(BINS - 1))])
        return F.coalesce(x, *[m[table[b * near + t]] for t in range(near)], F.get(F.filter(later, lambda v: v.isNotNull()), F.lit(0)))

    return let(values, lambda m: F.transform(m, lambda x, b: fill(x, b, m)))


def fingerprint(text: Column) -> Column:
    """The low BITS (4) of each bin's value as one hexadecimal digit: BINS digits.

    Equal texts have equal fingerprints.  Null counts as empty; an empty or
    blank text has one shingle, a run of one empty word.
    """
    digits = F.transform(_densified(_sorted_minima(shingle_hashes(F.coalesce(text, F.lit(""))))), lambda v: F.substring(F.lit("0123456789abcdef"), v.bitwiseAND(F.lit(15)).cast("int") + 1, F.lit(1)))
    return F.array_join(digits, "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints, from 0 to 1.

    The share E of equal digits is J + (1 - J) / 16, as different values agree in
    4 low bits by chance: J = (E - 1/16) / (1 - 1/16), not below 0.
    """
    ones = F.lit(0x1111111111111111)

    def differing(x: Column, y: Column, i: int) -> Column:
        half = lambda v, k: F.conv(F.substring(v, i * 16 + 1 + 8 * k, 8), 16, 10).cast("long")
        word = lambda v: F.shiftleft(half(v, 0), 32).bitwiseOR(half(v, 1))
        return let(word(x).bitwiseXOR(word(y)), lambda d: F.bit_count(reduce(lambda p, q: p.bitwiseOR(q), [F.shiftrightunsigned(d, k) for k in range(BITS)]).bitwiseAND(ones)))

    chance = 2.0**-BITS
    share = lambda x, y: 1 - reduce(lambda p, q: p + q, [differing(x, y, i) for i in range(BINS * BITS // 64)]) / F.lit(float(BINS))
    both = F.struct(a.alias("x"), b.alias("y"))
    return let(both, lambda p: F.when(p["x"] == p["y"], 1.0).otherwise(F.greatest(F.lit(0.0), (share(p["x"], p["y"]) - chance) / (1 - chance))))


def with_next(documents: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """``documents`` (doc_id integer, text) with ``derived`` columns and struct ``following``.

    ``following`` holds text and the derived columns of the next row in
    descending order of doc_id; the last row gets the first one's.  Nulls come
    last, rows that repeat a doc_id stand in the order of a hash of their text,
    a single row follows itself.

    Rows are dealt out by slices of doc_id: its quantiles, evenly cut again in
    large tables, so dense and sparse stretches make slices alike.  They are
    ordered within a slice; the first row of each slice serves the slice before.
    This is the one shuffle of the texts, and it carries each of them once.
    """
    n = documents.count()
    k = min(256, n // SLICE_ROWS + 1)
    at = sorted({int(c) for c in documents.filter("doc_id is not null").stat.approxQuantile("doc_id", [i / k for i in range(k + 1)], 0.2 / k)})
    fine = max(1, n // (k * SLICE_ROWS))
    if at:
        bounds = F.array(*[F.lit(c) for c in at])
        q = let(F.greatest(F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))), F.lit(1)), lambda i: i)
        low, high = bounds[F.col("_q") - 1], F.coalesce(F.get(bounds, F.col("_q")), F.lit(at[-1]) + 1)
        inside = F.least(F.greatest(F.floor((F.col("doc_id") - low) * fine / F.greatest(high - low, F.lit(1))), F.lit(0)), F.lit(fine - 1))
    else:
        q, inside = F.lit(1), F.lit(0)
    # Larger slice numbers hold smaller ids; nulls have the largest.
    number = F.when(F.col("doc_id").isNull(), F.lit((len(at) + 2) * fine)).otherwise((len(at) + 1 - F.col("_q")) * fine + (fine - 1 - inside)).cast("long")
    rows = documents.withColumn("_q", q).withColumns({"_slice": number, "_tie": F.xxhash64("text")}).drop("_q")
    window = Window.partitionBy("_slice").orderBy(F.col("doc_id").desc_nulls_last(), "_tie", "text")
    value = lambda of: F.struct(*[of(c).alias(c) for c in ("text", *derived)])
    full = rows.withColumns(derived)
    # Heads are found by their ids alone; the broadcast of these, one a slice, keeps the other texts out of a shuffle.
    keys = rows.groupBy("_slice").agg(F.max("doc_id").alias("_key")).withColumnRenamed("_slice", "_of")
    heads = rows.join(F.broadcast(keys), (F.col("_slice") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_key"))).groupBy("_slice").agg(F.min(F.struct("_tie", "text")).alias("_h"))
    heads = staged(heads.select("_slice", F.col("_h.text").alias("text")).withColumns(derived).select("_slice", value(F.col).alias("_head")), "slice-heads")
    order = Window.orderBy("_slice")
    turn = heads.select("_slice").withColumn("_next", F.coalesce(F.lead("_slice").over(order), F.first("_slice").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    border = turn.join(heads.withColumnRenamed("_slice", "_next"), "_next").select("_slice", "_head")
    # Column by column: a struct to lead would be made before the shuffle, and carry each text a second time.
    later = F.when(F.lead("_tie").over(window).isNotNull(), value(lambda c: F.lead(c).over(window)))
    return full.withColumn("_in", later).join(border, "_slice").withColumn("following", F.coalesce("_in", "_head")).drop("_slice", "_tie", "_in", "_head")


def edited_text(text: Column, other: Column) -> Column:
    """The last third (rounded down) of the code points replaced by the first as many, or all, of ``other``."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(other, F.lit(1), third))


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for ``documents`` (doc_id, text).

    The edited text is ``edited_text`` of a document and the next one in
    descending order of doc_id (see ``with_next``); near_* are the likenesses
    of the document's fingerprint to those of the edited text and of the next
    document.  Null texts count as empty.  Every row gives a row.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, {"fingerprint": fingerprint(F.col("text"))})
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint", F.col("following.fingerprint").alias("_next"), edited_text(F.col("text"), F.col("following.text")).alias("_edited"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("_edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))
