"""SimHash near-duplicate groups, compared bit plane by bit plane."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardstream.llm.common import map_batches, staged, text_slices
from yardstream.llm.components import component_labels

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Members of a bucket that are compared at once; larger buckets are cut into blocks, and the blocks into pairs.
BUCKET = 16_384


def majority_bits(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits for each run of ``size`` hashes: those set in over half of the run (no hash: 0)."""
    out = np.zeros(len(size), np.uint64)
    ones = np.zeros((len(size), 64), np.int64)
    step, owner = 1 << 16, np.repeat(np.arange(len(size)), size)
    for low in range(0, len(values), step):  # bounded memory: 64 bytes for each shingle of a step
        part, who = values[low : low + step], owner[low : low + step]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.diff(who, prepend=-1))
        ones[who[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    for bit in range(64):
        out |= (2 * ones[:, bit] > size).astype(np.uint64) << np.uint64(bit)
    return out


def simhash_of(texts: list[bytes | None]) -> np.ndarray:
    """64-bit SimHash of UTF-8 texts over 4-word shingles, repeats counted (no word: 0)."""
    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = (text or b"").lower().split()
        n = len(words)
        if n <= SHINGLE:
            if n:
                hashes.append(digest(b" ".join(words), SEED))
            sizes.append(min(n, 1))
            continue
        line = b" ".join(words)
        ends = list(accumulate((len(w) + 1 for w in words), initial=0))
        hashes += [digest(line[low : high - 1], SEED) for low, high in zip(ends, ends[SHINGLE:])]
        sizes.append(n - SHINGLE + 1)
    return majority_bits(np.array(hashes, np.uint64), np.array(sizes, np.int64))


def _add_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "_utf8"):
        values = simhash_of(batch.column("_utf8").to_pylist()).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per row of ``documents``; fp holds the 64 bits as a signed long."""
    utf8 = documents.select("doc_id", F.col("text").cast("binary").alias("_utf8"))
    kind = utf8.schema["doc_id"].dataType.simpleString()
    return map_batches(utf8, _add_fingerprints, f"doc_id {kind}, fp long")


def _bands(n: int) -> list[int]:
    """Bit masks such that two values within the radius agree on one mask at least.

    64 bits cut into m runs: at most RADIUS runs differ, so m - RADIUS agree.
    m grows with the number of fingerprints so that a mask's bucket holds about
    a thousand of them; every m is exact.
    """
    m = RADIUS + 1
    while n > 1024 * 2 ** (64 * (m - RADIUS) // m) and m < 12:
        m += 1
    cuts = [64 * i // m for i in range(m + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(runs, m - RADIUS)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def link_roots(values: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Smallest index linked to each value within its bucket (``bucket`` ascending).

    Every bucket is laid out in blocks of 64 lanes, one machine word per bit
    plane.  A (value, block) pair keeps 64 saturating counters in three words;
    each plane is added by carry-save logic.  Pairs all of whose lanes exceed
    the radius are abandoned as the planes go by.
    """
    n = len(values)
    parent = np.arange(n)
    begin = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
    size = np.diff(np.append(begin, n))
    blocks = -(-size // 64)
    first = np.cumsum(blocks) - blocks
    inside = np.arange(n) - np.repeat(begin, size)
    word, lane = np.repeat(first, size) + inside // 64, inside % 64
    member = np.full((int(blocks.sum()), 64), -1)
    member[word, lane] = np.arange(n)
    live = np.bitwise_or.reduce(np.where(member >= 0, np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0)), axis=1)
    planes = np.zeros((64, len(member)), np.uint64)
    by_lane = np.where(member >= 0, values[member], 0).astype(np.uint64)
    for bit in range(64):
        planes[bit] = np.bitwise_or.reduce(((by_lane >> np.uint64(bit)) & np.uint64(1)) << np.arange(64, dtype=np.uint64), axis=1)
    last = np.repeat(first + blocks, size)
    pairs = last - word  # a value meets its own block and the later ones of its bucket
    bounds, step = np.cumsum(pairs), 1 << 16
    low = 0
    while low < n:
        done = bounds[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(bounds, done + step, "right")))
        who = np.repeat(np.arange(low, high), pairs[low:high])
        start = np.cumsum(pairs[low:high]) - pairs[low:high]
        block = np.repeat(word[low:high], pairs[low:high]) + np.arange(len(who)) - np.repeat(start, pairs[low:high])
        one, two, four, over = (np.zeros(len(who), np.uint64) for _ in range(4))
        over |= ~live[block]
        mine = values[who]
        for bit in range(64):
            differs = planes[bit][block] ^ (np.uint64(0) - ((mine >> np.uint64(bit)) & np.uint64(1)))
            carry = one & differs
            one ^= differs
            carry, two = two & carry, two ^ carry
            over |= four & carry
            four |= carry
            if bit % 8 == 7 and bit >= 15:
                over |= four & (one | two)  # five or more
                keep = over != np.uint64(0xFFFFFFFFFFFFFFFF)
                if not keep.all():
                    who, block, mine, one, two, four, over = (x[keep] for x in (who, block, mine, one, two, four, over))
                if not len(who):
                    break
        if len(who):
            for cut in range(0, len(who), 1 << 14):
                near = np.unpackbits((~over[cut : cut + (1 << 14)]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                row, at = np.nonzero(near)
                _union(parent, who[cut:][row], member[block[cut:][row], at])
        low = high
    return _roots(parent)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent[:] = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        _roots(parent)
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])


def _scan_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, cell, key, fp, rep) sorted by bucket -> edges (a, b) to the root of each linked set."""
    rest = None

    def solve(table: pa.Table) -> pa.RecordBatch:
        rep = table.column("rep").to_numpy()
        root = link_roots(table.column("fp").to_numpy().view(np.uint64), table.column("bucket").to_numpy())
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[root[linked]])], ["a", "b"])

    for batch in batches:
        own = pa.table({c: batch.column(c) for c in ("band", "key", "cell", "fp", "rep")})
        rest = own if rest is None else pa.concat_tables([rest, own])
        if rest.num_rows < BUCKET:
            continue
        x = [rest.column(c).to_numpy() for c in ("band", "key", "cell")]
        change = np.flatnonzero(np.logical_or.reduce([np.diff(v) != 0 for v in x])) + 1
        if len(change):  # the last bucket may go on
            yield solve(_numbered(rest.slice(0, change[-1])))
            rest = rest.slice(change[-1])
    if rest is not None and rest.num_rows:
        yield solve(_numbered(rest))


def _numbered(table: pa.Table) -> pa.Table:
    x = [table.column(c).to_numpy() for c in ("band", "key", "cell")]
    change = np.logical_or.reduce([np.diff(v) != 0 for v in x])
    return table.append_column("bucket", pa.array(np.concatenate([[0], np.cumsum(change)])))


def _links(classes: DataFrame, bucket: int) -> DataFrame:
    """Edges between fingerprints within the radius: a spanning set of each bucket's links."""
    masks = _bands(classes.count())
    fp = F.col("fp")
    bands = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))
    rows = classes.filter("rep is not null").select("fp", "rep", bands.alias("k")).select("k.band", "k.key", "fp", "rep")
    large = rows.groupBy("band", "key").agg(F.ceil(F.count("*") / bucket).cast("int").alias("cuts")).filter("cuts > 1")
    # A bucket beyond the size is cut into blocks by hash; each pair of blocks is a unit of work of its own.
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.least(own, j) * F.col("cuts") + F.greatest(own, j))
    rows = rows.join(large, ["band", "key"], "left").select("band", "key", "fp", "rep", F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(cells)).alias("cell"))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartition(parts, "band", "key", "cell").sortWithinPartitions("band", "key", "cell")
    return map_batches(sorted_rows, _scan_buckets, "a long, b long")


def near_duplicates(documents: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``documents`` (doc_id long, text; more columns are ignored).

    Two documents are linked when their fingerprints differ in RADIUS bits or
    fewer; component_id is the smallest doc_id reachable over links.  Equal
    fingerprints are one class, found by aggregation, so copies are never
    expanded into pairs.  Null, empty and blank texts have fingerprint 0.  A
    null doc_id has no part in links: its component is that of its fingerprint
    (null if no row with an id shares it).  Repeated rows each give a row; an
    empty table gives none.
    """
    rows = staged(fingerprints(documents), "simhash")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    labels = component_labels(_links(classes, bucket))
    found = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(staged(found, "simhash-components"), "fp", "left").select("doc_id", "fp", "component_id")


def hex64(value: Column) -> Column:
    """A 64-bit value as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def keep_one_per_group(documents: DataFrame, bucket: int = BUCKET, groups: DataFrame | None = None) -> DataFrame:
    """``documents`` without near copies: of each group the row with the smallest doc_id stays.

    ``groups`` (doc_id, component_id) are the groups, by default those of
    ``near_duplicates``.  Columns and their order are those of the input.  Rows with a null doc_id
    stay (nothing names them); of rows repeating a doc_id one stays.
    """
    names = documents.columns
    groups = near_duplicates(documents, bucket) if groups is None else groups
    drop = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_copy")).distinct()
    rows = documents.filter("doc_id is not null").join(staged(drop, "copies"), F.col("doc_id") == F.col("_copy"), "left_anti")
    once = F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id"))
    named = rows.withColumn("_nth", once).filter("_nth = 1").select(*names)
    return named.unionAll(documents.filter("doc_id is null"))  # not through the window: they would share one task
