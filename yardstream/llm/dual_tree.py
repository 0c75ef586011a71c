"""Exact ranked lexical search by dual trees over items and documents.

Items and documents are vectors over the items' terms: an item's coordinate is
the term's weight, a document's the saturated count.  A score is their inner
product.  Both sides stand in hierarchies whose nodes hold the maximum of each
coordinate below them, so the product of two nodes' maxima is a bound for every
pair below.  A pair of nodes whose bound is under the weakest kth score among
the node's items is left out as a whole; all others are opened, down to exact
scores.  All numbers are whole and below 2**53, so sums in doubles are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardstream.llm.common import arrow_schema, map_batches, staged, text_slices

#: Results of an item.
TOP = 50
#: Term occurrences of items that travel to the tasks at once; more items take further passes over the documents.
BLOCK_TERMS = 50_000
#: Items and documents in a leaf, nodes joined into one of the next level.
ITEM_LEAF, DOC_LEAF, FAN = 1, 8, 4
#: Coordinates of the documents that a task holds as one tree.
CELLS = 6_000_000
#: One document in so many gives the first bounds.
FIRST = 32
#: Terms of one item up to which sums stay exact in doubles.
EXACT_TERMS = 250_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_TERM_BYTES = bytearray(b" " * 128 + bytes(range(128, 256)))
_TERM_BYTES[48:58] = b"0123456789"
_TERM_BYTES[65:91] = _TERM_BYTES[97:123] = _LOWER.encode()
_TERM_BYTES = bytes(_TERM_BYTES)


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM_BYTES).split()


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def halved(points: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the points in which neighbours are close: halves along the line between two far points, down to leaves."""
    order, todo = np.arange(len(points)), [(0, len(points))]
    while todo:
        low, high = todo.pop()
        if high - low <= leaf:
            continue
        own = points[order[low:high]]
        a = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        b = own[((own - a) ** 2).sum(axis=1).argmax()]
        order[low:high] = order[low:high][np.argsort(own @ (a - b), kind="stable")]
        middle = low + -(-(high - low) // (2 * leaf)) * leaf  # halves are whole leaves
        todo += [(low, middle), (middle, high)]
    return order


def _directions(n_terms: int) -> np.ndarray:
    return np.random.default_rng(7).choice([-1.0, 1.0], (n_terms, 16))


class ItemNode:
    """Items low to high (places in the tree's order): their terms, the maximum weight of each, and the nodes below."""

    def __init__(self, low: int, high: int, terms: np.ndarray, peak: np.ndarray, below: list[ItemNode], matrix: np.ndarray | None = None):
        self.low, self.high, self.terms, self.peak, self.below, self.matrix = low, high, terms, peak, below, matrix


class Items:
    """The hierarchy over a block of items: ``terms`` are the term numbers of each item."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray):
        self.kind = np.float64 if max(map(len, terms)) <= EXACT_TERMS else np.int64
        lines = _directions(len(weights))
        self.order = halved(np.array([weights[t] @ lines[t] for t in terms]), ITEM_LEAF)
        level = []
        for low in range(0, len(terms), ITEM_LEAF):
            own = [terms[i] for i in self.order[low : low + ITEM_LEAF]]
            union = np.unique(np.concatenate(own))
            matrix = np.zeros((len(own), len(union)), self.kind)
            for j, t in enumerate(own):
                matrix[j, np.searchsorted(union, t)] = weights[t]
            level.append(ItemNode(low, low + len(own), union, matrix.max(axis=0), [], matrix))
        while len(level) > 1:
            level = [self._above(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        self.root, self.n, self.n_terms = level[0], len(terms), len(weights)

    @staticmethod
    def _above(below: list[ItemNode]) -> ItemNode:
        if len(below) == 1:
            return below[0]
        union = np.unique(np.concatenate([b.terms for b in below]))
        peak = np.zeros(len(union), below[0].peak.dtype)
        for b in below:
            at = np.searchsorted(union, b.terms)
            peak[at] = np.maximum(peak[at], b.peak)
        return ItemNode(below[0].low, below[-1].high, union, peak, below)


class Search:
    """The best documents of each item over any number of document trees, and what was opened on the way."""

    def __init__(self, items: Items, floors: np.ndarray, top: int):
        self.items, self.top = items, top
        #: Per place in the items' order: no document below it can be among the best.
        self.least = np.maximum(floors[items.order], 1).astype(np.int64)
        none = np.zeros(0, np.int64)
        self.best = [(none, none, none.astype(bool)) for _ in range(items.n)]
        self.bounds = self.scored = 0

    def add(self, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        """Search the tree of documents whose coordinates are given as (row, term, value), by row, with ids by row (``unknown``: no id).

        Every row has a coordinate.  Arrays are kept by term, so a node pair reads whole runs.
        """
        lines = values[:, None] * _directions(self.items.n_terms)[terms]
        order = halved(np.add.reduceat(lines, np.searchsorted(rows, np.arange(len(ids))), axis=0), DOC_LEAF)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.points = np.zeros((self.items.n_terms, len(ids)), self.items.kind)
        self.points[terms, place[rows]] = values
        self.ids, self.unknown = ids[order], unknown[order]
        self.peaks = [np.maximum.reduceat(self.points, np.arange(0, len(ids), DOC_LEAF), axis=1)]
        while self.peaks[-1].shape[1] > FAN:
            self.peaks.append(np.maximum.reduceat(self.peaks[-1], np.arange(0, self.peaks[-1].shape[1], FAN), axis=1))
        self._open(self.items.root, len(self.peaks) - 1, np.arange(self.peaks[-1].shape[1]), 0)

    def _open(self, item: ItemNode, level: int, nodes: np.ndarray, depth: int) -> None:
        bound = item.peak @ self.peaks[level][np.ix_(item.terms, nodes)]
        self.bounds += len(nodes)
        best_first = np.argsort(-bound, kind="stable")
        nodes, bound = nodes[best_first], bound[best_first]
        nodes = nodes[bound >= self.least[item.low : item.high].min()]
        if not len(nodes):
            return
        if item.below and (depth % 2 == 0 or not level):
            for below in item.below:
                self._open(below, level, nodes, depth + 1)
        elif level:
            inner = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            self._open(item, level - 1, inner[inner < self.peaks[level - 1].shape[1]], depth + 1)
        else:
            low, size = 0, FAN
            while low < len(nodes):  # the best leaves raise the bar for the others
                own = nodes[low : low + size][bound[low : low + size][: len(nodes) - low] >= self.least[item.low : item.high].min()]
                if not len(own):
                    break
                self._score(item, own)
                low, size = low + size, size * 2

    def _score(self, leaf: ItemNode, nodes: np.ndarray) -> None:
        docs = (nodes[:, None] * DOC_LEAF + np.arange(DOC_LEAF)).ravel()
        docs = docs[docs < len(self.ids)]
        scores = (leaf.matrix @ self.points[np.ix_(leaf.terms, docs)]).astype(np.int64)
        self.scored += scores.size
        for j in np.flatnonzero((scores >= self.least[leaf.low : leaf.high, None]).any(axis=1)):
            place = leaf.low + j
            at = np.flatnonzero(scores[j] >= self.least[place])
            s, i, u = (np.concatenate([a, b]) for a, b in zip(self.best[place], (scores[j, at], self.ids[docs[at]], self.unknown[docs[at]])))
            keep = np.lexsort((i, u, -s))[: self.top]
            self.best[place] = s[keep], i[keep], u[keep]
            if len(keep) == self.top:
                self.least[place] = max(self.least[place], s[keep[-1]])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, score, id, unknown) of the best documents."""
        item = np.repeat(self.items.order, [len(s) for s, _, _ in self.best])
        return item, *(np.concatenate([b[k] for b in self.best]) for k in range(3))


def _count_terms(vocabulary: dict[bytes, int]):
    """Rows (doc_id, _utf8) -> doc_id, n (terms with repeats), the items' terms in the text and their counts."""
    size = max(len(vocabulary), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "_utf8"):
            n, found = [], []
            for text in batch.column("_utf8").to_pylist():
                terms = terms_of(text)
                n.append(len(terms))
                numbers = np.fromiter(map(vocabulary.get, terms, repeat(-1)), np.int64, len(terms))
                found.append(numbers[numbers >= 0] + (len(n) - 1) * size)
            cell, count = np.unique(np.concatenate(found), return_counts=True)
            ends = pa.array(np.searchsorted(cell, np.arange(len(n) + 1) * size), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (cell % size, count)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return run


def _search(counted: DataFrame, items, names: list, item_type: T.DataType, floors: np.ndarray, n_docs: int, n_words: int, top: int) -> DataFrame:
    """(item, item_id, doc_id, score): the best documents of each task's rows."""
    out = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", item_type), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = items.value
        search, most = Search(tree, floors, top), max(DOC_LEAF, CELLS // tree.n_terms)
        for batch in batches:
            for low in range(0, batch.num_rows, most):
                part = batch.slice(low, most)
                n, terms = part.column("n").to_numpy().astype(np.int64), part.column("terms")
                rows = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False))
                tf = part.column("counts").flatten().to_numpy().astype(np.int64)
                m = 100 - 50 + (50 * n * n_docs) // n_words
                values = (1_000_000_000 * tf) // (1000 * tf + 20 * m[rows])
                ids = part.column("doc_id")
                search.add(rows, terms.flatten().to_numpy(), values, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        item, score, ids, unknown = search.rows()
        for low in range(0, len(item), 50_000):
            cut = slice(low, low + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(item[cut]), pa.array([names[i] for i in item[cut]], schema.field("item_id").type), pa.array(ids[cut], mask=unknown[cut]), pa.array(score[cut])], schema=schema)

    return map_batches(counted.filter("size(terms) > 0"), run, out)


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def rank_documents(documents: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents (doc_id, text) of each item (item_id, text) with a score above 0.

    Equal scores stand in ascending order of doc_id, null doc_ids last.  Rows of
    one item_id are one item with the terms of all of them; a null item_id is an
    item too.  Null and termless texts match nothing: such items have no rows,
    such documents count nowhere.  Repeated documents are documents of their
    own.  Empty tables give no rows.  Further columns are ignored.

    Documents are not shuffled: each task builds trees over its rows and gives
    its best ``top`` for each item.  A first search of one document in FIRST
    sets a score that each item's kth best reaches for certain, so tasks give
    little more than the final rows.  Items travel in blocks of about
    ``block_terms`` terms, one pass over the documents each.
    """
    spark = documents.sparkSession
    pairs = staged(items.select("item_id", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).distinct(), "item-terms")
    item_type, n_blocks = pairs.schema["item_id"].dataType, -(-pairs.count() // block_terms)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_utf8"))
    results = []
    for block in range(n_blocks):
        own = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block) if n_blocks > 1 else pairs
        by_item: dict = {}
        for row in own.collect():
            by_item.setdefault(row.item_id, []).append(row.term.encode())
        if not by_item:
            continue
        names = sorted(by_item, key=repr)
        vocabulary = {t: i for i, t in enumerate(sorted({t for terms in by_item.values() for t in terms}))}
        terms = [np.array(sorted(vocabulary[t] for t in by_item[k])) for k in names]
        counted = staged(map_batches(texts, _count_terms(vocabulary), "doc_id long, n long, terms array<int>, counts array<int>").filter("n > 0"), "term-counts")
        n_docs, n_words = counted.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for row in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[row["term"]] = row["count"]
        weights = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        tree, floors = spark.sparkContext.broadcast(Items(terms, weights)), np.zeros(len(names), np.int64)
        first = counted.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST)) == 0)
        for row in _best(_search(first, tree, names, item_type, floors, n_docs, n_words, top), top).filter(F.col("rank") == top).collect():
            floors[row["item"]] = row["score"]
        found = _search(counted, tree, names, item_type, floors, n_docs, n_words, top)
        results.append(_best(found, top).select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type), *T.StructType.fromDDL("rank int, doc_id long, score long")]))
    out = results[0]
    for more in results[1:]:
        out = out.unionAll(more)
    return out
