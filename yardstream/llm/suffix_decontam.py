"""Benchmark decontamination with suffix arrays over shards of the training documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardstream.llm.common import arrow_schema, map_batches, text_slices

WINDOW = 10
#: Bytes of benchmark text searched at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 32 << 20
#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

REPORT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType()),
    T.StructField("places", T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("doc_word", T.LongType()), T.StructField("words", T.LongType())]))),
    T.StructField("contaminated", T.BooleanType()),
])


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class TestSuffixes:
    """The benchmark as one sequence of word numbers, and the windows to look for.

    Equal windows are searched once; ``owners`` lists the items of each.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number, text, where = self.vocabulary, [], {}
        self.names = sorted({name for name, _ in items})
        rank = {name: i for i, name in enumerate(self.names)}
        for name, raw in items:
            ids = [number.setdefault(w, len(number)) for w in words_of(raw)]
            at = len(text)
            text += [*ids, -2]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                where.setdefault(tuple(ids[i : i + size]), (at + i, [], []))[1].append(rank[name])
                where[tuple(ids[i : i + size])][2].append(i)
        self.text = np.array([*text, *[-2] * window], np.int32)
        self.length = np.array([len(k) for k in where], np.int64)
        self.start = np.array([v[0] for v in where.values()], np.int64)
        self.owners = [sorted(set(v[1])) for v in where.values()]
        self.first = [(self.names[v[1][0]], v[2][0]) for v in where.values()]
        self.least = int(self.length.min()) if len(where) else 0
        self.most = int(self.length.max()) if len(where) else 0


def _suffix_array(tokens: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of their suffixes, compared over ``depth`` words.

    Sorted by the first word, then, within ties only, by each further word.
    """
    order = starts[np.argsort(tokens[starts], kind="stable")]
    tie = np.concatenate([[False], tokens[order[1:]] == tokens[order[:-1]]])
    for k in range(1, depth):
        open_ = tie.copy()
        open_[:-1] |= tie[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            break
        group, word = np.cumsum(~tie)[at], tokens[order[at] + k]
        by = np.lexsort((word, group))
        order[at] = order[at][by]
        word = word[by]
        tie[at[1:]] &= word[1:] == word[:-1]
    return order


def _search(tokens: np.ndarray, array: np.ndarray, tests: TestSuffixes, after: bool) -> np.ndarray:
    """Binary search of all windows at once: first place not below (``after``: above) each window."""
    low, high = np.zeros(len(tests.start), np.int64), np.full(len(tests.start), len(array), np.int64)
    while (open_ := low < high).any():
        q = np.flatnonzero(open_)
        mid = (low[q] + high[q]) // 2
        side, equal = np.zeros(len(q), np.int8), np.ones(len(q), bool)
        for k in range(tests.most):
            use = equal & (k < tests.length[q])
            if not use.any():
                break
            a, b = tokens[array[mid] + k], tests.text[tests.start[q] + np.minimum(k, tests.length[q] - 1)]
            side = np.where(use & (a < b), -1, np.where(use & (a > b), 1, side))
            equal &= ~use | (a == b)
        right = (side < 0) | ((side == 0) & after)
        low[q] = np.where(right, mid + 1, low[q])
        high[q] = np.where(right, high[q], mid)
    return low


def search_shard(texts: list[bytes | None], tests: TestSuffixes) -> list[dict]:
    """One report for each text of a shard: hits, items, longest verbatim match and its places."""
    n_words, rows = [], []
    for text in texts:
        words = words_of(text)
        n_words.append(len(words))
        rows.append(np.fromiter(map(tests.vocabulary.get, words, repeat(-1)), np.int32, len(words)))
        rows.append(np.full(1, -1, np.int32))  # no match runs from one document into the next
    most = max(tests.most, 1)
    tokens = np.concatenate([*rows, np.full(most, -1, np.int32)]) if rows else np.zeros(0, np.int32)
    begin = np.cumsum([0, *[n + 1 for n in n_words]])[:-1]
    hit = np.zeros(len(tokens) + 1, np.int32)
    found: list[dict[int, None]] = [{} for _ in texts]
    longest, places = np.zeros(len(texts), np.int64), [[] for _ in texts]
    if len(tests.start):
        # A suffix can start a window only if its first words are all benchmark words.
        strange = np.cumsum(np.concatenate([[0], tokens < 0]))
        starts = np.flatnonzero(strange[tests.least :] == strange[: -tests.least])
        starts = starts[starts < len(tokens) - most]
        array = _suffix_array(tokens, starts, most)
        low, high = _search(tokens, array, tests, False), _search(tokens, array, tests, True)
        for w in np.flatnonzero(high > low):
            at = array[low[w] : high[w]]
            size = int(tests.length[w])
            hit[at] += 1
            hit[at + size] -= 1
            doc = np.searchsorted(begin, at, "right") - 1
            for d in np.unique(doc):
                found[d].update(dict.fromkeys(tests.owners[w]))
            full, alive = np.full(len(at), size), np.ones(len(at), bool)
            while alive.any():  # the match is extended word by word
                item = tests.text[np.minimum(tests.start[w] + full, len(tests.text) - 1)]
                alive &= tokens[np.minimum(at + full, len(tokens) - 1)] == item
                full[alive] += 1
            for d, p, f in zip(doc, at, full):
                if f > longest[d]:
                    longest[d], places[d] = f, []
                if f == longest[d]:
                    places[d].append((*tests.first[w], int(p - begin[d]), int(f)))
    covered = np.concatenate([[0], np.cumsum(np.cumsum(hit) > 0)])
    out = []
    for d, n in enumerate(n_words):
        n_hit = int(covered[begin[d] + n] - covered[begin[d]])
        items = [tests.names[i] for i in sorted(found[d])]
        out.append({"n_words": n, "n_hit": n_hit, "n_items": len(items), "items": items, "longest": int(longest[d]), "places": [dict(zip(("item_id", "item_word", "doc_word", "words"), p)) for p in places[d]], "contaminated": n_hit > 0})
    return out


def _items(rows: DataFrame) -> list[tuple[str, bytes | None]]:
    return [(r.item_id if r.item_id is not None else "", None if r.text is None else bytes(r.text)) for r in rows.collect()]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """The benchmark in blocks of about ``block_bytes`` of text; only one block is on the driver at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for b in range(n):
        yield _items(rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) if n > 1 else rows)


def contamination_report(documents: DataFrame, benchmark: DataFrame, max_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` (doc_id) with what the benchmark's windows hit in each text.

    n_words, n_hit (words inside any occurrence of a window), n_items and items
    (item_ids as text, sorted), longest (words of the longest verbatim match
    that starts with a window) and places (that match: item, word offset in the
    item and in the document), contaminated.  A window is 10 consecutive words
    of an item; an item of fewer words is one window.  Words are compared
    without case (A-Z).

    Documents are cut into shards that fit a task's memory; a shard's suffix
    array is made and searched in the task, so nothing is shuffled.  The
    benchmark travels to every task and may hold ``max_bytes`` of text; a larger
    one is an error here, while ``decontaminate`` searches it block by block.

    Null or wordless texts have no words and no hits; so has every text when the
    benchmark is empty.  Null item_ids count as ''; repeated items count once.
    """
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the benchmark holds {size} bytes of text, more than {max_bytes}: report on parts of it")
    items = documents.sparkSession.sparkContext.broadcast(next(iter(_blocks(benchmark, max(size, 1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = TestSuffixes(items.value)
        for batch in text_slices(batches, "_utf8"):
            reports = search_shard(batch.column("_utf8").to_pylist(), tests)
            yield pa.RecordBatch.from_pylist([{"doc_id": d, **r} for d, r in zip(batch.column("doc_id").to_pylist(), reports)], schema)

    rows = documents.select("doc_id", F.col("text").cast("binary").alias("_utf8"))
    out = T.StructType([rows.schema["doc_id"], *REPORT])
    schema = arrow_schema(out)
    return map_batches(rows, run, out)


def decontaminate(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` without those in which a window of the benchmark occurs.

    Columns, order and repeated rows stay as they are; null and empty texts
    stay.  Nothing is shuffled: rows pass the search of each benchmark block
    (usually one) and the affected ones are left out.
    """
    names = documents.columns
    for block in _blocks(benchmark, block_bytes):
        items = documents.sparkSession.sparkContext.broadcast(block)
        at = names.index("text")

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            tests = TestSuffixes(items.value)
            for batch in batches:
                own = pa.RecordBatch.from_arrays([batch.column(at).cast(pa.binary())], ["_utf8"])
                keep = [not r["contaminated"] for part in text_slices(iter([own]), "_utf8") for r in search_shard(part.column("_utf8").to_pylist(), tests)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        documents = map_batches(documents, run, documents.schema)
    return documents


def item_digest() -> object:
    """Lowercase hex SHA-256 of the comma-joined items of a report."""
    return F.sha2(F.array_join("items", ","), 256)
