"""Token ids in binary shards with a minimal perfect hash index.

File format: two Parquet tables (so that any store that Spark reads will do,
and Spark's commit protocol covers lost executors).

``shards``, one row per shard:

| column | content |
|---|---|
| part, piece | number of the shard, ascending with the keys |
| n_ids | ids in the payload |
| width | bytes of an id (2 or 4) |
| payload | the ids of the shard's documents, one after the other, little-endian |
| keys | the documents' keys in order (for full reads; a keyed read doesn't touch it) |
| seeds | displacement of each bucket of the hash |
| fingerprints, offsets, lengths | by hash slot: 32-bit fingerprint of the key, first id, number of ids |
| low, high | smallest and largest key |

``directory``, a small row per shard: part, piece, low, high and start, the ids
of all documents of earlier shards.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yardstream.llm.common import arrow_schema, map_batches, shared_path, text_slices

END_ID = 2
SHARD_BYTES = 4 << 20
SHARD_DOCS = 16_384
#: Distinct white-space separated chunks whose ids a worker remembers.
MEMO = 500_000
_BUCKET = 4
_SHARDS = "part long, piece long, n_ids long, width int, payload binary, keys array<long>, seeds binary, fingerprints binary, offsets binary, lengths binary, low long, high long"


def _mix(keys: np.ndarray, seed) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) of keys and seed."""
    with np.errstate(over="ignore"):
        x = keys ^ (np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hashes(keys: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k.encode()) for k in keys], np.uint64)


def build_index(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, slot of each key): hash and displace, largest buckets first; n keys fill n slots."""
    n = len(hashes)
    buckets = max(1, -(-n // _BUCKET))
    bucket = (_mix(hashes, 1) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=buckets)
    begin = np.cumsum(size) - size
    seeds, slots, taken = np.zeros(buckets, np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
    for b in np.argsort(-size, kind="stable"):
        if not size[b]:
            break
        members = order[begin[b] : begin[b] + size[b]]
        low = 2
        while True:  # 64 displacements are tried at once
            tries = np.arange(low, low + 64, dtype=np.uint64)
            at = (_mix(hashes[members][None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
            good = ~taken[at].any(axis=1)
            if size[b] > 1:
                ranked = np.sort(at, axis=1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            hit = np.flatnonzero(good)
            if len(hit):
                seeds[b], slots[members] = tries[hit[0]], at[hit[0]]
                taken[at[hit[0]]] = True
                break
            low += 64
    return seeds, slots


def find_slots(hashes: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key: two hash values and one array access, whatever the shard's size."""
    bucket = (_mix(hashes, 1) % np.uint64(len(seeds))).astype(np.int64)
    return (_mix(hashes, seeds[bucket].astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes, 0) >> np.uint64(32)).astype("<u4")


_MARKS = ".,;:!?"


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The tokenizer drops white space and no token crosses it, so a text's ids are
    those of its white-space separated chunks; a chunk met before is not encoded
    again.  New chunks are encoded together:

    * Words of Latin letters up to U+00FF pass the steps before the model as
      their small letters' bytes, so the same model is given them directly,
      split at spaces; the vocabulary tells which tokens end a word.  One mark
      after a word is a token of its own.
    * Other chunks take the whole tokenizer, with the vocabulary's end-of-text
      mark between them, which is always a token of its own.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.kind, self.memo = Tokenizer.from_file(path), f"<u{width}", {}
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.mark = next((m for m in special if not m.isspace()), None)
        self.mark_id = special.get(self.mark)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        lowers = isinstance(self.tokenizer.normalizer, normalizers.Sequence) and self.tokenizer.normalizer.normalize_str("AZ") == "az"
        self.model = None
        if suffix and lowers:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
            self.ends = ends
            self.marks = {m: self._alone(m) for m in _MARKS}

    def _alone(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.kind).tobytes()

    def _cut(self, part: list[str], ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        if len(low) != len(part):
            raise ValueError("this tokenizer does not keep chunks apart")
        raw, size = ids.astype(self.kind).tobytes(), int(self.kind[2])
        self.memo.update(zip(part, [raw[a:b] for a, b in zip((low * size).tolist(), (high * size).tolist())]))

    def _learn(self, chunks: list[str]) -> None:
        memo, words, derived, others = self.memo, {}, [], []
        for chunk in chunks:
            if self.model is not None and chunk and (chunk.isascii() or max(chunk) <= "\xff"):
                word = chunk.lower()
                mark = word[-1:] if word[-1:] in self.marks else ""
                word = word[: len(word) - len(mark)]
                if word.isalpha():
                    if word not in memo:
                        words[word] = None
                    if word != chunk:
                        derived.append((chunk, word, mark))
                    continue
            others.append(chunk)
        new = list(words)
        parts = [new[i : i + 512] for i in range(0, len(new), 512)]
        for part, got in zip(parts, self.model.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False) if parts else ()):
            ids = np.array(got.ids, np.uint32)
            high = np.flatnonzero(self.ends[ids]) + 1
            self._cut(part, ids, np.concatenate([[0], high[:-1]]), high)
        for chunk, word, mark in derived:
            memo[chunk] = memo[word] + self.marks[mark] if mark else memo[word]
        for chunk in [c for c in others if self.mark is None or "<" in c or ">" in c]:
            memo[chunk] = self._alone(chunk)
        new = [c for c in others if c not in memo]
        parts = [new[i : i + 512] for i in range(0, len(new), 512)]
        for part, got in zip(parts, self.tokenizer.encode_batch_fast([self.mark.join(p) for p in parts], add_special_tokens=False) if parts else ()):
            ids = np.array(got.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            self._cut(part, ids, np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(ids)]]))

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text (null: none).

        Chunks are cut and numbered by Arrow, so the memory is asked once for
        each distinct chunk of a slice; ids are gathered by index arrays.
        """
        lines = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        for blank in "\n\t\r":
            lines = pc.replace_substring(lines, blank, " ")
        parts = pc.split_pattern(lines.fill_null(""), " ")
        chunks = parts.flatten().dictionary_encode()
        memo, distinct = self.memo, chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(memo) > MEMO:
            for chunk in list(islice(memo, len(memo) // 2)):  # the oldest half goes; what is common is soon back
                del memo[chunk]
        known = list(map(memo.get, distinct))
        unknown = [i for i, ids in enumerate(known) if ids is None]
        self._learn([distinct[i] for i in unknown])
        for i in unknown:
            known[i] = memo[distinct[i]]
        size = np.fromiter(map(len, known), np.int64, len(known)) // int(self.kind[2])
        first, pool = np.cumsum(size) - size, np.frombuffer(b"".join(known), self.kind)
        number = chunks.indices.to_numpy()
        many = size[number]
        ends = np.cumsum(many)
        ids = pool[np.repeat(first[number] - (ends - many), many) + np.arange(many.sum())]
        limits = np.concatenate([[0], ends])[np.cumsum(np.concatenate([[0], pc.list_value_length(parts).to_numpy()]))].tolist()
        return [ids[low:high].tobytes() for low, high in zip(limits, limits[1:])]


def worker_encoder(path: str, width: int) -> Encoder:
    """The encoder of this Python worker: workers serve many tasks, and the memory of chunks is worth keeping."""
    kept = sys.modules.setdefault("yardstream_worker_state", types.SimpleNamespace(encoders={})).encoders
    if (path, width) not in kept:
        kept[path, width] = Encoder(path, width)
    return kept[path, width]


def _shard_row(part: int, piece: int, doc_ids: list[int | None], ids: list[bytes], width: int) -> dict:
    keys = [str(k) for k in doc_ids]
    known = [k for k in doc_ids if k is not None]
    low, high = (known[0], known[-1]) if known else (None, None)
    lengths = np.array([len(x) // width for x in ids], np.int64)
    offsets = np.cumsum(lengths) - lengths
    hashes = key_hashes(_numbered(keys))
    seeds, slots = build_index(hashes)
    table = {name: np.zeros(len(keys), kind) for name, kind in (("fingerprints", "<u4"), ("offsets", "<u8"), ("lengths", "<u8"))}
    table["fingerprints"][slots], table["offsets"][slots], table["lengths"][slots] = fingerprint(hashes), offsets, lengths
    return {"part": part, "piece": piece, "n_ids": int(lengths.sum()), "width": width, "payload": b"".join(ids), "keys": doc_ids, "seeds": seeds.astype("<u4").tobytes(), **{k: v.tobytes() for k, v in table.items()}, "low": low, "high": high}


def _numbered(keys: list[str]) -> list[str]:
    """Keys made distinct: the copy number is part of the hashed key (0 for the first)."""
    seen: dict[str, int] = {}
    out = []
    for k in keys:
        seen[k] = seen.get(k, -1) + 1
        out.append(f"{k}#{seen[k]}")
    return out


def write_store(documents: DataFrame, path: str, tokenizer: str, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> None:
    """Encode the texts of ``documents`` (doc_id long, text) and write them under ``path`` in ascending doc_id order.

    Each document's ids end with END_ID.  Null and empty texts have that id
    alone.  Null doc_ids come first; rows repeating a doc_id stand in the order
    of their texts, each with its own ids.  An empty table gives an empty store.
    ``tokenizer`` names the vocabulary file on the executors.  Texts are dealt
    out by range of (doc_id, hash of the text), so a repeated doc_id is spread
    too, and shards are closed by size: a task holds one shard.
    """
    width = 2 if _vocabulary_size(tokenizer) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, piece = worker_encoder(tokenizer, width), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], f"<u{width}").tobytes()
        keys, ids, size = [], [], 0
        for batch in text_slices(batches, "text"):
            found = encoder.encode(batch.column("text"))
            for key, one in zip(batch.column("doc_id").to_pylist(), found):
                keys.append(key)
                ids.append(one + end)
                size += len(ids[-1])
                if size >= shard_bytes or len(keys) >= shard_docs:
                    yield pa.RecordBatch.from_pylist([_shard_row(part, piece, keys, ids, width)], schema)
                    keys, ids, size, piece = [], [], 0, piece + 1
        if keys:
            yield pa.RecordBatch.from_pylist([_shard_row(part, piece, keys, ids, width)], schema)

    schema = arrow_schema(_SHARDS)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
    rows = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text")
    map_batches(rows, run, _SHARDS).write.option("compression", "zstd").parquet(f"{path}/shards")
    _directory(documents.sparkSession, path).write.parquet(f"{path}/directory")


def _vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def _directory(spark: SparkSession, path: str) -> DataFrame:
    shards = spark.read.parquet(f"{path}/shards").select("part", "piece", "n_ids", "low", "high")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select("part", "piece", "low", "high", (F.col("base") + F.col("before")).alias("start"))


class Shard:
    """A shard row as arrays; ``get`` answers from the index alone."""

    def __init__(self, row: dict):
        self.row, self.n = row, len(row["fingerprints"]) // 4
        self.seeds = np.frombuffer(row["seeds"], "<u4")
        self.prints = np.frombuffer(row["fingerprints"], "<u4")
        self.offsets, self.lengths = (np.frombuffer(row[k], "<u8").astype(np.int64) for k in ("offsets", "lengths"))
        self.ids = np.frombuffer(row["payload"], f"<u{row['width']}")

    def slots(self, named: list[str]) -> np.ndarray:
        """Slot of each numbered key; -1 where the stored fingerprint says that it isn't here."""
        hashes = key_hashes(named)
        slot = find_slots(hashes, self.seeds, self.n)
        return np.where(self.prints[slot] == fingerprint(hashes), slot, -1)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document with this key (none: empty list)."""
        out = []
        while (slot := self.slots([f"{key}#{len(out)}"])[0]) >= 0:
            out.append(self.ids[self.offsets[slot] : self.offsets[slot] + self.lengths[slot]])
        return out


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a store, each fetched through the index.

    start counts the ids of all documents before it; ids_crc32 is the crc32 of
    its ids as little-endian 32-bit integers.  A key that the index does not
    give back is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0])
                keys = shard.row["keys"]
                slots = shard.slots(_numbered([str(k) for k in keys]))
                if (slots < 0).any():
                    raise ValueError(f"shard {shard.row['part']}.{shard.row['piece']} lacks a key")
                offsets, lengths = shard.offsets[slots], shard.lengths[slots]
                sums = [zlib.crc32(shard.ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(offsets.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.row[c]] * len(keys), pa.int64()) for c in ("part", "piece")] + [pa.array(keys, pa.int64()), pa.array(offsets), pa.array(lengths), pa.array(sums, pa.int64())],
                    ["part", "piece", "doc_id", "offset", "n_tokens", "ids_crc32"])

    rows = map_batches(spark.read.parquet(f"{path}/shards"), run, "part long, piece long, doc_id long, offset long, n_tokens long, ids_crc32 long")
    directory = spark.read.parquet(f"{path}/directory").select("part", "piece", F.col("start").alias("_start"))
    return rows.join(directory, ["part", "piece"]).select("doc_id", (F.col("_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) for the doc_ids of ``keys``: keyed access, one row per stored document.

    Keys meet the shards through cells of the key range (an equi-join), then the
    shard's index gives the place.  Unknown and null keys give no row.
    """
    directory = spark.read.parquet(f"{path}/directory").filter("low is not null")
    least, most, n = directory.agg(F.min("low"), F.max("high"), F.count("*")).first()
    width = max(1, (most - least) // n + 1) if n else 1
    cell = lambda c: F.floor((F.col(c) - F.lit(least or 0)) / width)
    cells = directory.select("part", "piece", "low", "high", F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"))
    wanted = keys.select(F.col("doc_id").cast("long").alias("key")).filter("key is not null").distinct().withColumn("cell", cell("key"))
    wanted = wanted.join(cells, "cell").filter("key between low and high").select("part", "piece", "key").distinct()
    shards = spark.read.parquet(f"{path}/shards").drop("keys", "low", "high")
    # A shard and its wanted keys: at most the keys of one shard meet its row.
    rows = shards.join(wanted.groupBy("part", "piece").agg(F.collect_list("key").alias("wanted")), ["part", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0])
                found = [(k, ids.tolist()) for k in shard.row["wanted"] for ids in shard.get(k)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return map_batches(rows, run, "doc_id long, ids array<long>")


def encode_to_store(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Write a store in the shared folder and read it back (see ``read_store``)."""
    spark = documents.sparkSession
    path = shared_path(spark, "tokens")
    write_store(documents, path, tokenizer)
    return read_store(spark, path)
