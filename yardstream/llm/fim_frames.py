"""Fill-in-middle rearrangement over seekable compressed frames.

A text is stored as independent zstandard frames of FRAME code points each, with
the cumulative count of code points behind every frame.  A position is found by
binary search over the counts.  Only the frames that a cut goes through are
decompressed to select from them; whole frames move into the rearranged text as
they are, still compressed.  Digests stream the frames in order, one at a time.

Store row: doc_id, n (code points), marked (the text holds a mark), ends
(cumulative counts), frames.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardstream.llm.common import arrow_schema, map_batches, shared_path, text_slices

#: Code points in a frame.
FRAME = 1 << 16
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK = 3  # code points of each
#: Order of the sections behind their marks in each form.
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}


class Frames:
    """Frames of one text, read by position."""

    def __init__(self, ends: list[int], frames: list[bytes], tool: zstandard.ZstdDecompressor):
        self.ends, self.frames, self.tool = ends, frames, tool
        self.n = ends[-1] if ends else 0

    def between(self, low: int, high: int) -> Iterator[tuple[bytes, int, int, int]]:
        """(frame, its code points, first and last wanted one) of the frames that hold code points low to high."""
        i = bisect_right(self.ends, low)
        while low < high:
            begin = self.ends[i - 1] if i else 0
            end = min(high, self.ends[i])
            yield self.frames[i], self.ends[i] - begin, low - begin, end - begin
            low, i = end, i + 1

    def stream(self, low: int, high: int) -> Iterator[bytes]:
        """UTF-8 of code points low to high, a frame at a time."""
        for frame, units, first, last in self.between(low, high):
            data = self.tool.decompress(frame)
            yield data if last - first == units else data.decode()[first:last].encode()


class FrameWriter:
    """Collects texts and whole frames in order; loose text becomes frames of ``size`` code points."""

    def __init__(self, tool: zstandard.ZstdCompressor, size: int):
        self.tool, self.size = tool, size
        self.ends: list[int] = []
        self.frames: list[bytes] = []
        self.loose: list[str] = []

    def _put(self, frame: bytes, units: int) -> None:
        self.frames.append(frame)
        self.ends.append((self.ends[-1] if self.ends else 0) + units)

    def flush(self) -> None:
        text, self.loose = "".join(self.loose), []
        for i in range(0, len(text), self.size):
            part = text[i : i + self.size]
            self._put(self.tool.compress(part.encode()), len(part))

    def text(self, text: str) -> None:
        self.loose.append(text)

    def section(self, source: Frames, low: int, high: int) -> None:
        """Code points low to high of another text: cut frames are decompressed, whole ones taken as they are."""
        for frame, units, first, last in source.between(low, high):
            if last - first == units:
                self.flush()
                self._put(frame, units)
            else:
                self.loose.append(source.tool.decompress(frame).decode()[first:last])


def cuts(key: str, n: int) -> tuple[int, int, int, int]:
    """(prefix end, middle end, two draws) from the SHA-256 of ``key``."""
    digest = hashlib.sha256(key.encode()).digest()
    h = [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return min(a, b), max(a, b), h[2], h[3]


def rearranged(source: Frames, form: str, first: int, second: int, writer: FrameWriter) -> None:
    sections = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, source.n)}
    for mark in FORMS[form]:
        writer.text(mark)
        writer.section(source, *sections[mark])
    writer.flush()


def read_back(output: Frames, form: str) -> tuple[str, str]:
    """(SHA-256 of the output, SHA-256 of the text rebuilt from output and form alone).

    The first stream takes the digest and finds the marks; the second one reads
    the sections in the text's order.
    """
    whole, places, seen, at = hashlib.sha256(), {}, "", 0
    for data in output.stream(0, output.n):
        whole.update(data)
        if form != "plain":
            text = seen + data.decode()
            for mark in FORMS[form]:
                if mark not in places and (p := text.find(mark)) >= 0:
                    places[mark] = at - len(seen) + p
            at += len(text) - len(seen)
            seen = text[-(_MARK - 1) :]  # a mark may stand across two frames
    if form == "plain":
        return whole.hexdigest(), whole.hexdigest()
    limits = [places[m] for m in FORMS[form]] + [output.n]
    if limits != sorted(limits) or limits[0]:
        raise ValueError("the marks of a rearranged text are out of order")
    sections = {m: (low + _MARK, high) for m, low, high in zip(FORMS[form], limits, limits[1:])}
    rebuilt = hashlib.sha256()
    for mark in (PREFIX, MIDDLE, SUFFIX):
        for data in output.stream(*sections[mark]):
            rebuilt.update(data)
    return whole.hexdigest(), rebuilt.hexdigest()


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def to_frames(documents: DataFrame, size: int = FRAME) -> DataFrame:
    """Store rows of ``documents`` (doc_id, text; more columns are ignored).

    Null and empty texts have no frames and n = 0.  Repeated rows each give a
    row, a null doc_id is kept; an empty table gives none.  A very long text is
    many frames in one row.
    """
    schema = arrow_schema(out := f"doc_id {_kind(documents)}, n long, marked boolean, ends array<long>, frames array<binary>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=LEVEL)
        for batch in text_slices(batches, "_utf8"):
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("_utf8").to_pylist()):
                text = (data or b"").decode()
                writer = FrameWriter(tool, size)
                writer.text(text)
                writer.flush()
                marked = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
                rows.append({"doc_id": doc_id, "n": len(text), "marked": marked, "ends": writer.ends, "frames": writer.frames})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return map_batches(documents.select("doc_id", F.col("text").cast("binary").alias("_utf8")), run, out)


def write_frames(documents: DataFrame, path: str, size: int = FRAME) -> None:
    """Write the store of ``documents`` as a Parquet table (the frames are compressed already)."""
    to_frames(documents, size).write.option("compression", "none").parquet(path)


def rearrange(store: DataFrame, fim_rate: int = 90, spm_rate: int = 20, salt: str = "1", size: int = FRAME) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, ends, frames): the rearranged texts, as frames again.

    Two cuts and two draws come from the SHA-256 of ``salt``:doc_id (a null
    doc_id: nothing after the colon).  Of 100 documents ``fim_rate`` are
    rearranged, of these ``spm_rate`` in a hundred with the suffix first.  A
    text that is empty or holds a mark stays plain, with null lengths.
    """
    schema = arrow_schema(out := f"doc_id {_kind(store)}, n long, form string, prefix_chars long, middle_chars long, ends array<long>, frames array<binary>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=LEVEL)
        for batch in _frame_slices(batches):
            rows = []
            for row in batch.to_pylist():
                first, second, draw, order = cuts(f"{salt}:{'' if row['doc_id'] is None else row['doc_id']}", row["n"])
                one = {"doc_id": row["doc_id"], "n": row["n"], "form": "plain", "ends": row["ends"], "frames": row["frames"]}
                if row["n"] and not row["marked"] and draw % 100 < fim_rate:
                    one["form"] = "spm" if order % 100 < spm_rate else "psm"
                    writer = FrameWriter(pack, size)
                    rearranged(Frames(row["ends"], row["frames"], unpack), one["form"], first, second, writer)
                    one |= {"prefix_chars": first, "middle_chars": second - first, "ends": writer.ends, "frames": writer.frames}
                rows.append(one)
            yield pa.RecordBatch.from_pylist(rows, schema)

    return map_batches(store.select("doc_id", "n", "marked", "ends", "frames"), run, out)


def _frame_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about a megabyte of frames (one row at least)."""
    for batch in batches:
        low, held = 0, 0
        for i, frames in enumerate(batch.column("frames")):
            held += sum(len(f.as_buffer()) for f in frames) if len(frames) else 0
            if held >= 1 << 20:
                yield batch.slice(low, i + 1 - low)
                low, held = i + 1, 0
        if low < batch.num_rows:
            yield batch.slice(low)


def digests(output: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of rearranged texts, by streaming their frames."""
    kept = "doc_id", "n", "form", "prefix_chars", "middle_chars"
    out = f"doc_id {_kind(output)}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            found = [read_back(Frames(e.as_py(), f.as_py(), tool), form.as_py()) for e, f, form in zip(batch.column("ends"), batch.column("frames"), batch.column("form"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([x[i] for x in found], pa.string()) for i in (0, 1))], [*kept, "output_sha256", "restored_sha256"])

    return map_batches(output.select(*kept, "ends", "frames"), run, out)


def texts(frames: DataFrame) -> DataFrame:
    """(doc_id, text) of a store or of rearranged texts, decompressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in _frame_slices(batches):
            whole = [b"".join(map(tool.decompress, f)).decode() for f in batch.column("frames").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(whole, pa.string())], ["doc_id", "text"])

    return map_batches(frames.select("doc_id", "ends", "frames"), run, f"doc_id {_kind(frames)}, text string")


def fill_in_middle(documents: DataFrame, path: str | None = None, size: int = FRAME) -> DataFrame:
    """Write the frame store of ``documents`` (to the shared folder by default), rearrange it and read the digests back."""
    spark: SparkSession = documents.sparkSession
    path = path or shared_path(spark, "frames")
    write_frames(documents, path, size)
    return digests(rearrange(spark.read.parquet(path), size=size))
