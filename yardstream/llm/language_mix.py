"""Language identification as a mixture: EM over n-gram likelihoods, languages chosen by penalised likelihood."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardstream.llm.common import map_batches, text_slices

#: Cells of the trigram table of a language; a prime well above the trigrams of an alphabet.
CELLS = 262_139
UNDETERMINED = "und"
#: Pseudo-count of a trigram that a language hasn't shown.
SMOOTH = 0.5
EM_ROUNDS = 8
#: Distinct chunks whose likelihoods a worker remembers.
MEMO = 100_000
_WORDS = re.compile(r"[^\W\d_]+")


def _letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def chunks_of(text: str | None) -> list[str]:
    """Lower-case chunks between white space; a chunk may hold several words."""
    return (text or "").lower().split()


def _trigrams(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each character trigram of ^word$, number of the chunk that holds the word)."""
    words, holder = [], []
    for i, chunk in enumerate(chunks):
        for word in (chunk,) if chunk.isalpha() else filter(None, map(_letters, _WORDS.findall(chunk))):
            words.append(word)
            holder.append(i)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    ends = codes == 3
    keep = ~(ends[:-2] | ends[1:-1])  # a trigram starts and goes on inside one word
    cells = ((codes[:-2] * 1_000_003 + codes[1:-1]) * 1_000_003 + codes[2:]) % CELLS
    owner = np.array(holder)[np.cumsum(codes == 2) - 1]
    return cells[keep], owner[:-2][keep]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each language, added up over a partition."""
    words: dict[str, Counter] = {}
    counts: dict[str, np.ndarray] = {}

    def flush() -> None:
        for lang, counter in words.items():
            cells, owner = _trigrams(list(counter))
            weight = np.array(list(counter.values()), np.float64)
            counts[lang] = counts.get(lang, 0) + np.bincount(cells, weight[owner], CELLS)
        words.clear()

    for batch in text_slices(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words.setdefault(lang, Counter()).update(chunks_of(text))
        if sum(map(len, words.values())) > 300_000:
            flush()
    flush()
    for lang, table in counts.items():
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells, pa.int64()), pa.array(table[cells].astype(np.int64))], ["lang", "cell", "n"])


class Model:
    """Log-probabilities (language, cell) and which cells a language has shown."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        shown = max(1, int((counts.sum(axis=0) > 0).sum())) if len(languages) else 1
        total = counts.sum(axis=1, keepdims=True)
        self.logs = np.log((counts + SMOOTH) / (total + SMOOTH * 2 * shown)).astype(np.float32)
        self.seen = (counts > 0).any(axis=0) if len(languages) else np.zeros(CELLS, bool)


def learn(documents: DataFrame) -> tuple[list[str], bytes]:
    """Count the trigrams of all rows of ``documents`` (text, lang) by language.

    Rows without language or text add nothing.  What comes to the driver is
    bounded by languages x CELLS counts.
    """
    rows = documents.filter("lang is not null and text is not null").select("lang", "text")
    sums = map_batches(rows, _count_batches, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang").agg(F.collect_list("cell").alias("cell"), F.collect_list("n").alias("n")).collect()
    packed.sort(key=lambda r: r["lang"])
    table = np.zeros((len(packed), CELLS), np.int64)
    for i, row in enumerate(packed):
        table[i, row["cell"]] = row["n"]
    return [r["lang"] for r in packed], table.tobytes()


def _em(w: np.ndarray, count: np.ndarray, owner: np.ndarray, starts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language shares of each document and the log-likelihood of its words under them.

    ``w`` holds the likelihood of each distinct word under each language (up to
    a factor per word), ``count`` how often it occurs; words of a document stand together.
    """
    n = np.add.reduceat(count, starts)[:, None]
    share, one = share.astype(np.float32), np.ones(w.shape[1], np.float32)
    for _ in range(EM_ROUNDS):
        r = w * share[owner]
        r *= (count / (r @ one))[:, None]
        share = np.add.reduceat(r, starts, axis=0) / n
    return share, np.add.reduceat(count * np.log((w * share[owner]) @ one).astype(np.float64), starts)


class Memory:
    """Likelihoods of the chunks met so far, one row each; ``rows`` is emptied when it has grown too large."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((0, len(model.languages) + 2), np.float32)

    def number(self, chunks: list[str]) -> None:
        if len(self.rows) > MEMO:
            self.rows.clear()
            self.table = self.table[:0]
        new = [c for c in dict.fromkeys(chunks) if c not in self.rows]
        cells, owner = _trigrams(new)
        part = np.zeros((len(new), self.table.shape[1]), np.float32)
        part[:, -2] = np.bincount(owner, minlength=len(new))
        part[:, -1] = np.bincount(owner, self.model.seen[cells], len(new))
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        if len(first):
            part[owner[first], :-2] = np.add.reduceat(self.model.logs[:, cells].T, first, axis=0)
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.table = np.concatenate([self.table, part])


def infer(texts: list[str | None], memory: Memory) -> list[tuple[str, float, float, dict[str, float]]]:
    """(language, score, known share, shares of the chosen languages) of each text."""
    out: list = [(UNDETERMINED, 0.0, 0.0, {})] * len(texts)
    languages = memory.model.languages
    if not languages:
        return out
    bags = [Counter(chunks_of(t)) for t in texts]
    memory.number(list(chain.from_iterable(bags)))
    words = np.array(list(map(memory.rows.__getitem__, chain.from_iterable(bags))), np.int64)
    count = np.array(list(chain.from_iterable(bag.values() for bag in bags)), np.float32)
    doc = np.repeat(np.arange(len(texts)), [len(bag) for bag in bags])
    rows = memory.table[words]
    full = rows[:, -2] > 0  # the others hold no letter
    rows, count, doc = rows[full], count[full], doc[full]
    if not len(rows):
        return out
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    which = doc[starts]
    doc = np.cumsum(np.diff(doc, prepend=doc[0]) != 0)
    k = len(languages)
    logs = rows[:, :k]
    n = np.add.reduceat(count, starts).astype(np.float64)
    single = np.add.reduceat(logs * count[:, None], starts, axis=0, dtype=np.float64)
    known = np.add.reduceat(rows[:, -1] * count, starts) / np.add.reduceat(rows[:, -2] * count, starts)
    top = np.maximum.reduce(logs.T)
    w = np.maximum(np.exp(logs - top[:, None]), np.float32(1e-30))
    base = np.add.reduceat((top * count).astype(np.float64), starts)
    share, _ = _em(w, count, doc, starts, np.full((len(n), k), 1 / k))
    order = np.argsort(-share, axis=1, kind="stable")
    # One language: no share to estimate.  m languages: m - 1 shares, each costing half the logarithm of the words.
    best = single.max(axis=1)
    chosen = np.zeros((len(n), k))
    chosen[np.arange(len(n)), single.argmax(axis=1)] = 1.0
    size_of = np.ones(len(n), int)
    going = np.arange(len(n))
    for m in range(2, k + 1):
        going = going[share[going, order[going, m - 1]] * n[going] >= 0.5]
        if not len(going):
            break
        place = np.full(len(n), -1)
        place[going] = np.arange(len(going))
        part = place[doc] >= 0
        own = place[doc[part]]
        mask = np.zeros((len(going), k))
        np.put_along_axis(mask, order[going, :m], 1.0, axis=1)
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        start = share[going] * mask
        got, likely = _em(w[part], count[part], own, begin, start / start.sum(axis=1, keepdims=True))
        score = likely + base[going] - 0.5 * (m - 1) * np.log(np.maximum(n[going], 2))
        better = score > best[going]
        best[going[better]], chosen[going[better]], size_of[going[better]] = score[better], got[better], m
        going = going[better]
    spread = np.exp(single - single.max(axis=1, keepdims=True))
    spread /= spread.sum(axis=1, keepdims=True)
    for d, i in enumerate(which):
        at = int(chosen[d].argmax())
        score = float(spread[d, at] if size_of[d] == 1 else chosen[d, at])
        out[i] = (languages[at], min(max(score, 0.0), 1.0), float(known[d]), {languages[j]: float(chosen[d, j]) for j in order[d] if chosen[d, j] > 0})
    return out


def _with_model(documents: DataFrame, learned: tuple[list[str], bytes], handle, schema) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table = sent.value
        memory = Memory(Model(languages, np.frombuffer(table, np.int64).reshape(len(languages), CELLS)))
        for batch in batches:
            yield from handle(batch, memory)

    return map_batches(documents, run, schema)


def identify(documents: DataFrame, learned: tuple[list[str], bytes]) -> DataFrame:
    """(doc_id, lang_pred, score, known, languages) for every row of ``documents`` (doc_id, text).

    Each word is drawn from one of the document's languages, with the
    probability of its character trigrams.  EM finds the shares; a further
    language is accepted when it raises the log-likelihood by more than half the
    logarithm of the number of words.  Languages are tried in the order of their
    shares, up to all learned ones; the first that is not accepted ends the
    search.  lang_pred has the largest share (ties:
    the first in alphabetical order); score is that share, or for a single
    language its posterior; known is the share of trigrams that any language
    has shown; languages maps the chosen ones to their shares.

    A null text, one without a letter, or a model without languages gives
    ``und`` with score 0.  Repeated rows each get a row.
    """

    def handle(batch: pa.RecordBatch, memory: Memory) -> Iterator[pa.RecordBatch]:
        for part in text_slices(iter([batch]), "text"):
            got = infer(part.column("text").to_pylist(), memory)
            columns = [part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*got), (pa.string(), pa.float64(), pa.float64(), pa.map_(pa.string(), pa.float64()))))]
            columns[4] = pa.array([list(x[3].items()) for x in got], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "known", "languages"])

    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _with_model(rows, learned, handle, f"doc_id {kind}, lang_pred string, score double, known double, languages map<string,double>")


def keep_known_languages(documents: DataFrame, learned: tuple[list[str], bytes], least_known: float = 0.3) -> DataFrame:
    """``documents`` without those in no known language.

    Rejected are texts without letters (null and empty ones too) and texts of
    whose trigrams less than ``least_known`` occur in any learned language.
    Columns, order and repeated rows stay.  If nothing was learned all rows stay.
    """
    if not learned[0]:
        return documents
    at = documents.columns.index("text")

    def handle(batch: pa.RecordBatch, memory: Memory) -> Iterator[pa.RecordBatch]:
        own = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
        keep = [g[0] != UNDETERMINED and g[2] >= least_known for part in text_slices(iter([own]), "text") for g in infer(part.column("text").to_pylist(), memory)]
        yield batch.filter(pa.array(keep, pa.bool_()))

    return _with_model(documents, learned, handle, documents.schema)
