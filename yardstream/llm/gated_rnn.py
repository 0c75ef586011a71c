"""Toxicity scores by a bidirectional gated recurrent network over windows of words.

A text is read in overlapping windows of WINDOW words, one every STRIDE words and
the last one at the end.  Each word enters by an embedding of the word itself
and one of its character n-grams (both hashed).  A gated recurrent unit runs
over the window in both directions, attention pools its states, and the pooled
state gives the window's score.  A text's score is that of its worst window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardstream.llm.common import map_batches, staged, text_slices

WINDOW, STRIDE = 32, 24
#: Labelled documents of each label that the network is fitted on (those with the smallest hash of doc_id), and code points of all of them.
SAMPLE, SAMPLE_CHARS = 1_500, 8_000_000
#: Bytes of a word; longer runs are cut into words of this size.
WORD = 32
#: Bytes of text that are cut into words at once; longer texts go piece by piece.
PIECE = 1 << 20
WORD_CELLS, GRAM_CELLS, GRAM = 1 << 14, 1 << 15, 4
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 8, 12, 10, 8
#: Steps of the fit, documents of each label in a step, windows drawn of each, learning rate, decay of the embeddings, share of words that a step hides from the word embedding.
STEPS, BATCH, DRAWN, RATE, DECAY, HIDDEN_WORDS = 320, 64, 6, 0.01, 0.1, 0.5
#: Steps after which the worst windows of all texts of label 0 are looked up anew.
MINED = (120, 180, 240, 280)
#: One text of the sample in so many is kept from the network, to set scale and offset of the scores.
ASIDE = 5
#: Windows that are scored at once.
CHUNK = 1024

_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of several texts: where each begins, which text it is of, and the distinct ones by their features."""

    def __init__(self, texts: list[bytes], whole: list[bool]):
        """A text that is not ``whole`` goes on elsewhere: a last word that might go on too is left out."""
        line = b" ".join(texts) + b" "
        self.bytes = np.frombuffer(line, np.uint8)
        sizes = np.array([len(t) + 1 for t in texts])
        self.first = np.cumsum(sizes) - sizes
        edge = np.diff(_IS_WORD[self.bytes].astype(np.int8), prepend=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        parts = -(-(end - start) // WORD)
        if len(parts) and parts.max() > 1:
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start, end = np.repeat(start, parts) + nth * WORD, np.repeat(end, parts)
            end = np.minimum(end, start + WORD)
        self.owner = np.searchsorted(self.first, start, "right") - 1
        goes_on = (end == (self.first + sizes - 1)[self.owner]) & (end - start < WORD) & ~np.array(whole)[self.owner]
        self.start, self.end, self.owner = start[~goes_on], end[~goes_on], self.owner[~goes_on]
        self.count = np.bincount(self.owner, minlength=len(texts))
        hashes = self._hashes()
        _, at, self.number = np.unique(hashes, return_index=True, return_inverse=True)
        self.cells = (_finished(hashes[at]) % np.uint64(WORD_CELLS)).astype(np.int64)
        self._grams(at)

    def _hashes(self) -> np.ndarray:
        """A polynomial of each word's bytes, from running sums."""
        n = len(self.bytes)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n))])
        return (sums[self.end] - sums[self.start]) * _powers(_INVERSE, n)[self.start]

    def _grams(self, at: np.ndarray) -> None:
        """Cells of the character n-grams of the distinct words (marks at both ends), and how many each word has."""
        size = self.end[at] - self.start[at] + GRAM - 1  # GRAM - 2 marks before, one behind
        first = np.cumsum(size) - size
        within = np.arange(size.sum()) - np.repeat(first, size)
        source = np.repeat(self.start[at] - (GRAM - 2), size) + within
        inner = (within >= GRAM - 2) & (within < np.repeat(size, size) - 1)
        letters = np.where(inner, self.bytes[np.minimum(source, len(self.bytes) - 1)], 32).astype(np.uint64)
        code = np.zeros(len(letters), np.uint64)
        for i in range(GRAM):
            code = code * np.uint64(257) + np.concatenate([letters[i:], np.zeros(min(i, len(letters)), np.uint64)])
        self.grams = (_finished(code[within < np.repeat(size, size) - GRAM + 1]) % np.uint64(GRAM_CELLS)).astype(np.int64)
        self.gram_count = size - GRAM + 1

    def windows(self, whole: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text of each window, distinct words of each window, byte where a text that goes on has to go on, or -1).

        The number of distinct words stands for an empty place.  A text that
        goes on leaves its last full window to what follows, which may end there.
        """
        n, done = self.count, np.array(whole)
        many = np.where(done, np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STRIDE) + 1), np.maximum(n - WINDOW, 0) // STRIDE)
        text = np.repeat(np.arange(len(n)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        begin = np.minimum(nth * STRIDE, np.maximum(n - WINDOW, 0)[text])
        base = np.cumsum(n) - n
        place = begin[:, None] + np.arange(WINDOW)
        empty = place >= n[text][:, None]
        number = np.append(self.number, 0)[np.where(empty, 0, place + base[text][:, None])]
        number[empty] = len(self.cells)
        next_word = base + many * STRIDE
        next_byte = np.append(self.start, 0)[np.where(done | (many == 0), -1, next_word)] - self.first
        return text, number, np.where(done | (many == 0), -1, next_byte)


def _summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, width) sums of the rows with the same index."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(index):
        order = np.argsort(index, kind="stable")
        first = np.flatnonzero(np.diff(index[order], prepend=-1))
        out[index[order][first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights of the embeddings, of both directions' gates (update, reset, candidate), of the attention and of the output."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def start(seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[-2])).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, np.float32)
        dim = WORD_DIM + GRAM_DIM
        # Embeddings start at zero: a word and an n-gram never met add nothing.
        return Network({"word": zero(WORD_CELLS, WORD_DIM), "gram": zero(GRAM_CELLS, GRAM_DIM), "X": make(2, dim, 3 * HIDDEN), "x": zero(2, 3 * HIDDEN), "U": make(2, HIDDEN, 3 * HIDDEN), "A": make(2 * HIDDEN, ATTENTION), "a": zero(ATTENTION), "v": make(ATTENTION, 1)[:, 0], "c": make(2 * HIDDEN, 1)[:, 0], "b": zero(1)})

    def embed(self, words: Words | _Subset) -> np.ndarray:
        """Inputs of the distinct words: word embedding beside the mean of the n-gram embeddings."""
        grams = np.zeros((len(words.cells), GRAM_DIM), np.float32)
        if len(words.cells):
            first = np.cumsum(words.gram_count) - words.gram_count
            for low in range(0, len(first), 1 << 16):
                own = slice(low, low + (1 << 16))
                a, b = first[own][0], first[own][-1] + words.gram_count[own][-1]
                grams[own] = np.add.reduceat(self.w["gram"][words.grams[a:b]], first[own] - a, axis=0) / words.gram_count[own, None]
        return np.hstack([self.w["word"][words.cells], grams])

    def inputs(self, embedded: np.ndarray) -> np.ndarray:
        """What each distinct word adds to the gates, per direction; an empty place keeps the state (update gate at one)."""
        out = np.zeros((2, len(embedded) + 1, 3 * HIDDEN), np.float32)
        out[:, :-1] = embedded @ self.w["X"] + self.w["x"][:, None]
        out[:, -1, :HIDDEN] = 40
        return out

    def forward(self, inputs: np.ndarray, numbers: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Scores (log odds) of windows of word numbers; ``keep``: with all that the gradients need."""
        n, h = len(numbers), HIDDEN
        states = np.zeros((WINDOW, n, 2 * h), np.float32)
        steps: list[list] = [[], []]
        for side in (0, 1):
            gates, matrix, state = inputs[side], self.w["U"][side], np.zeros((n, h), np.float32)
            for t in range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1):
                x, u = gates[numbers[:, t]], state @ matrix
                zr = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
                if keep:
                    steps[side].append((t, state, z, r, c, u[:, 2 * h :]))
                state = c + z * (state - c)
                states[t, :, side * h : (side + 1) * h] = state
        empty = (numbers == inputs.shape[1] - 1).T
        focus = np.tanh(states @ self.w["A"] + self.w["a"])
        weight = np.where(empty, -np.inf, focus @ self.w["v"])
        weight = np.exp(weight - np.maximum(weight.max(axis=0), -1e30))
        weight /= np.maximum(weight.sum(axis=0), 1e-30)
        pooled = np.einsum("tn,tnd->nd", weight, states)
        return pooled @ self.w["c"] + self.w["b"], {"states": states, "steps": steps, "focus": focus, "weight": weight, "pooled": pooled}

    def gradients(self, f: dict, embedded: np.ndarray, numbers: np.ndarray, error: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the summed loss whose derivative by the scores is ``error``: by the weights, and by the distinct words' inputs."""
        w, h, states, weight = self.w, HIDDEN, f["states"], f["weight"]
        d_pooled = error[:, None] * w["c"]
        d_states = weight[:, :, None] * d_pooled
        by_weight = np.einsum("tnd,nd->tn", states, d_pooled)
        d_focus = weight * (by_weight - (weight * by_weight).sum(axis=0))
        d_pre = d_focus[:, :, None] * w["v"] * (1 - f["focus"] ** 2)
        d_states += d_pre @ w["A"].T
        out = {"c": f["pooled"].T @ error, "b": np.array([error.sum()]), "v": np.einsum("tna,tn->a", f["focus"], d_focus), "A": np.einsum("tnd,tna->da", states, d_pre), "a": d_pre.sum(axis=(0, 1)), "X": np.zeros_like(w["X"]), "x": np.zeros_like(w["x"]), "U": np.zeros_like(w["U"])}
        by_word = np.zeros_like(embedded)
        for side in (0, 1):
            carried, by_place = np.zeros((len(numbers), h), np.float32), np.zeros((len(numbers), WINDOW, 3 * h), np.float32)
            for t, before, z, r, c, uc in reversed(f["steps"][side]):
                ds = d_states[t, :, side * h : (side + 1) * h] + carried
                dc = ds * (1 - z) * (1 - c * c)
                dz, dr = ds * (before - c) * z * (1 - z), dc * uc * r * (1 - r)
                du, dx = np.hstack([dz, dr, dc * r]), np.hstack([dz, dr, dc])
                carried = ds * z + du @ w["U"][side].T
                out["U"][side] += before.T @ du
                by_place[:, t] = dx
            by_number = _summed(numbers.ravel(), by_place.reshape(-1, 3 * h), len(embedded) + 1)[:-1]
            out["X"][side], out["x"][side] = embedded.T @ by_number, by_number.sum(axis=0)
            by_word += by_number @ w["X"][side].T
        return out, by_word

    def scores(self, words: Words | _Subset, numbers: np.ndarray) -> np.ndarray:
        """Log odds of every window."""
        inputs = self.inputs(self.embed(words))
        return np.concatenate([self.forward(inputs, numbers[i : i + CHUNK])[0] for i in range(0, len(numbers), CHUNK)] or [np.zeros(0, np.float32)])


def _step(net: Network, words: _Subset, numbers: np.ndarray, labels: np.ndarray, seen: np.ndarray, moments: dict, step: int) -> None:
    """One step of Adam on the mean cross-entropy of some windows; words not ``seen`` enter by their n-grams alone."""
    embedded = net.embed(words)
    embedded[~seen, :WORD_DIM] = 0
    logits, kept = net.forward(net.inputs(embedded), numbers, True)
    grads, by_word = net.gradients(kept, embedded, numbers, ((_sigmoid(logits) - labels) / len(labels)).astype(np.float32))
    grads["word"] = _summed(words.cells, by_word[:, :WORD_DIM] * seen[:, None], WORD_CELLS)
    grads["gram"] = _summed(words.grams, np.repeat(by_word[:, WORD_DIM:] / words.gram_count[:, None], words.gram_count, axis=0), GRAM_CELLS)
    for k, g in grads.items():
        m, v = moments[k]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        if k in ("word", "gram"):
            net.w[k] *= 1 - RATE * DECAY
        net.w[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)


class _Subset:
    """The distinct words that some windows hold, numbered anew."""

    def __init__(self, words: Words | _Subset, numbers: np.ndarray):
        used, new = np.unique(numbers, return_inverse=True)
        real = used[used < len(words.cells)]
        self.numbers = np.where(numbers == len(words.cells), len(real), new.reshape(numbers.shape))
        self.cells, self.gram_count = words.cells[real], words.gram_count[real]
        first, own = np.cumsum(words.gram_count) - words.gram_count, np.cumsum(self.gram_count) - self.gram_count
        self.grams = words.grams[np.repeat(first[real] - own, self.gram_count) + np.arange(self.gram_count.sum())]


def fit(texts: list[bytes], labels: np.ndarray, share: float, steps: int = STEPS, batch: int = BATCH, drawn: int = DRAWN) -> dict[str, np.ndarray]:
    """Weights from whole texts (lower-case UTF-8) and their 0/1 labels; ``share`` is that of label 1 among all labelled documents.

    A label holds for a text, not for each window: in every step ``drawn``
    windows of each drawn text are scored, and the worst one stands for it; for
    texts of label 0 later steps add the worst of all their windows.  Half of a
    step's texts have each label.  At the end scale and offset of the scores are
    set on texts that the network has not seen, weighted to ``share``.  Only one
    label: the same score for every text.
    """
    aside = np.arange(len(texts)) % ASIDE == ASIDE - 1
    own, held = ([t for t, x in zip(texts, aside == y) if x] for y in (False, True))
    net = Network.start()
    if len(set(labels[~aside])) < 2:
        net.w["c"][:], net.w["b"][:] = 0, np.log((share + 1e-3) / (1 - share + 1e-3))
        return net.w
    _train(net, own, labels[~aside], steps, batch, drawn)
    if len(set(labels[aside])) == 2:
        logits = np.concatenate([score_texts(net, [t.decode()])[0] for t in held])
        scale, offset = _calibrated(logits, labels[aside], share)
    else:
        scale, offset = 1.0, 0.0
    net.w["c"] *= np.float32(scale)
    net.w["b"] = (net.w["b"] * scale + offset).astype(np.float32)
    return net.w


def _train(net: Network, texts: list[bytes], labels: np.ndarray, steps: int, batch: int, drawn: int) -> None:
    words = Words(texts, [True] * len(texts))
    owner, numbers, _ = words.windows([True] * len(texts))
    first = np.searchsorted(owner, np.arange(len(texts)))
    size = np.diff(np.append(first, len(owner)))
    rng = np.random.default_rng(5)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    sides = [np.flatnonzero(labels == y) for y in (0, 1)]
    target, clean = np.repeat([0.0, 1.0], batch), labels[owner] == 0
    mined = None
    for step in range(1, steps + 1):
        text = np.concatenate([rng.choice(s, batch) for s in sides])
        windows = first[text][:, None] + (rng.random((len(text), drawn)) * size[text][:, None]).astype(np.int64)
        if step in MINED:
            scores = np.full(len(owner), -np.inf)
            scores[clean] = net.scores(words, numbers[clean])
            mined = np.lexsort((scores, owner))[first + size - 1]
        if mined is not None:
            windows[:batch, 0] = mined[text[:batch]]
        subset = _Subset(words, numbers[windows.ravel()])
        worst = net.scores(subset, subset.numbers).reshape(len(text), drawn).argmax(axis=1)
        subset = _Subset(words, numbers[windows[np.arange(len(text)), worst]])
        _step(net, subset, subset.numbers, target, rng.random(len(subset.cells)) >= HIDDEN_WORDS, moments, step)


def _calibrated(logits: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Scale (positive) and offset that make log odds fit labels when label 1 has ``share``: weighted logistic regression by Newton steps."""
    weight = np.where(labels == 1, share / max(labels.mean(), 1e-9), (1 - share) / max(1 - labels.mean(), 1e-9))
    spread = logits.std() + 1e-6
    x, (scale, offset) = (logits - logits.mean()) / spread, (1.0, 0.0)
    for _ in range(50):
        p = _sigmoid(scale * x + offset)
        g = np.array([(weight * (p - labels) * x).sum() + 0.1 * (scale - 1), (weight * (p - labels)).sum() + 1e-3 * offset])
        curve = weight * p * (1 - p)
        h = np.array([[(curve * x * x).sum() + 0.1, (curve * x).sum()], [(curve * x).sum(), curve.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        scale, offset = max(0.05, scale - np.clip(step[0], -1, 1)), offset - np.clip(step[1], -1, 1)
    return scale / spread, offset - scale * logits.mean() / spread


def learn(documents: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> dict[str, np.ndarray] | None:
    """Weights fitted on labelled documents (``labels``: doc_id and a 0/1 column).

    At most ``sample`` doc_ids of each label are used, those with the smallest
    hash, and of these, in that order, whole texts while they fit into
    ``sample_chars`` code points together: that is all that comes to the driver.
    Null labels and doc_ids are left out; of several labels of a doc_id the
    largest counts, of several texts the smallest.  None when no labelled
    document is left.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_label"))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    chosen = None
    for y in (0, 1):
        own = known.filter(F.col("_label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = own if chosen is None else chosen.unionAll(own)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("_label").alias("label"), F.min("text").alias("text"))
    texts = staged(texts, "toxicity-sample")
    held, fits = 0, []
    for r in texts.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if held + r.n <= sample_chars:
            held, fits = held + r.n, [*fits, r.doc_id]
    if not fits:
        return None
    rows = texts.filter(F.col("doc_id").isin(fits)).orderBy("doc_id").select("label", "text").collect()
    share = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
    return fit([(r.text or "").lower().encode() for r in rows], np.array([r.label for r in rows]), share)


def score_texts(net: Network, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(log odds of the worst window, number of windows) of each text, all overlapping windows scored."""
    worst, many = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
    waiting = [(i, (t or "").lower().encode(), PIECE) for i, t in enumerate(texts)]
    while waiting:
        pieces, whole = [t[:size] for _, t, size in waiting], [len(t) <= size for _, t, size in waiting]
        words = Words(pieces, whole)
        text, numbers, go_on = words.windows(whole)
        place = np.array([i for i, _, _ in waiting])[text]
        np.maximum.at(worst, place, net.scores(words, numbers))
        many += np.bincount(place, minlength=len(texts))
        # Too few words for a window: look at twice as much.
        waiting = [(i, t[at:], PIECE) if at >= 0 else (i, t, 2 * size) for (i, t, size), at, done in zip(waiting, go_on.tolist(), whole) if not done]
    return worst, many


def score(documents: DataFrame, weights: dict[str, np.ndarray] | None) -> DataFrame:
    """(doc_id, score, windows) for every row of ``documents`` (doc_id, text; more columns are ignored).

    score is the chance of label 1 of the worst window, windows their number.
    Null, empty and wordless texts are one empty window and get a score too.
    Without weights every score is 0.5.  Repeated rows each get a row; an empty
    table gives none.
    """
    rows = documents.select("doc_id", F.col("text").cast("string").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(sent.value) if sent.value else None
        for batch in text_slices(batches, "_text"):
            logits, many = score_texts(net, batch.column("_text").to_pylist()) if net else (np.zeros(batch.num_rows), np.ones(batch.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(logits, -500, 500)))), pa.array(many)], ["doc_id", "score", "windows"])

    return map_batches(rows, run, f"doc_id {kind}, score double, windows long")
