"""Quality scores by attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardstream.llm.common import arrow_schema, map_batches, text_slices

#: Words in a passage; a document is the bag of its passages, the last one shorter.
PASSAGE = 64
#: Labelled documents that the classifier is fitted on (those with the smallest hash of doc_id).
SAMPLE = 6_000
#: Passages of a sampled document that the fit sees: of a longer one, this many groups of neighbours, averaged.
SAMPLE_PASSAGES = 128
HIDDEN, ATTENTION, ROUNDS, RATE, DECAY = 16, 8, 400, 0.02, 1e-4

#: Kinds of bytes: lower, upper, digit, space, sentence marks, commas and the like, quotes and brackets, other symbols, non-ASCII.
_KINDS = np.full(256, 7)
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\f", b".!?", b",;:-", b"'\"()[]")):
    _KINDS[list(_bytes)] = _kind
_KINDS[128:] = 8
N_KINDS = 9
FEATURES = N_KINDS + 7


def encode_passages(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, number of passages of each text).

    Shares of the kinds of bytes, mean word length and its spread, shares of
    different words and of different word pairs, of words with symbols and of
    very short words, and the passage's length.  A text without words is one
    empty passage.
    """
    passages, sizes, rows = [], [], []
    for text in texts:
        words = (text or b"").split()
        parts = [words[i : i + PASSAGE] for i in range(0, len(words), PASSAGE)] or [[]]
        sizes.append(len(parts))
        for part in parts:
            n = len(part)
            lengths = list(map(len, part))
            mean = sum(lengths) / n if n else 0.0
            spread = (sum(x * x for x in lengths) / n - mean * mean) ** 0.5 if n and sum(x * x for x in lengths) / n > mean * mean else 0.0
            rows.append((mean / 8, spread / 8, len(set(part)) / n if n else 1.0, len(set(zip(part, part[1:]))) / (n - 1) if n > 1 else 1.0, sum(x <= 2 for x in lengths) / n if n else 0.0, np.log1p(n) / 4, 1.0 if n == 0 else 0.0))
            passages.append(b" ".join(part))
    owner = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    kinds = _KINDS[np.frombuffer(b"".join(passages), np.uint8)]
    counts = np.bincount(owner * N_KINDS + kinds, minlength=len(passages) * N_KINDS).reshape(-1, N_KINDS)
    shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.hstack([np.sqrt(shares), np.array(rows)]).astype(np.float32), np.array(sizes, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """h = tanh(E x); a ~ exp(w . (tanh(V h) * sigmoid(U h))) over a bag; score = sigmoid(c . sum(a h) + b)."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def start(mean: np.ndarray, scale: np.ndarray, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        d = len(mean)
        make = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-1]), shape)
        return Network({"mean": mean, "scale": scale, "E": make(HIDDEN, d), "e": np.zeros(HIDDEN), "V": make(ATTENTION, HIDDEN), "U": make(ATTENTION, HIDDEN), "w": make(ATTENTION), "c": make(HIDDEN), "b": np.zeros(1)})

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        w, starts, owner = self.w, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        x = (x - w["mean"]) / w["scale"]
        h = np.tanh(x @ w["E"].T + w["e"])
        t, g = np.tanh(h @ w["V"].T), _sigmoid(h @ w["U"].T)
        s = (t * g) @ w["w"]
        a = np.exp(s - np.maximum.reduceat(s, starts)[owner])
        a /= np.add.reduceat(a, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["b"]), "owner": owner, "starts": starts}

    def gradients(self, f: dict[str, np.ndarray], error: np.ndarray) -> dict[str, np.ndarray]:
        """Of the summed loss whose derivative by the bags' logits is ``error``."""
        w, owner = self.w, f["owner"]
        dz = error[:, None] * w["c"]
        da = (dz[owner] * f["h"]).sum(axis=1)
        ds = f["a"] * (da - np.add.reduceat(f["a"] * da, f["starts"])[owner])
        dt, dg = ds[:, None] * w["w"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * w["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz[owner] + dt @ w["V"] + dg @ w["U"]) * (1 - f["h"] ** 2)
        return {"E": dh.T @ f["x"], "e": dh.sum(axis=0), "V": dt.T @ f["h"], "U": dg.T @ f["h"], "w": (ds[:, None] * f["t"] * f["g"]).sum(axis=0), "c": f["z"].T @ error, "b": np.array([error.sum()])}


def fit(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> Network:
    """Adam on the mean cross-entropy over all bags, from fixed starting weights."""
    net = Network.start(x.mean(axis=0), x.std(axis=0) + 1e-3)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items() if k not in ("mean", "scale")}
    for step in range(1, ROUNDS + 1):
        f = net.forward(x, sizes)
        for k, g in net.gradients(f, (f["p"] - labels) / len(labels)).items():
            m, v = moment[k]
            g = g + DECAY * net.w[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            net.w[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _pooled(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bags of SAMPLE_PASSAGES at most: neighbours of a longer bag are averaged in even groups."""
    within = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = np.minimum(sizes, SAMPLE_PASSAGES)
    group = within * np.repeat(n, sizes) // np.repeat(sizes, sizes) + np.repeat(np.cumsum(n) - n, sizes)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    count = np.diff(np.append(first, len(x)))
    return np.add.reduceat(x, first, axis=0) / count[:, None], n


_SAMPLE = "label int, n int, features binary"


def learn(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """Weights fitted on labelled documents (``labels``: doc_id and a 0/1 column).

    At most ``sample`` labelled rows are used, those with the smallest hash of
    doc_id; whole texts are encoded.  What comes to the driver is bounded by
    ``sample`` bags of SAMPLE_PASSAGES passages.  Null labels and labels of
    unknown documents are left out; None when no labelled document is left.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("_utf8")).join(F.broadcast(chosen), "doc_id").select("label", "_utf8")
    schema = arrow_schema(_SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "_utf8"):
            x, n = _pooled(*encode_passages(batch.column("_utf8").to_pylist()))
            parts = np.split(x.astype("<f4"), np.cumsum(n)[:-1])
            yield pa.RecordBatch.from_pylist([{"label": y, "n": int(k), "features": p.tobytes()} for y, k, p in zip(batch.column("label").to_pylist(), n, parts)], schema)

    bags = map_batches(rows, run, _SAMPLE).collect()
    if not bags:
        return None
    bags.sort(key=lambda r: (r["label"], bytes(r["features"])))  # the order of arrival has no say
    x = np.frombuffer(b"".join(bytes(r["features"]) for r in bags), "<f4").reshape(-1, FEATURES).astype(np.float64)
    return fit(x, np.array([r["n"] for r in bags]), np.array([r["label"] for r in bags], np.float64)).w


def score(documents: DataFrame, weights: dict[str, np.ndarray] | None) -> DataFrame:
    """(doc_id, score, passages, strongest) for every row of ``documents`` (doc_id, text).

    score is the chance of label 1 for the attention-weighted passages;
    passages counts them and strongest is the largest attention weight.  Null,
    empty and blank texts are one empty passage and get a score too.  Without
    weights every score is 0.5.  Repeated rows each get a row.
    """
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("_utf8"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network({k: v.astype(np.float32) for k, v in sent.value.items()}) if sent.value else None
        for batch in text_slices(batches, "_utf8"):
            x, n = encode_passages(batch.column("_utf8").to_pylist())
            if net is None:
                p, strongest = np.full(len(n), 0.5), 1.0 / n
            else:
                f = net.forward(x, n)
                p, strongest = f["p"].astype(np.float64), np.maximum.reduceat(f["a"], f["starts"]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(n), pa.array(strongest)], ["doc_id", "score", "passages", "strongest"])

    return map_batches(rows, run, f"doc_id {kind}, score double, passages long, strongest double")
