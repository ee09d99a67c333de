"""Quality classifier: attention-based multiple-instance learning over passages.

Method. A document is a bag of passages of ``PASSAGE`` consecutive words (all of its text). Each
passage is encoded by shape statistics (word lengths, letter case, symbols, digits, repetition,
distinct words) through one tanh layer; a gated attention, softmax of w.(tanh(Vh) * sigmoid(Uh)),
weighs the passages; the weighted sum gives the score. Encoder, attention and output are learned
together from document labels by gradient descent. The fit uses at most ``TRAIN_DOCS`` labelled
documents, those with the smallest xxhash64 of their id; statistics of the features used to
scale them come from the same sample. Scoring streams over all texts, one pass, no shuffle.

Defined cases: a null or blank text is a bag of one passage of zeros; unlabelled rows, null
labels and labels of unknown documents train nothing; with one class only, or none, the score is
the share of label 1 (0.5 without labels); repeated rows are scored each by itself; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, batch, chunks, read

PASSAGE = 64
TRAIN_DOCS = 3000
HIDDEN, GATES, STEPS, RATE, PENALTY, SEED = 16, 8, 200, 0.03, 1e-4, 7
THRESHOLD = 0.3
FEATURES = (
    "log_words", "mean_length", "spread_length", "upper", "digit", "symbol", "bar", "exclamation", "stop", "non_ascii",
    "repeat_1", "repeat_2_8", "short", "long", "distinct", "capital",
)


UPPER, DIGIT, SYMBOL, BAR, EXCLAMATION, STOP, NON_ASCII = range(1, 8)
_KIND = np.zeros(256, np.uint8)
for _kind, _bytes in ((UPPER, range(65, 91)), (DIGIT, range(48, 58)), (SYMBOL, b"#$%&*@^~<>=+\\{}[]_"), (BAR, b"|"), (EXCLAMATION, b"!"), (STOP, b".,"), (NON_ASCII, range(128, 256))):
    _KIND[list(_bytes)] = _kind


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of the texts, and the offsets of each text's rows."""
    w = Words(texts, lower=False)
    counts = np.diff(w.offsets)
    n_pass = np.maximum(1, -(-counts // PASSAGE))
    offsets = np.concatenate([[0], np.cumsum(n_pass)])
    total = int(offsets[-1])
    x = np.zeros((total, len(FEATURES)))
    nw = len(w.starts)
    if not nw:
        return x, offsets
    # first word of each passage; a document without words has a passage without words
    first = np.repeat(w.offsets[:-1], n_pass) + (np.arange(total) - np.repeat(offsets[:-1], n_pass)) * PASSAGE
    last = np.append(first[1:], nw)
    words = np.maximum(last - first, 1).astype(np.float64)
    byte_from = np.append(w.starts, len(w.data))[first]
    byte_to = np.append(byte_from[1:], len(w.data))

    def add(v: np.ndarray) -> np.ndarray:
        c = np.zeros(nw + 1, np.int64)
        np.cumsum(v, out=c[1:])
        return (c[last] - c[first]).astype(np.float64)

    def count(kind: int) -> np.ndarray:
        at = np.flatnonzero(kinds == kind)
        return (np.searchsorted(at, byte_to) - np.searchsorted(at, byte_from)).astype(np.float64)

    kinds = _KIND[w.data]
    length = w.ends - w.starts
    chars = np.maximum(add(length), 1)
    mean = chars / words
    h = w.hashes
    starts_text = np.zeros(nw + 1, bool)
    starts_text[w.offsets[w.offsets <= nw]] = True
    again = np.zeros(nw, bool)
    near = np.zeros(nw, bool)
    crossed = np.cumsum(starts_text[:nw])
    for lag in range(1, 9):
        if nw > lag:
            hit = np.flatnonzero(h[lag:] == h[:-lag])
            hit = hit[crossed[hit + lag] == crossed[hit]] + lag
            (again if lag == 1 else near)[hit] = True
    # distinct words of a passage: 44 bits of the hash, sorted below the passage's number
    row = np.repeat(np.arange(total, dtype=np.uint64), last - first)
    code = np.sort((h >> np.uint64(20)) | (row << np.uint64(44)))
    new = np.ones(nw, bool)
    new[1:] = code[1:] != code[:-1]
    upper, symbol, bar = count(UPPER), count(SYMBOL), count(BAR)
    cols = (
        np.log1p(last - first), mean, np.sqrt(np.maximum(add(length * length) / words - mean**2, 0)),
        upper / chars, count(DIGIT) / chars, symbol / chars, bar / words, count(EXCLAMATION) / words, count(STOP) / words,
        count(NON_ASCII) / chars, add(again) / words, add(near) / words, add(length <= 2) / words, add(length >= 15) / words,
        add(new) / words, add(kinds[w.starts] == UPPER) / words,
    )
    for k, c in enumerate(cols):
        x[:, k] = c
    return x, offsets


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


class GatedAttention:
    """Parameters and forward pass; ``fit`` trains on bags given as rows and offsets."""

    def __init__(self, d: int, seed: int = SEED):
        r = np.random.default_rng(seed)
        s = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"W": s(d, HIDDEN), "b": np.zeros(HIDDEN), "V": s(HIDDEN, GATES), "U": s(HIDDEN, GATES), "w": s(GATES), "o": s(HIDDEN), "c": np.zeros(1)}
        self.mean, self.std, self.constant = np.zeros(d), np.ones(d), None

    def forward(self, x: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        p, at = self.p, offsets[:-1]
        x = np.clip((x - self.mean) / self.std, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        size = np.diff(offsets)
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, at), size))
        a /= np.repeat(np.add.reduceat(a, at), size)
        z = np.add.reduceat(a[:, None] * h, at)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "y": _sigmoid(z @ p["o"] + p["c"])}

    def score(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        return self.forward(x, offsets)["y"]

    def fit(self, x: np.ndarray, offsets: np.ndarray, label: np.ndarray) -> GatedAttention:
        if not len(label) or label.min() == label.max():
            self.constant = float(label.mean()) if len(label) else 0.5
            return self
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        size, p = np.diff(offsets), self.p
        m1 = {k: np.zeros_like(v) for k, v in p.items()}
        m2 = {k: np.zeros_like(v) for k, v in p.items()}
        for step in range(1, STEPS + 1):
            f = self.forward(x, offsets)
            dy = (f["y"] - label) / len(label)
            dz = dy[:, None] * p["o"]
            dzr = np.repeat(dz, size, 0)
            da = (dzr * f["h"]).sum(1)
            de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, offsets[:-1]), size))
            dv, du = de[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2), de[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
            dh = f["a"][:, None] * dzr + dv @ p["V"].T + du @ p["U"].T
            dp = dh * (1 - f["h"] ** 2)
            g = {"W": f["x"].T @ dp, "b": dp.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ de, "o": f["z"].T @ dy, "c": np.array([dy.sum()])}
            for k in p:
                d = g[k] + PENALTY * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.99 * m2[k] + 0.01 * d * d
                p[k] = p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        return self


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    """True where crc32 of the id as text leaves ``rest`` modulo ``mod``."""
    return F.coalesce(F.crc32(id_col.cast("string")) % mod == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, bound: int) -> DataFrame:
    """``(doc_id, label, text)`` of at most ``bound`` labelled documents, by smallest xxhash64 of the id.

    The bound counts ids that stand in ``docs``: labels of other documents do not use it up.
    """
    picked = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & allowed)
        .groupBy("doc_id").agg(F.min(label).alias("label"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")


def train(docs: DataFrame, labels: DataFrame, allowed: Column, bound: int = TRAIN_DOCS) -> GatedAttention:
    """Fit on the bounded sample; passages are encoded to features on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            x, offs = passages(b.column(2))
            flat = pa.ListArray.from_arrays(pa.array(offs * x.shape[1], pa.int32()), pa.array(x.astype(np.float32).ravel()))
            yield batch({"doc_id": b.column(0), "label": b.column(1).cast(pa.int32()), "x": flat})

    rows = labelled_sample(docs, labels, "quality", allowed, bound).mapInArrow(run, "doc_id bigint, label int, x array<float>").toArrow()
    rows = rows.sort_by("doc_id")
    bags = [np.asarray(v, np.float64).reshape(-1, len(FEATURES)) for v in rows.column("x").to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    x = np.concatenate(bags) if bags else np.zeros((0, len(FEATURES)))
    return GatedAttention(len(FEATURES)).fit(x, offsets, rows.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: GatedAttention, keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, the columns of ``keep`` and ``score`` (probability of label 1) of every row."""
    keep = keep or []
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.select("text", F.col("doc_id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            out = {"doc_id": b.column(1)} | {f"k{i}": b.column(i + 2) for i in range(len(keep))}
            yield batch(out | {"score": pa.array(shared.value.score(*passages(b.column(0))))})

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
    fields += [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    out = cols.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())]))
    return out.select("doc_id", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    test = held_out(F.col("doc_id"), 5, 0)
    model = train(docs, read(spark, sf_dir, "labels"), ~test)
    return score(docs, model).select(
        "doc_id", test.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


SQL = {}
