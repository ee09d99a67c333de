"""Embedding whitening by polarisation covariance.

Method. Entries become whole numbers, ``x = floor(SCALE * c)``. The fit list is each distinct ``x`` vector
once. For every dimension the sum of its squared centred values is aggregated, and for every pair
of dimensions that of the squared centred values of their sum; the pair's covariance is half of
what is left of the sum's variance after the two dimensions' own variances are taken off (polarisation), so only squares
are ever summed. All of it is exact: a value is centred on the whole part ``m`` of its mean before it is
squared, the rest ``r`` (``S = n m + r``) enters as ``n * sum of squares - r^2`` in whole numbers of any size, and
one division gives each covariance as the nearest double. ``eigh`` of the assembled matrix gives the
components; a row's whitened value is its centred vector on a component over the root of the eigenvalue.

On Spark: distinct vectors by one grouping (copies are merged map-side, so a hot vector sends one row
a task), two passes over them for sums and squares (a task sends d (d + 1) / 2 numbers), one that measures the
covariance of the whitened fit list, and a last one over all rows without a shuffle. Only numbers that
depend on the vector length d reach the driver.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped; zero
vectors stay; vectors of each length are fitted and whitened apart; a null id is kept; repeated ids
and equal vectors give rows of their own but count once in the fit; entries beyond the range of a long take its
end; fewer dimensions than components give as many; a component without variance (``e`` at or below rounding of
the largest) has whitened value 0 and is left out of ``identity_error``; a component's sign makes its largest entry
positive; an empty table gives no rows; extra columns are ignored unless kept. A very long vector costs d^2 memory in
a task and on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, read, stage
from .vectors import by_length

SCALE, COMPONENTS = 256, 4
LOW_BITS = 62  # exact sums travel as two decimals: bits above and below
CHUNK_NUMBERS = 1 << 20  # numbers of a block of rows in a task
_LONG = 1 << 62


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int, keep: Sequence[str] = ()) -> DataFrame:
    """``(vec_id, x array<bigint>, k0, k1, ...)`` of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    usable = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    top = float(1 << 63)
    number = lambda c: F.when(c * scale >= top, F.lit((1 << 63) - 1)).when(c * scale < -top, F.lit(-(1 << 63))).otherwise(F.floor(c * scale))
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    rows = vectors.filter(F.coalesce(usable, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, number).alias("x"), *kept)


def _blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of a list column by length and in blocks of bounded size: length, places, whole numbers."""
    for d, at, x in by_length(column):
        step = max(1, CHUNK_NUMBERS // d)
        for i in range(0, len(at), step):
            yield d, at[i : i + step], x[i : i + step]


def _decimals(numbers: Sequence[int]) -> pa.Array:
    return pa.array([Decimal(n) if abs(n) < 10**38 else None for n in numbers], pa.decimal128(38, 0))


def _top(x: np.ndarray) -> int:
    """Largest absolute value, as a whole number of any size."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def _long_or_object(x: np.ndarray, factor: int = 1) -> np.ndarray:
    """``x`` itself while ``factor`` times its values stay far inside a long, else whole numbers of any size."""
    return x if _top(x) * factor < _LONG else x.astype(object)


@dataclass
class Whitening:
    """What whitening one vector length needs; ``n`` distinct vectors, ``m`` and ``r`` as in the module text."""

    n: int
    m: np.ndarray
    r: list[int]
    axes: np.ndarray  # components as columns
    values: np.ndarray  # their eigenvalues, falling; 0 for those without variance
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - m``, exact."""
        return _long_or_object(x, 4) - _long_or_object(self.m, 4)

    def whitened(self, u: np.ndarray) -> np.ndarray:
        """Rows on the components over the roots of the eigenvalues; ``u`` is centred on ``m``."""
        rest = np.array([r / self.n for r in self.r])
        root = np.where(self.values > 0, np.sqrt(self.values), np.inf)
        return (u.astype(np.float64) - rest) @ self.axes / root

    def deviations(self, u: np.ndarray) -> pa.Array:
        """Sum over dimensions of ``(n x - S)^2`` of each row, exact; null beyond 38 digits."""
        worst = self.n * (_top(u) + 1)
        if worst * worst * u.shape[1] < _LONG:
            y = u.astype(np.int64) * self.n - np.array(self.r, np.int64)
            return pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
        y = u.astype(object) * self.n - np.array(self.r, object)
        return _decimals((y * y).sum(1).tolist())


def totals(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each vector length the number of vectors and the sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for d, at, x in _blocks(b.column(0)):
                s = _long_or_object(x, len(x)).sum(0).astype(object)
                held = sums.setdefault(d, [0, 0])
                held[0] += len(at)
                held[1] = held[1] + s
        for d, (n, s) in sums.items():
            yield batch({"d": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "s": _decimals(s.tolist())})

    out: dict[int, tuple[int, list[int]]] = {}
    cells = distinct.select("x").mapInArrow(run, "d int, i int, n long, s decimal(38,0)")
    for r in cells.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow().to_pylist():
        n, s = out.setdefault(r["d"], (r["n"], [0] * r["d"]))
        s[r["i"]] = int(r["s"])
    return out


def block_squares(u: np.ndarray) -> np.ndarray:
    """Upper triangle of sums over rows: of ``u_i^2`` at (i, i), of ``(u_i + u_j)^2`` at (i, j)."""
    d = u.shape[1]
    cols = np.ascontiguousarray(u.T)
    out = np.zeros((d, d), u.dtype)
    for i in range(d):
        w = cols[i:] + cols[i]
        w[0] = cols[i]
        out[i, i:] = (w * w).sum(1)
    return out


def squares(distinct: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, dict[tuple[int, int], int]]:
    """For each vector length the exact sums of :func:`block_squares` over all vectors, centred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # length -> [sums in longs, their bound, sums of any size]
        for b in batches:
            for d, _, x in _blocks(b.column(0)):
                u = _long_or_object(x, 4) - _long_or_object(centres[d], 4)
                h = held.setdefault(d, [np.zeros((d, d), np.int64), 0, np.zeros((d, d), object)])
                bound = (2 * _top(u)) ** 2 * len(u)
                if bound >= _LONG:
                    h[2] = h[2] + block_squares(u.astype(object))
                    continue
                if h[1] + bound >= _LONG:
                    h[2] = h[2] + h[0].astype(object)
                    h[0][:], h[1] = 0, 0
                h[0] += block_squares(u.astype(np.int64))
                h[1] += bound
        for d, (small, _, large) in held.items():
            i, j = np.triu_indices(d)
            q = (large + small.astype(object))[i, j].tolist()
            low = (1 << LOW_BITS) - 1
            yield batch({
                "d": pa.array(np.full(len(i), d, np.int32)), "i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)),
                "high": _decimals([int(v) >> LOW_BITS for v in q]), "low": _decimals([int(v) & low for v in q]),
            })

    out: dict[int, dict[tuple[int, int], int]] = {}
    cells = distinct.select("x").mapInArrow(run, "d int, i int, j int, high decimal(38,0), low decimal(38,0)")
    for r in cells.groupBy("d", "i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).toArrow().to_pylist():
        out.setdefault(r["d"], {})[r["i"], r["j"]] = (int(r["high"]) << LOW_BITS) + int(r["low"])
    return out


def polarised(n: int, r: Sequence[int], q: dict[tuple[int, int], int]) -> tuple[np.ndarray, float]:
    """Covariance matrix and its trace from the sums of squares: each entry one exact division."""
    d = len(r)
    own = [n * q[i, i] - r[i] ** 2 for i in range(d)]  # n^2 times the variance of a dimension
    v = np.zeros((d, d))
    for i in range(d):
        v[i, i] = own[i] / (n * n)
        for j in range(i + 1, d):
            both = n * q[i, j] - (r[i] + r[j]) ** 2  # n^2 times the variance of the two dimensions' sum
            v[i, j] = v[j, i] = (both - own[i] - own[j]) / (2 * n * n)
    return v, sum(own) / (n * n)


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A :class:`Whitening` for each vector length of ``distinct(x)``."""
    sums = totals(distinct)
    centres = {d: np.array([s // n for s in S], np.int64) for d, (n, S) in sums.items()}
    out = {}
    for d, q in squares(distinct, centres).items():
        n, S = sums[d]
        r = [s % n for s in S]
        v, trace = polarised(n, r, q)
        values, axes = np.linalg.eigh(v)
        k = min(components, d)
        values, axes = values[::-1][:k].copy(), axes[:, ::-1][:, :k].copy()
        axes *= np.where(axes[np.abs(axes).argmax(0), range(k)] < 0, -1.0, 1.0)
        values[values <= max(values[0], 0) * d * np.finfo(float).eps] = 0
        out[d] = Whitening(n, centres[d], r, axes, values, values / trace if trace else np.zeros(k))
    return out


def _rows(fitted: dict[int, Whitening], column: pa.Array) -> Iterator[tuple[Whitening, np.ndarray, np.ndarray]]:
    for d, at, x in _blocks(column):
        yield fitted[d], at, fitted[d].centred(x)


def measured(distinct: DataFrame, fitted: dict[int, Whitening]) -> None:
    """Set ``identity_error``: how far the covariance of the whitened fit list is from the identity."""
    k = max((len(w.values) for w in fitted.values()), default=0)
    if not k:
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, _, u in _rows(fitted, b.column(0)):
                z = w.whitened(u)
                cols = {f"w{i}": pa.array(z[:, i] if i < z.shape[1] else np.zeros(len(z))) for i in range(k)}
                yield batch({"d": pa.array(np.full(len(z), u.shape[1], np.int32)), **cols})

    white = distinct.select("x").mapInArrow(run, "d int, " + ", ".join(f"w{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for r in white.groupBy("d").agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).collect():
        w = fitted[r["d"]]
        live = w.values > 0
        off = [abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < len(live) and live[i] and live[j]]
        w.identity_error = max(off, default=0.0)


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", keep: Sequence[str] = ()
) -> DataFrame:
    """``(vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error, *keep)``, one row for each
    vector and component. ``keep``: further input columns, whatever their names."""
    rows = whole_vectors(vectors, id_col, vec_col, scale, keep)
    distinct = stage(rows.select("x").distinct(), "whole-vectors")
    fitted = fit(distinct, components)
    measured(distinct, fitted)
    shared = vectors.sparkSession.sparkContext.broadcast(fitted)  # d x components numbers for each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, at, u in _rows(shared.value, b.column(1)):
                z, k = w.whitened(u), len(w.values)
                each, take = len(at) * k, pa.array(np.repeat(at, k))
                yield batch({
                    "vec_id": b.column(0).take(take),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    "n": pa.array(np.full(each, w.n, np.int64)),
                    "deviation": w.deviations(u).take(pa.array(np.repeat(np.arange(len(at)), k))),
                    "whitened": pa.array(z.ravel() + 0.0),
                    "explained": pa.array(np.tile(w.explained, len(at))),
                    "identity_error": pa.array(np.full(each, w.identity_error)),
                    **{f"k{i}": b.column(2 + i).take(take) for i in range(len(keep))},
                })

    own = T.StructType.fromDDL("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    kept = [T.StructField(f"k{i}", vectors.schema[c].dataType) for i, c in enumerate(keep)]
    out = rows.mapInArrow(run, T.StructType([*own.fields, *kept]))
    return out.select(*own.names, *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; ``deviation`` as a long, null where it does not fit one."""
    out = whiten(read(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("bigint"))


SQL = {}
