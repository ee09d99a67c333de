"""Range buckets on fixed bounds: an order cut into pieces that every pass of a job sees alike.

``repartitionByRange`` samples its bounds anew in each plan, so two passes over one input need not
agree on them. Here the bounds are fitted once, on a bounded sample of the order keys, and are then literals of the
plan: ``assign`` is a plain projection, and a count per bucket and a numbering per bucket fit together
without a stored copy of the rows.

The first key is mapped to a double that keeps its order (timestamps as microseconds, or seconds without a
zone, dates as days; values that share a double, as numbers beyond 2**53 may, stay in one bucket) and looked up by
bisection (Spark ML ``Bucketizer``). A value of the first key that fills a bucket or more gets a bucket of its own,
and that bucket is cut again by the second key, so a hot first key is spread. Bounds steer only how
evenly rows are spread, never a result.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_SAMPLE = 1 << 18  # order keys that reach the driver at most (about), 16 bytes each
SAMPLE_PER_BUCKET = 32
LEAST_PER_BUCKET = 16


def order_key(df: DataFrame, name: str) -> Column | None:
    """``name`` as a double that keeps its order, or None for a type without one.

    NULL stays NULL. ``+ 0.0`` makes a negative zero the plain one, which Spark orders as equal.
    """
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.cast("double") + F.lit(0.0)
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        return c.cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):  # whole seconds, from its fields: a cast would go through the session's time zone
        seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
        return F.unix_date(c.cast("date")).cast("double") * 86400.0 + seconds
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    return None


@dataclass(frozen=True)
class RangeBuckets:
    """Buckets 0, 1, ... in the order of ``keys``; NULL first keys come in bucket 0, NaN in the last."""

    keys: tuple[str, ...]
    splits: tuple[float, ...]  # inner bounds of the first key
    hot: dict[int, tuple[float, ...]] = field(default_factory=dict)  # place among splits -> inner bounds of the second key

    @property
    def width(self) -> int:
        return 2 + max((len(x) for x in self.hot.values()), default=0)

    @property
    def count(self) -> int:
        """Upper bound on the number of buckets that hold rows."""
        return len(self.splits) + 3 + sum(len(x) + 1 for x in self.hot.values())

    def assign(self, df: DataFrame, name: str = "bucket") -> DataFrame:
        """``df`` with its bucket number (a long); a projection, no shuffle."""
        first, out = "_range_key", df.withColumn("_range_key", order_key(df, self.keys[0]))
        place = F.lit(1)
        if self.splits:
            out = _bisect(out, first, self.splits, "_range_at")
            place = F.coalesce(F.col("_range_at").cast("long") + 1, F.lit(0))
        else:
            place = F.when(F.col(first).isNull(), 0).when(F.isnan(first), 2).otherwise(1)
        bucket = place.cast("long") * self.width
        extra = []
        if self.hot:
            out = out.withColumn("_range_next", order_key(df, self.keys[1]))
            inner = F.lit(0)
            for at, bounds in self.hot.items():
                extra.append(f"_range_in_{at}")
                out = _bisect(out, "_range_next", bounds, extra[-1])
                sub = F.coalesce(F.col(extra[-1]).cast("long") + 1, F.lit(0))
                # a NaN goes with the last bounds, so that the width holds
                inner = F.when(F.col("_range_at") == at, F.least(sub, F.lit(len(bounds) + 1))).otherwise(inner)
            bucket = bucket + inner
            extra.append("_range_next")
        return out.withColumn(name, bucket).drop(first, "_range_at", *extra)


def _bisect(df: DataFrame, col: str, inner: Sequence[float], out: str) -> DataFrame:
    """Number of ``inner`` bounds at or below ``col``; NaN gets one more, NULL stays NULL."""
    splits = [-math.inf, *inner, math.inf]
    return Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)


def fit_ranges(df: DataFrame, keys: Sequence[str], buckets: int, seed: int = 7) -> RangeBuckets | None:
    """Fit about ``buckets`` ranges of the order ``keys`` on a sample of at most ``MAX_SAMPLE`` keys (about).

    None if a key among the first two has no order-keeping double. Two small jobs: a count and the sample.
    """
    keys = tuple(keys)
    cols = [order_key(df, k) for k in keys[:2]]
    if not cols or any(c is None for c in cols):
        return None
    buckets = max(1, min(buckets, MAX_SAMPLE // LEAST_PER_BUCKET))
    want = min(MAX_SAMPLE, SAMPLE_PER_BUCKET * buckets)
    total = df.count()
    names = [f"k{i}" for i in range(len(cols))]
    picked = df.select(*[c.alias(n) for c, n in zip(cols, names)])
    if total > want:
        picked = picked.sample(fraction=want / total, seed=seed)
    table = picked.toArrow()
    rows = sorted(
        tuple(-math.inf if x is None else math.inf if math.isnan(x) else x for x in r)
        for r in zip(*[table.column(n).to_pylist() for n in names])
    )
    return cut(keys, rows, buckets)


def cut(keys: Sequence[str], rows: Sequence[tuple[float, ...]], buckets: int) -> RangeBuckets:
    """Bounds at equal steps of sorted sample ``rows``; see the module text for hot first keys."""
    at = [rows[len(rows) * i // buckets] for i in range(1, buckets)] if rows else []
    at = [r for r in at if math.isfinite(r[0])]
    values = sorted({r[0] for r in at})
    inner: set[float] = set(values)
    repeated = {v for v in values if sum(r[0] == v for r in at) > 1} if len(at) > len(values) else set()
    for v in repeated:
        inner.add(math.nextafter(v, math.inf))
    splits = sorted(x for x in inner if math.isfinite(x))
    hot = {}
    if len(keys) > 1:
        for v in sorted(repeated):
            seconds = sorted({r[1] for r in at if r[0] == v and len(r) > 1 and math.isfinite(r[1])})
            if seconds:
                hot[bisect_right(splits, v)] = tuple(seconds)
    return RangeBuckets(tuple(keys), tuple(splits), hot)
