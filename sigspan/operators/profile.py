"""Grouped profiles: moments, exact percentiles, segment and bucket profiles.

All are one ``groupBy().agg()`` with partial aggregation. Moments are algebraic, so a hot group
costs nothing extra. Exact percentiles keep a value-count map per group; groups are segments or
buckets of a segment, whose size is bounded by the segment length. For groups without such a
bound, ``exact_quantiles_distributed`` selects the order statistics of large groups without a sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import field
from ..functions.stats import PROFILES, QUANTILE_LEVELS, profile_aggs
from ..session import sized_broadcast, stage_table
from ..spec import SegmentSpec
from .selection import select_quantiles
from .sequence import null_safe_join

LARGE_GROUP = 1 << 20  # rows; larger groups are not held in one buffer (about 32 bytes for each distinct value)
_GROUP_ROW_BYTES = 64


def _sources(value: str):
    return {"x": F.col(value), "xa": F.abs(F.col(value))}


def grouped_profile(
    df: DataFrame, keys: Sequence[str], stats: list[tuple], value: str = "x", approx_accuracy: int | None = None
) -> DataFrame:
    aggs, names = profile_aggs(stats, _sources(value), approx_accuracy)
    return df.groupBy(*keys).agg(*aggs).select(*keys, *names)


def segment_profile(
    seq: DataFrame,
    kind: str = "moments",
    keys: Sequence[str] = ("seg",),
    value: str = "x",
    approx_accuracy: int | None = None,
) -> DataFrame:
    """Per-segment profile: ``moments`` (20 statistics) or ``tails`` (14 statistics).

    Both profiles of one set can be requested together with ``kind="both"``; they then share
    one scan and one aggregation. ``approx_accuracy`` opts into approximate percentiles.
    """
    if kind == "both":
        stats = PROFILES["moments"] + [s for s in PROFILES["tails"] if s[0] not in {t[0] for t in PROFILES["moments"]}]
    else:
        stats = PROFILES[kind]
    return grouped_profile(seq, list(keys), stats, value, approx_accuracy)


def moments_profile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """avg, sample std, population skewness, excess kurtosis and max of ``value`` per group."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.avg(v).alias("avg"),
        F.stddev_samp(v).alias("std"),
        F.skewness(v).alias("skew"),
        F.kurtosis(v).alias("kurt"),
        F.max(v).alias("max"),
    )


def quantile_profile(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float] = QUANTILE_LEVELS) -> DataFrame:
    """Exact interpolated percentiles in long form ``(keys..., p, q)``; one buffer per group."""
    ps = [float(p) for p in levels]
    agg = df.groupBy(*keys).agg(F.percentile(F.col(value), F.array(*[F.lit(p) for p in ps])).alias("_q"))
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in ps]).alias("p"), F.col("_q").alias("q"))
    return agg.select(*keys, F.explode(pairs).alias("_pq")).select(*keys, "_pq.p", "_pq.q")


def exact_quantiles_distributed(
    df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float] = QUANTILE_LEVELS, large: int = LARGE_GROUP
) -> DataFrame:
    """Exact interpolated percentiles for groups of any size, in long form ``(keys..., p, q)``.

    No row is sorted. A scan of the keys finds the groups of more than ``large`` rows; their order
    statistics are selected by histogram refinement (:mod:`.selection`), so no task ever holds such a group. All other
    groups fit one ``percentile`` buffer each. Without a large group the second pass is one aggregation.
    Groups without a value are left out, a NULL key forms a group.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    big = stage_table(sizes.where(F.col("_n") > large).select(*keys), "large-groups")
    most = big.count()
    if not most:
        return quantile_profile(rows, keys, value, levels)
    some = sized_broadcast(big, most, _GROUP_ROW_BYTES * len(keys))
    rest = quantile_profile(null_safe_join(rows, some, keys, "left_anti"), keys, value, levels)
    return rest.unionByName(select_quantiles(null_safe_join(rows, some, keys, "left_semi"), keys, value, levels))


def bucket_of(spec: SegmentSpec, no: str = "no"):
    """Stat bucket of a 1-based position: ``int(no / B)`` (truncation), i.e. ``no div B`` for no >= 0."""
    return F.expr(f"`{no}` div {spec.bucket}").cast("int")


def bucket_profile(seq: DataFrame, spec: SegmentSpec, value: str = "x", keys: Sequence[str] = ("seg",)) -> DataFrame:
    """``(seg, seq, x_avg, x_p02, x_p98, xa_p95)`` per segment and stat bucket."""
    bucketed = seq.withColumn("seq", bucket_of(spec))
    return grouped_profile(bucketed, [*keys, "seq"], PROFILES["bucket"], value)


def bucket_vectors(
    profile: DataFrame, columns: Sequence[str] = ("x_avg", "x_p02", "x_p98", "xa_p95"), keys: Sequence[str] = ("seg",)
) -> DataFrame:
    """Collect bucket statistics of a segment into parallel arrays ordered by bucket.

    ``(seg, stx1..stxN array<double>)``; the array position is the rank of the bucket.
    One row per segment, bounded by ``L / B + 1`` buckets.
    """
    cols = list(columns)
    packed = profile.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", *cols))).alias("_b"))
    return packed.select(*keys, *[F.transform("_b", field(c)).alias(f"stx{i + 1}") for i, c in enumerate(cols)])



def assemble(df: DataFrame, cols: Sequence[str], out: str = "stat", handle_invalid: str = "error") -> DataFrame:
    """Scalar columns -> one ``array<double>`` in column order.

    ``handle_invalid``: ``error`` fails on a NULL (like a vector assembler's default), ``keep``
    stores NULL as NaN, ``skip`` drops the row.
    """
    vals = [F.col(c).cast("double") for c in cols]
    any_null = F.lit(False)
    for v in vals:
        any_null = any_null | v.isNull()
    if handle_invalid == "error":
        arr = F.when(any_null, F.raise_error(F.lit(f"NULL in one of {list(cols)}"))).otherwise(F.array(*vals))
        return df.withColumn(out, arr)
    if handle_invalid == "keep":
        return df.withColumn(out, F.array(*[F.coalesce(v, F.lit(float("nan"))) for v in vals]))
    if handle_invalid == "skip":
        return df.where(~any_null).withColumn(out, F.array(*vals))
    raise ValueError("handle_invalid must be error, keep or skip")

