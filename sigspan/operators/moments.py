"""Mergeable moments: a small state for each group that later batches and coarser groups are merged from.

A state is ``(n, mean, m2, m3, m4, low, high)``: the count, the mean, the sums of the 2nd, 3rd and 4th powers of the
distances from that mean, the least and the largest value. States of disjoint rows merge to the state of their
union without the rows, whatever their means (the sums are moved to the common mean), so a profile
rolls up from finer groups, and a scaler is refitted when a batch of vectors arrives, from tables of states.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scaler import _number
from .sequence import null_safe_join

STATE = ("n", "mean", "m2", "m3", "m4", "low", "high")


def moment_state(df: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    """``(keys..., *STATE)`` of ``value`` per group: one aggregate with map-side merging. NULL values do not count."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    agg = df.select(*keys, v.alias("_v")).groupBy(*keys).agg(
        F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.var_pop("_v").alias("_var"), F.skewness("_v").alias("_skew"),
        F.kurtosis("_v").alias("_kurt"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    # the built-in aggregates hold the same sums; without spread the standardised ones are undefined and the sums 0
    m2 = F.coalesce(F.col("_var") * F.col("n"), F.lit(0.0))
    m3 = F.when(F.col("_var") > 0, F.col("_skew") * F.pow("_var", F.lit(1.5)) * F.col("n")).otherwise(F.lit(0.0))
    m4 = F.when(F.col("_var") > 0, (F.col("_kurt") + 3) * F.col("_var") * F.col("_var") * F.col("n")).otherwise(F.lit(0.0))
    return agg.select(*keys, "n", F.coalesce("mean", F.lit(0.0)).alias("mean"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4"), "low", "high")


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of the unions over ``keys`` (NULL keys form a group); other columns, such as a batch or a finer key, go."""
    keys = list(keys)
    means = states.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("mean")).alias("_s"))
    means = means.select(*keys, F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(F.lit(0.0)).alias("_mean"))
    cols = [F.col(f"`{c}`") for c in (*keys, *STATE)]
    moved = null_safe_join(states.select(*cols), means, keys) if keys else states.select(*cols).withColumn("_mean", means.select("_mean").scalar())
    d, n, m2, m3, m4 = F.col("mean") - F.col("_mean"), F.col("n"), F.col("m2"), F.col("m3"), F.col("m4")
    return moved.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(m2 + n * d * d).alias("m2"),
        F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"), F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"),
        F.min("low").alias("low"), F.max("high").alias("high"))


def state_statistics(states: DataFrame, keys: Sequence[str], prefix: str = "x") -> DataFrame:
    """``(keys..., {prefix}_avg, _std, _skew, _kurt, _max)``: sample std (NULL for one value), population
    skewness and excess kurtosis (NULL without spread), as the built-in aggregates give them."""
    n = F.col("n")
    spread = F.col("m2") > 0
    return states.select(
        *keys,
        F.when(n > 0, F.col("mean")).alias(f"{prefix}_avg"),
        F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias(f"{prefix}_std"),
        F.when(spread, F.sqrt(n.cast("double")) * F.col("m3") / F.pow("m2", F.lit(1.5))).alias(f"{prefix}_skew"),
        F.when(spread, n * F.col("m4") / (F.col("m2") * F.col("m2")) - 3).alias(f"{prefix}_kurt"),
        F.col("high").alias(f"{prefix}_max"),
    )


def scaler_state(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., k, *STATE)``: the state of every dimension of an array column; NaN values do not count.

    ``merge_states(..., [*by, "k"])`` joins batches; :func:`scaler_from_states` gives the scaler.
    """
    long = df.select(*by, F.posexplode(col).alias("k", "_e"))
    return moment_state(long, [*by, "k"], _number(F.col("_e")))


def scaler_from_states(states: DataFrame, by: Sequence[str] = (), std_col: str = "std") -> DataFrame:
    """Merged states -> the table that :func:`sigspan.operators.scaler.fit_scaler` fits from the rows."""
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(F.lit(0.0))
    packed = F.array_sort(F.collect_list(F.struct("k", std.alias("_s"))))
    gathered = states.groupBy(*by).agg(packed.alias("_p"))
    return gathered.select(*by, F.transform("_p", lambda e: e["_s"]).alias(std_col))
