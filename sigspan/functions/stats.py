"""Statistic definitions for segment profiles.

Each profile is a list of ``(name, kind, source, arg)`` entries; ``source`` is ``"x"`` or
``"xa"`` (absolute value of x), ``kind`` one of avg, std, skew, kurt, max, pct.
Percentiles of one source are computed with a single ``percentile(v, array(...))`` call,
so a group keeps one value buffer per source instead of one per percentile.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statistic names and percentile levels of the three reference profiles.
# 20-statistic profile: avg, std, skewness, kurtosis, max and percentiles 0.05 0.20 0.50 0.80 0.95,
# of x (prefix x_) and of abs(x) (prefix xa_); percentile names p1 p2 p5 p8 p9.
PROFILE_20 = [
    ("x_avg", "avg", "x", None),
    ("x_std", "std", "x", None),
    ("x_skew", "skew", "x", None),
    ("x_kurt", "kurt", "x", None),
    ("x_max", "max", "x", None),
    ("x_p1", "pct", "x", 0.05),
    ("x_p2", "pct", "x", 0.20),
    ("x_p5", "pct", "x", 0.50),
    ("x_p8", "pct", "x", 0.80),
    ("x_p9", "pct", "x", 0.95),
    ("xa_avg", "avg", "xa", None),
    ("xa_std", "std", "xa", None),
    ("xa_skew", "skew", "xa", None),
    ("xa_kurt", "kurt", "xa", None),
    ("xa_max", "max", "xa", None),
    ("xa_p1", "pct", "xa", 0.05),
    ("xa_p2", "pct", "xa", 0.20),
    ("xa_p5", "pct", "xa", 0.50),
    ("xa_p8", "pct", "xa", 0.80),
    ("xa_p9", "pct", "xa", 0.95),
]
# 14-statistic tail profile: avg of x; percentiles 0.01 0.02 0.05 0.10 0.90 0.95 0.98 0.99 of x;
# percentiles 0.90 0.92 0.95 0.98 0.99 of abs(x).
PROFILE_14 = [
    ("x_avg", "avg", "x", None),
    ("x_p01", "pct", "x", 0.01),
    ("x_p02", "pct", "x", 0.02),
    ("x_p05", "pct", "x", 0.05),
    ("x_p10", "pct", "x", 0.10),
    ("x_p90", "pct", "x", 0.90),
    ("x_p95", "pct", "x", 0.95),
    ("x_p98", "pct", "x", 0.98),
    ("x_p99", "pct", "x", 0.99),
    ("xa_p90", "pct", "xa", 0.90),
    ("xa_p92", "pct", "xa", 0.92),
    ("xa_p95", "pct", "xa", 0.95),
    ("xa_p98", "pct", "xa", 0.98),
    ("xa_p99", "pct", "xa", 0.99),
]
# Bucket profile: avg of x, percentiles 0.02 and 0.98 of x, percentile 0.95 of abs(x).
PROFILE_BUCKET = [
    ("x_avg", "avg", "x", None),
    ("x_p02", "pct", "x", 0.02),
    ("x_p98", "pct", "x", 0.98),
    ("xa_p95", "pct", "xa", 0.95),
]
# Percentile levels of the long-form quantile query.
QUANTILE_LEVELS = [0.05, 0.20, 0.50, 0.80, 0.95]

PROFILES = {"moments": PROFILE_20, "tails": PROFILE_14, "bucket": PROFILE_BUCKET}

_SIMPLE = {
    "avg": F.avg,
    "std": F.stddev_samp,
    "skew": F.skewness,
    "kurt": F.kurtosis,
    "max": F.max,
    "min": F.min,
}


def profile_aggs(
    stats: list[tuple], sources: dict[str, Column], approx_accuracy: int | None = None
) -> tuple[list[Column], list[Column]]:
    """Aggregate expressions and the projection that names every statistic.

    Returns ``(aggs, names)``: ``aggs`` go into ``agg(...)``, ``names`` into a following ``select``.
    Percentiles are exact (interpolated) unless ``approx_accuracy`` is given, which switches to
    ``percentile_approx`` (a bounded sketch per group, no interpolation).
    """
    aggs: list[Column] = []
    names: list[Column] = []
    levels: dict[str, list[float]] = {}
    for name, kind, src, arg in stats:
        if kind == "pct":
            levels.setdefault(src, [])
            if arg not in levels[src]:
                levels[src].append(arg)
    for src, ps in levels.items():
        arr = F.array(*[F.lit(p) for p in ps])
        if approx_accuracy is None:
            pct = F.percentile(sources[src], arr)
        else:
            pct = F.percentile_approx(sources[src], arr, approx_accuracy)
        aggs.append(pct.alias(f"_pct_{src}"))
    for name, kind, src, arg in stats:
        if kind == "pct":
            pos = levels[src].index(arg) + 1
            names.append(F.element_at(F.col(f"_pct_{src}"), pos).alias(name))
        else:
            aggs.append(_SIMPLE[kind](sources[src]).alias(name))
            names.append(F.col(name))
    return aggs, names
