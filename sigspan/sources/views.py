"""SQL access: register tables as temporary views, and run profile SQL over a DataFrame argument."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..functions.stats import PROFILES
from .tables import TABLES, read_table

_SQL_AGG = {
    "avg": "avg({v})",
    "std": "stddev_samp({v})",
    "skew": "skewness({v})",
    "kurt": "kurtosis({v})",
    "max": "max({v})",
    "min": "min({v})",
}


def register_views(spark: SparkSession, sf_dir: str, names: Iterable[str] = TABLES) -> list[str]:
    """``createOrReplaceTempView`` for every table of a data directory; returns the view names."""
    out = []
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
        out.append(name)
    return out


def profile_sql(spark: SparkSession, data: DataFrame, kind: str = "moments", keys: str = "seg", value: str = "x") -> DataFrame:
    """The segment profile written as SQL text over a DataFrame argument (``{data}``).

    Same statistics and names as :func:`sigspan.operators.profile.segment_profile`; percentiles
    are ``percentile(v, p)`` per statistic, as a SQL user writes them.
    """
    cols = []
    for name, agg, src, arg in PROFILES[kind]:
        v = value if src == "x" else f"abs({value})"
        expr = f"percentile({v}, {arg})" if agg == "pct" else _SQL_AGG[agg].format(v=v)
        cols.append(f"{expr} AS {name}")
    return spark.sql(f"SELECT {keys}, {', '.join(cols)} FROM {{data}} GROUP BY {keys}", data=data)
