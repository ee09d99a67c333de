"""Standard scaling without centring (``withStd=True, withMean=False``) on array columns.

``fit_scaler`` is a lazy aggregate: the per-dimension sample standard deviation of array
columns, optionally per group (e.g. one scaler per window position). The arrays are unpivoted
to ``(group, dim, value)`` and reduced with ``stddev_samp`` grouped by dimension: partial
aggregation per task, and the final merge is spread over the dimensions. (A vector summary --
``Summarizer``, or ``StandardScaler.fit`` -- ends in one task that merges one K-dimensional
buffer per map task, which grows with the task count.) The per-dimension results are gathered
back into one array per group, bounded by the dimension. Several columns are fitted in the
same scan.
``apply_scaler`` attaches the result -- a scalar subquery without groups, else a join on the
group keys, broadcast when the group count is bounded -- and scales element-wise; a dimension
with std 0 (constant, or a single row) maps to 0.0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, field
from ..session import sized_broadcast


def _as_list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _std_name(col: str, cols: list[str], std_col: str) -> str:
    return std_col if len(cols) == 1 else f"{std_col}_{col}"


def _number(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def fit_scaler(df: DataFrame, cols: str | Sequence[str], by: Sequence[str] = (), std_col: str = "std") -> DataFrame:
    """Per-dimension sample std of each array column, one row per ``by`` group.

    One column: the result column is ``std_col``; several: ``{std_col}_{col}``. NaN values (a statistic
    of a degenerate segment) do not count, so they spoil no other segment.
    """
    by, cols = list(by), _as_list(cols)
    names = [_std_name(c, cols, std_col) for c in cols]
    # one row per (group, dimension) carrying the value of every column at that dimension
    zipped = F.arrays_zip(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    long = df.select(*by, F.posexplode(zipped).alias("_k", "_z"))
    per_dim = long.groupBy(*by, "_k").agg(
        *[F.coalesce(F.stddev_samp(_number(F.col(f"_z._c{i}"))), F.lit(0.0)).alias(f"_s{i}") for i in range(len(cols))]
    )
    packed = F.array_sort(F.collect_list(F.struct("_k", *[f"_s{i}" for i in range(len(cols))])))
    gathered = per_dim.groupBy(*by).agg(packed.alias("_p")) if by else per_dim.agg(packed.alias("_p"))
    return gathered.select(*by, *[F.transform("_p", field(f"_s{i}")).alias(n) for i, n in enumerate(names)])



def _scale(values: Column, std: Column) -> Column:
    # std is bound once (it may be a scalar subquery) and then indexed per element
    return bind(
        std,
        lambda s: F.transform(values, lambda v, i: F.when(s[i] != 0.0, v * (F.lit(1.0) / s[i])).otherwise(F.lit(0.0))),
    )


def apply_scaler(
    df: DataFrame,
    cols: str | Sequence[str],
    stds: DataFrame,
    out: str | Sequence[str] | None = None,
    by: Sequence[str] = (),
    groups_bound: int | None = 1,
    std_col: str = "std",
    row_bytes: int = 1 << 18,
) -> DataFrame:
    """``out[i] = col[i] * (1 / std[i])``, or 0.0 where ``std[i] == 0``.

    ``groups_bound`` is a known upper bound on the rows of ``stds`` (1 without ``by``) and
    ``row_bytes`` one on their width (default: vectors of up to 32 768 doubles); the std table is
    broadcast only if the product is below the broadcast limit.
    """
    by, cols = list(by), _as_list(cols)
    outs = _as_list(out) if out is not None else cols
    names = [_std_name(c, cols, std_col) for c in cols]
    if by:
        small = sized_broadcast(stds.select(*by, F.struct(*names).alias("_std")), groups_bound, row_bytes)
        src, std = df.join(small, by), F.col("_std")
    else:
        # one row: a scalar subquery, evaluated once for the whole query (its own column: a
        # subquery may not appear inside a higher-order function)
        src, std = df.withColumn("_std", stds.select(F.struct(*names)).scalar()), F.col("_std")
    scaled = {o: _scale(F.col(c), std[n]).alias(o) for c, o, n in zip(cols, outs, names)}
    keep = [F.col(f"`{c}`") for c in src.columns if c not in scaled and c != "_std"]
    return src.select(*keep, *scaled.values())


def standard_scale(
    df: DataFrame,
    cols: str | Sequence[str],
    out: str | Sequence[str] | None = None,
    fit_on: DataFrame | None = None,
    by: Sequence[str] = (),
    groups_bound: int | None = 1,
) -> DataFrame:
    """Fit on ``fit_on`` (default: ``df`` itself) and scale ``df``; all columns in one fit pass."""
    stds = fit_scaler(fit_on if fit_on is not None else df, cols, by)
    return apply_scaler(df, cols, stds, out, by, groups_bound)
