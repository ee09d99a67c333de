"""Array expressions used on spectra and feature vectors (all JVM-side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import BinSpec


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind(col: str | Column, fn) -> Column:
    """Evaluate ``col`` once and hand it to ``fn`` as a lambda variable.

    A column used inside a higher-order function lambda is otherwise inlined by the optimizer
    and re-evaluated for every lambda call (e.g. a whole DCT per bin).
    """
    return F.transform(F.array(_c(col)), fn)[0]


def field(name: str):
    """Lambda ``e -> e.name`` for ``transform`` over an array of structs.

    A one-argument closure: a two-argument lambda would be taken as ``(element, index)``.
    """
    return lambda e: e[name]


def checked_prefix(col: str | Column, n: int, what: str = "array") -> Column:
    """The first ``n`` elements; fails (like a vector slicer) when fewer are present."""
    msg = F.lit(f"{what} shorter than {n} elements")
    return bind(col, lambda c: F.when(F.size(c) >= n, F.slice(c, 1, n)).otherwise(F.raise_error(msg)))


def band(col: str | Column, start: int, size: int) -> Column:
    """Contiguous band ``col[start : start+size]`` (0-based start); fails when out of range."""
    msg = F.lit(f"band {start}..{start + size - 1} past the end of the array")
    return bind(col, lambda c: F.when(F.size(c) >= start + size, F.slice(c, start + 1, size)).otherwise(F.raise_error(msg)))


def stride(col: str | Column, step: int, size: int | None = None) -> Column:
    """Every ``step``-th element from 0 (over the first ``size`` elements, default all)."""
    c = _c(col)
    last = (F.lit(size) if size is not None else F.size(c)) - 1
    return bind(c, lambda v: F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: v[i]))


def overlapped_bins(col: str | Column, bins: BinSpec) -> Column:
    """Bin ``i`` = ``sum(|v[i*hop : i*hop+width]|) / divisor`` for ``i`` in ``0 .. n_bins-1``."""
    h, w, d = bins.hop, bins.width, float(bins.divisor)

    def per_array(v):
        return F.transform(
            F.sequence(F.lit(0), F.lit(bins.n_bins - 1)),
            lambda i: F.aggregate(F.slice(v, i * h + 1, w), F.lit(0.0), lambda acc, e: acc + F.abs(e)) / F.lit(d),
        )

    msg = F.lit(f"spectrum shorter than the {bins.span} coefficients the bins cover")
    return bind(col, lambda v: F.when(F.size(v) >= bins.span, per_array(v)).otherwise(F.raise_error(msg)))
