"""Slices of a segment, segment vectors and sliding windows.

Slice ``i`` of a segment covers positions ``no BETWEEN i*s AND (i+1)*s`` (``inclusive``, the
reference bounds: a sample at an inner boundary belongs to two slices) or ``i*s < no <= (i+1)*s``
(``strict``). Counts and sums per slice explode each sample to its one or two slices and
aggregate once. Vectors collect a whole segment once -- one shuffle keyed by ``seg``, whose
size is bounded by the segment length -- and cut the slices out of the ordered samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind
from ..spec import SegmentSpec


def slice_ids(spec: SegmentSpec, no: str = "no") -> Column:
    """Array of the slice numbers a position belongs to (one, or two at an inner boundary)."""
    s, n = spec.slice_len, spec.n_slices
    p = F.col(no)
    own = F.expr(f"(`{no}` - 1) div {s}")
    if spec.boundary == "strict":
        return F.array(own)
    nxt = F.expr(f"`{no}` div {s}")
    return F.when((p % s == 0) & (nxt < n) & (nxt > own), F.array(own, nxt)).otherwise(F.array(own))


def slice_membership(seq: DataFrame, spec: SegmentSpec) -> DataFrame:
    """One row per (sample, slice it belongs to): adds ``slice``."""
    return seq.withColumn("slice", F.explode(slice_ids(spec))).where(
        (F.col("slice") >= 0) & (F.col("slice") < spec.n_slices)
    )


def slice_rows(seq: DataFrame, spec: SegmentSpec, keys: Sequence[str] = ("seg",)) -> DataFrame:
    """``(seg, slice, n, x_sum)``: sample count and sum per slice.

    ``keys`` identify a segment here and below: ``("set", "seg")`` on a union of sets.
    """
    return (
        slice_membership(seq, spec)
        .groupBy(*keys, "slice")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x_sum"))
    )


def slice_counts(seq: DataFrame, spec: SegmentSpec, complete_only: bool = True, keys: Sequence[str] = ("seg",)) -> DataFrame:
    """``(seg, n0..n{k-1})``: samples per slice, one scan with conditional aggregates.

    With ``complete_only`` a segment is kept only if every slice has samples (the result of
    joining the per-slice aggregates on ``seg``).
    """
    m = slice_membership(seq, spec)
    names = [f"n{i}" for i in range(spec.n_slices)]
    agg = m.groupBy(*keys).agg(
        *[F.count(F.when(F.col("slice") == i, F.lit(1))).alias(c) for i, c in enumerate(names)]
    )
    if complete_only:
        cond = F.lit(True)
        for c in names:
            cond = cond & (F.col(c) > 0)
        agg = agg.where(cond)
    return agg


def join_slices(seq: DataFrame, spec: SegmentSpec) -> DataFrame:
    """Join form of :func:`slice_counts`: one aggregate per slice, inner-joined on ``seg``.

    Kept to check the one-scan form; it scans the input once per slice.
    """
    out = None
    s = spec.slice_len
    for i in range(spec.n_slices):
        if spec.boundary == "inclusive":
            cond = F.col("no").between(i * s, (i + 1) * s)
        else:
            cond = (F.col("no") > i * s) & (F.col("no") <= (i + 1) * s)
        part = seq.where(cond).groupBy("seg").agg(F.count(F.lit(1)).alias(f"n{i}"))
        out = part if out is None else out.join(part, "seg")
    return out


def segment_samples(seq: DataFrame, value: str = "x", max_len: int | None = None, keys: Sequence[str] = ("seg",)) -> DataFrame:
    """``(seg, _s array<struct<no, v>>)`` ordered by position; one row per segment.

    Positions beyond ``max_len`` are left out, so a segment file far longer than the segment
    length does not grow its group (they lie in no slice).
    """
    if max_len is not None:
        seq = seq.where(F.col("no") <= max_len)
    no = F.col("no")
    return seq.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(no.alias("no"), F.col(value).alias("v")))).alias("_s"))


def segment_slices(
    seq: DataFrame, spec: SegmentSpec, value: str = "x", complete_only: bool = True, keys: Sequence[str] = ("seg",)
) -> DataFrame:
    """``(seg, slices array<array<double>>)``: the ordered samples of every slice.

    With ``complete_only`` segments lacking any slice are dropped.
    """
    s, n = spec.slice_len, spec.n_slices
    first = 0 if spec.boundary == "inclusive" else 1  # first position of slice i is i*s + first
    samples = segment_samples(seq, value, max_len=s * n, keys=keys)
    values = F.transform("_s", lambda e: e["v"])
    size = F.size("_s")
    # positions 1..m without gaps (a sequenced signal, a whole file): slice i is one positional cut
    contiguous = (F.col("_s")[0]["no"] == 1) & (F.element_at("_s", -1)["no"] == size)

    def pick(i):
        lo = i * s + first
        return F.transform(F.filter("_s", lambda e: (e["no"] >= lo) & (e["no"] <= (i + 1) * s)), lambda e: e["v"])

    idx = F.sequence(F.lit(0), F.lit(n - 1))
    slices = F.when(contiguous, bind(values, lambda vals: F.transform(idx, lambda i: _cut(vals, i, s, first, size)))).otherwise(
        F.transform(idx, pick)
    )
    out = samples.select(*keys, slices.alias("slices"))
    if complete_only:
        out = out.where(F.forall("slices", lambda a: F.size(a) > 0))
    return out


def _cut(values: Column, i: Column, s: int, first: int, size: Column) -> Column:
    start = F.greatest(i * s + first, F.lit(1))
    end = F.least((i + 1) * s, size)
    return F.slice(values, start, F.greatest(end - start + 1, F.lit(0)))


def slice_vectors(seg_slices: DataFrame, keys: Sequence[str] = ("seg",)) -> DataFrame:
    """Long form of slice vectors: ``(seg, slice, vx)``."""
    return seg_slices.select(*keys, F.posexplode("slices").alias("slice", "vx"))


def concat_slices(seg_slices: DataFrame, out: str = "vx", keys: Sequence[str] = ("seg",)) -> DataFrame:
    """Segment vector: the slices concatenated in order (``L + slices - 1`` values if inclusive)."""
    return seg_slices.select(*keys, F.flatten("slices").alias(out))


def sliding_windows(seg_slices: DataFrame, spec: SegmentSpec, out: str = "vx", keys: Sequence[str] = ("seg",)) -> DataFrame:
    """``(seg, win, vx)``: window ``j`` = slices ``j .. j+win_slices-1`` concatenated."""
    k, nw = spec.win_slices, spec.n_windows
    wins = F.transform(F.sequence(F.lit(0), F.lit(nw - 1)), lambda j: F.flatten(F.slice("slices", j + 1, k)))
    return seg_slices.select(*keys, F.posexplode(wins).alias("win", out))


def to_long(df: DataFrame, keys: list[str], col: str, k: str = "k", v: str = "v") -> DataFrame:
    """Array column to long form ``(keys..., k, v)`` with 0-based ``k``."""
    return df.select(*keys, F.posexplode(col).alias(k, v))
