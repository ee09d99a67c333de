"""Labels: the target at the end of a segment and at the end of every sliding window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import SegmentSpec


def segment_label(seq: DataFrame, spec: SegmentSpec, keys: Sequence[str] = ("seg",)) -> DataFrame:
    """``(seg, y)`` at ``no = L``; segments that do not reach it have no label."""
    return seq.where(F.col("no") == spec.length).select(*keys, "y")


def window_labels(seq: DataFrame, spec: SegmentSpec, keys: Sequence[str] = ("seg",)) -> DataFrame:
    """``(seg, y0..y{w-1})``: ``y`` at the last position of every window; all positions needed.

    One scan with a conditional aggregate instead of a self join per position. Completeness is
    counted on the positions, so a present position with a NULL ``y`` keeps its segment.
    """
    pos = spec.window_label_positions
    picked = seq.where(F.col("no").isin(pos))
    agg = picked.groupBy(*keys).agg(
        F.count("no").alias("_npos"),  # (keys, no) is unique
        *[F.max(F.when(F.col("no") == p, F.col("y"))).alias(f"y{j}") for j, p in enumerate(pos)],
    )
    return agg.where(F.col("_npos") == len(pos)).drop("_npos")


def window_labels_join(seq: DataFrame, spec: SegmentSpec) -> DataFrame:
    """Self-join form of :func:`window_labels` (one scan per position), kept for comparison."""
    pos = spec.window_label_positions
    out = seq.where(F.col("no") == pos[0]).select("seg", F.col("y").alias("y0"))
    for j, p in enumerate(pos[1:], start=1):
        out = out.join(seq.where(F.col("no") == p).select("seg", F.col("y").alias(f"y{j}")), "seg")
    return out
