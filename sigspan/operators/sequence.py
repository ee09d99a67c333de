"""Sequencing: dense row numbers without a one-partition window, segments, names, id continuation.

The global order of a long signal is a dense ``1..N`` row number. A window without
``partitionBy`` would move every row into one task, so the index is built the way a
distributed sort works:

* ``row_index`` (sort order): range-partition on the order key (hot keys are split by the
  sampled bounds), sort inside each partition, tag rows with ``monotonically_increasing_id``
  (partition id in the high bits, position in the low bits), count rows per partition,
  prefix-sum the counts (one row per partition) and add the offset back. The tagged frame is
  written once as a Parquet stage table, so both passes see the same partitions even after an
  executor loss, and each reads only the columns it needs.
* ``row_index(stored=False)``: the same without a stored copy, for inputs that are cheap to read
  twice. The ranges are fitted once and fixed as literals (:mod:`.ranges`); one pass counts the rows of
  each range, the other numbers the rows inside each range, and the offsets join the two.
* ``group_offsets``: rows that are numbered inside their groups already need only the groups' sizes;
  the prefix sum runs over blocks of groups first, so no task holds all of them.
* ``file_order_index`` (physical file order, e.g. a CSV written in time order): no shuffle at
  all; rows are counted per input split ``(file, block start)`` and offset by the splits before.

Row numbers inside groups (``partition_by``) reuse the same tags: the group start is the smallest
global index of the group, attached through the ``(partition, group)`` pairs, so a hot group
spread over many range partitions never lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions, sized_broadcast, stage_table
from ..spec import SegmentSpec
from .ranges import fit_ranges

RANGES_PER_PARTITION = 4
_POS_BITS = 33
_POS_MASK = (1 << _POS_BITS) - 1
_OFFSETS_ROW_BYTES = 32  # a partition number and an offset
_SPLIT_ROW_BYTES = 64  # five numbers of an input split


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _tag_sorted(
    df: DataFrame, keys: list[Column], num_partitions: int | None, stored: bool, keep: list[str] | None
) -> tuple[DataFrame, int]:
    spark = df.sparkSession
    n = num_partitions or shuffle_partitions(spark)
    cols = [F.col(f"`{c}`") for c in (keep if keep is not None else df.columns)]
    tagged = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .select(*cols, F.monotonically_increasing_id().alias("_mid"))
    )
    if stored:
        tagged = stage_table(tagged, "row-index")
    tagged = tagged.select(
        "*",
        F.shiftright(F.col("_mid"), _POS_BITS).alias("_pid"),
        F.col("_mid").bitwiseAND(F.lit(_POS_MASK)).alias("_pos"),
    ).drop("_mid")
    return tagged, n


def _offsets(counts: DataFrame, order: list[str], count_col: str = "_n", partition: list[str] | None = None) -> DataFrame:
    """Exclusive prefix sum of ``count_col`` in ``order`` (small input: one row per partition or split)."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if partition:
        w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_off", F.coalesce(F.sum(count_col).over(w), F.lit(0)).cast("long"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL; keeps the left side's key columns."""
    renamed = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`"))
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def row_index(
    df: DataFrame,
    order_by: Sequence[str | Column],
    partition_by: Sequence[str] = (),
    name: str = "idx",
    num_partitions: int | None = None,
    stored: bool = True,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Dense ``row_number()`` over ``order_by`` (1-based), optionally restarted per ``partition_by``.

    Equals ``row_number() OVER ([PARTITION BY p] ORDER BY o)``; the order key should be unique
    (add a tie-breaker) so that the numbering is deterministic. ``keep`` lists the columns to
    carry (default all): order keys not needed later need not be stored. The sort uses ``num_partitions``
    range partitions, by default the session's ``spark.sql.shuffle.partitions`` (a fixed count:
    letting AQE merge ranges would put a small input into a single task).

    ``stored=False`` writes nothing: ranges on fixed bounds replace the sampled range shuffle, and the input
    is read three times (bounds: its first two order keys, sampled; counts: the order keys; numbering). It
    needs plain order columns whose first two are numbers, dates or timestamps, and no ``partition_by``.
    """
    part = list(partition_by)
    if not stored:
        if part or not all(isinstance(c, str) for c in order_by):
            raise ValueError("stored=False numbers a whole table by plain columns")
        return _row_index_ranges(df, list(order_by), name, num_partitions, keep)
    keys = _cols([*part, *order_by])
    out_cols = list(keep) if keep is not None else [c for c in df.columns if c != name]
    carried = out_cols + [c for c in part if c not in out_cols]
    tagged, n = _tag_sorted(df, keys, num_partitions, stored, carried)

    if not part:
        counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
        offsets = _offsets(counts, ["_pid"]).select("_pid", "_off")
        out = tagged.join(sized_broadcast(offsets, n, _OFFSETS_ROW_BYTES), "_pid")
        return out.select(*[F.col(f"`{c}`") for c in out_cols], (F.col("_off") + F.col("_pos") + 1).alias(name))

    # one row per (range partition, group): at most #groups + #partitions rows
    per_part = tagged.groupBy("_pid", *part).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    counts = per_part.groupBy("_pid").agg(F.sum("_n").alias("_n"))
    offsets = _offsets(counts, ["_pid"]).select("_pid", "_off")
    starts = per_part.join(sized_broadcast(offsets, n, _OFFSETS_ROW_BYTES), "_pid").withColumn("_g0", F.col("_off") + F.col("_first") + 1)
    group_first = starts.groupBy(*part).agg(F.min("_g0").alias("_gstart"))
    # null-safe: rows whose group key is NULL form a group, as in row_number() OVER (PARTITION BY ...)
    pair_start = null_safe_join(starts.select("_pid", *part, "_off"), group_first, part)
    out = null_safe_join(tagged, pair_start, ["_pid", *part])
    return out.select(*[F.col(f"`{c}`") for c in out_cols], (F.col("_off") + F.col("_pos") + 2 - F.col("_gstart")).alias(name))


def _row_index_ranges(
    df: DataFrame, order_by: list[str], name: str, num_partitions: int | None, keep: Sequence[str] | None
) -> DataFrame:
    """Dense row number over ``order_by`` on fixed ranges: rows are moved once and written nowhere.

    A range is one window group, spread over several ranges for each partition so that hashing the
    ranges to partitions stays even; counts are one row for each range, broadcast behind their bound.
    """
    n = num_partitions or shuffle_partitions(df.sparkSession)
    out_cols = list(keep) if keep is not None else [c for c in df.columns if c != name]
    ranges = fit_ranges(df, order_by, RANGES_PER_PARTITION * n)
    if ranges is None:
        raise ValueError(f"stored=False needs numbers, dates or timestamps first in {order_by}")
    counts = ranges.assign(df.select(*[F.col(f"`{c}`") for c in order_by]), "_range").groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(counts, ["_range"]).select("_range", "_off")
    carried = list(dict.fromkeys([*out_cols, *order_by]))
    placed = ranges.assign(df.select(*[F.col(f"`{c}`") for c in carried]), "_range")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*_cols(order_by)))
    out = placed.withColumn("_pos", inside).join(sized_broadcast(offsets, ranges.count, _OFFSETS_ROW_BYTES), "_range")
    return out.select(*[F.col(f"`{c}`") for c in out_cols], (F.col("_off") + F.col("_pos")).alias(name))


def group_offsets(rows: DataFrame, key: str, position: str, name: str = "off", block: int = 4096) -> DataFrame:
    """``(key, off)``: how many rows the groups with a smaller ``key`` (a number from 0 on) hold.

    ``position`` numbers the rows of a group 1, 2, ... already, so its maximum is the size; the rows
    themselves are neither sorted nor moved. A window holds ``block`` groups, or one row a block.
    """
    sizes = rows.groupBy(key).agg(F.max(position).cast("long").alias("_n")).withColumn("_b", F.floor(F.col(key) / block))
    blocks = _offsets(sizes.groupBy("_b").agg(F.sum("_n").alias("_bn")), ["_b"], "_bn").select("_b", F.col("_off").alias("_boff"))
    inside = _offsets(sizes, [key], "_n", ["_b"])
    return inside.join(blocks, "_b").select(key, (F.col("_boff") + F.col("_off")).alias(name))


def natural_order(path: str | Column) -> list[Column]:
    """Sort keys of a path with digit runs compared as numbers: part-99999 before part-100000.

    Every digit run is padded to 20 digits; the path itself breaks ties.
    """
    path = F.col(path) if isinstance(path, str) else path
    padded = F.regexp_replace(path, r"(\d+)", "00000000000000000000$1")
    return [F.regexp_replace(padded, r"\d*?(\d{20})(?!\d)", "$1"), path]


def _splits_bound(df: DataFrame) -> int | None:
    """Upper bound on the input splits of a file scan: a file is cut at the split size, and a partition
    holds at most that size. None for a frame that lists no files (a streaming micro-batch)."""
    files = len(df.inputFiles())
    return files + 2 * df.rdd.getNumPartitions() if files else None


def file_order_index(
    df: DataFrame, name: str = "idx", per_file: bool = False, keep_file: bool = False, per: Column | None = None, file_id: str | None = None
) -> DataFrame:
    """Dense row number in physical file order, without a shuffle of the data.

    ``df`` must be a direct file scan (it reads the hidden ``_metadata`` column), or carry
    ``_file`` / ``_block`` columns taken from it (e.g. a streaming micro-batch). Rows are
    ordered by file path (numbers in it as numbers), then by split start inside the file, then by
    read position. With ``per`` (an expression constant within a file) the numbering restarts for
    each of its values and runs on over the files that share it; ``per_file`` restarts in every file.
    ``file_id`` names a column for the number of the row's file, 0, 1, ... in the order of the paths.

    The offsets are a few numbers for each input split, broadcast behind a bound of their size: the files and
    partitions of the scan, or, where those are not known, the splits counted in a stage table.
    """
    have = set(df.columns)
    file_cols = [] if {"_file", "_block"} <= have else [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ]
    tagged = df.select("*", *file_cols, F.monotonically_increasing_id().alias("_mid"))
    tagged = tagged.withColumn("_part", F.shiftright("_mid", _POS_BITS))
    group = F.col("_file") if per_file else per if per is not None else F.lit(0)
    splits = tagged.groupBy("_part", "_file", "_block").agg(
        F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_n"), F.first(group).alias("_group"))
    w = Window.partitionBy("_group").orderBy(*natural_order("_file"), "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("long"))
    numbers = []
    if file_id is not None:
        offsets = offsets.withColumn(file_id, F.dense_rank().over(Window.orderBy(*natural_order("_file"))).cast("long") - 1)
        numbers = [file_id]
    offsets = offsets.select(F.col("_part").alias("_opart"), "_m0", (F.col("_m0") + F.col("_n")).alias("_m1"), "_off", *numbers)
    bound = None if {"_file", "_block"} <= have else _splits_bound(df)
    if bound is None:
        offsets = stage_table(offsets, "splits")
        bound = offsets.count()
    inside = (F.col("_part") == F.col("_opart")) & (F.col("_mid") >= F.col("_m0")) & (F.col("_mid") < F.col("_m1"))
    out = tagged.join(sized_broadcast(offsets, bound, _SPLIT_ROW_BYTES), inside)
    out = out.withColumn(name, F.col("_off") + (F.col("_mid") - F.col("_m0")) + 1)
    drop = ["_block", "_mid", "_m0", "_m1", "_off", "_part", "_opart"] + ([] if keep_file else ["_file"])
    return out.drop(*drop)


def assign_segments(df: DataFrame, spec: SegmentSpec, idx: str = "idx") -> DataFrame:
    """Fixed-length segments of a dense 1-based index: ``seg = (idx-1) div L``, ``no = (idx-1) % L + 1``."""
    L = spec.length
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("seg", "no")]
    return df.select(
        *keep,
        F.expr(f"(`{idx}` - 1) div {L}").cast("long").alias("seg"),
        ((F.col(idx) - 1) % F.lit(L) + 1).cast("int").alias("no"),
    )


def sequence_signal(sig: DataFrame, spec: SegmentSpec, order_by: Sequence[str] = ("ts", "uid"), stored: bool = True) -> DataFrame:
    """Signal ``(uid, ts, x, y)`` -> ``(uid, idx, seg, no, x, y)`` in time order.

    ``stored`` for a sequence that several steps read; without it nothing is written and each of them orders anew.
    """
    indexed = row_index(sig, list(order_by), keep=["uid", "x", "y"], stored=stored)
    return assign_segments(indexed, spec).select("uid", "idx", "seg", "no", "x", "y")


def segment_name(seg: str | Column = "seg", prefix: str = "raw_") -> Column:
    """``raw_0007``; numbers above 9999 keep all digits (unlike a left pad to 4)."""
    seg = F.col(seg) if isinstance(seg, str) else seg
    return F.format_string(f"{prefix}%04d", seg.cast("long"))


def decoded_path(path: str | Column) -> Column:
    """Plain text of a path that Spark gives percent-encoded (``%20`` for a space; ``+`` stays)."""
    path = F.col(path) if isinstance(path, str) else path
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def file_stem(path: str | Column) -> Column:
    """File name without directory and extension: ``/a/b/seg%2000ab.csv`` -> ``seg 00ab``."""
    return F.substring_index(F.substring_index(decoded_path(path), "/", -1), ".", 1)


def complete_segments(seq: DataFrame, spec: SegmentSpec, keys: Sequence[str] = ("seg",)) -> DataFrame:
    """``(seg, n)`` of segments that reach the last position ``no = L``."""
    return (
        seq.groupBy(*keys)
        .agg(F.max("no").alias("_last"), F.count(F.lit(1)).alias("n"))
        .where(F.col("_last") == spec.length)
        .select(*keys, "n")
    )


def keep_complete(seq: DataFrame, spec: SegmentSpec) -> DataFrame:
    """Rows of complete segments of a continuous sequence (only the tail can be partial).

    Needs one scalar (the last index), evaluated once as a scalar subquery.
    """
    last = seq.agg(F.max("idx")).scalar()
    L = spec.length
    return seq.where(F.col("idx") <= last - last % L)


def max_scalar(df: DataFrame, col: str, alias: str = "m") -> DataFrame:
    """One-row global maximum (partial max per task, one final row)."""
    return df.agg(F.max(col).alias(alias))


def split_train_test(seq: DataFrame, spec: SegmentSpec, train_fraction: float = 0.8, keep_tail: bool = False) -> DataFrame:
    """Tag segments: the first ``train_fraction`` of the complete ones as set 0, the rest as set 1.

    Adds ``set`` and ``set_seg`` (segment number restarting at 0 inside each set). The partial
    tail segment is dropped, or with ``keep_tail`` becomes the last segment of the train set.
    Needs one scalar (the last index), a scalar subquery.
    """
    L = spec.length
    last = seq.agg(F.max("idx")).scalar()
    full = ((last - last % L) / L).cast("long")  # exact: a multiple of L divided by L
    n_train = F.floor(full * F.lit(train_fraction).cast("decimal(10,6)")).cast("long")
    tagged = seq.withColumn("_n_train", n_train).withColumn("_full", full)
    if not keep_tail:
        tagged = tagged.where(F.col("seg") < F.col("_full"))
    test = (F.col("seg") >= F.col("_n_train")) & (F.col("seg") < F.col("_full"))
    return (
        tagged.withColumn("set", F.when(test, F.lit(1)).otherwise(F.lit(0)))
        .withColumn("set_seg", F.when(test, F.col("seg") - F.col("_n_train")).otherwise(F.least("seg", "_n_train")))
        .drop("_full")
    )


def union_train_test(seq: DataFrame, spec: SegmentSpec, train_fraction: float = 0.8) -> DataFrame:
    """Train and test sets as one relation keyed by ``(set, seg)``; every row of ``seq`` is in it.

    Test rows get a NULL label and ids that continue after the largest train id:
    ``uid = max(train uid) + position inside the test set``.
    """
    tagged = split_train_test(seq, spec, train_fraction, keep_tail=True)
    train = tagged.where(F.col("set") == 0)
    test = tagged.where(F.col("set") == 1)
    max_train_uid = train.agg(F.max("uid")).scalar()
    test = test.withColumn("uid", max_train_uid + F.col("idx") - F.col("_n_train") * spec.length).withColumn(
        "y", F.lit(None).cast("double")
    )
    cols = ["uid", "set", "set_seg", "no", "x", "y"]
    return (
        train.select(*cols)
        .unionByName(test.select(*cols))
        .withColumnRenamed("set_seg", "seg")
    )
