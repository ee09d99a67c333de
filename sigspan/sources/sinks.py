"""Sinks: stage tables, CSV signal files and the submission CSV."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.decimal_text import PLACES, exact_text


def write_stage(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    fmt: str = "parquet",
) -> str:
    """Write a stage table.

    ``mode``: ``overwrite``, ``append`` or ``errorifexists`` (fail if present). ``sort_by``
    range-partitions on all of its keys (one hot leading key is split) and sorts inside partitions -- ordered files without a
    single-partition write, so later range filters skip row groups.
    """
    out = df
    if sort_by:
        keys = list(sort_by)
        out = out.repartitionByRange(*keys).sortWithinPartitions(*keys)
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)
    return path


def write_batch(df: DataFrame, path: str, batch: int | str, batch_col: str = "batch", sort_by: Sequence[str] = ()) -> str:
    """Append one batch to a table in a way that can be repeated: a batch written again replaces itself.

    The table is partitioned by ``batch_col``; only the partition of this batch is overwritten (dynamic partition
    overwrite), so a rerun after a failure neither doubles rows nor touches other batches. Read it back with
    :func:`read_batches`. ``batch`` is kept as text in the folder name.
    """
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    tagged = df.withColumn(batch_col, F.lit(str(batch)))
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch_col).parquet(path)
    return path


def read_batches(spark: SparkSession, path: str, schema: T.StructType, batch_col: str = "batch") -> DataFrame:
    """All batches written by :func:`write_batch`; ``schema`` is that of a batch, the batch name is text."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(batch_col, T.StringType())])).parquet(path)


def write_lookup_table(df: DataFrame, path: str, key: str, files: int, keys_per_file: int) -> str:
    """A table from which the rows of a few keys can be read without scanning the rest.

    Rows are dealt by the hash of ``key`` to ``files`` files, sorted inside, with a Parquet bloom filter of the key
    (sized for ``keys_per_file``), so that :func:`sigspan.sources.tables.read_keys` skips whole row groups even
    where keys have no order that minimum and maximum could tell apart. A key's rows stand in one file.
    """
    writer = df.repartition(files, key).sortWithinPartitions(key).write.mode("overwrite")
    writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(keys_per_file))
    writer.option(f"parquet.enable.dictionary#{key}", "false").parquet(path)
    return path


def write_segment_table(df: DataFrame, path: str, buckets: int | None = None, name: str | None = None) -> DataFrame:
    """Write a sequenced set once, bucketed by ``seg`` and sorted by ``(seg, no)``; return the table.

    The files live at ``path`` and the table is registered in the session catalog, so every
    later ``groupBy("seg")`` on it (profiles, segment vectors, labels, windows) runs without a
    shuffle: one exchange at write time instead of one per consumer.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = name or f"sigspan_seg_{uuid.uuid4().hex}"
    (
        df.repartition(n, "seg")  # the one exchange: a task writes one bucket, so n files at most
        .write.mode("overwrite")
        .bucketBy(n, "seg")
        .sortBy("seg", "no")
        .option("path", path)
        .format("parquet")
        .saveAsTable(table)
    )
    return spark.table(table)


def write_signal_csv(
    df: DataFrame,
    path: str,
    cols: Sequence[str] = ("x", "y"),
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
    sort_by: Sequence[str] = (),
    num_files: int | None = None,
) -> str:
    """CSV with a header line, columns in the given order.

    ``sort_by`` writes rows in that order: range partitions (``num_files`` of them, else the
    session's count, which AQE may merge) sorted inside, so part files in name order hold
    consecutive ranges.
    """
    if sort_by:
        keys = list(sort_by)
        ranged = df.repartitionByRange(num_files, *keys) if num_files else df.repartitionByRange(*keys)
        df = ranged.sortWithinPartitions(*keys)
    w = df.select(*cols, *partition_by).write.mode(mode).option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return path


def submission_text(df: DataFrame, value: str = "time_to_failure", decimals: int = 20, exact: bool = True) -> DataFrame:
    """``value`` as fixed-decimal text: the exact binary value with 20 decimals (default) or Java's ``%.Nf``.

    Java pads zeros after the shortest digits that give the double back; the result file of the pipeline carries the
    exact expansion (``0.1`` -> ``0.10000000000000000555``).
    """
    if not exact:
        return df.withColumn(value, F.format_string(f"%.{decimals}f", F.col(value)))
    if decimals != PLACES:
        raise ValueError(f"the exact text has {PLACES} decimals")
    return exact_text(df, value)


def write_submission(df: DataFrame, path: str, order_by: str = "pos", single_file: bool = False) -> str:
    """Result CSV with header ``seg_id,time_to_failure`` (20 decimals), rows in manifest order.

    By default a range sort writes ordered part files (part 0 holds the first positions).
    ``single_file`` adds ``coalesce(1)`` for a small export: one task then sorts and writes all.
    """
    out = submission_text(df).orderBy(order_by).select("seg_id", "time_to_failure")
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).csv(path)
    return path
