"""Incremental ingest of segment files with Structured Streaming.

New segment CSV files arriving in a directory are picked up in micro-batches bounded by bytes. A
file is never split across micro-batches, so every batch numbers the rows inside its files
(no shuffle of the samples) and writes its own ``batch=<epoch>`` folders: the rows by file number, and the files with their
names and row counts (the dictionary, beside the table in ``<table>-files``). The manifest is met when the table is read: a file that arrives before its
manifest line is not lost, and part files of a segment may come in different micro-batches. The
stream checkpoint makes the ingest restartable: a rerun after a failure continues with the files
not yet committed, and a replayed batch overwrites its folders, so no rows are written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sequence import file_order_index, natural_order
from ..session import sized_broadcast
from ..sources.files import segment_file_name, with_manifest, with_missing

_SCHEMA = T.StructType([T.StructField("x", T.DoubleType(), True)])
BATCH_BYTES = 64 << 30
_FILE_ROW_BYTES = 160  # name, position and three numbers of a file


def segment_batch(batch: DataFrame, name_col: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows ``(file_id, fno, x)`` and files ``(file_id, file, name, n)`` of one micro-batch.

    ``fno`` counts inside the file; ``file_id`` numbers the files of the batch in the order of their
    paths, for both alike. The files are listed with their row counts, so no reader counts rows again.
    """
    numbered = file_order_index(batch, name="fno", per_file=True, file_id="file_id")
    files = batch.groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    files = files.withColumn("file_id", F.dense_rank().over(Window.orderBy(*natural_order("file"))).cast("long") - 1)
    return numbered.select("file_id", "fno", "x"), files.select("file_id", "file", segment_file_name(F.col("file"), name_col).alias("name"), "n")


def start_segment_stream(
    spark: SparkSession,
    src_dir: str,
    out_path: str,
    checkpoint: str,
    batch_bytes: int = BATCH_BYTES,
    name_col: str | None = "name",
    available_now: bool = True,
):
    """Start the ingest query; returns the ``StreamingQuery``."""
    schema = _SCHEMA
    if name_col:
        schema = T.StructType(_SCHEMA.fields + [T.StructField(name_col, T.StringType(), True)])
    stream = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("maxBytesPerTrigger", str(batch_bytes))
        .option("mode", "FAILFAST")
        .csv(src_dir)
        .select(
            "x",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
    )

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        # one folder per micro-batch, overwritten on replay: a batch re-run after a failure
        # replaces its own output instead of appending it twice
        rows, files = segment_batch(batch, name_col)
        base = out_path.rstrip("/")
        files.write.mode("overwrite").parquet(f"{base}-files/batch={epoch_id}")
        rows.write.mode("overwrite").parquet(f"{base}/batch={epoch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def ingest_segment_files(
    spark: SparkSession,
    src_dir: str,
    manifest: DataFrame,
    out_path: str,
    batch_bytes: int = BATCH_BYTES,
    name_col: str | None = "name",
) -> DataFrame:
    """Run the ingest over the files present now, then read the stage table."""
    query = start_segment_stream(spark, src_dir, out_path, out_path.rstrip("/") + "-checkpoint", batch_bytes, name_col)
    query.awaitTermination()
    return read_ingested(spark, out_path, manifest)


def read_ingested(spark: SparkSession, out_path: str, manifest: DataFrame, check_missing: bool = True) -> DataFrame:
    """``(seg, name, no, x)`` of all micro-batches, with the manifest as it is now.

    ``no`` runs on over the part files of a segment in the natural order of their names. A
    manifest entry without rows fails the read unless ``check_missing`` is off.

    The dictionary of files (number, name, rows before) is joined to the rows by (batch, file number): broadcast, so
    that no sample moves, while its size is below the broadcast limit, else shuffled by two numbers. The
    rows themselves are read once, and only to be numbered.
    """
    base = out_path.rstrip("/")
    files = spark.read.parquet(f"{base}-files")
    known = files.count()
    w = Window.partitionBy("name").orderBy(*natural_order("file")).rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select(F.col("batch").alias("_batch"), F.col("file_id").alias("_file_id"), "name", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_off"))
    placed = with_manifest(placed, manifest, None)
    small = sized_broadcast(placed, known, _FILE_ROW_BYTES)
    rows = spark.read.parquet(base)
    numbered = rows.join(small, (F.col("batch") == F.col("_batch")) & (F.col("file_id") == F.col("_file_id")))
    out = numbered.select("seg", "name", (F.col("_off") + F.col("fno")).cast("int").alias("no"), "x")
    return with_missing(out, manifest, files.select("name").distinct()) if check_missing else out
