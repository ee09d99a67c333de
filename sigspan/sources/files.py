"""File sources: signal CSV, one-file-per-segment directories, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sequence import decoded_path, file_order_index, file_stem

SIGNAL_SCHEMA = T.StructType([T.StructField("x", T.DoubleType(), True), T.StructField("y", T.DoubleType(), True)])
SEGMENT_FILE_SCHEMA = T.StructType([T.StructField("x", T.DoubleType(), True)])
MANIFEST_SCHEMA = T.StructType([T.StructField("seg_id", T.StringType(), True)])


def read_signal_csv(spark: SparkSession, path: str, schema: T.StructType = SIGNAL_SCHEMA, mode: str = "FAILFAST") -> DataFrame:
    """CSV with a header line and a declared schema; malformed rows fail the read by default."""
    return spark.read.csv(path, header=True, schema=schema, mode=mode)


def read_signal_csv_indexed(spark: SparkSession, path: str, schema: T.StructType = SIGNAL_SCHEMA) -> DataFrame:
    """Signal CSV with ``uid``: a dense 1-based row number in file order (no shuffle)."""
    return file_order_index(read_signal_csv(spark, path, schema), name="uid")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest CSV ``seg_id`` (other columns ignored) -> ``(seg_id, pos)``, ``pos`` = 0-based line order."""
    raw = spark.read.csv(path, header=True, schema=MANIFEST_SCHEMA, mode="PERMISSIVE")
    indexed = file_order_index(raw, name="_line")
    return indexed.select("seg_id", (F.col("_line") - 1).alias("pos"))


def segment_file_name(path: Column, name_col: str | None) -> Column:
    """Segment name of a file: its stem, or the plain value of the ``name_col=...`` folder."""
    if name_col is None:
        return file_stem(path)
    # twice decoded: the folder escapes the value, the path the folder
    return decoded_path(decoded_path(F.regexp_extract(path, f"/{name_col}=([^/]*)/[^/]*$", 1)))


def segment_names_present(spark: SparkSession, path: str, name_col: str | None = None) -> DataFrame:
    """``(name)`` of every segment with a file below ``path``; lists the files, reads none."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return listed.select(segment_file_name(F.col("path"), name_col).alias("name")).distinct()


def with_missing(rows: DataFrame, manifest: DataFrame, present: DataFrame) -> DataFrame:
    """``rows``, failing the job if a manifest entry is not among the names in ``present``.

    The check adds no row: one that is missing raises as soon as its ``seg`` is read.
    """
    man = manifest.select(F.col("seg_id").alias("name"))
    # the error depends on a column of the join, so that no filter on seg moves it below the join
    found = man.join(present.select("name", F.lit(True).alias("_found")), "name", "left").where(F.col("_found").isNull())
    error = F.raise_error(F.concat(F.lit("no file for segment "), "name")).cast("long")
    missing = found.select(F.when(F.col("_found").isNull(), error).alias("seg"))
    cols = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "seg" else F.col("seg") for f in rows.schema.fields]
    return rows.unionByName(missing.select(*cols))


def with_manifest(files: DataFrame, manifest: DataFrame, present: DataFrame | None) -> DataFrame:
    """``files`` with ``seg``, the manifest position of their ``name``.

    Files that the manifest does not list are dropped. A listed segment without a file fails the
    job (``present``: the names that have one; None skips the check).
    """
    man = manifest.select(F.col("seg_id").alias("name"), F.col("pos").cast("long").alias("seg"))
    out = files.join(man, "name")
    return out if present is None else with_missing(out, manifest, present)


def read_segment_files(
    spark: SparkSession,
    path: str,
    manifest: DataFrame,
    schema: T.StructType = SEGMENT_FILE_SCHEMA,
    name_col: str | None = None,
    check_missing: bool = True,
) -> DataFrame:
    """One scan over a directory of segment CSV files, flat or one folder for each segment.

    Returns ``(seg, name, no, x)``: ``name`` is the file stem (or the plain text of the
    partition column ``name_col`` of a partitioned layout), ``seg`` its manifest position and ``no``
    the 1-based row number inside the segment, over all its part files in the natural order
    of their names (no shuffle of the samples). Files not in the manifest are dropped; a manifest
    entry without a file fails the job unless ``check_missing`` is off.
    """
    fields = list(schema.fields) + ([T.StructField(name_col, T.StringType())] if name_col else [])
    raw = spark.read.csv(path, header=True, schema=T.StructType(fields), mode="FAILFAST")
    name = segment_file_name(F.col("_file"), name_col)
    files = file_order_index(raw, name="no", per=name, keep_file=True).withColumn("name", name).drop("_file")
    files = files.select("name", F.col("no").cast("int").alias("no"), *[f.name for f in schema.fields])
    present = segment_names_present(spark, path, name_col) if check_missing else None
    return with_manifest(files, manifest, present).select("seg", "name", "no", *[f.name for f in schema.fields])
