"""Reads of chosen keys: right rows, and a scan that skips the others."""

from pyspark.sql import functions as F

from sigspan.session import scratch_path
from sigspan.sources import sinks as sk
from sigspan.sources.tables import read_keys


def _scanned(df):
    """Rows that the scans of an executed frame gave out."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_only_row_groups_with_a_wanted_key_are_read(spark):
    rows = spark.range(64000).select(F.substring(F.md5((F.col("id") % 640).cast("string").cast("binary")), 1, 12).alias("name"), (F.col("id") / 3).alias("x"))
    path = sk.write_lookup_table(rows, scratch_path(spark, "t-lookup"), "name", files=64, keys_per_file=30)
    names = [r.name for r in rows.select("name").distinct().orderBy("name").limit(40).collect()]
    table = spark.read.parquet(path)
    for wanted in (names[:1], names[3:6], names[::3] + ["nobody"], ["nobody"], [], names[:2] * 3):
        out = read_keys(table, "name", wanted)
        got = sorted((r.name, r.x) for r in out.collect())
        assert got == sorted((r.name, r.x) for r in rows.where(F.col("name").isin(wanted)).collect()) if wanted else got == []
        if 0 < len(set(wanted)) <= 3:
            assert _scanned(out) <= (len(set(wanted)) + 2) * 3000  # of 64000: files of about 1000 rows that hold a name, or seem to
    assert read_keys(table, "name", names[::3])._jdf.queryExecution().executedPlan().toString().count("In(name") >= 1
