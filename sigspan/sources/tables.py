"""Table sources: parquet stage tables and the ``signal`` base relation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one table of a data directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_keys(table: DataFrame, key: str, wanted: Sequence, at_once: int = 10) -> DataFrame:
    """Rows of ``table`` whose ``key`` is among ``wanted``, a list known beforehand.

    The list is pushed to the scan in groups of ``at_once`` (longer ones Spark would push as one range of values), so that row groups without a wanted key are skipped by
    their bloom filter, dictionary or bounds. Made for up to some hundred keys; join a table of keys beyond that.
    """
    names = list(dict.fromkeys(wanted))
    condition = F.lit(False)
    for i in range(0, len(names), at_once):
        condition = condition | F.col(key).isin(names[i : i + at_once])
    return table.where(condition)


def signal_from_events(events: DataFrame, label_period: int = 1700) -> DataFrame:
    """The ``signal`` base relation: one sample per event, time order ``(ts, event_id)``.

    ``uid`` = event id, ``x`` = value, ``y`` = a countdown label with a period unlike the
    segment length, so labels differ between segments. ``ts`` is kept as the order key.
    """
    return events.select(
        F.col("event_id").alias("uid"),
        F.col("ts"),
        F.col("value").alias("x"),
        ((F.lit(label_period) - F.col("event_id") % label_period).cast("double") / 100.0).alias("y"),
    )


def read_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_from_events(read_table(spark, sf_dir, "events"))


def embeddings_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as ``(vec_id, label, vx array<double>)``."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vx"))
