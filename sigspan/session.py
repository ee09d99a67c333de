"""Session helpers: shared scratch location, size-checked broadcast, local sessions for tests."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest size a helper table may have and still be broadcast on purpose.
# Above it, the join is left to the planner (AQE picks broadcast or a shuffled join at run time).
MAX_BROADCAST_BYTES = 32 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stage tables.

    Read from the session (``spark.checkpoint.dir`` or the context's checkpoint dir). Only when
    neither is set (local tests) a private folder is created and registered.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir()
    if not path:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="sigspan-ckpt-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir() or path
    return path


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh, unused path below the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    sep = "" if base.endswith("/") else "/"
    return f"{base}{sep}sigspan-{tag}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage like a reliable checkpoint, but later reads prune columns and push filters down.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so the path can be handed to local-only tools in tests."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return path


def sized_broadcast(df: DataFrame, max_rows_bound: int | None, row_bytes: int, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast only when a proven upper bound on its bytes is below ``limit``.

    ``max_rows_bound`` must be a bound known without running the data (partition count,
    number of windows, one row of a global aggregate ...), ``row_bytes`` one on the width of a row.
    Without a bound, or above the limit, the frame is returned unmarked and AQE chooses the join.
    """
    if max_rows_bound is not None and max_rows_bound * row_bytes <= limit:
        return F.broadcast(df)
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sigspan") -> SparkSession:
    """Session for tests and the local bench: UI off, AQE on, UTC."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SIGSPAN_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark
