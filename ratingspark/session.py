"""Session helpers: a tuned local session for tests/bench, and the shared
checkpoint folder read from the cluster's own configuration."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "ratingspark") -> SparkSession:
    """Session for local runs. On a cluster, use the session the cluster hands
    you; these settings only matter for local[N]."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the platform sets it (a shared file system) and its absence
    is an error; only a session on a local master gets a temporary folder."""
    d = spark.conf.get(_CKPT_KEY, None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "") or ""):
            raise ValueError(f"{_CKPT_KEY} must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="ratingspark-ckpt-")
        spark.conf.set(_CKPT_KEY, d)
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # sessions without a local SparkContext (Spark Connect)
        pass
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Stage boundary: write ``df`` once as Parquet under the shared checkpoint
    folder (``spark.checkpoint.dir``) and continue from the written table.

    This cuts the lineage (a lost executor re-reads files instead of re-running
    every upstream join and aggregate), lets each later statistic scan a
    columnar table with pruning instead of recomputing the chain, and keeps
    downstream plans small. Each call writes a fresh folder (no overwrite, no
    delete), so concurrent jobs never clash."""
    path = scratch_path(df.sparkSession, f"tables/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
