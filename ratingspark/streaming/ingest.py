"""Per-key cached ingest (S5 / S6 / J7) as Structured Streaming.

Landed statement files arrive in a folder (one sub-folder per drop, any number
of part files, a ticker's rows in any of them). A file-source stream picks
them up; ``foreachBatch`` admits rows by (ticker, drop): the first drop seen
for a ticker, the earliest of its micro-batch, wins for good, and every row of
that drop is stored whatever micro-batch it comes in. Rows of other drops are
re-crawls and skipped.

Each micro-batch writes its rows, and the winners it set, to folders of its
own and overwrites them when it runs again, so a batch repeated after a lost
driver stores nothing twice. The checkpoint records the files consumed.

``Trigger.availableNow`` drains what has landed and stops, which is the
batch-scheduled form of the original's "skip what is cached, fetch the rest".
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ratingspark.session import scratch_path

KEY = "ticker"
#: Conditions of a store without any winner: no folder yet, or one in which a first
#: batch was cut short before it finished a file.
NOTHING_STORED = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def land(df: DataFrame, landing_dir: str, drop: int) -> None:
    """Write one drop of statement rows into the landing folder."""
    df.withColumn("drop", F.lit(drop)).write.parquet(f"{landing_dir}/drop={drop:05d}")


def _winners(spark: SparkSession, store_dir: str, but: int) -> DataFrame | None:
    """``(ticker, won)`` of all micro-batches but one, or None where none has set a
    winner. A store that cannot be read as one is an error, not a first batch:
    taking it for one would admit every re-crawl again."""
    try:
        winners = spark.read.parquet(f"{store_dir}/winners")
    except AnalysisException as error:
        if error.getCondition() in NOTHING_STORED:
            return None
        raise
    return winners.where(F.col("batch") != but).select(KEY, F.col("drop").alias("won"))


def ingest_batch(batch: DataFrame, store_dir: str, batch_id: int) -> None:
    spark = batch.sparkSession
    here = batch.groupBy(KEY).agg(F.min("drop").alias("drop"))
    won = _winners(spark, store_dir, batch_id)
    new = here if won is None else here.join(won, KEY, "left_anti")
    new.write.mode("overwrite").parquet(f"{store_dir}/winners/batch={batch_id}")
    new = spark.read.schema(here.schema).parquet(f"{store_dir}/winners/batch={batch_id}").select(
        KEY, F.col("drop").alias("won"))
    all_won = new if won is None else won.unionByName(new)
    admitted = batch.join(all_won, KEY).where(F.col("drop") == F.col("won")).drop("won")
    admitted.write.mode("overwrite").parquet(f"{store_dir}/rows/batch={batch_id}")


def stored(spark: SparkSession, store_dir: str) -> DataFrame:
    return spark.read.parquet(f"{store_dir}/rows").drop("batch")


def run_ingest(spark: SparkSession, landing_dir: str, store_dir: str, checkpoint_dir: str,
               schema, files_per_trigger: int = 64) -> None:
    """Drain the landing folder into the store (available-now trigger)."""
    stream = (spark.readStream.schema(schema)
              .option("maxFilesPerTrigger", files_per_trigger)
              .option("basePath", landing_dir)
              .parquet(landing_dir))
    q = (stream.writeStream
         .foreachBatch(lambda df, batch_id: ingest_batch(df, store_dir, batch_id))
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()


def ingest_statements(spark: SparkSession, items: DataFrame) -> DataFrame:
    """Land ``items`` as drop 1, then a re-crawl of half the tickers with
    changed values as drop 2, stream both into a store and return the store:
    each ticker's rows of drop 1 exactly once."""
    base = scratch_path(spark, f"ingest/{uuid.uuid4().hex}")
    landing, store, ckpt = f"{base}/landing", f"{base}/store", f"{base}/_checkpoint"
    land(items, landing, 1)
    again = spark.read.parquet(f"{landing}/drop=00001").where(F.pmod(F.xxhash64(KEY), F.lit(2)) == 0)
    land(again.withColumn("value", F.col("value") + 1), landing, 2)
    run_ingest(spark, landing, store, ckpt, spark.read.parquet(landing).schema)
    return stored(spark, store).drop("drop")
