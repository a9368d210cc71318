import uuid

import pytest
from pyspark.sql.utils import AnalysisException

from ratingspark.session import scratch_path
from ratingspark.streaming import ingest as si

SCHEMA = "ticker string, statement string, period string, item_pos int, item_id string, value double"


def folders(spark):
    base = scratch_path(spark, f"test-ingest/{uuid.uuid4().hex}")
    return f"{base}/landing", f"{base}/store", f"{base}/_ckpt"


def test_ingest_is_idempotent_across_restarts(spark):
    rows = [("F1", "balance", "2024", 1, "total_assets", 10.0), ("F1", "income", "2024", 1, "n_3.net_revenue", 5.0),
            ("F2", "balance", "2024", 1, "total_assets", 7.0)]
    items = spark.createDataFrame(rows, SCHEMA)
    landing, store, ckpt = folders(spark)
    si.land(items, landing, 1)
    si.land(items, landing, 2)  # the same tickers landed again
    schema = spark.read.parquet(landing).schema
    si.run_ingest(spark, landing, store, ckpt, schema)
    assert si.stored(spark, store).count() == 3
    # restart from the same checkpoint after a new drop with one new ticker
    more = spark.createDataFrame([("F3", "balance", "2024", 1, "total_assets", 1.0)] + rows, items.schema)
    si.land(more, landing, 3)
    si.run_ingest(spark, landing, store, ckpt, schema)
    got = si.stored(spark, store)
    assert got.count() == 4
    assert sorted(r[0] for r in got.select("ticker").distinct().collect()) == ["F1", "F2", "F3"]


@pytest.mark.parametrize("files_per_trigger", [1, 3])
def test_a_tickers_files_may_span_micro_batches(spark, files_per_trigger):
    """One drop in many one-row files, then a re-crawl with other values."""
    rows = [(f"F{k % 3}", "balance", str(2000 + k), k, "total_assets", float(k)) for k in range(8)]
    landing, store, ckpt = folders(spark)
    si.land(spark.createDataFrame(rows, SCHEMA).repartition(8, "period"), landing, 1)
    si.land(spark.createDataFrame([(*r[:5], -1.0) for r in rows], SCHEMA).coalesce(1), landing, 2)
    si.run_ingest(spark, landing, store, ckpt, spark.read.parquet(landing).schema, files_per_trigger)
    got = si.stored(spark, store)
    assert sorted((r.ticker, r.period, r.value) for r in got.collect()) == sorted((r[0], r[2], r[5]) for r in rows)


def test_a_repeated_micro_batch_changes_nothing(spark):
    rows = [("F1", "balance", "2024", 1, "total_assets", 1.0), ("F2", "balance", "2024", 1, "total_assets", 2.0)]
    batch = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", drop int")
    _, store, _ = folders(spark)
    for batch_id in (0, 0, 1, 0):
        si.ingest_batch(batch if batch_id == 0 else batch.where("ticker = 'F1'"), store, batch_id)
    # batch 1 holds more rows of F1's winning drop, batch 0 its two rows, however often it ran
    assert si.stored(spark, store).count() == 3


def test_a_damaged_store_is_no_first_batch(spark):
    batch = spark.createDataFrame([("F1", "balance", "2024", 1, "total_assets", 1.0, 1)], SCHEMA + ", drop int")
    _, store, _ = folders(spark)
    spark.range(1).write.parquet(f"{store}/winners/batch=0")  # no ticker, no drop
    with pytest.raises(AnalysisException):
        si.ingest_batch(batch, store, 1)


def test_a_first_batch_cut_short_is_done_again(spark):
    batch = spark.createDataFrame([("F1", "balance", "2024", 1, "total_assets", 1.0, 1)], SCHEMA + ", drop int")
    _, store, _ = folders(spark)
    spark.range(1).write.parquet(f"{store}/winners/_temporary/part")  # files that no reader lists
    si.ingest_batch(batch, store, 0)
    assert si.stored(spark, store).count() == 1
