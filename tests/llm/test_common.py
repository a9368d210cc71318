import pytest
from pyspark.sql import functions as F

from ratingspark.llm import common


def test_thinned_loses_no_join_partner(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    wanted = spark.range(0, 20_000, 37).select(F.col("id").alias("k"))
    kept = common.thinned(rows, "k", wanted)
    assert kept.columns == rows.columns
    assert kept.join(wanted, "k").count() == wanted.count() and kept.count() < 800
    maybe, never = common.split_by(rows, "k", wanted)
    assert maybe.count() + never.count() == 20_000 and never.join(wanted, "k").count() == 0
    assert common.thinned(rows, "k", wanted.where("false")).count() == 0


def test_nulls_are_kept_out_safely(spark):
    rows = spark.createDataFrame([(None,), (1,)], "k long")
    wanted = spark.createDataFrame([(1,), (None,)], "k long")
    assert common.thinned(rows, "k", wanted).join(wanted, "k").count() == 1


def test_scratch_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="share"):
        common.scratch_root(Session())
