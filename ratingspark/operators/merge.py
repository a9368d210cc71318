"""Merging two populations.

Foreign (large) rated rows and local rated rows are unioned into the training
set, local rows upweighted by replication; unrated local rows become the
scoring set. Replication is ``explode(sequence(1, k))`` — a narrow per-row
operation, no shuffle — and the fractional remainder is a deterministic hash
cut, so no step needs a global sort or a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingspark.functions import fixed_values as fv
from ratingspark.functions.scalars import valid_grade
from ratingspark.operators.clean import impute_reference
from ratingspark.operators.features import reference_ratio


def split_local(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rated = has_rating AND grade on the scale (null-safe); the
    complement is the scoring set."""
    rated = F.coalesce(F.col("has_rating") & valid_grade(F.col("credit_rating")), F.lit(False))
    return df.filter(rated), df.filter(~rated)


def upweight(df: DataFrame, weight: float = fv.MERGE_LOCAL_WEIGHT, key: str = "ticker",
             seed: int = fv.SEED) -> DataFrame:
    """``int(weight)`` copies of every row, plus one more copy of the rows
    whose seeded hash falls under the fractional part (about n * frac rows)."""
    whole = int(weight)
    frac = weight - whole
    extra = F.when(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(frac * 1_000_000), 1) \
        .otherwise(0) if frac > 0 else F.lit(0)
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.lit(whole) + extra)))


def merge(feats: DataFrame, weight: float = fv.MERGE_LOCAL_WEIGHT) -> tuple[DataFrame, DataFrame]:
    """(train, predict). train = foreign rated ∪ upweighted local rated,
    imputed (I1) and with reference ratios (N1); predict = unrated local."""
    local = feats.filter(F.col("data_source") == "vietnam")
    rated, unrated = split_local(local)
    foreign = feats.filter((F.col("data_source") == "kaggle") & valid_grade(F.col("credit_rating")))
    train = foreign.withColumn("copy_no", F.lit(0)).unionByName(upweight(rated, weight))
    return reference_ratio(impute_reference(train)), reference_ratio(impute_reference(unrated))
