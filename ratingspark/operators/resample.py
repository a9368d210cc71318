"""Resampling of rare classes (M5): synthetic rows between neighbours of a class
(J8), then removal of Tomek links, the mutual nearest neighbours of two
classes.

The sampler acts only if there are ``LEAST_ROWS`` rows and some class has less
than half the mean class size. Every class but the largest is filled up to the
largest. Base rows are dealt evenly in seeded digest order; neighbour and
position on the line come from digests of (key, copy), so a synthetic row does
not depend on partitions. A class of one row has nothing to interpolate with;
then all rows stay as they are, as in the original, whose sampler fails there.
Weights mean nothing on synthetic rows and are null afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingspark.functions import fixed_values as fv
from ratingspark.operators.labels import seeded_rank
from ratingspark.operators.neighbours import nearest
from ratingspark.session import materialize

LEAST_ROWS, NEIGHBOURS = 15, 5
#: Copies of a row that are made in one place; more are spread over tasks.
COPIES = 1000


def plan(counts: dict) -> tuple[int, dict]:
    """``(neighbours, synthetic rows by class)``; no neighbours if the trigger
    does not act."""
    mean = sum(counts.values()) / max(1, len(counts))
    if sum(counts.values()) < LEAST_ROWS or min(counts.values()) < 2 or min(counts.values()) >= mean / 2:
        return 0, {}
    most = max(counts.values())
    return max(1, min(NEIGHBOURS, min(counts.values()) - 1)), {c: most - n for c, n in counts.items() if n < most}


def digest_number(*parts: Column) -> Column:
    """A number in [0, 2^32) from a digest, the same in Spark and SQL."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", *parts)), 1, 8), 16, 10).cast("long")


def synthetic(rows: DataFrame, key: str, label: str, features: list[str], seed: int = fv.SEED) -> DataFrame | None:
    """The synthetic rows ``key, label, features``, keys ``<base>~<copy>``; null
    if the trigger does not act."""
    rows = materialize(rows.where(F.col(label).isNotNull()).select(key, label, F.array(*[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("vector")), "resample-rows")
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row per class
    k, need = plan(counts) if counts else (0, {})
    if not k:
        return None
    literal = lambda of: F.create_map(*[F.lit(x) for item in of.items() for x in item])[F.col(label)]
    rare = rows.where(F.col(label).isin(list(need)))
    near = (nearest(rare, k, key, "vector", label).groupBy("key")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("near")))  # k of them
    ranked = seeded_rank(rare, [label], key, seed)
    copies = F.floor(literal(need) / literal(counts)) + (F.col("_rank") <= literal(need) % literal(counts)).cast("int")
    dealt = ranked.withColumn("copies", copies.cast("int")).where("copies > 0")
    spread = (dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES).cast("int"))))
              .withColumnRenamed(key, "key").join(near, "key").repartition("key", "block"))
    made = spread.withColumn("copy", F.explode(F.sequence(
        F.col("block") * COPIES, F.least(F.col("block") * COPIES + COPIES, F.col("copies")) - 1)))
    of = lambda what: digest_number(F.col("key"), F.col("copy").cast("string"), F.lit(f"{what}{seed}"))
    drawn = made.select(
        "key", label, "vector", "copy", F.col("near")[F.pmod(of("n"), F.size("near")).cast("int")]["neighbour"].alias("neighbour"),
        (of("l") / F.lit(float(1 << 32))).alias("share"))
    other = rare.select(F.col(key).alias("neighbour"), F.col("vector").alias("towards"))
    line = F.zip_with("vector", "towards", lambda a, b: a + F.col("share") * (b - a))
    return (drawn.join(other, "neighbour")
            .select(F.concat_ws("~", "key", F.col("copy").cast("string")).alias(key), label, line.alias("vector"))
            .select(key, label, *[F.col("vector")[n].alias(c) for n, c in enumerate(features)]))


def tomek_links(rows: DataFrame, key: str, label: str, features: list[str]) -> DataFrame:
    """``key`` of all rows whose nearest neighbour has another label and is
    theirs in turn. Nulls count as 0."""
    vectors = materialize(rows.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("label"), F.array(*[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("vector")), "tomek-rows")
    near = materialize(nearest(vectors, 1, label=None).select("key", "neighbour")
                       .join(vectors.select("key", "label"), "key"), "tomek-nearest")
    other = near.select(F.col("key").alias("neighbour"), F.col("neighbour").alias("back"), F.col("label").alias("other"))
    return (near.join(other, "neighbour").where((F.col("back") == F.col("key")) & (F.col("other") != F.col("label")))
            .select(F.col("key").alias(key)))


def smote_tomek(rows: DataFrame, key: str, label: str, features: list[str], weight: str | None = None,
                seed: int = fv.SEED) -> DataFrame:
    """``rows`` with ``is_synthetic``: unchanged if the trigger does not act;
    else with synthetic rows, without Tomek links, and with null weights. Other
    columns are null on synthetic rows."""
    made = synthetic(rows, key, label, features, seed)
    if made is None:
        return rows.withColumn("is_synthetic", F.lit(False))
    kept = rows.withColumns({weight: F.lit(None).cast(rows.schema[weight].dataType)} if weight else {})
    both = materialize(kept.withColumn("is_synthetic", F.lit(False)).unionByName(
        made.withColumn("is_synthetic", F.lit(True)), allowMissingColumns=True), "resampled")
    return both.join(tomek_links(both, key, label, features), key, "left_anti")
