"""Exact linear-interpolated quantiles of many columns and groups at once
(pandas / DuckDB ``quantile_cont``), without gathering any group's values.

1. A mergeable sketch per (group, column) brackets each quantile: the values a
   little below and above it, whatever the number of rows.
2. One pass counts what lies below the bracket, remembers its neighbours on
   either side, and counts the distinct values inside it, all with map-side
   combining, so that a hot group or a hot value shrinks before the shuffle.
3. Only the distinct values inside the brackets, a few ten-thousandths of a
   group, are ranked; the two values around the wanted position interpolate.

The result does not depend on the sketch's error, which only sets how many
values step 3 ranks. The brackets, one row for each group, column and quantile,
are sent to the values as long as they are few; the values then stay where they
are. With more groups both sides meet by group and column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingspark.session import materialize

#: Brackets that may be broadcast, some 100 bytes each.
FEW_BRACKETS = 100_000
#: Accuracy of the sketch: its ranks are off by n / ACCURACY at most.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float],
                    by: str | None = None) -> DataFrame:
    """Long form: (``by``), ``feature``, ``k`` (position in
    ``probabilities``), ``n`` (non-null values) and ``value``. Nulls are
    skipped, rows with a null ``by`` left out; a column without values has no
    row. ``df`` is read twice: pass a written table."""
    group = [by] if by else []
    source = df.where(F.col(by).isNotNull()) if by else df
    values = source.select(*group, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        group, columns, "feature", "v").where("v is not null")
    key = [*group, "feature"]
    reach = 2 / ACCURACY
    ends = [x for p in probabilities for x in (max(0.0, p - reach), min(1.0, p + reach))]
    sketch = values.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", ends, ACCURACY).alias("ends"))
    few = True  # one row a column without groups
    if by:
        sketch = materialize(sketch, "sketch")
        few = sketch.count() * len(probabilities) <= FEW_BRACKETS
    brackets = sketch.select(*key, "n", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p"), F.col("ends")[2 * k].alias("low"),
                 F.col("ends")[2 * k + 1].alias("high")) for k, p in enumerate(probabilities)])).alias("b")).select(
        *key, "n", "b.*")
    # -1 below, 0 inside, 1 above; outside the bracket only the nearest value matters
    side = F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0)
    counted = (values.join(F.broadcast(brackets) if few else brackets, key).withColumn("side", side)
               .groupBy(*key, "k", "p", "n", "side", F.when(F.col("side") == 0, F.col("v")).alias("inside"))
               .agg(F.count(F.lit(1)).alias("rows"), F.min("v").alias("least"), F.max("v").alias("most")))
    ordered = Window.partitionBy(*key, "k").orderBy("side", "inside")
    last = F.sum("rows").over(ordered) - 1
    ranked = counted.select(
        *key, "k", "p", "n", F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least")).alias("v"),
        F.when(F.col("side") < 0, last).otherwise(last - F.col("rows") + 1).alias("first"),
        F.when(F.col("side") > 0, last - F.col("rows") + 1).otherwise(last).alias("last"))
    place = F.col("p") * (F.col("n") - 1)
    at = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("v")))
    found = ranked.groupBy(*key, "k", "p", "n").agg(at(F.floor(place)).alias("low"), at(F.ceil(place)).alias("high"))
    return found.select(*key, "k", "n", (F.col("low") + (F.col("high") - F.col("low")) * (place - F.floor(place)))
                        .alias("value"))


def wide_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], by: str | None = None,
                   counts: dict[str, str] | None = None) -> DataFrame:
    """Quantiles as columns: ``wanted`` maps each output name to a column and a
    probability, ``counts`` each output name to a column whose non-null values
    are counted. One row per group that has any value (without ``by``: one row)."""
    columns = sorted({c for c, _ in wanted.values()} | set((counts or {}).values()))
    probabilities = sorted({p for _, p in wanted.values()})
    long = exact_quantiles(df, columns, probabilities, by)
    cells = [F.max(F.when((F.col("feature") == c) & (F.col("k") == probabilities.index(p)), F.col("value"))).alias(name)
             for name, (c, p) in wanted.items()]
    cells += [F.coalesce(F.max(F.when(F.col("feature") == c, F.col("n"))), F.lit(0)).alias(name)
              for name, c in (counts or {}).items()]
    return long.groupBy(by).agg(*cells) if by else long.agg(*cells)
