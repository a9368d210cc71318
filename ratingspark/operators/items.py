"""Statement layer: period ranking (W1), line-item resolution (P13, P14),
previous-period values (W3) and year-over-year growth (W2).

Input is the long statement table ``(ticker, statement, period, item_pos,
item_id, value)``. Nothing here iterates rows: period ranks are computed on the
distinct (ticker, statement, period) set, names are matched once on the
*distinct* item ids against a fixed candidate table (an equi-join on
substrings, not a theta join), and the winning item per (ticker, metric) is a
``min_by`` aggregate, which combines partially before the shuffle so a hot
ticker never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingspark.functions import fixed_values as fv
from ratingspark.session import materialize

KEYS = ["ticker", "statement"]


# ---------------------------------------------------------------- W1
def period_sort_key(period: Column) -> Column:
    """``YYYY`` -> year, ``YYYY-Qn`` -> year*10+n, anything else -> 0."""
    p = F.trim(period.cast("string"))
    q = F.regexp_extract(p, r"^(\d+)-Q(\d+)$", 0)
    return (
        F.when(p.rlike(r"^\d+$"), p.cast("bigint"))
        .when(q != "", F.regexp_extract(p, r"^(\d+)-Q", 1).cast("bigint") * 10
              + F.regexp_extract(p, r"-Q(\d+)$", 1).cast("bigint"))
        .otherwise(F.lit(0).cast("bigint"))
    )


def rank_periods(items: DataFrame, mixed: bool = True) -> DataFrame:
    """Add ``period_rank`` (0 = newest) per (ticker, statement).

    The rank is taken over the distinct periods of a statement, including
    periods whose cells are all null. ``mixed=True`` reproduces the original
    ordering where quarter keys (YYYY*10+n) sort above every year when both
    grains are present; ``mixed=False`` ranks each grain on its own."""
    periods = items.select(*KEYS, "period").distinct().withColumn("_k", period_sort_key(F.col("period")))
    part = list(KEYS)
    if not mixed:
        periods = periods.withColumn("_grain", F.col("period").contains("-Q"))
        part.append("_grain")
    # window over distinct periods only: a partition holds one statement's
    # periods (tens of rows), never its line items
    w = Window.partitionBy(*part).orderBy(F.col("_k").desc(), F.col("period"))
    ranked = periods.withColumn("period_rank", (F.row_number().over(w) - 1).cast("int")).drop("_k", "_grain")
    return items.join(ranked, KEYS + ["period"])


# ---------------------------------------------------------------- candidates
def lookups_variant_a() -> list[tuple[str, str, list[str]]]:
    """(lookup name, statement, ordered candidate list) for the adapter."""
    b, i, c, r = fv.BALANCE_CANDIDATES, fv.INCOME_CANDIDATES, fv.CASHFLOW_CANDIDATES, fv.RATIO_CANDIDATES
    out = [(f"bs_{k}", "balance", v) for k, v in b.items()]
    out += [(f"is_{k}", "income", v) for k, v in i.items()]
    out += [(f"cf_{k}", "cashflow", v) for k, v in c.items()]
    out += [(f"rt_{k}", "ratio", v) for k, v in r.items()]
    return out


def candidate_table(spark: SparkSession, lookups: list[tuple[str, str, list[str]]]) -> DataFrame:
    rows = [(name, stmt, rank, cand, cand.strip().lower())
            for name, stmt, cands in lookups for rank, cand in enumerate(cands)]
    return spark.createDataFrame(
        rows, "lookup string, statement string, cand_rank int, cand string, cand_norm string")


def _substring_matches(keys: DataFrame, cands: DataFrame, key_col: str, lens: set[int]) -> DataFrame:
    """Equi-join form of ``cand_norm IN key``: explode every substring of each
    distinct key whose length is a candidate length, then join on equality."""
    lens_arr = "array(" + ",".join(str(n) for n in lens) + ")"
    subs = keys.select(
        key_col,
        F.explode(F.array_distinct(F.flatten(F.expr(
            f"transform(sequence(1, greatest(length({key_col}), 1)), "
            f"i -> transform(filter({lens_arr}, n -> i + n - 1 <= length({key_col})), "
            f"n -> substring({key_col}, i, n)))")))).alias("cand_norm"))
    return subs.join(F.broadcast(cands.select("cand_norm").distinct()), "cand_norm")


# ---------------------------------------------------------------- P13
def _availability(items: DataFrame) -> DataFrame:
    """(ticker, statement, item_id, seen): items with at least one non-null
    cell and their first-seen position (newest period first, then row order).
    Partial aggregation combines a ticker's periods before the shuffle."""
    return (items.filter(F.col("value").isNotNull())
            .groupBy(*KEYS, "item_id")
            .agg(F.min(F.struct("period_rank", "item_pos")).alias("seen")))


def _layout_id() -> Column:
    return F.sha2(F.concat_ws("\u0001", F.col("statement"), F.array_join("layout", "\u0001")), 256)


def layouts(avail: DataFrame) -> DataFrame:
    """Per (ticker, statement): its layout = the available item ids in
    first-seen order, and ``layout_id``, a digest of (statement, layout).

    Resolver A's choice depends on nothing else, so it is computed once per
    distinct layout — statement templates repeat across firms, so there are
    far fewer layouts than tickers — and joined back. A (ticker, statement)
    holds at most the statement's distinct item ids, so the list is bounded."""
    s = avail.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("seen", "item_id"))).alias("_s"))
    ids = F.transform("_s", lambda x: x["item_id"])
    return s.select(*KEYS, ids.alias("layout")).withColumn("layout_id", _layout_id())


def _layout_items(reps: DataFrame, lookups: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(layout_id, statement, lookup, item_id) of distinct layouts."""
    items = (reps.select("layout_id", "statement", F.posexplode("layout").alias("pos", "item_id"))
             .select("layout_id", "statement", "item_id",
                     F.struct(F.lit(0).alias("period_rank"), F.col("pos").alias("item_pos")).alias("seen")))
    return _resolve_core(items, lookups, ["layout_id", "statement"])


def resolve_items_a(items: DataFrame, lookups: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Resolver A: per (ticker, lookup) choose ONE item id.

    Candidates in priority order; each tried as exact id, then as a normalised
    key (lower/trim, and with ``(...)`` removed), then as a substring of the
    keys in first-seen column order. The chosen item is kept even if its value
    at the wanted period is null. Output: (ticker, statement, lookup, item_id).
    The matching runs on the distinct layouts only (see ``layouts``)."""
    lay = layouts(_availability(items))
    chosen = _layout_items(lay.dropDuplicates(["layout_id", "statement"]), lookups)
    # one row per (layout, lookup); AQE broadcasts it when it is small
    return lay.select(*KEYS, "layout_id").join(chosen, ["layout_id", "statement"]).select(
        *KEYS, "lookup", "item_id")


def statement_rows(items: DataFrame) -> DataFrame:
    """One row per (ticker, statement), all-null ones too: ``layout`` and
    ``layout_id`` as in ``layouts``, and ``v0``, ``v1``, the layout's items'
    values at the newest and second-newest period (the largest of repeated
    cells). The long table is shuffled once: ranks, items and layouts are all
    taken in its partitions by statement.

    ``items`` may hold one row for some cells of a period, with an array ``cells`` of
    (item_pos, item_id, value) that is never empty: these are ranked as they are, and
    made long after the ranking has sorted them."""
    rank = F.dense_rank().over(Window.partitionBy(*KEYS).orderBy(F.col("_k").desc(), F.col("period"))) - 1
    ranked = (items.where(F.col("ticker").isNotNull() & F.col("statement").isNotNull())
              .withColumn("_k", period_sort_key(F.col("period"))).withColumn("period_rank", rank)
              .where(F.col("period").isNotNull()))
    if "cells" in items.columns:
        ranked = ranked.select(*KEYS, "period_rank", F.inline("cells"))
    at = lambda idx: F.max(F.when(F.col("period_rank") == idx, F.col("value")))
    known = F.col("value").isNotNull()
    if isinstance(ranked.schema["item_pos"].dataType, T.IntegerType):
        # one number in the order of (period_rank, item_pos), nulls first: hashed, where a struct would be sorted
        seen = F.shiftleft(F.col("period_rank").cast("long"), 33) + F.coalesce(
            F.col("item_pos").cast("long") + F.lit((1 << 31) + 1), F.lit(0))
    else:
        seen = F.struct("period_rank", "item_pos")
    cells = ranked.groupBy(*KEYS, "item_id").agg(F.min(F.when(known, seen)).alias("seen"), at(0).alias("v0"), at(1).alias("v1"))
    cell = F.when(F.col("seen").isNotNull() & F.col("item_id").isNotNull(), F.struct("seen", "item_id", "v0", "v1"))
    rows = cells.groupBy(*KEYS).agg(F.array_sort(F.collect_list(cell)).alias("_s")).select(
        *KEYS, F.col("_s.item_id").alias("layout"), F.col("_s.v0").alias("v0"), F.col("_s.v1").alias("v1"))
    return rows.withColumn("layout_id", _layout_id())


def values_a(rows: DataFrame, lookups: list[tuple[str, str, list[str]]], wanted: list[tuple[str, int]]) -> DataFrame:
    """Per ticker of ``statement_rows`` one column ``<lookup>@<idx>`` for each of
    ``wanted`` (idx 0 or 1): the value of the item that resolver A chooses."""
    reps = materialize(rows.select("layout_id", "statement", "layout").dropDuplicates(["layout_id", "statement"]), "layouts")
    chosen = _layout_items(reps, lookups).groupBy("layout_id", "statement").agg(
        F.map_from_entries(F.collect_list(F.struct("lookup", "item_id"))).alias("_items"))
    names = list(dict.fromkeys(name for name, _ in wanted))
    # places in the layout, from 0; null where no item is chosen
    places = reps.join(chosen, ["layout_id", "statement"]).select("layout_id", "statement", F.array(*[
        (F.nullif(F.array_position("layout", F.col("_items")[name]), F.lit(0)) - 1).cast("int")
        for name in names]).alias("_at"))
    value = lambda name, idx: F.get(F.col(f"v{idx}"), F.get("_at", F.lit(names.index(name))))
    return rows.join(places, ["layout_id", "statement"], "left").groupBy("ticker").agg(
        *[F.max(value(name, idx)).alias(f"{name}@{idx}") for name, idx in wanted])


def _resolve_core(avail: DataFrame, lookups: list[tuple[str, str, list[str]]], keys: list[str]) -> DataFrame:
    spark = avail.sparkSession
    cands = F.broadcast(candidate_table(spark, lookups))  # fixed size: bounded broadcast
    k1 = avail.select(*keys, "item_id", F.lower(F.trim("item_id")).alias("key"),
                      F.struct(F.col("seen"), F.lit(0).alias("w")).alias("prod"))
    stripped = F.lower(F.trim(F.regexp_replace("item_id", r"\s*\(.*?\)\s*", "")))
    k2 = avail.select(*keys, "item_id", stripped.alias("key"),
                      F.struct(F.col("seen"), F.lit(1).alias("w")).alias("prod")).filter(F.col("key") != "")
    lookup = (k1.unionByName(k2).groupBy(*keys, "key")
              .agg(F.max_by("item_id", "prod").alias("owner"), F.min("prod").alias("key_pos")))

    zero = F.struct(F.struct(F.lit(0).alias("period_rank"), F.lit(0).alias("item_pos")).alias("seen"),
                    F.lit(0).alias("w"))
    exact = avail.join(cands.withColumnRenamed("cand", "item_id"), ["statement", "item_id"]).select(
        *keys, "lookup", "cand_rank", F.lit(0).alias("kind"), zero.alias("key_pos"),
        F.col("item_id").alias("chosen"))
    norm = lookup.join(cands.withColumnRenamed("cand_norm", "key"), ["statement", "key"]).select(
        *keys, "lookup", "cand_rank", F.lit(1).alias("kind"), "key_pos", F.col("owner").alias("chosen"))
    dkeys = lookup.select("key").distinct()
    sub_hits = _substring_matches(dkeys, cands, "key",
                                  {len(c.strip().lower()) for _, _, cs in lookups for c in cs})
    sub = (lookup.join(sub_hits, "key")
           .join(cands, ["statement", "cand_norm"])
           .select(*keys, "lookup", "cand_rank", F.lit(2).alias("kind"), "key_pos",
                   F.col("owner").alias("chosen")))
    hits = exact.unionByName(norm).unionByName(sub)
    return (hits.groupBy(*keys, "lookup")
            .agg(F.min_by("chosen", F.struct("cand_rank", "kind", "key_pos")).alias("item_id")))


def values_at(items: DataFrame, resolved: DataFrame, idx: int = 0) -> DataFrame:
    """Value of each resolved item at the statement's ``idx``-th newest period
    (null if the cell is null or the statement has fewer periods)."""
    cells = items.filter(F.col("period_rank") == idx).select(*KEYS, "item_id", "value")
    return resolved.join(cells, KEYS + ["item_id"], "left").select(
        "ticker", "lookup", F.lit(idx).alias("idx"), "item_id", "value")


# ---------------------------------------------------------------- P14
def resolve_values_b(items: DataFrame, lookups: list[tuple[str, str, list[str], int]]) -> DataFrame:
    """Resolver B: first NON-NULL value at period ``idx``; pass 1 exact keys in
    order, pass 2 keys in order x columns in order by substring.
    ``lookups`` = (name, statement, keys, idx). Output (ticker, lookup, value)."""
    spark = items.sparkSession
    rows = [(name, stmt, rank, k, k.lower(), idx)
            for name, stmt, keys, idx in lookups for rank, k in enumerate(keys)]
    cands = F.broadcast(spark.createDataFrame(
        rows, "lookup string, statement string, cand_rank int, cand string, cand_norm string, idx int"))
    order = (items.filter(F.col("value").isNotNull())
             .groupBy(*KEYS, "item_id")
             .agg(F.min(F.struct("period_rank", "item_pos")).alias("col_pos")))
    cells = items.filter(F.col("value").isNotNull()).select(*KEYS, "item_id", "period_rank", "value")
    zero = F.struct(F.lit(0).alias("period_rank"), F.lit(0).alias("item_pos"))
    exact = (order.join(cands.withColumnRenamed("cand", "item_id"), ["statement", "item_id"])
             .select(*KEYS, "item_id", "lookup", "idx", "cand_rank", F.lit(1).alias("pass"),
                     zero.alias("col_pos")))
    low = order.withColumn("key", F.lower("item_id"))
    sub_hits = _substring_matches(low.select("key").distinct(), cands, "key",
                                  {len(k.lower()) for _, _, ks, _ in lookups for k in ks})
    sub = (low.join(sub_hits, "key").join(cands, ["statement", "cand_norm"])
           .select(*KEYS, "item_id", "lookup", "idx", "cand_rank", F.lit(2).alias("pass"), "col_pos"))
    hits = exact.unionByName(sub).join(cells.withColumnRenamed("period_rank", "idx"), KEYS + ["item_id", "idx"])
    return (hits.groupBy("ticker", "lookup")
            .agg(F.min_by("value", F.struct("pass", "cand_rank", "col_pos")).alias("value")))


def values_b(rows: DataFrame, lookups: list[tuple[str, str, list[str], int]]) -> DataFrame:
    """Per ticker of ``statement_rows`` one column per lookup (idx 0 or 1): the value
    that resolver B finds. Which items a lookup tries, and in which order, depends on
    the layout alone, so it is found once per distinct layout; the first of their values
    that is not null is then picked inside each statement's row."""
    reps = materialize(rows.select("layout_id", "statement", "layout").dropDuplicates(["layout_id", "statement"]), "layouts")
    cands = F.broadcast(rows.sparkSession.createDataFrame(
        [(name, stmt, rank, k, k.lower()) for name, stmt, keys, _ in lookups for rank, k in enumerate(keys)],
        "lookup string, statement string, cand_rank int, cand string, cand_norm string"))  # fixed size
    items = reps.select("layout_id", "statement", F.posexplode("layout").alias("pos", "item_id"))
    low = items.withColumn("key", F.lower("item_id"))
    sub_hits = _substring_matches(low.select("key").distinct(), cands, "key",
                                  {len(k.lower()) for _, _, ks, _ in lookups for k in ks})
    exact = items.join(cands.withColumnRenamed("cand", "item_id"), ["statement", "item_id"]).select(
        "layout_id", "statement", "lookup", F.struct(F.lit(1).alias("pass"), "cand_rank", "pos").alias("hit"))
    sub = low.join(sub_hits, "key").join(cands, ["statement", "cand_norm"]).select(
        "layout_id", "statement", "lookup", F.struct(F.lit(2).alias("pass"), "cand_rank", "pos").alias("hit"))
    tried = (exact.unionByName(sub).groupBy("layout_id", "statement", "lookup")
             .agg(F.array_sort(F.collect_list("hit")).alias("hits"))
             .groupBy("layout_id", "statement").agg(F.map_from_entries(F.collect_list(
                 F.struct("lookup", F.array_distinct("hits.pos").alias("at")))).alias("_tried")))
    # one row a layout: places in it, from 0, in the order in which they are tried
    places = tried.select("layout_id", "statement", F.array(*[
        F.col("_tried")[name] for name, _, _, _ in lookups]).alias("_at"))

    def value(i: int, idx: int) -> Column:
        found = F.transform(F.get("_at", F.lit(i)), lambda p: F.get(F.col(f"v{idx}"), p))
        return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))

    return rows.join(places, ["layout_id", "statement"], "left").groupBy("ticker").agg(
        *[F.max(value(i, idx)).alias(name) for i, (name, _, _, idx) in enumerate(lookups)])


# ---------------------------------------------------------------- W2 / W3
def clip(c: Column, lo: float, hi: float) -> Column:
    """Null-preserving clip (``greatest/least`` would turn null into a bound)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def yoy_growth(v0: Column, v1: Column, lo: float = -0.9, hi: float = 5.0) -> Column:
    """``(v0 - v1) / |v1|`` clipped, null when either is null or |v1| < 1e-9.
    Uses the newest and second-newest period, not calendar adjacency."""
    ok = v0.isNotNull() & v1.isNotNull() & (F.abs(v1) >= F.lit(1e-9))
    return F.when(ok, clip((v0 - v1) / F.abs(v1), lo, hi))
