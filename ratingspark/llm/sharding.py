"""Balanced label propagation into shards, in DataFrame functions alone.

Rows are dealt evenly to the shards by rank in a hash order. Rows with equal
texts are linked. Each round, every group of linked rows wants the shard that
most of its members could share, counting the unlinked rows there that could
give way; its members elsewhere apply to move. Unlinked rows offer themselves
to a hashed shard each. Between two shards as many rows move one way as the
other (the quota), movers of links before the unlinked, so the counts of all
shards stay as they were: at most one apart (law ``rows``). Groups larger than
three quarters of a shard are split by hash into pieces that fit.

Hash orders use a key of the row's content (id, text, number among equal
rows), so the shards are a function of the table and not of its partitions.
Rounds end when no linked row wants to move, or when as many want to as ``STALE``
rounds before; ``rounds`` can bound them.

Whatever ranks rows does so by counts of hash cells first and by a window only
inside a cell, so no shard, queue or group is sorted in one task.

Defined cases: a null text counts as the empty one (size 1, checksum 0) and is
linked to empty texts; repeated rows are rows of their own; null ids are
carried along; other columns are ignored; with fewer rows than shards the last
shards stay empty; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingspark.llm.common import splitmix, written

SHARDS, STALE = 16, 2
#: Rows of one hash cell, about.
CELL = 20_000
GROUP = ["g1", "g2", "piece"]


def _cell(c: str, salt: int, n: int) -> Column:
    return F.pmod(splitmix(F.col(c), salt), F.lit(n))


def _ranked(rows: DataFrame, within: list[str], cells: int, salt: int, name: str) -> DataFrame:
    """Adds the 0-based rank of each row ``within`` its key, in a hash order:
    the counts of the cells before its own, and its place in the cell."""
    celled = rows.withColumn("cell", _cell("key", salt, cells))
    counts = written(celled.groupBy(*within, "cell").agg(F.count(F.lit(1)).alias("rows")), "cells")
    before = Window.partitionBy(*within).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select(*within, "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(*within, "cell").orderBy(splitmix(F.col("key"), salt), "key", "row"))
    return (celled.withColumn("inside", inside).join(written(start, "starts"), [*within, "cell"])
            .withColumn(name, F.col("start") + F.col("inside") - 1).drop("cell", "inside", "start"))


def _first_rows(applied: DataFrame, quota: DataFrame, cells: int) -> DataFrame:
    """Of each queue (``shard``, ``to``) the first ``moves`` rows: those of
    whole cells below the quota, and of the cell that crosses it the first by
    finer cells and then by rank. Cells follow the groups, so that movers of
    one group pass together."""
    queue = ["shard", "to"]
    rest = applied.join(F.broadcast(quota), queue)  # one row per two shards
    passed = None
    for level, cell in ((1, F.pmod(F.xxhash64(F.coalesce("g1", "key")), F.lit(cells)) + F.col("prio") * cells),
                        (2, _cell("key", 5, cells))):
        name = f"cell{level}"
        rest = written(rest.withColumn(name, cell), "queue")
        counts = rest.groupBy(*queue, name).agg(F.count(F.lit(1)).alias("rows"), F.max("moves").alias("moves"))
        before = Window.partitionBy(*queue).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        placed = written(counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
                         .where("before < moves")
                         .select(*queue, name, "before", (F.col("before") + F.col("rows") > F.col("moves")).alias("cut")),
                         "placed")
        joined = rest.join(placed, [*queue, name])
        whole = joined.where("not cut").select("row", "to")
        passed = whole if passed is None else passed.unionByName(whole)
        rest = joined.where("cut").withColumn("moves", F.col("moves") - F.col("before")).drop("before", "cut", name)
    place = F.row_number().over(Window.partitionBy(*queue).orderBy("key", "row"))
    return passed.unionByName(rest.withColumn("place", place).where("place <= moves").select("row", "to"))


def _keyed(rows: DataFrame, cells: int) -> DataFrame:
    """Adds ``key``, a hash of the id, the text's hashes and the row's number
    among equal rows. Equal rows may take their numbers in any order: what
    number goes to which makes no difference to the result."""
    equal = ["id", "h1", "h2"]
    twice = written(rows.groupBy(*equal).agg(F.count(F.lit(1)).alias("alike")).where("alike > 1"), "equal-rows")
    same = F.col("e.id").eqNullSafe(F.col("r.id")) & (F.col("e.h1") == F.col("r.h1")) & (F.col("e.h2") == F.col("r.h2"))
    repeated = rows.alias("r").join(twice.alias("e"), same).select(
        "r.row", F.col("r.row").alias("key"), F.xxhash64("r.h1", "r.h2", F.coalesce(F.col("r.id").cast("string"), F.lit("null"))).alias("of"))
    number = _ranked(repeated, ["of"], cells, 9, "number").select("row", "number")
    return (rows.join(number, "row", "left")
            .withColumn("key", F.xxhash64("id", "h1", "h2", F.coalesce("number", F.lit(0)))).drop("number"))


def propagate(rows: DataFrame, shards: int, cells: int, step: int) -> tuple[DataFrame, int]:
    """One round over ``rows(row, key, g1, g2, piece, shard)``, linked rows
    having a ``g1``: the rows, and how many linked ones wanted to move."""
    linked = rows.where("g1 is not null")
    free = rows.where("g1 is null").groupBy("shard").agg(F.count(F.lit(1)).alias("free"))
    here = linked.groupBy(*GROUP, "shard").agg(F.count(F.lit(1)).alias("members"))
    here = written(here, "members")
    size = here.groupBy(*GROUP).agg(F.sum("members").alias("size"))
    together = F.col("members") + F.least(F.coalesce("free", F.lit(0)), F.col("size") - F.col("members"))
    want = written(here.join(size, GROUP).join(F.broadcast(free), "shard", "left")  # one row per shard
                   .groupBy(*GROUP).agg(F.max(F.struct(
                       together.alias("together"), "members", F.xxhash64("g1", "piece", "shard").alias("tie"),
                       "shard"))["shard"].alias("to")), "wishes")
    movers = written(linked.join(want, GROUP).where("shard != to")
                     .select("row", "key", "g1", "shard", "to", F.lit(0).alias("prio")), "movers")
    wanting = movers.count()
    if not wanting:
        return rows, 0
    offers = rows.where("g1 is null").select(
        "row", "key", "g1", "shard",
        F.pmod(F.col("shard") + 1 + _cell("key", 11 + step, shards - 1), F.lit(shards)).cast("int").alias("to"),
        F.lit(1).alias("prio"))
    applied = movers.unionByName(offers)
    flow = written(applied.groupBy("shard", "to").agg(
        F.count(F.when(F.col("prio") == 0, 1)).alias("asked"), F.count(F.lit(1)).alias("able")), "flow")
    back = flow.select(F.col("shard").alias("to"), F.col("to").alias("shard"), F.col("asked").alias("asked_back"),
                       F.col("able").alias("able_back"))
    quota = (flow.join(F.broadcast(back), ["shard", "to"])  # one row per two shards
             .select("shard", "to", F.least(F.greatest("asked", "asked_back"), "able", "able_back").alias("moves"))
             .where("moves > 0"))
    moved = written(_first_rows(applied, written(quota, "quota"), cells), "moved")
    return rows.join(moved, "row", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), wanting


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
          rounds: int | None = None) -> DataFrame:
    """At most ``rounds`` rounds, by default as many as it takes. One row per input row: id, ``size``, ``text_crc32``, ``law``, ``shard``,
    ``slot`` (from 0 without gaps in each shard), ``grown_shard`` (null)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = written(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")), "shard-rows")
    total = base.count()
    cells = max(16, total // CELL)
    base = written(_keyed(base, cells), "keyed-rows")
    dealt = _ranked(base.select("row", "key", F.lit(0).alias("all")), ["all"], cells, 3, "rank").select(
        "row", "key", F.pmod("rank", F.lit(shards)).cast("int").alias("shard"))
    fits = max(2, total * 3 // (shards * 4))
    groups = written(base.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "groups")
    piece = _cell("key", 1, 1 << 30) % F.ceil(F.col("copies") / F.lit(fits))
    members = base.join(groups, ["h1", "h2"]).select(
        "row", F.col("h1").alias("g1"), F.col("h2").alias("g2"), piece.alias("piece"))
    rows = written(dealt.join(members, "row", "left"), "dealt")
    wanted: list[int] = []
    while shards > 1 and (rounds is None or len(wanted) < rounds):
        moved, wanting = propagate(rows, shards, max(16, cells // shards), len(wanted))
        if not wanting or len(wanted) >= STALE and wanting >= wanted[-STALE]:
            break
        wanted.append(wanting)
        rows = written(moved, "propagated")
    slots = _ranked(rows.select("row", "key", "shard"), ["shard"], max(4, cells // shards), 4, "slot")
    return base.join(slots, "row").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
