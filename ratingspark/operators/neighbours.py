"""Exact nearest neighbours (J8) as a join over the cells of a k-d tree.

Rows with equal vectors of a class are one *group*, which is searched once and
known by its k + 1 smallest keys: no row has more neighbours in it. Every class
is cut into cells of about ``CELL`` groups by the medians of at most ``SAMPLE``
groups; a cell is known by the box around its members. Equal cells cannot grow
without bound: one of more than two ``CELL`` is cut by hash into chunks. Two passes:

1. Each chunk answers for its own groups. The k-th distance found bounds the
   group's search radius.
2. A group visits another chunk only if the box of its cell is as near as the
   radius. The visitors of a chunk come in pieces of ``VISITORS``.

In a task both sides are cut again, into leaves of ``LEAF`` vectors with boxes
of their own, and the leaves that the radius reaches are compared, the nearest
first. A matrix product, exact to a known rounding, passes over most pairs; the
distances of the others are added up dimension by dimension, so the result is
that of all pairs. A box's distance is rounded as its members' are and never
exceeds theirs.

A chunk sends at most k groups for each visitor; no pairs are emitted. The best
k rows are the result: equal distances in the order of the keys.

How far the boxes prune depends on the data's dimension; the result does not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingspark.session import materialize

CELL, LEAF, VISITORS, SAMPLE = 16_384, 256, 32_768, 20_000
#: Cells of one class at most: their boxes travel to the driver and to every task.
PIVOTS = 1024
#: Relative rounding of a squared distance taken from a matrix product, with room to spare.
ROUNDING = 1e-12


def cuts(x: np.ndarray, parts: int) -> list[tuple[int, float, int, int]]:
    """A k-d tree over ``x`` as nodes ``(dimension, last value to the left, left,
    right)``, children below 0 being the cells -1 - child; the first is the root.
    No node if there is a single cell."""
    nodes: list[tuple[int, float, int, int]] = []
    cells = 0

    def grow(own: np.ndarray, parts: int) -> int:
        nonlocal cells
        if parts > 1 and len(own) > 1:
            f = int(x[own].std(0).argmax())
            values = np.sort(x[own, f])
            at = values[max(0, len(own) * (parts // 2) // parts - 1)]
            if at == values[-1]:  # the last value must have a right side
                at = values[max(0, np.searchsorted(values, at) - 1)]
            if at < values[-1]:
                here, left = len(nodes), x[own, f] <= at
                nodes.append((f, float(at), 0, 0))
                children = grow(own[left], parts // 2), grow(own[~left], parts - parts // 2)
                nodes[here] = (f, float(at), *children)
                return here
        cells += 1
        return -cells

    grow(np.arange(len(x)), parts)
    return nodes


def cell_of(x: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The cell of each row."""
    if not nodes:
        return np.zeros(len(x), np.int32)
    feature, at, left, right = (np.array(c) for c in zip(*nodes))
    node = np.zeros(len(x), np.int64)
    while len(moving := np.flatnonzero(node >= 0)):
        here = node[moving]
        node[moving] = np.where(x[moving, feature[here]] <= at[here], left[here], right[here])
    return (-1 - node).astype(np.int32)


def gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each box."""
    total = np.zeros((len(x), len(low)))
    for v, a, b in zip(x.T, low.T, high.T):
        gap = np.maximum(a[None, :] - v[:, None], v[:, None] - b[None, :])
        total += np.maximum(gap, 0.0) ** 2
    return total


def _leaves(x: np.ndarray, size: int) -> list[np.ndarray]:
    todo, out = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        half = np.argpartition(x[own, x[own].std(0).argmax()], len(own) // 2)
        todo += [own[half[len(own) // 2:]], own[half[:len(own) // 2]]]
    return out


def best(x: np.ndarray, ids: np.ndarray, limit: np.ndarray, y: np.ndarray, hosts: np.ndarray, k: int,
         leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """``(squared distances, places)`` of the k nearest rows of ``y`` to each row
    of ``x`` that are no farther than its ``limit``, itself (by id) left out;
    equal distances in the order of ``y``; infinity and -1 where there are fewer.
    ``limit`` becomes the k-th distance found."""
    found, place = np.full((len(x), k), np.inf), np.full((len(x), k), -1)
    if not len(x) or not len(y):
        return found, place
    middle = y.mean(0)
    blocks = _leaves(y, leaf)
    low, high = np.stack([y[b].min(0) for b in blocks]), np.stack([y[b].max(0) for b in blocks])
    shifted = [y[b] - middle for b in blocks]
    lengths = [(s ** 2).sum(1) for s in shifted]
    for own in _leaves(x, leaf):
        mine, far, dist, at = x[own], limit[own], found[own], place[own]
        near = gaps(mine, low, high)
        moved = mine - middle
        length = (moved ** 2).sum(1)
        for b in np.argsort(near.mean(0), kind="stable"):
            go = np.flatnonzero(near[:, b] <= far)
            if not len(go):
                continue
            rough = length[go, None] + lengths[b][None, :] - 2 * (moved[go] @ shifted[b].T)
            rough[ids[own[go]][:, None] == hosts[blocks[b]][None, :]] = np.inf
            most = far[go]
            if np.isinf(most).any() and rough.shape[1] > k:
                most = np.minimum(most, np.partition(rough, k - 1, axis=1)[:, k - 1])
            slack = ROUNDING * (length[go] + lengths[b].max())
            row, col = np.nonzero((rough <= (most + slack)[:, None]) & np.isfinite(rough))
            if not len(row):
                continue
            row, to = go[row], blocks[b][col]
            exact = np.zeros(len(row))
            for f in range(x.shape[1]):
                exact += (mine[row, f] - y[to, f]) ** 2
            inside = exact <= far[row]
            row, to, exact = row[inside], to[inside], exact[inside]
            touched = np.unique(row)
            if not len(touched):
                continue
            row = np.concatenate([np.repeat(touched, k), row])
            exact, to = np.concatenate([dist[touched].ravel(), exact]), np.concatenate([at[touched].ravel(), to])
            order = np.lexsort((to, exact, row))
            row, exact, to = row[order], exact[order], to[order]
            first = np.searchsorted(row, touched)
            kept = first[:, None] + np.arange(k)
            dist[touched], at[touched] = exact[kept], to[kept]
            far[touched] = np.minimum(far[touched], dist[touched, k - 1])
        found[own], place[own], limit[own] = dist, at, far
    return found, place


def _matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _by_class(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    codes = batch.column("class").dictionary_encode()
    at = codes.indices.to_numpy()
    for n, name in enumerate(codes.dictionary.to_pylist()):
        yield name, np.flatnonzero(at == n)


def nearest(rows: DataFrame, k: int, key: str = "key", vector: str = "vector", label: str | None = "label",
            cell: int = CELL, pivots: int = PIVOTS) -> DataFrame:
    """``key, rank, neighbour, distance`` (Euclidean): the k nearest other rows
    of the same ``label`` (of all rows without one), fewer where the class is
    smaller. Keys are unique and not null; rows without label or vector, or
    with a null or non-finite component, have no neighbours and are none."""
    key_type, spark = rows.schema[key].dataType, rows.sparkSession
    values = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda x: x + F.lit(0.0))  # no -0.0
    usable = "class is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))"
    base = materialize(
        rows.select(F.col(f"`{key}`").alias("key"),
                    (F.lit("") if label is None else F.col(f"`{label}`").cast("string")).alias("class"),
                    values.alias("v")).where(usable).withColumn("row", F.monotonically_increasing_id()), "neighbour-rows")

    # groups of equal vectors: each row learns its group, the first one the smallest keys
    same = Window.partitionBy("class", "v").orderBy("key", "row")
    members = materialize(base.select(
        "class", "v", "key", "row", F.row_number().over(same).alias("place"), F.first("row").over(same).alias("group"),
        F.collect_list("key").over(same.rowsBetween(0, k)).alias("keys")).select(
        "key", "row", "group", *[F.when(F.col("place") == 1, F.col(c)).alias(c) for c in ("class", "v", "keys")]),
        "neighbour-members")
    groups = members.where("keys is not null").select("group", "class", "v", "keys")
    sizes = {r["class"]: r["n"] for r in groups.groupBy("class").agg(F.count("*").alias("n")).collect()}  # one row per class
    if not sizes:
        return spark.createDataFrame([], T.StructType([
            T.StructField("key", key_type), T.StructField("rank", T.IntegerType()),
            T.StructField("neighbour", key_type), T.StructField("distance", T.DoubleType())]))
    wanted = {c: min(pivots, -(-n // cell)) for c, n in sizes.items()}
    width = groups.select(F.max(F.size("v"))).first()[0]

    # the cells: medians of rows by hash, then the boxes of all members
    share = F.create_map(*[F.lit(x) for c, n in sizes.items() if wanted[c] > 1 for x in (c, min(1.0, SAMPLE / n))] or [
        F.lit(""), F.lit(0.0)])
    drawn: dict[str, list] = {}
    for r in groups.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.coalesce(share[F.col("class")], F.lit(0.0)) * (1 << 30)).select(
            "class", "v").collect():
        drawn.setdefault(r["class"], []).append(r["v"])
    trees = {c: cuts(np.array(drawn[c]), n) if c in drawn else [] for c, n in wanted.items()}
    shared = spark.sparkContext.broadcast(trees)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _matrix(batch.column("v"), width), np.zeros(batch.num_rows, np.int32)
            for c, own in _by_class(batch):
                at[own] = cell_of(x[own], shared.value[c])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "cell"])

    assigned = materialize(groups.mapInArrow(assign, T.StructType([*groups.schema.fields, T.StructField("cell", T.IntegerType())])),
                           "neighbour-cells")
    cells = materialize(assigned.groupBy("class", "cell").agg(
        F.count("*").alias("n"), F.array(*[F.min(F.col("v")[f]) for f in range(width)]).alias("low"),
        F.array(*[F.max(F.col("v")[f]) for f in range(width)]).alias("high")).withColumn(
        "chunks", F.when(F.col("n") <= 2 * cell, 1).otherwise(F.ceil(F.col("n") / cell)).cast("int")), "neighbour-extents")
    boxes: dict[str, list] = {}
    for r in cells.orderBy("class", "cell").collect():  # at most PIVOTS rows of a class
        boxes.setdefault(r["class"], []).append(r)
    shared_boxes = spark.sparkContext.broadcast({c: (
        [(r["cell"], r["chunks"]) for r in own], np.array([r["low"] for r in own]), np.array([r["high"] for r in own]))
        for c, own in boxes.items()})
    chunked = materialize(
        assigned.join(F.broadcast(cells.select("class", "cell", "chunks")), ["class", "cell"])  # the same bound
        .withColumn("chunk", F.pmod(F.xxhash64("group"), F.col("chunks")).cast("int")).drop("chunks"), "neighbour-chunks")

    # first pass: a group's own chunk
    near_type = "group long, other long, d double"

    def sent(ids: np.ndarray, found: np.ndarray, place: np.ndarray, hosts: np.ndarray) -> pa.Table:
        row, at = np.nonzero(place >= 0)
        return pa.table({"group": ids[row], "other": hosts[place[row, at]], "d": found[row, at]})

    def sides(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return part.column("group").to_numpy(), _matrix(part.column("v"), width)

    def own_chunk(part: pa.Table) -> pa.Table:
        part = part.sort_by("first")
        ids, x = sides(part)
        # k rows of its own vector leave no room for others farther than nothing
        limit = np.where(part.column("copies").to_numpy() > k, 0.0, np.inf)
        found, place = best(x, ids, limit, x, ids, k)
        held = pa.array([o[p >= 0].tolist() for o, p in zip(ids[place], place)], pa.list_(pa.int64()))
        far = pa.array([f[p >= 0].tolist() for f, p in zip(found, place)], pa.list_(pa.float64()))
        return pa.table([part.column("group"), part.column("class"), part.column("v"), part.column("cell"),
                         part.column("chunk"), pa.array(limit), held, far],
                        names=["group", "class", "v", "cell", "chunk", "reach", "others", "ds"])

    hosts = chunked.select("group", "class", "v", "cell", "chunk", F.col("keys")[0].alias("first"), F.size("keys").alias("copies"))
    first = materialize(hosts.groupBy("class", "cell", "chunk").applyInArrow(
        own_chunk, "group long, class string, v array<double>, cell int, chunk int, reach double, others array<long>, "
                   "ds array<double>"), "neighbour-first")

    # second pass: the chunks that can hold something as near
    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, reach = _matrix(batch.column("v"), width), batch.column("reach").to_numpy()
            cell_at, chunk_at = batch.column("cell").to_numpy(), batch.column("chunk").to_numpy()
            for c, own in _by_class(batch):
                targets, low, high = shared_boxes.value[c]
                close = gaps(x[own], low, high) <= reach[own, None]
                for n, (target, chunks) in enumerate(targets):
                    for chunk in range(chunks):
                        at = own[close[:, n] & ~((cell_at[own] == target) & (chunk_at[own] == chunk))]
                        if len(at):
                            picked = pa.array(at)
                            yield pa.RecordBatch.from_arrays(
                                [batch.column(f).take(picked) for f in ("group", "class", "v", "reach")]
                                + [pa.array(np.full(len(at), t, np.int32)) for t in (target, chunk)],
                                names=["group", "class", "v", "reach", "cell", "chunk"])

    target = ["class", "cell", "chunk"]
    visiting = materialize(first.select("group", "class", "v", "cell", "chunk", "reach").mapInArrow(
        visits, "group long, class string, v array<double>, reach double, cell int, chunk int"), "neighbour-visits")
    pieces = visiting.groupBy(*target).agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("pieces"))
    visited = (hosts.join(pieces, target).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
               .select(*target, "piece", "group", "v", "first"))
    visitors = visiting.join(pieces, target).withColumn(
        "piece", F.pmod(F.xxhash64("group", F.lit(1)), F.col("pieces")).cast("int")).select(*target, "piece", "group", "v", "reach")

    def chunk_visited(guests: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("first")
        ids, x = sides(guests)
        there, y = sides(own)
        found, place = best(x, ids, guests.column("reach").to_numpy().copy(), y, there, k)
        return sent(ids, found, place, there)

    on = [*target, "piece"]
    second = visitors.groupBy(*on).cogroup(visited.groupBy(*on)).applyInArrow(chunk_visited, near_type)
    pairs = first.select("group", F.explode(F.arrays_zip("others", "ds")).alias("p")).select(
        "group", F.col("p.others").alias("other"), F.col("p.ds").alias("d")).unionByName(second)

    # the keys of the groups found, and of the own group: k + 1 rows answer for all members
    keys = groups.select(F.col("group").alias("other"), "keys")
    spread = lambda d: F.transform("keys", lambda n: F.struct(d.alias("distance"), n.alias("neighbour")))
    some = (pairs.join(keys, "other").select("group", spread(F.col("d")).alias("near"))
            .unionByName(groups.select("group", spread(F.lit(0.0)).alias("near"))))
    answers = some.groupBy("group").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    others = F.slice(F.filter("near", lambda n: n["neighbour"] != F.col("key")), 1, k)
    return (members.select("key", "group").join(answers, "group").select("key", F.posexplode(others).alias("at", "n"))
            .select("key", (F.col("at") + 1).alias("rank"), F.col("n.neighbour").alias("neighbour"),
                    F.sqrt("n.distance").alias("distance")))
