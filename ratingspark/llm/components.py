"""Connected components of a link table by union-find and contraction.

Each partition first unites its links with a union-find forest and passes on
one link per node instead of all. Then rounds of Spark joins contract the
rest: every node takes its least neighbour as parent, links move to the
parents, links inside one parent vanish. No link set, component or node table
is ever gathered in one task or on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingspark.llm.common import written

FOREST_LINKS = 200_000


def _forest(links: dict) -> list[tuple]:
    return [(node, root) for node in list(links) if (root := _find(links, node)) != node]


def _find(parent: dict, node):
    root = node
    while parent.setdefault(root, root) != root:
        root = parent[root]
    while parent[node] != root:
        parent[node], node = root, parent[node]
    return root


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links in, at most one link per node out; memory is bounded by starting a
    new forest after ``FOREST_LINKS`` links."""
    parent: dict = {}
    held, schema = 0, None

    def emit():
        rows = _forest(parent)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], type=schema.field(k).type) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = _find(parent, a), _find(parent, b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        held += batch.num_rows
        if held >= FOREST_LINKS:
            yield emit()
            parent.clear()
            held = 0
    if schema is not None and parent:
        yield emit()


def _united(links: DataFrame) -> DataFrame:
    return links.select("a", "b").mapInArrow(_unite, links.select("a", "b").schema)


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, root)``: one row per linked node, equal roots
    exactly for nodes joined by a path. No links give no rows; repeated and
    self links are allowed; a null end links nothing."""
    kind = links.schema["a"].dataType
    links = written(_united(links.where("a != b")).distinct(), "forest")
    labels = None
    while not links.isEmpty():
        ends = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                       .select("node", F.least("node", "low").alias("parent")), "parents")
        up_a = step.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        up_b = step.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = (links.join(up_a, "a").join(up_b, "b").where("pa != pb")
                 .select(F.col("pa").alias("a"), F.col("pb").alias("b")))
        links = written(_united(moved).distinct(), "contracted")
        if labels is None:
            labels = step.select("node", F.col("parent").alias("root"))
        else:
            up = step.select(F.col("node").alias("root"), F.col("parent").alias("higher"))
            labels = written(labels.join(up, "root", "left")
                             .select("node", F.coalesce("higher", "root").alias("root")), "labels")
    if labels is None:
        return links.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("root"))
    return labels
