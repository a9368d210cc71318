"""MinHash near-deduplication with SuperMinHash signatures.

1. Every whole text becomes a set of word shingles. Rows with equal sets are
   one node, known by a 128-bit digest, so copies never meet as pairs.
2. SuperMinHash: element ranks are correlated through one permutation per
   element. Step j of all elements is drawn at once; the loop ends early as
   soon as no later rank can undercut the signature.
3. Banding: nodes that agree in one band share a bucket.
4. Verification on full sets, in rounds, grouping the nodes by the verified
   links after each. Round one compares each node with the least nodes of its
   buckets; round two, where buckets hold several groups, with one of about
   ``LEADERS`` hashed members a bucket, of another group. The nodes of buckets
   that even then hold several groups go through an exact similarity join with
   prefix and position filters, between groups only: of its pairs, round three
   verifies each node's likeliest in each other group, round four those that
   are still in different groups. So every link between two groups of a bucket
   is found, and members already united are not paired.
5. Union-find grouping (``components``).

Defined cases: a null, empty or blank text has an empty set and no links;
fewer words than the shingle width make one shingle; repeated rows and equal
texts share a component; a null id gets a result row and never is a
component's id unless all its ids are null; an empty table gives no rows;
other input columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingspark.llm.common import bounded_batches, released, thinned, written
from ratingspark.llm.components import components
from ratingspark.llm.shingles import U64, mix, shingle_set

BANDS, ROWS = 24, 4
LEADERS = 4


def superminhash(elements: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash signature of distinct 64-bit elements as ``size`` int32.
    Equal entries of two signatures estimate the Jaccard similarity."""
    best = np.full(size, U64(2**64 - 1))
    rows = np.arange(len(elements))
    perm = None
    for j in range(size):
        if j and int(best.max()) < (j << 32):
            break
        with np.errstate(over="ignore"):
            draw = mix(elements + U64((0x9E3779B97F4A7C15 * (j + 1)) & (2**64 - 1)))
        swap = (j + (draw & U64(0xFFFFFFFF)) % U64(size - j)).astype(np.int64)
        if j == 0:
            slot, first = swap, swap
        else:
            if perm is None:
                perm = np.tile(np.arange(size, dtype=np.uint8), (len(elements), 1))
                perm[rows, 0] = first
                perm[rows, first] = 0
            slot = perm[rows, swap]
            perm[rows, swap] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(best, slot, (draw >> U64(32)) | U64(j << 32))
    return ((best >> U64(32) << U64(25)) | ((best & U64(0xFFFFFFFF)) >> U64(7))).astype(np.uint32).view(np.int32)


def _signatures(width: int, size: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, nodes, sigs = [], [], []
            for text in batch.column(2):
                found = shingle_set(text.as_py(), width)
                counts.append(len(found))
                nodes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sigs.append(superminhash(found, size) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(sigs, pa.list_(pa.int32()))], names=["id", "row_key", "n_shingles", "node", "sig"])
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(text.as_py(), width) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()),
                 pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "hashes"])
    return run


def _linked(percent: int):
    """``a, b, x, y`` to the pairs ``a, b`` with 100 * intersection >= percent
    * union of the full sets x and y."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=U64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, hashes`` to one row per node and shingle, in blocks."""
    for batch in batches:
        for node, found in zip(batch.column(0), batch.column(1)):
            found = np.frombuffer(found.as_buffer(), dtype=np.int64)
            for at in range(0, len(found), 1 << 16):
                part = found[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node.as_py()] * len(part), pa.binary()), pa.array(part)], names=["node", "shingle"])


def row_key(id_col: str, text_col: str) -> F.Column:
    """Names a row by its id and a hash of its text, null-safely."""
    return F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), F.lit(":"),
                    F.hex(F.xxhash64(F.col(f"`{text_col}`"))))


def _pairs(rows: DataFrame, a: tuple[str, str], b: tuple[str, str], percent: int) -> DataFrame:
    """Distinct ordered pairs of nodes, less those whose set sizes rule a link
    out. ``a`` and ``b`` name each side's node and size."""
    one, two = (F.struct(F.col(x[0]).alias("node"), F.col(x[1]).alias("n")) for x in (a, b))
    return (rows.where(F.least(a[1], b[1]) * 100 >= F.greatest(a[1], b[1]) * percent)
            .select(F.least(one, two)["node"].alias("a"), F.greatest(one, two)["node"].alias("b")).distinct())


def _likeliest(met: DataFrame) -> DataFrame:
    """Of the leaders that a node meets, the one that it shares most buckets
    with."""
    shared = met.groupBy("node", "n", "leader", "leader_n").agg(F.count(F.lit(1)).alias("buckets"))
    best = shared.groupBy("node", "n").agg(F.max(F.struct("buckets", "leader", "leader_n")).alias("best"))
    return best.select("node", "n", "best.leader", "best.leader_n")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs, those linked by their full sets."""
    pairs = written(pairs, "pairs")
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return (pairs.join(thinned(left, "a", pairs), "a").join(thinned(right, "b", pairs), "b").select("a", "b", "x", "y")
            .mapInArrow(released(_linked(percent)), "a binary, b binary"))


def _near(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of ``nodes(node, root, n)`` with different roots whose full sets
    may be linked, with a bound ``reach`` of their intersection. By prefix and
    position filters, which lose none: with every set in one order, rarest
    shingles first, two linked sets share one of their first n - ceil(0.8 n) + 1,
    and what follows the first shared one is long enough for the rest."""
    found = written(thinned(sets, "node", nodes).join(nodes, "node").select("node", "hashes")
                    .mapInArrow(released(_elements), "node binary, shingle long"), "elements")
    holders = written(found.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "holders")
    # shingles of one holder come first in the order; their number is enough
    ranked = (thinned(found, "shingle", holders).join(holders, "shingle").groupBy("node")
              .agg(F.sort_array(F.collect_list(F.struct("holders", "shingle"))).alias("order")).join(nodes, "node")
              .withColumn("alone", F.col("n") - F.size("order")))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1 - F.col("alone")
    start = written(ranked.where(prefix > 0).select("node", "root", "n", "alone", F.posexplode(
        F.slice("order", F.lit(1), prefix.cast("int"))).alias("place", "first"))
        .select("first.shingle", "node", "root", "n", (F.col("alone") + F.col("place")).alias("at")), "prefixes")
    # of each shingle, only the rows outside its commonest root look for partners
    common = (start.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("rows"))
              .groupBy("shingle").agg(F.max(F.struct("rows", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
              .where("roots > 1").select("shingle", F.col("main.root").alias("main")))
    seek = written(start.join(written(common, "shared"), "shingle").where("root != main").select(
        "shingle", *[F.col(c).alias(f"other_{c}") for c in ("node", "root", "n", "at")]), "seekers")
    reach = F.least(F.col("n") - F.col("at"), F.col("other_n") - F.col("other_at"))
    met = start.join(seek, "shingle").where(
        (F.col("root") != F.col("other_root"))
        & (reach * (100 + percent) >= (F.col("n") + F.col("other_n")) * percent)
        & (F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * percent))
    return (met.groupBy("node", "n", "root", F.col("other_node").alias("other"), "other_n", "other_root")
            .agg(F.max(reach).alias("reach")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (least id
    reachable over links of at least ``percent`` similarity), ``kept``, and
    ``row_key`` naming the input row."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    sig_schema = T.StructType([T.StructField("id", id_type), T.StructField("row_key", T.StringType()),
                               T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()),
                               T.StructField("sig", T.ArrayType(T.IntegerType()))])
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(id_col, text_col).alias("row_key"),
                        F.col(f"`{text_col}`").alias("text"))
    signed = written(texts.mapInArrow(released(_signatures(width, bands * rows, id_type)), sig_schema), "signatures")

    banded = (signed.where("node is not null")
              .select("node", F.col("n_shingles").alias("n"), F.posexplode(F.expr(
                  f"transform(sequence(0, {bands - 1}), i -> xxhash64(i, slice(sig, i * {rows} + 1, {rows})))"))
                  .alias("band", "bucket")).select("bucket", "node", "n"))
    heads = written(banded.groupBy("bucket")
                    .agg(F.min(F.struct("node", "n")).alias("head"), F.max("node").alias("last"))
                    .where("head.node != last").select("bucket", F.col("head.node").alias("head"),
                                                       F.col("head.n").alias("head_n")), "buckets")
    members = written(thinned(banded, "bucket", heads).join(heads, "bucket").distinct(), "members")
    nodes = signed.join(members.select("node").distinct(), "node", "left_semi")
    wanted = written(nodes.groupBy("node").agg(F.min("row_key").alias("row_key")).select("row_key"), "wanted")
    sets = written(thinned(texts, "row_key", wanted).join(wanted, "row_key").select("text")
                   .mapInArrow(released(_sets(width)), "node binary, hashes binary")
                   .groupBy("node").agg(F.max("hashes").alias("hashes")), "sets")

    links, groups = None, None

    def settle(pairs: DataFrame) -> None:
        """Verifies candidate pairs and groups the nodes by all links so far."""
        nonlocal links, groups
        more = written(_verified(pairs, sets, percent), "links")
        if groups is None or not more.isEmpty():
            links = more if links is None else written(links.unionAll(more), "links")
            groups = components(links)

    def rooted(rows: DataFrame, node: str, root: str) -> DataFrame:
        of = groups.select(F.col("node").alias(node), F.col("root").alias("found root"))
        return rows.join(of, node, "left").withColumn(root, F.coalesce("found root", node)).drop("found root")

    def unsettled() -> DataFrame:
        """The members of buckets that hold several groups, with their roots."""
        rows = rooted(members.select("bucket", "node", "n"), "node", "root")
        apart = written(rows.groupBy("bucket").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
            .where("low != high").select("bucket", "size"), "open")
        return written(rows.join(apart, "bucket"), "apart")

    settle(_pairs(members.where("node != head"), ("node", "n"), ("head", "head_n"), percent))
    rows = unsettled()
    place = F.pmod(F.xxhash64("node", "bucket"), F.lit(1 << 20)) * F.col("size") / F.lit(1 << 20)
    lead = rows.where(place < LEADERS).select("bucket", F.col("node").alias("leader"), F.col("root").alias("led"),
                                              F.col("n").alias("leader_n"))
    settle(_pairs(_likeliest(rows.join(lead, "bucket").where("root != led")), ("node", "n"), ("leader", "leader_n"),
                  percent))
    near = written(_near(written(unsettled().select("node", "root", "n").distinct(), "unsettled"), sets, percent), "near")
    best = near.groupBy("other", "other_n", "root").agg(F.max(F.struct("reach", "node", "n")).alias("best"))
    settle(_pairs(best.select("other", "other_n", "best.node", "best.n"), ("node", "n"), ("other", "other_n"), percent))
    still = rooted(rooted(near.drop("root", "other_root"), "node", "root"), "other", "other_root")
    settle(_pairs(still.where("root != other_root"), ("node", "n"), ("other", "other_n"), percent))

    labelled = signed.drop("sig").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = written(labelled.where("root is not null").groupBy("root").agg(F.min("id").alias("component")), "least")
    return labelled.join(least, "root", "left").select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
        F.when(F.col("root").isNull(), F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("component"))).alias("kept"),
        "row_key")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows less all but one document of each near-duplicate group;
    of rows equal in id and text one stays."""
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select("row_key").distinct()
    return (docs.withColumn("row_key", row_key(id_col, text_col)).join(kept, "row_key", "left_semi")
            .dropDuplicates(["row_key"]).drop("row_key"))
