"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the ``K`` least distinct 48-bit shingle hashes, ascending. The
sketch of joined parts is the bottom k of their sketches (``merge``), and two
sketches give estimates of resemblance, containment and distinct shingles. The
fingerprint string is the base64 of the hashes, six bytes each, big-endian.

``edited_fingerprints`` also fingerprints each text with its last half
replaced by the start of the next document's. Documents are dealt into ranges
of ids; the first row of a range also goes to the range before it, so every
row meets its follower inside one stream and the text is shuffled once.

Defined cases: a null text is the empty one, with the empty sketch and
fingerprint; two empty sketches have likeness 1, an empty and a full one 0;
fewer words than a shingle make one shingle; null ids come before all others;
rows with equal ids follow each other in the order of their text's hash; a
single row is its own follower; an empty table gives no rows; other columns
are ignored."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingspark.llm.shingles import U64, shingle_hashes, word_hashes

K = 128
WIDTH = 5
#: Bytes of text that one range of ids should hold.
RANGE_BYTES = 16 << 20


def sketch(text: str | None, k: int = K, width: int = WIDTH) -> np.ndarray:
    """The k least distinct shingle hashes of a text, ascending."""
    found = shingle_hashes(word_hashes((text or "").encode("utf-8")), width) >> U64(16)
    if len(found) > 4 * k:  # most hashes cannot be among the k least
        for reach in (4 * k, 32 * k):
            low = np.unique(found[found <= np.partition(found, reach)[reach]]) if len(found) > reach else []
            if len(low) >= k:
                return low[:k]
    return np.unique(found)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity (1 for two empty sketches)."""
    least = merge(a, b, k)
    if not len(least):
        return 1.0
    return float(np.count_nonzero(np.isin(least, a, assume_unique=True) & np.isin(least, b, assume_unique=True))
                 / len(least))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((int(a[k - 1]) + 1) / 2.0**48)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds (1 for an empty a)."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def to_string(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode("ascii")


def from_string(s: str) -> np.ndarray:
    six = np.frombuffer(base64.b64decode(s), dtype=np.uint8).reshape(-1, 6)
    return np.pad(six, ((0, 0), (2, 0))).copy().view(">u8").reshape(-1).astype(U64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                 width: int = WIDTH) -> DataFrame:
    """id, ``fingerprint`` and the estimated ``n_shingles`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t.as_py(), k, width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(to_string, found), pa.string()),
                 pa.array([distinct(x, k) for x in found], pa.float64())], names=["id", "fingerprint", "n_shingles"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("fingerprint", T.StringType()), T.StructField("n_shingles", T.DoubleType())])
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def _follow(k: int, width: int):
    """Rows of a partition ordered by range, id and hash; each row is joined to
    the next of its range, the copied first row of the next range being last."""
    def row(batch: pa.RecordBatch, at: int) -> dict:
        text = batch.column("text")[at].as_py() or ""
        return {"range": batch.column("range")[at].as_py(), "copied": batch.column("copied")[at].as_py(),
                "id": batch.column("id")[at].as_py(), "text": text, "sketch": sketch(text, k, width)}

    def result(this: dict, after: dict) -> tuple:
        text = this["text"]
        half = len(text) // 2
        edited = text[:len(text) - half] + after["text"][:half]
        new = sketch(edited, k, width)
        return (this["id"], len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), to_string(this["sketch"]),
                to_string(new), resemblance(this["sketch"], new, k), resemblance(this["sketch"], after["sketch"], k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = None, None
        for batch in batches:
            schema = schema or pa.schema([
                ("id", batch.schema.field("id").type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                ("near_edited", pa.float64()), ("near_next", pa.float64())])
            out = []
            for at in range(batch.num_rows):
                now = row(batch, at)
                if held is not None and held["range"] == now["range"]:
                    out.append(result(held, now))
                held = None if now["copied"] else now
            columns = list(zip(*out)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return run


def _ranges(rows: DataFrame) -> tuple[list, int]:
    """The bounds between ranges of ids, quantiles of about ``RANGE_BYTES``
    each: one number per range reaches the driver."""
    total = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count("id").alias("n")).first()
    n = max(1, int((total["b"] or 0) // RANGE_BYTES) + 1)
    if n == 1 or not total["n"]:
        return [], 1
    points = [k / n for k in range(1, n)]
    bounds = rows.agg(F.percentile_approx("id", points, 100 * n).alias("q")).first()["q"]
    return sorted(set(bounds)), len(set(bounds)) + 1


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                        width: int = WIDTH) -> DataFrame:
    """Of every row: ``n_chars``, its fingerprint, the SHA-256 and fingerprint
    of its edited text, and the likeness of its fingerprint to the edited
    text's and to the next document's. Ids must be integers."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    bounds, n = _ranges(rows)

    def place(ids: pd.Series) -> pd.Series:
        found = np.searchsorted(np.array(bounds, dtype=np.int64), ids.fillna(-2**63).to_numpy(np.int64), side="right")
        return pd.Series(found.astype(np.int32))

    ranged = rows.withColumn("range", F.pandas_udf(place, "int")("id")) if bounds else rows.withColumn("range", F.lit(0))
    ranged = ranged.withColumn("tie", F.xxhash64("text"))
    # the first row of each range: at most one per range reaches the driver
    order = F.struct(F.col("id").isNotNull().alias("known"), F.col("id").alias("id"), F.col("tie").alias("tie"))
    firsts = ranged.groupBy("range").agg(F.min(order).alias("first")).orderBy("range").collect()
    filled = [r["range"] for r in firsts]
    spark = docs.sparkSession
    copies = spark.createDataFrame(
        [(r["first"]["id"], r["first"]["tie"], filled[at - 1]) for at, r in enumerate(firsts)],
        "first_id long, first_tie long, also int")
    heads = (rows.withColumn("tie", F.xxhash64("text"))
             .join(F.broadcast(copies), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")))
             .dropDuplicates(["also"]).select("id", "text", F.col("also").alias("range"), "tie",
                                              F.lit(True).alias("copied")))
    dealt = (ranged.select("id", "text", "range", "tie", F.lit(False).alias("copied")).unionByName(heads)
             .repartitionById(n, F.col("range"))
             .sortWithinPartitions("range", "copied", F.col("id").asc_nulls_first(), "tie"))
    schema = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return (dealt.select("range", "copied", "id", "text").mapInArrow(_follow(k, width), schema)
            .withColumnRenamed("id", id_col))
