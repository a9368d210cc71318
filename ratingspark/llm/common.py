"""Helpers shared by the training-data operators: scratch tables in the
cluster's shared folder and column helpers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHECKPOINT_KEY = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only a session on
    a local master may lack the setting; it then gets a temporary folder."""
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "") or ""):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ratingspark-llm-")
        spark.conf.set(CHECKPOINT_KEY, folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back. Cuts
    lineage: a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of rows of the driver. They go as Arrow: as pickled rows they
    would start a second pool of Python workers on every executor."""
    struct = T.StructType.fromDDL(schema)
    names = struct.fieldNames()
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, r)) for r in rows], to_arrow_schema(struct)), struct)


ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows and bytes that travel to a Python worker at once, unless the session says otherwise.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts are far larger than Spark's default of 10,000 rows a batch
    allows for; bounds rows and bytes in sessions that have not set their own."""
    if spark.conf.get(ROWS_KEY, None) is None:
        spark.conf.set(ROWS_KEY, str(BATCH_ROWS))
    if int(spark.conf.get(BYTES_KEY, None) or -1) in (-1, 2**63 - 1, 2**31 - 1):
        spark.conf.set(BYTES_KEY, str(BATCH_BYTES))


def splitmix(c: Column, salt: int) -> Column:
    """A 64-bit hash of a column, different for each salt."""
    return F.xxhash64(c, F.lit(salt))


def give_back() -> None:
    """Gives the memory that this Python worker no longer uses back to the
    system: Spark keeps the worker for the stages that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def released(run):
    """A batch function that gives back memory at its end."""
    def wrapped(batches):
        yield from run(batches)
        give_back()
    return wrapped


#: Bits of the map that ``thinned`` builds: at most 512 rows of 4 KB.
MAP_BITS = 1 << 24


def _marked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Adds ``map found``: false only where no row of ``wanted`` has the key."""
    slot = F.pmod(F.xxhash64(key), F.lit(MAP_BITS)) + 1
    bits = wanted.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("map bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("map bits"))
    place = "bitmap_bit_position(`map slot`)"
    found = f"shiftright(int(conv(hex(substring(`map bits`, int({place} / 8) + 1, 1)), 16, 10)), int({place} % 8)) & 1 = 1"
    return (rows.withColumn("map slot", slot).withColumn("map bucket", F.bitmap_bucket_number("map slot"))
            .join(F.broadcast(bits), "map bucket", "left")
            .withColumn("map found", F.coalesce(F.expr(found), F.lit(False))))


def thinned(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Drops rows that an equi-join with ``wanted`` on ``key`` would drop, by a
    bitmap of hashed keys, before they are shuffled. The map's size is fixed:
    with very many keys it lets more rows pass, and the join still decides. Follow
    it by an inner join: the optimizer would move a semi-join before the map."""
    return _marked(rows, key, wanted).where("`map found`").select(*[f"`{c}`" for c in rows.columns])


def split_by(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that may have their key in ``wanted``, and those that have not."""
    marked, columns = _marked(rows, key, wanted), [f"`{c}`" for c in rows.columns]
    return marked.where("`map found`").select(*columns), marked.where("not `map found`").select(*columns)
