"""What the operators share: Arrow batches, shared scratch tables, small helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of strings and binaries, that an operator works on at a time in Python. What Spark sends at
#: once is bounded by the same while a table is stored, and else by spark.sql.execution.arrow.maxBytesPerBatch
#: (64 MB unless set); so a worker's memory is bounded by these and by the longest text.
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20
#: Spark's setting by which the shuffle files of a finished query go at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most rows rows and, but for single longer rows, size bytes of text."""
    for batch in batches:
        total = np.zeros(batch.num_rows, np.int64)
        for col in batch.columns:
            if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
                total += pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(total), 0
        while at < batch.num_rows:
            most = (ends[at - 1] if at else 0) + size
            end = min(at + rows, max(at + 1, int(np.searchsorted(ends, most, side="right"))))
            yield batch.slice(at, end - at)
            at = end


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in pieces small enough for long texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(pieces(batches))

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one of our own on
    a local master, as in tests; on a cluster that is an error, since executors could not see it."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if not at.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skeinlog-"))
        at = sc._jsc.sc().getCheckpointDir()
    return at.get()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Has Spark send Python no more at once than an operator works on, and delete the shuffles of a query when it ends,
    not when the driver happens to collect its garbage; the session's own settings come back after."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k) for k in (*limits, CLEANUP)}
    try:
        for k, most in limits.items():
            now = int(before[k].rstrip("b"))
            spark.conf.set(k, str(most if now <= 0 else min(now, most)))
        spark.conf.set(CLEANUP, "true")
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def store(df: DataFrame, **options: str | int) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it again. The table is deleted by
    drop_stored(), or else when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skeinlog-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.options(**options).parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Has a folder that exists deleted when the application ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def drop_stored(df: DataFrame) -> None:
    """Deletes what store() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def same_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns called names only, so that extra columns of the caller cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids count as fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


MASK_BITS = 24


def flag_likely(df: DataFrame, key: Column, keys: DataFrame, keys_key: Column, flag: str, bits: int = MASK_BITS) -> DataFrame:
    """df with flag: false only where key is surely not among keys, and true for few other rows.

    A mask of 2 ** bits bits is filled with the hashes of keys; it has 2 ** (bits - 6) rows of 64 bits at
    most, whatever the number of keys, and so is broadcast. A full mask flags every row. It spares rows
    that a join would drop, or leave as they are, from being shuffled for it."""
    at, word, mask = (fresh(df, c) for c in ("_at", "_word", "_mask"))

    def bit(at: str) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(at).bitwiseAND(F.lit(63)).cast("int"))

    filled = keys.select(F.pmod(keys_key, F.lit(1 << bits)).alias(at)).select(F.shiftright(at, 6).alias(word), bit(at).alias("bit")).groupBy(word).agg(F.bit_or("bit").alias(mask))
    rows = df.withColumn(at, F.pmod(key, F.lit(1 << bits))).join(F.broadcast(filled), F.shiftright(at, 6) == F.col(word), "left")
    return rows.withColumn(flag, F.coalesce(F.col(mask), F.lit(0)).bitwiseAND(bit(at)) != 0).drop(at, word, mask)
