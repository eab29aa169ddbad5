"""Digests of transcripts as they arrive: an extension of ours, in Structured Streaming.

New files are read line by line (the source's own log says which are new) and turned into session heads, a
folder for each batch. A file that has grown since is read again by refresh(), as a whole; of the heads of one
path those of its last time of modification count. compact() merges the batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import transcripts

HEADS = ("first_prompt", "last_prompt", "last_message")
FILES = {"recursiveFileLookup": True, "pathGlobFilter": "*.jsonl"}


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines of files, as a scan gives them."""
    return transcripts.scanned(spark.readStream.options(**FILES).option("lineSep", "\n").text(folder))


def heads(steps: DataFrame) -> DataFrame:
    """path, modified, counts, and (place, text) of first and last values."""
    at = F.struct("line_no", "block_no", "text")
    user, said = F.col("kind") == "user", F.col("kind").isin("assistant", "final")
    return steps.groupBy("path").agg(F.max("modified").alias("modified"), F.count_if(user).alias("prompt_count"), F.min(F.when(user, at)).alias("first_prompt"), F.max(F.when(user, at)).alias("last_prompt"), F.max(F.when(said, at)).alias("last_message"))


def heads_of(lines: DataFrame, dialect: str) -> DataFrame:
    return heads(transcripts.finished(transcripts.DIALECTS[dialect](lines).repartition("path")))


def run(spark: SparkSession, folder: str, dialect: str, out: str, checkpoint: str) -> StreamingQuery:
    """Processes what is there and ends; each batch's heads are a folder of their own under out, so a batch that
    is repeated after a failure replaces itself."""
    def batch(lines: DataFrame, number: int) -> None:
        heads_of(transcripts.lines_of(lines), dialect).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return line_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(rows: DataFrame) -> DataFrame:
    """The heads of each path's last time of modification."""
    names = [c for c in rows.columns if c not in ("path", "batch")]
    rows = rows.groupBy("path").agg(F.max_by(F.struct(*names), F.struct("modified", F.col("batch").cast("string"))).alias("h"))
    return rows.select("path", "h.*")


def refresh(spark: SparkSession, folder: str, dialect: str, out: str) -> int:
    """Reads those stored files again that were modified since; how many there were."""
    files = spark.read.format("binaryFile").options(**FILES).load(folder)  # a listing: contents are not read
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("now"))
    known = newest(spark.read.parquet(out)).select("path", "modified")
    grown = [r["path"] for r in files.join(known, "path").filter("now > modified").select("path").toLocalIterator()]
    if grown:
        heads_of(transcripts.raw_lines(spark, grown), dialect).write.parquet(f"{out}/batch=refresh-{uuid.uuid4().hex}")
    return len(grown)


def compact(spark: SparkSession, out: str) -> None:
    """Merges all batches into one. What is merged is written before anything is deleted; until then it is there
    twice, which changes nothing."""
    root = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("batch=")]
    newest(spark.read.parquet(out)).write.parquet(f"{out}/batch=merged-{uuid.uuid4().hex}")
    for path in old:
        fs.delete(path, True)


def read(spark: SparkSession, out: str) -> DataFrame:
    """Digest heads of all paths; paths without a prompt are no sessions."""
    done = newest(spark.read.parquet(out)).filter("prompt_count > 0")
    return done.select("path", F.col("prompt_count").cast("int").alias("prompt_count"), *[F.col(f"{k}.text").alias(k) for k in HEADS])
