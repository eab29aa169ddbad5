"""Line dedup: lines that many documents share go, except in one document.

A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased. Lines are
exploded to (128-bit hash of the key, document, position) without their text, documents are counted
per hash, and only the positions to drop travel back to the texts, which are reassembled by position.

The first count per hash is of lines, with partial sums before the shuffle, so a line that a third
of the documents hold costs a row per task. Only lines under hashes that reach the threshold are
counted by distinct document. Joins on a hash are plain inner joins, which AQE splits where one key
is heavy.

Defined results: a null or empty text is one empty line; whole texts count, however long; keys shorter than `min_chars` never go;
a document is a doc_id: rows that repeat a doc_id count once and lose the same lines; null doc_ids
are not counted as documents and keep no common line; of rows of one doc_id none comes before another, they all keep the
line or all lose it; two lines are the same if their 128-bit hashes are;
extra columns are kept, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 20
MIN_DOCUMENTS = 3
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_keys(text: bytes, min_chars: int) -> tuple[list[int], list[bytes]]:
    """Positions and keys of the lines whose key has at least min_chars code points."""
    at, keys = [], []
    for i, line in enumerate(text.split(b"\n")):
        key = line.strip(SPACE)
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            at.append(i)
            keys.append(key.lower())
    return at, keys


def explode_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """rows (doc_id, row_key, text) to a row for each long enough line: h1, h2, doc_id, row_key, pos."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            counts, pos, hashes = [], [], []
            for text in texts:
                at, keys = line_keys(text, min_chars) if text else ((), ())
                counts.append(len(at))
                pos += at
                hashes += map(digest, keys)
            both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            take = pa.array(np.repeat(np.arange(len(texts)), counts))
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), batch.column(0).take(take), batch.column(1).take(take), pa.array(pos, pa.int32())], schema=schema)

    return common.map_arrow(rows, run, "h1 bigint, h2 bigint, doc_id bigint, row_key bigint, pos int")


def dropped_positions(rows: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, row_key and the array of line positions that go, for the rows that lose any."""
    every = lines = common.store(explode_lines(rows, min_chars))
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_documents).select("h1", "h2")
    often = common.store(often)  # a plain shuffle on either side of a join lets AQE split a heavy hash
    lines = common.store(lines.join(often, ["h1", "h2"]))
    shared = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    shared = shared.groupBy("h1", "h2").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_documents).drop("n")
    shared = common.store(shared)
    common.drop_stored(every)
    gone = lines.join(shared, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """df with its text deduplicated and with n_lines and n_dropped (names of df's own win: ours get a trailing _)."""
    key, gone, lines, likely = (common.fresh(df, c) for c in ("row_key", "gone", "lines", "likely"))
    n_lines, n_dropped = common.fresh(df, "n_lines"), common.fresh(df, "n_dropped")
    df = df.withColumn(key, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    drop = dropped_positions(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(key).alias("row_key"), F.col(text).alias("text")), min_chars, min_documents)
    drop = common.store(drop.select(F.col("doc_id").alias(f"{gone}_id"), F.col("row_key").alias(f"{gone}_key"), F.col("gone").alias(gone)))
    # texts that lose no line, but for few by chance, are not shuffled
    own = F.col(doc_id).cast("bigint")
    df = common.flag_likely(df, F.xxhash64(own, F.col(key)), drop, F.xxhash64(f"{gone}_id", f"{gone}_key"), likely)
    rest = df.filter(~F.col(likely)).withColumn(gone, F.lit(None).cast("array<int>"))
    out = df.filter(F.col(likely)).join(drop, own.eqNullSafe(F.col(f"{gone}_id")) & (F.col(key) == F.col(f"{gone}_key")), "left").drop(f"{gone}_id", f"{gone}_key")
    out = rest.unionByName(out).drop(likely)
    out = out.withColumn(lines, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).withColumn(n_lines, F.size(lines).cast("bigint")).withColumn(n_dropped, F.coalesce(F.size(gone), F.lit(0)).cast("bigint"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(F.col(lines), i))
    kept = F.when(F.col(n_dropped) > 0, F.array_join(left, "\n")).otherwise(F.coalesce(F.col(text), F.lit("")))
    return out.withColumn(text, kept).drop(key, gone, lines)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.same_columns(common.documents(spark, sf_dir), ["doc_id", "text"])
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM (SELECT doc_id, text, row_number() OVER () AS rid FROM documents)
), stripped AS (
  SELECT doc_id, rid, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM stripped WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT s.doc_id, s.rid, s.pos, s.line, (h.k IS NOT NULL AND s.doc_id IS DISTINCT FROM h.keeper) AS gone
  FROM stripped s LEFT JOIN shared h ON s.k = h.k
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""
