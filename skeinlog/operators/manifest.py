"""Differences between two sets of files, and counts of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digests(files: DataFrame, name: str = "file", content: str = "content") -> DataFrame:
    """file and the SHA-256 of its content."""
    return files.select(F.col(name).alias("file"), F.sha2(F.col(content), 256).alias("sha256"))


def diff(expected: DataFrame, found: DataFrame) -> DataFrame:
    """file and state of the files (file, sha256) of either: missing, extra, modified or same."""
    e, f = expected.select(F.col("file").alias("_e"), F.col("sha256").alias("_eh")), found.select(F.col("file").alias("_f"), F.col("sha256").alias("_fh"))
    state = F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_eh") != F.col("_fh"), "modified").otherwise("same")
    return e.join(f, F.col("_e") == F.col("_f"), "full").select(F.coalesce("_e", "_f").alias("file"), state.alias("state"))


def states(shipped: DataFrame, recorded: DataFrame, found: DataFrame) -> DataFrame:
    """folder and state of the folders of shipped. All three have folder, file, sha256: what would be written, what
    was recorded when it was written, what is there.

    absent: nothing is there; unmanaged: nothing was recorded; modified: a recorded file is gone or changed, or one
    that would be written is there without record; outdated: record and shipment differ; else current."""
    own = lambda df, n: df.select("folder", "file", F.col("sha256").alias(n))
    rows = own(shipped, "s").join(own(recorded, "r"), ["folder", "file"], "full").join(own(found, "f"), ["folder", "file"], "full")
    s, r, f = F.col("s"), F.col("r"), F.col("f")
    changed = (r.isNotNull() & ~r.eqNullSafe(f)) | (s.isNotNull() & r.isNull() & f.isNotNull())
    differs = (s.isNotNull() | r.isNotNull()) & ~s.eqNullSafe(r)
    out = rows.groupBy("folder").agg(F.count("s").alias("n_s"), F.count("r").alias("n_r"), F.count("f").alias("n_f"), F.bool_or(changed).alias("changed"), F.bool_or(differs).alias("differs"))
    state = F.when(F.col("n_f") == 0, "absent").when(F.col("n_r") == 0, "unmanaged").when(F.col("changed"), "modified").when(F.col("differs"), "outdated").otherwise("current")
    return out.filter("n_s > 0").select("folder", state.alias("state"))


def count_files(lines: DataFrame) -> DataFrame:
    """Number of transcripts among lines (path, ...), by folder."""
    return lines.select("path").distinct().groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("files"))
