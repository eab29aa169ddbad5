"""Hand-over notes: files `<folder>/<repo key>/<stamp>-<agent>.md`, and what is joined to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.redact import redact
from ..functions.text import basename, fold_case, inline, repo_key, trim_bytes

MAX_BODY = 64 << 10
STAMP = "yyyy-MM-dd'T'HH-mm-ss'Z'"
NAME = r"^(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}Z)-(.+)\.md$"


def parse_notes(files: DataFrame) -> DataFrame:
    """files (path, value) to note_id, key, agent, at, body; other names are no notes."""
    name, key = F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)
    rows = files.select(F.regexp_replace(name, r"\.md$", "").alias("note_id"), key.alias("key"), F.try_to_timestamp(F.nullif(F.regexp_extract(name, NAME, 1), F.lit("")), F.lit(STAMP)).cast("timestamp").alias("at"), F.regexp_extract(name, NAME, 2).alias("agent"), trim_bytes(F.col("value"), MAX_BODY).alias("body"))
    return rows.filter(F.col("at").isNotNull())


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of all repositories, with the root that the folder's .root file names, if its key is the folder's."""
    files = spark.read.text(f"{folder}/*/*.md", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    notes = parse_notes(files)
    roots = spark.read.option("recursiveFileLookup", "false").text(f"{folder}/*/.root*", wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("key"), F.trim(F.regexp_replace("value", r"\s+$", "")).alias("root"))
    return notes.join(roots.filter(repo_key(F.col("root")) == F.col("key")), "key", "left")


def newest(notes: DataFrame, key: str = "key") -> DataFrame:
    """The newest note of each repository; among equals the first by id."""
    return notes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("at"), F.asc("note_id")))).filter("_n = 1").drop("_n")


def gate(note_at: Column, session_start: Column, has_session: Column) -> Column:
    """Whether a note is shown: written since the session began, or there is no session."""
    return ~has_session | session_start.isNull() | (note_at >= session_start)


def title(body: Column, n: int = 120) -> Column:
    """The first line that isn't blank after redaction."""
    lines = F.filter(F.transform(F.split(redact(body), "\n"), inline), lambda x: x != "")
    return F.substring(F.coalesce(F.get(lines, 0), F.lit("")), 1, n)


def of_projects(notes: DataFrame, registry: DataFrame) -> DataFrame:
    """notes with the project they belong to and its root (columns project and _root)."""
    reg = registry.withColumn("_key", repo_key(F.col("path"))).withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("position")))).filter("_n = 1").select("_key", F.col("name").alias("_name"), F.col("path").alias("_path"))
    root = F.coalesce(F.nullif("_path", F.lit("")), F.nullif("root", F.lit("")))
    return notes.join(reg, notes["key"] == reg["_key"], "left").withColumn("_root", root).withColumn("project", F.coalesce(F.nullif("_name", F.lit("")), basename(root), F.col("key")))


def names(notes: DataFrame, registry: DataFrame) -> DataFrame:
    """names: those of all projects with notes, sorted; one row. A user's projects are few."""
    return of_projects(notes, registry).agg(F.sort_array(F.collect_set("project")).alias("names"))


def listing(notes: DataFrame, registry: DataFrame, project: str | None = None, limit: int = 15) -> DataFrame:
    """Notes with the project they belong to, newest first and numbered; the limit is 50 at most."""
    rows = of_projects(notes, registry)
    if project is not None:
        rows = rows.filter(fold_case(F.col("project")) == fold_case(F.lit(project)))
    rows = rows.orderBy(F.desc("at"), "note_id", "key").limit(max(0, min(limit, 50)))
    number = F.row_number().over(Window.orderBy(F.desc("at"), "note_id", "key"))
    return rows.select(number.alias("n"), "note_id", "project", F.col("_root").alias("root"), "agent", "at", title(F.col("body")).alias("title"))


def stamps(requests: DataFrame) -> DataFrame:
    """Requests (key, agent, at) with a stamp of their own: of equal seconds each takes the next free one.
    With n requests in order, the i-th takes max over j <= i of (second_j + i - j)."""
    w = Window.partitionBy("key", "agent").orderBy("second", "at")
    rows = requests.withColumn("second", F.floor(F.unix_micros("at") / 10**6).cast("bigint")).withColumn("i", F.row_number().over(w))
    free = F.max(F.col("second") - F.col("i")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("i")
    return rows.withColumn("stamp", F.date_format(F.timestamp_seconds(free), STAMP)).drop("second", "i")
