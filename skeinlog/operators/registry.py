"""The table of known repositories: lookup, upsert, names, closest names, staleness."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import age_days, fold_case

# Files whose change makes a card stale (README* stands for any name that begins so).
KEY_FILES = ("README*", "CLAUDE.md", "AGENTS.md", "package.json", "go.mod", "pyproject.toml", "Cargo.toml")
STALE_COMMITS, STALE_DAYS, ACTIVE_DAYS = 30, 60, 30

MAX_QUERIES = 1000

ENTRY = "path string, remote string, name string, last_seen timestamp"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the stored document, with their position; a document that can't be parsed has none."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"repos array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>").alias("d"))
    return doc.select(F.posexplode("d.repos").alias("position", "e")).select("position", "e.*")


def lookup(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """asked (path, remote) with the name of the first entry of its path, else of its remote."""
    def first(col: str) -> DataFrame:
        return registry.filter(F.col(col) != "").groupBy(col).agg(F.min_by("name", "position").alias("name"))

    by_path = first("path").select(F.col("path").alias("_path"), F.col("name").alias("_by_path"))
    by_remote = first("remote").select(F.col("remote").alias("_remote"), F.col("name").alias("_by_remote"))
    out = asked.join(by_path, F.col("path") == F.col("_path"), "left").join(by_remote, F.col("remote") == F.col("_remote"), "left")
    return out.withColumn("name", F.coalesce("_by_path", "_by_remote")).drop("_path", "_remote", "_by_path", "_by_remote")


def upsert(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """registry with what was seen: an entry of the same path, else the first of the same remote, keeps its name,
    takes path and remote of what was seen last, and its last_seen only moves forward; the rest is added. Of several
    things seen with one path the last counts."""
    when = lambda c: F.max_by(c, F.struct(F.coalesce("last_seen", F.lit(0).cast("timestamp")), "path"))
    each = seen.filter("path <> ''").groupBy("path").agg(when("remote").alias("remote"), when("name").alias("name"), F.max("last_seen").alias("last_seen"))
    each = each.unionByName(seen.filter("coalesce(path, '') = ''").select("path", "remote", "name", "last_seen"))
    place = F.col("position") if "position" in registry.columns else F.col("path")
    old = registry.withColumn("_at", place)
    by_path = old.filter("path <> ''").select(F.col("path").alias("_path"), F.lit(True).alias("_has")).distinct()
    by_remote = old.filter("remote <> ''").groupBy(F.col("remote").alias("_remote")).agg(F.min_by("path", "_at").alias("_first"))
    each = each.join(by_path, F.col("path") == F.col("_path"), "left").join(by_remote, F.col("remote") == F.col("_remote"), "left")
    entry = F.when(F.col("_has"), F.col("path")).otherwise(F.coalesce("_first", "path"))
    new = each.select(entry.alias("_entry"), "path", "remote", "name", "last_seen").groupBy("_entry").agg(when("path").alias("path"), when("remote").alias("remote"), when("name").alias("name"), F.max("last_seen").alias("last_seen"))
    joined = old.alias("o").join(new.alias("n"), F.col("o.path") == F.col("n._entry"), "full")
    col = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")).alias(c)
    return joined.select(col("path"), col("remote"), F.coalesce(F.col("o.name"), F.col("n.name")).alias("name"), F.greatest("o.last_seen", "n.last_seen").alias("last_seen"))


def commits_after(rows: DataFrame, commits: DataFrame, root: str = "root", since: str = "since") -> DataFrame:
    """root and commits: how many of its commits (root, at) are later than since. Roots without any are left out."""
    new = commits.select(F.col("root").alias("_root"), F.col("at").alias("_at"))
    both = rows.select(F.col(root).alias("root"), F.col(since).alias("_since")).join(new, (F.col("root") == F.col("_root")) & (F.col("_at") > F.col("_since")))
    return both.groupBy("root").agg(F.count("*").cast("int").alias("commits"))


def with_cards(registry: DataFrame, cards: DataFrame) -> DataFrame:
    """registry with summary, status and updated of the card of its name, and has_card."""
    c = cards.select(F.col("name").alias("_card"), "summary", "status", "updated")
    return registry.join(c, F.col("name") == F.col("_card"), "left").withColumn("has_card", F.col("_card").isNotNull()).drop("_card")


def active(items: DataFrame, now: Column, days: int = ACTIVE_DAYS, current: str | None = None) -> DataFrame:
    """Items seen within the window, or with a card; not the current repository."""
    out = items.filter((now - F.make_interval(days=F.lit(days)) <= F.col("last_seen")) | F.col("has_card"))
    return out.filter(F.col("path") != current) if current is not None else out


def find(registry: DataFrame, name_or_path: str) -> DataFrame:
    """The first entry of that name in any case, else of that path."""
    named = fold_case(F.col("name")) == fold_case(F.lit(name_or_path))
    hit = registry.filter(named | ((F.col("path") == name_or_path) if name_or_path.startswith("/") else F.lit(False)))
    return hit.orderBy(F.desc(named), "position").limit(1)


def closest(names: DataFrame, queries: DataFrame, n: int = 3) -> DataFrame:
    """For each query the n names most like it: those that begin with it, then those that hold it, then by
    edit distance; names has position. Queries are what persons typed: MAX_QUERIES at most, else an error; each
    meets every name."""
    if queries.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries")
    low, q = F.lower("name"), F.lower("query")
    rank = F.when(F.startswith(low, q), 0).when(F.contains(low, q), 1).otherwise(2)
    rows = names.join(F.broadcast(queries), how="cross").withColumn("rank", rank).withColumn("distance", F.levenshtein(low, q))
    order = ("rank", "distance", "position", "name")
    # first the best of each partition, so that no task sorts all names
    part = rows.withColumn("_part", F.spark_partition_id())
    part = part.withColumn("n", F.row_number().over(Window.partitionBy("query", "_part").orderBy(*order))).filter(F.col("n") <= n)
    best = part.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("n") <= n)
    return best.select("query", "n", "name", "rank", "distance")


def drift(cards: DataFrame, commits: DataFrame, changes: DataFrame) -> DataFrame:
    """cards (name, path, commit) with known, commits and changed: what happened in the repository after the
    card's commit. commits (path, sha, at), changes (path, sha, file)."""
    base = commits.select(F.col("path").alias("_p"), F.col("sha").alias("_sha"), F.col("at").alias("since"))
    known = cards.join(base, (cards["path"] == F.col("_p")) & (cards["commit"] == F.col("_sha")), "left").withColumn("known", F.col("_sha").isNotNull()).drop("_p", "_sha")
    later = known.filter("known").select("name", "path", "since").join(commits, "path").filter(F.col("at") > F.col("since"))
    count = later.groupBy("name").agg(F.count("*").cast("int").alias("commits"))
    key = F.col("file").isin(*[k for k in KEY_FILES if "*" not in k]) | F.startswith("file", F.lit("README")) & ~F.contains("file", F.lit("/"))
    files = later.select("name", "path", "sha").join(changes.filter(key), ["path", "sha"]).groupBy("name").agg(F.sort_array(F.collect_set("file")).alias("changed"))
    out = known.drop("since").join(count, "name", "left").join(files, "name", "left")
    return out.withColumn("commits", F.coalesce("commits", F.lit(0))).withColumn("changed", F.coalesce("changed", F.array().cast("array<string>")))


def stale_reason(updated: Column, commits: Column, changed: Column, known: Column, now: Column, max_commits: int = STALE_COMMITS, max_days: int = STALE_DAYS) -> Column:
    """Why a card is stale, reasons joined by "; "; empty: it is fresh. A limit of 0 switches its rule off."""
    days = age_days(updated, now)
    by_commits = F.when(known & (F.lit(max_commits) > 0) & (commits >= max_commits), F.concat(commits.cast("string"), F.lit(" commits since it was written")))
    by_files = F.when(known & (F.size(changed) > 0), F.concat(F.array_join(changed, ", "), F.lit(" changed")))
    by_age = F.when((F.lit(max_days) > 0) & (days >= max_days), F.concat(F.lit("written "), days.cast("string"), F.lit(" days ago")))
    return F.array_join(F.filter(F.array(by_commits, by_files, by_age), lambda x: x.isNotNull()), "; ")


def slug(s: str) -> str:
    return "".join(c if c.isascii() and (c.isalnum() or c == "-") else "-" for c in s.lower()).strip("-")


@dataclass(frozen=True)
class Entry:
    path: str = ""
    remote: str = ""
    name: str = ""
    last_seen: datetime | None = None


def free_name(root: str, taken: set[str]) -> str:
    """The folder's name, else with its parent's, else numbered from 2."""
    parts = [p for p in root.split("/") if p not in ("", ".")]
    base = slug(parts[-1] if parts else "") or "project"
    if base in taken:
        parent = slug(parts[-2]) if len(parts) > 1 else ""
        base = f"{base}-{parent}" if parent else base
    name, n = base, 2
    while name in taken:
        name, n = f"{base}-{n}", n + 1
    return name


def fold(entries: list[Entry], seen: Iterable[Entry], cards: Iterable[Entry] = ()) -> list[Entry]:
    """Upserts one at a time, as names given earlier decide later ones: an entry of the same path, else of
    the same remote, is updated; a new one takes the name of its card, or a free name. The table is one
    document of a user's repositories, so this runs on the driver."""
    out, cards = list(entries), list(cards)
    for e in seen:
        at = next((i for i, x in enumerate(out) if e.path and x.path == e.path), None)
        if at is None:
            at = next((i for i, x in enumerate(out) if e.remote and x.remote == e.remote), None)
        if at is not None:
            old = out[at]
            later = max((t for t in (old.last_seen, e.last_seen) if t is not None), default=None)
            out[at] = replace(old, path=e.path or old.path, remote=e.remote or old.remote, last_seen=later)
            continue
        taken = {x.name for x in out}
        mine = (c.name for c in cards if c.name and c.name not in taken and ((c.path and c.path == e.path) or (e.remote and c.remote == e.remote)))
        name = next(mine, None) or free_name(e.path, taken | {c.name for c in cards})
        out.append(replace(e, name=name))
    return out
