"""Which sessions a repository's brief is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ancestors, relative_to, within

SESSIONS = 3


def in_repos(sessions: DataFrame, repos: DataFrame, cwd: str = "cwd", root: str = "root") -> DataFrame:
    """Each session with each repository that its working directory is in: the directory's ancestors are
    exploded and joined by equality, so that no nested loop is needed. Where repos has alias (see
    sources.repos.aliases), that is what directories are in; a session counts once for a root."""
    up = sessions.withColumn("_root", F.explode(ancestors(F.col(cwd))))
    if "alias" not in repos.columns:
        return up.join(repos, up["_root"] == repos[root]).drop("_root")
    names = [c for c in repos.columns if c != "alias"]
    each = repos.groupBy(*names).agg(F.collect_set("alias").alias("_aliases"))
    found = up.join(each.withColumn("_alias", F.explode("_aliases")), F.col("_root") == F.col("_alias"))
    # of several aliases that a directory is in, one is kept: the longest
    up_to = F.array_max(F.filter("_aliases", lambda a: within(F.col(cwd), a)))
    return found.filter(F.col("_alias") == up_to).drop("_root", "_alias", "_aliases")


def recent(sessions: DataFrame, now: Column, days: int = 14, modified: str = "modified") -> DataFrame:
    return sessions.filter(F.col(modified) >= now - F.make_interval(days=F.lit(days)))


def exclude(sessions: DataFrame, session_id: str, col: str = "session_id") -> DataFrame:
    return sessions.filter(F.col(col) != session_id)


def without_disabled(sessions: DataFrame, disabled: DataFrame, root: str = "root", path: str = "path") -> DataFrame:
    """Sessions whose root isn't in a disabled directory; blank ones disable nothing."""
    off = disabled.filter(F.trim(F.col(path)) != "").select(F.col(path).alias("_off"))
    up = sessions.select(root).distinct().withColumn("_up", F.explode(ancestors(F.col(root))))
    gone = up.join(off, F.col("_up") == F.col("_off")).select(F.col(root).alias("_gone")).distinct()
    return sessions.join(gone, F.col(root) == F.col("_gone"), "left_anti")


def ranked(sessions: DataFrame, keep: int | None = SESSIONS, repo: str = "root", order: tuple[Column, ...] | None = None, forced: str | None = None) -> DataFrame:
    """sessions with rank by modified, newest first, per repository; a forced session id comes first."""
    order = order or (F.desc("modified"), F.asc("source_order"), F.asc("path"))
    if forced is not None:
        order = (F.desc(F.col("session_id") == forced), *order)
    out = sessions.withColumn("rank", F.row_number().over(Window.partitionBy(repo).orderBy(*order)))
    return out.filter(F.col("rank") <= keep) if keep else out


def relative_files(sessions: DataFrame, root: str = "root") -> DataFrame:
    """Files below the root lose it; two spellings of one file stay two."""
    return sessions.withColumn("files", F.transform("files", lambda f: F.struct(relative_to(f["path"], F.col(root)).alias("path"), f["ops"].alias("ops"), f["count"].alias("count"))))


def last_failed(commands: Column, n: int = 3) -> Column:
    """The last n failed commands, oldest first."""
    bad = F.transform(F.filter(commands, lambda c: c["failed"]), lambda c: c["command"])
    return F.slice(bad, F.greatest(F.size(bad) - n + 1, F.lit(1)), n)


__all__ = ["exclude", "in_repos", "last_failed", "ranked", "recent", "relative_files", "within", "without_disabled"]
