"""The state of a user's repositories, asked of git on the driver, as tables.

Checkouts are local folders of the machine that the user works on, so nothing here is distributed: a few git
calls for each, several repositories at a time. A repository that git fails on is left out.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_remote

AT_ONCE, TIMEOUT = 8, 20
ACTIVE_DAYS = 30


def git(folder: str, *args: str) -> str | None:
    """What git prints, without line breaks at the end; None if it fails or takes too long."""
    try:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, errors="replace", timeout=TIMEOUT, env=os.environ | {"GIT_OPTIONAL_LOCKS": "0"})
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.rstrip("\n") if done.returncode == 0 else None


def main_checkout(folder: str) -> str | None:
    """The root of the checkout that a folder belongs to; of a linked worktree the main one. None outside of git."""
    shared = git(folder, "rev-parse", "--path-format=absolute", "--git-common-dir")
    if not shared:
        return None
    return os.path.dirname(shared) if os.path.basename(shared) == ".git" else git(folder, "rev-parse", "--show-toplevel") or None


@dataclass
class State:
    root: str
    branch: str = ""
    uncommitted: int = 0
    remote_url: str = ""
    head: str = ""
    commits: list[tuple[str, datetime, str]] = field(default_factory=list)
    changes: list[tuple[str, str]] = field(default_factory=list)


def read_state(root: str, since: datetime | None = None) -> State | None:
    """Branch, uncommitted files, remote, and the commits of HEAD (after since, with the files they change)."""
    listed = git(root, "status", "--porcelain")
    if listed is None:
        return None
    branch = git(root, "symbolic-ref", "--short", "-q", "HEAD") or git(root, "rev-parse", "--abbrev-ref", "HEAD") or ""
    out = State(root, branch, len(listed.splitlines()), git(root, "remote", "get-url", "origin") or "", git(root, "rev-parse", "HEAD") or "")
    bound = [f"--since={since.astimezone(timezone.utc).isoformat()}"] if since else []
    log = git(root, "log", *bound, "--name-only", "-m", "--first-parent", "--format=%x01%H%x00%ct%x00%s", "HEAD") or ""
    for part in log.split("\x01")[1:]:
        head, *files = part.split("\n")
        sha, at, subject = head.split("\0", 2)
        out.commits.append((sha, datetime.fromtimestamp(int(at), timezone.utc), subject))
        out.changes += [(sha, f) for f in files if f]
    return out


def collect(spark: SparkSession, roots: Iterable[str], since: datetime | None = None) -> dict[str, DataFrame]:
    """Tables for the engine's calls: repos (root, name), git (root, path, branch, uncommitted, head, remote, subject,
    at: those of the last commit), commits (root, path, sha, at, subject) and changes (root, path, sha, file)."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        found = [s for s in pool.map(lambda r: read_state(r, since), dict.fromkeys(roots)) if s is not None]
    last = [(s.commits[0][2], s.commits[0][1]) if s.commits else (None, None) for s in found]
    tables = {
        "repos": ([(s.root, os.path.basename(s.root)) for s in found], "root string, name string"),
        "git": ([(s.root, s.root, s.branch, s.uncommitted, s.head, s.remote_url, *c) for s, c in zip(found, last, strict=True)], "root string, path string, branch string, uncommitted int, head string, remote string, subject string, at timestamp"),
        "commits": ([(s.root, s.root, *c) for s in found for c in s.commits], "root string, path string, sha string, at timestamp, subject string"),
        "changes": ([(s.root, s.root, *c) for s in found for c in s.changes], "root string, path string, sha string, file string"),
    }
    out = {k: spark.createDataFrame(rows, schema) for k, (rows, schema) in tables.items()}
    out["git"] = out["git"].withColumn("remote", normal_remote(F.col("remote")))
    return out


def by_last_commit(git_state: DataFrame) -> DataFrame:
    """Repositories with a commit, the one with the latest first; ties by root."""
    return git_state.filter(F.col("at").isNotNull()).orderBy(F.desc("at"), "root")


def recently_committed(git_state: DataFrame, now: Column, days: int = ACTIVE_DAYS) -> DataFrame:
    """Repositories whose last commit is within the window; disabled ones are for select.without_disabled()."""
    return git_state.filter(F.col("at") >= now - F.expr(f"INTERVAL {timedelta(days=days).days} DAYS"))


def resolve(spark: SparkSession, folders: Iterable[str]) -> DataFrame:
    """cwd, root and known: the checkout that each folder belongs to; outside of git the folder itself."""
    each = list(dict.fromkeys(folders))
    with ThreadPoolExecutor(AT_ONCE) as pool:
        roots = list(pool.map(main_checkout, each))
    return spark.createDataFrame([(c, r or os.path.normpath(c), r is not None) for c, r in zip(each, roots, strict=True)], "cwd string, root string, known boolean")


def aliases(spark: SparkSession, roots: Iterable[str]) -> DataFrame:
    """root, name and alias: each repository under its path as given and, where links lead elsewhere, as resolved."""
    rows = [(r, os.path.basename(r), a) for r in dict.fromkeys(roots) for a in dict.fromkeys((os.path.normpath(r), os.path.realpath(r)))]
    return spark.createDataFrame(rows, "root string, name string, alias string")
