"""A user's small stores, written on the driver: notes, registry, cards, index.

They are files that people also edit by hand, one user's repositories large. What grows with the
transcripts is written by DataFrame writers instead (see save_sessions).
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import asdict
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.registry import Entry

LOCK_STALE_SECONDS = 10
SKIPPED_DIRS = {"node_modules", "vendor"}


def write_atomic(path: str | Path, text: str) -> None:
    """A reader sees the old file or the new one, never a part."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, part = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        with suppress(OSError):
            os.unlink(part)
        raise


def _key(s: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else "-" for c in s)


def write_note(folder: str | Path, root: str, agent: str, body: str, now: datetime) -> Path:
    """A new note of a repository; a second that is taken moves it to the next one."""
    own = Path(folder) / _key(root)
    own.mkdir(parents=True, exist_ok=True)
    if not (own / ".root").exists():
        write_atomic(own / ".root", root)
    name, at = _key(agent)[:32] or "agent", now.astimezone(timezone.utc).replace(microsecond=0)
    for _ in range(1000):
        path = own / f"{at:%Y-%m-%dT%H-%M-%SZ}-{name}.md"
        try:
            with open(path, "x", encoding="utf-8", newline="") as f:
                f.write(body)
            return path
        except FileExistsError:
            at += timedelta(seconds=1)
    raise FileExistsError(f"no free note name in {own}")


@contextmanager
def locked(path: Path, timeout: float) -> Iterator[None]:
    """Holds a lock file; one that is left over is taken after a while."""
    lock, until = path.with_name(f".{path.name}.lock"), time.monotonic() + timeout
    path.parent.mkdir(parents=True, exist_ok=True)
    while True:
        try:
            lock.open("x").close()
            break
        except FileExistsError:
            with suppress(FileNotFoundError):
                if time.time() - lock.stat().st_mtime > LOCK_STALE_SECONDS:
                    lock.unlink()
                    continue
            if time.monotonic() > until:
                raise TimeoutError(f"{path} is locked by another process") from None
            time.sleep(0.01)
    try:
        yield
    finally:
        with suppress(FileNotFoundError):
            lock.unlink()


def load_registry(path: str | Path) -> list[Entry]:
    """Entries of the stored document; none if there is none. ValueError if it can't be parsed."""
    if not Path(path).exists():
        return []
    doc = json.loads(Path(path).read_text(encoding="utf-8"))
    try:
        return [Entry(e.get("path", ""), e.get("remote", ""), e.get("name", ""), datetime.fromisoformat(t) if (t := e.get("last_seen")) else None) for e in doc["repos"]]
    except (TypeError, KeyError, AttributeError) as e:
        raise ValueError(f"{path} is no registry") from e


def save_registry(path: str | Path, entries: Iterable[Entry]) -> None:
    rows = [asdict(e) | {"last_seen": e.last_seen.isoformat() if e.last_seen else None} for e in entries]
    write_atomic(path, json.dumps({"repos": rows}, indent=2, ensure_ascii=False) + "\n")


def update_registry(path: str | Path, change: Callable[[list[Entry]], list[Entry]], timeout: float = 2.0) -> list[Entry]:
    """Load, change and save under a lock; a document that can't be parsed is kept as .bak and begun anew."""
    path = Path(path)
    with locked(path, timeout):
        try:
            entries = load_registry(path)
        except ValueError:
            write_atomic(path.with_name(path.name + ".bak"), path.read_text(encoding="utf-8", errors="replace"))
            entries = []
        entries = change(entries)
        save_registry(path, entries)
    return entries


def save_card(path: str | Path, text: str, was_valid: bool = True) -> None:
    """Writes a card; a file that was no card (a broken edit by hand) is kept as .bak."""
    path = Path(path)
    if path.exists() and not was_valid:
        write_atomic(path.with_name(path.name + ".bak"), path.read_text(encoding="utf-8", errors="replace"))
    write_atomic(path, text)


def save_cards(cards: DataFrame, folder: str | Path) -> int:
    """Writes a user's cards (columns as parsed), one file each; other files of those names are kept as .bak."""
    from ..operators.cards import marshal, parse_cards

    folder, spark, n = Path(folder), cards.sparkSession, 0
    there = [(str(p), p.read_text(encoding="utf-8", errors="replace")) for p in sorted(folder.glob("*.md"))]
    valid = {r["card_file"] for r in parse_cards(spark.createDataFrame(there, "path string, value string")).select("card_file").collect()} if there else set()
    for row in cards.select("name", marshal().alias("text")).toLocalIterator():
        path = folder / f"{row['name']}.md"
        save_card(path, row["text"], str(path) in valid)
        n += 1
    return n


def find_repos(roots: Iterable[str | Path], depth: int = 4) -> list[str]:
    """Directories with .git below the roots; repositories are not looked into, nor are hidden and vendored folders."""
    found: list[str] = []

    def walk(at: Path, left: int) -> None:
        if (at / ".git").exists():
            found.append(str(at))
        elif left:
            with suppress(OSError):
                for p in sorted(at.iterdir()):
                    if p.is_dir() and not p.is_symlink() and not p.name.startswith(".") and p.name not in SKIPPED_DIRS:
                        walk(p, left - 1)

    for root in roots:
        walk(Path(root), depth)
    return found


def save_sessions(sessions: DataFrame, path: str) -> None:
    """Digests as Parquet by agent."""
    sessions.write.mode("overwrite").partitionBy("agent").parquet(path)


PROFILE = """# Profile

## About
(Who you are and what you do.)

## Focus
(What you are working on now.)
"""


def load_profile(path: str | Path) -> tuple[str, bool]:
    """A profile's text, and whether it was made just now from the template."""
    path = Path(path)
    if path.exists():
        return path.read_text(encoding="utf-8"), False
    write_atomic(path, PROFILE)
    return PROFILE, True


def write_index(index: DataFrame, path: str | Path) -> None:
    """Writes the one row of api.index()."""
    write_atomic(path, index.first()["index"])


def print_json(df: DataFrame) -> Iterator[str]:
    """Rows as indented JSON, one at a time."""
    for row in df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("j")).toLocalIterator():
        yield row["j"]
