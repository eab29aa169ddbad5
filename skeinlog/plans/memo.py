"""Scans that calls in quick succession share.

A scan's digests are stored as a table in the shared folder, under the call's arguments and what a listing saw (how many
files, their bytes, the newest time of modification). Within the time to live a call reads the table and lists nothing;
after that it lists, and parses only if the listing saw something else. Meant for a process that answers many calls;
tables that were replaced stay until the application ends, as answers may still be read from them.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import session
from ..sources import files
from . import api

TTL = 45.0


@dataclass
class Held:
    path: str
    schema: object
    seen: tuple
    at: float


class SessionScans:
    """load_sessions(), remembered. clock: seconds; listings and scans count what was done."""

    def __init__(self, spark: SparkSession, ttl: float = TTL, clock: Callable[[], float] = time.monotonic):
        self.spark, self.ttl, self.clock = spark, ttl, clock
        self.held: dict[tuple, Held] = {}
        self.lock = threading.Lock()
        self.listings = self.scans = 0

    def seen(self, roots: dict[str, tuple[str, str]]) -> tuple:
        """What a listing tells of each source; a source that cannot be listed is what it is until it can."""
        self.listings += 1
        out = []
        for agent, (dialect, root) in roots.items():
            try:
                found = files.list_files(root, dialect)
            except Exception as e:  # whatever its store says: load_sessions leaves such a source out
                out.append((agent, str(e)))
                continue
            out.append((agent, len(found), sum(f.size for f in found), max((f.modified for f in found), default=0)))
        return tuple(out)

    def load(self, roots: dict[str, tuple[str, str]], tail: bool = False) -> DataFrame:
        """Digests of all transcripts, at most ttl seconds old."""
        key = (tuple(roots.items()), tail)
        with self.lock:
            held, now = self.held.get(key), self.clock()
            if held is None or now - held.at >= self.ttl:
                seen = self.seen(roots)
                if held is None or held.seen != seen:
                    df = api.load_sessions(self.spark, roots, tail=tail)
                    held = Held(f"{session.scratch(self.spark)}/sessions", df.schema, seen, now)
                    df.write.parquet(held.path)
                    self.scans += 1
                held.at = now
                self.held[key] = held
        return self.spark.read.schema(held.schema).parquet(held.path)
