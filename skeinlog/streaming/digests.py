"""Digests of transcripts while they are written, in Structured Streaming: two ways.

append() stores the partial digest of what each batch adds to a file; read() joins a path's partial digests, as they are
associative, and compact() does so in the store. The digest itself is never rebuilt from lines, and a batch's work and
what it writes grow with its new bytes only.

live() keeps each path's digest as state (transformWithState): heads, and by key files, commands, and calls that wait
for a result. Each batch gives the digests that it changed. State goes after a time without lines.

Both read the source of sources.files, whose offsets are bytes of each path: nothing is read or counted twice, whatever
the cut into batches and wherever a query stopped. A file that became shorter is read anew: its first line voids what
was known of its path (a first line of more than MAX_LINE bytes, which is left out, does not).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import digest
from ..sources import files, transcripts

DIGEST = (
    "title string, branch string, cwd string, start timestamp, end timestamp, prompt_count int, first_prompt string, last_prompt string, last_message string, "
    "files array<struct<path:string,ops:array<string>,count:int>>, commands array<struct<command:string,failed:boolean>>, tail array<struct<kind:string,head:string,body:string,at:timestamp>>"
)


def steps_of(lines: DataFrame, dialect: str) -> DataFrame:
    return digest.slim(transcripts.DIALECTS[dialect](lines), tail=True)


def append(spark: SparkSession, root: str, dialect: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Stores partial digests of new lines. Each batch is a folder of its own under out, so a batch that is repeated
    after a failure replaces itself. trigger: as of writeStream.trigger; availableNow unless given."""

    def batch(lines: DataFrame, number: int) -> None:
        parts = digest.partials(steps_of(lines, dialect), tail=True, keep=("modified",))
        parts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    lines = files.stream(spark, root, dialect)
    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def valid(rows: DataFrame) -> DataFrame:
    """Stored partial digests without those of files that were replaced since: of the batches of a path those from the
    last one on that holds its first line."""
    begun = F.max(F.when(F.col("part") == 0, F.col("batch"))).over(Window.partitionBy("path"))
    return rows.withColumn("_begun", begun).filter(F.col("_begun").isNull() | (F.col("batch") >= F.col("_begun"))).drop("_begun")


def stored(spark: SparkSession, out: str) -> DataFrame:
    _settle(spark, out)
    return spark.read.schema(f"path string, part bigint, p {digest.PART_TYPE}, modified timestamp, batch bigint").parquet(out)


def read(spark: SparkSession, out: str, tail: bool = True) -> DataFrame:
    """Digests of all files that have a prompt so far."""
    return digest.merged(valid(stored(spark, out)), tail, ("modified",))


def _folder(spark: SparkSession, out: str):
    """The store's file system, how it calls a name in out, and the names that are there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(out)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, lambda name: path(f"{out}/{name}"), [s.getPath().getName() for s in fs.listStatus(root)]


def compact(spark: SparkSession, out: str) -> int:
    """Joins each path's partial digests to one, which takes the place of the last batch in it; how many batches there
    were. What is joined is written as a whole before anything goes, under a name that readers do not see; whoever
    finds that name finishes the exchange. Batches that come meanwhile stay as they are."""
    rows = stored(spark, out)
    fs, path, names = _folder(spark, out)
    batches = sorted(int(n[6:]) for n in names if n.startswith("batch="))
    if len(batches) > 1:
        by = valid(rows.filter(F.col("batch") <= batches[-1])).groupBy("path").agg(F.min("part").alias("part"), F.sort_array(F.collect_list(F.struct("part", "p"))).alias("parts"), F.max("modified").alias("modified"))
        written = f"_writing-{uuid.uuid4().hex}"
        by.select("path", "part", digest.joined(F.transform("parts", lambda x: x["p"])).alias("p"), "modified").write.parquet(f"{out}/{written}")
        fs.rename(path(written), path(f"_batch={batches[-1]}"))
        _settle(spark, out)
    return len(batches)


def _settle(spark: SparkSession, out: str) -> None:
    """Puts what compact() has written in the place of the batches that it holds."""
    fs, path, names = _folder(spark, out)
    for name in [n for n in names if n.startswith("_batch=")]:
        for old in [n for n in names if n.startswith("batch=") and int(n[6:]) <= int(name[7:])]:
            fs.delete(path(old), True)
        fs.rename(path(name), path(name[1:]))


class Live(StatefulProcessor):
    """The digest of one path, from its steps in order. Heads are one value; files, commands and waiting calls are kept
    by key, so that a batch touches what it changes."""

    EMPTY = {"title": None, "branch": None, "cwd": None, "start": None, "end": None, "prompt_count": 0, "first_prompt": None, "last_prompt": None, "last_message": None, "lines": 0, "n_commands": 0, "n_files": 0, "tail": []}

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "json string", self.ttl_ms)
        self.files = handle.getMapState("files", "file string", "json string", self.ttl_ms)
        self.commands = handle.getMapState("commands", "n int", "command string, failed boolean", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "call string", "n int, head string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        steps = sorted(rows, key=lambda r: (r.line_no, r.block_no, r.kind != "line"))
        if steps and steps[0].line_no == 0 and self.head.exists():  # the file was replaced
            for state in (self.head, self.files, self.commands, self.waiting):
                state.clear()
        h = json.loads(self.head.get()[0]) if self.head.exists() else json.loads(json.dumps(self.EMPTY))
        for r in steps:
            self.take(h, r)
        h["tail"] = h["tail"][-digest.TAIL :]
        self.head.update((json.dumps(h),))
        if h["prompt_count"]:
            files_ = sorted((json.loads(v[0]) | {"path": k[0]} for k, v in self.files.iterator()), key=lambda f: f["n"])
            commands = [{"command": v[0], "failed": v[1]} for _, v in sorted((k[0], v) for k, v in self.commands.iterator())]
            yield Row(path=key[0], digest=json.dumps(h | {"files": files_, "commands": commands}))

    def take(self, h: dict, r) -> None:
        kind, act, head = r.kind, None, r.head
        if kind == "line":
            h["lines"] += 1
        elif kind in ("title", "branch"):
            h[kind] = r.text
        elif kind == "cwd" and h["cwd"] is None and h["lines"] <= digest.CWD_LINES:
            h["cwd"] = r.text
        elif kind == "entry" and r.ts is not None:
            h["start"], h["end"] = (r.ts if h["start"] is None else h["start"]), r.ts
        elif kind == "user":
            act, h["prompt_count"], h["last_prompt"] = kind, h["prompt_count"] + 1, r.text
            h["first_prompt"] = r.text if h["first_prompt"] is None else h["first_prompt"]
        elif kind in ("assistant", "final"):
            act, h["last_message"] = kind if kind == "assistant" else None, r.text
        elif kind == "file":
            act, known = kind, self.files.getValue((r.text,))
            f = json.loads(known[0]) if known else {"n": h["n_files"], "ops": [], "count": 0}
            h["n_files"] += known is None
            self.files.updateValue((r.text,), (json.dumps(f | {"ops": f["ops"] + [r.op] * (r.op not in f["ops"]), "count": f["count"] + 1}),))
        elif kind == "command":
            act, n = kind, h["n_commands"]
            h["n_commands"] += 1
            self.commands.updateValue((n,), (r.text, False))
            if r.call_id is not None:
                self.waiting.updateValue((r.call_id,), (n, r.head))
        elif kind == "result" and r.call_id is not None and (call := self.waiting.getValue((r.call_id,))):
            self.waiting.removeKey((r.call_id,))
            if r.is_error:
                act, head = "failure", call[1]
                self.commands.updateValue((call[0],), (self.commands.getValue((call[0],))[0], True))
        if act:
            h["tail"].append({"kind": act, "head": head, "body": r.body, "at": r.ts})

    def close(self) -> None:
        pass


def live(spark: SparkSession, root: str, dialect: str, ttl_hours: float | None = 24 * 14) -> DataFrame:
    """A stream of path and DIGEST's columns of each file with a prompt that got new lines: its digest after them. A
    file without new lines for ttl_hours is forgotten (None: never), and would begin anew with its next line."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    steps = steps_of(files.stream(spark, root, dialect), dialect)
    slim = steps.select("path", "line_no", "block_no", F.unix_micros("ts").alias("ts"), "kind", F.when(F.col("kind") != "result", F.col("text")).alias("text"), digest.head_of(F.col("text")).alias("head"), F.substring(F.when(F.col("kind") == "file", F.col("op")).otherwise(F.col("text")), 1, digest.BODY_CHARS).alias("body"), "op", "call_id", "is_error")
    ttl = None if ttl_hours is None else int(ttl_hours * 3_600_000)
    out = slim.groupBy("path").transformWithState(Live(ttl), "path string, digest string", "Update", "None" if ttl is None else "ProcessingTime")
    parsed = F.from_json("digest", DIGEST.replace("timestamp", "bigint"))
    out = out.select("path", parsed.alias("d")).select("path", "d.*")
    tail = F.transform("tail", lambda t: F.struct(t["kind"].alias("kind"), t["head"].alias("head"), t["body"].alias("body"), F.timestamp_micros(t["at"]).alias("at")))
    return out.withColumns({"start": F.timestamp_micros("start"), "end": F.timestamp_micros("end"), "tail": tail})
