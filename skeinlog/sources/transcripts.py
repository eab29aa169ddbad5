"""Transcripts of two dialects, as JSON lines, to one table of steps.

Dialect `blocks`: a line is a user or assistant entry whose message content is a string or an array of
blocks. Dialect `rollout`: a line has a type and a payload. Both give steps

    path, line_no, block_no, ts, kind, text, op, call_id, is_error

with kind one of user, assistant, final, command, file, result, title, branch, cwd, entry (a line that
counts for start and end) and line (one for each line). (line_no, block_no) orders the steps of a file.

A dialect is registered with its layout, its steps, and two small questions about one entry that a reader of only the
ends of files asks (see files); further dialects are added with register().

Files are read line by line and in splits, so no file is held in memory. A line is parsed once: all its
steps are made by one expression as an array, and exploded. Lines that aren't JSON objects, longer lines
than MAX_LINE, unknown types and a last line without a line break give no steps.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import rfc3339, trim_space

MAX_LINE = 16 << 20
LATE = 1 << 30  # block_no of what follows all blocks of a line

# Prefixes of user entries that no user typed, and names of tools.
NOT_PROMPTS = (
    "<command-name>", "<command-message>", "<local-command-stdout>", "<local-command-caveat>", "<system-reminder>",
    "[Request interrupted", "<bash-input>", "<bash-stdout>", "<bash-stderr>", "<task-notification>",
)
INJECTED = ("<environment_context>", "<user_instructions>", "# AGENTS.md instructions for")
SHELL_TOOLS = ("shell", "local_shell", "shell_command", "exec_command", "container.exec")
PATCH_OPS = {"*** Update File: ": "edit", "*** Add File: ": "write", "*** Delete File: ": "delete"}
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

STEPS = "path string, line_no bigint, block_no int, ts timestamp, kind string, text string, op string, call_id string, is_error boolean"
FIELDS = ("block_no", "ts", "kind", "text", "op", "call_id", "is_error")


def lines_of(lines: DataFrame) -> DataFrame:
    """lines (path, modified, size, block, line), as a file scan gives them, with line_no and bytes. line_no orders a
    file's lines: the split they are in (4 KiB at least), then the place in the task that reads it."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    line_no = F.shiftleft(F.shiftright("block", 12), 33) + place
    return lines.select("path", "modified", "size", line_no.alias("line_no"), F.octet_length("line").cast("bigint").alias("bytes"), "line")


def scanned(files: DataFrame) -> DataFrame:
    """path, modified, size, block and line of a scan of text files."""
    m = lambda name: F.col(f"_metadata.file_{name}")
    return files.select(m("path").alias("path"), m("modification_time").alias("modified"), m("size").alias("size"), m("block_start").alias("block"), F.col("value").alias("line"))


def raw_lines(spark: SparkSession, paths: str | list[str], modified_after: str | None = None) -> DataFrame:
    """path, modified, size, line_no, bytes and line of all lines."""
    reader = spark.read.option("modifiedAfter", modified_after) if modified_after else spark.read
    return lines_of(scanned(reader.option("lineSep", "\n").text(paths)))


def finished(steps: DataFrame) -> DataFrame:
    """steps of raw_lines without those of a last line that has no line break, and without line steps. Lines and
    breaks add up to the file's size if the last line has one."""
    w = Window.partitionBy("path")
    total = F.sum(F.when(F.col("kind") == "line", F.col("bytes") + 1)).over(w)
    steps = steps.withColumns({"_total": total, "_last": F.max("line_no").over(w)})
    cut = (F.col("_total") != F.col("size")) & (F.col("line_no") == F.col("_last"))
    return steps.filter(~cut & (F.col("kind") != "line")).drop("_total", "_last")


def _event(kind: str, text: Column, when: Column, block: Column | int = 0, ts: Column | None = None, op: Column | None = None, call: Column | None = None, error: Column | None = None) -> Column:
    """A step as a struct where `when` holds, else null."""
    null = F.lit(None)
    at = F.lit(block) if isinstance(block, int) else block
    values = (at.cast("int"), (null if ts is None else ts).cast("timestamp"), F.lit(kind), text.cast("string"), (null if op is None else op).cast("string"), (null if call is None else call).cast("string"), (null if error is None else error).cast("boolean"))
    return F.when(when, F.struct(*(v.alias(n) for v, n in zip(values, FIELDS, strict=True))))


def _explode(lines: DataFrame, events: list[Column], arrays: Sequence[Column] = ()) -> DataFrame:
    """A row for each event that isn't null; events of a line are made once."""
    line = _event("line", F.lit(None), F.lit(True))
    every = F.concat(F.array(line, *events), *(F.coalesce(a, F.array().cast(f"array<struct<{EVENT}>>")) for a in arrays))
    keep = [c for c in lines.columns if c in ("path", "modified", "size", "bytes", "line_no", "whole")]
    out = lines.select(*keep, F.explode(F.filter(every, lambda e: e.isNotNull())).alias("e"))
    return out.select(*keep, *(F.col(f"e.{f}").alias(f) for f in FIELDS))


EVENT = "block_no:int,ts:timestamp,kind:string,text:string,op:string,call_id:string,is_error:boolean"


def _parse(line: Column, most: int = MAX_LINE) -> Column:
    return F.when((F.octet_length(line) < most) & line.rlike(r"^\s*\{") & line.rlike(r"\}\s*$"), F.try_parse_json(line))


def _get(v: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _is_array(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))


def _starts(text: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(text, F.lit(p))
    return out


def blocks_steps(lines: DataFrame) -> DataFrame:
    """Steps of the `blocks` dialect."""
    e = lines.withColumn("v", _parse(F.col("line"))).drop("line")
    content = F.try_variant_get("v", "$.message.content", "variant")
    e = e.withColumns({"type": _get("v", "$.type"), "ts": rfc3339(_get("v", "$.timestamp")), "content": content, "side": F.coalesce(_get("v", "$.isSidechain", "boolean"), F.lit(False)), "meta": F.coalesce(_get("v", "$.isMeta", "boolean"), F.lit(False))})
    plain = F.when(F.schema_of_variant("content") == "STRING", _get("content", "$"))
    blocks = F.when(_is_array(F.col("content")), F.try_variant_get("content", "$", "array<variant>"))
    e = e.withColumns({"plain": plain, "blocks": blocks})
    e = e.withColumn("texts", F.filter(F.transform("blocks", lambda b: F.when(_get(b, "$.type") == "text", _get(b, "$.text"))), lambda t: t.isNotNull() & (t != "")))
    prompt = trim_space(F.coalesce("plain", F.array_join("texts", "\n"), F.lit("")))
    said = F.array_join(F.filter("texts", lambda t: trim_space(t) != ""), "\n")
    e = e.withColumns({"prompt": prompt, "said": said})
    ts, c = F.col("ts"), F.col
    entry = c("type").isin("user", "assistant") & ~c("side")
    user, assistant = entry & (c("type") == "user"), entry & (c("type") == "assistant")
    text = lambda kind, path, when: _event(kind, _get("v", path), when & (_get("v", path) != ""), ts=ts)

    def of_block(b: Column, i: Column) -> Column:
        kind, name = _get(b, "$.type"), _get(b, "$.name")
        op = F.when(name.isin("Edit", "MultiEdit", "NotebookEdit"), "edit").when(name == "Write", "write")
        file = F.when(name == "NotebookEdit", _get(b, "$.input.notebook_path")).otherwise(_get(b, "$.input.file_path"))
        inner = F.try_variant_get(b, "$.content", "array<variant>")
        listed = F.array_join(F.filter(F.transform(inner, lambda x: F.when(_get(x, "$.type") == "text", _get(x, "$.text"))), lambda t: t.isNotNull() & (t != "")), "\n")
        result = F.when(_is_array(F.try_variant_get(b, "$.content", "variant")), listed).otherwise(_get(b, "$.content"))
        tool, command = assistant & (kind == "tool_use"), _get(b, "$.input.command")
        return F.coalesce(
            _event("command", command, tool & (name == "Bash") & (command != ""), i, ts, call=F.nullif(_get(b, "$.id"), F.lit(""))),
            _event("file", file, tool & op.isNotNull() & (file != ""), i, ts, op=op),
            _event("result", F.coalesce(result, F.lit("")), user & (kind == "tool_result"), i, ts, call=_get(b, "$.tool_use_id"), error=F.coalesce(_get(b, "$.is_error", "boolean"), F.lit(False))),
        )

    return _explode(e, [
        _event("title", _get("v", "$.aiTitle"), (c("type") == "ai-title") & (_get("v", "$.aiTitle") != "")),
        _event("entry", F.lit(None), entry, ts=ts),
        text("cwd", "$.cwd", entry),
        text("branch", "$.gitBranch", entry),
        _event("user", c("prompt"), user & ~c("meta") & (c("prompt") != "") & ~_starts(c("prompt"), NOT_PROMPTS), LATE, ts),
        _event("assistant", c("said"), assistant & (c("said") != ""), LATE, ts),
    ], [F.transform("blocks", of_block)])


def command_text(arguments: Column) -> Column:
    """The shell command of a tool call's JSON arguments: a shell wrapper's script, an argv joined by spaces, or a string."""
    v = F.when(arguments.rlike(r"^\s*\{") & arguments.rlike(r"\}\s*$"), F.try_parse_json(arguments))
    command = F.try_variant_get(v, "$.command", "variant")
    kind = F.schema_of_variant(command)
    argv = F.when(F.startswith(kind, F.lit("ARRAY<STRING")), F.try_variant_get(v, "$.command", "array<string>"))
    shell = (F.size(argv) == 3) & F.get(argv, 0).isin("sh", "bash", "zsh") & F.get(argv, 1).isin("-lc", "-c")
    text = F.when(F.size(argv) > 0, F.when(shell, F.get(argv, 2)).otherwise(F.array_join(argv, " ")))
    plain = F.when(kind == "STRING", F.nullif(_get(v, "$.command"), F.lit("")))
    return F.coalesce(text, plain, _get(v, "$.cmd"), F.lit(""))


def output_failed(output: Column) -> Column:
    """A non-zero exit: metadata.exit_code of a JSON output, else a line `Exit code: n`."""
    v = F.when(output.rlike(r"^\s*\{") & output.rlike(r"\}\s*$"), F.try_parse_json(output))
    return F.coalesce(_get(v, "$.metadata.exit_code", "bigint") != 0, output.rlike("(?md)^Exit code: [1-9]"), F.lit(False))


def output_text(output: Column) -> Column:
    """The output field of a JSON output, else the output itself."""
    v = F.when(output.rlike(r"^\s*\{") & output.rlike(r"\}\s*$"), F.try_parse_json(output))
    return F.coalesce(F.nullif(_get(v, "$.output"), F.lit("")), output)


def patch_files(patch: Column, ts: Column) -> Column:
    """A file step for each file that a patch names, as an array; null where there is no patch."""

    def of_row(row: Column, at: Column) -> Column:
        op, name = F.lit(None).cast("string"), F.lit(None).cast("string")
        for prefix, kind in PATCH_OPS.items():
            hit = F.startswith(row, F.lit(prefix))
            op, name = F.when(hit, kind).otherwise(op), F.when(hit, trim_space(F.substring(row, len(prefix) + 1, 1 << 30))).otherwise(name)
        return _event("file", name, name != "", at, ts, op=op)

    return F.transform(F.split(patch, "\n"), of_row)


def rollout_steps(lines: DataFrame) -> DataFrame:
    """Steps of the `rollout` dialect."""
    e = lines.withColumn("v", _parse(F.col("line"))).drop("line")
    e = e.withColumns({"type": _get("v", "$.type"), "ts": rfc3339(_get("v", "$.timestamp")), "p": F.try_variant_get("v", "$.payload", "variant")})
    e = e.withColumns({"kind": _get("p", "$.type"), "name": _get("p", "$.name"), "role": _get("p", "$.role"), "arguments": _get("p", "$.arguments")})
    parts = F.try_variant_get("p", "$.content", "array<variant>")
    texts = F.filter(F.transform(parts, lambda x: F.when(_get(x, "$.type").isin("input_text", "output_text"), _get(x, "$.text"))), lambda t: t.isNotNull() & (trim_space(t) != ""))
    out = F.try_variant_get("p", "$.output", "variant")
    output = F.coalesce(F.when(F.schema_of_variant(out) == "STRING", _get("p", "$.output")).otherwise(F.to_json(out)), F.lit(""))
    ts, c = F.col("ts"), F.col
    item = (c("type") == "response_item") & c("p").isNotNull()
    call = item & (c("kind") == "function_call")
    answer = item & (c("kind") == "function_call_output")
    patch = F.when(call & (c("name") == "apply_patch"), _get(F.try_parse_json("arguments"), "$.input")).when(item & (c("kind") == "custom_tool_call") & (c("name") == "apply_patch"), _get("p", "$.input"))
    e = e.withColumns({"said": trim_space(F.array_join(texts, "\n")), "output": F.when(answer, output), "command": F.when(call & c("name").isin(*SHELL_TOOLS), command_text(c("arguments"))), "patch": patch, "final": _get("p", "$.last_agent_message")})
    entry = c("type").isin("session_meta", "turn_context", "response_item", "event_msg") & c("p").isNotNull()
    meta = entry & c("type").isin("session_meta", "turn_context")
    message = item & (c("kind") == "message") & (c("said") != "")
    text = lambda kind, path, when: _event(kind, _get("p", path), when & (_get("p", path) != ""), ts=ts)
    return _explode(e, [
        _event("entry", F.lit(None), entry, ts=ts),
        text("cwd", "$.cwd", meta),
        text("branch", "$.git.branch", meta),
        _event("user", c("said"), message & (c("role") == "user") & ~_starts(c("said"), INJECTED), ts=ts),
        _event("assistant", c("said"), message & (c("role") == "assistant"), ts=ts),
        _event("final", c("final"), entry & (c("type") == "event_msg") & (c("kind") == "task_complete") & (trim_space(c("final")) != ""), ts=ts),
        _event("command", c("command"), c("command") != "", ts=ts, call=F.nullif(_get("p", "$.call_id"), F.lit(""))),
        _event("result", output_text(c("output")), answer, ts=ts, call=_get("p", "$.call_id"), error=output_failed(c("output"))),
    ], [patch_files(c("patch"), ts)])


def _text(value: object) -> str:
    return value if isinstance(value, str) else ""


def _dict(value: object) -> dict:
    return value if isinstance(value, dict) else {}


def _texts(content: object, kinds: tuple[str, ...]) -> list[str]:
    return [_text(b.get("text")) for b in content if isinstance(b, dict) and b.get("type") in kinds] if isinstance(content, list) else []


def blocks_seen(entry: dict) -> str | None:
    """Whether an entry is a prompt or a message, as its steps are."""
    content = _dict(entry.get("message")).get("content")
    if entry.get("isSidechain") is True:
        return None
    if entry.get("type") == "user" and entry.get("isMeta") is not True:
        prompt = (content if isinstance(content, str) else "\n".join(t for t in _texts(content, ("text",)) if t)).strip()
        return "prompt" if prompt and not prompt.startswith(NOT_PROMPTS) else None
    return "message" if entry.get("type") == "assistant" and any(t.strip() for t in _texts(content, ("text",))) else None


def blocks_cwd(entry: dict) -> str | None:
    return _text(entry.get("cwd")) or None if entry.get("type") in ("user", "assistant") and entry.get("isSidechain") is not True else None


def rollout_seen(entry: dict) -> str | None:
    p = _dict(entry.get("payload"))
    if entry.get("type") == "event_msg":
        return "message" if p.get("type") == "task_complete" and _text(p.get("last_agent_message")).strip() else None
    if entry.get("type") != "response_item" or p.get("type") != "message":
        return None
    said = "\n".join(t for t in _texts(p.get("content"), ("input_text", "output_text")) if t.strip()).strip()
    if p.get("role") == "user":
        return "prompt" if said and not said.startswith(INJECTED) else None
    return "message" if said and p.get("role") == "assistant" else None


def rollout_cwd(entry: dict) -> str | None:
    return _text(_dict(entry.get("payload")).get("cwd")) or None if entry.get("type") in ("session_meta", "turn_context") else None


@dataclass(frozen=True)
class Dialect:
    """What the engine knows of a kind of transcript. layout: `folders` (<root>/<project>/<file>) or `days`
    (<root>/<y>/<m>/<d>/<file>); prefix: of its files, which end in .jsonl; steps: lines to steps; seen: whether an
    entry (the JSON object of a line) is a "prompt" or a "message"; cwd: the working directory an entry names;
    id_pattern: of the session's id in the file's stem, where that is not all of it."""

    name: str
    layout: str
    steps: Callable[[DataFrame], DataFrame]
    seen: Callable[[dict], str | None]
    cwd: Callable[[dict], str | None]
    prefix: str = ""
    id_pattern: str | None = None

    def __call__(self, lines: DataFrame) -> DataFrame:
        return self.steps(lines)

    def is_file(self, name: str) -> bool:
        return name.startswith(self.prefix) and name.endswith(".jsonl")


DIALECTS: dict[str, Dialect] = {}


def register(dialect: Dialect) -> Dialect:
    if dialect.layout not in ("folders", "days"):
        raise ValueError("a layout is folders or days")
    DIALECTS[dialect.name] = dialect
    return dialect


register(Dialect("blocks", "folders", blocks_steps, blocks_seen, blocks_cwd))
register(Dialect("rollout", "days", rollout_steps, rollout_seen, rollout_cwd, prefix="rollout-", id_pattern=UUID))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jsonl$", "")


def session_id(dialect: str, path: Column) -> Column:
    """The file's stem, or what the dialect's pattern finds in it."""
    stem, pattern = file_stem(path), DIALECTS[dialect].id_pattern
    return F.coalesce(F.nullif(F.regexp_extract(stem, pattern, 0), F.lit("")), stem) if pattern else stem


def project_slug(path: str) -> str:
    """The folder that the `blocks` dialect keeps a project's transcripts in."""
    return re.sub("[^A-Za-z0-9]", "-", path)


def folder_test(repos: Iterable[str]) -> Callable[[str], bool]:
    """Whether a project folder can hold transcripts of those repositories or of directories in them: by their paths
    as given, and with links resolved."""
    slugs = {project_slug(p) for r in repos for p in (os.path.normpath(r), os.path.realpath(r))}
    return lambda name: any(name == s or name.startswith(f"{s}-") for s in slugs)


def folders(spark: SparkSession, at: str) -> list[str]:
    """Names of the folders in a folder; none if it doesn't exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []


def places(spark: SparkSession, root: str, dialect: str, repos: Sequence[str] | None = None, since: datetime | None = None) -> list[str]:
    """The folders of a dialect's root that can hold transcripts of those repositories (their own and those of
    directories in them) and, of days, not two days or more before since. Only folders are listed here."""
    if DIALECTS[dialect].layout == "folders":
        own = folder_test(repos) if repos is not None else None
        return [f"{root}/{name}" for name in folders(spark, root) if own is None or own(name)]
    out = []
    for year in folders(spark, root):
        for month in folders(spark, f"{root}/{year}") if re.fullmatch("[0-9]+", year) else []:
            for day in folders(spark, f"{root}/{year}/{month}") if re.fullmatch("[0-9]+", month) else []:
                try:
                    date = datetime.strptime(f"{year}/{month}/{day}", "%Y/%m/%d")
                except ValueError:
                    continue
                if since is None or date + timedelta(days=2) >= since:
                    out.append(f"{root}/{year}/{month}/{day}")
    return out


def last_files(spark: SparkSession, folder: str, dialect: str, newest: int) -> list[str]:
    """The files of a folder that were modified last, as a listing of it tells."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    files = [(-s.getModificationTime(), s.getPath().toString()) for s in listed if s.isFile()]
    named = [f for f in files if DIALECTS[dialect].is_file(f[1].rpartition("/")[2])]
    return [name for _, name in sorted(named)[:newest]]


def discover(spark: SparkSession, root: str, dialect: str, since: datetime | None = None, repos: Sequence[str] | None = None, newest: int | None = None) -> DataFrame:
    """raw_lines of a dialect's folder: `<root>/<project>/*.jsonl`, or `<root>/<y>/<m>/<d>/rollout-*.jsonl` with
    days of digits. since: a time of modification in UTC; repos: roots of repositories. Folders that either rules
    out are not listed further, files that are too old not read. newest: of each folder only so many files are
    read, those modified last (ties: the first paths)."""
    found = places(spark, root, dialect, repos, since)
    if newest is not None:
        found = [f for folder in found for f in last_files(spark, folder, dialect, newest)]
    if not found:
        return lines_of(spark.createDataFrame([], "path string, modified timestamp, size bigint, block bigint, line string"))
    reader = spark.read.option("lineSep", "\n").option("pathGlobFilter", f"{DIALECTS[dialect].prefix}*.jsonl").option("ignoreMissingFiles", True)
    if since is not None:
        # the reader wants later than to the second, in its session's zone; the exact bound is filtered on metadata
        reader = reader.option("modifiedAfter", (since - timedelta(seconds=1)).strftime("%Y-%m-%dT%H:%M:%S")).option("timeZone", "UTC")
    lines = scanned(reader.text(found))
    return lines_of(lines.filter(F.col("modified") >= F.timestamp_micros(F.lit(round(since.replace(tzinfo=timezone.utc).timestamp() * 1e6)))) if since is not None else lines)


def early_cwd(steps: DataFrame, lines: int = 64) -> DataFrame:
    """steps with early: whether the step is in one of its file's first lines. Where line steps are left, they count."""
    w = Window.partitionBy("path").orderBy("line_no").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("early", F.count_if(F.col("kind") == "line").over(w) <= lines)


def first_cwd(steps: DataFrame, lines: int = 64) -> DataFrame:
    """path and its first non-empty working directory, looked for in the first lines only."""
    return early_cwd(steps, lines).filter((F.col("kind") == "cwd") & F.col("early")).groupBy("path").agg(F.min_by("text", F.struct("line_no", "block_no")).alias("cwd"))
