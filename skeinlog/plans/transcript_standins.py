"""Events as whole transcripts, with all that lines of the two dialects can hold, each query with its SQL.

An event is a line of its user's transcript; event_id modulo 12 says what kind of line. There are malformed lines, side
chains, harness entries, titles, branches, times, prompts of both forms, tools, patches, results and final messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..sources import files, transcripts
from . import api
from .standins import ISO, as_lines, iso, query, table


def _lit(value: object, name: str) -> Column:
    return F.lit(value).alias(name)


def _of_kind(lines: dict[int, Column]) -> Column:
    return F.coalesce(*[F.when(F.col("k") == k, v) for k, v in lines.items()])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return e.withColumns({"k": F.col("event_id") % 12, "name": F.concat(F.lit("e"), F.col("event_id")), "home": F.concat(F.lit("/srv/u"), "user_id"), "stamp": stamp})


def blocks_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, name, ts = _events(spark, sf_dir), F.col("name"), F.col("stamp").alias("timestamp")
    said = lambda text: F.struct(text.alias("content")).alias("message")
    blocks = lambda *b: F.struct(F.array(*b).alias("content")).alias("message")
    block = lambda kind, **f: F.struct(_lit(kind, "type"), *(v.alias(k) for k, v in f.items()))
    kind = {"user": _lit("user", "type"), "assistant": _lit("assistant", "type")}
    entry = lambda of, *fields: F.to_json(F.struct(kind[of], *fields))
    chatter = F.when(F.col("event_id") % 24 == 3, "<command-name>").otherwise("[Request interrupted by ")
    big = F.col("value") > 50
    texts = F.from_json(F.concat(F.lit('[{"type":"text","text":"first '), name, F.lit('"},{"type":"image"},{"type":"text","text":"second"},{"type":"text","text":""}]')), "array<struct<type:string,text:string>>")
    lines = {
        0: F.concat(F.lit('{"type":"user","message":{"content":"'), name),
        1: entry("user", _lit(True, "isSidechain"), ts, _lit("/side", "cwd"), said(name)),
        2: entry("user", _lit(True, "isMeta"), ts, _lit("", "cwd"), said(F.concat(F.lit("meta "), name))),
        3: entry("user", ts, said(F.concat(chatter, name))),
        4: F.to_json(F.struct(_lit("ai-title", "type"), F.concat(F.lit("T "), name).alias("aiTitle"), ts)),
        5: entry("user", ts, F.col("home").alias("cwd"), F.concat(F.lit("b"), F.col("event_id") % 7).alias("gitBranch"), said(F.concat(F.lit("  ask "), name, F.lit("\n")))),
        6: entry("user", F.lit("not a time").alias("timestamp"), said(texts)),
        7: entry("assistant", ts, blocks(F.struct(_lit("thinking", "type"), F.lit(None).cast("string").alias("text")), F.struct(_lit("text", "type"), F.concat(F.lit("said "), name).alias("text")))),
        8: entry("assistant", blocks(block("tool_use", id=F.lit("c"), name=F.lit("Bash"), input=F.struct(F.concat(F.lit("run "), name).alias("command"))))),
        9: entry("user", blocks(block("tool_result", tool_use_id=F.lit("c"), is_error=big, content=F.concat(F.lit("out "), name)))),
        10: entry("assistant", blocks(block("tool_use", id=F.lit("f"), name=F.when(big, "Write").otherwise("Edit"), input=F.struct(F.concat("home", F.lit("/f"), F.col("event_id") % 5).alias("file_path"))))),
        11: F.to_json(F.struct(_lit("summary", "type"), ts, _lit("/late", "cwd"))),
    }
    return as_lines(e.select(F.col("user_id").cast("string").alias("path"), F.unix_micros("ts").alias("line_no"), _of_kind(lines).alias("line")), F.lit(False))


def rollout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, name, ts = _events(spark, sf_dir), F.col("name"), F.col("stamp").alias("timestamp")
    line = lambda kind, *fields, stamp=None: F.to_json(F.struct(_lit(kind, "type"), *([stamp] if stamp is not None else []), F.struct(*fields).alias("payload")))
    message = lambda role, kind, text, stamp=None: line("response_item", _lit("message", "type"), _lit(role, "role"), F.array(F.struct(_lit(kind, "type"), text.alias("text"))).alias("content"), stamp=stamp)
    big = F.col("value") > 50
    patch = F.concat(F.lit("*** Begin Patch\n*** "), F.when(big, "Add").otherwise("Update"), F.lit(" File: f"), F.col("event_id") % 5, F.lit("\n+x\n*** End Patch"))
    lines = {
        0: F.when(big, "[1]").otherwise("no json"),
        1: line("session_meta", F.col("home").alias("cwd"), F.struct(F.concat(F.lit("b"), F.col("event_id") % 7).alias("branch")).alias("git"), stamp=ts),
        2: line("turn_context", _lit("/late", "cwd"), stamp=ts),
        3: message("user", "input_text", F.concat(F.lit("<environment_context>"), name)),
        4: line("event_msg", _lit("user_message", "type"), name.alias("message"), stamp=ts),
        5: message("user", "input_text", F.concat(F.lit(" ask "), name), ts),
        6: message("assistant", "output_text", F.concat(F.lit("said "), name)),
        7: line("event_msg", _lit("task_complete", "type"), F.when(big, F.concat(F.lit("final "), name)).otherwise("  ").alias("last_agent_message")),
        8: line("response_item", _lit("function_call", "type"), _lit("shell_command", "name"), _lit("c", "call_id"), F.to_json(F.struct(F.concat(F.lit("run "), name).alias("command"))).alias("arguments")),
        9: line("response_item", _lit("function_call_output", "type"), _lit("c", "call_id"), F.concat(F.lit("out\nExit code: "), big.cast("int")).alias("output")),
        10: line("response_item", _lit("custom_tool_call", "type"), _lit("apply_patch", "name"), patch.alias("input")),
        11: line("compacted", _lit("x", "type"), stamp=ts),
    }
    return as_lines(e.select(F.col("user_id").cast("string").alias("path"), F.unix_micros("ts").alias("line_no"), _of_kind(lines).alias("line")), F.lit(False))


def _told(d: DataFrame) -> DataFrame:
    commands = F.transform("commands", lambda c: F.concat(c["command"], F.when(c["failed"], " failed").otherwise("")))
    touched = F.transform("files", lambda f: F.concat_ws(" ", f["path"], F.array_join(f["ops"], "+"), f["count"].cast("string")))
    tail = F.transform("tail", lambda t: F.concat_ws(" ", t["kind"], t["head"]))
    return d.select(F.col("path").alias("session_id"), "title", "branch", "cwd", iso("start").alias("start"), iso("end").alias("end"), "prompt_count", "first_prompt", "last_prompt", "last_message", F.array_join(commands, ", ").alias("commands"), F.array_join(touched, ", ").alias("files"), F.array_join(tail, ", ").alias("tail"))


def _sql(kinds: dict[str, str], title: str, branch: str, cwd: str, file: str) -> str:
    """The digests of events; kinds: conditions on k (and value) for prompt, message, command, result, touch and timed,
    and in text what a line says."""
    return rf"""
WITH e AS (SELECT *, event_id % 12 AS k, 'e' || event_id AS name, '/srv/u' || user_id AS home, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS line FROM events),
x AS (SELECT *, {kinds['text']} AS text, {file} AS file, CASE WHEN value > 50 THEN 'write' ELSE 'edit' END AS op FROM e),
p AS (SELECT *, lag(k) OVER w AS before, lag(text) OVER w AS called, lead(k) OVER w AS after, lead(value) OVER w AS after_value FROM x WHERE k IN (8, 9) WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
c AS (SELECT user_id, string_agg(text || CASE WHEN after = 9 AND after_value > 50 THEN ' failed' ELSE '' END, ', ' ORDER BY ts) AS commands FROM p WHERE k = 8 GROUP BY user_id),
o AS (SELECT user_id, file, op, min(ts) AS t0, count(*) AS n FROM x WHERE k = 10 GROUP BY ALL),
f AS (SELECT user_id, file, string_agg(op, '+' ORDER BY t0) AS ops, min(t0) AS t0, sum(n) AS n FROM o GROUP BY ALL),
g AS (SELECT user_id, string_agg(file || ' ' || ops || ' ' || n, ', ' ORDER BY t0) AS files FROM f GROUP BY user_id),
a AS (SELECT user_id, ts, CASE WHEN {kinds['prompt']} THEN 'user' WHEN k = {kinds['said']} THEN 'assistant' WHEN k = 8 THEN 'command' ELSE 'file' END AS kind, CASE WHEN k = 10 THEN file ELSE string_split(text, chr(10))[1] END AS head
      FROM x WHERE {kinds['prompt']} OR k IN ({kinds['said']}, 8, 10)
      UNION ALL SELECT user_id, ts, 'failure', called FROM p WHERE k = 9 AND before = 8 AND value > 50),
t AS (SELECT user_id, string_agg(kind || ' ' || head, ', ' ORDER BY ts) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM a) WHERE n <= 30 GROUP BY user_id),
h AS (SELECT user_id, {title} AS title, {branch} AS branch, {cwd} AS cwd, min(ts) FILTER (WHERE {kinds['timed']}) AS start, max(ts) FILTER (WHERE {kinds['timed']}) AS "end",
             count(*) FILTER (WHERE {kinds['prompt']}) AS n, arg_min(text, ts) FILTER (WHERE {kinds['prompt']}) AS first_prompt, arg_max(text, ts) FILTER (WHERE {kinds['prompt']}) AS last_prompt,
             arg_max(text, ts) FILTER (WHERE {kinds['message']}) AS last_message FROM x GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS session_id, title, branch, cwd, {ISO.format('start')} AS start, {ISO.format('"end"')} AS "end", CAST(n AS INTEGER) AS prompt_count, first_prompt, last_prompt, last_message,
       coalesce(commands, '') AS commands, coalesce(files, '') AS files, coalesce(tail, '') AS tail
FROM h LEFT JOIN c USING (user_id) LEFT JOIN g USING (user_id) LEFT JOIN t USING (user_id) WHERE n > 0
"""


_BLOCKS = {
    "prompt": "k IN (5, 6)", "message": "k = 7", "said": "7", "timed": "k IN (2, 3, 5, 7)",
    "text": "CASE k WHEN 5 THEN 'ask ' || name WHEN 6 THEN 'first ' || name || chr(10) || 'second' WHEN 7 THEN 'said ' || name WHEN 8 THEN 'run ' || name END",
}
_BLOCKS_SQL = _sql(_BLOCKS, "arg_max('T ' || name, ts) FILTER (WHERE k = 4)", "arg_max('b' || event_id % 7, ts) FILTER (WHERE k = 5)", "arg_min(home, ts) FILTER (WHERE k = 5 AND line <= 64)", "home || '/f' || event_id % 5")


@query(_BLOCKS_SQL)
def blocks_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(api.digests(blocks_lines(spark, sf_dir), "blocks", tail=True))


_ROLLOUT = {
    "prompt": "k = 5", "message": "(k = 6 OR k = 7 AND value > 50)", "said": "6", "timed": "k IN (1, 2, 4, 5)",
    "text": "CASE k WHEN 5 THEN 'ask ' || name WHEN 6 THEN 'said ' || name WHEN 7 THEN 'final ' || name WHEN 8 THEN 'run ' || name END",
}


@query(_sql(_ROLLOUT, "CAST(NULL AS VARCHAR)", "arg_max('b' || event_id % 7, ts) FILTER (WHERE k = 1)", "arg_min(CASE WHEN k = 1 THEN home ELSE '/late' END, ts) FILTER (WHERE k IN (1, 2) AND line <= 64)", "'f' || event_id % 5"))
def rollout_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(api.digests(rollout_lines(spark, sf_dir), "rollout", tail=True))


def write_blocks(spark: SparkSession, sf_dir: str) -> str:
    """The blocks transcripts as files in a shared folder: its path."""
    root = session.scratch(spark)
    lines = blocks_lines(spark, sf_dir).withColumn("file", F.concat(F.lit("-srv-u"), "path", F.lit("/"), "path", F.lit(".jsonl")))
    files.write_lines(lines, root).count()
    return root


@query(_BLOCKS_SQL)
def file_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the data source: every folder, every file, in byte ranges."""
    d = api.digests(files.lines(spark, write_blocks(spark, sf_dir), "blocks"), "blocks", tail=True, complete=True)
    return _told(d.withColumn("path", transcripts.session_id("blocks", F.col("path"))))


@query(f"""
WITH d AS ({_BLOCKS_SQL})
SELECT cwd AS root, session_id, true AS whole, title, start, prompt_count, first_prompt, last_prompt, last_message, regexp_replace(files, '/srv/u[0-9]+/', '', 'g') AS files FROM d WHERE cwd IS NOT NULL
""")
def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found by probes of their first lines and read in waves, for each repository."""
    root = write_blocks(spark, sf_dir)
    repos = table(spark, sf_dir, "events").select(F.concat(F.lit("/srv/u"), "user_id").alias("root"), F.col("user_id").cast("string").alias("name")).distinct()
    d = api.load_recent(spark, {"a": ("blocks", root)}, repos)
    touched = F.transform("files", lambda f: F.concat_ws(" ", f["path"], F.array_join(f["ops"], "+"), f["count"].cast("string")))
    return d.select("root", "session_id", "whole", "title", iso("start").alias("start"), "prompt_count", "first_prompt", "last_prompt", "last_message", F.array_join(touched, ", ").alias("files"))
