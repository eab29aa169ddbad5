"""The engine's operators on general tables, each with the SQL that must give the same rows.

The tables hold no transcripts, so each query maps its operator's relations to what is there:
conversations are sessions, events are steps, orders are session files, customers and suppliers are
registry entries, documents are notes and field texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.redact import redact, scrub
from ..operators import cards, digest, manifest, notes, registry, select
from ..sources import transcripts
from . import api, brief

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "2024-02-01 00:00:00"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its timestamps in UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def iso(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


ISO = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def sql_inline(s: str) -> str:
    return rf"regexp_replace(trim(regexp_replace({s}, '\s+', ' ', 'g')), '^#+ ?', '')"


def sql_cut(s: str, n: int) -> str:
    return f"CASE WHEN length({s}) > {n} THEN rtrim(left({s}, {n})) || '…' ELSE {s} END"


# eight characters at least, one of them a digit or sign: the pattern language has no look-ahead
_EIGHT = "|".join([*(f"[A-Za-z._~-]{{{k}}}[0-9+/=][A-Za-z0-9+/=._~-]{{{7 - k},}}" for k in range(7)), "[A-Za-z._~-]{7,}[0-9+/=][A-Za-z0-9+/=._~-]*"])
_RE = [
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[redacted]"), (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*", "[redacted]"),
    (r"(^|[^A-Za-z0-9])sk-[A-Za-z0-9_-]{10,}", r"\1[redacted]"), (r"([a-z][a-z0-9+.-]*://[^/\s:@]+:)[^@\s/]+@", r"\1[redacted]@"),
    (r"(?i)(--(?:token|password|passwd|secret|api-key|apikey)[= ])\S+", r"\1[redacted]"), (rf"\b(Basic|Token|Bearer)(\s+)(?:{_EIGHT})", r"\1\2[redacted]"),
    (r"gh[pousr]_[A-Za-z0-9]{20,}", "[redacted]"), (r"github_pat_[A-Za-z0-9_]{20,}", "[redacted]"), (r"xox[abprs]-[A-Za-z0-9-]{8,}", "[redacted]"), (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "[redacted]"),
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[redacted]"), (r"\b(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{10,}", "[redacted]"), (r"\bAIza[0-9A-Za-z_-]{30,}", "[redacted]"), (r"\bnpm_[A-Za-z0-9]{30,}", "[redacted]"),
    (r"(?i)([A-Za-z0-9_.-]*(?:secret|password|passwd|token|api[_-]?key|private[_-]?key|credential|auth)[A-Za-z0-9_.-]*[\"']?\s*[:=]\s*[\"']?)[^\s\",']+", r"\1[redacted]"),
]


def sql_redact(s: str) -> str:
    for pattern, to in _RE:
        s = f"regexp_replace({s}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return s


# --- sessions -----------------------------------------------------------------------------------


def conversation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    text = tx.trim_space(F.col("text"))
    kind = F.when((F.col("role") == "user") & ~transcripts._starts(text, transcripts.NOT_PROMPTS), "user").when(F.col("role") == "assistant", "assistant").otherwise("entry")
    n = lambda t: F.lit(None).cast(t)
    return c.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("int").alias("line_no"), F.lit(0).alias("block_no"), n("timestamp").alias("ts"), kind.alias("kind"), text.alias("text"), n("string").alias("op"), n("string").alias("call_id"), n("boolean").alias("is_error"))


@query(r"""
WITH c AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(count(*) FILTER (WHERE role = 'user') AS INTEGER) AS prompt_count,
       arg_min(text, turn) FILTER (WHERE role = 'user') AS first_prompt, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_prompt,
       arg_max(text, turn) FILTER (WHERE role = 'assistant') AS last_message
FROM c GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') > 0
""")
def session_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = digest.sessions(conversation_steps(spark, sf_dir))
    return d.select(F.col("path").alias("session_id"), "prompt_count", "first_prompt", "last_prompt", "last_message")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("root"), F.col("o_orderdate").alias("modified"), F.col("o_orderstatus").alias("source_order"), F.col("o_orderkey").alias("path"))


@query("""
SELECT o_custkey AS repo, o_orderkey AS session_id, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderstatus, o_orderkey) AS r FROM orders) WHERE r <= 3
""")
def session_top3_per_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.ranked(refs(spark, sf_dir)).select(F.col("root").alias("repo"), "session_id", "rank")


@query("""
SELECT o_custkey AS repo, o_orderkey AS session_id, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey = 77 THEN 0 ELSE 1 END, o_orderdate DESC, o_orderstatus, o_orderkey) AS r FROM orders) WHERE r <= 3
""")
def forced_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.ranked(refs(spark, sf_dir), forced=77).select(F.col("root").alias("repo"), "session_id", "rank")


@query("SELECT o_orderkey AS session_id FROM orders WHERE o_orderkey <> 77 AND o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 90 DAY")
def exclude_and_age_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = select.recent(refs(spark, sf_dir), F.lit("1998-06-01 00:00:00").cast("timestamp"), days=90)
    return select.exclude(out, 77).select("session_id")


@query(f"""
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS agent, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderstatus, o_orderkey) AS INTEGER) AS rank,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS start, '0001-01-01T00:00:00Z' AS "end" FROM orders ORDER BY o_orderdate DESC, o_orderstatus, o_orderkey LIMIT 50
""")
def recent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = {"root": F.lit("/all"), "agent": F.col("source_order"), "session_id": F.col("session_id").cast("string"), "title": F.lit(None).cast("string"), "branch": F.lit("b"), "start": F.col("modified"), "end": F.lit(None).cast("timestamp"), "prompt_count": F.lit(1)}
    return api.list_sessions(refs(spark, sf_dir).withColumns(one), 99).select("id", "agent", "rank", "start", "end")


def as_lines(rows: DataFrame, lose_last: Column) -> DataFrame:
    """rows (path, line_no, line) as lines of files, of which those of lose_last end without a line break."""
    rows = rows.withColumn("bytes", F.octet_length("line").cast("bigint"))
    size = F.sum(F.col("bytes") + 1).over(Window.partitionBy("path")) - lose_last.cast("int")
    return rows.select("path", now().alias("modified"), size.alias("size"), F.col("line_no").cast("bigint").alias("line_no"), "bytes", "line")


def conversation_lines(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    """Conversations as transcripts; of every third the last line has no line break."""
    c = table(spark, sf_dir, "conversations")
    lit, text = (lambda x, name: F.lit(x).alias(name)), F.coalesce("text", F.lit(""))
    if dialect == "blocks":
        c = c.filter("conv_id % 2 = 0")
        plain = F.struct(text.alias("content")).alias("message")
        said = F.struct(F.array(F.struct(lit("text", "type"), text.alias("text"))).alias("content")).alias("message")
        line = F.when(F.col("role") == "user", F.to_json(F.struct(lit("user", "type"), lit("/srv/a", "cwd"), plain))).when(F.col("role") == "assistant", F.to_json(F.struct(lit("assistant", "type"), said))).otherwise(F.to_json(F.struct(lit("user", "type"), F.lit(True).alias("isMeta"), plain)))
    else:
        c = c.filter("conv_id % 2 <> 0")
        part = lambda kind: F.array(F.struct(lit(kind, "type"), text.alias("text"))).alias("content")
        item = lambda role, kind: F.to_json(F.struct(lit("response_item", "type"), F.struct(lit("message", "type"), lit(role, "role"), part(kind)).alias("payload")))
        line = F.when(F.col("role") == "user", item("user", "input_text")).when(F.col("role") == "assistant", item("assistant", "output_text")).otherwise(F.to_json(F.struct(lit("event_msg", "type"), F.struct(lit("user_message", "type"), text.alias("message")).alias("payload"))))
    return as_lines(c.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line_no"), line.alias("line")), F.col("path").cast("bigint") % 3 == 0)


@query(r"""
WITH c AS (SELECT *, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
k AS (SELECT conv_id, turn, role, t, CASE WHEN conv_id % 2 = 0 THEN coalesce(text, '') ELSE t END AS said FROM c WHERE NOT (conv_id % 3 = 0 AND r = 1) AND t <> '')
SELECT CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'blocks' ELSE 'rollout' END AS agent, CASE WHEN conv_id % 2 = 0 THEN '/srv/a' END AS cwd,
       CAST(count(*) FILTER (WHERE role = 'user') AS INTEGER) AS prompt_count, arg_min(t, turn) FILTER (WHERE role = 'user') AS first_prompt,
       arg_max(t, turn) FILTER (WHERE role = 'user') AS last_prompt, arg_max(said, turn) FILTER (WHERE role = 'assistant') AS last_message
FROM k GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') > 0
""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [api.digests(conversation_lines(spark, sf_dir, d), d).withColumn("agent", F.lit(d)) for d in ("blocks", "rollout")]
    return parts[0].unionByName(parts[1]).select(F.col("path").alias("session_id"), "agent", "cwd", "prompt_count", "first_prompt", "last_prompt", "last_message")


# --- steps --------------------------------------------------------------------------------------


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for x in ("click", "command", "error", "result", "view", "assistant", "signup", "user", "purchase", "file")])[F.col("event_type")]
    call = F.when(F.col("event_type").isin("click", "error"), F.lit("call"))
    return e.select(F.col("user_id").cast("string").alias("path"), F.unix_micros("ts").alias("line_no"), F.lit(0).alias("block_no"), "ts", kind.alias("kind"), F.concat(F.lit("e"), F.col("event_id")).alias("text"), F.lit("edit").alias("op"), call.alias("call_id"), (F.col("value") > 50).alias("is_error"))


@query("""
WITH e AS (SELECT *, lead(event_type) OVER w AS after_type, lead(value) OVER w AS after_value
           FROM events WHERE event_type IN ('click', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT CAST(user_id AS VARCHAR) AS session_id, 'e' || event_id AS command, coalesce(after_type = 'error' AND after_value > 50, false) AS failed FROM e WHERE event_type = 'click'
""")
def pair_call_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = digest.pair_results(event_steps(spark, sf_dir)).filter("kind = 'command'")
    return p.select(F.col("path").alias("session_id"), F.col("text").alias("command"), F.coalesce("failed", F.lit(False)).alias("failed"))


@query("""
SELECT CAST(user_id AS VARCHAR) AS session_id, string_agg('e' || event_id, ', ' ORDER BY ts) AS failed FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM (
    SELECT *, lead(event_type) OVER w AS after_type, lead(value) OVER w AS after_value
    FROM events WHERE event_type IN ('click', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts))
  WHERE event_type = 'click' AND after_type = 'error' AND after_value > 50) WHERE r <= 3 GROUP BY user_id
""")
def last3_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = digest.pair_results(event_steps(spark, sf_dir)).filter("kind = 'command'")
    c = p.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", F.col("text").alias("command"), F.coalesce("failed", F.lit(False)).alias("failed")))).alias("c"))
    out = c.select(F.col("path").alias("session_id"), F.array_join(select.last_failed(F.col("c")), ", ").alias("failed"))
    return out.filter("failed <> ''")


@query("""
WITH a AS (
  SELECT user_id, ts, 'e' || event_id AS head, CASE event_type WHEN 'click' THEN 'command' WHEN 'view' THEN 'assistant' WHEN 'signup' THEN 'user' ELSE 'file' END AS kind
  FROM events WHERE event_type <> 'error'
  UNION ALL
  SELECT user_id, ts, before AS head, 'failure' FROM (
    SELECT *, lag(event_type) OVER w AS before_type, 'e' || lag(event_id) OVER w AS before
    FROM events WHERE event_type IN ('click', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts))
  WHERE event_type = 'error' AND before_type = 'click' AND value > 50
), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, kind DESC) AS n FROM a)
SELECT CAST(user_id AS VARCHAR) AS session_id, string_agg(kind || ' ' || head, ', ' ORDER BY n DESC) AS tail FROM r WHERE n <= 30 GROUP BY user_id
""")
def tail30(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = digest.tails(event_steps(spark, sf_dir))
    return t.select(F.col("path").alias("session_id"), F.array_join(F.transform("tail", lambda x: F.concat_ws(" ", x["kind"], x["head"])), ", ").alias("tail"))


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("block_no"), F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("text"), F.col("l_returnflag").alias("op"))


TOUCHES = """
WITH t AS (SELECT l_orderkey, 'p' || (l_partkey % 50) AS file, l_linenumber AS a, l_suppkey AS b, l_returnflag AS op FROM lineitem),
o AS (SELECT l_orderkey, file, op, min(CAST(a AS BIGINT) * 1000000000 + b) AS t0 FROM t GROUP BY ALL),
f AS (SELECT l_orderkey, file, string_agg(op, '+' ORDER BY t0, op) AS ops, min(t0) AS t0 FROM o GROUP BY ALL),
n AS (SELECT l_orderkey, file, count(*) AS n FROM t GROUP BY ALL)
"""


@query(TOUCHES + """
SELECT CAST(l_orderkey AS VARCHAR) AS session_id, string_agg(file || ' (' || ops || CASE WHEN n > 1 THEN '×' || n ELSE '' END || ')', ', ' ORDER BY t0, file) AS files, count(*) AS n_files
FROM f JOIN n USING (l_orderkey, file) GROUP BY l_orderkey
""")
def file_touch_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = digest.touched_files(touches(spark, sf_dir))
    return f.select(F.col("path").alias("session_id"), F.array_join(F.transform("files", brief.file_label), ", ").alias("files"), F.size("files").cast("bigint").alias("n_files"))


@query(TOUCHES + "SELECT CAST(l_orderkey AS VARCHAR) AS session_id, file, ops FROM f WHERE ops LIKE '%+%'")
def ops_distinct_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = digest.touched_files(touches(spark, sf_dir)).select("path", F.explode("files").alias("f"))
    return f.select(F.col("path").alias("session_id"), F.col("f.path").alias("file"), F.array_join("f.ops", "+").alias("ops")).filter(F.contains("ops", F.lit("+")))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a rollout transcript: clicks are commands, errors their outputs, purchases patches."""
    e = table(spark, sf_dir, "events")
    lit, name = (lambda x, k: F.lit(x).alias(k)), F.concat(F.lit("e"), F.col("event_id"))
    item = lambda *fields: F.to_json(F.struct(lit("response_item", "type"), F.struct(*fields).alias("payload")))
    said = lambda role, kind: item(lit("message", "type"), lit(role, "role"), F.array(F.struct(lit(kind, "type"), name.alias("text"))).alias("content"))
    command = F.to_json(F.struct(F.array(F.lit("bash"), F.lit("-lc"), F.concat(name, F.lit(" --now"))).alias("command")))
    output = F.to_json(F.struct(name.alias("output"), F.struct((F.col("value") > 50).cast("int").alias("exit_code")).alias("metadata")))
    patch = F.concat(F.lit("*** Begin Patch\n*** "), F.when(F.col("value") > 50, "Add").otherwise("Update"), F.lit(" File: f"), F.col("event_id") % 7, F.lit("\n+x\n"))
    lines = {
        "click": item(lit("function_call", "type"), lit("shell", "name"), lit("c", "call_id"), command.alias("arguments")), "error": item(lit("function_call_output", "type"), lit("c", "call_id"), output.alias("output")),
        "view": said("assistant", "output_text"), "signup": said("user", "input_text"), "purchase": item(lit("custom_tool_call", "type"), lit("apply_patch", "name"), patch.alias("input")),
    }
    line = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in lines.items()])
    return as_lines(e.select(F.col("user_id").cast("string").alias("path"), F.unix_micros("ts").alias("line_no"), line.alias("line")), F.lit(False))


@query("""
WITH e AS (SELECT *, 'e' || event_id AS name FROM events),
p AS (SELECT *, lead(event_type) OVER w AS after_type, lead(value) OVER w AS after_value FROM e WHERE event_type IN ('click', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
c AS (SELECT user_id, string_agg(name || ' --now' || CASE WHEN after_type = 'error' AND after_value > 50 THEN ' failed' ELSE '' END, ', ' ORDER BY ts) AS commands FROM p WHERE event_type = 'click' GROUP BY user_id),
t AS (SELECT user_id, 'f' || event_id % 7 AS file, CASE WHEN value > 50 THEN 'write' ELSE 'edit' END AS op, ts FROM e WHERE event_type = 'purchase'),
o AS (SELECT user_id, file, op, min(ts) AS t0, count(*) AS n FROM t GROUP BY ALL),
f AS (SELECT user_id, file, string_agg(op, '+' ORDER BY t0) AS ops, min(t0) AS t0, sum(n) AS n FROM o GROUP BY ALL),
g AS (SELECT user_id, string_agg(file || ' ' || ops || ' ' || n, ', ' ORDER BY t0) AS files FROM f GROUP BY user_id),
h AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') AS n, arg_min(name, ts) FILTER (WHERE event_type = 'signup') AS first_prompt, arg_max(name, ts) FILTER (WHERE event_type = 'signup') AS last_prompt,
             arg_max(name, ts) FILTER (WHERE event_type = 'view') AS last_message FROM e GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(n AS INTEGER) AS prompt_count, first_prompt, last_prompt, last_message, coalesce(commands, '') AS commands, coalesce(files, '') AS files
FROM h LEFT JOIN c USING (user_id) LEFT JOIN g USING (user_id) WHERE n > 0
""")
def rollout_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = api.digests(event_lines(spark, sf_dir), "rollout", tail=True)
    commands = F.transform("commands", lambda c: F.concat(c["command"], F.when(c["failed"], " failed").otherwise("")))
    files = F.transform("files", lambda f: F.concat_ws(" ", f["path"], F.array_join(f["ops"], "+"), f["count"].cast("string")))
    return d.select(F.col("path").alias("session_id"), "prompt_count", "first_prompt", "last_prompt", "last_message", F.array_join(commands, ", ").alias("commands"), F.array_join(files, ", ").alias("files"))


@query("""
SELECT event_id, 1 AS block_no, 'edit' AS op, event_type AS file FROM events
UNION ALL SELECT event_id, 3, CASE WHEN value > 50 THEN 'write' ELSE 'delete' END, 'u/' || user_id FROM events
""")
def explode_patch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = F.concat(F.lit("*** Begin Patch\n*** Update File:   "), "event_type", F.lit(" \n-*** Add File: no\n*** "), F.when(F.col("value") > 50, "Add").otherwise("Delete"), F.lit(" File: u/"), F.col("user_id"), F.lit("\n*** Update File:  \n"))
    found = F.filter(transcripts.patch_files(patch, F.lit(None)), lambda f: f.isNotNull())
    return table(spark, sf_dir, "events").select("event_id", F.explode(found).alias("f")).select("event_id", "f.block_no", "f.op", F.col("f.text").alias("file"))


@query("""
SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'e' || event_id END AS session_id, CASE WHEN event_type NOT IN ('click', 'view') THEN '' END AS cwd FROM events
""")
def hook_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("event_type") == "click", "resume").when(F.col("event_type") == "view", "fork").otherwise(F.col("event_type"))
    r = api.request(F.to_json(F.struct(F.concat(F.lit("e"), F.col("event_id")).alias("session_id"), source.alias("source"), F.lit(3).alias("other"))))
    return table(spark, sf_dir, "events").select("event_id", r.alias("r")).select("event_id", "r.session_id", "r.cwd")


@query("""
SELECT event_id, CASE WHEN value > 80 THEN event_type || ' --n ' || user_id WHEN value > 40 THEN event_type || ' ' || user_id ELSE event_type END AS command,
       value > 60 AS failed FROM events
""")
def command_and_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("user_id").cast("string")
    wrapped = F.to_json(F.struct(F.array(F.lit("bash"), F.lit("-lc"), F.concat_ws(" --n ", "event_type", n)).alias("command")))
    argv = F.to_json(F.struct(F.array("event_type", n).alias("command")))
    arguments = F.when(F.col("value") > 80, wrapped).when(F.col("value") > 40, argv).otherwise(F.to_json(F.struct(F.col("event_type").alias("cmd"))))
    code = F.when(F.col("value") > 60, F.lit(2)).otherwise(0)
    output = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("out\nExit code: "), code.cast("string"), F.lit("\n"))).otherwise(F.to_json(F.struct(F.struct(code.alias("exit_code")).alias("metadata"))))
    return e.select("event_id", transcripts.command_text(arguments).alias("command"), transcripts.output_failed(output).alias("failed"))


# --- notes --------------------------------------------------------------------------------------


@query(f"""
WITH p AS (SELECT user_id, max(ts) AS start FROM events WHERE event_type = 'click' GROUP BY user_id),
n AS (SELECT user_id, arg_max(event_id, ts) AS note_id, max(ts) AS at FROM events WHERE event_type = 'view' GROUP BY user_id),
u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id AS repo, CASE WHEN p.start IS NULL OR n.at >= p.start THEN n.note_id END AS note_id, {ISO.format('p.start')} AS start
FROM u LEFT JOIN p USING (user_id) LEFT JOIN n USING (user_id)
""")
def newest_note_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    primary = e.filter("event_type = 'click'").groupBy("user_id").agg(F.max("ts").alias("start"))
    newest = notes.newest(e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("note_id"), F.col("ts").alias("at")), "user_id")
    rows = e.select("user_id").distinct().join(primary, "user_id", "left").join(newest, "user_id", "left")
    return rows.select(F.col("user_id").alias("repo"), F.when(notes.gate(F.col("at"), F.col("start"), F.col("start").isNotNull()), F.col("note_id")).alias("note_id"), iso("start").alias("start"))


def note_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("note_id"), F.col("source").alias("key"), F.lit("").alias("root"), F.col("lang").alias("agent"), F.timestamp_seconds(F.col("n_chars") * 10**7 - F.col("doc_id")).alias("at"), F.col("text").alias("body"))


def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("src"), F.col("c_custkey") % 12).alias("path"), F.col("c_name").alias("name"), F.col("c_custkey").alias("position"))


@query(rf"""
WITH reg AS (SELECT 'src' || (c_custkey % 12) AS path, arg_max(c_name, c_custkey) AS name FROM customer GROUP BY 1),
n AS (SELECT doc_id, source, lang, text, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents),
lines AS (SELECT doc_id, {sql_inline('line')} AS line, pos FROM (SELECT doc_id, unnest(string_split(safe, chr(10))) AS line, unnest(range(len(string_split(safe, chr(10))))) AS pos FROM (SELECT doc_id, r, {sql_redact('text')} AS safe FROM n) WHERE r <= 50))
SELECT r AS n, CAST(n.doc_id AS VARCHAR) AS note_id, coalesce(reg.name, n.source) AS project, coalesce(reg.path, '') AS root, lang AS agent,
       coalesce((SELECT left(arg_min(line, pos) FILTER (WHERE line <> ''), 120) FROM lines l WHERE l.doc_id = n.doc_id), '') AS title
FROM n LEFT JOIN reg ON n.source = reg.path WHERE r <= 50
""")
def notes_left_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = notes.listing(note_rows(spark, sf_dir), source_registry(spark, sf_dir), limit=99)
    return out.select(F.col("n").cast("bigint").alias("n"), "note_id", "project", F.coalesce("root", F.lit("")).alias("root"), "agent", "title")


# --- registry -----------------------------------------------------------------------------------


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.col("c_name").alias("path"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("remote"), F.concat(F.lit("r"), F.col("c_custkey")).alias("name"), F.col("c_custkey").alias("position"), "c_mktsegment", "c_acctbal")


@query("""
WITH reg AS (SELECT c_name AS path, 'n' || c_nationkey AS remote, 'r' || c_custkey AS name, c_custkey AS position FROM customer WHERE c_custkey % 3 = 0),
r AS (SELECT remote, arg_min(name, position) AS name FROM reg GROUP BY remote)
SELECT c.c_custkey, coalesce(p.name, r.name) AS name FROM customer c LEFT JOIN reg p ON p.path = c.c_name LEFT JOIN r ON r.remote = 'n' || c.c_nationkey
""")
def two_phase_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    return registry.lookup(c.select("c_custkey", "path", "remote"), c.filter(F.col("c_custkey") % 3 == 0).drop("c_custkey")).select("c_custkey", "name")


@query(f"""
WITH old AS (SELECT o_custkey, 'c' || o_custkey AS path, 'g' || o_custkey AS remote, 'n' || o_custkey AS name, max(o_orderdate) AS t FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_custkey),
new AS (SELECT o_custkey, CASE WHEN o_custkey % 4 = 0 THEN 'moved' ELSE 'c' END || o_custkey AS path, CASE WHEN o_custkey % 2 = 0 THEN 'g' || o_custkey ELSE '' END AS remote, 'm' || o_custkey AS name, max(o_orderdate) AS t FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
SELECT coalesce(new.path, old.path) AS path, coalesce(nullif(new.remote, ''), old.remote) AS remote, coalesce(old.name, new.name) AS name,
       {ISO.format('CASE WHEN old.t IS NULL OR new.t > old.t THEN new.t ELSE old.t END')} AS last_seen
FROM old FULL JOIN new ON old.o_custkey = new.o_custkey
""")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", (F.col("o_orderstatus") == "O").alias("is_new")).agg(F.max("o_orderdate").alias("last_seen"))
    key = F.col("o_custkey")
    old = o.filter("not is_new").select(F.concat(F.lit("c"), key).alias("path"), F.concat(F.lit("g"), key).alias("remote"), F.concat(F.lit("n"), key).alias("name"), "last_seen")
    new = o.filter("is_new").select(F.concat(F.when(key % 4 == 0, "moved").otherwise("c"), key).alias("path"), F.when(key % 2 == 0, F.concat(F.lit("g"), key)).otherwise("").alias("remote"), F.concat(F.lit("m"), key).alias("name"), "last_seen")
    return registry.upsert(old, new).withColumn("last_seen", iso("last_seen"))


@query("""
WITH c AS (SELECT 'r' || s_suppkey AS name, s_name AS summary FROM supplier)
SELECT 'r' || c_custkey AS name, c.summary, c.name IS NOT NULL AS has_card FROM customer LEFT JOIN c ON c.name = 'r' || c_custkey
""")
def registry_left_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.with_cards(customers(spark, sf_dir), supplier_cards(spark, sf_dir)).select("name", "summary", "has_card")


def supplier_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("r"), F.col("s_suppkey")).alias("name"), F.col("s_name").alias("summary"), F.lit("").alias("status"), F.lit(None).cast("timestamp").alias("updated"))


@query(f"""
WITH o AS (SELECT o_custkey, max(o_orderdate) AS t FROM orders GROUP BY o_custkey)
SELECT 'r' || o_custkey AS name, s.s_suppkey IS NOT NULL AS has_card, {ISO.format('t')} AS last_seen FROM o LEFT JOIN supplier s ON s.s_suppkey = o_custkey
WHERE (t >= TIMESTAMP '1998-08-01' - INTERVAL 30 DAY OR s.s_suppkey IS NOT NULL) AND o_custkey <> 5
""")
def active_window_or_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_seen"))
    o = o.select(F.concat(F.lit("r"), F.col("o_custkey")).alias("name"), F.col("o_custkey").cast("string").alias("path"), "last_seen")
    items = registry.with_cards(o, supplier_cards(spark, sf_dir))
    return registry.active(items, F.lit("1998-08-01 00:00:00").cast("timestamp"), current="5").select("name", "has_card", iso("last_seen").alias("last_seen"))


# --- cards, indexes, notes as files ---------------------------------------------------------------


def full_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of suppliers with every field, some of which have to be quoted in a file."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    facts = F.transform(F.sequence(F.lit(1), (k % 4 + 1).cast("int")), lambda i: F.concat(F.lit("fact "), i.cast("string"), F.lit(" of "), F.col("s_name")))
    stack = F.when(k % 3 == 0, F.concat(F.lit('"odd": [yes] '), k.cast("string"))).when(k % 3 == 1, F.lit("true")).otherwise("")
    return s.select(
        F.concat(F.lit("r"), k).alias("name"), F.concat(F.lit("/srv/n"), F.col("s_nationkey")).alias("path"), F.when(k % 2 == 0, F.concat(F.lit("h/"), k)).otherwise("").alias("remote"), stack.alias("stack"),
        F.lit("it's: done # almost").alias("status"), F.concat(k.cast("string"), F.lit("e5")).alias("commit"), F.lit("- agent").alias("updated_by"), F.timestamp_seconds(k * 86399 + 1700000000).alias("updated"),
        F.concat("s_name", F.lit(" ships. Often.")).alias("summary"), F.when(k % 5 == 0, F.array(F.lit("docs/a.md"))).otherwise(F.array().cast("array<string>")).alias("read_more"),
        F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(facts).alias("facts"), F.when(k % 4 == 0, "own: 1").otherwise("").alias("extra_front"), F.when(k % 6 == 0, "## Other\ntext").otherwise("").alias("extra_body"),
    )


@query(f"""
SELECT 'r' || s_suppkey AS name, '/srv/n' || s_nationkey AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'h/' || s_suppkey ELSE '' END AS remote,
       CASE s_suppkey % 3 WHEN 0 THEN '"odd": [yes] ' || s_suppkey WHEN 1 THEN 'true' ELSE '' END AS stack, 'it''s: done # almost' AS status, s_suppkey || 'e5' AS "commit", '- agent' AS updated_by,
       {ISO.format('make_timestamp((s_suppkey * 86399 + 1700000000) * 1000000)')} AS updated, s_name || ' ships. Often.' AS summary, CASE WHEN s_suppkey % 5 = 0 THEN 'docs/a.md' ELSE '' END AS read_more,
       CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE array_to_string(['fact ' || i || ' of ' || s_name FOR i IN range(1, s_suppkey % 4 + 2)], ', ') END AS facts,
       CASE WHEN s_suppkey % 4 = 0 THEN 'own: 1' ELSE '' END AS extra_front, CASE WHEN s_suppkey % 6 = 0 THEN '## Other' || chr(10) || 'text' ELSE '' END AS extra_body FROM supplier
""")
def card_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = full_cards(spark, sf_dir).select(F.concat(F.lit("/cards/"), "name", F.lit(".md")).alias("path"), cards.marshal().alias("value"))
    more = spark.createDataFrame([("/cards/index.md", "---\nname: x\n---\n"), ("/cards/no.md", "# no card\n")], "path string, value string")
    out = cards.parse_cards(files.union(more))
    return out.select("name", "path", "remote", "stack", "status", "commit", "updated_by", iso("updated").alias("updated"), "summary", F.array_join("read_more", ", ").alias("read_more"), F.array_join("facts", ", ").alias("facts"), "extra_front", "extra_body")


def seen_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_seen"))
    return customers(spark, sf_dir).join(o, F.col("c_custkey") == F.col("o_custkey")).select("name", "path", "position", "last_seen")


ITEMS = """
WITH i AS (SELECT 'r' || c_custkey AS name, c_name AS path, coalesce(s_name, '(no card yet)') AS blurb, t
  FROM customer JOIN (SELECT o_custkey, max(o_orderdate) AS t FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey = c_custkey)
"""


@query(ITEMS + "SELECT '# Projects' || chr(10) || string_agg('- [[' || name || ']] — ' || blurb || ' · ' || path || chr(10), '' ORDER BY name) AS index FROM i")
def projects_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.index(seen_customers(spark, sf_dir), supplier_cards(spark, sf_dir))


@query(ITEMS + f"""
SELECT name, name || ' · ' || path || ' · ' || blurb || ' · ' || CASE WHEN d < 30 THEN CAST(d AS BIGINT) || 'd ago' WHEN d < 365 THEN CAST(floor(d / 30) AS BIGINT) || 'mo ago' ELSE CAST(floor(d / 365) AS BIGINT) || 'y ago' END AS line
FROM (SELECT *, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(t)) / 86400000000.0) AS d FROM i)
""")
def projects_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.list_projects(seen_customers(spark, sf_dir), supplier_cards(spark, sf_dir), now())


@query("SELECT 'r' || c_custkey AS name, c_name AS path FROM customer WHERE c_custkey = 77")
def find_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.find(customers(spark, sf_dir), "R77").select("name", "path")


@query("""
SELECT strftime(ts, '%Y-%m-%dT%H-%M-%SZ') || '-agent-' || event_type AS note_id, 'k' || user_id AS key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, 'agent-' || event_type AS agent, props AS body
FROM events WHERE event_type <> 'click'
""")
def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stamp = F.when(F.col("event_type") == "click", F.lit("2024-13-01T00-00-00Z")).otherwise(F.date_format("ts", notes.STAMP))
    files = e.select(F.concat(F.lit("/notes/k"), F.col("user_id"), F.lit("/"), stamp, F.lit("-agent-"), F.col("event_type"), F.lit(".md")).alias("path"), F.col("props").alias("value"))
    return notes.parse_notes(files).select("note_id", "key", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "agent", "body")


@query("""
WITH r AS (SELECT event_id, user_id, event_type, (epoch_us(ts) // 86400000000) * 86400 AS second, ts FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY second, ts) AS i FROM r),
f AS (SELECT *, max(second - i) OVER (PARTITION BY user_id, event_type ORDER BY i) + i AS free FROM n)
SELECT event_id, strftime(make_timestamp(free * 1000000), '%Y-%m-%dT%H-%M-%SZ') AS stamp FROM f
""")
def note_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, us = F.lit(86400000000), F.unix_micros("ts")
    # requests of one day ask for its first second; their order within it is that of the events
    at = F.timestamp_micros((F.floor(us / day) * day + F.floor(us % day / 86400)).cast("bigint"))
    out = notes.stamps(table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.col("event_type").alias("agent"), at.alias("at")))
    return out.select("event_id", "stamp")


@query("""
SELECT p_partkey, '# Me' || chr(10) || chr(10) || '## Likes' || chr(10) || '- ' || p_name || chr(10) || '- cake' || chr(10) || chr(10) || '## Work' || chr(10) || '- ' || p_brand || chr(10) AS likes,
       '# Me' || chr(10) || chr(10) || '## Likes' || chr(10) || '- ' || p_name || chr(10) || chr(10) || '## Work' || chr(10) || '- cake' || chr(10) AS work,
       '# Me' || chr(10) || chr(10) || '## Likes' || chr(10) || '- ' || p_name || chr(10) || chr(10) || '## Work' || chr(10) || '- ' || p_brand || chr(10) || chr(10) || '## New' || chr(10) || '- cake' || chr(10) AS more FROM part
""")
def profile_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# Me\n\n## Likes\n- "), "p_name", F.lit("\n\n## Work\n- "), "p_brand", F.lit("\n"))
    return table(spark, sf_dir, "part").select("p_partkey", api.update_profile(text, "LIKES", "cake").alias("likes"), api.update_profile(text, "Work", "cake", append=False).alias("work"), api.update_profile(text, "New", "cake").alias("more"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.concat(F.lit("/"), F.lower("c_mktsegment"), F.lit("/n"), F.col("c_nationkey"), F.lit("/c"), F.col("c_custkey")).alias("root"))


PATH = "'/' || lower(c_mktsegment) || '/n' || c_nationkey || '/c' || c_custkey"


@query(f"""
WITH off AS (SELECT '/building' AS path UNION ALL SELECT '/machinery/n' || n_nationkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT '')
SELECT c_custkey, p AS root FROM (SELECT c_custkey, {PATH} AS p FROM customer) c WHERE NOT EXISTS (SELECT 1 FROM off WHERE off.path <> '' AND (c.p = off.path OR starts_with(c.p, off.path || '/')))
""")
def disabled_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("/machinery/n"), F.col("n_nationkey")).alias("path"))
    off = n.union(spark.createDataFrame([("/building",), ("",)], "path string"))
    return select.without_disabled(paths(spark, sf_dir), off)


@query(f"""
WITH r AS (SELECT DISTINCT '/' || lower(c_mktsegment) AS root FROM customer UNION SELECT DISTINCT '/' || lower(c_mktsegment) || '/n' || c_nationkey FROM customer WHERE c_nationkey % 4 = 0)
SELECT c_custkey, r.root AS repo FROM (SELECT c_custkey, {PATH} AS p FROM customer) c JOIN r ON c.p = r.root OR starts_with(c.p, r.root || '/')
""")
def path_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    top = F.concat(F.lit("/"), F.lower("c_mktsegment"))
    roots = c.select(top.alias("repo")).union(c.filter("c_nationkey % 4 = 0").select(F.concat(top, F.lit("/n"), F.col("c_nationkey")))).distinct()
    return select.in_repos(paths(spark, sf_dir), roots, cwd="root", root="repo").select("c_custkey", "repo")


@query(f"""
SELECT c_custkey, CASE WHEN p = r THEN '.' WHEN starts_with(p, r || '/') THEN substr(p, length(r) + 2) ELSE p END AS file FROM (
  SELECT c_custkey, {PATH} AS p, CASE c_custkey % 3 WHEN 0 THEN '/building' WHEN 1 THEN '/machinery' ELSE {PATH} END AS r FROM customer)
""")
def path_relativise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(spark, sf_dir)
    root = F.when(F.col("c_custkey") % 3 == 0, "/building").when(F.col("c_custkey") % 3 == 1, "/machinery").otherwise(F.col("root"))
    return p.select("c_custkey", tx.relative_to(F.col("root"), root).alias("file"))


@query("""
WITH reg AS (SELECT 'src' || (c_custkey % 12) AS path, arg_max(c_name, c_custkey) AS name FROM customer GROUP BY 1)
SELECT string_agg(name, ', ' ORDER BY name) AS names, count(*) AS n FROM (SELECT DISTINCT coalesce(reg.name, d.source) AS name FROM documents d LEFT JOIN reg ON d.source = reg.path)
""")
def distinct_names_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes.names(note_rows(spark, sf_dir), source_registry(spark, sf_dir))
    return n.select(F.array_join("names", ", ").alias("names"), F.size("names").cast("bigint").alias("n"))


@query("""
SELECT c_custkey, CAST(count(o_orderkey) FILTER (WHERE o_orderdate > TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 1000 AS INTEGER))) AS INTEGER) AS commits
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def commits_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("root"), (F.lit("1995-01-01").cast("timestamp") + F.make_interval(days=(F.col("c_custkey") % 1000).cast("int"))).alias("since"))
    found = registry.commits_after(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("root"), F.col("o_orderdate").alias("at")))
    return c.join(found, "root", "left").select("c_custkey", F.coalesce("commits", F.lit(0)).alias("commits"))


def drift_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of customers at their first order, drift by later orders and their parts."""
    o = table(spark, sf_dir, "orders")
    commits = o.select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").cast("string").alias("sha"), F.col("o_orderdate").alias("at"))
    first = o.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("f"))
    known = F.when(F.col("o_custkey") % 5 == 0, "gone").otherwise(F.col("f.o_orderkey").cast("string"))
    made = first.select(F.concat(F.lit("k"), F.col("o_custkey")).alias("name"), F.col("o_custkey").cast("string").alias("path"), known.alias("commit"), F.col("f.o_orderdate").alias("updated"))
    names = F.array(*[F.lit(x) for x in ("README.md", "go.mod", "src/main.c", "docs/README", "Cargo.toml", "x", "AGENTS.md")])
    li = table(spark, sf_dir, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    changes = li.select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").cast("string").alias("sha"), F.get(names, (F.col("l_partkey") % 70).cast("int")).alias("file")).filter("file is not null")
    return registry.drift(made, commits, changes)


DRIFT = """
WITH f AS (SELECT o_custkey, min(o_orderdate) AS updated, o_custkey % 5 <> 0 AS known FROM orders GROUP BY o_custkey),
later AS (SELECT o.* FROM orders o JOIN f ON f.o_custkey = o.o_custkey AND f.known AND o.o_orderdate > f.updated),
n AS (SELECT o_custkey, count(*) AS commits FROM later GROUP BY o_custkey),
c AS (SELECT o_custkey, string_agg(DISTINCT file, ', ' ORDER BY file) AS changed FROM (
  SELECT o_custkey, CASE l_partkey % 70 WHEN 0 THEN 'README.md' WHEN 1 THEN 'go.mod' WHEN 4 THEN 'Cargo.toml' WHEN 6 THEN 'AGENTS.md' END AS file
  FROM later JOIN lineitem ON l_orderkey = o_orderkey) WHERE file IS NOT NULL GROUP BY o_custkey),
d AS (SELECT 'k' || f.o_custkey AS name, known, updated, coalesce(commits, 0) AS commits, coalesce(changed, '') AS changed FROM f LEFT JOIN n USING (o_custkey) LEFT JOIN c USING (o_custkey))
"""


@query(DRIFT + "SELECT name, known, CAST(commits AS INTEGER) AS commits, changed FROM d")
def drift_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_tables(spark, sf_dir).select("name", "known", "commits", F.array_join("changed", ", ").alias("changed"))


@query(DRIFT + """
SELECT name, concat_ws('; ', CASE WHEN known AND commits >= 8 THEN commits || ' commits since it was written' END, CASE WHEN known AND changed <> '' THEN changed || ' changed' END,
  CASE WHEN days >= 1400 THEN 'written ' || days || ' days ago' END) AS reason
FROM (SELECT *, CAST(floor((epoch_us(TIMESTAMP '1998-08-02 12:00:00') - epoch_us(updated)) / 86400000000.0) AS BIGINT) AS days FROM d)
""")
def staleness_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drift_tables(spark, sf_dir)
    reason = registry.stale_reason(F.col("updated"), F.col("commits"), F.col("changed"), F.col("known"), F.lit("1998-08-02 12:00:00").cast("timestamp"), 8, 1400)
    return d.select("name", reason.alias("reason"))


@query(f"""
WITH q(query) AS (VALUES ('customer#00000001'), ('ustomer#0000'), ('portfolo'), ('REGION')),
r AS (SELECT query, name, position, CASE WHEN starts_with(lower(name), lower(query)) THEN 0 WHEN contains(lower(name), lower(query)) THEN 1 ELSE 2 END AS rank, levenshtein(lower(name), lower(query)) AS distance
      FROM q, (SELECT c_name AS name, c_custkey AS position FROM customer) c)
SELECT query, CAST(n AS INTEGER) AS n, name, rank, CAST(distance AS INTEGER) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, distance, position, name) AS n FROM r) WHERE n <= 3
""")
def fuzzy_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("customer#00000001",), ("ustomer#0000",), ("portfolo",), ("REGION",)], "query string")
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("position"))
    return registry.closest(names, asked)


@query("""
WITH a AS (SELECT 'p' || p_partkey AS file, sha256(p_name) AS h FROM part WHERE p_partkey % 7 <> 0),
b AS (SELECT 'p' || p_partkey AS file, sha256(CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_name END) AS h FROM part WHERE p_partkey % 11 <> 0)
SELECT coalesce(a.file, b.file) AS file, CASE WHEN b.file IS NULL THEN 'missing' WHEN a.file IS NULL THEN 'extra' WHEN a.h <> b.h THEN 'modified' ELSE 'same' END AS state
FROM a FULL JOIN b ON a.file = b.file
""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("file", F.concat(F.lit("p"), F.col("p_partkey")))
    changed = F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(F.col("p_name"))
    return manifest.diff(manifest.digests(p.filter("p_partkey % 7 <> 0"), content="p_name"), manifest.digests(p.filter("p_partkey % 11 <> 0").withColumn("now", changed), content="now"))


@query("""
WITH f AS (SELECT l_orderkey, list('f' || l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey) AS facts FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_concat([x FOR x, i IN facts IF i <> 2 AND i <> 4], ['new fact']), ', ') AS facts FROM f
""")
def facts_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    facts = F.transform("x", lambda x: F.concat(F.lit("f"), x["l_linenumber"].cast("string")))
    out = cards.patched_facts(facts, F.array(F.lit(2), F.lit(4)), F.array(F.lit("## new  fact"), F.lit(" ")))
    return f.select("l_orderkey", F.array_join(out, ", ").alias("facts"))


@query("""
SELECT event_type AS name, bool_and(value < 99.5) AS ok, count(*) AS n_checks, count(*) FILTER (WHERE value >= 99.5) AS n_failed,
       coalesce(string_agg('e' || event_id || ' · user ' || user_id || ' · see props', chr(10) ORDER BY 'e' || event_id) FILTER (WHERE value >= 99.5), '') AS todo FROM events GROUP BY event_type
""")
def checks_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    checks = e.select(F.col("event_type").alias("name"), F.concat(F.lit("e"), F.col("event_id")).alias("check"), (F.col("value") < 99.5).alias("ok"), F.concat(F.lit("user "), F.col("user_id")).alias("message"), F.lit("see props").alias("hint"))
    return api.doctor(checks, "name")


@query("""
WITH s AS (SELECT p_size AS folder, 'p' || p_partkey AS file, sha256(p_name) AS h FROM part WHERE p_partkey % 9 <> 0),
r AS (SELECT p_size AS folder, 'p' || p_partkey AS file, sha256(CASE WHEN p_size % 3 = 1 AND p_partkey % 5 = 0 THEN p_brand ELSE p_name END) AS h FROM part WHERE p_partkey % 9 <> 0 AND p_size % 10 <> 0),
f AS (SELECT p_size AS folder, 'p' || p_partkey AS file, sha256(CASE WHEN p_size % 3 = 1 AND p_partkey % 5 = 0 THEN p_brand WHEN p_size % 7 = 0 THEN p_type ELSE p_name END) AS h FROM part WHERE p_partkey % 9 <> 0 AND p_size % 11 <> 0),
j AS (SELECT coalesce(s.folder, r.folder, f.folder) AS folder, s.h AS s, r.h AS r, f.h AS f FROM s FULL JOIN r ON s.folder = r.folder AND s.file = r.file FULL JOIN f ON f.folder = coalesce(s.folder, r.folder) AND f.file = coalesce(s.file, r.file))
SELECT folder, CASE WHEN count(f) = 0 THEN 'absent' WHEN count(r) = 0 THEN 'unmanaged' WHEN bool_or((r IS NOT NULL AND r IS DISTINCT FROM f) OR (s IS NOT NULL AND r IS NULL AND f IS NOT NULL)) THEN 'modified'
       WHEN bool_or(s IS DISTINCT FROM r) THEN 'outdated' ELSE 'current' END AS state FROM j GROUP BY folder HAVING count(s) > 0
""")
def manifest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").filter("p_partkey % 9 <> 0").withColumn("file", F.concat(F.lit("p"), F.col("p_partkey")))
    old = F.when((F.col("p_size") % 3 == 1) & (F.col("p_partkey") % 5 == 0), F.col("p_brand"))
    rows = lambda df, c: df.select(F.col("p_size").alias("folder"), "file", F.sha2(c, 256).alias("sha256"))
    shipped = rows(p, F.col("p_name"))
    recorded = rows(p.filter("p_size % 10 <> 0"), F.coalesce(old, "p_name"))
    found = rows(p.filter("p_size % 11 <> 0"), F.coalesce(old, F.when(F.col("p_size") % 7 == 0, F.col("p_type")), "p_name"))
    return manifest.states(shipped, recorded, found)


# --- texts --------------------------------------------------------------------------------------


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"""
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago'
  WHEN s < 2592000 THEN CAST(floor(s / 86400) AS BIGINT) || 'd ago' WHEN s < 31536000 THEN CAST(floor(s / 2592000) AS BIGINT) || 'mo ago' ELSE CAST(floor(s / 31536000) AS BIGINT) || 'y ago' END AS ago
FROM (SELECT event_id, greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1000000.0, 0) AS s FROM events)
""")
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.relative_time(F.col("ts"), now()).alias("ago"))


@query(f"SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0) AS BIGINT) AS days FROM events")
def age_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.age_days(F.col("ts"), now()).alias("days"))


@query(f"SELECT doc_id, {sql_inline('text')} AS line FROM documents")
def inline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.inline(F.col("text")).alias("line"))


@query(f"SELECT doc_id, {sql_cut('line', 80)} AS clipped FROM (SELECT doc_id, {sql_inline('text')} AS line FROM documents)")
def clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.clip(F.col("text"), 80).alias("clipped"))


@query(r"SELECT doc_id, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))[1] AS line FROM documents")
def first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.first_line(F.col("text")).alias("line"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents),
c AS (SELECT doc_id, CASE WHEN strpos(s, '. ') > 0 THEN left(s, strpos(s, '. ')) ELSE s END AS s FROM t)
SELECT doc_id, CASE WHEN length(s) > 120 THEN left(s, 119) || '…' ELSE s END AS sentence FROM c
""")
def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.first_sentence(F.col("text")).alias("sentence"))


@query("SELECT doc_id, left(text, list_max([k FOR k IN range(0, 42) IF strlen(left(text, k)) <= 41])) AS head FROM documents")
def byte_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.trim_bytes(F.col("text"), 41).alias("head"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9]', '-', 'g') AS key FROM pages")
def repo_key_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.repo_key(F.col("url")).alias("key"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9-]', '-', 'g'), '-') AS slug FROM part")
def name_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.name_slug(F.col("p_name")).alias("slug"))


@query(rf"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' # ' ELSE {sql_inline('text')} END AS raw, {sql_inline('text')} AS prompt FROM documents),
u AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE raw END AS title, prompt FROM t)
SELECT doc_id, coalesce(nullif({sql_cut('title', 120)}, ''), {sql_cut('prompt', 60)}) AS title FROM u
""")
def title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    s = F.struct(F.when(F.col("doc_id") % 3 == 0, " # ").otherwise(F.col("text")).alias("title"), F.col("text").alias("first_prompt"))
    return d.select("doc_id", brief.session_title(s).alias("title"))


@query(r"SELECT page_id, CAST(coalesce(list_max([length(x) FOR x IN regexp_extract_all(replace(html, '<', chr(96)), '`+')]), 0) AS INTEGER) AS ticks, repeat(chr(96), greatest(coalesce(list_max([length(x) FOR x IN regexp_extract_all(replace(html, '<', chr(96)), '`+')]), 0), 2) + 1) AS fence FROM pages")
def fence_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.replace("html", F.lit("<"), F.lit(tx.TICK))
    return table(spark, sf_dir, "pages").select("page_id", tx.longest_ticks(html).alias("ticks"), tx.fence(html).alias("fence"))


@query(f"SELECT doc_id, {sql_redact('text')} AS safe FROM documents")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", redact(F.col("text")).alias("safe"))


def sql_trim_bytes(s: str, n: int) -> str:
    return f"CASE WHEN strlen({s}) <= {n} THEN {s} ELSE left({s}, list_max([k FOR k IN range({n // 4}, {n + 1}) IF strlen(left({s}, k)) <= {n}])) END"


@query(f"WITH a AS (SELECT doc_id, {sql_trim_bytes('text', 16384)} AS t FROM documents), b AS (SELECT doc_id, {sql_redact('t')} AS t FROM a) SELECT doc_id, {sql_trim_bytes('t', 8192)} AS safe FROM b")
def scrub_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", scrub(F.col("text")).alias("safe"))


@query(f"SELECT source, count(*) AS n, count(*) FILTER (WHERE text <> {sql_redact('text')}) AS n_redacted FROM documents GROUP BY source")
def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text") != redact(F.col("text"))).alias("n_redacted"))


@query(r"""
WITH a AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '.git' WHEN 1 THEN replace(url, '://', '://me:pw@') || '/' ELSE 'git@' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/', ':') END AS u FROM pages),
b AS (SELECT page_id, regexp_replace(CASE WHEN contains(u, '://') THEN regexp_replace(regexp_replace(u, '^[a-z]+://', ''), '^[^/]*@', '') ELSE regexp_replace(regexp_replace(u, '^[^/]*@', ''), '^([^:]*):', '\1/') END, '/$', '') AS u FROM a),
c AS (SELECT page_id, regexp_replace(u, '\.git$', '') AS u FROM b)
SELECT page_id, CASE WHEN strpos(u, '/') = 0 OR strpos(u, '/') = length(u) THEN lower(split_part(u, '/', 1)) ELSE lower(split_part(u, '/', 1)) || substr(u, strpos(u, '/')) END AS remote FROM c
""")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    scp = F.concat(F.lit("git@"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "^([^/]*)/", "$1:"))
    u = F.when(k == 0, F.concat("url", F.lit(".git"))).when(k == 1, F.concat(F.replace("url", F.lit("://"), F.lit("://me:pw@")), F.lit("/"))).otherwise(scp)
    return table(spark, sf_dir, "pages").select("page_id", tx.normal_remote(u).alias("remote"))


@query(r"""
SELECT doc_id, CASE WHEN length(line) > 300 THEN rtrim(left(line, 300)) || '…' ELSE line END AS headline FROM (
  SELECT doc_id, array_to_string([x FOR x IN [regexp_replace(y, '^\s+|\s+$', '', 'g') FOR y IN string_split(text, chr(10))] IF x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '<!--')], ' ') AS line FROM documents)
""")
def headline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.headline(F.col("text")).alias("headline"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F-\x9F\x{2028}\x{2029}\x{FEFF}]', ' ', 'g'), '\s+', ' ', 'g')) AS line FROM documents")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.sanitize_scalar(F.col("text")).alias("line"))


@query(rf"SELECT page_id, chr(96) || replace({sql_inline('html')}, chr(96), chr(39)) || chr(96) AS span FROM (SELECT page_id, replace(html, '<', chr(96)) AS html FROM pages)")
def code_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.code(F.replace("html", F.lit("<"), F.lit(tx.TICK))).alias("span"))


@query(f"""
SELECT c_custkey, CASE WHEN p = '/building/n1' THEN '~' WHEN starts_with(p, '/building/') THEN '~' || substr(p, 10) ELSE p END AS shown, 'c' || c_custkey AS base, 'n' || c_nationkey AS parent FROM (SELECT *, {PATH} AS p FROM customer)
""")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("/"), F.lower("c_mktsegment"), F.lit("/n"), F.col("c_nationkey"), F.lit("/c"), F.col("c_custkey")).alias("root"))
    slashed = F.concat("root", F.lit("//"))
    return p.select("c_custkey", tx.tilde(F.col("root"), "/building").alias("shown"), tx.basename(slashed).alias("base"), tx.parent_name(slashed).alias("parent"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'said ' || event_type WHEN 1 THEN event_type ELSE '{"other":1}' END AS output FROM events""")
def output_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    out = F.when(k == 0, F.to_json(F.struct(F.concat(F.lit("said "), "event_type").alias("output")))).when(k == 1, F.col("event_type")).otherwise('{"other":1}')
    return table(spark, sf_dir, "events").select("event_id", transcripts.output_text(out).alias("output"))


# --- briefs -------------------------------------------------------------------------------------


def as_briefs(d: DataFrame) -> DataFrame:
    """Rows (session_id, first_prompt, last_prompt, last_message and others) as what a brief is rendered from."""
    null = {"agent": F.lit("dialect a"), "title": F.lit(""), "branch": F.concat(F.lit("b"), F.col("session_id")), "end": F.lit("2024-01-31 22:00:00"), "files": F.lit(None), "commands": F.lit(None), "tail": F.lit(None)}
    fields = [f.split(":", 1) for f in ("agent:string", "title:string", "branch:string", "end:timestamp", "first_prompt:string", "last_prompt:string", "last_message:string", f"files:{brief.FILES}", f"commands:{brief.COMMANDS}", f"tail:{brief.TAIL}")]
    primary = F.struct(*[null.get(k, F.col(k)).cast(t).alias(k) for k, t in fields])
    return d.select(
        "*", F.concat(F.lit("repo "), F.col("session_id")).alias("repo"), now().alias("now"), primary.alias("primary"), F.lit(None).cast(f"array<{brief.DIGEST}>").alias("others"),
        F.lit(None).cast("struct<agent:string,at:timestamp,body:string>").alias("note"), F.struct(F.lit(3).alias("uncommitted"), F.lit(1).alias("commits")).alias("git"), F.lit(None).cast("struct<names:array<string>,card_state:string,reason:string>").alias("projects"),
    )


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_briefs(session_digest(spark, sf_dir))


_BRIEF = rf"""
WITH c AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text FROM conversations),
d AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS fp, arg_max(text, turn) FILTER (WHERE role = 'user') AS lp,
             arg_max(text, turn) FILTER (WHERE role = 'assistant') AS lm FROM c GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') > 0),
i AS (SELECT *, {sql_inline('fp')} AS f, {sql_inline('lp')} AS l, {sql_inline('lm')} AS m FROM d),
p AS (SELECT session_id, '## skeinlog — unfinished work in repo ' || session_id || chr(10) || '{brief.PREAMBLE}' || chr(10) || 'Last: dialect a · 2h ago · branch b' || session_id
             || CASE WHEN f <> '' THEN ' · "' || {sql_cut('f', 60)} || '"' ELSE '' END || chr(10) AS head,
             coalesce('Goal: ' || nullif({sql_cut('f', 300)}, '') || chr(10), '') AS goal, coalesce(CASE WHEN lp <> fp THEN 'Latest ask: ' || nullif({sql_cut('l', 300)}, '') || chr(10) END, '') AS ask,
             coalesce('Ended with: ' || nullif({sql_cut('m', 800)}, '') || chr(10), '') AS e800, coalesce('Ended with: ' || nullif({sql_cut('m', 300)}, '') || chr(10), '') AS e300,
             'Now: 3 uncommitted files, 1 commits since that session' || chr(10) || '→ details: call skeinlog MCP tool get_handoff' || chr(10) AS foot FROM i)
"""


@query(_BRIEF + "SELECT session_id, head || goal || ask || e800 || foot AS inject FROM p")
def inject_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brief.render_inject(briefs(spark, sf_dir)).select("session_id", "inject")


@query(rf"""
WITH c AS (SELECT *, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
k AS (SELECT * FROM c WHERE NOT (conv_id % 3 = 0 AND r = 1) AND t <> ''),
d AS (SELECT conv_id, arg_min(t, turn) FILTER (WHERE role = 'user') AS fp, arg_max(t, turn) FILTER (WHERE role = 'user') AS lp, coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), '') AS lm
      FROM k GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') > 0),
x AS (SELECT conv_id, {sql_redact('fp')} AS fp, {sql_redact('lp')} AS lp, {sql_redact('lm')} AS lm FROM d),
i AS (SELECT *, {sql_inline('fp')} AS f, {sql_inline('lp')} AS l, {sql_inline('lm')} AS m FROM x),
n AS (SELECT conv_id, count(o_orderkey) AS n FROM d LEFT JOIN orders ON o_custkey = conv_id GROUP BY conv_id)
SELECT '/srv/' || conv_id AS root, '## skeinlog — unfinished work in repo ' || conv_id || chr(10) || '{brief.PREAMBLE}' || chr(10) || 'Last: agent a · unknown' || CASE WHEN f <> '' THEN ' · "' || {sql_cut('f', 60)} || '"' ELSE '' END || chr(10)
       || coalesce('Goal: ' || nullif({sql_cut('f', 300)}, '') || chr(10), '') || coalesce(CASE WHEN lp <> fp THEN 'Latest ask: ' || nullif({sql_cut('l', 300)}, '') || chr(10) END, '')
       || coalesce('Ended with: ' || nullif({sql_cut('m', 800)}, '') || chr(10), '') || 'Now: 2 uncommitted files, ' || n || ' commits since that session' || chr(10) || '→ details: call skeinlog MCP tool get_handoff' || chr(10) AS inject
FROM i JOIN n USING (conv_id)
""")
def handoff_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole call: lines to digests, repositories, ranks, scrubbing, repository state, briefs."""
    parts = [api.digests(conversation_lines(spark, sf_dir, d), d, tail=True) for d in ("blocks", "rollout")]
    d = parts[0].unionByName(parts[1])
    d = d.withColumns({"cwd": F.concat(F.lit("/srv/"), "path", F.lit("/src")), "agent": F.lit("agent a"), "session_id": F.col("path"), "source_order": F.lit(0)})
    roots = d.select(F.concat(F.lit("/srv/"), "path").alias("root"), F.concat(F.lit("repo "), "path").alias("name"))
    none = spark.createDataFrame([], "key string, note_id string, agent string, at timestamp, body string")
    git = roots.select("root", F.lit(2).alias("uncommitted"))
    commits = table(spark, sf_dir, "orders").select(F.concat(F.lit("/srv/"), "o_custkey").alias("root"), F.col("o_orderdate").alias("at"))
    return api.handoff(api.sessions_of(d, roots, now()), roots, none, git, commits, now()).select("root", "inject")


@query(_BRIEF + """
SELECT session_id, CASE WHEN strlen(head || goal || ask || e800 || foot) <= 1000 THEN head || goal || ask || e800 || foot WHEN strlen(head || goal || e800 || foot) <= 1000 THEN head || goal || e800 || foot
  WHEN strlen(head || goal || e300 || foot) <= 1000 THEN head || goal || e300 || foot ELSE left(head || goal || e300 || foot, list_max([k FOR k IN range(0, 1001) IF strlen(left(head || goal || e300 || foot, k)) <= 1000])) END AS inject FROM p
""")
def budget_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = brief._pieces(brief.TOOL)
    rows = briefs(spark, sf_dir).select("session_id", *[v.alias(f"_{k}") for k, v in pieces.items()])
    ladder = [brief._inject({k: F.col(f"_{k}") for k in pieces}, *step) for step in brief.LADDER]
    return rows.select("session_id", brief.first_that_fits(ladder, F.lit(1000)).alias("inject"))


# every other letter of this text takes three bytes
_WIDE = "translate(coalesce(text, ''), 'aeiounstrl', '愛絵位尾卯雲葉空山川')"


@query(rf"""
WITH d AS (SELECT doc_id, 'w' || doc_id AS session_id, {_WIDE} AS fp, substr({_WIDE}, 150) AS lp, substr({_WIDE}, 40) AS lm FROM documents),
i AS (SELECT *, {sql_inline('fp')} AS f, {sql_inline('lp')} AS l, {sql_inline('lm')} AS m FROM d),
p AS (SELECT doc_id, '## skeinlog — unfinished work in repo ' || session_id || chr(10) || '{brief.PREAMBLE}' || chr(10) || 'Last: dialect a · 2h ago · branch b' || session_id
             || CASE WHEN f <> '' THEN ' · "' || {sql_cut('f', 60)} || '"' ELSE '' END || chr(10) AS head,
             coalesce('Goal: ' || nullif({sql_cut('f', 300)}, '') || chr(10), '') AS goal, coalesce(CASE WHEN lp <> fp THEN 'Latest ask: ' || nullif({sql_cut('l', 300)}, '') || chr(10) END, '') AS ask,
             coalesce('Ended with: ' || nullif({sql_cut('m', 800)}, '') || chr(10), '') AS e800, coalesce('Ended with: ' || nullif({sql_cut('m', 300)}, '') || chr(10), '') AS e300,
             'Now: 3 uncommitted files, 1 commits since that session' || chr(10) || '→ details: call skeinlog MCP tool get_handoff' || chr(10) AS foot FROM i)
SELECT doc_id, CASE WHEN strlen(head || goal || ask || e800 || foot) <= 3072 THEN head || goal || ask || e800 || foot WHEN strlen(head || goal || e800 || foot) <= 3072 THEN head || goal || e800 || foot ELSE head || goal || e300 || foot END AS inject FROM p
""")
def inject_over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact briefs of documents as sessions, of which many pass the limit of 3,072 bytes."""
    wide = F.translate(F.coalesce("text", F.lit("")), "aeiounstrl", "愛絵位尾卯雲葉空山川")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("w"), F.col("doc_id")).alias("session_id"), wide.alias("first_prompt"), F.substring(wide, 150, 1 << 30).alias("last_prompt"), F.substring(wide, 40, 1 << 30).alias("last_message"))
    return brief.render_inject(as_briefs(rows)).select("doc_id", "inject")


def with_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """briefs() with the last turns of each conversation as activities."""
    t = digest.tails(conversation_steps(spark, sf_dir)).select(F.col("path").alias("session_id"), "tail")
    b = briefs(spark, sf_dir).join(t, "session_id")
    return b.withColumn("primary", F.col("primary").withField("tail", F.col("tail").cast(brief.TAIL))).drop("tail")


@query(_BRIEF.rstrip() + rf"""
, q AS (SELECT session_id, '## skeinlog — unfinished work in repo ' || session_id || chr(10) || '{brief.PREAMBLE}' || chr(10) || 'Last: dialect a · 2h ago · branch b' || session_id
             || CASE WHEN f <> '' THEN ' · "' || {sql_cut('f', 60)} || '"' ELSE '' END || chr(10) || coalesce('Goal: ' || nullif({sql_cut('f', 2000)}, '') || chr(10), '')
             || coalesce(CASE WHEN lp <> fp THEN 'Latest ask: ' || nullif({sql_cut('l', 2000)}, '') || chr(10) END, '') || coalesce('Ended with: ' || nullif({sql_cut('m', 4000)}, '') || chr(10), '')
             || 'Now: 3 uncommitted files, 1 commits since that session' || chr(10) AS head, chr(10) || '→ details: call skeinlog MCP tool get_handoff' || chr(10) AS foot FROM i),
a AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, role, left(string_split(text, chr(10))[1], 120) AS h, regexp_replace(regexp_replace(left(text, 2000), '^\s+', ''), '\s+$', '') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n
      FROM c WHERE role IN ('user', 'assistant')),
e AS (SELECT session_id, n, '- ' || role || CASE WHEN {sql_inline('h')} <> '' THEN ' · ' || {sql_inline('h')} ELSE '' END || ' · unknown' || chr(10) || CASE WHEN body <> '' THEN repeat(chr(96), 3) || chr(10) || body || chr(10) || repeat(chr(96), 3) || chr(10) ELSE '' END AS entry
      FROM a WHERE n <= 30),
s AS (SELECT e.*, 20 + sum(strlen(entry)) OVER (PARTITION BY session_id ORDER BY n) AS back FROM e),
k AS (SELECT s.session_id, string_agg(entry, '' ORDER BY n DESC) AS tail FROM s JOIN q USING (session_id) WHERE back <= 4000 - strlen(q.head) - strlen(q.foot) GROUP BY s.session_id),
w AS (SELECT session_id, head || coalesce(chr(10) || '## Recent activity' || chr(10) || tail, '') || foot AS whole FROM q LEFT JOIN k USING (session_id))
SELECT session_id, CASE WHEN strlen(whole) <= 4000 THEN whole ELSE left(whole, list_max([x FOR x IN range(0, 4001) IF strlen(left(whole, x)) <= 4000])) END AS "full" FROM w
""")
def tail_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brief.render_full(with_tails(spark, sf_dir), most=4000).select("session_id", "full")


@query(_BRIEF.rstrip() + rf"""
, x AS (SELECT session_id, '## skeinlog — unfinished work in repo ' || session_id || chr(10) || '{brief.PREAMBLE}' || chr(10) || 'Last: dialect a · 2h ago · branch b' || session_id
             || CASE WHEN f <> '' THEN ' · "' || {sql_cut('f', 60)} || '"' ELSE '' END || chr(10) || 'Handoff note from keeper · 5m ago (full: get_handoff):' || chr(10) AS head,
             'Now: 3 uncommitted files, 1 commits since that session' || chr(10) || '→ details: call skeinlog MCP tool get_handoff' || chr(10) AS foot,
             repeat('Line of a note: ' || session_id || chr(10), CAST(CAST(session_id AS BIGINT) % 150 + 1 AS BIGINT)) AS note FROM i),
z AS (SELECT *, rtrim(note, chr(10)) AS body, strlen('Line of a note: ' || session_id || chr(10)) AS width FROM x),
v AS (SELECT z.session_id, size, i, head || repeat(chr(96), 3) || chr(10) || CASE WHEN strlen(body) <= size THEN body ELSE rtrim(repeat('Line of a note: ' || session_id || chr(10), CAST(floor((size + 1) / width) AS BIGINT)), chr(10)) || chr(10) || '… (full note: get_handoff)' END
             || chr(10) || repeat(chr(96), 3) || chr(10) || foot AS brief FROM z, (SELECT unnest([1800, 1500, 1200, 900, 600, 300]) AS size, unnest(range(6)) AS i))
SELECT session_id, coalesce(arg_min(brief, i) FILTER (WHERE strlen(brief) <= 1200), arg_max(brief, i)) AS inject FROM v GROUP BY session_id
""")
def inject_note_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.repeat(F.concat(F.lit("Line of a note: "), F.col("session_id"), F.lit("\n")), (F.col("session_id").cast("bigint") % 150 + 1).cast("int"))
    note = F.struct(F.lit("keeper").alias("agent"), (now() - F.expr("INTERVAL 5 MINUTES")).alias("at"), own.alias("body"))
    pieces = brief._pieces(brief.TOOL)
    rows = briefs(spark, sf_dir).withColumn("note", note).select("session_id", *[v.alias(f"_{k}") for k, v in pieces.items()])
    c = {k: F.col(f"_{k}") for k in pieces}
    return rows.select("session_id", brief.first_that_fits(brief.note_ladder(c), F.lit(1200)).alias("inject"))


@query("""
WITH s AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey)
SELECT n_regionkey AS region, '## skeinlog — projects' || chr(10) || 'Your projects (memory in skeinlog; call get_project before guessing): ' || array_to_string(names[1:3], ', ')
  || CASE WHEN len(names) > 3 THEN ' (+' || (len(names) - 3) || ' more)' ELSE '' END || chr(10) || 'This project has no skeinlog card yet. Once you understand it, call update_project.' || chr(10) AS section FROM s
""")
def names_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    p = F.struct(F.transform("x", lambda x: x["n_name"]).alias("names"), F.lit("missing").alias("card_state"), F.lit("").alias("reason"))
    return n.select(F.col("n_regionkey").alias("region"), p.alias("projects")).select("region", brief.projects_section(most=3).alias("section"))
