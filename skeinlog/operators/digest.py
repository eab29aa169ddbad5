"""Steps to a digest of each session.

The digest is mergeable. Each split of a file (a range of its lines that one task reads) gives a partial digest: its
first and last values, counts, files in order of their first touch, commands, the last activities, and of its calls
what is open at both edges (a command without a result yet, a failing result whose command stands before the split).
join() of two partial digests of neighbouring ranges is associative, so they can be merged in any grouping: here by
path, in a store of streamed lines as they come (see streaming). So a file of any size is digested by as many tasks
as it has splits; only what a digest lists, and the last state of each call, comes together by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import built_once, first_line, let

TAIL = 30
HEAD_CHARS, BODY_CHARS = 120, 2000
#: A working directory counts in the first lines only.
CWD_LINES = 64
AT = ("line_no", "block_no")
#: Bits of line_no below the number of the split that the line was read in.
SPLIT_BITS = 33

_AT = "line_no:bigint,block_no:int"
FIRSTS, LASTS = ("cwd", "start", "first_prompt"), ("title", "branch", "end", "last_prompt", "last_message")
_FILE = f"struct<{_AT},ops:array<string>,count:int>"
_PENDING = f"struct<{_AT},text:string>"
#: A partial digest. calls: the last state of each call, with the place and text of a command that waits for a result
#: (null: none does). fronts: failing results of calls that were not met before.
PART = {
    **{k: f"struct<{_AT},x:{'timestamp' if k in ('start', 'end') else 'string'}>" for k in FIRSTS + LASTS},
    "prompt_count": "int",
    "files": f"array<struct<file:string,{_AT},ops:array<string>,count:int>>",
    "commands": f"array<struct<{_AT},command:string,failed:boolean>>",
    "calls": f"array<struct<call:string,{_AT},text:string>>",
    "fronts": f"array<struct<call:string,{_AT},ts:timestamp,body:string>>",
    "tail": f"array<struct<{_AT},act:string,head:string,body:string,ts:timestamp>>",
    "lines": "array<bigint>", "bytes": "bigint", "size": "bigint",
}
PART_TYPE = f"struct<{','.join(f'{k}:{t}' for k, t in PART.items())}>"
#: The same while it is merged: files and calls by name.
_OPEN_TYPE = f"struct<{','.join(f'{k}:{t}' for k, t in (PART | {'files': f'map<string,{_FILE}>', 'calls': f'map<string,{_PENDING}>'}).items())}>"


def with_results(steps: DataFrame, *by: str) -> DataFrame:
    """steps with failed (a command that a result with an error answers), called (of such a result, the command), and
    opens and ends (the first and the last event of its call), within path and by.

    A result answers the last call of its id, if no other result came between: within a call id that
    is the event just before it, so one window sort does what a range join would.
    """
    call = F.when(F.col("kind").isin("command", "result"), F.col("call_id"))
    w = Window.partitionBy("path", *by, call, F.when(call.isNull(), F.col("line_no"))).orderBy(*AT)
    before, after = F.lag("kind").over(w), F.lead("kind").over(w)
    failed = call.isNotNull() & (F.col("kind") == "command") & (after == "result") & F.lead("is_error").over(w)
    answers = call.isNotNull() & (F.col("kind") == "result") & (before == "command") & F.col("is_error")
    return steps.withColumns({
        "failed": F.coalesce(failed, F.lit(False)), "called": F.when(answers, F.lag("text").over(w)),
        "opens": call.isNotNull() & before.isNull(), "ends": call.isNotNull() & after.isNull(),
    })


def pair_results(steps: DataFrame) -> DataFrame:
    """command steps with failed, and failure steps at the results that tell of it."""
    rows = activities(with_results(steps.filter(F.col("kind").isin("command", "result")))).filter(F.col("act").isin("command", "failure"))
    return rows.select("path", *AT, "ts", "text", "failed", F.col("act").alias("kind"), "head", "body")


def activities(steps: DataFrame) -> DataFrame:
    """with_results() with act (user, assistant, file, command or failure; null: none), head and body."""
    kind = F.col("kind")
    act = F.when(kind.isin("user", "assistant", "file", "command"), kind).when(F.col("called").isNotNull(), "failure")
    return steps.withColumns({"act": act, "head": F.coalesce("called", "text"), "body": F.when(kind == "file", F.col("op")).otherwise(F.col("text"))})


def slim(steps: DataFrame, tail: bool) -> DataFrame:
    """steps without what a digest doesn't use of them: results are long, and only what fits a tail is of use."""
    return steps.withColumn("text", F.when(F.col("kind") == "result", F.substring("text", 1, BODY_CHARS) if tail else F.lit("")).otherwise(F.col("text")))


@built_once
def _part_columns(tail: bool, sized: bool) -> tuple[list[str], list[str], list[Column], Column]:
    """Of partials(): the names of heads and lists, the aggregates of a file in a part, and the part made of them."""
    kind, is_file = F.col("kind"), F.col("kind") == "file"

    def value(pick, kinds: tuple[str, ...], of: str = "text", only: Column | bool = True) -> Column:
        return pick(F.when(kind.isin(*kinds) & only, F.struct(*AT, F.col(of).alias("x"))))

    timed = F.col("ts").isNotNull()
    found = {
        "title": value(F.max, ("title",)), "branch": value(F.max, ("branch",)), "cwd": value(F.min, ("cwd",)), "start": value(F.min, ("entry",), "ts", timed), "end": value(F.max, ("entry",), "ts", timed),
        "first_prompt": value(F.min, ("user",)), "last_prompt": value(F.max, ("user",)), "last_message": value(F.max, ("assistant", "final")),
    }
    waits = lambda c: F.when(kind == "command", F.col(c)).alias(c)
    lists = {
        "commands": F.when(kind == "command", F.struct(*AT, F.col("text").alias("command"), "failed")),
        "calls": F.when(F.col("ends"), F.struct(F.col("call_id").alias("call"), *map(waits, AT), waits("text"))),
        "fronts": F.when(F.col("opens") & (kind == "result") & F.col("is_error"), F.struct(F.col("call_id").alias("call"), *AT, "ts", F.substring("text", 1, BODY_CHARS).alias("body"))),
        "tail": F.when(F.col("n") <= TAIL, F.struct(*AT, *entry())) if tail else F.lit(None).cast(PART["tail"][6:-1]),
        "lines": F.when(kind == "line", F.col("line_no")),
    }
    touch = {"at": F.min(F.when(is_file, F.struct(*AT))), "count": F.count_if(is_file).cast("int"), "ops": F.collect_list(F.when(is_file, F.struct(*AT, "op")))}
    bytes_, size = (F.col(c) if sized else F.lit(None).cast("bigint") for c in ("bytes", "size"))
    sums = {"prompt_count": F.count_if(kind == "user"), "bytes": F.sum(F.when(kind == "line", bytes_ + 1)), "size": F.max(size)}
    every = {"at_": F.min("line_no")} | found | {k: F.collect_list(v) for k, v in lists.items()} | touch | sums
    values = {k: F.col(k) for k in PART}
    values["files"] = F.transform("files", lambda f: F.struct(f["file"], f["at"]["line_no"], f["at"]["block_no"], f["ops"], f["count"]))
    values["lines"] = F.slice("lines", 1, CWD_LINES)
    return list(found), list(lists), [v.alias(k) for k, v in every.items()], F.struct(*(v.alias(k) for k, v in values.items())).cast(PART_TYPE)


def partials(steps: DataFrame, tail: bool = False, keep: tuple[str, ...] = (), last_apart: bool = False) -> DataFrame:
    """A partial digest (p) for each path and split of it; part, its first line_no, orders them. The columns named in
    keep are the same in all steps of a path. last_apart: a split's last line is a part of its own, so that it can be left
    out (see merged)."""
    split = ["path", "split"]
    rows = steps.withColumn("line_no", F.col("line_no").cast("bigint")).withColumn("split", F.shiftright("line_no", SPLIT_BITS))
    rows = rows.repartition(*split)
    last = (F.col("line_no") == F.max("line_no").over(Window.partitionBy(*split))).cast("int") if last_apart else F.lit(0)
    rows = activities(with_results(rows.withColumn("part", F.col("split") * 2 + last), "split", "part"))
    if tail:
        rows = last_activities(rows, "split", "part")
    found, lists, every, values = _part_columns(tail, {"bytes", "size"} <= set(steps.columns))
    # by file first, where steps of other kinds are a file of their own (null); then by part, all in place
    rows = rows.withColumn("file", F.when(F.col("kind") == "file", F.col("text")))
    per = rows.groupBy(*split, "part", "file").agg(*every, *(F.max(k).alias(f"keep_{k}") for k in keep))
    per = per.withColumn("ops", ops_of("ops"))
    merged = [(F.min if k in FIRSTS else F.max)(k).alias(k) for k in found] + [F.sort_array(F.flatten(F.collect_list(k))).alias(k) for k in lists]
    merged += [F.sum("prompt_count").alias("prompt_count"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"), files_of(F.col("file").isNotNull()).alias("files"), *(F.max(f"keep_{k}").alias(f"keep_{k}") for k in keep)]
    out = per.groupBy(*split, "part").agg(F.min("at_").alias("at_"), *merged)
    return out.select("path", F.col("at_").alias("part"), values.alias("p"), *(F.col(f"keep_{k}").alias(k) for k in keep))


def _opened(p: Column) -> Column:
    """A part with files and calls by name."""
    files = F.map_from_entries(F.transform(p["files"], lambda f: F.struct(f["file"], F.struct(f["line_no"], f["block_no"], f["ops"], f["count"]))))
    calls = F.map_from_entries(F.transform(p["calls"], lambda c: F.struct(c["call"], F.struct(c["line_no"], c["block_no"], c["text"]))))
    return F.struct(*(({"files": files, "calls": calls}.get(k, p[k])).alias(k) for k in PART)).cast(_OPEN_TYPE)


def _closed(p: Column) -> Column:
    files = F.transform(F.map_entries(p["files"]), lambda e: F.struct(e["key"], e["value"]["line_no"], e["value"]["block_no"], e["value"]["ops"], e["value"]["count"]))
    calls = F.transform(F.map_entries(p["calls"]), lambda e: F.struct(e["key"], e["value"]["line_no"], e["value"]["block_no"], e["value"]["text"]))
    return F.struct(*(({"files": files, "calls": calls}.get(k, p[k])).alias(k) for k in PART)).cast(PART_TYPE)


def _join(a: Column, b: Column) -> Column:
    """Two parts (opened) of which b follows a."""

    def joined(met: Column) -> Column:
        """met: the results of b that answer a command of a."""
        here = lambda c: F.exists(met, lambda m: (m["line_no"] == c["line_no"]) & (m["block_no"] == c["block_no"]))
        told = F.transform(a["commands"], lambda c: F.struct(c["line_no"], c["block_no"], c["command"], c["failed"] | here(c))).cast(PART["commands"])
        failures = F.transform(met, lambda m: F.struct(m["front"]["line_no"], m["front"]["block_no"], F.lit("failure"), head_of(m["text"]), m["front"]["body"], m["front"]["ts"])).cast(PART["tail"])
        tail = F.concat(a["tail"], F.when(F.size(met) == 0, b["tail"]).otherwise(F.sort_array(F.concat(b["tail"], failures))))
        file = lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.struct(x["line_no"], x["block_no"], F.array_distinct(F.concat(x["ops"], y["ops"])), x["count"] + y["count"]).cast(_FILE))
        values = {k: F.coalesce(a[k], b[k]) for k in FIRSTS} | {k: F.coalesce(b[k], a[k]) for k in LASTS} | {
            "prompt_count": a["prompt_count"] + b["prompt_count"],
            "files": F.map_zip_with(a["files"], b["files"], file),
            "commands": F.concat(F.when(F.size(met) == 0, a["commands"]).otherwise(told), b["commands"]),
            "calls": F.map_zip_with(a["calls"], b["calls"], lambda k, x, y: F.coalesce(y, x)),
            "fronts": F.concat(a["fronts"], F.filter(b["fronts"], lambda f: ~F.map_contains_key(a["calls"], f["call"]))),
            "tail": let(tail, lambda t: F.when(F.size(t) <= TAIL, t).otherwise(F.slice(t, -TAIL, TAIL))),
            "lines": F.slice(F.concat(a["lines"], b["lines"]), 1, CWD_LINES),
            "bytes": F.coalesce(a["bytes"] + b["bytes"], a["bytes"], b["bytes"]), "size": F.greatest(a["size"], b["size"]),
        }
        return F.struct(*(values[k].alias(k) for k in PART)).cast(_OPEN_TYPE)

    waiting = F.transform(b["fronts"], lambda f: let(F.try_element_at(a["calls"], f["call"]), lambda c: F.struct(c["line_no"].alias("line_no"), c["block_no"].alias("block_no"), c["text"].alias("text"), f.alias("front"))))
    return let(F.filter(waiting, lambda m: m["line_no"].isNotNull()), joined)


def joined(parts: Column) -> Column:
    """The parts of an array, in order and one at least, as one."""

    def fold(every: Column) -> Column:
        rest = F.slice(every, F.lit(2), F.size(every) - 1)
        one = F.aggregate(rest, let(F.get(every, F.lit(0)), _opened), lambda a, b: let(_opened(b), lambda b: _join(a, b)))
        return F.when(F.size(every) == 1, F.get(every, F.lit(0))).otherwise(let(one, _closed))

    return let(parts, fold)


@built_once
def _joined_parts() -> Column:
    return joined(F.col("parts"))


def merged(parts: DataFrame, tail: bool = False, keep: tuple[str, ...] = (), complete: bool = True, all_paths: bool = False) -> DataFrame:
    """Digests of partials(): a row for each path with a user prompt (all_paths: for each path). complete=False: where
    lines and breaks don't add up to a file's size its last line has no break and is left out."""
    by = parts.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("part", "p"))).alias("parts"), *(F.max(k).alias(f"keep_{k}") for k in keep))
    by = by.withColumn("parts", F.transform("parts", lambda x: x["p"]))
    if not complete:
        total = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + F.coalesce(p["bytes"], F.lit(0)))
        cut = total != F.get("parts", F.lit(0))["size"]
        by = by.withColumn("parts", F.when(cut, F.slice("parts", F.lit(1), F.size("parts") - 1)).otherwise(F.col("parts"))).filter(F.size("parts") > 0)
    return finished(by.select("path", _joined_parts().alias("p"), *(F.col(f"keep_{k}").alias(k) for k in keep)), tail, keep, all_paths)


@built_once
def _digest_columns(tail: bool) -> list[Column]:
    """A digest's columns from the part p that covers its file."""
    p = F.col("p")
    early = (F.size(p["lines"]) < CWD_LINES) | (p["cwd"]["line_no"] <= F.get(p["lines"], F.lit(CWD_LINES - 1)))
    heads = {k: p[k]["x"] for k in FIRSTS + LASTS} | {"cwd": F.when(early, p["cwd"]["x"]), "prompt_count": p["prompt_count"]}
    order = ("title", "branch", "cwd", "start", "end", "prompt_count", "first_prompt", "last_prompt", "last_message")
    commands = F.transform(p["commands"], lambda c: F.struct(c["command"].alias("command"), c["failed"].alias("failed")))
    files = F.transform(F.sort_array(F.transform(p["files"], lambda f: F.struct(F.struct(f["line_no"], f["block_no"]).alias("at"), f["file"].alias("file"), f["ops"].alias("ops"), f["count"].alias("count")))), lambda f: F.struct(f["file"].alias("path"), f["ops"].alias("ops"), f["count"].alias("count")))
    last = F.transform(p["tail"], lambda t: F.struct(t["act"].alias("kind"), t["head"].alias("head"), t["body"].alias("body"), t["ts"].alias("at")))
    return [*(heads[k].alias(k) for k in order), files.alias("files"), commands.alias("commands"), *[last.alias("tail")] * tail]


def finished(rows: DataFrame, tail: bool = False, keep: tuple[str, ...] = (), all_paths: bool = False) -> DataFrame:
    """rows (path, p) whose p covers a whole file, as digests: title, branch, cwd, start, end, prompt_count, first_prompt,
    last_prompt, last_message, files, commands, with tail the last activities, and keep."""
    if not all_paths:
        rows = rows.filter("p.prompt_count > 0")
    return rows.select("path", *_digest_columns(tail), *keep)


def sessions(steps: DataFrame, tail: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Digests of steps: a row for each path with a user prompt (see finished)."""
    return merged(partials(steps, tail, keep), tail, keep)


def ops_of(ops: str) -> Column:
    """The distinct operations in order of (line_no, block_no, op)."""
    return F.array_distinct(F.transform(F.sort_array(ops), lambda o: o["op"]))


def files_of(when: Column) -> Column:
    """The aggregate of at, file, ops and count to files, in order of the first touch."""
    return F.sort_array(F.collect_list(F.when(when, F.struct("at", "file", "ops", "count"))))


def in_order(files: str) -> Column:
    return F.transform(files, lambda f: F.struct(f["file"].alias("path"), f["ops"].alias("ops"), f["count"].alias("count")))


def touched_files(touches: DataFrame) -> DataFrame:
    """path and files: a file's distinct operations and its number of touches, in order of the first touch."""
    rows = touches.repartition("path")
    per = rows.groupBy("path", F.col("text").alias("file"), "op").agg(F.min(F.struct(*AT)).alias("at"), F.count("*").alias("n"))
    per = per.groupBy("path", "file").agg(F.min("at").alias("at"), F.sum("n").cast("int").alias("count"), F.sort_array(F.collect_list(F.struct("at", "op"))).alias("ops"))
    files = per.withColumn("ops", F.transform("ops", lambda o: o["op"])).groupBy("path").agg(files_of(F.lit(True)).alias("files"))
    return files.select("path", in_order("files").alias("files"))


def last_activities(rows: DataFrame, *by: str) -> DataFrame:
    """activities() with n: the last activity within path and by is 1; null for what is none."""
    w = Window.partitionBy("path", *by).orderBy(F.col("act").isNull(), F.desc("line_no"), F.desc("block_no"), F.desc("act"))
    return rows.withColumn("n", F.row_number().over(w)).withColumn("n", F.when(F.col("act").isNotNull(), F.col("n")))


def head_of(text: Column) -> Column:
    return F.substring(first_line(text), 1, HEAD_CHARS)


def entry() -> tuple[Column, ...]:
    return F.col("act"), head_of(F.col("head")).alias("head"), F.substring("body", 1, BODY_CHARS).alias("body"), F.col("ts")


def tails(steps: DataFrame) -> DataFrame:
    """path and tail: the last activities, oldest first."""
    return merged(partials(steps, tail=True), tail=True, all_paths=True).filter(F.size("tail") > 0).select("path", "tail")
