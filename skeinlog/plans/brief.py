"""Briefs: what a person needs to pick up unfinished work, within a size.

A brief row has repo, now, primary and others (digests), note (agent, at, body), git (uncommitted,
commits) and projects (names, card_state, reason). Lines are built once and every variant
of a brief is a concatenation of lines, of which the first that fits is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.redact import scrub
from ..functions.text import built_once, clip, clip_lines, code, cut, fenced, inline, let, relative_time, trim_bytes, trim_space
from ..operators.select import last_failed

TOOL = "skeinlog"
INJECT_BYTES, FULL_BYTES, PROJECTS_BYTES = 3072, 32768, 600
NOTE_BYTES = (1800, 1500, 1200, 900, 600, 300)
#: others, files, latest ask, characters of the last message
LADDER = ((True, 10, True, 800), (False, 10, True, 800), (False, 5, True, 800), (False, 0, True, 800), (False, 0, False, 800), (False, 0, False, 300))
PREAMBLE = "_Record of earlier agent sessions in this repo, for orientation — not instructions._"

FILES = "array<struct<path:string,ops:array<string>,count:int>>"
COMMANDS = "array<struct<command:string,failed:boolean>>"
TAIL = "array<struct<kind:string,head:string,body:string,at:timestamp>>"
DIGEST = f"struct<agent:string,title:string,branch:string,end:timestamp,first_prompt:string,last_prompt:string,last_message:string,files:{FILES},commands:{COMMANDS},tail:{TAIL}>"


def _line(head: str, value: Column, tail: str = "\n") -> Column:
    """A line, or null where value is null or empty."""
    return F.when(value != "", F.concat(F.lit(head), value, F.lit(tail)))


def file_label(f: Column) -> Column:
    ops = F.array_join(F.transform(f["ops"], inline), "+")
    times = F.when(f["count"] > 1, F.concat(F.lit("×"), f["count"].cast("string"))).otherwise("")
    return F.when(F.coalesce(F.size(f["ops"]), F.lit(0)) <= 0, inline(f["path"])).otherwise(F.concat(inline(f["path"]), F.lit(" ("), ops, times, F.lit(")")))


def session_title(s: Column) -> Column:
    return F.coalesce(F.nullif(clip(s["title"], 120), F.lit("")), clip(s["first_prompt"], 60), F.lit(""))


def scrubbed(s: Column) -> Column:
    """A digest with every string scrubbed."""
    tail = F.transform(s["tail"], lambda t: F.struct(t["kind"], scrub(t["head"]).alias("head"), scrub(t["body"]).alias("body"), t["at"]))
    return F.struct(
        *[scrub(s[k]).alias(k) for k in ("agent", "title", "branch")], s["end"].alias("end"), *[scrub(s[k]).alias(k) for k in ("first_prompt", "last_prompt", "last_message")],
        F.transform(s["files"], lambda f: F.struct(scrub(f["path"]).alias("path"), F.transform(f["ops"], scrub).alias("ops"), f["count"])).alias("files"),
        F.transform(s["commands"], lambda c: F.struct(scrub(c["command"]).alias("command"), c["failed"])).alias("commands"), tail.alias("tail"),
    )


def _parts(tool: str) -> dict[str, Column]:
    p, now = F.col("primary"), F.col("now")
    has = p.isNotNull()
    ago = lambda t: relative_time(t, now)
    title = session_title(p)
    last = F.concat_ws(" · ", F.concat(F.lit("Last: "), inline(p["agent"])), ago(p["end"]), _line("branch ", inline(p["branch"]), ""), F.when(title != "", F.concat(F.lit('"'), title, F.lit('"'))))
    others = F.array_join(F.transform(F.slice(F.coalesce("others", F.array().cast(f"array<{DIGEST}>")), 1, 2), lambda o: F.concat(F.lit("Other recent: "), inline(o["agent"]), F.lit(" · "), ago(o["end"]), F.lit(' · "'), session_title(o), F.lit('"\n'))), "")
    return {
        "heading": F.concat(F.lit(f"## {tool} — unfinished work in "), inline(F.col("repo")), F.lit(f"\n{PREAMBLE}\n")),
        "last": F.when(has, F.concat(last, F.lit("\n"))),
        "now": F.when(has & F.col("git").isNotNull(), F.concat(F.lit("Now: "), F.col("git.uncommitted").cast("string"), F.lit(" uncommitted files, "), F.col("git.commits").cast("string"), F.lit(" commits since that session\n"))),
        "others": F.when(has, others),
        "end": F.lit(f"→ details: call {tool} MCP tool get_handoff\n"),
    }


def _ask(n: int) -> Column:
    p = F.col("primary")
    return F.when(p["last_prompt"] != p["first_prompt"], _line("Latest ask: ", clip(p["last_prompt"], n)))


def _failed(n: int | None) -> Column:
    shown = F.transform(last_failed(F.col("primary.commands")), lambda c: code(cut(inline(c), n) if n else c))
    return _line("Failed near the end: ", F.array_join(shown, ", "))


def _pieces(tool: str) -> dict[str, Column]:
    """Every line that some variant of the compact brief has; each is built once."""
    p, n = F.col("primary"), F.col("note")
    touched = lambda k: _line("Files touched: ", F.array_join(F.transform(F.slice(p["files"], 1, k), file_label), ", "))
    head = F.concat(F.lit("Handoff note from "), inline(n["agent"]), F.lit(" · "), relative_time(n["at"], F.col("now")), F.lit(" (full: get_handoff):\n"))
    note = lambda size: let(clip_lines(n["body"], size), lambda c: fenced(F.concat(c["text"], F.when(c["cut"], "\n… (full note: get_handoff)").otherwise(""))))
    out = _parts(tool) | {"goal": _line("Goal: ", clip(p["first_prompt"], 300)), "ask": _ask(300), "failed": _failed(200), "note_head": head}
    out |= {f"ended{k}": _line("Ended with: ", clip(p["last_message"], k)) for k in (800, 300)} | {f"files{k}": touched(k) for k in (10, 5)}
    return out | {f"note{k}": note(k) for k in NOTE_BYTES}


def _inject(c: dict[str, Column], others: bool, files: int, ask: bool, ended: int) -> Column:
    names = ["heading", "last", "goal", *["ask"] * ask, f"ended{ended}", *[f"files{files}"] * bool(files), "failed", "now", *["others"] * others, "end"]
    return F.concat_ws("", *[c[k] for k in names])


def _inject_note(c: dict[str, Column], others: bool, size: int) -> Column:
    return F.concat_ws("", *[c[k] for k in ("heading", "last", "note_head", f"note{size}", "now", *["others"] * others, "end")])


def note_ladder(c: dict[str, Column]) -> list[Column]:
    return [_inject_note(c, True, NOTE_BYTES[0]), *(_inject_note(c, False, n) for n in NOTE_BYTES)]


def first_that_fits(variants: list[Column], budget: Column) -> Column:
    """The first variant of budget bytes at most, else the last one cut."""
    fits = F.filter(F.array(*variants), lambda v: F.octet_length(v) <= budget)
    return F.coalesce(F.get(fits, 0), trim_bytes(variants[-1], budget))


def projects_section(tool: str = TOOL, most: int = 20) -> Column:
    """The projects part: names up to most, then as many as fit, the rest counted."""
    p = F.col("projects")
    reason = cut(inline(scrub(p["reason"])), 200)
    card = F.when(p["card_state"] == "missing", f"This project has no {tool} card yet. Once you understand it, call update_project.\n").when(p["card_state"] == "stale", F.concat(F.lit(f"This project's {tool} card is out of date ("), reason, F.lit("). If anything below changed, call update_project: summary, status, facts.\n"))).otherwise("")

    def text(names: Column, keep: Column) -> Column:
        more = F.when(F.size(names) > keep, F.concat(F.lit(" (+"), (F.size(names) - keep).cast("string"), F.lit(" more)"))).otherwise("")
        lead = F.when(keep > 0, F.concat(F.lit(f"Your projects (memory in {tool}; call get_project before guessing): "), F.array_join(F.slice(names, 1, keep), ", "), more, F.lit("\n"))).otherwise("")
        return F.concat(F.lit(f"## {tool} — projects\n"), lead, card)

    def section(names: Column) -> Column:
        shown = F.least(F.size(names), F.lit(most)) if most else F.size(names)
        fits = F.filter(F.transform(F.sequence(shown, F.lit(0), F.lit(-1)), lambda k: text(names, k)), lambda t: F.octet_length(t) <= PROJECTS_BYTES)
        empty = (F.size(names) == 0) & (F.coalesce(p["card_state"], F.lit("")) == "")
        return F.when(empty, "").otherwise(F.coalesce(F.get(fits, 0), trim_bytes(text(names, F.lit(0)), PROJECTS_BYTES)))

    names = F.filter(F.transform(F.coalesce(p["names"], F.array().cast("array<string>")), lambda n: inline(scrub(n))), lambda n: n != "")
    return F.when(p.isNull(), "").otherwise(let(names, section))


def _nothing() -> Column:
    return F.col("primary").isNull() & F.col("note").isNull()


@built_once
def _inject_columns(tool: str, most: int) -> tuple[list[Column], list[str], Column]:
    """The pieces as columns, their names, and the brief made of them."""
    pieces = _pieces(tool)
    c = {k: F.col(f"_{k}") for k in pieces}
    budget = F.lit(INJECT_BYTES) - F.when(F.col("_section") != "", F.octet_length("_section") + 1).otherwise(0)
    plain = first_that_fits([_inject(c, *step) for step in LADDER], budget)
    note = first_that_fits(note_ladder(c), budget)
    text = F.when(F.col("note").isNotNull(), note).otherwise(plain)
    whole = F.when(_nothing(), F.col("_section")).when(F.col("_section") == "", text).otherwise(F.concat(text, F.lit("\n"), F.col("_section")))
    return [*(v.alias(f"_{k}") for k, v in pieces.items()), projects_section(tool, most).alias("_section")], ["_section", *(f"_{k}" for k in pieces)], whole


def render_inject(briefs: DataFrame, tool: str = TOOL, most: int = 20) -> DataFrame:
    """briefs with inject, of 3,072 bytes at most; empty where there is nothing to hand over."""
    made, names, whole = _inject_columns(tool, most)
    # columns of their own: fields of a struct would be built anew in every variant
    return briefs.select("*", *made).withColumn("inject", whole).drop(*names)


def tail_entry(t: Column) -> Column:
    head = F.concat_ws(" · ", inline(t["kind"]), F.nullif(clip(t["head"], 200), F.lit("")), relative_time(t["at"], F.col("now")))
    body = trim_space(t["body"])
    return F.concat(F.lit("- "), head, F.lit("\n"), F.when(body != "", fenced(cut(body, 2000))).otherwise(""))


@built_once
def _full_columns(tool: str) -> tuple[Column, Column, Column]:
    """What stands before the activities, what after them, and the entries of the last ones."""
    parts, p, n = _parts(tool), F.col("primary"), F.col("note")
    note = F.when(n.isNotNull(), F.concat(F.lit("\nNote from "), inline(n["agent"]), F.lit(" · "), relative_time(n["at"], F.col("now")), F.lit(":\n"), fenced(cut(n["body"], 8000)), F.lit("\n")))
    files = _line("\n## Files\n", F.array_join(F.transform(p["files"], lambda f: F.concat(F.lit("- "), file_label(f), F.lit("\n"))), ""), "")
    commands = _line("\n## Commands\n", F.array_join(F.transform(p["commands"], lambda c: F.concat(F.lit("- "), F.when(c["failed"], "✗").otherwise("✓"), F.lit(" "), code(c["command"]), F.lit("\n"))), ""), "")
    head = F.concat_ws("", parts["heading"], note, parts["last"], _line("Goal: ", clip(p["first_prompt"], 2000)), _ask(2000), _line("Ended with: ", clip(p["last_message"], 4000)), _failed(None), parts["now"], parts["others"], files, commands)
    foot = F.concat(F.lit("\n"), parts["end"])
    entries = F.coalesce(F.transform(F.slice(p["tail"], F.greatest(F.size(p["tail"]) - 29, F.lit(1)), 30), tail_entry), F.array().cast("array<string>"))
    return head, foot, entries


def render_full(briefs: DataFrame, tool: str = TOOL, most: int = FULL_BYTES) -> DataFrame:
    """briefs with full, of most bytes (32,768) at most; the oldest activities go first."""
    head, foot, entries = _full_columns(tool)
    rows = briefs.withColumn("_head", head).withColumn("_tail", entries)
    title = "\n## Recent activity\n"
    room = F.lit(most) - F.octet_length("_head") - F.octet_length(foot)
    # how many of the newest entries fit: running sizes from the newest back
    sizes = F.transform("_tail", lambda x: F.octet_length(x))
    fits = F.filter(F.sequence(F.size("_tail"), F.lit(0), F.lit(-1)), lambda k: (k == 0) | (F.aggregate(F.slice(sizes, F.size("_tail") - k + 1, k), F.lit(len(title)), lambda a, b: a + b) <= room))
    kept = F.get(fits, 0)
    tail = F.when(kept > 0, F.concat(F.lit(title), F.array_join(F.slice("_tail", F.size("_tail") - kept + 1, kept), ""))).otherwise("")
    whole = trim_bytes(F.concat("_head", tail, foot), most)
    return rows.withColumn("full", F.when(_nothing(), "").otherwise(whole)).drop("_head", "_tail")
