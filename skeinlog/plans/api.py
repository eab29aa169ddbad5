"""The engine's calls: each answers for every repository of its inputs at once.

Side inputs are tables: repos (root, name), git (root, branch, uncommitted), commits (root, at), notes,
registry and cards. Times are timestamps.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import built_once, collapse, first_sentence, fold_case, relative_time, repo_key, tilde, trim_space
from ..operators import cards as card_ops
from ..operators import digest, notes as note_ops, registry as reg_ops, select
from ..sources import files, transcripts
from .brief import DIGEST, TOOL, render_full, render_inject, scrubbed

MAX_LIST, DEFAULT_SESSIONS, DEFAULT_NOTES = 50, 10, 15
NO_CARD = "(no card yet)"


def load_sessions(spark: SparkSession, roots: dict[str, tuple[str, str]], since: datetime | None = None, tail: bool = False, repos: Sequence[str] | None = None, newest: int | None = None) -> DataFrame:
    """Digests of all transcripts; roots: agent to (dialect, folder). The order of the agents breaks ties.

    since (a time of modification, in UTC) and repos (roots of repositories) leave folders unread; with newest,
    only that many files of each folder are read: those modified last. A source that cannot be listed is left
    out with a warning, and a file that is gone when it is read gives nothing."""
    out = None
    for order, (agent, (dialect, root)) in enumerate(roots.items()):
        try:
            lines = transcripts.discover(spark, root, dialect, since, repos, newest)
        except Exception as e:  # whatever its store says: the other sources still answer
            warnings.warn(f"source {agent!r} is left out: {e}", stacklevel=2)
            continue
        found = digests(lines, dialect, tail).withColumns({"agent": F.lit(agent), "session_id": transcripts.session_id(dialect, F.col("path")), "source_order": F.lit(order)})
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], no_sessions(tail)) if out is None else out


def digests(lines: DataFrame, dialect: str, tail: bool = False, complete: bool = False) -> DataFrame:
    """Digests of the files of lines (see raw_lines), with their time of modification; a working directory counts if
    it is named early in the file. complete: as the lines of files.lines are, none of which lacks its line break."""
    keep = ("modified", *(["whole"] if "whole" in lines.columns else []))
    steps = digest.slim(transcripts.DIALECTS[dialect](lines), tail)
    return digest.merged(digest.partials(steps, tail, keep, last_apart=not complete), tail, keep, complete)


def references(spark: SparkSession, roots: dict[str, tuple[str, str]], repos: DataFrame, since: datetime | None = None, within: Sequence[str] | None = None) -> DataFrame:
    """The files that belong to repositories, newest first: root, name, n (1 is the newest of its root), agent,
    dialect, source_order, session_id and the file. Contents are read for the working directory in their first lines
    only. A source that cannot be listed is left out with a warning."""
    out = None
    for order, (agent, (dialect, root)) in enumerate(roots.items()):
        bounds = files.Bounds()
        if since is not None:
            bounds.kept.append(lambda at, x: at != "modified" or x >= files.micros(since))
        try:
            found = files.probe(files.listing(spark, root, dialect, bounds, within), dialect)
        except Exception as e:  # whatever its store says: the other sources still answer
            warnings.warn(f"source {agent!r} is left out: {e}", stacklevel=2)
            continue
        found = found.withColumns({"agent": F.lit(agent), "dialect": F.lit(dialect), "source_order": F.lit(order), "session_id": transcripts.session_id(dialect, F.col("path"))})
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "folder string, day date, path string, modified timestamp, size bigint, cwd string, agent string, dialect string, source_order int, session_id string")
    return select.ranked(select.in_repos(out, repos), keep=None).withColumnRenamed("rank", "n")


def load_recent(spark: SparkSession, roots: dict[str, tuple[str, str]], repos: DataFrame, limit: int = select.SESSIONS, full: bool = False, since: datetime | None = None, within: Sequence[str] | None = None, seen: list | None = None) -> DataFrame:
    """The newest sessions of each repository, `limit` at most, as sessions_of() gives them, with whole (all of the
    file was read). Files are read in waves, newest first and of their ends only: first `limit` of each repository,
    then twice as many each time of those repositories that have too few sessions yet (a file without a prompt is
    none). With full each repository's newest session is read as a whole, with its last activities. seen: a list
    that the number of files of each wave is appended to."""
    refs = references(spark, roots, repos, since, within).persist()
    side = ["root", "name", "n", "agent", "dialect", "source_order", "session_id"]
    file = ["folder", "day", "path", "modified", "size"]

    def read(chosen: DataFrame, whole: bool) -> DataFrame:
        out = None
        for dialect in sorted({d for d, _ in roots.values()}):
            own = chosen.filter(F.col("dialect") == dialect).select(*file).distinct()
            lines = files.read_whole(own) if whole else files.read_ends(own, dialect)
            found = digests(lines, dialect, full, complete=True)
            out = found if out is None else out.unionByName(found)
        return chosen.select(*side, "path").join(out, "path")

    valid, low, wave = None, 0, limit
    todo = refs.select("root").distinct()
    while valid is None or todo.limit(1).count():
        chosen = refs.filter((F.col("n") > low) & (F.col("n") <= low + wave)).join(todo, "root", "left_semi")
        if seen is not None:
            seen.append(chosen.select("path").distinct().count())
        found = (read(chosen, False) if roots else spark.createDataFrame([], f"root string, name string, n int, {no_sessions(full)}, whole boolean, dialect string")).persist()
        valid = found if valid is None else valid.unionByName(found)
        low, wave = low + wave, wave * 2
        enough = valid.groupBy("root").count().filter(F.col("count") >= limit).select("root")
        todo = refs.filter(F.col("n") > low).select("root").distinct().join(enough, "root", "left_anti")
    top = valid.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy("n"))).filter(F.col("rank") <= limit)
    if full and roots:
        first = refs.join(top.filter("rank = 1 and not whole").select("root", "n"), ["root", "n"], "left_semi")
        whole = read(first, True).withColumn("rank", F.lit(1))
        top = top.filter("rank > 1 or whole").unionByName(whole.select(*top.columns))
    return select.relative_files(top.drop("n", "dialect", "rank"))


def no_sessions(tail: bool) -> str:
    files, commands = "array<struct<path:string,ops:array<string>,count:int>>", "array<struct<command:string,failed:boolean>>"
    tails = ", tail array<struct<kind:string,head:string,body:string,at:timestamp>>" if tail else ""
    return f"path string, title string, branch string, cwd string, start timestamp, end timestamp, prompt_count int, first_prompt string, last_prompt string, last_message string, files {files}, commands {commands}{tails}, modified timestamp, agent string, session_id string, source_order int"


def sessions_of(sessions: DataFrame, repos: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Recent sessions with the root of each repository they ran in; files below it lose it."""
    return select.relative_files(select.in_repos(select.recent(sessions, now, days), repos))


def list_sessions(sessions: DataFrame, limit: int = DEFAULT_SESSIONS) -> DataFrame:
    """root, rank and what identifies a session, newest first, of sessions_of()."""
    limit = min(limit if limit > 0 else DEFAULT_SESSIONS, MAX_LIST)
    stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("0001-01-01T00:00:00Z"))
    return select.ranked(sessions, limit).select("root", "rank", "agent", F.col("session_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("branch", F.lit("")).alias("branch"), stamp("start").alias("start"), stamp("end").alias("end"), F.col("prompt_count").alias("prompts"))


@built_once
def _digest() -> Column:
    fields = {f.split(":", 1)[0]: f.split(":", 1)[1] for f in ("agent:string", "title:string", "branch:string", "end:timestamp", "first_prompt:string", "last_prompt:string", "last_message:string")}
    cols = [F.coalesce(F.col(k), F.lit("")).alias(k) if t == "string" else F.col(k) for k, t in fields.items()]
    return scrubbed(F.struct(*cols, "files", "commands", "tail")).cast(DIGEST)


def handoff(sessions: DataFrame, repos: DataFrame, notes: DataFrame, git: DataFrame, commits: DataFrame, now: Column, projects: DataFrame | None = None, session_id: str | None = None, exclude: str | None = None, note_id: str | None = None, full: bool = False, tool: str = TOOL) -> DataFrame:
    """A brief for each repository: root, repo, inject and, if asked for, full.

    sessions: of sessions_of(), with tail if full. notes: key, note_id, agent, at, body. A session id asked
    for comes first, and repositories without it get no brief; a note asked for is pinned and moves what
    counts as new. projects: root and projects (see brief).
    """
    if exclude:
        sessions = select.exclude(sessions, exclude)
    if "tail" not in sessions.columns:
        sessions = sessions.withColumn("tail", F.lit(None).cast("array<struct<kind:string,head:string,body:string,at:timestamp>>"))
    top = select.ranked(sessions, forced=session_id)
    if session_id:
        has = top.filter((F.col("rank") == 1) & (F.col("session_id") == session_id)).select("root")
        repos = repos.join(has, "root", "left_semi")
    each = top.select("root", "rank", "start", "end", _digest().alias("digest"))
    each = each.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("rank", "start", "end", "digest"))).alias("s"))
    each = each.select("root", F.get("s", 0).alias("first"), F.transform(F.slice("s", 2, 2), lambda x: x["digest"]).alias("others"))
    shown = notes.filter(F.col("note_id") == note_id) if note_id else note_ops.newest(notes)
    shown = shown.select("key", F.struct("agent", "at", "body").alias("_note"))
    rows = repos.withColumn("key", repo_key(F.col("root"))).join(each, "root", "left").join(shown, "key", "inner" if note_id else "left")
    visible = F.lit(True) if note_id else note_ops.gate(F.col("_note.at"), F.col("first.start"), F.col("first").isNotNull())
    note = F.when(F.col("_note").isNotNull() & visible, F.struct(F.col("_note.agent").alias("agent"), F.col("_note.at").alias("at"), card_ops.redact(F.col("_note.body")).alias("body")))
    since = F.coalesce(F.col("_note.at") if note_id else F.col("first.end"), F.timestamp_seconds(F.lit(0)))
    rows = rows.withColumn("note", note).withColumn("_since", since)
    counted = reg_ops.commits_after(rows, commits, since="_since").withColumnRenamed("commits", "_commits")
    rows = rows.join(git.select("root", "uncommitted"), "root", "left").join(counted, "root", "left")
    state = F.when(F.col("uncommitted").isNotNull(), F.struct("uncommitted", F.coalesce("_commits", F.lit(0)).alias("commits")))
    rows = rows.join(projects, "root", "left") if projects is not None else rows.withColumn("projects", F.lit(None).cast("struct<names:array<string>,card_state:string,reason:string>"))
    briefs = rows.select("root", F.col("name").alias("repo"), now.alias("now"), F.col("first.digest").alias("primary"), "others", "note", state.alias("git"), "projects")
    briefs = render_inject(briefs, tool)
    briefs = render_full(briefs, tool) if full else briefs
    return briefs.select("root", "repo", "inject", *["full"] * full)


def list_handoffs(notes: DataFrame, registry: DataFrame, project: str | None = None, limit: int = DEFAULT_NOTES) -> DataFrame:
    return note_ops.listing(notes, registry, project, min(limit if limit > 0 else DEFAULT_NOTES, MAX_LIST))


def no_handoffs(notes: DataFrame, registry: DataFrame, project: str) -> DataFrame:
    """text for a project that list_handoffs() has no notes of: which projects have some, and which are named alike."""
    found = note_ops.names(notes, registry)
    asked = notes.sparkSession.createDataFrame([(project,)], "query string")
    each = found.select(F.posexplode("names").alias("position", "name"))
    near = reg_ops.closest(each, asked).agg(F.array_sort(F.collect_list(F.struct("n", "name"))).alias("c"))
    hint = F.when(F.size("c") > 0, F.concat(F.lit(". Did you mean: "), F.array_join(F.transform("c", lambda x: x["name"]), ", "), F.lit("?"))).otherwise("")
    some = F.concat(F.lit(f'no handoff notes for "{project}". Projects with notes: '), F.array_join("names", ", "), hint)
    return found.crossJoin(near).select(F.when(F.size("names") == 0, "no handoff notes yet").otherwise(some).alias("text"))  # one row each


def toc_line(now: Column, home: str = "") -> Column:
    """A project's line of the table of contents, from name, path, summary, has_card and last_seen."""
    path = tilde(F.col("path"), home) if home else F.col("path")
    return F.concat_ws(" · ", "name", path, blurb(), relative_time(F.col("last_seen"), now))


def blurb() -> Column:
    return F.when(F.col("has_card") & (trim_space(F.coalesce("summary", F.lit(""))) != ""), first_sentence(F.col("summary"))).otherwise(NO_CARD)


def list_projects(registry: DataFrame, cards: DataFrame, now: Column, home: str = "") -> DataFrame:
    """name and line of each project, last seen first."""
    items = reg_ops.with_cards(registry, cards)
    return items.orderBy(F.desc("last_seen"), "name").select("name", toc_line(now, home).alias("line"))


def index(registry: DataFrame, cards: DataFrame, home: str = "") -> DataFrame:
    """The text of the index of all projects, by name: one row."""
    items = reg_ops.with_cards(registry, cards)
    path = tilde(F.col("path"), home) if home else F.col("path")
    line = F.concat(F.lit("- [["), "name", F.lit("]] — "), blurb(), F.lit(" · "), path, F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct("name", line.alias("line"))))
    return items.agg(F.concat(F.lit("# Projects\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "")).alias("index"))


def card_states(registry: DataFrame, cards: DataFrame, commits: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """name, card_state (missing, stale or fresh) and reason of each project."""
    c = cards.select("name", "commit", "updated")
    reg = registry.select("name", "path").join(c, "name", "left").withColumn("_has", F.col("updated").isNotNull() | F.col("commit").isNotNull())
    drifted = reg_ops.drift(reg, commits, changes)
    reason = reg_ops.stale_reason(F.col("updated"), F.col("commits"), F.col("changed"), F.col("known"), now)
    out = drifted.withColumn("reason", F.when(F.col("_has"), reason).otherwise(""))
    state = F.when(~F.col("_has"), "missing").when(F.col("reason") != "", "stale").otherwise("fresh")
    return out.select("name", state.alias("card_state"), "reason")


def brief_projects(registry: DataFrame, cards: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """root and projects for handoff(): of each project the names of the other active ones, last seen first,
    and the state of its own card. A user's registry is small; its names go into one row."""
    items = reg_ops.active(reg_ops.with_cards(registry, cards), now)
    names = items.agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("last_seen")).alias("t"), "name"))).alias("_n"))
    rows = registry.join(states, "name", "left").crossJoin(names)
    others = F.transform(F.filter("_n", lambda x: x["name"] != F.col("name")), lambda x: x["name"])
    state = F.when(F.col("card_state") == "fresh", "").otherwise(F.coalesce("card_state", F.lit("missing")))
    return rows.select(F.col("path").alias("root"), F.struct(others.alias("names"), state.alias("card_state"), F.coalesce("reason", F.lit("")).alias("reason")).alias("projects"))


def get_project(registry: DataFrame, cards: DataFrame, live: DataFrame, name_or_path: str, now: Column) -> DataFrame:
    """text of a project's card with a line on its repository's state; without the project, the closest names.
    live: path, branch, uncommitted, subject, at."""
    found = reg_ops.find(registry, name_or_path).select("name", "path")
    made = cards.select(F.col("name").alias("_card"), F.regexp_replace(F.substring(card_ops.marshal(), 5, 1 << 30), r"(?s)\A(.*?)\n---\n", "$1\n\n").alias("_text"))
    state = live.select(F.col("path").alias("_path"), F.col("branch").alias("_branch"), "uncommitted", "subject", F.col("at").alias("_at"))
    rows = found.join(made, F.col("name") == F.col("_card"), "left").join(state, F.col("path") == F.col("_path"), "left")
    none = F.concat("name", F.lit(" · "), "path", F.lit(" — no card yet. Read its README.md / CLAUDE.md for details.\n"))
    commit = F.when(F.col("_at").isNotNull(), F.concat(F.lit(" · last commit "), relative_time(F.col("_at"), now), F.lit(' "'), collapse(F.col("subject")), F.lit('"')))
    line = F.when(F.col("_path").isNotNull(), F.concat_ws("", F.lit("\nLive: branch "), "_branch", commit, F.lit(" · "), F.col("uncommitted").cast("string"), F.lit(" uncommitted\n")))
    hit = rows.select(F.concat_ws("", F.coalesce("_text", none), line).alias("text"), F.lit(True).alias("found"))
    asked = registry.sparkSession.createDataFrame([(name_or_path,)], "query string")
    near = reg_ops.closest(registry.select("name", "position"), asked).agg(F.array_sort(F.collect_list(F.struct("n", "name"))).alias("c"))
    miss = near.select(F.concat(F.lit(f'no project named "{name_or_path}"'), F.when(F.size("c") > 0, F.concat(F.lit("; closest: "), F.array_join(F.transform("c", lambda x: x["name"]), ", "))).otherwise("")).alias("text"), F.lit(False).alias("found"))
    both = hit.unionByName(miss)
    return both.orderBy(F.desc("found")).limit(1)


def update_projects(cards: DataFrame, patches: DataFrame, stamp: DataFrame) -> DataFrame:
    """cards after their patches, all or nothing; fields that the engine owns come from stamp (name, path,
    remote, commit, updated, updated_by), which also makes cards that there were none of."""
    own = stamp.select(*[F.col(c).alias(f"_{c}") for c in stamp.columns])
    empty = {"extra_front": "", "extra_body": "", "summary": "", "stack": "", "status": ""}
    new = own.join(cards.select("name"), F.col("_name") == F.col("name"), "left_anti").select(F.col("_name").alias("name"))
    for f in cards.schema.fields:
        if f.name != "name":
            new = new.withColumn(f.name, F.lit(empty[f.name]) if f.name in empty else F.array().cast(f.dataType) if f.name in ("read_more", "facts") else F.lit(None).cast(f.dataType))
    out = card_ops.apply_patches(cards.unionByName(new), patches)
    out = out.join(own, F.col("name") == F.col("_name"), "left")
    done = F.col("_name").isNotNull() & F.col("error").isNull()
    return out.withColumns({c: F.when(done, F.col(f"_{c}")).otherwise(F.col(c)) for c in stamp.columns if c != "name"}).drop(*own.columns)


def profile_sections(profile: Column) -> Column:
    """A profile's `## ` sections: an array of (header, body); the first, without a header, is what stands before."""
    parts = F.split(F.concat(F.lit("\n"), profile), r"\n(?=## )", -1)
    head = lambda s, i: F.when(i == 0, "").otherwise(trim_space(F.substring(F.substring_index(s, "\n", 1), 4, 1 << 30)))
    return F.transform(parts, lambda s, i: F.struct(head(s, i).alias("header"), F.when(i == 0, F.regexp_replace(s, "^\n", "")).when(F.contains(s, F.lit("\n")), F.regexp_replace(s, r"^[^\n]*\n", "")).otherwise("").alias("body")))


def update_profile(profile: Column, header: str, entry: str, append: bool = True) -> Column:
    """The profile with an entry in the section of that header, in any case: appended, or instead of what is
    there; a new section comes last."""
    sections = profile_sections(profile)
    same = lambda s: fold_case(s["header"]) == fold_case(F.lit(header))
    line = f"- {entry}\n"
    body = lambda s: F.concat(F.regexp_replace(s["body"], "\n+$", ""), F.when(trim_space(s["body"]) == "", "").otherwise("\n"), F.lit(line)) if append else F.lit(line)
    text = lambda s: F.concat(F.when(s["header"] == "", "").otherwise(F.concat(F.lit("## "), s["header"], F.lit("\n"))), s["body"])
    done = F.transform(sections, lambda s: F.struct(s["header"].alias("header"), F.when((s["header"] != "") & same(s), body(s)).otherwise(s["body"]).alias("body")))
    whole = F.array_join(F.filter(F.transform(done, lambda s: F.regexp_replace(text(s), "\n+$", "")), lambda x: x != ""), "\n\n")
    missing = ~F.exists(sections, lambda s: (s["header"] != "") & same(s))
    return F.concat(whole, F.when(missing, F.concat(F.when(whole == "", "").otherwise("\n\n"), F.lit(f"## {header}\n{line.rstrip()}"))).otherwise(""), F.lit("\n"))


def doctor(checks: DataFrame, *by: str) -> DataFrame:
    """ok: whether all checks (check, ok, message, hint) passed; n_checks, n_failed, and what to do; for each of by,
    if given."""
    w = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("check", "message", "hint"))))
    todo = F.array_join(F.transform(w, lambda x: F.concat_ws(" · ", x["check"], x["message"], x["hint"])), "\n")
    return checks.groupBy(*by).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"), F.count("*").alias("n_checks"), F.count_if(~F.col("ok")).alias("n_failed"), todo.alias("todo"))


def card_check(cards: DataFrame, registry: DataFrame) -> DataFrame:
    """A check for doctor(): how many of the known projects have a card."""
    known = registry.select(F.col("name").alias("_name")).join(cards.select("name").distinct(), F.col("_name") == F.col("name"), "left")
    n = known.agg(F.count("name").alias("n"), F.count("*").alias("of"))
    return n.select(F.lit("cards").alias("check"), (F.col("n") == F.col("of")).alias("ok"), F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("of").cast("string"), F.lit(" projects have a card")).alias("message"), F.lit("call update_project in the others").alias("hint"))


def request(payload: Column) -> Column:
    """session_id, cwd and source of a hook's request; null where it isn't to be answered."""
    v = F.try_parse_json(payload)
    r = F.struct(*[F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")).alias(k) for k in ("session_id", "cwd", "source")])
    return F.when(v.isNotNull() & ~r["source"].isin("resume", "compact", "fork"), r)


def envelope(text: Column) -> Column:
    """The JSON that a session-start hook prints."""
    return F.to_json(F.struct(F.struct(F.lit("SessionStart").alias("hookEventName"), text.alias("additionalContext")).alias("hookSpecificOutput")))


