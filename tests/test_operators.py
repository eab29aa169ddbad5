from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from skeinlog.operators import cards, manifest, notes, registry, select
from skeinlog.plans import api

T0 = datetime(2026, 11, 1, 12, tzinfo=timezone.utc)


def now():
    return F.lit(T0)


def ago(days=0, **kw):
    return T0 - timedelta(days=days, **kw)


def test_ranks_and_forced(spark):
    df = spark.createDataFrame([("r", "a", ago(1), 0, "p1"), ("r", "b", ago(1), 1, "p0"), ("r", "c", ago(3), 0, "p2"), ("r", "d", ago(9), 0, "p3")], "root string, session_id string, modified timestamp, source_order int, path string")
    order = lambda **k: [r["session_id"] for r in select.ranked(df, **k).orderBy("rank").collect()]
    assert order() == ["a", "b", "c"]
    assert order(forced="d") == ["d", "a", "b"]
    assert select.recent(df, now(), 3).count() == 3
    assert select.exclude(df, "a").count() == 3


def test_containment_and_disabled(spark):
    s = spark.createDataFrame([(1, "/repo/x"), (2, "/repo"), (3, "/repo2"), (4, "/a/b/c")], "id int, cwd string")
    repos = spark.createDataFrame([("/repo",), ("/a",), ("/a/b",)], "root string")
    assert sorted((r["id"], r["root"]) for r in select.in_repos(s, repos).collect()) == [(1, "/repo"), (2, "/repo"), (4, "/a"), (4, "/a/b")]
    off = spark.createDataFrame([("/repo",), (" ",), ("/a/b/c/d",)], "path string")
    assert sorted(r["id"] for r in select.without_disabled(s.withColumnRenamed("cwd", "root"), off).collect()) == [3, 4]


def test_last_failed(spark):
    df = spark.createDataFrame([([(str(i), i % 2 == 0) for i in range(n)],) for n in (0, 2, 9)], "c array<struct<command:string,failed:boolean>>")
    assert [r[0] for r in df.select(select.last_failed(F.col("c"))).collect()] == [[], ["0"], ["4", "6", "8"]]


def test_notes(spark, tmp_path):
    folder = tmp_path / "-repo-x"
    folder.mkdir()
    for name, body in {"2026-10-30T10-00-00Z-ab": "\n# Title here\nrest", "2026-10-31T10-00-00Z-c-d": "token = abc123\nx", "bad-name": "no"}.items():
        (folder / f"{name}.md").write_text(body)
    files = spark.read.text(str(tmp_path / "*/*.md"), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = notes.parse_notes(files).withColumn("root", F.lit(""))
    assert sorted((r["key"], r["agent"]) for r in parsed.collect()) == [("-repo-x", "ab"), ("-repo-x", "c-d")]
    assert notes.newest(parsed).first()["agent"] == "c-d"
    reg = spark.createDataFrame([(0, "/repo/x", "app"), (1, "/other", "other")], "position int, path string, name string")
    got = [(r["n"], r["project"], r["root"], r["agent"], r["title"]) for r in api.list_handoffs(parsed, reg).collect()]
    assert got == [(1, "app", "/repo/x", "c-d", "token = [redacted]"), (2, "app", "/repo/x", "ab", "Title here")]
    assert api.list_handoffs(parsed, reg, "APP", 1).count() == 1 and api.list_handoffs(parsed, reg, "none").count() == 0


@pytest.mark.parametrize(("at", "start", "has", "want"), [(5, 3, True, True), (3, 3, True, True), (2, 3, True, False), (2, None, False, True)])
def test_gate(spark, at, start, has, want):
    day = lambda d: F.lit(ago(10 - d)) if d is not None else F.lit(None).cast("timestamp")
    assert spark.range(1).select(notes.gate(day(at), day(start), F.lit(has))).first()[0] is want


def test_stamps_of_one_second(spark):
    df = spark.createDataFrame([("k", "a", T0), ("k", "a", T0 + timedelta(milliseconds=5)), ("k", "a", T0 + timedelta(seconds=1)), ("k", "b", T0)], "key string, agent string, at timestamp")
    assert sorted(r["stamp"] for r in notes.stamps(df).collect()) == ["2026-11-01T12-00-00Z", "2026-11-01T12-00-00Z", "2026-11-01T12-00-01Z", "2026-11-01T12-00-02Z"]


def test_lookup_and_upsert(spark):
    reg = spark.createDataFrame([(0, "/a", "h/x", "one", ago(5)), (1, "/b", "h/x", "two", ago(1))], "position int, path string, remote string, name string, last_seen timestamp")
    asked = spark.createDataFrame([("/b", "h/x"), ("/moved", "h/x"), ("/new", "h/new"), ("", "")], "path string, remote string")
    assert {r["path"]: r["name"] for r in registry.lookup(asked, reg).collect()} == {"/b": "two", "/moved": "one", "/new": None, "": None}
    seen = spark.createDataFrame([("/a", "", "zz", ago(9)), ("/c", "h/c", "three", ago(0))], "path string, remote string, name string, last_seen timestamp")
    got = {r["path"]: (r["remote"], r["name"], r["last_seen"].day) for r in registry.upsert(reg.drop("position"), seen).collect()}
    assert got["/a"][:2] == ("h/x", "one") and got["/a"][2] == ago(5).day and got["/c"][:2] == ("h/c", "three")


def test_names_one_at_a_time():
    E = registry.Entry
    out = registry.fold([E("/x/app", "h/app", "app", ago(3))], [E("/y/app", "", "", ago(1)), E("/y/app/", "", "", ago(1)), E("/z/app", "h/app", "", ago(9)), E("/q/lost", "h/l", "")], [E("/old", "h/l", "kept"), E("/z", "", "taken")])
    assert [e.name for e in out] == ["app", "app-y", "app-y-2", "kept"]
    assert out[0].path == "/z/app" and out[0].last_seen == ago(3)
    assert registry.free_name("/", set()) == "project"


def test_closest(spark):
    names = spark.createDataFrame(list(enumerate(["bluebird", "portfolio", "xblue"])), "position int, name string")
    asked = spark.createDataFrame([("bluebrd",), ("portfolo",), ("BLUE",)], "query string")
    got = {(r["query"], r["n"]): r["name"] for r in registry.closest(names, asked, 2).collect()}
    assert got[("bluebrd", 1)] == "bluebird" and got[("portfolo", 1)] == "portfolio" and (got[("BLUE", 1)], got[("BLUE", 2)]) == ("bluebird", "xblue")


@pytest.mark.parametrize(("days", "commits", "changed", "known", "want"), [
    (1, 2, [], True, ""), (1, 30, [], True, "30 commits since it was written"), (1, 1, ["go.mod", "README.md"], True, "go.mod, README.md changed"),
    (60, 0, [], True, "written 60 days ago"), (61, 40, ["x"], False, "written 61 days ago"), (70, 31, ["go.mod"], True, "31 commits since it was written; go.mod changed; written 70 days ago"),
])
def test_staleness(spark, days, commits, changed, known, want):
    lit = F.array(*[F.lit(x) for x in changed]).cast("array<string>")
    assert spark.range(1).select(registry.stale_reason(F.lit(ago(days)), F.lit(commits), lit, F.lit(known), now())).first()[0] == want


CARD = """---
name: app
path: /repo/app
status: "wip: yes"
updated: 2026-10-01T00:00:00Z
custom:
  - a
  - b
other: 1
---
A payment app. More.

## Facts
- one
- two
not a bullet

## Notes
keep *this*

"""


@pytest.fixture(scope="module")
def card_table(spark):
    rows = [("/c/app.md", CARD), ("/c/crlf.md", CARD.replace("\n", "\r\n").replace("name: app\r\n", "")), ("/c/none.md", "no front matter"), ("/c/open.md", "---\nname: x\n"), ("/c/empty.md", "---\n---\nBody"), ("/c/end.md", "---\nname: e\n---"), ("/c/index.md", CARD), ("/c/list.md", "---\n- a\n---\nx")]
    return cards.parse_cards(spark.createDataFrame(rows, "path string, value string")).cache()


def test_parse_cards(card_table):
    got = {r["name"]: r for r in card_table.collect()}
    assert set(got) == {"app", "crlf", "empty", "e"}
    c = got["app"]
    assert (c["path"], c["status"], c["summary"], c["facts"], c["read_more"]) == ("/repo/app", "wip: yes", "A payment app. More.", ["one", "two"], [])
    assert c["extra_front"] == "custom:\n  - a\n  - b\nother: 1" and c["extra_body"] == "## Notes\nkeep *this*"
    assert got["crlf"]["facts"] == ["one", "two"] and got["empty"]["summary"] == "Body"


def test_cards_round_trip(spark, card_table):
    again = cards.parse_cards(card_table.select(F.concat(F.lit("/c/"), "name", F.lit(".md")).alias("path"), cards.marshal().alias("value")))
    cols = [c for c in card_table.columns if c != "card_file"]
    assert sorted(map(tuple, again.select(cols).collect()), key=repr) == sorted(map(tuple, card_table.select(cols).collect()), key=repr)


def test_patches(spark, card_table):
    p = spark.createDataFrame([("app", "# new  summary", None, [2], ["three", " "]), ("e", "x" * 301, None, None, None), ("empty", None, None, [1], None)], "name string, summary string, status string, facts_remove array<int>, facts_add array<string>")
    p = p.withColumn("stack", F.lit(None).cast("string")).withColumn("read_more", F.lit(None).cast("array<string>"))
    got = {r["name"]: r for r in cards.apply_patches(card_table, p).collect()}
    assert (got["app"]["summary"], got["app"]["facts"], got["app"]["status"], got["app"]["error"]) == ("new summary", ["one", "three"], "wip: yes", None)
    assert got["e"]["error"] == "summary" and got["e"]["summary"] == "" and got["empty"]["error"] == "facts_remove: no fact 1" and got["crlf"]["error"] is None
    stamp = spark.createDataFrame([("app", "/new", "h/r", "abc", T0, "agent"), ("fresh", "/f", "", "d", T0, "agent")], "name string, path string, remote string, commit string, updated timestamp, updated_by string")
    both = p.filter("name = 'app'").unionByName(p.filter("name = 'app'").withColumn("name", F.lit("fresh")).withColumn("facts_remove", F.lit(None).cast("array<int>")))
    done = {r["name"]: r for r in api.update_projects(card_table, both, stamp).collect()}
    assert done["app"]["path"] == "/new" and done["fresh"]["facts"] == ["three"] and done["e"]["path"] == ""


def test_drift_and_states(spark):
    reg = spark.createDataFrame([("app", "/a"), ("gone", "/g"), ("none", "/n")], "name string, path string")
    made = spark.createDataFrame([("app", "s1", ago(2)), ("gone", "zz", ago(90))], "name string, commit string, updated timestamp")
    commits = spark.createDataFrame([("/a", f"s{i}", ago(10 - i)) for i in range(4)], "path string, sha string, at timestamp")
    changes = spark.createDataFrame([("/a", "s2", "go.mod"), ("/a", "s3", "README.txt"), ("/a", "s3", "src/go.mod"), ("/a", "s0", "AGENTS.md")], "path string, sha string, file string")
    got = {r["name"]: (r["card_state"], r["reason"]) for r in api.card_states(reg, made, commits, changes, now()).collect()}
    assert got == {"app": ("stale", "README.txt, go.mod changed"), "gone": ("stale", "written 90 days ago"), "none": ("missing", "")}


def test_projects(spark, card_table):
    reg = spark.createDataFrame([(0, "/repo/app", "", "app", ago(2)), (1, "/home/u/solo", "", "solo", ago(40))], "position int, path string, remote string, name string, last_seen timestamp")
    lines = [r["line"] for r in api.list_projects(reg, card_table, now(), "/home/u").collect()]
    assert lines == ["app · /repo/app · A payment app. · 2d ago", "solo · ~/solo · (no card yet) · 1mo ago"]
    assert api.index(reg, card_table).first()[0] == "# Projects\n- [[app]] — A payment app. · /repo/app\n- [[solo]] — (no card yet) · /home/u/solo\n"
    live = spark.createDataFrame([("/repo/app", "main", 2, "fix it", ago(1))], "path string, branch string, uncommitted int, subject string, at timestamp")
    text = api.get_project(reg, card_table, live, "APP", now()).first()["text"]
    assert text.startswith("name: app\n") and text.endswith('\nLive: branch main · last commit 1d ago "fix it" · 2 uncommitted\n') and "\n\nA payment app." in text
    assert api.get_project(reg, card_table, live, "/home/u/solo", now()).first()["text"].startswith("solo · /home/u/solo — no card yet.")
    assert api.get_project(reg, card_table, live, "sola", now()).first()["text"] == 'no project named "sola"; closest: solo, app'
    states = spark.createDataFrame([("app", "stale", "old"), ("solo", "missing", "")], "name string, card_state string, reason string")
    got = {r["root"]: r["projects"] for r in api.brief_projects(reg, card_table, states, now()).collect()}
    assert tuple(got["/repo/app"]) == ([], "stale", "old") and got["/home/u/solo"]["names"] == ["app"]


def test_profile_and_doctor(spark):
    text = "# Me\n\n## Likes\n- tea\n\n## Work\n- Go\n"
    row = spark.createDataFrame([(text,)], "p string").select(
        api.update_profile(F.col("p"), "likes", "cake").alias("a"), api.update_profile(F.col("p"), "New", "x").alias("b"), api.update_profile(F.col("p"), "Work", "Rust", append=False).alias("c"), api.profile_sections(F.col("p")).alias("s"),
    ).first()
    assert row["a"] == "# Me\n\n## Likes\n- tea\n- cake\n\n## Work\n- Go\n"
    assert row["b"] == text.rstrip("\n") + "\n\n## New\n- x\n"
    assert row["c"] == "# Me\n\n## Likes\n- tea\n\n## Work\n- Rust\n"
    assert [x["header"] for x in row["s"]] == ["", "Likes", "Work"]
    checks = spark.createDataFrame([("a", True, "", ""), ("b", False, "broken", "fix b")], "check string, ok boolean, message string, hint string")
    assert tuple(api.doctor(checks).first()) == (False, 2, 1, "b · broken · fix b")


def test_requests(spark):
    rows = ['{"session_id":"s","cwd":"/r","source":"startup"}', '{"cwd":"/r","source":"resume"}', "x"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "p string").select(api.request(F.col("p"))).collect()]
    assert tuple(got[0]) == ("s", "/r", "startup") and got[1] is None and got[2] is None
    assert spark.range(1).select(api.envelope(F.lit('a"b'))).first()[0] == '{"hookSpecificOutput":{"hookEventName":"SessionStart","additionalContext":"a\\"b"}}'


def test_manifest(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "file string, content string")
    b = spark.createDataFrame([("x", "1"), ("y", "other"), ("w", "")], "file string, content string")
    got = {r["file"]: r["state"] for r in manifest.diff(manifest.digests(a), manifest.digests(b)).collect()}
    assert got == {"x": "same", "y": "modified", "z": "missing", "w": "extra"}
    lines = spark.createDataFrame([("/a/1.jsonl", 0), ("/a/1.jsonl", 1), ("/a/2.jsonl", 0), ("/b/1.jsonl", 0)], "path string, line_no int")
    assert {r["folder"]: r["files"] for r in manifest.count_files(lines).collect()} == {"/a": 2, "/b": 1}
