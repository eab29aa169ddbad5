from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from skeinlog.plans import api, brief

NOW = datetime(2026, 11, 1, 12, tzinfo=timezone.utc)
SCHEMA = f"repo string, now timestamp, primary {brief.DIGEST}, others array<{brief.DIGEST}>, note struct<agent:string,at:timestamp,body:string>, git struct<uncommitted:int,commits:int>, projects struct<names:array<string>,card_state:string,reason:string>"


def digest(**kw):
    base = {"agent": "agent a", "title": "Add payments", "branch": "feat/pay", "end": NOW - timedelta(hours=2), "first_prompt": "implement checkout", "last_prompt": "now fix the test", "last_message": "Still fails."}
    base |= {"files": [(f"pay/f{i}.go", ["edit", "write"] if i == 1 else ["edit"], 1 + i % 3) for i in range(12)], "commands": [("build", False), ("t A", True), ("t B", True), ("vet", False), ("t C", True), ("t D", True)]}
    base |= {"tail": [("user", "fix", "fix it", NOW - timedelta(hours=2)), ("command", "go test", "FAIL\n```\nnested\n```", NOW - timedelta(hours=2)), ("file", "a.go", " ", None)]}
    return tuple((base | kw).values())


OTHERS = [digest(agent="agent b", title="", first_prompt="Refactor ledger", end=NOW - timedelta(days=1)), digest(title="Docs", end=None)]


@pytest.fixture(scope="module")
def render(spark):
    def run(*rows, **kw):
        df = spark.createDataFrame([("app", NOW, *r) for r in rows], SCHEMA)
        out = brief.render_full(brief.render_inject(df, **kw))
        return [(r["inject"], r["full"]) for r in out.collect()]

    return run


HEAD = f"## skeinlog — unfinished work in app\n{brief.PREAMBLE}\n"
LAST = 'Last: agent a · 2h ago · branch feat/pay · "Add payments"\n'
END = "→ details: call skeinlog MCP tool get_handoff\n"
INJECT = (
    HEAD + LAST + "Goal: implement checkout\nLatest ask: now fix the test\nEnded with: Still fails.\n"
    "Files touched: pay/f0.go (edit), pay/f1.go (edit+write×2), pay/f2.go (edit×3), pay/f3.go (edit), pay/f4.go (edit×2), pay/f5.go (edit×3), pay/f6.go (edit), pay/f7.go (edit×2), pay/f8.go (edit×3), pay/f9.go (edit)\n"
    "Failed near the end: `t B`, `t C`, `t D`\nNow: 3 uncommitted files, 1 commits since that session\n"
    'Other recent: agent b · 1d ago · "Refactor ledger"\nOther recent: agent a · unknown · "Docs"\n' + END
)


def test_golden(render):
    (inject, full), = render((digest(), OTHERS, None, (3, 1), None))
    assert inject == INJECT
    want = HEAD + LAST + "Goal: implement checkout\nLatest ask: now fix the test\nEnded with: Still fails.\nFailed near the end: `t B`, `t C`, `t D`\nNow: 3 uncommitted files, 1 commits since that session\n"
    want += 'Other recent: agent b · 1d ago · "Refactor ledger"\nOther recent: agent a · unknown · "Docs"\n\n## Files\n'
    want += "".join(f"- pay/f{i}.go (edit{'+write' if i == 1 else ''}{f'×{1 + i % 3}' if i % 3 else ''})\n" for i in range(12))
    want += "\n## Commands\n- ✓ `build`\n- ✗ `t A`\n- ✗ `t B`\n- ✓ `vet`\n- ✗ `t C`\n- ✗ `t D`\n"
    want += "\n## Recent activity\n- user · fix · 2h ago\n```\nfix it\n```\n- command · go test · 2h ago\n````\nFAIL\n```\nnested\n```\n````\n- file · a.go · unknown\n\n" + END
    assert full == want


def test_note_replaces_fields(render):
    (inject, full), = render((digest(), [], ("agent b", NOW - timedelta(minutes=5), "do\n## this"), None, None))
    assert inject == HEAD + LAST + "Handoff note from agent b · 5m ago (full: get_handoff):\n```\ndo\n## this\n```\n" + END
    assert "Note from agent b · 5m ago:\n```\ndo\n## this\n```\n" in full and "Goal: implement checkout" in full


def test_caps(render):
    long = digest(first_prompt="g" * 5000, last_prompt="é" * 5000, last_message="日" * 9000, files=[(f"dir/{'x' * 80}{i}", ["edit"], 1) for i in range(60)], tail=[("user", "h", "b" * 2000, NOW)] * 30)
    rows = render((long, OTHERS, None, (1, 1), None), (long, OTHERS, ("a", NOW, "line of a note\n" * 900), (1, 1), (["p" * 30] * 40, "missing", "")), (digest(), [], ("a", NOW, "日" * 9000), None, None))
    for inject, full in rows:
        assert len(inject.encode()) <= brief.INJECT_BYTES and len(full.encode()) <= brief.FULL_BYTES
        assert full.endswith(END)
    assert rows[0][0].endswith(END) and "Files touched" not in rows[0][0] and "full note: get_handoff" in rows[1][0]
    assert rows[0][1].count("- user · h") < 30 and "## Recent activity" in rows[0][1]


def test_forged_structure(render):
    (inject, full), = render((digest(title="## x\n## forged", first_prompt="a\n## b", files=[("# p\n## q", ["edit"], 1)], commands=[("`rm`\n## z", True)]), [], None, None, None))
    assert not [x for x in inject.split("\n")[1:] if x.startswith("#")]
    assert "Failed near the end: `'rm' ## z`" in inject
    assert [x for x in full.split("\n") if x.startswith("## ")] == ["## skeinlog — unfinished work in app", "## Files", "## Commands", "## Recent activity"]


def test_nothing_and_projects(render):
    rows = render((None, None, None, None, None), (None, None, None, None, (["a", "b", "c"], "stale", "old\n## x")), (None, None, None, None, ([f"project-number-{i}" for i in range(60)], "missing", "")), most=30)
    assert rows[0] == ("", "")
    assert rows[1][0] == "## skeinlog — projects\nYour projects (memory in skeinlog; call get_project before guessing): a, b, c\nThis project's skeinlog card is out of date (old ## x). If anything below changed, call update_project: summary, status, facts.\n"
    assert len(rows[2][0].encode()) <= brief.PROJECTS_BYTES and "more)" in rows[2][0]


def test_handoff_end_to_end(spark):
    sessions = spark.createDataFrame(
        [("/r", "s1", "agent a", 0, "p1", NOW - timedelta(hours=1), NOW - timedelta(hours=3), NOW - timedelta(hours=2), "T1"), ("/r", "s2", "agent b", 1, "p2", NOW - timedelta(hours=2), NOW - timedelta(hours=5), NOW - timedelta(hours=4), "T2")],
        "root string, session_id string, agent string, source_order int, path string, modified timestamp, start timestamp, end timestamp, title string",
    )
    sessions = sessions.withColumn("branch", F.lit(None).cast("string")).withColumn("first_prompt", F.lit("do it with token = abc")).withColumn("last_prompt", F.lit("do it with token = abc")).withColumn("last_message", F.lit(None).cast("string")).withColumn("prompt_count", F.lit(1))
    sessions = sessions.withColumn("files", F.array().cast("array<struct<path:string,ops:array<string>,count:int>>")).withColumn("commands", F.array().cast("array<struct<command:string,failed:boolean>>"))
    repos = spark.createDataFrame([("/r", "r"), ("/empty", "empty")], "root string, name string")
    notes = spark.createDataFrame([("-r", "n1", "agent c", NOW - timedelta(hours=4), "early"), ("-r", "n2", "agent c", NOW - timedelta(hours=9), "older")], "key string, note_id string, agent string, at timestamp, body string")
    git = spark.createDataFrame([("/r", 2)], "root string, uncommitted int")
    commits = spark.createDataFrame([("/r", NOW - timedelta(hours=h)) for h in (1, 3, 6)], "root string, at timestamp")
    args = (repos, notes, git, commits, F.lit(NOW))
    got = {r["root"]: r["inject"] for r in api.handoff(sessions, *args).collect()}
    assert got["/empty"] == ""
    assert got["/r"] == f'## skeinlog — unfinished work in r\n{brief.PREAMBLE}\nLast: agent a · 2h ago · "T1"\nGoal: do it with token = [redacted]\nNow: 2 uncommitted files, 1 commits since that session\nOther recent: agent b · 4h ago · "T2"\n' + END
    forced = {r["root"]: r["inject"] for r in api.handoff(sessions, *args, session_id="s2").collect()}
    assert set(forced) == {"/r"} and 'Last: agent b · 4h ago · "T2"' in forced["/r"] and "Handoff note from agent c · 4h ago" in forced["/r"]
    pinned = {r["root"]: r["full"] for r in api.handoff(sessions, *args, note_id="n2", full=True).collect()}
    assert set(pinned) == {"/r"} and "older" in pinned["/r"] and "3 commits since" in pinned["/r"]
    listed = [(r["rank"], r["id"], r["prompts"], r["start"]) for r in api.list_sessions(sessions, 99).orderBy("rank").collect()]
    assert listed == [(1, "s1", 1, "2026-11-01T09:00:00Z"), (2, "s2", 1, "2026-11-01T07:00:00Z")]
