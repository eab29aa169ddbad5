import json
import os
import random
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from test_transcripts import GARDEN, KITE, UUID, block, lines, message, says  # noqa: E402

from skeinlog.functions.text import rfc3339  # noqa: E402, F401
from skeinlog.plans import api  # noqa: E402
from skeinlog.sources import files as m, transcripts as tr  # noqa: E402


def names(df):
    return sorted({r["path"].rpartition("/")[2] for r in df.select("path").distinct().collect()})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for at in ("a/-srv-garden", "a/-srv-pond", "b/2031/05/04", "b/2031/05/09"):
        (root / at).mkdir(parents=True)
    (root / "a/-srv-garden/s1.jsonl").write_text(lines(GARDEN) + '{"type":"user","message":{"content":"cut')
    (root / "a/-srv-garden/meta.jsonl").write_text(lines(GARDEN[:2]))
    (root / "a/-srv-garden/empty.jsonl").write_text("")
    (root / "a/-srv-garden/notes.txt").write_text("no transcript\n")
    (root / "a/-srv-pond/p.jsonl").write_text(lines([says("feed the fish", cwd="/srv/pond")]))
    for d in ("04", "09"):
        (root / f"b/2031/05/{d}/rollout-{d}-{UUID}.jsonl").write_text(lines(KITE))
    os.utime(root / "a/-srv-pond/p.jsonl", (1_800_000_000,) * 2)
    return str(root)


def test_ranges_cut_anywhere_give_each_line_once(tmp_path, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 7)
    monkeypatch.setattr(tr, "MAX_LINE", 40)
    rng = random.Random(2)
    for _ in range(60):
        body = b"".join(bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 1, 5, 30, 39, 40, 90]))) + b"\n" for _ in range(rng.randrange(8))) + rng.choice([b"", b"open"])
        f = tmp_path / "x"
        f.write_bytes(body)
        want, at = [], 0
        for line in body.split(b"\n")[:-1]:
            if len(line) < 40:
                want.append((at, line))
            at += len(line) + 1
        cuts = sorted({0, len(body), *(rng.randrange(len(body) + 1) for _ in range(4))})
        with f.open("rb") as h:
            got = [x for a, b in zip(cuts, cuts[1:]) for x in m.lines_between(h, a, b, len(body))]
        assert got == want


def test_data_source_equals_the_text_reader(spark, folder):
    for agent, dialect in (("a", "blocks"), ("b", "rollout")):
        mine = api.digests(m.lines(spark, f"{folder}/{agent}", dialect), dialect, tail=True, complete=True).drop("path", "whole", "modified").collect()
        text = api.digests(tr.discover(spark, f"{folder}/{agent}", dialect), dialect, tail=True).drop("path", "modified").collect()
        assert sorted(mine, key=repr) == sorted(text, key=repr) and mine


def test_splits_of_a_file_are_tasks_of_their_own(spark, folder, monkeypatch):
    monkeypatch.setattr(m, "SPLIT_BYTES", 400)
    df = m.read_whole(m.listing(spark, f"{folder}/a", "blocks"))
    cut = api.digests(df, "blocks", tail=True, complete=True).filter("title = 'Watering plan'").drop("path", "modified", "whole").collect()
    found = api.digests(tr.discover(spark, f"{folder}/a", "blocks"), "blocks", tail=True).filter("title = 'Watering plan'").drop("path", "modified").collect()
    assert cut == found
    size = os.path.getsize(f"{folder}/a/-srv-garden/s1.jsonl")
    assert len(m.split([(m.File("", None, "p", 0, size), 0, size)])) == -(-size // 400)


def scanned(spark, folder, dialect, condition):
    """The rows of a filtered read, and the folders that were listed for it."""
    listed, real = [], m._listed
    reader = m.LineReader(folder, dialect)
    return listed, real, reader


@pytest.mark.parametrize("dialect, condition, want", [
    ("blocks", "folder = '-srv-pond'", ["p.jsonl"]),
    ("blocks", "folder in ('-srv-pond', 'x')", ["p.jsonl"]),
    ("blocks", "folder like '-srv-g%'", ["meta.jsonl", "s1.jsonl"]),
    ("blocks", "modified > timestamp '2028-01-01'", []),
    ("blocks", "modified >= timestamp '2027-01-15 08:00:00' and modified <= timestamp '2027-01-15 08:00:00'", ["p.jsonl"]),
    ("rollout", "day >= date '2031-05-05'", [f"rollout-09-{UUID}.jsonl"]),
    ("rollout", "day = date '2031-05-04' and line like '%session_meta%'", [f"rollout-04-{UUID}.jsonl"]),
])
def test_plain_filters_reach_the_listing(spark, folder, dialect, condition, want):
    df = m.lines(spark, f"{folder}/{'a' if dialect == 'blocks' else 'b'}", dialect).filter(condition)
    assert names(df) == want
    pushed = m.LineReader(folder, dialect)
    assert pushed.bounds.kept == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    left = [x for x in plan.split("\n") if "Filter" in x and "PushedFilters" not in x]
    if "folder = " in condition or "day >= " in condition or "modified > " in condition:
        assert not any("folder" in x.replace("isnotnull(folder", "") and " = -srv" in x for x in left)


def test_what_filters_rule_out_is_neither_listed_nor_opened(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, StringContains

    reader = m.LineReader(f"{folder}/a", "blocks")
    left = list(reader.pushFilters([EqualTo(("folder",), "-srv-pond"), StringContains(("line",), "fish"), GreaterThanOrEqual(("modified",), datetime(2027, 1, 1))]))
    assert left == [StringContains(("line",), "fish")]
    assert [f.path.rpartition("/")[2] for p in reader.partitions() for f, _, _ in p.ranges] == ["p.jsonl"]
    assert [at.rpartition("/")[2] for at in reader.bounds.seen] == ["-srv-pond"]


def test_many_folders_are_listed_by_tasks(spark, folder, monkeypatch):
    for agent, dialect, repos in (("a", "blocks", None), ("a", "blocks", ["/srv/pond"]), ("b", "rollout", None)):
        here = sorted(map(tuple, m.listing(spark, f"{folder}/{agent}", dialect, repos=repos).collect()))
        monkeypatch.setattr(m, "LISTED_HERE", 0)
        there = m.listing(spark, f"{folder}/{agent}", dialect, repos=repos)
        assert "MapInArrow" in there._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, there.collect())) == here and here
        monkeypatch.undo()


def padded(n, more=()):
    """A long transcript: a prompt, n long results, then more."""
    return lines([says("the first ask", cwd="/srv/long")]) + lines([message(block("tool_result", tool_use_id="t", content="y" * 900), role="user")] * n) + lines(more)


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, path):
        self.f, self.read_bytes = open(path, "rb"), 0

    def seek(self, at):
        self.f.seek(at)

    def read(self, n):
        out = self.f.read(n)
        self.read_bytes += len(out)
        return out


def test_ends_read_a_window_only(tmp_path, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 1 << 10)
    path = tmp_path / "x.jsonl"
    path.write_text(padded(2000, [says("the last ask"), message(block("text", text="done"))]))
    f, size = Counted(path), path.stat().st_size
    whole, found = m.end_lines(f, size, tr.blocks_seen, window=16 << 10, most=64 << 10)
    assert not whole and f.read_bytes < 20 << 10 < size // 50
    assert found[0][0] == 0 and b"the last ask" in found[-2][1]
    starts = {a for a, _ in m.lines_between(path.open("rb"), 0, size, size)}
    assert all(a in starts for a, _ in found)


@pytest.mark.parametrize("behind, window", [(5, 16 << 10), (30, 32 << 10), (50, 64 << 10), (1500, 64 << 10)])
def test_windows_double_until_a_prompt_and_a_message_are_seen(tmp_path, behind, window):
    path = tmp_path / "x.jsonl"
    path.write_text(padded(2000, [says("the last ask"), message(block("text", text="done"))] + [message(block("tool_result", tool_use_id="t", content="z" * 900), role="user")] * behind))
    size = path.stat().st_size
    _, found = m.end_lines(path.open("rb"), size, tr.blocks_seen, window=16 << 10, most=64 << 10)
    tail = [a for a, _ in found if a > 0]
    assert size - window <= tail[0] < size - window + 2000
    assert any(b"the last ask" in x for _, x in found) == (behind < 1000)


def test_files_without_an_early_prompt_are_read_as_a_whole(tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text(lines([message(block("text", text="z" * 900))] * 100 + [says("late")]))
    whole, found = m.end_lines(path.open("rb"), path.stat().st_size, tr.blocks_seen, window=4 << 10, most=8 << 10)
    assert whole and len(found) == 101


def test_ends_equal_the_whole_where_the_window_suffices(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/long.jsonl").write_text(padded(3000, GARDEN))
    (tmp_path / "p/short.jsonl").write_text(lines(GARDEN))
    refs = m.listing(spark, str(tmp_path), "blocks")
    ends = {r["path"].rpartition("/")[2]: r for r in api.digests(m.read_ends(refs, "blocks", 16 << 10, 64 << 10), "blocks", True, True).collect()}
    exact = {r["path"].rpartition("/")[2]: r for r in api.digests(m.read_whole(refs), "blocks", True, True).collect()}
    assert ends["short.jsonl"] == exact["short.jsonl"] and ends["short.jsonl"]["whole"]
    a, b = ends["long.jsonl"].asDict(), exact["long.jsonl"].asDict()
    assert not a.pop("whole") and b.pop("whole")
    assert a == b  # what is between the ends has neither prompts nor calls


def test_probe(spark, folder):
    found = {r["path"].rpartition("/")[2]: r["cwd"] for r in m.probe(m.listing(spark, f"{folder}/a", "blocks"), "blocks").collect()}
    assert found == {"s1.jsonl": "/srv/garden", "meta.jsonl": "/srv/garden", "p.jsonl": "/srv/pond", "empty.jsonl": None}


@pytest.fixture
def many(tmp_path):
    """A repository of 1,000 files, of which the newest four have no prompt, and one of two files."""
    for folder, n in (("-srv-many", 1000), ("-srv-few", 2)):
        (tmp_path / folder).mkdir()
        for i in range(n):
            f = tmp_path / folder / f"{folder[5:]}{i:04}.jsonl"
            entries = [says("<command-name>x", cwd=f"/srv/{folder[5:]}")] if folder == "-srv-many" and i >= 996 else [says(f"ask {i}", cwd=f"/srv/{folder[5:]}"), message(block("text", text="ok"))]
            f.write_text(lines(entries))
            os.utime(f, (1_900_000_000 + i, 1_900_000_000 + i))
    return str(tmp_path)


def test_only_the_waves_that_are_needed_are_parsed(spark, many):
    repos = spark.createDataFrame([("/srv/many", "many"), ("/srv/few", "few"), ("/srv/none", "none")], "root string, name string")
    seen = []
    got = api.load_recent(spark, {"a": ("blocks", many)}, repos, limit=3, seen=seen).collect()
    assert sorted((r["root"], r["session_id"]) for r in got) == [("/srv/few", "few0000"), ("/srv/few", "few0001"), *(("/srv/many", f"many{i:04}") for i in (993, 994, 995))]
    assert seen == [5, 6]  # three and two files, then six more of the one that had none yet


def test_recent_equals_all_and_the_newest_is_whole(spark, folder, tmp_path):
    (tmp_path / "-srv-long").mkdir()
    (tmp_path / "-srv-long/l.jsonl").write_text(padded(900, GARDEN))
    repos = spark.createDataFrame([("/srv/garden", "garden"), ("/srv/pond", "pond"), ("/srv/long", "long"), ("/srv/kite", "kite")], "root string, name string")
    roots = {"agent a": ("blocks", f"{folder}/a"), "agent b": ("rollout", f"{folder}/b"), "c": ("blocks", str(tmp_path))}
    mine = api.load_recent(spark, roots, repos, full=True).drop("whole", "path", "modified")  # listings tell microseconds
    every = api.sessions_of(api.load_sessions(spark, roots, tail=True), repos, F.lit("2026-01-01").cast("timestamp"), 10_000).drop("path", "modified")
    assert sorted(map(repr, mine.select(*sorted(every.columns)).collect())) == sorted(map(repr, every.select(*sorted(every.columns)).collect()))
    with pytest.warns(UserWarning, match="agent x"):
        none = api.load_recent(spark, {"agent x": ("blocks", "nosuchscheme://host/there")}, repos)
    assert none.collect() == []


def test_a_third_dialect_is_added_from_outside(spark, tmp_path):
    def steps(lines):
        e = lines.withColumn("v", F.try_parse_json("line"))
        kind, text = F.try_variant_get("v", "$.who", "string"), F.try_variant_get("v", "$.said", "string")
        null = F.lit(None)
        keep = [c for c in lines.columns if c in ("path", "modified", "size", "whole", "bytes", "line_no")]
        return e.select(*keep, F.lit(0).alias("block_no"), null.cast("timestamp").alias("ts"), kind.alias("kind"), text.alias("text"), null.cast("string").alias("op"), null.cast("string").alias("call_id"), null.cast("boolean").alias("is_error"))

    tr.register(tr.Dialect("plain", "folders", steps, lambda e: {"user": "prompt", "assistant": "message"}.get(e.get("who")), lambda e: e.get("at"), prefix="chat-"))
    try:
        (tmp_path / "x").mkdir()
        (tmp_path / "x/chat-1.jsonl").write_text(lines([{"who": "user", "said": "hello", "at": "/srv/x"}, {"who": "assistant", "said": "hi"}]))
        (tmp_path / "x/other.jsonl").write_text(lines([{"who": "user", "said": "no"}]))
        repos = spark.createDataFrame([("/srv/x", "x")], "root string, name string")
        r = api.load_recent(spark, {"p": ("plain", str(tmp_path))}, repos).first()
        assert (r["session_id"], r["first_prompt"], r["last_message"], r["agent"]) == ("chat-1", "hello", "hi", "p")
        assert m.lines(spark, str(tmp_path), "plain").count() == 2
    finally:
        del tr.DIALECTS["plain"]
