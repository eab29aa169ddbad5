import json
import os
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skeinlog.operators import digest
from skeinlog.plans import api
from skeinlog.sources import transcripts as tr
from skeinlog.streaming import sessions as stream

DAY = "2031-05-04T"


def says(text, **more):
    return {"type": "user", "message": {"content": text}, **more}


def block(kind, **fields):
    return {"type": kind, **fields}


def message(*blocks, role="assistant", **more):
    return {"type": role, "message": {"content": list(blocks)}, **more}


GARDEN = [
    says("harness notes", isMeta=True, cwd="/srv/garden", timestamp=DAY + "08:00:00Z"),
    says("<command-name>clear</command-name>"),
    says(" \t Water the tomatoes twice\n", gitBranch="spring", timestamp=DAY + "08:00:02Z"),
    {"type": "from-the-future", "anything": [1]},
    {"type": "ai-title", "aiTitle": "Sketch"},
    message(block("thinking", thinking="which bed?"), block("text", text="Reading the plan.")),
    message(block("tool_use", id="k1", name="Edit", input={"file_path": "/srv/garden/beds.toml"}), gitBranch="summer"),
    message(block("tool_use", id="k2", name="Write", input={"file_path": "/srv/garden/hose.py"}), block("tool_use", id="k3", name="MultiEdit", input={"file_path": "/srv/garden/beds.toml"})),
    message(block("tool_use", id="k4", name="NotebookEdit", input={"notebook_path": "/srv/garden/rain.ipynb"})),
    {"type": "ai-title", "aiTitle": "Watering plan"},
    message(block("tool_use", id="sh1", name="Bash", input={"command": "make drip"}), block("tool_use", id="sh2", name="Bash", input={"command": "date -u"})),
    message(block("tool_result", tool_use_id="sh1", is_error=True, content=[block("text", text="valve"), block("text", text="stuck")]), block("tool_result", tool_use_id="sh2", content="noon"), role="user", timestamp=DAY + "08:01:30Z"),
    message(block("tool_result", tool_use_id="sh1", is_error=True, content="once more"), role="user"),
    says("never shown", isSidechain=True, timestamp="2040-01-01T00:00:00Z"),
    message(block("text", text="Then"), block("text", text="mulch bed four"), role="user"),
    message(block("text", text="Valve still stuck"), block("text", text="  "), timestamp=DAY + "08:02:00Z"),
]
KITE = [
    {"type": "session_meta", "timestamp": DAY + "09:00:00Z", "payload": {"cwd": "/srv/kite", "git": {"branch": "wind"}}},
    {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [block("input_text", text="<environment_context>tz")]}},
    {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [block("input_text", text="shorten the tail")]}},
    {"type": "event_msg", "payload": {"type": "user_message", "message": "shorten the tail"}},
    {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "call_id": "z1", "arguments": json.dumps({"command": ["zsh", "-c", "tie --knots 3"]})}},
    {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "z1", "output": json.dumps({"output": "string too short", "metadata": {"exit_code": 4}})}},
    {"type": "response_item", "payload": {"type": "function_call", "name": "exec_command", "call_id": "z2", "arguments": json.dumps({"cmd": "ls spools"})}},
    {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "z2", "output": "red\nExit code: 0"}},
    {"type": "response_item", "payload": {"type": "custom_tool_call", "name": "apply_patch", "input": "*** Begin Patch\n*** Update File: tail.txt\n@@\n*** Add File: spool.txt\n*** Delete File: old.txt\n"}},
    {"type": "response_item", "payload": {"type": "function_call", "name": "apply_patch", "arguments": json.dumps({"input": "*** Update File: tail.txt"})}},
    {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [block("output_text", text="halfway")]}},
    {"type": "event_msg", "timestamp": DAY + "09:00:40Z", "payload": {"type": "task_complete", "last_agent_message": "Knots do not hold"}},
]
UUID = "5d1c0f3e-aaaa-4bbb-8ccc-0123456789ab"


def lines(entries):
    return "".join(json.dumps(e) + "\n" for e in entries)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("transcripts")
    for at in ("a/-srv-garden/sub", "a/-srv-garden-shed", "a/-srv-gardens", "b/2031/05/04", "b/2031/05/x", "b/2019/01/02"):
        (root / at).mkdir(parents=True)
    (root / "a/-srv-garden/s1.jsonl").write_text(lines(GARDEN) + '{"type":"user","message":{"content":"cut')
    (root / "a/-srv-garden/whole.jsonl").write_text(lines(GARDEN[:3]) + json.dumps(says("complete, but without a line break")))
    (root / "a/-srv-garden/meta.jsonl").write_text(lines(GARDEN[:2]))
    (root / "a/-srv-garden/bad.jsonl").write_text("no json\n[1]\n\n" + lines([says("fine")]) + json.dumps(says("x" * (17 << 20))) + "\n")
    (root / "a/-srv-garden/sub/deep.jsonl").write_text(lines(GARDEN))
    (root / "a/-srv-garden-shed/s2.jsonl").write_text(lines([says("shed", cwd="/srv/garden/shed")]))
    (root / "a/-srv-gardens/s3.jsonl").write_text(lines([says("elsewhere", cwd="/srv/gardens")]))
    for day in ("2031/05/04", "2031/05/x", "2019/01/02"):
        (root / f"b/{day}/rollout-{day[:4]}-{UUID}.jsonl").write_text(lines(KITE))
    (root / "b/2031/05/04/notes.jsonl").write_text(lines(KITE))
    return str(root)


@pytest.fixture(scope="module")
def loaded(spark, folder):
    return api.load_sessions(spark, {"agent a": ("blocks", f"{folder}/a"), "agent b": ("rollout", f"{folder}/b")}, tail=True)


@pytest.fixture(scope="module")
def found(loaded):
    return {r["path"].rpartition("/")[2]: r for r in loaded.collect()}


def test_blocks(found):
    assert {k for k in found if not k.startswith("rollout")} == {"s1.jsonl", "whole.jsonl", "bad.jsonl", "s2.jsonl", "s3.jsonl"}
    s = found["s1.jsonl"]
    assert (s["title"], s["branch"], s["cwd"], s["prompt_count"], s["session_id"]) == ("Watering plan", "summer", "/srv/garden", 2, "s1")
    assert (s["first_prompt"], s["last_prompt"], s["last_message"]) == ("Water the tomatoes twice", "Then\nmulch bed four", "Valve still stuck")
    assert (s["start"], s["end"]) == (datetime(2031, 5, 4, 8), datetime(2031, 5, 4, 8, 2))
    assert [tuple(f) for f in s["files"]] == [("/srv/garden/beds.toml", ["edit"], 2), ("/srv/garden/hose.py", ["write"], 1), ("/srv/garden/rain.ipynb", ["edit"], 1)]
    assert [tuple(c) for c in s["commands"]] == [("make drip", True), ("date -u", False)]
    assert [t["kind"] for t in s["tail"]] == ["user", "assistant", "file", "file", "file", "file", "command", "command", "failure", "user", "assistant"]
    failure = s["tail"][8]
    assert (failure["head"], failure["body"]) == ("make drip", "valve\nstuck")


def test_last_line_without_a_break(found):
    assert found["whole.jsonl"]["prompt_count"] == 1 and found["whole.jsonl"]["last_prompt"] == "Water the tomatoes twice"


def test_tolerance(found):
    assert (found["bad.jsonl"]["prompt_count"], found["bad.jsonl"]["first_prompt"]) == (1, "fine")


def test_rollout(found):
    assert [k for k in found if k.startswith("rollout")] and all(r["session_id"] == UUID for k, r in found.items() if k.startswith("rollout"))
    s = found[f"rollout-2031-{UUID}.jsonl"]
    assert (s["branch"], s["cwd"], s["prompt_count"], s["first_prompt"], s["last_message"]) == ("wind", "/srv/kite", 1, "shorten the tail", "Knots do not hold")
    assert [tuple(f) for f in s["files"]] == [("tail.txt", ["edit"], 2), ("spool.txt", ["write"], 1), ("old.txt", ["delete"], 1)]
    assert [tuple(c) for c in s["commands"]] == [("tie --knots 3", True), ("ls spools", False)]
    assert {t["kind"] for t in s["tail"]} == {"user", "assistant", "command", "file", "failure"}
    assert next(t["body"] for t in s["tail"] if t["kind"] == "failure") == "string too short"


def test_one_scan_and_one_parse(spark, folder):
    plan = api.load_sessions(spark, {"a": ("blocks", f"{folder}/a")}, tail=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and plan.count("Exchange") <= 2
    optimized = api.load_sessions(spark, {"a": ("blocks", f"{folder}/a")})._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("parse_json") <= 2  # the expression, and its name


def test_what_is_listed(spark, folder):
    slugs = lambda **kw: sorted(p.rpartition("/")[2] for p in tr.places(spark, f"{folder}/a", "blocks", **kw))
    assert slugs() == ["-srv-garden", "-srv-garden-shed", "-srv-gardens"]
    assert slugs(repos=["/srv/garden/"]) == ["-srv-garden", "-srv-garden-shed"]
    days = lambda **kw: [p[-10:] for p in tr.places(spark, f"{folder}/b", "rollout", **kw)]
    assert days() == ["2019/01/02", "2031/05/04"]
    assert days(since=datetime(2031, 5, 5)) == ["2031/05/04"] and days(since=datetime(2031, 5, 7)) == []
    assert tr.places(spark, f"{folder}/none", "blocks") == []


def test_age_and_newest(spark, folder, tmp_path):
    (tmp_path / "p").mkdir()
    for i in range(4):
        f = tmp_path / "p" / f"{i}.jsonl"
        f.write_text(lines([says(f"prompt {i}")]))
        os.utime(f, (1_900_000_000 + i, 1_900_000_000 + i))
    ids = lambda **kw: sorted(r["session_id"] for r in api.load_sessions(spark, {"a": ("blocks", str(tmp_path))}, **kw).collect())
    assert ids(since=datetime(1970, 1, 1) + timedelta(seconds=1_900_000_002)) == ["2", "3"]
    assert ids(newest=3) == ["1", "2", "3"]
    assert ids(since=datetime(2100, 1, 1)) == []


def test_failing_source_is_left_out(spark, folder):
    with pytest.warns(UserWarning, match="agent x"):
        got = api.load_sessions(spark, {"agent x": ("blocks", "nosuchscheme://host/there"), "agent a": ("blocks", f"{folder}/a")})
    assert got.filter("session_id = 's1'").count() == 1
    assert api.load_sessions(spark, {}).collect() == [] and api.load_sessions(spark, {"a": ("blocks", f"{folder}/none")}).collect() == []


COMMANDS = [
    ({"command": ["bash", "-lc", "a b"]}, "a b"), ({"command": ["sh", "-c", "x"]}, "x"), ({"command": ["ls", "-l"]}, "ls -l"), ({"command": ["bash", "-x", "y"]}, "bash -x y"),
    ({"command": "plain"}, "plain"), ({"cmd": "c"}, "c"), ({"command": "", "cmd": "c"}, "c"), ({}, ""),
]


def test_command_text(spark):
    df = spark.createDataFrame([(json.dumps(a), w) for a, w in COMMANDS] + [("not json", "")], "a string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", tr.command_text(F.col("a")).alias("got")).collect())


def test_output_failed(spark):
    outputs = [('{"metadata":{"exit_code":0}}', False), ('{"metadata":{"exit_code":2}}', True), ("x\nExit code: 3\n", True), ("Exit code: 0", False), ("see Exit code: 1", False), ('{"output":"Exit code: 1"}', False)]
    df = spark.createDataFrame(outputs, "o string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", tr.output_failed(F.col("o")).alias("got")).collect())


def test_first_cwd_and_tail_length(spark):
    rows = [("p", i, 0, None, "cwd", f"/d{i}", None, None, None) for i in (70, 63, 80)] + [("q", 64, 0, None, "cwd", "/late", None, None, None)]
    rows += [("p", i, 0, None, "user", f"u{i}", None, None, None) for i in range(40)]
    rows += [(p, i, 0, None, "line", None, None, None, None) for p in "pq" for i in range(90)]
    steps = spark.createDataFrame(rows, tr.STEPS)
    assert [tuple(r) for r in tr.first_cwd(steps).collect()] == [("p", "/d63")]
    tail = digest.sessions(steps, tail=True).first()["tail"]
    assert [t["head"] for t in tail] == [f"u{i}" for i in range(10, 40)]


def test_id_is_used_again(spark):
    """The last call of an id gets the result, and a second result of it none."""
    kinds = [("command", None), ("command", None), ("result", True), ("result", True), ("command", None), ("result", False)]
    steps = spark.createDataFrame([("p", i, 0, None, k, f"t{i}", None, "x", e) for i, (k, e) in enumerate(kinds)], tr.STEPS)
    got = {r["text"]: bool(r["failed"]) for r in digest.pair_results(steps).filter("kind = 'command'").collect()}
    assert got == {"t0": False, "t1": True, "t4": False}
    assert digest.pair_results(steps).filter("kind = 'failure'").count() == 1


def test_stream_equals_batch(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    stream.run(spark, f"{folder}/a/-srv-garden", "blocks", out, str(tmp_path / "log")).awaitTermination(120)

    def check(paths):
        got = {r["path"].rpartition("/")[2]: r for r in stream.read(spark, out).collect()}
        want = digest.sessions(tr.finished(tr.blocks_steps(tr.raw_lines(spark, paths)))).collect()
        assert {r["path"].rpartition("/")[2] for r in want} == got.keys()
        for r in want:
            mine = got[r["path"].rpartition("/")[2]]
            assert all(mine[k] == r[k] for k in ("prompt_count", "first_prompt", "last_prompt", "last_message"))

    paths = [f"{folder}/a/-srv-garden/*.jsonl", f"{folder}/a/-srv-garden/sub/*.jsonl"]
    check(paths)
    assert stream.refresh(spark, f"{folder}/a/-srv-garden", "blocks", out) == 0


def test_grown_files_are_read_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    f, out = tmp_path / "in/s.jsonl", str(tmp_path / "out")
    f.write_text(lines([says("first")]) + json.dumps(says("sec")))
    os.utime(f, (1_800_000_000,) * 2)
    stream.run(spark, str(tmp_path / "in"), "blocks", out, str(tmp_path / "log")).awaitTermination(120)
    assert [r["prompt_count"] for r in stream.read(spark, out).collect()] == [1]
    f.write_text(lines([says("first"), says("second"), says("third")]))
    os.utime(f, (1_800_000_100,) * 2)
    assert stream.refresh(spark, str(tmp_path / "in"), "blocks", out) == 1
    for _ in range(2):
        assert [(r["prompt_count"], r["last_prompt"]) for r in stream.read(spark, out).collect()] == [(3, "third")]
        stream.compact(spark, out)
    assert len([p for p in os.listdir(out) if p.startswith("batch=")]) == 1


LARGE = """
import sys
from pyspark.sql import SparkSession
from skeinlog.plans import api
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "4").getOrCreate()
s = api.load_sessions(spark, {"a": ("blocks", sys.argv[1])}, tail=True).first()
print(s["prompt_count"], len(s["tail"]), s["last_prompt"])
"""


def test_a_file_of_a_gigabyte_with_a_default_heap(tmp_path):
    (tmp_path / "p").mkdir()
    with open(tmp_path / "p/s.jsonl", "w") as f:
        one = json.dumps(message(block("tool_result", tool_use_id="t", content="y" * 1_000_000), role="user")) + "\n"
        for i in range(1000):
            f.write(one)
            if i % 100 == 0:
                f.write(lines([says(f"prompt {i}")]))
    done = subprocess.run([sys.executable, "-c", LARGE, str(tmp_path)], capture_output=True, text=True, timeout=300)
    os.remove(tmp_path / "p/s.jsonl")
    assert done.stdout.split("\n")[0] == "10 10 prompt 900", done.stderr[-2000:]
