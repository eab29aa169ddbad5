import json
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from test_transcripts import GARDEN, KITE, UUID, block, lines, message, says  # noqa: E402

from skeinlog.operators import digest  # noqa: E402
from skeinlog.plans import api  # noqa: E402
from skeinlog.sources import files, transcripts as tr  # noqa: E402
from skeinlog.streaming import digests as m  # noqa: E402

KINDS = [("user", None), ("assistant", None), ("final", None), ("title", None), ("branch", None), ("cwd", None), ("entry", None), ("line", None)]


def some_steps(rng, n, splits):
    """Steps of one path over some splits, with calls and results that meet across their borders."""
    rows = []
    for i in range(n):
        kind = rng.choice(["user", "assistant", "final", "title", "branch", "cwd", "entry", "line", "file", "command", "result", "command", "result", "result"])
        at = (rng.randrange(splits) << digest.SPLIT_BITS) + i
        ts = f"2031-01-01 00:00:{i % 60:02}" if rng.random() < 0.8 else None
        rows.append(("p", at, i % 3, ts, kind, f"{kind} {i}\nmore", rng.choice(["edit", "write"]) if kind == "file" else None, rng.choice("abcde") if kind in ("command", "result") and rng.random() < 0.9 else None, rng.random() < 0.6 if kind == "result" else None))
        if kind == "file":
            rows[-1] = (*rows[-1][:5], f"f{rng.randrange(6)}", *rows[-1][6:])
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, tr.STEPS.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))


def test_digests_do_not_depend_on_the_splits(spark):
    """The same steps in one split and over many, told apart by path."""
    rng = random.Random(4)
    rows = []
    for k in range(12):
        many = sorted(some_steps(rng, 120, rng.choice([2, 5, 40])), key=lambda r: r[1:3])
        rows += [(f"many {k}", *r[1:]) for r in many] + [(f"one {k}", i, *r[2:]) for i, r in enumerate(many)]
    got = {r["path"]: r for r in digest.sessions(frame(spark, rows), tail=True).collect()}
    assert len(got) == 24 and any(c["failed"] for r in got.values() for c in r["commands"]) and any(t["kind"] == "failure" for r in got.values() for t in r["tail"])
    for k in range(12):
        assert got[f"many {k}"][1:] == got[f"one {k}"][1:], k


def test_joining_is_associative(spark):
    rng = random.Random(5)
    parts = digest.partials(frame(spark, sorted(some_steps(rng, 200, 6), key=lambda r: r[1:3])), tail=True)
    row = parts.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "p"))), lambda x: x["p"]).alias("x")).cache()
    assert row.select(F.size("x")).first()[0] == 6
    whole = digest.finished(row.select("path", digest.joined(F.col("x")).alias("p")), tail=True).first()
    for cut in (1, 3, 5):
        two = F.array(digest.joined(F.slice("x", 1, cut)), digest.joined(F.slice("x", cut + 1, 6 - cut)))
        assert digest.finished(row.select("path", digest.joined(two).alias("p")), tail=True).first() == whole


def test_no_window_over_a_path(spark):
    rows = frame(spark, some_steps(random.Random(1), 5, 2))
    plan = digest.sessions(rows, tail=True)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(path#" in plan and plan.count("Window [") == 2 or plan.count("Window ") >= 2
    assert all("split#" in x.split("], [")[-2] + x for x in plan.split("\n") if "Window [" in x)


@pytest.fixture
def growing(tmp_path):
    """A folder of two files, and what is appended to them step by step, at any byte."""
    root = tmp_path / "in"
    (root / "-srv-garden").mkdir(parents=True)
    more = [message(block("tool_use", id="late", name="Bash", input={"command": "sow"}))] + [says(f"ask {i}") for i in range(40)] + [message(block("tool_result", tool_use_id="late", is_error=True, content="dry"), role="user")]
    body = {"s1": lines(GARDEN + more).encode(), "s2": lines([says("one", cwd="/srv/garden"), message(block("text", text="two"))]).encode()}
    cuts = {"s1": [700, 701, 2600, len(body["s1"])], "s2": [0, len(body["s2"]) - 1, len(body["s2"]), len(body["s2"])]}

    def grow(step):
        for name, data in body.items():
            with open(root / f"-srv-garden/{name}.jsonl", "ab") as f:
                f.write(data[cuts[name][step - 1] if step else 0 : cuts[name][step]])

    return str(root), grow


def exact(spark, root):
    return {r["path"].rpartition("/")[2]: r.asDict() for r in api.digests(files.lines(spark, root, "blocks"), "blocks", True, True).drop("modified", "whole").collect()}


def test_appended_bytes_are_read_once_and_digests_equal_the_batch(spark, growing, tmp_path):
    root, grow = growing
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    for step in range(4):
        grow(step)
        query = m.append(spark, root, "blocks", out, log)
        query.awaitTermination(180)
        assert query.exception() is None
        got = {r["path"].rpartition("/")[2]: r.asDict() for r in m.read(spark, out).drop("modified").collect()}
        assert got == exact(spark, root)
        if step == 2:
            assert m.compact(spark, out) > 1
            assert {r["path"].rpartition("/")[2]: r.asDict() for r in m.read(spark, out).drop("modified").collect()} == got
    lines_read = m.stored(spark, out).select(F.sum("p.bytes")).first()[0]
    assert lines_read == sum(os.path.getsize(f"{root}/-srv-garden/{n}.jsonl") for n in ("s1", "s2"))  # nothing twice
    with open(f"{root}/-srv-garden/s2.jsonl", "w") as f:
        f.write(lines([says("anew")]))
    m.append(spark, root, "blocks", out, log).awaitTermination(180)
    got = {r["path"].rpartition("/")[2]: r.asDict() for r in m.read(spark, out).drop("modified").collect()}
    assert got == exact(spark, root) and got["s2.jsonl"]["first_prompt"] == "anew"


def test_offsets_read_new_bytes_only(growing):
    root, grow = growing
    reader, start, seen = m.files.LineStream(root, "blocks", None), {"files": {}}, []
    for step in range(4):
        grow(step)
        end = reader.latestOffset()
        parts = reader.partitions(start, end)
        seen += [(f.path.rpartition("/")[2], a, b) for p in parts for f, a, b in p.ranges]
        assert [p.ranges for p in reader.partitions(end, end)] == [[]]
        start = json.loads(json.dumps(end))
    assert [x for x in seen if x[0] == "s1.jsonl"] == [("s1.jsonl", a, b) for a, b in zip([0, 700, 701, 2600], [700, 701, 2600, os.path.getsize(f"{root}/-srv-garden/s1.jsonl")])]


def test_state_equals_the_batch(spark, growing, tmp_path):
    root, grow = growing
    got = {}

    def batch(rows, number):
        got.update((r["path"].rpartition("/")[2], r.asDict()) for r in rows.collect())

    for step in (0, 2, 3):
        for k in range({0: 0, 2: 1, 3: 3}[step], step + 1):
            grow(k)
        query = m.live(spark, root, "blocks").writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        assert got == exact(spark, root)
