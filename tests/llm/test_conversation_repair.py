import hashlib
import heapq
import itertools
import random
import re
import zlib

from skeinlog.llm import conversation_repair as m

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, Blank int"


def cheapest(rows, must, cut):
    """Cost, audit and repaired rows of the cheapest edits, ASCII-least first, by a plain search over whole audits."""
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, initials, out = heapq.heappop(todo)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, out
        state = (i, initials if len(initials) < 2 else initials[-1] + ("s" if initials[0] == "s" else ""))
        if state in done or not re.fullmatch("(s?(ua)*u?)?", initials):
            continue
        done.add(state)
        for r in ("user", "assistant"):
            heapq.heappush(todo, (cost + 2, audit + "I", i, initials + r[0], (*out, (r, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(todo, (cost + 3, audit + "D", i + 1, initials, out))
            if not must[i]:
                heapq.heappush(todo, (cost + cut[i], audit + "K", i + 1, initials + (role[:1] or "?"), (*out, (role, text))))
                for r in ("user", "assistant"):
                    heapq.heappush(todo, (cost + cut[i] + 2, audit + "R", i + 1, initials + r[0], (*out, (r, text))))
    raise AssertionError


def plain(rows):
    """What is owed for one conversation's rows (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, must, cut, counts = set(), [], [], [0, 0, 0]
    for _, role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        blank, again, ends = not kept, (role, text) in seen, kept[-1:] in (".", "!", "?") and bool(kept)
        seen.add((role, text))
        must.append(blank or again), cut.append(int(not ends))
        fault = 0 if blank else 1 if again else 2 if not ends else None
        if fault is not None:
            counts[fault] += 1
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit, out = cheapest([r[1:] for r in rows], must, cut)
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()


def conversations(seed, n, most):
    rng = random.Random(seed)
    texts = ["a.", "b", "c?", "", " \n", None, "d! ", "longer text.\n", "a.", "é" * 50]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    return {i: [(rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(1, most))] for i in range(n)}


def frame(spark, convs):
    return spark.createDataFrame([(c, *r, "x", 1) for c, rows in convs.items() for r in rows], SCHEMA).repartition(5)


def test_audits_and_digests_are_those_of_a_plain_search(spark):
    convs = conversations(3, 150, 9) | {None: [(1, "user", "x."), (2, "assistant", "y."), (2, "assistant", "y.")]}
    df = frame(spark, convs)
    found = m.audits(df).cache()
    sums = {r["conv_id"]: r["sha256"] for r in m.digests(df, found).collect()}
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], sums[r["conv_id"]]) for r in found.collect()}
    assert got == {c: plain(rows) for c, rows in convs.items()}


def test_repaired_rows(spark):
    convs = conversations(4, 40, 8)
    df = frame(spark, convs)
    found = m.audits(df)
    rows = m.repair(df, found).collect()
    of = {c: sorted((r for r in rows if r["conv_id"] == c), key=lambda r: r["position"]) for c in convs}
    for c, given in convs.items():
        assert [r["position"] for r in of[c]] == list(range(len(of[c])))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in of[c]))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in of[c]).encode()).hexdigest() == plain(given)[-1]


def test_a_conversation_over_many_tasks_is_one(spark):
    """Products of any cut of the rows are the product of all; long conversations are cut by the ranges."""
    rng = random.Random(1)
    kinds = "".join(rng.choice("suaoSUAOx") for _ in range(700))
    whole = m.solve(m.matrix(kinds))
    for _ in range(5):
        cuts = sorted({0, len(kinds), *(rng.randrange(len(kinds)) for _ in range(6))})
        assert m.solve(m.products([m.matrix(kinds[a:b]) for a, b in zip(cuts, cuts[1:])])) == whole
    rows = [(i // 2, rng.choice(["user", "assistant", "system"]), f"text {rng.randrange(150)}" + rng.choice([".", ""])) for i in range(300)]
    df = frame(spark, {1: rows, 2: rows[:3]})
    assert m.pieces(m.marked(m.plain(df)), 8).filter("conv_id = 1").count() > 2
    found = m.audits(df).cache()
    sums = {r["conv_id"]: r["sha256"] for r in m.digests(df, found).collect()}
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], sums[r["conv_id"]]) for r in found.collect()}
    assert got == {1: plain(rows), 2: plain(rows[:3])}


def test_all_short_kinds():
    texts = {"x": ("user", "", True, 0), "s": ("system", "a.", False, 0), "U": ("user", "b", False, 1), "a": ("assistant", "c.", False, 0), "o": ("tool", "d.", False, 0)}
    for n in range(1, 5):
        for kinds in itertools.product(texts, repeat=n):
            rows = [texts[k] for k in kinds]
            want = cheapest([r[:2] for r in rows], [r[2] for r in rows], [r[3] for r in rows])
            assert m.solve(m.matrix("".join(kinds))) == want[:2]


def test_repeated_rows_are_counted_before_the_pass(spark):
    df = frame(spark, {1: [(0, "user", "hi.")] * 3000 + [(1, "assistant", "yes.")]})
    assert m.marked(m.plain(df)).count() == 2
    r = m.audits(df).collect()[0]
    assert (r["duplicate"], r["illegal"], r["cost"], r["audit"]) == (2999, 2999, 8997, "K" + "D" * 2999 + "K")


def test_query(spark, tmp_path):
    convs = conversations(5, 60, 8) | {200: []}
    dropped = next(i for i in range(300, 900) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    convs[dropped] = [(1, "user", "gone.")]
    frame(spark, convs).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for c, rows in convs.items():
        out = []
        for t, r, x in rows:
            r, x = " " if r is None else r, " " if x is None else x
            fault = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
            x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
            out += [(t, "user" if fault == 4 else r, x)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        if rows:
            want[c] = plain(out)
    got = {r[0]: tuple(r)[1:] for r in m.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == want and got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    found = m.audits(df)
    assert found.collect() == [] and m.repair(df, found).collect() == []
