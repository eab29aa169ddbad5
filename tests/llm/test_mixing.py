import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from skeinlog.llm import mixing as m


def shared_by_rounds(sizes, weights, most=3):
    """Shares by weight; whatever is above its cap stops there, again and again."""
    capped = set()
    while True:
        left = sum(sizes) - sum(most * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        out = [most * s if i in capped else left * weights[i] / weight for i, s in enumerate(sizes)]
        above = {i for i, s in enumerate(sizes) if i not in capped and out[i] > most * s}
        if not above:
            return out
        capped |= above


def test_targets():
    rng = random.Random(0)
    for _ in range(500):
        sizes = [rng.randint(0, 1000) for _ in range(rng.randint(1, 9))]
        sizes[0] += 1
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        assert m.share_out(sizes, weights) == pytest.approx(shared_by_rounds(sizes, weights))


def test_mix_equals_brute_force(docs):
    rows = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), hashlib.md5((r["text"] or "").encode()).hexdigest()) for r in docs.collect()]
    total = Counter()
    for _, s, n, _ in rows:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, shared_by_rounds([total[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    want, groups = [], defaultdict(list)
    for i, s, n, text in rows:
        groups[s].append((hashlib.md5(f"{'' if i is None else i}/{text}".encode()).hexdigest(), i is not None, i or 0, n))
    for s, members in groups.items():
        start = 0
        for _, known, i, n in sorted(members):
            copies = sum(c * total[s] + start + n / 2 <= target[s] for c in range(3)) if n else 0
            want.append((i if known else None, n, total[s], copies * n))
            start += n
    got = m.mix(docs, buckets=8)
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    taken = Counter()
    for r in got.collect():
        assert r["taken"] <= 3 * r["size"] and len(r["begins"]) == r["copies"] and r["begins"] == sorted(r["begins"]) and all(0 <= x <= 1 for x in r["begins"])
        assert r["target"] == pytest.approx(target[next(s for i, s, n, _ in rows if i == r["doc_id"] and n == r["size"])]) or r["doc_id"] is None
        taken[r["source_size"]] += r["taken"]
    assert sorted(map(tuple, got.select("doc_id", "size", "taken").collect()), key=repr) == sorted(map(tuple, m.mix(docs.repartition(2), buckets=64).select("doc_id", "size", "taken").collect()), key=repr)


def test_schedule_is_inverted(spark):
    from pyspark.sql import functions as F

    for shape in m.SHAPES:
        pieces = m.demand(shape)
        shares = spark.range(101).select((F.col("id") / 100).alias("share"))
        for r in shares.select("share", m.time_of(F.col("share"), pieces).alias("t")).collect():
            done, t, a, s = next(p for p in reversed(pieces) if p[1] <= r["t"])
            assert done + a * (r["t"] - t) + s * (r["t"] - t) ** 2 / 2 == pytest.approx(r["share"], abs=1e-9)


def test_curriculum(docs):
    plan = Counter()
    for r in m.mix(docs, buckets=8).collect():
        plan[(r["doc_id"], r["size"])] += r["copies"]
    out = m.curriculum(docs, buckets=8)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], len((r["text"] or "").split())) for r in out.collect())
    assert got == +plan


def test_words_in(spark, texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", m.words_in(F.col("t")).alias("n")).collect():
        assert r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["t"] or ""))


def test_empty_table(no_docs):
    assert m.mix(no_docs).collect() == []
    assert m.curriculum(no_docs).collect() == []


def test_sources_without_words(spark):
    df = spark.createDataFrame([(1, " ", "a"), (2, None, "a"), (3, "one two", "b"), (None, "", None)], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: (r["size"], r["target"], r["taken"]) for r in m.mix(df).collect()}
    assert got == {1: (0, 0.0, 0), 2: (0, 0.0, 0), 3: (2, 2.0, 2), None: (0, 0.0, 0)}
    assert [r["doc_id"] for r in m.curriculum(df).collect()] == [3]
    assert {r["taken"] for r in m.mix(df.filter("doc_id <> 3")).collect()} == {0}


def test_many_equal_rows(spark):
    """A third of the rows is one row: each of them has a place of its own, in the plan and in the curriculum."""
    rows = [(None, "same words here", None, i) for i in range(2500)] + [(i, f"words {i} of its own", "s", 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, nth int")
    plan = m.mix(df).collect()
    assert len(plan) == len(rows)
    same = [r for r in plan if r["doc_id"] is None]
    assert sorted(r["nth"] for r in same) == list(range(2500))
    out = m.curriculum(df)
    assert out.columns == df.columns
    got = Counter((r["doc_id"], r["nth"]) for r in out.collect())
    assert sum(got.values()) == sum(r["copies"] for r in plan)
    assert max(got.values()) <= 3 and Counter(n for (i, _), n in got.items() if i is None) == Counter(r["copies"] for r in same if r["copies"])
