import hashlib
import math
import random
from fractions import Fraction

from skeinlog.llm import vector_codes as m

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, Error int"


def plain(rows, entries=m.ENTRIES, rounds=m.ROUNDS):
    """Rows (vec_id, code, error, label_error) and codebooks, one vector at a time."""
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max(1, -(-max((len(v) for _, v, _ in rows if v is not None), default=0) // m.PARTS)) * m.PARTS
    ints = [(i, [math.floor(Fraction(x) * 256) for x in v] + [0] * (dim - len(v)), l) for i, v, l in kept]
    ints.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = dim // m.PARTS
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in ints[:entries]] for p in range(m.PARTS)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(part(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[near(v, p)[1] for p in range(m.PARTS)] for _, v, _ in ints]
        for p in range(m.PARTS):
            for e in range(len(books[p])):
                of = [part(v, p) for (_, v, _), c in zip(ints, codes) if c[p] == e]
                books[p][e] = [sum(x) // len(of) for x in zip(*of)] if of else books[p][e]
        books = [list(b) for b in books]
    out, labels = [], {}
    for i, v, l in ints:
        best = [near(v, p) for p in range(m.PARTS)]
        error = sum(d for d, _ in best)
        labels[l] = labels.get(l, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in best), min(error, m.LONG), l))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, c, e, min(labels[l], m.LONG), digest) for i, c, e, l in out]


def check(spark, tmp_path, rows, parts=3):
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts).write.parquet(f"{tmp_path}/embeddings.parquet")
    single = [(i, None if v is None else [None if x is None else spark_float(x) for x in v], l) for i, v, l in rows]
    got = [tuple(r) for r in m.op12_vector_codes(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(plain(single), key=repr)


def spark_float(x):
    import numpy as np

    return float(np.float32(x))


def some(rng, n, dim=32):
    return [(i, [round(rng.gauss(0, 1), 2) for _ in range(dim)], rng.choice([0, 1, None])) for i in range(n)]


def test_query_equals_plain_python(spark, tmp_path):
    rng = random.Random(1)
    rows = some(rng, 150)
    rows += [(200, None, 1), (201, [None] * 32, 1), (202, [1.0] * 31 + [float("nan")], 1), (203, [float("-inf")] * 32, None)]
    rows += [rows[7]] * 40 + [(7, rows[8][1], 2), (None, rows[3][1], 2)]
    check(spark, tmp_path, rows)


def test_few_vectors_ties_and_negative_means(spark, tmp_path):
    check(spark, tmp_path, [(3, [-0.001] * 16, 1), (1, [0.0] * 16, 1), (2, [0.0] * 16, None), (9, [0.01] * 16, 1)])


def test_lengths_differ(spark, tmp_path):
    check(spark, tmp_path, [(1, [0.5] * 20, 1), (2, [0.25] * 5, 1), (3, [], 1), (4, None, 2)])


def test_numbers_beyond_longs(spark, tmp_path):
    rng = random.Random(2)
    rows = some(rng, 70, 16) + [(100 + i, [3.0e38 * (-1) ** i, 1e25, -1.5] + [2.0**40] * 13, i % 2) for i in range(5)]
    rows[3] = (3, [1e30] * 16, 1)
    check(spark, tmp_path, rows)


def test_tasks_send_sums_only(spark):
    df = spark.createDataFrame([(i, [float(i % 3)] * 16, 1) for i in range(2000)], "id bigint, v array<float>, l int").repartition(2)
    books = m.first_vectors(df, 16, 4)
    assert books.shape == (16, 4, 1)
    assert m.refine(df, books, 16)[0].ravel().tolist() == [0, 256, 512, 0]  # the fourth starts as the first and is never nearest


def test_decode_is_within_the_error(spark):
    rows = some(random.Random(3), 90)
    coded, books = m.compress(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA))
    ints = {i: [math.floor(256 * spark_float(x)) for x in v] for i, v, _ in rows}
    for r in coded.collect():
        assert sum((a - b) ** 2 for a, b in zip(m.decode(r["code"], books), ints[r["vec_id"]])) == r["error"]


def test_empty_tables(spark, tmp_path):
    check(spark, tmp_path / "a", [])
    check(spark, tmp_path / "b", [(1, None, 1)])
