import random
import time
from itertools import combinations

import numpy as np
import pytest

from skeinlog.llm import graph, ngram_join as m, shingles, trie_join

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_components(sets, p, q):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def shingle_set(text, width):
    w = (text or "").translate(LOWER)
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize(("width", "p", "q", "block"), [(3, 9, 10, m.BLOCK), (5, 4, 5, m.BLOCK), (3, 9, 10, 300), (5, 4, 5, 1000), (3, 3, 10, 700), (3, 3, 10, 300)])
def test_equals_brute_force(docs, width, p, q, block):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [shingle_set(t, width) for _, t in rows]
    roots = brute_components(sets, p, q)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, len(s), least.get(r) if s else i) for (i, _), s, r in zip(rows, sets, roots, strict=True)), key=repr)
    got = m.similar_groups(docs, width=width, p=p, q=q, block=block).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_keep_one(docs):
    groups = m.similar_groups(docs).collect()
    kept = m.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    linked = {(r["component_id"], r["keeper_key"]) for r in groups if r["n_shingles"] and r["component_id"] is not None}
    ids = [r["doc_id"] for r in rows if (r["text"] or "").split()]
    assert sorted(ids) == sorted(i for i, _ in linked)  # one of each group, once
    assert sum(not (r["text"] or "").split() for r in rows) == sum(not (r["text"] or "").split() for r in docs.collect())


def test_signatures_meet():
    """Linked sets have a signature in common, whichever shingles are frequent."""
    rng = random.Random(3)
    with np.errstate(over="ignore"):
        for p, q in ((9, 10), (4, 5)):
            signer = m.Signer(p, q, np.array([rng.random() < 0.3 for _ in range(1 << 10)]))
            for _ in range(300):
                n = rng.randint(1, 400)
                a = {rng.getrandbits(64) for _ in range(n)}
                b = set(a)
                while q * len(a & b) >= p * len(a | b):
                    last = set(b)
                    if rng.random() < 0.5 and len(b) > 1:
                        b.remove(min(b, key=lambda x: hash((x, n))))
                    else:
                        b.add(rng.getrandbits(64))
                x, y = (signer(np.array(sorted(s), np.uint64)) for s in (a, last))
                assert len(np.intersect1d(x, y))


def test_trie_lookup():
    rng = random.Random(1)
    for _ in range(60):
        base = [rng.sample(range(200), rng.randint(1, 40)) for _ in range(3)]
        sets = {frozenset(set(rng.choice(base)) ^ {rng.randrange(220) for _ in range(rng.randint(0, 4))}) for _ in range(20)} - {frozenset()}
        sets = sorted(map(set, sets), key=sorted)
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        for p, q in ((9, 10), (4, 5), (1, 2)):
            levels = np.array([rng.randrange(3) for _ in range(64)])
            want = brute_components(sets, p, q)
            assert trie_join.components(arrays, p, q).tolist() == want
            assert trie_join.components(arrays, p, q, levels).tolist() == want
            trie = trie_join.Trie(arrays, p, q, levels)
            got = list(zip(*(x.tolist() for x in trie.links(np.arange(len(sets)))), strict=True))
            assert len(got) == len(set(got))
            assert set(got) == {(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets) if i != j and q * len(s & t) >= p * len(s | t)}
            # some sets already joined, and only some look up: links of theirs, and nothing else, are added
            for share in (0.2, 0.5, 0.9):
                kinds = rng.randint(1, 6)
                known = np.array([next(j for j in range(i + 1) if j % kinds == i % kinds) for i in range(len(sets))])
                asks = np.array([rng.random() < share for _ in sets])
                root = known.tolist()
                for i, j in sorted(got):
                    if asks[i] and root[i] != root[j]:
                        low, high = sorted((root[i], root[j]))
                        root = [low if r == high else r for r in root]
                assert trie_join.components(arrays, p, q, levels, known, asks).tolist() == root


def test_many_sets_without_links_take_seconds():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 63, 20, dtype=np.uint64)) for _ in range(16_000)]
    began = time.perf_counter()
    assert trie_join.components(sets, 9, 10).tolist() == list(range(16_000))
    assert time.perf_counter() - began < 30


def test_a_large_group_of_near_copies():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate((np.delete(base, rng.integers(0, 200, 4)), rng.integers(0, 1 << 63, 4, dtype=np.uint64)))) for _ in range(2_000)]
    assert set(trie_join.components(sets, 9, 10).tolist()) == {0}


def test_short_texts_are_one_shingle():
    words = shingles.WordHashes()
    a, b, c, d = shingles.shingle_sets([b"a b", b"A  B\n", b"b a", None], 3, words)
    assert a.tolist() == b.tolist() != c.tolist()
    assert len(a) == 1 and len(d) == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(4000, 4100)] + [(7, 7), (None, 1)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in root}


def test_empty_table(no_docs):
    assert m.similar_groups(no_docs).collect() == []
    assert m.keep_one(no_docs).collect() == []


def test_a_chain_across_blocks(spark):
    """Only neighbours are linked, most sets are not linked with the hub, and each tree holds few of them."""
    words = [f"w{i}" for i in range(260)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 50])) for i in range(40)] + [(100 + i, " ".join(f"x{j}" for j in range(5 * i, 5 * i + 50))) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in m.similar_groups(docs, width=3, p=4, q=5, block=900).collect()}
    assert got == {i: 0 if i < 100 else 100 for i, _ in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_families_across_blocks(spark, seed):
    """Families of near copies that drift apart, some with bridges: most groups of a component lie in several blocks,
    and the hub's is not always the largest."""
    rng = random.Random(seed)
    base, rows = [f"w{rng.randrange(500)}" for _ in range(90)], []
    for family in range(6):
        for _ in range(rng.randrange(2, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"y{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(w)))
        for _ in range(rng.choice((1, 2, 5))):  # the next family is linked, nearly linked or far
            base[rng.randrange(len(base))] = f"z{rng.randrange(10_000)}"
    rng.shuffle(rows)
    sets = [shingle_set(t, 3) for _, t in rows]
    roots = brute_components(sets, 4, 5)
    least = {r: min(i for (i, _), s in zip(rows, roots) if s == r) for r in roots}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in m.similar_groups(docs, width=3, p=4, q=5, block=900).collect()}
    assert got == {i: least[r] for (i, _), r in zip(rows, roots)}


def test_repeated_rows_are_one_in_a_tree(spark, monkeypatch):
    """20,000 rows of one doc_id and text, and a near copy: two texts are dealt, and the groups are right."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(500)}" for _ in range(120)]
    other = [*words[:-1], "x"]
    rows = [(5, " ".join(words))] * 20_000 + [(9, " ".join(other)), (9, " ".join(other)), (11, "alone in the world of words")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    dealt, real = [], m.deal

    def deal(rows, near):
        out = real(rows, near)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(m, "deal", deal)
    got = {(r["doc_id"], r["component_id"]) for r in m.similar_groups(df).collect()}
    assert got == {(5, 5), (9, 5), (11, 11)} and dealt[0] == 2
    assert sorted(r["doc_id"] for r in m.keep_one(df).collect()) == [5, 11]


def test_a_signature_is_ten_bytes_and_comes_back():
    rng = np.random.default_rng(4)
    signs, nodes = np.sort(rng.integers(0, 1 << 64, 50_000, dtype=np.uint64)), rng.integers(0, 1 << m.NODE_BITS, 50_000)
    bucket, data = m.packed(signs, nodes)
    assert data.nbytes <= 11 * len(signs) and len(set(bucket.tolist())) == len(bucket) <= m.BUCKETS
    keys, back = m.unpacked(data.to_pylist())
    assert back.tolist() == nodes.tolist() and keys.tolist() == (signs & np.uint64((1 << 40) - 1)).tolist()
    assert np.repeat(bucket, [len(x) // 10 for x in data.to_pylist()]).tolist() == (signs >> m.BUCKET_SHIFT).tolist()


def test_signs_of_several_tasks_are_tied(spark):
    """One row for each set, edges of sets that sign the same, and no signature is kept."""
    text = " ".join(f"w{i}" for i in range(300))
    rows = spark.createDataFrame([(i, i, text + f" x{i}") for i in range(8)] + [(8, 8, " ".join(f"y{i}" for i in range(300)))], "doc_id bigint, row_key bigint, text string").repartition(4)
    out = m.tied(m.sign_texts(rows, 5, 4, 5, np.zeros(1 << 10, bool))).collect()
    nodes = {r["row"]["doc_id"]: r["row"]["node"] for r in out if r["kind"] == m.ROW}
    assert sorted(nodes) == list(range(9)) and {r["kind"] for r in out} == {m.ROW, m.EDGE}
    assert {x for r in out if r["kind"] == m.EDGE for x in (r["a"], r["b"])} == {nodes[i] for i in range(8)}
