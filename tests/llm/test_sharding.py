import zlib

from skeinlog.llm import sharding as m


def test_shards(spark, docs):
    rows = m.records(docs, slots=64)
    slots = m.slot_map(rows, 4, slots=64)
    got = m.assign(rows, slots).collect()
    assert len(got) == docs.count()
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    for s in range(4):
        places = sorted(r["slot"] for r in got if r["shard"] == s)
        assert places == list(range(len(places)))
    assert all(slots.shard_of[r["vslot"]] == r["shard"] for r in got)
    assert slots.loads() == [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]


def test_repeated_and_null_ids_spread(spark):
    rows = [(None, f"text {i}") for i in range(500)] + [(7, "the same")] * 1000 + [(8, f"other {i}") for i in range(500)]
    got = m.records(spark.createDataFrame(rows, "doc_id bigint, text string"), slots=256).groupBy("vslot").sum("n").collect()
    assert sum(r[1] for r in got) == 2000 and max(r[1] for r in got) <= 2 * m.CHUNK


def test_query(spark, docs, sf_dir):
    out = m.op6_sharding(spark, sf_dir)
    assert out.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = out.collect()
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    again = {(r["doc_id"], r["text_crc32"], r["shard"]) for r in m.op6_sharding(spark, sf_dir).collect()}
    assert again == {(r["doc_id"], r["text_crc32"], r["shard"]) for r in got}


def test_grown_and_rebalanced_maps_are_even():
    sizes = [1 + (i * 7919) % 1000 for i in range(4096)]
    loads = m.SlotMap.build(sizes, [1] * 4096, 15).grow().rebalance(sizes, [1] * 4096, slack=0.0).loads()
    assert len(loads) == 16 and max(loads) - min(loads) <= max(sizes)


def test_sizes_are_near_equal():
    sizes = [1 + (i * 7919) % 1000 for i in range(4096)]
    loads = m.SlotMap.build(sizes, [1] * 4096, 16).loads()
    assert max(loads) - min(loads) <= max(sizes)


def test_versions(spark, tmp_path):
    sizes = [1 + (i * 7919) % 1000 for i in range(512)]
    first = m.SlotMap.build(sizes, [1] * 512, 8)
    grown = first.grow()
    assert grown.version == 2 and {b for a, b in zip(first.shard_of, grown.shard_of, strict=True) if a != b} == {8}
    assert abs(grown.loads()[8] - sum(sizes) / 9) <= 1000
    heavier = [s * (5 if first.shard_of[i] == 0 else 1) for i, s in enumerate(sizes)]
    even = first.rebalance(heavier, [1] * 512)
    before, after = m.SlotMap(1, 8, first.shard_of, heavier, []).loads(), even.loads()
    assert max(after) < max(before) and max(after) <= 1.02 * sum(heavier) / 8 + max(heavier)
    for x in (first, grown):
        x.save(spark, str(tmp_path / "map"))
    assert m.SlotMap.load(spark, str(tmp_path / "map")) == grown
    assert m.SlotMap.load(spark, str(tmp_path / "map"), 1) == first


def test_empty_table(no_docs):
    rows = m.records(no_docs)
    assert m.assign(rows, m.slot_map(rows, 16)).collect() == []
