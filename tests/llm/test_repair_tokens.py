import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skeinlog.llm import repair_tokens as m


@pytest.fixture(scope="module")
def tokenizer():
    return m.load(m.tokenizer_path())


def test_chunks_equal_the_library(tokenizer):
    rng = random.Random(1)
    texts = ["", "a", " a", "a ", "a  b", "a   b", "  a", "a \n b", "a\n b", "a\n  b", " ", "   ", "a<|endoftext|>b  c", "don't  stop 's it", "\n\n", "日本 語", "q\u0085 z", "a   b", "x\x1c y", None]
    texts += ["".join(rng.choice("ab1 .,'\n\té  s漢<|> ") for _ in range(rng.randrange(14))) for _ in range(2000)]
    for limit in (m.TABLE_CHUNKS, 40):
        chunks = m.Chunks(tokenizer, limit)
        for at in range(0, len(texts), 300):
            some = texts[at : at + 300]
            ids, counts = m.encode_texts(chunks, pa.array(some, pa.string()), ("<|endoftext|>",))
            want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, m.END] for t in some]
            assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert len(chunks.young) <= limit


def test_words_breaks_and_marks_equal_the_library(tokenizer):
    """Words that the model takes as they are, line breaks and marks that are cut off: the library's ids for the text."""
    rng = random.Random(6)
    parts = ["word", "Été", "ÿ", "ɏŁ", "Ω", "漢", "1", "'s", "'", "&&&", "#", "_", "-", "<|", "~", "\n", "\n\n", "\r\n", "\t", "\u0085", "\u00a0", "\u2028", "\x1c", "\u200b", " ", "  ", "\x01", "×", "ª"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(6000)] + ["a.\nB&&& c", "a\nb\nc", "x" * 5000]
    ids, counts = m.encode_texts(m.Chunks(tokenizer), pa.array(texts, pa.string()), ("<|endoftext|>",))
    want = [[*e.ids, m.END] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_few_chunks_reach_the_batches_of_the_library(tokenizer):
    class Counted(m.Chunks):
        asked = []

        def ids(self, chunks):
            self.asked += chunks
            return super().ids(chunks)

    chunks = Counted(tokenizer)
    m.encode_texts(chunks, pa.array(["see end.\nNext&&& word."]))
    assert sorted(chunks.asked) == sorted(["see", " see", " end", ".", "\n", "Next", "&&&", " word"]) and chunks.direct


def documents(rng, n, kinds):
    docs = [[*(rng.randrange(kinds) for _ in range(rng.randrange(0, 200))), m.END] for _ in range(n)]
    docs += [docs[0]] * 5 + [[7] * 1000 + [m.END], [1, 2, 1, 2, 2, 2, 2], [m.END]]
    return docs


@pytest.mark.parametrize("base", [50_257, 70_000])
@pytest.mark.parametrize("kinds", [3, 40, 50_000])
def test_files_round_trip_and_random_access(base, kinds):
    rng = random.Random(kinds)
    docs = documents(rng, 60, kinds)
    shard = m.Shard(m.write_shard(np.array([i for d in docs for i in d], np.int32), np.array([len(d) for d in docs]), base))
    assert shard.counts().tolist() == [len(d) for d in docs]
    assert shard.expand(shard.symbols).tolist() == [i for d in docs for i in d]
    assert all(shard.expand(np.array([base + k])).tolist() == [*shard.expand(r[:1]), *shard.expand(r[1:])] and len(shard.expand(np.array([base + k]))) == shard.lengths[k] for k, r in enumerate(shard.rules[:200]))
    for _ in range(300):
        d, a, b = rng.randrange(len(docs)), rng.randrange(-3, 210), rng.randrange(-3, 210)
        assert shard.ids(d, a, b).tolist() == docs[d][a:b]


def test_repeats_are_compressed():
    ids = np.array(([5, 6, 7, 8] * 500 + [m.END]) * 4, np.int32)
    symbols, rules, ends = m.compress(ids, np.array([2001, 4002, 6003, 8004]), 100)
    assert len(symbols) < 120 and len(rules) < 40 and ends[-1] == len(symbols)
    assert (symbols[ends - 1] == m.END).all()  # no pair crosses a document


def test_pairs_are_replaced_from_the_left():
    symbols, rules, _ = m.compress(np.array([3, 3, 3, 3, 3, 9, 3, 3, 3, 3, 9] * 3, np.int32), np.array([33]), 100, round_rules=1, least=4)
    assert rules.tolist()[0] == [3, 3]
    want = np.array([100, 100, 3, 9, 100, 100, 9] * 3)
    one, _, _ = m.compress(np.array([3, 3, 3, 3, 3, 9, 3, 3, 3, 3, 9] * 3, np.int32), np.array([33]), 100, most_symbols=101, least=4)
    assert one.tolist() == want.tolist()


def owed(tokenizer, docs):
    rows = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in docs), key=lambda r: r[:2])
    out, start = [], 0
    for none, name, text in rows:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, m.END], "<u4")
        out.append((None if none else name, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query(spark, docs, sf_dir, tokenizer):
    got = [tuple(r) for r in m.op13_repair_tokens(spark, sf_dir).collect()]
    want = owed(tokenizer, docs.collect())
    assert sorted((r[0] is None, r[0] or 0, *r[2:]) for r in got) == sorted((r[0] is None, r[0] or 0, *r[2:]) for r in want)
    single = {r[0] for r in want if sum(r[0] == w[0] for w in want) == 1}
    assert {r[:2] for r in got if r[0] in single} == {r[:2] for r in want if r[0] in single}
    places = sorted(r[1:3] for r in got)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))


def test_small_shards_ids_and_windows(spark, docs, tokenizer):
    stored = m.write_shards(docs, shard_ids=300, table_chunks=64)
    assert stored.count() > 8
    rows = m.read_shards(stored, with_ids=True).collect()
    want = owed(tokenizer, docs.collect())
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted(w[2:] for w in want)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r["ids"])
    asked = spark.createDataFrame([(i, at, n) for i in (13, 14, 20, 60) for at, n in ((0, 3), (5, 40), (10**6, 2), (0, 0))], "doc_id bigint, at bigint, n bigint")
    got = m.read_windows(stored, asked).collect()
    assert len(got) == sum(len(of.get(i, [])) for i in (13, 14, 20, 60)) * 4
    assert all(r["window"] in [ids[r["at"] : r["at"] + r["n"]] for ids in of[r["doc_id"]]] for r in got)


def test_empty_table(spark, no_docs):
    assert m.read_shards(m.write_shards(no_docs)).collect() == []
