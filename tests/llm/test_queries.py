"""The registered queries: their SQL on the smallest tables, and their columns on rows of every odd kind."""

import hashlib
import os
import re
from pathlib import Path

import pytest

from skeinlog.llm import registry, sentencepiece_codec

DATA = Path(os.environ.get("SKEINLOG_TEST_DATA", "/root/testdata/sf0.001"))
CONTRACT = {
    "op1_bradley_terry": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_weak_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op4_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op5_telephony": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op6_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op7_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op8_sentencepiece": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op9_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op11_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op12_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op13_repair_tokens": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
}


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("all"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 3)] + [(None, 1, 0), (7, None, 1), (7, 1, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (None, None, None, None)], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{at}/conversations.parquet")
    vectors = [(i, [float(i % 5), -0.5, 0.001 * i] * 16, i % 3) for i in range(70)] + [(None, [1.0] * 48, None), (90, None, 1), (91, [None] * 48, 1), (92, [float("nan")] * 48, 1)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


ROWS = {"op4_chat_format": 3, "op11_conversation_repair": 2, "op12_vector_codes": 71}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract(spark, docs, tables, name):
    out = registry.queries()[name](spark, tables)
    want = [tuple(c.rsplit(" ", 1)) for c in CONTRACT[name].split(", ")]
    assert out.dtypes[: len(want)] == want
    assert out.count() == ROWS.get(name, docs.count())


def test_settings_come_back(spark, tables):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in keys]
    registry.queries()["op3_weak_rules"](spark, tables).count()
    assert [spark.conf.get(k) for k in keys] == before


def test_sentencepiece_equals_the_library(spark, docs, tables):
    sp = sentencepiece_codec.load(sentencepiece_codec.model_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = sp.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    got = registry.queries()["op8_sentencepiece"](spark, tables).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    df = registry.queries()[name](spark, str(DATA))
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(row[names.index(c)] for c in order) for row in got.fetchall()), key=repr)
    mine = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    assert len(mine) == len(want)
    for a, b in zip(mine, want):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 1e-6) for x, y in zip(a, b))


def test_every_operator_is_registered():
    assert {re.sub(r"_.*", "", n) for n in registry.queries()} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
