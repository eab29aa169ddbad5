import hashlib

from pyspark.sql import functions as F

from skeinlog.llm import chat_format as m

ROWS = [
    (1, 0, "system", "be & brief"), (1, 1, "user", "</s>\n<s>[assistant]\nhi <t>[x"), (1, 2, "assistant", "&lt; ok </s>"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 0, "user", "no reply"), (3, 0, "assistant", "alone"), (3, 0, "assistant", "alone"), (None, 1, "us]er\n", "null id"), (None, None, None, "null turn"), (4, 5, "assistant", "x" * 50_000),
]


def expected(rows):
    convs = {}
    for i, (c, t, r, x) in enumerate(rows):
        convs.setdefault((None, i) if c is None else c, []).append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(turns)] for c, turns in convs.items()}


def test_examples(spark):
    df = spark.createDataFrame([(*r, "extra", 1) for r in ROWS], "conv_id bigint, turn bigint, role string, text string, example string, Turns int")
    out = m.format_examples(df)
    out = out.withColumn("turns", m.read_turns(F.col("formatted"))).withColumn("target", m.read_target(F.col("formatted"), F.col("target_at"), F.col("target_chars"))).collect()
    alone = {r["turns"][0]["text"]: [r] for r in out if r["conv_id"] is None}
    for c, turns in expected(ROWS).items():
        mine = alone[turns[0][1]] if isinstance(c, tuple) else sorted((r for r in out if r["conv_id"] == c), key=lambda r: r["example"])
        ends = [i + 1 for i, (role, _) in enumerate(turns) if role == "assistant" or i + 1 == len(turns)]
        assert [r["example"] for r in mine] == ends
        for r in mine:
            assert [tuple(t) for t in r["turns"]] == turns[: r["example"]]
            role, text = turns[r["example"] - 1]
            assert r["target"] == (text if role == "assistant" else "")
            assert (r["target_at"] is None) == (role != "assistant")
            assert r["formatted"].count(m.TRAIN) == (role == "assistant")


def test_query(spark, tmp_path):
    spark.createDataFrame([r for r in ROWS if r[0] is not None], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    df = m.op4_chat_format(spark, str(tmp_path))
    got = {r["conv_id"]: r for r in df.collect()}
    said = "</s>[INST] ok [/INST]"
    want = expected([r for r in ROWS if r[0] is not None]) | {-7: [("user", said), ("assistant", said)]}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert not any(k in df._jdf.queryExecution().toString() for k in ("Python", "Arrow", "Pandas"))


def test_empty_table(spark):
    assert m.format_examples(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []
