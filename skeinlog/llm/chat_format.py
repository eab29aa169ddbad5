"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn of a conversation becomes an example of its own: all turns before it as context,
which is not trained on, and that reply as the only trainable part. A conversation that doesn't end
with an assistant turn has one more example that holds all its turns and trains nothing, so that the
output loses no turn.

Template: a turn is `<s>[role]\\n`, its text, `</s>\\n`; the reply that is trained on starts with
`<t>` in place of `<s>`. In roles and texts `&` is written `&amp;`, `<` as `&lt;`, and in roles `]`
as `&rb;`, so no text holds a control string, and reading back undoes it.

Turns are ordered by turn, then role, then text. Defined results: a null text or role is empty; null turns
come first; nothing tells which conversation a row without conv_id belongs to, so each is one of its own;
repeated rows are turns of their own; texts of any length are formatted whole; extra columns are left out,
whatever their names; an empty table gives no examples. A conversation's turns are gathered in one row: its length is what one speaker wrote, and
its examples are made one at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

OPEN, TRAIN, CLOSE = "<s>[", "<t>[", "</s>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("]"), F.lit("&rb;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&rb;"), F.lit("]")))


def format_examples(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, apart (tells rows without conv_id from each other), example (number of turns in it), is_last, formatted, target_at (position of the trained
    text in formatted, from 1; null: none) and target_chars."""
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    apart = F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id())
    df = df.select(F.col(conv_id).alias("conv_id"), apart.alias("apart"), said.alias("said"))
    convs = df.groupBy("conv_id", "apart").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    heads = F.transform("turns", lambda t: F.concat(escape_role(t["role"]), F.lit("]\n")))
    bodies = F.transform("turns", lambda t: F.concat(escape(t["text"]), F.lit(CLOSE)))
    n = F.size("turns")
    trained = F.filter(F.sequence(F.lit(1), n), lambda i: (F.get("turns", i - 1)["role"] == "assistant") | (i == n))
    convs = convs.select("conv_id", "apart", n.alias("n"), F.transform("turns", lambda t: t["role"] == "assistant").alias("replies"), heads.alias("heads"), bodies.alias("bodies"), trained.alias("ends"))
    convs = convs.withColumn("whole", F.zip_with("heads", "bodies", lambda h, b: F.concat(F.lit(OPEN), h, b)))
    rows = convs.select("conv_id", "apart", "n", "replies", "heads", "bodies", "whole", F.explode("ends").alias("example"))
    is_reply = F.get("replies", F.col("example") - 1)
    context = F.array_join(F.slice("whole", 1, F.col("example") - 1), "")
    head, body = F.get("heads", F.col("example") - 1), F.get("bodies", F.col("example") - 1)
    rows = rows.select("conv_id", "apart", "example", (F.col("example") == F.col("n")).alias("is_last"), is_reply.alias("is_reply"), F.concat(context, F.when(is_reply, TRAIN).otherwise(OPEN), head).alias("before"), body.alias("body"))
    at = F.when(F.col("is_reply"), F.length("before") + 1)
    chars = F.when(F.col("is_reply"), F.length("body") - len(CLOSE)).otherwise(0)
    return rows.select("conv_id", "apart", "example", "is_last", F.concat("before", "body").alias("formatted"), at.alias("target_at"), chars.alias("target_chars"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example: an array of (role, text)."""
    parts = F.filter(F.split(formatted, "</s>\n", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "]\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(p, F.length(role) + len(OPEN) + 3)).alias("text"))

    return F.transform(parts, turn)


def read_target(formatted: Column, target_at: Column, target_chars: Column) -> Column:
    """The text under the loss mask."""
    return F.when(target_at.isNull(), "").otherwise(unescape(F.substr(formatted, target_at, target_chars)))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = common.same_columns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), ["conv_id", "turn", "role", "text"])
    ours = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id bigint, turn bigint, role string, text string")
    rows = format_examples(convs.unionByName(ours))
    target = read_target(F.col("formatted"), F.col("target_at"), F.col("target_chars"))
    rows = rows.select("conv_id", "apart", "example", F.length("formatted").cast("bigint").alias("chars"), target.alias("target"), F.when(F.col("is_last"), read_turns(F.col("formatted"))).alias("turns"))
    out = rows.groupBy("conv_id", "apart").agg(F.sum("chars").alias("formatted_chars"), F.max("turns").alias("turns"), F.sort_array(F.collect_list(F.struct("example", "target"))).alias("targets"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("targets", lambda t: t["target"]), "")
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS apart, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), ']', '&rb;'))
            + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 11 AS chars,
         row_number() OVER (PARTITION BY conv_id, apart ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id, apart) AS n
  FROM turns
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id, apart ORDER BY i) AS prefix FROM sized
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(prefix) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id, apart
"""
