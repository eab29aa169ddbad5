"""Conversation structure repair: a forward Viterbi pass over four grammar states.

A conversation's roles have to read `(s?(ua)+)?` by their initials. Edits: Keep (cost 0) a row whose initial fits,
Rerole (2) a row to user or assistant, Delete (3) a row, Insert (2) a row of user or assistant without text. Blank
rows and repeats of an earlier role and text have to be deleted, and a row that ends without `.`, `!` or `?` costs
1 more where it stays. An audit is the edits' initials in order; of the cheapest the ASCII-least is taken. Given the
state, each edit leaves no choice, so an audit says all.

States: 0 nothing yet, 1 after the system row, 2 after a user, 3 after an assistant; 0 and 3 may end. Best (cost,
audit) between two states over some rows is a matrix with an associative product: rows are range-partitioned by
conversation and turn, each task multiplies what it has of a conversation, and the few products of conversations
that a border cuts are multiplied after that. So a conversation that holds a third of all rows is many tasks' work.
After each row at most two inserts follow (a third would come back to a state for more), which closes the layer;
ties never are prefixes of each other, so comparing layer by layer is exact.

Edits are applied in a stream of sorted rows that holds one row and one audit at a time. A digest of a whole
conversation is one value over all its bytes, so it alone is made in one task per conversation.

Rows are ordered by turn (nulls first), role, and the md5 of the text. Defined results: a null role or text is one
space, and null conv_ids are one conversation; repeated rows are rows, each but the first a repeat; they and equal
texts are counted before anything is joined, so a hot one is one row; texts of any length are read whole, an audit
is as long as its conversation; extra columns are left out, whatever their names; an empty table gives an empty
table, and a conversation without rows no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The state after an inserted or reroled row, and after a kept one of an initial.
NEXT = (2, 2, 3, 2)
KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: Rows whose matrix is remembered by the worker.
SHORT = 64
STATS = ("blank", "duplicate", "truncated", "illegal", "turns")
ORDER = ("turn", "role", "key")

Cell = tuple[int, str] | None
Matrix = tuple[tuple[Cell, ...], ...]


def _best(cells: list[tuple[int, int, str]]) -> tuple[Cell, ...]:
    """The best cell of each state, of (state, cost, audit)."""
    out: list[Cell] = [None] * 4
    for state, cost, audit in cells:
        if out[state] is None or (cost, audit) < out[state]:
            out[state] = (cost, audit)
    return tuple(out)


def close(cells: tuple[Cell, ...]) -> tuple[Cell, ...]:
    """The cells after at most two inserts."""
    found = [(s, *c) for s, c in enumerate(cells) if c]
    once = [(NEXT[s], c + 2, a + "I") for s, c, a in found]
    return _best(found + once + [(NEXT[s], c + 2, a + "I") for s, c, a in once])


def row_matrix(kind: str) -> Matrix:
    """Of one row: x has to be deleted; s, u, a are kept by their initials, o by none; capitals are truncated."""
    more, out = int(kind.isupper()), []
    for state in range(4):
        cells = [(state, 3, "D")]
        if kind != "x":
            cells.append((NEXT[state], 2 + more, "R"))
            kept = KEEP.get(kind.lower(), (None,) * 4)[state]
            if kept is not None:
                cells.append((kept, more, "K"))
        out.append(close(_best(cells)))
    return tuple(out)


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(_through(row, [b[m][t] for m in range(4)]) for t in range(4)) for row in a)


def _through(heads: tuple[Cell, ...], tails: list[Cell]) -> Cell:
    pairs = [(x[0] + y[0], x[1], y[1]) for x, y in zip(heads, tails, strict=True) if x and y]
    if not pairs:
        return None
    least = min(p[0] for p in pairs)
    return least, min(h + t for cost, h, t in pairs if cost == least)


def matrix(kinds: str) -> Matrix:
    """Of rows of these kinds, one at least; halves are multiplied, so long audits are copied seldom."""
    return _short(kinds) if len(kinds) <= SHORT else product(matrix(kinds[: len(kinds) // 2]), matrix(kinds[len(kinds) // 2 :]))


@lru_cache(maxsize=50_000)
def _short(kinds: str) -> Matrix:
    return row_matrix(kinds) if len(kinds) == 1 else product(_short(kinds[: len(kinds) // 2]), _short(kinds[len(kinds) // 2 :]))


def products(matrices: list[Matrix]) -> Matrix:
    while len(matrices) > 1:
        matrices = [product(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def solve(m: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    start = close(((0, ""), None, None, None))
    ends = [_through(start, [m[s][t] for s in range(4)]) for t in (0, 3)]
    return min(e for e in ends if e)


def fault_columns(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it ends without a mark."""
    return ~text.rlike(r"[^\x20\x09-\x0D]"), ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def plain(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role and text, without nulls in the last two."""
    said = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(" "))
    return df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("bigint").alias("turn"), said(role).alias("role"), said(text).alias("text"))


def marked(rows: DataFrame) -> DataFrame:
    """Distinct rows of plain(), without texts: conv_id, turn, role, key (of the text), n (equal rows), blank, cut and
    again (role and text were said in an earlier turn)."""
    blank, cut = fault_columns(F.col("text"))
    rows = rows.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("key"), blank.alias("blank"), cut.alias("cut"))
    rows = rows.groupBy("conv_id", *ORDER, "blank", "cut").agg(F.count("*").alias("n"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    said = rows.filter(~F.col("blank")).groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("key").alias("_key")).agg(F.min(at).alias("_at"), F.count("*").alias("_n")).filter("_n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("key") == F.col("_key"))
    rows = rows.join(said, same, "left").withColumn("again", F.coalesce(F.col("_at") < at, F.lit(False)))
    return rows.select("conv_id", *ORDER, "n", "blank", "cut", "again")


class Piece:
    """Consecutive rows of one conversation: the kinds of its rows and what is counted."""

    def __init__(self, conv, turn, role, key):
        self.conv, self.at = conv, (turn, role, key)
        self.kinds: list[str] = []
        self.counts = dict.fromkeys(STATS, 0)
        self.first, self.last, self.low, self.high = role[:1], None, None, None

    def add(self, turn, role: str, n: int, blank: bool, cut: bool, again: bool) -> None:
        c, initial = self.counts, role[:1]
        if self.last is not None:
            c["illegal"] += self.last + initial not in ("su", "ua", "au")
        c["illegal"] += n - 1
        if turn is not None:
            c["turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        stays = 0 if blank or again else 1
        c["blank" if blank else "duplicate"] += n - stays
        c["truncated"] += stays and cut
        kind = initial if initial in KEEP else "o"
        self.kinds.append((kind.upper() if cut else kind) * stays + "x" * (n - stays))
        self.last = initial


def _cells(m: Matrix) -> tuple[list, list]:
    flat = [c for row in m for c in row]
    return [c and c[0] for c in flat], [c and c[1] for c in flat]


def pieces(rows: DataFrame, parts: int) -> DataFrame:
    """A row for each conversation of each range of marked() rows: its place, its counts and its matrix."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *ORDER, "first", "last", "low", "high", *STATS, "costs", "audits"]
    types = None

    def row(p: Piece) -> dict:
        costs, audits = _cells(matrix("".join(p.kinds)))
        return dict(zip(names, [p.conv, *p.at, p.first, p.last, p.low, p.high, *p.counts.values(), costs, audits], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, done = None, []
        for batch in batches:
            form = pa.schema([batch.schema.field(0), *types])
            for c, turn, role, key, n, blank, cut, again in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if piece is None or piece.conv != c:
                    if piece:
                        done.append(row(piece))
                    piece = Piece(c, turn, role, key)
                piece.add(turn, role, n, blank, cut, again)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=form)
                done = []
        if piece:
            yield pa.RecordBatch.from_pylist([row(piece)], schema=form)

    big, text = pa.int64(), pa.string()
    types = [pa.field(n, t) for n, t in zip(names[1:], [big, text, pa.binary(), text, text, big, big, *[big] * len(STATS), pa.list_(big), pa.list_(text)], strict=True)]
    schema = f"conv_id {conv}, turn bigint, role string, key binary, first string, last string, low bigint, high bigint, " + ", ".join(f"{s} bigint" for s in STATS) + ", costs array<bigint>, audits array<string>"
    return rows.repartitionByRange(parts, "conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER).mapInArrow(run, schema)


def join_pieces(found: DataFrame) -> DataFrame:
    """pieces() of whole conversations put together: conv_id, gaps, the counts, cost and audit."""
    conv = found.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def row(conv, parts: list[dict]) -> dict:
        total = {s: sum(p[s] for p in parts) for s in STATS}
        timed = [p for p in parts if p["low"] is not None]
        total["turns"] -= sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
        total["illegal"] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:]))
        gaps = timed[-1]["high"] - timed[0]["low"] + 1 - total.pop("turns") if timed else 0
        cells = [[(c, a) if c is not None else None for c, a in zip(p["costs"], p["audits"])] for p in parts]
        cost, audit = solve(products([tuple(tuple(x[4 * s : 4 * s + 4]) for s in range(4)) for x in cells]))
        return {"conv_id": conv, "gaps": gaps, **total, "cost": cost, "audit": audit}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, done = [], []
        for batch in batches:
            form = pa.schema([batch.schema.field(0), *(pa.field(n, pa.string() if n == "audit" else pa.int64()) for n in names[1:])])
            for p in batch.to_pylist():
                if parts and parts[0]["conv_id"] != p["conv_id"]:
                    done.append(row(parts[0]["conv_id"], parts))
                    parts = []
                parts.append(p)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=form)
                done = []
        if parts:
            yield pa.RecordBatch.from_pylist([row(parts[0]["conv_id"], parts)], schema=form)

    return found.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).mapInArrow(run, f"conv_id {conv}, " + ", ".join(f"{n} {'string' if n == 'audit' else 'bigint'}" for n in names[1:]))


def audits(df: DataFrame, **columns: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation that has rows."""
    return join_pieces(pieces(marked(plain(df, **columns)), common.partitions(df.sparkSession)))


def _edited(df: DataFrame, found: DataFrame, make, schema: str, **columns: str) -> DataFrame:
    """For each conversation in one sorted stream: make(conv_id) gives an object whose add(edit, turn, role, text) takes
    the repaired rows in order and whose end() gives the last of its rows; all its rows are in `out` until taken."""
    rows = plain(df, **columns).select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.unhex(F.md5("text")).alias("key"), "text")
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("key"), F.col("audit").alias("text"))
    by = ["conv_id", "kind", *ORDER]
    said = ("user", "assistant")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, audit, at, count, form = None, "", 0, 0, None

        def insert() -> None:
            nonlocal at, count
            while at < len(audit) and audit[at] == "I":
                target.add("I", None, said[count % 2], "")
                at, count = at + 1, count + 1

        for batch in batches:
            form, out = batch.schema.field(0), []
            for conv, kind, turn, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5)), strict=True):
                if kind == 0:
                    if target:
                        out += target.end()
                    target, audit, at, count = make(conv), text, 0, 0
                    insert()
                    continue
                edit, at = audit[at], at + 1
                if edit == "K":
                    target.add("K", turn, role, text)
                    count += not (count == 0 and role[:1] == "s")  # the system row stands before the pairs
                elif edit == "R":
                    target.add("R", turn, said[count % 2], text)
                    count += 1
                insert()
            out += target.taken() if target else []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_form(form))
        if target:
            yield pa.RecordBatch.from_pylist(target.end(), schema=_form(form))

    def _form(field: pa.Field) -> pa.Schema:
        types = {"string": pa.string(), "bigint": pa.int64()}
        return pa.schema([field, *(pa.field(n, types[t]) for n, t in (c.split(" ") for c in schema.split(", ")))])

    both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(*by)
    return both.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {schema}")


class _Rows:
    def __init__(self, conv):
        self.conv, self.position, self.out = conv, 0, []

    def add(self, edit, turn, role, text) -> None:
        self.out.append({"conv_id": self.conv, "position": self.position, "edit": edit, "turn": turn, "role": role, "text": text})
        self.position += 1

    def taken(self) -> list[dict]:
        out, self.out = self.out, []
        return out

    end = taken


class _Digest:
    def __init__(self, conv):
        self.conv, self.hash, self.empty = conv, hashlib.sha256(), True

    def add(self, edit, turn, role, text) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def taken(self) -> list[dict]:
        return []

    def end(self) -> list[dict]:
        return [{"conv_id": self.conv, "sha256": self.hash.hexdigest()}]


def repair(df: DataFrame, found: DataFrame, **columns: str) -> DataFrame:
    """The repaired rows by audits(): conv_id, position, edit (K, R or I), turn (null where inserted), role and text."""
    return _edited(df, found, _Rows, "position bigint, edit string, turn bigint, role string, text string", **columns)


def digests(df: DataFrame, found: DataFrame, **columns: str) -> DataFrame:
    """conv_id and sha256 of the repaired `role:text`, joined by line breaks."""
    return _edited(df, found, _Digest, "sha256 string", **columns)


def damage(df: DataFrame) -> DataFrame:
    """The query's faults, by crc32 of `conv_id:turn` modulo 20 (a null is one space there too)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = plain(df).withColumn("fault", fault).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = common.same_columns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), ["conv_id", "turn", "role", "text"])
    rows = damage(given)
    found = common.store(audits(rows))
    sums = digests(rows, found).withColumnRenamed("conv_id", "_conv")
    every = given.select("conv_id").distinct()
    found = found.withColumnRenamed("conv_id", "_id")
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").join(sums, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _plus(cell: str, cost: str, edit: str) -> str:
    """SQL: a cell (nine digits of cost, then the audit; null: none) after one more edit."""
    return f"(lpad(CAST(CAST({cell}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {cell}[10:] || '{edit}')"


def _op11_sql() -> str:
    free, add = "NOT must", _plus
    when = lambda test, value: f"CASE WHEN {test} THEN {value} END"
    back = ("v0", "v1", "v3")
    n2 = ", ".join([add("v2", "3", "D"), *(when(f"{free} AND initial = 'u'", add(v, "cut", "K")) for v in back), *(when(free, add(v, "2 + cut", "R")) for v in back)])
    n3 = ", ".join([add("v3", "3", "D"), when(f"{free} AND initial = 'a'", add("v2", "cut", "K")), when(free, add("v2", "2 + cut", "R"))])
    m2 = f"least(n2, {', '.join(add(n, '2', 'I') for n in ('n0', 'n1', 'n3'))})"
    return rf"""
WITH RECURSIVE bytes AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295], [CAST(ascii(x) AS BIGINT) FOR x IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault
  FROM conversations, bytes
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, range(2) copies(n) WHERE fault <> 0 AND (n = 0 OR fault = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open, role[1:1] AS initial FROM damaged
), judged AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), seen AS (
  SELECT *, blank OR again AS must, CASE WHEN open THEN 1 ELSE 0 END AS cut FROM judged
), dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS v0, CAST(NULL AS VARCHAR) AS v1, '000000002I' AS v2, '000000004II' AS v3 FROM seen
  UNION ALL
  SELECT conv_id, i, n0, n1, m2, least(n3, {add('m2', '2', 'I')}) FROM (SELECT *, {m2} AS m2 FROM (
    SELECT s.conv_id, s.i, {add('v0', '3', 'D')} AS n0, least({add('v1', '3', 'D')}, {when(f"{free} AND initial = 's'", add('v0', 'cut', 'K'))}) AS n1, least({n2}) AS n2, least({n3}) AS n3
    FROM dp JOIN seen s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.i = dp.i + 1))
), best AS (
  SELECT conv_id, least(arg_max(v0, i), arg_max(v3, i)) AS cell FROM (SELECT conv_id, i, coalesce(v0, '~') AS v0, coalesce(v3, '~') AS v3 FROM dp) GROUP BY conv_id
), edits AS (
  SELECT conv_id, unnest(string_split(cell[10:], '')) AS edit, generate_subscripts(string_split(cell[10:], ''), 1) AS pos FROM best WHERE length(cell) > 9
), placed_edits AS (
  SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM edits
), told AS (
  SELECT e.conv_id, e.pos, e.edit, CASE WHEN e.edit <> 'I' THEN s.role END AS role, CASE WHEN e.edit = 'I' THEN '' ELSE s.text END AS text, s.initial,
         row_number() OVER (PARTITION BY e.conv_id ORDER BY e.pos) AS k
  FROM placed_edits e LEFT JOIN seen s ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.i = s.i WHERE e.edit <> 'D'
), lines AS (
  SELECT *, first_value(edit = 'K' AND initial = 's') OVER (PARTITION BY conv_id ORDER BY pos) AS system FROM told
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - CASE WHEN system THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS whole FROM lines GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate,
         count(*) FILTER (WHERE open AND NOT must) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM seen GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(cell[1:9] AS BIGINT), 0) AS cost, coalesce(cell[10:], '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted n ON c.conv_id IS NOT DISTINCT FROM n.conv_id
LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN repaired r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""


OP11_SQL = _op11_sql()
