"""Vector code compression: product codes of integer vectors by rounds of nearest entries and means.

A component x becomes the integer floor(256 x). Vectors are cut into PARTS equal parts; each part's codebook starts as
that part of the vectors of the smallest ids and is refined in rounds: every part goes to its nearest entry (squared
distance, ties to the lower index), and each entry becomes the componentwise floor of its parts' mean. Codebooks are
a bounded table of integers that is broadcast; Arrow batches compute all distances of a part by the norm expansion
|x|^2 - 2 x.c + |c|^2 with int64 matrix products and take the first least one; a task sends sums per entry, never a
vector, and those are merged by one grouped shuffle per round. A vector that many rows share is therefore no hot key.

Everything is exact: batches whose numbers could leave int64 are computed with Python's integers, and sums travel
as 64-bit limbs in decimals.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are left out; a vector that is
shorter than the longest, or whose length is no multiple of PARTS, has zeros after its end; with fewer than ENTRIES
vectors there are so many entries; ties of ids (null ids come last) are broken by the components, and repeated rows
are rows and may be entries of their own; an error beyond a long is the largest long; extra columns are left out,
whatever their names; an empty table gives an empty table, and codebooks without entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LONG = (1 << 63) - 1
LIMB = 64


def integers(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and their integers (kept, dim): int64, or Python's where those do not fit."""
    n = len(vectors)
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    values = vectors.values.slice(offsets[0], offsets[-1] - offsets[0])
    bad = values.is_null().to_numpy(zero_copy_only=False)
    x = values.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(bad | ~np.isfinite(x))])
    at = offsets - offsets[0]
    keep = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]])
    lengths = np.diff(at)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(x * SCALE)
    small = np.abs(scaled) < 2**62
    row = np.repeat(np.arange(n), lengths)
    column = np.arange(len(x)) - np.repeat(at[:-1], lengths)
    fits = bool(small[keep[row]].all())
    out = np.zeros((n, dim), np.int64 if fits else object)
    out[row, column] = np.where(small, scaled, 0).astype(np.int64)
    if not fits:
        for i in np.flatnonzero(~small & keep[row]):
            a, b = float(x[i]).as_integer_ratio()
            out[row[i], column[i]] = a * SCALE // b
    return keep, out[keep]


def nearest(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x (n, parts, d) and codebooks (parts, entries, d) to the codes (n, parts) and squared distances (n, parts)."""
    most = max((int(np.abs(a).max()) for a in (x, codebooks) if a.size), default=0)
    if x.dtype == object or x.shape[2] * 4 * most * most > LONG:
        x, codebooks = x.astype(object), codebooks.astype(object)
    else:
        codebooks = codebooks.astype(np.int64)
    codes = np.empty(x.shape[:2], np.int64)
    least = np.empty(x.shape[:2], x.dtype)
    for p in range(x.shape[1]):
        part, book = x[:, p], codebooks[p]
        far = (part * part).sum(axis=1)[:, None] - 2 * (part @ book.T) + (book * book).sum(axis=1)[None]
        codes[:, p] = far.argmin(axis=1)
        least[:, p] = far[np.arange(len(part)), codes[:, p]]
    return codes, least


def entry_sums(x: np.ndarray, codes: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Per part and entry: how many parts it has, and their sums (parts, entries, d)."""
    counts = np.stack([np.bincount(c, minlength=entries) for c in codes.T])
    sums = np.zeros((x.shape[1], entries, x.shape[2]), x.dtype)
    for p in range(x.shape[1]):
        np.add.at(sums[p], codes[:, p], x[:, p])
    return counts, sums


def limbs(value: int) -> list[int]:
    """value in base 2 ** LIMB, least first; the last one is signed."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def vector_dim(df: DataFrame, vector: str) -> int:
    """The longest vector's length, up to a multiple of PARTS."""
    longest = df.agg(F.max(F.size(F.col(vector)))).first()[0] or 0
    return max(1, -(-longest // PARTS)) * PARTS


def first_vectors(df: DataFrame, dim: int, entries: int) -> np.ndarray:
    """The codebooks to start from, of the first rows by id: (PARTS, at most entries, dim / PARTS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = integers(batch.column(1), dim)
            ids = batch.column(0).filter(pa.array(keep))
            order = sorted(range(len(ids)), key=lambda i: (not ids[i].is_valid, ids[i].as_py() or 0, x[i].tolist()))[:entries]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(order, pa.int64())), pa.array([[str(v) for v in x[i].tolist()] for i in order], pa.list_(pa.string()))], names=["id", "x"])

    rows = df.mapInArrow(run, f"id {df.schema.fields[0].dataType.simpleString()}, x array<string>")
    rows = rows.select("id", F.transform("x", lambda v: v.cast("double")).alias("n"), "x").orderBy(F.asc_nulls_last("id"), "n", "x").limit(entries).collect()
    first = [[int(v) for v in r["x"]] for r in rows]
    fits = all(abs(v) < 2**62 for r in first for v in r)
    return np.array(first, np.int64 if fits else object).reshape(len(first), PARTS, dim // PARTS).swapaxes(0, 1)


def refine(df: DataFrame, codebooks: np.ndarray, dim: int) -> np.ndarray:
    """One round: the codebooks after all vectors went to their nearest entries."""
    shared, width, entries = df.sparkSession.sparkContext.broadcast(codebooks), dim // PARTS, codebooks.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        counts, totals = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, width), object)
        for batch in batches:
            _, x = integers(batch.column(1), dim)
            x = x.reshape(len(x), PARTS, width)
            if not len(x):
                continue
            n, sums = entry_sums(x if x.dtype == object or int(np.abs(x).max()) * len(x) <= LONG else x.astype(object), nearest(x, books)[0], entries)
            counts += n
            totals += sums.astype(object)
        out = []
        for p, e in zip(*np.nonzero(counts)):
            split = [limbs(int(v)) for v in totals[p, e]]
            for k in range(max(map(len, split))):
                out.append({"part": int(p), "entry": int(e), "limb": k, "n": int(counts[p, e]) if k == 0 else 0, "sums": [str(s[k]) if k < len(s) else "0" for s in split]})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema({"part": pa.int32(), "entry": pa.int32(), "limb": pa.int32(), "n": pa.int64(), "sums": pa.list_(pa.string())}))

    sent = df.mapInArrow(run, "part int, entry int, limb int, n bigint, sums array<string>")
    merged = sent.groupBy("part", "entry", "limb").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(width)]).alias("sums"))
    out, counts = codebooks.astype(object), {}
    totals = np.zeros(codebooks.shape, object)
    for r in merged.toLocalIterator():  # parts x entries rows, and as many for each limb of huge numbers
        p, e = r["part"], r["entry"]
        counts[p, e] = counts.get((p, e), 0) + r["n"]
        totals[p, e] += np.array([int(v) << LIMB * r["limb"] for v in r["sums"]], object)
    for (p, e), n in counts.items():
        out[p, e] = totals[p, e] // n
    shared.destroy()
    fits = all(abs(int(v)) < 2**62 for v in out.ravel())
    return out.astype(np.int64) if fits else out


def encode(df: DataFrame, codebooks: np.ndarray, dim: int) -> DataFrame:
    """df (id, vector, label) to id, label, code and error of the rows that are kept."""
    shared, width = df.sparkSession.sparkContext.broadcast(codebooks), dim // PARTS
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            keep, x = integers(batch.column(1), dim)
            codes, far = nearest(x.reshape(len(x), PARTS, width), books)
            text = codes.astype(np.uint8).tobytes().hex()
            size = 2 * PARTS
            error = far.sum(axis=1) if far.dtype == object or int(far.max(initial=0)) * PARTS <= LONG else far.astype(object).sum(axis=1)
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(2).filter(kept), pa.array([text[i : i + size] for i in range(0, len(text), size)], pa.string()), pa.array([min(int(v), LONG) for v in error], pa.int64())], names=[names[0], names[2], "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.mapInArrow(run, f"`{names[0]}` {types[names[0]]}, `{names[2]}` {types[names[2]]}, code string, error bigint")


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in codebooks.ravel()).encode()).hexdigest()


def decode(code: str, codebooks: np.ndarray) -> list[int]:
    """The vector of integers that a code stands for."""
    return [int(v) for p, e in enumerate(bytes.fromhex(code)) for v in codebooks[p, e]]


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of every vector that is kept, stored, and the codebooks (PARTS, entries, width)."""
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    df = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").alias("label"))
    dim = vector_dim(df, "vector")
    with common.small_batches(df.sparkSession):
        books = first_vectors(df, dim, entries)
        for _ in range(rounds if books.shape[1] else 0):
            books = refine(df, books, dim)
    if not books.shape[1]:
        return df.sparkSession.createDataFrame([], df.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")).schema), books
    return common.store(encode(df, books, dim)), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(common.same_columns(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), ["vec_id", "embedding", "label"]))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("bigint")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _op12_sql() -> str:
    parts = f"""
WITH cells AS (
  SELECT row_number() OVER () AS r, vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos, len(embedding) // {PARTS} AS width
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), x AS (
  SELECT r, vec_id, label, pos // width AS p, pos % width AS d, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM cells
), first AS (
  SELECT r, row_number() OVER (ORDER BY vec_id, r) - 1 AS e FROM (SELECT DISTINCT r, vec_id FROM x) ORDER BY vec_id LIMIT {ENTRIES}
), book0 AS (SELECT p, e, d, v FROM x JOIN first USING (r))"""
    near = "SELECT r, p, e, far FROM (SELECT x.r, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS far FROM x JOIN book{k} b ON x.p = b.p AND x.d = b.d GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY far, e) = 1"
    for k in range(ROUNDS):
        parts += f""", near{k} AS ({near.format(k=k)}
), mean{k} AS (
  SELECT x.p, e, d, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v FROM x JOIN near{k} n ON x.r = n.r AND x.p = n.p GROUP BY x.p, e, d
), book{k + 1} AS (SELECT b.p, b.e, b.d, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e AND b.d = m.d)"""
    return f"""{parts}, final AS ({near.format(k=ROUNDS)}
), coded AS (
  SELECT r, string_agg(printf('%02x', CAST(e AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM final GROUP BY r
), named AS (
  SELECT vec_id, label, code, error FROM coded JOIN (SELECT DISTINCT r, vec_id, label FROM x) USING (r)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, d)) FROM book{ROUNDS}) AS codebooks_sha256
FROM named
"""


OP12_SQL = _op12_sql()
