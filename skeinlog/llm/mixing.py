"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1. The integral of the schedule, scaled so
that the whole run demands the source's target of words, is its cumulative demand; the documents of a
source, in the order of a hash of their id and text, repeated as often as the target asks, follow each other
in words, and each copy is trained at the time at which cumulative demand reaches the copy's first
word: the inverse of the integral. The mix is the copies, range-sorted by that position.

Targets: sources share all words by weight; a target stops at `max_repeats` times its source's words
and the excess is shared by weight among the others until none is above.

Running sums never gather a source in one task: words are summed per source and hash bucket, buckets
are added up per source, and only documents of one bucket are summed in order. Sums per source reach
the driver (a row for each source).

Defined results: a null or empty text has no words and is never taken; null sources are one source,
the last; null and repeated ids are told apart by their texts; equal rows (same id, source and text) are
placed together as one, cut into chunks of CHUNK, and each takes a place of its own, in any order; a text of
any length is one document; ties in the order are broken by id and text; a source without words has
target 0; extra columns of curriculum() are kept, whatever their names; an empty table gives an empty table.
curriculum() numbers rows that are equal in id, source and text by streaming through them in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BUCKETS = 4096
CHUNK = 1000
MAX_REPEATS = 3
WEIGHTS = (5.0, 2.0, 1.0)
#: Times of the schedules' knots, and the relative weight there of every first, second and third source:
#: the first kind fades, the second stays, the third grows.
KNOTS = (0.0, 0.5, 1.0)
SHAPES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def words_in(text: Column) -> Column:
    """Number of runs of what isn't ASCII white space; null: 0."""
    plain = F.btrim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "), F.lit(" "))
    return F.when(F.coalesce(F.length(plain), F.lit(0)) == 0, 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def share_out(sizes: Sequence[int], weights: Sequence[float], max_repeats: float = MAX_REPEATS) -> list[float]:
    """Targets that share sum(sizes) by weight, none above max_repeats times its size."""
    order = sorted(range(len(sizes)), key=lambda i: max_repeats * sizes[i] / weights[i])
    left, weight, out = float(sum(sizes)), float(sum(weights)), [0.0] * len(sizes)
    for n, i in enumerate(order):
        if left / weight * weights[i] <= max_repeats * sizes[i]:
            for j in order[n:]:
                out[j] = left / weight * weights[j]
            break
        out[i] = float(max_repeats * sizes[i])
        left, weight = left - out[i], weight - weights[i]
    return out


def demand(shape: Sequence[float], knots: Sequence[float] = KNOTS) -> list[tuple[float, float, float, float]]:
    """Pieces (share of the demand before, after, time at the start, ...) of the normalised integral of a
    piecewise linear schedule: (done, t, weight at t, slope)."""
    pieces, done = [], 0.0
    for t, u, a, b in zip(knots, knots[1:], shape, shape[1:], strict=False):
        pieces.append((done, t, a, (b - a) / (u - t)))
        done += (a + b) / 2 * (u - t)
    return [(d / done, t, a / done, s / done) for d, t, a, s in pieces]


def time_of(share: Column, pieces: Sequence[tuple[float, float, float, float]]) -> Column:
    """The time at which the share of the demand is reached: done + a x + s x x / 2 = share, solved for x."""
    out = None
    for done, t, a, s in pieces:
        rest = share - done
        x = rest / a if s == 0 else (-a + F.sqrt(F.greatest(F.lit(a * a) + 2 * s * rest, F.lit(0.0)))) / s
        out = (F.lit(t) + x) if out is None else F.when(share >= done, F.lit(t) + x).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def plan(df: DataFrame, source: str, size: Column, weight_of: Callable[[int], float], max_repeats: float) -> list[tuple[str | None, int, float]]:
    """(source, words, target) by code point, null last."""
    rows = df.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("n")).collect()
    rows = sorted(((r["source"], int(r["n"])) for r in rows), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    targets = share_out([n for _, n in rows], [weight_of(i) for i in range(len(rows))], max_repeats)
    return [(s, n, t) for (s, n), t in zip(rows, targets, strict=True)]


def mix(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, shapes: Sequence[Sequence[float]] = SHAPES, buckets: int = BUCKETS) -> DataFrame:
    """Per row: doc_id, source, row_key (hash of the text), nth of how many equal rows, size, source_size, target,
    copies, taken, and begins (position of each copy in training time, 0 to 1)."""
    spark = df.sparkSession
    plain = F.coalesce(F.col(text), F.lit(""))
    draw = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("/"), F.md5(plain)))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), F.xxhash64(plain).alias("row_key"), draw.alias("draw"))
    rows = common.store(rows.groupBy("doc_id", "source", "size", "row_key", "draw").agg(F.count("*").alias("equal")).withColumn("words", F.col("size") * F.col("equal")))
    sources = plan(rows, "source", F.col("words"), lambda i: weights[i % len(weights)], max_repeats)
    numbered = [(k, s, n, t) for k, (s, n, t) in enumerate(sources)]
    table = spark.createDataFrame(numbered, "k int, s string, source_size bigint, target double")
    rows = rows.withColumn("bucket", F.conv(F.substring("draw", 1, 7), 16, 10).cast("bigint") * F.lit(buckets) / F.lit(1 << 28)).withColumn("bucket", F.floor("bucket").cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("words").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    base = sums.join(table, sums["s"].eqNullSafe(table["s"])).select(sums["s"], "b", "before", "k", "source_size", "target")
    within = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("words").over(within), F.lit(0)))
    rows = rows.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n)
    rows = rows.withColumn("chunk", F.explode(upto(F.floor((F.col("equal") - 1) / CHUNK).cast("bigint")))).withColumn("i", F.explode(upto(F.least(F.lit(CHUNK), F.col("equal") - F.col("chunk") * CHUNK) - 1)))
    rows = rows.withColumn("nth", F.col("chunk") * CHUNK + F.col("i"))
    start = F.col("before") + F.col("inside") + F.col("nth") * F.col("size")
    # copy c of a document begins at c * source_size + start; it is taken where its middle is within the target
    fits = F.try_divide(F.col("target") - start - F.col("size") / 2, F.col("source_size"))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.least(F.greatest(F.floor(fits) + 1, F.lit(0)), F.lit(max_repeats))).cast("int")
    rows = rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    pieces = [demand(shape) for shape in shapes]

    def begins(c: Column) -> Column:
        share = F.try_divide(c * F.col("source_size") + start, F.col("target"))
        out = time_of(share, pieces[-1])
        for i in range(len(pieces) - 1):
            out = F.when(F.col("k") % len(pieces) == i, time_of(share, pieces[i])).otherwise(out)
        return out

    at = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), begins)).otherwise(F.array().cast("array<double>"))
    return rows.select("doc_id", "source", "row_key", "nth", "equal", "size", "source_size", "target", "copies", F.col("taken").cast("bigint").alias("taken"), at.alias("begins"))


def curriculum(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mix itself: df's columns, a row for each copy taken, range-sorted by training position."""
    key, begins, at, nth, likely = (common.fresh(df, c) for c in ("row_key", "begins", "position", "nth", "likely"))
    keys = [f"{at}_id_known", f"{at}_id", f"{at}_source_known", f"{at}_source", key]

    def keyed(rows: DataFrame, doc_id: str, source: str) -> DataFrame:
        """Plain join keys, so that null ids and sources meet too."""
        zero = F.lit(0).cast(rows.schema[doc_id].dataType)
        return rows.withColumns({keys[0]: F.col(doc_id).isNotNull(), keys[1]: F.coalesce(F.col(doc_id), zero), keys[2]: F.col(source).isNotNull(), keys[3]: F.coalesce(F.col(source), F.lit(""))})

    plan_ = mix(df, text, doc_id, source, **options).filter("copies > 0").withColumnRenamed("row_key", key)
    plan_ = common.store(keyed(plan_, "doc_id", "source").select(*keys, F.col("nth").alias(nth), F.col("begins").alias(begins), "equal"))
    df = keyed(df.withColumn(key, F.xxhash64(F.coalesce(F.col(text), F.lit("")))), doc_id, source)
    # of equal rows, the n-th takes the n-th plan; only such rows (and few others by chance) have to be numbered
    df = common.flag_likely(df, F.xxhash64(*keys), plan_.filter("equal > 1"), F.xxhash64(*keys), likely)
    alone = df.filter(~F.col(likely)).join(plan_.filter("equal = 1").drop(nth, "equal"), keys)
    several = df.filter(F.col(likely)).withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) - F.lit(1).cast("bigint"))
    several = several.join(plan_.drop("equal"), [*keys, nth]).drop(nth)
    out = alone.unionByName(several).withColumn(at, F.explode(begins))
    return out.orderBy(at, doc_id).drop(*keys, likely, begins, at)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.same_columns(common.documents(spark, sf_dir), ["doc_id", "text", "source"])
    out = mix(docs).withColumn("position", F.get("begins", F.lit(0)))
    out = out.orderBy("position", "doc_id")
    return out.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS draw,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 5.0e0 WHEN 1 THEN 2.0e0 ELSE 1.0e0 END AS w FROM ranked
), capped AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, k) AS r FROM weighed
), shares AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM ranked) AS DOUBLE) - coalesce(sum(CAST(3 * source_size AS DOUBLE)) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
            / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) AS level
  FROM capped
), stop AS (
  SELECT min(r) AS r FROM shares WHERE level * w <= 3 * source_size
), targets AS (
  SELECT s.source, s.k, s.source_size,
         CASE WHEN s.r < stop.r THEN CAST(3 * s.source_size AS DOUBLE) ELSE (SELECT t.level FROM shares t, stop u WHERE t.r = u.r) * s.w END AS target
  FROM shares s, stop
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.k,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE least(greatest(CAST(floor((target - start - CAST(size AS DOUBLE) / 2) / source_size) AS BIGINT) + 1, 0), 3) END AS copies,
         start / target AS share
  FROM placed
)
SELECT doc_id, size, source_size, target, taken, round(position_raw, 9) AS position FROM (
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
       CASE WHEN copies = 0 THEN NULL WHEN k % 3 = 1 THEN share
            WHEN k % 3 = 0 THEN
              CASE WHEN share >= 0.625 THEN 0.5 + (-1.0 + sqrt(greatest(1.0 * 1.0 + 2 * -1.0 * (share - 0.625), 0.0))) / -1.0
                   ELSE 0.0 + (-1.5 + sqrt(greatest(1.5 * 1.5 + 2 * -1.0 * (share - 0.0), 0.0))) / -1.0 END
            ELSE
              CASE WHEN share >= 0.375 THEN 0.5 + (-1.0 + sqrt(greatest(1.0 * 1.0 + 2 * 1.0 * (share - 0.375), 0.0))) / 1.0
                   ELSE 0.0 + (-0.5 + sqrt(greatest(0.5 * 0.5 + 2 * 1.0 * (share - 0.0), 0.0))) / 1.0 END
       END AS position_raw
FROM taken)
"""
