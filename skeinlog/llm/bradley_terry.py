"""Quality scores by Bradley-Terry ranking.

Of a pair of documents, one labelled good and one bad, the good one is preferred. A document's score
is a weighted sum of features: ratios of what its text is made of, and the shares of its words in hash
buckets. The weights minimise the logistic loss on the feature differences of the pairs. The threshold
is the quantile of the labelled documents' scores at the share of bad ones, and the probability
returned is the logistic function of the score above it.

Every labelled document takes part. Up to `at_once` of them are fitted at once (fit), each paired with all of the other
label. More are dealt by a hash to blocks of about `block`, and every document meets all of the
other label in its block; a round of Newton's method is a Spark job that sums the blocks' gradients and Hessians. Blocks
are so few that each holds both labels but by a chance of e^-16; where one label is too rare for that, its documents go to
every block. The threshold is an order statistic of all scores, found by counting. What
reaches the driver is sums of fixed size. Every document is scored.

Defined results: a null or empty text has the features of no words and is scored like others; whole
texts count, however long; labels that are null or not 0 or 1, of a null doc_id or without a document
are left out; a document labelled twice, or labelled rows that repeat a doc_id, count as often as they
meet; equal texts have equal scores, and a score of exactly 0.5 is above the threshold; without two
kinds of labels every score is the share of good labels, or 0.5 without any; extra columns are left
out, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .text_stats import text_stats

#: Labelled documents that are fitted at once, and those of a block where there are more.
AT_ONCE, BLOCK = 2_000, 1_000
#: Copies of sums that reach the driver, and bins that the scores are counted in at a time.
LANES, BINS = 8, 4096
BUCKETS = 64


def features() -> dict[str, Column]:
    """Bounded features of the columns of text_stats."""
    c = F.col

    def share(a: Column, b: Column, most: float = 1.0) -> Column:
        return F.least(F.coalesce(F.try_divide(a, b), F.lit(0.0)), F.lit(most)).cast("double")

    n = c("n_words")
    return {
        "symbols": share(c("n_symbols"), n),
        "letters": share(c("n_upper") + c("n_lower") + c("n_wide"), c("word_chars")),
        "upper": share(c("n_upper"), c("n_upper") + c("n_lower")),
        "bangs": share(c("n_bangs"), n),
        "pipes": share(c("n_pipes"), n),
        "digits": share(c("n_digits"), c("word_chars")),
        "distinct": share(c("n_distinct"), F.sqrt(n * F.least(n, F.lit(400))), 1.2),
        "stutter": share(c("n_stutter"), n),
        "repeats": share(c("n_repeat_words"), n),
        "same_lines": share(c("n_dup_lines"), c("n_lines")),
        "stops": share(c("n_stops"), n, 0.5),
        "word_length": share(c("word_chars"), n, 12.0),
        "long": F.least(F.log1p(n) / 10, F.lit(1.0)),
        "blank": (n == 0).cast("double"),
    }


@dataclass
class Ranking:
    """score = weights . (features - center) / scale; threshold: the score of an even chance."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.center) / self.scale * self.weights).sum(axis=1)  # in one order, so equal rows score equal


def pair_sums(z: np.ndarray, good: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of all pairs of a good and a bad row of z: the sums of their gradients and Hessians, and how many they are."""
    up, down, width = z[good], z[~good], len(w)
    out = np.zeros(width + width * width + 1)
    for i in range(0, len(up), 1024):  # so that the pairs of many rows are not all in memory
        u = up[i : i + 1024]
        lose = 1 / (1 + np.exp(np.clip((u @ w)[:, None] - down @ w, -500, 500)))
        h = lose * (1 - lose)
        cross = u.T @ (h @ down)
        out[:width] += down.T @ lose.sum(axis=0) - u.T @ lose.sum(axis=1)
        out[width:-1] += ((u.T * h.sum(axis=1)) @ u + (down.T * h.sum(axis=0)) @ down - cross - cross.T).ravel()
        out[-1] += lose.size
    return out


def newton(sums: Callable[[np.ndarray], np.ndarray], width: int, ridge: float, rounds: int) -> np.ndarray:
    """The weights at rest; sums(w) are the pair_sums() of all pairs."""
    w = np.zeros(width)
    for _ in range(rounds):
        total = sums(w)
        if not total[-1]:
            break
        gradient = total[:width] / total[-1] + ridge * w
        step = np.linalg.solve(total[width:-1].reshape(width, width) / total[-1] + ridge * np.eye(width), gradient)
        step *= min(1, 5 / max(np.abs(step).max(), 1e-9))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray, opponents: int | None = None, ridge: float = 1e-3, rounds: int = 50) -> Ranking:
    """Newton's method on the pairs' logistic loss: all pairs, or so many drawn for each of the rarer label."""
    share = float(good.mean()) if len(good) else 0.5
    center, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    model = Ranking(center, scale, np.zeros(x.shape[1]), -float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if not len(x) or not 0 < share < 1:
        return model
    z = (x - center) / scale
    if opponents is None:
        model.weights = newton(lambda w: pair_sums(z, good, w), x.shape[1], ridge, rounds)
        model.threshold = float(np.quantile(z @ model.weights, 1 - share))
        return model
    up, down = z[good], z[~good]
    k = opponents * min(len(up), len(down))
    draw = np.random.default_rng(0)
    fair = [np.arange(k) % len(s) if len(s) == min(len(up), len(down)) else draw.integers(0, len(s), k) for s in (up, down)]
    d = up[fair[0]] - down[fair[1]]
    w = model.weights
    for _ in range(rounds):
        lose = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        gradient = -(d * lose[:, None]).mean(axis=0) + ridge * w
        hessian = (d * (lose * (1 - lose))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        step *= min(1, 5 / max(np.abs(step).max(), 1e-9))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    model.threshold = float(np.quantile(z @ w, 1 - share))
    return model


def featured(df: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """doc_id and x, the features of each row: those of features(), then those of content."""
    rows = text_stats(df, text, doc_id, buckets)
    return rows.select("doc_id", F.concat(F.array(*features().values()), F.col("content").cast("array<double>")).alias("x"))


def labelled(rows: DataFrame, labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """x, good and draw, a hash, of every labelled row."""
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).cast("bigint").alias("doc_id"), (F.col(label) == 1).alias("good"))
    return rows.join(known, "doc_id").withColumn("draw", F.pmod(F.xxhash64("doc_id", "good", "x"), F.lit(1 << 40)))


def drawn(rows: DataFrame, labels: DataFrame, doc_id: str, label: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of sample labelled rows, or of all if they are fewer. Where there are more, a hash of the row thins
    them out before they are sorted by it, so that what is sorted and sent to the driver is of fixed size. rank() asks for all."""
    got = labelled(rows, labels, doc_id, label)
    n = got.count()
    if n > sample:
        got = got.filter(F.col("draw") <= int((1 << 40) * min(1.0, 1.05 * sample / n)))
    table = got.orderBy("draw", "doc_id", "good").limit(sample).select("x", "good").toArrow()
    good = np.array(table.column("good").to_pylist(), bool)
    return np.array(table.column("x").to_pylist(), float), good


def matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float)


def summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """part(x, good) of each block, added up; rows (block, good, x), those of a block in a row. Tasks add theirs, then
    LANES tasks what the others have."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last, held = np.zeros(size), None, []

        def end() -> None:
            if held:
                total[:] += part(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch in batches:
            block, x = batch.column(0).to_numpy(), matrix(batch.column(2), batch.num_rows)
            good = batch.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for i, j in zip(edges, edges[1:]):
                if i < j and block[i] != last:
                    end()
                    last, held = block[i], []
                held.append((x[i:j], good[i:j]))
        end()
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["task", "total"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros(size), None
        for batch in batches:
            for task, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = task if first is None else first
                total += np.frombuffer(blob)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["task", "total"])

    form = "task int, total binary"
    with common.small_batches(rows.sparkSession):
        sums = common.map_arrow(rows, add, form).repartition(LANES, F.col("task") % LANES).sortWithinPartitions("task")
        return sum((np.frombuffer(r["total"]) for r in sorted(common.map_arrow(sums, merge, form).collect())), np.zeros(size))


def order_statistics(scores: DataFrame, at: list[int]) -> list[float]:
    """Of scores (s, without nulls) those at these places of the ascending order; the rows are counted in bins of values."""
    out = []
    for k in at:
        low, high = scores.agg(F.min("s"), F.max("s")).first()
        while low < high:
            width = (high - low) / BINS
            place = F.least(F.floor((F.col("s") - low) / width), F.lit(BINS - 1)) if width > 0 else F.col("s")
            bins = scores.filter(F.col("s").between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
            below = scores.filter(F.col("s") < low).count()
            for b in bins.orderBy("bin").collect():  # BINS rows at most
                if k < below + b["n"]:
                    low, high = b["low"], b["high"]
                    break
                below += b["n"]
        out.append(low)
    return out


def fit_blocks(got: DataFrame, n: int, n_good: int, block: int, ridge: float = 1e-3, rounds: int = 50) -> Ranking:
    """fit() on all pairs within blocks of the rows of labelled()."""
    rarer, share = min(n_good, n - n_good), n_good / n
    width = len(got.select("x").first()["x"])
    whole = rarer < 16 * max(1, n // block) and rarer <= block  # of few rows of a label each goes to every block
    blocks = max(1, n // block if whole else min(n // block, rarer // 16))
    by_hash = F.array(F.pmod(F.col("draw"), F.lit(blocks)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    places = F.when(F.col("good") == F.lit(n_good == rarer), every).otherwise(by_hash) if whole else by_hash
    dealt = got.select(F.explode(places).alias("block"), "good", "x").repartition(common.partitions(got.sparkSession), "block").sortWithinPartitions("block")
    rows, got = common.store(dealt), got.select("good", "x")
    column = lambda i: F.get("x", F.lit(i))
    moments = got.agg(F.array(*(F.avg(column(i)) for i in range(width))), F.array(*(F.stddev_pop(column(i)) for i in range(width)))).first()
    center, scale = np.array(moments[0]), np.maximum(np.array(moments[1]), 1e-3)
    w = newton(lambda w: summed(rows, lambda x, good: pair_sums((x - center) / scale, good, w), width + width**2 + 1), width, ridge, rounds)
    model = Ranking(center, scale, w, 0.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.scores(matrix(batch.column(0), batch.num_rows)))], names=["s"])

    scores = common.store(common.map_arrow(got.select("x"), score, "s double"))
    place = (n - 1) * (1 - share)
    low, high = order_statistics(scores, [int(place), min(int(place) + 1, n - 1)])
    model.threshold = low + (high - low) * (place - int(place))
    return model


def rank(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", at_once: int = AT_ONCE, opponents: int | None = None, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """doc_id and score of each row of df; labels (doc_id, label) are those to learn from."""
    rows = common.store(featured(df, text, doc_id, buckets))
    got = labelled(rows, labels, doc_id, label)
    n, n_good = got.agg(F.count("*"), F.count_if("good")).first()
    if n > at_once and 0 < n_good < n:
        model = fit_blocks(common.store(got.select("good", "x", "draw")), n, n_good, block)
    elif n > at_once:  # without two kinds of labels the features teach nothing
        model = fit(np.zeros((1, len(features()) + buckets)), np.array([n_good > 0]))
    else:
        x, good = drawn(rows, labels, doc_id, label, at_once)
        model = fit(x if len(x) else np.zeros((0, len(features()) + buckets)), good, opponents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            score = 1 / (1 + np.exp(-np.clip(model.scores(flat) - model.threshold, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return common.map_arrow(rows, run, "doc_id bigint, score double")


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.same_columns(common.documents(spark, sf_dir), ["doc_id", "text"])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(common.fold(F.col("doc_id"), 3) != 1)
    out = rank(docs, labels)
    return out.select("doc_id", (common.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
