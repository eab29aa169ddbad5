"""Quality rules by weak supervision: rules vote or abstain, their accuracies are estimated, and a
document is judged by the posterior probability that it is good instead of having to pass every rule.

Each rule looks at one ratio and knows three answers: good (1) where the ratio is that of ordinary text,
bad (-1) where it is that of a fault, and none (0) in between or where there is too little text to tell.
A rule has two accuracies: the share of bad documents among those it votes on that it calls bad, and the
share of good ones that it calls good. To abstain says nothing. Expectation-maximisation on the counts
of vote patterns, of which there are 3 ** rules at most whatever the number of documents, estimates both
and the share of bad documents. As a fault of one kind says nothing of another, a rule misses most bad
documents, so its good votes weigh little and its bad votes weigh as much as they are seldom wrong:
several good votes can outweigh a bad one, and faint signs of several rules add up.

Defined results: a null or empty text has no words and fails the base rules; where a ratio would divide
by nothing, or a text has under MIN_WORDS words, rules abstain; whole texts count, however long; a
posterior of exactly 0.5 keeps; repeated rows count as often as they occur, null ids are ids like others,
and extra columns are left out, whatever their names; an empty table gives an empty table and the
starting estimates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .text_stats import text_stats

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
START_VOTES = 20


def votes() -> dict[str, Column]:
    """Each rule's vote on the columns of text_stats."""
    c = F.col

    def rule(ratio: Column, good: Callable[[Column], Column], bad: Callable[[Column], Column], asked: Column | bool = True) -> Column:
        enough = (c("n_words") >= MIN_WORDS) & asked
        return F.when(enough & bad(ratio), -1).when(enough & good(ratio), 1).otherwise(0)

    per_word = lambda name: F.try_divide(c(name), c("n_words"))
    cased = c("n_upper") + c("n_lower")
    letters = F.try_divide(cased + c("n_wide") + c("n_digits"), c("word_chars"))
    distinct = F.try_divide(c("n_distinct"), F.sqrt(c("n_words") * F.least(c("n_words"), F.lit(400))))
    between = lambda low, high: lambda r: (r > low) & (r < high)
    below, above = (lambda x: lambda r: r < x), (lambda x: lambda r: r > x)
    return {
        "symbols": rule(per_word("n_symbols"), below(0.02), above(0.1)),
        "pipes": rule(per_word("n_pipes"), below(0.005), above(0.05)),
        "letters": rule(letters, above(0.95), below(0.9)),
        "upper": rule(F.try_divide(c("n_upper"), cased), between(0.005, 0.12), above(0.25)),
        "bangs": rule(per_word("n_bangs"), below(0.02), above(0.2)),
        "stutter": rule(per_word("n_stutter"), below(0.03), above(0.08)),
        "distinct": rule(distinct, above(0.6), below(0.4), c("n_words") >= 50),
        "repeats": rule(per_word("n_repeat_words"), below(0.05), above(0.1)),
        "lines": rule(F.try_divide(c("n_dup_lines"), c("n_lines")), below(0.1), above(0.4), c("n_lines") >= 3),
        "stops": rule(per_word("n_stops"), between(0.03, 0.5), lambda r: (r < 0.01) | (r >= 0.5)),
        "length": rule(per_word("word_chars"), between(3, 8), lambda r: (r > 10) | (r < 2)),
        "short": rule(c("n_words"), lambda r: r >= 40, lambda r: r < 20),
    }


@dataclass
class Model:
    """bad: share of bad documents; caught: of each rule, the share of bad documents it votes on that it calls
    bad; blamed: the share of good ones that it calls bad (1 less these: its accuracy on good documents)."""

    bad: float
    caught: np.ndarray
    blamed: np.ndarray

    @property
    def offset(self) -> float:
        """Log odds of good before any vote."""
        return float(np.log((1 - self.bad) / self.bad))

    @property
    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """What a good and a bad vote of each rule add to the log odds."""
        return np.log((1 - self.blamed) / (1 - self.caught)), np.log(self.blamed / self.caught)

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        for_good, for_bad = self.weights
        return 1 / (1 + np.exp(-np.clip(self.offset + (pattern > 0) @ for_good + (pattern < 0) @ for_bad, -500, 500)))


def fit(pattern: np.ndarray, counts: np.ndarray, rounds: int = 1000) -> Model:
    """Expectation-maximisation. The start, of which each rule's accuracies weigh as START_VOTES votes: one
    document in ten is bad, a rule catches three of ten and blames one good document in a hundred. A rule
    that blames more than one in twenty would not be worth its vote, so blame stays within that."""
    rules = pattern.shape[1]
    caught, blamed = np.full(rules, 0.3), np.full(rules, 0.01)
    model = Model(0.1, caught, blamed)
    said_bad, said = (pattern < 0).astype(float), (pattern != 0).astype(float)
    for _ in range(rounds if counts.sum() else 0):
        good = model.posterior(pattern)
        bad_n, good_n = counts * (1 - good), counts * good
        after = Model(
            float((bad_n.sum() + 1) / (counts.sum() + 10)),
            np.clip((bad_n @ said_bad + START_VOTES * caught) / (bad_n @ said + START_VOTES), 0.001, 0.999),
            np.clip((good_n @ said_bad + START_VOTES * blamed) / (good_n @ said + START_VOTES), 1e-5, 0.05),
        )
        moved = max(abs(after.bad - model.bad), np.abs(after.caught - model.caught).max(), np.abs(after.blamed - model.blamed).max())
        model = after
        if moved < 1e-9:
            break
    return model


def judge(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the counts of text_stats, base_failed, the votes, good (posterior) and kept."""
    rules = votes()
    rows = text_stats(df, text, doc_id)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = common.store(rows.withColumn("base_failed", failed).withColumns({f"vote_{k}": v for k, v in rules.items()}))
    names = [f"vote_{k}" for k in rules]
    code = sum(((F.col(k) + 1) * 3**i for i, k in enumerate(names)), F.lit(0))
    seen = rows.groupBy(code.cast("bigint").alias("code")).agg(F.count("*").alias("n")).orderBy("code").collect()  # 3 ** rules rows at most
    pattern = np.array([[r["code"] // 3**i % 3 - 1 for i in range(len(names))] for r in seen], np.int64).reshape(-1, len(names))
    model = fit(pattern, np.array([r["n"] for r in seen], float))
    logit = F.lit(model.offset)
    for k, for_good, for_bad in zip(names, *(w.tolist() for w in model.weights), strict=True):
        logit = logit + F.when(F.col(k) > 0, for_good).when(F.col(k) < 0, for_bad).otherwise(0.0)
    good = 1 / (1 + F.exp(-logit))
    return rows.withColumn("good", good).withColumn("kept", ~F.col("base_failed") & (F.col("good") >= 0.5))


def op3_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(common.documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("good", 6).alias("good"), *[c for c in rows.columns if c.startswith("vote_")])
