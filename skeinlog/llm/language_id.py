"""Language ID by n-gram filters whose entries are bitmasks of languages.

Learning counts the letter trigrams of each language (a word's start and end count as letters) over
all documents to learn from. Every trigram of a language, however rare, goes into a bit-sliced Bloom
filter: a slot is a mask with a bit for each language, and the AND of a trigram's slots names all
languages that contain it. So that a stray trigram does not weigh as much as a common one, a language
has a bit for each of LEVELS: the first for all its trigrams, the next for those that are at least such
a share of them, and so on.

A text's trigrams are looked up, the bits of each language and level are counted, and each count is
corrected for the rate of false positives, which follows from how full the slice is. A language's
score is the mean of its corrected shares over the levels; the highest wins, the first by code point
among equals.

The filter is built by the executors, slice by slice, and only it reaches the driver and is broadcast. It
has SLOTS_PER_GRAM slots for each trigram of the richest language, but no more than FILTER_BYTES; what
that costs is false positives, which are corrected for, and no trigram.

Defined results: a null text, and a text without a letter, is `und` with score 0, and so is every
text if nothing was learned; whole texts count, however long; rows without a language teach nothing;
repeated rows count as often as they occur; null ids are ids like others; columns that are not kept are left out,
whatever their names, and those that are kept should not be called lang_pred or score; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import mix

#: The least share of its language's trigrams that a trigram of each level has.
LEVELS = (0.0, 1e-6, 1e-5, 1e-4, 1e-3)
HASHES = 4
SLOTS_PER_GRAM = 16
FILTER_BYTES = 64 << 20
SLICES = 64
MAX_LANGUAGES = 2000


def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None, is_letter: np.ndarray) -> np.ndarray:
    """The letter trigrams of a text as numbers: three code points of 21 bits, 0 for a word's start or end."""
    if not text:
        return np.zeros(0, np.uint64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.concatenate(([0], np.where(is_letter[code], code, 0), [0])).astype(np.uint64)
    code = code[np.concatenate(([True], (code[1:] != 0) | (code[:-1] != 0)))]  # one gap between words
    if len(code) < 3:
        return np.zeros(0, np.uint64)
    grams = code[:-2] << np.uint64(42) | code[1:-1] << np.uint64(21) | code[2:]
    return grams[code[1:-1] != 0]


def count_trigrams(rows: DataFrame) -> DataFrame:
    """rows (lang, text) to lang, gram, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = letter_table()
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(trigrams(text, is_letter))
            for lang, found in by_lang.items():
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return common.map_arrow(rows, run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Filter:
    """langs by code point; slots: masks (words, number of slots), in which bit language * levels + level is set;
    wrong: rate of false positives by language and level."""

    langs: list[str]
    slots: np.ndarray
    wrong: np.ndarray

    @classmethod
    def of(cls, langs: list[str], slots: np.ndarray) -> Filter:
        wrong = np.zeros((len(langs), len(LEVELS)))
        for i, level in np.ndindex(wrong.shape):
            wrong[i, level] = (np.count_nonzero(bits(slots, i, level)) / slots.shape[1]) ** HASHES
        return cls(langs, slots, wrong)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """The languages and levels that contain each trigram: (words, trigrams)."""
        out = None
        for at in places(grams, self.slots.shape[1]):
            found = self.slots[:, at]
            out = found if out is None else out & found
        return out

    def scores(self, grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each text (its trigrams are grams[start:end], not none, the texts in a row) the score by language."""
        masks, out = self.masks(grams), np.zeros((len(starts), len(self.langs)))
        for i, level in np.ndindex(self.wrong.shape):
            raw = np.add.reduceat(bits(masks, i, level).astype(np.int32), starts) / (ends - starts)
            wrong = self.wrong[i, level]
            out[:, i] += np.clip((raw - wrong) / (1 - wrong), 0, 1) if wrong < 1 else raw
        return out / len(LEVELS)


def word_type(bits_needed: int) -> np.dtype:
    """The least unsigned type that has so many bits, or 64 of them."""
    return np.dtype(f"u{next((n for n in (1, 2, 4) if bits_needed <= 8 * n), 8)}")


def bits(masks: np.ndarray, lang: int, level: int) -> np.ndarray:
    """One language's bits of one level."""
    width = 8 * masks.dtype.itemsize
    at = lang * len(LEVELS) + level
    return masks[at // width] >> masks.dtype.type(at % width) & masks.dtype.type(1)


def places(grams: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The slots of each trigram, one hash after another."""
    with np.errstate(over="ignore"):
        first = mix(grams + np.uint64(0x9E3779B97F4A7C15))
        second = first >> np.uint64(32) | np.uint64(1)
        for i in range(HASHES):
            yield ((first + np.uint64(i) * second) & np.uint64(size - 1)).astype(np.int64)


def build_filter(counts: DataFrame, langs: DataFrame, n_langs: int, size: int) -> np.ndarray:
    """The slots of a filter: counts (lang, gram, n), langs (lang, k, total). Each task fills slices of the filter."""
    dtype = word_type(n_langs * len(LEVELS))
    width = 8 * dtype.itemsize
    words, step = -(-n_langs * len(LEVELS) // width), size // SLICES

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, gram, share = (c.to_numpy() for c in batch.columns)
            first = k.astype(np.int64) * len(LEVELS)
            level = np.searchsorted(np.array(LEVELS), share, side="right") - 1
            for at in places(gram.view(np.uint64), size):
                yield pa.RecordBatch.from_arrays([pa.array((at // step).astype(np.int32)), pa.array((at % step).astype(np.int32)), pa.array(first.astype(np.int32)), pa.array((first + level).astype(np.int32))], names=["slice", "at", "first", "last"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            which, at, first, last = (c.to_numpy() for c in batch.columns)
            for s in np.unique(which).tolist():
                own = slices.setdefault(s, np.zeros((words, step), dtype))
                here = which == s
                for level in range(len(LEVELS)):  # a trigram of a level is one of all lower levels
                    bit = first[here] + level
                    has = bit <= last[here]
                    np.bitwise_or.at(own, (bit[has] // width, at[here][has]), np.left_shift(dtype.type(1), (bit[has] % width).astype(dtype)))
        if slices:
            yield pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int32()), pa.array([x.tobytes() for x in slices.values()], pa.binary())], names=["slice", "masks"])

    shares = counts.join(F.broadcast(langs), "lang").select("k", "gram", (F.col("n") / F.col("total")).alias("share"))  # a row per language
    placed = common.map_arrow(shares, place, "slice int, at int, first int, last int").repartition(min(SLICES, common.partitions(counts.sparkSession)), "slice")
    out = np.zeros((SLICES, words, step), dtype)
    for r in common.map_arrow(placed, fill, "slice int, masks binary").collect():  # FILTER_BYTES at most
        out[r["slice"]] = np.frombuffer(r["masks"], dtype).reshape(words, step)
    return out.transpose(1, 0, 2).reshape(words, size)


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", filter_bytes: int = FILTER_BYTES) -> Filter:
    """A filter of the rows' languages (MAX_LANGUAGES at most, else an error)."""
    spark = rows.sparkSession
    counts = common.store(count_trigrams(rows.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).limit(MAX_LANGUAGES + 1).collect()  # a row per language
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    totals.sort(key=lambda r: r["lang"].encode())
    per_slot = -(-len(totals) * len(LEVELS) // 8) or 1
    want = max([r["kinds"] for r in totals], default=1) * SLOTS_PER_GRAM
    size = max(SLICES, min(1 << int(np.ceil(np.log2(want))), 1 << int(np.floor(np.log2(filter_bytes / per_slot)))))
    langs = spark.createDataFrame([(r["lang"], k, r["total"]) for k, r in enumerate(totals)], "lang string, k int, total bigint")
    slots = build_filter(counts, langs, len(totals), size) if totals else np.zeros((1, size), np.uint8)
    common.drop_stored(counts)
    return Filter.of([r["lang"] for r in totals], slots)


def identify(df: DataFrame, model: Filter, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, lang_pred and score of each row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # FILTER_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, filters = letter_table(), shared.value
        names = np.array([*filters.langs, "und"], object)
        for batch in batches:
            found = [trigrams(t, is_letter) for t in batch.column(len(keep)).to_pylist()]
            counts = np.array([len(x) for x in found], np.int64)
            ends = np.cumsum(counts)
            some = np.flatnonzero(counts) if filters.langs else np.zeros(0, np.int64)
            pick, score = np.full(len(found), len(filters.langs)), np.zeros(len(found))
            step = 256  # texts at a time
            for part in (some[i : i + step] for i in range(0, len(some), step)):
                first = (ends - counts)[part[0]]
                scores = filters.scores(np.concatenate(found[part[0] : part[-1] + 1]), (ends - counts)[part] - first, ends[part] - first)
                pick[part] = scores.argmax(axis=1)
                score[part] = scores.max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names[pick].tolist(), pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return common.map_arrow(common.same_columns(df, [*keep, text]), run, ", ".join(f"`{k}` {types[k]}" for k in keep) + ", lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = common.fold(F.col("doc_id"), 4) == 2
    model = learn(docs.filter(~held_out))
    return common.store(identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))
