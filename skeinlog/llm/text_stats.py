"""Counts of a text that quality rules and scores are made of."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Of a text: words, code points in words, characters of [#*$%&|<>], lines equal to an earlier one, words in
#: repeated 5-word windows, distinct words, words equal to the word before, and code points that are A-Z, a-z,
#: 0-9, not ASCII, "!", "|", or one of ".!?"; lines with a word.
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_stutter", "n_upper", "n_lower", "n_digits", "n_wide", "n_bangs", "n_pipes", "n_stops", "n_lines")
WINDOW = 5


def repeated_words(ids: np.ndarray, kinds: int, window: int = WINDOW) -> int:
    """Words in windows that are found twice or more; ids: the words as numbers below kinds."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key, size = ids[:n], kinds
    for i in range(1, window):
        if size > (1 << 62) // kinds:  # number the prefixes anew, so that keys stay exact
            key, size = np.unique(key, return_inverse=True)[1], n
        key, size = key * kinds + ids[i : i + n], size * kinds
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    step = np.zeros(len(ids) + 1, np.int64)
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return int(np.count_nonzero(np.cumsum(step)))


def stats(text: bytes) -> tuple[int, ...]:
    """The counts named in NAMES of a UTF-8 text."""
    if not text:
        return (0,) * len(NAMES)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    points = len(text) - int(seen[0x80:0xC0].sum())
    return (
        len(words), points - int(seen[9:14].sum() + seen[32]), int(seen[list(b"#*$%&|<>")].sum()), len(lines) - len(set(lines)), repeated_words(ids, len(numbers)),
        len(numbers), int(np.count_nonzero(ids[1:] == ids[:-1])), int(seen[65:91].sum()), int(seen[97:123].sum()), int(seen[48:58].sum()), int(seen[0xC0:].sum()),
        int(seen[33]), int(seen[124]), int(seen[list(b".!?")].sum()), len(lines),
    )


def content(text: bytes, buckets: int) -> np.ndarray:
    """The share of a text's words, A-Z lower-cased, in each of that many hash buckets of words."""
    seen: dict[bytes, int] = {}
    for w in text.lower().split():
        seen[w] = seen.get(w, 0) + 1
    at = np.fromiter(map(zlib.crc32, seen), np.int64, len(seen)) % buckets
    n = np.bincount(at, np.fromiter(seen.values(), float, len(seen)), buckets)
    return (n / max(n.sum(), 1)).astype(np.float32)


def text_stats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = 0) -> DataFrame:
    """doc_id and the counts of each text (null: empty), with buckets also its content as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = np.array([stats(t) for t in texts], np.int64).reshape(-1, len(NAMES))
            cols = [batch.column(0), *(pa.array(rows[:, i]) for i in range(len(NAMES)))]
            if buckets:
                flat = np.concatenate([content(t, buckets) for t in texts]) if texts else np.zeros(0, np.float32)
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * buckets, pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *NAMES, *["content"] * bool(buckets)])

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return common.map_arrow(rows, run, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in NAMES) + ", content array<float>" * bool(buckets))
