"""SentencePiece encoding and decoding through a table of distinct marked words.

The library replaces spaces by a marker and puts one marker in front of the text. Where no piece of
the vocabulary has a marker after another character, no piece crosses from one marked word (a run of
markers and what follows up to the next marker) to the next, so a text's ids are its words' ids in
order. Each task keeps a table of the distinct marked words it has met: a word is segmented by the
library once, and ids are joined back by position. The table belongs to a task and is emptied
before it would pass `table_words` entries or `table_chars` characters (or the words of one batch of texts), and words go
to the library in slices, so memory is bounded and no word occurrence is ever shuffled. What the caller does not ask for
(decoded texts) is neither made nor remembered.

Defined results: null and empty texts have no ids and decode to the empty text; texts of any length
are encoded whole; repeated rows give repeated results; null ids are ids like others; a row depends on its own text
only, so there are no ties; columns that are not kept are left out, whatever their names, and keeping one that would
clash with a result is an error; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK = "▁"
MODEL = "piece_bpe_32k.model"
TABLE_WORDS = 300_000
#: Characters of the table's words: long words (hashes, links) are remembered in smaller numbers.
TABLE_CHARS = 8 << 20
#: Bytes of texts that are split into words at a time: their words take some ten times as much.
TEXT_BYTES = 1 << 20
#: Words, and about so many characters, that the library gets at once; it returns a list of Python integers for each.
SLICE_WORDS, SLICE_CHARS = 8_192, 1 << 20

_words = re.compile(" *[^ ]+| +").findall


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_vocabulary(sp) -> None:
    """Raises unless no piece has a marker after another character."""
    for i in range(sp.vocab_size()):
        if MARK in sp.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"piece {i} crosses a whitespace marker: the distinct-chunk table would not be exact")


def split_words(text: str) -> list[str]:
    """The marked words of a text, each without its first marker; markers are written as spaces."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    words = text.split(" ")
    if "" in words:
        words = [w[1:] for w in _words(" " + text)]
    return words


def slices(words: list[str], most: int = SLICE_WORDS, chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The words in order, most of them at most at a time, and chars characters but for single longer words."""
    at = size = 0
    for i, w in enumerate(words):
        if i > at and (i - at == most or size + len(w) > chars):
            yield words[at:i]
            at, size = i, 0
        size += len(w)
    if words:
        yield words[at:]


class WordTable:
    """Distinct marked words of a task, with the ids of each (joined by commas, or packed as int32) and, if decoded, its decoded text."""

    def __init__(self, sp, limit: int = TABLE_WORDS, chars: int = TABLE_CHARS, packed: bool = False, decoded: bool = True):
        self.sp, self.limit, self.chars, self.packed, self.decoded, self.mark = sp, limit, chars, packed, decoded, sp.piece_to_id(MARK)
        self.ids: dict[str, str | bytes] = {}
        self.text: dict[str, str] = {}
        self.size = 0

    def add(self, words: set[str]) -> None:
        """Segments and decodes the words that are not in the table."""
        new = list(words - self.ids.keys())
        size = sum(map(len, new))
        if self.ids and (len(self.ids) + len(new) > self.limit or self.size + size > self.chars):
            self.ids.clear(), self.text.clear()
            new, self.size = list(words), 0
            size = sum(map(len, new))
        self.size += size
        for part in slices(new):
            ids = self.sp.encode(part, num_threads=1)
            if "" in part:  # the marker alone: a space that ends the text
                ids[part.index("")] = [self.mark]
            self.ids.update(zip(part, (array("i", x).tobytes() if self.packed else str(x)[1:-1].replace(" ", "") for x in ids), strict=True))
            if self.decoded:
                self.text.update(zip(part, self.sp.decode(ids, num_threads=1), strict=True))


def encode_texts(table: WordTable, texts: list[str | None]) -> list[tuple[str | bytes, int, str | None]]:
    """Of each text: ids joined by commas, or packed, their number, the decoded text (None if the table has none)."""
    words = [split_words(text or "") for text in texts]
    table.add(set().union(*words))
    ids, decoded = table.ids.__getitem__, table.text.__getitem__
    joined = [(b"" if table.packed else ",").join(map(ids, w)) for w in words]
    counts = [len(x) // 4 if table.packed else x.count(",") + 1 if x else 0 for x in joined]
    return list(zip(joined, counts, (" ".join(map(decoded, w)) if table.decoded else None for w in words), strict=True))


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, as_array: bool = True, table_words: int = TABLE_WORDS, table_chars: int = TABLE_CHARS, decoded: bool = True) -> DataFrame:
    """keep's columns, with n_tokens, ids (an array, or decimal ids joined by commas) and, if asked for, decoded."""
    path = path or model_path()
    check_vocabulary(load(path))
    results = ["n_tokens", "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(load(path), table_words, table_chars, packed=as_array, decoded=decoded)
        for batch in batches:
            texts, n = batch.column(len(keep)), batch.num_rows
            at = 0
            while at < n:
                end, size = at, 0
                while end < n and size < TEXT_BYTES:
                    size += len(texts[end].as_buffer() or b"") if texts[end].is_valid else 0
                    end += 1
                ids, counts, plain = zip(*encode_texts(table, texts.slice(at, end - at).to_pylist()), strict=True)
                if as_array:
                    col = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                else:
                    col = pa.array(ids, pa.string())
                made = [pa.array(counts, pa.int64()), col, *[pa.array(plain, pa.string())] * decoded]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, end - at) for c in batch.columns[: len(keep)]), *made], names=[*keep, *results])
                at = end

    kept = [f for f in df.schema.fields if f.name in keep]
    if any(c in results for c in keep):
        raise ValueError(f"keep must not hold {', '.join(results)}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted(kept, key=lambda f: keep.index(f.name)))
    return common.map_arrow(common.same_columns(df, [*keep, text]), run, f"{schema}, n_tokens bigint, ids {'array<int>' if as_array else 'string'}" + ", decoded string" * decoded)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """df with out: the library's decode of each array of ids (null: the empty text)."""
    path = path or model_path()

    def run(series: Iterator) -> Iterator:
        import pandas as pd

        sp = load(path)
        for s in series:
            yield pd.Series(sp.decode([[] if x is None else [int(i) for i in x] for x in s], num_threads=1) if len(s) else [], dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(F.col(ids)))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(common.documents(spark, sf_dir), as_array=False)
    return common.store(coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")))
