"""Token ids in files compressed by a grammar (Re-Pair), read back as a whole or at any place.

Texts are range-partitioned by doc_id, encoded, and cut into shards of whole documents. A shard repeatedly replaces
its frequent pairs of symbols by new ones: each round counts all pairs, takes the most frequent (up to ROUND_RULES, as
long as there are two-byte symbols), and replaces their occurrences from left to right where they do not overlap. No
pair crosses the end of a document. A shard's file holds its rules, how many ids each symbol stands for, where each
document begins, and the symbols; so the ids of a document, or a few of them, are found by adding up lengths, and only
the symbols that hold them are expanded.

Shards are the rows of a Parquet table (the file as a binary): Spark's committer then makes a shard appear once,
whatever executor wrote it. A file knows its ids before it in its range; the ranges' sums, one row for each, are
broadcast.

File, little-endian: `SKRP`, version (u16), symbol width in bytes (u16), first new symbol (u32), rules (u32), documents
(u32), symbols (u64); then rules (two symbols each), lengths of the rules (u64), first symbol of each document and the
end (u64), symbols.

Encoding: a text is cut at spaces; no token of a byte-level vocabulary crosses from one such chunk to the next unless
white space follows the space and precedes it, and such texts are encoded whole, as are those that hold a special
token. Marks between a word and a space are cut off too, and so is a line break between two other characters. Each
distinct chunk is encoded by the library once per worker, as long as the worker's table remembers it; one that is a
word of letters is a single pre-token, which the library's model takes as it is.

Defined results: a null text is empty, an empty text has its end id only; rows of one doc_id come in the order of
their texts' hashes, null doc_ids last; repeated rows are documents of their own; a text of any length is one document
of one shard; extra columns are left out, whatever their names; an empty table gives no file and no rows.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TOKENIZER = "byte_bpe_50k.json"
END = 2
#: Ids of a shard before it is closed; pairs taken in a round; the least often a pair must occur.
SHARD_IDS, ROUND_RULES, LEAST = 1 << 20, 1 << 14, 6
#: Bytes of text cut at once, chunks given to the library at once, chunks that a worker remembers, and the longest such chunk.
TEXT_BYTES, AT_ONCE, TABLE_CHUNKS, LONG_CHUNK = 8 << 20, 8192, 700_000, 48
HEAD = "<4sHHIIIQ"
#: White space, and what other libraries may take for it, before a space and after it (or the end): such texts are encoded whole.
_WHITE = "[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{180E}\\x{2000}-\\x{200F}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{2060}\\x{3000}\\x{FEFF}]"
WHOLE = f"{_WHITE} (?:{_WHITE}|$)|\\x{{01}}"
#: Marks after a word are a token of their own and get chunks of their own, which have fewer distinct words then. So does
#: a line break with no white space beside it. The apostrophe isn't among the marks: it may begin a token with letters.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
MARKS, APART = f"({LETTERS})([!-&(-/:-@\\[-`{{-~]+)( |$)", "\\1 \x01\\2\\3"
BREAK, BROKEN = f"([^{_WHITE[1:]})\n([^{_WHITE[1:]})", "\\1 \x01\n \x01\\2"
#: Chunks that are one pre-token, and how a byte-level vocabulary writes the bytes of UTF-8 that aren't printed as they are.
WORD = re.compile(f" ?{LETTERS}+")
BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lengths[i]] for each i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class Chunks:
    """The ids of distinct chunks as bytes, in two generations: what is not met while one fills is forgotten."""

    def __init__(self, tokenizer, limit: int = TABLE_CHUNKS):
        self.tokenizer, self.limit = tokenizer, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        cut, added = tokenizer.pre_tokenizer, tokenizer.get_added_tokens_decoder().values()
        plain = type(cut).__name__ == "ByteLevel" and cut.use_regex and not cut.add_prefix_space and tokenizer.normalizer is None
        self.direct = plain and not any(WORD.fullmatch(t.content) for t in added)

    def _encode(self, new: list[str]) -> list[bytes]:
        """By the library: words of letters by its model, others some at a time, as what it returns for one is a kilobyte."""
        out: list[bytes] = [b""] * len(new)
        rest, tokenize = [], self.tokenizer.model.tokenize
        for i, c in enumerate(new):
            if self.direct and WORD.fullmatch(c):
                out[i] = array("i", [t.id for t in tokenize(c.encode().decode("latin-1").translate(BYTES))]).tobytes()
            else:
                rest.append(i)
        for at in range(0, len(rest), AT_ONCE):
            some = rest[at : at + AT_ONCE]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([new[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = array("i", e.ids).tobytes()
        return out

    def ids(self, chunks: list[str]) -> list[bytes]:
        """Of distinct chunks."""
        known, get = self.young, self.old.get
        found = [known.get(c) or get(c) for c in chunks]
        new = [c for c, f in zip(chunks, found, strict=True) if f is None]
        if new:
            made = iter(self._encode(new))
            found = [next(made) if f is None else f for f in found]
        if len(known) + len(chunks) > self.limit // 2:
            self.old, self.young = known, {}
        fits = self.limit - len(self.young)
        self.young.update((c, f) for c, f in zip(chunks[:fits], found[:fits], strict=True) if len(c) <= LONG_CHUNK)
        return found


def worker_chunks(path: str, limit: int = TABLE_CHUNKS) -> Chunks:
    """The table of this Python worker, which serves one task after the other."""
    kept = sys.modules.setdefault("skeinlog_worker_tables", types.ModuleType("skeinlog_worker_tables"))
    if getattr(kept, "key", None) != (path, limit):
        kept.key, kept.chunks = (path, limit), Chunks(load(path), limit)
    return kept.chunks


def encode_texts(chunks: Chunks, texts: pa.Array, specials: tuple[str, ...] = (), end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with the end id, and how many each text has."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    whole = pc.match_substring_regex(texts, WHOLE)
    for s in specials:
        whole = pc.or_(whole, pc.match_substring(texts, s))
    cut = pc.split_pattern(pc.replace_substring_regex(pc.replace_substring_regex(pc.if_else(whole, "", texts), BREAK, BROKEN), MARKS, APART), " ")
    offsets = cut.offsets.to_numpy()
    words = cut.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    at = (offsets - offsets[0]).astype(np.int64)
    names = words.dictionary.to_pylist()
    index = words.indices.to_numpy().astype(np.int64)
    heads = [names[i] for i in index[at[:-1]].tolist()]
    for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
        heads[i] = texts[int(i)].as_py()
    # a word after a space is another chunk than the first word of a text, and what was cut off follows no space; the last entry is the end
    first: dict[str, int] = {}
    index[at[:-1]] = [len(names) + first.setdefault(h, len(first)) for h in heads]
    coded = [*chunks.ids([w[1:] if w[:1] == "\x01" else " " + w for w in names]), *chunks.ids(list(first)), struct.pack("<i", end)]
    flat = np.frombuffer(b"".join(coded), np.int32)
    lengths = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
    starts = np.cumsum(lengths) - lengths
    index = np.insert(index, at[1:], len(coded) - 1)
    counts = np.add.reduceat(lengths[index], at[:-1] + np.arange(n))
    return gather(flat, starts[index], lengths[index]), counts


def _slots(codes: np.ndarray) -> np.ndarray:
    """A place among 2 ** 20 for each code."""
    if codes.dtype == np.uint32:
        return (codes * np.uint32(0x9E3779B1)) >> np.uint32(12)
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def frequent_pairs(pairs: np.ndarray, most: int, least: int) -> np.ndarray:
    """The codes of the most frequent pairs, first the most frequent, then the least code."""
    order = np.sort(pairs)
    edge = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1], [True]]))
    counts = np.diff(edge)
    often = np.flatnonzero(counts >= least)
    return order[edge[often]][np.argsort(-counts[often], kind="stable")[:most]]


def compress(ids: np.ndarray, ends: np.ndarray, base: int, most_symbols: int = 1 << 16, round_rules: int = ROUND_RULES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of documents that end before `ends` to (symbols, rules (n, 2), ends among the symbols). Symbols from base
    on are rules; a rule's sides are older symbols."""
    form, half = (np.uint32, 16) if most_symbols <= 1 << 16 else (np.uint64, 32)
    symbols, ends, rules = ids.astype(form), ends.astype(np.int64), [np.zeros((0, 2), np.int64)]
    count = 0
    while len(symbols) > 1 and base + count < most_symbols:
        codes = symbols[:-1] << form(half) | symbols[1:]
        inside = np.ones(len(codes), bool)
        inside[ends[ends < len(symbols)] - 1] = False
        picked = frequent_pairs(codes[inside], min(round_rules, most_symbols - base - count), least) if inside.any() else codes[:0]
        if not len(picked):
            break
        # a pair whose slot a more frequent one takes waits for the next round
        table = np.full(1 << 20, -1, np.int32)
        table[_slots(picked)[::-1]] = np.arange(len(picked), dtype=np.int32)[::-1]
        rule = table[_slots(codes)]
        hit = np.flatnonzero((rule >= 0) & inside)
        hit = hit[picked[rule[hit]] == codes[hit]]
        # where occurrences overlap, every other one of a run counts
        first = np.concatenate([[True], np.diff(hit) != 1])
        run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        used = np.bincount(rule[hit], minlength=len(picked)) > 0
        number = base + count + np.cumsum(used) - 1
        symbols[hit] = number[rule[hit]].astype(form)
        pairs = picked[used].astype(np.uint64)
        rules.append(np.stack([pairs >> np.uint64(half), pairs & np.uint64((1 << half) - 1)], axis=1).astype(np.int64))
        count += len(pairs)
        stays = np.ones(len(symbols), bool)
        stays[hit + 1] = False
        ends = np.cumsum(stays)[ends - 1]
        symbols = symbols[stays]
    return symbols, np.concatenate(rules), ends


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1))
    return np.array(out, np.uint64)


def write_shard(ids: np.ndarray, counts: np.ndarray, base: int) -> bytes:
    """The file of documents with so many ids each."""
    width = 2 if base < 1 << 16 else 4
    symbols, rules, ends = compress(ids, np.cumsum(counts), base, 1 << 16 if width == 2 else base + (1 << 20))
    form = f"<u{width}"
    head = struct.pack(HEAD, b"SKRP", 1, width, base, len(rules), len(counts), len(symbols))
    first = np.concatenate([[0], ends]).astype("<u8")
    return b"".join([head, rules.astype(form).tobytes(), rule_lengths(rules, base).astype("<u8").tobytes(), first.tobytes(), symbols.astype(form).tobytes()])


class Shard:
    """A file that was read: nothing is expanded until it is asked for."""

    def __init__(self, data: bytes):
        magic, version, width, self.base, rules, docs, symbols = struct.unpack_from(HEAD, data)
        if magic != b"SKRP" or version != 1:
            raise ValueError("not a shard file of this version")
        form, at = f"<u{width}", struct.calcsize(HEAD)
        parts = []
        for count, kind in ((2 * rules, form), (rules, "<u8"), (docs + 1, "<u8"), (symbols, form)):
            parts.append(np.frombuffer(data, kind, count, at).astype(np.int64))
            at += parts[-1].size * np.dtype(kind).itemsize
        self.rules, self.lengths, self.first, self.symbols = parts[0].reshape(-1, 2), *parts[1:]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Their ids: the newest rules are replaced by their sides until none is left."""
        while len(rest := np.flatnonzero(symbols >= self.base)):
            twice = np.ones(len(symbols), np.int64)
            twice[rest] = 2
            at = np.cumsum(twice) - twice
            out = np.repeat(symbols, twice)
            pairs = self.rules[symbols[rest] - self.base]
            out[at[rest]], out[at[rest] + 1] = pairs[:, 0], pairs[:, 1]
            symbols = out
        return symbols

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        out = np.ones(len(symbols), np.int64)
        rest = symbols >= self.base
        out[rest] = self.lengths[symbols[rest] - self.base]
        return out

    def counts(self) -> np.ndarray:
        """Ids of each document."""
        total = np.concatenate([[0], np.cumsum(self.sizes(self.symbols))])
        return np.diff(total[self.first])

    def ids(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Some ids of a document; only the symbols that hold them are expanded."""
        symbols = self.symbols[self.first[doc] : self.first[doc + 1]]
        ends = np.cumsum(self.sizes(symbols))
        total = int(ends[-1]) if len(ends) else 0
        start, stop, _ = slice(start, stop).indices(total)
        if start >= stop:
            return np.zeros(0, np.int64)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        skip = start - (int(ends[a - 1]) if a else 0)
        return self.expand(symbols[a : b + 1])[skip : skip + stop - start]


def write_shards(df: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, end: int = END, shard_ids: int = SHARD_IDS, table_chunks: int = TABLE_CHUNKS) -> DataFrame:
    """Encodes and stores: range, seq (of the shard in it), before (ids before it in its range), n_ids, doc_ids and file."""
    path = path or tokenizer_path()
    tokenizer = load(path)
    base = max(tokenizer.get_vocab_size(with_added_tokens=True), end + 1)
    specials = tuple(sorted({t.content for t in tokenizer.get_added_tokens_decoder().values()}))
    del tokenizer
    form = pa.schema({"range": pa.int32(), "seq": pa.int32(), "before": pa.int64(), "n_ids": pa.int64(), "doc_ids": pa.list_(pa.int64()), "file": pa.binary()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, part = worker_chunks(path, table_chunks), TaskContext.get().partitionId()
        before, seq = 0, 0
        left = (np.zeros(0, np.int32), np.zeros(0, np.int64), [])  # ids, their numbers and doc_ids not yet in a shard

        def shards(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal left, before, seq
            ids, counts, names = left
            ends, at, doc = np.cumsum(counts), 0, 0
            while doc < len(names):
                stop = int(np.searchsorted(ends, at + shard_ids, "left")) + 1
                if stop > len(names) and not last:
                    break
                stop = min(stop, len(names))
                to = int(ends[stop - 1])
                row = {"range": part, "seq": seq, "before": before, "n_ids": to - at, "doc_ids": names[doc:stop], "file": write_shard(ids[at:to], counts[doc:stop], base)}
                yield pa.RecordBatch.from_pylist([row], schema=form)
                before, seq, at, doc = before + to - at, seq + 1, to, stop
            left = (ids[at:], counts[doc:], names[doc:])

        def together() -> Iterator[pa.Table]:
            held, size = [], 0
            for batch in common.pieces(batches):
                held.append(batch)
                size += batch.column(1).nbytes
                if size >= TEXT_BYTES:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
            if held:
                yield pa.Table.from_batches(held)

        for table in together():
            ids, counts = encode_texts(chunks, table.column(1).combine_chunks(), specials, end)
            left = (np.concatenate([left[0], ids]), np.concatenate([left[1], counts]), left[2] + table.column(0).to_pylist())
            del table, ids
            yield from shards(False)
        yield from shards(True)

    rows = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    by = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(common.partitions(df.sparkSession), *by).sortWithinPartitions(*by)
    return common.store(rows.mapInArrow(run, "range int, seq int, before bigint, n_ids bigint, doc_ids array<bigint>, file binary"))


def read_shards(stored: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids, out of the files."""
    sums = stored.groupBy("range").agg(F.sum("n_ids").alias("n"))  # a row for each range of the partitioning
    base = sums.select(F.col("range").alias("_range"), F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    rows = stored.join(F.broadcast(base), F.col("range") == F.col("_range")).select((F.col("_base") + F.col("before")).alias("start"), "doc_ids", "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, names, file in zip(*batch.columns, strict=True):
                shard = Shard(file.as_py())
                counts = shard.counts()
                ids = shard.expand(shard.symbols).astype("<u4")
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                cols = [names.values, pa.array(start.as_py() + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def read_windows(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Random access: wanted (doc_id, at, n) with window, those n ids of each document of that id from at on. Shards
    and requests meet by the shard's place, found through the list of each shard's documents."""
    homes = stored.select("range", "seq", F.posexplode("doc_ids").alias("doc", "doc_id"))
    asked = wanted.select("doc_id", F.col("at").cast("bigint").alias("at"), F.col("n").cast("bigint").alias("n")).join(homes, "doc_id")
    rows = asked.join(stored.select("range", "seq", "file"), ["range", "seq"]).sortWithinPartitions("range", "seq").select("doc_id", "at", "n", "doc", "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard = None, None
        for batch in batches:
            out = []
            for name, at, n, doc, file in zip(*batch.columns, strict=True):
                if last is None or file.as_buffer() != last:
                    last = file.as_buffer()
                    shard = Shard(file.as_py())
                out.append({"doc_id": name.as_py(), "at": at.as_py(), "n": n.as_py(), "window": shard.ids(doc.as_py(), max(0, at.as_py()), max(0, at.as_py() + n.as_py())).tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema({"doc_id": pa.int64(), "at": pa.int64(), "n": pa.int64(), "window": pa.list_(pa.int32())}))

    return rows.mapInArrow(run, "doc_id bigint, at bigint, n bigint, window array<int>")


def op13_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(common.documents(spark, sf_dir)))
