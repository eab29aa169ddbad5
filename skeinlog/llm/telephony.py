"""Media columns of telephony audio: mu-law, A-law and IMA ADPCM in WAVE files.

Coded bytes are stored as they are in a WAVE file, so storing is lossless. Decoding expands mu-law and
A-law by tables of 256 entries, and ADPCM blocks with numpy across blocks: all blocks of a batch take
the same step at once. Decoded 8 kHz PCM is resampled to 4 kHz in integers: a low-pass of (1, 2, 1) / 4, of which
every second sample is kept.

Media and PCM are stored as a table, and all that is reported is read back from it. Every resampled sample
is stored, as it is (mu-law, A-law) or as its difference from the one before (ADPCM), whichever compresses;
in a column for each codec, so that like is stored with like.

An ADPCM block is 64 bytes: a predictor (int16), a step index (taken modulo 89), a reserved byte, and
120 codes of 4 bits, low half first; it decodes to 121 samples, the predictor first.

Defined results: a null text is empty, an empty text is 64 zero bytes; a payload is the UTF-8 bytes
and zero bytes up to a positive multiple of 64; its codec is chosen by its crc32, so equal texts have
equal media; null ids and repeated rows are rows like others, and ties in anything do not matter, since a
row depends on its own text only; a text of any length is one payload, one file and one cell, and works
alone in memory if it is longer than a piece; extra columns are left out, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RATE = 8000
BLOCK = 64
#: WAVE format tags, and the step sizes and index changes of IMA ADPCM.
FORMATS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
CODECS = ("mulaw", "alaw", "ima_adpcm")
IMA_STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
IMA_CHANGES = (-1, -1, -1, -1, 2, 4, 6, 8)
#: Bytes of payload decoded at a time (samples take some fifteen times that), and how the table is written.
PIECE = common.BATCH_BYTES // 4
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": 12, "parquet.page.size": 8 << 20}


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law byte: inverted bits, of which sign, 3 of exponent and 4 of mantissa, with bias 132."""
    code = ~np.arange(256) & 255
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law byte: every other bit inverted; a set sign bit is positive."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """blocks (n, 64) of uint8 to PCM (n, 121)."""
    steps, changes = np.array(IMA_STEPS, np.int32), np.array(IMA_CHANGES * 2, np.int32)
    n = len(blocks)
    out = np.empty((2 * (BLOCK - 4) + 1, n), np.int16)
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = blocks[:, 2].astype(np.int32) % len(IMA_STEPS)
    out[0] = sample
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for i, pair in enumerate(codes):
        for half, code in enumerate((pair & 15, pair >> 4)):
            step = steps[index]
            change = step >> 3
            change += step * (code >> 2 & 1) + (step >> 1) * (code >> 1 & 1) + (step >> 2) * (code & 1)
            sample = np.clip(np.where(code & 8, sample - change, sample + change), -32768, 32767)
            index = np.clip(index + changes[code], 0, len(IMA_STEPS) - 1)
            out[2 * i + half + 1] = sample
    return out.T


def resample(pcm: np.ndarray) -> np.ndarray:
    """Half the rate: of every second sample the mean of its neighbours (at the ends: itself) and twice itself, rounded
    to the nearest, halves up."""
    wide = np.concatenate([pcm[:1], pcm, pcm[-1:]]).astype(np.int32)
    return ((wide[:-2] + 2 * wide[1:-1] + wide[2:] + 2) >> 2)[::2].astype(np.int16) if len(pcm) else pcm


def pack_pcm(pcm: np.ndarray, codec: str) -> bytes:
    """All samples, little-endian; ADPCM's as differences modulo 2 ** 16."""
    return (np.diff(pcm, prepend=np.int16(0)) if codec == "ima_adpcm" else pcm).astype("<i2").tobytes()


def unpack_pcm(packed: bytes, codec: str) -> np.ndarray:
    """The inverse of pack_pcm."""
    samples = np.frombuffer(packed, "<i2").astype(np.int16)
    return np.cumsum(samples, dtype=np.int16) if codec == "ima_adpcm" else samples


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def wave(data: bytes, codec: str) -> bytes:
    """A WAVE file of coded mono samples at 8 kHz."""
    per_block, bits, rate = (BLOCK, 4, RATE * BLOCK // 121) if codec == "ima_adpcm" else (1, 8, RATE)
    extra = struct.pack("<HH", 2, 121) if codec == "ima_adpcm" else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", FORMATS[codec], 1, RATE, rate, per_block, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[str, bytes]:
    """Codec and coded bytes of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
            codec = next(k for k, v in FORMATS.items() if v == tag)
        elif name == b"data":
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAVE file without data")


def decode_batch(coded: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """PCM of each (codec, bytes); the ADPCM blocks of all are decoded together."""
    tables = {"mulaw": mulaw_table(), "alaw": alaw_table()}
    blocks = b"".join(data for codec, data in coded if codec == "ima_adpcm")
    decoded = decode_adpcm(np.frombuffer(blocks, np.uint8).reshape(-1, BLOCK)) if blocks else np.zeros((0, 121), np.int16)
    out, at = [], 0
    for codec, data in coded:
        if codec == "ima_adpcm":
            out.append(decoded[at : at + len(data) // BLOCK].ravel())
            at += len(data) // BLOCK
        else:
            out.append(tables[codec][np.frombuffer(data, np.uint8)])
    return out


def feature(codec: str, pcm: np.ndarray) -> str:
    """Of resampled PCM: codec, samples, peak, sum of magnitudes, sign changes, and the crc32 of the samples; all exact."""
    size = np.abs(pcm.astype(np.int64))
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec};{len(pcm)};{int(size.max(initial=0))};{int(size.sum())};{crossings};{zlib.crc32(pcm.astype('<i2').tobytes())}"


def encode_media(df: DataFrame, text: str = "text", doc_id: str = "doc_id", codecs: tuple[str, ...] = CODECS) -> DataFrame:
    """doc_id, n_bytes, media (the WAVE file that holds the text's payload) and its packed 4 kHz samples in the
    pcm_ column of its codec."""
    columns = [f"pcm_{c}" for c in CODECS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, size=PIECE):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            data = [payload(t) for t in texts]
            coded = [(codecs[zlib.crc32(d) % len(codecs)], d) for d in data]
            packed = [pack_pcm(resample(x), c) for (c, _), x in zip(coded, decode_batch(coded), strict=True)]
            cols = [pa.array([len(t) for t in texts], pa.int64()), pa.array([wave(d, c) for c, d in coded], pa.binary())]
            cols += [pa.array([x if c == own else None for x, (own, _) in zip(packed, coded, strict=True)], pa.binary()) for c in CODECS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_bytes", "media", *columns])

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return common.map_arrow(rows, run, "doc_id bigint, n_bytes bigint, media binary, " + ", ".join(f"{c} binary" for c in columns))


def store_media(df: DataFrame, text: str = "text", doc_id: str = "doc_id", codecs: tuple[str, ...] = CODECS) -> DataFrame:
    """encode_media's table, stored and read again."""
    return common.store(encode_media(df, text, doc_id, codecs), **STORED)


OUTPUTS = {
    "codec": "string", "payload": "binary", "feature": "string", "pcm": "binary", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint",
    "media_bytes": "bigint", "media_sha256": "string",
}


def read_media(stored: DataFrame, outputs: tuple[str, ...] = ("codec", "payload", "feature")) -> DataFrame:
    """doc_id, n_bytes and, read out of the stored files and samples, any of OUTPUTS: codec, payload, feature (of the
    PCM), pcm (little-endian 16-bit samples at 4 kHz), and sizes and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, size=PIECE):
            files = batch.column(2).to_pylist()
            coded = [read_wave(x) for x in files]
            packed = {c: col.to_pylist() for c, col in zip(CODECS, batch.columns[3:], strict=True)}
            pcm = [unpack_pcm(packed[c][i], c) for i, (c, _) in enumerate(coded)]
            make = {
                "codec": lambda: [c for c, _ in coded],
                "payload": lambda: [d for _, d in coded],
                "feature": lambda: [feature(c, x) for (c, _), x in zip(coded, pcm, strict=True)],
                "pcm": lambda: [x.astype("<i2").tobytes() for x in pcm],
                "payload_bytes": lambda: [len(d) for _, d in coded],
                "payload_sha256": lambda: [hashlib.sha256(d).hexdigest() for _, d in coded],
                "tail_crc32": lambda: [zlib.crc32(d[-BLOCK:]) for _, d in coded],
                "media_bytes": lambda: [len(x) for x in files],
                "media_sha256": lambda: [hashlib.sha256(x).hexdigest() for x in files],
            }
            types = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(make[k](), types[OUTPUTS[k]]) for k in outputs)], names=["doc_id", "n_bytes", *outputs])

    rows = common.same_columns(stored, ["doc_id", "n_bytes", "media", *(f"pcm_{c}" for c in CODECS)])
    return common.map_arrow(rows, run, "doc_id bigint, n_bytes bigint, " + ", ".join(f"{k} {OUTPUTS[k]}" for k in outputs))


def op5_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_media(common.documents(spark, sf_dir))
    return read_media(stored, ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"))
