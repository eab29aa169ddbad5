import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from skeinlog.llm import telephony as m


def decode_scalar(block):
    sample, index = int.from_bytes(block[:2], "little", signed=True), block[2] % 89
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = m.IMA_STEPS[index]
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            sample = max(-32768, min(32767, sample - change if code & 8 else sample + change))
            index = max(0, min(88, index + m.IMA_CHANGES[code & 7]))
            out.append(sample)
    return out


def test_adpcm():
    blocks = np.random.default_rng(0).integers(0, 256, (300, 64), dtype=np.uint8)
    assert m.decode_adpcm(blocks).tolist() == [decode_scalar(bytes(b)) for b in blocks]


def test_tables():
    mu, a = m.mulaw_table(), m.alaw_table()
    assert mu[[0x00, 0x80, 0x7F, 0xFF, 0x8F, 0x0F]].tolist() == [-32124, 32124, 0, 0, 16764, -16764]
    assert a[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert (mu[:128] == -mu[128:]).all() and (a[:128] == -a[128:]).all()


def test_waves():
    for data in (b"\x00" * 64, bytes(range(256))):
        for codec in m.CODECS:
            assert m.read_wave(m.wave(data, codec)) == (codec, data)


def test_resample():
    assert m.resample(np.array([1, 4, -3, 8, 100], np.int16)).tolist() == [(1 + 2 + 4 + 2) >> 2, (4 - 6 + 8 + 2) >> 2, (8 + 200 + 100 + 2) >> 2]
    assert m.resample(np.array([-7], np.int16)).tolist() == [-7] and m.resample(np.array([], np.int16)).tolist() == []
    assert m.resample(np.array([32767, 32767, -32768, -32768], np.int16)).tolist() == [32767, -16384]


def test_packed_pcm_is_lossless():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64):
        for codec in m.CODECS:
            pcm = rng.integers(-32768, 32768, n).astype(np.int16)
            assert m.unpack_pcm(m.pack_pcm(pcm, codec), codec).tolist() == pcm.tolist()
            assert len(m.pack_pcm(pcm, codec)) == 2 * n


def test_every_resampled_sample_is_in_the_stored_bytes(docs):
    """The stored columns alone give the samples: two bytes for each, sums of differences for ADPCM, nothing else."""
    for r in m.store_media(docs).collect():
        ((codec, packed),) = [(c, bytes(r[f"pcm_{c}"])) for c in m.CODECS if r[f"pcm_{c}"] is not None]
        words = [int.from_bytes(packed[i : i + 2], "little", signed=True) for i in range(0, len(packed), 2)]
        if codec == "ima_adpcm":
            total, out = 0, []
            for x in words:
                total = (total + x + 32768) % 65536 - 32768
                out.append(total)
            words = out
        assert words == plain_pcm(*m.read_wave(bytes(r["media"])))[1]


def test_round_trip(docs):
    stored = m.store_media(docs)
    assert stored.columns == ["doc_id", "n_bytes", "media", "pcm_mulaw", "pcm_alaw", "pcm_ima_adpcm"]
    rows = m.read_media(stored, tuple(m.OUTPUTS)).withColumn("crc", F.crc32(F.substring("payload", -64, 64))).collect()
    texts = sorted((r["text"] or "").encode() for r in docs.collect())
    assert sorted(bytes(r["payload"])[: r["n_bytes"]] for r in rows) == texts
    features = {}
    for r in rows:
        data = bytes(r["payload"])
        assert len(data) % 64 == 0 and data and not any(data[r["n_bytes"] :]) and len(data) - r["n_bytes"] <= 64
        assert r["crc"] == zlib.crc32(data[-64:])
        (pcm,) = m.decode_batch([(r["codec"], data)])
        stored_pcm = np.frombuffer(bytes(r["pcm"]), "<i2")
        assert stored_pcm.tolist() == m.resample(pcm).tolist()
        assert r["feature"] == m.feature(r["codec"], stored_pcm)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), r["crc"])
        value = (r["feature"], r["media_sha256"])
        assert features.setdefault(data, value) == value


def plain_pcm(codec, data):
    """Decoded and resampled samples, one at a time."""
    if codec == "ima_adpcm":
        pcm = [x for i in range(0, len(data), 64) for x in decode_scalar(data[i : i + 64])]
    else:
        table = (m.mulaw_table() if codec == "mulaw" else m.alaw_table()).tolist()
        pcm = [table[b] for b in data]
    wide = [pcm[0], *pcm, pcm[-1]]
    return pcm, [(wide[i] + 2 * wide[i + 1] + wide[i + 2] + 2) >> 2 for i in range(0, len(pcm), 2)]


def plain_row(doc_id, text):
    """What the query owes for one document, one sample at a time."""
    text = (text or "").encode()
    data = text + bytes(-len(text) % 64 if text else 64)
    codec = m.CODECS[zlib.crc32(data) % 3]
    low = plain_pcm(codec, data)[1]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(low, low[1:]))
    feature = f"{codec};{len(low)};{max(map(abs, low))};{sum(map(abs, low))};{crossings};{zlib.crc32(b''.join(x.to_bytes(2, 'little', signed=True) for x in low))}"
    media = m.wave(data, codec)
    return (doc_id, len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)


def test_query(spark, docs, sf_dir):
    out = m.op5_telephony(spark, sf_dir)
    assert out.columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    want = [plain_row(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


def test_empty_table(no_docs):
    assert m.read_media(m.store_media(no_docs)).collect() == []
