"""Word shingles as sorted sets of 64-bit hashes."""

from __future__ import annotations

import struct

import numpy as np

_M1, _M2, _STEP, _SEED = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash; emptied at limit words, so that it stays small."""

    def __init__(self, limit: int = 150_000):
        import xxhash

        self.digest, self.limit = xxhash.xxh3_64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.digest(word)
        return value


def shingle_sets(texts: list[bytes | None], width: int, words: WordHashes) -> list[np.ndarray]:
    """Of each text: the sorted distinct hashes of its width-word shingles, words being runs of what
    isn't ASCII white space with A-Z lower-cased; a shorter text is one shingle, no words are none."""
    split = [t.lower().split() if t else [] for t in texts]
    counts = [len(w) for w in split]
    flat = np.fromiter((words[w] for ws in split for w in ws), np.uint64, sum(counts))
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(flat) - width + 1), np.uint64)
        for i in range(width):
            rolled = rolled * _STEP + mix(flat[i : i + len(rolled)] + np.uint64(i + 1))
        rolled = mix(rolled)
        out, at = [], 0
        for n in counts:
            if n >= width:
                s = np.sort(rolled[at : at + n - width + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif n:
                h = _SEED + np.uint64(n)
                for x in flat[at : at + n]:
                    h = mix(np.array([h * _STEP + x]))[0]
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a set, as two signed numbers."""
    import xxhash

    return struct.unpack("<qq", xxhash.xxh3_128_digest(s.tobytes()))
