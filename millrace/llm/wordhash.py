"""Words of many texts at a time, as codes of a dictionary, and 64-bit hashes of words and of runs of words.

Arrow cuts a batch of texts into words and numbers the different ones, so codes compare exactly. A word's hash is
XXH3 of its bytes, taken once for each different word. The hash of a run is a polynomial in the hashes of its
words, from prefix sums modulo 2**64, and then mixed. No Python runs per word of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 in which each bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 18)
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def chunks(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters; a longer text is a range of its own."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def words(texts: list[str] | pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words in order, the words that they stand for, and where each text's words begin (one more
    than texts). lower: A-Z only."""
    array = pa.array(texts, type=pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(array) if lower else array)
    begins = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, different = np.asarray(coded.indices), coded.dictionary
    none = pc.index(different, pa.scalar("", pa.large_string())).as_py()
    if none >= 0:  # before a leading and after a trailing blank
        keep = codes != none
        begins = np.concatenate([[0], np.cumsum(keep)])[begins]
        codes = codes[keep]
    return codes, different, begins


def hashes(different: pa.Array) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(w) for w in different.cast(pa.large_binary()).to_pylist()]), dtype=">u8").astype(np.uint64)


def runs(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the words values[lo:hi] for each pair."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k words in a row (texts' edges are the caller's)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    lo = np.arange(n)
    return runs(values, lo, lo + k)


def shingles(texts: list[str], k: int = 5, lower: bool = False) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of k words in a row; of all its words if they are fewer."""
    codes, different, begins = words(texts, lower)
    values = hashes(different)[codes]
    all_runs, out = grams(values, k), []
    for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(all_runs[lo : hi - k + 1]))
        else:
            out.append(grams(values[lo:hi], hi - lo) if hi > lo else all_runs[:0])
    return out
