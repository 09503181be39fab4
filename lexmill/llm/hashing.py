"""Vectorised 64-bit hashes of words and byte strings by prefix sums, all modulo 2**64.

Such sums are only sound for short strings: differences in the order of the Thue-Morse sequence lose a factor 2**k more
with each doubling to 2**k bytes, and vanish at 1024. Strings that can be longer than PLAIN bytes are named by ``digests``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
#: A random odd number for each byte value.
BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Longer strings are not named by sums.
PLAIN = 32
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers before each position; length ``len(data) + 1``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data))[0], out=sums[1:])
    return sums


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``data[start:end]``, equal for equal strings at any place."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of ``data[start:end]`` by a cryptographic hash, equal for equal strings at any place."""
    held = memoryview(np.ascontiguousarray(data))
    found = b"".join([hashlib.blake2b(held[a:b], digest_size=8).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(found, np.uint64)


def text_blocks(texts: pa.Array, size: int = 1 << 20):
    """(first row, last row, bytes, cuts) of successive texts of about ``size`` bytes; cuts are offsets into the bytes."""
    texts = texts.cast(pa.binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        low, high = int(offsets[first]), int(offsets[last])
        yield first, last, data[low:high], (offsets[first : last + 1] - low).astype(np.int64)
        first = last


def words_in(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words of texts laid end to end and cut at ``cuts``."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACES[data]
    edge = np.diff(inside)
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    inner = np.unique(cuts[1:-1])
    joined = inner[(inside[inner] > 0) & (inside[inner + 1] > 0)]  # a word that would run over a text's end
    if len(joined):
        starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
    return starts, ends, np.searchsorted(cuts, starts, "right") - 1


def shingle_sets(data: np.ndarray, cuts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word-shingle hashes of each text: (hashes in order of text and hash, text numbers, sizes).

    A-Z is lower-cased. A text with fewer than ``width`` words has the whole sequence as its one shingle.
    """
    n = len(cuts) - 1
    data = LOWER[data]
    starts, ends, doc = words_in(data, cuts)
    word = spans(prefix_sums(data), starts, ends)
    long = np.nonzero(ends - starts > PLAIN)[0]
    word[long] = digests(data, starts[long], ends[long])
    n_words = np.bincount(doc, minlength=n)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    whole = len(word) - width + 1
    if whole > 0:
        total = np.zeros(whole, np.uint64)
        for k in range(width):
            total += word[k : k + whole] * factors[k]
        same = doc[:whole] == doc[width - 1 :]
        hashes, of = mix(total[same]), doc[:whole][same]
    else:
        hashes, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.nonzero((n_words > 0) & (n_words < width))[0]
    if len(short):
        first = np.searchsorted(doc, short)
        total = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            there = n_words[short] > k
            total[there] += word[first[there] + k] * factors[k]
        hashes = np.concatenate([hashes, mix(total + n_words[short].astype(np.uint64))])
        of = np.concatenate([of, short])
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(of[order].astype(np.int32), kind="stable")]
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    return hashes, of, np.bincount(of, minlength=n)


def sum_by(group: np.ndarray, values: np.ndarray, groups: int) -> np.ndarray:
    """Sums of 64-bit values modulo 2**64 for each group (exact: halves are summed as integers below 2**53)."""
    low = np.bincount(group, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=groups).astype(np.uint64)
    high = np.bincount(group, (values >> np.uint64(32)).astype(np.float64), minlength=groups).astype(np.uint64)
    return low + (high << np.uint64(32))
