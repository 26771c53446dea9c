"""Vectorised word, n-gram and minimum kernels over Arrow text columns."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(range(256)).lower()
#: Words longer than this many bytes are hashed one by one by a cryptographic hash.
LONG_WORD = 256
_BASES = {}
M64 = (1 << 64) - 1


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def raw_slices(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, UTF-8 of the texts), about limit bytes at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, n = 0, len(column)
    while lo < n:
        before = sizes[lo - 1] if lo else 0
        hi = min(n, max(lo + 1, int(np.searchsorted(sizes, before + limit, side="right"))))
        yield lo, hi, raw_texts(column.slice(lo, hi - lo))
        lo = hi


def text_chunks(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts, about limit bytes each; one longer text comes alone."""
    column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of the first word of each text (one more entry than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    before &= ~cut[:-1]
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    after &= ~cut[1:]
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd."""
    have = _BASES.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _BASES[base] = tuple(out)
    return have[0][:n], have[1][:n]


def _spans(prefix: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (prefix[ends] - prefix[starts]) * inverse[starts]


def _prefix(values: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * p, out=out[1:])
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inverse = powers(base, len(data))
    out = mix(_spans(_prefix(data.astype(np.uint64) + np.uint64(1), p), inverse, starts, ends))
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=base.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def ngram_hashes(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """One hash for each k consecutive words, text borders ignored."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, inverse = powers(base, len(words))
    prefix = _prefix(words, p)
    return mix((prefix[k:] - prefix[:n]) * inverse[:n])


def sliding(values: np.ndarray, width: int, take) -> np.ndarray:
    """take (np.minimum or np.maximum) over each width consecutive values, by doubling."""
    n, have = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    while 2 * have <= width:
        values = take(values[: len(values) - have], values[have:])
        have *= 2
    return take(values[:n], values[width - have : width - have + n])
