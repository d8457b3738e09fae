"""NumPy over whole Arrow batches of texts: words, word hashes, sets. No loop over words or bytes."""

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Odd base of the rolling byte hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE = 1 << 19

#: True for bytes of words: other than space, tab, line feed, vertical tab, form feed, carriage return.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
#: True for digits, letters and all non-ASCII bytes.
ALNUM = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
#: A-Z to a-z.
LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)


def mix(x):
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _M1
        x = (x ^ (x >> U64(27))) * _M2
        return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U64)
        while len(have) < n:
            have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
        _POWERS[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums s with which range_hash gives the hash of any range of bytes."""
    s = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=s[1:])
    return s


def range_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], the same wherever the bytes stand."""
    return mix((s[end] - s[start]) * powers(_INVERSE, len(s))[start] + (end - start).astype(U64))


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    texts = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary() if pa.types.is_binary(batch.schema.field(name).type) else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


def slices(data: np.ndarray, offsets: np.ndarray, most=SLICE):
    """(first row, bytes, offsets) of runs of rows with at most so many bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, kind=PLAIN):
    """Starts and ends of all words, and for each row its first word and the one after its last.
    A word ends where its row ends."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = kind[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets[:-1]), np.searchsorted(starts, offsets[1:])


_STEPS = mix(np.arange(101, 165, dtype=U64))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size hashes; those that cross rows are for the caller to leave out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(size):
        out += hashes[k : k + n] * (_STEPS[k] | U64(1))
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size=5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of size words. A row with fewer words has one
    shingle of all of them; a row without words none."""
    starts, ends, lo, hi = words(data, offsets)
    if not len(starts):
        return [np.zeros(0, U64)] * (len(offsets) - 1)
    hashes = range_hash(prefix_hash(data), starts, ends)
    runs = grams(hashes, size)
    out = []
    for a, b in zip(lo, hi, strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        else:
            out.append(grams(hashes[a:b], int(b - a)) if b > a else np.zeros(0, U64))
    return out


def as_binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


class Union:
    """Union-find over 0 ... n-1; the root is the smallest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b
