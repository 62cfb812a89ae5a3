"""Words and hashes of whole batches of texts in numpy: no Python loop over words.

Words are hashed eight bytes at a time, with a bijective mix after each; spans and runs by polynomials modulo 2**64 over
random values, mixed at the end. All hashes have 64 bits. Equal sequences always get equal hashes; n different ones hold a
false match with a chance of about n*n / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import shipped

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_RANDOM = np.random.default_rng(20240229)
BYTE_VALUE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
BASE = int(_RANDOM.integers(1, 2**63)) * 2 + 1
WORD_BASE = int(_RANDOM.integers(1, 2**63)) * 2 + 1


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0], have = 1, 1
    while have < n:
        more = min(have, n - have)
        np.multiply(out[:more], np.uint64(pow(base, have, 1 << 64)), out=out[have : have + more])
        have += more
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finish of 64 bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def distinct(x: np.ndarray) -> np.ndarray:
    """Ascending distinct values; by sorting, which for millions of numbers is several times faster than numpy's hash table."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a large_string array and the n+1 places where its rows begin and end."""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch: start and end byte, and row_ends[i]:row_ends[i+1] are the words of row i."""

    def __init__(self, text: pa.Array, lower: bool = False):
        self.data, self.rows = raw(text)
        if lower:
            upper = (self.data >= 65) & (self.data <= 90)
            self.data = self.data + (upper.astype(np.uint8) << 5)
        n = len(self.data)
        space = np.zeros(256, bool)
        space[list(SPACES)] = True
        is_space = space[self.data]
        before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
        before[1:], after[: max(n - 1, 0)] = is_space, is_space[1:]
        before[self.rows] = True
        after[self.rows[1:] - 1] = True
        self.starts = np.flatnonzero(~is_space & before[:n])
        self.ends = np.flatnonzero(~is_space & after[:n]) + 1
        self.row_ends = np.searchsorted(self.starts, self.rows)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.row_ends))


#: Words up to this many bytes are hashed step by step.
STEPPED = 512
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span; the spans are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    length = ends - starts
    out = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = mixed(out + (eight[starts] & _LOW_BYTES[np.minimum(length, 8)]) * np.uint64(0xD6E8FEB86659FD93))
    more, done = np.flatnonzero((length > 8) & (length <= STEPPED)), 8
    while len(more):
        left = length[more] - done
        out[more] = mixed(out[more] * np.uint64(0x2545F4914F6CDD1D) + (eight[starts[more] + done] & _LOW_BYTES[np.minimum(left, 8)]))
        more, done = more[left > 8], done + 8
    long = np.flatnonzero(length > STEPPED)
    if len(long):
        out[long] = span_hashes(data, starts[long], ends[long])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span; the spans are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    begin = np.zeros(len(data), np.int64)
    begin[starts] = starts
    np.maximum.accumulate(begin, out=begin)
    rel = np.arange(len(data)) - begin
    longest = int((ends - starts).max())
    np.minimum(rel, longest - 1, out=rel)  # bytes between the spans; the sums below leave them out
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(BASE, longest)[rel], out=sums[1:])
    return mixed(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))


class Runs:
    """Hashes of any run of consecutive word hashes, by prefix sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers(WORD_BASE, n)[:n], out=self.sums[1:])
        self.back = powers(pow(WORD_BASE, -1, 1 << 64), n + 1)

    def of(self, starts: np.ndarray, lengths) -> np.ndarray:
        return mixed((self.sums[starts + lengths] - self.sums[starts]) * self.back[starts] + np.asarray(lengths).astype(np.uint64))


def windows(row_ends: np.ndarray, length: int) -> np.ndarray:
    """Starts of all runs of `length` words that lie within one row."""
    n = int(row_ends[-1]) if len(row_ends) else 0
    if n < length:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    ends = row_ends[1:]
    for back in range(1, length):  # starts too close to the end of their row
        at = ends - back
        ok[at[(at >= row_ends[:-1]) & (at >= 0)]] = False
    return np.flatnonzero(ok)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[starts[i]:starts[i]+lengths[i]] one after another."""
    total = int(lengths.sum())
    shift = starts - (np.cumsum(lengths) - lengths)
    return flat[np.arange(total) + np.repeat(shift, lengths)]


shipped(__name__)
