"""Words and their hashes over Arrow string buffers, without a Python object per word.

A word's bytes are taken eight at a time and chained through a mixer that is a bijection of 64-bit numbers, so different words of up to
eight bytes and equal length never share a hash. Longer words go through as many steps; the rare ones over ``LONG`` bytes are hashed by
BLAKE2. Runs of words are hashed as a tree of pairs through the same mixer. None of these is a polynomial, whose values regular
patterns (Thue-Morse words modulo 2**64, say) make equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES, LANE, LONG = 1 << 20, 8, 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd numbers: what a chain's state, and the left of two joined runs, is multiplied by; what lengths are.
CHAIN, LEFT, LENGTH = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(LANE + 1)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * LEFT + right)


class Runs:
    """Hashes of every run of a given number of consecutive values. Another seed gives another, independent hash."""

    def __init__(self, values: np.ndarray, seed: int = 0):
        self.doubled = [mixed(values ^ np.uint64(seed))]

    def of(self, width: int) -> np.ndarray:
        """The hash of values[i : i + width] for each i that has as many."""
        count = len(self.doubled[0]) - width + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        out, at = None, 0
        for k in range(width.bit_length()):
            if k == len(self.doubled):
                x, step = self.doubled[-1], 1 << (k - 1)
                self.doubled.append(joined_hash(x[:-step], x[step:]))
            if width >> k & 1:
                own = self.doubled[k][at : at + count]
                out = own if out is None else joined_hash(out, own)
                at += 1 << k
        return out


class Words:
    """The words of the texts of an Arrow array: starts and ends in data; first[i]:first[i + 1] are text i's."""

    def __init__(self, texts: pa.Array, lower: bool = False, space: np.ndarray = _SPACE):
        texts = pc.fill_null(texts, "")
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        n = len(data)
        #: The bytes, and a lane more so that eight can be read from any of them.
        self.padded = np.zeros(n + LANE, np.uint8)
        self.padded[:n] = _LOWER[data] if lower else data
        self.data = self.padded[:n]
        blank = space[self.data]
        before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
        before[1:], after[:n] = blank, blank
        before[self.offsets] = True
        after[self.offsets] = True
        self.starts = np.flatnonzero(~blank & before[:n])
        self.ends = np.flatnonzero(~blank & after[1:]) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from starts to ends."""
        lanes = np.ndarray(len(self.data) + 1, "<u8", buffer=self.padded, strides=(1,))
        size = ends - starts
        out = size.astype(np.uint64) * LENGTH
        at, more = 0, np.arange(len(size))
        while len(more) and at < LONG:
            left = size[more] - at
            out[more] = mixed(out[more] * CHAIN ^ lanes[starts[more] + at] & _MASKS[np.minimum(left, LANE)])
            at += LANE
            more = more[left > LANE]
        for i in more:
            digest = hashlib.blake2b(self.data[starts[i] : ends[i]], digest_size=LANE).digest()
            out[i] = int.from_bytes(digest, "little")
        return out

    def joined(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """Text i's words (those with keep true) joined by one space."""
        a, b = self.first[i], self.first[i + 1]
        ws = bytes(self.data[self.offsets[i] : self.offsets[i + 1]]).split()
        assert len(ws) == b - a
        return b" ".join(ws if keep is None else [w for w, k in zip(ws, keep) if k])


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about CHUNK_BYTES of text; a longer text has a batch of its own."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + CHUNK_BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end
