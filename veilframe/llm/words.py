"""Words of whole Arrow text columns, found and hashed with numpy.

Every separator is an ASCII character, so cutting UTF-8 bytes and cutting
characters give the same words. Texts are worked on in slices of some megabytes,
but no text is ever cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Texts are taken together up to this many bytes.
SLICE_BYTES = 4 << 20

# A-Z become a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Words of letters, digits and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
PLAIN = np.zeros(256, dtype=bool)
PLAIN[48:58] = PLAIN[97:123] = PLAIN[128:] = True
# Words between white space: [^\x20\x09-\x0D]
SPACED = np.ones(256, dtype=bool)
SPACED[9:14] = SPACED[32] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_factors = np.zeros(0, dtype=np.uint64)


def factors(n: int) -> np.ndarray:
    """One odd multiplier for each place in a word."""
    global _factors
    if len(_factors) < n:
        count = max(256, 1 << (n - 1).bit_length())
        _factors = mix(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)
    return _factors


@dataclass
class Words:
    """The words of some texts: text i has the words first[i] to first[i + 1]."""

    low: np.ndarray  # lower-cased bytes of all texts
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    text_at: np.ndarray  # where each text starts, and the end of the last

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits for each word."""
        lens = self.ends - self.starts
        if not len(lens):
            return np.zeros(0, dtype=np.uint64)
        begins = np.cumsum(lens) - lens
        at = np.arange(int(lens.sum())) - np.repeat(begins, lens)
        values = self.low[at + np.repeat(self.starts, lens)].astype(np.uint64) + np.uint64(1)
        values *= factors(int(lens.max()))[at]
        return mix(np.add.reduceat(values, begins) + lens.astype(np.uint64))

    def text(self, i: int) -> str:
        """Word i itself."""
        return self.low[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def words_of(texts: pa.Array, kind: np.ndarray) -> Words:
    """Cut the texts of one slice; a null text has no words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    low = LOWER[raw[at[0] : at[-1]]]
    at = at - at[0]
    word = np.zeros(len(low) + 2, dtype=bool)
    word[1:-1] = kind[low]
    inside = word[1:-1]
    begin, end = inside & ~word[:-2], inside & ~word[2:]
    # Words of neighbouring texts must not grow together.
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(low))]
    begin[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(low, starts, ends, np.searchsorted(starts, at), at)


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The same rows, in batches whose texts have about SLICE_BYTES bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row, and where each starts; none crosses a text's end."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        g = mix(g * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    return g[at], at


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


# --- a filter of fixed size for keys -----------------------------------------------------

FILTER_BITS = 24


def filter_places(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def may_hold(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """False only for keys that are not in the filter."""
    place = filter_places(x)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def key_filter(keys, column: str) -> bytes:
    """One bit of 2^FILTER_BITS for each key: 2 MB, however many keys there are.

    A key is a long, or binary of which the first 8 bytes count.

    A full filter only lets more rows through; what it lets through is joined exactly.
    """
    from pyspark.sql import functions as F

    def places(batches):
        for batch in batches:
            x = batch.column(0).drop_null()
            if pa.types.is_binary(x.type):
                x = np.frombuffer(b"".join(k[:8] for k in x.to_pylist()), np.uint64)
            else:
                x = x.to_numpy(zero_copy_only=False).view(np.uint64)
            place = np.unique(filter_places(x))
            word, start = np.unique(place >> 6, return_index=True)
            if len(word):
                bits = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), start)
                yield pa.RecordBatch.from_arrays([pa.array(word), as_long(bits)], ["w", "b"])

    rows = (
        keys.select(F.col(column).alias("k"))
        .mapInArrow(places, "w long, b long")
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return out.tobytes()
