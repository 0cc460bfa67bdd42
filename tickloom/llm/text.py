"""Words and fingerprints of Arrow text columns, and the few Spark helpers the operators share.

Texts come to Python workers as Arrow batches. Everything here works on the UTF-8 bytes of many texts
at once: a table tells word bytes from separators, and fingerprints are polynomial sums over bytes (or
over word fingerprints, for windows), so that no loop runs per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once (a longer text is still taken whole).
PIECE_BYTES = 1 << 19

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

U = np.uint64


def _table(separators: list[int]) -> np.ndarray:
    t = np.ones(256, bool)
    t[separators] = False
    return t


#: Words between white space: [^\x20\x09-\x0D]+
BLANK_SPLIT = _table([0x20, *range(0x09, 0x0E)])
#: Words of digits, letters and non-ASCII bytes, after A-Z became a-z: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM_SPLIT = _table([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: The byte each byte becomes when A-Z is lower-cased.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_P, _Q = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def _power(base: U, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(p)
    return have[:n]


def _inverse(base: U) -> U:
    return U(pow(int(base), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers; a bijection."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _ranges(values: np.ndarray, base: U, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of values[start:end] for each pair, from one running sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_inverse(base), len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of some texts: byte ranges starts..ends in raw; of text d, words offsets[d]..offsets[d+1]."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, table: np.ndarray, lower: bool = False):
        self.raw = raw = ASCII_LOWER[raw] if lower else raw
        self.bounds = bounds
        inside = table[raw]
        first, last = inside.copy(), inside.copy()
        if len(raw):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = bounds[1:-1]
            edge = edge[(edge > 0) & (edge < len(raw))]
            first[edge] |= inside[edge]
            last[edge - 1] |= inside[edge - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self) -> np.ndarray:
        return self.range_hashes(self.starts, self.ends)

    def range_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of bytes starts..ends, as of a word."""
        return _ranges(_BYTE[self.raw], _P, starts, ends)

    def hashes_less_a_letter(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words numbered at, each once without each of its letters: place in at, and the hash of what is left."""
        s, e = self.starts[at], self.ends[at]
        sizes = e - s
        flat = np.repeat(s - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        lead = (self.raw[flat] & 0xC0) != 0x80
        owner, a = np.repeat(np.arange(len(at)), sizes)[lead], flat[lead]
        b = np.concatenate([a[1:], e[-1:]])
        last = np.flatnonzero(np.concatenate([owner[1:] != owner[:-1], [True]])) if len(owner) else owner
        b[last] = e[owner[last]]
        s, e = s[owner], e[owner]
        total = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(_BYTE[self.raw] * _power(_P, len(self.raw)), out=total[1:])
        back = _power(_inverse(_P), len(self.raw) + 1)
        return owner, mix((total[a] - total[s]) * back[s] + (total[e] - total[b]) * back[s + b - a] + (e - s - b + a).astype(np.uint64))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def word(self, i: int) -> str:
        return self.raw[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")

    def window_starts(self, length: int) -> np.ndarray:
        """Indices of the words at which a window of so many words of one text starts."""
        room = np.repeat(self.offsets[1:], self.counts()) - np.arange(len(self))
        return np.flatnonzero(room >= length)


def window_hashes(word_hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    return _ranges(word_hashes, _Q, starts, starts + length)


def range_hashes(word_hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _ranges(word_hashes, _Q, starts, ends)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    if off is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows into pieces with at most so many bytes of text, or one row."""
    _, bounds = text_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at)
        at = to


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB for this session, unless it has set a size of its own: workers and executors hold several at once."""
    if spark.conf.get(_BATCH_BYTES) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(_BATCH_BYTES, str(8 << 20))


def map_pieces(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", most: int = PIECE_BYTES) -> DataFrame:
    """mapInArrow with a function of pieces of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column, most):
                out = function(piece)
                if out is not None and out.num_rows:
                    yield out
            pa.default_memory_pool().release_unused()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def list_array(values: np.ndarray | pa.Array, offsets: np.ndarray) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def remainder(column: Column, by: int) -> Column:
    """crc32 of the number's decimal text, modulo by; null has none."""
    return F.crc32(column.cast("string")) % by


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
