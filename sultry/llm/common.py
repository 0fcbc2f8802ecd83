"""Shared pieces of the training-data operators: words, hashes, batches and lineage cuts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_dir, ship

__all__ = ["WORD", "Rolling", "chunks", "map_batches", "materialize", "maybe_in", "mix", "shared_dir", "ship", "signed", "text_bytes", "word_hashes", "words_col"]

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, empty for null."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values: spreads nearby inputs over the whole range."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE, np.uint64), dtype=np.uint64)])
        _INVERSES = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, inverse, np.uint64), dtype=np.uint64)])
    return _POWERS[:n], _INVERSES[:n]


class Rolling:
    """Hashes of any span of a token sequence in constant time each: a polynomial over 64-bit token hashes."""

    def __init__(self, tokens: np.ndarray):
        power, self.inverse = _powers(len(tokens) + 1)
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * power[:-1], dtype=np.uint64, out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of tokens [start, end)."""
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def windows(self, k: int) -> np.ndarray:
        """Mixed hashes of all windows of k tokens."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k : k + n] - self.sums[:n]) * self.inverse[:n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def chunks(sizes: list[int], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about `most` bytes together, so that a batch's arrays stay small."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over single batches; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def words_col(text) -> F.Column:
    """Words of a text as a native array; null texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


#: Bits of a fixed-size filter of ids.
FILTER_BITS = 1 << 23


def maybe_in(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Adds maybe_: false where df's key is surely not among `ids` (its first column). The filter has FILTER_BITS bits whatever the number of ids,
    so it is a table of at most FILTER_BITS / 64 rows to broadcast; it spares large rows a shuffle, and a join must follow."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    at = ids.select(slot(F.col(ids.columns[0])).alias("at_"))
    words = at.groupBy((F.col("at_") / 64).cast("int").alias("word_")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at_ % 64 as int))")).alias("bits_"))
    words = materialize(words, "filter")
    placed = df.withColumn("at_", slot(F.col(key))).withColumn("word_", (F.col("at_") / 64).cast("int"))
    hit = F.coalesce(F.getbit("bits_", (F.col("at_") % 64).cast("int")) == 1, F.lit(False))
    return placed.join(F.broadcast(words), "word_", "left").withColumn("maybe_", hit).drop("word_", "at_", "bits_")
