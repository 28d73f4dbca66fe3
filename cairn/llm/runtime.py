"""Helpers of the operators in this subpackage: fixed-size bit filters, row keys, column selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import U64, xxhash64_longs

#: log2 of the bits of a filter: 2 MB that are broadcast whatever the size of the input.
FILTER_BITS = 24
_MASK = (1 << FILTER_BITS) - 1
_SHIFTS = (0, 20, 40)


def bit_filter(df: DataFrame, column: str) -> np.ndarray:
    """Bloom filter over a bigint column, built by the executors.

    Its size is fixed (2**FILTER_BITS bits): a filter that overflows lets more
    rows pass and never drops one, so it may only thin out rows before an exact
    join.
    """
    h = F.xxhash64(F.col(column))
    places = F.array(*[F.shiftrightunsigned(h, s).bitwiseAND(F.lit(_MASK).cast("bigint")) for s in _SHIFTS])
    rows = (
        df.select(F.explode(places).alias("at"))
        .groupBy(F.shiftright("at", 6).cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
        .toArrow()
    )
    words = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    del rows
    pa.default_memory_pool().release_unused()  # the driver makes many filters
    return words.view(U64)


def split_by_filter(df: DataFrame, key: Column, words: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(rows whose key ``bit_filter`` may have seen, all others), told apart where the rows are read, without Python.

    The filter is one row that is broadcast; a join's condition looks it up and nothing of it is copied to the rows.
    """
    bits = fresh(df, "filter_words")
    one = F.broadcast(df.sparkSession.createDataFrame(pa.table({bits: list_array(as_longs(words), np.array([len(words)]))})))
    held = F.lit(True)
    for s in _SHIFTS:
        at = F.shiftrightunsigned(F.xxhash64(key), s).bitwiseAND(F.lit(_MASK).cast("bigint"))
        word = F.element_at(F.col(bits), (F.shiftright(at, 6) + 1).cast("int"))
        held &= F.call_function("shiftrightunsigned", word, at.bitwiseAND(F.lit(63).cast("bigint")).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1
    return df.join(one, held, "left_semi"), df.join(one, held, "left_anti")


def may_hold(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each value of a bigint array, whether ``bit_filter`` may have seen it."""
    h = xxhash64_longs(values)
    found = np.ones(len(h), dtype=bool)
    for s in _SHIFTS:
        at = (h >> U64(s)) & U64(_MASK)
        found &= ((words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1)).astype(bool)
    return found


def as_longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have yet (names clash without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
