"""Helpers the text operators share: tables, words as codes, Arrow batches, held-out rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A task's word dictionary is emptied beyond this many entries, so its memory stays bounded.
CODES_HELD = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(column: str, mod: int) -> Column:
    """crc32 of the column as text, modulo `mod`; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


class Codes(dict):
    """A 64-bit code for each word, looked up like a dictionary and bounded in size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CODES_HELD:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def lower_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; other letters stay as they are."""
    return text.lower().split()


def word_codes(words: list[bytes], codes: Codes) -> np.ndarray:
    return np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_codes(codes: np.ndarray, size: int) -> np.ndarray:
    """A code for each run of `size` neighbouring codes, in order."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out + codes[k : k + n] + np.uint64(k + 1))
    return out


def small_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` text bytes, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.fromiter((len(x) for x in raw(batch.column(column))), np.int64, batch.num_rows)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start)


def with_columns(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column(c) for c in keep] + list(new.values()), names=keep + list(new)
    )


def bit_map(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit map of 2 ** bits places, of one size for any number of rows, that has the places of all
    values of a 64-bit column; others may share a place with one of them."""
    slot = F.col(column).bitwiseAND((1 << bits) - 1)
    words = rows.select(slot.alias("slot")).groupBy(F.expr("slot >> 6").alias("word"))
    # At most 2 ** (bits - 6) rows of two numbers.
    found = words.agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("mask")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[found["word"].to_numpy()] = found["mask"].to_numpy()
    return table.view(np.uint64)


def without_ids(rows: DataFrame, ids: DataFrame, column: str, bits: int = 24) -> DataFrame:
    """The rows whose value in `column` is not in `ids`; a null equals none.

    A bit map of 2 ** bits places, of one size for any number of ids and without a Python worker, is
    broadcast as words of 64 places. Rows at a place that no id has stay where they are read; only
    the others, the ids' own rows and few besides, are shuffled to be compared by value. Both
    tables are read twice, so they should be written ones.
    """
    slot = F.xxhash64(column).bitwiseAND((1 << bits) - 1)
    placed = ids.select(F.shiftright(slot, 6).alias("_word"), slot.bitwiseAND(63).cast("int").alias("_bit"))
    # At most 2 ** (bits - 6) rows of two numbers.
    marks = placed.groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_mask"))
    looked = rows.withColumn("_slot", slot).withColumn("_word", F.shiftright("_slot", 6))
    looked = looked.join(F.broadcast(marks), "_word", "left")
    marked = F.coalesce(F.expr("shiftright(_mask, cast(_slot & 63 as int)) & 1L = 1L"), F.lit(False))
    same = looked.where(marked).select(*rows.columns).join(ids, column, "left_anti")
    return looked.where(~marked).select(*rows.columns).unionByName(same.select(*rows.columns))


def in_bit_map(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether the place of each code is in the map."""
    slot = codes & np.uint64(64 * len(table) - 1)
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
