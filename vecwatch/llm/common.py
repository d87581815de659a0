"""Helpers the operators of this folder share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import scratch_root

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast only if it was counted to have at most so many (narrow) rows.
BROADCAST_ROWS = 100_000
#: Bytes of a batch of whole texts on its way to Python, about; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(column: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def row_key(*columns: str) -> list[Column]:
    """128 bits, as two longs, that name a row by some of its values. Rows that agree in them have one key."""
    first = F.xxhash64(F.lit(1), *columns)
    return [first.alias("k1"), F.xxhash64(F.lit(2), *columns, first).alias("k2")]


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a stored table for broadcast if it was counted to be small; else joins shuffle it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def stored(df: DataFrame) -> DataFrame:
    """Rows written as a table in the shared folder and read again, cut from their lineage."""
    path = scratch_root(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame, at_most: int = BATCH_BYTES) -> DataFrame:
    """`df`, with batches that go to Python bounded in bytes as well as in rows.

    A batch stands in the JVM's native memory several times over (vectors that double as they grow, the stream's buffer, the answer) and in the Python worker, for every task at once; freed
    blocks of that size are kept by the allocator. Batches that are bounded in rows alone make executors larger as texts get longer."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(at_most))
    return df


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text of an Arrow column, a null one as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str = "text", at_most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about so many bytes of text, so that working arrays stay small."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // at_most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    import pandas as pd

    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, n: int, odd: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of n values: a polynomial modulo 2**64, scrambled."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(odd) + hashes[i : i + m]
    return mixed(out)


def lowered_words(text: bytes) -> list[bytes]:
    return text.lower().split()


LETTERS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct `row`, so that no column of the caller can clash with a helper's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col("row")[c].alias(c) for c in like.columns])
