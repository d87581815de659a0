"""Removal of repeated word windows, with a count-min prefilter.

A window of WINDOW words is represented by the smallest hash among its PART-word runs, so about one run in twelve represents all windows
that lie over it, and equal windows have equal representatives. Every task sketches the representatives of its texts; the sketches
are merged shard by shard into one of fixed size. Its counts can only be too high, so a window whose representative is counted once is unique. The second pass digests
the windows that may be repeated and groups them exactly, by 128 bits of their words. A task first merges its own equal windows, so a
window that stands in a great many texts reaches the exact step once per task.

The sketch has a fixed number of cells whatever the input. If that is far too few, more unique windows reach the exact step; none is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import as_bytes, mixed, packed, shingle_hashes, slices, whole, word_hashes

WINDOW = 35
PART = 12
DEPTH = 2
WIDTH_BITS = 27  # cells of each of the sketch's rows, as a power of two: two rows are 32 MB as one bit a cell
SHARD_BITS = 18
FLUSH = 4_000_000
TWICE = np.uint32(1 << 31)


def _running(op, x: np.ndarray, n: int) -> np.ndarray:
    """`op` over every n consecutive values."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = op(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def representatives(hashes: np.ndarray, lengths: np.ndarray, window: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid one after another: the hash that represents the window at each place (0: no window starts there), and the hashes of
    all runs that represent some window, one for each place where they stand."""
    n, none = len(hashes), np.zeros(len(hashes), np.uint64)
    if n < window:
        return none, none[:0]
    runs = shingle_hashes(hashes, part) | np.uint64(1)  # never 0
    least = _running(np.minimum, runs, window - part + 1)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(n)  # words from a place to its text's end
    of = none.copy()
    of[: len(least)] = np.where(left[: len(least)] >= window, least, np.uint64(0))
    span = window - part + 1
    padded = np.concatenate([np.zeros(span - 1, np.uint64), of])
    most = _running(np.maximum, padded, span)  # at a place: the largest representative of the windows over the run there
    return of, runs[runs == most[: len(runs)]]


def cells(values: np.ndarray, width_bits: int) -> np.ndarray:
    """The cell of each value in each row of the sketch: DEPTH rows one after another."""
    shift = np.uint64(64 - width_bits)
    return np.stack([(mixed(values + np.uint64(0x632BE59BD9B4E019 * (r + 1) & (2**64 - 1))) >> shift) + np.uint64(r << width_bits) for r in range(DEPTH)])


def _laid(batch: pa.RecordBatch) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    texts = [t.split() for t in as_bytes(batch.column("text"))]
    return texts, np.array([len(t) for t in texts], np.int64), word_hashes([w for t in texts for w in t])


def merged_sketch(docs: DataFrame, window: int, part: int, width_bits: int) -> np.ndarray:
    """One bit per cell of the merged sketch: counted twice or more. Its size is fixed by the parameters."""
    shard_bits = min(SHARD_BITS, width_bits)
    low = np.uint64((1 << shard_bits) - 1)

    def emit(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at, n = np.unique(np.concatenate(found), return_counts=True)
        value = (at & low).astype(np.uint32) | np.where(n > 1, TWICE, np.uint32(0))
        shard = (at >> np.uint64(shard_bits)).astype(np.int32)
        edges = np.flatnonzero(np.diff(shard, prepend=-1))
        parts = [p.tobytes() for p in np.split(value, edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(shard[edges]), pa.array(parts, pa.binary())], names=["shard", "cells"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for whole_batch in batches:
            for batch in slices(whole_batch):
                _, lengths, hashes = _laid(batch)
                own = cells(representatives(hashes, lengths, window, part)[1], width_bits).reshape(-1)
                if len(own):
                    found.append(own)
                    size += len(own)
                if size >= FLUSH:
                    yield from emit(found)
                    found, size = [], 0
        if found:
            yield from emit(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())], names=["shard", "bits"])

        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("cells").to_pylist()):
                if shard != now:
                    if now is not None:
                        yield done()
                    now, counts = shard, np.zeros(1 << shard_bits, np.uint8)
                value = np.frombuffer(data, np.uint32)
                at = value & ~TWICE
                counts[at] = np.minimum(counts[at] + np.where(value & TWICE, 2, 1), 2)
        if now is not None:
            yield done()

    parts = docs.select("text").mapInArrow(sketch, "shard int, cells binary")
    bits = parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "shard int, bits binary")
    out = np.zeros((DEPTH << width_bits) // 8, np.uint8)
    each = (1 << shard_bits) // 8
    for r in bits.toLocalIterator():
        out[r["shard"] * each : (r["shard"] + 1) * each] = np.frombuffer(r["bits"], np.uint8)
    return out


def _key(doc_id: str, text: str):
    """Names a row in few bytes: a hash of id and text, and the id, which packs well."""
    return [F.xxhash64(doc_id, text).alias("k1"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("k2")]


def repeated_places(docs: DataFrame, window: int = WINDOW, part: int = PART, width_bits: int = WIDTH_BITS) -> DataFrame:
    """Of every text with a repeated window: its row key and the starts of such windows, as a list of ranges a * 2**31 + b."""
    sketch = docs.sparkSession.sparkContext.broadcast(merged_sketch(docs, window, part, width_bits))
    names = ("h1", "h2", "k1", "k2", "a", "b", "n")  # the digest's halves, the row's key, a range of starts, how often it is known to stand

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.value
        for whole_batch in batches:
            digests, owner, place = [], [], []
            k1, k2 = (whole_batch.column(c).to_numpy() for c in ("k1", "k2"))
            first = 0
            for batch in slices(whole_batch):
                texts, lengths, hashes = _laid(batch)
                of, _ = representatives(hashes, lengths, window, part)
                edge = np.flatnonzero(np.diff(of, prepend=np.uint64(0)))  # a representative's windows stand together
                at = cells(of[edge], width_bits)
                twice = ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0) & (of[edge] != 0)
                maybe = np.flatnonzero(np.repeat(twice, np.diff(edge, append=len(of)))) + (edge[0] if len(edge) else 0)
                starts = np.concatenate([[0], np.cumsum(lengths)])
                doc = np.searchsorted(starts, maybe, side="right") - 1
                cut = np.flatnonzero(np.diff(doc, prepend=-1))
                for group in np.split(np.arange(len(maybe)), cut[1:]):
                    if not len(group):
                        continue
                    d = int(doc[group[0]])
                    line = b" ".join(texts[d])
                    ends = np.cumsum(np.fromiter(map(len, texts[d]), np.int64, len(texts[d])) + 1)
                    own = maybe[group] - starts[d]
                    begin, end = (ends[own] - np.fromiter((len(texts[d][i]) for i in own), np.int64, len(own)) - 1).tolist(), (ends[own + window - 1] - 1).tolist()
                    digests.append(b"".join([hashlib.blake2b(line[x:y], digest_size=16).digest() for x, y in zip(begin, end)]))
                    owner.append(np.full(len(own), first + d, np.int64))
                    place.append(own)
                first += batch.num_rows
            if digests:
                yield _local(np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), np.concatenate(owner), np.concatenate(place), k1, k2)

    def _local(h: np.ndarray, owner: np.ndarray, place: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> pa.RecordBatch:
        """Equal windows of one batch: one stands for them in the exact step, the others are known to be repeated and leave as ranges."""
        order = np.lexsort((h[:, 1], h[:, 0]))
        new = np.ones(len(h), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]).any(axis=1)
        count = np.diff(np.flatnonzero(new), append=len(h))
        lead = order[new]
        n = np.ones(len(h), np.int64)
        n[lead] = np.minimum(count, 2)
        others = np.sort(order[~new])  # by text and place, as they came
        cut = np.ones(len(others), bool)
        cut[1:] = (owner[others[1:]] != owner[others[:-1]]) | (place[others[1:]] != place[others[:-1]] + 1)
        a = others[cut]
        size = np.diff(np.flatnonzero(cut), append=len(others))
        at = np.concatenate([lead, a])
        name = np.concatenate([h[lead], np.stack([k1[owner[a]], place[a]], axis=1) if len(a) else h[:0]])
        until = np.concatenate([place[lead] + 1, place[a] + size])
        twos = np.concatenate([n[lead], np.full(len(a), 2)])
        values = [name[:, 0], name[:, 1], k1[owner[at]], k2[owner[at]], place[at].astype(np.int32), until.astype(np.int32), twos.astype(np.int8)]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in values], names=names)

    schema = "h1 long, h2 long, k1 long, k2 long, a int, b int, n byte"
    found = docs.select("text", *_key("doc_id", "text")).mapInArrow(candidates, schema)
    total = F.sum("n").over(W.partitionBy("h1", "h2"))
    twice = found.withColumn("total", total).where("total > 1")
    return twice.groupBy("k1", "k2").agg(F.collect_list(F.shiftleft(F.col("a").cast("long"), 31) + F.col("b")).alias("ranges"))


def removed_windows(docs: DataFrame, window: int = WINDOW, part: int = PART, width_bits: int = WIDTH_BITS) -> DataFrame:
    """`docs` packed as `row`, with n_words, n_removed and the kept words joined by one space."""
    from pyspark.sql import types as T

    places = repeated_places(docs.select("doc_id", "text"), window, part, width_bits)
    rows = packed(docs).select("row", *_key("row.doc_id", "row.text")).join(places.hint("shuffle_hash"), ["k1", "k2"], "left").select("row", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part_, n, gone, kept = batch.slice(at, 1024), [], [], []
                for text, ranges in zip(as_bytes(part_.column("row").field("text")), part_.column("ranges").to_pylist()):
                    words = text.split()
                    if ranges:
                        cover = np.zeros(len(words) + 1, np.int32)
                        found = np.array(ranges, np.int64)
                        np.add.at(cover, found >> 31, 1)
                        np.add.at(cover, (found & 0x7FFFFFFF) - 1 + window, -1)
                        stay = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                        gone.append(len(words) - len(stay))
                        n.append(len(words))
                        words = [words[i] for i in stay.tolist()]
                    else:
                        n.append(len(words))
                        gone.append(0)
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part_.column("row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "n_words", "n_removed", "kept"])

    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return rows.mapInArrow(cut, schema)


def substring_dedup(docs: DataFrame, window: int = WINDOW, part: int = PART, width_bits: int = WIDTH_BITS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of `docs`.

    A null or empty text has no words and keeps the digest of nothing. A text shorter than a window keeps all its words. Rows that
    repeat a text repeat its windows, so each loses them. Texts of any length are taken whole; other columns are not read; an empty table gives no rows.
    """
    out = removed_windows(docs.select("doc_id", whole().alias("text")), window, part, width_bits)
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
