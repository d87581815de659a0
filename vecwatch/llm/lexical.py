"""Ranked lexical search over bit-sliced Bloom signatures.

Index: documents of alike size are put in blocks. A block keeps one bitmap per bit of its Bloom signature (a slice: one bit per document), so a
term's documents are the AND of its few slices, a superset of the true ones. A term is entered once per step of its count that it reaches (COUNTS), which bounds counts
from above as well.

Search: for every item the slices' rows, weighted by what a term can add at most at that count and that length of the document, are summed to an upper bound per
document. The best bounds are scored exactly first; their k-th score then excludes every document whose bound, with its id as the tie's judge, cannot
reach it. All others are scored exactly. Nothing is cut by a number of candidates.

Items are searched in blocks of ITEMS_AT_ONCE, each against all documents.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import as_bytes, mixed, row_key, small_side, stored, whole, word_hashes

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TOP = 20
B_PERCENT = 25
HASHES = 6
BITS = 16              # least bits of a signature per entry of the largest document a block may hold
ROWS = 1024            # most documents of a block
BLOCK_BYTES = 1 << 22  # a block of large documents has fewer rows (8 at least), so that its slices stay at about this size
ITEMS_AT_ONCE = 2000
CACHED_WORDS = 300_000
_GROUP = 32            # items whose bounds are worked out together inside a task


def terms(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


def _counts() -> list[int]:
    found = [1]
    while found[-1] < 1 << 40:
        found.append(max(found[-1] + 1, found[-1] * 5 // 4))
    return found


COUNTS = _counts()  # 1 to 8, then a quarter more each


def steps_of(count: int) -> int:
    """How many of COUNTS a count reaches."""
    return bisect.bisect_right(COUNTS, count)


def positions(hashes: np.ndarray, step: int, bits: int) -> np.ndarray:
    """Slices (one row of HASHES numbers per hash) of terms entered for a step."""
    base = mixed(hashes + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    second = mixed(base ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return ((base[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * second[:, None]) % np.uint64(bits)).astype(np.int64)


class _Hashes(dict):
    """64-bit hashes of words, kept while the table holds."""

    def of(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in words if w not in self]
        if new:
            if len(self) > CACHED_WORDS:
                self.clear()
                new = words
            self.update(zip(new, word_hashes(new).tolist()))
        return np.array([self[w] for w in words], np.uint64)


INDEX = "bits int, slices binary, doc_ids array<{id}>, k1 array<long>, k2 array<long>, sizes array<long>"


def signatures(docs: DataFrame, bits: int = BITS, rows: int = ROWS) -> DataFrame:
    """Blocks of signatures of all documents that have a term: `bits` slices of one bitmap each (packed, first document in the highest bit), and per document its id, row key and size in terms."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_blocks = _Hashes(), {}
        id_type = None

        def block(size: int) -> pa.RecordBatch:
            ids, k1, k2, sizes, entries = zip(*open_blocks.pop(size))
            taken = np.zeros((size, -(-len(ids) // 8) * 8), bool)
            for column, per_step in enumerate(entries):
                for step, hashes in enumerate(per_step):
                    taken[positions(hashes, step, size).ravel(), column] = True
            values = (pa.array([size], pa.int32()), pa.array([np.packbits(taken, axis=1).tobytes()], pa.binary()), pa.array([list(ids)], pa.list_(id_type)), *(pa.array([list(x)], pa.list_(pa.int64())) for x in (k1, k2, sizes)))
            return pa.RecordBatch.from_arrays(list(values), names=["bits", "slices", "doc_ids", "k1", "k2", "sizes"])

        for batch in batches:
            id_type = batch.column("doc_id").type
            for doc_id, k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k1", "k2")), as_bytes(batch.column("text"))):
                counts = Counter(terms(text))
                if not counts:
                    continue
                hashes, reached = known.of(list(counts)), np.array([steps_of(n) for n in counts.values()])
                per_step = [hashes[reached > s] for s in range(int(reached.max()))]
                size = 64 << max(0, (bits * int(reached.sum()) - 1).bit_length() - 6)
                open_blocks.setdefault(size, []).append((doc_id, k1, k2, sum(counts.values()), per_step))
                if len(open_blocks[size]) >= min(rows, max(8, BLOCK_BYTES * 8 // size)):
                    yield block(size)
        for size in list(open_blocks):
            yield block(size)

    return docs.select("doc_id", *row_key("doc_id", "text"), whole().alias("text")).mapInArrow(build, INDEX.format(id=kind))


def document_counts(docs: DataFrame, asked: list[bytes]) -> np.ndarray:
    """For every asked term the number of documents that hold it, over all documents and whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(asked)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = shared.value, np.zeros(len(asked), np.int64)
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                for t in at.keys() & set(terms(text)):
                    found[at[t]] += 1
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(found[used])], names=["t", "n"])

    out = np.zeros(len(asked), np.int64)
    for r in docs.select("text").mapInArrow(count, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow().to_pylist():  # one row per asked term
        out[r["t"]] = r["n"]
    return out


@dataclass
class Asked:
    """A block of items: their distinct terms with weights, and each item's terms with repeats."""
    terms: list[bytes]
    weights: np.ndarray
    items: list[np.ndarray]
    n_docs: int
    n_terms: int
    k: int

    @classmethod
    def of(cls, docs: DataFrame, texts: list[bytes], n_docs: int, n_terms: int, k: int) -> "Asked":
        words = [terms(t) for t in texts]
        own = sorted(set().union(*words)) if words else []
        at = {t: i for i, t in enumerate(own)}
        df = document_counts(docs, own) if own else np.zeros(0, np.int64)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) if n else 0 for n in df], np.int64)
        return cls(own, weights, [np.array([at[t] for t in w if weights[at[t]] > 0], np.int64) for w in words], n_docs, n_terms, k)

    def parts(self) -> tuple:
        """What tasks are sent: plain values, so that executors need no copy of this module."""
        return self.terms, self.weights, self.items, self.n_docs, self.n_terms, self.k

    def norms(self, sizes: np.ndarray) -> np.ndarray:
        return 100 - B_PERCENT + (B_PERCENT * sizes * self.n_docs) // self.n_terms


def gains(count, m):
    """What a term adds per unit of weight."""
    return (1_000_000_000 * count) // (1000 * count + 12 * m)


def _bounds(asked: Asked, hashes: np.ndarray, row: dict, members: list[int]) -> np.ndarray:
    """Upper bounds of the scores, (members of asked.items) x (documents of a block)."""
    bits, n = row["bits"], len(row["sizes"])
    sizes = np.array(row["sizes"], np.int64)
    slices = np.frombuffer(row["slices"], np.uint8).reshape(bits, -1)
    own = np.unique(np.concatenate([asked.items[i] for i in members]))
    m, most = asked.norms(sizes), int(sizes.max())
    value, live, last, step = np.zeros((len(own), n), np.int64), np.arange(len(own)), np.zeros(n, np.int64), 0
    before = None
    while len(live):
        maps = np.bitwise_and.reduce(slices[positions(hashes[own[live]], step, bits)], axis=1)
        if before is not None:
            maps &= before  # a count reaches a step only if it reached those below
        some = maps.any(axis=1)
        live, before = live[some], maps[some]
        gain = gains(np.minimum(COUNTS[step + 1] - 1, sizes), m)  # the largest count that reaches no further step
        held = np.unpackbits(before, axis=1)[:, :n]
        value[live] += held * (gain - last)[None, :]
        last, step = gain, step + 1
        if COUNTS[step] > most:
            break
    value *= asked.weights[own][:, None]
    at = np.searchsorted(own, np.concatenate([asked.items[i] for i in members]))
    edges = np.cumsum([0, *[len(asked.items[i]) for i in members]])[:-1]
    return np.add.reduceat(value[at], edges, axis=0)


def _candidates(index: DataFrame, asked: Asked, floors: dict | None) -> DataFrame:
    """(item, doc_id, k1, k2, bound): without floors the best k bounds of every task per item, with them all documents that can still be among the best k.

    `floors` has per item the k-th score found so far and its document's id; an item without one has no floor.
    """
    shared = index.sparkSession.sparkContext.broadcast((asked.parts(), word_hashes(asked.terms), floors))
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, hashes, floors = shared.value
        asked = Asked(*sent)
        with_terms = [i for i, own in enumerate(asked.items) if len(own)]
        best: dict[int, list] = {}
        for batch in batches:
            id_type = batch.column("doc_ids").type.value_type
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_buffer() if c == "slices" else batch.column(c)[at].as_py() for c in batch.schema.names}
                ids = row["doc_ids"]
                # ids ascend and nulls come last where bounds tie
                order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)), np.int64)
                out = []
                for a in range(0, len(with_terms), _GROUP):
                    members = with_terms[a : a + _GROUP]
                    for i, bound in zip(members, _bounds(asked, hashes, row, members)):
                        if floors is None:
                            held = best.setdefault(i, [])
                            floor = held[-1][0] if len(held) >= asked.k else 1
                            ranked = order[bound[order] >= floor]
                            ranked = ranked[np.argsort(-bound[ranked], kind="stable")][: asked.k]
                            if len(ranked):
                                held.extend((int(bound[j]), ids[j] is None, ids[j] or 0, row["k1"][j], row["k2"][j]) for j in ranked)
                                held.sort(key=lambda x: (-x[0], x[1], x[2]))
                                del held[asked.k :]
                        else:
                            score, last = floors.get(i, (0, None))
                            for j in np.flatnonzero(bound >= max(score, 1)):
                                if bound[j] > score or (ids[j] is not None and (last is None or ids[j] <= last)) or (ids[j] is None and last is None):
                                    out.append((i, ids[j], row["k1"][j], row["k2"][j], int(bound[j])))
                if out:
                    yield _rows(out, id_type)
        kept = [(i, None if x[1] else x[2], x[3], x[4], x[0]) for i, held in best.items() for x in held]
        if kept:
            yield _rows(kept, id_type)

    return index.mapInArrow(find, f"item int, doc_id {kind}, k1 long, k2 long, bound long")


def _rows(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.int32(), id_type, pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), kinds)], names=["item", "doc_id", "k1", "k2", "bound"])


def _exact(docs: DataFrame, pairs: DataFrame, asked: Asked) -> DataFrame:
    """(item, doc_id, k1, k2, score) of every pair with a score above 0. A text is read once for all items that ask for it; equal rows are scored each."""
    shared = docs.sparkSession.sparkContext.broadcast(asked.parts())
    wanted = stored(pairs.groupBy("k1", "k2").agg(F.collect_set("item").alias("items")))
    rows = docs.select("doc_id", *row_key("doc_id", "text"), whole().alias("text")).join(small_side(wanted), ["k1", "k2"])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(*shared.value)
        at = {t: i for i, t in enumerate(asked.terms)}
        repeats: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            out = []
            for doc_id, k1, k2, text, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k1", "k2")), as_bytes(batch.column("text")), batch.column("items").to_pylist()):
                found = terms(text)
                m = int(asked.norms(np.array(len(found), np.int64)))
                gain = {at[t]: int(asked.weights[at[t]]) * gains(n, m) for t, n in Counter(found).items() if t in at}
                for i in items:
                    if i not in repeats:
                        repeats[i] = list(Counter(asked.items[i].tolist()).items())
                    total = sum(n * gain.get(t, 0) for t, n in repeats[i])
                    if total:
                        out.append((i, doc_id, k1, k2, total))
            if out:
                yield _rows(out, batch.column("doc_id").type).rename_columns(["item", "doc_id", "k1", "k2", "score"])

    return rows.mapInArrow(score, f"item int, doc_id {kind}, k1 long, k2 long, score long")


def _best(pairs: DataFrame, by: str, k: int) -> DataFrame:
    """Best k rows per item, ties by ascending id, nulls last. Spark cuts to k rows per task and item before the shuffle."""
    order = W.partitionBy("item").orderBy(F.desc(by), F.asc_nulls_last("doc_id"), "k1", "k2")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, bits: int = BITS, rows: int = ROWS, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0.

    A null or empty text has no term: such a document is not found and does not count, such an item finds nothing. Equal scores rank by ascending id, null
    ids last; repeated documents rank each, repeated items are answered each; other columns are not read; empty tables give no rows. Texts of any length count whole.
    """
    spark = docs.sparkSession
    index = stored(signatures(docs, bits, rows))
    n_docs, n_terms = index.select(F.size("sizes").alias("d"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("t")).agg(F.sum("d"), F.sum("t")).first()
    listed = stored(items.select("item_id", F.col("text")).withColumn("number", F.monotonically_increasing_id()))
    out, numbers = [], listed.select("number").orderBy("number").toLocalIterator()
    while True:
        block = [r[0] for _, r in zip(range(at_once), numbers)]
        if not block:
            break
        texts = listed.where(F.col("number").between(block[0], block[-1])).orderBy("number").toArrow()
        names = spark.createDataFrame(pa.table({"item": pa.array(range(texts.num_rows), pa.int32()), "item_id": texts.column("item_id")}))
        if n_docs:
            asked = Asked.of(docs, as_bytes(texts.column("text").combine_chunks()), n_docs, n_terms, k)
            first = stored(_exact(docs, _best(_candidates(index, asked, None), "bound", k), asked))
            last = _best(first, "score", k).where(F.col("rank") == k).toArrow().to_pylist()  # one row per item of the block
            floors = {r["item"]: (r["score"], r["doc_id"]) for r in last}
            rest = stored(_candidates(index, asked, floors))
            found = _best(_exact(docs, rest, asked), "score", k)
            out.append(found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not out:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    while len(out) > 1:
        out = [a.unionByName(b) for a, b in zip(out[::2], out[1::2])] + ([out[-1]] if len(out) % 2 else [])
    return out[0]


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The same rows by DuckDB, every pair scored.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM_SQL}') AS w FROM documents),
n AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
t AS (SELECT r, unnest(w) AS term FROM d),
f AS (SELECT r, term, count(*) AS tf FROM t GROUP BY r, term),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM_SQL}') AS w FROM benchmark),
a AS (SELECT q, term, count(*) AS reps FROM (SELECT q, unnest(w) AS term FROM i) GROUP BY q, term),
g AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM f, c GROUP BY term, docs),
s AS (SELECT a.q, f.r, CAST(sum(a.reps * g.weight * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (75 + (25 * n.n * c.docs) // c.terms)))) AS BIGINT) AS score
  FROM a JOIN f USING (term) JOIN g USING (term) JOIN n ON n.r = f.r, c GROUP BY a.q, f.r),
k AS (SELECT s.q, n.doc_id, s.score, row_number() OVER (PARTITION BY s.q ORDER BY s.score DESC, n.doc_id) AS rank FROM s JOIN n USING (r) WHERE s.score > 0)
SELECT i.item_id, CAST(k.rank AS INTEGER) AS rank, k.doc_id, k.score FROM k JOIN i USING (q) WHERE k.rank <= 20"""
