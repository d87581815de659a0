"""MinHash near-deduplication with tensored banding.

A document is the set of its distinct word shingles. Documents with equal sets form one class first. A class has two small collections of
minhash bands, SIDE bands of BAND hashes each; a table key is a pair of one band of the first and one of the second collection,
so SIDE * SIDE tables of 2 * BAND hashes cost 2 * SIDE * BAND minhashes. Two classes of similarity s share a key with
probability (1 - (1 - s**BAND)**SIDE)**2, over 0.9998 at 0.8.

Candidates are confirmed on full sets. Within a key everyone is first compared with the key's lead, the class that meets most others. Components of the
confirmed links then leave only pairs across components of one key. Of these, pairs near a common lead are bounded by what they share inside and outside the
lead; others meet by one of their rarest shingles near it and are bounded by their distances to it, their sizes and all their minhashes. What may still be a link is compared. A large group of copies or near copies is
thus one pair per member, and no key emits all its pairs. Components come from min-label rounds on stored link tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import as_bytes, bounded_batches, lowered_words, mixed, packed, row_key, shingle_hashes, slices, stored, unpacked, whole, word_hashes

SIDE = 9
BAND = 2
HASHES = 2 * SIDE * BAND
#: Pairs of similarity 0.8 agree in fewer of the 36 minhashes with a probability below 1e-6 (binomial tail).
LEAST_EQUAL = 16
#: Bytes of a minhash that pairs are first compared by.
PRINT = 2
#: Classes alike by so many percent are near one another: what they do not share is short.
NEAR = 50
SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, k1 long, k2 long, mins binary"


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a text with fewer words than n is one shingle, one without words has none."""
    words = lowered_words(text)
    return np.unique(shingle_hashes(word_hashes(words), min(n, len(words)))) if words else np.zeros(0, np.uint64)


def minhashes(shingles: np.ndarray, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function; the shingle hashes are scrambled already, so a multiply and add serves."""
    parts = [(shingles[i : i + 16384] * odd[:, None] + add[:, None]).min(axis=1) for i in range(0, len(shingles), 16384)]
    return np.minimum.reduce(parts)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    drawn = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return drawn[:HASHES] | np.uint64(1), drawn[HASHES:]


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """Per row: size and 128-bit digest of its set, a key of the row, and its minhashes."""
    odd, add = _functions()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for whole_batch in batches:
            for batch in slices(whole_batch):
                size, d1, d2, mins = [], [], [], []
                for text in as_bytes(batch.column("text")):
                    found = shingle_set(text, n)
                    a, b = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64)
                    size.append(len(found))
                    d1.append(a)
                    d2.append(b)
                    mins.append(minhashes(found, odd, add).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), batch.column("k1"), batch.column("k2"), pa.array(mins, pa.binary())],
                    names=[x.split()[0] for x in SIGNED.split(", ")])

    return bounded_batches(docs.select("doc_id", "text", *row_key("doc_id", "text"))).mapInArrow(sign, SIGNED)


def table_keys(classes: DataFrame) -> DataFrame:
    """A row for each class and table: the key pairs a band of the first collection with one of the second."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.arange(SIDE * SIDE, dtype=np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                mins = np.frombuffer(b"".join(part.column("mins").to_pylist()), np.uint64).reshape(-1, 2, SIDE, BAND)
                bands = np.zeros(mins.shape[:3], np.uint64)
                for i in range(BAND):
                    bands = mixed(bands * np.uint64(3) + mins[..., i])
                keys = mixed(bands[:, 0, :, None] * np.uint64(5) + bands[:, 1, None, :]).reshape(-1, SIDE * SIDE)
                keys = mixed(keys + tables)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column("cls").to_numpy(), SIDE * SIDE))], names=["key", "cls"])

    return classes.select("cls", "mins").mapInArrow(pair, "key long, cls long")


JUDGED = "a long, b long, linked boolean, inside int, size_b int, outside array<bigint>"


def _texts(asked: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cls, text): the text of one row of each class asked for."""
    asked = asked.select("cls").distinct().join(classes.select("cls", "k1", "k2"), "cls")
    texts = docs.select(whole().alias("text"), *row_key("doc_id", "text"))
    return texts.join(asked.hint("shuffle_hash"), ["k1", "k2"]).groupBy("cls").agg(F.any_value("text").alias("text"))


def _shingles(texts: DataFrame, n: int) -> DataFrame:
    """(cls, tokens): the shingle set of every class."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in slices(whole_batch):
                found = [shingle_set(text, n).view(np.int64) for text in as_bytes(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(found, pa.list_(pa.int64()))], names=["cls", "tokens"])

    return bounded_batches(texts).mapInArrow(cut, "cls long, tokens array<bigint>")


def judged(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int, outside_too: bool = True) -> DataFrame:
    """Compares the class pairs (a, b) on full sets: whether they are linked, how much of b lies inside a, and, if they are alike by NEAR percent, what of b lies outside.

    Texts of one row per class are read again, and only of classes in a pair."""
    texts = stored(_texts(pairs.select(F.explode(F.array("a", "b")).alias("cls")), classes, docs))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for whole_batch in batches:
            for batch in (part for half in slices(whole_batch, "text_b") for part in slices(half, "text_a")):
                out = ([], [], [], [])
                for x, y in zip(as_bytes(batch.column("text_a")), as_bytes(batch.column("text_b"))):
                    if x != last:
                        last, other = x, shingle_set(x, n)
                    own = shingle_set(y, n)
                    inside = np.isin(own, other, assume_unique=True)
                    both = int(inside.sum())
                    union = len(own) + len(other) - both
                    outside = own[~inside].view(np.int64) if outside_too and 100 * both >= NEAR * union else None
                    for column, value in zip(out, (100 * both >= percent * union, both, len(own), outside)):
                        column.append(value)
                columns = [pa.array(v, t) for v, t in zip(out, (pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *columns], names=["a", "b", "linked", "inside", "size_b", "outside"])

    left = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
    # a lead's text stands in the row of each of its pairs
    return stored(bounded_batches(pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")).mapInArrow(compare, JUDGED))


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable class of every class in a link: (cls, root). Each round every class takes the smallest root of its neighbours, then roots
    are followed once more; the rounds end when nothing changes. Every step of a round is stored before the next one reads it: a step that is read
    several times inside one plan is planned, and its sides are broadcast by the driver, several times at once."""
    links = stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    roots = stored(links.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = links.join(roots.select(F.col("cls").alias("b"), "root"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("root").alias("near"))
        told = stored(roots.join(near, "cls").select("cls", "root", F.least("root", "near").alias("low")))
        # a smaller root found by one member is told to the old root, and everyone follows its root's root
        hooks = told.where("low < root").groupBy(F.col("root").alias("cls")).agg(F.min("low").alias("hook"))
        told = stored(told.join(hooks, "cls", "left").select("cls", "root", F.least("low", "hook").alias("low")))
        jump = told.select(F.col("cls").alias("low"), F.col("low").alias("next"))
        moved = stored(told.join(jump, "low").select("cls", F.col("root").alias("was"), F.least("low", "next").alias("root")))
        roots = moved.select("cls", "root")
        if moved.where("root <> was").isEmpty():
            return roots


def _joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, root) after more links: these join components found before, so only the roots at their ends go through the rounds again."""
    ends = _rooted(_rooted(links, roots, "a", "root_a"), roots, "b", "root_b")
    over = components(ends.where("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    over = over.select(F.col("cls").alias("root"), F.col("root").alias("over"))
    moved = roots.join(over, "root", "left").select("cls", F.coalesce("over", "root").alias("root"))  # a large component is one skewed key, which Spark splits at run time
    new = over.join(roots.select(F.col("cls").alias("root")), "root", "left_anti").select(F.col("root").alias("cls"), F.col("over").alias("root"))
    return stored(moved.union(new))


def near_components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, its digest and keys, and component_id."""
    rows = stored(signatures(docs, n))
    groups = rows.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min(F.struct("k1", "k2", "n_shingles", "mins")).alias("one"), F.min("doc_id").alias("least_id"))
    classes = stored(groups.select("d1", "d2", "least_id", "one.*").withColumn("cls", F.monotonically_increasing_id()))
    sizes = classes.select("cls", "n_shingles", "mins")
    shared = _shared_keys(classes)
    pairs = shared.where("cls <> lead").select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct()
    told = judged(_possible(pairs, sizes, percent), classes, docs, n, percent)
    links = told.where("linked").select("a", "b")
    roots = components(links)
    rest = stored(_near_rest(told, roots, percent).union(_far_rest(shared, told, roots, sizes, percent, lambda asked: _shingles(_texts(asked, classes, docs), n))).distinct())
    if not rest.isEmpty():
        roots = _joined_roots(roots, judged(rest, classes, docs, n, percent, outside_too=False).where("linked").select("a", "b"))
    classes = stored(_rooted(classes.select("cls", "least_id", "d1", "d2"), roots, "cls", "root"))
    names = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = classes.join(names, "root").select("d1", "d2", "component_id")
    # a set that a great many documents share is one skewed key of this join, which Spark splits at run time
    return rows.join(named, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "k1", "k2")


def _shared_keys(classes: DataFrame) -> DataFrame:
    """(key, cls, lead) of every key that two or more classes have. The lead is the class that meets most others over all its keys:
    in a group of copies of one text that is the text they were made from, or one close to it."""
    keys = table_keys(classes)
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(keys.join(counts, "key"))
    met = shared.groupBy("cls").agg(F.sum("n").alias("met"))
    shared = shared.select("key", "cls").join(met, "cls")
    leads = shared.groupBy("key").agg(F.max("met").alias("met"))
    leads = shared.join(leads, ["key", "met"]).groupBy("key").agg(F.min("cls").alias("lead"))
    return stored(shared.select("key", "cls").join(leads, "key"))


def _rooted(df: DataFrame, roots: DataFrame, cls: str, root: str) -> DataFrame:
    own = roots.select(F.col("cls").alias(cls), F.col("root").alias(root))
    return df.join(own, cls, "left").withColumn(root, F.coalesce(F.col(root), F.col(cls)))


def _near_rest(told: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs that may be links among the classes near one lead, where one of them is not in the lead's component.

    What two classes share is inside the lead, at most the smaller of their parts inside, or outside it. So without a common shingle outside
    only pairs whose parts inside suffice can be links, which are few as one of them is no link of the lead; the others are found by a common shingle among their
    rarest ones outside (a prefix filter).
    """
    near = told.where(F.col("outside").isNotNull())
    near = stored(_rooted(_rooted(near, roots, "b", "root"), roots, "a", "lead_root").select("a", "b", "inside", "size_b", "outside", "root", "lead_root"))
    x = near.where("root <> lead_root").select("a", *[F.col(c).alias(f"{c}_x") for c in ("b", "inside", "size_b", "outside", "root")])
    y = near.select("a", *[F.col(c).alias(f"{c}_y") for c in ("b", "inside", "size_b", "outside", "root")])
    across = F.col("root_x") != F.col("root_y")
    enough = lambda more: 100 * (F.least("inside_x", "inside_y") + more) >= percent * (F.col("size_b_x") + F.col("size_b_y") - F.least("inside_x", "inside_y") - more)
    a_x, a_y = x.drop("outside_x").withColumnRenamed("a", "a_x"), y.drop("outside_y").withColumnRenamed("a", "a_y")
    inner = a_x.join(a_y, (F.col("a_x") == F.col("a_y")) & across & _sized("size_b_x", "size_b_y", percent) & enough(F.lit(0))).select("b_x", "b_y")
    # shingles outside in order of rarity near the lead: pairs that share as many as they need share one within the first ones of each
    tokens = near.select("a", "b", "inside", "size_b", "root", "lead_root", F.size("outside").alias("q"), F.explode("outside").alias("token"))
    often = tokens.groupBy("a", "token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    alone = F.coalesce(F.col("often"), F.lit(1))
    tokens = tokens.join(often, ["a", "token"], "left").withColumn("pos", F.row_number().over(W.partitionBy("a", "b").orderBy(alone, "token")))
    tokens = stored(tokens.where("often > 1"))
    t_x = tokens.where("root <> lead_root").select(*[F.col(c).alias(f"{c}_x") for c in ("a", "token", "b", "inside", "size_b", "root", "q", "pos")])
    t_y = tokens.select(*[F.col(c).alias(f"{c}_y") for c in ("a", "token", "b", "inside", "size_b", "root", "q", "pos")])
    wanted = F.ceil(percent * (F.col("size_b_x") + F.col("size_b_y")) / (100 + percent) - 1e-6) - F.least("inside_x", "inside_y")
    wanted = F.greatest(wanted, F.lit(1))
    early = (F.col("pos_x") <= F.col("q_x") - wanted + 1) & (F.col("pos_y") <= F.col("q_y") - wanted + 1)
    met = t_x.join(t_y, (F.col("a_x") == F.col("a_y")) & (F.col("token_x") == F.col("token_y")) & across & _sized("size_b_x", "size_b_y", percent) & early)
    outer = met.select("b_x", "b_y").distinct()
    return inner.union(outer).select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b"))


def _far_rest(shared: DataFrame, told: DataFrame, roots: DataFrame, sizes: DataFrame, percent: int, shingles_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs around one lead, across components, that are not both near it: those whose distances to the lead, sizes and minhashes leave a link possible.

    They are found by a common shingle among their rarest ones (a prefix filter), not by the keys they share, as all that have a long passage in common share keys.
    Minhashes tell first, in the same way, which classes have none to meet; the shingles of the others are taken from their texts again."""
    distance = 1 - F.col("inside") / (F.col("size_b") + F.col("size_a") - F.col("inside"))
    known = told.join(sizes.select(F.col("cls").alias("a"), F.col("n_shingles").alias("size_a")), "a").select(
        F.col("a").alias("lead"), F.col("b").alias("cls"), distance.alias("d"), F.col("outside").isNotNull().alias("near"))
    # what is known of a class and a lead is joined once, not for each key they share
    shared = shared.where("cls <> lead")
    facts = _rooted(shared.select("lead", "cls").distinct(), roots, "cls", "root").join(sizes.select("cls", "n_shingles"), "cls")
    facts = stored(facts.join(known, ["lead", "cls"], "left").withColumn("near", F.coalesce("near", F.lit(False))))
    split = shared.join(facts.select("lead", "cls", "root", "near"), ["lead", "cls"])
    split = split.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count_if(~F.col("near")).alias("far")).where("lo < hi and far > 0")
    asked = stored(shared.join(split.select("key"), "key", "left_semi").select("lead", "cls").distinct())
    if asked.isEmpty():  # no key has classes of several components that are not all near its lead
        return asked.select(F.col("lead").alias("a"), F.col("cls").alias("b"))
    prints = F.concat(*[F.substring("mins", i * 8 + 1, PRINT) for i in range(HASHES)])
    rows = stored(facts.join(asked, ["lead", "cls"], "left_semi").join(sizes.select("cls", prints.alias("prints")), "cls"))
    # pairs that agree in LEAST_EQUAL minhashes share one among the first ones of each, in order of rarity near the lead: what all have in common is not looked at
    words = F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: F.xxhash64(i, F.substring(F.col("mins"), i * 8 + 1, F.lit(8))))
    cut = sizes.join(asked.select("cls").distinct(), "cls", "left_semi").select("cls", F.explode(words).alias("token"))  # once for a class, however many leads it has
    tokens = stored(asked.join(cut, "cls").select("lead", "cls", "token"))
    often = tokens.groupBy("lead", "token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    order = W.partitionBy("lead", "cls").orderBy(F.coalesce("often", F.lit(1)), "token")
    early = tokens.join(often, ["lead", "token"], "left").withColumn("pos", F.row_number().over(order)).where((F.col("pos") <= HASHES - LEAST_EQUAL + 1) & (F.col("often") > 1))
    early = stored(early.select("lead", "cls", "token").join(rows.drop("prints"), ["lead", "cls"]))
    meet = early.groupBy("lead", "token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count_if(~F.col("near")).alias("far")).where("lo < hi and far > 0")
    rows = stored(rows.join(early.join(meet, ["lead", "token"], "left_semi").select("lead", "cls").distinct(), ["lead", "cls"]))
    # sets that are links share one of the first shingles of each in any order, for a set of n those before the last percent * n / 100
    tokens = stored(rows.select("lead", "cls", "n_shingles").join(shingles_of(rows), "cls").select("lead", "cls", "n_shingles", F.explode("tokens").alias("token")))
    often = tokens.groupBy("lead", "token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    early = tokens.join(often, ["lead", "token"], "left").withColumn("pos", F.row_number().over(order))
    early = early.where((F.col("pos") <= F.floor((100 - percent) * F.col("n_shingles") / 100 + 1e-6) + 1) & (F.col("often") > 1))
    early = stored(early.select("lead", "cls", "token").join(rows, ["lead", "cls"]))
    x, y = early.where("not near").select(*[F.col(c).alias(f"{c}_x") for c in early.columns]), early.select(*[F.col(c).alias(f"{c}_y") for c in early.columns])
    slack = 1 - percent / 100 + 1e-9  # distances obey the triangle inequality; a class the lead was not compared with may be at any
    apart = F.coalesce(F.abs(F.col("d_x") - F.col("d_y")) <= slack, F.lit(True))
    once = F.col("near_y") | (F.col("cls_x") < F.col("cls_y"))
    pairs = x.join(y, (F.col("lead_x") == F.col("lead_y")) & (F.col("token_x") == F.col("token_y")) & once & (F.col("root_x") != F.col("root_y")) & apart
                   & _sized("n_shingles_x", "n_shingles_y", percent) & (_equal("prints_x", "prints_y") >= LEAST_EQUAL))
    return pairs.select(F.least("cls_x", "cls_y").alias("a"), F.greatest("cls_x", "cls_y").alias("b"))


def _sized(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _equal(a: str, b: str):
    """Number of equal minhashes of two signatures, by the prints of their minhashes: never fewer than are equal."""
    same = lambda i: F.substring(F.col(a), i * PRINT + 1, F.lit(PRINT)) == F.substring(F.col(b), i * PRINT + 1, F.lit(PRINT))
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(HASHES - 1)), same))


def _possible(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity."""
    left = sizes.select(F.col("cls").alias("a"), F.col("n_shingles").alias("size_a"))
    right = sizes.select(F.col("cls").alias("b"), F.col("n_shingles").alias("size_b"))
    return stored(pairs.join(left, "a").join(right, "b").where(_sized("size_a", "size_b", percent)).select("a", "b"))


def near_dedup(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs`.

    Null and empty texts, and texts of white space alone, have an empty set and stay by themselves. Rows that repeat a text are one class; rows that repeat doc_id and text have the same
    answer. A null doc_id never names a component that has another id; a component of null ids alone is named null and kept.
    Long texts are taken whole. Other columns are not read. An empty table gives no rows.
    """
    out = near_components(docs, n, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of `docs` for each group, with all its columns."""
    kept = near_components(docs, n, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("k1", "k2").distinct()
    rows = packed(docs).select("row", *row_key("row.doc_id", "row.text")).join(kept, ["k1", "k2"], "left_semi")
    return unpacked(rows.groupBy("k1", "k2").agg(F.any_value("row").alias("row")), docs)
