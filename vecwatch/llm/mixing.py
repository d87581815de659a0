"""Mixing sources to target weights.

The words of a source, its documents in a hashed order one after another, are packed into blocks of fixed length. Every output shard
draws how many of its slots each source fills: a multinomial draw given each source's total, so capped sources keep
their cap and every source meets its target. The draws of a source, numbered through all shards, go through a
pseudorandom permutation of its block numbers, one for each pass over the source, and are joined with the blocks by number.
Everything is DataFrame code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, packed, small_side, stored, whole

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 1 << 14
BUCKET_ROWS = 4096
CHUNK = 1 << 13
ROUNDS = 12


def permuted(x: Column, n: Column, seed: int, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1 applied to x: swap-or-not rounds, each its own inverse, for any n."""

    def turn(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), r, *key), n) - at, n)
        return F.when(F.pmod(F.xxhash64(F.lit(seed + 1), r, *key, F.greatest(at, partner)), F.lit(2)) == 1, partner).otherwise(at)

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), x.cast("long"), turn)


@dataclass
class Mix:
    placed: DataFrame  # doc_id, source, size, k, sid, start: where a document's words lie in its source's stream
    sources: DataFrame  # source, sid, weight, source_size, target, n_blocks, draws, first_draw
    shards: DataFrame  # shard, sid, slots, first: drawn counts, and the number of the first draw
    slots: DataFrame  # shard, sid, draw, block
    pieces: DataFrame  # sid, start, skip, words, times: the part of a document that lies in one block


def _sources(sizes: DataFrame, weights, cap: int, block_words: int) -> DataFrame:
    """Targets: the whole size is shared by weight; who would pass its cap keeps the cap, and the rest is shared again.

    The end of that resharing is one level: target = min(cap * size, level * weight). With the sources in order of cap / weight, the level is
    found from running sums. The windows hold one narrow row per source.
    """
    one = F.lit(1)
    rank = W.orderBy(F.col("source").asc_nulls_last())
    by = W.partitionBy(one).orderBy("full", "sid")
    before, rest = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    all_rows = W.partitionBy(one)
    out = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(one).alias("n_rows"))
    out = out.withColumn("sid", (F.row_number().over(rank) - 1).cast("long"))
    out = out.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    out = out.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("full", F.col("most") / F.col("weight"))
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    out = out.withColumn("level", level)
    # the level is that of the first source, in this order, which it does not fill
    out = out.withColumn("level", F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "sid", "level"))).over(all_rows)["level"])
    out = out.withColumn("target", F.least(F.col("most"), F.col("level") * F.col("weight")))
    out = out.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    # as many draws as blocks of the source's mean length make up the target
    draws = F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long")
    out = out.withColumn("draws", F.when(F.col("source_size") > 0, F.least(draws, F.col("n_blocks") * cap)).otherwise(F.lit(0).cast("long")))
    numbered = W.partitionBy(one).orderBy("sid").rowsBetween(W.unboundedPreceding, -1)
    return out.withColumn("first_draw", F.coalesce(F.sum("draws").over(numbered), F.lit(0)).cast("long")).withColumn("n_draws", F.sum("draws").over(all_rows)).drop("most", "full", "level")


def _spread(df: DataFrame, count: str, name: str) -> DataFrame:
    """A row for each number below `count`, made in two steps so that no task makes all numbers of a large source."""
    top = F.floor((F.col(count) - 1) / CHUNK)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number: few small rows that become many are not to be coalesced
    out = df.where(F.col(count) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), top.cast("long")))).repartition(parts, "sid", "_chunk")
    a = F.col("_chunk") * CHUNK
    return out.withColumn(name, F.explode(F.sequence(a, F.least(a + CHUNK, F.col(count)) - 1))).drop("_chunk")


def plan(docs: DataFrame, *, weights=WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> Mix:
    sizes = stored(docs.select("doc_id", "source", F.xxhash64("doc_id", "source", "text").alias("k"), F.regexp_count(whole(), F.lit(WORD)).cast("long").alias("size")))
    sources = stored(_sources(sizes, weights, cap, block_words))
    facts = small_side(sources.select(F.col("source").alias("_source"), "sid", "n_rows"))
    rows = sizes.join(facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # a source's rows are dealt into buckets of bounded size; sums of buckets give each bucket's start
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "k"), F.ceil(F.col("n_rows") / BUCKET_ROWS)))
    within = W.partitionBy("sid", "bucket").orderBy("k", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    buckets = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("_n"))
    offset = F.sum("_n").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    buckets = buckets.select("sid", "bucket", offset.alias("_offset"))
    placed = rows.withColumn("_end", F.sum("size").over(within)).join(buckets, ["sid", "bucket"])
    placed = stored(placed.select("doc_id", "source", "size", "k", "sid", (F.col("_offset") + F.col("_end") - F.col("size")).alias("start")))

    n = F.col("n_draws")
    drawn = _spread(sources.select("sid", "draws", "first_draw", "n_draws"), "draws", "i")
    shard = F.floor(permuted(F.col("first_draw") + F.col("i"), n, seed) / shard_slots)
    shards = drawn.groupBy(shard.alias("shard"), "sid").agg(F.count(F.lit(1)).alias("slots"))
    shards = shards.withColumn("first", F.sum("slots").over(W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("slots"))
    shards = stored(shards)
    facts = small_side(sources.select("sid", "n_blocks"))
    slots = _spread(shards.join(facts, "sid"), "slots", "i").withColumn("draw", F.col("first") + F.col("i"))
    nb = F.col("n_blocks")
    slots = slots.withColumn("block", permuted(F.col("draw") % nb, nb, seed + 2, F.col("sid"), F.floor(F.col("draw") / nb)))
    slots = slots.select("shard", "sid", "draw", "block")

    a, end, size = F.col("start"), F.col("start") + F.col("size"), F.lit(block_words)
    cut = placed.where("size > 0").select("sid", "start", "size", F.explode(F.sequence(F.floor(a / size), F.floor((end - 1) / size))).alias("block"))
    low = F.greatest(a, F.col("block") * size)
    cut = cut.select("sid", "start", "block", (low - a).alias("skip"), (F.least(end, (F.col("block") + 1) * size) - low).alias("words"))
    times = slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    pieces = cut.join(times, ["sid", "block"]).select("sid", "start", "skip", "words", "times")
    return Mix(placed, sources, shards, slots, pieces)


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken.

    Null and empty texts have size 0 and are taken 0 times. A null source is a source of its own, last in order. A source without
    words has target 0. Repeated rows lie one after another in the stream and are taken each for itself. Other columns are not read, an empty table gives no
    rows. The draw depends on the rows alone, so reruns agree.
    """
    m = plan(docs, **how)
    taken = m.pieces.groupBy("sid", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    taken = taken.select(F.col("sid").alias("_sid"), F.col("start").alias("_start"), "taken")
    facts = small_side(m.sources.select("sid", "source_size", "target"))
    own = (F.col("sid") == F.col("_sid")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0)
    return m.placed.join(facts, "sid").join(taken, own, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents with the columns of `docs`: copy c of a document has, in order, the words of its blocks taken c times or more.

    A copy with all words keeps the text as it is, another has its words joined by one space (and its n_chars counted anew). Rows that repeat in doc_id, source
    and text follow one plan.
    """
    m = plan(docs, **how)
    parts = m.pieces.groupBy("sid", "start").agg(F.sort_array(F.collect_list(F.struct("skip", "words", "times"))).alias("_parts"))
    parts = m.placed.where("size > 0").join(parts, ["sid", "start"])
    parts = parts.groupBy(F.col("k").alias("_k"), F.col("doc_id").alias("_id")).agg(F.min(F.struct("start", "size", "_parts")).alias("_p"))
    parts = parts.select("_k", "_id", "_p.size", "_p._parts").withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max("_parts.times"))))
    parts = parts.select("_k", "_id", "size", F.filter("_parts", lambda p: p["times"] >= F.col("_c")).alias("_parts"))
    parts = parts.select("_k", "_id", F.struct("size", "_parts").alias("plan"))
    out = packed(docs).withColumn("key", F.xxhash64("row.doc_id", "row.source", "row.text"))
    out = out.join(parts, (F.col("key") == F.col("_k")) & F.col("row.doc_id").eqNullSafe(F.col("_id")))
    full = F.aggregate("plan._parts", F.lit(0).cast("long"), lambda n, p: n + p["words"]) == F.col("plan.size")
    out = out.withColumn("full", full).withColumn("words", F.when(~F.col("full"), F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0))))
    cut = F.transform("plan._parts", lambda p: F.slice(F.col("words"), (p["skip"] + 1).cast("int"), p["words"].cast("int")))
    text = F.when(F.col("full"), F.col("row.text")).otherwise(F.array_join(F.flatten(cut), " "))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("full"), F.col("row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
