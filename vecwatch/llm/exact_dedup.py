"""Exact deduplication by a tree merge of sorted digest runs.

Every partition first sorts its digests into a run with one entry per digest: the smallest id, the number of rows, the
length of the text. Runs are then exchanged in binomial rounds: in round r a run passes each entry to the partition whose number
agrees with its own but for the r-th digit, which is taken from the digest. What arrives is sorted again as a whole, not merged run by run, and the smallest
identifier of entries that agree in the whole digest and length is kept. There are 8 places a digit, so 8 or fewer shuffle partitions mean one round, a plain shuffle by digest. After the last round a partition holds
one share of all digests, each complete. A frequent text is one entry per run from the first level on, so no task ever
holds its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SPACE, packed, stored, unpacked, whole

#: Runs that meet in one merge, as a power of two.
DIGIT = 3
RUN = "at long, sha binary, length long, keep_id long, group_size long"
NO_ID = np.iinfo(np.int64).max


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges entries of runs that come sorted by place and digest: one entry per place, digest and length leaves."""
    names, last = [x.split()[0] for x in RUN.split(", ")], None
    for batch in batches:
        at, length = (np.asarray(batch.column(c)) for c in ("at", "length"))
        size = np.asarray(batch.column("group_size"))
        ids = batch.column("keep_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        sha = np.frombuffer(b"".join(batch.column("sha").to_pylist()), np.uint64).reshape(-1, 4)
        if last is not None:
            at, length, ids, size = (np.concatenate([[x], y]) for x, y in zip((last[0], last[2], last[3], last[4]), (at, length, ids, size)))
            sha = np.concatenate([last[1][None], sha])
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (length[1:] != length[:-1]) | (sha[1:] != sha[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        at, sha, length = at[first], sha[first], length[first]
        ids, size = np.minimum.reduceat(ids, first), np.add.reduceat(size, first)
        last = (at[-1], sha[-1], length[-1], ids[-1], size[-1])
        if len(at) > 1:
            yield _run(names, at[:-1], sha[:-1], length[:-1], ids[:-1], size[:-1])
    if last is not None:
        yield _run(names, *(np.array([x]) for x in last))


def _run(names, at, sha, length, ids, size) -> pa.RecordBatch:
    ids = pa.array(ids, pa.int64(), mask=ids == NO_ID)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array([x.tobytes() for x in sha], pa.binary()), pa.array(length), ids, pa.array(size)], names=names)


def digests(docs: DataFrame) -> DataFrame:
    """Id, SHA-256 and length of every text after each run of white space became one space."""
    text = F.regexp_replace(whole(), SPACE, " ")
    return docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).cast("long").alias("length"))


def merged_groups(rows: DataFrame, rounds: int | None = None) -> DataFrame:
    """Digest, length, smallest id and number of rows of every distinct text. `rounds` defaults to what covers the shuffle partitions."""
    fan = 1 << DIGIT
    if rounds is None:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rounds = max(1, -(-(max(1, parts - 1)).bit_length() // DIGIT))
    places = fan**rounds
    # the last four bytes of a digest give its place; the sort by the whole digest is not bent by them
    home = F.conv(F.substring(F.hex("sha"), -8, 8), 16, 10).cast("long") % places
    runs = rows.select(
        (F.spark_partition_id() % places).cast("long").alias("at"), "sha", "length", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    runs = runs.sortWithinPartitions("at", "sha", "length").mapInArrow(merge_runs, RUN)
    for r in range(rounds):
        low = fan**r
        digit = lambda x: F.floor(x / low) % fan
        at = (F.col("at") + (digit(home) - digit(F.col("at"))) * low).cast("long")
        runs = runs.withColumn("at", at).repartition(places, "at").sortWithinPartitions("at", "sha", "length").mapInArrow(merge_runs, RUN)
    return runs.drop("at")


def exact_dedup(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    A null text is an empty one, and all empty texts are one group. A null doc_id is never the smallest while another is there; a
    group of null ids has keep_id null, and its rows stay (kept is true, as no identifier tells them apart). Rows that repeat
    both doc_id and text have the same answer, so all of them are kept or none. Other columns are not read. An empty table gives no rows.
    """
    rows = stored(digests(docs))
    groups = merged_groups(rows, rounds)
    # a digest with a great many rows is one skewed key of this join, which Spark splits at run time
    return rows.join(groups, ["sha", "length"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of rows that repeat id and text, one."""
    keyed = packed(docs).withColumn("sha", F.sha2(F.regexp_replace(whole("row.text"), SPACE, " "), 256))
    names = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("own")).distinct()
    kept = keyed.join(names, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("own")), "left_semi")
    once = kept.groupBy(F.col("row.doc_id").alias("id"), "sha").agg(F.any_value("row").alias("row"))
    return unpacked(once, docs)
