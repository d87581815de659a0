"""Tables on plain parquet.

Every table is an append-only log: one directory per writer and batch, written
whole again when that batch is replayed. The present state is the newest row
per key. A replayed micro-batch leaves out its own and later batches of the
same writer, so it sees the state its first run saw, and no file that is being
read is ever overwritten.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from .. import schemas


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="vecwatch-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_root(spark: SparkSession) -> str:
    """A new root for tables inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """The rows, stored in the shared folder and cut from their lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def latest(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key in the given order. Spark cuts to one row per key before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Target with the changes merged in: the last change of a key wins over earlier ones and over the target."""
    columns = target.columns
    newest = latest(changes, keys, [F.col(order).desc()]).select(*columns)
    return target.join(newest.select(*keys), list(keys), "left_anti").select(*columns).unionByName(newest)


def upsert_points(table: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    return upsert(table, new, ("point_id",), order)


def points_by_id(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored points of the asked ids; an id without a point gives no row."""
    return table.join(ids.select("point_id").distinct(), "point_id", "left_semi")


def delete_points(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("point_id"), "point_id", "left_anti")


def delete_batch(table: DataFrame, batch_ids: Sequence[str]) -> DataFrame:
    return table.where(~F.coalesce(F.col("batch_id").isin(*batch_ids), F.lit(False))) if batch_ids else table


def cascade_delete(
    gone: DataFrame, entries: DataFrame, references: DataFrame, embeddings: DataFrame, points: DataFrame, *, by: str = "entry"
) -> dict[str, DataFrame]:
    """Remove entries (or references) with everything below them; `removed` lists the point ids that went."""
    key = "entry_id" if by == "entry" else "reference_id"
    ids = gone.select(F.col("id").alias(key)).distinct()
    own = ids.select(F.col(key).alias("id"))
    removed = embeddings.join(ids, key, "left_semi").select(F.col("qdrant_point_id").alias("point_id"))
    under = references.join(ids, "entry_id", "left_anti") if by == "entry" else references.join(own, "id", "left_anti")
    return {
        "entries": entries.join(own, "id", "left_anti") if by == "entry" else entries,
        "references": under.select(*references.columns),
        "embeddings": embeddings.join(ids, key, "left_anti").select(*embeddings.columns),
        "points": delete_points(points, removed),
        "removed": removed,
    }


class Table:
    """One append-only log table under `root`."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: T.StructType | None = None, keys: Sequence[str] = ()):
        self.spark, self.path, self.name = spark, f"{root.rstrip('/')}/{name}", name
        declared = schemas.TABLES.get(name)
        self.schema = schema or declared[0]
        self.keys = tuple(keys) or (declared[1] if declared else ())

    def write(self, df: DataFrame, batch: int, writer: str = "load") -> None:
        """Write one batch of a writer; a replay of the batch replaces it."""
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        rows = df.select(*cols)
        if {"vector", "user_id"} <= set(self.schema.fieldNames()):
            rows = rows.sortWithinPartitions("user_id")  # narrow min/max per row group, so a tenant's scan skips the others
        rows.write.mode("overwrite").parquet(f"{self.path}/writer={writer}/batch={batch}")

    def log(self, before: int | None = None, job: str | None = None, upto: Mapping[str, int] | None = None) -> DataFrame:
        """All rows with their `writer` and `batch`, without what the job's writers wrote from batch `before` on.

        `upto` pins the other writers as well: each to its last batch named there, one that is not named to nothing.
        """
        full = T.StructType([*self.schema.fields, T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType())])
        try:
            df = self.spark.read.schema(full).parquet(self.path)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], full)
        if before is None:
            return df
        mine, others = F.col("writer").startswith(job), F.lit(True)
        if upto is not None:
            others = F.lit(False)
            for writer, last in upto.items():
                others = others | ((F.col("writer") == writer) & (F.col("batch") <= last))
        return df.where((mine & (F.col("batch") < before)) | (~mine & others))

    def last_batches(self, job: str) -> dict[str, int]:
        """The last batch of every writer that is not the job's (one row per writer)."""
        rows = self.log().where(~F.col("writer").startswith(job)).groupBy("writer").agg(F.max("batch").alias("last")).collect()
        return {r["writer"]: r["last"] for r in rows}

    def written(self, batch: int, writer: str) -> DataFrame:
        """What one batch of a writer holds, read back from storage."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/writer={writer}/batch={batch}")

    def rows(self, before: int | None = None, job: str | None = None, upto: Mapping[str, int] | None = None) -> DataFrame:
        """Every logged row; right for tables whose keys are only ever written once."""
        return self.log(before, job, upto).drop("writer", "batch")

    def current(self, before: int | None = None, job: str | None = None, only: DataFrame | None = None, upto: Mapping[str, int] | None = None) -> DataFrame:
        """Newest row per key, by updated_at where the table has it, then by batch and writer.

        `only` names the rows a job cares about by some columns; the log is cut to them before anything is shuffled.
        """
        rows = self.log(before, job, upto)
        if only is not None:
            rows = rows.join(only.distinct(), only.columns, "left_semi").select(*rows.columns)
        newest = [F.col(c).desc() for c in ("updated_at",) if c in self.schema.fieldNames()]
        return latest(rows, self.keys, [*newest, F.col("batch").desc(), F.col("writer").desc()]).drop("writer", "batch")

    # --- tables with heavy rows: versions are told apart by a small side log, not by sorting the rows ---
    def write_version(self, df: DataFrame, batch: int, writer: str) -> None:
        """Write rows and note which older rows they replace."""
        self.write(df, batch, writer)
        new = self.written(batch, writer).select(*self.keys).distinct()
        old = self.log(batch, writer).select(*self.keys, "writer", "batch").join(new, list(self.keys), "left_semi")
        self._replaced().write(old.select(*self.keys, F.col("writer").alias("old_writer"), F.col("batch").alias("old_batch")), batch, writer)

    def live(self, before: int | None = None, job: str | None = None, upto: Mapping[str, int] | None = None) -> DataFrame:
        """All rows that no later row replaced. The heavy rows are not shuffled while the side log is small."""
        gone = self._replaced().rows(before, job, upto).withColumnsRenamed({"old_writer": "writer", "old_batch": "batch"})
        return self.log(before, job, upto).join(gone, [*self.keys, "writer", "batch"], "left_anti").select(*self.schema.fieldNames())

    def _replaced(self) -> "Table":
        key_fields = [self.schema[k] for k in self.keys]
        side = T.StructType([*key_fields, T.StructField("old_writer", T.StringType()), T.StructField("old_batch", T.LongType())])
        return Table(self.spark, self.path.rsplit("/", 1)[0], f"{self.name}_replaced", side, self.keys)

    def compact_into(self, root: str, rows: DataFrame | None = None) -> "Table":
        """Write the present state (or `rows`, for instance after retention) as the start of a table under another root."""
        target = Table(self.spark, root, self.name, self.schema, self.keys)
        target.write(self.current() if rows is None else rows, 0, "compacted")
        return target


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return Table(spark, root, name).current()


def write_table(df: DataFrame, root: str, name: str, batch: int = 0, writer: str = "load") -> None:
    Table(df.sparkSession, root, name).write(df, batch, writer)
