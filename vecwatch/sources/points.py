"""Point tables partitioned by source type and tenant bucket, with changes that persist.

Spark's dynamic partition overwrite replaces exactly the partitions that a change touches. New contents are first written aside in the shared folder and moved from there, so no
file is read and replaced in one job, and a change that was interrupted can be made again: changes name points by id and give the same table when repeated.
A partition that loses its last row keeps one row without a point id, which readers skip.

Changes to one table have to be made one after another; readers of a partition that is being replaced should retry, as with any overwritten parquet folder.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import config as C, schemas
from . import tables

BUCKETS = 64           # tenant buckets per source type; a tenant's points are in one
FILE_ROWS = 500_000    # rows of a partition per file, about


def bucket_of(user_id: Column, buckets: int = BUCKETS) -> Column:
    """The tenant's bucket; points without a tenant are in bucket 0."""
    return F.coalesce(F.pmod(F.xxhash64(user_id), F.lit(buckets)).cast("int") * F.when(user_id.isNotNull(), 1), F.lit(0))


class PointTable:
    """Points under `root`, in folders source_type=../bucket=.."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType = schemas.EVIDENCE_POINTS, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, f"{root.rstrip('/')}/points", schema, buckets
        inner = [f for f in schema.fields if f.name != "source_type"]
        self._stored = T.StructType([*inner, T.StructField("source_type", T.StringType()), T.StructField("bucket", T.IntegerType())])

    def _all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self._stored).parquet(self.path)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], self._stored)

    def rows(self, source_type: str | None = None, users: Iterable[str] | None = None) -> DataFrame:
        """The points, of one source type and some tenants if given: both cut the folders that are listed. Filters on these columns that come later cut them as well."""
        df = self._all().where(F.col("point_id").isNotNull())
        if source_type is not None:
            df = df.where(F.col("source_type") == source_type)
        if users is not None:
            users = sorted(set(users))
            asked = self.spark.createDataFrame([(u,) for u in users], "user_id string").select(bucket_of(F.col("user_id"), self.buckets).alias("b")).distinct()
            df = df.where(F.col("bucket").isin(*[r["b"] for r in asked.collect()]) & F.col("user_id").isin(*users)) if users else df.where(F.lit(False))
        return df.select(*self.schema.fieldNames(), "bucket")

    def of_tenants(self, source_type: str, tenants: DataFrame) -> DataFrame:
        """Points of the tenants in a table (user_id), of any number: their buckets, at most BUCKETS values, cut the folders; a semi join cuts the rows."""
        ids = tenants.select("user_id").where(F.col("user_id").isNotNull()).distinct()
        buckets = [r["b"] for r in ids.select(bucket_of(F.col("user_id"), self.buckets).alias("b")).distinct().collect()]
        df = self.rows(source_type).where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))
        return df.join(ids, "user_id", "left_semi").select(*df.columns)

    def _touched(self, df: DataFrame) -> list[tuple[str, int]]:
        return [(r["source_type"], r["bucket"]) for r in df.select("source_type", "bucket").distinct().collect()]  # at most BUCKETS per source type

    def _inside(self, touched: list[tuple[str, int]]) -> Column:
        cond = F.lit(False)
        for kind in sorted({t for t, _ in touched}):
            cond = cond | ((F.col("source_type") == kind) & F.col("bucket").isin(*sorted(b for t, b in touched if t == kind)))
        return cond

    def _replace(self, df: DataFrame, touched: list[tuple[str, int]]) -> None:
        """Overwrite the touched partitions with `df`, which holds all that they keep."""
        aside = tables.scratch_root(self.spark)
        names = self._stored.fieldNames()
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._stored])
        keep = self.spark.createDataFrame([(t, b) for t, b in touched], "source_type string, bucket int")
        df.unionByName(keep, allowMissingColumns=True).select(*names).write.parquet(aside)
        rows = self.spark.read.schema(self._stored).parquet(aside)
        held = rows.where(F.col("point_id").isNotNull()).groupBy("source_type", "bucket").agg(F.count(F.lit(1)).alias("n"))
        # one row stands for an emptied partition; large partitions get several files
        slices = F.broadcast(keep.join(held, ["source_type", "bucket"], "left").select("source_type", "bucket", F.col("n").isNull().alias("empty"), F.ceil(F.coalesce("n", F.lit(1)) / FILE_ROWS).cast("int").alias("slices")))
        rows = rows.join(slices, ["source_type", "bucket"]).where(F.col("point_id").isNotNull() | F.col("empty"))
        dealt = rows.repartition("source_type", "bucket", F.pmod(F.xxhash64("point_id"), F.col("slices"))).select(*names)
        (dealt.sortWithinPartitions("source_type", "bucket", "user_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("source_type", "bucket").parquet(self.path))

    def upsert(self, new: DataFrame, order: str | None = None) -> None:
        """Points by id: new ones are added, known ones replaced, also where they change tenant or source. Of several rows of an id the last in `order` counts."""
        placed = new.withColumn("bucket", bucket_of(F.col("user_id"), self.buckets))
        placed = tables.latest(placed, ["point_id"], [F.col(order).desc()] if order else [F.col("created_at").desc()]).select(*self._stored.fieldNames())
        aside = tables.scratch_root(self.spark)
        placed.write.parquet(aside)
        placed = self.spark.read.schema(self._stored).parquet(aside)
        was = self._all().where(F.col("point_id").isNotNull())
        touched = sorted(set(self._touched(placed)) | set(self._touched(was.join(placed.select("point_id"), "point_id", "left_semi"))))
        if touched:
            kept = was.where(self._inside(touched)).join(placed.select("point_id"), "point_id", "left_anti")
            self._replace(kept.select(*self._stored.fieldNames()).unionByName(placed), touched)

    def delete(self, ids: DataFrame) -> None:
        """Remove points by id (point_id)."""
        ids = tables.durable(ids.select("point_id").where(F.col("point_id").isNotNull()).distinct())
        self._delete(lambda df, how: df.join(ids, "point_id", how))

    def delete_by(self, source_type: str, column: str, values: DataFrame) -> None:
        """Remove the points of a source type whose `column` is among the first column of `values`, for instance those of deleted watch-list entries."""
        wanted = tables.durable(values.select(F.col(values.columns[0]).alias(column)).where(F.col(column).isNotNull()).distinct())
        self._delete(lambda df, how: df.join(wanted, column, how), source_type)

    def _delete(self, cut, source_type: str | None = None) -> None:
        was = self._all().where(F.col("point_id").isNotNull())
        if source_type is not None:
            was = was.where(F.col("source_type") == source_type)
        touched = self._touched(cut(was, "left_semi"))
        if touched:
            self._replace(cut(was.where(self._inside(touched)), "left_anti").select(*self._stored.fieldNames()), touched)


def delete_entries(gone: DataFrame, entries: DataFrame, references: DataFrame, embeddings: DataFrame, points: PointTable, *, by: str = "entry") -> dict[str, DataFrame]:
    """Delete watch-list entries (or references) with all below them: their points leave the table at once, the other tables are handed back without them."""
    left = tables.cascade_delete(gone, entries, references, embeddings, points.rows(C.SOURCE_BLACKLIST), by=by)
    points.delete(left.pop("removed"))
    return left | {"points": points.rows()}
