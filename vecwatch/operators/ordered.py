"""Order-dependent helpers that do not put a whole key, or the whole table, into one task.

A plain window over a key sorts all rows of that key in one task. Here the
order is cut into buckets: the window runs inside (key, bucket), and only one
small row per (key, bucket) travels on to carry state over the bucket ends.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def carry_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, values: Mapping[str, Column], *, inclusive: bool
) -> DataFrame:
    """For each output name, the last non-null value at or before (or strictly before) each row of its key.

    `bucket` must grow with `order`.
    """
    tagged = df.withColumn("_bucket", bucket)
    end = 0 if inclusive else -1
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    at = F.struct(*order)
    ends = tagged.groupBy(*keys, "_bucket").agg(
        *[F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_end_{n}") for n, v in values.items()])
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*keys, "_bucket", *[F.last(f"_end_{n}", True).over(earlier).alias(f"_carry_{n}") for n in values])
    seen = tagged.select("*", *[F.last(v, True).over(inside).alias(f"_in_{n}") for n, v in values.items()])
    joined = seen.join(carried, [*keys, "_bucket"])
    out = joined.select(*df.columns, *[F.coalesce(f"_in_{n}", f"_carry_{n}").alias(n) for n in values])
    return out


def global_sequence(df: DataFrame, order: Sequence[str], bucket: Column, out: str) -> DataFrame:
    """Consecutive numbers 1..n in table order: position inside a bucket plus the rows of all earlier buckets."""
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(*order))
    return tagged.withColumn("_pos", inside).join(starts, "_bucket").withColumn(out, F.col("_start") + F.col("_pos")).drop("_bucket", "_pos", "_start")


def order_statistics(df: DataFrame, groups: Sequence[str], value: str, ranks: Mapping[str, Column], *, width: int = 1024) -> DataFrame:
    """Elements of the sorted integer values at 0-based ranks, one row per group and one column per rank name.

    A rank is an expression over `n`, the row count of the group. Equal values are counted first, so the
    ordered steps see distinct values only, in value ranges of `width`.
    """
    groups = list(groups) or ["_all"]
    base = df if groups != ["_all"] else df.withColumn("_all", F.lit(0))
    counted = base.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c")).withColumn("_range", F.floor(F.col(value) / F.lit(width)))
    ranges = counted.groupBy(*groups, "_range").agg(F.sum("_c").alias("_rc"))
    before = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("_start", F.coalesce(F.sum("_rc").over(before), F.lit(0))).withColumn("n", F.sum("_rc").over(W.partitionBy(*groups)))
    inside = W.partitionBy(*groups, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    placed = counted.join(ranges, [*groups, "_range"]).withColumn("_hi", F.col("_start") + F.sum("_c").over(inside)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    picks = [F.max(F.when((F.col("_lo") <= r) & (r < F.col("_hi")), F.col(value))).alias(name) for name, r in ranks.items()]
    totals = [F.first("n").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(F.col(value) * F.col("_c")).alias("total")]
    out = placed.groupBy(*groups).agg(*totals, *picks)
    return out.drop("_all") if groups == ["_all"] else out
