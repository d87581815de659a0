"""Counts, coverage, latency and volume reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import config as C
from ..functions import text, timing
from ..sources.tables import durable, latest
from . import ordered, predicates as P


def status_counts(df: DataFrame, labels: Mapping[int, str]) -> DataFrame:
    """One row per label, zeros included."""
    wide = df.agg(*[F.count_if(F.col("status") == code).alias(name) for code, name in labels.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in labels.values())
    return wide.selectExpr(f"stack({len(labels)}, {pairs}) as (status_name, n)")


def counts_by_entry(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows per entry for the asked entries; an entry without rows has no line."""
    asked = ids.select(F.col("id").alias("entry_id")).distinct()
    return rows.join(asked, "entry_id", "left_semi").groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"))


def total(df: DataFrame, name: str = "total") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def distinct_categories(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("category").isNotNull()).select("category").distinct()


def categories(requests: DataFrame, caller: P.Caller) -> DataFrame:
    """Entity ids in use with their labels, by id. Texts that are no integer lists are skipped."""
    scoped = requests if caller.is_admin else P.tenant_scope(requests, caller)
    raw = F.from_json("category", "array<string>")
    ids = distinct_categories(scoped).select(F.explode(raw).alias("raw")).where(F.col("raw").rlike("^-?[0-9]+$"))
    found = ids.select(F.col("raw").try_cast("bigint").alias("id")).where("id is not null").distinct()
    return found.withColumn("label", text.entity_label(F.col("id"))).orderBy("id")


def coverage(requests: DataFrame, since: Column) -> DataFrame:
    recent = requests.where(F.col("created_at") > since)
    return recent.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("weapon_analyzed").alias("analyzed"), F.count_if("has_weapon").alias("with_weapons"),
        F.count_if(F.col("weapon_analyzed") & ~F.col("has_weapon")).alias("clean"),
        F.count_if(F.col("status") == C.REQUEST_ERROR).alias("errors"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def daily_coverage(requests: DataFrame, since: Column) -> DataFrame:
    recent = requests.where(F.col("created_at") > since)
    return recent.groupBy(timing.day_of(F.col("created_at")).alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("weapon_analyzed").alias("analyzed"), F.count_if("has_weapon").alias("with_weapons"),
        F.count_if(F.col("weapon_analysis_error").isNotNull()).alias("analysis_errors")).orderBy(F.col("day").desc())


PHASES = ("queue_wait", "processing", "total")


def phase_times(requests: DataFrame, start: Column, end: Column) -> DataFrame:
    """(phase, ms) rows of analysed requests created in [start, end) with a stream id and an end time."""
    used = requests.where(
        F.col("weapon_analyzed") & (F.col("created_at") >= start) & (F.col("created_at") < end)
        & F.col("stream_message_id").isNotNull() & F.col("processing_completed_at").isNotNull())
    t = used.select(timing.stream_id_ms(F.col("stream_message_id")).alias("i"), timing.epoch_ms(F.col("created_at")).alias("p"),
                    timing.epoch_ms(F.col("processing_completed_at")).alias("c"))
    return t.selectExpr("stack(3, 'queue_wait', p - i, 'processing', c - p, 'total', c - i) as (phase, ms)")


def summarize_times(times: DataFrame) -> DataFrame:
    """count, min, interpolated p50/p90/p99, max and mean per phase, rounded to whole milliseconds.

    The two neighbours of each percentile are picked by rank, so no task holds all values.
    """
    wanted = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    ranks: dict[str, Column] = {}
    at = lambda p: (F.col("n") - 1) * F.lit(p)
    for name, p in wanted.items():
        ranks[f"{name}_lo"], ranks[f"{name}_hi"] = F.floor(at(p)), F.ceil(at(p))
    found = ordered.order_statistics(times, ["phase"], "ms", ranks)
    mixed = lambda name, p: F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (at(p) - F.floor(at(p)))
    whole = lambda c: F.rint(c).cast("bigint")
    return found.select(
        "phase", F.col("n").alias("n"), "min", *[whole(mixed(n, p)).alias(n) for n, p in wanted.items()], "max",
        whole(F.col("total") / F.col("n")).alias("avg"))


SKETCH_SIZE = 2000  # of the quantile sketches: a rank is off by less than SKETCH_ERROR of all values
SKETCH_ERROR = 0.005


def daily_sketches(requests: DataFrame, start: Column, end: Column) -> DataFrame:
    """(day, phase, n, lo, hi, total, sketch): what a later run needs of a day, whatever its number of requests. Days are computed once, kept, and merged by `merged_latency`."""
    day = F.to_date("created_at")
    span = requests.where((F.col("created_at") >= start) & (F.col("created_at") < end)).select(day.alias("day"), "weapon_analyzed", "created_at", "stream_message_id", "processing_completed_at")
    used = span.where(F.col("weapon_analyzed") & F.col("stream_message_id").isNotNull() & F.col("processing_completed_at").isNotNull())
    t = used.select("day", timing.stream_id_ms(F.col("stream_message_id")).alias("i"), timing.epoch_ms(F.col("created_at")).alias("p"), timing.epoch_ms(F.col("processing_completed_at")).alias("c"))
    times = t.selectExpr("day", "stack(3, 'queue_wait', p - i, 'processing', c - p, 'total', c - i) as (phase, ms)").where("ms is not null")
    return times.groupBy("day", "phase").agg(
        F.count(F.lit(1)).alias("n"), F.min("ms").alias("lo"), F.max("ms").alias("hi"), F.sum("ms").alias("total"),
        F.call_function("kll_sketch_agg_bigint", F.col("ms").cast("bigint"), F.lit(SKETCH_SIZE)).alias("sketch"))


def merged_latency(days: DataFrame) -> DataFrame:
    """count, min, p50/p90/p99, max and mean per phase from the sketches of any number of days: percentiles within SKETCH_ERROR of their rank, all else exact."""
    merge = lambda a, b: F.call_function("kll_sketch_merge_bigint", a, b)
    per = days.groupBy("phase").agg(  # one small row per day and phase
        F.sum("n").alias("n"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("total").alias("total"), F.collect_list("sketch").alias("sketches"))
    one = F.aggregate(F.slice("sketches", 2, F.greatest(F.size("sketches") - 1, F.lit(1))), F.element_at("sketches", 1), merge)
    at = F.call_function("kll_sketch_get_quantile_bigint", one, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return per.withColumn("q", at).select("phase", "n", "min", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"), F.col("q")[2].alias("p99"), "max", F.rint(F.col("total") / F.col("n")).cast("bigint").alias("avg"))


def union_phases(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def phase_latency(requests: DataFrame, start: Column, end: Column) -> DataFrame:
    return summarize_times(phase_times(requests, start, end))


def latency_stats(pairs: DataFrame, value: str = "delta_ms") -> DataFrame:
    """count, min, median, p90, p99, max and mean; p90 and p99 are the elements at min(floor(n p), n - 1), the
    median and the mean lose their fraction."""
    last = F.col("n") - 1
    at = lambda p: F.least(F.floor(F.col("n") * F.lit(p)), last)
    ranks = {"m_lo": F.floor(last / 2), "m_hi": F.ceil(last / 2), "p90": at(0.90), "p99": at(0.99)}
    found = ordered.order_statistics(pairs, [], value, ranks)
    whole = lambda c: c.cast("bigint")
    return found.select(F.col("n").alias("n"), "min", whole((F.col("m_lo") + F.col("m_hi")) / 2).alias("p50"), "p90", "p99", "max",
                        whole(F.col("total") / F.col("n")).alias("avg"))


def _order(df: DataFrame) -> DataFrame:
    return df.withColumn("ms", timing.stream_id_ms(F.col("stream_id"))).withColumn("sub", timing.stream_id_seq(F.col("stream_id")))


def latest_per_key(outputs: DataFrame, n: int | None = None, key: str = "key") -> DataFrame:
    """Newest output of each key, among the newest `n` outputs when given."""
    rows = _order(outputs)
    newest = [F.col("ms").desc(), F.col("sub").desc()]
    if n is not None:
        rows = rows.orderBy(*newest).limit(n)
    return latest(rows.where(F.coalesce(F.length(key), F.lit(0)) > 0), [key], newest)


def asof_latency(
    inputs: DataFrame, outputs: DataFrame, *, input_window: int | None = None, output_limit: int | None = None, bucket_ms: int = 3_600_000, ranges: int | None = None,
) -> DataFrame:
    """Each key's newest output with the last input of the same key at or before it: (key, in_ms, out_ms, delta_ms).

    Unpaired outputs have a null in_ms. With `input_window` only the newest N inputs at or before the output count.
    Inputs and outputs are (key, stream_id). Work is split by key and time bucket, so a hot key is spread out. With `ranges` buckets are that many measured
    ranges of stream ids of about one size, so that a hot hour is spread out as well; the rows are stored once, dealt by range.
    """
    out_rows = latest_per_key(outputs, output_limit).withColumn("side", F.lit(1))
    in_rows = _order(inputs).withColumn("side", F.lit(0))
    columns = ["key", "ms", "sub", "side"]
    both = in_rows.select(*columns).unionByName(out_rows.select(*columns))
    if ranges is None:
        bucket = F.floor(F.col("ms") / F.lit(bucket_ms))
    else:  # equal ids fall into one range; numbers of ranges ascend with the ids
        both = durable(both.repartitionByRange(ranges, "ms", "sub").withColumn("_range", F.spark_partition_id()))
        bucket = F.col("_range")
    if input_window is None:
        values = {"in_ms": F.when(F.col("side") == 0, F.col("ms"))}
        seen = ordered.carry_last(both, ["key"], ["ms", "sub", "side"], bucket, values, inclusive=True)
        found = seen.where("side = 1").select("key", "in_ms", F.col("ms").alias("out_ms"))
    else:
        # every row learns how many inputs the stream holds up to it; equal ids count the input first
        per = both.withColumn("_bucket", bucket)
        sizes = per.groupBy("_bucket").agg(F.count_if(F.col("side") == 0).alias("_n"))
        starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
        inside = F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).over(
            W.partitionBy("_bucket").orderBy("ms", "sub", "side").rowsBetween(W.unboundedPreceding, 0))
        numbered = per.withColumn("_in", inside).join(starts, "_bucket").withColumn("n_in", F.col("_start") + F.col("_in")).drop("_bucket", "_in", "_start")
        values = {"last": F.when(F.col("side") == 0, F.struct("ms", "n_in"))}
        seen = ordered.carry_last(numbered, ["key"], ["ms", "sub", "side"], bucket, values, inclusive=True).where("side = 1")
        near = F.col("n_in") - F.col("last.n_in") < input_window
        found = seen.select("key", F.when(near, F.col("last.ms")).alias("in_ms"), F.col("ms").alias("out_ms"))
    return found.withColumn("delta_ms", F.col("out_ms") - F.col("in_ms"))


def slowest(pairs: DataFrame, n: int = 5, alarm_ms: int = 5000) -> DataFrame:
    """The n slowest pairs, only when the 90th percentile passes the alarm."""
    paired = pairs.where("delta_ms is not null")
    alarm = latency_stats(paired).select(F.col("p90") > alarm_ms).scalar()
    return paired.where(alarm).orderBy(F.col("delta_ms").desc(), "key").limit(n)


def volume_profile(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows, mean rows per active day and peak day of each named table (DataFrame, time column)."""
    parts = []
    for name, (df, ts) in tables.items():
        daily = df.groupBy(F.to_date(ts).alias("d")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(daily.agg(F.lit(name).alias("table_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
                               F.avg("n").alias("daily_avg"), F.max("n").alias("daily_peak")))
    return union_phases(*parts)


def status_shares(df: DataFrame, labels: Mapping[int, str]) -> DataFrame:
    counted = df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy())  # over one row per status
    return counted.withColumn("share", share).withColumn("status_name", text.labelled(F.col("status"), dict(labels)))


def entries_page(entries: DataFrame, references: DataFrame, embeddings: DataFrame, limit: int = 50, offset: int = 0, **where) -> DataFrame:
    """Newest entries with their reference and embedding counts. Only the page's entries are counted."""
    page = P.entries_filter(entries, **where).orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)
    refs = counts_by_entry(references, page).select(F.col("entry_id").alias("id"), F.col("n").alias("references_count"))
    embs = counts_by_entry(embeddings, page).select(F.col("entry_id").alias("id"), F.col("n").alias("embeddings_count"))
    return page.join(refs, "id", "left").join(embs, "id", "left").fillna(0, ["references_count", "embeddings_count"])


def active_entries(entries: DataFrame, user_id: str | None = None) -> DataFrame:
    own = P.entries_filter(entries, user_id, True).where(F.col("status") == C.ENTRY_INDEXED)
    return own.orderBy("created_at", "id")


def children_by_entry(rows: DataFrame, entry_id: str | None = None) -> DataFrame:
    """References or embeddings, oldest first inside their entry."""
    own = rows if entry_id is None else rows.where(F.col("entry_id") == entry_id)
    return own.orderBy("entry_id", "created_at", "id")
