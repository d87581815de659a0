"""Event envelopes {event_type, payload(JSON text)}: read, route, quarantine, write."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from .. import schemas
from ..functions import timing


def read_envelopes(spark: SparkSession, path: str, *, streaming: bool = False, files_per_trigger: int = 64) -> DataFrame:
    """JSON lines on a shared folder, as a batch or a stream."""
    if streaming:
        return spark.readStream.schema(schemas.ENVELOPE).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return spark.read.schema(schemas.ENVELOPE).json(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """The same envelopes from Kafka records, when the connector is on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    body = F.from_json(F.col("value").cast("string"), "event_type string, payload string")
    stream_id = F.concat(F.unix_millis("timestamp").cast("string"), F.lit("-"), F.col("offset").cast("string"))
    return raw.select(body["event_type"].alias("event_type"), body["payload"].alias("payload"), stream_id.alias("stream_id"))


def parsed(schema: T.StructType) -> Column:
    """The payload as a struct; null when the JSON is broken. A missing payload reads as an empty object."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    body = F.from_json(F.coalesce("payload", F.lit("{}")), T.StructType([*schema.fields, T.StructField("_broken", T.StringType())]), options)
    return F.when(body["_broken"].isNull() & body.isNotNull(), F.struct(*[body[f.name].alias(f.name) for f in schema]))


def parse(df: DataFrame, event_type: str, schema: T.StructType) -> DataFrame:
    """Messages of one type with `p`, the parsed payload. `p` is null when the JSON is broken; the text is kept."""
    return df.where(F.col("event_type") == event_type).withColumn("p", parsed(schema))


MOST_TYPES = 10_000  # distinct dropped event types that are counted exactly


def opened(df: DataFrame, kinds: Mapping[str, T.StructType], counts: Observation) -> DataFrame:
    """Messages with `p_<n>`, the payload parsed by the n-th kind where it is of that kind, and the counts of `routing_counts` observed on the way: no job of their own."""
    known = F.coalesce(F.col("event_type").isin(*kinds), F.lit(False))
    for n, (event_type, schema) in enumerate(kinds.items()):
        df = df.withColumn(f"p_{n}", F.when(F.col("event_type") == event_type, parsed(schema)))
    broken = known
    for n in range(len(kinds)):
        broken = broken & F.col(f"p_{n}").isNull()
    dropped = F.when(~known, F.coalesce("event_type", F.lit("unknown")))
    return df.observe(counts, F.count(F.lit(1)).alias("received"), F.count_if(broken).alias("rejected"), F.call_function("approx_top_k", dropped, F.lit(MOST_TYPES), F.lit(MOST_TYPES * 10)).alias("dropped"))


def routing_counts(counts: Observation) -> dict:
    """What was received, rejected as unreadable, and dropped per unknown event type, once the observed messages were first read."""
    got = counts.get
    return {"received": got["received"], "rejected": got["rejected"], "dropped": {r["item"]: r["count"] for r in got["dropped"] or () if r["item"] is not None}}


def split_unroutable(df: DataFrame, known: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(routable, dropped). A missing event type counts as unknown."""
    routable = F.coalesce(F.col("event_type").isin(*known), F.lit(False))
    return df.where(routable), df.where(~routable)


def unroutable_counts(df: DataFrame, known: Sequence[str]) -> DataFrame:
    kind = F.coalesce("event_type", F.lit("unknown"))
    return split_unroutable(df, known)[1].groupBy(kind.alias("event_type")).agg(F.count(F.lit(1)).alias("dropped"))


def quarantine(df: DataFrame, bad: Column, stream: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(good, dead letters). A dead letter keeps the message and says where and when it failed."""
    bad = F.coalesce(bad, F.lit(True))
    dead = df.where(bad).select(
        "event_type", "payload", F.lit(stream).alias("original_stream"), F.col("stream_id").alias("original_message_id"),
        F.unix_seconds(now.cast("timestamp")).cast("string").alias("dead_lettered_at"),
    )
    return df.where(~bad), dead


def as_text(schema: T.StructType) -> list[Column]:
    """Times as ISO text, everything else as it is."""
    times = (T.TimestampType, T.TimestampNTZType)
    return [timing.iso_utc(F.col(f.name)).alias(f.name) if isinstance(f.dataType, times) else F.col(f.name) for f in schema]


def to_envelope(df: DataFrame, event_type: str | Column) -> DataFrame:
    """All columns as one JSON payload; nulls are written, times become text."""
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    body = F.to_json(F.struct(*as_text(df.schema)), {"ignoreNullFields": "false"})
    return df.select(kind.alias("event_type"), body.alias("payload"))
