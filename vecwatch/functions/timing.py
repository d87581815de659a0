"""Time column functions. `now` is always a parameter, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970, rounded to the nearest."""
    return F.round(_micros(ts) / F.lit(1000.0)).cast("bigint")


def stream_id_ms(stream_id: Column) -> Column:
    return F.split_part(stream_id, F.lit("-"), F.lit(1)).try_cast("bigint")


def stream_id_seq(stream_id: Column) -> Column:
    return F.coalesce(F.nullif(F.split_part(stream_id, F.lit("-"), F.lit(2)), F.lit("")).try_cast("bigint"), F.lit(0))


def stream_order(stream_id: str = "stream_id") -> Column:
    """Sort key of a stream id: time, then sequence, both as numbers."""
    return F.struct(stream_id_ms(F.col(stream_id)).alias("ms"), stream_id_seq(F.col(stream_id)).alias("seq"), F.col(stream_id).alias("id"))


def iso_utc(ts: Column, z: bool = False) -> Column:
    """ISO text; the fraction is left out when there are no microseconds."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(_micros(ts) % 1_000_000 == 0, whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return F.concat(text, F.lit("Z")) if z else text


def older_than(ts: Column, now: Column, **parts: int) -> Column:
    """True when `ts` lies before `now` minus an interval given as days=, hours=, mins= or secs=."""
    gap = F.make_dt_interval(*(F.lit(parts.get(p, 0)) for p in ("days", "hours", "mins", "secs")))
    return ts.isNotNull() & (ts < now - gap)


def day_of(ts: Column) -> Column:
    return F.date_trunc("day", ts)
