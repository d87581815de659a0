"""Scheduled passes over the request tables: stale recovery and retention. Timeouts live in batches.reap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import timing


def _retry(df: DataFrame, error_status: int, max_retries: int, now: Column) -> DataFrame:
    """One more try, or an error once the tries are used up."""
    tries = F.col("retry_count") + 1
    spent = tries >= max_retries
    return (
        df.withColumn("status", F.when(spent, error_status).otherwise(1))
        .withColumn("error_message", F.when(spent, F.lit("Max retries exceeded (stale WORKING recovery)")).otherwise(F.col("error_message")))
        .withColumn("worker_id", F.when(spent, F.col("worker_id")))
        .withColumn("retry_count", tries.cast("int")).withColumn("updated_at", now))


def recover_stale(
    requests: DataFrame, searches: DataFrame, now: Column, *, minutes: int = C.STALE_WORKING_MINUTES, max_retries: int = C.MAX_RETRIES,
    index_seconds: int = C.COMPUTE_TIMEOUT_SECONDS,
) -> dict[str, DataFrame]:
    """Changed rows of both tables. Index searches are never put back to work, they end after their own timeout."""
    stale = lambda df: df.where((F.col("status") == 2) & timing.older_than(F.col("processing_started_at"), now, mins=minutes))
    emb = _retry(stale(requests), C.REQUEST_ERROR, max_retries, now).select(*requests.columns)
    old = stale(searches)
    on_index = F.col("search_type") == C.SEARCH_TYPE_INDEX
    again = _retry(old.where(~on_index), C.SEARCH_ERROR, max_retries, now).select(*searches.columns)
    timed_out = (
        old.where(on_index & timing.older_than(F.col("processing_started_at"), now, secs=index_seconds))
        .withColumn("status", F.lit(C.SEARCH_ERROR)).withColumn("error_message", F.lit("Image-index compute timed out (stale WORKING)"))
        .withColumn("updated_at", now).select(*searches.columns))
    return {"requests": emb, "searches": again.unionByName(timed_out)}


def retain(
    requests: DataFrame, searches: DataFrame, now: Column, days: int = C.RETENTION_DAYS, *,
    request_status: Sequence[int] = (C.REQUEST_DONE, C.REQUEST_ERROR), search_status: Sequence[int] = (C.SEARCH_COMPLETED, C.SEARCH_ERROR),
) -> dict[str, DataFrame]:
    """Both tables without their finished rows older than the retention time."""
    stays = lambda df, ends: df.where(~(F.col("status").isin(*ends) & timing.older_than(F.col("created_at"), now, days=days)))
    return {"requests": stays(requests, request_status), "searches": stays(searches, search_status)}
