"""On-demand index batches: submit, land, count, finish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import config as C
from ..functions import text, timing, vectors
from ..sources.tables import latest, upsert
from . import predicates as P

ACTIVE = (C.BATCH_PENDING, C.BATCH_COMPUTING)
COUNTS = ("submitted", "embedded", "filtered", "failed")


def mint(target: DataFrame, submits: DataFrame, key: str, order: str) -> DataFrame:
    """Submits with `created`: true for the first one of a key the target does not hold yet."""
    first = submits.groupBy(key).agg(F.min(order).alias("_first"))
    known = target.select(key).distinct().withColumn("_known", F.lit(True))
    tagged = submits.join(first, key).join(known, key, "left")
    return tagged.withColumn("created", F.col("_known").isNull() & (F.col(order) == F.col("_first"))).drop("_known", "_first")


def batch_counts(results: DataFrame, batches: DataFrame) -> DataFrame:
    """Absolute counts per batch, recounted from the result rows; every batch has a row."""
    status = F.col("status")
    per = results.groupBy("batch_id").agg(
        F.count_if(status == C.RESULT_EMBEDDED).alias("embedded"),
        F.count_if(status == C.RESULT_FILTERED).alias("filtered"),
        F.count_if(status.isin(*C.RESULT_FAILED)).alias("failed"),
    )
    base = batches.select(F.col("id").alias("batch_id"), F.coalesce("submitted_count", F.lit(0)).cast("bigint").alias("submitted"))
    return base.join(per, "batch_id", "left").fillna(0, ["embedded", "filtered", "failed"])


def terminal_status(counts: DataFrame) -> DataFrame:
    """Adds `terminal_status`; null while fewer items are accounted for than were submitted."""
    accounted = F.col("embedded") + F.col("filtered") + F.col("failed")
    rule = (
        F.when(accounted < F.col("submitted"), F.lit(None).cast("string"))
        .when(F.col("failed") == 0, C.BATCH_COMPLETED)
        .otherwise(C.BATCH_COMPLETED_WITH_ERRORS)
    )
    return counts.withColumn("terminal_status", rule)


def lifecycle_events(batches: DataFrame, event_type: str | Column) -> DataFrame:
    """created / completed / failed envelopes; only a failed one carries the error message."""
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    count = lambda name: F.coalesce(F.col(f"{name}_count"), F.lit(0)).alias(name)
    shared = [
        F.col("id").alias("batch_id"), F.col("client_batch_ref"), F.col("external_id"), F.col("user_id"), F.col("status"),
        F.struct(*[count(n) for n in COUNTS]).alias("counts"), F.col("source_ref"),
        timing.iso_utc(F.col("created_at")).alias("created_at"), timing.iso_utc(F.col("completed_at")).alias("completed_at"),
    ]
    keep = {"ignoreNullFields": "false"}
    body = F.when(kind == C.EVENT_BATCH_FAILED, F.to_json(F.struct(*shared, F.col("error_message")), keep)).otherwise(F.to_json(F.struct(*shared), keep))
    return batches.select(kind.alias("event_type"), body.alias("payload"))


def submit_batches(submits: DataFrame, batches: DataFrame, now: Column, *, n_cap: int = C.BATCH_ITEM_CAP) -> dict[str, DataFrame]:
    """Intake of submit messages (the SUBMIT fields plus `seq`, the message order).

    Unbindable messages are dropped. A rejected one makes (or turns) its batch an error batch and announces the
    failure. The first valid one of an unknown client reference mints the batch and dispatches its items; any
    later one is only announced again.
    """
    checked = P.validate_submits(submits, n_cap).withColumn("submitted", F.coalesce(F.size("entries"), F.lit(0)))
    bound = checked.where("bindable")
    wrong = F.col("error").isNotNull()
    per_ref = bound.groupBy("client_batch_ref").agg(
        F.min_by(F.struct("user_id", "external_id", "source_ref", "metadata", "submitted"), "seq").alias("first"),
        F.min("seq").alias("first_seq"),
        F.max_by("error", F.when(wrong, F.col("seq"))).alias("last_error"),
        F.min(F.when(wrong, F.col("seq"))).alias("first_error_seq"),
    )
    held = batches.select("client_batch_ref", F.struct(*batches.columns).alias("was"))
    refs = per_ref.join(held, "client_batch_ref", "left")
    new, failed = F.col("was").isNull(), F.col("last_error").isNotNull()
    batch_id = text.natural_id("batch", F.col("client_batch_ref"))
    minted = {
        "id": batch_id, "client_batch_ref": F.col("client_batch_ref"), "external_id": F.col("first.external_id"), "user_id": F.col("first.user_id"),
        "status": F.lit(C.BATCH_COMPUTING), "submitted_count": F.col("first.submitted"), "embedded_count": F.lit(0), "filtered_count": F.lit(0),
        "failed_count": F.lit(0), "source_ref": F.col("first.source_ref"), "metadata": F.col("first.metadata"),
        "error_message": F.lit(None).cast("string"), "created_at": now, "updated_at": now, "completed_at": F.lit(None).cast("timestamp")}
    on_error = {"status": F.lit(C.BATCH_ERROR), "error_message": text.truncate_error(F.col("last_error")), "completed_at": now}
    after = {n: F.when(new, minted[n]).otherwise(F.col(f"was.{n}")) for n in batches.columns}
    after = {n: F.when(failed, on_error[n]).otherwise(c) if n in on_error else c for n, c in after.items()}
    refs = refs.select("client_batch_ref", "first_seq", "first_error_seq", new.alias("new"), failed.alias("failed"),
                       F.col("was.status").alias("prior_status"), F.struct(*[c.alias(n) for n, c in after.items()]).alias("after"))
    changed = refs.where(F.col("new") | F.col("failed")).select("after.*")

    rows = bound.select("client_batch_ref", "seq", "error", "user_id", "metadata", "entries").join(refs, "client_batch_ref")
    seen_error = wrong | F.coalesce(F.col("first_error_seq") < F.col("seq"), F.lit(False))
    status_then = F.when(seen_error, C.BATCH_ERROR).otherwise(F.coalesce("prior_status", F.lit(C.BATCH_COMPUTING)))
    told = rows.select("error", status_then.alias("status_then"), "after.*")
    told = told.withColumn("status", F.col("status_then")).withColumn("error_message", text.truncate_error(F.col("error"))).withColumn(
        "completed_at", F.when(F.col("status_then") == C.BATCH_ERROR, F.col("completed_at")))
    kind = F.when(wrong, C.EVENT_BATCH_FAILED).otherwise(C.EVENT_BATCH_CREATED)

    fresh = rows.where(F.col("new") & (F.col("seq") == F.col("first_seq")) & ~wrong)
    dispatch = fresh.select(
        batch_id.alias("batch_id"), "user_id", "metadata",
        F.transform("entries", lambda it, i: F.struct(
            text.item_id_of(it).alias("item_id"), it["image_url"].alias("image_url"), i.alias("item_index"))).alias("items"))
    return {"dropped": checked.where(~F.col("bindable")), "batches": changed, "dispatch": dispatch, "lifecycle": lifecycle_events(told, kind)}


def _message_problem(results: Column, dim: int) -> Column:
    """True when any item makes the whole message unusable."""
    return F.exists(results, lambda r: r["item_index"].isNull() | (
        r["status"].eqNullSafe(F.lit(C.RESULT_EMBEDDED)) & vectors.vector_error(r["vector_b64"], r["vector_encoding"], dim).isNotNull()))


def land_results(
    messages: DataFrame, batches: DataFrame, results: DataFrame, now: Column, *, dim: int = C.EMBEDDING_DIM
) -> dict[str, DataFrame]:
    """Computed items of known batches (batch_id, results, seq).

    A message with one unreadable vector is set aside as a whole. Items overwrite by (batch, item index), counts
    are taken anew over all rows of the touched batches, and a batch ends only when every item is accounted for.
    """
    known = batches.select(F.col("id").alias("batch_id"), "user_id", F.col("external_id"))
    named = messages.withColumn("batch_id", text.normalize_uuid("batch_id")).join(known, "batch_id")
    bad = F.coalesce(_message_problem(F.col("results"), dim), F.lit(False))
    quarantined = named.where(bad)
    items = named.where(~bad).select("batch_id", "user_id", "external_id", "seq", F.posexplode("results").alias("pos", "r"))
    embedded = F.col("r.status") == C.RESULT_EMBEDDED
    flat = items.select(
        "batch_id", "user_id", "external_id", F.col("r.item_index").alias("item_index"),
        F.coalesce(text.item_id_of(F.col("r")), F.lit("")).alias("item_ref"),
        text.source_url_of(F.col("r.image_url"), F.col("r.source_url")).alias("source_url"), F.col("r.status").alias("status"),
        F.when(embedded, text.index_point_id(F.col("batch_id"), F.col("r.item_index"))).alias("qdrant_point_id"),
        F.col("r.duplicate_of_index").alias("duplicate_of_index"), F.col("r.error_message").alias("error_message"),
        F.col("r.vector_b64").alias("vector_b64"), F.struct("seq", "pos").alias("order"))
    newest = latest(flat, ["batch_id", "item_index"], [F.col("order").desc()])
    changed = newest.select(*results.columns)
    last_vector = latest(flat.where(F.col("qdrant_point_id").isNotNull()), ["qdrant_point_id"], [F.col("order").desc()])
    points = last_vector.select(
        F.col("qdrant_point_id").alias("point_id"), vectors.decode_vector("vector_b64").alias("vector"), "user_id", "external_id",
        "batch_id", "item_index", "item_ref", "source_url", F.lit(C.MODEL_VERSION).alias("model_version"))
    touched = named.where(~bad).select(F.col("batch_id").alias("id")).distinct()
    open_batches = batches.join(touched, "id", "left_semi").select(*batches.columns)
    mine = results.join(touched.withColumnRenamed("id", "batch_id"), "batch_id", "left_semi").select(*results.columns)
    merged = upsert(mine, newest.withColumn("seq", F.lit(1)), ("batch_id", "item_index"), "seq")
    counted = terminal_status(batch_counts(merged, open_batches)).withColumnRenamed("batch_id", "id")
    ended = F.col("terminal_status").isNotNull()
    after = open_batches.join(counted, "id")
    for name in ("embedded", "filtered", "failed"):
        after = after.withColumn(f"{name}_count", F.col(name).cast("int"))
    after = after.withColumn("status", F.coalesce("terminal_status", "status")).withColumn("updated_at", now).withColumn(
        "completed_at", F.when(ended, now).otherwise(F.col("completed_at")))
    finished = after.where(ended).select(*batches.columns)
    return {
        "results": changed,
        "points": points,
        "batches": after.select(*batches.columns),
        "finished": finished,
        "lifecycle": lifecycle_events(finished, C.EVENT_BATCH_COMPLETED),
        "quarantined": quarantined,
    }


def fail_batches(errors: DataFrame, batches: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Batch-level compute errors (batch_id, error_message, seq): the last one wins, even over a finished batch."""
    named = errors.withColumn("id", text.normalize_uuid("batch_id")).where(F.col("id").isNotNull())
    last = named.groupBy("id").agg(F.max_by(F.coalesce("error_message", F.lit("")), "seq").alias("_error"))
    failed = (
        batches.join(last, "id").withColumn("status", F.lit(C.BATCH_ERROR)).withColumn("error_message", text.truncate_error(F.col("_error")))
        .withColumn("completed_at", now).withColumn("updated_at", now).select(*batches.columns))
    return {"batches": failed, "lifecycle": lifecycle_events(failed, C.EVENT_BATCH_FAILED)}


def reap(batches: DataFrame, now: Column, seconds: int = C.COMPUTE_TIMEOUT_SECONDS) -> dict[str, DataFrame]:
    """Batches pending or computing for too long end as `error`."""
    stuck = batches.where(F.col("status").isin(*ACTIVE) & timing.older_than(F.col("created_at"), now, secs=seconds))
    failed = stuck.withColumn("status", F.lit(C.BATCH_ERROR)).withColumn("error_message", F.lit("compute timeout")).withColumn(
        "completed_at", now).withColumn("updated_at", now).select(*batches.columns)
    return {"batches": failed, "lifecycle": lifecycle_events(failed, C.EVENT_BATCH_FAILED)}


def latest_run(batches: DataFrame) -> DataFrame:
    return latest(batches, ["user_id", "external_id"], [F.col("created_at").desc(), F.col("id")])


def runs(batches: DataFrame, cap: int = C.RUNS_CAP, external_id: str | None = None, user_id: str | None = None) -> DataFrame:
    """Runs of each (tenant, external id), newest first as `run` 1..cap."""
    if external_id is not None:
        batches = batches.where(F.col("external_id") == external_id)
    if user_id is not None:
        batches = batches.where(F.col("user_id") == user_id)
    if int(cap) < 1:
        raise ValueError(f"cap has to be positive, not {cap}")
    limit = int(cap)
    order = W.partitionBy("user_id", "external_id").orderBy(F.col("created_at").desc(), F.col("id"))
    return batches.withColumn("run", F.row_number().over(order)).where(F.col("run") <= limit)


def batch_items(results: DataFrame, batch_id: str, limit: int = 100, offset: int = 0) -> DataFrame:
    return results.where(F.col("batch_id") == batch_id).orderBy("item_index").offset(offset).limit(limit)


def lookup(df: DataFrame, key: str, value: str, user_id: str | None = None, **equal: str) -> DataFrame:
    """One row by key inside a tenant; a miss and a foreign row are both empty."""
    found = df.where(F.col(key) == value)
    if user_id is not None:
        found = found.where(F.col("user_id") == user_id)
    for name, wanted in equal.items():
        found = found.where(F.col(name) == wanted)
    return found.limit(1)
