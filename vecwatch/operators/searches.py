"""Search requests: intake, landing, outcome, matches, error routing, reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import text
from ..functions.timing import older_than, stream_order
from ..functions.vectors import is_valid_vector
from ..sources.tables import latest
from . import ingest, predicates as P, similarity as S

EVIDENCE_PAYLOAD = (
    "user_id", "evidence_id", "camera_id", "image_url", "device_id", "app_id", "infraction_code", "category", "weapon_analyzed",
    "has_weapon", "weapon_classes", "image_index", "created_at")


def _meta(name: str) -> Column:
    return F.get_json_object("metadata", f"$.{name}")


def _request_rows(df: DataFrame, now: Column, **given: Column) -> DataFrame:
    """A search request row from the columns at hand; the others get their defaults."""
    none = lambda kind="string": F.lit(None).cast(kind)
    base = {
        "id": text.natural_id("search", F.col("search_id")), "search_id": F.col("search_id"), "user_id": F.col("user_id"),
        "image_url": F.lit("(computed)"), "status": F.lit(C.SEARCH_TO_WORK), "similarity_status": F.lit(C.NO_MATCHES),
        "search_type": F.lit(C.SEARCH_TYPE_EVIDENCE), "external_ids": none("array<string>"), "threshold": F.lit(C.SEARCH_THRESHOLD),
        "max_results": F.lit(C.SEARCH_MAX_RESULTS), "search_metadata": none(), "total_matches": F.lit(0), "results_key": none(),
        "qdrant_query_point_id": none(), "worker_id": none(), "error_message": none(), "retry_count": F.lit(0),
        "processing_started_at": none("timestamp"), "processing_completed_at": none("timestamp"), "stream_message_id": none(),
        "created_at": now, "updated_at": now,
    }
    return df.select(*[c.alias(n) for n, c in {**base, **given}.items()])


def intake_searches(messages: DataFrame, searches: DataFrame, now: Column) -> DataFrame:
    """Rows for new searches (the SEARCH_CREATED fields plus stream_id); a known search id is skipped.

    Index searches start working at once, evidence searches wait to be picked up.
    """
    fresh = ingest.new_only(P.admit(messages, P.ADMISSION["search_created"]), searches, "search_id", stream_order())
    indexed = F.coalesce(_meta("search_type") == C.SEARCH_TYPE_INDEX, F.lit(False))
    return _request_rows(
        fresh, now, image_url=F.col("image_url"), threshold=F.coalesce("threshold", F.lit(C.SEARCH_THRESHOLD)),
        max_results=F.coalesce("max_results", F.lit(C.SEARCH_MAX_RESULTS)), search_metadata=F.col("metadata"),
        status=F.when(indexed, C.SEARCH_WORKING).otherwise(C.SEARCH_TO_WORK),
        search_type=F.when(indexed, C.SEARCH_TYPE_INDEX).otherwise(C.SEARCH_TYPE_EVIDENCE),
        external_ids=F.when(indexed, F.from_json(_meta("external_ids"), "array<string>")),
        processing_started_at=F.when(indexed, now).cast("timestamp"), stream_message_id=F.col("stream_id"))


def search_outcome(searches: DataFrame, matches: DataFrame) -> DataFrame:
    """Total matches and outcome of every search, also of those without any."""
    per = matches.groupBy("search_request_id").agg(F.count(F.lit(1)).alias("total_matches"))
    joined = searches.select(F.col("id").alias("search_request_id")).join(per, "search_request_id", "left").fillna(0, ["total_matches"])
    return joined.withColumn("similarity_status", F.when(F.col("total_matches") > 0, C.MATCHES_FOUND).otherwise(C.NO_MATCHES))


def replace_matches(old: DataFrame, new: DataFrame, ids: DataFrame) -> DataFrame:
    """The new result set of a search takes the place of the old one, also when it is empty."""
    gone = ids.select(F.col("id").alias("search_request_id")).distinct()
    return old.join(gone, "search_request_id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def _evidence_matches(hits: DataFrame) -> DataFrame:
    payload = F.to_json(F.struct(*EVIDENCE_PAYLOAD, F.col("point_id").alias("qdrant_point_id")))
    return hits.select(
        text.natural_id("match", F.col("query_id"), F.col("point_id")).alias("id"), F.col("query_id").alias("search_request_id"),
        F.coalesce("evidence_id", "point_id").alias("evidence_id"), "camera_id", F.col("score").alias("similarity_score"),
        F.coalesce("image_url", F.lit("")).alias("image_url"), payload.alias("match_metadata"), F.lit(None).cast("string").alias("external_id"))


def _index_matches(hits: DataFrame) -> DataFrame:
    meta = F.to_json(F.struct("batch_id", "item_index", "item_ref", F.col("point_id").alias("qdrant_point_id"),
                              F.lit(C.SEARCH_TYPE_INDEX).alias("search_type")), {"ignoreNullFields": "false"})
    return hits.select(
        text.natural_id("match", F.col("query_id"), F.col("point_id")).alias("id"), F.col("query_id").alias("search_request_id"),
        text.image_id(F.col("item_ref"), F.col("point_id")).alias("evidence_id"), F.lit(None).cast("string").alias("camera_id"),
        F.col("score").alias("similarity_score"), F.col("source_url").alias("image_url"), meta.alias("match_metadata"), "external_id")


def evidence_search(searches: DataFrame, points: DataFrame, *, tenant_scoped: bool = True, **physical) -> DataFrame:
    """Match rows of many searches at once: (id, user_id, vector, threshold, max_results, search_metadata).

    Every search keeps its own threshold, limit and metadata filter; one pass over the points serves all.
    """
    queries = searches.select(
        F.col("id").alias("query_id"), "vector", F.col("user_id").alias("q_user_id"), F.col("threshold").alias("q_threshold"),
        F.col("max_results").alias("q_limit"), *P.search_filter_columns(F.col("search_metadata")))
    scope = ("user_id",) if tenant_scoped else ()
    hits = S.similarity_search(queries, P.evidence_only(points), C.SEARCH_MAX_RESULTS, C.SEARCH_THRESHOLD, scope=scope,
                               payload=EVIDENCE_PAYLOAD, **physical)
    return _evidence_matches(hits)


def index_searches(searches: DataFrame, index: DataFrame, **physical) -> DataFrame:
    """The same on the on-demand index, within tenant and external ids."""
    queries = searches.select(
        F.col("id").alias("query_id"), "vector", F.col("user_id").alias("q_user_id"), F.col("external_ids").alias("q_external_ids"),
        F.col("threshold").alias("q_threshold"), F.col("max_results").alias("q_limit"))
    return _index_matches(S.index_search(queries, index, C.SEARCH_MAX_RESULTS, C.SEARCH_THRESHOLD, **physical))


def land_searches(
    messages: DataFrame, searches: DataFrame, points: DataFrame, index: DataFrame, now: Column, *,
    store: Callable[[DataFrame, DataFrame], DataFrame] | None = None, **physical,
) -> dict[str, DataFrame]:
    """Computed query vectors (the SEARCH_RESULT fields plus stream_id) -> finished searches and their matches.

    Vectors of watch-list references are handed on as `reference_vectors`. An index search never reads the
    evidence points; with an unusable vector it ends as an error. The last message of a search id counts.
    `store(matches, finished)` may write the matches and hand back the stored rows, so the search runs once.
    """
    admitted = P.admit(messages, P.ADMISSION["search_result"])
    is_reference = F.coalesce(F.col("purpose") == "blacklist_embed", F.lit(False))
    references = admitted.where(is_reference & (F.length("blacklist_entry_id") > 0)).select(
        F.col("search_id").alias("reference_id"), F.col("blacklist_entry_id").alias("entry_id"), "user_id", "vector", "stream_id")
    asked = latest(admitted.where(~is_reference), ["search_id"], [stream_order().desc()])
    indexed = F.coalesce(_meta("search_type") == C.SEARCH_TYPE_INDEX, F.lit(False))
    found = asked.withColumn("message_user", F.when(indexed, F.coalesce(F.nullif(_meta("user_id"), F.lit("")), "user_id")).otherwise(F.col("user_id")))
    found = found.withColumn("message_type", F.when(indexed, C.SEARCH_TYPE_INDEX).otherwise(C.SEARCH_TYPE_EVIDENCE))
    # the guard against vectors without a direction belongs to index searches; an evidence search with one finds nothing and is done
    found = found.withColumn("usable", is_valid_vector(F.col("vector")) | (F.col("message_type") == C.SEARCH_TYPE_EVIDENCE))
    found = found.select("search_id", "vector", F.col("message_user").alias("user_id"), "message_type", "usable", "stream_id",
                         F.coalesce("threshold", F.lit(C.SEARCH_THRESHOLD)).alias("threshold"),
                         F.coalesce("max_results", F.lit(C.SEARCH_MAX_RESULTS)).alias("max_results"),
                         F.col("metadata").alias("search_metadata"),
                         F.from_json(_meta("external_ids"), "array<string>").alias("external_ids"),
                         text.natural_id("search", F.col("search_id")).alias("id"))
    known = searches.join(found.select("search_id").distinct(), "search_id", "left_semi").select(*searches.columns)
    row_id = known.select("search_id", F.col("id").alias("known_id"))
    found = found.join(row_id, "search_id", "left").withColumn("id", F.coalesce("known_id", "id"))
    evidence = found.where((F.col("message_type") == C.SEARCH_TYPE_EVIDENCE) & F.col("usable"))
    on_index = found.where((F.col("message_type") == C.SEARCH_TYPE_INDEX) & F.col("usable"))
    new_matches = evidence_search(evidence, points, **physical).unionByName(index_searches(on_index, index, **physical))
    done = found.where("usable")
    if store is not None:
        new_matches = store(new_matches, done.select("id"))
    created = _request_rows(
        found.where("known_id is null").drop("known_id"), now, id=F.col("id"), threshold=F.col("threshold"), max_results=F.col("max_results"),
        search_metadata=F.col("search_metadata"), search_type=F.col("message_type"), stream_message_id=F.col("stream_id"),
        external_ids=F.when(F.col("message_type") == C.SEARCH_TYPE_INDEX, F.col("external_ids")),
        processing_started_at=F.when(F.col("message_type") == C.SEARCH_TYPE_INDEX, now).cast("timestamp"))
    rows = known.unionByName(created.select(*searches.columns))
    outcome = search_outcome(done.select("id"), new_matches).withColumnRenamed("search_request_id", "id")
    after = rows.drop("total_matches", "similarity_status").join(outcome, "id", "left").withColumn("_done", F.col("total_matches").isNotNull())
    after = (
        after.withColumn("total_matches", F.coalesce("total_matches", F.lit(0)))
        .withColumn("similarity_status", F.coalesce("similarity_status", F.lit(C.NO_MATCHES)))
        .withColumn("status", F.when(F.col("_done"), C.SEARCH_COMPLETED).otherwise(C.SEARCH_ERROR))
        .withColumn("error_message", F.when(~F.col("_done"), F.lit("degenerate query vector")).otherwise(F.col("error_message")))
        .withColumn("processing_completed_at", F.when(F.col("_done"), now).otherwise(F.col("processing_completed_at")))
        .withColumn("qdrant_query_point_id", F.when(F.col("_done"), text.natural_id("query", F.col("id"))).otherwise(F.col("qdrant_query_point_id")))
        .withColumn("updated_at", now))
    vectors = done.select(text.natural_id("query", F.col("id")).alias("point_id"), "vector", "search_id")
    return {"searches": after.select(*searches.columns), "matches": new_matches, "query_vectors": vectors,
            "replaced": done.select("id"), "reference_vectors": references}


def route_errors(errors: DataFrame, references: DataFrame, searches: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Compute errors of type `search` (entity_id, entity_type, error, stream_id): to the watch-list reference with that id, else to
    the search, which is created when missing. The last error of an id counts."""
    mine = errors.where(F.col("entity_type") == "search").withColumn("entity_id", F.coalesce("entity_id", F.lit("")))
    last = latest(mine, ["entity_id"], [stream_order().desc()])
    told = last.select("entity_id", text.normalize_uuid("entity_id").alias("ref_id"), text.compute_error_text(F.col("error")).alias("_error"))
    refs = references.join(told.select(F.col("ref_id").alias("id"), "_error"), "id")
    refs = refs.withColumn("status", F.lit(C.REFERENCE_ERROR)).withColumn("error_message", text.truncate_error(F.col("_error"))).withColumn("updated_at", now)
    rest = told.join(refs.select(F.col("id").alias("ref_id")), "ref_id", "left_anti").select(F.col("entity_id").alias("search_id"), "_error")
    hit = searches.join(rest, "search_id").withColumn("status", F.lit(C.SEARCH_ERROR)).withColumn("error_message", F.col("_error")).withColumn(
        "updated_at", now).select(*searches.columns)
    missing = rest.join(searches.select("search_id"), "search_id", "left_anti").withColumn("user_id", F.lit("unknown"))
    created = _request_rows(missing, now, image_url=F.lit("(failed)"), status=F.lit(C.SEARCH_ERROR), error_message=F.col("_error"))
    return {"references": refs.select(*references.columns), "searches": hit.unionByName(created.select(*searches.columns))}


# --- reads -------------------------------------------------------------------
def searches_with_matches(searches: DataFrame, matches: DataFrame, user_id: str | None = None, search_type: str | None = None) -> DataFrame:
    """Searches beside their matches; a search without matches keeps one row with null match columns."""
    if user_id is not None:
        searches = searches.where(F.col("user_id") == user_id)
    if search_type is not None:
        searches = searches.where(F.col("search_type") == search_type)
    child = matches.select(F.col("search_request_id").alias("id"), F.col("id").alias("match_id"), "evidence_id", "similarity_score")
    return searches.join(child, "id", "left")


def matches_page(matches: DataFrame, search_id: str | None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of matches, best first. A page has 1 to 100 rows; other limits are refused."""
    if not 1 <= limit <= 100:
        raise ValueError(f"limit has to be from 1 to 100, not {limit}")
    mine = matches if search_id is None else matches.where(F.col("search_request_id") == search_id)
    return mine.orderBy(F.col("similarity_score").desc(), "id").offset(offset).limit(limit)


def user_searches(searches: DataFrame, user_id: str, limit: int = 20, offset: int = 0) -> DataFrame:
    return searches.where(F.col("user_id") == user_id).orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)


def pending(df: DataFrame, limit: int, max_retries: int = C.MAX_RETRIES) -> DataFrame:
    """Oldest work still to do."""
    waiting = df.where((F.col("status") == C.REQUEST_TO_WORK) & (F.col("retry_count") < max_retries))
    return waiting.orderBy("created_at", "id").limit(limit)


def recalc_candidates(searches: DataFrame, search_type: str, now: Column, hours_old: int = C.RECALC_HOURS_OLD, limit: int | None = C.RECALC_LIMIT) -> DataFrame:
    """Finished searches with matches that are old enough, oldest first."""
    due = searches.where(
        (F.col("search_type") == search_type) & (F.col("status") == C.SEARCH_COMPLETED)
        & (F.col("similarity_status") == C.MATCHES_FOUND) & older_than(F.col("processing_completed_at"), now, hours=hours_old))
    ordered = due.orderBy("processing_completed_at", "id")
    return ordered if limit is None else ordered.limit(limit)


def recalc_due(searches: DataFrame, now: Column, hours_old: int = C.RECALC_HOURS_OLD, limit: int | None = C.RECALC_LIMIT) -> DataFrame:
    """Candidates of both search types, each with its own limit."""
    evidence, index = (recalc_candidates(searches, t, now, hours_old, limit) for t in (C.SEARCH_TYPE_EVIDENCE, C.SEARCH_TYPE_INDEX))
    return evidence.unionByName(index)


def recalculate(
    searches: DataFrame, query_vectors: DataFrame, points: DataFrame, index: DataFrame, old_matches: DataFrame, now: Column, *,
    hours_old: int = C.RECALC_HOURS_OLD, limit: int | None = C.RECALC_LIMIT,
    store: Callable[[DataFrame, DataFrame], DataFrame] | None = None, **physical,
) -> dict[str, DataFrame]:
    """Search again with the stored query vectors, one pass per point table, and replace the match sets.

    A candidate without a stored vector is skipped and listed in `skipped`.
    """
    due = recalc_due(searches, now, hours_old, limit)
    stored = query_vectors.select(F.col("point_id").alias("qdrant_query_point_id"), "vector")
    ready = due.join(stored, "qdrant_query_point_id")
    skipped = due.join(stored.select("qdrant_query_point_id"), "qdrant_query_point_id", "left_anti")
    fresh = evidence_search(ready.where(F.col("search_type") == C.SEARCH_TYPE_EVIDENCE), points, **physical).unionByName(
        index_searches(ready.where(F.col("search_type") == C.SEARCH_TYPE_INDEX), index, **physical))
    if store is not None:
        fresh = store(fresh, ready.select("id"))
    outcome = search_outcome(ready.select("id"), fresh).withColumnRenamed("search_request_id", "id")
    after = ready.drop("vector", "total_matches", "similarity_status").join(outcome, "id").withColumn(
        "processing_completed_at", now).withColumn("updated_at", now).select(*searches.columns)
    return {"searches": after, "matches": replace_matches(old_matches, fresh, ready.select("id")), "skipped": skipped}
