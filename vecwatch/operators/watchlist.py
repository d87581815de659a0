"""Watch-list matching in its three directions, and watch-list upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import text, timing
from ..sources.tables import latest
from . import ordered, predicates as P, similarity as S

EVIDENCE_FIELDS = ("evidence_id", "camera_id", "device_id", "app_id", "infraction_code", "category", "image_url", "image_index")


def _active_indexed(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("active") & (F.col("status") == C.ENTRY_INDEXED))


def active_tenants(entries: DataFrame) -> DataFrame:
    """Tenants with at least one active, indexed entry."""
    return _active_indexed(entries).select("user_id").distinct()


def active_point_ids(entries: DataFrame, embeddings: DataFrame, user_id: str | None = None) -> DataFrame:
    own = _active_indexed(entries) if user_id is None else _active_indexed(entries).where(F.col("user_id") == user_id)
    return embeddings.join(own.select(F.col("id").alias("entry_id"), "user_id"), "entry_id").select("user_id", "entry_id", "qdrant_point_id")


def _entry_side(entries: DataFrame) -> DataFrame:
    return entries.select(
        F.col("id").alias("blacklist_entry_id"), F.col("name").alias("blacklist_entry_name"),
        F.col("category").alias("blacklist_entry_category"), F.col("blacklist_version").alias("blacklist_entry_version"))


def _reference_side(references: DataFrame) -> DataFrame:
    return references.select(F.col("id").alias("blacklist_reference_id"), F.col("image_url").alias("blacklist_reference_url"))


def _with_watchlist(hits: DataFrame, entries: DataFrame, references: DataFrame) -> DataFrame:
    """Attribute hits to their entry and reference; a hit whose entry or reference is gone is dropped."""
    return hits.join(_entry_side(entries), "blacklist_entry_id").join(_reference_side(references), "blacklist_reference_id")


def _evidence_side(df: DataFrame, score: str, trigger: str, threshold: Column, *extra: str) -> DataFrame:
    return df.select(
        "user_id", "blacklist_entry_id", "blacklist_entry_name", "blacklist_entry_category", "blacklist_entry_version",
        "blacklist_reference_id", "blacklist_reference_url", F.lit(C.MODEL_VERSION).alias("blacklist_model_version"),
        "evidence_id", F.col("camera_id").alias("evidence_camera_id"), F.col("device_id").alias("evidence_device_id"),
        F.col("app_id").alias("evidence_app_id"), F.col("infraction_code").alias("evidence_infraction_code"),
        F.col("category").alias("evidence_category"), F.coalesce("image_url", F.lit("")).alias("matched_image_url"),
        F.coalesce("image_index", F.lit(0)).alias("matched_image_index"), F.col("frame_id").alias("matched_qdrant_point_id"),
        F.col(score).alias("similarity_score"), threshold.alias("threshold_used"), F.lit(trigger).alias("trigger"), *extra)


def inline_matches(
    frames: DataFrame, points: DataFrame, entries: DataFrame, references: DataFrame, *,
    threshold: float = C.MATCH_THRESHOLD, limit: int = C.INLINE_MATCH_LIMIT, active_only: bool = False, **physical,
) -> DataFrame:
    """New frames against their tenant's watch-list points; tenants without an active indexed entry are skipped first.

    An inactive entry still matches while its tenant has another active one, unless `active_only`.
    """
    frames = frames.join(active_tenants(entries), "user_id", "left_semi")
    listed = P.blacklist_only(points)
    queries = frames.select(F.col("point_id").alias("query_id"), "vector", F.col("user_id").alias("q_user_id"))
    hits = S.similarity_search(queries, listed, limit, threshold, scope=("user_id",),
                               payload=("user_id", "blacklist_entry_id", "blacklist_reference_id"), **physical)
    hits = hits.where(text.is_uuid(F.col("blacklist_entry_id")) & text.is_uuid(F.col("blacklist_reference_id")))
    own = frames.select(F.col("point_id").alias("frame_id"), *EVIDENCE_FIELDS)
    found = hits.withColumnRenamed("query_id", "frame_id").join(own, "frame_id")
    if active_only:
        entries = entries.where("active")
    return _evidence_side(_with_watchlist(found, entries, references), "score", "inline", F.lit(threshold))


def reverse_matches(
    new_references: DataFrame, points: DataFrame, entries: DataFrame, references: DataFrame, *,
    threshold: float = C.MATCH_THRESHOLD, limit: int = C.REVERSE_MATCH_LIMIT, **physical,
) -> DataFrame:
    """New reference vectors (reference_id, entry_id, user_id, vector) against their tenant's stored evidence.

    With a column point_id a reference may have several vectors; each makes its own search under its own limit.
    """
    asked = F.col("point_id" if "point_id" in new_references.columns else "reference_id")
    queries = new_references.select(asked.alias("query_id"), "vector", F.col("user_id").alias("q_user_id"))
    hits = S.similarity_search(queries, P.evidence_only(points), limit, threshold, scope=("user_id",),
                               payload=("user_id", *EVIDENCE_FIELDS), **physical)
    who = new_references.select(asked.alias("query_id"), F.col("reference_id").alias("blacklist_reference_id"), F.col("entry_id").alias("blacklist_entry_id"))
    found = hits.join(who, "query_id").withColumnRenamed("point_id", "frame_id")
    return _evidence_side(_with_watchlist(found, entries, references), "score", "reverse_search", F.lit(threshold))


def backfill_references(entry_ids: DataFrame, entries: DataFrame, references: DataFrame, embeddings: DataFrame, points: DataFrame) -> DataFrame:
    """Stored vectors of every processed reference of the entries: newest embedding each, missing vectors skipped.

    The search runs under the owner of the entry.
    """
    own = entries.join(entry_ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("entry_id"), "user_id")
    done = references.where(F.col("status") == C.REFERENCE_PROCESSED).select(F.col("id").alias("reference_id"), "entry_id")
    newest = latest(embeddings, ["reference_id"], [F.col("created_at").desc(), F.col("id").desc()])
    wanted = done.join(own, "entry_id").join(newest.select("reference_id", F.col("qdrant_point_id").alias("point_id")), "reference_id")
    return wanted.join(points.select("point_id", "vector"), "point_id").select("reference_id", "entry_id", "user_id", "vector")


def backfill_matches(entry_ids: DataFrame, entries: DataFrame, references: DataFrame, embeddings: DataFrame, points: DataFrame, **options) -> DataFrame:
    again = backfill_references(entry_ids, entries, references, embeddings, points)
    return reverse_matches(again, points, entries, references, **options)


def best_per_point(df: DataFrame) -> DataFrame:
    """Best score per (entry, indexed point), and batch when there is one; equal scores go to the oldest embedding."""
    keys = ["blacklist_entry_id", "point_id", *[c for c in ("landed_batch_id",) if c in df.columns]]
    return latest(df, keys, [F.col("score").desc(), F.col("embedding_created_at"), F.col("embedding_id")])


def cross_reference(
    entries: DataFrame, embeddings: DataFrame, points: DataFrame, index: DataFrame, *,
    external_ids: Sequence[str] | None = None, batch_id: str | None = None, batches: DataFrame | None = None,
    threshold: float | None = None, limit: int | None = None, default: float = C.MATCH_THRESHOLD, **physical,
) -> DataFrame:
    """Entries' stored reference vectors against the on-demand index of their tenant, best score per indexed point.

    Degenerate and missing vectors give nothing. The model guard runs after the per-reference limit.
    With `batches` (id, user_id) every entry is held against each landed batch of its tenant.
    """
    limit = limit or C.XREF_LIMIT
    floor = text.effective_threshold(F.lit(threshold), F.col("match_threshold"), default)
    asked = entries.select(F.col("id").alias("blacklist_entry_id"), "user_id", floor.alias("threshold_used"))
    stored = embeddings.select(
        F.col("entry_id").alias("blacklist_entry_id"), F.col("id").alias("embedding_id"), F.col("reference_id").alias("blacklist_reference_id"),
        F.col("qdrant_point_id").alias("point_id"), F.col("model_version").alias("reference_model_version"), F.col("created_at").alias("embedding_created_at"))
    probes = asked.join(stored, "blacklist_entry_id").join(points.select("point_id", "vector"), "point_id").drop("point_id")
    probes = probes.withColumn("query_id", F.col("embedding_id"))
    queries = probes.select("query_id", "vector", F.col("user_id").alias("q_user_id"), F.col("threshold_used").alias("q_threshold"))
    if external_ids:
        index = index.where(F.col("external_id").cast("string").isin(*[str(e) for e in external_ids]))
    if batch_id:
        index = index.where(F.col("batch_id").cast("string") == F.lit(str(batch_id)))
    least = default if threshold is None else threshold
    if batches is None:
        hits = S.index_search(queries, index, limit, least, **physical)
    else:  # one search per reference over what landed for its tenant, then its best of every batch
        landed = batches.select(F.col("id").cast("string").alias("batch_id"), F.col("user_id").cast("string").alias("user_id")).distinct()
        arrived = index.withColumns({c: F.col(c).cast("string") for c in ("user_id", "external_id", "batch_id")}).join(landed, ["batch_id", "user_id"], "left_semi")
        hits = S.score_join(queries, arrived, threshold=least, k=limit, per="batch_id", scope=("user_id",), payload=S.INDEX_PAYLOAD, **physical)
        order = S.W.partitionBy("query_id", "batch_id").orderBy(F.col("score").desc(), "point_id")
        hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).withColumn("landed_batch_id", F.col("batch_id"))
    found = P.same_model(hits.drop("user_id").join(probes.drop("vector"), "query_id"))
    best = best_per_point(found)
    return best.select(
        "user_id", "blacklist_entry_id", "blacklist_reference_id", "external_id", "batch_id", "item_index",
        text.image_id(F.col("item_ref"), F.col("point_id")).alias("image_id"), "source_url",
        F.col("point_id").alias("qdrant_point_id"), F.col("score").alias("similarity_score"), "threshold_used")


def cross_reference_batch(batches: DataFrame, entries: DataFrame, embeddings: DataFrame, points: DataFrame, index: DataFrame, **options) -> DataFrame:
    """Every active indexed entry of a tenant against each of its just landed batches."""
    active = _active_indexed(entries).join(batches.select("user_id").distinct(), "user_id", "left_semi")
    return cross_reference(active, embeddings, points, index, batches=batches, **options)


def index_match_rows(xref: DataFrame, entries: DataFrame, references: DataFrame) -> DataFrame:
    """Cross-reference hits in the shape of a match event; the evidence fields of an index point are null."""
    none = F.lit(None).cast("string")
    shaped = xref.withColumn("evidence_id", F.col("image_id")).withColumn("image_url", F.col("source_url")).withColumn(
        "image_index", F.col("item_index")).withColumn("frame_id", F.col("qdrant_point_id"))
    for name in ("camera_id", "device_id", "infraction_code", "category"):
        shaped = shaped.withColumn(name, none)
    shaped = shaped.withColumn("app_id", F.lit(None).cast("int"))
    full = _with_watchlist(shaped, entries, references).withColumn("match_target", F.lit(C.SEARCH_TYPE_INDEX))
    return _evidence_side(full, "similarity_score", "image_index_xref", F.col("threshold_used"), "match_target", "external_id", "batch_id")


def match_events(matches: DataFrame, matched_at: Column) -> DataFrame:
    """Envelopes of watch-list matches. The three index keys are only there for index matches."""
    stamped = matches.withColumn("matched_at", timing.iso_utc(matched_at, z=True))
    body = F.to_json(F.struct(*stamped.columns), {"ignoreNullFields": "false"})
    return stamped.select(F.lit(C.EVENT_MATCH).alias("event_type"), body.alias("payload"))


def land_reference_embeddings(messages: DataFrame, entries: DataFrame, references: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Computed reference vectors: a new point and embedding row, reference processed, entry indexed.

    Messages (reference_id, entry_id, user_id, vector, stream_id) with ids that are no UUIDs, or whose entry or
    reference is gone, are dropped.
    """
    named = messages.withColumn("entry_id", text.normalize_uuid("entry_id")).withColumn("reference_id", text.normalize_uuid("reference_id"))
    bound = (
        named.where(F.col("entry_id").isNotNull() & F.col("reference_id").isNotNull())
        .join(entries.select(F.col("id").alias("entry_id"), F.col("category").alias("entry_category")), "entry_id")
        .join(references.select(F.col("id").alias("reference_id"), "image_url"), "reference_id")
        .withColumn("point_id", text.natural_id("reference-point", F.col("reference_id"), F.col("stream_id")))
    )
    points = bound.select(
        "point_id", "vector", F.lit(C.SOURCE_BLACKLIST).alias("source_type"), F.col("entry_id").alias("blacklist_entry_id"),
        F.col("reference_id").alias("blacklist_reference_id"), "user_id", F.lit(C.MODEL_VERSION).alias("model_version"), "image_url",
        F.when(F.length("entry_category") > 0, F.array("entry_category")).alias("category"), now.alias("created_at"))
    rows = bound.select(
        text.natural_id("reference-embedding", F.col("point_id")).alias("id"), "entry_id", "reference_id",
        F.col("point_id").alias("qdrant_point_id"), F.lit(C.MODEL_VERSION).alias("model_version"),
        F.lit(None).cast("string").alias("json_data"), now.alias("created_at"))
    done_refs = references.join(bound.select(F.col("reference_id").alias("id")).distinct(), "id", "left_semi")
    done_entries = entries.join(bound.select(F.col("entry_id").alias("id")).distinct(), "id", "left_semi")
    return {
        "points": points,
        "embeddings": rows,
        "references": done_refs.withColumn("status", F.lit(C.REFERENCE_PROCESSED)).withColumn("updated_at", now).select(*references.columns),
        "entries": done_entries.withColumn("status", F.lit(C.ENTRY_INDEXED)).withColumn("updated_at", now).select(*entries.columns),
        "reverse_queries": bound.select("reference_id", "entry_id", "user_id", "vector"),
    }


def apply_patches(entries: DataFrame, patches: DataFrame, now: Column | None = None, *, bucket_size: int = 100_000) -> DataFrame:
    """Entries after their patches (entry_id, seq, patch JSON) in seq order.

    An absent key keeps a field; an explicit null clears category, description, threshold and json_data but not
    name or active. A patch that changes the threshold or switches the entry on again adds one version.
    """
    keys = F.json_object_keys("patch")
    body = F.from_json("patch", "name string, category string, description string, active boolean, match_threshold double, json_data string")
    parsed = patches.select("entry_id", "seq", body.alias("b"), keys.alias("k"))
    has = lambda name: F.coalesce(F.array_contains("k", name), F.lit(False))
    flat = parsed.select(
        "entry_id", "seq", has("match_threshold").alias("has_threshold"), F.col("b.match_threshold").alias("threshold"),
        F.col("b.active").alias("active"), F.col("b.name").alias("name"),
        *[F.when(has(n), F.struct(F.col(f"b.{n}").alias("v"))).alias(f"set_{n}") for n in ("category", "description", "json_data")])
    flat = flat.withColumn("set_threshold", F.when(F.col("has_threshold"), F.struct(F.col("threshold").alias("v"))))
    bucket = F.floor(F.col("seq") / F.lit(bucket_size))
    seen = ordered.carry_last(flat, ["entry_id"], ["seq"], bucket,
                              {"prior_threshold": F.col("set_threshold"), "prior_active": F.col("active")}, inclusive=False)
    start = entries.select(F.col("id").alias("entry_id"), F.col("match_threshold").alias("_t0"), F.col("active").alias("_a0"))
    seen = seen.join(start, "entry_id")
    before = F.when(F.col("prior_threshold").isNotNull(), F.col("prior_threshold.v")).otherwise(F.col("_t0"))
    moved = F.col("has_threshold") & ~F.col("threshold").eqNullSafe(before)
    revived = F.coalesce(F.col("active"), F.lit(False)) & ~F.coalesce("prior_active", "_a0", F.lit(False))
    at = lambda c: F.when(c.isNotNull(), F.col("seq"))
    newest = lambda name: F.max_by(F.col(name), at(F.col(name))).alias(f"_{name}")
    folded = seen.groupBy("entry_id").agg(
        F.count_if(moved | revived).alias("_bumps"), newest("name"), newest("active"), newest("set_threshold"),
        newest("set_category"), newest("set_description"), newest("set_json_data"))
    out = entries.join(folded.withColumnRenamed("entry_id", "id"), "id", "left")
    changed = F.col("_bumps").isNotNull()
    result = out.withColumn("name", F.coalesce("_name", "name")).withColumn("active", F.coalesce("_active", "active"))
    for name, slot in (("match_threshold", "_set_threshold"), ("category", "_set_category"), ("description", "_set_description"), ("json_data", "_set_json_data")):
        result = result.withColumn(name, F.when(F.col(slot).isNotNull(), F.col(f"{slot}.v")).otherwise(F.col(name)))
    result = result.withColumn("blacklist_version", (F.col("blacklist_version") + F.coalesce("_bumps", F.lit(0))).cast("int"))
    if now is not None:
        result = result.withColumn("updated_at", F.when(changed, now).otherwise(F.col("updated_at")))
    return result.select(*entries.columns)
