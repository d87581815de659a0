"""Declared schemas. Nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

STR, INT, LONG, DBL, BOOL, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
STRINGS, VECTOR = T.ArrayType(STR), T.ArrayType(T.FloatType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def _strings(names: str) -> dict[str, T.DataType]:
    return {name: STR for name in names.split()}


DETECTION = struct(class_name=STR, class_id=INT, confidence=DBL, source=STR, bbox=struct(x1=INT, y1=INT, x2=INT, y2=INT))
DETECTIONS = T.ArrayType(DETECTION)

ENVELOPE = struct(**_strings("event_type payload stream_id"))
DEAD_LETTERS = struct(**_strings("event_type payload original_stream original_message_id dead_lettered_at"))

EVIDENCE_POINTS = struct(
    point_id=STR, vector=VECTOR, **_strings("source_type evidence_id camera_id user_id device_id"), app_id=INT, infraction_code=STR,
    category=STRINGS, weapon_analyzed=BOOL, has_weapon=BOOL, weapon_classes=STRINGS, image_index=INT, image_url=STR,
    blacklist_entry_id=STR, blacklist_reference_id=STR, model_version=STR, created_at=TS)

INDEX_POINTS = struct(
    point_id=STR, vector=VECTOR, **_strings("user_id external_id batch_id"), item_index=INT, **_strings("item_ref source_url model_version"))

QUERY_VECTORS = struct(point_id=STR, vector=VECTOR, search_id=STR)

EMBEDDING_REQUESTS = struct(
    **_strings("id evidence_id camera_id user_id device_id"), app_id=INT, infraction_code=STR, category=STR, status=INT, image_urls=STRINGS,
    worker_id=STR, error_message=STR, retry_count=INT, processing_started_at=TS, processing_completed_at=TS, stream_message_id=STR,
    weapon_analyzed=BOOL, has_weapon=BOOL, weapon_classes=STRINGS, weapon_max_confidence=DBL, weapon_summary=STR,
    weapon_analysis_error=STR, created_at=TS, updated_at=TS)

EVIDENCE_EMBEDDINGS = struct(
    **_strings("id request_id qdrant_point_id"), image_index=INT, image_url=STR, weapon_detections=DETECTIONS, json_data=STR, created_at=TS)

SEARCH_REQUESTS = struct(
    **_strings("id search_id user_id image_url"), status=INT, similarity_status=INT, search_type=STR, external_ids=STRINGS, threshold=DBL,
    max_results=INT, search_metadata=STR, total_matches=INT, **_strings("results_key qdrant_query_point_id worker_id error_message"),
    retry_count=INT, processing_started_at=TS, processing_completed_at=TS, stream_message_id=STR, created_at=TS, updated_at=TS)

SEARCH_MATCHES = struct(
    **_strings("id search_request_id evidence_id camera_id"), similarity_score=DBL, **_strings("image_url match_metadata external_id"))

ENTRIES = struct(
    **_strings("id name category description"), status=INT, active=BOOL, is_archived=BOOL, user_id=STR, blacklist_version=INT,
    match_threshold=DBL, json_data=STR, created_at=TS, updated_at=TS)

REFERENCES = struct(
    **_strings("id entry_id image_url image_type"), status=INT, error_message=STR, retry_count=INT, json_data=STR, created_at=TS, updated_at=TS)

REFERENCE_EMBEDDINGS = struct(**_strings("id entry_id reference_id qdrant_point_id model_version json_data"), created_at=TS)

BATCHES = struct(
    **_strings("id client_batch_ref external_id user_id status"), submitted_count=INT, embedded_count=INT, filtered_count=INT,
    failed_count=INT, **_strings("source_ref metadata error_message"), created_at=TS, updated_at=TS, completed_at=TS)

RESULTS = struct(
    batch_id=STR, item_index=INT, **_strings("item_ref source_url status qdrant_point_id"), duplicate_of_index=INT, error_message=STR)

# The tables and the key of a row in each.
TABLES = {
    "embedding_requests": (EMBEDDING_REQUESTS, ("evidence_id",)),
    "evidence_embeddings": (EVIDENCE_EMBEDDINGS, ("qdrant_point_id",)),
    "search_requests": (SEARCH_REQUESTS, ("search_id",)),
    "search_matches": (SEARCH_MATCHES, ("id",)),
    "entries": (ENTRIES, ("id",)),
    "references": (REFERENCES, ("id",)),
    "reference_embeddings": (REFERENCE_EMBEDDINGS, ("id",)),
    "batches": (BATCHES, ("id",)),
    "results": (RESULTS, ("batch_id", "item_index")),
    "evidence_points": (EVIDENCE_POINTS, ("point_id",)),
    "index_points": (INDEX_POINTS, ("point_id",)),
    "query_vectors": (QUERY_VECTORS, ("point_id",)),
    "match_sets": (struct(search_request_id=STR, updated_at=TS), ("search_request_id",)),
    "dead_letters": (DEAD_LETTERS, ("original_stream", "original_message_id")),
    "outbox": (struct(stream=STR, event_type=STR, payload=STR), ("stream", "payload")),
    "dispatch": (struct(batch_id=STR, user_id=STR, metadata=STR, items=T.ArrayType(struct(item_id=STR, image_url=STR, item_index=INT))), ("batch_id",)),
}

# --- payloads on the wire ---------------------------------------------------
EVIDENCE_RESULT = struct(
    **_strings("evidence_id camera_id user_id device_id"), app_id=INT, infraction_code=STR, zip_url=STR, entities=STRINGS, trace_event=STR,
    embeddings=T.ArrayType(struct(image_name=STR, image_url=STR, image_index=INT, vector=VECTOR)),
    input_count=INT, filtered_count=INT, embedded_count=INT,
    weapon_analysis=struct(
        images=T.ArrayType(struct(image_name=STR, image_index=INT, detections=DETECTIONS)),
        summary=struct(
            images_analyzed=INT, images_with_detections=INT, total_detections=INT, classes_detected=STRINGS, max_confidence=DBL,
            has_weapon=BOOL, model_version=T.MapType(STR, STR))),
    weapon_analysis_error=struct(message=STR))

SEARCH_RESULT = struct(
    search_id=STR, user_id=STR, vector=VECTOR, threshold=DBL, max_results=INT, **_strings("purpose blacklist_entry_id metadata"))

SEARCH_CREATED = struct(**_strings("search_id user_id image_url"), threshold=DBL, max_results=INT, metadata=STR)

_ITEM = T.ArrayType(struct(**_strings("item_id image_id image_url")))
SUBMIT = struct(**_strings("user_id client_batch_ref external_id source_ref metadata"), items=_ITEM, images=_ITEM)

COMPUTED = struct(batch_id=STR, results=T.ArrayType(struct(
    item_id=STR, image_id=STR, item_index=INT, **_strings("status image_url source_url vector_b64 vector_encoding"), embedding_dim=INT,
    duplicate_of_index=INT, error_message=STR)))

COMPUTE_ERROR = struct(**_strings("entity_id entity_type error batch_id error_message"))
