"""Defaults, status codes and fixed vocabularies."""

from __future__ import annotations

# --- thresholds and limits -------------------------------------------------
SEARCH_THRESHOLD = 0.75
SEARCH_MAX_RESULTS = 50
MATCH_THRESHOLD = 0.85
INLINE_MATCH_LIMIT = 100
REVERSE_MATCH_LIMIT = 1000
XREF_LIMIT = 50
PAIR_THRESHOLD = 0.85
EXTERNAL_IDS_CAP = 200
RUNS_CAP = 200
BATCH_ITEM_CAP = 100
EMBEDDING_DIM = 512
VECTOR_ENCODING = "f32le_b64"
MODEL_VERSION = "clip-vit-b-32"
COMPUTE_TIMEOUT_SECONDS = 900
STALE_WORKING_MINUTES = 10
MAX_RETRIES = 3
RETENTION_DAYS = 30
RECALC_HOURS_OLD = 2
RECALC_LIMIT = 20
ERROR_TEXT_MAX = 500

# --- status codes (fixed values) -------------------------------------------
REQUEST_STATUS = {1: "to_work", 2: "working", 3: "embedded", 4: "done", 5: "error"}
SEARCH_STATUS = {1: "to_work", 2: "working", 3: "completed", 4: "error"}
SEARCH_STATUS_LABELS = {1: "pending", 2: "working", 3: "completed", 4: "error"}
SIMILARITY_STATUS = {1: "no_matches", 2: "matches_found"}
ENTRY_STATUS = {1: "created", 2: "processing", 3: "indexed", 4: "updating", 5: "error"}
REFERENCE_STATUS = {1: "to_process", 2: "processing", 3: "processed", 4: "error"}

REQUEST_TO_WORK, REQUEST_WORKING, REQUEST_EMBEDDED, REQUEST_DONE, REQUEST_ERROR = 1, 2, 3, 4, 5
SEARCH_TO_WORK, SEARCH_WORKING, SEARCH_COMPLETED, SEARCH_ERROR = 1, 2, 3, 4
NO_MATCHES, MATCHES_FOUND = 1, 2
ENTRY_INDEXED = 3
REFERENCE_PROCESSED, REFERENCE_ERROR = 3, 4

BATCH_PENDING = "pending"
BATCH_COMPUTING = "computing"
BATCH_COMPLETED = "completed"
BATCH_COMPLETED_WITH_ERRORS = "completed_with_errors"
BATCH_ERROR = "error"
RESULT_EMBEDDED = "embedded"
RESULT_FILTERED = "filtered"
RESULT_FAILED = ("download_failed", "decode_failed", "no_result")

SOURCE_EVIDENCE = "evidence"
SOURCE_BLACKLIST = "blacklist"
SEARCH_TYPE_EVIDENCE = "evidence"
SEARCH_TYPE_INDEX = "image_index"
WEAPON_MODES = ("all", "only", "exclude", "analyzed_clean")
ADMIN_ROLES = ("admin", "root", "dev")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp")

# Entity ids and their labels (fixed values); other ids read "unk".
ENTITY_LABELS = {0: "person", 1: "bicycle", 2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}
UNKNOWN_LABEL = "unk"

# Name space of the deterministic index point ids (fixed value).
INDEX_NAMESPACE = "19c871f8-fb51-5d35-8584-ec49ac00cbf3"

# Event types (fixed values).
EVENT_EMBEDDINGS = "embeddings.computed"
EVENT_SEARCH_VECTOR = "search.vector.computed"
EVENT_SEARCH_CREATED = "search.created"
EVENT_INDEX_SUBMIT = "image.index.submit"
EVENT_INDEX_COMPUTED = "image.index.computed"
EVENT_INDEX_DISPATCH = "image.index.compute"
EVENT_COMPUTE_ERROR = "compute.error"
EVENT_MATCH = "image.blacklist_match"
EVENT_WEAPONS = "weapons.detected"
EVENT_BATCH_CREATED = "image_batch.created"
EVENT_BATCH_COMPLETED = "image_batch.completed"
EVENT_BATCH_FAILED = "image_batch.failed"

# Keys that make a landed warehouse event unique, per feed (fixed values).
FEED_KEYS = {
    "image_search_request": ("id", "status", "updated_at"),
    "image_search_match": ("search_request_id", "evidence_id"),
    "blacklist_image_entry": ("id", "blacklist_version", "updated_at"),
    "blacklist_image_reference": ("id", "status", "updated_at"),
    "blacklist_image_embedding": ("id",),
    "image_embedding_request": ("id", "status", "updated_at"),
    "image_embedding": ("id",),
}

# The field of a feed's row that is the same in every delivery of its key, if there is one: landing is cut by its day.
FEED_TIMES = {
    "image_search_request": "updated_at",
    "image_search_match": None,
    "blacklist_image_entry": "updated_at",
    "blacklist_image_reference": "updated_at",
    "blacklist_image_embedding": "created_at",
    "image_embedding_request": "updated_at",
    "image_embedding": "created_at",
}
