"""Text, id and JSON column functions. All are built from JVM-side expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

from .. import config as C

_HEX32 = "^[0-9a-f]{32}$"


def _dashed(hex32: Column) -> Column:
    part = lambda start, size: F.substring(hex32, start, size)
    return F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))


def normalize_uuid(value) -> Column:
    """Lower-case dashed form of any accepted UUID spelling, else null."""
    bare = F.lower(F.col(value) if isinstance(value, str) else value)
    bare = F.replace(F.replace(bare, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    bare = F.replace(F.btrim(bare, F.lit("{}")), F.lit("-"), F.lit(""))
    return F.when(bare.rlike(_HEX32), _dashed(bare))


def is_uuid(value) -> Column:
    return normalize_uuid(value).isNotNull()


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version-5 id: SHA-1 over namespace bytes and name, then version and variant bits."""
    ns = F.unhex(F.lit(uuid.UUID(namespace).hex))
    digest = F.sha1(F.concat(ns, F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def index_point_id(batch_id: Column, item_index: Column) -> Column:
    """Same batch and item always give the same point id, so a redelivery overwrites its own point."""
    return uuid5(C.INDEX_NAMESPACE, F.concat_ws("_", batch_id.cast("string"), item_index.cast("string")))


def natural_id(kind: str, *parts: Column) -> Column:
    """Replay-stable id for rows whose natural key is known."""
    return uuid5(C.INDEX_NAMESPACE, F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def name_hash(name: Column) -> Column:
    return F.substring(F.sha2(F.encode(name, "UTF-8"), 256), 1, 16)


def published_name_hash(name: Column) -> Column:
    """What the entry feed carries: no name gives an empty text, never a hash of nothing."""
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, F.lit("")).otherwise(name_hash(name))


def entities_to_category(entities: Column) -> Column:
    """Entity ids -> struct(text, ids, valid). Empty or missing gives nulls; `valid` is false on a non-integer id."""
    numbers = F.transform(entities, lambda e: e.cast("string").try_cast("bigint"))
    clean = F.array_sort(F.array_distinct(numbers))
    present = F.coalesce(F.size(entities), F.lit(0)) > 0
    valid = ~present | F.forall(numbers, lambda n: n.isNotNull())
    usable = present & valid
    return F.struct(
        F.when(usable, F.to_json(clean)).alias("text"),
        F.when(usable, F.transform(clean, lambda n: n.cast("string"))).alias("ids"),
        valid.alias("valid"),
    )


def entity_label(entity_id: Column) -> Column:
    pairs = [F.lit(x) for kv in C.ENTITY_LABELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), entity_id.cast("int")), F.lit(C.UNKNOWN_LABEL))


def labelled(code: Column, names: dict[int, str]) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code.cast("int")), F.lit("unknown"))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(F.btrim(text, F.lit(" \t\n\r\f\x0b"))), F.lit(0)) == 0


def is_http_url(text: Column) -> Column:
    return F.coalesce(F.lower(F.btrim(text, F.lit(" \t\n\r\f\x0b"))).rlike("^https?://"), F.lit(False))


def url_extension(url: Column) -> Column:
    """Text after the last dot, lower case, cut at the first question mark."""
    return F.split_part(F.lower(F.substring_index(url, ".", -1)), F.lit("?"), F.lit(1))


def truncate_error(text: Column, limit: int = C.ERROR_TEXT_MAX) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, limit)


def compute_error_text(text: Column) -> Column:
    return F.concat(F.lit("Compute error: "), F.coalesce(text, F.lit("Unknown compute error")))


def image_urls_of(json_data: Column) -> Column:
    """`crop_evidence_urls` of a JSON text; broken JSON or another shape gives an empty list."""
    parsed = F.from_json(json_data, "crop_evidence_urls array<string>")
    return F.coalesce(parsed["crop_evidence_urls"], F.array().cast("array<string>"))


def summary_of(json_data: Column) -> Column:
    parsed = F.from_json(json_data, "summary string")
    return F.coalesce(parsed["summary"], F.lit(""))


def search_params(metadata: Column) -> Column:
    """Threshold and result count of a search, read from its metadata text with defaults."""
    return F.struct(
        F.coalesce(F.get_json_object(metadata, "$.threshold").try_cast("double"), F.lit(C.SEARCH_THRESHOLD)).alias("threshold"),
        F.coalesce(F.get_json_object(metadata, "$.max_results").try_cast("int"), F.lit(C.SEARCH_MAX_RESULTS)).alias("max_results"),
    )


def frame_classes(detections: Column) -> Column:
    names = F.transform(detections, lambda d: d["class_name"])
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: F.coalesce(F.length(n), F.lit(0)) > 0)))


def effective_threshold(requested: Column, entry: Column, default: float = C.MATCH_THRESHOLD) -> Column:
    return F.coalesce(requested, entry, F.lit(default)).cast("double")


def _non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def image_id(item_ref: Column, point_id: Column) -> Column:
    return F.coalesce(_non_empty(item_ref), point_id)


def source_url_of(image_url: Column, source_url: Column) -> Column:
    return F.coalesce(_non_empty(image_url), _non_empty(source_url))


def storage_folder(camera_id: Column, evidence_id: Column) -> Column:
    return F.concat(F.lit("embeddings/"), camera_id, F.lit("/"), evidence_id)


def items_of(items: Column, images: Column) -> Column:
    """Both wire names are accepted; the native one wins when both are there."""
    return F.coalesce(items, images)


def item_id_of(item: Column) -> Column:
    return F.coalesce(item["item_id"], item["image_id"])
