"""Row filters, guards and validation rules, as column predicates that Spark can push to the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import config as C
from ..functions import text, vectors


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(and_, conditions) if conditions else F.lit(True)


def payload_condition(schema: T.StructType, conditions: Mapping[str, object]) -> Column:
    """AND of field conditions: a scalar means equality, a list means any-of. On an array field: contains / overlaps.

    A field the table lacks, or a null in it, never matches: the condition is then false or null, and a filter drops
    both. Plain comparisons are kept, so the scan can use them.
    """
    parts = []
    for name, value in conditions.items():
        if name not in schema.fieldNames():
            parts.append(F.lit(False))
            continue
        column = F.col(name)
        if isinstance(schema[name].dataType, T.ArrayType):
            wanted = list(value) if isinstance(value, (list, tuple)) else [value]
            kind = schema[name].dataType.simpleString()
            test = F.arrays_overlap(column, F.array(*[F.lit(v) for v in wanted]).cast(kind))
        elif isinstance(value, (list, tuple)):
            test = column.isin(*value)
        else:
            test = column == F.lit(value)
        parts.append(test)
    return _all(parts)


def payload_filter(df: DataFrame, conditions: Mapping[str, object]) -> DataFrame:
    return df.where(payload_condition(df.schema, conditions))


def evidence_only(df: DataFrame, conditions: Mapping[str, object] | None = None) -> DataFrame:
    """The scope always wins over a source_type the caller passes."""
    return payload_filter(df, {**(conditions or {}), "source_type": C.SOURCE_EVIDENCE})


def blacklist_only(df: DataFrame, conditions: Mapping[str, object] | None = None) -> DataFrame:
    return payload_filter(df, {**(conditions or {}), "source_type": C.SOURCE_BLACKLIST})


def entry_points(df: DataFrame, entry_id: str, conditions: Mapping[str, object] | None = None) -> DataFrame:
    return payload_filter(df, {**(conditions or {}), "source_type": C.SOURCE_BLACKLIST, "blacklist_entry_id": entry_id})


def weapons_conditions(mode: str | None, classes: Sequence[str] | None = None) -> dict[str, object]:
    """An unknown mode adds nothing; classes only count in mode `only`."""
    if mode == "only":
        return {"has_weapon": True, **({"weapon_classes": list(classes)} if classes else {})}
    if mode == "exclude":
        return {"has_weapon": False}
    if mode == "analyzed_clean":
        return {"weapon_analyzed": True, "has_weapon": False}
    return {}


def weapons_filter(df: DataFrame, mode: str | None, classes: Sequence[str] | None = None) -> DataFrame:
    return payload_filter(df, weapons_conditions(mode, classes))


def search_conditions(metadata: Mapping[str, object] | None) -> dict[str, object]:
    """Only camera_id, object_type, category and the weapons mode of a search's metadata reach the filter."""
    metadata = metadata or {}
    allowed = {k: metadata[k] for k in ("camera_id", "object_type", "category") if k in metadata}
    return {**allowed, **weapons_conditions(metadata.get("weapons_filter"), metadata.get("weapon_classes")),
            "source_type": C.SOURCE_EVIDENCE}


def search_filter_columns(metadata: Column) -> list[Column]:
    """The same allow-list per row, from a JSON metadata text, as the FILTER_FIELDS of the similarity join."""
    def any_of(name: str) -> Column:
        """A scalar or a list; either way the field has to have one of the values."""
        raw = F.get_json_object(metadata, f"$.{name}")
        return F.when(raw.isNotNull(), F.coalesce(F.when(raw.startswith("["), F.from_json(raw, "array<string>")), F.array(raw))).alias(f"f_{name}")

    return [
        any_of("camera_id"), any_of("object_type"), any_of("category"),
        F.get_json_object(metadata, "$.weapons_filter").alias("f_weapons_filter"),
        F.from_json(F.get_json_object(metadata, "$.weapon_classes"), "array<string>").alias("f_weapon_classes"),
    ]


@dataclass(frozen=True)
class Caller:
    user_id: str
    role: str = "user"
    created_by: str | None = None

    @property
    def owner_id(self) -> str | None:
        return self.created_by if self.role == "guest" else self.user_id

    @property
    def is_admin(self) -> bool:
        return self.role in C.ADMIN_ROLES


def tenant_scope(df: DataFrame, caller: Caller, target: str | None = None) -> DataFrame:
    """Admins see everything or one target tenant; a guest sees its parent's rows; others only their own."""
    tenant = target if caller.is_admin else caller.owner_id
    if tenant is None:
        return df if caller.is_admin else df.where(F.lit(False))
    return df.where(F.col("user_id") == F.lit(tenant))


def valid_vectors(df: DataFrame, column: str = "vector") -> DataFrame:
    return df.where(vectors.is_valid_vector(F.col(column)))


def index_condition(user_id: str, external_ids: Sequence[object] | None = None, batch_id: object | None = None) -> Column:
    parts = [F.col("user_id").cast("string") == F.lit(str(user_id))]
    if external_ids:
        parts.append(F.col("external_id").cast("string").isin(*[str(e) for e in external_ids]))
    if batch_id:
        parts.append(F.col("batch_id").cast("string") == F.lit(str(batch_id)))
    return _all(parts)


def index_scope(df: DataFrame, user_id: str, external_ids: Sequence[object] | None = None, batch_id: object | None = None) -> DataFrame:
    return df.where(index_condition(user_id, external_ids, batch_id))


# Fields a message must carry, per job.
ADMISSION = {
    "evidence_result": ("evidence_id", "embeddings"),
    "search_result": ("search_id", "vector"),
    "search_created": ("search_id", "image_url"),
    "evidence_created": ("evidence_id", "image_urls"),
}


def is_admitted(schema: T.StructType, required: Sequence[str]) -> Column:
    """Texts and lists must be there and not empty; a search vector only has to be there."""
    parts = []
    for name in required:
        column, kind = F.col(name), schema[name].dataType
        if isinstance(kind, T.ArrayType) and name != "vector":
            parts.append(F.coalesce(F.size(column), F.lit(0)) > 0)
        elif isinstance(kind, T.StringType):
            parts.append(F.coalesce(F.length(column), F.lit(0)) > 0)
        else:
            parts.append(column.isNotNull())
    return _all(parts)


def admit(df: DataFrame, required: Sequence[str]) -> DataFrame:
    return df.where(is_admitted(df.schema, required))


def admission_counts(df: DataFrame, required: Sequence[str]) -> DataFrame:
    ok = is_admitted(df.schema, required)
    return df.agg(F.count_if(ok).alias("admitted"), F.count_if(~ok).alias("rejected"))


def _item_problem(item: Column, position: Column) -> Column:
    label = F.concat(F.lit("item "), position.cast("string"))
    return (
        F.when(item.isNull(), F.concat(label, F.lit(" is not an object")))
        .when(text.is_blank(text.item_id_of(item)), F.concat(label, F.lit(" missing item_id/image_id")))
        .when(~text.is_http_url(item["image_url"]), F.concat(label, F.lit(" has invalid image_url")))
    )


def validate_submits(df: DataFrame, n_cap: int = C.BATCH_ITEM_CAP) -> DataFrame:
    """Adds `bindable` (tier 1), `error` (tier 2, first failing rule) and `entries`, the item list in use.

    Input: user_id, client_batch_ref, external_id, items, images. An item that is not an object reads null.
    """
    entries = text.items_of(F.col("items"), F.col("images"))
    found = F.filter(F.transform(F.col("entries"), _item_problem), lambda p: p.isNotNull())
    size = F.coalesce(F.size("entries"), F.lit(0))
    error = (
        F.when(text.is_blank(F.col("external_id")), F.lit("missing external_id"))
        .when(size == 0, F.lit("batch has no items"))
        .when(size > n_cap, F.concat(F.lit(f"batch exceeds N_CAP={n_cap} (got "), size.cast("string"), F.lit(")")))
        .otherwise(F.try_element_at(found, F.lit(1)))
    )
    bindable = text.is_uuid(F.col("user_id")) & ~text.is_blank(F.col("client_batch_ref"))
    return df.withColumn("entries", entries).withColumn("bindable", F.coalesce(bindable, F.lit(False))).withColumn("error", error)


def entries_filter(df: DataFrame, user_id: str | None = None, active: bool | None = True, category: str | None = None) -> DataFrame:
    """`active` None means both. A missing user or category means no condition."""
    parts = []
    if user_id is not None:
        parts.append(F.col("user_id") == F.lit(user_id))
    if active is not None:
        parts.append(F.col("active") == F.lit(active))
    if category is not None:
        parts.append(F.col("category") == F.lit(category))
    return df.where(_all(parts))


def same_model(df: DataFrame, left: str = "reference_model_version", right: str = "model_version") -> DataFrame:
    """A pair with different versions, or without one, is dropped."""
    return df.where(F.col(left) == F.col(right))


def label_status(df: DataFrame, names: Mapping[int, str], column: str = "status", out: str = "status_name") -> DataFrame:
    return df.withColumn(out, text.labelled(F.col(column), dict(names)))


def project_matches(df: DataFrame, kind: str = C.SEARCH_TYPE_EVIDENCE) -> DataFrame:
    """Result shape of stored matches. Batch and item come from the metadata text of an index match."""
    meta = F.col("match_metadata")
    batch, item = F.get_json_object(meta, "$.batch_id"), F.get_json_object(meta, "$.item_index").try_cast("int")
    if kind == C.SEARCH_TYPE_INDEX:
        return df.select(
            F.col("evidence_id").alias("image_id"), F.col("image_url").alias("source_url"), F.col("similarity_score").alias("score"),
            "external_id", batch.alias("batch_id"), item.alias("item_index"),
        )
    indexed = F.col("external_id").isNotNull()
    return df.select(
        "evidence_id", "camera_id", "similarity_score", "image_url", F.coalesce(meta, F.lit("{}")).alias("metadata"),
        "external_id", F.when(indexed, batch).alias("batch_id"), F.when(indexed, item).alias("item_index"),
    )


def weapon_state(df: DataFrame) -> DataFrame:
    state = (
        F.when(F.col("weapon_analysis_error").isNotNull(), "analysis_failed")
        .when(~F.coalesce("weapon_analyzed", F.lit(False)), "never_analyzed")
        .when(F.coalesce("has_weapon", F.lit(False)), "weapon")
        .otherwise("clean")
    )
    return df.withColumn("weapon_state", state)


# Row rules per table: column -> (test, message).
CONSTRAINTS = {
    "entry": {
        "name": (lambda c: c.isNotNull() & F.length(c).between(1, 255), "name must have 1 to 255 characters"),
        "match_threshold": (lambda c: c.isNull() | c.between(0.0, 1.0), "match_threshold must be in 0..1"),
    },
    "reference": {"image_url": (lambda c: text.is_http_url(c), "image_url must be http or https")},
    "index_search": {
        "external_ids": (lambda c: F.coalesce(F.size(c), F.lit(0)).between(1, C.EXTERNAL_IDS_CAP), "external_ids must have 1 to 200 ids"),
        "image_url": (lambda c: c.isNotNull(), "image_url is required"),
    },
}


def check_constraints(df: DataFrame, rules: Mapping[str, tuple]) -> DataFrame:
    """Adds `violations`, the messages of the rules a row breaks; an empty list means valid."""
    tests = [F.when(~F.coalesce(test(F.col(name)), F.lit(False)), F.lit(message)) for name, (test, message) in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*tests)))


def supported_image_urls(df: DataFrame, column: str = "image_url", formats: Sequence[str] = C.IMAGE_EXTENSIONS) -> DataFrame:
    url = F.col(column)
    return df.where(url.rlike("^https?://") & text.url_extension(url).isin(*formats))
