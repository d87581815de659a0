"""Evidence results -> frames, points, requests, weapon reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import text, timing
from ..schemas import DETECTIONS
from ..sources.tables import latest
from . import predicates as P

def new_only(df: DataFrame, table: DataFrame, key: str, order: Column) -> DataFrame:
    """First row per key whose key the table does not hold yet."""
    known = table.select(key).join(df.select(key).distinct(), key, "left_semi").distinct()
    return latest(df.join(known, key, "left_anti"), [key], [order])


def frame_detections(image_name: Column, images: Column) -> Column:
    """Detections reported under a frame's name; of several reports the last counts, without one the list is empty."""
    named = F.filter(images, lambda i: i["image_name"] == F.coalesce(image_name, F.lit("")))
    return F.coalesce(F.try_element_at(named, F.lit(-1))["detections"], F.array().cast(DETECTIONS))


def stored_urls(results: DataFrame, uploads: DataFrame) -> DataFrame:
    """Put the stored copy's url (evidence_id, image_name, public_url) in place of the one in the message."""
    # only names a message asks for, so a list below is never longer than that message's frames
    asked = results.select("evidence_id", F.explode(F.transform("embeddings", lambda e: F.coalesce(e["image_name"], F.lit("")))).alias("image_name"))
    wanted = uploads.where(F.length("public_url") > 0).join(asked.distinct(), ["evidence_id", "image_name"], "left_semi")
    one = wanted.groupBy("evidence_id", "image_name").agg(F.max("public_url").alias("public_url"))
    lookup = one.groupBy("evidence_id").agg(F.map_from_entries(F.collect_list(F.struct("image_name", "public_url"))).alias("_urls"))
    swapped = F.transform("embeddings", lambda e: e.withField("image_url", F.coalesce(
        F.try_element_at(F.col("_urls"), F.coalesce(e["image_name"], F.lit(""))), e["image_url"])))
    return results.join(lookup, "evidence_id", "left").withColumn("embeddings", swapped).drop("_urls")


def analysed() -> Column:
    """Whether an evidence result carries a weapon analysis; an empty block is none."""
    return F.col("weapon_analysis").isNotNull() & (F.col("weapon_analysis.images").isNotNull() | F.col("weapon_analysis.summary").isNotNull())


def with_frames(results: DataFrame) -> DataFrame:
    """Adds `frames`, the embedded frames in message order with their detections. Works inside the row, no shuffle."""
    images = F.coalesce("weapon_analysis.images", F.array().cast(results.schema["weapon_analysis"].dataType["images"].dataType))
    return results.withColumn("frames", F.transform("embeddings", lambda e, i: F.struct(
        i.alias("pos"), F.coalesce(e["image_name"], F.lit("")).alias("image_name"), F.coalesce(e["image_index"], F.lit(0)).alias("image_index"),
        F.coalesce(e["image_url"], F.lit("")).alias("image_url"), e["vector"].alias("vector"),
        frame_detections(e["image_name"], images).alias("detections"))))


def frames(results: DataFrame, now: Column) -> DataFrame:
    """One row per embedded frame, with everything points and frame rows need.

    Detections are null when the evidence was not analysed and [] when the frame is clean.
    """
    shaped = results if "frames" in results.columns else with_frames(results)
    flat = shaped.withColumn("_category", text.entities_to_category(F.col("entities"))).select(
        "evidence_id", "camera_id", "user_id", "device_id", "app_id", "infraction_code", F.col("_category.ids").alias("category"),
        analysed().alias("weapon_analyzed"), F.explode("frames").alias("f")).select("*", "f.*").drop("f")
    return flat.select(
        text.natural_id("frame", F.col("evidence_id"), F.col("pos")).alias("point_id"), "vector",
        F.lit(C.SOURCE_EVIDENCE).alias("source_type"), "evidence_id", "camera_id", "user_id", "device_id", "app_id", "infraction_code",
        "category", "weapon_analyzed", (F.col("weapon_analyzed") & (F.size("detections") > 0)).alias("has_weapon"),
        text.frame_classes(F.col("detections")).alias("weapon_classes"), "image_index", "image_url", now.alias("created_at"), "pos",
        "image_name", F.when(F.col("weapon_analyzed"), F.col("detections")).alias("weapon_detections"))


def points(frame_rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return frame_rows.select(
        "point_id", "vector", "source_type", "evidence_id", "camera_id", "user_id", "device_id", "app_id", "infraction_code", "category",
        "weapon_analyzed", "has_weapon", "weapon_classes", "image_index", "image_url", none.alias("blacklist_entry_id"),
        none.alias("blacklist_reference_id"), none.alias("model_version"), "created_at")


def frame_rows(frame_df: DataFrame) -> DataFrame:
    meta = F.to_json(F.struct("source_type", "evidence_id", "camera_id", "user_id", "device_id", "app_id", "infraction_code", "category",
                              "weapon_analyzed", "has_weapon", "weapon_classes", "image_index", "image_url",
                              timing.iso_utc(F.col("created_at")).alias("created_at")), {"ignoreNullFields": "false"})
    return frame_df.select(
        text.natural_id("frame-row", F.col("point_id")).alias("id"), text.natural_id("request", F.col("evidence_id")).alias("request_id"),
        F.col("point_id").alias("qdrant_point_id"), "image_index", "image_url", "weapon_detections", meta.alias("json_data"), "created_at")


def requests(results: DataFrame, now: Column) -> DataFrame:
    """One embedded request row per evidence result; weapon fields come from the producer's summary."""
    results = results if "frames" in results.columns else with_frames(results)
    summary = F.col("weapon_analysis.summary")
    return results.select(
        text.natural_id("request", F.col("evidence_id")).alias("id"), "evidence_id", "camera_id", "user_id", "device_id", "app_id",
        "infraction_code", text.entities_to_category(F.col("entities"))["text"].alias("category"), F.lit(C.REQUEST_EMBEDDED).alias("status"),
        F.lit(None).cast("string").alias("worker_id"), F.lit(None).cast("string").alias("error_message"), F.lit(0).alias("retry_count"),
        F.lit(None).cast("timestamp").alias("processing_started_at"), now.alias("processing_completed_at"),
        F.col("stream_id").alias("stream_message_id"), analysed().alias("weapon_analyzed"),
        F.coalesce(summary["has_weapon"], F.lit(False)).alias("has_weapon"),
        F.coalesce(summary["classes_detected"], F.array().cast("array<string>")).alias("weapon_classes"),
        summary["max_confidence"].alias("weapon_max_confidence"), F.to_json(summary).alias("weapon_summary"),
        F.col("weapon_analysis_error.message").alias("weapon_analysis_error"), now.alias("created_at"), now.alias("updated_at"),
        F.transform("frames", lambda f: f["image_url"]).alias("image_urls"))


def error_requests(messages: DataFrame, now: Column) -> DataFrame:
    """The row that marks an evidence whose message could not be stored (evidence_id, ..., error)."""
    none = lambda kind: F.lit(None).cast(kind)
    given = lambda name, kind="string": F.col(name) if name in messages.columns else none(kind)
    return messages.select(
        text.natural_id("request", F.col("evidence_id")).alias("id"), "evidence_id", given("camera_id").alias("camera_id"),
        given("user_id").alias("user_id"), given("device_id").alias("device_id"), given("app_id", "int").alias("app_id"),
        given("infraction_code").alias("infraction_code"), none("string").alias("category"), F.lit(C.REQUEST_ERROR).alias("status"),
        none("string").alias("worker_id"), text.truncate_error(F.col("error")).alias("error_message"), F.lit(0).alias("retry_count"),
        none("timestamp").alias("processing_started_at"), none("timestamp").alias("processing_completed_at"),
        given("stream_id").alias("stream_message_id"), F.lit(False).alias("weapon_analyzed"), F.lit(False).alias("has_weapon"),
        F.array().cast("array<string>").alias("weapon_classes"), none("double").alias("weapon_max_confidence"),
        none("string").alias("weapon_summary"), none("string").alias("weapon_analysis_error"), now.alias("created_at"),
        now.alias("updated_at"), F.array().cast("array<string>").alias("image_urls"))


def weapon_rollup(armed: Column, summary: Column) -> Column:
    """Summary of the frames with detections: the producer's value, and where one is missing what the frames say."""
    found = F.flatten(F.transform(armed, lambda f: f["detections"]))
    n_armed = F.size(armed).cast("bigint")
    return F.struct(
        F.coalesce(summary["has_weapon"], F.lit(True)).alias("has_weapon"),
        F.coalesce(summary["total_detections"], F.size(found)).cast("bigint").alias("total_detections"),
        F.coalesce(summary["classes_detected"], text.frame_classes(found)).alias("classes_detected"),
        F.coalesce(summary["max_confidence"], F.array_max(F.transform(found, lambda d: d["confidence"]))).alias("max_confidence"),
        F.coalesce(summary["images_analyzed"].cast("bigint"), n_armed).alias("images_analyzed"),
        n_armed.alias("images_with_detections"))


def weapon_rollups(results: DataFrame) -> DataFrame:
    """Roll-up row per analysed evidence with at least one detection."""
    shaped = results if "frames" in results.columns else with_frames(results)
    armed = shaped.where(F.col("weapon_analysis").isNotNull()).withColumn("armed", F.filter("frames", lambda f: F.size(f["detections"]) > 0))
    return armed.where(F.size("armed") > 0).withColumn("rollup", weapon_rollup(F.col("armed"), F.col("weapon_analysis.summary")))


def weapons_events(results: DataFrame, detected_at: Column) -> DataFrame:
    """One report event per analysed evidence with at least one detection; frames keep the message order."""
    body = weapon_rollups(results)
    model = F.col("weapon_analysis.summary.model_version")
    who = [F.col(c) for c in ("evidence_id", "camera_id", "user_id", "device_id", "app_id", "infraction_code")]
    images = F.transform("armed", lambda f: F.struct(*[f[n].alias(n) for n in ("image_name", "image_index", "image_url", "detections")]))

    def payload(summary: Column) -> Column:
        return F.to_json(F.struct(*who, timing.iso_utc(detected_at, z=True).alias("detected_at"), summary.alias("summary"),
                                  images.alias("images")), {"ignoreNullFields": "false"})

    has_model = F.coalesce(F.size(F.map_keys(model)), F.lit(0)) > 0
    rollup = F.col("rollup")
    return body.select(F.lit(C.EVENT_WEAPONS).alias("event_type"),
                       F.when(has_model, payload(rollup.withField("model_version", model))).otherwise(payload(rollup)).alias("payload"))


def frame_problem(dim: int | None = None) -> Column:
    """What keeps an evidence from being stored: its first frame without a vector, or, with `dim`, with one of another dimension; null if there is none."""
    sizes = F.transform("embeddings", lambda e, i: F.struct(i.alias("pos"), F.coalesce(F.size(e["vector"]), F.lit(0)).alias("n")))
    wrong = F.try_element_at(F.filter(sizes, lambda s: (s["n"] <= 0) if dim is None else (s["n"] != dim)), F.lit(1))
    name = F.concat(F.lit("frame "), wrong["pos"].cast("string"))
    return F.when(wrong["n"] <= 0, F.concat(name, F.lit(" has no vector"))).when(wrong.isNotNull(), F.concat(name, F.lit(" has a vector of "), wrong["n"].cast("string"), F.lit(" cells")))


def ingest_evidence(results: DataFrame, known: DataFrame, now: Column, uploads: DataFrame | None = None, dim: int | None = None) -> dict[str, DataFrame]:
    """Parsed evidence results (the EVIDENCE_RESULT fields plus stream_id) -> rows of every table they feed.

    A message whose entity ids are no numbers cannot be read: it goes back as `dead`, leaves no row and blocks no later message. Messages without evidence id or
    embeddings are skipped, known evidence is skipped, and an evidence with a frame that cannot be stored leaves one error request and nothing else.
    """
    valid = text.entities_to_category(F.col("entities"))["valid"]
    admitted = P.admit(results.where(valid), P.ADMISSION["evidence_result"])
    fresh = new_only(admitted, known, "evidence_id", timing.stream_order()).withColumn("error", frame_problem(dim))
    good, bad = fresh.where(F.col("error").isNull()).drop("error"), fresh.where(F.col("error").isNotNull())
    good = with_frames(good if uploads is None else stored_urls(good, uploads))
    frame_df = frames(good, now)
    ok = requests(good, now)
    failed = error_requests(bad, now).select(*ok.columns)
    return {
        "dead": results.where(~valid),
        "frames": frame_df,
        "points": points(frame_df),
        "frame_rows": frame_rows(frame_df),
        "requests": ok.unionByName(failed),
        "weapons": weapons_events(good, now),
    }


def evidence_errors(errors: DataFrame, known: DataFrame, now: Column) -> DataFrame:
    """Compute errors of evidence (entity_id, entity_type, error, stream_id): one error request unless one exists."""
    mine = errors.where(F.col("entity_type") == "evidence").select(
        F.coalesce("entity_id", F.lit("")).alias("evidence_id"), text.compute_error_text(F.col("error")).alias("error"), "stream_id")
    fresh = new_only(mine, known, "evidence_id", timing.stream_order()).withColumn("camera_id", F.lit("unknown"))
    return error_requests(fresh.drop("stream_id"), now)
