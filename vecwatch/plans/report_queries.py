"""Registered queries for reports, latency, evidence ingest and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C, schemas
from ..functions import text, timing
from ..operators import feeds, ingest as I, ordered, predicates as P, reports as R
from ..sources.tables import durable
from .registry import joined, query, r6, ts, us

NOW = "2024-01-20 12:00:00"
_SINCE = "2024-01-05 00:00:00"


# --- counts and coverage -----------------------------------------------------------------
@query("status_counts", """
    select 'requests' as kind, l.name as status_name, (select count(*) from v_requests r where r.status = l.code) as n
      from (values (1, 'to_work'), (2, 'working'), (3, 'embedded'), (4, 'done'), (5, 'error')) l(code, name)
    union all select 'searches', l.name, (select count(*) from v_searches r where r.status = l.code)
      from (values (1, 'to_work'), (2, 'working'), (3, 'completed'), (4, 'error')) l(code, name)""")
def _(d):
    one = lambda df, labels, kind: R.status_counts(df, labels).withColumn("kind", F.lit(kind))
    return one(d["v_requests"], C.REQUEST_STATUS, "requests").unionByName(one(d["v_searches"], C.SEARCH_STATUS, "searches"))


@query("status_labels", """
    select id, case status when 1 then 'pending' when 2 then 'working' when 3 then 'completed' when 4 then 'error' else 'unknown' end as status_name from v_requests""")
def _(d):
    return P.label_status(d["v_requests"], C.SEARCH_STATUS_LABELS).select("id", "status_name")


@query("weapon_states", """
    select case when weapon_analysis_error is not null then 'analysis_failed' when not weapon_analyzed then 'never_analyzed' when has_weapon then 'weapon' else 'clean' end
      as weapon_state, count(*) as n from v_requests group by 1""")
def _(d):
    return P.weapon_state(d["v_requests"]).groupBy("weapon_state").agg(F.count(F.lit(1)).alias("n"))


_CATEGORY_IDS = """ids as (select distinct cast(user_id % 10 as bigint) as id from events where event_id % 7 not in (0, 1) {own}
      union select distinct cast(10 + event_id % 3 as bigint) from events where event_id % 7 not in (0, 1, 2) {own})"""
_LABELS = "case id when 0 then 'person' when 1 then 'bicycle' when 2 then 'car' when 3 then 'motorcycle' when 5 then 'bus' when 7 then 'truck' else 'unk' end as label"


@query("category_list", f"with {_CATEGORY_IDS.format(own='')} select id, {_LABELS} from ids")
def _(d):
    return R.categories(d["v_requests"], P.Caller("root", "root"))


@query("category_list_of_tenant", f"with {_CATEGORY_IDS.format(own='and user_id = 17')} select id, {_LABELS} from ids")
def _(d):
    return R.categories(d["v_requests"], P.Caller("user-3", "guest", "user-17"))


@query("distinct_category_texts", "select distinct category from v_requests where category is not null")
def _(d):
    return R.distinct_categories(d["v_requests"])


@query("coverage_overview", f"""
    select count(*) as total, count(*) filter (where weapon_analyzed) as analyzed, count(*) filter (where has_weapon) as with_weapons,
      count(*) filter (where weapon_analyzed and not has_weapon) as clean, count(*) filter (where status = 5) as errors,
      epoch_us(min(created_at)) as oldest, epoch_us(max(created_at)) as newest from v_requests where created_at > timestamp '{_SINCE}'""")
def _(d):
    return R.coverage(d["v_requests"], ts(_SINCE)).withColumns({"oldest": us("oldest"), "newest": us("newest")})


@query("daily_coverage", f"""
    select cast(date_trunc('day', created_at) as date) as day, count(*) as total, count(*) filter (where weapon_analyzed) as analyzed,
      count(*) filter (where has_weapon) as with_weapons, count(*) filter (where weapon_analysis_error is not null) as analysis_errors
    from v_requests where created_at > timestamp '{_SINCE}' group by 1""")
def _(d):
    return R.daily_coverage(d["v_requests"], ts(_SINCE)).withColumn("day", F.to_date("day"))


_PHASES = """w as (select cast(split_part(stream_message_id, '-', 1) as bigint) as i, cast(floor(epoch_us(created_at) / 1000.0 + 0.5) as bigint) as p,
      cast(floor(epoch_us(processing_completed_at) / 1000.0 + 0.5) as bigint) as c from v_requests
      where weapon_analyzed and created_at >= timestamp '2024-01-03 00:00:00' and created_at < timestamp '2024-01-28 00:00:00'
        and stream_message_id is not null and processing_completed_at is not null),
    t as (select 'queue_wait' as phase, p - i as ms from w union all select 'processing', c - p from w union all select 'total', c - i from w)"""


@query("phase_latency", f"""with {_PHASES}
    select phase, count(*) as n, min(ms) as "min", cast(round_even(percentile_cont(0.5) within group (order by ms), 0) as bigint) as p50,
      cast(round_even(percentile_cont(0.9) within group (order by ms), 0) as bigint) as p90, cast(round_even(percentile_cont(0.99) within group (order by ms), 0) as bigint) as p99,
      max(ms) as "max", cast(round_even(avg(ms), 0) as bigint) as "avg" from t group by phase""")
def _(d):
    return R.phase_latency(d["v_requests"], ts("2024-01-03"), ts("2024-01-28"))


@query("phase_union", f"with {_PHASES} select phase, count(*) as n, sum(ms) as total_ms from t group by phase")
def _(d):
    times = R.phase_times(d["v_requests"], ts("2024-01-03"), ts("2024-01-28"))
    parts = [times.where(F.col("phase") == p).groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total_ms")) for p in R.PHASES]
    return R.union_phases(*parts)


_STREAM = "cast(split_part(stream_id, '-', 1) as bigint) as ms, cast(split_part(stream_id, '-', 2) as bigint) as sub"
_OUT = f"""o as (select key, {_STREAM} from v_outputs), i as (select key, {_STREAM} from v_inputs),
    lo as (select key, ms, sub from (select *, row_number() over (partition by key order by ms desc, sub desc) as rn from o) t where rn = 1)"""
_ASOF = f"""{_OUT}, pairs as (select lo.key, i.ms as in_ms, lo.ms as out_ms, lo.ms - i.ms as delta_ms
      from lo asof left join i on lo.key = i.key and lo.ms * 10 + lo.sub >= i.ms * 10 + i.sub)"""


@query("latest_output_per_key", f"with {_OUT} select key, ms, sub from lo")
def _(d):
    return R.latest_per_key(d["v_outputs"]).select("key", "ms", "sub")


@query("latest_output_among_newest", f"""with {_OUT}, top as (select * from o order by ms desc, sub desc limit 200)
    select key, ms, sub from (select *, row_number() over (partition by key order by ms desc, sub desc) as rn from top) t where rn = 1""")
def _(d):
    return R.latest_per_key(d["v_outputs"], 200).select("key", "ms", "sub")


_ASOF_SQL = f"with {_ASOF} select key, in_ms, out_ms, delta_ms from pairs"


@query("asof_latency", _ASOF_SQL)
def _(d):
    return R.asof_latency(d["v_inputs"], d["v_outputs"])


_WINDOW_SQL = f"""with {_OUT}, ranked as (select *, row_number() over (order by ms, sub) as g from i),
    n as (select lo.key, lo.ms, lo.sub, (select count(*) from i where i.ms * 10 + i.sub <= lo.ms * 10 + lo.sub) as upto from lo)
    select n.key, r.ms as in_ms, n.ms as out_ms, n.ms - r.ms as delta_ms
    from n left join (select n.key, max(r.g) as g from n join ranked r on r.key = n.key and r.g <= n.upto and r.g > n.upto - 120 group by n.key) b on b.key = n.key
    left join ranked r on r.g = b.g"""


@query("asof_latency_input_window", _WINDOW_SQL)
def _(d):
    return R.asof_latency(d["v_inputs"], d["v_outputs"], input_window=120)


@query("asof_latency_ranges", _ASOF_SQL)
def _(d):
    return R.asof_latency(d["v_inputs"], d["v_outputs"], ranges=16)


@query("asof_latency_input_window_ranges", _WINDOW_SQL)
def _(d):
    return R.asof_latency(d["v_inputs"], d["v_outputs"], input_window=120, ranges=16)


@query("phase_latency_sketched", f"""with {_PHASES}
    select phase, count(*) as n, min(ms) as "min", max(ms) as "max", cast(round_even(avg(ms), 0) as bigint) as "avg", true as p50_near, true as p90_near, true as p99_near from t group by phase""")
def _(d):
    """Percentiles merged from stored daily sketches, held against the ranks of the exact values."""
    days = durable(R.daily_sketches(d["v_requests"], ts("2024-01-03"), ts("2024-01-28")))
    found, times = R.merged_latency(days), R.phase_times(d["v_requests"], ts("2024-01-03"), ts("2024-01-28"))
    wanted = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    ranks = times.join(found, "phase").groupBy("phase").agg(*[x for p in wanted for x in (F.count_if(F.col("ms") < F.col(p)).alias(f"{p}_lo"), F.count_if(F.col("ms") <= F.col(p)).alias(f"{p}_hi"))])
    near = lambda p, q: ((F.col(f"{p}_lo") <= (q + R.SKETCH_ERROR) * F.col("n") + 1) & (F.col(f"{p}_hi") >= (q - R.SKETCH_ERROR) * F.col("n") - 1)).alias(f"{p}_near")
    return found.join(ranks, "phase").select("phase", "n", "min", "max", "avg", *[near(p, q) for p, q in wanted.items()])


@query("latency_statistics", f"""with {_ASOF}, s as (select delta_ms as x, row_number() over (order by delta_ms) - 1 as r, count(*) over () as n from pairs where in_ms is not null)
    select max(n) as n, min(x) as "min", cast(floor(median(x)) as bigint) as p50, max(x) filter (where r = least(floor(n * 0.90), n - 1)) as p90,
      max(x) filter (where r = least(floor(n * 0.99), n - 1)) as p99, max(x) as "max", cast(floor(avg(x)) as bigint) as "avg" from s""")
def _(d):
    return R.latency_stats(R.asof_latency(d["v_inputs"], d["v_outputs"]).where("delta_ms is not null"))


@query("slowest_pairs", f"with {_ASOF} select key, delta_ms from pairs where in_ms is not null order by delta_ms desc, key limit 5")
def _(d):
    return R.slowest(R.asof_latency(d["v_inputs"], d["v_outputs"]), 5, 5000).select("key", "delta_ms")


@query("global_input_sequence", "select event_id, row_number() over (order by ts, event_id) as seq from events")
def _(d):
    rows = d["events"].withColumn("hour", F.date_trunc("hour", F.col("ts")))
    return ordered.global_sequence(rows, ["ts", "event_id"], F.col("hour"), "seq").select("event_id", "seq")


@query("volume_profile", """
    with r as (select cast(created_at as date) as d, count(*) as n from v_requests group by 1), s as (select cast(created_at as date) as d, count(*) as n from v_searches group by 1)
    select 'requests' as table_name, cast(sum(n) as bigint) as row_count, round(avg(n), 6) as daily_avg, max(n) as daily_peak from r
    union all select 'searches', cast(sum(n) as bigint), round(avg(n), 6), max(n) from s""")
def _(d):
    profile = R.volume_profile({"requests": (d["v_requests"], "created_at"), "searches": (d["v_searches"], "created_at")})
    return profile.withColumn("daily_avg", r6("daily_avg"))


@query("status_shares", """
    select status, count(*) as n, round(count(*) * 1.0 / sum(count(*)) over (), 6) as share, case status when 1 then 'to_work' when 2 then 'working' when 3 then 'embedded'
      when 4 then 'done' when 5 then 'error' end as status_name from v_requests group by status""")
def _(d):
    return R.status_shares(d["v_requests"], C.REQUEST_STATUS).withColumn("share", r6("share"))


# --- evidence ingest -----------------------------------------------------------------------
def _results(d):
    """One evidence message per five stored vectors; every evidence has its own mix of weapon blocks."""
    n = F.col("vec_id")
    e = F.floor(n / 5)
    name = F.concat(F.lit("f"), (n % 5).cast("string"))
    box = F.lit(None).cast("struct<x1:int,y1:int,x2:int,y2:int>")
    hit = lambda cls, conf: F.struct(cls.alias("class_name"), F.lit(1).alias("class_id"), conf.alias("confidence"), F.lit("m").alias("source"), box.alias("bbox"))
    first = hit(F.when(n % 2 == 0, F.lit("arma")).otherwise(F.lit("persona")), (n % 10) / 10)
    second = hit(F.lit(""), (n % 7) / 10)
    found = F.when(n % 3 == 0, F.array(first, second)).when(n % 3 == 1, F.array(first)).otherwise(F.array().cast(schemas.DETECTIONS))
    image = F.struct(name.alias("image_name"), (n % 5).cast("int").alias("image_index"), found.alias("detections"))
    frame = F.struct(name.alias("image_name"), F.when(n % 4 != 1, F.concat(F.lit("http://img/"), n.cast("string"))).alias("image_url"),
                     (n % 5).cast("int").alias("image_index"), F.when(n % 55 != 36, F.col("embedding")).alias("vector"))
    # five frames per evidence id at most, by construction of the id
    per = d["embeddings"].groupBy(e.alias("e")).agg(
        F.array_sort(F.collect_list(F.struct((n % 5).alias("o"), frame.alias("f"), image.alias("i")))).alias("all"), F.min("label").alias("label"))
    ev = F.col("e")
    summary = F.struct(
        F.when(ev % 4 == 0, F.lit(7)).alias("images_analyzed"), F.lit(None).cast("int").alias("images_with_detections"),
        F.when(ev % 4 == 1, F.lit(99)).alias("total_detections"), F.when(ev % 4 == 2, F.array(F.lit("z"))).alias("classes_detected"),
        F.when(ev % 4 == 3, F.lit(0.77)).alias("max_confidence"), F.when(ev % 4 != 0, ev % 2 == 0).alias("has_weapon"),
        F.when(ev % 6 == 1, F.create_map(F.lit("yolo"), F.lit("8"))).alias("model_version"))
    images = F.transform("all", lambda x: x["i"])
    twice = F.struct(F.lit("f0").alias("image_name"), F.lit(0).alias("image_index"), F.array(hit(F.lit("last"), F.lit(0.5).cast("double"))).alias("detections"))
    block = F.struct(F.when(ev % 8 == 3, F.concat(images, F.array(twice))).otherwise(images).alias("images"), F.when(ev % 5 != 4, summary).alias("summary"))
    entities = (F.when(ev % 6 == 0, F.lit(None)).when(ev % 6 == 1, F.array().cast("array<string>")).when(ev % 6 == 2, F.array(*[F.lit(x) for x in ("5", "2", "2")]))
                .when(ev % 6 == 3, F.array(F.lit("0"))).when(ev % 6 == 4, F.array(F.lit("x"))).otherwise(F.array(F.col("label").cast("string"), F.lit("12"))))
    return per.select(
        F.when(ev % 19 == 0, F.lit("")).otherwise(F.concat(F.lit("E"), ev.cast("string"))).alias("evidence_id"), F.lit("cam").alias("camera_id"),
        F.lit("user-1").alias("user_id"), F.lit("dev").alias("device_id"), F.lit(1).alias("app_id"), F.lit("INF").alias("infraction_code"),
        F.lit(None).cast("string").alias("zip_url"), entities.alias("entities"), F.lit(None).cast("string").alias("trace_event"),
        F.transform("all", lambda x: x["f"]).alias("embeddings"), F.when(ev % 3 != 0, block).alias("weapon_analysis"),
        F.when(ev % 9 == 0, F.struct(F.lit("timeout").alias("message"))).alias("weapon_analysis_error"), F.concat(ev.cast("string"), F.lit("-0")).alias("stream_id"))


_EV = """f as (select vec_id as n, cast(floor(vec_id / 5) as bigint) as e, vec_id % 5 as pos, embedding, label from embeddings),
    known as (select concat('E', cast(event_id as string)) as evidence_id from events where event_type = 'error'),
    ok as (select e, concat('E', cast(e as string)) as evidence_id, min(label) as label from f where e % 19 <> 0 group by e having concat('E', cast(e as string)) not in (select evidence_id from known)),
    g as (select f.*, ok.evidence_id, e % 3 <> 0 as analyzed, (e % 8 = 3 and pos = 0) as doubled from f join ok using (e) where e % 6 <> 4 and e % 11 <> 7)"""
_DET = "case when doubled then 1 when n % 3 = 0 then 2 when n % 3 = 1 then 1 else 0 end"
_CLS = "case when doubled then 'last' when n % 3 = 2 then '' when n % 2 = 0 then 'arma' else 'persona' end"


def _ingested(d, uploads=None):
    known = d["events"].where("event_type = 'error'").select(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("evidence_id"))
    return I.ingest_evidence(_results(d), known, ts(NOW), uploads)


@query("ingest_frames", f"""with {_EV}
    select evidence_id, cast(pos as int) as pos, cast(pos as int) as image_index, case when n % 4 = 1 then '' else concat('http://img/', cast(n as string)) end as image_url,
      analyzed as weapon_analyzed, analyzed and {_DET} > 0 as has_weapon, case when analyzed then {_CLS} else '' end as weapon_classes, case when analyzed then {_DET} end as n_detections,
      case e % 6 when 2 then '2,5' when 3 then '0' when 5 then (select case when ok.label < 12 then concat(cast(ok.label as string), ',12') else '12' end from ok where ok.e = g.e) end as category,
      round(cast(embedding[1] as double), 6) as first_value from g""")
def _(d):
    frames = _ingested(d)["frames"]
    return frames.select("evidence_id", "pos", "image_index", "image_url", "weapon_analyzed", "has_weapon", joined("weapon_classes").alias("weapon_classes"),
                         F.when(F.col("weapon_detections").isNotNull(), F.size("weapon_detections")).alias("n_detections"), joined("category").alias("category"),
                         r6(F.element_at("vector", 1).cast("double")).alias("first_value"))


@query("ingest_stored_urls", f"""with {_EV}
    select evidence_id, cast(pos as int) as pos, case when n % 2 = 0 then concat('s3/', cast(n as string)) when n % 4 = 1 then '' else concat('http://img/', cast(n as string)) end as image_url from g""")
def _(d):
    n = F.col("vec_id")
    uploads = d["embeddings"].where(n % 2 == 0).select(F.concat(F.lit("E"), F.floor(n / 5).cast("string")).alias("evidence_id"),
                                                       F.concat(F.lit("f"), (n % 5).cast("string")).alias("image_name"), F.concat(F.lit("s3/"), n.cast("string")).alias("public_url"))
    return _ingested(d, uploads)["frames"].select("evidence_id", "pos", "image_url")


@query("ingest_requests", f"""with {_EV}
    select ok.evidence_id, case when e % 11 = 7 then 5 else 3 end as status, case when e % 11 = 7 then 'frame 1 has no vector' end as error_message,
      e % 11 <> 7 and e % 3 <> 0 as weapon_analyzed, case when e % 11 = 7 or e % 3 = 0 or e % 5 = 4 or e % 4 = 0 then false else e % 2 = 0 end as has_weapon,
      case when e % 11 <> 7 and e % 3 <> 0 and e % 5 <> 4 and e % 4 = 2 then 'z' else '' end as weapon_classes,
      case when e % 11 <> 7 and e % 3 <> 0 and e % 5 <> 4 and e % 4 = 3 then 0.77 end as weapon_max_confidence,
      case when e % 11 = 7 then null when e % 6 = 2 then '[2,5]' when e % 6 = 3 then '[0]' when e % 6 = 5 then concat('[', cast(label as string), ',12]') end as category,
      case when e % 11 <> 7 and e % 9 = 0 then 'timeout' end as weapon_analysis_error,
      case when e % 11 = 7 then 0 else (select count(*) from f where f.e = ok.e) end as n_urls from ok where e % 6 <> 4""")
def _(d):
    rows = _ingested(d)["requests"]
    return rows.select("evidence_id", "status", "error_message", "weapon_analyzed", "has_weapon", joined("weapon_classes").alias("weapon_classes"), "weapon_max_confidence",
                       "category", "weapon_analysis_error", F.size("image_urls").alias("n_urls"))


@query("ingest_unreadable_entities", "select distinct concat(cast(cast(floor(vec_id / 5) as bigint) as string), '-0') as stream_id from embeddings where cast(floor(vec_id / 5) as bigint) % 6 = 4")
def _(d):
    return _ingested(d)["dead"].select("stream_id")


@query("ingest_frame_rows", f"""with {_EV}
    select count(*) as n, count(distinct evidence_id) as requests, count(*) filter (where analyzed) as with_detections, count(*) filter (where analyzed and {_DET} = 0) as clean from g""")
def _(d):
    rows = _ingested(d)["frame_rows"]
    return rows.agg(F.countDistinct("qdrant_point_id").alias("n"), F.countDistinct("request_id").alias("requests"), F.count("weapon_detections").alias("with_detections"),
                    F.count_if(F.size("weapon_detections") == 0).alias("clean"))


@query("frame_feed", f"""with {_EV}
    select 'image_embedding.upserted' as event_type, evidence_id, cast(pos as int) as image_index, case when analyzed then cast({_DET} as int) end as n_detections, 8 as keys from g""")
def _(d):
    events = feeds.frame_events(_ingested(d)["frame_rows"])
    get = lambda p: F.get_json_object("payload", p)
    found = F.from_json(get("$.weapon_detections"), "array<string>")
    return events.select("event_type", F.get_json_object(get("$.json_data"), "$.evidence_id").alias("evidence_id"), get("$.image_index").cast("int").alias("image_index"),
                         F.when(found.isNotNull(), F.size(found)).alias("n_detections"), F.size(F.json_object_keys("payload")).alias("keys"))


@query("weapons_detected_events", f"""with {_EV}, a as (select * from g where analyzed and {_DET} > 0),
    c as (select evidence_id, min(e) as e, sum({_DET}) as found, count(*) as frames, string_agg(distinct {_CLS}, ',' order by {_CLS}) filter (where {_CLS} <> '') as classes,
        max(case when doubled then 0.5 when n % 3 = 0 then greatest(n % 10, n % 7) / 10 else (n % 10) / 10 end) as conf, string_agg(concat('f', cast(pos as string)), ',' order by pos) as images from a group by evidence_id)
    select evidence_id, case when e % 5 = 4 or e % 4 = 0 then true else e % 2 = 0 end as has_weapon, cast(case when e % 5 <> 4 and e % 4 = 1 then 99 else found end as bigint) as total_detections,
      case when e % 5 <> 4 and e % 4 = 2 then 'z' else classes end as classes_detected, round(case when e % 5 <> 4 and e % 4 = 3 then 0.77 else conf end, 6) as max_confidence,
      cast(case when e % 5 <> 4 and e % 4 = 0 then 7 else frames end as bigint) as images_analyzed, frames as images_with_detections, images,
      e % 5 <> 4 and e % 6 = 1 as has_model, '2024-01-20T12:00:00Z' as detected_at from c""")
def _(d):
    events = _ingested(d)["weapons"]
    shape = ("evidence_id string, detected_at string, summary struct<has_weapon:boolean,total_detections:bigint,classes_detected:array<string>,max_confidence:double,"
             "images_analyzed:bigint,images_with_detections:bigint,model_version:map<string,string>>, images array<struct<image_name:string>>")
    p = events.select(F.from_json("payload", shape).alias("p")).select("p.*")
    return p.select("evidence_id", "summary.has_weapon", "summary.total_detections", joined("summary.classes_detected").alias("classes_detected"),
                    r6("summary.max_confidence").alias("max_confidence"), "summary.images_analyzed", "summary.images_with_detections",
                    joined(F.transform("images", lambda i: i["image_name"])).alias("images"), F.col("summary.model_version").isNotNull().alias("has_model"), "detected_at")


@query("weapon_rollup", f"""with {_EV}, b as (select f.*, concat('E', cast(e as string)) as evidence_id, (e % 8 = 3 and pos = 0) as doubled from f where e % 3 <> 0 and e % 19 <> 0)
    select evidence_id, cast(sum({_DET}) filter (where {_DET} > 0) as bigint) as found, count(*) as armed from b where {_DET} > 0 group by evidence_id""")
def _(d):
    rows = I.weapon_rollups(P.admit(_results(d), P.ADMISSION["evidence_result"]))
    found = F.aggregate(F.transform("armed", lambda f: F.size(f["detections"])), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("evidence_id", found.alias("found"), F.col("rollup.images_with_detections").alias("armed"))


@query("new_evidence_only", """
    with m as (select event_id, concat('E', cast(event_id % 4000 as string)) as evidence_id from events where event_type <> 'error'),
    l as (select *, row_number() over (partition by evidence_id order by event_id) as rn from m)
    select evidence_id, event_id from l where rn = 1 and evidence_id not in (select concat('E', cast(event_id % 4000 as string)) from events where event_type = 'error')""")
def _(d):
    rows = d["events"].select("event_id", "event_type", F.concat(F.lit("E"), (F.col("event_id") % 4000).cast("string")).alias("evidence_id"))
    return I.new_only(rows.where("event_type <> 'error'"), rows.where("event_type = 'error'"), "evidence_id", F.col("event_id")).select("evidence_id", "event_id")


@query("evidence_compute_errors", """
    with m as (select event_id, concat('E', cast(event_id % 3000 as string)) as evidence_id from events where event_type = 'error'),
    l as (select *, row_number() over (partition by evidence_id order by event_id) as rn from m)
    select evidence_id, 'unknown' as camera_id, 5 as status, concat('Compute error: e', cast(event_id as string)) as error_message from l
    where rn = 1 and evidence_id not in (select concat('E', cast(event_id as string)) from events where event_type = 'view')""")
def _(d):
    n = F.col("event_id")
    errors = d["events"].where("event_type <> 'view'").select(
        F.concat(F.lit("E"), (n % 3000).cast("string")).alias("entity_id"), F.when(F.col("event_type") == "error", "evidence").otherwise("search").alias("entity_type"),
        F.concat(F.lit("e"), n.cast("string")).alias("error"), F.concat(n.cast("string"), F.lit("-0")).alias("stream_id"))
    known = d["events"].where("event_type = 'view'").select(F.concat(F.lit("E"), n.cast("string")).alias("evidence_id"))
    return I.evidence_errors(errors, known, ts(NOW)).select("evidence_id", "camera_id", "status", "error_message")


# --- row rules -------------------------------------------------------------------------------
@query("constraint_checks", """
    select id, case when name = '' then 'name must have 1 to 255 characters' end as bad_name,
      case when match_threshold is not null and not match_threshold between 0 and 1 then 'match_threshold must be in 0..1' end as bad_threshold from v_entries""")
def _(d):
    checked = P.check_constraints(d["v_entries"], P.CONSTRAINTS["entry"])
    pick = lambda t: F.try_element_at(F.filter("violations", lambda v: v.startswith(t)), F.lit(1))
    return checked.select("id", pick("name").alias("bad_name"), pick("match").alias("bad_threshold"))


@query("supported_image_urls", """
    with u as (select page_id, case page_id % 5 when 0 then concat(url, '/a.JPG?x=1') when 1 then concat(url, '/b.gif') when 2 then concat('ftp', url, '.png')
      when 3 then concat(url, '/c.tar.webp') else url end as image_url from pages)
    select page_id from u where regexp_matches(image_url, '^https?://')
      and split_part(lower(list_last(string_split(image_url, '.'))), '?', 1) in ('jpg', 'jpeg', 'png', 'webp')""")
def _(d):
    n, u = F.col("page_id") % 5, F.col("url")
    url = (F.when(n == 0, F.concat(u, F.lit("/a.JPG?x=1"))).when(n == 1, F.concat(u, F.lit("/b.gif"))).when(n == 2, F.concat(F.lit("ftp"), u, F.lit(".png")))
           .when(n == 3, F.concat(u, F.lit("/c.tar.webp"))).otherwise(u))
    return P.supported_image_urls(d["pages"].select("page_id", url.alias("image_url"))).select("page_id")


# --- column functions ------------------------------------------------------------------------
@query("index_point_ids", """
    select o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
      || substr('89ab', cast(('0x' || substr(h, 17, 1))::int % 4 + 1 as int), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id
    from (select o_orderkey, sha1(unhex('19c871f8fb515d358584ec49ac00cbf3') || encode(concat('b-', cast(o_orderkey as string), '_', cast(o_orderkey % 7 as string)))) as h from orders) t""")
def _(d):
    n = F.col("o_orderkey")
    return d["orders"].select("o_orderkey", text.index_point_id(F.concat(F.lit("b-"), n.cast("string")), n % 7).alias("point_id"))


@query("name_hashes", "select c_custkey, substr(sha256(c_name), 1, 16) as name_hash from customer")
def _(d):
    return d["customer"].select("c_custkey", text.name_hash(F.col("c_name")).alias("name_hash"))


@query("entities_to_category", """
    with e as (select o_orderkey, o_orderkey % 9 as a, o_custkey % 9 as b from orders)
    select o_orderkey, case o_orderkey % 4 when 0 then null when 1 then null else '[' || case when a = b then cast(a as string) else cast(least(a, b) as string) || ',' || cast(greatest(a, b) as string) end || ']' end as text,
      case o_orderkey % 4 when 0 then null when 1 then null else case when a = b then cast(a as string) else cast(least(a, b) as string) || ',' || cast(greatest(a, b) as string) end end as ids,
      o_orderkey % 4 <> 1 as valid from e""")
def _(d):
    n = F.col("o_orderkey")
    a, b = (n % 9).cast("string"), (F.col("o_custkey") % 9).cast("string")
    entities = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, F.array(a, F.lit("x"))).otherwise(F.array(a, b, a))
    c = text.entities_to_category(entities)
    return d["orders"].select("o_orderkey", c["text"].alias("text"), joined(c["ids"]).alias("ids"), c["valid"].alias("valid"))


@query("entity_labels", f"select p_partkey, {_LABELS.replace('case id', 'case p_size')} from part")
def _(d):
    return d["part"].select("p_partkey", text.entity_label(F.col("p_size")).alias("label"))


@query("iso_times", """
    select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as with_micros, strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%SZ') as whole from events""")
def _(d):
    return d["events"].select("event_id", timing.iso_utc(F.col("ts")).alias("with_micros"), timing.iso_utc(F.date_trunc("minute", F.col("ts")), z=True).alias("whole"))


@query("stream_times", """
    select event_id, epoch_us(ts) // 1000 as from_id, cast(round(epoch_us(ts) / 1000.0) as bigint) as rounded_ms, cast(date_trunc('day', ts) as date) as day,
      ts < timestamp '2024-01-20 12:00:00' - interval '10' day as old from events""")
def _(d):
    t = F.col("ts")
    stream_id = F.concat(F.unix_millis(t.cast("timestamp")).cast("string"), F.lit("-3"))
    return d["events"].select("event_id", timing.stream_id_ms(stream_id).alias("from_id"), timing.epoch_ms(t).alias("rounded_ms"), F.to_date(timing.day_of(t)).alias("day"),
                              timing.older_than(t.cast("timestamp"), ts(NOW), days=10).alias("old"))


@query("alias_resolution", """
    select o_orderkey, case when o_orderkey % 3 = 0 then 'native' when o_orderkey % 3 = 1 then 'alias' end as used,
      case when o_orderkey % 2 = 0 then 'item' else 'image' end as item_id from orders""")
def _(d):
    n = F.col("o_orderkey")
    one = lambda s: F.array(F.lit(s))
    used = text.items_of(F.when(n % 3 == 0, one("native")), F.when(n % 3 != 2, one("alias")))
    item = F.struct(F.when(n % 2 == 0, F.lit("item")).alias("item_id"), F.lit("image").alias("image_id"))
    return d["orders"].select("o_orderkey", F.element_at(used, 1).alias("used"), text.item_id_of(item).alias("item_id"))


@query("uuid_normalisation", """
    select doc_id, case when doc_id % 6 < 5 then UUID[cast(doc_id as string)] end as id from documents""")
def _(d):
    n, md = F.col("doc_id") % 6, F.md5(F.col("doc_id").cast("string"))
    dashed = text._dashed(md)
    raw = (F.when(n == 0, dashed).when(n == 1, F.upper(md)).when(n == 2, F.concat(F.lit("{"), dashed, F.lit("}"))).when(n == 3, F.concat(F.lit("urn:uuid:"), dashed))
           .when(n == 4, md).otherwise(F.concat(md, F.lit("0"))))
    return d["documents"].select("doc_id", text.normalize_uuid(raw).alias("id"))


@query("error_texts", """
    select doc_id, md5(substr(text, 1, 500)) as shortened, md5(concat('Compute error: ', text)) as told from documents""")
def _(d):
    return d["documents"].select("doc_id", F.md5(text.truncate_error(F.col("text"))).alias("shortened"), F.md5(text.compute_error_text(F.col("text"))).alias("told"))


@query("json_extraction", """
    select event_id, case event_id % 4 when 0 then 'u1,u2' else '' end as urls, case event_id % 4 when 0 then concat('s', cast(event_id as string)) else '' end as summary from events""")
def _(d):
    n = F.col("event_id")
    body = (F.when(n % 4 == 0, F.concat(F.lit('{"crop_evidence_urls":["u1","u2"],"summary":"s'), n.cast("string"), F.lit('"}'))).when(n % 4 == 1, F.lit("{bad"))
            .when(n % 4 == 2, F.lit('{"other":1}')))
    return d["events"].select("event_id", joined(text.image_urls_of(body)).alias("urls"), text.summary_of(body).alias("summary"))


@query("frame_class_names", """
    select o_orderkey, case when o_orderkey % 3 = 0 then 'a,b' when o_orderkey % 3 = 1 then 'b' else '' end as classes from orders""")
def _(d):
    n = F.col("o_orderkey") % 3
    make = lambda *names: F.array(*[F.struct(F.lit(x).cast("string").alias("class_name")) for x in names])
    found = F.when(n == 0, make("b", "a", "b", None)).when(n == 1, make("b", "")).otherwise(make("", None))
    return d["orders"].select("o_orderkey", joined(text.frame_classes(found)).alias("classes"))


@query("threshold_and_fallbacks", """
    select c_custkey, case when c_custkey % 3 = 0 then 0.5 when c_custkey % 2 = 0 then round(c_acctbal, 2) else 0.85 end as threshold,
      case when c_custkey % 3 = 0 then concat('p', cast(c_custkey as string)) else c_mktsegment end as image_id,
      case when c_custkey % 3 <> 0 then c_mktsegment when c_custkey % 2 = 0 then c_name end as source_url,
      concat('embeddings/', cast(c_nationkey as string), '/', c_name) as folder from customer""")
def _(d):
    n = F.col("c_custkey")
    ref = F.when(n % 3 != 0, F.col("c_mktsegment")).otherwise(F.lit(""))
    return d["customer"].select(
        "c_custkey", text.effective_threshold(F.when(n % 3 == 0, 0.5), F.when(n % 2 == 0, F.col("c_acctbal"))).alias("threshold"),
        text.image_id(ref, F.concat(F.lit("p"), n.cast("string"))).alias("image_id"), text.source_url_of(ref, F.when(n % 2 == 0, F.col("c_name"))).alias("source_url"),
        text.storage_folder(F.col("c_nationkey").cast("string"), F.col("c_name")).alias("folder"))


@query("search_parameters", """
    select o_orderkey, case when o_orderkey % 3 = 0 then 0.6 else 0.75 end as threshold, case when o_orderkey % 3 = 1 then 7 else 50 end as max_results from orders""")
def _(d):
    n = F.col("o_orderkey") % 3
    p = text.search_params(F.when(n == 0, F.lit('{"threshold":0.6}')).when(n == 1, F.lit('{"max_results":7,"threshold":"x"}')))
    return d["orders"].select("o_orderkey", p["threshold"].alias("threshold"), p["max_results"].alias("max_results"))
