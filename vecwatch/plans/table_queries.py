"""Registered queries over request, batch and watch-list tables, and the feeds made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C, schemas
from ..functions import text, timing, vectors
from ..operators import batches as B, feeds, maintenance as M, predicates as P, reports as R, searches as S, watchlist as L
from ..sources import envelopes as E, tables
from ..streaming import jobs
from .domain import uuid_of
from .registry import joined, query, r6, ts, us

NOW = "2024-01-20 12:00:00"
_NOW_SQL = f"timestamp '{NOW}'"


# --- batches -----------------------------------------------------------------------
_LANDED = """landed as (select *, row_number() over (partition by batch_id, item_index order by seq desc) as rn from v_landings),
    r as (select * from landed where rn = 1)"""


@query("upsert_results_last_wins", f"with {_LANDED} select batch_id, item_index, item_ref, source_url, status from r")
def _(d):
    changes = d["v_landings"]
    target = changes.where("status = 'filtered'").drop("seq").dropDuplicates(["batch_id", "item_index"]).withColumn("status", F.lit("stale"))
    return tables.upsert(target, changes, ("batch_id", "item_index"), "seq").select("batch_id", "item_index", "item_ref", "source_url", "status")


_COUNTS = f"""with {_LANDED},
    c as (select batch_id, count(*) filter (where status = 'embedded') as embedded, count(*) filter (where status = 'filtered') as filtered,
            count(*) filter (where status in ('download_failed', 'decode_failed', 'no_result')) as failed from r group by batch_id),
    counts as (select b.id as batch_id, cast(b.submitted_count as bigint) as submitted, coalesce(embedded, 0) as embedded,
            coalesce(filtered, 0) as filtered, coalesce(failed, 0) as failed from v_batches b left join c on c.batch_id = b.id)"""


def _results(d):
    return tables.latest(d["v_landings"], ["batch_id", "item_index"], [F.col("seq").desc()])


@query("batch_counts", f"{_COUNTS} select * from counts")
def _(d):
    return B.batch_counts(_results(d), d["v_batches"])


@query("batch_terminal_status", f"""{_COUNTS} select batch_id, case when embedded + filtered + failed < submitted then null when failed = 0 then 'completed'
    else 'completed_with_errors' end as terminal_status from counts""")
def _(d):
    return B.terminal_status(B.batch_counts(_results(d), d["v_batches"])).select("batch_id", "terminal_status")


@query("batch_lifecycle_events", """
    select case when status = 'completed' then 'image_batch.completed' else 'image_batch.created' end as event_type, id as batch_id, status,
      submitted_count as submitted, user_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at from v_batches""")
def _(d):
    kind = F.when(F.col("status") == C.BATCH_COMPLETED, C.EVENT_BATCH_COMPLETED).otherwise(C.EVENT_BATCH_CREATED)
    events = B.lifecycle_events(d["v_batches"], kind)
    get = lambda p: F.get_json_object("payload", p)
    return events.select("event_type", get("$.batch_id").alias("batch_id"), get("$.status").alias("status"), get("$.counts.submitted").cast("int").alias("submitted"),
                         get("$.user_id").alias("user_id"), get("$.created_at").alias("created_at"))


@query("latest_run", """
    select user_id, external_id, id from (select *, row_number() over (partition by user_id, external_id order by created_at desc, id) as rn from v_batches) t where rn = 1""")
def _(d):
    return B.latest_run(d["v_batches"]).select("user_id", "external_id", "id")


@query("runs_of_external_id", """
    select user_id, external_id, id, cast(run as int) as run from (select *, row_number() over (partition by user_id, external_id order by created_at desc, id) as run
    from v_batches) t where run <= 200""")
def _(d):
    return B.runs(d["v_batches"]).select("user_id", "external_id", "id", "run")


@query("batch_items_page", """
    with r as (select *, row_number() over (partition by batch_id, item_index order by seq desc) as rn from v_landings)
    select item_index, item_ref, status from r where rn = 1 and batch_id = 'b-7' order by item_index limit 3 offset 1""")
def _(d):
    return B.batch_items(_results(d), "b-7", 3, 1).select("item_index", "item_ref", "status")


@query("batch_timeout", f"""
    select id, 'error' as status, 'compute timeout' as error_message from v_batches
    where status in ('pending', 'computing') and created_at < timestamp '1998-06-01 00:15:00' - interval '900' second""")
def _(d):
    return B.reap(d["v_batches"], ts("1998-06-01 00:15:00"))["batches"].select("id", "status", "error_message")


@query("lookup_by_id", "select 'batch' as kind, id, status from v_batches where id = 'b-11' union all select 'search', id, cast(status as string) from v_searches where search_id = 'search-7'")
def _(d):
    batches, searches = d["v_batches"], d["v_searches"]
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", F.col("status").cast("string").alias("status"))
    hits = one(B.lookup(batches, "id", "b-11"), "batch").unionByName(one(B.lookup(searches, "search_id", "search-7", search_type="evidence"), "search"))
    foreign = one(B.lookup(batches, "id", "b-11", "user-none"), "foreign batch")
    other_type = one(B.lookup(searches, "search_id", "search-7", search_type="image_index"), "other type")
    return hits.unionByName(foreign).unionByName(other_type)


def _submits(d):
    """Batch submits derived from orders: client refs repeat, some rules are broken."""
    o = d["orders"].withColumn("n", F.col("o_orderkey"))
    n = F.col("n")
    user = F.when(n % 17 == 0, F.lit("not-a-uuid")).when(n % 17 == 1, F.lit(" ")).otherwise(
        F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad((F.col("o_custkey") % 9).cast("string"), 12, "0")))
    client = F.when(n % 19 == 0, F.lit("  ")).otherwise(F.concat(F.lit("ref-"), F.floor(n / 3).cast("string")))
    url = F.when(n % 13 == 5, F.lit("ftp://x")).when(n % 13 == 6, F.lit(None)).otherwise(F.concat(F.lit(" HTTPS://img/"), n.cast("string")))
    item = F.struct(F.when(n % 2 == 0, F.concat(F.lit("it-"), n.cast("string"))).alias("item_id"),
                    F.when(n % 11 != 3, F.concat(F.lit("im-"), n.cast("string"))).alias("image_id"), url.alias("image_url"))
    good = F.struct(F.lit("first").alias("item_id"), F.lit(None).cast("string").alias("image_id"), F.lit("http://ok").alias("image_url"))
    size = (n % 5).cast("int")
    listed = F.when(size == 0, F.array().cast(schemas.SUBMIT["items"].dataType)).otherwise(F.concat(F.array(good), F.array_repeat(item, size)))
    return o.select(
        user.alias("user_id"), client.alias("client_batch_ref"), F.when(n % 23 == 0, F.lit("")).otherwise(F.lit("ext")).alias("external_id"),
        F.lit(None).cast("string").alias("source_ref"), F.lit(None).cast("string").alias("metadata"),
        F.when(n % 2 == 0, listed).alias("items"), F.when(n % 2 == 1, listed).alias("images"), n.alias("seq"))


_SUBMITS = """n as (select o_orderkey as n, o_custkey as c from orders),
    p as (select n as seq, n % 17 in (0, 1) as bad_user, n % 19 = 0 as bad_ref, concat('ref-', cast(cast(floor(n / 3) as bigint) as string)) as client_batch_ref,
        n % 23 = 0 as no_ext, n % 5 as size, (n % 2 = 1 and n % 11 = 3) as no_id, n % 13 in (5, 6) as bad_url from n),
    v as (select *, not bad_user and not bad_ref as bindable, case when no_ext then 'missing external_id' when size = 0 then 'batch has no items'
        when size + 1 > 4 then concat('batch exceeds N_CAP=4 (got ', cast(size + 1 as string), ')') when no_id then 'item 1 missing item_id/image_id'
        when bad_url then 'item 1 has invalid image_url' end as error from p)"""


@query("submit_validation", f"with {_SUBMITS} select seq, bindable, error, cast(case when size = 0 then 0 else size + 1 end as int) as n_items from v")
def _(d):
    return P.validate_submits(_submits(d), 4).select("seq", "bindable", "error", F.size("entries").alias("n_items"))


_SUBMIT_STATE = f"""with {_SUBMITS}, b as (select * from v where bindable),
    known as (select distinct client_batch_ref from v_batches),
    f as (select client_batch_ref, min(seq) as first_seq, min(case when error is not null then seq end) as first_error,
            max(case when error is not null then seq end) as last_error from b group by client_batch_ref)"""


@query("mint_batches", f"""{_SUBMIT_STATE} select b.seq, b.client_batch_ref,
    (b.seq = f.first_seq and b.client_batch_ref not in (select client_batch_ref from known where cast(substr(client_batch_ref, 5) as bigint) % 2 = 0)) as created
    from b join f using (client_batch_ref)""")
def _(d):
    held = d["v_batches"].where(F.substring("client_batch_ref", 5, 20).cast("bigint") % 2 == 0)
    bound = P.validate_submits(_submits(d), 4).where("bindable")
    return B.mint(held, bound, "client_batch_ref", "seq").select("seq", "client_batch_ref", "created")


def _held(d):
    return d["v_batches"].where(F.substring("client_batch_ref", 5, 20).cast("bigint") % 2 == 0)


@query("submit_batches_state", f"""{_SUBMIT_STATE}, held as (select * from v_batches where cast(substr(client_batch_ref, 5) as bigint) % 2 = 0)
    select f.client_batch_ref, case when f.last_error is not null then 'error' else 'computing' end as status, e.error as error_message,
      case when h.id is not null then h.submitted_count else case when s.size = 0 then 0 else s.size + 1 end end as submitted_count
    from f left join held h using (client_batch_ref) left join b e on e.seq = f.last_error join b s on s.seq = f.first_seq
    where h.id is null or f.last_error is not null""")
def _(d):
    out = B.submit_batches(_submits(d), _held(d), ts(NOW), n_cap=4)["batches"]
    return out.select("client_batch_ref", "status", "error_message", "submitted_count")


@query("submit_batches_events", f"""{_SUBMIT_STATE}, held as (select * from v_batches where cast(substr(client_batch_ref, 5) as bigint) % 2 = 0),
    t as (select b.client_batch_ref, case when b.error is not null then 'image_batch.failed' else 'image_batch.created' end as event_type,
        case when b.error is not null or coalesce(f.first_error < b.seq, false) then 'error' else coalesce(h.status, 'computing') end as status
      from b join f using (client_batch_ref) left join held h using (client_batch_ref))
    select client_batch_ref, event_type, status, count(*) as n from t group by 1, 2, 3""")
def _(d):
    events = B.submit_batches(_submits(d), _held(d), ts(NOW), n_cap=4)["lifecycle"]
    get = lambda p: F.get_json_object("payload", p)
    return events.select(get("$.client_batch_ref").alias("client_batch_ref"), "event_type", get("$.status").alias("status")).groupBy(
        "client_batch_ref", "event_type", "status").agg(F.count(F.lit(1)).alias("n"))


@query("submit_batches_dispatch", f"""{_SUBMIT_STATE}, held as (select * from v_batches where cast(substr(client_batch_ref, 5) as bigint) % 2 = 0)
    select b.client_batch_ref, cast(i as int) as item_index, case when i = 0 then 'first' when b.seq % 2 = 0 then concat('it-', cast(b.seq as string))
      else concat('im-', cast(b.seq as string)) end as item_id
    from b join f on f.first_seq = b.seq, range(0, 5) t(i) where b.error is null and i <= b.size and b.client_batch_ref not in (select client_batch_ref from held)""")
def _(d):
    held, submits = _held(d), _submits(d)
    out = B.submit_batches(submits, held, ts(NOW), n_cap=4)["dispatch"]
    names = submits.select("client_batch_ref").distinct().withColumn("batch_id", text.natural_id("batch", F.col("client_batch_ref")))
    return out.join(names, "batch_id").select("client_batch_ref", F.explode("items").alias("i")).select("client_batch_ref", "i.item_index", "i.item_id")


def _computed(d):
    """Computed messages: one per tenant, batch and part; the vectors travel as base64."""
    e = d["embeddings"].select("vec_id", "label", vectors.encode_vector("embedding").alias("b64"))
    n = F.col("vec_id")
    status = F.when(n % 7 == 1, "download_failed").when(n % 7 == 2, "filtered").when(n % 7 == 3, "no_result").otherwise("embedded")
    b64 = F.when(n % 97 == 5, F.lit("AAAA")).otherwise(F.col("b64"))
    item = F.struct(
        F.when(n % 2 == 0, F.concat(F.lit("it-"), n.cast("string"))).alias("item_id"), F.concat(F.lit("im-"), n.cast("string")).alias("image_id"),
        (F.floor(n / 4) % 10).cast("int").alias("item_index"), status.alias("status"), F.when(n % 3 == 0, F.lit("")).otherwise(F.lit("http://a")).alias("image_url"),
        F.lit("http://b").alias("source_url"), F.when(status == "embedded", b64).alias("vector_b64"), F.lit(C.VECTOR_ENCODING).alias("vector_encoding"),
        F.lit(64).alias("embedding_dim"), F.lit(None).cast("int").alias("duplicate_of_index"), F.lit(None).cast("string").alias("error_message"))
    name = F.concat(F.lit("lb-"), (n % 25).cast("string"))
    md = F.md5(name)
    part = lambda s, k: F.substring(md, s, k)
    uuid = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    return e.select(F.upper(uuid).alias("batch_id"), F.array(item).alias("results"), n.alias("seq"))


def _open_batches(d):
    known = _computed(d).select(F.lower("batch_id").alias("id")).distinct()
    none = lambda kind="string": F.lit(None).cast(kind)
    given = known.withColumn("n", F.conv(F.substring("id", 1, 4), 16, 10).cast("int"))
    return given.where(F.col("id") != uuid_of("lb-3")).select(
        "id", F.col("id").alias("client_batch_ref"), F.lit("ext").alias("external_id"), F.lit("user-1").alias("user_id"), F.lit(C.BATCH_COMPUTING).alias("status"),
        F.lit(10).alias("submitted_count"), *[F.lit(0).alias(f"{k}_count") for k in ("embedded", "filtered", "failed")], none().alias("source_ref"),
        none().alias("metadata"), none().alias("error_message"), ts(NOW).alias("created_at"), ts(NOW).alias("updated_at"), none("timestamp").alias("completed_at"))


_LAND = """with m as (select vec_id as seq, UUID[concat('lb-', cast(vec_id % 25 as string))] as batch_id, cast(floor(vec_id / 4) as bigint) % 10 as item_index,
      case vec_id % 7 when 1 then 'download_failed' when 2 then 'filtered' when 3 then 'no_result' else 'embedded' end as status,
      case when vec_id % 2 = 0 then concat('it-', cast(vec_id as string)) else concat('im-', cast(vec_id as string)) end as item_ref,
      case when vec_id % 3 = 0 then 'http://b' else 'http://a' end as source_url, embedding
    from embeddings where vec_id % 25 <> 3 and not (vec_id % 97 = 5 and vec_id % 7 not in (1, 2, 3))),
    r as (select * from (select *, row_number() over (partition by batch_id, item_index order by seq desc) as rn from m) t where rn = 1)"""


@query("land_results_rows", f"{_LAND} select batch_id, cast(item_index as int) as item_index, status, item_ref, source_url, status = 'embedded' as has_point from r")
def _(d):
    empty = d.spark.createDataFrame([], schemas.RESULTS)
    out = B.land_results(_computed(d), _open_batches(d), empty, ts(NOW), dim=64)["results"]
    return out.select("batch_id", "item_index", "status", "item_ref", "source_url", F.col("qdrant_point_id").isNotNull().alias("has_point"))


@query("land_results_batches", f"""{_LAND}, c as (select batch_id, count(*) filter (where status = 'embedded') as e, count(*) filter (where status = 'filtered') as f,
      count(*) filter (where status in ('download_failed', 'no_result')) as x from r group by 1)
    select batch_id as id, cast(e as int) as embedded_count, cast(f as int) as filtered_count, cast(x as int) as failed_count,
      case when e + f + x < 10 then 'computing' when x = 0 then 'completed' else 'completed_with_errors' end as status from c""")
def _(d):
    empty = d.spark.createDataFrame([], schemas.RESULTS)
    out = B.land_results(_computed(d), _open_batches(d), empty, ts(NOW), dim=64)["batches"]
    return out.select("id", "embedded_count", "filtered_count", "failed_count", "status")


@query("land_results_points", f"""with m as (select vec_id as seq, UUID[concat('lb-', cast(vec_id % 25 as string))] as batch_id,
      cast(floor(vec_id / 4) as bigint) % 10 as item_index, embedding from embeddings
      where vec_id % 25 <> 3 and vec_id % 7 not in (1, 2, 3) and vec_id % 97 <> 5),
    r as (select * from (select *, row_number() over (partition by batch_id, item_index order by seq desc) as rn from m) t where rn = 1)
    select batch_id, cast(item_index as int) as item_index, round(cast(embedding[1] as double), 6) as first_value, len(embedding) as dim from r""")
def _(d):
    empty = d.spark.createDataFrame([], schemas.RESULTS)
    out = B.land_results(_computed(d), _open_batches(d), empty, ts(NOW), dim=64)["points"]
    return out.select("batch_id", "item_index", r6(F.element_at("vector", 1).cast("double")).alias("first_value"), F.size("vector").alias("dim"))


@query("land_results_quarantine", """
    select vec_id as seq from embeddings where vec_id % 25 <> 3 and vec_id % 97 = 5 and vec_id % 7 not in (1, 2, 3)""")
def _(d):
    empty = d.spark.createDataFrame([], schemas.RESULTS)
    return B.land_results(_computed(d), _open_batches(d), empty, ts(NOW), dim=64)["quarantined"].select("seq")


@query("known_batches_only", """
    select vec_id % 25 <> 3 as known, count(*) as n from embeddings group by 1""")
def _(d):
    held = _open_batches(d).select("id", F.lit(True).alias("known"))
    named = _computed(d).select(text.normalize_uuid("batch_id").alias("id"))
    return named.join(held, "id", "left").groupBy(F.col("known").isNotNull().alias("known")).agg(F.count(F.lit(1)).alias("n"))


@query("batch_compute_errors", """
    with e as (select UUID[concat('lb-', cast(event_id % 40 as string))] as id, event_id, concat('err ', cast(event_id as string)) as m from events where event_type = 'error'),
    l as (select *, row_number() over (partition by id order by event_id desc) as rn from e)
    select id, m as error_message, 'error' as status from l where rn = 1
      and id in (select UUID[concat('lb-', cast(vec_id % 25 as string))] from embeddings where vec_id % 25 <> 3)""")
def _(d):
    md = F.md5(F.concat(F.lit("lb-"), (F.col("event_id") % 40).cast("string")))
    errors = d["events"].where("event_type = 'error'").select(md.alias("batch_id"), F.concat(F.lit("err "), F.col("event_id").cast("string")).alias("error_message"),
                                                             F.col("event_id").alias("seq"))
    return B.fail_batches(errors, _open_batches(d), ts(NOW))["batches"].select("id", "error_message", "status")


# --- searches ----------------------------------------------------------------------
@query("search_outcome", """
    select s.id as search_request_id, count(m.id) as total_matches, case when count(m.id) > 0 then 2 else 1 end as similarity_status
    from v_searches s left join v_matches m on m.search_request_id = s.id group by s.id""")
def _(d):
    return S.search_outcome(d["v_searches"], d["v_matches"])


@query("searches_with_matches", """
    select s.search_id, m.id as match_id, round(m.similarity_score, 6) as similarity_score
    from v_searches s left join v_matches m on m.search_request_id = s.id where s.user_id = 'user-7' and s.search_type = 'evidence'""")
def _(d):
    return S.searches_with_matches(d["v_searches"], d["v_matches"], "user-7", "evidence").select("search_id", "match_id", r6("similarity_score").alias("similarity_score"))


@query("matches_page", "select id, round(similarity_score, 6) as similarity_score from v_matches order by v_matches.similarity_score desc, id limit 20 offset 40")
def _(d):
    return S.matches_page(d["v_matches"], None, 20, 40).select("id", r6("similarity_score").alias("similarity_score"))


@query("user_searches_page", "select id, epoch_us(created_at) as created_us from v_searches where user_id = 'user-12' order by created_at desc, id limit 10 offset 5")
def _(d):
    return S.user_searches(d["v_searches"], "user-12", 10, 5).select("id", us("created_at").alias("created_us"))


@query("pending_requests", "select id from v_requests where status = 1 and retry_count < 3 order by created_at, id limit 50")
def _(d):
    return S.pending(d["v_requests"], 50).select("id")


@query("recalculation_candidates", """
    (select id from v_searches where search_type = 'evidence' and status = 3 and similarity_status = 2
      and processing_completed_at < timestamp '1999-01-01 00:00:00' - interval '2' hour order by processing_completed_at, id limit 20)
    union all (select id from v_searches where search_type = 'image_index' and status = 3 and similarity_status = 2
      and processing_completed_at < timestamp '1999-01-01 00:00:00' - interval '2' hour order by processing_completed_at, id limit 20)""")
def _(d):
    parts = [S.recalc_candidates(d["v_searches"], t, ts("1999-01-01")) for t in ("evidence", "image_index")]
    return parts[0].unionByName(parts[1]).select("id")


@query("replace_matches", """
    select search_request_id, count(*) as n from v_matches where search_request_id not in (select id from v_searches where status = 3) group by 1
    union all select s.id, 1 from v_searches s where s.status = 3 and s.similarity_status = 2""")
def _(d):
    old, done = d["v_matches"], d["v_searches"].where("status = 3")
    new = done.where("similarity_status = 2").select(
        F.concat(F.lit("new-"), "id").alias("id"), F.col("id").alias("search_request_id"), F.lit("E").alias("evidence_id"), F.lit("c").alias("camera_id"),
        F.lit(0.9).alias("similarity_score"), F.lit("u").alias("image_url"), F.lit("{}").alias("match_metadata"), F.lit(None).cast("string").alias("external_id"))
    return S.replace_matches(old, new, done).groupBy("search_request_id").agg(F.count(F.lit(1)).alias("n"))


@query("match_projection", """
    select evidence_id, external_id, case when external_id is not null then concat('b-', cast(cast(substr(search_request_id, 3) as bigint) as string)) end as batch_id,
      case when external_id is not null then cast(split_part(id, '-', 3) as int) end as item_index, round(similarity_score, 6) as similarity_score from v_matches""")
def _(d):
    return P.project_matches(d["v_matches"]).select("evidence_id", "external_id", "batch_id", "item_index", r6("similarity_score").alias("similarity_score"))


@query("search_intake", """
    with m as (select event_id, concat('search-', cast(event_id % 3000 as string)) as search_id, event_type, user_id from events where event_id % 13 <> 0),
    f as (select *, row_number() over (partition by search_id order by event_id) as rn from m)
    select search_id, concat('user-', cast(user_id as string)) as user_id, case when event_type = 'view' then 2 else 1 end as status,
      case when event_type = 'view' then 'image_index' else 'evidence' end as search_type, case when event_type = 'view' then 'ext-1,ext-2' end as external_ids,
      event_type = 'view' as started from f where rn = 1 and search_id not in (select search_id from v_searches where status = 3)""")
def _(d):
    n = F.col("event_id")
    messages = d["events"].select(
        F.concat(F.lit("search-"), (n % 3000).cast("string")).alias("search_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user_id"),
        F.when(n % 13 == 0, F.lit("")).otherwise(F.lit("http://q")).alias("image_url"), F.lit(None).cast("double").alias("threshold"),
        F.lit(None).cast("int").alias("max_results"),
        F.when(F.col("event_type") == "view", F.lit('{"search_type":"image_index","external_ids":["ext-1","ext-2"]}')).alias("metadata"),
        F.concat(n.cast("string"), F.lit("-0")).alias("stream_id"))
    out = S.intake_searches(messages, d["v_searches"].where("status = 3"), ts(NOW))
    return out.select("search_id", "user_id", "status", "search_type", joined("external_ids").alias("external_ids"),
                      F.col("processing_started_at").isNotNull().alias("started"))


def _asked(d):
    """Computed query vectors for the first searches by number: every stored vector asks once."""
    n = F.col("vec_id")
    indexed = n % 4 == 0
    meta = F.when(indexed, F.concat(F.lit('{"search_type":"image_index","user_id":"user-'), (F.col("label") % 3).cast("string"), F.lit('","external_ids":["ext-1","ext-2"]}'))).otherwise(
        F.concat(F.lit('{"camera_id":"cam-'), (n % 7).cast("string"), F.lit('"}')))
    vector = F.when((n % 12).isin(0, 1), F.transform("embedding", lambda x: x * F.lit(0).cast("float"))).otherwise(F.col("embedding"))
    return d["embeddings"].select(
        F.concat(F.lit("search-"), n.cast("string")).alias("search_id"), F.concat(F.lit("user-"), (F.col("label") % 3).cast("string")).alias("user_id"),
        vector.alias("vector"), F.lit(0.1).alias("threshold"), F.lit(6).alias("max_results"), F.lit("search").alias("purpose"),
        F.lit(None).cast("string").alias("blacklist_entry_id"), meta.alias("metadata"), F.concat(n.cast("string"), F.lit("-1")).alias("stream_id"))


_LAND_SEARCH = """with q as (select vec_id, concat('search-', cast(vec_id as string)) as search_id, concat('user-', cast(label % 3 as string)) as user_id,
      embedding as vector from embeddings),
    s as (select q.search_id, p.point_id, list_cosine_similarity(cast(q.vector as double[]), cast(p.vector as double[])) as score
          from q join v_evidence p on p.user_id = q.user_id and p.camera_id = concat('cam-', cast(vec_id % 7 as string)) where vec_id % 4 <> 0 and vec_id % 12 <> 1
          union all
          select q.search_id, x.point_id, list_cosine_similarity(cast(q.vector as double[]), cast(x.vector as double[]))
          from q join v_index x on x.user_id = q.user_id and x.external_id in ('ext-1', 'ext-2') where vec_id % 4 = 0 and vec_id % 12 <> 0),
    k as (select *, row_number() over (partition by search_id order by score desc, point_id) as rn from s where score >= 0.1)"""


@query("land_searches_matches", f"{_LAND_SEARCH} select search_id, point_id, round(score, 6) as similarity_score from k where rn <= 6")
def _(d):
    searches = d["v_searches"]
    out = S.land_searches(_asked(d), searches, d["v_evidence"].unionByName(d["v_watch"]), d["v_index"], ts(NOW))
    found = out["matches"].select(F.col("search_request_id").alias("id"), F.get_json_object("match_metadata", "$.qdrant_point_id").alias("point_id"),
                                  r6("similarity_score").alias("similarity_score"))
    return found.join(out["searches"].select("id", "search_id"), "id").drop("id")


@query("land_searches_requests", f"""{_LAND_SEARCH}, c as (select search_id, count(*) as n from k where rn <= 6 group by 1)
    select q.search_id, coalesce(c.n, 0) as total_matches, case when vec_id % 12 = 0 then 4 else 3 end as status,
      case when c.n > 0 then 2 else 1 end as similarity_status, vec_id % 12 <> 0 as has_vector from q left join c using (search_id)""")
def _(d):
    out = S.land_searches(_asked(d), d["v_searches"], d["v_evidence"].unionByName(d["v_watch"]), d["v_index"], ts(NOW))["searches"]
    return out.select("search_id", "total_matches", "status", "similarity_status",
                      ((F.col("status") == 3) & F.col("qdrant_query_point_id").isNotNull()).alias("has_vector"))


@query("recalculate_searches", """
    with c as (select * from v_searches where status = 3 and similarity_status = 2 and processing_completed_at < timestamp '2030-01-01 00:00:00' - interval '2' hour),
    r as (select c.*, cast(substr(c.id, 3) as bigint) as n, e.embedding as vector from c join embeddings e on c.qdrant_query_point_id = concat('q-', cast(e.vec_id as string))),
    s as (select r.id, p.point_id, list_cosine_similarity(cast(r.vector as double[]), cast(p.vector as double[])) as score, r.threshold
          from r join v_evidence p on p.user_id = concat('user-', cast(r.n % 3 as string)) and p.camera_id = concat('cam-', cast(r.n % 7 as string)) where r.search_type = 'evidence'
          union all
          select r.id, x.point_id, list_cosine_similarity(cast(r.vector as double[]), cast(x.vector as double[])), r.threshold
          from r join v_index x on x.user_id = concat('user-', cast(r.n % 3 as string)) and x.external_id in ('ext-1', 'ext-2') where r.search_type = 'image_index'),
    k as (select *, row_number() over (partition by id order by score desc, point_id) as rn from s where score >= 0.15),
    t as (select id, count(*) as n from k where rn <= 20 group by id)
    select r.id, coalesce(t.n, 0) as total_matches, case when t.n > 0 then 2 else 1 end as similarity_status from r left join t using (id)""")
def _(d):
    number = F.substring("id", 3, 20).cast("bigint")
    searches = d["v_searches"].withColumn("user_id", F.concat(F.lit("user-"), (number % 3).cast("string"))).withColumn("threshold", F.lit(0.15))
    stored = d["embeddings"].select(F.concat(F.lit("q-"), F.col("vec_id").cast("string")).alias("point_id"), F.col("embedding").alias("vector"))
    out = S.recalculate(searches, stored, d["v_evidence"].unionByName(d["v_watch"]), d["v_index"], d["v_matches"], ts("2030-01-01"), limit=None)
    return out["searches"].select("id", "total_matches", "similarity_status")


@query("route_compute_errors", """
    with e as (select event_id, case when event_id % 3 = 0 then UUID[concat('ref-', cast(event_id % 700 as string))] else concat('search-', cast(event_id % 4000 as string)) end as id
               from events where event_type in ('error', 'view')),
    l as (select *, row_number() over (partition by id order by event_id desc) as rn from e)
    select case when r.id is not null then 'reference' else 'search' end as kind, l.id, 4 as status, concat('Compute error: e', cast(event_id as string)) as error_message
    from l left join v_wl_refs r on r.id = l.id where rn = 1""")
def _(d):
    n = F.col("event_id")
    md = F.md5(F.concat(F.lit("ref-"), (n % 700).cast("string")))
    ref = F.concat_ws("-", *[F.substring(md, s, k) for s, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    errors = d["events"].select(
        F.when(n % 3 == 0, ref).otherwise(F.concat(F.lit("search-"), (n % 4000).cast("string"))).alias("entity_id"),
        F.when(F.col("event_type").isin("error", "view"), "search").otherwise("evidence").alias("entity_type"), F.concat(F.lit("e"), n.cast("string")).alias("error"),
        F.concat(n.cast("string"), F.lit("-0")).alias("stream_id"))
    refs = d["v_wl_refs"].withColumn("error_message", F.lit(None).cast("string")).withColumn("updated_at", F.col("created_at"))
    out = S.route_errors(errors, refs, d["v_searches"], ts(NOW))
    one = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "status", "error_message")
    return one(out["references"], "reference", "id").unionByName(one(out["searches"], "search", "search_id"))


# --- maintenance -----------------------------------------------------------------------
_STALE = f"""select 'request' as kind, id, cast(retry_count + 1 as int) as retry_count, case when retry_count + 1 >= 3 then 5 else 1 end as status,
      case when retry_count + 1 >= 3 then worker_id end as worker_id from v_requests where status = 2 and processing_started_at < {_NOW_SQL} - interval '10' minute
    union all select 'search', id, cast(retry_count + 1 as int), case when retry_count + 1 >= 3 then 4 else 1 end, case when retry_count + 1 >= 3 then worker_id end
      from v_searches where status = 2 and search_type = 'evidence' and processing_started_at < {_NOW_SQL} - interval '10' minute
    union all select 'search', id, retry_count, 4, worker_id from v_searches
      where status = 2 and search_type = 'image_index' and processing_started_at < {_NOW_SQL} - interval '900' second"""


@query("stale_recovery", _STALE)
def _(d):
    out = M.recover_stale(d["v_requests"], d["v_searches"], ts(NOW))
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "retry_count", "status", "worker_id")
    return one(out["requests"], "request").unionByName(one(out["searches"], "search"))


@query("retention", """
    select 'request' as kind, count(*) as n from v_requests where not (status in (4, 5) and created_at < timestamp '2024-02-12 00:00:00' - interval '30' day)
    union all select 'search', count(*) from v_searches where not (status in (3, 4) and created_at < timestamp '1998-01-01 00:00:00' - interval '30' day)""")
def _(d):
    one = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return one(M.retain(d["v_requests"], d["v_searches"], ts("2024-02-12"))["requests"], "request").unionByName(
        one(M.retain(d["v_requests"], d["v_searches"], ts("1998-01-01"))["searches"], "search"))


# --- watch-list rows ------------------------------------------------------------------------
@query("entries_filter", """
    select 'active' as which, count(*) as n from v_entries where active and user_id = 'user-3'
    union all select 'inactive_building', count(*) from v_entries where not active and category = 'BUILDING' union all select 'both', count(*) from v_entries""")
def _(d):
    e = d["v_entries"]
    one = lambda df, kind: df.agg(F.lit(kind).alias("which"), F.count(F.lit(1)).alias("n"))
    return one(P.entries_filter(e, "user-3"), "active").unionByName(one(P.entries_filter(e, None, False, "BUILDING"), "inactive_building")).unionByName(
        one(P.entries_filter(e, active=None), "both"))


@query("counts_by_entry", """
    select 'references' as kind, entry_id, count(*) as n from v_refs where entry_id in (select id from v_entries where active) group by entry_id
    union all select 'embeddings', entry_id, count(*) from v_embs where entry_id in (select id from v_entries where active) group by entry_id""")
def _(d):
    ids = d["v_entries"].where("active")
    one = lambda rows, kind: R.counts_by_entry(rows, ids).withColumn("kind", F.lit(kind))
    return one(d["v_refs"], "references").unionByName(one(d["v_embs"], "embeddings"))


@query("entries_page", """
    with page as (select * from v_entries where active order by created_at desc, id limit 25 offset 10)
    select p.id, (select count(*) from v_refs r where r.entry_id = p.id) as references_count, (select count(*) from v_embs m where m.entry_id = p.id) as embeddings_count
    from page p""")
def _(d):
    return R.entries_page(d["v_entries"], d["v_refs"], d["v_embs"], 25, 10).select("id", "references_count", "embeddings_count")


@query("active_entries", "select id, epoch_us(created_at) as created_us from v_entries where active and status = 3")
def _(d):
    return R.active_entries(d["v_entries"]).select("id", us("created_at").alias("created_us"))


@query("children_by_entry", """
    select id, entry_id, cast(row_number() over (partition by entry_id order by created_at, id) as int) as place from v_refs""")
def _(d):
    ordered = R.children_by_entry(d["v_refs"])
    return ordered.withColumn("place", F.row_number().over(R.W.partitionBy("entry_id").orderBy("created_at", "id"))).select("id", "entry_id", "place")


@query("totals", """
    select 'entries' as kind, count(*) as total from v_entries union all select 'searches', count(*) from v_searches where user_id = 'user-5'
    union all select 'matches', count(*) from v_matches""")
def _(d):
    one = lambda df, kind: R.total(df).withColumn("kind", F.lit(kind))
    return one(d["v_entries"], "entries").unionByName(one(d["v_searches"].where("user_id = 'user-5'"), "searches")).unionByName(one(d["v_matches"], "matches"))


BUMPS_SQL = """
    with p as (select entry_id, seq, patch, json_extract(patch, '$.match_threshold') is not null as has_t, cast(nullif(json_extract_string(patch, '$.match_threshold'), 'null') as double) as t,
        cast(json_extract_string(patch, '$.active') as boolean) as a from v_patches),
    j as (select p.*, e.match_threshold as t0, e.active as a0, e.blacklist_version as v0,
        last_value(case when has_t then struct_pack(v := t) end ignore nulls) over (partition by p.entry_id order by seq rows between unbounded preceding and 1 preceding) as pt,
        last_value(a ignore nulls) over (partition by p.entry_id order by seq rows between unbounded preceding and 1 preceding) as pa
      from p join v_entries e on e.id = p.entry_id),
    b as (select *, (has_t and t is distinct from (case when pt is null then t0 else pt.v end)) or (coalesce(a, false) and not coalesce(pa, a0)) as bump from j),
    f as (select entry_id, count(*) filter (where bump) as bumps, arg_max(a, seq) filter (where a is not null) as last_a,
        arg_max(struct_pack(v := t), seq) filter (where has_t) as last_t, arg_max(json_extract_string(patch, '$.name'), seq) filter (where json_extract_string(patch, '$.name') is not null) as last_n,
        arg_max(struct_pack(v := nullif(json_extract_string(patch, '$.category'), 'null')), seq) filter (where json_extract(patch, '$.category') is not null) as last_c from b group by entry_id)
    select e.id, cast(e.blacklist_version + coalesce(bumps, 0) as int) as blacklist_version, coalesce(last_a, active) as active,
      round(case when last_t is null then match_threshold else last_t.v end, 6) as match_threshold, coalesce(last_n, name) as name,
      case when last_c is null then category else last_c.v end as category from v_entries e left join f on f.entry_id = e.id"""


@query("version_bumps", BUMPS_SQL)
def _(d):
    out = L.apply_patches(d["v_entries"], d["v_patches"], ts(NOW), bucket_size=500)
    return out.select("id", "blacklist_version", "active", r6("match_threshold").alias("match_threshold"), "name", "category")


# --- feeds ------------------------------------------------------------------------------------
def _get(*names):
    return [F.get_json_object("payload", f"$.{n}").alias(n) for n in names]


@query("search_request_feed", """
    select case status when 3 then 'image_search.completed' when 4 then 'image_search.failed' else 'image_search.created' end as event_type, id, search_id,
      cast(status as string) as status, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at, 20 as keys from v_searches where search_type <> 'image_index'""")
def _(d):
    events = feeds.search_request_events(d["v_searches"])
    return events.select("event_type", *_get("id", "search_id", "status", "created_at"), F.size(F.json_object_keys("payload")).alias("keys"))


@query("search_match_feed", """
    select s.id as search_request_id, s.user_id, m.evidence_id, round(m.similarity_score, 6) as similarity_score
    from v_searches s join v_matches m on m.search_request_id = s.id where s.status = 3 and s.search_type <> 'image_index'""")
def _(d):
    events = feeds.search_match_events(d["v_searches"], d["v_matches"], ts(NOW))
    return feeds.explode_match_events(events).select("search_request_id", "user_id", "evidence_id", r6("similarity_score").alias("similarity_score"))


@query("entry_feed", """
    select 'blacklist_image_entry.upserted' as event_type, id, case when name = '' then '' else substr(sha256(name), 1, 16) end as name_hash,
      cast(blacklist_version as string) as blacklist_version, false as leaks_name, 12 as keys from v_entries""")
def _(d):
    events = feeds.entry_events(d["v_entries"])
    return events.select("event_type", *_get("id", "name_hash", "blacklist_version"), F.contains("payload", F.lit("Customer#")).alias("leaks_name"),
                         F.size(F.json_object_keys("payload")).alias("keys"))


@query("reference_feeds", """
    select 'blacklist_image_reference.upserted' as event_type, id, entry_id, error_message, 10 as keys from v_refs
    union all select 'blacklist_image_embedding.created', id, entry_id, null, 7 from v_embs""")
def _(d):
    one = lambda e: e.select("event_type", *_get("id", "entry_id", "error_message"), F.size(F.json_object_keys("payload")).alias("keys"))
    return one(feeds.reference_events(d["v_refs"])).unionByName(one(feeds.reference_embedding_events(d["v_embs"])))


@query("embedding_request_feed", """
    select concat('image_embedding_request.', k) as event_type, id, evidence_id, 24 as keys from v_requests, (values ('created'), ('completed')) t(k) where status = 3
    union all select 'image_embedding_request.failed', id, evidence_id, 24 from v_requests where status = 5""")
def _(d):
    events = feeds.embedding_request_events(d["v_requests"])
    return events.select("event_type", *_get("id", "evidence_id"), F.size(F.json_object_keys("payload")).alias("keys"))


def _landing_events(d):
    """Feed rows with planted repeats."""
    n = F.col("event_id")
    return d["events"].select(
        (F.floor(n / 4)).cast("string").alias("id"), (n % 2).cast("int").alias("status"), F.when(n % 6 == 0, F.lit(None)).otherwise((n % 3).cast("string")).alias("updated_at"),
        n.alias("event_id"))


@query("warehouse_landing", """
    with e as (select cast(cast(floor(event_id / 4) as bigint) as string) as id, cast(event_id % 2 as int) as status, case when event_id % 6 = 0 then null else cast(event_id % 3 as string) end as updated_at,
        event_id, event_type from events),
    f as (select *, row_number() over (partition by id, status, updated_at order by event_id) as rn from e)
    select id, status, updated_at, event_id from f where rn = 1 and not exists (select 1 from e t where t.event_type = 'view' and t.id = f.id and t.status = f.status
      and t.updated_at is not distinct from f.updated_at)""")
def _(d):
    rows = _landing_events(d)
    seen = rows.join(d["events"].where("event_type = 'view'").select("event_id"), "event_id", "left_semi")
    return feeds.land_events(rows, seen, C.FEED_KEYS["image_embedding_request"], "event_id").select("id", "status", "updated_at", "event_id")


@query("alert_deduplication", """
    select concat('E', cast(user_id as string)) as evidence_id, concat('entry-', cast(event_id % 20 as string)) as blacklist_entry_id, event_id % 3 as blacklist_entry_version
    from events group by 1, 2, 3""")
def _(d):
    n = F.col("event_id")
    alerts = d["events"].select(F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("evidence_id"),
                                F.concat(F.lit("entry-"), (n % 20).cast("string")).alias("blacklist_entry_id"), (n % 3).alias("blacklist_entry_version"))
    return feeds.dedup_alerts(alerts)


@query("table_round_trip", """
    select id, cast(blacklist_version + case when blacklist_version > 2 then 10 else 0 end as int) as blacklist_version, name from v_entries""")
def _(d):
    root = tables.scratch_root(d.spark)
    entries = d["v_entries"]
    tables.write_table(entries, root, "entries", 0)
    bumped = entries.where("blacklist_version > 2").withColumns({"blacklist_version": F.col("blacklist_version") + 10, "updated_at": F.col("updated_at") + F.expr("interval 1 day")})
    tables.write_table(bumped, root, "entries", 1)
    return tables.read_table(d.spark, root, "entries").select("id", "blacklist_version", "name")


@query("index_job_replayed", f"""{_LAND}, c as (select batch_id, count(*) filter (where status = 'embedded') as e, count(*) filter (where status = 'filtered') as f,
      count(*) filter (where status in ('download_failed', 'no_result')) as x from r group by 1)
    select batch_id as id, cast(e as int) as embedded_count, cast(f as int) as filtered_count, cast(x as int) as failed_count,
      (select count(distinct item_index) from m where m.batch_id = c.batch_id and status = 'embedded') as points,
      case when e + f + x < 10 then 'computing' when x = 0 then 'completed' else 'completed_with_errors' end as status from c""")
def _(d):
    ws = jobs.Workspace(d.spark, tables.scratch_root(d.spark), lambda: ts(NOW), dim=64)
    ws.table("batches").write(_open_batches(d), 0)
    messages = E.to_envelope(_computed(d).select("batch_id", "results"), C.EVENT_INDEX_COMPUTED)
    order = _computed(d).select("batch_id", "seq", F.col("results")[0]["image_id"].alias("image_id"))
    image = F.get_json_object("payload", "$.results[0].image_id")
    # a row of either side has vectors behind it, so none is sent to all tasks by way of the driver
    stream = messages.withColumn("image_id", image).hint("shuffle_merge").join(order, "image_id").select("event_type", "payload", F.concat(F.col("seq").cast("string"), F.lit("-0")).alias("stream_id"))
    for _ in range(2):
        jobs.apply_index(ws, stream, 1)
    points = ws.table("index_points").live().groupBy(F.col("batch_id").alias("id")).agg(F.count(F.lit(1)).alias("points"))
    return ws.table("batches").current().join(points, "id").select("id", "embedded_count", "filtered_count", "failed_count", "points", "status")


# --- envelopes -----------------------------------------------------------------------------------
_KNOWN = (C.EVENT_EMBEDDINGS, C.EVENT_SEARCH_VECTOR, C.EVENT_COMPUTE_ERROR)


@query("envelope_source", """
    select case when payload is null or payload like '{broken%' then null else json_extract_string(payload, '$.evidence_id') end as evidence_id,
      case when payload is null or payload like '{broken%' then null else cast(json_extract_string(payload, '$.app_id') as int) end as app_id, stream_id,
      coalesce(payload not like '{broken%', true) as readable
    from v_messages where event_type = 'embeddings.computed'""")
def _(d):
    parsed = E.parse(d["v_messages"], C.EVENT_EMBEDDINGS, schemas.EVIDENCE_RESULT)
    return parsed.select("p.evidence_id", "p.app_id", "stream_id", F.col("p").isNotNull().alias("readable"))


@query("unroutable_events", """
    select coalesce(event_type, 'unknown') as event_type, count(*) as dropped from v_messages
    where event_type is null or event_type not in ('embeddings.computed', 'search.vector.computed', 'compute.error') group by 1""")
def _(d):
    return E.unroutable_counts(d["v_messages"], _KNOWN)


@query("quarantined_messages", f"""
    select event_type, payload, 'embeddings:results' as original_stream, stream_id as original_message_id, cast(cast(epoch({_NOW_SQL}) as bigint) as string) as dead_lettered_at
    from v_messages where event_type = 'embeddings.computed' and payload like '{{broken%'""")
def _(d):
    parsed = E.parse(d["v_messages"], C.EVENT_EMBEDDINGS, schemas.EVIDENCE_RESULT)
    return E.quarantine(parsed, F.col("p").isNull(), "embeddings:results", ts(NOW))[1]


@query("envelope_sink", """
    select 'made' as event_type, id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at, error_message is null as null_kept, 10 as keys from v_refs""")
def _(d):
    events = E.to_envelope(d["v_refs"], "made")
    return events.select("event_type", *_get("id", "created_at"), (F.get_json_object("payload", "$.error_message").isNull()
                         & F.array_contains(F.json_object_keys("payload"), "error_message")).alias("null_kept"), F.size(F.json_object_keys("payload")).alias("keys"))


@query("admission_counts", """
    select count(*) filter (where payload is not null and payload not like '{broken%' and cast(split_part(stream_id, '-', 1) as bigint) % 2 = 0) as admitted,
      count(*) filter (where not (payload is not null and payload not like '{broken%' and cast(split_part(stream_id, '-', 1) as bigint) % 2 = 0)) as rejected
    from v_messages where event_type = 'embeddings.computed'""")
def _(d):
    parsed = E.parse(d["v_messages"], C.EVENT_EMBEDDINGS, schemas.EVIDENCE_RESULT)
    urls = F.when(timing.stream_id_ms(F.col("stream_id")) % 2 == 0, F.array(F.lit("u"))).otherwise(F.array().cast("array<string>"))
    return P.admission_counts(parsed.select("p.evidence_id", urls.alias("image_urls")), P.ADMISSION["evidence_created"])
