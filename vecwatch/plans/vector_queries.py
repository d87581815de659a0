"""Registered queries over the vector tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import text, vectors
from ..operators import cells, diversity, hashed_pairs, predicates as P, searches, similarity as S, watchlist as L
from ..sources import points as stored_points, tables
from .domain import uuid_of
from .registry import query, r6, ts

COS = "list_cosine_similarity(cast({a}.vector as double[]), cast({b}.vector as double[]))"
_T = 0.2


def _as_queries(df, *scope):
    return df.select(F.col("point_id").alias("query_id"), "vector", *[F.col(s).alias(f"q_{s}") for s in scope])


@query("cosine_topk_join", f"""
    with s as (select q.point_id as query_id, p.point_id, {COS.format(a='q', b='p')} as score
               from v_watch q, v_evidence p where p.has_weapon),
    k as (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from s where score >= {_T})
    select query_id, point_id, cast(rank as int) as rank, round(score, 6) as score from k where rank <= 10""")
def _(d):
    found = S.similarity_search(_as_queries(d["v_watch"]), d["v_evidence"], 10, _T, F.col("has_weapon"))
    return found.select("query_id", "point_id", "rank", r6("score").alias("score"))


@query("cosine_topk_join_tiled", f"""
    with s as (select q.point_id as query_id, p.point_id, {COS.format(a='q', b='p')} as score
               from v_watch q, v_evidence p where q.user_id = p.user_id),
    k as (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from s where score >= {_T})
    select query_id, point_id, cast(rank as int) as rank, round(score, 6) as score from k where rank <= 5""")
def _(d):
    found = S.similarity_search(_as_queries(d["v_watch"], "user_id"), d["v_evidence"], 5, _T, scope=("user_id",),
                                broadcast_queries=0, tile_rows=128)
    return found.select("query_id", "point_id", "rank", r6("score").alias("score"))


@query("neighbour_lists", f"""
    with s as (select q.point_id as query_id, p.point_id, {COS.format(a='q', b='p')} as score from v_watch q, v_evidence p),
    k as (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from s)
    select query_id, point_id, cast(rank as int) as rank, round(score, 6) as score from k where rank <= 8""")
def _(d):
    return S.neighbours(_as_queries(d["v_watch"]), d["v_evidence"], 8).select("query_id", "point_id", "rank", r6("score").alias("score"))


@query("index_search_scoped", f"""
    with s as (select q.point_id as query_id, p.point_id, p.external_id, {COS.format(a='q', b='p')} as score
               from v_evidence q join v_index p on q.user_id = p.user_id and p.external_id in ('ext-1', 'ext-3')),
    k as (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from s where score >= 0.15)
    select query_id, point_id, external_id, cast(rank as int) as rank, round(score, 6) as score from k where rank <= 7""")
def _(d):
    queries = _as_queries(d["v_evidence"], "user_id").withColumn("q_external_ids", F.array(F.lit("ext-1"), F.lit("ext-3")))
    found = S.index_search(queries, d["v_index"], 7, 0.15)
    return found.select("query_id", "point_id", "external_id", "rank", r6("score").alias("score"))


@query("similar_pairs", f"""
    select a.point_id as id_a, b.point_id as id_b, round({COS.format(a='a', b='b')}, 6) as score
    from v_evidence a join v_evidence b on a.point_id < b.point_id where {COS.format(a='a', b='b')} > 0.3""")
def _(d):
    return S.similar_pairs(d["v_evidence"], 0.3).select("id_a", "id_b", r6("score").alias("score"))


@query("similar_pairs_tiled", f"""
    select a.point_id as id_a, b.point_id as id_b, round({COS.format(a='a', b='b')}, 6) as score
    from v_evidence a join v_evidence b on a.point_id < b.point_id where {COS.format(a='a', b='b')} > 0.35""")
def _(d):
    return S.similar_pairs(d["v_evidence"], 0.35, broadcast_queries=0, tile_rows=128, pivots=8).select("id_a", "id_b", r6("score").alias("score"))


@query("pair_similarity_stats", f"""
    with s as (select {COS.format(a='a', b='b')} as x from v_evidence a join v_evidence b on a.point_id < b.point_id)
    select count(*) as pairs, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, round(min(x), 6) as "min", round(max(x), 6) as "max",
      round(median(x), 6) as median from s""")
def _(d):
    return S.similarity_stats(d["v_evidence"]).select("pairs", *[r6(c).alias(c) for c in ("mean", "std", "min", "max", "median")])


@query("collection_stats", """
    select count(*) as points, max(len(vector)) as dimension, count(*) filter (where coalesce(len(vector), -1) <> 64) as wrong_dimension,
      'cosine' as metric from v_evidence""")
def _(d):
    return S.collection_stats(d["v_evidence"], 64)


_SHORT = "case when {a}.vec_id % 5 = 0 then {a}.embedding[1:24] else {a}.embedding end"


def _mixed(d):
    """Vectors of two dimensions: every fifth is cut to 24 cells."""
    n = F.col("vec_id")
    return d["embeddings"].select(F.concat(F.lit("x-"), n.cast("string")).alias("point_id"), (n % 3).cast("string").alias("user_id"),
                                  F.when(n % 5 == 0, F.slice("embedding", 1, 24)).otherwise(F.col("embedding")).alias("vector"))


_MIXED_SQL = f"""select vec_id, concat('x-', cast(vec_id as string)) as point_id, vec_id % 3 as tenant, {_SHORT.format(a='e')} as vector from embeddings e"""


@query("mixed_dimensions_topk", f"""
    with m as ({_MIXED_SQL}),
    s as (select q.point_id as query_id, p.point_id, case when len(q.vector) = len(p.vector) then {COS.format(a='q', b='p')} end as score
          from m q join m p on q.tenant = p.tenant and q.point_id <> p.point_id where q.vec_id % 7 < 3 and p.vec_id % 2 = 1),
    k as (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from s where score >= 0.1)
    select form, query_id, point_id, cast(rank as int) as rank, round(score, 6) as score
    from k, (values ('broadcast'), ('one partition'), ('shipped'), ('tiled')) as f(form) where rank <= 4""")
def _(d):
    rows, n = _mixed(d), F.substring("point_id", 3, 20).cast("long")
    asked = _as_queries(rows.where(n % 7 < 3), "user_id")
    held = rows.where(n % 2 == 1)
    forms = {"broadcast": (held.repartition(5), {}), "one partition": (held.coalesce(1), {}), "shipped": (held, {"broadcast_queries": d["embeddings"].where("vec_id % 2 = 1").count()}),
             "tiled": (held, {"broadcast_queries": 0, "tile_rows": 60})}
    out = None
    for form, (points, physical) in forms.items():
        many = asked
        if form == "shipped":  # more queries than points: every query is also asked under another tenant, where it finds nothing
            many = asked.unionByName(asked.withColumn("q_user_id", F.lit("none")).withColumn("query_id", F.concat(F.lit("y"), "query_id")))
        found = S.best_per_query(S.score_join(many, points, threshold=0.1, k=5, scope=("user_id",), **physical).where("query_id <> point_id"), 4)
        found = found.select(F.lit(form).alias("form"), "query_id", "point_id", "rank", r6("score").alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


@query("mixed_dimensions_pairs", f"""
    with m as ({_MIXED_SQL}),
    s as (select a.point_id as id_a, b.point_id as id_b, case when len(a.vector) = len(b.vector) then {COS.format(a='a', b='b')} end as score from m a join m b on a.point_id < b.point_id)
    select form, id_a, id_b, round(score, 6) as score from s, (values ('broadcast'), ('pivots'), ('tiled')) as f(form) where score > 0.38""")
def _(d):
    rows, out = _mixed(d), None
    for form, physical in (("broadcast", {}), ("pivots", {"broadcast_queries": 0, "tile_rows": 90, "pivots": 6}), ("tiled", {"broadcast_queries": 0, "tile_rows": 90})):
        found = S.similar_pairs(rows, 0.38, **physical).select(F.lit(form).alias("form"), "id_a", "id_b", r6("score").alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


@query("mixed_dimensions_stats", f"""
    with m as ({_MIXED_SQL}),
    s as (select {COS.format(a='a', b='b')} as x from m a join m b on a.point_id < b.point_id and len(a.vector) = len(b.vector))
    select count(*) as pairs, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, round(min(x), 6) as "min", round(max(x), 6) as "max" from s""")
def _(d):
    return S.similarity_stats(_mixed(d), tile_rows=150).select("pairs", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


@query("similar_pairs_lsh", f"""
    select count(*) as exact_pairs, 0 as unconfirmed, 0 as repeated, true as recall_reached
    from v_evidence a join v_evidence b on a.point_id < b.point_id where {COS.format(a='a', b='b')} > 0.35""")
def _(d):
    points = d["v_evidence"]
    exact = S.similar_pairs(points, 0.35).select("id_a", "id_b", F.lit(1).alias("exact"), F.lit(0).alias("times"))
    found = hashed_pairs.similar_pairs_lsh(points, 0.35, recall=0.95, tile_rows=200).select("id_a", "id_b", F.lit(0).alias("exact"), F.lit(1).alias("times"))
    # both sides meet in one grouping; a pair without an id meets nothing
    alone = F.when(F.col("id_a").isNull() | F.col("id_b").isNull(), F.col("exact")).alias("alone")
    met = exact.unionByName(found).groupBy("id_a", "id_b", alone).agg(F.sum("exact").alias("exact"), F.sum("times").alias("times"))
    counted = met.agg(F.sum("exact").alias("exact_pairs"), F.count_if(F.col("exact") == 0).cast("int").alias("unconfirmed"),
                      F.sum(F.when(F.col("times") > 1, F.greatest("exact", F.lit(1))).otherwise(0)).cast("int").alias("repeated"), F.sum(F.when(F.col("times") > 0, F.col("exact")).otherwise(0)).alias("hit"))
    counted = counted.select(*[F.coalesce(c, F.lit(0).cast(counted.schema[c].dataType)).alias(c) for c in counted.columns])
    return counted.select("exact_pairs", "unconfirmed", "repeated", (F.col("hit") >= 0.9 * F.col("exact_pairs")).alias("recall_reached"))


@query("neighbour_lists_cells", f"""
    with s as (select q.point_id as query_id, p.point_id, p.camera_id, {COS.format(a='q', b='p')} as score from v_watch q join v_evidence p on q.user_id = p.user_id),
    k as (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from s)
    select query_id, point_id, camera_id, cast(rank as int) as rank, round(score, 6) as score from k where rank <= 10""")
def _(d):
    root, points = tables.scratch_root(d.spark), d["v_evidence"].select("point_id", "vector", "user_id", "camera_id")
    cells.build(points, root, 32)
    found = cells.Layout(d.spark, root, points.schema).search(_as_queries(d["v_watch"], "user_id"), 10, scope=("user_id",), payload=("camera_id",))
    return found.select("query_id", "point_id", "camera_id", "rank", r6("score").alias("score"))


# --- watch-list ----------------------------------------------------------------
_MATCH = ("matched_qdrant_point_id", "blacklist_entry_id", "blacklist_reference_id", "blacklist_entry_name", "blacklist_entry_version",
          "blacklist_reference_url", "evidence_id", "evidence_camera_id", "matched_image_index")


def _match_rows(df, *extra):
    return df.select(*_MATCH, r6("similarity_score").alias("similarity_score"), "threshold_used", "trigger", *extra)


_MATCH_SQL = """matched_qdrant_point_id, e.id as blacklist_entry_id, r.id as blacklist_reference_id, e.name as blacklist_entry_name,
      e.blacklist_version as blacklist_entry_version, r.image_url as blacklist_reference_url, evidence_id, evidence_camera_id, matched_image_index"""


@query("inline_watchlist_match", f"""
    with gate as (select distinct user_id from v_wl_entries where active and status = 3),
    s as (select f.point_id as matched_qdrant_point_id, f.evidence_id, f.camera_id as evidence_camera_id, f.image_index as matched_image_index,
            p.point_id, p.blacklist_entry_id, p.blacklist_reference_id, {COS.format(a='f', b='p')} as score
          from v_evidence f join v_watch p on f.user_id = p.user_id where f.user_id in (select user_id from gate)),
    k as (select *, row_number() over (partition by matched_qdrant_point_id order by score desc, point_id) as rn from s where score >= {_T})
    select {_MATCH_SQL}, round(score, 6) as similarity_score, cast({_T} as double) as threshold_used, 'inline' as "trigger"
    from k join v_wl_entries e on e.id = k.blacklist_entry_id join v_wl_refs r on r.id = k.blacklist_reference_id where rn <= 12""")
def _(d):
    return _match_rows(L.inline_matches(d["v_evidence"], d["v_watch"], d["v_wl_entries"], d["v_wl_refs"], threshold=_T, limit=12))


_REVERSE = f"""
    with s as (select n.reference_id, n.entry_id, p.point_id as matched_qdrant_point_id, p.evidence_id, p.camera_id as evidence_camera_id,
            p.image_index as matched_image_index, {COS.format(a='n', b='p')} as score
          from ({{news}}) n join v_evidence p on n.user_id = p.user_id),
    k as (select *, row_number() over (partition by reference_id order by score desc, matched_qdrant_point_id) as rn from s where score >= {_T})
    select {_MATCH_SQL}, round(score, 6) as similarity_score, cast({_T} as double) as threshold_used, 'reverse_search' as "trigger"
    from k join v_wl_entries e on e.id = k.entry_id join v_wl_refs r on r.id = k.reference_id where rn <= 9"""


@query("reverse_watchlist_match", _REVERSE.format(
    news="select blacklist_reference_id as reference_id, blacklist_entry_id as entry_id, user_id, vector from v_watch"))
def _(d):
    news = d["v_watch"].select(F.col("blacklist_reference_id").alias("reference_id"), F.col("blacklist_entry_id").alias("entry_id"), "user_id", "vector")
    return _match_rows(L.reverse_matches(news, d["v_evidence"], d["v_wl_entries"], d["v_wl_refs"], threshold=_T, limit=9))


@query("reverse_match_every_vector", _REVERSE.format(
    news="""select blacklist_reference_id as reference_id, blacklist_entry_id as entry_id, user_id, point_id, vector from v_watch union all
            select blacklist_reference_id, blacklist_entry_id, user_id, concat(point_id, '-b'), list_reverse(vector) from v_watch""").replace("select n.reference_id, n.entry_id,", "select n.point_id as asked, n.reference_id, n.entry_id,")
    .replace("partition by reference_id order", "partition by asked order"))
def _(d):
    """Two vectors of every reference, as when it is computed twice before a job runs: each makes its own search."""
    news = d["v_watch"].select(F.col("blacklist_reference_id").alias("reference_id"), F.col("blacklist_entry_id").alias("entry_id"), "user_id", "point_id", "vector")
    news = news.unionByName(news.withColumn("point_id", F.concat("point_id", F.lit("-b"))).withColumn("vector", F.reverse("vector")))
    return _match_rows(L.reverse_matches(news, d["v_evidence"], d["v_wl_entries"], d["v_wl_refs"], threshold=_T, limit=9))


@query("backfill_watchlist_match", _REVERSE.format(
    news="""select r.id as reference_id, r.entry_id, e.user_id, w.vector from v_wl_refs r join v_wl_entries e on e.id = r.entry_id
            join v_wl_embs m on m.reference_id = r.id join v_watch w on w.point_id = m.qdrant_point_id where r.status = 3"""))
def _(d):
    entries = d["v_wl_entries"]
    return _match_rows(L.backfill_matches(entries.select("id"), entries, d["v_wl_refs"], d["v_wl_embs"], d["v_watch"].unionByName(d["v_evidence"]),
                                          threshold=_T, limit=9))


_XREF_COLUMNS = ("user_id", "blacklist_entry_id", "blacklist_reference_id", "external_id", "batch_id", "item_index", "image_id", "source_url",
                 "qdrant_point_id")
_XREF_SELECT = """user_id, blacklist_entry_id, blacklist_reference_id, external_id, batch_id, item_index,
      coalesce(nullif(item_ref, ''), point_id) as image_id, source_url, point_id as qdrant_point_id, round(score, 6) as similarity_score,
      round(thr, 6) as threshold_used"""


@query("cross_reference", f"""
    with s as (select e.id as blacklist_entry_id, e.user_id, coalesce(e.match_threshold, 0.25) as thr, m.id as emb_id, m.created_at as emb_at,
            m.reference_id as blacklist_reference_id, m.model_version as ref_model, x.point_id, x.external_id, x.batch_id, x.item_index, x.item_ref,
            x.source_url, x.model_version, {COS.format(a='w', b='x')} as score
          from v_wl_entries e join v_wl_embs m on m.entry_id = e.id join v_watch w on w.point_id = m.qdrant_point_id
          join v_index x on x.user_id = e.user_id and x.external_id in ('ext-0', 'ext-2', 'ext-4')),
    k as (select *, row_number() over (partition by emb_id order by score desc, point_id) as rn from s where score >= thr),
    g as (select *, row_number() over (partition by blacklist_entry_id, point_id order by score desc, emb_at, emb_id) as best
          from k where rn <= 6 and model_version = ref_model)
    select {_XREF_SELECT} from g where best = 1""")
def _(d):
    found = L.cross_reference(d["v_wl_entries"], d["v_wl_embs"], d["v_watch"], d["v_index"], external_ids=["ext-0", "ext-2", "ext-4"],
                              limit=6, default=0.25)
    return found.select(*_XREF_COLUMNS, r6("similarity_score").alias("similarity_score"), r6("threshold_used").alias("threshold_used"))


@query("cross_reference_batch", f"""
    with s as (select e.id as blacklist_entry_id, e.user_id, coalesce(e.match_threshold, 0.25) as thr, m.id as emb_id, m.created_at as emb_at,
            m.reference_id as blacklist_reference_id, m.model_version as ref_model, x.point_id, x.external_id, x.batch_id, x.item_index, x.item_ref,
            x.source_url, x.model_version, {COS.format(a='w', b='x')} as score
          from v_wl_entries e join v_wl_embs m on m.entry_id = e.id join v_watch w on w.point_id = m.qdrant_point_id
          join v_landed b on b.user_id = e.user_id join v_index x on x.user_id = e.user_id and x.batch_id = b.id where e.active and e.status = 3),
    k as (select *, row_number() over (partition by emb_id, batch_id order by score desc, point_id) as rn from s where score >= thr),
    g as (select *, row_number() over (partition by blacklist_entry_id, point_id, batch_id order by score desc, emb_at, emb_id) as best
          from k where rn <= 4 and model_version = ref_model)
    select {_XREF_SELECT} from g where best = 1""")
def _(d):
    found = L.cross_reference_batch(d["v_landed"], d["v_wl_entries"], d["v_wl_embs"], d["v_watch"], d["v_index"], limit=4, default=0.25)
    return found.select(*_XREF_COLUMNS, r6("similarity_score").alias("similarity_score"), r6("threshold_used").alias("threshold_used"))


@query("best_match_per_point", f"""
    with s as (select w.blacklist_entry_id, x.point_id, w.point_id as embedding_id, w.created_at, {COS.format(a='w', b='x')} as score
               from v_watch w join v_index x on w.user_id = x.user_id),
    g as (select *, row_number() over (partition by blacklist_entry_id, point_id order by score desc, created_at, embedding_id) as rn from s where score >= 0.1)
    select blacklist_entry_id, point_id, embedding_id, round(score, 6) as score from g where rn = 1""")
def _(d):
    watch = d["v_watch"]
    known = watch.select(F.col("point_id").alias("query_id"), "blacklist_entry_id", F.col("created_at").alias("embedding_created_at"))
    asked = _as_queries(watch, "user_id").join(known.withColumnsRenamed({"blacklist_entry_id": "q_best", "embedding_created_at": "q_order"}), "query_id")
    hits = S.score_join(asked, d["v_index"], threshold=0.1, scope=("user_id",))
    best = L.best_per_point(hits.join(known, "query_id").withColumnRenamed("query_id", "embedding_id"))
    return best.select("blacklist_entry_id", "point_id", "embedding_id", r6("score").alias("score"))


@query("active_tenants", "select distinct user_id from v_entries where active and status = 3")
def _(d):
    return L.active_tenants(d["v_entries"])


@query("active_point_ids", """
    select e.user_id, m.entry_id, m.qdrant_point_id from v_embs m join v_entries e on e.id = m.entry_id where e.active and e.status = 3""")
def _(d):
    return L.active_point_ids(d["v_entries"], d["v_embs"])


@query("same_model_guard", """
    select w.point_id as left_id, x.point_id as right_id from v_watch w join v_index x on w.vector = x.vector and w.model_version = x.model_version""")
def _(d):
    number = lambda: F.split_part("point_id", F.lit("-"), F.lit(2))
    left = d["v_watch"].select(number().alias("n"), F.col("point_id").alias("left_id"), F.col("model_version").alias("reference_model_version"))
    right = d["v_index"].select(number().alias("n"), F.col("point_id").alias("right_id"), "model_version")
    return P.same_model(left.join(right, "n")).select("left_id", "right_id")


@query("watchlist_match_events", f"""
    with gate as (select distinct user_id from v_wl_entries where active and status = 3),
    s as (select f.point_id as frame, f.evidence_id, f.image_url, f.category, p.point_id, p.blacklist_entry_id, p.blacklist_reference_id,
            {COS.format(a='f', b='p')} as score
          from v_evidence f join v_watch p on f.user_id = p.user_id where f.user_id in (select user_id from gate)),
    k as (select *, row_number() over (partition by frame order by score desc, point_id) as rn from s where score >= 0.4)
    select 'image.blacklist_match' as event_type, e.id as entry, e.category as entry_category, k.frame, k.image_url, k.category[1] as first_category,
      round(score, 6) as score, '2024-03-01T10:00:00.250000Z' as matched_at, false as has_target
    from k join v_wl_entries e on e.id = k.blacklist_entry_id join v_wl_refs r on r.id = k.blacklist_reference_id where rn <= 3""")
def _(d):
    found = L.inline_matches(d["v_evidence"], d["v_watch"], d["v_wl_entries"], d["v_wl_refs"], threshold=0.4, limit=3)
    events = L.match_events(found, ts("2024-03-01 10:00:00.25"))
    get = lambda p: F.get_json_object("payload", p)
    return events.select(
        "event_type", get("$.blacklist_entry_id").alias("entry"), get("$.blacklist_entry_category").alias("entry_category"),
        get("$.matched_qdrant_point_id").alias("frame"), get("$.matched_image_url").alias("image_url"),
        get("$.evidence_category[0]").alias("first_category"), r6(get("$.similarity_score").cast("double")).alias("score"),
        get("$.matched_at").alias("matched_at"), F.array_contains(F.json_object_keys("payload"), "match_target").alias("has_target"))


@query("index_match_events", f"""
    with s as (select e.id as entry, e.user_id, coalesce(e.match_threshold, 0.25) as thr, m.id as emb_id, m.created_at as emb_at, m.reference_id,
            m.model_version as ref_model, x.point_id, x.external_id, x.batch_id, x.item_index, x.item_ref, x.model_version, {COS.format(a='w', b='x')} as score
          from v_wl_entries e join v_wl_embs m on m.entry_id = e.id join v_watch w on w.point_id = m.qdrant_point_id
          join v_landed b on b.user_id = e.user_id join v_index x on x.user_id = e.user_id and x.batch_id = b.id where e.active and e.status = 3),
    k as (select *, row_number() over (partition by emb_id, batch_id order by score desc, point_id) as rn from s where score >= thr),
    g as (select *, row_number() over (partition by entry, point_id, batch_id order by score desc, emb_at, emb_id) as best
          from k where rn <= 2 and model_version = ref_model)
    select entry, reference_id as reference, coalesce(nullif(item_ref, ''), point_id) as evidence, 'image_index' as target, external_id, batch_id,
      item_index as image_index, null as camera, 'image_index_xref' as "trigger", round(score, 6) as score from g where best = 1""")
def _(d):
    found = L.cross_reference_batch(d["v_landed"], d["v_wl_entries"], d["v_wl_embs"], d["v_watch"], d["v_index"], limit=2, default=0.25)
    events = L.match_events(L.index_match_rows(found, d["v_wl_entries"], d["v_wl_refs"]), ts("2024-03-01 10:00:00"))
    get = lambda p: F.get_json_object("payload", p)
    return events.select(
        get("$.blacklist_entry_id").alias("entry"), get("$.blacklist_reference_id").alias("reference"), get("$.evidence_id").alias("evidence"),
        get("$.match_target").alias("target"), get("$.external_id").alias("external_id"), get("$.batch_id").alias("batch_id"),
        get("$.matched_image_index").cast("int").alias("image_index"), get("$.evidence_camera_id").alias("camera"), get("$.trigger").alias("trigger"),
        r6(get("$.similarity_score").cast("double")).alias("score"))


# --- filters on vector tables ----------------------------------------------------
@query("payload_filter", """
    select point_id, camera_id from v_evidence
    where camera_id in ('cam-1', 'cam-4') and user_id = 'user-1' and (list_contains(category, '4') or list_contains(category, '11'))""")
def _(d):
    kept = P.payload_filter(d["v_evidence"], {"camera_id": ["cam-1", "cam-4"], "user_id": "user-1", "category": ["4", "11"]})
    return kept.select("point_id", "camera_id")


@query("source_scope", """
    select 'evidence' as which, count(*) as n from v_evidence union all select 'blacklist', count(*) from v_watch
    union all select 'entry', count(*) from v_watch where blacklist_entry_id = UUID['entry-23']""")
def _(d):
    both = d["v_evidence"].unionByName(d["v_watch"])
    tag = lambda df, name: df.agg(F.lit(name).alias("which"), F.count(F.lit(1)).alias("n"))
    entry = uuid_of("entry-23")
    return tag(P.evidence_only(both, {"source_type": "blacklist"}), "evidence").unionByName(tag(P.blacklist_only(both), "blacklist")).unionByName(
        tag(P.entry_points(both, entry), "entry"))


@query("weapons_modes", """
    select 'all' as mode, count(*) as n from v_evidence union all select 'only', count(*) from v_evidence where has_weapon
    union all select 'only_classes', count(*) from v_evidence where has_weapon and (list_contains(weapon_classes, 'objeto') or list_contains(weapon_classes, 'x'))
    union all select 'exclude', count(*) from v_evidence where not has_weapon
    union all select 'analyzed_clean', count(*) from v_evidence where weapon_analyzed and not has_weapon union all select 'unknown', count(*) from v_evidence""")
def _(d):
    points = d["v_evidence"]
    out = None
    for name, mode, classes in (("all", "all", None), ("only", "only", None), ("only_classes", "only", ["objeto", "x"]), ("exclude", "exclude", ["objeto"]),
                                ("analyzed_clean", "analyzed_clean", None), ("unknown", "???", None)):
        part = P.weapons_filter(points, mode, classes).agg(F.lit(name).alias("mode"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("metadata_allow_list", """
    select point_id from v_evidence where camera_id = 'cam-2' and list_contains(category, '3') and has_weapon = false""")
def _(d):
    asked = {"camera_id": "cam-2", "category": "3", "weapons_filter": "exclude", "user_id": "user-9", "source_type": "blacklist"}
    return P.payload_filter(d["v_evidence"].unionByName(d["v_watch"]), P.search_conditions(asked)).select("point_id")


@query("many_filtered_searches", f"""
    with q as (select *, cast(substr(point_id, 4) as bigint) as n from v_watch),
    s as (select q.point_id as query_id, p.point_id, {COS.format(a='q', b='p')} as score, n
          from q join v_evidence p on q.user_id = p.user_id
          where (n % 3 <> 0 or p.camera_id = concat('cam-', cast(n % 7 as string)) or (n % 6 = 0 and p.camera_id = concat('cam-', cast((n + 2) % 7 as string))))
            and (n % 4 <> 1 or list_contains(p.category, cast(n % 10 as string)) or list_contains(p.category, '11'))
            and case n % 5 when 1 then p.has_weapon when 2 then not p.has_weapon when 3 then p.weapon_analyzed and not p.has_weapon else true end),
    k as (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from s where score >= 0.05 + (n % 4) * 0.05)
    select query_id, point_id, cast(rank as int) as rank, round(score, 6) as score from k where rank <= 2 + n % 3""")
def _(d):
    n = F.substring("point_id", 4, 20).cast("bigint")
    key = lambda cond, k, v: F.when(cond, F.concat(F.lit(f'"{k}":'), v))
    mode = F.element_at(F.array(*[F.lit(m) for m in ("all", "only", "exclude", "analyzed_clean", "odd")]), (n % 5 + 1).cast("int"))
    meta = F.concat(F.lit("{"), F.concat_ws(
        ",", key(n % 6 == 3, "camera_id", F.concat(F.lit('"cam-'), (n % 7).cast("string"), F.lit('"'))),
        key(n % 6 == 0, "camera_id", F.concat(F.lit('["cam-'), (n % 7).cast("string"), F.lit('","cam-'), ((n + 2) % 7).cast("string"), F.lit('"]'))),
        key(n % 4 == 1, "category", F.concat(F.lit('["'), (n % 10).cast("string"), F.lit('","11"]'))),
        key(F.lit(True), "weapons_filter", F.concat(F.lit('"'), mode, F.lit('"')))), F.lit("}"))
    asked = d["v_watch"].select(F.col("point_id").alias("id"), "user_id", "vector", (F.lit(0.05) + (n % 4) * 0.05).alias("threshold"),
                                (2 + n % 3).cast("int").alias("max_results"), meta.alias("search_metadata"))
    found = searches.evidence_search(asked, d["v_evidence"])
    rank = F.row_number().over(S.W.partitionBy("search_request_id").orderBy(F.col("similarity_score").desc(), "pid"))
    rows = found.withColumn("pid", F.get_json_object("match_metadata", "$.qdrant_point_id")).withColumn("rank", rank)
    return rows.select(F.col("search_request_id").alias("query_id"), F.col("pid").alias("point_id"), "rank", r6("similarity_score").alias("score"))


@query("tenant_scope", """
    select 'own' as who, count(*) as n from v_entries where user_id = 'user-3' union all select 'guest', count(*) from v_entries where user_id = 'user-4'
    union all select 'admin', count(*) from v_entries union all select 'admin_target', count(*) from v_entries where user_id = 'user-5'""")
def _(d):
    entries = d["v_entries"]
    rows = [("own", P.Caller("user-3"), "user-5"), ("guest", P.Caller("user-9", "guest", "user-4"), None), ("admin", P.Caller("user-1", "admin"), None),
            ("admin_target", P.Caller("user-1", "root"), "user-5")]
    parts = [P.tenant_scope(entries, c, t).agg(F.lit(n).alias("who"), F.count(F.lit(1)).alias("n")) for n, c, t in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_BROKEN = """case vec_id % 6 when 1 then cast([] as float[]) when 2 then null when 3 then list_transform(embedding, lambda x: cast(0 as float))
    when 4 then list_append(embedding, cast('nan' as float)) when 5 then list_append(embedding, cast('infinity' as float)) else embedding end"""


@query("valid_vector_guard", f"""
    with b as (select vec_id, {_BROKEN} as v from embeddings)
    select vec_id from b where len(v) > 0 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0
      and list_sum(list_transform(v, lambda x: cast(x as double) * x)) > 0""")
def _(d):
    e, n = F.col("embedding"), F.col("vec_id") % 6
    extra = lambda v: F.concat(e, F.array(F.lit(float(v)).cast("float")))
    broken = (F.when(n == 1, F.array().cast("array<float>")).when(n == 2, F.lit(None)).when(n == 3, F.transform(e, lambda x: x * F.lit(0).cast("float")))
              .when(n == 4, extra("nan")).when(n == 5, extra("inf")).otherwise(e))
    return P.valid_vectors(d["embeddings"].select("vec_id", broken.alias("vector"))).select("vec_id")


@query("index_scope", """
    select point_id from v_index where user_id = 'user-2' and external_id in ('ext-0', 'ext-3') and batch_id = UUID['ixb-2-3']""")
def _(d):
    return P.index_scope(d["v_index"], "user-2", ["ext-0", "ext-3"], uuid_of("ixb-2-3")).select("point_id")


# --- point tables ------------------------------------------------------------------
@query("upsert_points", """
    with changed as (select point_id, concat(image_url, '?v=', cast(v as string)) as image_url, v from v_evidence, (values (1), (2)) as t(v) where app_id % 2 = 1
                     union all select concat('new-', point_id), image_url, 1 from v_evidence where app_id = 3),
    last as (select *, row_number() over (partition by point_id order by v desc) as rn from changed)
    select point_id, image_url from last where rn = 1 union all select point_id, image_url from v_evidence where point_id not in (select point_id from changed)""")
def _(d):
    table = d["v_evidence"]
    odd = table.where("app_id % 2 = 1").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    odd = odd.withColumn("image_url", F.concat("image_url", F.lit("?v="), F.col("seq").cast("string")))
    new = table.where("app_id = 3").withColumn("point_id", F.concat(F.lit("new-"), "point_id")).withColumn("seq", F.lit(1))
    return tables.upsert_points(table, odd.unionByName(new)).select("point_id", "image_url")


@query("upsert_index_items", """
    select cast(label % 3 as string) as tenant, count(*) as n, sum(len(embedding)) as cells, count(*) as fresh_urls, 'clip-vit-b-32' as model_version
    from embeddings group by 1""")
def _(d):
    items = d["v_index"].withColumn("point_id", text.index_point_id(F.col("batch_id"), F.col("item_index"))).withColumn("model_version", F.lit(C.MODEL_VERSION))
    held = items.where(F.col("external_id").isin("ext-0", "ext-1"))
    arriving = items.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("source_url", F.concat("source_url", F.lit("#"), F.col("seq").cast("string")))
    out = tables.upsert_points(held, arriving)
    return out.groupBy(F.split_part("user_id", F.lit("-"), F.lit(2)).alias("tenant")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("vector")).alias("cells"), F.count_if(F.col("source_url").endswith("#2")).alias("fresh_urls"),
        F.max("model_version").alias("model_version"))


@query("query_vector_fetch", """
    select s.search_id, e.vec_id from v_searches s join embeddings e on s.qdrant_query_point_id = concat('q-', cast(e.vec_id as string))""")
def _(d):
    stored = d["embeddings"].select(F.concat(F.lit("q-"), F.col("vec_id").cast("string")).alias("point_id"), "vec_id", F.col("embedding").alias("vector"))
    ids = d["v_searches"].select(F.col("qdrant_query_point_id").alias("point_id"), "search_id")
    return tables.points_by_id(stored, ids).join(ids, "point_id").select("search_id", "vec_id")


@query("points_by_id", """
    select point_id, evidence_id from v_evidence where point_id in (select concat('ev-', lpad(cast(o_orderkey as string), 9, '0')) from orders)""")
def _(d):
    ids = d["orders"].select(F.concat(F.lit("ev-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("point_id"))
    return tables.points_by_id(d["v_evidence"], ids).select("point_id", "evidence_id")


@query("delete_points", """
    select point_id from v_evidence where point_id not in (select point_id from v_evidence where camera_id = 'cam-3')
    union all select point_id from v_index where batch_id not in (UUID['ixb-0-1'], UUID['ixb-1-2'])""")
def _(d):
    table = d["v_evidence"]
    kept = tables.delete_points(table, table.where("camera_id = 'cam-3'").select("point_id"))
    gone = [uuid_of("ixb-0-1"), uuid_of("ixb-1-2")]
    return kept.select("point_id").unionByName(tables.delete_batch(tables.delete_batch(d["v_index"], []), gone).select("point_id"))


_LEFT_SQL = f"""
    with gone as (select id from v_wl_entries where not active),
    held as (select *, point_id in (select qdrant_point_id from v_wl_embs where entry_id in (select id from gone)) as removed from v_watch),
    s as (select f.point_id as frame, p.point_id, p.blacklist_entry_id as entry_id, {COS.format(a='f', b='p')} as score
          from v_evidence f join held p on f.user_id = p.user_id where not p.removed and f.vector[1] > 0),
    k as (select *, row_number() over (partition by frame order by score desc, point_id) as rank from s where score >= {_T})
    select frame, point_id, entry_id, cast(rank as int) as rank, round(score, 6) as score from k where rank <= 5"""


@query("delete_entries_then_search", _LEFT_SQL)
def _(d):
    """Deletes of inactive entries persist in a partitioned table; a search of it meets nothing of theirs."""
    store = stored_points.PointTable(d.spark, tables.scratch_root(d.spark), buckets=4)
    store.upsert(d["v_evidence"].unionByName(d["v_watch"]))
    entries = d["v_wl_entries"]
    stored_points.delete_entries(entries.where("not active"), entries, d["v_wl_refs"], d["v_wl_embs"], store)
    again = stored_points.PointTable(d.spark, store.path.rsplit("/", 1)[0], buckets=4)
    asked = again.rows(C.SOURCE_EVIDENCE).where("vector[0] > 0")
    found = S.similarity_search(_as_queries(asked, "user_id"), again.of_tenants(C.SOURCE_BLACKLIST, asked), 5, _T, scope=("user_id",), payload=("blacklist_entry_id",))
    return found.select(F.col("query_id").alias("frame"), "point_id", F.col("blacklist_entry_id").alias("entry_id"), "rank", r6("score").alias("score"))


@query("partitioned_points", """
    select source_type, user_id, count(*) as n, count(*) filter (where image_url like '%#2') as fresh from (
      select source_type, case when label = 4 then 'user-9' else user_id end as user_id, case when camera_id = 'cam-2' then concat(image_url, '#2') else image_url end as image_url
      from (select v.*, e.label from v_evidence v join embeddings e on v.point_id = concat('ev-', lpad(cast(e.vec_id as string), 9, '0'))) where camera_id <> 'cam-5'
      union all select source_type, user_id, image_url from v_watch where user_id <> 'user-1')
    group by source_type, user_id""")
def _(d):
    """Upserts that replace, move a tenant's points and add, deletes by id and of a whole tenant, read back from storage."""
    store, mine = stored_points.PointTable(d.spark, tables.scratch_root(d.spark), buckets=8), d["v_evidence"]
    label = F.element_at("category", 1)
    store.upsert(mine.where("camera_id <> 'cam-2'").unionByName(d["v_watch"]))
    moved = mine.where(label == "4").withColumn("user_id", F.lit("user-9")).unionByName(mine.where((label != "4") & (F.col("camera_id") == "cam-2")))
    told = moved.withColumn("image_url", F.when(F.col("camera_id") == "cam-2", F.concat("image_url", F.lit("#2"))).otherwise(F.col("image_url")))
    store.upsert(told.withColumn("seq", F.lit(2)).unionByName(moved.where("camera_id = 'cam-2'").withColumn("seq", F.lit(1))), "seq")
    store.delete(mine.where("camera_id = 'cam-5'"))
    store.delete_by(C.SOURCE_BLACKLIST, "user_id", d.spark.createDataFrame([("user-1",)], "user_id string"))
    rows = store.rows()
    return rows.groupBy("source_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("image_url").endswith("#2")).alias("fresh"))


@query("cascade_delete", """
    with gone as (select id from v_wl_entries where not active)
    select 'entries' as kind, count(*) as n from v_wl_entries where id not in (select id from gone)
    union all select 'references', count(*) from v_wl_refs where entry_id not in (select id from gone)
    union all select 'embeddings', count(*) from v_wl_embs where entry_id not in (select id from gone)
    union all select 'points', count(*) from v_watch where point_id not in (select qdrant_point_id from v_wl_embs where entry_id in (select id from gone))
    union all select 'removed', count(*) from v_wl_embs where entry_id in (select id from gone)""")
def _(d):
    entries = d["v_wl_entries"]
    left = tables.cascade_delete(entries.where("not active"), entries, d["v_wl_refs"], d["v_wl_embs"], d["v_watch"])
    parts = [df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")) for kind, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("land_reference_embeddings", """
    select w.blacklist_reference_id as reference_id, w.blacklist_entry_id as entry_id, r.image_url, e.category as entry_category, 3 as reference_status,
      3 as entry_status, len(w.vector) as dim from v_watch w join v_wl_entries e on e.id = w.blacklist_entry_id and e.active
    join v_wl_refs r on r.id = w.blacklist_reference_id""")
def _(d):
    messages = d["v_watch"].select(F.upper("blacklist_reference_id").alias("reference_id"), F.col("blacklist_entry_id").alias("entry_id"), "user_id", "vector",
                                   F.concat(F.lit("17-"), F.substring("point_id", 4, 9)).alias("stream_id"))
    entries = d["v_wl_entries"].where("active").withColumn("updated_at", F.col("created_at"))
    refs = d["v_wl_refs"].withColumn("updated_at", F.col("created_at"))
    out = L.land_reference_embeddings(messages, entries, refs, ts("2024-03-01"))
    r = out["references"].select(F.col("id").alias("reference_id"), F.col("status").alias("reference_status"))
    e = out["entries"].select(F.col("id").alias("entry_id"), F.col("status").alias("entry_status"))
    p = out["points"].select(F.col("point_id").alias("qdrant_point_id"), "image_url", F.element_at("category", 1).alias("entry_category"), F.size("vector").alias("dim"))
    rows = out["embeddings"].select("entry_id", "reference_id", "qdrant_point_id")
    return rows.join(p, "qdrant_point_id").join(r, "reference_id").join(e, "entry_id").drop("qdrant_point_id")


# --- vector functions ----------------------------------------------------------------
@query("cosine_function", """
    select w.point_id, round(list_cosine_similarity(cast(w.vector as double[]), cast(list_reverse(w.vector) as double[])), 6) as c from v_watch w""")
def _(d):
    return d["v_watch"].select("point_id", r6(vectors.cosine(F.col("vector"), F.reverse("vector"))).alias("c"))


@query("l2_normalize_function", """
    with s as (select vec_id, list_transform(embedding, lambda x: cast(x as double) * (1 + vec_id % 3)) as v from embeddings),
    n as (select vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u from s)
    select vec_id, round(u[1], 6) as first_value, round(sqrt(list_sum(list_transform(u, lambda y: y * y))), 6) as length from n""")
def _(d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3))
    unit = d["embeddings"].select("vec_id", vectors.l2_normalize(scaled).alias("u"))
    return unit.select("vec_id", r6(F.element_at("u", 1)).alias("first_value"), r6(vectors.norm(F.col("u"))).alias("length"))


@query("decode_vector_function", """
    select vec_id, cast(i as int) as pos, round(cast(embedding[i] as double), 6) as value from embeddings, range(1, 65) t(i)""")
def _(d):
    wire = d["embeddings"].select("vec_id", vectors.encode_vector("embedding").alias("b64"))
    good = wire.where(vectors.vector_error(F.col("b64"), F.lit(C.VECTOR_ENCODING), 64).isNull())
    cells = good.select("vec_id", F.posexplode(vectors.decode_vector("b64")).alias("pos", "value"))
    return cells.select("vec_id", (F.col("pos") + 1).cast("int").alias("pos"), r6(F.col("value").cast("double")).alias("value"))


@query("vector_errors", """
    select case vec_id % 5 when 0 then 'unknown vector_encoding' when 1 then 'null vector_b64' when 2 then 'vector_b64 is not a whole number of float32'
      when 3 then 'wrong vector dimension' end as problem, count(*) as n from embeddings group by 1""")
def _(d):
    n = F.col("vec_id") % 5
    wire = d["embeddings"].withColumn("b64", vectors.encode_vector("embedding"))
    b64 = F.when(n == 1, F.lit(None)).when(n == 2, F.base64(F.substring(F.unbase64("b64"), 1, 254))).when(n == 3, F.base64(F.substring(F.unbase64("b64"), 1, 252))).otherwise(F.col("b64"))
    encoding = F.when(n == 0, F.lit("f16")).otherwise(F.lit(C.VECTOR_ENCODING))
    return wire.select(vectors.vector_error(b64, encoding, 64).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


_BHATT = """sqrt(greatest(0, 1 - list_sum(list_transform(list_zip(a.h, b.h), lambda z: sqrt(z[1] * z[2]))) / sqrt(list_sum(a.h) * list_sum(b.h))))"""


@query("bhattacharyya_function", f"""
    with h as (select vec_id, list_transform(embedding, lambda x: abs(cast(x as double))) as h from embeddings)
    select a.vec_id, round({_BHATT}, 6) as distance from h a join h b on b.vec_id = a.vec_id + 1""")
def _(d):
    h = d["embeddings"].select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("h"))
    following = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("h2"))
    return h.join(following, "vec_id").select("vec_id", r6(vectors.bhattacharyya(F.col("h"), F.col("h2"))).alias("distance"))


@query("quality_function", """
    select p_partkey, (least(p_size, p_partkey % 90) >= 10 and case when least(p_size, p_partkey % 90) > 0
      then greatest(p_size, p_partkey % 90) * 1.0 / least(p_size, p_partkey % 90) else 999 end <= 5) as fair from part""")
def _(d):
    return d["part"].select("p_partkey", vectors.passes_quality(F.col("p_size"), F.col("p_partkey") % 90, 10, 5.0).alias("fair"))


def _hist_frames(d):
    group = F.floor(F.col("vec_id") / 10)
    return d["embeddings"].select(
        group.alias("group_id"), F.col("vec_id").alias("pos"), (40 + F.col("vec_id") % 100).cast("int").alias("width"), F.lit(120).alias("height"),
        F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("hist"))


_GREEDY = f"""
    with recursive h as (select cast(floor(vec_id / 10) as bigint) as g, vec_id as pos, list_transform(embedding, lambda x: abs(cast(x as double))) as h
             from embeddings where least(40 + vec_id % 100, 120) >= 50 and greatest(40 + vec_id % 100, 120) * 1.0 / least(40 + vec_id % 100, 120) <= 5),
    first as (select g, min(pos) as pos from h group by g),
    walk as (select first.g, first.pos, 1 as kept from first
      union all
      select w.g, (select min(b.pos) from h b, h a where a.g = w.g and a.pos = w.pos and b.g = w.g and b.pos > w.pos and {_BHATT} >= 0.37) as pos, w.kept + 1
      from walk w where w.kept < 4 and w.pos is not null)
    select g as group_id, pos from walk where pos is not null"""


@query("diversity_selection", _GREEDY)
def _(d):
    return diversity.diversity_select(_hist_frames(d), threshold=0.37, max_images=4)


@query("diversity_selection_hot_groups", _GREEDY)
def _(d):
    return diversity.diversity_select(_hist_frames(d), threshold=0.37, max_images=4, group_rows=0)
