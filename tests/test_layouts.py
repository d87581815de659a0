"""Stored layouts and hash tables: partitions and files that a search reads, exactness, recall, persisted change."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecwatch import config as C
from vecwatch.operators import cells, hashed_pairs as H, similarity as S, watchlist as L
from vecwatch.plans.domain import Domain
from vecwatch.sources import points as P
from vecwatch.sources.tables import scratch_root

SF = "/root/testdata/sf0.001"


def clustered(spark, n=900, groups=30, dim=24, short=20, seed=4):
    """Clusters of near vectors, and a few vectors of another dimension."""
    r = np.random.default_rng(seed)
    centre = r.standard_normal((groups, dim))
    rows = [(f"p{i:05d}", (centre[i % groups] + 0.25 * r.standard_normal(dim)).tolist(), f"t{i % 3}") for i in range(n)]
    rows += [(f"s{i:05d}", r.standard_normal(7).tolist(), "t0") for i in range(short)]
    rows += [("zero", [0.0] * dim, "t0"), ("none", None, "t0"), ("nan", [math.nan] * dim, "t1")]
    return spark.createDataFrame(rows, "point_id string, vector array<float>, user_id string").repartition(6)


def pairs(df):
    return [(r.id_a, r.id_b) for r in df.collect()]


# --- hash tables ---------------------------------------------------------------------
@pytest.mark.parametrize("threshold", [0.8, 0.9])
@pytest.mark.parametrize("tile_rows", [4096, 30])
def test_hash_tables_find_confirmed_pairs_once(spark, threshold, tile_rows):
    points = clustered(spark)
    exact = set(pairs(S.similar_pairs(points, threshold)))
    found = pairs(H.similar_pairs_lsh(points, threshold, recall=0.95, tile_rows=tile_rows))
    assert len(found) == len(set(found)) and set(found) <= exact and len(found) >= 0.9 * len(exact) > 0


def test_one_hot_bucket_is_cut_not_capped(spark):
    """A third of all vectors are equal: every pair of them is found, whatever the tiles."""
    r = np.random.default_rng(1)
    same = r.standard_normal(8).tolist()
    rows = [(f"h{i:03d}", same) for i in range(60)] + [(f"x{i:03d}", r.standard_normal(8).tolist()) for i in range(120)]
    points = spark.createDataFrame(rows, "point_id string, vector array<float>")
    found = set(pairs(H.similar_pairs_lsh(points, 0.999, made=H.Tables(3, 4, 0.9), tile_rows=7)))
    assert {p for p in found if p[0][0] == "h" and p[1][0] == "h"} == {(f"h{i:03d}", f"h{j:03d}") for i in range(60) for j in range(i + 1, 60)}


def test_table_plan_meets_the_recall():
    for rows in (100, 10**6, 10**12):
        for threshold in (0.35, 0.85, 0.99):
            made = H.plan(rows, threshold, 0.95)
            agree = 1 - math.acos(threshold) / math.pi
            assert 1 <= made.tables <= H.MOST_TABLES and 1 - (1 - agree**made.bits) ** made.tables >= 0.95
    with pytest.raises(ValueError):
        H.plan(10, 1.0, 0.9)


def test_hash_tables_of_nothing(spark):
    none = clustered(spark).limit(0)
    assert H.similar_pairs_lsh(none, 0.8).count() == 0


# --- cells --------------------------------------------------------------------------------
@pytest.mark.parametrize("threshold", [None, 0.9])
def test_cells_lose_no_hit_and_read_less(spark, threshold):
    points, root = clustered(spark), scratch_root(spark)
    cells.build(points, root, 40)
    layout = cells.Layout(spark, root, points.schema)
    queries = points.where("point_id like '%7' or point_id like 's%1'").select(F.col("point_id").alias("query_id"), "vector")
    key = lambda df: {(r.query_id, r.rank, r.point_id, round(r.score, 9)) for r in df.collect()}
    assert key(layout.search(queries, 10, threshold)) == key(S.similarity_search(queries, points, 10, threshold))
    one = queries.where("query_id = 'p00007'")
    assert layout.search(one, 10, threshold).count() == 10
    read = set().union(*layout.rounds)
    assert 0 < len(read) <= len(layout.cells) / 4  # a query inside a cluster visits few cells


def test_cells_read_only_the_listed_partitions(spark):
    points, root = clustered(spark), scratch_root(spark)
    cells.build(points, root, 40)
    layout = cells.Layout(spark, root, points.schema)
    rows = spark.read.schema(layout.schema).parquet(f"{root}/points").where(F.col("cell").isin(*list(layout.cells)[:3]))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell#") or "cell#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert len(rows.inputFiles()) > 0 and rows.select("cell").distinct().count() == 3


def test_cells_of_nothing(spark):
    none, root = clustered(spark).limit(0), scratch_root(spark)
    cells.build(none, root)
    asked = clustered(spark).limit(3).select(F.col("point_id").alias("query_id"), "vector")
    assert cells.Layout(spark, root, none.schema).search(asked, 5).count() == 0


# --- pushed conditions --------------------------------------------------------------------
def test_scopes_and_filters_reach_the_scan(spark, tmp_path):
    d = Domain(spark, SF)
    d["v_evidence"].write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    asked = points.where("user_id = 'user-1'").limit(5).select(F.col("point_id").alias("query_id"), "vector", F.col("user_id").alias("q_user_id"), F.array(F.lit("cam-1"), F.lit("cam-2")).alias("f_camera_id"))
    found = S.score_join(asked, points, threshold=0.1, scope=("user_id",))
    pushed = found._jdf.queryExecution().executedPlan().toString().split("PushedFilters:")[1].split("]")[0]
    assert "EqualTo(user_id,user-1)" in pushed and "In(camera_id" in pushed
    assert {r.point_id for r in found.collect()} <= {r.point_id for r in points.where("user_id = 'user-1' and camera_id in ('cam-1', 'cam-2')").collect()}


def test_inline_match_lists_only_watch_list_partitions(spark):
    d, store = Domain(spark, SF), P.PointTable(spark, scratch_root(spark), buckets=4)
    store.upsert(d["v_evidence"].unionByName(d["v_watch"]))
    frames = store.rows(C.SOURCE_EVIDENCE, ["user-1"])
    files = {r[0] for r in frames.select(F.input_file_name()).distinct().collect()}
    assert {f.split("source_type=")[1].split("/")[0] for f in files} == {C.SOURCE_EVIDENCE} and len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1
    listed = store.of_tenants(C.SOURCE_BLACKLIST, frames)
    scan = listed._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert f"= {C.SOURCE_BLACKLIST}" in scan and "bucket#" in scan  # folders of other sources and tenants are not listed
    found = L.inline_matches(frames, listed, d["v_wl_entries"], d["v_wl_refs"], threshold=0.2, limit=5)
    want = L.inline_matches(d["v_evidence"].where("user_id = 'user-1'"), d["v_watch"], d["v_wl_entries"], d["v_wl_refs"], threshold=0.2, limit=5)
    key = lambda df: sorted((r.matched_qdrant_point_id, r.blacklist_reference_id, round(r.similarity_score, 9)) for r in df.collect())
    assert key(found) == key(want) != []


# --- partitioned points ----------------------------------------------------------------------
def test_changes_persist_and_can_be_repeated(spark):
    d, root = Domain(spark, SF), scratch_root(spark)
    store, mine = P.PointTable(spark, root, buckets=4), d["v_evidence"]
    assert store.rows().count() == 0
    ids = lambda: {r.point_id for r in P.PointTable(spark, root, buckets=4).rows().collect()}
    for _ in range(2):
        store.upsert(mine)
    every = {r.point_id for r in mine.collect()}
    assert ids() == every
    for _ in range(2):
        store.delete_by(C.SOURCE_EVIDENCE, "user_id", spark.createDataFrame([("user-0",), (None,)], "user_id string"))
    left = {r.point_id for r in mine.where("user_id <> 'user-0'").collect()}
    assert ids() == left
    store.delete(mine.select("point_id"))
    assert ids() == set()  # emptied partitions stay empty
    store.upsert(mine.where("user_id = 'user-2'").withColumn("user_id", F.lit(None).cast("string")))
    assert {(r.user_id, r.bucket) for r in store.rows().collect()} == {(None, 0)}
