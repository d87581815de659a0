"""Tiles, groups of queries and limits per value: what leaves a task grows with the rows, not with their pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecwatch.operators import cells, hashed_pairs as H, similarity as S
from vecwatch.sources.tables import scratch_root

FORMS = {"broadcast": {}, "tiled": {"broadcast_queries": 0, "tile_rows": 7}}


def vectors(n, dim=6, seed=3):
    r = np.random.default_rng(seed)
    v = r.standard_normal((n, dim)).astype(np.float32).astype(float)
    v[n // 2] = v[1]  # equal scores
    return v


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def points_of(spark, v):
    rows = [(f"p{i:04d}", [float(x) for x in row], f"t{i % 2}", None if i % 11 == 10 else f"b{i % 5}") for i, row in enumerate(v)]
    return spark.createDataFrame(rows, "point_id string, vector array<float>, tenant string, batch string")


@pytest.mark.parametrize("form", FORMS)
def test_only_the_best_query_of_a_group_is_told(spark, form):
    v = vectors(90)
    points = points_of(spark, v)
    queries = points.select(F.col("point_id").alias("query_id"), "vector", F.col("tenant").alias("q_tenant"), F.col("batch").alias("q_best"),
                            (-F.substring("point_id", 2, 4).cast("int")).alias("q_order"))
    hits = S.score_join(queries, points, threshold=0.1, scope=("tenant",), **FORMS[form])
    known = queries.select("query_id", "q_best", "q_order")
    got = [(r.q_best, r.point_id, r.query_id, r.score, r.q_order) for r in hits.join(known, "query_id").collect()]
    scores, want = unit(v) @ unit(v).T, {}
    for q in range(90):
        for p in range(90):
            if q % 2 == p % 2 and scores[q, p] >= 0.1:
                key = (None if q % 11 == 10 else f"b{q % 5}", f"p{p:04d}")
                want[key] = max(want.get(key, (-2, 0)), (round(scores[q, p], 9), q))
    best = {}
    for group, point, query, score, _ in got:
        best[group, point] = max(best.get((group, point), (-2, 0)), (round(score, 9), int(query[1:])))
    assert best == want
    most = len(want) if form == "broadcast" else 4 * len(want)
    assert len(got) <= most  # before: every pair over the threshold


@pytest.mark.parametrize("form", FORMS)
def test_limits_per_value(spark, form):
    v = vectors(90)
    points = points_of(spark, v)
    queries = points.select(F.col("point_id").alias("query_id"), "vector", F.col("tenant").alias("q_tenant"))
    hits = S.score_join(queries, points, threshold=0.0, k=2, per="batch", scope=("tenant",), payload=("batch",), **FORMS[form])
    rank = F.row_number().over(S.W.partitionBy("query_id", "batch").orderBy(F.desc("score"), "point_id"))
    got = {(r.query_id, r.batch, r.point_id) for r in hits.withColumn("rank", rank).where("rank <= 2").collect()}
    scores, want = unit(v) @ unit(v).T, set()
    for q in range(90):
        for b in range(5):
            mine = [p for p in range(90) if p % 2 == q % 2 and p % 5 == b and p % 11 != 10 and scores[q, p] >= 0]
            want |= {(f"p{q:04d}", f"b{b}", f"p{p:04d}") for p in sorted(mine, key=lambda p: (-round(scores[q, p], 9), p))[:2]}
    assert got == want


def test_small_tiles_stop_at_a_number(spark):
    points = points_of(spark, vectors(300))
    i_role, _ = S._pair_tiles(points, 3)
    assert i_role.select("i").distinct().count() == S.MOST_TILES  # before: 100 tiles, each vector shipped to all of them
    assert i_role.count() < 300 * S.MOST_TILES
    by_tenant, sizes = S._spread(points, ["tenant"], 3, "point_id", "tile", "tiles")
    assert {r.tiles for r in sizes.collect()} == {S.MOST_TILES}
    assert by_tenant.count() == 300


def test_rows_of_a_value_are_near(spark):
    points = points_of(spark, vectors(300)).where("batch is not null")
    tagged, sizes = S._spread(points, ["tenant"], 20, "point_id", "tile", "tiles", near="batch")
    per = tagged.groupBy("tenant", "batch").agg(F.count_distinct("tile").alias("n")).collect()
    assert sizes.first().tiles == 7 and max(r.n for r in per) <= 3
    full = tagged.groupBy("tenant", "tile").count().collect()
    assert len(full) == 14 and sum(r["count"] for r in full) == points.count()


def test_tiles_keep_numbers_of_rows(spark):
    """The best of a pair of tiles are kept as row numbers; payload is taken once, for what is told."""
    v = vectors(60)
    table = points_of(spark, v).toArrow()
    (q,) = S._Queries.per_dimension(table.rename_columns(["query_id", "vector", "tenant", "batch"]), (), -1.0, 3)
    schema = pa.schema([("query_id", pa.string()), ("point_id", pa.string()), ("batch", pa.string()), ("score", pa.float64())])
    out = S._Survivors(q, ["point_id", "batch"], schema, table)
    S._score_batch(q, out, table, (), False, False)
    assert all(isinstance(p[2], np.ndarray) for p in out.parts)
    rows = pa.Table.from_batches(list(out.drain())).to_pylist()
    best = np.argsort(-(unit(v) @ unit(v).T), axis=1, kind="stable")[:, :3]
    assert {(r["query_id"], r["point_id"]) for r in rows} == {(f"p{i:04d}", f"p{j:04d}") for i in range(60) for j in best[i]}


@pytest.mark.parametrize("tile_rows", [4, 500])
def test_stats_of_all_pairs_in_small_tiles(spark, tile_rows):
    v = vectors(120, dim=4)
    scores = (unit(v) @ unit(v).T)[np.triu_indices(120, 1)]
    got = S.similarity_stats(points_of(spark, v), tile_rows=tile_rows).first()
    want = (len(scores), scores.mean(), scores.std(), scores.min(), scores.max(), np.median(scores))
    assert tuple(got) == pytest.approx(want, abs=1e-6)


def test_hash_tables_make_few_rows_at_once(spark, monkeypatch):
    points = points_of(spark, vectors(200))
    want = {(r.id_a, r.id_b) for r in H.similar_pairs_lsh(points, 0.8).collect()}
    monkeypatch.setattr(H, "KEYED_ROWS", 20)
    monkeypatch.setattr(H, "_CODE_CELLS", 5)
    got = [(r.id_a, r.id_b) for r in H.similar_pairs_lsh(points, 0.8).collect()]
    assert set(got) == want and len(got) == len(want) > 0


@pytest.mark.parametrize("threshold", [None, 0.5])
def test_cells_take_any_number_of_queries(spark, monkeypatch, threshold):
    points, root = points_of(spark, vectors(200)), scratch_root(spark)
    cells.build(points, root, 12)
    queries = points.select(F.col("point_id").alias("query_id"), "vector", F.col("tenant").alias("q_tenant"))
    key = lambda df: {(r.query_id, r.rank, r.point_id, r.batch, round(r.score, 9)) for r in df.collect()}
    want = key(S.similarity_search(queries, points, 5, threshold, scope=("tenant",), payload=("batch",)))
    monkeypatch.setattr(S, "BROADCAST_QUERIES", 50)  # before: an error
    layout = cells.Layout(spark, root, points.schema)
    assert key(layout.search(queries, 5, threshold, scope=("tenant",), payload=("batch",))) == want
    assert layout.search(queries.limit(0), 5, threshold, scope=("tenant",)).count() == 0


def test_best_k_leave_wide_point_tiles_once_and_are_ranked_in_one_shuffle(spark):
    """More points than TILE_ROWS whose cells fit into one tile: each query's best k leave it once, and are not dealt out again by slices before they are ranked."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((S.TILE_ROWS + 3000, 4)).astype(np.float32)
    points = spark.createDataFrame(pa.table({"point_id": [f"p{i:06d}" for i in range(len(vectors))], "vector": pa.array(vectors.tolist(), pa.list_(pa.float32()))}))
    queries = spark.createDataFrame(pa.table({"query_id": [f"q{i:02d}" for i in range(30)], "vector": pa.array(vectors[:30].tolist(), pa.list_(pa.float32()))}))
    assert S.score_join(queries, points, k=5, broadcast_queries=0).count() == 30 * 5
    found = S.similarity_search(queries, points, 5, 0.5, broadcast_queries=0)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(query_id") == 1
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    scores = unit[:30] @ unit.T
    want = {(f"q{q:02d}", r + 1): f"p{p:06d}" for q in range(30) for r, p in enumerate(np.lexsort((np.arange(len(unit)), -scores[q]))[:5])}
    assert {(r.query_id, r["rank"]): r.point_id for r in found.collect()} == want


def mixed_points(spark):
    """Vectors of two dimensions, equal ones, one id twice, and some without a direction."""
    v = vectors(240)
    v[200:230] = v[7]
    rows = [(f"p{i:04d}", [float(x) for x in row]) for i, row in enumerate(v)] + [(f"s{i:04d}", [float(x) for x in row[:3]]) for i, row in enumerate(v[:60])]
    rows += [("p0003", [float(x) for x in v[3]]), ("zero", [0.0] * 6), ("none", None), ("empty", []), ("nan", [float("nan")] * 6)]
    return spark.createDataFrame(rows, "point_id string, vector array<float>").repartition(5)


@pytest.mark.parametrize("few", [0, 10**9])
@pytest.mark.parametrize("tiles", [1, 6])
def test_tiles_of_vectors_tell_the_pairs_of_the_hash_tables(spark, monkeypatch, few, tiles):
    points, made = mixed_points(spark), H.Tables(5, 4, 0.9)
    key = lambda df: sorted((r.id_a, r.id_b, round(r.score, 9)) for r in df.collect())
    monkeypatch.setattr(S, "pair_tiles", lambda n, cells, tile_rows: F.lit(10**6))  # so many that the buckets are shuffled
    want = H.similar_pairs_lsh(points, 0.6, made=made, tile_rows=50)
    assert "hashpartitioning(t#" in want._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(S, "pair_tiles", lambda n, cells, tile_rows: F.lit(tiles))
    monkeypatch.setattr(H, "_FEW_PAIRS", few)
    got = H.similar_pairs_lsh(points, 0.6, made=made, tile_rows=50)
    assert key(got) == key(want) and got.count() > 400


def test_many_hash_tables_ship_a_vector_once_per_tile(spark):
    """A low threshold asks for many tables: not every table gets its copy of each vector."""
    points = points_of(spark, vectors(600))
    found = H.similar_pairs_lsh(points, 0.35, recall=0.95, tile_rows=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(i#" in plan and "hashpartitioning(t#" not in plan
    scores = unit(vectors(600)) @ unit(vectors(600)).T
    exact = {(f"p{a:04d}", f"p{b:04d}") for a, b in zip(*np.nonzero(np.triu(scores > 0.35, 1)))}
    got = [(r.id_a, r.id_b) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) <= exact and len(got) >= 0.9 * len(exact)


def test_exact_pairs_of_tiles_ship_a_vector_once_per_tile(spark, monkeypatch):
    points = mixed_points(spark)
    want = sorted((r.id_a, r.id_b, round(r.score, 9)) for r in S.similar_pairs(points, 0.6).collect())
    monkeypatch.setattr(S, "_FLUSH_ROWS", 50)
    found = S.similar_pairs(points, 0.6, broadcast_queries=0, tile_rows=40)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(i#") == 1
    assert sorted((r.id_a, r.id_b, round(r.score, 9)) for r in found.collect()) == want and len(want) > 400


def test_wide_pair_tiles_are_bounded_by_cells(spark):
    tiles = lambda n, dim, rows=4096: spark.range(1).select(S.pair_tiles(F.lit(n), F.lit(n * dim), rows)).first()[0]
    assert [tiles(600_000, 64), tiles(600_000, 512), tiles(600_000, 1024), tiles(600_000, 10**6), tiles(0, 64)] == [37, 37, 74, 147, 1]
    assert [tiles(2000, 64, 200), tiles(50_000, 64, 200)] == [10, 16]
