"""The similarity joins against brute force, in every physical form, on planted and awkward data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecwatch.operators import predicates as P, similarity as S

FORMS = {"broadcast": {}, "tiled": {"broadcast_queries": 0, "tile_rows": 16}, "one_tile": {"broadcast_queries": 0}}


def planted(n=120, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    for i in range(0, n, 4):
        base[i] = base[0] + 0.05 * rng.normal(size=dim)  # a quarter are near-copies of one vector
    base[7] = base[11] = base[15]
    return base.astype(np.float32)


def frame(spark, vectors, tenants=None):
    tenants = tenants or ["t0" if i % 3 else "t1" for i in range(len(vectors))]
    rows = [(f"p{i:04d}", [float(x) for x in v], t) for i, (v, t) in enumerate(zip(vectors, tenants))]
    return spark.createDataFrame(rows, "point_id string, vector array<float>, tenant string").repartition(5)


def cosines(v):
    v = v.astype(np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return u @ u.T


def ids(n):
    return [f"p{i:04d}" for i in range(n)]


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("scoped", [False, True])
def test_topk_equals_brute_force(spark, form, scoped):
    v = planted()
    df = frame(spark, v)
    queries = df.select(F.col("point_id").alias("query_id"), "vector", F.col("tenant").alias("q_tenant"))
    got = S.similarity_search(queries, df, 5, 0.3, scope=("tenant",) if scoped else (), **FORMS[form])
    have = {(r["query_id"], r["rank"]): (r["point_id"], round(r["score"], 9)) for r in got.collect()}
    c, names = cosines(v), ids(len(v))
    want = {}
    for i in range(len(v)):
        pool = [j for j in range(len(v)) if round(c[i, j], 12) >= 0.3 and (not scoped or (i % 3 == 0) == (j % 3 == 0))]
        for rank, j in enumerate(sorted(pool, key=lambda j: (-round(c[i, j], 12), names[j]))[:5], 1):
            want[names[i], rank] = round(c[i, j], 9)
    assert {k: s for k, (_, s) in have.items()} == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("threshold", [0.2, 0.6, 0.85, 0.99])
@pytest.mark.parametrize("form", [{}, {"broadcast_queries": 0, "tile_rows": 16, "pivots": 0}, {"broadcast_queries": 0, "tile_rows": 16, "pivots": 6}, {"broadcast_queries": 0, "pivots": 300}])
def test_pairs_equal_brute_force(spark, threshold, form):
    v = planted()
    c, names = cosines(v), ids(len(v))
    want = sorted((names[i], names[j]) for i in range(len(v)) for j in range(i + 1, len(v)) if c[i, j] > threshold)
    got = S.similar_pairs(frame(spark, v), threshold, **form).collect()
    assert sorted((r["id_a"], r["id_b"]) for r in got) == want


@pytest.mark.parametrize("n", [2, 40, 41])
def test_pair_stats(spark, n):
    v = planted()[:n]
    upper = cosines(v)[np.triu_indices(n, 1)]
    row = S.similarity_stats(frame(spark, v), tile_rows=13).first()
    want = (len(upper), upper.mean(), upper.std(), upper.min(), upper.max(), np.median(upper))
    assert tuple(row) == pytest.approx(want, abs=1e-8)


def test_pair_stats_of_nothing(spark):
    assert tuple(S.similarity_stats(frame(spark, planted()[:1])).first()) == (0, None, None, None, None, None)


@pytest.mark.parametrize("form", FORMS)
def test_awkward_vectors_match_nothing(spark, form):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("zero", [0.0, 0.0]), ("nan", [nan, 1.0]), ("inf", [inf, 1.0]), ("empty", []), ("null", None), ("hole", [1.0, None]), ("b", [1.0, 0.01])]
    df = spark.createDataFrame(rows, "point_id string, vector array<float>")
    got = S.similarity_search(df.withColumnRenamed("point_id", "query_id"), df, 9, -1.0, **FORMS[form]).collect()
    assert sorted((r["query_id"], r["point_id"]) for r in got) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")]
    assert sorted(r["point_id"] for r in P.valid_vectors(df).collect()) == ["a", "b"]


@pytest.mark.parametrize("form", FORMS)
def test_equal_scores_rank_by_id_and_limits_are_per_query(spark, form):
    rows = [(f"p{i}", [1.0, 0.0]) for i in (3, 1, 2, 5, 4)]
    df = spark.createDataFrame(rows, "point_id string, vector array<float>")
    queries = spark.createDataFrame([("q1", [2.0, 0.0], 2, 0.5), ("q2", [1.0, 0.0], 3, None), ("q3", [0.0, 1.0], 9, None)],
                                    "query_id string, vector array<float>, q_limit int, q_threshold double")
    got = S.similarity_search(queries, df, 9, 0.9, **FORMS[form]).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["point_id"]) for r in got] == [("q1", "p1"), ("q1", "p2"), ("q2", "p1"), ("q2", "p2"), ("q2", "p3")]


def test_one_tenant_with_most_rows_is_split(spark):
    v = planted(200)
    tenants = ["hot" if i % 5 else f"t{i}" for i in range(200)]
    df = frame(spark, v, tenants)
    queries = df.select(F.col("point_id").alias("query_id"), "vector", F.col("tenant").alias("q_tenant"))
    plain = S.score_join(queries, df, threshold=0.4, scope=("tenant",))
    tiled = S.score_join(queries, df, threshold=0.4, scope=("tenant",), broadcast_queries=0, tile_rows=10)
    key = lambda d: sorted((r["query_id"], r["point_id"], round(r["score"], 9)) for r in d.collect())
    assert key(plain) == key(tiled)


def test_many_queries_against_few_points_ship_the_points(spark):
    v = planted()
    df = frame(spark, v).withColumn("note", F.concat(F.lit("n-"), "point_id"))
    few = df.where("point_id < 'p0020'")
    queries = df.select(F.col("point_id").alias("query_id"), "vector", F.col("tenant").alias("q_tenant"))
    shipped = S.score_join(queries, few, threshold=0.4, scope=("tenant",), payload=("note",), broadcast_queries=50)
    direct = S.score_join(queries, few, threshold=0.4, scope=("tenant",), payload=("note",))
    key = lambda d: sorted((r["query_id"], r["point_id"], r["note"], round(r["score"], 9)) for r in d.collect())
    assert key(shipped) == key(direct) and "n-p0000" in {r["note"] for r in shipped.collect()}


def test_foreign_rows_never_appear(spark):
    v = planted(30)
    index = frame(spark, v).select("point_id", "vector", F.col("tenant").alias("user_id"), F.lit("x1").alias("external_id"), F.lit("b1").alias("batch_id"),
                                   F.lit(1).alias("item_index"), F.lit("").alias("item_ref"), F.lit("u").alias("source_url"), F.lit("m").alias("model_version"))
    ask = lambda tenant, ext: spark.createDataFrame([("q", [float(x) for x in v[0]], tenant, ext)], "query_id string, vector array<float>, q_user_id string, q_external_ids array<string>")
    assert S.index_search(ask("t9", ["x1"]), index, 50, -1.0).count() == 0
    assert S.index_search(ask("t1", ["x2"]), index, 50, -1.0).count() == 0
    own = S.index_search(ask("t1", []), index, 50, -1.0)
    assert own.count() == 10 and {r["user_id"] for r in own.collect()} == {"t1"}
    best = own.where("rank = 1").first()
    assert best["point_id"] == "p0000" and best["score"] == pytest.approx(1.0)


def test_a_plan_with_bounded_queries_does_not_shuffle_points(spark):
    df = frame(spark, planted())
    text = S.score_join(df.select(F.col("point_id").alias("query_id"), "vector"), spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("point_id"), F.col("embedding").alias("vector")), threshold=0.5, k=3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("kept", [1, 7, 200])
def test_large_limits_leave_the_broadcast_form(spark, monkeypatch, kept):
    df = frame(spark, planted())
    queries = df.select(F.col("point_id").alias("query_id"), "vector", F.lit(6).alias("q_limit"))
    want = {tuple(r) for r in S.similarity_search(queries, df, 3, 0.2).select("query_id", "rank", F.round("score", 9)).collect()}
    monkeypatch.setattr(S, "SURVIVOR_ROWS", kept)
    got = {tuple(r) for r in S.similarity_search(queries, df, 3, 0.2).select("query_id", "rank", F.round("score", 9)).collect()}
    assert got == want and max(r[1] for r in got) == 6


@pytest.mark.parametrize("parts", [1, 5])
def test_other_dimensions_and_empty_limits_do_not_change_hits(spark, parts):
    """Points of another dimension, even when they are the most, never hide points of the query's; a limit of 0 asks for nothing."""
    points = [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), *[(f"w{i}", [1.0, 0.0, 0.0]) for i in range(9)]]
    points = spark.createDataFrame(points, "point_id string, vector array<float>").repartition(parts)
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    assert sorted(r.point_id for r in S.similarity_search(queries, points, k=5, threshold=0.5).collect()) == ["a", "b"]
    assert S.similarity_search(queries, points, k=0, threshold=0.5).count() == 0
