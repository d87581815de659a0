"""Truth tables and edge cases of the pure rules."""

import hashlib
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecwatch import config as C, schemas
from vecwatch.functions import text, timing, vectors
from vecwatch.operators import batches as B, diversity, feeds, ordered, predicates as P, reports as R, watchlist as L
from vecwatch.sources import envelopes as E, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("counts,want", [
    ((3, 3, 0, 0), "completed"), ((3, 2, 1, 0), "completed"), ((3, 2, 0, 1), "completed_with_errors"), ((3, 0, 0, 3), "completed_with_errors"),
    ((3, 2, 0, 0), None), ((0, 0, 0, 0), "completed"), ((2, 3, 0, 0), "completed"), ((5, 1, 1, 1), None)])
def test_terminal_status(spark, counts, want):
    df = spark.createDataFrame([counts], "submitted int, embedded int, filtered int, failed int")
    assert B.terminal_status(df).first()["terminal_status"] == want


def test_point_id_is_uuid5(spark):
    name = str(uuid.uuid4())
    got = one(spark, text.index_point_id(F.lit(name), F.lit(7)))
    assert got == str(uuid.uuid5(uuid.UUID(C.INDEX_NAMESPACE), f"{name}_7"))


@pytest.mark.parametrize("name", ["Jane", "", "ñandú 日本"])
def test_name_hash(spark, name):
    assert one(spark, text.name_hash(F.lit(name))) == hashlib.sha256(name.encode()).hexdigest()[:16]
    assert one(spark, text.published_name_hash(F.lit(name))) == ("" if not name else hashlib.sha256(name.encode()).hexdigest()[:16])
    assert one(spark, text.published_name_hash(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("entities,want", [
    (None, (None, None, True)), ([], (None, None, True)), (["0"], ("[0]", ["0"], True)), (["5", "2", "2"], ("[2,5]", ["2", "5"], True)),
    (["10", "9"], ("[9,10]", ["9", "10"], True)), (["a"], (None, None, False)), (["1", None], (None, None, False))])
def test_entities(spark, entities, want):
    df = spark.createDataFrame([(entities,)], "e array<string>")
    row = df.select(text.entities_to_category(F.col("e")).alias("c")).first()["c"]
    assert (row["text"], row["ids"], row["valid"]) == want


@pytest.mark.parametrize("value,ok", [("{%s}", True), ("urn:uuid:%s", True), ("%s", True), ("x%s", False), ("", False)])
def test_uuid_spellings(spark, value, ok):
    u = str(uuid.uuid4())
    raw = value % u if "%s" in value else value
    assert one(spark, text.normalize_uuid(F.lit(raw.upper() if raw.startswith("{") else raw))) == (u if ok else None)


def test_vector_errors_and_exact_decode(spark):
    v = np.array([0.1, -3.4028235e38, 1e-45, 0.0], dtype="<f4")
    df = spark.createDataFrame([([float(x) for x in v],)], "v array<float>").withColumn("b", vectors.encode_vector("v"))
    back = df.select(vectors.decode_vector("b").alias("w"), vectors.vector_error(F.col("b"), F.lit(C.VECTOR_ENCODING), 4).alias("e")).first()
    assert np.array(back["w"], dtype="<f4").tobytes() == v.tobytes() and back["e"] is None
    bad = lambda b, enc=C.VECTOR_ENCODING: one(spark, vectors.vector_error(F.lit(b).cast("string"), F.lit(enc).cast("string"), 4))
    assert bad("AAAA") == "vector_b64 is not a whole number of float32" and bad(None) == "null vector_b64"
    assert bad("AAAAAA==") == "wrong vector dimension" and bad("AAAA", "f16") == "unknown vector_encoding" and bad("AAAA", None) == "unknown vector_encoding"
    assert bad("!!") == "vector_b64 is not base64"


def test_iso_and_stream_times(spark):
    at = lambda t: F.lit(t).cast("timestamp")
    assert one(spark, timing.iso_utc(at("2024-01-02 03:04:05"))) == "2024-01-02T03:04:05"
    assert one(spark, timing.iso_utc(at("2024-01-02 03:04:05.5"), z=True)) == "2024-01-02T03:04:05.500000Z"
    assert one(spark, timing.iso_utc(F.lit(None).cast("timestamp"))) is None
    assert one(spark, timing.stream_id_ms(F.lit("1700000000123-7"))) == 1700000000123


def test_weapon_modes():
    assert P.weapons_conditions(None) == P.weapons_conditions("all") == P.weapons_conditions("??") == {}
    assert P.weapons_conditions("only", []) == {"has_weapon": True}
    assert P.weapons_conditions("only", ("a",)) == {"has_weapon": True, "weapon_classes": ["a"]}
    assert P.weapons_conditions("exclude", ["a"]) == {"has_weapon": False}
    assert P.search_conditions({"user_id": "x", "source_type": "blacklist", "camera_id": "c"}) == {"camera_id": "c", "source_type": "evidence"}


def test_filter_ignores_nothing_and_matches_no_missing_field(spark):
    df = spark.createDataFrame([("a", ["1", "2"], None), ("b", None, "x")], "id string, category array<string>, cam string")
    pick = lambda **kw: [r["id"] for r in P.payload_filter(df, kw).collect()]
    assert pick(category="2") == ["a"] and pick(category=["9", "1"]) == ["a"] and pick(cam=["x"]) == ["b"] and pick(object_type="car") == [] and pick() == ["a", "b"]


@pytest.mark.parametrize("change,want", [
    ({}, None), ({"external_id": " "}, "missing external_id"), ({"items": None, "images": None}, "batch has no items"), ({"items": []}, "batch has no items"),
    ({"items": [("a", None, "http://x")] * 4}, "batch exceeds N_CAP=3 (got 4)"), ({"items": [("a", None, "http://x"), None]}, "item 1 is not an object"),
    ({"items": [(" ", None, "http://x")]}, "item 0 missing item_id/image_id"), ({"items": [("a", None, "ftp://x")]}, "item 0 has invalid image_url"),
    ({"items": [("a", None, None)]}, "item 0 has invalid image_url"), ({"items": None, "images": [(None, "b", " HTTPS://x ")]}, None),
    ({"items": [], "images": [(None, "b", "http://x")]}, "batch has no items")])
def test_submit_rules(spark, change, want):
    base = {"user_id": str(uuid.uuid4()), "client_batch_ref": "r", "external_id": "e", "source_ref": None, "metadata": None, "items": [("a", None, "http://x")], "images": None}
    df = spark.createDataFrame([tuple({**base, **change}.values())], schemas.SUBMIT)
    row = P.validate_submits(df, 3).first()
    assert row["bindable"] and row["error"] == want


def test_unbindable_submits(spark):
    for user, ref in (("x", "r"), (None, "r"), (str(uuid.uuid4()), "  "), (str(uuid.uuid4()), None)):
        df = spark.createDataFrame([(user, ref, "e", None, None, None, None)], schemas.SUBMIT)
        assert not P.validate_submits(df).first()["bindable"]


def entry(spark, **more):
    base = {"id": "e", "name": "n", "category": "c", "description": None, "status": 3, "active": True, "is_archived": False, "user_id": "u", "blacklist_version": 1,
            "match_threshold": 0.8, "json_data": None, "created_at": None, "updated_at": None}
    return spark.createDataFrame([tuple({**base, **more}.values())], schemas.ENTRIES)


@pytest.mark.parametrize("patches,version,threshold,active", [
    (['{"match_threshold":0.9}'], 2, 0.9, True), (['{"match_threshold":0.8}'], 1, 0.8, True), (['{"match_threshold":null}'], 2, None, True),
    (['{"name":"x"}'], 1, 0.8, True), (['{"active":false}', '{"active":true}'], 2, 0.8, True), (['{"active":true}'], 1, 0.8, True),
    (['{"active":false}', '{"active":true,"match_threshold":0.1}'], 2, 0.1, True), (['{"match_threshold":0.9}', '{"match_threshold":0.8}'], 3, 0.8, True),
    (['{"match_threshold":null}', '{"match_threshold":null}'], 2, None, True), (['{"active":null}'], 1, 0.8, True), (['{"active":false}'], 1, 0.8, False)])
@pytest.mark.parametrize("bucket", [1, 100])
def test_version_bumps(spark, patches, version, threshold, active, bucket):
    p = spark.createDataFrame([("e", i, t) for i, t in enumerate(patches)], "entry_id string, seq long, patch string")
    row = L.apply_patches(entry(spark), p, bucket_size=bucket).first()
    assert (row["blacklist_version"], row["match_threshold"], row["active"]) == (version, threshold, active)


def test_patch_null_clears_only_nullable_fields(spark):
    p = spark.createDataFrame([("e", 1, '{"name":null,"category":null,"json_data":{"a":1}}')], "entry_id string, seq long, patch string")
    row = L.apply_patches(entry(spark), p).first()
    assert (row["name"], row["category"], row["json_data"]) == ("n", None, '{"a":1}')


def greedy(hists, threshold, compare_all, top, least):
    kept, rejected = [], []
    for i, h in enumerate(hists):
        if len(kept) >= top:
            break
        rivals = [hists[k] for k in (kept if compare_all else kept[-1:])]
        dist = [np.sqrt(max(0, 1 - np.sqrt(h * r).sum() / np.sqrt(h.sum() * r.sum()))) for r in rivals]
        (kept if all(x >= threshold for x in dist) else rejected).append(i)
    while len(kept) < least and rejected:
        kept.append(rejected.pop(0))
    return sorted(kept)


@pytest.mark.parametrize("compare_all", [False, True])
@pytest.mark.parametrize("threshold,top,least", [(0.2, 10, 1), (0.35, 4, 1), (0.9, 10, 5), (0.25, 3, 3)])
@pytest.mark.parametrize("group_rows", [10_000, 3])
def test_diversity(spark, compare_all, threshold, top, least, group_rows):
    rng = np.random.default_rng(1)
    hists = rng.random((25, 8)) ** 3
    rows = [("g", i, 100, 100, [float(x) for x in h]) for i, h in enumerate(hists)] + [("g", 90, 40, 100, [1.0] * 8), ("g", 91, 60, 400, [1.0] * 8), ("s", 1, 60, 60, [1.0] * 8)]
    df = spark.createDataFrame(rows, "group_id string, pos int, width int, height int, hist array<double>").repartition(4)
    got = diversity.diversity_select(df, threshold=threshold, compare_all=compare_all, max_images=top, min_images=least, group_rows=group_rows).collect()
    assert sorted(r["pos"] for r in got if r["group_id"] == "g") == greedy(hists, threshold, compare_all, top, least)
    assert [r["pos"] for r in got if r["group_id"] == "s"] == [1]


def test_order_statistics_follow_the_index_rule(spark):
    values = [int(x) for x in np.random.default_rng(2).integers(-3000, 9000, 501)] + [7] * 300
    df = spark.createDataFrame([(v,) for v in values], "delta_ms long").repartition(6)
    row = R.latency_stats(df).first()
    s = sorted(values)
    at = lambda p: s[min(int(len(s) * p), len(s) - 1)]
    assert (row["n"], row["min"], row["p90"], row["p99"], row["max"]) == (801, s[0], at(0.9), at(0.99), s[-1])
    assert row["p50"] == int(np.median(s)) and row["avg"] == int(sum(s) / len(s))


def test_asof_equal_ids_pair_and_later_inputs_do_not(spark):
    ins = spark.createDataFrame([("a", "100-1"), ("a", "90-0"), ("b", "300-0"), ("c", "7000000-0"), ("d", "5-0")], "key string, stream_id string")
    outs = spark.createDataFrame([("a", "100-1"), ("b", "200-0"), ("c", "99000000-0"), ("c", "50-0"), ("d", "6-0")], "key string, stream_id string")
    for window in (None, 100):
        got = {r["key"]: r["delta_ms"] for r in R.asof_latency(ins, outs, input_window=window).collect()}
        assert got == {"a": 0, "b": None, "c": 92000000, "d": 1}
    got = {r["key"]: r["delta_ms"] for r in R.asof_latency(ins, outs, input_window=1).collect()}
    assert got == {"a": 0, "b": None, "c": 92000000, "d": 1}
    got = {r["key"]: r["in_ms"] for r in R.asof_latency(ins, outs, output_limit=1).collect()}
    assert got == {"c": 7000000}


def test_slowest_only_under_alarm(spark):
    df = spark.createDataFrame([("a", 10), ("b", 20), ("c", None)], "key string, delta_ms long")
    assert R.slowest(df, 2, 5000).count() == 0
    assert [r["key"] for r in R.slowest(df, 2, 15).collect()] == ["b", "a"]


def test_carry_last_over_empty_buckets(spark):
    rows = [("k", 1, "a"), ("k", 2, None), ("k", 55, None), ("k", 70, "b"), ("k", 71, None), ("j", 3, None)]
    df = spark.createDataFrame(rows, "key string, t int, v string")
    got = ordered.carry_last(df, ["key"], ["t"], F.floor(F.col("t") / 10), {"last": F.col("v")}, inclusive=False)
    assert {(r["key"], r["t"]): r["last"] for r in got.collect()} == {("k", 1): None, ("k", 2): "a", ("k", 55): "a", ("k", 70): "a", ("k", 71): "b", ("j", 3): None}


def test_broken_json_is_quarantined_and_missing_payload_is_empty(spark):
    df = spark.createDataFrame([("t", '{"batch_id":"b"', "1-0"), ("t", '{"batch_id":"b"}', "2-0"), ("t", None, "3-0"), ("t", "[1]", "4-0"), ("t", '{"batch_id":1}', "5-0")], schemas.ENVELOPE)
    parsed = E.parse(df, "t", schemas.COMPUTE_ERROR)
    good, dead = E.quarantine(parsed, F.col("p").isNull(), "s", F.lit("2024-01-01").cast("timestamp"))
    assert {r["stream_id"] for r in good.collect()} >= {"2-0", "3-0", "5-0"}
    assert "1-0" in {r["original_message_id"] for r in dead.collect()}


def test_match_feed_needs_matches(spark):
    s = spark.createDataFrame([("s1", 3, "evidence"), ("s2", 3, "evidence"), ("s3", 3, "image_index")], "id string, status int, search_type string").withColumns(
        {"user_id": F.lit("u"), "image_url": F.lit("i"), "total_matches": F.lit(1)})
    m = spark.createDataFrame([("m1", "s1"), ("m3", "s3")], "id string, search_request_id string").withColumns(
        {"evidence_id": F.lit("E"), "camera_id": F.lit(None).cast("string"), "similarity_score": F.lit(0.5), "image_url": F.lit("i"), "match_metadata": F.lit("{}")})
    events = feeds.search_match_events(s, m, F.lit("2024-01-01").cast("timestamp")).collect()
    assert len(events) == 1 and '"camera_id":null' in events[0]["payload"] and '"search_request_id":"s1"' in events[0]["payload"]


def test_table_log_versions(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path), "index_points")
    row = lambda pid, x: (pid, [x], "u", "e", "b", 0, "r", "s", "m")
    make = lambda *rows: spark.createDataFrame(list(rows), schemas.INDEX_POINTS)
    assert t.live().count() == 0 and t.current().count() == 0
    t.write_version(make(row("p", 1.0), row("q", 1.0)), 0, "w")
    t.write_version(make(row("p", 2.0)), 1, "w")
    t.write_version(make(row("p", 2.0)), 1, "w")
    state = lambda df: sorted((r["point_id"], r["vector"][0]) for r in df.collect())
    assert state(t.live()) == state(t.current()) == [("p", 2.0), ("q", 1.0)]
    assert state(t.current(1, "w")) == [("p", 1.0), ("q", 1.0)]
    assert state(t.compact_into(str(tmp_path / "new")).current()) == [("p", 2.0), ("q", 1.0)]
    tables.write_table(make(row("z", 1.0)), str(tmp_path / "n2"), "index_points")
    assert state(tables.read_table(spark, str(tmp_path / "n2"), "index_points")) == [("z", 1.0)]
