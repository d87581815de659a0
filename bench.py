"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every query runs once untimed, so that code generation and Python workers are warm, and then three times into a
sink that reads all rows and columns; the median counts. The physical forms of the vector joins at 512 dimensions are timed beside the headline and are not in its total.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from vecwatch.operators import hashed_pairs, similarity as S
from vecwatch.plans import catalog
from vecwatch.session import session

HEADLINE = (
    "cosine_topk_join", "neighbour_lists", "similar_pairs", "pair_similarity_stats", "inline_watchlist_match", "reverse_watchlist_match",
    "cross_reference", "many_filtered_searches", "land_results_batches", "upsert_results_last_wins", "batch_terminal_status",
    "submit_batches_state", "search_match_feed", "warehouse_landing", "asof_latency", "phase_latency", "daily_coverage", "version_bumps",
    "ingest_frames", "weapons_detected_events", "diversity_selection",
)


def forms(spark, folder):
    """The stored vectors widened to 512 cells, in every form of the joins."""
    wide = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.transform("embedding", lambda x: x * F.cos(x * k))))
    points = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("point_id"), wide.cast("array<float>").alias("vector"), F.col("label").cast("string").alias("user_id"))
    asked = points.select(F.col("point_id").alias("query_id"), "vector", F.col("user_id").alias("q_user_id"))
    return {
        "topk_512_broadcast": lambda: S.similarity_search(asked, points, 10, 0.2, scope=("user_id",)),
        "topk_512_tiled": lambda: S.similarity_search(asked, points, 10, 0.2, scope=("user_id",), broadcast_queries=0, tile_rows=512),
        "topk_512_shipped": lambda: S.similarity_search(asked, points.where("cast(point_id as int) % 4 = 0"), 10, 0.2, scope=("user_id",), broadcast_queries=600),
        "pairs_512_tiled": lambda: S.similar_pairs(points, 0.3, broadcast_queries=0, tile_rows=512),
        "pairs_512_pivots": lambda: S.similar_pairs(points, 0.3, broadcast_queries=0, tile_rows=512, pivots=16),
        "pairs_512_hashed": lambda: hashed_pairs.similar_pairs_lsh(points, 0.3, recall=0.9),
    }


def timed(make) -> float:
    """Median of three runs after an untimed one."""
    times = []
    for _ in range(4):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times[1:]), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    times = {name: timed(lambda: queries[name](spark, folder)) for name in HEADLINE}
    total = round(sum(times.values()), 3)
    times |= {name: timed(make) for name, make in forms(spark, folder).items()}
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
