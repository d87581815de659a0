"""Exact top-k over a stored cell layout, reading only the cells that can still matter.

`build` deals the vectors to their nearest centre and writes them partitioned by cell, with a side table of every cell's centre, radius (largest angle to
the centre) and size. A query at angle a from a centre cannot reach a score above cos(a - radius) in that cell. `search` lets every query visit its best cells first, in
rounds of growing size, and stops it once its k-th score beats the bounds of all cells left. Cells nobody asks for are never read: a round's scan lists
its cells, which are partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sources.tables import durable
from . import similarity as S

CELLS = 256            # centres per dimension, at most
SAMPLE_ROWS = 16_384   # vectors that the centres are made from (smallest id hashes)
STEPS = 4              # rounds of moving the centres to their members' means
FILE_ROWS = 200_000    # rows of a cell per file, about
FIRST = 2              # cells a query visits in the first round; each round doubles them
SLACK = 1e-9


def centres_of(points: DataFrame, cells: int = CELLS) -> dict[int, np.ndarray]:
    """Unit centres per dimension: spherical k-means on a bounded sample. They only steer the layout; radii are measured over all vectors."""
    sample = points.select("vector", F.xxhash64("point_id").alias("h")).orderBy("h").limit(SAMPLE_ROWS).drop("h").toArrow()
    out = {}
    for dim in S._dimensions(sample.column("vector")):
        x, _ = S._matrix(sample.column("vector"), dim)
        if not len(x):
            continue
        n = max(1, min(cells, int(len(x) ** 0.5)))
        centre = x[np.random.default_rng(len(x)).choice(len(x), n, replace=False)]
        for _ in range(STEPS):
            home = (x @ centre.T).argmax(axis=1)
            total = np.zeros_like(centre)
            np.add.at(total, home, x)
            size = np.linalg.norm(total, axis=1, keepdims=True)
            centre = np.where(size > 0, total / np.where(size > 0, size, 1), centre)
        out[dim] = centre
    return out


def build(points: DataFrame, root: str, cells: int = CELLS) -> None:
    """Write the layout of `points` (point_id, vector and any payload) under `root`: `points` by cell, and `cells`. Vectors without a direction are in no cell."""
    spark, made = points.sparkSession, centres_of(points, cells)
    shipped = spark.sparkContext.broadcast(made)
    start = np.cumsum([0, *[len(made[d]) for d in sorted(made)]])
    first = {d: int(start[i]) for i, d in enumerate(sorted(made))}
    none = int(start[-1])  # dimensions that the sample did not meet share one cell each, without bound

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in S._dimensions(batch.column("vector")):
                matrix, rows = S._matrix(batch.column("vector"), dim)
                if not len(rows):
                    continue
                kept = batch.take(pa.array(rows))
                if dim in shipped.value:
                    scores = matrix @ shipped.value[dim].T
                    cell, angle = scores.argmax(axis=1) + first[dim], np.arccos(np.clip(scores.max(axis=1), -1, 1))
                else:
                    cell, angle = np.full(len(rows), none + dim), np.full(len(rows), np.pi)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell.astype(np.int32)), pa.array(angle), pa.array(np.full(len(rows), dim, np.int32))], names=[*kept.schema.names, "cell", "angle", "dim"])

    schema = T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("dim", T.IntegerType())])
    homes = points.mapInArrow(home, schema)
    sizes = homes.select("cell", "dim", "angle").groupBy("cell", "dim").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # one row per cell
    rows = [(r["cell"], r["dim"], r["radius"], r["n"], made[r["dim"]][r["cell"] - first[r["dim"]]].tolist() if r["dim"] in made else None) for r in sizes]
    table = spark.createDataFrame(rows, "cell int, dim int, radius double, n long, centre array<double>")
    table.coalesce(1).write.mode("overwrite").parquet(f"{root}/cells")
    # a large cell is dealt to several tasks, so that no cell is written by one
    slices = F.broadcast(table.select("cell", F.ceil(F.col("n") / FILE_ROWS).cast("int").alias("slices")))
    dealt = homes.drop("angle", "dim").join(slices, "cell").withColumn("slice", F.pmod(F.xxhash64("point_id"), F.col("slices")))
    dealt = dealt.repartition("cell", "slice").select(*points.columns, "cell")
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{root}/points")


def bounds_of(cells: dict, matrix: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The cells of a dimension and the best score that each query could find in each."""
    dim = matrix.shape[1]
    own = [c for c, r in cells.items() if r["dim"] == dim]
    if not own:
        return own, np.zeros((len(matrix), 0))
    radius = np.array([cells[c]["radius"] for c in own])
    if cells[own[0]]["centre"] is None:
        return own, np.ones((len(matrix), len(own)))
    angle = np.arccos(np.clip(matrix @ np.array([cells[c]["centre"] for c in own]).T, -1, 1))
    return own, np.cos(np.clip(angle - radius, 0, np.pi)) + SLACK


class Layout:
    """A stored layout, and what its last search read."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root = spark, root
        self.schema = T.StructType([*schema.fields, T.StructField("cell", T.IntegerType())])
        table = spark.read.schema("cell int, dim int, radius double, n long, centre array<double>").parquet(f"{root}/cells").orderBy("cell").collect()  # one row per cell
        self.cells = {r["cell"]: r for r in table}
        self.rounds: list[list[int]] = []

    def bounds(self, matrix: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The cells of a dimension and the best score that each query could find in each."""
        return bounds_of(self.cells, matrix)

    def search(self, queries: DataFrame, k: int, threshold: float | None = None, *, scope: Sequence[str] = (), payload: Sequence[str] = (), predicate=None) -> DataFrame:
        """Per query the best k points with cosine >= threshold (all without one), ties by id: rows as `similarity_search` gives them.

        Up to BROADCAST_QUERIES queries are shipped to the cells they visit; more of them meet the cells in tiles. Equality on `scope` and `predicate` cut the rows of a cell.
        """
        table = S._bounded_rows(queries.select("query_id", "vector", *[f"q_{s}" for s in scope]), S.BROADCAST_QUERIES)
        if table is None or table.num_rows * k > S.SURVIVOR_ROWS:
            return self._search_many(queries, k, threshold, scope, payload, predicate)
        names = list(dict.fromkeys(["point_id", *payload]))
        schema = T.StructType([queries.schema["query_id"], *[self.schema[c] for c in names], T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
        best = self.spark.createDataFrame([], schema)
        floors = np.full(table.num_rows, -np.inf if threshold is None else threshold)
        bounds, numbers = {}, {}
        for dim in S._dimensions(table.column("vector")):
            matrix, rows = S._matrix(table.column("vector"), dim)
            own, bound = self.bounds(matrix)
            order = np.argsort(-bound, axis=1)
            numbers[dim] = rows
            bounds[dim] = (np.array(own, np.int64), np.take_along_axis(bound, order, axis=1), order)
        self.rounds, done, step = [], 0, FIRST
        while True:
            visits: dict[int, list[int]] = {}
            for dim, (own, bound, order) in bounds.items():
                for at, row in enumerate(numbers[dim]):
                    for c in range(done, min(done + step, len(own))):
                        if bound[at, c] < floors[row]:
                            break
                        visits.setdefault(int(own[order[at, c]]), []).append(int(row))
            if not visits:
                if all(done + step >= len(own) for own, _, _ in bounds.values()) or all((bound[:, done:] < floors[numbers[d]][:, None]).all() for d, (_, bound, _) in bounds.items()):
                    break
            else:
                self.rounds.append(sorted(visits))
                found = self._visited(table, visits, floors, k, schema, scope, names, predicate)
                # at most k rows per query: bounded, kept on the driver between rounds
                best = self.spark.createDataFrame(S.best_per_query(best.drop("rank").unionByName(found), k).select(*schema.fieldNames()).toArrow(), schema)
                at = {q: i for i, q in enumerate(table.column("query_id").to_pylist())}
                for r in best.where(F.col("rank") == k).select("query_id", "score").toArrow().to_pylist():
                    floors[at[r["query_id"]]] = max(floors[at[r["query_id"]]], r["score"])
            done, step = done + step, step * 2
            if all(done >= len(own) for own, _, _ in bounds.values()):
                break
        return best

    def _search_many(self, queries: DataFrame, k: int, threshold: float | None, scope: Sequence[str], payload: Sequence[str], predicate) -> DataFrame:
        """The same rounds for any number of queries: a round's visits are rows, which meet the points by cell, and its results are stored."""
        queries = queries.select("query_id", "vector", *[f"q_{s}" for s in scope])
        names = list(dict.fromkeys(["point_id", *payload]))
        shipped = self.spark.sparkContext.broadcast(self.cells)
        base = -np.inf if threshold is None else threshold

        def visits_of(done: int, step: int):
            def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    floors = batch.column("floor").fill_null(base).to_numpy(zero_copy_only=False)
                    for dim in S._dimensions(batch.column("vector")):
                        matrix, rows = S._matrix(batch.column("vector"), dim)
                        own, bound = bounds_of(shipped.value, matrix)
                        order = np.argsort(-bound, axis=1)[:, done:done + step]
                        row, at = np.nonzero(np.take_along_axis(bound, order, axis=1) >= floors[rows][:, None])
                        taken = pa.array(rows[row])
                        yield pa.RecordBatch.from_arrays(
                            [*(c.take(taken) for c in batch.columns[:-1]), pa.array(floors[rows[row]]), pa.array(np.array(own, np.int32)[order[row, at]])],
                            names=[*batch.schema.names[:-1], "q_threshold", "q_cell"])
            return visit

        visited = T.StructType([*queries.schema.fields, T.StructField("q_threshold", T.DoubleType()), T.StructField("q_cell", T.IntegerType())])
        floors, best = self.spark.createDataFrame([], T.StructType([queries.schema["query_id"], T.StructField("floor", T.DoubleType())])), None
        most = max((sum(1 for r in self.cells.values() if r["dim"] == dim) for dim in {r["dim"] for r in self.cells.values()}), default=0)
        self.rounds, done, step = [], 0, FIRST
        while best is None or done < most:
            visits = queries.join(floors, "query_id", "left").select(*queries.columns, "floor").mapInArrow(visits_of(done, step), visited)
            read = sorted(r["q_cell"] for r in visits.select("q_cell").distinct().collect())  # one row per cell
            if not read and best is not None:
                break
            self.rounds.append(read)
            rows = self.spark.read.schema(self.schema).parquet(f"{self.root}/points").where(F.col("cell").isin(*read) if read else F.lit(False))
            rows = rows if predicate is None else rows.where(predicate)
            found = S.score_join(visits, rows, k=k, scope=("cell", *scope), payload=names, broadcast_queries=0)
            if best is not None:
                found = best.drop("rank").unionByName(found)
            best = durable(S.best_per_query(found, k).select("query_id", *names, "score", "rank"))
            floors = best.where(F.col("rank") == k).groupBy("query_id").agg(F.max("score").alias("floor"))
            done, step = done + step, step * 2
        return best

    def _visited(self, table: pa.Table, visits: dict[int, list[int]], floors: np.ndarray, k: int, schema: T.StructType, scope, names, predicate) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(f"{self.root}/points").where(F.col("cell").isin(*visits))
        if predicate is not None:
            rows = rows.where(predicate)
        hits = T.StructType([f for f in schema.fields if f.name != "rank"])
        arrow = S._arrow_schema(hits)
        shipped = self.spark.sparkContext.broadcast((table.append_column("q_threshold", pa.array(floors)), visits))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, visits = shipped.value
            outs: dict = {}
            for batch in batches:
                whole = pa.Table.from_batches([batch])
                for (cell,), own in S._by_scope(whole, ["cell"]):
                    if cell not in outs:
                        mine = asked.take(pa.array(visits[int(cell)]))
                        outs[cell] = [(q, S._Survivors(q, names, arrow)) for q in S._Queries.per_dimension(mine, scope, None, k)]
                    part = whole.take(pa.array(own))
                    for q, out in outs[cell]:
                        S._score_batch(q, out, part.drop(["cell"]), scope, False, False)
            for made in outs.values():
                for _, out in made:
                    yield from out.drain()

        return rows.select("vector", "cell", *dict.fromkeys([*names, *scope])).mapInArrow(scan, hits)
