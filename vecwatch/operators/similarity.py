"""Cosine joins between two vector tables.

Scoring is exact. The score of every surviving pair is computed in float64 by
numpy on Arrow batches, and only rows that pass the threshold and the local
top-k leave a task; pairs are never materialised as rows.

Physical forms, chosen by counted bounds:

* bounded queries: the query matrix is broadcast and the point table is scored
  in place, so the large side is neither shuffled nor sorted; the scope values
  and filters that all queries share are pushed into its scan;
* bounded points and many queries: the points are shipped, each query is ranked in place;
* anything larger: both sides are cut into tiles per scope value (tenant), a
  tile holding at most TILE_ROWS vectors. A hot tenant only gets more tiles.
  Tiles meet through a cogroup on (scope, query tile, point tile). Every vector is
  shipped to each tile of the other side, so smaller tiles that a caller asks for
  are used up to MOST_TILES of them and grow beyond. Where the best k are kept, each
  point tile sends its own best k of every query on, so points then stand in tiles
  of as many vectors as fill BROADCAST_VALUES.

Vectors of one dimension meet only vectors of the same; a table may mix dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

BROADCAST_QUERIES = 8192       # most query rows that may be broadcast
BROADCAST_VALUES = 8_388_608   # most query vector elements that may be broadcast (64 MB)
TILE_ROWS = 16_384             # most vectors of one side in one tile
PAIR_TILE_ROWS = 4096          # the same where every passing pair is a result row and a pair of tiles returns them at once
WIDE_PAIR_ROWS = 16_384        # the same where they leave the task bit by bit
BEST_TILE_ROWS = 4096          # most queries of one tile where the best are kept per query and value
MOST_TILES = 16                # tiles of one scope value up to which a smaller tile size is followed
PUSHED_VALUES = 1000           # most values of a scope or filter that are pushed into the point scan as a list
SCOPE_ROWS = 200_000           # most scope values whose tile counts may be broadcast
RANK_SALTS = 32                # first ranking stage: slices per query
_PROBE_BYTES = 1 << 30         # estimated plan size from which a bound is probed before rows are fetched
_BLOCK_CELLS = 1_000_000       # scores held at once inside a task
_FLUSH_ROWS = 100_000          # survivors buffered inside a task
SURVIVOR_ROWS = 2_000_000      # most rows a task may have to keep as the best k of its queries
TILE_SURVIVORS = 800_000       # the same for a pair of tiles, whose rows leave it at once
SPREAD_SURVIVORS = 200_000     # the same while a scope value's queries make no more than MOST_TILES tiles

# Optional per-query payload filters: any-of or equality on the field behind "f_", and the two weapons columns.
FIELD_FILTERS = ("f_camera_id", "f_object_type", "f_category", "f_external_id")
FILTER_FIELDS = (*FIELD_FILTERS, "f_weapons_filter", "f_weapon_classes")


# ---------------------------------------------------------------------------
# Scoring inside a task
# ---------------------------------------------------------------------------
def _flat(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _dimensions(column) -> list[int]:
    """The vector lengths that occur, without 0 and null."""
    sizes = pc.fill_null(pc.list_value_length(_flat(column)), 0).to_numpy(zero_copy_only=False)
    return np.unique(sizes[sizes > 0]).tolist()


def _matrix(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-normalised float64 matrix of the usable vectors of a dimension, and their row numbers.

    A vector is usable when it has elements, all finite, and a positive length.
    """
    array = _flat(column)
    sizes = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    if not dim or not len(rows):
        return np.empty((0, dim)), np.empty(0, dtype=np.int64)
    if len(rows) != len(sizes):
        array = array.take(pa.array(rows))
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(rows), dim)
    with np.errstate(all="ignore"):
        norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    good = np.isfinite(norms) & (norms > 0)
    return matrix[good] / norms[good, None], rows[good]


def _by_scope(table, names: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(scope values, row numbers) groups of a table; rows with a null scope value are in none.

    Values are told apart by dictionary codes, so Python touches distinct values only.
    """
    if not names:
        yield (), np.arange(table.num_rows)
        return
    codes, values = np.zeros(table.num_rows, dtype=np.int64), []
    missing = np.zeros(table.num_rows, dtype=bool)
    for name in names:
        column = table.column(name)
        column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.string()).dictionary_encode()
        index = column.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing |= index < 0
        values.append(column.dictionary.to_pylist())
        codes = codes * max(1, len(values[-1])) + index
    rows = np.flatnonzero(~missing)
    rows = rows[np.argsort(codes[rows], kind="stable")]
    for part in np.split(rows, np.flatnonzero(np.diff(codes[rows])) + 1) if len(rows) else ():
        code, key = int(codes[part[0]]), []
        for known in reversed(values):
            code, at = divmod(code, max(1, len(known)))
            key.append(known[at])
        yield tuple(reversed(key)), part


def _codes(column) -> np.ndarray:
    """Numbers that tell the values of a column apart; null is a value."""
    return _flat(column).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _id_rank(column) -> np.ndarray:
    """Numbers in the order of the ids, equal for equal ones; null comes first."""
    return pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and the run of every position."""
    starts = np.r_[0, np.flatnonzero(np.diff(values)) + 1]
    return starts, np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(values)]))


@dataclass
class _Queries:
    ids: pa.Array
    matrix: np.ndarray
    threshold: np.ndarray
    limit: np.ndarray | None
    groups: dict            # scope values -> (query numbers, their vectors as columns)
    filters: dict | None    # scope values -> [(filter, positions inside the group)], None when queries carry none
    best: dict | None       # scope values -> (start of every q_best group, its number per query), None when queries carry none

    @classmethod
    def per_dimension(cls, table: pa.Table, scope: Sequence[str], threshold: float | None, k: int | None) -> list["_Queries"]:
        made = [cls.of(table, dim, scope, threshold, k) for dim in _dimensions(table.column("vector"))]
        return [q for q in made if len(q.matrix)]

    @classmethod
    def of(cls, table: pa.Table, dim: int, scope: Sequence[str], threshold: float | None, k: int | None) -> "_Queries":
        matrix, rows = _matrix(table.column("vector"), dim)
        table = table.take(pa.array(rows))
        names = table.column_names
        n = table.num_rows
        floor = -np.inf if threshold is None else threshold
        if "q_threshold" in names:
            given = table.column("q_threshold").to_numpy(zero_copy_only=False).astype(float)
            limits = np.where(np.isnan(given), floor, given)
        else:
            limits = np.full(n, floor)
        if "q_limit" in names:
            k_each = np.array([k if v is None else v for v in table.column("q_limit").to_pylist()], dtype=np.int64)
        else:
            k_each = None if k is None else np.full(n, k, dtype=np.int64)
        members = dict(_by_scope(table, [f"q_{s}" for s in scope]))
        best = None
        if "q_best" in names:  # the queries of a group stand together, the first to be told first
            code, order = _codes(table.column("q_best")), [("query_id", "ascending")]
            if "q_order" in names:
                order.insert(0, ("q_order", "ascending"))
            told = pc.sort_indices(table.select([n for n, _ in order]), sort_keys=order, null_placement="at_start").to_numpy()
            place = np.empty(n, dtype=np.int64)
            place[told] = np.arange(n)
            members = {key: rows[np.lexsort((place[rows], code[rows]))] for key, rows in members.items()}
            best = {key: _runs(code[rows]) for key, rows in members.items()}
        groups = {key: (rows, np.ascontiguousarray(matrix[rows].T)) for key, rows in members.items()}
        filters = None
        asked = [f for f in FILTER_FIELDS if f in names]
        if asked:
            listed = lambda v: tuple(v) if isinstance(v, list) else v
            specs = [tuple((f, listed(v)) for f, v in zip(asked, row) if v is not None) for row in zip(*(table.column(f).to_pylist() for f in asked))]
            filters = {}
            for key, rows in members.items():
                per: dict = {}
                for at, row in enumerate(rows):
                    per.setdefault(specs[row], []).append(at)
                filters[key] = [(spec, np.array(at)) for spec, at in per.items()]
        return cls(table.column("query_id").combine_chunks(), matrix, limits, k_each, groups, filters, best)


def _any_of(column, wanted) -> np.ndarray:
    """Scalar column: value in `wanted`. List column: at least one element in `wanted`."""
    values = pa.array(list(wanted), pa.string())
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        out = np.zeros(len(array), dtype=bool)
        hit = pc.is_in(array.flatten(), value_set=values).to_numpy(zero_copy_only=False)
        out[pc.list_parent_indices(array).to_numpy(zero_copy_only=False)[hit]] = True
        return out
    return pc.fill_null(pc.is_in(column, value_set=values), False).to_numpy(zero_copy_only=False)


def _filter_mask(table, spec) -> np.ndarray:
    """Rows of a point batch that one query's metadata filter lets through. A missing field never matches."""
    asked = dict(spec)
    mask = np.ones(table.num_rows, dtype=bool)
    for name in FIELD_FILTERS:
        if name not in asked:
            continue
        field, value = name[2:], asked[name]
        if field not in table.schema.names:
            return np.zeros(table.num_rows, dtype=bool)
        mask &= _any_of(table.column(field), value if isinstance(value, tuple) else (value,))
    flag = lambda name, want: pc.fill_null(pc.equal(table.column(name), want), False).to_numpy(zero_copy_only=False)
    mode = asked.get("f_weapons_filter")
    if mode == "only":
        mask &= flag("has_weapon", True)
        if asked.get("f_weapon_classes"):
            mask &= _any_of(table.column("weapon_classes"), asked["f_weapon_classes"])
    elif mode == "exclude":
        mask &= flag("has_weapon", False)
    elif mode == "analyzed_clean":
        mask &= flag("weapon_analyzed", True) & flag("has_weapon", False)
    return mask


class _Survivors:
    """Rows that can still be in the answer, kept to the best k per query (and value of a column) while batches go by.

    With `held`, a table that stays at hand, its rows are kept as numbers and taken from it in the end.
    """

    def __init__(self, queries: _Queries, payload: Sequence[str], schema: pa.Schema, held: pa.Table | None = None):
        self.q, self.payload, self.schema, self.held = queries, payload, schema, held
        self.floor = queries.threshold.copy()
        self.budget = _FLUSH_ROWS if queries.limit is None else max(_FLUSH_ROWS, 2 * int(queries.limit.sum()))
        if held is not None:
            self.budget = min(self.budget, max(TILE_SURVIVORS, 2 * int(queries.limit.sum())))
            self.id_rank = _id_rank(held.column("point_id"))
        self.values: dict = {}
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, qi: np.ndarray, scores: np.ndarray, rows, value: tuple = ()) -> None:
        """`rows` of the points as a table, or as numbers of rows held; `value` is what the rows' queries are limited by besides."""
        code = self.values.setdefault(value, len(self.values))
        self.parts.append((qi.astype(np.int32), scores, rows, np.full(len(qi), code, np.int32)))
        self.rows += len(qi)

    def _merge(self):
        qi, scores, code = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1, 3))
        rows = np.concatenate([p[2] for p in self.parts]) if self.held is not None else pa.concat_tables([p[2] for p in self.parts])
        self.parts = []
        if self.q.limit is not None:
            if self.held is not None:
                by_id = self.id_rank[rows]
            else:
                by_id = _id_rank(rows.column("point_id"))
            group = code.astype(np.int64) * len(self.q.threshold) + qi
            order = np.lexsort((by_id, -scores, group))
            sorted_g, sorted_q = group[order], qi[order]
            rank = np.arange(len(order)) - np.searchsorted(sorted_g, sorted_g, side="left")
            limit = self.q.limit[sorted_q]
            keep = order[rank < limit]
            if len(self.values) == 1:
                last = order[rank == limit - 1]
                self.floor[qi[last]] = np.maximum(self.floor[qi[last]], scores[last])
            qi, scores, code = qi[keep], scores[keep], code[keep]
            rows = rows[keep] if self.held is not None else rows.take(pa.array(keep))
        return qi, scores, rows, code

    def compact(self) -> None:
        merged = self._merge()
        self.parts, self.rows = [merged], len(merged[0])
        self.budget = max(self.budget, 2 * self.rows)

    def drain(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        qi, scores, rows, _ = self._merge()
        self.rows = 0
        if self.held is not None:
            rows = self.held.select(list(self.payload)).take(pa.array(rows))
        columns = {"query_id": self.q.ids.take(pa.array(qi)), "score": pa.array(scores)}
        for name in self.payload:
            columns[name] = rows.column(name)
        arrays = [columns[f.name] for f in self.schema]
        yield from pa.Table.from_arrays(arrays, names=self.schema.names).cast(self.schema).to_batches(max_chunksize=20_000)


def _best_of_group(q: _Queries, key: tuple, scores: np.ndarray, passing: np.ndarray) -> np.ndarray:
    """Of the passing queries of a q_best group the best of every point, the first of equal ones."""
    starts, group = q.best[key]
    scores = np.where(passing, scores, -np.inf)
    top = np.maximum.reduceat(scores, starts, axis=1)
    pi, qj = np.nonzero(passing & (scores == top[:, group]))
    if len(pi):
        at = pi * len(starts) + group[qj]
        first = np.r_[True, at[1:] != at[:-1]]
        pi, qj = pi[first], qj[first]
    out = np.zeros_like(passing)
    out[pi, qj] = True
    return out


def _score_batch(q: _Queries, out: _Survivors, table: pa.Table, scope: Sequence[str], strict: bool, ordered: bool, per: Sequence[str] = ()) -> None:
    matrix, rows = _matrix(table.column("vector"), q.matrix.shape[1])
    if not len(rows):
        return
    table = table.select(list(dict.fromkeys([*out.payload, *scope, *[c for c in table.column_names if c != "vector"]])))
    table = table.take(pa.array(rows))
    masks: dict = {}
    for values, mine in _by_scope(table, [*scope, *per]):
        key, value = values[:len(scope)], values[len(scope):]
        if key not in q.groups:
            continue
        queries, columns = q.groups[key]
        step = max(1, _BLOCK_CELLS // len(queries))
        for start in range(0, len(mine), step):
            block = mine[start:start + step]
            scores = matrix[block] @ columns
            floor = out.floor[queries]
            passing = scores > floor if strict else scores >= floor
            for spec, at in q.filters[key] if q.filters is not None else ():
                if not spec:
                    continue
                if spec not in masks:
                    masks[spec] = _filter_mask(table, spec)
                passing[:, at] &= masks[spec][block, None]
            if q.limit is not None:
                k = int(q.limit[queries].max())
                if k <= 0:  # nothing is asked for
                    continue
                if k < len(block) and np.count_nonzero(passing) > 2 * k * len(queries):
                    ranked = np.where(passing, scores, -np.inf)
                    kth = np.partition(ranked, len(block) - k, axis=0)[len(block) - k]
                    passing &= scores >= kth
            if q.best is not None:
                passing = _best_of_group(q, key, scores, passing)
            pi, qj = np.nonzero(passing)
            if not len(pi):
                continue
            points, asked = block[pi], queries[qj]
            found = scores[pi, qj]
            if ordered:
                left = q.ids.take(pa.array(asked))
                right = table.column("point_id").take(pa.array(points)).combine_chunks()
                up = pc.less(left, right.cast(left.type)).to_numpy(zero_copy_only=False)
                points, asked, found = points[up], asked[up], found[up]
            out.add(asked, found, rows[points] if out.held is not None else table.select(out.payload).take(pa.array(points)), value)
            if q.limit is not None and out.rows > out.budget:
                out.compact()


# ---------------------------------------------------------------------------
# Join
# ---------------------------------------------------------------------------
def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _bounded_rows(df: DataFrame, cap: int) -> pa.Table | None:
    """The rows when there are at most `cap`, else None.

    A plan whose estimated size is large is first probed with `take`, which stops after the first partitions.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > _PROBE_BYTES and len(df.select(F.lit(1)).take(cap + 1)) > cap:
        return None
    head = df.limit(cap + 1).toArrow()
    return head if head.num_rows <= cap else None


def _tiles(n: Column, tile_rows: int, most_rows: int) -> Column:
    """Number of tiles for n rows: as small as asked while that makes no more than MOST_TILES, then growing to `most_rows` each.

    Every vector goes to each tile of the other side, so a tile size that stays small makes shuffles grow with the square of the rows.
    """
    tiles = lambda rows: F.ceil(n / F.lit(rows))
    return F.greatest(F.lit(1), F.least(tiles(tile_rows), F.greatest(F.lit(MOST_TILES), tiles(most_rows)))).cast("int")


def _in_place(sizes: DataFrame) -> DataFrame:
    """A table of sizes, broadcast where it is bounded: it is looked up in place and the vectors are not shuffled for it."""
    known = _bounded_rows(sizes, SCOPE_ROWS)
    return sizes if known is None else F.broadcast(sizes.sparkSession.createDataFrame(known, sizes.schema))


def _spread(df: DataFrame, keys: Sequence[str], tile_rows: int, id_col: str, tile: str, count: str, most_rows: int = TILE_ROWS, near: str | None = None, by_cells: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tag rows with a tile inside their scope value; also return the tiles per scope value.

    With `near`, rows of one value of that column are put into as few tiles as they fill. With `by_cells`, a tile of more rows than `most_rows` is made while its vectors have
    no more than BROADCAST_VALUES cells.
    """
    most_rows = max(most_rows, 1)
    if near is not None:
        df = df.withColumn("_near", F.xxhash64(near))
        parts = df.groupBy(*keys, "_near").agg(F.count(F.lit(1)).alias("_n"))
        before = W.partitionBy(*keys).orderBy("_near").rowsBetween(W.unboundedPreceding, -1)
        parts = parts.withColumn("_total", F.sum("_n").over(W.partitionBy(*keys))).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        parts = _in_place(parts.withColumn(count, _tiles(F.col("_total"), tile_rows, most_rows)))
        sizes = _in_place(parts.select(*keys, count).distinct())
        place = F.col("_start") + F.pmod(F.xxhash64(id_col), F.col("_n"))
        tagged = df.join(parts, [*keys, "_near"]).withColumn(tile, F.floor(place * F.col(count) / F.col("_total")).cast("int")).drop("_near", "_n", "_total", "_start")
    else:
        n = F.count(F.lit(1))
        tiles = _tiles(n, tile_rows, most_rows)
        if by_cells:
            tiles = F.least(tiles, F.greatest(F.lit(1), F.ceil(vector_cells() / F.lit(BROADCAST_VALUES))).cast("int"))
        sizes = df.groupBy(*keys).agg(tiles.alias(count))
        sizes = _in_place(sizes)
        tagged = df.join(sizes, list(keys)) if keys else df.crossJoin(sizes)
        tagged = tagged.withColumn(tile, F.pmod(F.xxhash64(id_col), F.col(count)).cast("int"))
    # fresh column ids, so that both roles of one table can meet in a cogroup
    return tagged.toDF(*tagged.columns), sizes


def _every(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(count) - 1))


def score_join(
    queries: DataFrame,
    points: DataFrame,
    *,
    threshold: float | None = None,
    k: int | None = None,
    scope: Sequence[str] = (),
    payload: Sequence[str] = (),
    strict: bool = False,
    ordered: bool = False,
    per: str | None = None,
    broadcast_queries: int | None = None,
    tile_rows: int | None = None,
) -> DataFrame:
    """(query_id, point_id, payload..., score) for every pair over the threshold, cut to each query's local best k.

    `queries` has query_id, vector, q_<scope> columns and, optionally, q_threshold, q_limit and the
    FILTER_FIELDS. `points` has point_id, vector, the scope and payload columns.
    `ordered` keeps a pair only when query_id < point_id. Final ranking is `best_per_query`.
    With `per`, a payload column, k is cut per query and value of it, not over all of the query's points; points without a value are left out.
    With q_best in `queries`, a point is told of each q_best value only the local best query, of equal ones the first by q_order (where there is one) and query_id.
    """
    return _score_join(queries, points, threshold, k, scope, payload, strict, ordered, per, broadcast_queries, tile_rows)[0]


def _score_join(
    queries: DataFrame, points: DataFrame, threshold: float | None = None, k: int | None = None, scope: Sequence[str] = (), payload: Sequence[str] = (), strict: bool = False,
    ordered: bool = False, per: str | None = None, broadcast_queries: int | None = None, tile_rows: int | None = None,
) -> tuple[DataFrame, int | None]:
    """The rows of `score_join`, and the number of parts of the points that each have sent their best k of a query, if it is known."""
    cap = BROADCAST_QUERIES if broadcast_queries is None else broadcast_queries
    grouped = "q_best" in queries.columns
    most_rows = PAIR_TILE_ROWS if k is None and not grouped else TILE_ROWS
    tile = most_rows if tile_rows is None else tile_rows
    by = [] if per is None else [per]
    spark = points.sparkSession
    payload = list(dict.fromkeys(["point_id", *payload]))
    extras = [f for f in ("q_threshold", "q_limit", "q_best", "q_order", *FILTER_FIELDS) if f in queries.columns]
    queries = queries.select("query_id", "vector", *[f"q_{s}" for s in scope], *extras)
    filters = [f[2:] for f in FIELD_FILTERS if f in extras]
    if "f_weapons_filter" in extras:
        filters += ["has_weapon", "weapon_analyzed", "weapon_classes"]
    needed = list(dict.fromkeys([*payload, *scope, *by, *[c for c in filters if c in points.columns]]))
    points = points.select("vector", *needed)
    schema = T.StructType(
        [T.StructField("query_id", queries.schema["query_id"].dataType)]
        + [T.StructField(c, points.schema[c].dataType) for c in payload]
        + [T.StructField("score", T.DoubleType())]
    )
    arrow = _arrow_schema(schema)

    bounded = _bounded_rows(queries, cap) if cap else None
    if bounded is not None:
        kept = bounded.num_rows * (k or 0)
        if "q_limit" in extras:
            kept = pc.sum(pc.fill_null(bounded.column("q_limit"), k or 0)).as_py() or 0
        if _cells(bounded) > BROADCAST_VALUES or kept > SURVIVOR_ROWS:
            bounded = None
    if bounded is not None:
        shipped = spark.sparkContext.broadcast(bounded)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = _Queries.per_dimension(shipped.value, scope, threshold, k)
            outs = [_Survivors(q, payload, arrow) for q in asked]
            for batch in batches:
                for q, out in zip(asked, outs):
                    _score_batch(q, out, pa.Table.from_batches([batch]), scope, strict, ordered, by)
                    if (q.limit is None or by) and out.rows > _FLUSH_ROWS:
                        yield from out.drain()
            for out in outs:
                yield from out.drain()

        return _pruned(points, bounded, scope).mapInArrow(scan, schema), None

    q_scope = [f"q_{s}" for s in scope]
    if cap and threshold is not None and not ordered and not extras and not by:
        few = _bounded_rows(points.select("vector", *needed), cap)
        if few is not None and _cells(few) <= BROADCAST_VALUES:
            return _ranked_in_place(queries, few, points.select(*payload).schema, scope, threshold, k, strict), 1 if k is not None else None
    most = k or 0
    if "q_limit" in extras:
        most = max(most, queries.agg(F.max("q_limit")).first()[0] or 0)
    q_most = max(1, min(BEST_TILE_ROWS if by else most_rows, min(SURVIVOR_ROWS, TILE_SURVIVORS) // most)) if most else most_rows
    few_at_once = max(1, SPREAD_SURVIVORS // most) if most else q_most
    tagged_q, q_sizes = _spread(queries, q_scope, min(tile, q_most, few_at_once), "query_id", "q_tile", "q_tiles", q_most, "q_best" if grouped and scope else None)
    kept = bool(most) and not grouped and not by
    tagged_p, p_sizes = _spread(points, scope, tile, "point_id", "p_tile", "p_tiles", most_rows, per if scope else None, kept and tile_rows is None)
    parts = (p_sizes.agg(F.max("p_tiles")).first()[0] or 0) if kept else None
    if scope:
        tagged_q = tagged_q.join(p_sizes.select(*[F.col(s).alias(f"q_{s}") for s in scope], "p_tiles"), q_scope)
        tagged_p = tagged_p.join(q_sizes.select(*[F.col(f"q_{s}").alias(s) for s in scope], "q_tiles"), list(scope))
    else:
        tagged_q, tagged_p = tagged_q.crossJoin(p_sizes), tagged_p.crossJoin(q_sizes)
    tagged_q = tagged_q.withColumn("p_tile", _every("p_tiles")).drop("p_tiles", "q_tiles")
    tagged_p = tagged_p.withColumn("q_tile", _every("q_tiles")).drop("p_tiles", "q_tiles")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        found = []
        for q in _Queries.per_dimension(left, scope, threshold, k):
            out = _Survivors(q, payload, arrow, None if q.limit is None or ordered else right)
            _score_batch(q, out, right, scope, strict, ordered, by)
            found.extend(out.drain())
        return pa.Table.from_batches(found, schema=arrow)

    left = tagged_q.groupBy(*q_scope, "q_tile", "p_tile")
    right = tagged_p.groupBy(*scope, "q_tile", "p_tile")
    return left.cogroup(right).applyInArrow(meet, schema), parts


def _cells(table: pa.Table) -> int:
    """Vector elements of a table."""
    return int(pc.sum(pc.list_value_length(table.column("vector"))).as_py() or 0)


def _listed(points: DataFrame, column: str, values: set) -> DataFrame:
    """Points whose column has one of the values: a pushed list, or a broadcast of the values where they are many."""
    if len(values) <= PUSHED_VALUES:
        return points.where(F.col(column).isin(*values)) if values else points.where(F.lit(False))
    kind = points.schema[column].dataType
    wanted = points.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField(column, kind)]))
    return points.join(F.broadcast(wanted), column, "left_semi").select(*points.columns)


def _pruned(points: DataFrame, queries: pa.Table, scope: Sequence[str]) -> DataFrame:
    """Points cut to what some query can reach, by conditions that a scan can take: scope values, filters every query carries, weapon modes."""
    texts = lambda name: isinstance(points.schema[name].dataType, T.StringType)
    seen = lambda name: set(queries.column(name).unique().to_pylist())
    for name in scope:
        if texts(name):
            points = _listed(points, name, {str(v) for v in seen(f"q_{name}") if v is not None})
    for name in FIELD_FILTERS:
        column = name[2:]
        if name not in queries.column_names or column not in points.columns or not texts(column) or queries.column(name).null_count:
            continue
        asked = queries.column(name).to_pylist()
        points = _listed(points, column, {str(v) for one in asked for v in (one if isinstance(one, (list, tuple)) else [one]) if v is not None})
    if "f_weapons_filter" in queries.column_names:
        modes = seen("f_weapons_filter")
        if modes == {"only"}:
            points = points.where("has_weapon")
        elif modes and modes <= {"exclude", "analyzed_clean"}:
            points = points.where("not has_weapon")
    return points


def _ranked_in_place(queries: DataFrame, few: pa.Table, kept: T.StructType, scope: Sequence[str], threshold: float, k: int | None, strict: bool) -> DataFrame:
    """(query_id, kept columns of the points, score) with a bounded point table shipped to the queries: each query sees all points at once and is cut to its best k."""
    shipped = queries.sparkSession.sparkContext.broadcast(few)
    schema = T.StructType([queries.schema["query_id"], *kept.fields, T.StructField("score", T.DoubleType())])
    arrow, names = _arrow_schema(schema), kept.fieldNames()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shipped.value
        by_id = np.unique(points.column("point_id").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        sides = []
        for dim in _dimensions(points.column("vector")):
            matrix, rows = _matrix(points.column("vector"), dim)
            sides.append((dim, {key: (rows[own], np.ascontiguousarray(matrix[own].T)) for key, own in _by_scope(points.select(list(scope)).take(pa.array(rows)) if scope else points.take(pa.array(rows)), scope)}))
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for dim, groups in sides:
                matrix, rows = _matrix(table.column("vector"), dim)
                own = table.drop(["vector"]).take(pa.array(rows))
                for key, mine in _by_scope(own, [f"q_{s}" for s in scope]):
                    if key not in groups or not len(mine):
                        continue
                    at, columns = groups[key]
                    step = max(1, _BLOCK_CELLS // max(1, len(at)))
                    for start in range(0, len(mine), step):
                        block = mine[start:start + step]
                        scores = matrix[block] @ columns
                        qi, pj = np.nonzero(scores > threshold if strict else scores >= threshold)
                        found = scores[qi, pj]
                        if k is not None:
                            order = np.lexsort((by_id[at[pj]], -found, qi))
                            place = np.arange(len(order)) - np.searchsorted(qi[order], qi[order], side="left")
                            order = order[place < k]
                            qi, pj, found = qi[order], pj[order], found[order]
                        if len(qi):
                            hit = points.select(names).take(pa.array(at[pj]))
                            out = pa.Table.from_arrays([own.column("query_id").take(pa.array(block[qi])), *hit.columns, pa.array(found)], names=schema.fieldNames())
                            yield from out.cast(arrow).to_batches(max_chunksize=20_000)

    return queries.mapInArrow(rank, schema)


def best_per_query(hits: DataFrame, k: int | Column, id_col: str = "point_id", parts: int | None = None) -> DataFrame:
    """Best k rows per query_id by score, ties by id, as `rank` 1..k.

    Ranked first inside hash slices of a query and then over the slice winners,
    so one query with very many hits never sorts in a single task. Hits of a few
    `parts` that were each cut to the best k are not that many: they are shuffled once.
    """
    order = [F.col("score").desc(), F.col(id_col)]
    limit = F.lit(k) if isinstance(k, int) else k
    sliced = W.partitionBy("query_id", F.pmod(F.xxhash64(id_col), F.lit(RANK_SALTS))).orderBy(*order)
    final = W.partitionBy("query_id").orderBy(*order)
    if parts is not None and parts <= RANK_SALTS:
        return hits.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= limit)
    return (
        hits.withColumn("rank", F.row_number().over(sliced)).where(F.col("rank") <= limit)
        .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= limit)
    )


def similarity_search(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    threshold: float | None,
    predicate: Column | None = None,
    *,
    scope: Sequence[str] = (),
    payload: Sequence[str] = (),
    **physical,
) -> DataFrame:
    """Per query the best k points with cosine >= threshold, under a payload predicate and scope equality.

    Queries may carry q_threshold and q_limit, which win over the arguments.
    """
    if predicate is not None:
        points = points.where(predicate)
    carried = "q_limit" in queries.columns
    hits, parts = _score_join(queries, points, threshold=threshold, k=k, scope=scope, payload=payload, **physical)
    if not carried:
        return best_per_query(hits, k, parts=parts)
    limits = queries.select("query_id", F.coalesce("q_limit", F.lit(k)).alias("q_limit"))
    return best_per_query(hits.join(limits, "query_id"), F.col("q_limit"), parts=parts).drop("q_limit")


def neighbours(queries: DataFrame, points: DataFrame, k: int, **options) -> DataFrame:
    """Best k points per query, whatever the score."""
    return similarity_search(queries, points, k, None, **options)


INDEX_PAYLOAD = ("user_id", "external_id", "batch_id", "item_index", "item_ref", "source_url", "model_version")


def index_search(queries: DataFrame, index: DataFrame, k: int, threshold: float, predicate: Column | None = None, **physical) -> DataFrame:
    """Tenant-scoped search of the on-demand index.

    `queries` carries q_user_id and, optionally, q_batch_id (then every query is held to its batch) and
    q_external_ids (any-of; a null or empty list sees the whole tenant).
    """
    if predicate is not None:
        index = index.where(predicate)
    scope = ["user_id", *(["batch_id"] if "q_batch_id" in queries.columns else [])]
    index = index.withColumns({c: F.col(c).cast("string") for c in ("user_id", "external_id", "batch_id")})
    queries = queries.withColumns({f"q_{s}": F.col(f"q_{s}").cast("string") for s in scope})
    if "q_external_ids" in queries.columns:
        ids = F.transform("q_external_ids", lambda e: e.cast("string"))
        queries = queries.withColumn("f_external_id", F.when(F.size(ids) > 0, ids))
    return similarity_search(queries, index, k, threshold, scope=scope, payload=INDEX_PAYLOAD, **physical)


# ---------------------------------------------------------------------------
# All pairs of one table
# ---------------------------------------------------------------------------
def pair_tiles(n: Column, cells: Column, tile_rows: int) -> Column:
    """Number of tiles for n vectors with so many cells that meet in `tile_pairs`: WIDE_PAIR_ROWS each, or fewer where those have more than BROADCAST_VALUES cells."""
    wide = F.least(F.ceil(n / F.lit(PAIR_TILE_ROWS)), F.ceil(cells / F.lit(BROADCAST_VALUES)))
    return F.greatest(_tiles(n, tile_rows, WIDE_PAIR_ROWS), wide).cast("int")


def vector_cells() -> Column:
    return F.sum(F.greatest(F.coalesce(F.size("vector"), F.lit(0)), F.lit(0)))


def tile_pairs(rows: DataFrame, tiles: Column) -> DataFrame:
    """Rows with `tile` and, once for each of the `tiles`, the pair (i, j) of tiles in which they meet it, i <= j. A vector goes to each tile once."""
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("point_id"), tiles).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), tiles - 1)))
    return rows.withColumn("i", F.least("tile", "_o")).withColumn("j", F.greatest("tile", "_o")).drop("_o")


def in_bulk(parts: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Small tables as batches of about _FLUSH_ROWS rows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n >= _FLUSH_ROWS:
            yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=_FLUSH_ROWS)
            held, n = [], 0
    if n:
        yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=_FLUSH_ROWS)


def _pair_tiles(points: DataFrame, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both roles of every vector in the upper triangle of tile pairs (i <= j)."""
    tagged, _ = _spread(points, [], tile_rows, "point_id", "tile", "tiles", PAIR_TILE_ROWS)
    i_role = tagged.withColumn("j", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1))).withColumnRenamed("tile", "i")
    j_role = tagged.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tile")))).withColumnRenamed("tile", "j")
    fresh = [F.col(c).alias(c) for c in ("point_id", "vector", "i", "j")]
    return i_role.select(*fresh), j_role.select(*fresh)


PIVOT_ROWS = 200_000           # fewest vectors for which cutting the pair space by pivots is tried
_ANGLE_SLACK = 1e-6


def _main_dimension(points: DataFrame) -> int:
    """The most frequent vector length."""
    sizes = points.where(F.size("vector") > 0).groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim")
    row = sizes.first()
    return row["dim"] if row else 0


def _pivot_cells(points: DataFrame, dim: int, threshold: float, pivots: int, must_cut: bool) -> tuple[DataFrame, DataFrame] | None:
    """Home cell of every vector of a dimension, and the cells it must be compared with.

    Angles obey the triangle inequality, so a partner of x inside cell c needs
    angle(x, pivot c) <= radius(c) + acos(threshold). Cells outside that ball are
    skipped without losing a pair. With `must_cut`, visits are counted by cell numbers first, and None is returned unless at least half of all comparisons go away.
    """
    seeds = points.select("vector", F.xxhash64("point_id").alias("h")).orderBy("h").limit(pivots).drop("h").toArrow()
    centre, _ = _matrix(seeds.column("vector"), dim)
    if not len(centre):
        return None
    ship = points.sparkSession.sparkContext.broadcast(centre)
    reach = float(np.arccos(np.clip(threshold, -1, 1)))

    def angles(batches):
        for batch in batches:
            matrix, rows = _matrix(batch.column("vector"), dim)
            if len(rows):
                yield batch, rows, np.arccos(np.clip(matrix @ ship.value.T, -1, 1))

    def home(batches):
        for batch, rows, angle in angles(batches):
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([kept.column("point_id"), kept.column("vector"), pa.array(angle.argmin(axis=1).astype(np.int32))], names=["point_id", "vector", "cell"])

    def extent(batches):
        radius, members = np.full(len(ship.value), -np.inf), np.zeros(len(ship.value), np.int64)
        for _, _, angle in angles(batches):
            cell = angle.argmin(axis=1)
            np.maximum.at(radius, cell, angle.min(axis=1))
            members += np.bincount(cell, minlength=len(members))
        used = np.flatnonzero(members)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(radius[used]), pa.array(members[used])], names=["cell", "r", "n"])

    base = points.select("point_id", "vector")
    homes = base.mapInArrow(home, T.StructType([*base.schema.fields, T.StructField("cell", T.IntegerType())]))
    radius, at_home = np.full(len(centre), -np.inf), np.zeros(len(centre))
    for row in base.mapInArrow(extent, "cell int, r double, n long").groupBy("cell").agg(F.max("r").alias("r"), F.sum("n").alias("n")).collect():  # one row per pivot
        radius[row["cell"]], at_home[row["cell"]] = row["r"], row["n"]

    def near_cells(angle):
        own = angle.argmin(axis=1)
        return own, (angle <= radius + reach + _ANGLE_SLACK) & (np.arange(angle.shape[1]) >= own[:, None])

    def visit(batches):
        seen = np.zeros(len(radius), np.int64)
        for _, _, angle in angles(batches):
            seen += near_cells(angle)[1].sum(axis=0)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(seen[used])], names=["cell", "n"])

    if must_cut:
        visits = base.mapInArrow(visit, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # one row per pivot
        if sum(at_home[row["cell"]] * row["n"] for row in visits) > at_home.sum() ** 2 / 4:
            return None

    def probe(batches):
        for batch, rows, angle in angles(batches):
            own, near = near_cells(angle)
            row, cell = np.nonzero(near)
            taken = batch.take(pa.array(rows[row]))
            yield pa.RecordBatch.from_arrays(
                [taken.column("point_id"), taken.column("vector"), pa.array(own[row].astype(np.int32)), pa.array(cell.astype(np.int32))],
                names=["point_id", "vector", "own", "cell"])

    p_schema = T.StructType([*base.schema.fields, T.StructField("own", T.IntegerType()), T.StructField("cell", T.IntegerType())])
    return homes, base.mapInArrow(probe, p_schema)


def similar_pairs(
    points: DataFrame,
    threshold: float,
    *,
    broadcast_queries: int | None = None,
    tile_rows: int | None = None,
    pivots: int | None = None,
) -> DataFrame:
    """(id_a, id_b, score) for unordered pairs of one dimension with cosine above the threshold, id_a < id_b. Exact."""
    tile = PAIR_TILE_ROWS if tile_rows is None else tile_rows
    cap = BROADCAST_QUERIES if broadcast_queries is None else broadcast_queries
    base = points.select("point_id", "vector")
    out = T.StructType([
        T.StructField("id_a", base.schema["point_id"].dataType),
        T.StructField("id_b", base.schema["point_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    arrow = _arrow_schema(out)
    small = cap and len(base.limit(cap + 1).select(F.lit(1)).take(cap + 1)) <= cap
    if small:
        hits = score_join(base.withColumnRenamed("point_id", "query_id"), base, threshold=threshold, strict=True,
                          ordered=True, broadcast_queries=cap)
        return hits.select(F.col("query_id").alias("id_a"), F.col("point_id").alias("id_b"), "score")

    def meet(left: pa.Table, right: pa.Table, both_ways: bool) -> pa.Table:
        return pa.concat_tables([arrow.empty_table(), *met(left, right, both_ways)])

    def met(left: pa.Table, right: pa.Table, both_ways: bool) -> Iterator[pa.Table]:
        for dim in sorted(set(_dimensions(left.column("vector"))) & set(_dimensions(right.column("vector")))):
            yield from met_of(left, right, dim, both_ways)

    def met_of(left: pa.Table, right: pa.Table, dim: int, both_ways: bool) -> Iterator[pa.Table]:
        a, a_rows = _matrix(left.column("vector"), dim)
        b, b_rows = _matrix(right.column("vector"), dim)
        if not len(a_rows) or not len(b_rows):
            return
        a_ids = _flat(left.column("point_id")).take(pa.array(a_rows))
        b_ids = _flat(right.column("point_id")).take(pa.array(b_rows))
        step = max(1, _BLOCK_CELLS // len(b_rows))
        for start in range(0, len(a_rows), step):
            scores = a[start:start + step] @ b.T
            i, j = np.nonzero(scores > threshold)
            found = scores[i, j]
            x, y = a_ids.take(pa.array(i + start)), b_ids.take(pa.array(j))
            up = pc.less(x, y)
            if both_ways:
                x, y = pc.if_else(up, x, y), pc.if_else(up, y, x)
            pairs = pa.Table.from_arrays([x, y, pa.array(found)], names=["id_a", "id_b", "score"])
            yield (pairs if both_ways else pairs.filter(up)).cast(arrow)

    n_pivots = pivots
    if n_pivots is None:
        rows = base.count() if threshold >= 0.5 else 0
        n_pivots = min(1024, int(rows ** 0.5 / 4)) if rows >= PIVOT_ROWS else 0
    main = _main_dimension(base) if n_pivots else 0
    cells = _pivot_cells(base.where(F.size("vector") == main), main, threshold, n_pivots, pivots is None) if main else None
    if cells is not None:
        homes, probes = cells
        rest = similar_pairs(base.where(F.size("vector") != main), threshold, broadcast_queries=broadcast_queries, tile_rows=tile_rows, pivots=0)
        tagged_h, h_sizes = _spread(homes, ["cell"], tile, "point_id", "h_tile", "h_tiles", PAIR_TILE_ROWS)
        tagged_p, p_sizes = _spread(probes, ["cell"], tile, "point_id", "p_tile", "p_tiles", PAIR_TILE_ROWS)
        left = tagged_p.join(h_sizes, "cell").withColumn("h_tile", _every("h_tiles"))
        right = tagged_h.join(p_sizes, "cell").withColumn("p_tile", _every("p_tiles"))

        def in_cell(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return arrow.empty_table()
            own = pc.equal(a.column("own"), a.column("cell"))
            same = meet(a.filter(own), b, False)          # both ends live here: seen twice, kept once
            cross = meet(a.filter(pc.invert(own)), b, True)  # partner's cell comes later: seen once
            return pa.concat_tables([same, cross])

        keys = ("cell", "p_tile", "h_tile")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(in_cell, out).unionByName(rest)

    sizes = _in_place(base.agg(pair_tiles(F.count(F.lit(1)), F.coalesce(vector_cells(), F.lit(0)), tile).alias("tiles")))
    rows = tile_pairs(base.crossJoin(sizes), F.col("tiles")).drop("tiles")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        own, i, j = (table.column(c).to_numpy() for c in ("tile", "i", "j"))
        if i[0] == j[0]:
            found = met(table, table, False)
        else:
            found = met(table.filter(pa.array(own == i[0])), table.filter(pa.array(own == j[0])), True)
        yield from in_bulk(found)

    return rows.groupBy("i", "j").applyInArrow(tiles, out)


_BINS = 65_536
_STATS_SAMPLE = 1024  # vectors whose pairs bracket the median before the pass over all pairs
_BRACKET = 0.05       # the bracket reaches so far below and above the middle of the sample's pairs, as a share of them


def _bracket(points: DataFrame) -> tuple[float, float]:
    """A range of scores that should hold the median: quantiles of all pairs of a fixed sample (smallest id hashes)."""
    sample = points.select("vector", F.xxhash64("point_id").alias("h")).orderBy("h").limit(_STATS_SAMPLE).drop("h").toArrow()
    found = []
    for dim in _dimensions(sample.column("vector")):
        x, _ = _matrix(sample.column("vector"), dim)
        found.append((x @ x.T)[np.triu_indices(len(x), 1)])
    scores = np.concatenate(found) if found else np.zeros(0)
    if not len(scores):
        return -1.0, 1.0 + 1e-9
    low, high = np.quantile(scores, [0.5 - _BRACKET, 0.5 + _BRACKET])
    return float(low) - 1e-9, float(high) + 1e-9


def similarity_stats(points: DataFrame, *, tile_rows: int | None = None) -> DataFrame:
    """pairs, mean, std (population), min, max and median of cosine over all unordered pairs of one dimension.

    One pass over the tiles of pairs: tiles return sums, extremes, the counts below and above a bracket of the median and a histogram inside it, never pairs. The bracket
    comes from a bounded sample. The median is exact where its bin holds one score, else within half a bin (5e-7 at most, usually below 1e-7). Only if the sample
    misled and the median lies outside, the pass is run again over the side that has it.
    """
    tile = PAIR_TILE_ROWS if tile_rows is None else tile_rows
    base = points.select("point_id", "vector")
    spark = points.sparkSession
    schema = T.StructType([
        T.StructField("bin", T.LongType()), T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType()),
        T.StructField("ss", T.DoubleType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()),
    ])
    arrow = _arrow_schema(schema)

    def one_pass(low: float, high: float) -> "pa.Table":
        """Per bin of the bracket, and for what is below (-1) and above (BINS), the number, sums and extremes of the scores."""
        i_role, j_role = _pair_tiles(base, tile)
        width = (high - low) / _BINS

        def tiles(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return arrow.empty_table()
            same = a.column("i")[0].as_py() == a.column("j")[0].as_py()
            n, s, ss = (np.zeros(_BINS + 2) for _ in range(3))
            lo, hi = np.full(_BINS + 2, np.inf), np.full(_BINS + 2, -np.inf)
            for dim in sorted(set(_dimensions(a.column("vector"))) & set(_dimensions(b.column("vector")))):
                x, _ = _matrix(a.column("vector"), dim)
                y = x if same else _matrix(b.column("vector"), dim)[0]
                step = max(1, _BLOCK_CELLS // max(1, len(y)))
                for start in range(0, len(x), step):
                    scores = x[start:start + step] @ y.T
                    if same:
                        scores = scores[np.arange(len(scores))[:, None] + start < np.arange(len(y))[None, :]]
                    scores = scores.ravel()
                    if not len(scores):
                        continue
                    # what lies outside the bracket is only counted; the edges of the bracket stand for extremes that others exceed
                    inside = scores[(scores >= low) & (scores < high)]
                    under = int(np.count_nonzero(scores < low))
                    over = len(scores) - under - len(inside)
                    least, most = scores.min(), scores.max()
                    n[0], n[-1] = n[0] + under, n[-1] + over
                    where = np.clip(np.floor((inside - low) / width), 0, _BINS - 1).astype(np.int64) + 1
                    n += np.bincount(where, minlength=_BINS + 2)
                    s[0], ss[0] = s[0] + scores.sum(), ss[0] + scores @ scores
                    np.minimum.at(lo, where, inside)
                    np.maximum.at(hi, where, inside)
                    if under:
                        lo[0], hi[0] = min(lo[0], least), max(hi[0], most if under == len(scores) else np.nextafter(low, -np.inf))
                    if over:
                        lo[-1], hi[-1] = min(lo[-1], least if over == len(scores) else high), max(hi[-1], most)
            used = np.flatnonzero(n + (s != 0))
            return pa.Table.from_arrays(
                [pa.array(used - 1), pa.array(n[used].astype(np.int64)), pa.array(s[used]), pa.array(ss[used]), pa.array(lo[used]), pa.array(hi[used])],
                schema=arrow)

        made = i_role.groupBy("i", "j").cogroup(j_role.groupBy("i", "j")).applyInArrow(tiles, schema)
        return made.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
                                       F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("bin").toPandas()  # at most BINS + 2 rows

    out = "pairs long, mean double, std double, min double, max double, median double"
    bins = one_pass(*_bracket(base))
    total = int(bins["n"].sum())
    if not total:
        return spark.createDataFrame([(0, None, None, None, None, None)], out)

    def at_rank(rank: int) -> float:
        """The score at a rank; a range that turns out to hold it outside the bracket is passed again."""
        table = bins
        while True:
            upto = table["n"].cumsum().to_numpy()
            at = int(np.searchsorted(upto, rank, side="right"))
            row = table.iloc[at]
            if row["lo"] == row["hi"] or (0 <= row["bin"] < _BINS and row["hi"] - row["lo"] <= 1e-6):
                return float((row["lo"] + row["hi"]) / 2)
            low, high = float(row["lo"]), float(row["hi"]) + 1e-12
            table = one_pass(low, high)

    mean = float(bins["s"].sum() / total)
    std = float(np.sqrt(max(0.0, bins["ss"].sum() / total - mean * mean)))
    middle = sorted({(total - 1) // 2, total // 2})
    median = float(np.mean([at_rank(r) for r in middle]))
    return spark.createDataFrame([(total, mean, std, float(bins["lo"].min()), float(bins["hi"].max()), median)], out)


def collection_stats(points: DataFrame, dim: int) -> DataFrame:
    return points.agg(
        F.count(F.lit(1)).alias("points"),
        F.max(F.size("vector")).alias("dimension"),
        F.count_if(F.coalesce(F.size("vector"), F.lit(-1)) != dim).alias("wrong_dimension"),
    ).withColumn("metric", F.lit("cosine"))
