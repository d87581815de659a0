"""Merkle manifest of a dataset as a rollup of nested structs.

Leaves are ranked inside their group and their ranks written in digits. A block is the leaves that agree in all but the last DIGITS digits. Inside
a block the digits are grouped away one after another, lowest first: every grouping nests the structs of its children under their digest, so a
finished block is one row that holds its whole subtree. Blocks are the leaves of the next round, until a group has one node. On the way back each
block's row meets the path above it, and a transform over the nested structs, exploded, emits each child with its path.

Blocks are bounded (FAN ** DIGITS leaves), so no row, task or driver ever holds a group. A block and the path above it meet in one grouping by
block; no step joins leaves, nodes or proofs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import small_side, stored

FAN = 2
DIGITS = 8


def field(column: str) -> Column:
    """A value inside a leaf: its UTF-8 length, a colon and itself; a null one is a dash."""
    text = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*fields), 256)


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`rows` stored, with their number `i` from 0 in their group and the group's size `n`, by ranges: no group is sorted in one task.

    Rows are dealt by ranges of (group, order) and sorted; what each range holds of a group is counted, and the counts of earlier ranges shift the places
    inside a range. Equal rows may change places, which changes no digest.
    """
    keys = [*group, *order]
    sorted_rows = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys])
    placed = stored(sorted_rows.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    spans = placed.groupBy(*group, part.alias("part")).agg(F.count(F.lit(1)).alias("m"), F.min("at").alias("first"))
    spans = spans.withColumn("before", F.sum("m").over(W.partitionBy(*group).orderBy("part")) - F.col("m")).withColumn("n", F.sum("m").over(W.partitionBy(*group)))
    spans = small_side(stored(spans.toDF(*[f"g_{c}" for c in group], "g_part", "m", "first", "before", "n")))
    same = part == F.col("g_part")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"g_{c}"))
    return placed.join(spans, same).select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("i"), "n")


def _rolled(nodes: DataFrame, group: Sequence[str], done: int, digits: int, fan: int) -> DataFrame:
    """Blocks of `nodes` (group, i, n, node with h): their structs nested level by level. `done` levels are below already.

    A level that the group does not reach, as one node was left before, hands its only child on (`lone`).
    """
    block = F.floor(F.col("i") / fan**digits).cast("long")
    level = nodes.select(*group, "n", block.alias("block"), "i", "node")
    for k in range(digits):
        kids = F.sort_array(F.collect_list(F.struct(F.pmod("i", F.lit(fan)).alias("digit"), F.col("node"))))
        level = level.groupBy(*group, "block", F.floor(F.col("i") / fan).cast("long").alias("above")).agg(F.max("n").alias("n"), kids.alias("kids"))
        reached = F.col("n") > fan ** (done + k)
        h = F.when(reached, F.sha2(F.array_join(F.transform("kids", lambda x: x["node"]["h"]), ""), 256)).otherwise(F.col("kids")[0]["node"]["h"])
        level = level.select(*group, "n", "block", F.col("above").alias("i"), F.struct(h.alias("h"), (~reached).alias("lone"), "kids").alias("node"))
    return level


def _below(node: Column, path: Column) -> Column:
    """Array of (node, path) of a node's children; a step of a path holds the digests left and right of the way."""
    hashes = F.transform(node["kids"], lambda x: x["node"]["h"])

    def child(kid: Column, k: Column) -> Column:
        left, right = F.array_join(F.slice(hashes, F.lit(1), k), ""), F.array_join(F.slice(hashes, k + 2, F.size(hashes)), "")
        step = F.when(node["lone"], F.array().cast(NO_PATH)).otherwise(F.array(F.struct(left.alias("left"), right.alias("right"))))
        return F.struct(kid["node"].alias("node"), F.concat(step, path).alias("path"))

    return F.transform(node["kids"], child)


def _emitted(blocks: DataFrame, keep: Sequence[str], digits: int) -> DataFrame:
    """The nodes `digits` levels below each row's `node`, with their paths: one transform and explode per level, inside the task that has the block."""
    for _ in range(digits):
        blocks = blocks.select(*keep, F.explode(_below(F.col("node"), F.col("path"))).alias("x")).select(*keep, F.col("x.node").alias("node"), F.col("x.path").alias("path"))
    return blocks


NO_PATH = "array<struct<left:string,right:string>>"


def tree(leaves: DataFrame, group: Sequence[str], above: DataFrame | None = None, digits: int = DIGITS, fan: int = FAN, top=None) -> DataFrame:
    """Every leaf with its path: columns of `group`, `node` as given, `path` (lowest step first) and `top` (digest of the group's last node).

    `leaves` has `group`, i, n and `node` (a struct with its digest h). `top` maps the rows (group, h) of the groups' last nodes to rows
    (group, path, top) with the path above these, so that trees stand on one another; without it, paths end at the group's last node.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    rounds, nodes = [], leaves
    while True:
        done = digits * len(rounds)
        blocks = stored(_rolled(nodes, group, done, digits, fan))
        rounds.append(blocks)
        if most <= fan ** (done + digits):
            break
        nodes = blocks.select(*group, "n", F.col("i"), F.struct(F.col("node.h").alias("h"), F.col("block").alias("block")).alias("node"))
    ends = rounds[-1].select(*group, F.col("node.h").alias("h"))
    paths = top(ends) if top else ends.select(*group, F.array().cast(NO_PATH).alias("path"), F.col("h").alias("top"))
    paths = paths.withColumn("block", F.lit(0).cast("long"))
    for at, blocks in reversed(list(enumerate(rounds))):
        kind = blocks.schema["node"].dataType
        both = blocks.select(*group, "block", "node", F.lit(None).cast(NO_PATH).alias("path"), F.lit(None).cast(paths.schema["top"].dataType).alias("top")).unionByName(
            paths.select(*group, "block", F.lit(None).cast(kind).alias("node"), "path", "top"))
        met = both.groupBy(*group, "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("node", "path", "top")])
        out = _emitted(met, [*group, "top"], digits)
        paths = out if not at else stored(out.select(*group, F.col("node.block").alias("block"), "path", "top"))
    return paths


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), forged: Column | None = None,
             digits: int = DIGITS, fan: int = FAN) -> DataFrame:
    """key, leaf, subroot, root, proof (steps with the digests left and right of the way, leaf to root), forged and folded_root of every row of `docs`.

    Leaves ascend by key inside a group, null keys first, equal keys by digest; groups ascend by their text, null first. `forged` is the leaf digest to fold up in place
    of the leaf (null: the leaf's own). Null and empty values are told apart; texts of any length are hashed whole; repeated rows are leaves of their own; other columns
    are not read; an empty table gives no rows.
    """
    own = leaf(*[field(c) for c in fields])
    rows = docs.select(F.col(group).alias("g"), F.col(key).alias("id"), own.alias("h"), (F.lit(None).cast("string") if forged is None else forged).alias("f"))
    placed = ranked(rows, ("g",), ("id", "h"))
    leaves = placed.select("g", "i", "n", F.struct("h", "id", "f").alias("node"))

    def over_groups(ends: DataFrame) -> DataFrame:
        roots = ranked(ends.select(F.lit(0).alias("all"), "g", "h"), ("all",), ("g", "h"))
        found = tree(roots.select("all", "i", "n", F.struct("h", "g").alias("node")), ("all",), digits=digits, fan=fan)
        return found.select(F.col("node.g").alias("g"), "path", F.struct(F.col("node.h").alias("subroot"), F.col("top").alias("root")).alias("top"))

    out = tree(leaves, ("g",), digits=digits, fan=fan, top=over_groups)
    folded = F.aggregate("path", F.coalesce("node.f", "node.h"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
    return out.select(F.col("node.id").alias(key), F.col("node.h").alias("leaf"), "top.subroot", "top.root", F.col("path").alias("proof"), folded.alias("folded_root"))


def merkle(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of `docs`.

    Rows whose id's crc32 is divisible by 7 are folded up from a leaf with one more character than the row has; a null id is never among them, and a null
    n_chars stays null. All else as `manifest` states.
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = (F.col("n_chars") + 1).cast("string")
    more = F.coalesce(F.concat(F.octet_length(more).cast("string"), F.lit(":"), more), F.lit("-"))
    forged = F.when(tampered, leaf(field("doc_id"), field("source"), field("lang"), more, field("text")))
    out = manifest(docs, forged=forged, digits=digits)
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _levels(name: str, source: str) -> str:
    """A recursive table `name` of (lvl, g, i, h, n): the levels of trees over the leaves of `source` (g, i, h, n)."""
    return f"""{name} AS (SELECT 0 AS lvl, g, i, h, n FROM {source}
  UNION ALL SELECT lvl + 1, g, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY lvl, g, i // 2, n)"""


def _steps(leaves: str, levels: str) -> str:
    """Per leaf (g, i) the list of steps to its root: L or R and a sibling's digest, or N."""
    return f"""(SELECT a.g, a.i, coalesce(list(CASE WHEN s.i IS NULL THEN 'N' WHEN s.i < t.i THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY t.lvl), []) AS steps
  FROM {leaves} a JOIN {levels} t ON t.g = a.g AND t.i = a.i >> t.lvl AND t.n > 1 LEFT JOIN {levels} s ON s.g = t.g AND s.lvl = t.lvl AND s.i = xor(t.i, 1) GROUP BY a.g, a.i)"""


def _field_sql(expression: str) -> str:
    return f"coalesce(strlen(CAST({expression} AS VARCHAR)) || ':' || CAST({expression} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: crc32 of a text of digits: bytes are taken in, then eight shifts each.
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT + 1, 0, 0, 0, 0, 0, 0, 0, 0]))),"
        " lambda a, x: CASE WHEN x > 0 THEN xor(a, x - 1) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)")

#: The same rows by DuckDB: levels by recursion, siblings by joins.
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('x' || lang, '') AS g, {_leaf_sql("n_chars")} AS h, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} END AS f FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
{_levels("t", "a")},
b AS (SELECT g AS lang, h, 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
{_levels("u", "b")},
p AS (SELECT a.*, coalesce(s.steps, []) AS low FROM a LEFT JOIN {_steps("a", "t")} s USING (g, i)),
q AS (SELECT b.lang, b.h AS subroot, coalesce(s.steps, []) AS high, (SELECT h FROM u WHERE n = 1) AS root FROM b LEFT JOIN {_steps("b", "u")} s USING (g, i)),
r AS (SELECT p.doc_id, p.h AS leaf, p.f, q.subroot, q.root, list_concat(p.low, q.high) AS steps FROM p JOIN q ON p.g = q.lang),
e AS (SELECT *, list_reduce(list_prepend(coalesce(f, leaf), steps), lambda acc, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || acc WHEN 'R' THEN acc || s[2:] ELSE acc END)) AS folded_root FROM r)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda s: s[2:]), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM e"""
