"""Quality rules with robust multivariate outliers.

Each text gives a few counts; their transforms make a vector. For every language and source the minimum-covariance-determinant
estimate of centre and scatter is found by concentration steps over all its rows: distances from the present estimate, the share of
rows with the smallest distances, their mean and covariance, and again. Rows far from the last estimate by Mahalanobis distance are rejected.

The steps are Spark aggregations over the stored vectors, a few numbers per text; only sums leave the tasks. Groups too small for an estimate
are pooled by language, and what is left over all languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_bytes, shingle_hashes, small_side, stored, word_hashes

WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
#: Share of a group's rows an estimate rests on, rows a group needs, concentration steps.
SHARE, LEAST_GROUP, STEPS = 0.75, 100, 6
#: Scatter of the nearest three quarters of normal rows is smaller than the whole's by this factor, in one to four dimensions.
CONSISTENCY = (2.714, 1.859, 1.609, 1.485)
#: Rejected beyond this squared distance: the chi-square quantile of four degrees of freedom at 0.999.
CUT = 18.467
#: Standard deviations of the transformed statistics that stand in where the scatter is singular: a direction is widened to them only if it is
#: narrower. Where a count is zero in nearly all rows, they alone reject from 1.7 % symbols, 11.4 % repeated words, or as much of repeated lines on;
#: mean word lengths within 14 % of the centre never reject alone.
FLOORS = (0.03, 0.03, 0.08, 0.08)
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIM = len(FLOORS)


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words inside n-word windows that stand twice or more in the text, first ones included."""
    if len(words) <= n:
        return 0
    hashes = shingle_hashes(word_hashes(words), n)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    seen: dict[tuple, int] = {}  # the words themselves decide
    for i in at.tolist():
        key = tuple(words[i : i + n])
        seen[key] = seen.get(key, 0) + 1
    cover = np.zeros(len(words) + 1, np.int64)
    for i in at.tolist():
        if seen[tuple(words[i : i + n])] > 1:
            cover[i] += 1
            cover[i + n] -= 1
    return int((np.cumsum(cover) > 0).sum())


def text_counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line.split(None, 1):
            dup += line in seen
            seen.add(line)
    return len(words), chars, sum(text.count(bytes([c])) for c in SYMBOLS), dup, repeated_words(words)


def statistics(docs: DataFrame) -> DataFrame:
    """The five counts of every whole text, a null one as empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_counts(t) for t in as_bytes(batch.column("text"))], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("source"), *[pa.array(found[:, i]) for i in range(len(STATS))]],
                                             names=["doc_id", "lang", "source", *STATS])

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(count, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in STATS))


def transformed() -> list[Column]:
    """Mean word length on a log scale, shrunk for short texts to `usual`, their group's median; shares of symbols, repeated lines and repeated words as angles."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    angle = lambda part, of: F.asin(F.sqrt(F.least(F.lit(1.0), part / of)))
    length = F.log((F.col("word_chars") + F.col("usual") * 40) / (F.col("n_words") + 40.0))
    return [length.alias("x0"), angle(F.col("n_symbols"), F.col("word_chars") + F.col("n_symbols") + 1.0).alias("x1"),
            angle(F.col("n_dup_lines"), F.col("n_dup_lines") + n / 8).alias("x2"), angle(F.col("n_repeat_words"), n).alias("x3")]


def _moments() -> list[Column]:
    x = [F.col(f"x{i}") for i in range(DIM)]
    return [F.count(F.lit(1)).alias("m"), *[F.sum(x[i]).alias(f"s{i}") for i in range(DIM)],
            *[F.sum(x[i] * x[j]).alias(f"s{i}{j}") for i in range(DIM) for j in range(i, DIM)]]


ESTIMATE = "g string, " + ", ".join(f"c{i} double" for i in range(DIM)) + ", " + ", ".join(f"p{i}{j} double" for i in range(DIM) for j in range(DIM))


def inverse_scatter(cov: np.ndarray) -> np.ndarray:
    """Inverse of a scatter widened for the part of the rows it was taken from, in as many dimensions as have a scatter."""
    floors = np.outer(FLOORS, FLOORS)
    size, axes = np.linalg.eigh(cov / floors)
    for d in range(DIM, 0, -1):
        if d == 1 or (size * CONSISTENCY[d - 1] > 1).sum() >= d:
            break
    size = np.maximum(size * CONSISTENCY[d - 1], 1.0)
    return (axes / size) @ axes.T / floors


def _estimates(sums: DataFrame) -> DataFrame:
    """Centre and inverse scatter of every group from its sums."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                mean = np.array([r[f"s{i}"] for i in range(DIM)]) / r["m"]
                cov = np.zeros((DIM, DIM))
                for i in range(DIM):
                    for j in range(i, DIM):
                        cov[i, j] = cov[j, i] = r[f"s{i}{j}"] / r["m"] - mean[i] * mean[j]
                rows.append([r["g"], *mean, *inverse_scatter(cov).reshape(-1)])
            columns = list(zip(*rows)) if rows else [[] for _ in range(1 + DIM + DIM * DIM)]
            names = [x.split()[0] for x in ESTIMATE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.float64()) for c in columns[1:]]], names=names)

    return sums.mapInArrow(solve, ESTIMATE)


def _distance() -> Column:
    d = [F.col(f"x{i}") - F.col(f"c{i}") for i in range(DIM)]
    return sum((d[i] * d[j] * F.col(f"p{i}{j}") for i in range(DIM) for j in range(DIM)), F.lit(0.0))


def mcd(vectors: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Estimates per group `g` of the vectors x0 .. x3: concentration steps over all rows, from medians on.

    A step's cut is the share's quantile of the group's distances, read from a histogram of 1,024 logarithmic bins, so it too is a sum over rows.
    """
    x = [F.col(f"x{i}") for i in range(DIM)]
    middle = vectors.groupBy("g").agg(*[F.percentile_approx(c, 0.5, 1000).alias(f"c{i}") for i, c in enumerate(x)])
    flat = [F.lit(1.0 / FLOORS[i] ** 2 if i == j else 0.0).alias(f"p{i}{j}") for i in range(DIM) for j in range(DIM)]
    now = stored(middle.select("g", *[f"c{i}" for i in range(DIM)], *flat))
    from pyspark.sql import Window as W

    for _ in range(steps):
        near = vectors.join(small_side(now), "g").withColumn("d", _distance())
        near = near.withColumn("bin", F.least(F.lit(1023), F.greatest(F.lit(0), F.floor((F.log2(F.col("d") + 1e-9) + 30) * 16))).cast("int"))
        bins = near.groupBy("g", "bin").agg(*_moments())
        # whole bins up to the share make the subset: its sums are sums of bins
        up = W.partitionBy("g").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.coalesce(F.sum("m").over(up), F.lit(0))).withColumn("all", F.sum("m").over(W.partitionBy("g")))
        sums = bins.where(F.col("before") < F.col("all") * share).groupBy("g").agg(*[F.sum(c).alias(c) for c in bins.columns if c == "m" or c[0] == "s"])
        now = stored(_estimates(sums))
    return now


def quality(docs: DataFrame, cut: float = CUT, least_group: int = LEAST_GROUP) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, distance and group of every row of `docs`.

    Base: fewer than 20 words, or over 30 % of words in repeated windows. The estimates come from rows that pass the base. A group with fewer than `least_group` such rows joins its language's small groups, these
    if still too few the rest of all languages; a rest that is too small has no estimate, distance null, and its rows are judged by the base alone.
    Null and empty texts have five zeros and fail the base. A null language or source is a group of its own. Repeated rows count each; other columns are not
    read; an empty table gives no rows.
    """
    rows = stored(statistics(docs))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    counts = rows.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window as W

    small = F.when(F.col("n") < least_group, F.col("n")).otherwise(0)
    counts = counts.withColumn("n_lang", F.sum(small).over(W.partitionBy("lang")))
    name = lambda *c: F.to_json(F.array(*c))
    counts = counts.select(F.col("lang").alias("l"), F.col("source").alias("s"), F.when(F.col("n") >= least_group, name("lang", "source")).when(F.col("n_lang") >= least_group, name("lang")).otherwise("[]").alias("g"))
    counts = small_side(stored(counts))
    rows = rows.join(counts, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s")
    rows = rows.withColumn("g", F.coalesce("g", F.lit("[]")))
    usual = rows.where(~F.col("base_failed")).groupBy("g").agg(F.percentile_approx(F.col("word_chars") / F.col("n_words"), 0.5, 1000).alias("usual"))
    rows = rows.join(small_side(stored(usual)), "g", "left").select("*", *transformed())
    vectors = rows.where(~F.col("base_failed")).select("g", *[f"x{i}" for i in range(DIM)])
    enough = vectors.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_group).select("g")
    found = mcd(stored(vectors.join(small_side(stored(enough)), "g", "left_semi")))
    out = rows.join(small_side(found), "g", "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))
    return out.select("doc_id", *STATS, "base_failed", kept.alias("kept"), "distance", F.col("g").alias("estimated_from"))
