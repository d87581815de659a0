"""Vector column functions. The column form is for single values; bulk scoring lives in operators.similarity."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .. import config as C


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalize(v: Column) -> Column:
    """Null when the vector has no length."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size))


def is_valid_vector(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = (F.size(v) > 0) & F.forall(v, finite)
    return F.coalesce(F.when(usable, F.exists(v, lambda x: x.cast("double") * x.cast("double") > 0)), F.lit(False))


def vector_error(vector_b64: Column, encoding: Column, dim: int = C.EMBEDDING_DIM) -> Column:
    """Why a wire vector cannot be read, or null when it can."""
    size = F.length(F.try_to_binary(vector_b64, F.lit("base64")))
    return (
        F.when(~encoding.eqNullSafe(F.lit(C.VECTOR_ENCODING)), F.lit("unknown vector_encoding"))
        .when(vector_b64.isNull(), F.lit("null vector_b64"))
        .when(size.isNull(), F.lit("vector_b64 is not base64"))
        .when(size % 4 != 0, F.lit("vector_b64 is not a whole number of float32"))
        .when(size != 4 * dim, F.lit("wrong vector dimension"))
    )


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(encoded: pd.Series) -> pd.Series:
    """Little-endian float32 bytes behind base64 -> array; Arrow batches, bit exact."""
    return encoded.map(lambda s: None if s is None else np.frombuffer(base64.b64decode(s), dtype="<f4"))


@F.pandas_udf(T.StringType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, dtype="<f4").tobytes()).decode("ascii"))


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance between two histograms; the scale is left out when both are (almost) empty."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda acc, x: acc + x)
    mass = total(a) * total(b)
    overlap = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda acc, x: acc + x)
    scaled = F.when(F.abs(mass) > F.lit(float(np.finfo(np.float32).eps)), F.try_divide(overlap, F.sqrt(mass))).otherwise(overlap)
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - scaled))


def passes_quality(width: Column, height: Column, min_side: int = 50, max_aspect: float = 5.0) -> Column:
    short, long_ = F.least(width, height), F.greatest(width, height)
    aspect = F.when(short > 0, long_ / F.nullif(short, F.lit(0))).otherwise(F.lit(999.0))
    return F.coalesce((short >= min_side) & (aspect <= max_aspect), F.lit(False))
