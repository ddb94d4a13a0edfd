"""Vector expressions on arrays, evaluated in double precision inside the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(x: Column, decimals: int = 6) -> Column:
    """`F.round` of a float column as a double, without its detour over texts.

    A float has 24 bits and 10^6 another 14 besides its powers of two, so up to 6 decimals the product below is exact and
    its half is rounded up like there. Large values, infinite ones and NaN go the long way.
    """
    value, scale = x.cast("double"), float(10**decimals)
    whole = F.floor(F.abs(value) * scale + 0.5)
    near = F.when(value < 0, -whole).otherwise(whole) / F.lit(scale)
    return F.when(F.abs(value) < 1e6, near).otherwise(F.round(value, decimals))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    length = norm(v)
    safe = F.when(length == 0, F.lit(1e-9)).otherwise(length)
    # The length is put in a one-element array so that it is computed once per row, not once per element.
    scaled = F.transform(F.array(safe), lambda s: F.transform(v, lambda x: (x.cast("double") / s).cast("float")))
    return F.element_at(scaled, 1)


def blend(mention: Column, context: Column, alpha: float) -> Column:
    """Weighted sum of two vectors, not normalised."""
    a, b = F.lit(float(alpha)), F.lit(1.0 - float(alpha))
    return F.zip_with(mention, context, lambda x, y: a * x.cast("double") + b * y.cast("double"))


def mean_pool(tokens: DataFrame, key: str, vector: str = "vector", mask: str = "mask") -> DataFrame:
    """Masked mean of the token vectors per text: sum(token · mask) / max(sum(mask), 1e-9).

    Each task adds up its tokens first, so at most one vector per text and task is shuffled. Tokens without a vector do
    not count.
    """
    masked = F.transform(F.col(vector), lambda x: x.cast("double") * F.col(mask).cast("double"))
    held = tokens.where(F.col(vector).isNotNull()).select(key, array_to_vector(masked).alias("_masked"), F.col(mask).cast("double").alias("_mask"))
    sums = held.groupBy(key).agg(Summarizer.sum(F.col("_masked")).alias("_total"), F.sum("_mask").alias("_weight"))
    weight = F.greatest("_weight", F.lit(1e-9))
    return sums.select(key, F.transform(vector_to_array("_total"), lambda x: x / weight).alias("pooled"))
