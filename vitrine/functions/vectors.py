"""Vector expressions: cosine, norms, text form.

These are for row-wise use (two vectors in one row). Scoring many queries
against a catalogue is ``operators.search``.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIMILARITY_PLACES = 6


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """``1 - cosine distance``; NULL for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def rounded(similarity: Column) -> Column:
    """Similarities carry six decimals, about what float32 vectors can tell apart."""
    return F.round(similarity, SIMILARITY_PLACES)


def shown(similarity: Column) -> Column:
    """Similarity as ``DECIMAL(5,4)``, half-up."""
    return similarity.cast("decimal(10,6)").cast("decimal(5,4)")


def to_text(vector: Column) -> Column:
    """``[x,y,...]``"""
    return F.concat(F.lit("["), F.array_join(vector.cast("array<string>"), ","), F.lit("]"))


def from_text(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def mean_vectors(rows: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Mean vector per key, combined before the shuffle; columns ``keys, qvec``."""
    present = rows.filter(F.col(vector).isNotNull())
    as_vector = present.withColumn("_v", array_to_vector(F.col(vector)))
    means = as_vector.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return means.withColumn("qvec", vector_to_array("_m")).drop("_m")
