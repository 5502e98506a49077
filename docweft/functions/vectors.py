"""Vector functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docweft.functions.plain import hash_vector


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 for empty, unequally long or zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.coalesce(F.when(fits & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def clamped(x: Column) -> Column:
    """Within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def hash_embedding(text: Column, dim: int = 384) -> Column:
    """Deterministic embedding by feature hashing; Python, as the JVM has no such hash."""

    @F.pandas_udf("array<double>")
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: hash_vector(t, dim))

    return embedded(text)
