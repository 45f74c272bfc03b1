"""Vector functions as Columns: cosine similarity and normalisation on a prefix of the dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _prefix(v: Column, n: Column) -> Column:
    return F.slice(v, F.lit(1), n)


def dot(a: Column, b: Column, kind: str = "double") -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast(kind) * y.cast(kind)), F.lit(0).cast(kind), lambda s, x: (s + x).cast(kind))


def cosine(a: Column, b: Column, dims: int | Column, precision: str = "double") -> Column:
    """Cosine of the first min(dims, len(a), len(b)) elements; 0 if either part has no length.

    NaN (from NaN elements) becomes null, so that it never sorts first. ``precision='float'`` folds in float.
    """
    n = F.greatest(F.least(F.lit(dims) if isinstance(dims, int) else dims, F.size(a), F.size(b)), F.lit(0))
    x, y = _prefix(a, n), _prefix(b, n)
    kind = "float" if precision in ("float", "f32") else "double"
    norm = F.sqrt(dot(x, x, kind)).cast(kind) * F.sqrt(dot(y, y, kind)).cast(kind)
    return F.nanvl(F.when(norm == 0, F.lit(0).cast(kind)).otherwise((dot(x, y, kind) / norm).cast(kind)), F.lit(None).cast(kind))


def truncate_and_normalize(v: Column, dims: int) -> Column:
    """The first ``dims`` elements scaled to length 1; unchanged if their length is 0."""
    p = _prefix(v, F.least(F.lit(max(dims, 0)), F.size(v)))
    norm = F.sqrt(dot(p, p))
    return F.when(norm == 0, F.transform(p, lambda x: x.cast("double"))).otherwise(F.transform(p, lambda x: x.cast("double") / norm))
