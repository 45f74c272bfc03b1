"""Pooling token or chunk vectors into one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_pool(chunks: DataFrame, key: str, vec: str, weight: str) -> DataFrame:
    """key, vec: the weighted mean of each key's vectors, element by element; zeros where the weights sum to 0."""
    each = chunks.select(key, F.posexplode(vec).alias("pos", "v"), F.col(weight).cast("double").alias("w"))
    sums = each.groupBy(key, "pos").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").alias("w"))
    mean = sums.select(key, "pos", F.when(F.col("w") == 0, 0.0).otherwise(F.col("s") / F.col("w")).alias("v"))
    return mean.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("p")).select(key, F.transform("p", lambda x: x["v"]).alias("vec"))


def masked_pool(tokens: DataFrame, key: str, vec: str, mask: str) -> DataFrame:
    """key, vec: the mean of each key's vectors that the mask (0 or 1) keeps; zeros where it keeps none.

    ``masked_mean`` over rows: partial sums, so a key's vectors are never in one place.
    """
    each = tokens.select(key, F.posexplode(vec).alias("pos", "v"), F.col(mask).cast("double").alias("m"))
    mean = each.groupBy(key, "pos").agg((F.sum(F.col("v") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))).alias("v"))
    return mean.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("p")).select(key, F.transform("p", lambda x: x["v"]).alias("vec"))


def weighted_average(parts: list[tuple[np.ndarray, int]], dims: int = 768) -> np.ndarray:
    """Weights in double, products and sums in float, in order; zeros of ``dims`` elements without weight."""
    total = sum(n for _, n in parts)
    if not total:
        return np.zeros(dims, np.float32)
    out = np.zeros(len(parts[0][0]), np.float32)
    for v, n in parts:
        out += (np.asarray(v, np.float32).astype(np.float64) * (n / total)).astype(np.float32)
    return out


def masked_mean(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """[batch, seq, dim] and [batch, seq] to [batch, dim]; a rank-2 input is pooled already."""
    if hidden.ndim == 2:
        return hidden.astype(np.float32)
    m = np.zeros(hidden.shape[:2], np.float32)
    m[:, : mask.shape[1]] = mask[:, : hidden.shape[1]]
    return np.einsum("bsd,bs->bd", hidden, m).astype(np.float32) / np.maximum(m.sum(1, keepdims=True), np.float32(1e-9))
