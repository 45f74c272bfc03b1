"""Mixing sources to target weights over a time-varying curriculum, in DataFrame operations only.

Targets: the sources share ``share`` of all words by weight; none takes more than ``most`` times its own words,
and what it can't take is shared among the others by weight until none is above its bound.

A source's schedule is a piecewise linear rate over training time 0 to 1. Its integral, scaled to the target,
is the source's cumulative demand for words; a document whose copy starts at word c of the source's shuffled
stream is placed at the time where demand reaches c, the inverse of that integral. Documents are range-sorted by
that time. A copy is taken whole if its middle word lies below the target, so a source misses its target by at
most half a document.

The running word count of a source is a sum over small hash buckets plus a sum within one, so a source with a
third of all rows is dealt over many tasks. A null source is one source, last by order; null and empty texts
have no words and are never taken; repeated rows are separate rows, and where many rows are equal in id and text
they are dealt over all buckets; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborsim.llm import common
from arborsim.llm.sharding import bucket, shuffled
from arborsim.operators import ordering

WEIGHTS = (5.0, 2.0, 1.0)
#: Rates at equally spaced times from 0 to 1, by weight class: late, steady, early.
SCHEDULES = ((0.5, 1.0, 1.5), (1.0, 1.0, 1.0), (1.6, 1.0, 0.4))
WORD = r"[^\x20\x09-\x0D]+"


def targets(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, _class (of its weight) and _n (rows) of each source of rows(source, size).

    Sources may be many: they are numbered along a range shuffle, and each round of sharing out again asks the table
    for three sums. A source is full once its part at the present rate a weight is above its bound; the rate only
    rises, so there are no more rounds than sources, and few where bounds are alike.
    """
    sums = rows.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"), F.count(F.lit(1)).alias("_n"))
    at = ordering.numbered(sums.withColumn("_lost", F.col("source").isNull()), ["_lost", "source"], "_k")
    kind = (F.col("_k") % len(weights)).cast("int")
    table = common.materialise(at.select("source", "source_size", "_n", kind.alias("_class"), F.get(F.array(*map(F.lit, weights)), kind).alias("_weight")), "mix-sources")
    bound, rate, full = F.col("source_size") * F.lit(float(most)), 0.0, -1
    whole = table.agg(F.sum("source_size")).first()[0] or 0
    while True:
        over = F.col("_weight") * rate > bound
        n, words, open_ = table.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("_weight")))).first()
        if n == full:
            break
        full, rate = n, (share * whole - most * (words or 0)) / open_ if open_ else float("inf")
    return table.select("source", "source_size", F.when(over, bound).otherwise(F.col("_weight") * rate).alias("target"), "_class", "_n")


def when(share: Column, rates: Sequence[float]) -> Column:
    """The time at which the integral of the piecewise linear rates reaches ``share`` of its whole."""
    n = len(rates) - 1
    area = [(a + b) / 2 / n for a, b in zip(rates, rates[1:])]
    need, out, before = share * sum(area), None, 0.0
    for i, (a, b) in enumerate(zip(rates, rates[1:])):
        # within the segment: a x + (b - a) n x^2 / 2 = need - before
        c = F.greatest(need - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(a * a) + c * (2.0 * (b - a) * n), F.lit(0.0)))
        x = F.lit(i / n) + F.when(a + root > 0, 2.0 * c / (a + root)).otherwise(0.0)
        out = F.when(need <= before + area[i], x) if out is None else out.when(need <= before + area[i], x)
        before += area[i]
    return F.least(out.otherwise(1.0), F.lit(1.0))


def mix(rows: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES, share: float = 1.5, most: int = 2, bucket_rows: int | None = None) -> DataFrame:
    """rows(source, size, _shuffle, ...) with source_size, target, copies, taken and times (of each copy).

    rows is read several times: give a narrow, materialised table. Neither rows nor sources are collected.
    """
    table = common.materialise(targets(rows, weights, share, most).withColumnRenamed("source", "_s"), "mix-targets")
    rows = rows.withColumn("_b", bucket("_shuffle", table.agg(F.sum("_n")).first()[0] or 0, bucket_rows)[0])
    ties = [F.col(c) for c in rows.columns if c not in ("_b", "_shuffle")]
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "_b").orderBy(*shuffled("_shuffle"), *ties).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = rows.groupBy("source", "_b").agg(F.sum("size").alias("_w"))
    before = F.coalesce(F.sum("_w").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = whole.select(F.col("source").alias("_s2"), F.col("_b").alias("_b2"), before.alias("_before"))
    out = rows.withColumn("_in", inside).join(whole, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("_b") == F.col("_b2")))
    out = out.join(table.drop("_n"), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_start", F.col("_before") + F.col("_in"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.col("_start") + e * F.col("source_size"))
    out = out.withColumn("_starts", F.filter(starts, lambda s: (F.col("size") > 0) & (s + F.col("size") / 2.0 < F.col("target"))))
    at = F.transform("_starts", lambda s: F.coalesce(*[F.when(F.col("_class") == i, when(s / F.col("target"), schedules[i % len(schedules)])) for i in range(len(weights))]))
    out = out.withColumn("copies", F.size("_starts")).withColumn("times", at)
    out = out.withColumn("taken", F.col("size") * F.col("copies"))
    return out.drop("_b", "_in", "_s2", "_b2", "_before", "_s", "_class", "_start", "_starts")


SEED = 23


def weigh(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, where the row lies (common.PLACE) and _shuffle of docs(doc_id, text, source, PLACE), written to the shared folder."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), F.xxhash64("text").alias("_text"), *reversed(common.PLACE))
    rows = common.materialise(rows, "mix-rows")
    return rows.withColumn("_shuffle", common.spread(rows, rows.count(), SEED, ["doc_id", "_text"], "_spot")).drop("_text")


def schedule(docs: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """One row for each copy that the mix takes: the columns of docs, range-sorted by training time.

    The texts are shuffled twice, by row and by time; everything else works on narrow rows.
    """
    n = partitions or common.shuffle_partitions(docs.sparkSession)
    plain = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    rows = common.located(plain, "mix-documents")
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    narrow = weigh(rows.select(*(F.col(own[c]).alias(c) for c in ("doc_id", "text", "source")), *common.PLACE))
    taken = mix(narrow, **options).select(F.col("_file").alias("_f"), F.col("_row").alias("_r"), "_shuffle", F.posexplode("times").alias("_copy", "_time"))
    both = rows.join(taken, (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_r")))
    order = ["_time", "_shuffle", "_copy", "_file", "_row"]
    return both.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*(F.col(k).alias(c) for c, k in own.items()))


def op8_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with what the mix takes of it; rows that aren't taken come last, in shuffled order."""
    docs = common.located(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "mix-documents")
    out = mix(weigh(docs)).withColumn("position", F.get("times", F.lit(0)))
    late = F.coalesce("position", 1 + F.pmod("_shuffle", F.lit(1 << 30)) / float(1 << 30))
    out = out.withColumn("_late", late).repartitionByRange(common.shuffle_partitions(spark), "_late", "_shuffle").sortWithinPartitions("_late", "_shuffle")
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "position", "source")
