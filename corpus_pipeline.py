"""A corpus for training, made from documents in five stages; each is written as Parquet and read by the next.

Quality drops rejected documents, the n-gram join all but one document of each group, decontamination every
document that holds a benchmark window, the curriculum repeats or leaves out documents to meet the sources'
targets, and the last stage puts the rows into shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborsim.llm import common, curriculum, decontaminate, jaccard_join, quality, sharding

#: Near copies: word shingles of this size, alike by at least so many percent. op3's query has values of its own.
SHINGLE, PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 1/2; the fit reads the labels of the documents that are here."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    (name,) = common.unused(docs, "quality_score")
    return quality.score(docs, model, docs.columns, name).where(F.col(name) >= 0.5).select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row that names its component; of rows with its doc_id and text, the least by all columns."""
    kept, key, copies, row = common.unused(docs, "_kept", "_key", "_copies", "_row")
    named = common.materialise(jaccard_join.named(docs, SHINGLE, PERCENT).toDF(kept, key, copies), "distinct-named")
    on = docs["doc_id"].cast("long").eqNullSafe(named[kept]) & (F.xxhash64(docs["text"]) == named[key])
    once, more = docs.join(named.where(F.col(copies) == 1), on, "left_semi"), named.where(F.col(copies) > 1)
    if more.isEmpty():
        return once
    least = docs.join(more, on).groupBy(kept, key).agg(F.min(F.struct(*(docs[c] for c in docs.columns))).alias(row))
    return once.unionByName(least.select(*(F.col(row)[c].alias(c) for c in docs.columns)))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum.schedule(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [("quality", keep_quality), ("distinct", keep_distinct), ("decontaminate", keep_clean), ("mix", mix_sources), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: The quality, n-gram and hashing stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
