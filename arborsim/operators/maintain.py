"""Keeping an index up to date: what is new, what is stale, and figures about both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborsim.functions import text


def sha_to_paths(tree: DataFrame) -> DataFrame:
    return tree.groupBy("blob_sha").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def live(tree: DataFrame) -> DataFrame:
    return tree.select("blob_sha").distinct()


def prune(index: DataFrame, tree: DataFrame) -> DataFrame:
    """Index rows whose content is still in the tree, be it text or not."""
    return index.join(live(tree), "blob_sha", "left_semi")


def new_entries(tree: DataFrame, index: DataFrame) -> DataFrame:
    """Text entries whose content isn't indexed."""
    return tree.where(text.is_text_path(F.col("path"))).join(index.select("blob_sha"), "blob_sha", "left_anti")


def readable(blobs: DataFrame) -> DataFrame:
    """Rows with content of 1 to 102,400 bytes that is valid UTF-8."""
    return blobs.where(text.within_size(F.col("content")) & text.valid_utf8(F.col("content")))


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """index and the rows of new whose content it lacks, one for each content."""
    fresh = new.groupBy("blob_sha").agg(F.min("vec").alias("vec")).join(index.select("blob_sha"), "blob_sha", "left_anti")
    return index.select("blob_sha", "vec").unionByName(fresh)


def status(index: DataFrame, tree: DataFrame) -> DataFrame:
    """One row: entries of the tree (files and copies alike) and rows of the index (stale ones too)."""
    return tree.agg(F.count(F.lit(1)).alias("total")).crossJoin(index.agg(F.count(F.lit(1)).alias("indexed")))


def gc_counts(index: DataFrame, tree: DataFrame) -> DataFrame:
    """One row: kept and pruned index rows, in one pass over the join."""
    both = index.select("blob_sha").join(live(tree).withColumn("here", F.lit(1)), "blob_sha", "left")
    return both.agg(F.count("here").alias("kept"), (F.count(F.lit(1)) - F.count("here")).alias("pruned"))
