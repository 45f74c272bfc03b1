"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each source are shuffled by a seeded hash and ranked; rank r of n gets the fraction (r - 1/2) / n. All
rows sorted by that fraction hold every source in the mixture's proportion at every stretch, so cutting the
sequence into equal runs gives shards that match the mixture and differ by one row at most (law ``rows``).

Both rankings are distributed: rows are dealt to many small buckets of the hash (or of the fraction), counted
for each bucket, and numbered within the bucket, so a source with a third of all rows is no task's burden.
Equal texts aren't kept together: under this law they are rows like any other, and rows equal in id and text that
are many are dealt over all buckets. A null source is a source of its own; null texts have no bytes; rows equal in
id, source and text change places at most with each other; an empty table gives no rows.

Places are found on narrow rows; the rows themselves are shuffled twice, to their places and to their shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborsim.llm import common

#: Rows of a bucket, at most about. Buckets grow in number with the table, not in size, and even a small table has
#: enough of them to occupy a cluster; the result doesn't depend on how many there are.
BUCKET_ROWS = 20_000
LEAST_BUCKETS = 1024


def shuffled(shuffle: str) -> tuple[Column, Column]:
    """The order of rows by a uniform long: its upper 31 bits, unsigned, then all of it."""
    return F.shiftrightunsigned(F.col(shuffle), 33), F.col(shuffle)


def bucket(shuffle: str, total: int, rows: int | None = None) -> tuple[Column, int]:
    """A row's bucket, which rises with that order, and the number of buckets for so many rows."""
    n = LEAST_BUCKETS + total // (rows or BUCKET_ROWS)
    return F.shiftright(shuffled(shuffle)[0] * F.lit(n), 31), n


def _numbered(df: DataFrame, groups: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """df with ``name``: the row's number (from 1) in its group by bucket and then order."""
    keys = [*groups, "_b"]
    df = df.withColumn("_b", bucket)
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    within = df.withColumn("_in", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    back = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    on = back[0]
    for b in back[1:]:
        on = on & b
    joined = within.alias("l").join(sums.alias("r"), on)
    return joined.select("l.*", (F.col("r._before") + F.col("l._in")).alias(name)).drop("_b", "_in")


def interleave(rows: DataFrame, source: str, shuffle: str, shards: int) -> DataFrame:
    """rows with shard and slot; ``shuffle`` is a long column that looks uniform, ties in it go by all columns.

    rows is read several times: give a narrow, materialised table.
    """
    total = rows.count()
    at, buckets = bucket(shuffle, total)
    order = [*shuffled(shuffle), *(F.col(c) for c in rows.columns)]
    ranked = _numbered(rows, [source], at, order, "_rank")
    sizes = rows.groupBy(F.col(source).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.join(sizes, F.col(source).eqNullSafe(F.col("_s"))).drop("_s")
    ranked = ranked.withColumn("_at", (F.col("_rank") - 0.5) / F.col("_n")).drop("_rank", "_n")
    place = F.floor(F.col("_at") * buckets).cast("long")
    placed = _numbered(ranked, [], place, [F.col("_at"), *order], "_pos")
    pos = F.col("_pos") - 1
    # shard k holds the positions from ceil(k * total / shards) on
    shard = F.expr(f"((_pos - 1) * {shards}) div {max(total, 1)}")
    first = F.expr(f"(_shard * {max(total, 1)} + {shards - 1}) div {shards}")
    return placed.withColumn("_shard", shard.cast("long")).withColumn("slot", (pos - first).cast("long")).withColumn("shard", F.col("_shard").cast("int")).drop("_pos", "_shard", "_at")


def weigh(docs: DataFrame, seed: int = 11) -> tuple[DataFrame, DataFrame, tuple[str, str]]:
    """docs with two columns that say where a row lies; its narrow rows (_doc, _source, _size, _crc, PLACE, _shuffle); the two columns."""
    file, row, spot = common.unused(docs, *common.PLACE)
    rows = common.located(docs, "shard-rows", (file, row, spot))
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = common.materialise(rows.select(
        F.col("doc_id").cast("long").alias("_doc"), F.col("source").cast("string").alias("_source"), (F.octet_length(text) + 16).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"), F.col(file).alias("_file"), F.col(row).alias("_row"), F.col(spot).alias("_spot"),
    ), "shard-narrow")
    shuffle = common.spread(narrow, narrow.count(), seed, ["_doc", "_crc", "_size"], "_spot")
    return rows, narrow.withColumn("_shuffle", shuffle).select("_doc", "_source", "_size", "_crc", "_spot", "_file", "_row", "_shuffle"), (file, row)


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 11, partitions: int | None = None) -> DataFrame:
    """docs, all its columns, with shard and slot (from 0 in each shard), range-shuffled by both.

    docs must have doc_id, text and source; where it has a column shard or slot, the new one gets an underscore more.
    """
    rows, narrow, place = weigh(docs, seed)
    shard, slot = common.unused(rows, "shard", "slot")
    file, row = common.unused(rows, "_f", "_r")
    at = interleave(narrow, "_source", "_shuffle", shards).select(F.col("_file").alias(file), F.col("_row").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot))
    out = rows.join(at, (F.col(place[0]) == F.col(file)) & (F.col(place[1]) == F.col(row))).select(*docs.columns, shard, slot)
    return out.repartitionByRange(partitions or common.shuffle_partitions(docs.sparkSession), shard, slot).sortWithinPartitions(shard, slot)


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    out = shard_documents(common.table(spark, sf_dir, "documents"))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source",
    )
