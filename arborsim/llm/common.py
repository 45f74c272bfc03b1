"""What the operators of this subpackage share: tables, scratch space, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper and lower case, for a lower() that leaves other letters alone.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where it is unset and all is one process, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="arborsim-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/arborsim/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*made: DataFrame) -> None:
    """Deletes tables that ``materialise`` made and nothing will read again."""
    spark = made[0].sparkSession
    for df in made:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def trimmed(run):
    """run, which then gives back to the system what its worker no longer uses: workers live on after a task."""

    def whole(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)

    return whole


#: A key with more than this share of a side's rows is dealt to several tasks; there are fewer than 256 such keys.
HOT_SHARE = 256


def dealt_join(left: DataFrame, right: DataFrame, key: str, by: Column | None = None, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """left.join(right, key, how), where left has hot keys and right one row for each key.

    Rows of a hot key are dealt by ``by`` to so many parts that each has 1 / HOT_SHARE of left, and the key's row on
    the right is sent to each part. Without ``by`` rows are dealt in turn, for which left must be a plain read of a
    table. Keys are counted in ``counted`` (left if None), a table too. Only the hot keys, fewer than HOT_SHARE,
    are collected and broadcast.
    """
    counted = left if counted is None else counted
    total = counted.count()
    hot = counted.groupBy(key).count().where((F.col("count") * HOT_SHARE > total) & F.col(key).isNotNull()).collect()
    hot = [(k, -(-n * HOT_SHARE // total)) for k, n in hot]
    if not hot:
        return left.join(right, key, how)
    part, parts = unused(left, "_part", "_parts")
    many = F.broadcast(left.sparkSession.createDataFrame(hot, f"{key} {left.schema[key].dataType.simpleString()}, {parts} long"))
    of = F.coalesce(F.col(parts), F.lit(1).cast("long"))
    left = left.join(many, key, "left").withColumn(part, F.pmod(F.monotonically_increasing_id() if by is None else by, of)).drop(parts)
    right = right.join(many, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), of - 1))).drop(parts)
    return left.join(right, [key, part], how).drop(part)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to be no column of df."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


#: Columns that ``located`` adds.
PLACE = "_file", "_row", "_spot"


def located(docs: DataFrame, what: str, names: Sequence[str] = PLACE) -> DataFrame:
    """docs with three longs, named so: a hash of the row's file, its number there, and a hash of file name and number.

    The first two tell rows apart; the third is the same wherever the files lie and whoever wrote them, as Spark's
    part files count by their numbers alone. A DataFrame that isn't a plain read of Parquet files is written to the
    shared folder first.
    """
    if not _plain_read(docs):
        docs = materialise(docs, what)
    meta = docs.metadataColumn("_metadata")
    part = F.regexp_replace(meta["file_name"], "-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "")
    own = F.xxhash64(meta["file_path"]), meta["row_index"], F.xxhash64(part, meta["row_index"])
    return docs.select(*docs.columns, *(c.alias(n) for c, n in zip(own, names)))


def _plain_read(df: DataFrame) -> bool:
    """Whether each row of df is a row of a Parquet file of its own: a read, and columns and rows chosen from it."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.getClass().getSimpleName() == "LogicalRelation" and "parquet" in node.toString().lower()


def spread(rows: DataFrame, total: int, seed: int, by: list[str], spot: str) -> Column:
    """A long that looks uniform: a hash of the columns ``by``; of those and of ``spot`` where rows equal in ``by`` are many.

    Many is two, and more than 1 / HOT_SHARE of all rows: there are fewer than HOT_SHARE such groups, and they are collected.
    Equal rows then aren't one bucket's; their places depend on which files of the table they are in.
    """
    equal = F.xxhash64(F.lit(seed), *by)
    hot = [r[0] for r in rows.groupBy(equal.alias("_h")).count().where((F.col("count") > 1) & (F.col("count") * HOT_SHARE > total)).collect()]
    return F.when(equal.isin(hot), F.xxhash64(F.lit(seed), *by, spot)).otherwise(equal) if hot else equal


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3; rows at 1 are held out of every fit. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int = 256 << 20, seed: int = 17) -> list[tuple[str, int]]:
    """(text, label) of at most ``max_rows`` labelled documents, none of them held out, in the order of a hash of their id.

    The choice doesn't depend on partitioning. Only the ids of the sample (at most max_rows) are broadcast; only the
    sample's texts reach the driver, one for each id (the least of several), and no more after ``max_bytes`` of them.
    """
    usable = labels.where((fold(F.col("doc_id")) != 1) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
    share = min(1.0, 1.1 * max_rows / max(usable.count(), 1))
    u = F.xxhash64(F.lit(seed), "_id")
    sample = usable.where(F.pmod(u, F.lit(1_000_000)) < int(share * 1_000_000) + (share == 1.0)).groupBy("_id").agg(F.max("_y").alias("_y")).withColumn("_u", u).orderBy("_u", "_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_t")).join(F.broadcast(sample), "_id")
    rows, held = [], 0
    for r in texts.groupBy("_u", "_id", "_y").agg(F.min("_t").alias("_t")).orderBy("_u", "_id").toLocalIterator():
        rows.append((r["_t"], r["_y"]))
        held += len(r["_t"].encode())
        if held > max_bytes:
            break
    return rows
