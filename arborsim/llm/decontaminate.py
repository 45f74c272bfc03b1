"""Benchmark decontamination by normalised word n-grams, in DataFrame operations only.

A text's words are its runs of ASCII letters and digits and non-ASCII characters, ASCII lower-cased. A benchmark
item of n words or more gives all its windows of n; a shorter one gives itself as one window. Document windows
are hashed and looked up in the hash set of item windows; every hit is verified word by word.

The item windows are measured first and broadcast in blocks of about ``BROADCAST_BYTES``, dealt by hash: one block
and one pass over the documents for any benchmark of usual size, more passes for larger ones. A window that many
items share is one row. Document windows are never shuffled; only verified hits are. A pass splits each text once.
Null texts have no words. Items without an id count as one item together, which comes first and is left out where
items are written as text. Rows that agree in doc_id and text share their result; nothing is dropped for skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborsim.llm import common

N = 10
#: Bytes of windows, their items and what a row takes besides, in a block.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 96
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: A word of a text that isn't lower-cased yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), BREAK), lambda w: w != "")


def _windows(base: DataFrame, keep: list[str], lengths: list[int]) -> DataFrame:
    """keep, words, pos, n, h: one row for each stretch of n words; h is xxhash64 of the stretch, as of an array.

    The hash reads the words where they lie: nothing is copied for each stretch, and scan, explode, hash and the
    lookup that follows are one generated stage.
    """
    # outer: for an inner one Spark infers a filter on the words, for which it splits the text again
    each = base.select(*keep, "words", F.posexplode_outer("words").alias("pos", "_w"))
    hashes = [F.struct(F.lit(n).alias("n"), F.xxhash64(*[F.get("words", F.col("pos") + i) for i in range(n)]).alias("h")) for n in lengths]
    if len(hashes) == 1:
        each = each.select(*keep, "words", "pos", hashes[0]["n"].alias("n"), hashes[0]["h"].alias("h"))
    else:
        each = each.select(*keep, "words", "pos", F.inline(F.array(*hashes)))
    return each.where(F.col("pos") + F.col("n") <= F.size("words"))


def item_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """n, h, window (words with spaces between), items (with an id, sorted), lost (whether one has none) of each distinct window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)
    each = items.select("item", "n", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.col("n")))).alias("w"))
    each = each.select("item", "n", F.xxhash64("w").alias("h"), F.array_join("w", " ").alias("window"))
    return each.groupBy("n", "h", "window").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull()).alias("lost"))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = N) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): rows has _key, doc_id, n_words of each row; hits has _key, pos, n, items, lost of each verified hit."""
    known = common.materialise(item_windows(benchmark, n), "benchmark-windows")
    bytes_of = F.lit(ROW_BYTES) + F.octet_length("window") + F.aggregate("items", F.lit(0), lambda s, x: s + 16 + F.octet_length(x))
    sizes = {r["n"]: r["b"] for r in known.groupBy("n").agg(F.sum(bytes_of).alias("b")).collect()}  # at most n rows
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.xxhash64(text).alias("a"), F.length(text).alias("b")).alias("_key")
    base = docs.select(F.col("doc_id").cast("long"), key, text.alias("text"))
    rows = base.select("doc_id", "_key", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    if not sizes:
        none = rows.select("doc_id", "_key", F.lit(0).alias("pos"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("lost"))
        return rows, none.where("false")
    known = known.select(F.col("h").alias("_h"), F.col("n").alias("_n"), F.col("window").alias("_window"), "items", "lost")
    seen, hits = _windows(base.select("doc_id", "_key", words(F.col("text")).alias("words")), ["doc_id", "_key"], sorted(sizes)), None
    blocks = -(-sum(sizes.values()) // BROADCAST_BYTES)
    for i in range(blocks):
        block = known.where(F.pmod("_h", F.lit(blocks)) == i) if blocks > 1 else known
        found = seen.join(F.broadcast(block), (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n")))
        found = found.where(F.array_join(F.slice("words", F.col("pos") + 1, F.col("n")), " ") == F.col("_window")).select("doc_id", "_key", "pos", "n", "items", "lost")
        hits = found if hits is None else hits.unionByName(found)
    return rows, hits


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """doc_id, _key, n_words, n_hit, items (sorted strings) and spans (first word, length) of each row."""
    rows, hits = find_hits(docs, benchmark, n)
    by = ["doc_id", "_key"]
    # hit stretches are merged with the running end of those before them; each document's hits are its own group
    at = hits.groupBy(*by, "pos").agg(F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("lost").alias("_lost"))
    order = Window.partitionBy(*by).orderBy("pos")
    ended = F.coalesce(F.max(F.col("pos") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = at.withColumn("_new", F.greatest(F.col("pos") + F.col("n") - F.greatest(F.col("pos"), ended), F.lit(0)))
    found = at.groupBy(*by).agg(
        F.sum("_new").cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("_lost").alias("_lost"), F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("spans"),
    ).withColumnRenamed("doc_id", "_d").withColumnRenamed("_key", "_k")
    # sets leave out nulls
    found = found.withColumn("items", F.when(F.col("_lost"), F.concat(F.array(F.lit(None).cast("string")), "items")).otherwise(F.col("items"))).drop("_lost")
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    return out.select("doc_id", "_key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, least: int = 1) -> DataFrame:
    """docs without the rows of which at least ``least`` words are hit."""
    _, hits = find_hits(docs, benchmark, n)
    if least > 1:
        hits = scan(docs, benchmark, n).where(F.col("n_hit") >= least)
    d, k = common.unused(docs, "_d", "_k")
    bad = hits.select(F.col("doc_id").alias(d), F.col("_key").alias(k)).distinct()
    text = F.coalesce(docs["text"], F.lit(""))
    key = F.struct(F.xxhash64(text).alias("a"), F.length(text).alias("b"))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad[d]) & (key == bad[k]), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: DuckDB SQL for the same rows.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bl AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT k, i, dw.n AS n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM h) GROUP BY k),
q AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(q.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(q.s, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (k) LEFT JOIN q USING (k)
"""
