"""The query catalogue over the test tables, and the same in DuckDB SQL.

The tree is made of ``documents`` (a path from source, id and an ending by id), the index of ``embeddings``
(vec_id = doc_id, one vector for each content: that of the lowest id; other vectors are stale rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborsim import schema
from arborsim.functions import text, vectors
from arborsim.operators import chunking, embed, maintain, pooling, search
from arborsim.schema import SearchOptions
from arborsim.sources import scratch

TARGET, QUERIES, BUDGET = 3, 5, 40


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """path, blob_sha, content, doc_id."""
    docs = _table(spark, d, "documents")
    end = F.element_at(F.array(*map(F.lit, (".md", ".rs", ".png", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.select(F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), end).alias("path"), text.blob_sha(F.col("text")).alias("blob_sha"), F.col("text").cast("binary").alias("content"), "doc_id")


def _index(spark: SparkSession, d: str, stale: bool = False) -> DataFrame:
    vecs = _table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    shas = _tree(spark, d).select("blob_sha", "doc_id")
    index = vecs.join(shas, vecs["vec_id"] == shas["doc_id"]).groupBy("blob_sha").agg(F.min_by("vec", "vec_id").alias("vec"))
    if stale:
        old = vecs.where("vec_id % 50 = 7").select(F.sha1(F.concat(F.lit("stale "), F.col("vec_id").cast("string")).cast("binary")).alias("blob_sha"), "vec")
        index = index.unionByName(old)
    return index


def _query_vector(spark: SparkSession, d: str, vec_id: int = TARGET) -> list[float]:
    return _table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def _r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _similar_vectors(dims: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = _table(spark, d, "embeddings")
        rows = e.where(F.col("vec_id") != TARGET).select(F.col("vec_id").cast("string").alias("blob_sha"), F.col("embedding").alias("vec"))
        found = search.scores(rows, _query_vector(spark, d), dims).select(F.col("blob_sha").cast("long").alias("vec_id"), _r("score").alias("score"))
        return search.top_k(found, 10, "vec_id")

    return run


def _literal(n: int = 64) -> list[float]:
    return [((i * 7) % 11 - 5) / 5 for i in range(n)]


def search_literal_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("blob_sha"), F.col("embedding").alias("vec"))
    found = search.scores(rows, _literal(), 64).select(F.col("blob_sha").cast("long").alias("vec_id"), _r("score").alias("score"))
    return search.top_k(found, 10, "vec_id")


def search_multi_query_topk(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "embeddings")
    q = e.where(F.col("vec_id") < QUERIES).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    index = e.select(F.format_string("%012d", "vec_id").alias("blob_sha"), F.col("embedding").alias("vec"))
    found = search.search_many(index, q, 32, 5)
    return found.select("query_id", F.col("blob_sha").cast("long").alias("vec_id"), _r("score").alias("score"), F.col("rank").cast("int").alias("rank"))


CASES = "(1, array(1d,2d,3d), array(1d,2d,3d), 3), (2, array(1d,0d), array(0d,1d), 2), (3, array(1d,0d), array(-1d,0d), 2), (4, array(1d,2d), array(0d,0d), 2), (5, array(1d,0d,999d), array(1d,0d,-999d), 2), (6, array(1d,2d), array(3d,4d), 0), (7, array(1d,0d,0d), array(1d,0d), 3)"


def cosine_edge_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM VALUES {CASES} AS t(id, a, b, dims)")
    return rows.select("id", _r(vectors.cosine(F.col("a"), F.col("b"), F.col("dims"))).alias("score"))


def truncate_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.truncate_and_normalize(F.col("embedding"), 16)).alias("pos", "v"))
    return e.select("vec_id", "pos", _r("v").alias("value"))


def blob_sha_catalog(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select("doc_id", "path", "blob_sha")


def sha_to_paths(spark: SparkSession, d: str) -> DataFrame:
    return maintain.sha_to_paths(_tree(spark, d)).select("blob_sha", F.size("paths").cast("long").alias("n_paths"), F.array_join("paths", ",").alias("paths"))


PATHS = ("src/main.rs", "README.md", "config.yaml", "Dockerfile.dockerfile", ".gitignore", "FILE.RS", "notes.TXT", "App.Jsx", "Makefile", "LICENSE", "src.bak/main.rs", "image.png", "archive.zip", "model.onnx", "archive.tar.gz", "src.bak/Makefile")


def text_blob_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _tree(spark, d).select("path").unionByName(_table(spark, d, "pages").select(F.col("url").alias("path"))).unionByName(spark.createDataFrame([(p,) for p in PATHS], "path string"))
    return rows.select("path", text.is_text_path(F.col("path")).alias("is_text"))


def size_guard(spark: SparkSession, d: str) -> DataFrame:
    """Sizes against the limit and against a smaller one, which test data exceed at every scale."""
    rows = _tree(spark, d).select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), text.within_size(F.col("content")).alias("kept"), text.within_size(F.col("content"), 4096).alias("kept_small"))
    return rows


def _found(df: DataFrame) -> DataFrame:
    return df.select(_r("score").alias("score"), "path", "blob_sha")


def search_with_paths(spark: SparkSession, d: str) -> DataFrame:
    return _found(search.search(_index(spark, d), _tree(spark, d), _query_vector(spark, d), SearchOptions(64, 10)))


def search_path_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _found(search.search(_index(spark, d), _tree(spark, d), _query_vector(spark, d), SearchOptions(64, 10, "src1")))


def search_stale_excluded(spark: SparkSession, d: str) -> DataFrame:
    return _found(search.search(_index(spark, d, True), _tree(spark, d), _query_vector(spark, d, 7), SearchOptions(32, 20)))


def search_packed(spark: SparkSession, d: str) -> DataFrame:
    return _found(search.search(search.pack(_index(spark, d, True)), _tree(spark, d), _query_vector(spark, d), SearchOptions(48, 25)))


def similar_excludes_copies(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)
    return _found(search.similar(_index(spark, d), tree, tree.where(F.col("doc_id") == TARGET).first()["path"], SearchOptions(64, 15)))


def format_results(spark: SparkSession, d: str) -> DataFrame:
    return search.format_results(search_with_paths(spark, d))


def update_new_blobs(spark: SparkSession, d: str) -> DataFrame:
    return maintain.new_entries(_tree(spark, d), _index(spark, d, True)).select("path", "blob_sha")


def gc_retained(spark: SparkSession, d: str) -> DataFrame:
    return maintain.prune(_index(spark, d, True), _tree(spark, d)).select("blob_sha")


def gc_pruned_count(spark: SparkSession, d: str) -> DataFrame:
    return maintain.gc_counts(_index(spark, d, True), _tree(spark, d))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return maintain.status(_index(spark, d, True), _tree(spark, d))


def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d, True)
    new = _tree(spark, d).select("blob_sha", F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")).alias("vec"))
    return maintain.upsert(maintain.prune(index, _tree(spark, d)), new).select("blob_sha", F.size("vec").cast("long").alias("dims"))


def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.chunk_lines(_table(spark, d, "documents"), BUDGET)
    return out.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("n_lines").cast("long").alias("n_lines"), F.col("tokens").cast("long").alias("tokens"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.chunk_lines(_table(spark, d, "documents"), BUDGET)
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("tokens").alias("tokens"), F.max("tokens").cast("long").alias("largest"))


def weighted_pool(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "embeddings").withColumn("w", F.col("vec_id") % 7)
    out = pooling.weighted_pool(e, "label", "embedding", "w")
    return out.select("label", F.posexplode("vec").alias("pos", "v")).select("label", "pos", _r("v").alias("value"))


def masked_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    """Token rows of a text are the vectors of a label; the mask leaves out every third."""
    e = _table(spark, d, "embeddings").withColumn("m", F.when(F.col("vec_id") % 3 == 0, 0.0).otherwise(1.0))
    out = pooling.masked_pool(e, "label", "embedding", "m")
    return out.select("label", F.posexplode("vec").alias("pos", "v")).select("label", "pos", _r("v").alias("value"))


def batch_plan(spark: SparkSession, d: str) -> DataFrame:
    """Greedy batches of all documents by white-space words."""
    docs = _table(spark, d, "documents").select("doc_id", F.size(F.filter(F.split("text", " "), lambda w: w != "")).alias("tokens"))
    return chunking.plan_batches(docs, "tokens", chunking.BatchConfig.with_batch_size(8), "doc_id")


MEMORY = tuple(m << 20 for m in (0, 512, 1024, 1100, 1200, 2048, 3000, 4096, 16384))


def batch_config(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(m,) for m in MEMORY], "available long")
    size = chunking.batch_size_column(F.col("available"))
    return rows.select("available", size.alias("batch_size"), chunking.batch_tokens_column(size).alias("batch_tokens"))


def index_codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The index as a file and read back from it."""
    from arborsim.sources import codec

    at = scratch.path(spark, "codec") + "/index.bin"
    codec.export(_index(spark, d), schema.IndexMeta(dims=64), at)
    model = codec.read_model(spark, at)
    return codec.read_files(spark, at).select("blob_sha", F.size("vec").alias("dims"), _r(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)).alias("total"), F.lit(model).alias("model"))


def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d).groupBy("blob_sha").agg(F.first("content").alias("content"))
    out = embed.embed(maintain.readable(tree), embed.HashingEmbedder(), config=chunking.BatchConfig())
    return out.select("blob_sha", F.size("vec").alias("dims"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.abs(x)), 3).alias("weight"))


def stream_update(spark: SparkSession, d: str) -> DataFrame:
    """The index after a stream of the tree's files, the documents table, has been taken in."""
    from arborsim.sources.index_store import IndexStore
    from arborsim.streaming.update import stream_update as start

    at = scratch.path(spark, "stream")
    _tree(spark, d).select("path", "blob_sha", "content").write.parquet(f"{at}/files")
    store = IndexStore(spark, f"{at}/index")
    files = spark.readStream.schema(schema.BLOBS).option("maxFilesPerTrigger", 4).parquet(f"{at}/files")
    start(files, store, embed.HashingEmbedder(), f"{at}/checkpoint").awaitTermination()
    return store.load()[1].select("blob_sha", F.size("vec").alias("dims"))


def engine_update(spark: SparkSession, d: str) -> DataFrame:
    """The index after an update with two thirds of the tree, one with half of it, and a collection with four fifths."""
    from arborsim.plans.engine import Engine

    engine, tree = Engine(spark, scratch.path(spark, "engine"), embed.HashingEmbedder()), _tree(spark, d)
    engine.update(tree.where("doc_id % 3 <> 0"))
    engine.update(tree.where("doc_id % 2 = 0"))
    engine.gc(tree.where("doc_id % 5 <> 0"))
    return engine.store.load()[1].select("blob_sha", F.size("vec").alias("dims"))


def engine_status(spark: SparkSession, d: str) -> DataFrame:
    from arborsim.plans.engine import Engine

    engine, tree = Engine(spark, scratch.path(spark, "engine"), embed.HashingEmbedder()), _tree(spark, d)
    did = engine.update(tree)
    return engine.status(tree).select("*", *(F.lit(did[k]).cast("long").alias(k) for k in ("entries", "distinct", "skipped")))


def task_prefix(spark: SparkSession, d: str) -> DataFrame:
    """What a model reads of a document and of a query."""
    both = _table(spark, d, "documents").select("doc_id", "lang", text.with_task(F.col("text"), "document").alias("document"), text.with_task(F.col("lang"), "query").alias("query"))
    return both.select("doc_id", F.md5(F.col("document").cast("binary")).alias("document_md5"), "query")


class _Fixed(embed.HashingEmbedder):
    """Gives one vector for whatever it reads."""

    def __init__(self, vec: list[float]):
        super().__init__(len(vec))
        self.vec = vec

    def embed_batch(self, texts: list[str]):
        import numpy as np

        return np.array([self.vec] * len(texts), np.float32)


def _stored(spark: SparkSession, d: str, embedder: embed.Embedder | None = None):
    """An engine whose store holds the index."""
    from arborsim.plans.engine import Engine

    engine = Engine(spark, scratch.path(spark, "engine"), embedder)
    engine.store.save(_index(spark, d, True), schema.IndexMeta(dims=64))
    return engine


def engine_search(spark: SparkSession, d: str) -> DataFrame:
    engine = _stored(spark, d, _Fixed(_query_vector(spark, d)))
    return _found(engine.search(["any", "words"], _tree(spark, d), SearchOptions(64, 12, "src")))


def engine_similar(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)
    return _found(_stored(spark, d).similar(tree.where(F.col("doc_id") == TARGET).first()["path"], tree, SearchOptions(64, 15)))


def git_tree_scan(spark: SparkSession, d: str) -> DataFrame:
    """The files of a repository that is made of the tree, through one git process, in the shared folder."""
    from arborsim.sources import git_tree

    at = scratch.local(spark, scratch.path(spark, "repository.git"))
    files = ((r["path"], bytes(r["content"])) for r in _tree(spark, d).select("path", "content").toLocalIterator())
    return git_tree.read(spark, git_tree.make(at, files)).select("path", "blob_sha", F.octet_length("content").cast("long").alias("n_bytes"))


def queries() -> dict:
    plain = (
        search_literal_topk, search_multi_query_topk, cosine_edge_cases, truncate_normalize, blob_sha_catalog, sha_to_paths, text_blob_filter, size_guard, search_with_paths,
        search_path_prefix, search_stale_excluded, search_packed, similar_excludes_copies, format_results, update_new_blobs, gc_retained, gc_pruned_count, status_counts, index_upsert, chunk_lines,
        chunk_stats, weighted_pool, masked_mean_pool, batch_plan, batch_config, index_codec_roundtrip, embed_documents, stream_update, engine_update, engine_status, engine_search, engine_similar, task_prefix, git_tree_scan,
    )
    return {"similar_topk_full": _similar_vectors(64), "similar_topk_prefix16": _similar_vectors(16), "similar_topk_prefix32": _similar_vectors(32)} | {f.__name__: f for f in plain}


def _cos(a: str, b: str, n: str, places: int = 6) -> str:
    a, b = f"CAST(({a})[1:{n}] AS DOUBLE[])", f"CAST(({b})[1:{n}] AS DOUBLE[])"
    return f"round(CASE WHEN {n} = 0 OR sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) = 0 THEN 0 ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END, {places})"


_EXT = "lower(regexp_extract(path, '(\\.[^.]*)$', 1))"
_SET = ", ".join(f"'{x}'" for x in schema.TEXT_EXTENSIONS)
_IS_TEXT = f"({_EXT} = '' OR {_EXT} IN ({_SET}))"
_TREE = "tree AS (SELECT doc_id, concat(source, '/doc_', doc_id, CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.rs' WHEN 2 THEN '.png' ELSE '' END) AS path, sha1(concat('blob ', CAST(strlen(text) AS VARCHAR), chr(0), text)) AS blob_sha, text FROM documents)"
_INDEX = "fresh AS (SELECT blob_sha, arg_min(embedding, vec_id) AS vec FROM tree JOIN embeddings ON vec_id = doc_id GROUP BY blob_sha)"
_STALE = "idx AS (SELECT * FROM fresh UNION ALL SELECT sha1(concat('stale ', vec_id)) AS blob_sha, embedding AS vec FROM embeddings WHERE vec_id % 50 = 7)"
_BOTH, _ALL = f"WITH {_TREE}, {_INDEX}", f"WITH {_TREE}, {_INDEX}, {_STALE}"


def _similar_sql(n: int) -> str:
    return f"SELECT e.vec_id, {_cos('e.embedding', 'q.embedding', str(n))} AS score FROM embeddings e, embeddings q WHERE q.vec_id = {TARGET} AND e.vec_id <> {TARGET} ORDER BY score DESC, e.vec_id LIMIT 10"


def _search_sql(index: str, q: str, n: int, top: int, more: str = "") -> str:
    best = f"SELECT {_cos('i.vec', 'q.v', str(n), 12)} AS s, path, t.blob_sha FROM {index} i JOIN tree t USING (blob_sha), ({q}) q WHERE true {more} ORDER BY s DESC, path LIMIT {top}"
    return f"SELECT round(s, 6) AS score, path, blob_sha FROM ({best})"


def _vec(k: int) -> str:
    return f"SELECT embedding AS v FROM embeddings WHERE vec_id = {k}"


_WITH_PATHS = _search_sql("fresh", _vec(TARGET), 64, 10)
_LINES = (
    "l0 AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM documents WHERE text IS NOT NULL), "
    "l1 AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1 : len(a) - 1] ELSE a END AS a FROM l0), "
    "l2 AS (SELECT doc_id, i, a[i] AS line, CAST(greatest(len(list_filter(regexp_split_to_array(a[i], '[ \\t]+'), lambda w: w <> '')), 1) AS BIGINT) AS n FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM l1)), "
    "f AS (SELECT doc_id, i, n AS used, CAST(0 AS BIGINT) AS c FROM l2 WHERE i = 1 UNION ALL "
    f"SELECT l.doc_id, l.i, CASE WHEN f.used + l.n <= {BUDGET} THEN f.used + l.n ELSE l.n END, CASE WHEN f.used + l.n <= {BUDGET} THEN f.c ELSE f.c + 1 END FROM f JOIN l2 l ON l.doc_id = f.doc_id AND l.i = f.i + 1), "
    "ch AS (SELECT f.doc_id, f.c AS chunk_idx, count(*) AS n_lines, CAST(sum(l2.n) AS BIGINT) AS tokens, md5(string_agg(l2.line, chr(10) ORDER BY l2.i)) AS chunk_md5 FROM f JOIN l2 USING (doc_id, i) GROUP BY ALL)"
)
_BATCH = (
    "r AS (SELECT doc_id, tokens, row_number() OVER (ORDER BY tokens, doc_id) AS k FROM (SELECT doc_id, CAST(len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS INTEGER) AS tokens FROM documents)), "
    "b AS (SELECT k, doc_id, tokens, CAST(1 AS BIGINT) AS size, CAST(0 AS BIGINT) AS batch FROM r WHERE k = 1 UNION ALL "
    "SELECT r.k, r.doc_id, r.tokens, CASE WHEN b.size >= 8 OR (b.size + 1) * r.tokens > 4096 THEN 1 ELSE b.size + 1 END, CASE WHEN b.size >= 8 OR (b.size + 1) * r.tokens > 4096 THEN b.batch + 1 ELSE b.batch END FROM b JOIN r ON r.k = b.k + 1)"
)
_READABLE = f"{_IS_TEXT} AND strlen(text) BETWEEN 1 AND 102400"


def oracle_sql() -> dict[str, str]:
    literal = "CAST([" + ", ".join(map(str, _literal())) + "] AS DOUBLE[])"
    cases = CASES.replace("array(", "[").replace("d)", "d]").replace("d", "::DOUBLE").replace("]::DOUBLE", "]")
    size = "greatest(1, least(32, greatest(available - 1107296256, 0) // 94371840))"
    return {
        "similar_topk_full": _similar_sql(64), "similar_topk_prefix16": _similar_sql(16), "similar_topk_prefix32": _similar_sql(32),
        "search_literal_topk": f"SELECT vec_id, {_cos('embedding', literal, '64')} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10",
        "search_multi_query_topk": f"SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_cos('e.embedding', 'q.embedding', '32')} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_cos('e.embedding', 'q.embedding', '32')} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id < {QUERIES}) WHERE rank <= 5",
        "cosine_edge_cases": f"SELECT id, {_cos('a', 'b', 'n')} AS score FROM (SELECT *, least(dims, len(a), len(b)) AS n FROM (VALUES {cases}) t(id, a, b, dims))",
        "truncate_normalize": "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(CASE WHEN n = 0 THEN p[i] ELSE p[i] / n END, 6) AS value FROM (SELECT vec_id, p, sqrt(list_dot_product(p, p)) AS n, unnest(range(1, len(p) + 1)) AS i FROM (SELECT vec_id, CAST(embedding[1:16] AS DOUBLE[]) AS p FROM embeddings))",
        "blob_sha_catalog": f"WITH {_TREE} SELECT doc_id, path, blob_sha FROM tree",
        "sha_to_paths": f"WITH {_TREE} SELECT blob_sha, count(*) AS n_paths, string_agg(path, ',' ORDER BY path) AS paths FROM tree GROUP BY blob_sha",
        "text_blob_filter": f"WITH {_TREE} SELECT path, {_IS_TEXT} AS is_text FROM (SELECT path FROM tree UNION ALL SELECT url FROM pages UNION ALL VALUES " + ", ".join(f"('{p}')" for p in PATHS) + ")",
        "size_guard": "SELECT doc_id, strlen(text) AS n_bytes, strlen(text) BETWEEN 1 AND 102400 AS kept, strlen(text) BETWEEN 1 AND 4096 AS kept_small FROM documents",
        "search_with_paths": f"{_BOTH} {_WITH_PATHS}",
        "search_path_prefix": f"{_BOTH} {_search_sql('fresh', _vec(TARGET), 64, 10, "AND starts_with(path, 'src1')")}",
        "search_stale_excluded": f"{_ALL} {_search_sql('idx', _vec(7), 32, 20)}",
        "similar_excludes_copies": f"{_BOTH} {_search_sql('fresh', f'SELECT vec AS v, blob_sha AS own FROM fresh WHERE blob_sha = (SELECT blob_sha FROM tree WHERE doc_id = {TARGET})', 64, 15, 'AND t.blob_sha <> q.own')}",
        "format_results": f"{_BOTH} SELECT printf('%.4f  %s', score, path) AS line FROM ({_WITH_PATHS})",
        "update_new_blobs": f"{_ALL} SELECT path, blob_sha FROM tree WHERE {_IS_TEXT} AND blob_sha NOT IN (SELECT blob_sha FROM idx)",
        "gc_retained": f"{_ALL} SELECT blob_sha FROM idx WHERE blob_sha IN (SELECT blob_sha FROM tree)",
        "gc_pruned_count": f"{_ALL} SELECT count(*) FILTER (blob_sha IN (SELECT blob_sha FROM tree)) AS kept, count(*) FILTER (blob_sha NOT IN (SELECT blob_sha FROM tree)) AS pruned FROM idx",
        "status_counts": f"{_ALL} SELECT (SELECT count(*) FROM tree) AS total, (SELECT count(*) FROM idx) AS indexed",
        "index_upsert": f"{_ALL}, k AS (SELECT blob_sha, len(vec) AS dims FROM idx WHERE blob_sha IN (SELECT blob_sha FROM tree)) SELECT * FROM k UNION ALL SELECT DISTINCT blob_sha, CAST(2 AS BIGINT) FROM tree WHERE blob_sha NOT IN (SELECT blob_sha FROM k)",
        "chunk_lines": f"WITH RECURSIVE {_LINES} SELECT doc_id, chunk_idx, n_lines, tokens, chunk_md5 FROM ch",
        "chunk_stats": f"WITH RECURSIVE {_LINES} SELECT doc_id, count(*) AS n_chunks, CAST(sum(tokens) AS BIGINT) AS tokens, max(tokens) AS largest FROM ch GROUP BY doc_id",
        "weighted_pool": "SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(CASE WHEN sum(w) = 0 THEN 0 ELSE sum(CAST(embedding[i] AS DOUBLE) * w) / sum(w) END, 6) AS value FROM (SELECT label, embedding, CAST(vec_id % 7 AS DOUBLE) AS w, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i",
        "masked_mean_pool": "SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(sum(CAST(embedding[i] AS DOUBLE) * m) / greatest(sum(m), 1e-9), 6) AS value FROM (SELECT label, embedding, CASE WHEN vec_id % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS m, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i",
        "batch_plan": f"WITH RECURSIVE {_BATCH} SELECT doc_id, tokens, batch FROM b",
        "search_packed": f"{_ALL} {_search_sql('idx', _vec(TARGET), 48, 25)}",
        "index_codec_roundtrip": f"{_BOTH} SELECT blob_sha, CAST(len(vec) AS INTEGER) AS dims, round(list_sum(CAST(vec AS DOUBLE[])), 6) AS total, '{schema.MODEL}' AS model FROM fresh",
        "stream_update": f"WITH {_TREE} SELECT DISTINCT blob_sha, CAST(64 AS INTEGER) AS dims FROM tree WHERE {_READABLE}",
        "engine_update": f"WITH {_TREE}, a AS (SELECT DISTINCT blob_sha FROM tree WHERE {_READABLE} AND doc_id % 3 <> 0), b AS (SELECT blob_sha FROM a WHERE blob_sha IN (SELECT blob_sha FROM tree WHERE doc_id % 2 = 0) UNION SELECT blob_sha FROM tree WHERE {_READABLE} AND doc_id % 2 = 0) SELECT blob_sha, CAST(64 AS INTEGER) AS dims FROM b WHERE blob_sha IN (SELECT blob_sha FROM tree WHERE doc_id % 5 <> 0)",
        "engine_status": f"WITH {_TREE} SELECT count(*) AS total, count(DISTINCT blob_sha) FILTER ({_READABLE}) AS indexed, 'hashing-64' AS model, 64 AS dims, count(*) FILTER ({_READABLE}) AS entries, count(DISTINCT blob_sha) FILTER ({_READABLE}) AS \"distinct\", count(*) FILTER ({_IS_TEXT} AND strlen(text) NOT BETWEEN 1 AND 102400) AS skipped FROM tree",
        "engine_search": f"{_ALL} {_search_sql('idx', _vec(TARGET), 64, 12, "AND starts_with(path, 'src')")}",
        "engine_similar": f"{_ALL} {_search_sql('idx', f'SELECT vec AS v, blob_sha AS own FROM fresh WHERE blob_sha = (SELECT blob_sha FROM tree WHERE doc_id = {TARGET})', 64, 15, 'AND t.blob_sha <> q.own')}",
        "task_prefix": f"SELECT doc_id, md5(concat('{schema.PREFIX_DOCUMENT}', text)) AS document_md5, concat('{schema.PREFIX_QUERY}', lang) AS query FROM documents",
        "git_tree_scan": f"WITH {_TREE} SELECT path, blob_sha, strlen(text) AS n_bytes FROM tree",
        "batch_config": f"SELECT available, CAST({size} AS INTEGER) AS batch_size, CAST(CASE WHEN {size} >= 32 THEN 16384 ELSE greatest({size} * 512, 512) END AS INTEGER) AS batch_tokens FROM (VALUES " + ", ".join(f"({m}::BIGINT)" for m in MEMORY) + ") t(available)",
    }
