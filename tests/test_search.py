import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborsim.functions import text, vectors
from arborsim.operators import maintain, search
from arborsim.schema import SearchOptions


@pytest.fixture(scope="module")
def tree(spark):
    rows = [("a.txt", b"alpha"), ("b.txt", b"beta"), ("c.txt", b"gamma")]
    return spark.createDataFrame(rows, "path string, content binary").withColumn("blob_sha", text.blob_sha(F.col("content")))


def indexed(spark, tree, vecs):
    shas = {r.path: r.blob_sha for r in tree.collect()}
    return spark.createDataFrame([(shas.get(p, p), v) for p, v in vecs.items()], "blob_sha string, vec array<float>")


ABC = {"a.txt": [1.0, 0.0, 0.0], "b.txt": [0.9, 0.1, 0.0], "c.txt": [0.0, 1.0, 0.0]}


# fixed values: what any implementation of these functions must give


@pytest.mark.parametrize("precision", ["double", "float"])
@pytest.mark.parametrize(("a", "b", "dims", "want"), [([1, 2, 3], [1, 2, 3], 3, 1), ([1, 0], [0, 1], 2, 0), ([1, 0], [-1, 0], 2, -1), ([1, 2], [0, 0], 2, 0), ([1, 0, 999], [1, 0, -999], 2, 1), ([1, 2], [3, 4], 0, 0), ([1, 0, 0], [1, 0], 3, 1), ([1, 2], [3, 4], -1, 0)])
def test_cosine(spark, a, b, dims, want, precision):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<float>, b array<float>")
    assert df.select(vectors.cosine(F.col("a"), F.col("b"), dims, precision)).first()[0] == pytest.approx(want, abs=1e-6)


def test_cosine_of_nan_is_null(spark):
    df = spark.createDataFrame([([float("nan"), 1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert df.select(vectors.cosine(F.col("a"), F.col("b"), 2)).first()[0] is None


@pytest.mark.parametrize(("v", "dims", "want"), [([3, 4, 100], 2, [0.6, 0.8]), ([0, 0], 2, [0, 0]), ([3, 4], 100, [0.6, 0.8])])
def test_truncate_and_normalize(spark, v, dims, want):
    df = spark.createDataFrame([([float(x) for x in v],)], "v array<float>")
    assert df.select(vectors.truncate_and_normalize(F.col("v"), dims)).first()[0] == pytest.approx(want, abs=1e-6)


def paths(df):
    return [r.path for r in df.collect()]


def test_search(spark, tree):
    index, q = indexed(spark, tree, ABC), [1.0, 0.0, 0.0]
    assert paths(search.search(index, tree, q)) == ["a.txt", "b.txt", "c.txt"]
    assert paths(search.search(index, tree, q, SearchOptions(top=1))) == ["a.txt"]
    assert paths(search.search(index, tree, q, SearchOptions(top=0))) == []
    assert paths(search.search(indexed(spark, tree, ABC | {"b.txt": [1.0, 0.0, 0.0]}), tree, q, SearchOptions(path="a"))) == ["a.txt"]
    assert paths(search.search(index.limit(0), tree, q)) == []
    assert paths(search.search(indexed(spark, tree, {"a.txt": [1.0, 0.0, 0.0], "deadbeef" * 5: [1.0, 0.0, 0.0]}), tree, q)) == ["a.txt"]


def test_search_fans_out_to_copies(spark):
    tree = spark.createDataFrame([("a.txt", b"same"), ("b.txt", b"same"), ("c.txt", b"other")], "path string, content binary").withColumn("blob_sha", text.blob_sha(F.col("content")))
    assert maintain.sha_to_paths(tree).where("size(paths) = 2").first().paths == ["a.txt", "b.txt"]
    index = indexed(spark, tree, {"a.txt": [1.0, 0.0], "c.txt": [0.0, 1.0]})
    assert paths(search.search(index, tree, [1.0, 0.0])) == ["a.txt", "b.txt", "c.txt"]
    assert paths(search.similar(index, tree, "a.txt")) == ["c.txt"]


def test_similar(spark, tree):
    index = indexed(spark, tree, {k: ABC[k] for k in ("a.txt", "b.txt")})
    assert paths(search.similar(index, tree, "a.txt")) == ["b.txt"]
    with pytest.raises(ValueError, match="not found"):
        search.similar(index, tree, "nope.txt")
    with pytest.raises(ValueError, match="not indexed"):
        search.similar(index, tree, "c.txt")


def test_wide_vectors_take_the_numpy_path(spark):
    rng = np.random.default_rng(1)
    rows = [(f"{i:03}", rng.normal(size=300 if i % 5 else 260).astype("f4").tolist()) for i in range(60)] + [("zero", [0.0] * 300), ("nan", [math.nan] * 300), ("none", None)]
    index, q = spark.createDataFrame(rows, "blob_sha string, vec array<float>"), rng.normal(size=300).tolist()
    got = {r.blob_sha: r.score for r in search.scores(index, q, 300).collect()}
    want = {r.blob_sha: r.score for r in index.where("vec is not null").select("blob_sha", vectors.cosine(F.col("vec"), F.array(*map(F.lit, q)), 300).alias("score")).collect()}
    assert got.keys() == want.keys() and got["nan"] is None and want["nan"] is None
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got if k != "nan")


def test_the_path_filter_reaches_the_scan(spark, tree, tmp_path):
    tree.write.parquet(f"file://{tmp_path}/tree")
    df = search.ranked(indexed(spark, tree, ABC), spark.read.parquet(f"file://{tmp_path}/tree"), [1.0, 0.0, 0.0], SearchOptions(path="a"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,a)" in plan and "TakeOrderedAndProject" in plan and "content" not in plan.split("ReadSchema")[1][:80]


def test_format(spark):
    df = spark.createDataFrame([(0.98765, "a.txt")], "score double, path string")
    assert search.format_results(df).first()[0] == "0.9877  a.txt"


TEXT = ["src/main.rs", "README.md", "config.yaml", "Dockerfile.dockerfile", ".gitignore", "FILE.RS", "notes.TXT", "App.Jsx", "Makefile", "LICENSE", "src.bak/main.rs"]
OTHER = ["image.png", "archive.zip", "model.onnx", "archive.tar.gz", "src.bak/Makefile"]


def test_text_paths(spark):
    df = spark.createDataFrame([(p,) for p in TEXT + OTHER], "path string")
    assert paths(df.where(text.is_text_path(F.col("path")))) == TEXT


def test_figures():
    assert [text.fmt_bytes(n) for n in (5, 2048, 3 << 20, 5 << 29)] == ["5 B", "2.0 KiB", "3.00 MiB", "2.50 GiB"]
    assert [text.fmt_duration(s) for s in (2.5, 0.0123, 0.0000042)] == ["2.50s", "12.3ms", "4µs"]
    assert [text.fmt_count(n) for n in (7, 1500, 2_500_000)] == ["7", "1.5K", "2.50M"]
    with pytest.raises(ValueError):
        text.query_text([])


def test_multi_query(spark, tree):
    index = indexed(spark, tree, ABC)
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "query_id long, query_vec array<float>")
    shas = {r.blob_sha: r.path for r in tree.collect()}
    assert {(r.query_id, shas[r.blob_sha]) for r in search.search_many(index, q, 3, 1).collect()} == {(1, "a.txt"), (2, "c.txt")}


def test_search_is_ranked_whatever_it_looks_up_first(spark, monkeypatch):
    """Many stale rows, ties across the block's end, a narrow path: the short way gives up or agrees."""
    rng = np.random.default_rng(9)
    vecs = [rng.integers(-2, 3, 20).astype(float).tolist() for _ in range(40)]
    index = spark.createDataFrame([(f"s{i:03}", vecs[i % 40]) for i in range(300)], "blob_sha string, vec array<float>")
    files = [(f"p{i % 7}/f{i:03}", f"s{i:03}") for i in range(0, 300, 3)] + [("p0/copy", "s003"), ("p0/lost", "none")]
    tree = spark.createDataFrame(files, "path string, blob_sha string")
    monkeypatch.setattr(search, "LEAST", 8)
    monkeypatch.setattr(search, "AHEAD", 2)
    for options in (SearchOptions(20, 10), SearchOptions(20, 3, "p6"), SearchOptions(20, 200), SearchOptions(20, 5, "nowhere"), SearchOptions(20, 0)):
        want = [tuple(r) for r in search.ranked(index, tree, vecs[5], options).collect()]
        assert [tuple(r) for r in search.search(index, tree, vecs[5], options).collect()] == want
        assert [tuple(r) for r in search.search(search.pack(index), tree, vecs[5], options).collect()] == want


def test_packed_vectors_score_alike(spark):
    rng = np.random.default_rng(1)
    rows = [(f"{i:03}", rng.normal(size=300 if i % 5 else 260).astype("f4").tolist()) for i in range(60)] + [("zero", [0.0] * 300), ("none", None), ("short", [])]
    index = spark.createDataFrame(rows, "blob_sha string, vec array<float>")
    for dims in (0, 3, 16, 280, 768):
        q = rng.normal(size=300).tolist()
        got = {r.blob_sha: r.score for r in search.scores(search.pack(index), q, dims).collect()}
        want = {r.blob_sha: r.score for r in search.scores(index.where("vec is not null"), q, dims).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
