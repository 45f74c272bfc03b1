import os
import subprocess
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborsim import schema
from arborsim.functions import text
from arborsim.operators import chunking, embed, maintain, pooling
from arborsim.plans import engine, queries
from arborsim.plans.engine import Engine
from arborsim.sources import codec, git_tree, hooks
from arborsim.sources.index_store import IndexStore
from arborsim.streaming.update import stream_update


def blobs(spark, rows):
    return spark.createDataFrame(rows, "path string, content binary").withColumn("blob_sha", text.blob_sha(F.col("content")))


# codec


def test_codec():
    meta, rows = schema.IndexMeta(1, "m", 3), {"abc123": [1, 2, 3], "def456": [4, 5, 6]}
    data = codec.encode(meta, rows.items())
    got_meta, got = codec.decode(data + b"tail")
    assert got_meta == meta and {k: v.tolist() for k, v in got.items()} == rows
    assert codec.encode(schema.IndexMeta(1, "m", 2), [("aa", [1, -1])]) == bytes.fromhex("00000001 0001 6d 00000002 00000001 0002 6161 3f800000 bf800000".replace(" ", ""))
    for bad in (b"\0\1", codec.encode(schema.IndexMeta(1, "m", 0), []), bytes.fromhex("00000001 0001 6d ffffffff 00000000"), bytes.fromhex("00000001 0001 6d 00000002 ffffffff"), data[:-4]):
        with pytest.raises(codec.IndexFormatError):
            codec.decode(bad)
    with pytest.raises(codec.IndexFormatError):
        codec.encode(meta, [("aa", [1, 2])])
    with pytest.raises(codec.IndexFormatError):
        codec.write_string("x" * 65536)
    assert codec.decode(codec.encode(schema.IndexMeta(1, "m", 1), [("a", [1]), ("a", [2])]))[1]["a"].tolist() == [2]


def test_codec_files(spark, tmp_path):
    index = spark.createDataFrame([("b", [1.0, 2.0]), ("a", [3.0, 4.0])], schema.INDEX)
    assert codec.export(index, schema.IndexMeta(dims=2), f"file://{tmp_path}/index.bin") == 2
    assert (tmp_path / "index.bin").read_bytes() == codec.encode(schema.IndexMeta(dims=2), [("a", [3, 4]), ("b", [1, 2])])
    assert codec.read_model(spark, f"file://{tmp_path}/index.bin") == schema.MODEL
    (tmp_path / ".index.bin.crc").unlink()
    assert sorted(map(tuple, codec.read_files(spark, str(tmp_path)).collect())) == [("a", [3.0, 4.0]), ("b", [1.0, 2.0])]


# store


def test_store(spark, tmp_path, caplog):
    store = IndexStore(spark, f"file://{tmp_path}/index")
    meta, index = store.load()
    assert meta == schema.IndexMeta() and index.count() == 0 and not store.clear()
    for k in range(3):
        store.save(spark.createDataFrame([(f"s{k}", [float(k), 1.0])], schema.INDEX), schema.IndexMeta(dims=2, model=f"m{k}"))
        meta, index = store.load()
        assert [r.blob_sha for r in index.collect()] == [f"s{k}"] and meta.model == f"m{k}"
    store.save(maintain.upsert(store.load()[1], spark.createDataFrame([("new", [0.0, 0.0])], schema.INDEX)), meta)
    assert store.load()[1].count() == 2
    with pytest.raises(Exception, match="dims"):
        store.save(store.load()[1], schema.IndexMeta(dims=3))
    assert store.load()[1].count() == 2
    with pytest.raises(ValueError):
        store.load("other")
    store._write("CURRENT", "garbage")
    assert store.load()[1].count() == 0 and "damaged" in caplog.text
    assert store.clear() and not store.clear()


def test_damaged_rows_load_as_empty(spark, tmp_path, caplog):
    for harm in ("garble", "cut", "lose"):
        store = IndexStore(spark, f"file://{tmp_path}/{harm}")
        store.save(spark.createDataFrame([(f"s{k}", [float(k), 1.0]) for k in range(50)], schema.INDEX).repartition(2), schema.IndexMeta(dims=2))
        part = next((tmp_path / harm).glob("v*/part-*.parquet"))
        data = part.read_bytes()
        part.with_name(f".{part.name}.crc").unlink()
        part.write_bytes(b"x" * len(data) if harm == "garble" else data[: len(data) // 2])
        if harm == "lose":
            part.unlink()
        caplog.clear()
        meta, index = store.load()
        assert index.count() == 0 and meta == schema.IndexMeta() and "damaged" in caplog.text
        store.save(spark.createDataFrame([("new", [0.0, 1.0])], schema.INDEX), schema.IndexMeta(dims=2))
        assert store.load()[1].count() == 1


def test_a_reader_between_the_steps_of_a_save(spark, tmp_path, monkeypatch):
    """At each step there is a whole index: the old one, then the new."""
    store, seen = IndexStore(spark, f"file://{tmp_path}/idx"), []
    rows = lambda *names: spark.createDataFrame([(n, [1.0]) for n in names], schema.INDEX)
    look = lambda: seen.append(sorted(r.blob_sha for r in IndexStore(spark, f"file://{tmp_path}/idx").load()[1].collect()))
    store.save(rows("a"), schema.IndexMeta(dims=1))
    put, replace = IndexStore._put, IndexStore._replace

    def watched_put(self, *a):
        out = put(self, *a)
        look()
        return out

    def watched_replace(self, *a):
        look()
        replace(self, *a)
        look()

    monkeypatch.setattr(IndexStore, "_put", watched_put)
    monkeypatch.setattr(IndexStore, "_replace", watched_replace)
    store.save(rows("b", "c"), schema.IndexMeta(dims=1))
    store.append(rows("d"), schema.IndexMeta(dims=1))
    assert seen == [["a"], ["a"], ["b", "c"], ["b", "c"], ["b", "c"], ["b", "c", "d"]]
    with pytest.raises(ValueError):
        store.append(rows("e"), schema.IndexMeta(dims=1, model="other"))
    assert store.compact() == 3 and len(store.current()["dirs"]) == 1


# chunks, batches, pooling


def test_batches():
    cfg = chunking.BatchConfig
    assert [len(b) for b in chunking.make_batches([6000] * 3, cfg())] == [2, 1]
    assert [len(b) for b in chunking.make_batches([10] * 40, cfg())] == [32, 8]
    assert chunking.make_batches([500, 10, 200], cfg()) == [[1, 2, 0]]
    assert chunking.make_batches([], cfg()) == []
    assert [len(b) for b in chunking.make_batches([100] * 6, cfg.with_batch_size(2))] == [2, 2, 2]
    assert cfg.from_available_memory(16 << 30) == cfg(32, 16384)
    assert cfg.from_available_memory(2 << 30).max_batch_size == 11 and cfg.from_available_memory(1 << 30).max_batch_size == 1
    assert [cfg.with_batch_size(n).max_batch_size for n in (4, 100, 0)] == [4, 32, 1]
    assert chunking.available_memory() > 0


def test_chunks(spark):
    cost = lambda s: len(s.split()) + 2
    assert chunking.lines("a\r\nb\n\nc\n") == ["a", "b", "", "c"] and chunking.lines("") == []
    text_ = "a b\nc d\ne f g h i j k\nl\n\nm"
    want = chunking.split_text_chunks(text_, cost, "", 2 + 2 + 4)
    df = spark.createDataFrame([(1, text_), (2, ""), (3, None)], "doc_id long, text string")
    assert [r.chunk for r in chunking.chunk_lines(df, 4, lambda s: max(1, len(s.split()))).orderBy("chunk_idx").collect() if r.doc_id == 1] == want == ["a b\nc d", "e f g h i j k", "l\n\nm"]
    assert chunking.split_text_chunks("a\nb", cost, "one two", 6) == []
    assert [tuple(r) for r in chunking.chunk_lines(df, 4).where("doc_id > 1").collect()] == [(2, 0, 1, 1, "")]
    many = spark.createDataFrame([(1, "a line\n" * 200_000)], "doc_id long, text string")
    assert chunking.chunk_lines(many, 5).count() == 100_000


@pytest.mark.parametrize("config", [chunking.BatchConfig(), chunking.BatchConfig(8, 300), chunking.BatchConfig(1, 512), chunking.BatchConfig(32, 40)])
def test_plan_is_make_batches_over_the_whole_table(spark, config):
    rng = np.random.default_rng(4)
    tokens = [int(t) for t in rng.choice([0, 1, 2, 7, 7, 7, 30, 100, 500], 400)]
    df = spark.createDataFrame(list(enumerate(tokens)), "id long, tokens long").repartition(5)
    got = {r.id: r.batch for r in chunking.plan_batches(df, "tokens", config, "id").collect()}
    assert got == {i: b for b, own in enumerate(chunking.make_batches(tokens, config)) for i in own}
    assert chunking.plan_batches(df.limit(0), "tokens", config, "id").count() == 0


def test_pooling(spark):
    v = lambda x: np.full(768, x, np.float32)
    assert (pooling.weighted_average([(v(2), 1), (v(4), 1)]) == 3).all() and (pooling.weighted_average([(v(0), 1), (v(10), 3)]) == 7.5).all()
    assert (pooling.weighted_average([(v(5), 9)]) == 5).all() and (pooling.weighted_average([]) == np.zeros(768)).all()
    df = spark.createDataFrame([("k", [0.0, 1.0], 1), ("k", [10.0, 1.0], 3), ("z", [1.0, 1.0], 0)], "key string, vec array<double>, w int")
    assert {r.key: r.vec for r in pooling.weighted_pool(df, "key", "vec", "w").collect()} == {"k": [7.5, 1.0], "z": [0.0, 0.0]}
    hidden = np.arange(12, dtype=np.float32).reshape(1, 3, 4)
    assert pooling.masked_mean(hidden, np.array([[1, 1, 0]])).tolist() == [[2, 3, 4, 5]]
    assert (pooling.masked_mean(hidden, np.zeros((1, 3))) == 0).all()
    assert pooling.masked_mean(hidden[0], None).tolist() == hidden[0].tolist()
    rows = spark.createDataFrame([("k", hidden[0, i].tolist(), int(i < 2)) for i in range(3)] + [("z", [1.0], 0)], "key string, vec array<double>, m int")
    assert {r.key: r.vec for r in pooling.masked_pool(rows, "key", "vec", "m").collect()} == {"k": [2, 3, 4, 5], "z": [0.0]}


# embedding


class Fails(embed.HashingEmbedder):
    def embed_batch(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError
        return super().embed_batch(texts)


def test_embedding(spark):
    e = embed.HashingEmbedder(16)
    long = "\n".join(f"line {i} of many words here" for i in range(300))
    one, two, empty = embed.embed_texts(e, [long, "short text", ""])
    assert one.shape == two.shape == empty.shape == (16,) and (two == e.embed_batch([schema.PREFIX_DOCUMENT + "short text"])[0]).all()
    assert [v is None for v in embed.embed_texts(Fails(), ["ok", "bad", "fine"])] == [False, True, False]
    got = embed.embed(blobs(spark, [("a", b"hello"), ("b", b"bad")]), Fails())
    assert got.count() == 1
    assert not embed.model_ready(embed.model_dir("none"))


def test_engine(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/idx", embed.HashingEmbedder())
    rows = [("a.txt", b"red green blue"), ("b.txt", b"red green"), ("copy.txt", b"red green"), ("c.png", b"red"), ("big.txt", b"x" * 102_401), ("empty.txt", b""), ("raw.txt", b"\xff\xfe")]
    tree = blobs(spark, rows)
    assert engine.update(tree) == {"state": "updated", "entries": 3, "distinct": 2, "pruned": 0, "skipped": 3}
    folders = engine.store.current()["dirs"]
    assert engine.update(tree)["state"] == "current" and engine.store.current()["dirs"] == folders
    assert engine.status(tree).first()[:2] == (7, 2)
    assert [r.path for r in engine.similar("a.txt", tree).collect()] == ["b.txt", "copy.txt"]
    assert engine.search(["red", "green"], tree).first().path in ("b.txt", "copy.txt")
    less = blobs(spark, rows[:1])
    assert engine.update(less) == {"state": "pruned", "entries": 0, "distinct": 0, "pruned": 1, "skipped": 0}
    assert engine.gc(blobs(spark, [("z.txt", b"z")])) == 1 and engine.gc(less) == 0
    assert engine.clear() and not engine.clear()


def test_update_reads_new_contents_only_and_appends(spark, tmp_path):
    engine, asked = Engine(spark, f"file://{tmp_path}/idx", embed.HashingEmbedder()), []
    rows = [("a.txt", b"red green blue"), ("b.txt", b"red green"), ("c.png", b"red")]
    more = [*rows, ("d.txt", b"yellow"), ("e.txt", b"red green")]

    def contents(shas):
        asked.append(sorted(r.blob_sha for r in shas.collect()))
        return blobs(spark, more).select("blob_sha", "content").join(shas, "blob_sha").dropDuplicates(["blob_sha"])

    first, second = (blobs(spark, r).select("path", "blob_sha") for r in (rows, more))
    sha = {r.path: r.blob_sha for r in second.collect()}
    assert engine.update(first, contents)["distinct"] == 2
    folders = engine.store.current()["dirs"]
    assert engine.update(second, contents) == {"state": "updated", "entries": 1, "distinct": 1, "pruned": 0, "skipped": 0}
    assert asked == [sorted([sha["a.txt"], sha["b.txt"]]), [sha["d.txt"]]]
    assert engine.store.current()["dirs"][: len(folders)] == folders and len(engine.store.current()["dirs"]) == len(folders) + 1
    assert [r.path for r in engine.similar("a.txt", second).collect()][:2] == ["b.txt", "e.txt"]
    engine.embedder = embed.HashingEmbedder(16)  # another embedder: all anew
    assert engine.update(second, contents)["distinct"] == 3 and engine.store.load()[0].dims == 16


def test_stream(spark, tmp_path):
    files, store = f"file://{tmp_path}/files", IndexStore(spark, f"file://{tmp_path}/idx")
    for k, rows in enumerate(([("a.txt", b"one"), ("b.txt", b"two")], [("c.txt", b"two"), ("d.txt", b"three")])):
        blobs(spark, rows).select("path", "blob_sha", "content").write.mode("append").parquet(files)
        stream_update(spark.readStream.schema(schema.BLOBS).parquet(files), store, embed.HashingEmbedder(), f"file://{tmp_path}/ckpt").awaitTermination()
        assert store.load()[1].count() == k + 2
        assert len(store.current()["dirs"]) == k + 1  # what was stored isn't written again


def test_stream_query_takes_in_the_whole_table(spark, sf):
    import hashlib

    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        data = (r.text or "").encode()
        if r.doc_id % 4 != 2 and 1 <= len(data) <= 102_400:  # the others are .png
            want.add(hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest())
    assert sorted(r.blob_sha for r in queries.stream_update(spark, sf).collect()) == sorted(want)


# git


@pytest.fixture
def repo(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", tmp_path, "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    run("init", "-q", ".")
    return tmp_path, run


def test_git_tree(spark, repo):
    at, run = repo
    assert git_tree.read(spark, str(at)).count() == 0
    (at / "src").mkdir()
    for name, data in (("top.txt", "top"), ("src/lib.rs", "same"), ("src/é b.rs", "same")):
        (at / name).write_text(data)
    os.symlink("top.txt", at / "link")
    run("add", "-A")
    run("commit", "-qm", "x")
    (at / "top.txt").write_text("not committed")
    rows = {r.path: r for r in git_tree.read(spark, str(at / "src")).collect()}
    assert rows.keys() == {"top.txt", "src/lib.rs", "src/é b.rs", "link"} and bytes(rows["top.txt"].content) == b"top"
    assert git_tree.read(spark, str(at)).where(text.blob_sha(F.col("content")) != F.col("blob_sha")).count() == 0
    assert git_tree.read(spark, str(at), content=False).where("content is not null").count() == 0
    sha = rows["top.txt"].blob_sha
    assert git_tree.read_blob(git_tree.find_repo(str(at)), sha) == "top"
    for bad in ("not-a-sha", "0" * 40):
        with pytest.raises(ValueError):
            git_tree.read_blob(str(at), bad)


def test_no_repository(tmp_path):
    with pytest.raises(ValueError):
        git_tree.find_repo(str(tmp_path))


def test_hooks(repo):
    at = str(repo[0] / ".git")
    names = list(hooks.HOOKS)
    assert hooks.installed(at) == [] and hooks.missing(at) == names
    other = repo[0] / ".git/hooks/post-merge"
    other.parent.mkdir(exist_ok=True)
    other.write_text("#!/bin/sh\necho mine")
    assert hooks.install(at) == {"post-commit": "created", "post-merge": "appended", "post-checkout": "created"}
    other.write_text(other.read_text() + "echo after\n")
    assert set(hooks.install(at).values()) == {"updated"} and other.read_text().count(hooks.BEGIN) == 1
    assert hooks.installed(at) == names and os.access(other, os.X_OK)
    assert subprocess.run(["sh", "-n", str(other)], check=False).returncode == 0
    assert hooks.uninstall(at) == {"post-commit": "removed", "post-merge": "cleaned", "post-checkout": "removed"}
    assert other.read_text() == "#!/bin/sh\necho mine\necho after\n" and hooks.uninstall(at) == {}


def test_an_installed_hook_runs_the_command(repo, tmp_path):
    at, run = repo
    hooks.install(str(at / ".git"))
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/arborsim").write_text(f"#!/bin/sh\necho $1 > {tmp_path}/called\n")
    os.chmod(tmp_path / "bin/arborsim", 0o755)
    (at / "f").write_text("x")
    run("add", "f")
    env = os.environ | {"PATH": f"{tmp_path}/bin:{os.environ['PATH']}"}
    subprocess.run(["git", "-C", at, "-c", "user.name=t", "-c", "user.email=t@example.com", "commit", "-qm", "x"], env=env, check=True)
    for _ in range(50):
        if (tmp_path / "called").exists() and (tmp_path / "called").read_text():
            break
        time.sleep(0.1)
    assert (tmp_path / "called").read_text() == "update\n"


# commands


def test_commands(spark, repo, monkeypatch, capsys):
    at, run = repo
    for name, data in (("a.txt", "red green blue"), ("b.txt", "red green"), ("c.png", "red")):
        (at / name).write_text(data)
    run("add", "-A")
    run("commit", "-qm", "x")
    monkeypatch.setenv("ARBORSIM_CWD", str(at))

    def said(*argv):
        code = engine.main(list(argv))
        out = capsys.readouterr()
        return code, out.out, out.err

    assert "Indexed 2 contents of 2 files, pruned 0, skipped 0." in said("--hashing", "-v", "--time-stats", "--memory-stats")[1]
    assert said("--hashing", "update")[1].startswith("Index is up to date")
    code, out, err = said("--hashing", "-v", "--time-stats", "--memory-stats", "-d", "64", "search", "red", "green")
    assert code == 0 and out.splitlines()[0].endswith("b.txt") and "peak" in out and "search:" in err
    assert said("similar", "a.txt")[1].splitlines()[0].endswith("b.txt")
    assert "Indexed: 2 / 3 blobs" in said("status")[1] and "Pruned 0" in said("gc")[1]
    assert said("search")[0] == 1 and "not found" in said("similar", "none.txt")[2]
    monkeypatch.setenv("HOME", str(at))
    code, _, err = said("search", "red")  # no model: an error, not hashed words
    assert code == 1 and "no model" in err
    assert "created post-commit" in said("install")[1] and "removed post-commit" in said("uninstall")[1]
    assert said("clear")[1] == "Index cleared.\n" and said("clear")[1] == "No index found.\n"


# a model


def field(number, data):
    """A protobuf field: an int as varint, anything else as bytes."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return varint(number << 3) + varint(data) if isinstance(data, int) else varint(number << 3 | 2) + varint(len(data)) + data


def tiny_model(folder, vocabulary, dims):
    """An ONNX graph that looks each token's vector up, and a tokenizer of words: enough to run the embedder."""
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    table = np.random.default_rng(2).normal(size=(len(vocabulary), dims)).astype("<f4")
    weights = field(1, table.shape[0]) + field(1, table.shape[1]) + field(2, 1) + field(8, b"table") + field(9, table.tobytes())
    node = field(1, b"table") + field(1, b"input_ids") + field(2, b"hidden") + field(4, b"Gather")
    unused = field(1, b"attention_mask") + field(2, b"mask") + field(4, b"Identity")

    def value(name, kind, *shape):
        dims_ = b"".join(field(1, field(2, d.encode()) if isinstance(d, str) else field(1, d)) for d in shape)
        return field(1, name) + field(2, field(1, field(1, kind) + field(2, dims_)))

    graph = field(1, node) + field(1, unused) + field(2, b"g") + field(5, weights)
    graph += field(11, value(b"input_ids", 7, "b", "s")) + field(11, value(b"attention_mask", 7, "b", "s"))
    graph += field(12, value(b"hidden", 1, "b", "s", dims)) + field(12, value(b"mask", 7, "b", "s"))
    (folder / "model.onnx").write_bytes(field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13)))
    t = Tokenizer(models.WordLevel({w: i for i, w in enumerate(vocabulary)}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.post_processor = processors.TemplateProcessing(single="[CLS] $A [SEP]", special_tokens=[("[CLS]", 1), ("[SEP]", 2)])
    t.save(str(folder / "tokenizer.json"))
    return table


def test_onnx_embedder(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    words = ["[UNK]", "[CLS]", "[SEP]", "red", "green", "search_document", "search_query", ":", "_"]
    table = tiny_model(tmp_path, words, 8)
    e = embed.OnnxEmbedder(str(tmp_path), 8, "tiny", 1)
    assert embed.model_ready(tmp_path) and e.count_tokens("red green") == 4 and e.count_tokens("") == 2
    ids = lambda *w: table[[1, *(words.index(x) for x in w), 2]]
    both = e.embed_batch(["red", "green red green"])
    assert np.allclose(both, [ids("red").mean(0), ids("green", "red", "green").mean(0)], atol=1e-6)  # the padding is masked
    assert np.allclose(e.embed_batch(["red " * 2000])[0], table[[1, *[3] * 510, 2]].mean(0), atol=1e-5)  # cut at 512
    one = embed.embed_texts(e, ["red green"], "query")[0]
    assert np.allclose(one, ids("search_query", ":", "red", "green").mean(0), atol=1e-6)
    long = "\n".join(["red green"] * 600)
    pooled = embed.embed_texts(e, [long, "red"])[0]
    parts = chunking.split_text_chunks(long, e.count_tokens, schema.PREFIX_DOCUMENT)
    counts = [e.count_tokens(schema.PREFIX_DOCUMENT + p) for p in parts]
    want = np.average([e.embed_batch([schema.PREFIX_DOCUMENT + p])[0] for p in parts], axis=0, weights=counts)
    assert len(parts) > 1 and np.allclose(pooled, want, atol=1e-5)
    got = embed.embed(blobs(spark, [("a", b"red"), ("b", b"green")]), e)
    assert all(len(r.vec) == 8 for r in got.collect())


def test_model_files_are_fetched_once(tmp_path):
    there, here = tmp_path / "there", tmp_path / "here"
    (there / "onnx").mkdir(parents=True)
    for name in embed.MODEL_FILES:
        (there / ("onnx" if name.endswith(".onnx") else "") / name).write_text(name)
    embed.ensure_model(here, there.as_uri())
    assert embed.model_ready(here) and sorted(p.name for p in here.iterdir()) == sorted(embed.MODEL_FILES)
    (here / "tokenizer.json").write_text("own")
    embed.ensure_model(here, "file:///none")
    assert (here / "tokenizer.json").read_text() == "own"
