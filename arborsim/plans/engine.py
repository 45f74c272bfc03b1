"""The commands on an index: update, search, similar, status, gc, clear, install, uninstall."""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborsim.functions.text import fmt_bytes, fmt_count, fmt_duration, query_text
from arborsim.operators import embed, maintain, search
from arborsim.operators.chunking import BatchConfig
from arborsim.schema import IndexMeta, SearchOptions
from arborsim.sources import git_tree, hooks
from arborsim.sources.index_store import IndexStore


class Engine:
    """Trees are DataFrames (path, blob_sha) of the files as they are now; those for ``update`` have content or a reader of it."""

    def __init__(self, spark: SparkSession, path: str, embedder: embed.Embedder | None = None, config: BatchConfig | None = None):
        self.spark, self.store, self.embedder, self.config = spark, IndexStore(spark, path), embedder, config
        self.last_stats: dict[str, float] = {}
        self._packed: tuple[tuple, DataFrame] | None = None

    def update(self, tree: DataFrame, contents: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int | str]:
        """Prunes stale rows and embeds new contents, each once, however many paths it has.

        contents gives (blob_sha, content) for (blob_sha): with it the contents of what is new are read, and no other;
        without it tree has a column content. Nothing is written if nothing changed, only the new rows if nothing is
        stale. An index that another embedder made is made anew.
        """
        began = time.monotonic()
        meta, index = self.store.load()
        new_meta = IndexMeta(meta.version, self.embedder.model, self.embedder.dims)
        other = self.store.current() is not None and (meta.model, meta.dims) != (new_meta.model, new_meta.dims)
        if other:
            index = self.store.empty()
        counts = maintain.gc_counts(index, tree).first()
        entries = maintain.new_entries(tree, index)
        if contents is None:
            found = entries.groupBy("blob_sha").agg(F.first("content").alias("content"))
        else:
            found = contents(entries.select("blob_sha").distinct())
        todo = entries.count()
        if todo or counts["pruned"] or other:
            new = embed.embed(maintain.readable(found), self.embedder, "document", self.config) if todo else self.store.empty()
            if counts["pruned"] or other:
                written = self.store.save(maintain.upsert(maintain.prune(index, tree), new), new_meta) - counts["kept"]
            else:
                written = self.store.append(new, new_meta)
        else:
            written = 0
        done = entries.join(self.store.load()[1].select("blob_sha"), "blob_sha", "left_semi").count() if written else 0
        self.last_stats = {"wall_s": time.monotonic() - began, "embedded": written, "kept": counts["kept"]}
        return {"state": "updated" if written else "pruned" if counts["pruned"] else "current", "entries": done, "distinct": written, "pruned": counts["pruned"], "skipped": todo - done}

    def embed_query(self, words: str | list[str]) -> np.ndarray:
        text = query_text([words] if isinstance(words, str) else words)
        return embed.embed_texts(self.embedder, [text], "query", self.config)[0]

    def packed(self) -> DataFrame:
        """The stored index as packed vectors, made once for each version of it and kept on the executors."""
        at = self.store.current() or {}
        version = tuple(at.get("dirs", ()))
        if self._packed is None or self._packed[0] != version:
            if self._packed:
                self._packed[1].unpersist()
            self._packed = version, search.pack(self.store.load()[1]).persist()
        return self._packed[1]

    def search(self, words: str | list[str], tree: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
        return search.search(self.packed(), tree, self.embed_query(words).tolist(), options)

    def similar(self, path: str, tree: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
        return search.similar(self.packed(), tree, path, options)

    def status(self, tree: DataFrame) -> DataFrame:
        meta, index = self.store.load()
        return maintain.status(index, tree).select("*", F.lit(meta.model).alias("model"), F.lit(meta.dims).alias("dims"))

    def gc(self, tree: DataFrame) -> int:
        """Drops and counts the rows whose content left the tree; always saves."""
        meta, index = self.store.load()
        pruned = maintain.gc_counts(index, tree).first()["pruned"]
        self.store.save(maintain.prune(index, tree), meta)
        return pruned

    def clear(self) -> bool:
        return self.store.clear()


COMMANDS = ("update", "search", "similar", "status", "gc", "clear", "install", "uninstall")


def choose_embedder(hashing: bool, threads: int = 0) -> embed.Embedder:
    """The ONNX model, fetched from $ARBORSIM_MODEL_URL if its files aren't there; hashed words only if asked for."""
    if hashing:
        return embed.HashingEmbedder()
    folder, url = embed.model_dir(), os.environ.get("ARBORSIM_MODEL_URL")
    if not embed.model_ready(folder):
        if not url:
            raise ValueError(f"no model in {folder}: put its files there, set ARBORSIM_MODEL_URL, or use --hashing")
        embed.ensure_model(folder, url)
    return embed.OnnxEmbedder(str(folder), threads=threads)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="arborsim")
    p.add_argument("-d", "--dims", type=int, default=768)
    p.add_argument("-n", "--top", type=int, default=10)
    p.add_argument("-p", "--path")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--time-stats", action="store_true")
    p.add_argument("--memory-stats", action="store_true")
    p.add_argument("--hashing", action="store_true", help="embed by hashed words, without a model")
    p.add_argument("-j", "--threads", type=int, default=0)
    p.add_argument("-b", "--batch-size", type=int)
    p.add_argument("command", nargs="?", default="update", choices=COMMANDS)
    p.add_argument("words", nargs="*")
    return p


def memory() -> dict[str, int]:
    """Peak and present bytes of this process, and of the JVM and Python workers it has started."""
    import resource

    return {"peak": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024, "children": resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss * 1024}


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        return _run(a)
    except ValueError as e:
        print(f"arborsim: {e}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace) -> int:
    repo = git_tree.find_repo()
    if a.command in ("install", "uninstall"):
        for name, did in getattr(hooks, a.command)(repo).items():
            print(f"  {did} {name}")
        return 0
    if a.command in ("search", "similar") and not a.words:
        raise ValueError(f"usage: arborsim {a.command} <words>")
    times: list[tuple[str, float]] = []

    def timed(what: str, run):
        began = time.monotonic()
        out = run()
        times.append((what, time.monotonic() - began))
        if a.verbose:
            print(f"{what}: {fmt_duration(times[-1][1])}", file=sys.stderr)
        return out

    embedder = timed("model", lambda: choose_embedder(a.hashing, a.threads)) if a.command in ("update", "search") else None
    spark = timed("session", SparkSession.builder.appName("arborsim").getOrCreate)
    engine = Engine(spark, f"{repo}/arborsim", embedder, BatchConfig.with_batch_size(a.batch_size) if a.batch_size else None)
    tree, options = git_tree.read(spark, repo, False), SearchOptions(a.dims, a.top, a.path)
    if a.command in ("search", "similar"):
        found = timed(a.command, lambda: engine.search(a.words, tree, options) if a.command == "search" else engine.similar(a.words[0], tree, options))
        for row in search.format_results(found).collect():
            print(row[0])
    elif a.command == "status":
        row = timed("status", lambda: engine.status(tree).first())
        print(f"Model:   {row['model']}\nIndexed: {row['indexed']} / {row['total']} blobs\nDims:    {row['dims']}\nHooks:   {', '.join(hooks.installed(repo)) or 'not installed'}")
    elif a.command == "clear":
        print("Index cleared." if engine.clear() else "No index found.")
    elif a.command == "gc":
        print(f"Pruned {timed('gc', lambda: engine.gc(tree))} unreferenced embeddings")
    else:
        did = timed("update", lambda: engine.update(tree, lambda shas: git_tree.contents(shas, repo)))
        print({"current": "Index is up to date.", "pruned": f"Pruned {did['pruned']} stale embeddings.", "updated": f"Indexed {fmt_count(did['distinct'])} contents of {fmt_count(did['entries'])} files, pruned {did['pruned']}, skipped {did['skipped']}."}[did["state"]])
    if a.time_stats:
        for what, s in times:
            print(f"{what:10} {fmt_duration(s)}")
        if n := engine.last_stats.get("embedded"):
            print(f"{'each':10} {fmt_duration(engine.last_stats['wall_s'] / n)}")
    if a.memory_stats:
        for what, n in memory().items():
            print(f"{what:10} {fmt_bytes(n)}")
    return 0
