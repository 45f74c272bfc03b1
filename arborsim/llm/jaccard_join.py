"""Exact n-gram Jaccard join, told as components: multiple-global-order prefix filtering.

Two texts link when 100 * |A and B| >= percent * |A or B| of their word-shingle sets. A set of n tokens needs
ceil(percent * n / 100) of them in common with any partner, so under any global token order two partners share a
token among the first n - ceil(percent * n / 100) + 1 of each: the prefix filter. It holds under several orders
at once, so candidates must share prefix tokens under each of them.

1. Sets: one pass gives each row its set's size and two hashes. Equal sets are one node from here on; where the
   first hash is the same for different sets, the second names them. The pass also counts, in each batch, tokens
   found in a large share of the rows; such hot tokens are few by construction.
2. Frequencies: a second pass sends every (token, node) to the token's bucket, packed at about 5 bytes. Buckets
   find which tokens lie in two nodes or more and how often; hot tokens skip the count and are dealt at random.
   Only shared tokens go on, to their nodes. Orders put rare tokens first, so a node whose prefix holds only
   tokens of its own has no partner and ends here. What survives is a small part of the corpus. The orders tell
   frequencies apart by factors of 2, 4 and 16, and order tokens of one class by different hashes.
3. Stars: each group of nodes with a common prefix token has one leader, under each order in turn; nodes that
   share prefix tokens with it under the other orders too are verified against it. A large group of near copies
   becomes one component in work linear in its size.
4. The rest: pairs from different components that share prefix tokens under all orders are verified exactly.

Nothing is capped, sampled or dropped; no pair of two components goes unseen. Tokens are 48-bit hashes: a pair of
sets of 1,000 tokens counts one in common that isn't with a chance of 4e-9, which matters only at the threshold.
Nodes are told apart by 126 bits. Joins deal the rows of hot nodes, roots and leaders to several tasks.

Null, empty and blank texts have size 0 and link with nothing, not even each other. Rows with equal doc_id are
rows like others; a null doc_id takes part but names no component unless it is alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborsim.llm import common
from arborsim.llm.components import components
from arborsim.llm.shingles import mix, set_hash, shingles, slices

U64 = np.uint64
TOKEN = U64((1 << 48) - 1)
ORDERS = 3
#: A token in more than half this share of a slice's rows (and 4 of them) is reported; of those reported, tokens
#: found in more than this share of all rows (and 64 of them) are hot, at most (tokens of a row) / HOT. Any other
#: token brings at most this share of the rows to one task.
HOT = 1 / 128
HOT_LEVEL = 60
#: Bytes of text that are turned into postings at a time.
SLICE = 3 << 20
#: Postings that a bucket task holds, about.
TASK_POSTINGS = 3_000_000
#: A prefix token with more than 1 / HOT_GROUPS of an order's prefix postings meets its leader in several tasks;
#: there are fewer than HOT_GROUPS such tokens in an order.
HOT_GROUPS = 256


def _order(keys: np.ndarray, k: int) -> np.ndarray:
    """Keys (level << 48 | token) in global order k: by class of 2^k levels, then by a hash of the token that differs with k."""
    if not k:
        return np.sort(keys)
    with np.errstate(over="ignore"):
        level = keys >> U64(48) + U64(k)
        return keys[np.argsort(level << U64(48) | mix((keys & TOKEN) + U64(k) * U64(0x9E3779B97F4A7C15)) >> U64(16), kind="stable")]


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: doc_id, node, check, n of each row, and key if docs has it; kind 1: a token (in node) found in n rows of a slice."""
    key = ["key"] if "key" in docs.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "node", "check", "n", *key]
        for batch in batches:
            for some in slices(batch, 1, SLICE):
                doc, token = shingles(some.column(1), size)
                n, node = set_hash(doc, token, some.num_rows)
                _, check = set_hash(doc, token, some.num_rows, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), some.column(0), pa.array(node), pa.array(check), pa.array(n.astype(np.int64)), *some.columns[2:]], names=names)
                _, first = np.unique(node, return_index=True)  # copies within the batch count once
                one = np.zeros(len(n), bool)
                one[first] = True
                each, count = np.unique(token[one[doc]], return_counts=True)
                often = count >= max(4, HOT * len(first) / 2)
                m = int(often.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.array(each[often].astype(np.int64)), pa.nulls(m, pa.int64()), pa.array(count[often].astype(np.int64)), *[pa.nulls(m, pa.int64())] * len(key)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), *key).mapInArrow(common.trimmed(run), "kind int, doc_id long, node long, check long, n long" + (", key long" if key else ""))


def _planes(*arrays: np.ndarray) -> bytes:
    """The arrays' bytes, all first bytes of an array first, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays))


def _from_planes(data: bytes, *kinds: tuple[int, str]) -> list[np.ndarray]:
    import zstandard

    body, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), 0, []
    for n, kind in kinds:
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(body[at : at + n * wide].reshape(wide, n).T).view(kind).ravel())
        at += n * wide
    return out


def _labels(spark: SparkSession, n: int) -> np.ndarray:
    """An int for each of n partitions that Spark's hash partitioning sends there."""
    ids = spark.range(40 * n).select(F.col("id").cast("int").alias("i"))
    found = ids.groupBy(F.pmod(F.hash("i"), F.lit(n)).alias("p")).agg(F.min("i")).collect()
    out = np.arange(n, dtype=np.int32)
    for k, i in found:
        out[k] = i
    return out


#: count postings of so many nodes: their hashes and sizes, then each posting's token (as steps from first) and node.
PACKED = "label int, hot boolean, nodes int, count int, first long, wide int, body binary"


def _postings(docs: DataFrame, size: int, labels: np.ndarray, hot: np.ndarray, met: np.ndarray) -> DataFrame:
    """Packed (token, node) of every row's set, by the token's bucket; those of hot tokens are dealt by batch.

    met: first hashes that different sets have; there the second is the node.
    """
    buckets = len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for some in slices(batch, 0, SLICE):
                doc, token = shingles(some.column(0), size)
                n, node = set_hash(doc, token, some.num_rows)
                if len(met):
                    node = np.where(np.isin(node, met), set_hash(doc, token, some.num_rows, 2)[1], node)
                new = np.zeros(len(n), bool)
                for i, x in enumerate(node.tolist()):
                    if n[i] and x not in seen:
                        seen.add(x)
                        new[i] = True
                keep = new[doc]
                doc, token = doc[keep], token[keep]
                if not len(doc):
                    continue
                home = ((token >> U64(16)) * U64(buckets) >> U64(32)).astype(np.int32)
                if len(hot):
                    home[np.isin(token, hot)] = -1
                order = np.lexsort((token, home))
                home, token, doc = home[order], token[order], doc[order]
                cut = np.append(np.flatnonzero(np.diff(home, prepend=home[0] - 1)), len(home))
                rows = []
                for a, b in zip(cut[:-1], cut[1:]):
                    own, index = np.unique(doc[a:b], return_inverse=True)
                    step = np.diff(token[a:b], prepend=token[a : a + 1])
                    wide = 4 if int(step.max()) < 1 << 32 else 8
                    body = _planes(node[own].astype("<i8"), n[own].astype("<i4"), step.astype(f"<u{wide}"), index.astype("<u2"))
                    at = int(home[a]) if home[a] >= 0 else int(node[own[0]]) % buckets
                    rows.append((int(labels[at]), bool(home[a] < 0), len(own), int(b - a), int(token[a]), wide, body))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=[x.split()[0] for x in PACKED.split(", ")])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(common.trimmed(run), PACKED)


#: count postings of so many nodes: their hashes, sizes and numbers of postings, then the postings' keys.
BY_NODE = "label int, nodes int, count int, body binary"


def _emit(labels: np.ndarray, node: np.ndarray, size: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """Postings packed for the partition of their node."""
    home = (node % len(labels)).astype(np.int32)
    order = np.lexsort((key, node, home))
    home, node, size, key = home[order], node[order], size[order], key[order]
    cut = np.append(np.flatnonzero(np.diff(home, prepend=home[0] - 1)), len(home))
    rows = []
    for a, b in zip(cut[:-1], cut[1:]):
        first = np.flatnonzero(np.diff(node[a:b], prepend=node[a] - 1)) + a
        count = np.diff(np.append(first, b))
        rows.append((int(labels[home[a]]), len(first), int(b - a), _planes(node[first].astype("<i8"), size[first].astype("<i4"), count.astype("<i4"), key[a:b].astype("<u8"))))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["label", "nodes", "count", "body"])


def _shared(labels: np.ndarray):
    """The postings of tokens that two nodes or more hold, with the level of their frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, nodes, sizes = [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                own, n, step, index = _from_planes(row["body"], (row["nodes"], "<i8"), (row["nodes"], "<i4"), (row["count"], f"<u{row['wide']}"), (row["count"], "<u2"))
                token = np.cumsum(step.astype(U64)) + U64(row["first"])
                if row["hot"]:
                    yield _emit(labels, own[index], n[index], U64(HOT_LEVEL) << U64(48) | token)
                    continue
                tokens.append(token)
                nodes.append(own[index])
                sizes.append(n[index])
        if not tokens:
            return
        seen = np.concatenate(tokens)
        seen.sort()
        twice = np.unique(seen[1:][seen[1:] == seen[:-1]])
        del seen
        if not len(twice):
            return
        for i, token in enumerate(tokens):  # most tokens are their node's own: only those seen twice are put together
            keep = twice[np.minimum(np.searchsorted(twice, token), len(twice) - 1)] == token
            tokens[i], nodes[i], sizes[i] = token[keep], nodes[i][keep], sizes[i][keep]
        token, node, size = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(sizes)
        del tokens, nodes, sizes
        order = np.lexsort((node, token))
        token, node, size = token[order], node[order], size[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, size = token[new], node[new], size[new]
        cut = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        run = np.diff(np.append(cut, len(token)))
        count = np.repeat(run, run)
        keep = count > 1
        if keep.any():
            level = np.minimum(np.ceil(np.log2(count[keep])), HOT_LEVEL - 1).astype(U64)
            yield _emit(labels, node[keep], size[keep], level << U64(48) | token[keep])

    return run


def _survivors(percent: int):
    """node, n, own (tokens nobody shares), keys (sorted), p0, p1, ...: prefix tokens under each order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, n, keys = [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                own, size, count, key = _from_planes(row["body"], (row["nodes"], "<i8"), (row["nodes"], "<i4"), (row["nodes"], "<i4"), (row["count"], "<u8"))
                node.append(np.repeat(own, count))
                n.append(np.repeat(size, count))
                keys.append(key)
        if not node:
            return
        node, n, keys = np.concatenate(node), np.concatenate(n), np.concatenate(keys)
        order = np.lexsort((keys, node))
        node, n, keys = node[order], n[order], keys[order]
        new = np.ones(len(node), bool)  # a hot token comes from each batch that holds a copy
        new[1:] = (node[1:] != node[:-1]) | (keys[1:] != keys[:-1])
        node, n, keys = node[new], n[new], keys[new]
        cut = np.append(np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])), len(node))
        rows = []
        for a, b in zip(cut[:-1], cut[1:]):
            size = int(n[a])
            prefix = size - (percent * size + 99) // 100 + 1 - (size - (b - a))
            if prefix > 0:
                k = keys[a:b]
                rows.append((int(node[a]), size, int(size - (b - a)), k.tobytes(), *((_order(k, o)[:prefix] & TOKEN).astype(np.int64) for o in range(ORDERS))))
            if len(rows) >= 500 or (rows and b == cut[-1]):
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.binary()), *(pa.array(list(x), pa.list_(pa.int64())) for x in c[4:])], names=["node", "n", "own", "keys", *(f"p{o}" for o in range(ORDERS))])
                rows = []

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of a table of pairs (a, b), those that share prefix tokens under every order and link, by their exact intersection."""
    orders = [f"p{o}" for o in range(ORDERS)]
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("keys").alias(f"k{x}"), *(F.col(p).alias(f"{p}{x}") for p in orders))
    full = common.dealt_join(pairs, side("a"), "a", F.xxhash64("b"))
    full = common.dealt_join(full, side("b"), "b", F.xxhash64("a"), counted=pairs)
    for p in orders:
        full = full.where(F.arrays_overlap(f"{p}a", f"{p}b"))
    full = full.select("a", "b", "na", "nb", "ka", "kb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(batch.column(4)[i].as_buffer(), "<u8"), np.frombuffer(batch.column(5)[i].as_buffer(), "<u8")
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(100 * both >= percent * (int(na[i]) + int(nb[i]) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return full.mapInArrow(common.trimmed(run), "a long, b long")


def _may_link(n: str, at: str, m: str, there: str, percent: int):
    """Whether sets of n and m tokens can link if the token at these places (from 0) is the first they share.

    A linking pair passes this at its first shared token, so pairs are lost nowhere by asking it of every token.
    """
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * F.least(F.col(n) - F.col(at), F.col(m) - F.col(there)) >= percent * (F.col(n) + F.col(m)))


def _prefixes(nodes: DataFrame, comp: DataFrame, order: int) -> DataFrame:
    """node, n, root, at, tok: every prefix token and its place in the set under that order."""
    posts = nodes.join(comp, "node").select("node", "n", "own", "root", F.posexplode(f"p{order}").alias("i", "tok"))
    return posts.select("node", "n", "root", (F.col("own") + F.col("i")).alias("at"), "tok")


def _hot_groups(nodes: DataFrame) -> list[list[tuple[int, int]]]:
    """For each order, its hot prefix tokens and the number of tasks that each is dealt to."""
    total = nodes.agg(F.coalesce(F.sum(F.size("p0")), F.lit(0))).first()[0]  # the same under every order
    posts = nodes.select(F.posexplode(F.array(*(f"p{o}" for o in range(ORDERS)))).alias("o", "p")).select("o", F.explode("p").alias("tok"))
    out = [[] for _ in range(ORDERS)]
    for o, tok, n in posts.groupBy("o", "tok").count().where(F.col("count") * HOT_GROUPS > total).collect():
        out[o].append((tok, -(-n * HOT_GROUPS // total)))
    return out


def _dealt(df: DataFrame, hot: list[tuple[int, int]]) -> DataFrame:
    """df with parts, the number of tasks that its token is dealt to."""
    parts = F.broadcast(df.sparkSession.createDataFrame(hot, "tok long, parts long"))
    return df.join(parts, "tok", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))


def _all_parts():
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))


def _stars(nodes: DataFrame, comp: DataFrame, order: int, percent: int, hot: list[tuple[int, int]]) -> DataFrame:
    """(a, b): each node with the leader of each group it shares a prefix token with, if components differ.

    The leader has the fewest rarer tokens before the one they share: of near copies, the one edited least.
    Nodes of a hot token are dealt to its tasks by their hash, and its leader is sent to each of them.
    """
    posts = _prefixes(nodes, comp, order)
    lead = posts.groupBy("tok").agg(
        F.min(F.struct((F.col("at") / F.col("n")).alias("s"), F.xxhash64("node", F.lit(order)).alias("h"), "node", "n", "root", "at")).alias("l"), F.min("root").alias("r0"), F.max("root").alias("r1"),
    ).where("r0 <> r1").select("tok", F.col("l.node").alias("ln"), F.col("l.n").alias("ls"), F.col("l.root").alias("lr"), F.col("l.at").alias("la"))
    if hot:
        posts = _dealt(posts, hot).withColumn("part", F.pmod(F.xxhash64("node"), "parts")).drop("parts")
        lead = _dealt(lead, hot).withColumn("part", _all_parts()).drop("parts")
    both = posts.join(lead, ["tok", "part"] if hot else "tok").where((F.col("root") != F.col("lr")) & _may_link("n", "at", "ls", "la", percent))
    return both.select(F.least("node", "ln").alias("a"), F.greatest("node", "ln").alias("b")).distinct()


def _crossing(nodes: DataFrame, comp: DataFrame, percent: int, hot: list[list[tuple[int, int]]]) -> DataFrame:
    """(a, b) of different components that share a prefix token under every order.

    Of two such nodes one at least lies outside the token's first component, so only those outside meet all: what
    a large component holds isn't compared within itself. Hot tokens are dealt as in stars, those outside to all.
    """
    out = None
    for o in range(ORDERS):
        posts, on = _prefixes(nodes, comp, o), ["tok"]
        mixed = posts.groupBy("tok").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("tok", "r0")
        if hot[o]:
            on = ["tok", "part"]
            posts = _dealt(posts, hot[o]).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
            mixed = _dealt(mixed, hot[o]).withColumn("part", _all_parts()).drop("parts")
        posts = posts.join(mixed, on)
        outside = posts.where("root <> r0")
        if hot[o]:
            outside = outside.withColumn("part", _all_parts())
        side = lambda df, x: df.select(*on, *(F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "at", "root")))  # noqa: E731, B023
        pairs = side(outside, "a").join(side(posts, "b"), on).where((F.col("a_root") != F.col("b_root")) & _may_link("a_n", "a_at", "b_n", "b_at", percent))
        pairs = pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
        out = pairs if out is None else out.join(pairs, ["a", "b"], "left_semi")
    return out


def _linked(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, root of each row of docs(doc_id, text), and key if docs has it, as a table; rows of one component share root.

    What was written on the way is deleted as soon as it is read.
    """
    spark = docs.sparkSession
    made = common.materialise(_sets(docs, size), "jaccard-sets")
    sets = made.where("kind = 0").drop("kind")
    total, rows = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    hot = made.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= max(64, HOT * rows)).select("node").collect()
    hot = np.array(sorted(r[0] for r in hot), U64)
    # of n nodes, n^2 / 2e19 share a first hash
    met = sets.where("n > 0").groupBy("node").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y").select("node").collect()
    met = np.array(sorted(r[0] for r in met), np.int64)
    if len(met):
        sets = sets.withColumn("node", F.when(F.col("node").isin(met.tolist()), F.col("check")).otherwise(F.col("node")))
    sets = sets.drop("check")
    tasks = max(common.shuffle_partitions(spark), -(-total // TASK_POSTINGS))
    labels = _labels(spark, tasks)
    posts = _postings(docs, size, labels, hot, met).repartition(tasks, "label").mapInArrow(common.trimmed(_shared(labels)), BY_NODE)
    schema = "node long, n long, own long, keys binary, " + ", ".join(f"p{o} array<bigint>" for o in range(ORDERS))
    nodes = common.materialise(posts.repartition(tasks, "label").mapInArrow(common.trimmed(_survivors(percent)), schema), "jaccard-nodes")
    comp, old = nodes.select("node", F.col("node").alias("root")), []
    links, hot_groups = [], _hot_groups(nodes)
    for o in range(ORDERS + 1):
        pairs = _stars(nodes, comp, o, percent, hot_groups[o]) if o < ORDERS else _crossing(nodes, comp, percent, hot_groups)
        pairs = common.materialise(pairs, "jaccard-pairs")
        links.append(common.materialise(_verified(pairs, nodes, percent), "jaccard-links"))
        common.drop(pairs)
        if links[-1].isEmpty():
            continue
        roots = components(reduce(DataFrame.unionByName, links).select(F.col("a").alias("u"), F.col("b").alias("v")))
        comp = common.materialise(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "jaccard-roots")
        common.drop(roots, *old)
        old = [comp]
    by = common.dealt_join(sets, comp.where("node <> root"), "node", how="left").withColumn("root", F.coalesce("root", "node")).drop("node")
    by = common.materialise(by, "jaccard-rows")
    common.drop(made, nodes, *links, *old)
    return by


def join(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs(doc_id, text)."""
    by = _linked(docs.select("doc_id", "text"), size, percent)
    least = by.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = common.dealt_join(by, least, "root", how="left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def named(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, key (xxhash64 of text), copies: the row that names each component, and how many rows are like it.

    It has the least doc_id, null last, and of its texts the one of the least key. Blank rows are components of
    their own, each of them: they come with one copy however many there are.
    """
    by = _linked(docs.select("doc_id", "text", F.xxhash64("text").alias("key")), size, percent)
    each = by.where("n > 0").groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("copies"))
    first = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "key", "copies")).alias("f"))
    blank = by.where("n = 0").select("doc_id", "key", F.lit(1).cast("long").alias("copies")).distinct()
    return first.select("f.doc_id", "f.key", "f.copies").unionByName(blank)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))
