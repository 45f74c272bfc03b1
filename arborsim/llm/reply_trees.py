"""Chat formatting of reply trees.

Messages point at the message they answer. Iterated self-joins of ever longer jumps (1, 2, 4, ... messages up)
give each leaf its score and the messages of its path, so a thread of a thousand turns takes ten joins, each of
the messages still under way; a round writes only those. Branches of a tree are ranked by score and each chosen
path is formatted as one conversation.

The template is ``<|im_start|>role newline text<|im_end|> newline`` for each turn. Control strings inside a text
get a backslash after their first character (one more if there are some already), so reading back is exact.
``loss`` lists the code points of the formatted text that are assistant text.

A null text is empty, a null role the empty role; messages whose parent is missing or null are roots; messages
on a cycle have no root and are left out. Ties go by id; an empty table gives no rows; other columns are ignored,
so their names can't clash. Rows of ``threads`` that are equal are turns of their own, one after the other. One
conversation is one row and is formatted by one task, whatever else the table holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborsim.llm import common

#: Control strings of common chat templates. None may occur unescaped inside a text.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Each alternative begins with a plain character: only there does the search stop.
_ESCAPE = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL))
_START, _END = CONTROL[:2]


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0].replace("\\", "", 1) if "\\" in m[0] else m[0], text)


def _role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _unrole(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the (start, end) of its assistant texts."""
    parts, at, loss = [], 0, []
    for role, text in turns:
        head, body, tail = f"{_START}{_role(role)}\n", escape(text), f"{_END}\n"
        if role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), loss


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(_END + "\n", line + 1)
        turns.append((_unrole(formatted[at + len(_START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(_END) + 1
    return turns


def leaf_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """tree, leaf, rank, node, depth_below: the messages on the ``best`` highest-scored paths of each tree (None: all).

    messages(tree, node, parent, score); ids are unique within their tree and all three are longs. A path's score
    is the mean score of its messages.
    """
    m = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = m.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    m = m.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")), "left").select("tree", "node", F.col("p").alias("parent"), "score")
    m = common.materialise(m, "reply-messages")
    up = lambda d, *c: d.select(F.col("tree").alias("t"), F.col("node").alias("x"), *c)
    meet = F.col("tree").eqNullSafe(F.col("t"))
    # going: messages with a jump to the one 2^k above; total and length are sums over the messages from here up to,
    # not with, that one. done: those whose sums reach the root.
    going = m.where("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("jump"), F.col("score").alias("total"), F.lit(1).cast("long").alias("length"))
    done = m.where("parent IS NULL").select("tree", "node", F.lit(None).cast("long").alias("jump"), F.col("score").alias("total"), F.lit(1).cast("long").alias("length"))
    jumps, made, most = [], [], m.count().bit_length() + 1  # only cycles go on after so many
    while len(jumps) < most and not going.isEmpty():
        jumps.append(going)
        above = up(going.unionByName(done), F.col("jump").alias("j2"), F.col("total").alias("t2"), F.col("length").alias("l2"))
        step = going.join(above, meet & (F.col("jump") == F.col("x")))
        step = common.materialise(step.select("tree", "node", F.col("j2").alias("jump"), (F.col("total") + F.col("t2")).alias("total"), (F.col("length") + F.col("l2")).alias("length")), "reply-jumps")
        made.append(step)
        going, done = step.where("jump IS NOT NULL"), done.unionByName(step.where("jump IS NULL"))
    inner = m.where("parent IS NOT NULL").select(F.col("tree").alias("t"), F.col("parent").alias("x")).distinct()
    leaves = done.join(inner, meet & (F.col("node") == F.col("x")), "left_anti").withColumn("score", F.col("total") / F.col("length"))
    leaves = common.materialise(leaves.select("tree", "node", "score"), "reply-leaves")
    if best == 1:
        first = leaves.groupBy("tree").agg(F.max(F.struct("score", (-F.col("node")).alias("k"))).alias("b"))
        leaves = first.select("tree", (-F.col("b.k")).alias("node"), F.lit(1).alias("rank"))
    else:
        leaves = _ranked(leaves)
        leaves = leaves if best is None else leaves.where(F.col("rank") <= best)
    path = common.materialise(leaves.select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("depth_below")), "reply-paths")
    for k, j in enumerate(jumps):  # all messages less than 2^k above the leaf, then those 2^k above these
        far = path.join(up(j, "jump"), meet & (F.col("node") == F.col("x")))
        path = path.unionByName(common.materialise(far.select("tree", "leaf", "rank", F.col("jump").alias("node"), (F.col("depth_below") + (1 << k)).alias("depth_below")), "reply-paths"))
    for step in made:
        common.drop(step)
    return path


def _ranked(leaves: DataFrame) -> DataFrame:
    """leaves with rank, by score and node in each tree: from a range shuffle, so that a large tree is many tasks'."""
    n = common.shuffle_partitions(leaves.sparkSession)
    order = [F.col("tree"), F.desc("score"), F.col("node")]
    rows = common.materialise(leaves.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "reply-ranks")
    # the numbers rise along the order; what a tree has in a partition begins and ends there
    part = F.shiftright("_at", 33)
    runs = rows.groupBy("tree", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    runs = runs.select(F.col("tree").alias("_t"), "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    both = rows.join(runs, F.col("tree").eqNullSafe(F.col("_t")) & (part == F.col("_part")))
    return both.withColumn("rank", (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int")).drop("_at", "_t", "_part", "_first", "_before")


FORMATTED = "tree long, leaf long, rank int, formatted string, loss array<struct<start: int, end: int>>"


def format_paths(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """tree, leaf, rank, formatted, loss of each path; texts(tree, node, role, text)."""
    body = texts.select(F.col("tree").alias("t"), F.col("node").alias("x"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    full = paths.join(body, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("x")))
    turns = full.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth_below")).alias("at"), "role", "text"))).alias("turns"))
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f for f, _ in made], pa.string()), pa.array([[{"start": a, "end": b} for a, b in x] for _, x in made], pair)], names=["tree", "leaf", "rank", "formatted", "loss"])

    return turns.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the formatted text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = parse(text)
                learnt = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), len(text)))
            c = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string()), pa.array(c[4], pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(F.col("tree").alias("conv_id"), "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def threads(conversations: DataFrame, score: Column | None = None) -> DataFrame:
    """tree, node, parent, score, role, text: each row answers the one before it by turn (then role, text)."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), (F.lit(0.0) if score is None else score).alias("score"), "role", "text")


def op9_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    messages = common.materialise(threads(rows.unionByName(extra)), "reply-threads")
    return read_back(common.materialise(format_paths(leaf_paths(messages), messages), "reply-formatted"))
