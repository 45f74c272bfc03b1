"""Line-boundary chunks, memory-aware batch sizes and greedy padded batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborsim.operators import ordering

MIB = 1 << 20
MAX_BATCH, MAX_TOKENS, TOKENS_PER_ITEM = 32, 16384, 512
ITEM_BYTES, MODEL_BYTES, HEADROOM_BYTES, FALLBACK_BYTES = 90 * MIB, 800 * MIB, 256 * MIB, 4096 * MIB


@dataclass(frozen=True)
class BatchConfig:
    max_batch_size: int = MAX_BATCH
    max_batch_tokens: int = MAX_TOKENS

    @staticmethod
    def with_batch_size(n: int) -> BatchConfig:
        n = min(max(n, 1), MAX_BATCH)
        return BatchConfig(n, MAX_TOKENS if n >= MAX_BATCH else max(n * TOKENS_PER_ITEM, TOKENS_PER_ITEM))

    @staticmethod
    def from_available_memory(available: int) -> BatchConfig:
        usable = max(0, available - MODEL_BYTES - HEADROOM_BYTES)
        return BatchConfig.with_batch_size(usable // ITEM_BYTES)

    @staticmethod
    def auto() -> BatchConfig:
        return BatchConfig.from_available_memory(available_memory())


def available_memory() -> int:
    """Bytes free for new work: MemAvailable, else MemTotal, else all physical memory, else 4 GiB."""
    try:
        with open("/proc/meminfo") as f:
            found = dict(line.split(":", 1) for line in f)
        for k in ("MemAvailable", "MemTotal"):
            if k in found:
                return int(found[k].split()[0]) * 1024
    except (OSError, ValueError):
        pass
    try:
        return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return FALLBACK_BYTES


def batch_size_column(available: Column) -> Column:
    usable = F.greatest(available - (MODEL_BYTES + HEADROOM_BYTES), F.lit(0))
    return F.greatest(F.lit(1), F.least(F.lit(MAX_BATCH), F.floor(usable / ITEM_BYTES))).cast("int")


def batch_tokens_column(size: Column) -> Column:
    return F.when(size >= MAX_BATCH, MAX_TOKENS).otherwise(F.greatest(size * TOKENS_PER_ITEM, F.lit(TOKENS_PER_ITEM))).cast("int")


def lines(text: str) -> list[str]:
    """Lines without their ends (\\n or \\r\\n); nothing after a last line end."""
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts] if text else []


def runs(costs: Iterable[int], room: int) -> list[tuple[int, int, int]]:
    """(first, last + 1, cost) of the runs of lines that fit the room, each as long as it can be; one line at least."""
    out: list[tuple[int, int, int]] = []
    for i, n in enumerate(costs):
        if out and out[-1][2] + n <= room:
            out[-1] = (out[-1][0], i + 1, out[-1][2] + n)
        else:
            out.append((i, i + 1, n))
    return out


def split_text_chunks(text: str, cost: Callable[[str], int], prefix: str = "", budget: int = 512) -> list[str]:
    """Runs of lines that fit the budget; a line that alone doesn't fit is a chunk of its own."""
    room = max(0, budget - cost(prefix) - 2)
    if not room:
        return []
    ls = lines(text)
    return ["\n".join(ls[a:b]) for a, b, _ in runs((max(max(0, cost(x) - 2), 1) for x in ls), room)]


def words_cost(line: str) -> int:
    """White-space words of a line, 1 at least: the token cost used where no tokenizer is at hand."""
    words = line.replace("\t", " ").split(" ")
    return max(1, len(words) - words.count(""))


def chunk_lines(docs: DataFrame, budget: int, cost: Callable[[str], int] = words_cost) -> DataFrame:
    """doc_id, chunk_idx, n_lines, tokens, chunk of docs(doc_id, text), in time linear in the texts; null texts have no chunks.

    A text without a character has one empty line.
    """
    schema = "doc_id long, chunk_idx int, n_lines int, tokens int, chunk string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ls = lines(text) or [""]
                rows = [(doc_id, k, b - a, n, "\n".join(ls[a:b])) for k, (a, b, n) in enumerate(runs(map(cost, ls), budget))]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def make_batches(tokens: Iterable[int], config: BatchConfig) -> list[list[int]]:
    """Positions in batches: shortest first, each batch within its size and padded token bounds."""
    tokens = list(tokens)
    out: list[list[int]] = []
    for i in sorted(range(len(tokens)), key=tokens.__getitem__):
        if not out or len(out[-1]) >= config.max_batch_size or (len(out[-1]) + 1) * tokens[i] > config.max_batch_tokens:
            out.append([])
        out[-1].append(i)
    return out


def plan_batches(rows: DataFrame, tokens: str, config: BatchConfig, *ties: str) -> DataFrame:
    """rows with batch: the plan of ``make_batches`` over the whole table, rows of equal tokens in the order of ties.

    Rows are numbered along a range shuffle. Along the lengths, shortest first, a batch is full at a size that the
    length alone decides, so the plan is a fold over the lengths and their numbers of rows: one row for each length
    reaches the driver. ties must tell rows apart for the plan to be the same each time.
    """
    spark = rows.sparkSession
    at = ordering.numbered(rows, [tokens, *ties], "_at")
    fold, first, batch, size = [], 0, -1, 0
    for t, n in at.groupBy(tokens).count().orderBy(tokens).collect():
        fits = min(config.max_batch_size, config.max_batch_tokens // t if t else config.max_batch_size)
        room, full = max(0, fits - size) if batch >= 0 else 0, max(1, fits)
        fold.append((t, first, batch, room, full))
        more = -(-(n - room) // full) if n > room else 0
        batch, size = batch + more, n - room - (more - 1) * full if more else size + n
        first += n
    kind = rows.schema[tokens].dataType.simpleString()
    plan = F.broadcast(spark.createDataFrame(fold, f"_t {kind}, _first long, _batch long, _room long, _full long"))
    past = F.col("_at") - F.col("_first") - F.col("_room")
    batch = F.when(past < 0, F.col("_batch")).otherwise(F.col("_batch") + 1 + F.floor(past / F.col("_full")).cast("long"))
    return at.join(plan, F.col(tokens) == F.col("_t")).select(*rows.columns, batch.alias("batch"))
