"""Token-id files: one concatenated id array in document order, with Elias-Fano document boundaries.

A file image (one row of the Parquet container, at most about ``block_ids`` ids unless one document alone has
more) is ``EFT1 | width | crc32 | n_ids | Elias-Fano ends | ids``; ids take 2 bytes where the vocabulary fits.
Images are written by Spark's own committer, so a lost executor leaves no half-written file.

Null texts count as empty and still get the end id. Rows that share a doc_id are all kept, in the order of a hash
of their text, and may lie in several images, so one id with many rows is no one task's; null ids come first. An
empty table writes no images and reads back empty. Other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborsim.llm import common
from arborsim.llm.elias_fano import EliasFano, encode

MAGIC = b"EFT1"
HEAD = struct.Struct("<4sBIQ")
IMAGES = "part int, block int, part_start long, n_ids long, doc_ids array<bigint>, image binary"
#: Chunks whose ids a worker remembers; beyond that it forgets them all and starts anew.
MEMO = 1_200_000


#: A chunk of letters and closing marks: the byte-level pattern cuts it into just these two.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]*)").fullmatch
#: What may lie inside a plain chunk.
_PARTS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*[.,;:!?]*").fullmatch


def _byte_letters() -> dict[int, str]:
    """The letter that the library's byte-level alphabet has for each byte of a character below U+0800."""
    from tokenizers.pre_tokenizers import ByteLevel

    level, out = ByteLevel(add_prefix_space=False, use_regex=False), {}
    for c in map(chr, range(0x800)):
        out |= zip(c.encode(), "".join(piece for piece, _ in level.pre_tokenize_str(c)))
    return out


class MemoTokenizer(dict):
    """Encodes whole texts with the tokenizers library, remembering the ids of each space-led chunk as bytes.

    A single space before another character always starts a pre-token of the byte-level pattern, and a single
    line end is always one of its own, so the ids of a text are those of its chunks, cut before each. A plain
    chunk goes straight to the library's model; any other chunk, and texts in which spaces or line ends meet, go
    through its whole pipeline. All this holds for a byte-level pattern with the library's own regex, no prefix
    space, no normaliser or post-processor, and no added token that a plain chunk, a space or a line end could be
    part of; with any other tokenizer all texts go through its pipeline whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer, pre_tokenizers

        self.of = Tokenizer.from_file(path)
        self.code = "H" if self.of.get_vocab_size() <= 1 << 16 else "I"
        self.model, self.letters = self.of.model, _byte_letters()
        self.marks: dict[str, bytes] = {}
        told = json.loads(self.of.to_str())
        level = told["pre_tokenizer"] or {}
        added = [t["content"] for t in told["added_tokens"]]
        self.direct = (level.get("type"), level.get("add_prefix_space"), level.get("use_regex", True)) == ("ByteLevel", False, True)
        self.direct &= told["normalizer"] is None and told["post_processor"] is None and told["model"]["type"] == "BPE" and not told["model"].get("dropout")
        self.direct &= not any(" " in t or "\n" in t or _PARTS(t) for t in added)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.of.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece.replace(" ", self.letters[32]) if piece.isascii() and piece != "\n" else piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        """Ids of a space and the chunk, or of the chunk alone if it starts with a line end."""
        line = chunk[:1] == "\n"
        m = _PLAIN(chunk[line:])
        if m:
            word, marks = m.groups()
            if marks and marks not in self.marks:
                self.marks[marks] = self._piece(marks)
            ids = self._piece("\n") + self._piece(word) if line else self[word] if marks else self._piece(" " + word)
            ids += self.marks[marks] if marks else b""
        else:
            ids = self._whole(chunk if line else " " + chunk)
        if len(self) >= MEMO:
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        get, dtype, out = self.__getitem__, np.dtype(self.code), []
        for t in texts:
            cut = t.replace("\n", " \n")
            if not self.direct or "  " in cut or "\n " in cut or cut[-1:] == " " or " " not in cut:
                out.append(np.frombuffer(self._whole(t), dtype))
            else:
                first, *rest = cut.split(" ")
                out.append(np.frombuffer((self._whole(first) if first else b"") + b"".join(map(get, rest)), dtype))
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> MemoTokenizer:
    """One for each worker process, whatever the number of its tasks."""
    return MemoTokenizer(path)


def image(docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs)
    body = encode(np.cumsum([len(d) for d in docs])) + ids.astype(ids.dtype.newbyteorder("<")).tobytes()
    return HEAD.pack(MAGIC, ids.dtype.itemsize, zlib.crc32(body), len(ids)) + body


def read_image(data: bytes) -> tuple[EliasFano, np.ndarray]:
    magic, width, crc, n = HEAD.unpack_from(data)
    body = data[HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("not an EFT1 image, or damaged")
    ends = EliasFano(body)
    return ends, np.frombuffer(body, f"<u{width}", n, ends.size)


def read_document(data: bytes, i: int) -> np.ndarray:
    """The ids of an image's i-th document, its bounds selected."""
    ends, flat = read_image(data)
    return flat[ends.select(i - 1) if i else 0 : ends.select(i)]


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, block_ids: int = 1_000_000, partitions: int | None = None) -> None:
    """Encodes docs(doc_id, text) into file images under path, in ascending doc_id order.

    One range shuffle of the texts; ids are made after it, so the range sampling doesn't encode anything.
    """
    spark = docs.sparkSession
    n = partitions or common.shuffle_partitions(spark)
    text = F.coalesce("text", F.lit(""))
    order = ["doc_id", "_hash", "text", *common.PLACE]
    ranged = common.located(docs.select("doc_id", "text"), "token-documents").select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("_hash"), *common.PLACE)
    ranged = ranged.repartitionByRange(n, *(c for c in order if c != "text")).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        tok, held, ids, size = None, [], [], 0

        def flush():
            nonlocal block, before, held, ids, size
            columns = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([image(held)], pa.binary())]
            block, before = block + 1, before + size
            held, ids, size = [], [], 0
            return pa.RecordBatch.from_arrays(columns, names=["part", "block", "part_start", "n_ids", "doc_ids", "image"])

        for batch in batches:
            tok = tok or tokenizer(tokenizer_path)
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                for doc_id, row in zip(some.column(0).to_pylist(), tok.encode(some.column(1).to_pylist())):
                    held.append(np.append(row, row.dtype.type(end_id)))
                    ids.append(doc_id)
                    size += len(held[-1])
                    if size >= block_ids:
                        yield flush()
        if held:
            yield flush()

    ranged.mapInArrow(run, IMAGES).write.option("parquet.block.size", 32 << 20).parquet(path)


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and, if asked, ids) of each document, from the images.

    Where each part starts is a sum over the parts before it: one number for each write task reaches the driver.
    """
    images = spark.read.schema(IMAGES).parquet(path)
    sizes = {r[0]: r[1] for r in images.groupBy("part").agg(F.sum("n_ids")).collect()}
    base = dict(zip(sorted(sizes), accumulate((sizes[k] for k in sorted(sizes)), initial=0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ends, flat = read_image(row.column("image")[0].as_py())
                end = ends.select_range(0, ends.n).astype(np.int64)
                start = np.concatenate([[0], end[:-1]])
                wide = flat.astype("<u4")
                crc = np.array([zlib.crc32(wide[a:b]) for a, b in zip(start, end)], np.int64)
                at = base[row.column("part")[0].as_py()] + row.column("part_start")[0].as_py()
                columns = [row.column("doc_ids").flatten(), pa.array(start + at), pa.array(end - start), pa.array(crc)]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(start, end[-1]), pa.int32()), pa.array(wide.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return images.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.scratch_path(spark, "token-files")
    write(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read(spark, path)
