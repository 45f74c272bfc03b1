"""The big-endian index file: header (version, model, dims, count), then for each row its hash and floats.

Strings are a 2-byte length and UTF-8. Import and export only; the Parquet store is the working format.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborsim import schema
from arborsim.sources import scratch


class IndexFormatError(ValueError):
    """Truncated data, dims that aren't positive, or a negative count."""


def write_string(text: str) -> bytes:
    data = text.encode()
    if len(data) > 0xFFFF:
        raise IndexFormatError("string of more than 65,535 bytes")
    return struct.pack(">H", len(data)) + data


def read_string(data: memoryview, at: int) -> tuple[str, int]:
    if at + 2 > len(data):
        raise IndexFormatError("truncated")
    n = struct.unpack_from(">H", data, at)[0]
    if at + 2 + n > len(data):
        raise IndexFormatError("truncated")
    return bytes(data[at + 2 : at + 2 + n]).decode(), at + 2 + n


def encode_row(sha: str, vec: Iterable[float], dims: int) -> bytes:
    """A vector of another length than dims is refused."""
    v = np.asarray(vec, ">f4")
    if len(v) != dims:
        raise IndexFormatError(f"{sha}: {len(v)} floats, not {dims}")
    return write_string(sha) + v.tobytes()


def header(meta: schema.IndexMeta, count: int) -> bytes:
    return struct.pack(">i", meta.version) + write_string(meta.model) + struct.pack(">ii", meta.dims, count)


def encode(meta: schema.IndexMeta, rows: Iterable[tuple[str, Iterable[float]]]) -> bytes:
    """Rows in the order given."""
    parts = [encode_row(sha, vec, meta.dims) for sha, vec in rows]
    return header(meta, len(parts)) + b"".join(parts)


def read_header(data: bytes) -> tuple[schema.IndexMeta, int, int]:
    """(meta, number of rows, where they begin)."""
    view = memoryview(data)
    if len(view) < 4:
        raise IndexFormatError("truncated")
    version = struct.unpack_from(">i", view)[0]
    model, at = read_string(view, 4)
    if at + 8 > len(view):
        raise IndexFormatError("truncated")
    dims, count = struct.unpack_from(">ii", view, at)
    if dims <= 0:
        raise IndexFormatError(f"dims is {dims}")
    if count < 0:
        raise IndexFormatError(f"count is {count}")
    return schema.IndexMeta(version, model, dims), count, at + 8


def decode(data: bytes) -> tuple[schema.IndexMeta, dict[str, np.ndarray]]:
    """The last row of a hash wins; bytes after the last row are ignored."""
    meta, count, at = read_header(data)
    view, dims, rows = memoryview(data), meta.dims, {}
    for _ in range(count):
        sha, at = read_string(view, at)
        if at + 4 * dims > len(view):
            raise IndexFormatError("truncated")
        rows[sha] = np.frombuffer(view, ">f4", dims, at).astype(np.float32)
        at += 4 * dims
    return meta, rows


def _chunks(index: DataFrame, dims: int, size: int = 1 << 20) -> DataFrame:
    """The index's rows by hash, encoded on the executors, in pieces of about so many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        give = lambda: pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["n", "rows"])
        for batch in batches:
            for sha, vec in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(encode_row(sha, vec.values.to_numpy(zero_copy_only=False), dims))
                if len(held) * len(held[-1]) >= size:
                    yield give()
                    held = []
        if held:
            yield give()

    return index.select("blob_sha", "vec").orderBy("blob_sha").mapInArrow(run, "n long, rows binary")


def export(index: DataFrame, meta: schema.IndexMeta, path: str) -> int:
    """Writes the whole index as one file, by hash, and returns its number of rows.

    The format is one file, so its bytes pass through the driver, a piece of about 1 MB at a time.
    """
    spark = index.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        pieces = scratch.materialise(_chunks(index, meta.dims), "codec-pieces")
        count = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        out.write(bytearray(header(meta, count)))
        order = pieces.select("*", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i")
        for r in order.toLocalIterator(prefetchPartitions=True):
            out.write(bytearray(r["rows"]))
    finally:
        out.close()
    return count


def read_model(spark: SparkSession, path: str) -> str:
    """The model's name in the header of an index file, of which only the header is read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return read_header(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(1 << 17, stream.available()))))[0].model
    finally:
        stream.close()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """blob_sha, vec of all index files under path, decoded on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                _, rows = decode(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.list_(pa.float32()))], names=["blob_sha", "vec"])

    files = spark.read.format("binaryFile").load(path).select(F.col("content"))
    return files.mapInArrow(run, schema.INDEX)
