"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into blocks, each compressed with either dictionary; the difference of the summed sizes, divided
by their sum, says which kind of text it resembles. A logistic curve fitted on labelled rows turns that into a
probability; beside the difference it sees how dense the smaller size is, as text that repeats itself compresses
alike with any dictionary. Blocks are short, so the dictionary and not the text's own history decides in long
texts too.

The fit uses at most ``max_rows`` labelled rows (never held-out ones), those of the least hashes of their id: part
trains the dictionaries, the rest the curve. Where samples are too few to train a dictionary, all of them, joined,
are the dictionary. Null and empty texts score as all figures being 0. With no labels, or one class only, all
scores are that class's share (1/2 without any). Ties score alike; repeated rows and clashing column names don't
matter: only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborsim.llm import common
from arborsim.llm.logistic import Logistic

#: Bound on the labelled rows a fit may use.
MAX_ROWS = 6000
BLOCK, DICT_BYTES, LEVEL = 2048, 64 << 10, 1


def _blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


class CompressionClassifier:
    """Fitted state is two dictionaries and a curve, a few hundred kB in all."""

    def __init__(self, block: int = BLOCK, level: int = LEVEL):
        self.block, self.level, self.good, self.bad, self.curve = block, level, b"", b"", Logistic()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_coders"}

    def fit(self, rows: list[tuple[str, int]]) -> CompressionClassifier:
        self.prior = float(np.mean([y for _, y in rows])) if rows else 0.5
        if not 0 < self.prior < 1:
            return self
        texts = {k: [t.encode() for t, y in rows if y == k and t] for k in (0, 1)}
        train = {k: v[: max(1, 2 * len(v) // 3)] for k, v in texts.items()}
        self.good, self.bad = self._dictionary(train[1]), self._dictionary(train[0])
        if not (self.good and self.bad):
            return self
        fit = [(t, y) for y, v in texts.items() for t in v[max(1, 2 * len(v) // 3) :]] or [(t, y) for y, v in texts.items() for t in v]
        self.curve.fit(self.features([t for t, _ in fit]), np.array([y for _, y in fit]))
        return self

    @staticmethod
    def _dictionary(texts: list[bytes]) -> bytes:
        import zstandard

        samples = [b for t in texts for b in _blocks(t)]
        try:
            return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=6).as_bytes()
        except zstandard.ZstdError:  # too few samples
            return b"".join(samples)

    def features(self, texts: list[bytes]) -> np.ndarray:
        import zstandard

        if not hasattr(self, "_coders"):
            made = []
            for data in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(data)
                d.precompute_compress(level=self.level)
                made.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_dict_id=False).compress)
            self._coders = made
        good, bad = self._coders
        out = np.zeros((len(texts), 3))
        for i, t in enumerate(texts):
            a = b = 0
            for x in _blocks(t):
                a += len(good(x))
                b += len(bad(x))
            if t:
                dense = np.log(min(a, b) / len(t))
                out[i] = (b - a) / (a + b), dense, dense * dense
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not (self.good and self.bad):
            return np.full(len(texts), self.prior)
        return self.curve.score(self.features(texts))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> CompressionClassifier:
    return CompressionClassifier().fit(common.labelled_sample(docs, labels, "quality", max_rows))


def score(docs: DataFrame, model: CompressionClassifier, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` (doc_id if None) of docs and the score, as ``name``; text is read beside them."""
    keep = keep or ["doc_id"]
    (body,) = common.unused(docs, "_text")
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    schema = docs.select(*keep).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held.value.score(texts), pa.float64())], names=[*(f.name for f in fields), name])

    return docs.select(*keep, F.col("text").cast("binary").alias(body)).mapInArrow(common.trimmed(run), schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", (common.fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
