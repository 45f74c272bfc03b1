"""Embedding documents and queries with any embedder: chunk, batch, embed, pool."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arborsim import schema
from arborsim.operators.chunking import BatchConfig, make_batches, split_text_chunks
from arborsim.operators.pooling import masked_mean, weighted_average

MODEL_FILES = ("model.onnx", "tokenizer.json", "special_tokens_map.json", "tokenizer_config.json")


class Embedder(Protocol):
    """Must be picklable; it is loaded once for each Python worker that uses it."""

    dims: int
    model: str

    def count_tokens(self, text: str) -> int:
        """Without truncation, special tokens included; 0 if the text can't be tokenised."""

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        """[len(texts), dims] floats; texts are truncated to the model's length."""


class HashingEmbedder:
    """Deterministic and model-free: signed word hashes, summed. For tests and pipelines without a model."""

    def __init__(self, dims: int = 64):
        self.dims, self.model = dims, f"hashing-{dims}"

    def count_tokens(self, text: str) -> int:
        return len(text.split()) + 2

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split()[: schema.CHUNK_TOKENS]:
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dims] += 1.0 if h >> 63 else -1.0
        return out


def model_dir(model: str = schema.MODEL) -> Path:
    return Path(os.environ.get("HOME", ".")) / ".arborsim" / "models" / model


def model_ready(folder: Path) -> bool:
    return all((folder / f).exists() for f in MODEL_FILES[:2])


def ensure_model(folder: Path, base_url: str) -> Path:
    """Fetches the model files that are missing."""
    import urllib.request

    if not model_ready(folder):
        folder.mkdir(parents=True, exist_ok=True)
        for name in MODEL_FILES:
            if not (folder / name).exists():
                part = folder / f"{name}.part"
                urllib.request.urlretrieve(f"{base_url.rstrip('/')}/{'onnx/' if name.endswith('.onnx') else ''}{name}", part)
                part.rename(folder / name)
    return folder


class OnnxEmbedder:
    """A transformer in ONNX form with its tokenizer. Needs the files in ``folder`` on every executor."""

    def __init__(self, folder: str, dims: int = schema.DIMS, model: str = schema.MODEL, threads: int = 0):
        self.folder, self.dims, self.model, self.threads = folder, dims, model, threads

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _load(self) -> None:
        if hasattr(self, "_session"):
            return
        import onnxruntime as ort
        from tokenizers import Tokenizer

        o = ort.SessionOptions()
        o.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL
        o.intra_op_num_threads, o.inter_op_num_threads = self.threads or os.cpu_count() or 1, 1
        self._session = ort.InferenceSession(str(Path(self.folder) / "model.onnx"), o)
        self._count, self._tok = (Tokenizer.from_file(str(Path(self.folder) / "tokenizer.json")) for _ in range(2))
        self._count.no_truncation()
        self._tok.enable_truncation(schema.CHUNK_TOKENS)
        for t in (self._count, self._tok):
            t.no_padding()

    def count_tokens(self, text: str) -> int:
        self._load()
        try:
            return len(self._count.encode(text).ids)
        except Exception:  # noqa: BLE001 - what can't be tokenised counts as 0
            return 0

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        self._load()
        coded = self._tok.encode_batch(texts)
        longest = max((len(c.ids) for c in coded), default=0)
        if not longest:
            return np.zeros((len(texts), self.dims), np.float32)
        ids, mask = np.zeros((len(texts), longest), np.int64), np.zeros((len(texts), longest), np.int64)
        for i, c in enumerate(coded):
            ids[i, : len(c.ids)], mask[i, : len(c.ids)] = c.ids, c.attention_mask
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        names = {x.name for x in self._session.get_inputs()}
        return masked_mean(self._session.run(None, {k: v for k, v in feed.items() if k in names})[0], mask)


def embed_texts(embedder: Embedder, texts: list[str], kind: str = "document", config: BatchConfig | None = None) -> list[np.ndarray | None]:
    """One vector for each text, or None where it can't be embedded.

    Texts over the model's length are cut at line ends and pooled by token count; chunks of all texts share the
    batches. A batch that fails is embedded one by one.
    """
    config = config or BatchConfig.auto()
    prefix = schema.PREFIX_QUERY if kind == "query" else schema.PREFIX_DOCUMENT
    chunks: list[tuple[int, str, int, bool]] = []
    for i, t in enumerate(texts):
        n = embedder.count_tokens(prefix + t)
        if n <= schema.CHUNK_TOKENS:
            chunks.append((i, prefix + t, n, True))
        else:
            for c in split_text_chunks(t, embedder.count_tokens, prefix, schema.CHUNK_TOKENS):
                chunks.append((i, prefix + c, embedder.count_tokens(prefix + c), False))
    vecs: list[np.ndarray | None] = [None] * len(chunks)
    for batch in make_batches((c[2] for c in chunks), config):
        try:
            for k, v in zip(batch, embedder.embed_batch([chunks[k][1] for k in batch])):
                vecs[k] = v
        except Exception:  # noqa: BLE001 - find the ones that fail
            for k in batch:
                try:
                    vecs[k] = embedder.embed_batch([chunks[k][1]])[0]
                except Exception:  # noqa: BLE001, S110
                    pass
    parts: list[list[int]] = [[] for _ in texts]
    for k, c in enumerate(chunks):
        parts[c[0]].append(k)
    out: list[np.ndarray | None] = []
    for own in parts:
        if any(vecs[k] is None for k in own):
            out.append(None)
        elif len(own) == 1 and chunks[own[0]][3]:
            out.append(vecs[own[0]])
        else:
            out.append(weighted_average([(vecs[k], chunks[k][2]) for k in own], embedder.dims))
    return out


def embed(docs: DataFrame, embedder: Embedder, kind: str = "document", config: BatchConfig | None = None, rows: int = 64) -> DataFrame:
    """blob_sha, vec of docs(blob_sha, content); what can't be embedded is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                vecs = embed_texts(embedder, [x or "" for x in some.column(1).to_pylist()], kind, config)
                keep = [i for i, v in enumerate(vecs) if v is not None]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(keep, pa.int64())), pa.array([vecs[i] for i in keep], pa.list_(pa.float32()))], names=["blob_sha", "vec"])

    return docs.selectExpr("blob_sha", "cast(content as string) as content").mapInArrow(run, schema.INDEX)
