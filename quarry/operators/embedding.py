"""Embedding texts: an interface, the offline byte embedder, and ONNX models where files are at hand."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.sources.config import Model


class Embedder(Protocol):
    model_id: str
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class ByteEmbedder:
    """The first ``dimensions`` bytes, centred and scaled to unit length."""

    def __init__(self, dimensions: int = 384):
        self.dimensions, self.model_id = dimensions, f"bytes-{dimensions}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for i, t in enumerate(texts):
            raw = np.frombuffer(t.encode("utf-8", "surrogatepass")[: self.dimensions], np.uint8)
            out[i, : len(raw)] = raw / 255 - 0.5
        n = np.sqrt((out**2).sum(1, keepdims=True))
        return np.divide(out, n, out=out, where=n > 0)


class OnnxEmbedder:
    """A sentence model: pooled output if it has one, else the mean over the tokens that count."""

    def __init__(self, model: Model):
        import onnxruntime
        from tokenizers import Tokenizer

        self.model_id, self.dimensions, self.length = model.model_id, model.dimensions, model.max_seq_len
        self.tokenizer = Tokenizer.from_file(model.tokenizer)
        self.tokenizer.enable_truncation(self.length)
        self.tokenizer.enable_padding(length=self.length)
        self.session = onnxruntime.InferenceSession(model.path, providers=["CPUExecutionProvider"])

    def embed(self, texts: list[str]) -> np.ndarray:
        found = self.tokenizer.encode_batch(texts)
        given = {"input_ids": [e.ids for e in found], "attention_mask": [e.attention_mask for e in found], "token_type_ids": [e.type_ids for e in found]}
        wanted = {i.name for i in self.session.get_inputs()}
        names = [o.name for o in self.session.get_outputs()]
        name = next((n for n in ("sentence_embedding", "embedding", "embeddings") if n in names), names[0])
        out = self.session.run([name], {k: np.array(v, np.int64) for k, v in given.items() if k in wanted})[0]
        if out.ndim == 3:
            mask = np.array(given["attention_mask"])[:, :, None]
            out = (out * mask).sum(1) / np.maximum(mask.sum(1), 1)
        if out.shape != (len(texts), self.dimensions):
            raise ValueError(f"the model gave {out.shape}, expected {(len(texts), self.dimensions)}")
        n = np.sqrt((out**2).sum(1, keepdims=True))
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def embedder(model: Model) -> Embedder:
    return ByteEmbedder(model.dimensions) if model.path is None else OnnxEmbedder(model)


def embed_column(df: DataFrame, key: str, text: str, model: Model, batch: int = 16) -> DataFrame:
    """``id, embedding`` of every row; texts are split at identifiers first.  The byte embedder stays in the JVM."""
    words = df.select(F.col(key).alias("id"), T.split_identifiers(F.col(text)).alias("text"))
    if model.path is None:
        return words.select("id", V.byte_embedding(F.col("text"), model.dimensions).cast("array<float>").alias("embedding"))

    def run(batches):
        e = embedder(model)  # once per task
        for b in batches:
            texts = b.column("text").to_pylist()
            vectors = [v for lo in range(0, len(texts), batch) for v in e.embed(texts[lo : lo + batch]).tolist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(vectors, pa.list_(pa.float32()))], ["id", "embedding"])

    return words.mapInArrow(run, "id long, embedding array<float>")


def embed_query(text: str, model: Model) -> list[float]:
    """As ``embed_column`` does for rows."""
    import re

    cut = re.sub(r"\s+|_+", " ", _split(text[: T.EMBED_CHARS])).strip()
    return embedder(model).embed([re.sub(" +", " ", cut)])[0].tolist()


def _split(text: str) -> str:
    out = []
    for i, c in enumerate(text):
        if i and c.isupper() and (text[i - 1].islower() or text[i - 1].isupper()):
            out.append(" ")
        out.append(c)
    return "".join(out)
