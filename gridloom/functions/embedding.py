"""Embedders of texts: a model where one is installed, else hashed words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.text import text_of

DIM = 64


def hash_embed(texts: DataFrame, key: str, text: Column | str, dim: int = DIM) -> DataFrame:
    """(key, embedding): counts of lower-cased ASCII words by hashed bucket, scaled to length 1; all zero for texts without words.

    The bucket is the first 32 bits of the word's md5 modulo dim, so that any engine can compute it.
    """
    found = F.regexp_extract_all(F.lower(text_of(text)), F.lit("[a-z0-9]+"), F.lit(0))
    bucket = F.transform(found, lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dim)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            at = np.repeat(np.arange(n, dtype=np.int64), sizes) * dim + batch.column(1).flatten().to_numpy()
            counts = np.bincount(at, minlength=n * dim).reshape(n, dim).astype(np.float64)
            norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            unit = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))], names=[key, "embedding"])

    return texts.select(key, bucket.alias("_b")).mapInArrow(run, f"{key} {kind}, embedding array<double>")


def model_embed(texts: DataFrame, key: str, text: str, model: str = "sentence-transformers/all-MiniLM-L6-v2", batch: int = 128) -> DataFrame:
    """(key, embedding) by an installed sentence model, loaded once a worker; raises ImportError where there is none."""
    import sentence_transformers  # noqa: F401

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from sentence_transformers import SentenceTransformer

        net = SentenceTransformer(model)
        for frame in frames:
            out = net.encode(frame[text].fillna("").tolist(), batch_size=batch, normalize_embeddings=True)
            yield pd.DataFrame({key: frame[key], "embedding": list(out)})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")
