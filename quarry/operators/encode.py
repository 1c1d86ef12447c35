"""Adapter from texts to vectors: any function over a list of strings, run in Arrow batches."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int) -> Encoder:
    """A model-free stand-in: signed hashing of words, for tests and where no model is at hand."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 16 & 1 else -1
        return out

    return run


def encode(df: DataFrame, id_col: str, text_col: str, encoder: Encoder, prefix: str = "query: ") -> DataFrame:
    """(id, vector): the encoder's rows for prefixed texts, scaled to unit length; a zero row becomes the first axis.
    Null text counts as empty. The encoder is sent to the workers, which load a model once if it is a lazy one."""
    rows = df.select(F.col(id_col).cast("string").alias(id_col), F.concat(F.lit(prefix), F.coalesce(text_col, F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(encoder(batch.column(1).to_pylist()), dtype=np.float32)
            zero = ~v.any(axis=1)
            v[zero, 0] = 1
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(v), type=pa.list_(pa.float32()))], names=[id_col, "vector"])

    return rows.mapInArrow(run, f"{id_col} string, vector array<float>")
