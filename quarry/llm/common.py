"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quarry.sources.shared import reliable as persisted  # noqa: F401  cuts the lineage with a checkpoint in the shared folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that comes in fewer parts than there are cores (a single small file) is dealt out over them once."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df


def scattered(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra or clashing columns never reach an operator."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def map_rows(df: DataFrame, of_batch: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow over a function from one record batch to a dict of output columns."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = of_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(schema))


_resident: dict = {}


def resident(key: tuple, make: Callable):
    """What a Python worker keeps from batch to batch and task to task: the encoder or scorer in use. Another key takes
    its place, so a worker that serves several operators in turn never holds the caches of more than one."""
    if key not in _resident:
        _resident.clear()
        pa.default_memory_pool().release_unused()
        _resident[key] = make()
    return _resident[key]


#: The white-space characters that end a word.
SPACES = "\t\n\x0b\x0c\r "


def slices(texts: pa.Array, at_once: int = 6_000_000) -> Iterator[pa.Array]:
    """Runs of the texts of about `at_once` bytes each, null as empty."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // at_once
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)] if len(texts) else [0]
    for a, b in zip(edges, edges[1:]):
        yield pc.fill_null(texts.slice(a, b - a).cast(pa.string()), "")


def coded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of all items, where each list's begin (one place more than lists), and the distinct items by code."""
    found = lists.values.dictionary_encode()
    return found.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64), found.dictionary.to_pylist()


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """coded() of the words `[^\\x20\\x09-\\x0D]+` of each text."""
    for c in SPACES[:-1]:
        if pc.any(pc.match_substring(texts, c)).as_py():
            texts = pc.replace_substring(texts, c, " ")
    codes, offsets, words = coded(pc.split_pattern(texts, " "))
    if "" in words:
        own = codes != words.index("")
        upto = np.concatenate([[0], np.cumsum(own)])
        codes, offsets = codes[own], upto[offsets]
    return codes, offsets, words


def by_list(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each list's values."""
    upto = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values)])
    return upto[offsets[1:]] - upto[offsets[:-1]]
