"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with control bytes apart (operator 7).

A store is a folder with two tables that Spark's own writers make, so it may lie in any store Spark can write:
`ranks` (rank, id), the most frequent id first, and `blocks`, one row a block with the block in binary form:

    8 bytes   magic and version, QTOKENS1
    u32, u64  number of documents, number of ids
    i64 each  document ids (the null id is written as the smallest number)
    u32 each  number of ids of each document
    bytes     control bytes: two bits an id, low bits first, for 1 to 4 data bytes
    bytes     data bytes: the ids' ranks, little-endian, without leading zeros

Blocks hold about `block` ids and are in ascending order of document id over (part, seq).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_schema, scattered
from quarry.llm.tokens import encoder, tokenizer_path
from quarry.sources.shared import remove, scratch

MAGIC = b"QTOKENS1"
NULL_ID = -(1 << 63)
#: Data bytes of the four ids of each control byte.
SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of uint32 values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    size = (1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)).astype(np.uint8)
    codes = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    codes[: len(v)] = size - 1
    c = codes.reshape(-1, 4)
    control = c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of pack()."""
    size = SIZES[np.frombuffer(control, dtype=np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(size) - size
    b = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(3, dtype=np.uint8)])
    out = b[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= b[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(doc_ids, lengths, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    return b"".join([MAGIC, struct.pack("<IQ", len(doc_ids), len(ranks)), np.array(doc_ids, dtype="<i8").tobytes(), np.array(lengths, dtype="<u4").tobytes(), control, data])


def read_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths and ranks."""
    if block[:8] != MAGIC:
        raise ValueError("not a block of token ids")
    docs, n = struct.unpack_from("<IQ", block, 8)
    at = 20
    ids = np.frombuffer(block, dtype="<i8", count=docs, offset=at)
    at += 8 * docs
    lengths = np.frombuffer(block, dtype="<u4", count=docs, offset=at)
    at += 4 * docs
    end = at + -(-n // 4)
    return ids, lengths, unpack(block[at:end], block[end:], n)


BLOCKS = "part int, seq int, before long, n long, block binary"
DRAFT = "part int, seq int, before long, n long, doc_ids binary, lengths binary, wide boolean, ids binary"


def _ids_of(wide: bool, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4" if wide else "<u2")


def _draft(docs: DataFrame, path: str, end_id: int, block: int) -> DataFrame:
    """Blocks in ascending order of doc_id with the ids as they are, in two bytes each where that is enough."""
    arrow = arrow_schema(DRAFT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before, waiting = TaskContext.get().partitionId(), 0, 0, 0
        own = encoder(path)
        ids: list[int] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            nonlocal seq, before, waiting
            values = np.concatenate(held)
            wide = bool(values.max() > 0xFFFF)
            made = {"part": part, "seq": seq, "before": before, "n": waiting, "wide": wide}
            made |= {"doc_ids": np.array(ids, dtype="<i8").tobytes(), "lengths": np.array(lengths, dtype="<u4").tobytes(), "ids": values.astype("<u4" if wide else "<u2").tobytes()}
            seq, before, waiting = seq + 1, before + waiting, 0
            for x in (ids, lengths, held):
                x.clear()
            return pa.RecordBatch.from_pylist([made], schema=arrow)

        for batch in batches:
            names = pc.fill_null(batch.column(0), NULL_ID).to_pylist()
            values, ends = own.encode(batch.column(1))
            values = np.insert(values, ends[1:], end_id)  # an end id after each document
            ends += np.arange(len(ends))
            sizes, at = np.diff(ends), 0
            while at < len(names):
                to = min(max(at + 1, int(np.searchsorted(ends, ends[at] + block - waiting))), len(names))
                ids += names[at:to]
                lengths += sizes[at:to].tolist()
                held.append(values[ends[at] : ends[to]])
                waiting += int(ends[to] - ends[at])
                at = to
                if waiting >= block:
                    yield out()
        if ids:
            yield out()

    ordered = scattered(docs, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.crc32("text"))
    return ordered.mapInArrow(run, DRAFT)


def count_ids(draft: DataFrame) -> DataFrame:
    """(id, n) over all blocks of a draft, end ids included."""
    arrow = arrow_schema("id long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for wide, raw in zip(*batch.columns):
                own = np.bincount(_ids_of(wide.as_py(), raw.as_py()))
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), dtype=np.int64)])
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=arrow)

    return draft.select("wide", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _save(blocks: DataFrame, folder: str) -> None:
    blocks.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(folder)


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, block: int = 1_000_000) -> None:
    """Writes all documents' ids, each document's with end_id after it, in ascending order of doc_id.

    Texts are encoded once, into a draft whose ids are counted and then exchanged for their frequency ranks. Null text
    counts as empty. Documents with the same id (or none: first of all) stand in order of their texts' CRC. An empty
    table gives a store without blocks.
    """
    spark, path = docs.sparkSession, path or tokenizer_path("byte_bpe_50k.json")
    _save(_draft(docs, path, end_id, block), f"{folder}/draft")
    draft = spark.read.parquet(f"{folder}/draft")
    # one row for each id of the vocabulary at most
    seen = sorted(map(tuple, count_ids(draft).collect()), key=lambda x: (-x[1], x[0]))
    spark.createDataFrame([(r, i) for r, (i, _) in enumerate(seen)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(max((i for i, _ in seen), default=0) + 1, dtype=np.uint32)
    rank[[i for i, _ in seen]] = np.arange(len(seen))
    told = spark.sparkContext.broadcast(rank)
    arrow = arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids, lengths, wide, raw = (batch.column(c)[r].as_py() for c in range(4, 8))
                own = write_block(np.frombuffer(doc_ids, dtype="<i8"), np.frombuffer(lengths, dtype="<u4"), told.value[_ids_of(wide, raw)])
                block = pa.array([own], type=pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(r, 1) for c in range(4)), block], schema=arrow)

    _save(draft.mapInArrow(run, BLOCKS), f"{folder}/blocks")
    remove(spark, f"{folder}/draft")


def read(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids), or with digests the CRC-32 of the ids as little-endian uint32 in place of them."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    # one row for each part, of which there are as many as the writing stage had tasks
    parts = sorted(map(tuple, blocks.groupBy("part").agg(F.sum("n")).collect()))
    sums = np.concatenate([[0], np.cumsum([n for _, n in parts])]) if parts else np.zeros(1, dtype=np.int64)
    offset = {p: int(s) for (p, _), s in zip(parts, sums)}
    ranks = sorted(map(tuple, spark.read.parquet(f"{folder}/ranks").collect()))  # the vocabulary at most
    told = spark.sparkContext.broadcast((offset, np.array([i for _, i in ranks], dtype="<u4")))
    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids array<long>")
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset, id_of = told.value
        for batch in batches:
            for part, before, block in zip(*(batch.column(c) for c in range(3))):
                doc_ids, lengths, values = read_block(block.as_py())
                ids = id_of[values]
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                cuts = list(zip(starts.tolist(), ends.tolist()))
                if digests:
                    last = [zlib.crc32(ids[a:b].tobytes()) for a, b in cuts]
                else:
                    last = [ids[a:b].astype(np.int64).tolist() for a, b in cuts]
                names = [None if i == NULL_ID else i for i in doc_ids.tolist()]
                columns = [names, starts + (offset[part.as_py()] + before.as_py()), lengths.astype(np.int64), last]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, arrow)], schema=arrow)

    return blocks.select("part", "before", "block").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes all documents to a new store in the shared folder and returns doc_id, start, n_tokens, ids_crc32 from it."""
    folder = scratch(docs.sparkSession, "token-ids")
    write(docs, folder, path)
    return read(docs.sparkSession, folder, digests=True)
