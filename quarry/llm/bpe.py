"""BPE encoding and decoding by content-defined chunk reuse (operator 4)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from quarry.llm.common import map_rows, resident, scattered
from quarry.llm.tokens import WHITE_SPACE, PieceEncoder, byte_table, tokenizer_path

#: The step from a non-space to a white-space character, across which no token reaches.
STEP = re.compile(f"(?<=[^{WHITE_SPACE}])(?=[{WHITE_SPACE}])")


class ChunkEncoder:
    """Cuts texts where a rolling hash of the last 16 bytes says so, encodes each distinct chunk once and repairs joins.

    A chunk's entry holds its ids and how many of them stand before its first and from its last step between a
    non-space and a space. Those between are final, whatever stands around the chunk. At a join the text from the left
    chunk's last step to the right chunk's first step is encoded again; where the right chunk has no step, the repair
    goes on into the next, until both ends stand on a step (or an end of the text) and so agree with the whole text's
    encoding. Entries are kept for `budget` bytes of chunks in two generations.
    """

    def __init__(self, path: str, bits: int = 9, least: int = 128, most: int = 4096, budget: int = 24_000_000):
        self.pieces = PieceEncoder(path)
        self.bits, self.least, self.most, self.budget = bits, least, most, budget
        # a gear table from a fixed multiplicative rule, the same in every process
        self.gear = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.uint32)
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.held = 0
        self.encoded = self.reused = 0

    def cuts(self, data: bytes) -> list[int]:
        """Ends of the chunks of a text's UTF-8 bytes, never inside a character."""
        n = len(data)
        if n <= self.least:
            return [n] if n else []
        b = np.frombuffer(data, dtype=np.uint8)
        g = self.gear[b]
        h = g.copy()
        for j in range(1, 16):
            h[j:] += g[:-j] << np.uint32(j)
        mask = np.uint32(((1 << self.bits) - 1) << (15 - self.bits))
        marks = (np.flatnonzero((h & mask) == 0) + 1).tolist()
        out, start, k = [], 0, 0
        while n - start > self.least:
            while k < len(marks) and marks[k] < start + self.least:
                k += 1
            end = min(marks[k] if k < len(marks) else n, start + self.most, n)
            while end < n and data[end] & 0xC0 == 0x80:
                end += 1
            out.append(end)
            start = end
        if start < n:
            out.append(n)
        return out

    def chunks(self, text: str) -> list[str]:
        data, start, out = text.encode("utf-8", "surrogatepass"), 0, []
        for end in self.cuts(data):
            out.append(data[start:end].decode("utf-8", "surrogatepass"))
            start = end
        return out

    def entries(self, wanted: list[str]) -> None:
        """Encodes the chunks that no entry stands for, all in one go."""
        missing = []
        for c in dict.fromkeys(wanted):
            if c in self.new:
                continue
            if c in self.old:
                self.new[c] = self.old[c]
                self.held += len(c)
            else:
                missing.append(c)
        self.reused += len(wanted) - len(missing)
        if not missing:
            return
        parts = []
        for c in missing:
            if c.isascii():
                parts.append((c, *_ends(c)))
            else:
                steps = [m.start() for m in STEP.finditer(c)]
                parts.append((c, steps[0], steps[-1]) if steps else (c, -1, -1))
        flat = []
        for c, first, last in parts:
            flat += [c, "", ""] if first < 0 else [c[:first], c[first:last], c[last:]]
        ids = self.pieces.encode_bytes(flat)
        for k, (c, first, last) in enumerate(parts):
            self.new[c] = (first, last, ids[3 * k + 1])
            self.held += len(c)
            self.encoded += 1

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        out: list[bytes] = []
        texts = list(texts)
        for at in range(0, len(texts), 256):
            if self.held > self.budget:
                self.old, self.new, self.held = self.new, {}, 0
            lists = [self.chunks(t) for t in texts[at : at + 256]]
            self.entries([c for one in lists for c in one])
            repairs: list[str] = []
            plans = []
            for one in lists:
                plan, carried = [], ""
                for c in one:
                    first, last, body = self.new[c]
                    if first < 0:  # no step in it: the repair goes on
                        carried += c
                        continue
                    plan.append(len(repairs))
                    repairs.append(carried + c[:first])
                    plan.append(body)
                    carried = c[last:]
                plan.append(len(repairs))
                repairs.append(carried)
                plans.append(plan)
            fixed = self.pieces.encode_bytes(repairs)
            out += [b"".join(fixed[x] if isinstance(x, int) else x for x in plan) for plan in plans]
        return out


_ASCII_STEP = re.compile("[^\t-\r ](?=[\t-\r ])")


def _ends(c: str) -> tuple[int, int]:
    """First and last step of an ASCII chunk."""
    m = _ASCII_STEP.search(c)
    if not m:
        return -1, -1
    first = m.end()
    k = len(c)
    tail = c.rstrip("\t\n\x0b\x0c\r ")
    if len(tail) < k:  # it ends in white space
        return first, len(tail)
    last = max(map(c.rfind, "\t\n\x0b\x0c\r "))
    while last > 0 and c[last - 1] in "\t\n\x0b\x0c\r ":
        last -= 1
    return first, last


def chunk_encoder(path: str) -> ChunkEncoder:
    """The worker's chunk encoder for a tokenizer file."""
    return resident(("chunks", path), lambda: ChunkEncoder(path))


@cache
def tables(path: str) -> tuple[list[bytes], list[bytes]]:
    """For every id its bytes and its decimal digits with a comma."""
    from tokenizers import Tokenizer

    raw = byte_table(Tokenizer.from_file(path))
    return raw, [b"%d," % i for i in range(len(raw))]


def decode(ids: Iterable[int], path: str) -> str:
    return b"".join(map(tables(path)[0].__getitem__, ids)).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): the ids of each whole text and what they decode to.

    Null text counts as empty (no ids); very long texts are encoded whole, chunk by chunk. Empty tables give no rows;
    repeated rows and rows without an id give a row each; other columns are ignored.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")

    def of(batch):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        ids = [np.frombuffer(x, dtype="<u4").astype(np.int32).tolist() for x in chunk_encoder(path).encode(texts)]
        return {id_col: batch.column(0), "ids": ids, "decoded": [decode(i, path) for i in ids]}

    return map_rows(scattered(docs, id_col, text_col), of, f"{id_col} long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids in decimal and of the decoded text.

    The same encoder and decoder as encode_documents, but the ids stay in the worker, so that no row carries them.
    Null text counts as empty, very long texts are taken whole; an empty table gives no rows; equal rows give equal
    results, a null id stays null, and other columns are ignored.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")

    def of(batch):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        raw, digits = tables(path)
        n, a, b = [], [], []
        for x in chunk_encoder(path).encode(texts):
            ids = np.frombuffer(x, dtype="<u4").tolist()
            n.append(len(ids))
            a.append(hashlib.sha256(b"".join(map(digits.__getitem__, ids))[:-1]).hexdigest())
            decoded = b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace")
            b.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    return map_rows(scattered(docs, "doc_id", "text"), of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
