"""Packing documents into sequences by non-negative least squares over length patterns (operator 8)."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_schema, persisted, scattered
from quarry.llm.tokens import encoder, tokenizer_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, path: str, most: int, end_id: int) -> DataFrame:
    """Each document's ids with end_id after them, cut into pieces of at most `most`; part and nth number the pieces of
    one length within a task."""
    arrow = arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part = encoder(path, drops_space=True), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            ids, ends = own.encode(batch.column(1))
            ids = np.insert(ids, ends[1:], end_id)  # an end id after each document
            raw = memoryview(ids.tobytes())
            starts = (ends + np.arange(len(ends))).tolist()
            rows = []
            for doc, begin, stop in zip(batch.column(0).to_pylist(), starts, starts[1:]):
                for k, at in enumerate(range(begin, stop, most)):
                    n = min(most, stop - at)
                    rows.append((doc, k, at - begin, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), part, seen[n]))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

    return scattered(docs, "doc_id", "text").mapInArrow(run, PIECES)


class Patterns(NamedTuple):
    """Ways to fill a sequence exactly: row i takes times[i, k] pieces of lengths[i, k], 0 of length 0 where fewer differ."""

    lengths: np.ndarray
    times: np.ndarray

    def of(self, rows: np.ndarray) -> Patterns:
        return Patterns(self.lengths[rows], self.times[rows])

    def used(self, repeats: np.ndarray, most: int) -> np.ndarray:
        """Pieces of each length in so many repeats of the rows."""
        return np.bincount(self.lengths.ravel(), weights=(self.times * repeats[:, None]).ravel(), minlength=most + 1)

    def value(self, prices: np.ndarray) -> np.ndarray:
        """Of each row at prices by length."""
        return (prices[self.lengths] * self.times).sum(axis=1)


def patterns(counts: np.ndarray, most: int) -> Patterns:
    """All sets of up to three pieces that occur and fill a sequence exactly, and all of one length repeated and one other
    piece, which are what short documents fill a sequence with."""
    have = counts > 0
    have[0] = False
    lengths = np.flatnonzero(have)
    rows: list[tuple] = [(np.array([[most, 0, 0]]), np.array([[1, 0, 0]]))] if have[most] else []
    for a in lengths[lengths < most]:
        # a >= b >= c; c may be 0
        b = np.arange(max(1, (most - a + 1) // 2), min(a, most - a) + 1)
        c = most - a - b
        b, c = b[have[b] & ((c == 0) | have[c])], c[have[b] & ((c == 0) | have[c])]
        if len(b):
            one = np.ones_like(b)
            rows.append((np.stack([np.full_like(b, a), b, c], axis=1), np.stack([one, one, np.minimum(c, 1)], axis=1)))
        n = np.arange(2, most // a + 1)
        rest = most - n * a
        fits = ((rest == 0) | have[rest]) & (rest != a) & ((n > 2) | (rest > a) | (rest == 0))
        n, rest = n[fits & (n + (rest > 0) > 3)], rest[fits & (n + (rest > 0) > 3)]
        if len(n):
            rows.append((np.stack([np.full_like(n, a), rest, np.zeros_like(n)], axis=1), np.stack([n, np.minimum(rest, 1), np.zeros_like(n)], axis=1)))
    if not rows:
        return Patterns(np.zeros((0, 3), dtype=np.int64), np.zeros((0, 3), dtype=np.int64))
    return Patterns(*(np.concatenate(x) for x in zip(*rows)))


def _spread(values: np.ndarray, found: Patterns, most: int) -> np.ndarray:
    """Rows in descending order of value of which no two have a length in common."""
    out, taken = [], bytearray(most + 1)
    for i, own in zip(values.tolist(), found.lengths[values].tolist()):
        if not (taken[own[0]] or (own[1] and taken[own[1]]) or (own[2] and taken[own[2]])):
            taken[own[0]] = taken[own[1]] = taken[own[2]] = 1
            out.append(i)
    return np.array(out, dtype=np.int64)


def fit_repeats(found: Patterns, counts: np.ndarray, rounds: int = 12, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(rows, repeats): non-negative least squares of the patterns against the histogram, the squared error of
    a length weighing as the root of the length.

    An active-set method: each round takes in patterns of the steepest descent that share no length with each other, and
    solves for the active ones by conjugate gradients; those that come out negative leave. At most as many patterns as
    there are lengths stay, so repeats are few and large, not many and below one half.
    """
    most = len(counts) - 1
    weight = np.sqrt(np.arange(most + 1) / most)
    target = counts * weight
    active, x = np.zeros(0, dtype=np.int64), np.zeros(0)
    for _ in range(rounds):
        own = found.of(active)
        slope = found.value(target - weight * own.used(x, most))
        slope[active] = 0
        size = np.sqrt(found.value(weight)) + 1e-12
        order = np.argsort(-(slope / size), kind="stable")
        new = _spread(order[slope[order] > 0][:20_000], found, most)
        if not len(new):
            break
        active, x = np.concatenate([active, new]), np.concatenate([x, np.zeros(len(new))])
        for _ in range(4):  # solve, drop the negative ones, solve again
            own = found.of(active)
            rest = own.value(target - weight * own.used(x, most))
            along, size = rest.copy(), float(rest @ rest)
            for _ in range(steps):
                if size < 1e-9:
                    break
                turned = own.value(weight * own.used(along, most))
                step = size / max(float(along @ turned), 1e-12)
                x, rest = x + step * along, rest - step * turned
                size, before = float(rest @ rest), size
                along = rest + size / before * along
            keep = x > 1e-6
            active, x = active[keep], x[keep]
            if keep.all():
                break
        if len(active) > np.count_nonzero(counts):
            keep = np.sort(np.argsort(-x, kind="stable")[: np.count_nonzero(counts)])
            active, x = active[keep], x[keep]
    return active, x


Group = tuple[int, list[tuple[int, int]]]


def round_repeats(found: Patterns, rows: np.ndarray, x: np.ndarray, counts: np.ndarray, least: float) -> tuple[list[Group], np.ndarray]:
    """Repeats of at least `least` to whole numbers, largest first, never more than the histogram holds; and its rest."""
    left, out = counts.copy(), []
    for i, repeats in sorted(zip(rows.tolist(), x.tolist()), key=lambda r: (-r[1], r[0])):
        if repeats < least:
            break
        parts: dict[int, int] = {}
        for v, m in zip(found.lengths[i].tolist(), found.times[i].tolist()):
            if m:
                parts[v] = parts.get(v, 0) + m
        n = min(max(1, int(repeats + 0.5)), *(int(left[v]) // m for v, m in parts.items()))
        if n > 0:
            for v, m in parts.items():
                left[v] -= n * m
            out.append((n, list(parts.items())))
    return out, left


def by_patterns(counts: np.ndarray, most: int) -> Iterator[tuple[list[Group], np.ndarray]]:
    """Sequences that patterns fill, and the pieces that are left for best fit; after each turn.

    Fits and rounds in turn: what rounding leaves is fitted anew with the patterns it still has, until none is left. Where
    all repeats are below one half the largest half of them counts as one each, so that every turn places something.
    Pieces shorter than a 64th of a sequence stay for the gaps that best fit leaves.
    """
    groups: list[Group] = []
    short, left = counts.copy(), counts.copy()
    short[most // 64 :] = left[: max(most // 64, 1)] = short[0] = 0
    while True:
        yield list(groups), left + short
        found = patterns(left, most)
        if not len(found.lengths):
            return
        rows, x = fit_repeats(found, left)
        if not len(rows):
            return
        more, left = round_repeats(found, rows, x, left, min(0.5, float(np.median(x))))
        if not more:
            return
        groups += more


def best_fit(left: np.ndarray, most: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing on a histogram: longest first, each into the fullest sequence with room. Equal sequences are
    one group, so the work depends on the number of lengths, not of documents."""
    open_: list[list[tuple[int, tuple]]] = [[] for _ in range(most + 1)]
    room = np.zeros(most + 1, dtype=bool)

    def put(rest: int, n: int, chain: tuple) -> None:
        if n:
            open_[rest].append((n, chain))
            room[rest] = True

    for length in range(most, 0, -1):
        todo = int(left[length])
        while todo:
            found = np.flatnonzero(room[length:])
            if len(found):
                rest = length + int(found[0])
                n, chain = open_[rest].pop()
                room[rest] = bool(open_[rest])
            else:
                rest, n, chain = most, todo, ()
            fits = rest // length
            full = min(n, todo // fits)
            put(rest - fits * length, full, (*chain, (length, fits)))
            todo -= full * fits
            n -= full
            if n and todo:  # fewer than a sequence holds
                put(rest - todo * length, 1, (*chain, (length, todo)))
                todo, n = 0, n - 1
            if chain:
                put(rest, n, chain)
    return [(n, list(chain)) for groups in open_ for n, chain in groups]


class Plan:
    """Where the k-th piece of each length goes: sorted slots with sequence and offset, as few rows as patterns."""

    def __init__(self, groups: list[tuple[int, list[tuple[int, int]]]], most: int):
        places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        first = 0
        for n, parts in groups:
            offset = 0
            for length, times in parts:
                for _ in range(times):
                    places[length].append((n, first, offset))
                    offset += length
            first += n
        self.n_sequences = first
        slot, self.base = 0, np.zeros(most + 1, dtype=np.int64)
        starts, seqs, offsets = [], [], []
        for length in sorted(places):
            self.base[length] = slot
            for n, sequence, offset in places[length]:
                starts.append(slot)
                seqs.append(sequence)
                offsets.append(offset)
                slot += n
        self.starts, self.seqs, self.offsets = (np.array(v, dtype=np.int64) for v in (starts, seqs, offsets))

    def at(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self.base[lengths] + ranks
        k = np.searchsorted(self.starts, slot, side="right") - 1
        return self.seqs[k] + slot - self.starts[k], self.offsets[k]


def plan(counts: np.ndarray, most: int) -> Plan:
    """counts: pieces by length, from 0 to `most`. Of the turns at which the patterns may stop, the one that gives the
    fewest sequences together with the best fit of the rest; of equal ones the last."""
    best = None
    for groups, left in by_patterns(counts, most):
        packed = groups + best_fit(left, most)
        size = sum(n for n, _ in packed)
        if best is None or size <= best[0]:
            best = size, packed
    return Plan(best[1], most)


def pack(docs: DataFrame, path: str | None = None, most: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece.

    The histogram of lengths, at most `most` rows, is all the driver gets. Pieces of one length are numbered by the
    tasks that made them and a running sum over tasks, so no task sees all pieces of a length. Null text counts as empty
    (one id, the end). Very long texts become many pieces; none is cut off. Repeated rows, and rows without an id, are
    packed each; pieces of equal length change places freely. Other columns are ignored. An empty table gives no rows.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    cut = persisted(pieces(docs, path, most, end_id))
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(most + 1, dtype=np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    told = docs.sparkSession.sparkContext.broadcast(plan(counts, most))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("nth"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = told.value.at(batch.column(3).to_numpy(), batch.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], schema=arrow)

    return ranked.mapInArrow(run, schema)
