"""Exact top-k inner products by Fagin's threshold algorithm (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_schema, scattered

#: Components reach this in size only where no product of theirs is exact.
LARGEST = 2.0**53
BLOCK = "dim int, g int, n int, ids binary, vectors binary"


class SortedLists:
    """The vectors of one block with, for every dimension, their places in descending order of that component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by], vectors[by].astype(np.float64)
        self.order = np.argsort(-self.vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.vectors, self.order, axis=0)

    def search(self, query: np.ndarray, own: int | None, k: int, first: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best (ties to the smaller id), without rows of id `own`.

        Sorted access goes down the lists of the dimensions with a nonzero query component, from the top where it is
        positive and from the bottom where it is negative, to a depth that doubles. Every place met is scored in full.
        No place that was not met can exceed the threshold, the query's product with the components at the depth; the
        search ends once that is below the k-th score (an equal one could still win by its id).
        """
        q = query.astype(np.float64)
        n = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        met = np.zeros(n, dtype=bool)
        if not len(up) and not len(down):
            met[:] = True
        depth, best, before = first, np.zeros(0), 0
        scores = np.full(n, -np.inf)
        while True:
            depth = min(depth, n)
            seen = np.zeros(n, dtype=bool)
            seen[self.order[before:depth, up].ravel()] = True
            seen[self.order[n - depth : n - before, down].ravel()] = True
            new = np.flatnonzero((seen | met) & np.isneginf(scores))
            scores[new] = self.vectors[new] @ q
            if own is not None:
                scores[new[self.ids[new] == own]] = -np.inf
                met[new[self.ids[new] == own]] = False
            if depth == n:
                break
            best = np.partition(np.concatenate([best, scores[new]]), -k)[-k:] if len(best) + len(new) >= k else np.concatenate([best, scores[new]])
            threshold = q[up] @ self.sorted[depth - 1, up] + q[down] @ self.sorted[n - depth, down]
            if len(best) >= k and threshold < best.min():
                break
            before, depth = depth, depth * 2
        at = np.flatnonzero(~np.isneginf(scores))
        if len(at) > k:
            least = np.partition(scores[at], -k)[-k]
            at = at[scores[at] >= least]
        at = at[np.lexsort((self.ids[at], -scores[at]))][:k]
        return self.ids[at], scores[at]


def _blocks(vectors: DataFrame, size: int, groups: int, id_col: str, vec_col: str) -> DataFrame:
    """Rows of up to `size` integer vectors each, made where they lie, without a shuffle."""
    arrow = arrow_schema(BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list] = {}
        made = TaskContext.get().partitionId()

        def out(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, vecs = zip(*held.pop(dim))
            made += 1
            v = np.array(vecs, dtype=np.int64).reshape(len(ids), dim)
            return pa.RecordBatch.from_pylist([{"dim": dim, "g": made % groups, "n": len(ids), "ids": np.array(ids, dtype=np.int64).tobytes(), "vectors": v.tobytes()}], schema=arrow)

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)):
                if i is None or v is None:
                    continue
                x = np.array(v, dtype=np.float64)
                x = np.floor(256 * x)
                if not (np.abs(x) < LARGEST).all():  # a null component reads as NaN
                    continue
                x = x.astype(np.int64)
                held.setdefault(len(x), []).append((i, x))
                if len(held[len(x)]) >= size:
                    yield out(len(x))
        for dim in list(held):
            yield out(dim)

    return scattered(vectors, id_col, vec_col).mapInArrow(run, BLOCK)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", size: int = 8192, groups: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of `queries` the k rows of `vectors` with the highest integer inner
    product, never a row of its own id; ties to the smaller id.

    Components become floor(256 x). Rows with a null id, a null vector, or a null or non-finite component, or one of 2**53
    or more after that, take no part;
    vectors of another length than a query's are no candidates for it. Repeated rows are candidates each; equal query rows
    count once. Scores are exact while they stay below 2**53. Query rows
    are packed into blocks too and each block meets each data block once, in one of `groups` groups (64, or as many as the
    vectors have partitions, if those are more); each pairing gives
    at most k rows a query, and the k best over all pairings are taken by an aggregation that keeps k rows a task.
    """
    groups = groups or max(64, vectors.rdd.getNumPartitions())
    data = _blocks(vectors, size, groups, id_col, vec_col)
    asked = _blocks(scattered(queries, id_col, vec_col).distinct(), 256, groups, id_col, vec_col).drop("g").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # by merging: a planner takes blocks for small by their schema, and would send all copies of the queries by the driver
    pairs = data.join(asked.hint("merge").select("dim", "g", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), ["dim", "g"])
    schema = "query_id long, vec_id long, score long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lists = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                dim, _, n, ids, vecs, q_n, q_ids, q_vecs = (batch.column(c)[r].as_py() for c in range(8))
                if (ids, vecs) != last:
                    last = ids, vecs
                    lists = SortedLists(np.frombuffer(ids, dtype=np.int64), np.frombuffer(vecs, dtype=np.int64).reshape(n, dim))
                out = []
                for q, v in zip(np.frombuffer(q_ids, dtype=np.int64).tolist(), np.frombuffer(q_vecs, dtype=np.int64).reshape(q_n, dim)):
                    got, scores = lists.search(v, q, k)
                    out += [(q, i, int(s)) for i, s in zip(got.tolist(), scores.tolist())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*out)], schema=arrow)

    found = pairs.select("dim", "g", "n", "ids", "vectors", "q_n", "q_ids", "q_vectors").mapInArrow(run, schema)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
