"""SimHash near-duplicates by covering locality-sensitive hashing (operator 5).

For radius r every bit is given a vector of r + 1 bits, and each of the 2**(r+1) - 1 nonzero vectors v gives a table that
keeps the bits whose vector has an odd inner product with v. Any r differing bits leave some v orthogonal to all their
vectors, so a pair within the radius agrees on all bits of that v's table: it always collides somewhere.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_rows, persisted, scattered

RADIUS = 2


def masks(radius: int = RADIUS) -> list[int]:
    """The kept bits of each table. Bits take the nonzero vectors in turn, so that every table keeps about as many."""
    kinds = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(64) if bin((i % kinds + 1) & v).count("1") % 2) for v in range(1, kinds + 1)]


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the word shingles' XXH64 (seed 42): a bit is set if it is in over half of the hashes."""
    from xxhash import xxh64_intdigest

    # lower() and split() on bytes touch ASCII alone: A-Z, and the six white-space characters
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 8192):
        part = h[at : at + 8192]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long): fp is the fingerprint as a signed 64-bit number. Null text: zero."""

    def of(batch):
        fp = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return {"doc_id": batch.column(0), "fp": fp.view(np.int64)}

    return map_rows(scattered(docs, "doc_id", "text"), of, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b), a < b, that connect all distinct values of column fp within the radius of two.

    Members of a bucket agree on its table's kept bits. Each member of a bucket with company goes to itself and to every
    value one kept-out bit away. All that meet at one such value are within two bits of each other, two members within
    two bits always meet, and no more than one member for each kept-out bit, and one, can meet there; so a star at the
    smallest of them connects exactly the pairs of the bucket, with rows in proportion to its size and no pairs.
    """
    if radius != 2:
        raise ValueError("stars at shared neighbours connect pairs within two bits")
    tables = masks(radius)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(tables)])
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    company = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").select("t", "key")
    members = rows.join(company, ["t", "key"], "left_semi")
    flips = [F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(64) if not m >> b & 1]) for m in tables]
    own = F.element_at(F.array(*flips), F.col("t") + 1)
    met = members.select("t", "fp", F.explode(own).alias("flip")).select("t", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"), "fp")
    stars = met.groupBy("t", "z").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    return stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    Label propagation with pointer jumping; every round is checkpointed, only the number of changes comes to the driver.
    """
    edges = persisted(edges)
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    labels = persisted(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("near")).withColumnRenamed("u", "node")
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = persisted(step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")))
        changed = new.filter("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels


def group(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable over links).

    Equal fingerprints are one node, so a group of copies of any size costs one row in the search. Null and empty texts
    have fingerprint zero and link like any other. A null doc_id takes part but is never a component's id unless all its
    members are null. Empty tables give no rows.
    """
    fps = persisted(fingerprints(docs, words))
    distinct = persisted(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    with_root = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = with_root.groupBy("root").agg(F.min("least").alias("component_id"))
    named = with_root.join(of_root, "root").select("fp", "component_id")
    return fps.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
