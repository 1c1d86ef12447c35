"""Relational operators: lookups, remaps, upserts, windows, aggregates and set algebra on any tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_all(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner enrichment with the number of misses, so that a caller can refuse them."""
    return left.join(right.withColumn("_hit", F.lit(True)), key, "left").withColumn("missing", F.col("_hit").isNull()).drop("_hit")


def upsert(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows of base replaced by those of patch with the same key; new keys are added."""
    return base.join(patch.select(key), key, "left_anti").unionByName(patch)


def merge_unique(parts: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """Union of parts, and the keys that are in it more than once."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows, rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def pool_hash(ids: Column) -> Column:
    """SHA-256 of the sorted distinct ids, a line each."""
    return F.sha2(F.concat(F.array_join(F.array_sort(F.collect_set(ids)), "\n"), F.lit("\n")), 256)


def mode_of(df: DataFrame, group: str, value: str, norm: Column) -> DataFrame:
    """Most frequent value of each group; ties by normalised form, then by the value."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), norm, value)
    return counts.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def count_map(df: DataFrame, group: str, value: str) -> DataFrame:
    """Counts of each value in a group as a JSON object with sorted keys."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(value).alias("key"), F.col("n").alias("value"))))
    return counts.groupBy(group).agg(F.to_json(F.map_from_entries(entries)).alias("counts"))


def nearest_rank(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Value at rank ceil(share * n) in ascending order."""
    w = Window.partitionBy(group)
    rows = df.filter(F.col(value).isNotNull()).select(group, value, F.row_number().over(w.orderBy(value)).alias("_r"), F.count("*").over(w).alias("_n"))
    at = lambda s: F.max(F.when(F.col("_r") == F.greatest(F.lit(1), F.ceil(F.lit(s) * F.col("_n"))), F.col(value)))
    return rows.groupBy(group).agg(*[at(s).alias(name) for name, s in shares.items()])


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's correlation. Ranks come from counts of distinct values, so only distinct values are ordered globally."""

    def with_rank(rows: DataFrame, c: str) -> DataFrame:
        counts = rows.groupBy(c).agg(F.count("*").alias("_n"))
        below = F.coalesce(F.sum("_n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return rows.join(counts.select(c, (below + (F.col("_n") + 1) / 2).alias(f"_rank_{c}")), c)

    rows = df.select(x, y).dropna()
    return with_rank(with_rank(rows, x), y).agg(F.round(F.corr(f"_rank_{x}", f"_rank_{y}"), 6).alias("rho"))


def bins(value: Column, edges: list[float]) -> Column:
    """Right-closed bins as labels `(a, b]`; null outside."""
    out = F.lit(None).cast("string")
    for a, b in reversed(list(zip(edges, edges[1:]))):
        out = F.when((value > a) & (value <= b), f"({a:g}, {b:g}]").otherwise(out)
    return out


def remap(rows: DataFrame, corpus: DataFrame, migration: DataFrame, id_col: str) -> DataFrame:
    """keep if the id is in the corpus, merged if the map leads to one that is, else unresolved."""
    here = corpus.select(F.col("poi_id").alias("_here"))
    to = migration.select(F.col("old_poi_id").alias("_old"), F.col("canonical_poi_id").alias("_to"))
    there = corpus.select(F.col("poi_id").alias("_there"))
    out = rows.join(here, F.col(id_col) == F.col("_here"), "left").join(to, F.col(id_col) == F.col("_old"), "left").join(there, F.col("_to") == F.col("_there"), "left")
    status = F.when(F.col("_here").isNotNull(), "keep").when(F.col("_there").isNotNull(), "merged").otherwise("unresolved")
    return out.withColumns({"status": status, "new_id": F.coalesce("_here", "_there")}).drop("_here", "_old", "_to", "_there")


def compose_migrations(first: DataFrame, second: DataFrame) -> DataFrame:
    """old -> new over two maps (old_poi_id, canonical_poi_id, action): a drop anywhere is a drop, else a merge anywhere
    is a merge, else keep. Ids that only the second map knows pass the first unchanged."""
    a = first.select("old_poi_id", F.col("canonical_poi_id").alias("mid"), F.col("action").alias("a1"))
    b = second.select(F.col("old_poi_id").alias("mid_id"), F.col("canonical_poi_id").alias("final"), F.col("action").alias("a2"))
    known = a.join(b, F.col("mid") == F.col("mid_id"), "left")
    only = b.join(a, F.col("mid_id") == F.col("old_poi_id"), "left_anti").select(F.col("mid_id").alias("old_poi_id"), F.col("mid_id").alias("mid"), F.lit("keep").alias("a1"), "mid_id", "final", "a2")
    rows = known.unionByName(only)
    action = F.when((F.col("a1") == "drop") | (F.coalesce("a2", F.lit("drop")) == "drop"), "drop").when((F.col("a1") == "merge") | (F.col("a2") == "merge"), "merge").otherwise("keep")
    return rows.select("old_poi_id", F.when(action != "drop", F.col("final")).alias("canonical_poi_id"), action.alias("action"))


def remap_arrays(rows: DataFrame, ids: str, key: str, first: str, migration: DataFrame) -> DataFrame:
    """Ids of an array mapped, dropped ones left out, duplicates kept once in order, the intended id before all."""
    each = rows.select(key, first, F.posexplode(ids).alias("_p", "_id"))
    head = rows.select(key, first, F.lit(-1).alias("_p"), F.col(first).alias("_id"))
    to = migration.select(F.col("old_poi_id").alias("_id"), F.col("canonical_poi_id").alias("_to"))
    mapped = each.unionByName(head).join(to, "_id").filter("_to is not null")
    kept = mapped.groupBy(key, "_to").agg(F.min("_p").alias("_p"))
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_to"))), lambda s: s["_to"]).alias(ids))


def as_of_history(history: DataFrame, requests: DataFrame, keep: int) -> DataFrame:
    """Events up to each request's cutoff, the latest of each poi, newest first.

    history: user_id, poi_id, ts; requests: request_id, user_id, cutoff.
    """
    seen = requests.join(history, "user_id").filter(F.col("ts") <= F.col("cutoff"))
    latest = seen.groupBy("request_id", "poi_id").agg(F.max("ts").alias("ts"))
    order = Window.partitionBy("request_id").orderBy(F.desc("ts"), "poi_id")
    return latest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def quota_dedup(df: DataFrame, key: str, item: str, priority: Column, quota: int) -> DataFrame:
    """Each item goes to its first source in priority; then each source keeps its first `quota` items by rank."""
    own = keep_first(df.withColumn("_p", priority), [key, item], [F.col("_p"), F.col("rank")])
    order = Window.partitionBy(key, "source").orderBy("rank", item)
    return own.withColumn("_q", F.row_number().over(order)).filter(F.col("_q") <= quota).drop("_q", "_p")


def rank_of_target(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """1 + number of better scores + number of equal scores with a smaller index, without a sort.

    scores: query_id, idx, score; targets: query_id, t_idx.
    """
    t = targets.join(scores, (scores["query_id"] == targets["query_id"]) & (scores["idx"] == targets["t_idx"])).select(targets["query_id"], "t_idx", F.col("score").alias("t_score"))
    better = (F.col("score") > F.col("t_score")) | ((F.col("score") == F.col("t_score")) & (F.col("idx") < F.col("t_idx")))
    return scores.join(t, "query_id").groupBy("query_id").agg((1 + F.count_if(better)).alias("rank"))


def permute_cohort(ranked: DataFrame, cohort: Column, order: list[Column], by: str = "query_id") -> DataFrame:
    """Rows of the cohort trade places among the ranks they hold, in the given order; all others stay."""
    rows = ranked.withColumn("_in", F.coalesce(cohort, F.lit(False)))
    w = Window.partitionBy(by, "_in")
    slot = F.row_number().over(w.orderBy("rank"))
    rows = rows.withColumns({"_slot": slot, "_turn": F.when(F.col("_in"), F.row_number().over(w.orderBy(*order))).otherwise(slot)})
    slots = rows.select(by, "_in", F.col("_slot").alias("_turn"), F.col("rank").alias("_rank"))
    return rows.join(slots, [by, "_in", "_turn"]).withColumn("rank", F.col("_rank")).drop("_in", "_slot", "_turn", "_rank")
