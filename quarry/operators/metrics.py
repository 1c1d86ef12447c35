"""Retrieval metrics over runs (query_id, doc_id, rank) and relevance (query_id, doc_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.training import hash_order


def best_ranks(run: DataFrame, qrels: DataFrame, queries: DataFrame, miss: int | None = None) -> DataFrame:
    """Each query's best rank of an acceptable document; `miss` (null) where there is none. All queries are kept."""
    hit = run.join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("best_rank"))
    out = queries.select("query_id").join(hit, "query_id", "left")
    return out.withColumn("best_rank", F.coalesce("best_rank", F.lit(miss))) if miss is not None else out


def recall_at(best: Column, k: int) -> Column:
    return F.avg(F.when(best <= k, 1.0).otherwise(0.0))


def mrr_at(best: Column, k: int) -> Column:
    return F.avg(F.when(best <= k, 1.0 / best).otherwise(0.0))


def summary(best: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 50), by: tuple[str, ...] = ()) -> DataFrame:
    """Recall at each k, MRR@10, miss@50 and the number of queries, for all or each slice."""
    b = F.col("best_rank")
    out = [F.count("*").alias("n"), *[F.round(recall_at(b, k), 6).alias(f"r{k}") for k in ks], F.round(mrr_at(b, 10), 6).alias("mrr10"), F.round(F.avg(F.when(b <= 50, 0.0).otherwise(1.0)), 6).alias("miss50")]
    return best.groupBy(*by).agg(*out) if by else best.agg(*out)


def depth_needed(best: DataFrame, rates: dict[str, float], depth: int) -> DataFrame:
    """The rank that covers a share of queries: at place ceil(rate * n) in ascending order; null beyond `depth`.

    Counts by rank come first, so only distinct ranks are put in order.
    """
    rows = best.select(F.coalesce("best_rank", F.lit(depth + 1)).alias("r")).groupBy("r").agg(F.count("*").alias("c"))
    upto = rows.select("r", F.sum("c").over(Window.orderBy("r")).alias("upto"))
    n = best.agg(F.count("*").alias("n"))
    joined = upto.crossJoin(F.broadcast(n))
    value = lambda rate: F.min(F.when(F.col("upto") >= F.ceil(F.lit(rate) * F.col("n")), F.col("r")))
    return joined.agg(*[F.when(value(rate) <= depth, value(rate)).alias(name) for name, rate in rates.items()])


def rescue(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Counts of queries found by the first alone, the second alone, both, neither, and by their union, within k."""
    both = a.select("query_id", F.col("best_rank").alias("a")).join(b.select("query_id", F.col("best_rank").alias("b")), "query_id", "full")
    x, y = F.coalesce(F.col("a") <= k, F.lit(False)), F.coalesce(F.col("b") <= k, F.lit(False))
    return both.agg(F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(x & y).alias("both"), F.count_if(~x & ~y).alias("neither"), F.count_if(x | y).alias("either"))


def prefix_metrics(steps: DataFrame, k: int = 10, window: int = 3) -> DataFrame:
    """Of (query_id, idx, rank): first hit, first of `window` consecutive hits at consecutive indexes, mean hit rate."""
    hit = F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))
    rows = steps.select("query_id", "idx", hit.alias("hit"))
    ahead = Window.partitionBy("query_id").orderBy("idx").rangeBetween(0, window - 1)
    rows = rows.withColumn("run", F.sum("hit").over(ahead))
    return rows.groupBy("query_id").agg(F.min(F.when(F.col("hit") == 1, F.col("idx"))).alias("first_hit"), F.min(F.when(F.col("run") == window, F.col("idx"))).alias("stable_hit"), F.round(F.avg("hit"), 6).alias("auc"))


def typing_sessions(events: DataFrame) -> DataFrame:
    """Of (session_id, event_index, hit): first hit, first hit that lasts, censored at one past the end, and flags."""
    order = Window.partitionBy("session_id").orderBy("event_index")
    rows = events.withColumn("step", F.row_number().over(order))
    rows = rows.withColumn("lasts", F.min(F.col("hit").cast("int")).over(Window.partitionBy("session_id").orderBy("step").rowsBetween(0, Window.unboundedFollowing)))
    g = rows.groupBy("session_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("hit"), F.col("step"))).alias("first"), F.min(F.when(F.col("lasts") == 1, F.col("step"))).alias("stable"), F.max_by("hit", "step").alias("final_hit"))
    return g.withColumns({
        "first_censored": F.coalesce("first", F.col("n") + 1),
        "stable_censored": F.coalesce("stable", F.col("n") + 1),
        "saved": F.coalesce(F.col("n") - F.col("stable"), F.lit(0)),
        "transient": F.col("first").isNotNull() & ~F.col("final_hit"),
        "retained": F.coalesce(F.col("first") == F.col("stable"), F.lit(False)),
    })


def session_summary(sessions: DataFrame) -> DataFrame:
    rate = lambda c: F.round(F.avg(c.cast("int").cast("double")), 6)
    return sessions.agg(
        F.count("*").alias("sessions"),
        rate(F.col("first").isNotNull()).alias("found_rate"),
        rate(F.col("stable").isNotNull()).alias("stable_found_rate"),
        rate(F.col("final_hit")).alias("final_hit_rate"),
        rate(F.col("transient")).alias("transient_rate"),
        F.round(F.avg("first_censored"), 6).alias("first_mean"),
        F.round(F.avg("stable_censored"), 6).alias("stable_mean"),
        F.round(F.avg("saved"), 6).alias("saved_mean"),
    )


def family_mean(values: DataFrame, family: str, value: str) -> DataFrame:
    """Mean of the families' means: every family weighs the same."""
    return values.groupBy(family).agg(F.avg(value).alias("m")).agg(F.round(F.avg("m"), 6).alias("mean"), F.count("*").alias("n_families"))


def bootstrap(families: DataFrame, family: str, value: str, draws: int = 1000, seed: int = 20260926) -> DataFrame:
    """Mean of family means with a percentile interval over resampled families.

    A draw is a pair (sample, slot) whose family is picked by a hash of both, so it needs no random state and is the
    same on any partitioning. families: one row for each family (a bounded evaluation set).
    """
    means = families.groupBy(family).agg(F.avg(value).alias("m"))
    numbered = means.withColumn("i", F.row_number().over(Window.orderBy(family)) - 1)
    total = numbered.agg(F.count("*").alias("n"))
    slots = numbered.select(F.col("i").alias("slot")).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picked = slots.crossJoin(F.broadcast(total)).withColumn("i", F.pmod(hash_order(seed, "sample", "slot"), F.col("n")).cast("int"))
    boots = picked.join(numbered, "i").groupBy("sample").agg(F.avg("m").alias("mean"))
    ordered = boots.withColumn("r", F.row_number().over(Window.orderBy("mean")) - 1)
    at = lambda s: F.max(F.when(F.col("r") == int(s * (draws - 1)), F.col("mean")))
    return ordered.agg(at(0.025).alias("low"), at(0.975).alias("high")).crossJoin(means.agg(F.avg("m").alias("mean"), F.count("*").alias("n_families")))


def brand_metrics(run: DataFrame, queries: DataFrame, qrels: DataFrame, siblings: DataFrame, k: int = 20) -> DataFrame:
    """Per query: first compatible rank, coverage of acceptable places within k, and whether only a sibling was shown.

    queries: query_id, family, group; qrels: query_id, doc_id; siblings: group, doc_id (other groups of the family).
    """
    need = qrels.groupBy("query_id").agg(F.count("*").alias("n_acceptable"))
    good = run.join(qrels, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= k).alias("found"))
    wrong = run.filter(F.col("rank") <= k).join(queries.select("query_id", "group"), "query_id").join(siblings, ["group", "doc_id"], "left_semi").select("query_id").distinct().withColumn("sibling", F.lit(True))
    out = queries.join(need, "query_id", "left").join(good, "query_id", "left").join(wrong, "query_id", "left")
    coverage = F.coalesce(F.col("found") / F.col("n_acceptable"), F.lit(0.0))
    false_branch = F.coalesce("sibling", F.lit(False)) & (F.col("first").isNull() | (F.col("first") > k))
    return out.select("query_id", "family", F.coalesce("first", F.lit(51)).alias("first"), F.round(coverage, 6).alias("coverage"), false_branch.alias("false_branch"))


def miss_class(in_corpus: Column, rank: Column) -> Column:
    """absent from the corpus, no candidate within 50, ranked below 20, or found."""
    return F.when(~in_corpus, "absent").when(rank.isNull() | (rank > 50), "candidate").when(rank > 20, "rank").otherwise("hit20")


def rescue_and_harm(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Share of the first's misses that the second finds, and of its hits that the second loses."""
    rows = a.select("query_id", F.col("best_rank").alias("a")).join(b.select("query_id", F.col("best_rank").alias("b")), "query_id")
    x, y = F.coalesce(F.col("a") <= k, F.lit(False)), F.coalesce(F.col("b") <= k, F.lit(False))
    share = lambda c, of: F.round(F.avg(F.when(of, c.cast("double"))), 6)
    return rows.agg(share(y, ~x).alias("rescue_rate"), share(~y, x).alias("harm_rate"))


def overlap_at(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Share of the exact top k (or of the pool, if smaller) that the other run also has."""
    left = a.filter(F.col("rank") <= k)
    common = left.join(b.filter(F.col("rank") <= k).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("common"))
    return left.groupBy("query_id").agg(F.count("*").alias("pool")).join(common, "query_id", "left").select("query_id", F.round(F.coalesce("common", F.lit(0)) / F.col("pool"), 6).alias("overlap"))
