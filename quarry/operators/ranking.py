"""Second-stage ranking as expressions and window operators keyed by query_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.geo import decay
from quarry.functions.text import contains_span
from quarry.operators.tables import permute_cohort


def name_level(query: Column, name: Column) -> Column:
    """3: the whole name; 2: a complete phrase in it; 1: a phrase whose last token is unfinished; else null."""
    return F.when((F.size(query) > 0) & (query == name), 3).when(contains_span(query, name), 2).when(contains_span(query, name, True), 1)


def token_overlap(query: Column, fields: Column) -> Column:
    """Share of query tokens in the fields; an unfinished last token (letters, three or more) counts one half."""
    n = F.size(query)

    def score(t, i):
        open_ = (i == n - 1) & t.rlike(r"^\p{L}{3,}$") & F.exists(fields, lambda f: F.startswith(f, t))
        return F.when(F.array_contains(fields, t), 1.0).when(open_, 0.5).otherwise(0.0)

    return F.when(n > 0, F.aggregate(F.transform(query, score), F.lit(0.0), lambda a, b: a + b) / n).otherwise(0.0)


def accent_coverage(query: Column, names: Column) -> Column:
    """As token_overlap over tokens with accents, an unfinished last token from two letters on."""
    n = F.size(query)

    def score(t, i):
        open_ = (i == n - 1) & t.rlike(r"^\p{L}{2,}$") & F.exists(names, lambda f: F.startswith(f, t))
        return F.when(F.array_contains(names, t), 1.0).when(open_, 0.5).otherwise(0.0)

    return F.when((n > 0) & (F.size(names) > 0), F.aggregate(F.transform(query, score), F.lit(0.0), lambda a, b: a + b) / n).otherwise(0.0)


def compatible_numbers(query: Column, fields: Column) -> Column:
    """Every query token with a digit stands whole in the fields."""
    return F.size(F.array_except(F.filter(query, lambda t: t.rlike(r"\p{Nd}")), fields)) == 0


def geo_blend(rrf_ratio: Column, coverage: Column, exact: Column, folded_exact: Column, distance: Column, compatible: Column) -> Column:
    """0.65 of text relevance (retrieval 0.65, coverage 0.35, exact bonus 0.04 or half) and 0.35 of distance decay."""
    text = 0.65 * rrf_ratio + 0.35 * coverage + F.when(exact, 0.04).when(folded_exact, 0.02).otherwise(0.0)
    text = F.when(exact | folded_exact, F.greatest(text, 0.65 * rrf_ratio + 0.35)).otherwise(text)
    near = F.when(distance.isNotNull() & compatible, F.exp(-distance / 5000.0)).otherwise(0.0)
    return 0.65 * text + 0.35 * near


def _head(column: str) -> Column:
    return F.first(column).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def geo_cohort(ranked: DataFrame, window: int = 10, floor: float = 0.5) -> DataFrame:
    """Reorders by distance decay only those of the first `window` rows that match as the head does and have at least
    half of its retrieval score. Columns: query_id, doc_id, rank, match_class, distance_m, rrf_ratio."""
    rows = ranked.withColumn("_head", _head("match_class"))
    same = (F.col("rank") <= window) & F.col("distance_m").isNotNull() & (F.col("rrf_ratio") >= floor) & (F.col("match_class") == F.col("_head"))
    points = F.round(decay(F.col("distance_m")), 9)
    return permute_cohort(rows, F.coalesce(same, F.lit(False)), [points.desc(), F.asc("rank")]).drop("_head")


def history_cohort(ranked: DataFrame, window: int = 10) -> DataFrame:
    """Places of the user's history come first among the rows of the window with the head's evidence; none is pulled in
    from outside. Columns: query_id, doc_id, rank, cohort_key, preferred_rank (null: not in the history)."""
    rows = ranked.withColumn("_head", _head("cohort_key"))
    same = (F.col("rank") <= window) & (F.col("cohort_key") == F.col("_head"))
    return permute_cohort(rows, F.coalesce(same, F.lit(False)), [F.asc_nulls_last("preferred_rank"), F.asc("rank")]).drop("_head")


def match_quality_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks by descending evidence columns, then by the rank before, then by id."""
    order = Window.partitionBy("query_id").orderBy(*[F.desc(k) for k in keys], "rank", "doc_id")
    return rows.withColumn("rank", F.row_number().over(order))


def loss_class() -> Column:
    """The earliest stage that lost the target, from flags of presence; null if it is in the top."""
    c = F.col
    return (
        F.when(c("in_top"), F.lit(None).cast("string"))
        .when(~c("retrieved") & ~c("rescued"), "retrieval_miss")
        .when(c("rescued") & ~c("deduped"), "lost_at_dedup_or_cap")
        .when(c("deduped") & ~c("after_geo"), "lost_at_geo")
        .when(c("after_geo") & ~c("after_name_address"), "lost_at_name_address")
        .when(c("after_name_address") & ~c("after_match"), "lost_at_name_match_quality")
        .when(c("after_match"), "lost_below_top_k")
        .otherwise("ranking_miss")
    )
