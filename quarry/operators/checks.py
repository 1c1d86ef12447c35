"""Validators as rule tables: each rule yields (rule, key, detail) rows; a table passes if no rule yields any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_rules(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """Rules on single rows, all in one scan: `rules` maps a name to a condition that must hold (null: broken)."""
    found = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(F.explode(F.filter(found, lambda r: r.isNotNull())).alias("rule"), key.cast("string").alias("key"))


def unique(df: DataFrame, key: str, rule: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def foreign_key(df: DataFrame, key: str, ref: DataFrame, ref_key: str, rule: str) -> DataFrame:
    return df.join(ref.select(F.col(ref_key).alias(key)), key, "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def group_size(df: DataFrame, key: str, least: int, most: int, rule: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") < least) | (F.col("n") > most)).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def cross_split_leaks(df: DataFrame, key: Column, split: str) -> DataFrame:
    """Keys that stand in more than one split, with the splits."""
    return df.groupBy(key.alias("key")).agg(F.array_join(F.array_sort(F.collect_set(split)), "|").alias("splits")).filter(F.contains("splits", F.lit("|")))


def ambiguous_queries(df: DataFrame, norm: Column, ids: Column) -> DataFrame:
    """Equal query texts with different sets of acceptable ids."""
    return df.groupBy(norm.alias("query")).agg(F.countDistinct(F.array_join(F.array_sort(ids), "|")).alias("n_sets")).filter("n_sets > 1")


def quotas(df: DataFrame, tag: str, minima: DataFrame) -> DataFrame:
    """Tags with fewer rows than their minimum."""
    have = df.groupBy(tag).agg(F.count("*").alias("n"))
    return minima.join(have, tag, "left").select(tag, F.coalesce("n", F.lit(0)).alias("n"), "least").filter("n < least")


def verdict(errors: DataFrame, names: list[str]) -> DataFrame:
    """One row for each rule: how often it is broken and whether it passes."""
    every = errors.sparkSession.createDataFrame([(n,) for n in names], "rule string")
    n = errors.groupBy("rule").agg(F.count("*").alias("n"))
    return every.join(n, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n")).withColumn("verdict", F.when(F.col("n") == 0, "PASS").otherwise("FAIL"))
