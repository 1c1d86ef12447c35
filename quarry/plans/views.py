"""Derived tables that stand in for places, queries and histories: the same SQL text in Spark and in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables whose rows cost enough work to be dealt out.
HEAVY = ("documents", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a heavy one in fewer parts than there are cores (a single small file) is dealt out over them once."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in HEAVY and df.rdd.getNumPartitions() < min(cores, 64) else df


#: column -> SQL over part; portable between both engines.
PLACES = {
    "poi_id": "concat('p:', cast(p_partkey as string))",
    "k": "p_partkey",
    "name": "p_name",
    "brand": "p_brand",
    "category": "p_type",
    "housenumber": "cast(p_size as string)",
    "street": "concat('street ', cast(p_partkey % 40 as string))",
    "region_id": "cast(p_partkey % 13 as int)",
    "destination_searchable": "(p_size % 10) <> 0",
    "lat": "cast(20.98 as double) + cast((p_partkey * 7919) % 1009 as double) / 5e4",
    "lon": "cast(105.80 as double) + cast((p_partkey * 104729) % 997 as double) / 5e4",
}
PLACES_SQL = "places as (select " + ", ".join(f"{sql} as {name}" for name, sql in PLACES.items()) + " from part)"

ANCHORS = {
    "anchor_id": "c_custkey",
    "lat": "cast(20.98 as double) + cast((c_custkey * 6007) % 1009 as double) / 5e4",
    "lon": "cast(105.80 as double) + cast((c_custkey * 3571) % 997 as double) / 5e4",
}
#: Every customer is an anchor.
ANCHORS_SQL = "anchors as (select " + ", ".join(f"{sql} as {name}" for name, sql in ANCHORS.items()) + " from customer)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{sql} as {name}" for name, sql in PLACES.items()])


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*[f"{sql} as {name}" for name, sql in ANCHORS.items()])


#: DuckDB's side of functions.text.fold and its token arrays, over a text column.
def fold_sql(c: str) -> str:
    return f"trim(regexp_replace(strip_accents(replace(lower(coalesce({c}, '')), 'ß', 'ss')), '\\s+', ' ', 'g'))"


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all({fold_sql(c)}, '[a-z0-9]+')"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = 6371000.0) -> str:
    return f"2 * {radius} * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"
