"""Readers and writers: CSV twins, JSON lines, GeoJSON, vectors and immutable releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, delimiter: str | None = None) -> None:
    """Arrays as canonical JSON (or joined by a delimiter), booleans in lower case, quotes doubled."""

    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, delimiter) if delimiter else F.to_json(c)
        elif isinstance(f.dataType, T.BooleanType):
            c = F.lower(c.cast("string"))
        return c.alias(f.name)

    df.select(*[cell(f) for f in df.schema]).write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, delimiter: str | None = None) -> tuple[DataFrame, Column]:
    """Typed rows of a CSV (a byte order mark is allowed), and a condition that marks rows with a bad value.

    A value that does not parse is null in the result and, where the text was not empty, marks its row.
    """
    names = [f.name for f in schema]
    raw = spark.read.option("header", True).option("escape", '"').option("encoding", "UTF-8").option("multiLine", True).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns]).select(*names)
    bad, out = F.lit(False), []
    for f in schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            listed = F.from_json(c, f.dataType)
            value = F.coalesce(listed, F.split(c, "[" + delimiter + "]").cast(f.dataType)) if delimiter else listed
        elif isinstance(f.dataType, T.BooleanType):
            value = F.when(F.lower(c).isin("true", "false"), F.lower(c) == "true")
        else:
            value = c.try_cast(f.dataType)
        bad = bad | (c.isNotNull() & (c != "") & value.isNull())
        out.append(value.alias(f.name))
    return raw.withColumn("_bad", bad).select(*out, "_bad"), F.col("_bad")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line: file, its text, the parsed record, and an error for lines that are no object of the schema."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter(F.trim("line") != "")
    rows = lines.withColumn("record", F.from_json("line", schema, {"mode": "PERMISSIVE"}))
    is_object = F.trim("line").rlike(r"^\{") & F.try_parse_json("line").isNotNull()
    return rows.withColumn("error", F.when(~is_object, "not an object"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """Spark's commit protocol makes the write atomic: readers see all parts or none."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one table and not in the other, as often as they are; the columns are those of the first."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def geojson_features(df: DataFrame, lat: str, lon: str, properties: list[str]) -> DataFrame:
    """One feature a row, longitude first; rows without coordinates are left out."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    rows = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def write_vectors(df: DataFrame, path: str) -> None:
    df.select("id", F.col("vector").cast("array<float>").alias("vector")).write.option("compression", "zstd").parquet(path)


def release(df: DataFrame, path: str, key: str) -> DataFrame:
    """Writes an immutable release (an existing one is refused) and returns its manifest: rows and hash of sorted keys.

    Keys are hashed in two steps, by hash bucket and then over the buckets, so no task holds them all.
    """
    df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/data")
    data = df.sparkSession.read.parquet(f"{path}/data")
    name = F.col(key).cast("string")
    buckets = data.groupBy(F.pmod(F.xxhash64(name), F.lit(4096)).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(name)), "\n"), 256).alias("h"))
    manifest = buckets.agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256).alias("keys_sha256"))
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return df.sparkSession.read.json(f"{path}/manifest")


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next `size` rows by key after a given one."""
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size)
