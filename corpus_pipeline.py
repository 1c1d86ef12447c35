"""A training-data pipeline over the documents table: quality rules, language, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import language_id, packing, quality, simhash
from quarry.llm.common import table
from quarry.sources.shared import remove, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key, a 64-bit hash of id, text and language, null apart from every value: no operator tells rows
    of one key apart, and rows without an id or with a shared one each have their own verdict."""
    parts = [x for c in ("doc_id", "text", "lang") for x in (F.col(c).isNull(), F.col(c))]
    return docs.withColumn("key", F.xxhash64(*parts))


def _by_key(rows: DataFrame) -> DataFrame:
    """Keyed rows as an operator takes them, the key in place of doc_id."""
    return rows.select(F.col("key").alias("doc_id"), "text", "lang")


def _only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The keyed rows whose key is in column doc_id of keys."""
    return rows.join(keys.select(F.col("doc_id").alias("key")), "key", "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose text passes the quality rules, as `quality.assess` has them; null texts go. Repeated rows stay
    repeated, rows without an id have their own verdict, an empty table stays empty, other columns go."""
    rows = _keyed(docs)
    return _only(rows, quality.assess(_by_key(rows), once=False).filter("kept")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language: no letters, or less than half of the posterior. Rows without a
    language take the predicted one. Nulls, repeats and empty tables as in `language_id.predict`: each row by itself."""
    model = language_id.fit(docs.filter(~language_id.held_out()))
    known = language_id.predict(docs, model, also=COLUMNS[1:]).filter("lang_pred <> 'und' and score >= 0.5")
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates by SimHash over five words: of the smallest id (null last), any one
    where rows with that id repeat. Texts without words are one group."""
    rows = _keyed(docs)
    groups = simhash.group(_by_key(rows), words=5).select(F.col("doc_id").alias("key"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    first = groups.join(rows.select("key", "doc_id"), "key").groupBy("component_id").agg(F.min(order)["key"].alias("doc_id"))
    return _only(rows, first).dropDuplicates(["key"]).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places as `packing.pack` has them, for every row."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("language id", language), ("simhash near-dedup", near_duplicates), ("best-fit packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # the stage before is read no more
            remove(spark, f"{folder}/{k - 1}")
    return docs


#: The stages rest on trained models and fingerprints, which SQL does not express.
ORACLE_SQL = None
