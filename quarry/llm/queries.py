"""The operators of this subpackage as queries over their whole tables, and their SQL where SQL can express them.

Each query passes its table whole to its operator, with production parameters. What nulls, empty and very long texts, ties,
repeated rows, empty tables and further columns give is stated at the operator that the query calls; none of them fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, html_extract, language_id, licenses, packing, quality, simhash, tokenio, topk, unigram
from quarry.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, as `html_extract.extract` has it."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, as `language_id.identify` has it."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document, as `quality.assess` has them."""
    return quality.assess(table(spark, sf_dir, "documents"), once=False)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them, as `bpe.encode_digests` has them."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, as `simhash.group` has them."""
    return simhash.group(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every fiftieth vector among all, as `topk.top_k` has them."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op7_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the files, as `tokenio.round_trip` has it."""
    return tokenio.round_trip(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece and its place, as `packing.pack` has them."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document, as `licenses.scan` has them."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document, as `unigram.count_tokens` has them."""
    return unigram.count_tokens(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_html_extraction, op2_language_id, op3_quality_rules, op4_bpe_round_trip, op5_simhash, op6_exact_top_k, op7_token_id_files, op8_best_fit_packing, op9_license_scan, op10_token_counts)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
           where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, cast(list_dot_product(q.e, v.e) as bigint) as score
      from v q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e) where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
    }
