"""Validators of releases: each gives (rule, key) for every violation and no row for a release that passes.

Rules on single rows are conditions of one scan; rules on groups are aggregations, and rules between tables anti-joins, so
no table is gathered. A missing value breaks a rule that asks for one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import checks
from quarry.operators.tables import pool_hash

# What a release's columns may say.
MEMBERSHIP = ("accepted", "needs_review", "excluded")
REVIEW = ("authored", "accepted", "needs_review")
LANGUAGES = ("lang_vi", "lang_en", "lang_mixed")
# Family and severity of each operator that makes a brand query.
OPERATORS = {
    "brand_canonical": ("BRAND_CANONICAL", "CLEAN"),
    "brand_namespace_form": ("BRAND_NAMESPACE", "CLEAN"),
    "brand_alias": ("BRAND_ALIAS", "CLEAN"),
    "brand_case_punct": ("BRAND_CASE_PUNCT", "SINGLE"),
    "brand_mechanical_typo": ("BRAND_MECHANICAL_TYPO", "SINGLE"),
    "brand_space_variant": ("BRAND_SPACE_VARIANT", "SINGLE"),
    "brand_orthographic_ime": ("BRAND_ORTHOGRAPHIC_IME", "SINGLE"),
    "brand_phonetic": ("BRAND_PHONETIC", "SINGLE"),
}


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _found(rows: DataFrame, rule: str, key: Column | str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"))


def _repeated(rows: DataFrame, rule: str, *columns: str) -> DataFrame:
    return _found(rows.groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n > 1"), rule, F.concat_ws("|", *columns))


def brand_members(members: DataFrame, families: DataFrame, version: str) -> DataFrame:
    """A release of brand groups. members: brand_family_id, brand_group_id, brand_canonical, brand_fold, brand_namespace,
    poi_id, destination_searchable, membership_status, review_status, group_version; families: brand_family_id,
    candidate_source, group_version."""
    accepted = F.col("membership_status") == "accepted"
    rules = {
        "known_namespace": F.col("brand_namespace").isin(*T.NAMESPACE_TOKENS, "other_reviewed"),
        "known_membership_status": F.col("membership_status").isin(*MEMBERSHIP),
        "known_review_status": F.col("review_status").isin(*REVIEW),
        "member_version": F.col("group_version") == version,
        "group_is_family_and_namespace": F.col("brand_group_id") == F.concat_ws(":", "brand_family_id", "brand_namespace"),
        "fold_of_canonical": F.col("brand_fold") == T.normalized(F.col("brand_canonical")),
        "accepted_is_searchable": ~accepted | F.col("destination_searchable"),
        "accepted_is_reviewed": ~accepted | (F.col("review_status") != "needs_review"),
        "accepted_has_a_namespace": ~accepted | (F.col("brand_namespace") != "other_reviewed"),
    }
    explicit = families.filter("candidate_source = 'explicit_brand'").select("brand_family_id")
    small = members.filter(accepted).groupBy("brand_group_id").agg(F.count("*").alias("_n")).filter("_n < 2")
    return _all([
        checks.row_rules(members, F.col("poi_id"), rules),
        _repeated(members, "one_row_a_member", "brand_group_id", "poi_id"),
        _found(small, "accepted_group_of_two", "brand_group_id"),
        _found(families.filter(~F.coalesce(F.col("group_version") == version, F.lit(False))), "family_version", "brand_family_id"),
        _found(members.select("brand_family_id").distinct().join(explicit, "brand_family_id", "left_anti"), "explicit_family", "brand_family_id"),
    ])


def authoring_packets(packets: DataFrame, members: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Packets for authors, one for each accepted group. packets: brand_group_id, brand_family_id, brand_namespace,
    intent_id, intent_scope, qrel_policy, namespace_scope, positive_poi_ids, n_positive, positive_pool_sha256,
    verified_aliases, alias_usage and the columns of `versions`; members as in `brand_members`."""
    own = members.filter((F.col("membership_status") == "accepted") & F.col("destination_searchable"))
    pools = own.groupBy("brand_group_id").agg(F.array_sort(F.collect_set("poi_id")).alias("_pool"), pool_hash(F.col("poi_id")).alias("_hash"))
    rows = packets.join(pools, "brand_group_id", "left")
    pool = F.col("positive_poi_ids")
    rules = {
        "group_identity": F.col("brand_group_id") == F.concat_ws(":", "brand_family_id", "brand_namespace"),
        "intent_identity": (F.col("intent_id") == F.col("brand_group_id")) & (F.col("intent_scope") == "BRAND"),
        "qrel_policy": F.col("qrel_policy") == "FAMILY_NAMESPACE",
        "namespace_scope": F.col("namespace_scope") == F.array("brand_namespace"),
        "pool_sorted_and_distinct": pool == F.array_sort(F.array_distinct(pool)),
        "pool_of_accepted_members": pool == F.col("_pool"),
        "pool_count": (F.col("n_positive") == F.size(pool)) & (F.size(pool) > 0),
        "pool_hash": F.col("positive_pool_sha256") == F.col("_hash"),
        "aliases_are_a_list": F.col("verified_aliases").isNotNull(),
        "alias_usage": F.col("alias_usage") == "review_only_do_not_author_until_adjudicated",
    } | {name: F.col(name) == value for name, value in versions.items()}
    return _all([
        checks.row_rules(rows, F.col("brand_group_id"), rules),
        _repeated(packets, "one_row_a_group", "brand_group_id"),
        _repeated(packets, "one_row_a_family_and_namespace", "brand_family_id", "brand_namespace"),
        _found(pools.join(packets.select("brand_group_id"), "brand_group_id", "left_anti"), "every_accepted_group", "brand_group_id"),
    ])


def brand_queries(queries: DataFrame, qrels: DataFrame, packets: DataFrame, version: str, qrels_version: str, partial: bool = False) -> DataFrame:
    """Authored brand queries against their packets. queries: query_id, intent_id, intent_scope, brand_family_id,
    namespace_scope, qrel_policy, canonical_brand_query, query_text, query_variant_family, variant_operator, severity,
    language_tag, review_status, generator_version; qrels: query_id, poi_id, relation, qrels_version; packets: intent_id,
    brand_family_id, brand_namespace, namespace_scope, requires_namespace_token, verified_aliases, positive_poi_ids."""
    p = packets.select("intent_id", F.col("brand_family_id").alias("p_family"), F.col("namespace_scope").alias("p_scope"), F.col("brand_namespace").alias("p_namespace"), "requires_namespace_token", "verified_aliases")
    rows = queries.join(p, "intent_id")
    text, canonical, operator = F.coalesce("query_text", F.lit("")), F.coalesce("canonical_brand_query", F.lit("")), F.col("variant_operator")
    compact = lambda c: F.regexp_replace(T.normalized(c), r"[^\p{L}\p{N}+]", "")
    spec = F.lit(False)
    for name, (family, severity) in OPERATORS.items():
        spec = spec | ((operator == name) & (F.col("query_variant_family") == family) & (F.col("severity") == severity))
    unless = lambda name, ok: (operator != name) | ok
    rules = {
        "query_id_form": F.col("query_id").rlike(r"^brandq1-\d{5}-v\d{2}$"),
        "intent_scope": F.col("intent_scope") == "BRAND",
        "qrel_policy": F.col("qrel_policy") == "FAMILY_NAMESPACE",
        "family_of_packet": F.col("brand_family_id") == F.col("p_family"),
        "scope_of_packet": F.col("namespace_scope") == F.col("p_scope"),
        "generator_version": F.col("generator_version") == version,
        "review_status": F.col("review_status").isin(*REVIEW),
        "language_tag": F.col("language_tag").isin(*LANGUAGES),
        "text_is_known": F.trim(text) != "",
        "known_operator": operator.isin(*OPERATORS),
        "family_and_severity": spec | ~F.coalesce(operator.isin(*OPERATORS), F.lit(False)),
        "verified_alias": unless("brand_alias", F.array_contains("verified_aliases", F.trim(text))),
        "one_slip": unless("brand_mechanical_typo", T.one_slip(T.normalized(canonical), T.normalized(text))),
        "case_keeps_identity": unless("brand_case_punct", compact(canonical) == compact(text)),
        "space_keeps_identity": unless("brand_space_variant", compact(canonical) == compact(text)),
        "namespace_token": ~F.col("requires_namespace_token") | T.has_namespace_token(text, F.col("p_namespace")),
    }
    norm = rows.withColumn("_norm", T.normalized(F.col("query_text")))
    of_intent = norm.groupBy("intent_id").agg(F.count("*").alias("n"), F.count_if(operator == "brand_canonical").alias("canonical"), F.count_distinct(canonical).alias("values"), F.count_distinct("_norm").alias("texts"))
    intents = checks.row_rules(of_intent, F.col("intent_id"), {"two_to_six_rows": F.col("n").between(2, 6), "one_canonical_row": F.col("canonical") == 1, "one_canonical_text": F.col("values") == 1, "distinct_texts": F.col("texts") == F.col("n")})
    shared = norm.groupBy("_norm").agg(F.count_distinct("intent_id").alias("n")).filter("n > 1")
    want = queries.join(packets.select("intent_id", "positive_poi_ids"), "intent_id").select("query_id", F.array_sort(F.array_distinct("positive_poi_ids")).alias("want"))
    have = qrels.groupBy("query_id").agg(F.array_sort(F.collect_set("poi_id")).alias("have"))
    differ = want.join(have, "query_id", "left").filter(F.col("want") != F.coalesce("have", F.array().cast("array<string>")))
    parts = [
        checks.row_rules(rows, F.col("query_id"), rules), intents,
        _repeated(queries, "one_row_a_query", "query_id"),
        _found(queries.join(packets.select("intent_id"), "intent_id", "left_anti"), "known_intent", "query_id"),
        _found(shared, "text_of_one_intent", "_norm"),
        checks.row_rules(qrels, F.concat_ws("|", "query_id", "poi_id"), {"relation": F.col("relation") == "positive_pool", "qrels_version": F.col("qrels_version") == qrels_version}),
        _repeated(qrels, "one_row_a_qrel", "query_id", "poi_id"),
        _found(qrels.join(queries.select("query_id"), "query_id", "left_anti"), "qrel_of_a_query", F.concat_ws("|", "query_id", "poi_id")),
        _found(differ, "qrels_are_the_pool", "query_id"),
    ]
    if not partial:
        parts.append(_found(packets.join(queries.select("intent_id"), "intent_id", "left_anti"), "every_intent", "intent_id"))
    return _all(parts)


def clean_corpus(core: DataFrame, documents: DataFrame, access: DataFrame, regions: DataFrame, migration: DataFrame, metres: float, expected: dict[str, int] | None = None) -> DataFrame:
    """A cleaned corpus and its migration. core: poi_id, name; documents: poi_id, name, passage_context; access, regions:
    poi_id; migration: old_poi_id, canonical_poi_id, action, distance_to_canonical_m; expected: rows (of core) and actions
    by name, as a manifest has them."""
    ids = core.select("poi_id").distinct().withColumn("_there", F.lit(True))
    own = documents.select("poi_id", F.col("name").alias("d_name"), "passage_context")
    paired = core.join(own, "poi_id", "left")
    rows = {"same_name": F.col("name") == F.col("d_name"), "passage_begins_with_name": F.startswith("passage_context", F.concat("name", F.lit(" |")))}
    old, new = ids.select(F.col("poi_id").alias("old_poi_id"), F.col("_there").alias("_old")), ids.select(F.col("poi_id").alias("canonical_poi_id"), F.col("_there").alias("_new"))
    moved = migration.join(old, "old_poi_id", "left").join(new, "canonical_poi_id", "left")
    dropped, merged = F.col("action") == "drop_junk_or_foreign", F.col("action") == "merge_duplicate"
    moves = {
        "dropped_leads_nowhere": ~dropped | (F.col("canonical_poi_id").isNull() & F.col("_old").isNull()),
        "kept_leads_to_a_survivor": dropped | F.col("_new"),
        "merged_is_near": ~merged | (F.col("distance_to_canonical_m") < metres),
    }
    parts = [
        checks.row_rules(paired, F.col("poi_id"), rows), checks.row_rules(moved, F.col("old_poi_id"), moves),
        _repeated(core, "one_row_a_place", "poi_id"), _repeated(migration, "one_row_an_old_id", "old_poi_id"),
    ]
    for name, other in (("documents", documents), ("access", access)):
        parts.append(_found(other.join(ids, "poi_id", "left_anti"), f"{name}_of_a_place", "poi_id"))
        parts.append(_found(ids.join(other.select("poi_id"), "poi_id", "left_anti"), f"place_in_{name}", "poi_id"))
    parts.append(_found(regions.join(ids, "poi_id", "left_anti"), "regions_of_a_place", "poi_id"))
    if expected is not None:
        have = core.agg(F.lit("rows").alias("key"), F.count("*").alias("n")).unionByName(migration.groupBy(F.col("action").alias("key")).agg(F.count("*").alias("n")))
        want = core.sparkSession.createDataFrame(sorted(expected.items()), "key string, want long")
        parts.append(_found(have.join(want, "key", "full").filter(~F.col("n").eqNullSafe(F.col("want"))), "counts_of_manifest", "key"))
    return _all(parts)
