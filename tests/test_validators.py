"""Every rule of the validators: a release that passes, and one planted violation for each rule."""

import hashlib

import pytest

from quarry.operators import validators

MEMBERS = "brand_family_id string, brand_group_id string, brand_canonical string, brand_fold string, brand_namespace string, poi_id string, destination_searchable boolean, membership_status string, review_status string, group_version string"
FAMILIES = "brand_family_id string, candidate_source string, group_version string"


def member(poi="p1", family="brand:a", ns="cafe", **more):
    row = {"brand_family_id": family, "brand_group_id": f"{family}:{ns}", "brand_canonical": "Á Coffee", "brand_fold": "á coffee", "brand_namespace": ns, "poi_id": poi, "destination_searchable": True, "membership_status": "accepted", "review_status": "accepted", "group_version": "v1"}
    return row | more


def rows(found):
    return sorted((r.rule, r.key) for r in found.collect())


def members_of(spark, own):
    names = [c.split(" ")[0] for c in MEMBERS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in own], MEMBERS)


GOOD = [member("p1"), member("p2"), member("p3", "brand:b", "hotel"), member("p4", "brand:b", "hotel"), member("p5", "brand:b", "hotel", membership_status="needs_review", review_status="needs_review")]
SOURCES = [("brand:a", "explicit_brand", "v1"), ("brand:b", "explicit_brand", "v1"), ("brand:c", "derived", "v1")]


@pytest.mark.parametrize("planted,expected", [
    ([], []),
    ([member("x", ns="spa"), member("y", ns="spa")], [("known_namespace", "x"), ("known_namespace", "y")]),
    ([member("x", membership_status="odd")], [("known_membership_status", "x")]),
    ([member("x", review_status=None)], [("accepted_is_reviewed", "x"), ("known_review_status", "x")]),
    ([member("x", group_version="v0")], [("member_version", "x")]),
    ([member("x", brand_group_id="brand:a:hotel", membership_status="excluded")], [("group_is_family_and_namespace", "x")]),
    ([member("x", brand_fold="a coffee")], [("fold_of_canonical", "x")]),
    ([member("x", destination_searchable=False)], [("accepted_is_searchable", "x")]),
    ([member("x", review_status="needs_review")], [("accepted_is_reviewed", "x")]),
    ([member("x", ns="other_reviewed"), member("y", ns="other_reviewed")], [("accepted_has_a_namespace", "x"), ("accepted_has_a_namespace", "y")]),
    ([member("x", ns="bank")], [("accepted_group_of_two", "brand:a:bank")]),
    ([member("p1")], [("one_row_a_member", "brand:a:cafe|p1")]),
    ([member("x", "brand:c"), member("y", "brand:c")], [("explicit_family", "brand:c")]),
])
def test_brand_members(spark, planted, expected):
    got = validators.brand_members(members_of(spark, GOOD + planted), spark.createDataFrame(SOURCES, FAMILIES), "v1")
    assert rows(got) == sorted(expected)


def test_family_versions(spark):
    got = validators.brand_members(members_of(spark, GOOD), spark.createDataFrame(SOURCES + [("brand:d", "derived", None)], FAMILIES), "v1")
    assert rows(got) == [("family_version", "brand:d")]


PACKETS = "brand_group_id string, brand_family_id string, brand_namespace string, intent_id string, intent_scope string, qrel_policy string, namespace_scope array<string>, positive_poi_ids array<string>, n_positive int, positive_pool_sha256 string, verified_aliases array<string>, alias_usage string, packet_version string, requires_namespace_token boolean"


def packet(pool=("p1", "p2"), family="brand:a", ns="cafe", **more):
    group = f"{family}:{ns}"
    row = {"brand_group_id": group, "brand_family_id": family, "brand_namespace": ns, "intent_id": group, "intent_scope": "BRAND", "qrel_policy": "FAMILY_NAMESPACE", "namespace_scope": [ns], "positive_poi_ids": list(pool), "n_positive": len(pool)}
    row |= {"positive_pool_sha256": hashlib.sha256("".join(f"{p}\n" for p in sorted(set(pool))).encode()).hexdigest(), "verified_aliases": ["A Cafe"], "alias_usage": "review_only_do_not_author_until_adjudicated", "packet_version": "v1", "requires_namespace_token": False}
    return row | more


def packets_of(spark, own):
    names = [c.split(" ")[0] for c in PACKETS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in own], PACKETS)


B = packet(("p3", "p4"), "brand:b", "hotel")


@pytest.mark.parametrize("own,expected", [
    ([packet(), B], set()),
    ([packet(intent_scope="POI"), B], {"intent_identity"}),
    ([packet(intent_id="other"), B], {"intent_identity"}),
    ([packet(qrel_policy=None), B], {"qrel_policy"}),
    ([packet(namespace_scope=["cafe", "hotel"]), B], {"namespace_scope"}),
    ([packet(positive_poi_ids=["p2", "p1"]), B], {"pool_sorted_and_distinct", "pool_of_accepted_members"}),
    ([packet(positive_poi_ids=["p1", "p9"]), B], {"pool_of_accepted_members"}),
    ([packet(n_positive=3), B], {"pool_count"}),
    ([packet(positive_pool_sha256="0"), B], {"pool_hash"}),
    ([packet(verified_aliases=None), B], {"aliases_are_a_list"}),
    ([packet(alias_usage="free"), B], {"alias_usage"}),
    ([packet(packet_version="v0"), B], {"packet_version"}),
    ([packet(), packet(), B], {"one_row_a_group", "one_row_a_family_and_namespace"}),
    ([packet()], {"every_accepted_group"}),
    ([packet(), B, packet(("p1",), "brand:z")], {"pool_of_accepted_members", "pool_hash"}),
    ([packet(brand_group_id="brand:a:hotel", intent_id="brand:a:hotel"), packet(), B], {"group_identity", "pool_of_accepted_members", "pool_hash", "one_row_a_family_and_namespace"}),
])
def test_authoring_packets(spark, own, expected):
    got = validators.authoring_packets(packets_of(spark, own), members_of(spark, GOOD), {"packet_version": "v1"})
    assert {r for r, _ in rows(got)} == expected


QUERIES = "query_id string, intent_id string, intent_scope string, brand_family_id string, namespace_scope array<string>, qrel_policy string, canonical_brand_query string, query_text string, query_variant_family string, variant_operator string, severity string, language_tag string, review_status string, generator_version string"


def asked(n=1, v=1, text="A Coffee", operator="brand_canonical", family="brand:a", ns="cafe", **more):
    kind, severity = validators.OPERATORS.get(operator, ("X", "CLEAN"))
    row = {"query_id": f"brandq1-{n:05d}-v{v:02d}", "intent_id": f"{family}:{ns}", "intent_scope": "BRAND", "brand_family_id": family, "namespace_scope": [ns], "qrel_policy": "FAMILY_NAMESPACE", "canonical_brand_query": "A Coffee" if family == "brand:a" else "B Hotel", "query_text": text}
    return row | {"query_variant_family": kind, "variant_operator": operator, "severity": severity, "language_tag": "lang_vi", "review_status": "authored", "generator_version": "g1"} | more


BASE = [asked(1, 1), asked(1, 2, "a-coffee", "brand_case_punct"), asked(2, 1, "B Hotel", family="brand:b", ns="hotel"), asked(2, 2, "B Hotle", "brand_mechanical_typo", family="brand:b", ns="hotel")]
POOL = {"brand:a:cafe": ["p1", "p2"], "brand:b:hotel": ["p3", "p4"]}


def check_queries(spark, own, qrels=None, partial=False, **of_packet):
    names = [c.split(" ")[0] for c in QUERIES.split(", ")]
    if qrels is None:
        qrels = [(r["query_id"], p, "positive_pool", "q1") for r in {r["query_id"]: r for r in own}.values() for p in POOL.get(r["intent_id"], [])]
    queries = spark.createDataFrame([tuple(r[n] for n in names) for r in own], QUERIES)
    found = validators.brand_queries(queries, spark.createDataFrame(qrels, "query_id string, poi_id string, relation string, qrels_version string"), packets_of(spark, [packet(**of_packet), B]), "g1", "q1", partial)
    return {r for r, _ in rows(found)}


@pytest.mark.parametrize("planted,expected", [
    ([], set()),
    ([asked(1, 3, "x", query_id="q-3")], {"query_id_form"}),
    ([asked(1, 3, "x", intent_scope=None)], {"intent_scope"}),
    ([asked(1, 3, "x", qrel_policy="POI")], {"qrel_policy"}),
    ([asked(1, 3, "x", brand_family_id="brand:b")], {"family_of_packet"}),
    ([asked(1, 3, "x", namespace_scope=["hotel"])], {"scope_of_packet"}),
    ([asked(1, 3, "x", generator_version="g0")], {"generator_version"}),
    ([asked(1, 3, "x", review_status="odd")], {"review_status"}),
    ([asked(1, 3, "x", language_tag="vi")], {"language_tag"}),
    ([asked(1, 3, "  ")], {"text_is_known"}),
    ([asked(1, 3, "x", "brand_other")], {"known_operator"}),
    ([asked(1, 3, "x", "brand_phonetic", severity="CLEAN")], {"family_and_severity"}),
    ([asked(1, 3, "Other", "brand_alias")], {"verified_alias"}),
    ([asked(1, 3, "A Cafe", "brand_alias")], set()),
    ([asked(1, 3, "A Coffeee x", "brand_mechanical_typo")], {"one_slip"}),
    ([asked(1, 3, "B-Coffee", "brand_case_punct")], {"case_keeps_identity"}),
    ([asked(1, 3, "a cof fees", "brand_space_variant")], {"space_keeps_identity"}),
    ([asked(1, 3, "a cof fee", "brand_space_variant")], set()),
    ([asked(1, 3, "A COFFEE", "brand_phonetic")], {"distinct_texts"}),
    ([asked(1, 3, "b  hotel", "brand_phonetic")], {"text_of_one_intent"}),
    ([asked(1, 3, "x", "brand_phonetic", canonical_brand_query="Other")], {"one_canonical_text"}),
    ([asked(1, k, f"x{k}", "brand_phonetic") for k in range(3, 8)], {"two_to_six_rows"}),
    ([asked(1, 1, "x", "brand_phonetic")], {"one_row_a_query"}),
    ([asked(3, 1, "x", family="brand:z")], {"known_intent"}),
])
def test_brand_queries(spark, planted, expected):
    got = check_queries(spark, BASE + planted)
    canonical = {"one_canonical_row"} if any(r["variant_operator"] == "brand_canonical" and r["intent_id"] in POOL for r in planted) else set()
    assert got == expected | canonical


def test_brand_queries_and_qrels(spark):
    qrels = [(r["query_id"], p, "positive_pool", "q1") for r in BASE for p in POOL[r["intent_id"]]]
    assert check_queries(spark, BASE, qrels[1:]) == {"qrels_are_the_pool"}
    assert check_queries(spark, BASE, qrels + qrels[:1]) == {"one_row_a_qrel"}
    assert check_queries(spark, BASE, qrels + [("none", "p1", "positive_pool", "q1")]) == {"qrel_of_a_query"}
    assert check_queries(spark, BASE, [(*qrels[0][:2], "negative", "q0"), *qrels[1:]]) == {"relation", "qrels_version"}
    assert check_queries(spark, BASE[:2]) == {"every_intent"} and check_queries(spark, BASE[:2], partial=True) == set()
    assert check_queries(spark, BASE, requires_namespace_token=True) == set()
    assert check_queries(spark, [*BASE, asked(1, 3, "A", "brand_phonetic")], requires_namespace_token=True) == {"namespace_token"}


@pytest.mark.parametrize("change,expected", [
    ({}, []),
    ({"core": [("a", "A"), ("a", "A")]}, [("one_row_a_place", "a")]),
    ({"documents": [("a", "B", "B | x")]}, [("passage_begins_with_name", "a"), ("same_name", "a")]),
    ({"documents": []}, [("passage_begins_with_name", "a"), ("place_in_documents", "a"), ("same_name", "a")]),
    ({"access": [("a",), ("z",)]}, [("access_of_a_place", "z")]),
    ({"regions": [("z",)]}, [("regions_of_a_place", "z")]),
    ({"migration": [("a", "a", "keep", None), ("a", "a", "keep", None)]}, [("one_row_an_old_id", "a")]),
    ({"migration": [("a", "a", "drop_junk_or_foreign", None)]}, [("dropped_leads_nowhere", "a")]),
    ({"migration": [("q", None, "drop_junk_or_foreign", None), ("r", "a", "merge_duplicate", 49.0)]}, []),
    ({"migration": [("q", "z", "keep", None)]}, [("kept_leads_to_a_survivor", "q")]),
    ({"migration": [("q", "a", "merge_duplicate", None), ("r", "a", "merge_duplicate", 60.0)]}, [("merged_is_near", "q"), ("merged_is_near", "r")]),
    ({"expected": {"rows": 2, "keep": 1}}, [("counts_of_manifest", "rows")]),
    ({"expected": {"rows": 1, "keep": 1}}, []),
])
def test_clean_corpus(spark, change, expected):
    t = {"core": [("a", "A")], "documents": [("a", "A", "A | x")], "access": [("a",)], "regions": [("a",)], "migration": [("a", "a", "keep", None)], "expected": None} | change
    kinds = {"core": "poi_id string, name string", "documents": "poi_id string, name string, passage_context string", "access": "poi_id string", "regions": "poi_id string", "migration": "old_poi_id string, canonical_poi_id string, action string, distance_to_canonical_m double"}
    frames = {n: spark.createDataFrame(t[n], kind) for n, kind in kinds.items()}
    assert rows(validators.clean_corpus(*frames.values(), 50.0, t["expected"])) == expected
