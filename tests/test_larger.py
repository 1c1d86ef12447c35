"""Queries against their SQL on made tables that are larger or odder than the smallest test tables."""

import math
import random

import duckdb
import pytest

from quarry.functions import geo
from quarry.llm import topk
from quarry.operators import identity, lexical, retrieval
from quarry.plans import catalog, online, suggest


def same(spark, folder, name, **tables):
    """The query's rows, equal to those of its SQL over the tables (name=(rows, schema))."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(path)
        con.execute(f"create view {table} as select * from '{path}/*.parquet'")
    got = catalog.QUERIES[name](spark, str(folder))
    out = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in out.description]
    want = sorted(map(str, out.fetchall()))
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == want
    return want


def test_g19_letters_without_marks(spark, tmp_path):
    texts = ["Straße", "strasse", "É t", "ét", "A  b", "", None, "ﬁne", "ＡＢ", "Σας"]
    rows = same(spark, tmp_path, "G19_has_accents", documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert sum("True" in r for r in rows) == 3


def test_l17_batches_beyond_four_digits(spark, tmp_path):
    rows = same(spark, tmp_path, "L17_combined_batches", customer=([(i,) for i in range(1, 20_101)], "c_custkey long"))
    assert len(rows) == 10_050 + 6_700


@pytest.mark.parametrize("name", ["C8_grid_pairs", "C11_radius_join"])
def test_joins_of_growing_sides_are_not_broadcast(spark, tmp_path, name):
    spark.range(1, 200).selectExpr("id as p_partkey", "'red bolt' as p_name", "'b' as p_brand", "'t' as p_type", "cast(id % 50 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 50).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


@pytest.mark.parametrize("metres", [5.0, 100.0, 3e5, 9e6, 2.1e7])
def test_distance_join_decides_most_pairs_by_bounds(spark, metres):
    """F8: the pairs of the formula alone, near the circle, the poles and the date line, without sines for each candidate."""
    rnd = random.Random(11)
    at = [(21.0, 105.8), (21.0, 180.0), (-60.0, -179.9999), (89.9999, 10.0), (90.0, 0.0), (-90.0, 33.0)]
    points = [(min(90.0, max(-90.0, a + rnd.uniform(-s, s))), (b + rnd.uniform(-s, s) + 180) % 360 - 180) for a, b in at for s in (0.0, 1e-3, 2.0)]
    points += [(21.0 + k * math.degrees(100.0 / geo.CLEANING), 105.8) for k in (0.999999, 1.0, 1.000001)] + [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(15)]
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, lat double, lon double")
    right = left.toDF("id2", "lat2", "lon2")
    found = geo.near_pairs(left, right, metres)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("COS(" not in line for line in plan.splitlines() if "Join Inner" in line)
    d = geo.haversine(left.lat, left.lon, right.lat2, right.lon2, geo.CLEANING)
    want = left.crossJoin(right).withColumn("distance_m", d).filter(f"distance_m < {metres}").select("id", "id2", "distance_m")
    assert sorted(map(tuple, found.select("id", "id2", "distance_m").collect())) == sorted(map(tuple, want.collect()))


def test_clauses_of_equal_texts_are_made_once(spark):
    docs = lexical.prepare_docs(spark.createDataFrame([(f"d{i}", "red bolt", "street 1", "7") for i in range(5)], "doc_id string, name string, street string, housenumber string"))
    q = lexical.prepare_queries(spark.createDataFrame([(1, "red bolt"), (2, "red bolt"), (3, None), (4, "blue")], "query_id long, text string"))
    assert lexical.texts(q).count() == 3
    got = lexical.phrase_clauses(q, docs, lexical.Policy()).collect()
    assert sorted((r.query_id, r.doc_id) for r in got) == [(k, f"d{i}") for k in (1, 2) for i in range(5)]


def test_k4a_pairs_are_dealt_out_over_all_tasks(spark, tmp_path):
    """the rows of the SQL, in one join of texts' rows and queries, no task with more than a tenth of them."""
    names = ["red bolt", "red bolt", "small gear", "red bolts", "12/3 red bolt", "gear 70", "blue", None, ""]
    parts = [(i, names[i % len(names)], "Brand#1", "t", i % 50) for i in range(360)]
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    rows = same(spark, tmp_path, "K4a_exact_and_prefix", part=(parts, schema), customer=([(i,) for i in range(100)], "c_custkey long"))
    assert len(rows) == 20 * 40 * (2 + 3 + 1 + 1 + 1)  # exact and leading red bolt, small g, 12/3, gear 7
    got = catalog.QUERIES["K4a_exact_and_prefix"](spark, str(tmp_path))
    made = got.rdd.mapPartitions(lambda own: [sum(1 for _ in own)]).collect()
    assert sum(made) == len(rows) and max(made) <= len(rows) / 10


def test_null_and_empty_texts_have_their_own_rows(spark):
    docs = spark.createDataFrame([("a", None), ("b", "null"), ("c", "tnull")], "doc_id string, name string").selectExpr("*", "'s' as street", "'1' as housenumber")
    q = lexical.prepare_queries(spark.createDataFrame([(1, None), (2, ""), (3, "null"), (4, "tnull"), (None, "null")], "query_id long, text string"))
    got = lexical.exact_clauses(q, lexical.prepare_docs(docs), lexical.Policy()).collect()
    assert sorted((r.query_id or 0, r.doc_id) for r in got) == [(0, "b"), (1, "a"), (2, "a"), (3, "b"), (4, "c")]


def test_k12_rounds_of_growing_circles(spark):
    places = [("a%02d" % i, "red bolt", 21.0, 105.8) for i in range(40)] + [("b%d" % i, "red cog", 21.0 + i / 100, 105.8) for i in range(1, 9)]
    places = spark.createDataFrame(places, "doc_id string, name_fold string, lat double, lon double")
    anchors = spark.createDataFrame([(1, "red", 21.0, 105.8), (2, "red cog", 21.0, 105.8), (3, "blue", 21.0, 105.8)], "query_id long, q_fold string, lat double, lon double")
    got = sorted((r.query_id, r.rank, r.doc_id) for r in retrieval.nearby_rescue(anchors, places).collect())
    assert got == [(1, i + 1, "a%02d" % i) for i in range(15)] + [(2, i, f"b{i}") for i in range(1, 5)]


def test_similar_names_meet_and_others_do_not(spark):
    rows = [("p1", "cafe mai", "1", "le loi", 21.0, 105.8), ("p2", "Café Mai", "1", "le loi", 21.0001, 105.8), ("p3", "pho ba", "1", "le loi", 21.0, 105.8), ("p4", None, "1", "le loi", 21.0, 105.8), ("p5", "cafe mai", "1", "le loi", 21.1, 105.8)]
    places = spark.createDataFrame(rows, "poi_id string, name string, housenumber string, street string, lat double, lon double")
    assert [(r.id, r.id2) for r in identity.duplicate_pairs(places).collect()] == [("p1", "p2")]


def test_op6_copies_of_queries_are_not_broadcast(spark):
    vectors = spark.range(200).selectExpr("id as vec_id", "array(cast(id as float), cast(1 as float)) as embedding")
    found = topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))
    assert found.count() == 20
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_e11_greedy_keepers_without_a_table_of_pairs(spark, tmp_path, monkeypatch):
    """the sequential choice, where a keeper may come before the one that settled its neighbour."""
    n = 600
    spark.range(n).selectExpr("id as p_partkey", "'red bolt' as p_name", "'b' as p_brand", "'t' as p_type", "cast(id % 50 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    written = []
    monkeypatch.setattr(identity, "reliable", lambda df, cut=identity.reliable: written.append(cut(df)) or written[-1])
    got = {r.id: r.keeper for r in catalog.QUERIES["E11_greedy_keepers"](spark, str(tmp_path)).collect()}
    at = {k: (20.98 + (k * 7919) % 1009 / 5e4, 105.80 + (k * 104729) % 997 / 5e4) for k in range(n)}

    def near(a, b):
        (x, y), (u, v) = (tuple(map(math.radians, at[k])) for k in (a, b))
        h = math.sin((u - x) / 2) ** 2 + math.cos(x) * math.cos(u) * math.sin((v - y) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(math.sqrt(h)) < 50

    kept = []
    for k in range(n):
        if not any(near(k, j) for j in kept):
            kept.append(k)
    assert len(kept) < n
    assert got == {f"p:{k}": f"p:{next((j for j in kept if near(k, j)), k)}" for k in range(n)}
    assert max(df.count() for df in written) <= n  # nodes, never pairs


def test_near_keepers_of_odd_places(spark):
    rows = [("a", 3, 21.0, 180.0), ("b", 1, 21.0, -179.9999), ("c", 2, None, 105.0), ("d", 4, 21.0, 179.9997), ("e", 5, float("nan"), 0.0), ("f", 6, 90.0, 10.0), ("g", 0, 90.0, -120.0), ("h", 7, 21.0, 180.0)]
    got = identity.near_keepers(spark.createDataFrame(rows, "id string, priority long, lat double, lon double"), 50.0).collect()
    assert sorted(map(tuple, got)) == [("a", "b"), ("b", "b"), ("c", "c"), ("d", "b"), ("e", "e"), ("f", "g"), ("g", "g"), ("h", "b")]
    assert identity.near_keepers(spark.createDataFrame([], "id string, priority long, lat double, lon double"), 50.0).count() == 0


def test_search_scores_kinds_of_documents_as_each_document(spark):
    """the same rows as the sum of all clauses over every document, from fewer rows than there are documents."""
    rnd = random.Random(8)
    names, streets, numbers = ["red bolt", "Red Bolt", "red 12", "blue", None], ["street 7", "street 12", None], ["12", "7/3", "12/3", "", None]
    docs = [(f"d{k}", rnd.choice(names), rnd.choice(streets), rnd.choice(numbers), rnd.choice([None, [], ["bolt"]])) for k in range(700)]
    docs = spark.createDataFrame(docs, "doc_id string, name string, street string, housenumber string, aliases array<string>")
    asked = ["red bolt 12 street 7 shop", "12/3 red bolt", "red bolt", "RED BOLT", "bolt", "blue 7/3", "street 12", "bv red", "", None]
    queries = spark.createDataFrame(list(enumerate(asked + asked[:2])), "query_id long, text string")
    q, d, p = lexical.prepare_queries(queries), lexical.prepare_docs(docs), lexical.Policy()
    whole = lexical.rewrite_clauses(queries, d, p)
    for f in (lexical.exact_clauses, lexical.prefix_clauses, lexical.phrase_clauses, lexical.house_clauses, lexical.code_clauses, lexical.number_clauses, lexical.bm25_clauses):
        whole = whole.unionByName(f(q, d, p))
    scores = {}
    for r in whole.groupBy("query_id", "doc_id").agg({"score": "sum"}).collect():
        scores.setdefault(r[0], []).append((-r[2], r[1]))
    written = []
    found = lexical.search(docs, queries, cut=lambda df: written.append(lexical.retrieval.reliable(df)) or written[-1])
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.doc_id, r.score)
    assert set(got) == set(scores) >= set(range(8))
    for k, rows in scores.items():
        want = sorted((round(s, 5), i) for s, i in rows)[:50]
        assert [got[k][n][0] for n in sorted(got[k])] == [i for _, i in want], asked[k % 10]
        assert [got[k][n][1] for n in sorted(got[k])] == pytest.approx([-s for s, _ in want], abs=2e-5)
    assert len(written) > 3 and max(df.count() for df in written) < 700


def test_requests_do_not_broadcast_the_places(spark, tmp_path):
    """places that a few compressed columns yield pass no driver."""
    spark.range(1, 200).selectExpr("id as p_partkey", "'red bolt' as p_name", "'b' as p_brand", "'t' as p_type", "cast(id % 50 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 200).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    rows = online.asked(spark, str(tmp_path))
    assert rows.count() == 3
    assert "BroadcastExchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_trace_makes_evidence_once(spark):
    """the stages after the evidence read it, and the target's ranks meet in one table and not in a join a stage."""
    places = [(f"p{i}", "red bolt", f"street {i}", str(i), "b", 21.0 + i / 1e4, 105.8, True) for i in range(6)]
    places = spark.createDataFrame(places, "poi_id string, name string, street string, housenumber string, brand string, lat double, lon double, destination_searchable boolean")
    queries = spark.createDataFrame([(1, "red bolt", 21.0, 105.8, "p0"), (2, "red bolt", 21.0, 105.8, "zz"), (3, "red bolt", 21.0, 105.8, None)], "query_id long, text string, lat double, lon double, target_poi_id string")
    found = suggest.trace(places, queries)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "structure" not in plan
    assert plan.count("Join LeftOuter") <= 3
    got = {r.query_id: r for r in found.collect()}
    ranks = [f"{name}_rank" for name in suggest.TRACED if name != "dense"]
    assert all(got[1][r] for r in ranks) and got[1].dense_rank is None and got[1].failure_class is None
    assert not any(got[k][r] for k in (2, 3) for r in ranks)
    assert got[2].failure_class == "retrieval_miss" and got[3].failure_class is None


def test_bm25_clauses_read_the_fields_once(spark):
    """one index for all clauses, which a plan holds twice (frequencies and scores)."""
    docs = lexical.prepare_docs(spark.createDataFrame([("d1", "red bolt", "street 1", "7")], "doc_id string, name string, street string, housenumber string"))
    q = lexical.prepare_queries(spark.createDataFrame([(1, "red bolt")], "query_id long, text string"))
    found = lexical.bm25_clauses(q, docs, lexical.Policy())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("explode(toks") <= 2
    assert sorted(r.clause for r in found.collect()) == ["best_or", "cross_or", "prefix_field"]
