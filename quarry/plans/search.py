"""Queries of retrieval, fusion, ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import geo
from quarry.functions import text as T
from quarry.operators import identity, retrieval
from quarry.plans.registry import query
from quarry.plans.views import ANCHORS_SQL, PLACES_SQL, anchors, haversine_sql, places, table, tokens_sql
from quarry.sources.shared import scratch

DOCS_SQL = f"""tok as (select doc_id, {tokens_sql('text')} as toks from documents),
len_ as (select doc_id, len(toks) as dl from tok), stat as (select count(*) as n_docs, avg(dl) as avgdl from len_),
post as (select doc_id, term, count(*) as tf from (select doc_id, unnest(toks) as term from tok) group by 1, 2),
freq as (select term, count(*) as df from post group by 1),
qt as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({tokens_sql('text')}) as term from benchmark) group by 1, 2)"""
BM25_SQL = f"""{DOCS_SQL},
bm as (select query_id, doc_id, round(sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score, count(*) as n_terms
  from qt join post using (term) join freq using (term) join len_ using (doc_id) cross join stat group by 1, 2),
lexical as (select * from (select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank from bm) where rank <= 50)"""
DENSE_SQL = """dv as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
dense as (select * from (select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank
  from (select q.vec_id as query_id, c.vec_id as doc_id, round(list_dot_product(q.v, c.v), 6) as score from dv q join dv c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)) where rank <= 50)"""


#: Folders of the stored index of the documents, by application and tables.
_STORED: dict[tuple[str, str], str] = {}


def index(spark, d):
    """The documents' index, written at its first use in an application and opened by every query."""
    key = spark.sparkContext.applicationId, d
    if key not in _STORED:
        folder = scratch(spark, "index")
        retrieval.Index.of(table(spark, d, "documents"), "doc_id", "text").store(folder)
        _STORED[key] = folder
    return retrieval.Index.open(spark, _STORED[key])


def terms(spark, d):
    return retrieval.query_terms(table(spark, d, "benchmark"), "item_id", "text")


def lexical(spark, d, k=50):
    return retrieval.ranked(retrieval.bm25(index(spark, d), terms(spark, d)).drop("n_terms"), k)


def dense(spark, d, k=50):
    """Queries: vectors whose id is divisible by 50, against all others."""
    v = table(spark, d, "embeddings")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = retrieval.dense_top_k(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), q, k + 1)
    return retrieval.ranked(found.filter("query_id <> doc_id").drop("rank"), k)


@query("A9_index_build", f"with {DOCS_SQL} select (select count(*) from post) as postings, (select count(*) from freq) as terms, (select n_docs from stat) as docs, (select round(avgdl, 6) from stat) as avgdl")
def a9(spark, d):
    i = index(spark, d)
    return i.postings.agg(F.count("*").alias("postings")).crossJoin(i.frequencies.agg(F.count("*").alias("terms"))).crossJoin(i.stats.select(F.col("n_docs").alias("docs"), F.round("avgdl", 6).alias("avgdl")))


@query("D18_corpus_statistics", f"with {DOCS_SQL} select term, df, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1), 6) as idf from freq cross join stat")
def d18(spark, d):
    i = index(spark, d)
    return i.frequencies.crossJoin(F.broadcast(i.stats)).select("term", "df", F.round(retrieval.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@query("C14_postings_join", f"with {DOCS_SQL} select query_id, doc_id, count(*) as hits from qt join post using (term) group by 1, 2")
def c14(spark, d):
    return terms(spark, d).join(index(spark, d).hits(terms(spark, d)), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"))


@query("C15_and_postings", f"with {DOCS_SQL}, need as (select query_id, count(*) as n from qt group by 1) select query_id, doc_id from qt join post using (term) join need using (query_id) group by query_id, doc_id, n having count(*) = n")
def c15(spark, d):
    return retrieval.and_postings(terms(spark, d).select("query_id", "term"), index(spark, d).hits(terms(spark, d)))


@query("B5_minimum_should_match", f"with {DOCS_SQL}, need as (select query_id, greatest(1, floor(count(*) * 0.5)) as n from qt group by 1) select query_id, doc_id, count(*) as n_terms from qt join post using (term) join need using (query_id) group by query_id, doc_id, n having count(*) >= n")
def b5(spark, d):
    return retrieval.minimum_should_match(terms(spark, d).select("query_id", "term"), index(spark, d).hits(terms(spark, d)))


@query("K1_bm25_top_k", f"with {BM25_SQL} select query_id, doc_id, score, rank from lexical")
def k1(spark, d):
    return lexical(spark, d).select("query_id", "doc_id", "score", "rank")


FIELDS_SQL = f"""{PLACES_SQL}, q as (select min(p_partkey) as query_id, p_name as text from part group by p_name),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest(string_split(text, ' ')) as term from q) group by 1, 2),
post as (select 'name' as field, poi_id as doc_id, term, count(*) as tf from (select poi_id, unnest(string_split(name, ' ')) as term from places) group by 2, 3
  union all select 'street', poi_id, term, count(*) from (select poi_id, unnest(string_split(street, ' ')) as term from places) group by 2, 3),
dl as (select field, doc_id, sum(tf) as dl from post group by 1, 2), st as (select field, count(*) as n, avg(dl) as avgdl from dl group by 1), fr as (select field, term, count(*) as df from post group by 1, 2),
f as (select query_id, doc_id, field, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as s
  from qt join post using (term) join fr using (field, term) join dl using (field, doc_id) join st using (field) group by 1, 2, 3)"""


def field_queries(spark, d):
    """Every distinct name is a query, numbered by the first part that bears it."""
    return table(spark, d, "part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("query_id"))


def fields(spark, d):
    return retrieval.FieldIndex(places(spark, d), "poi_id", {"name": 8.0, "street": 3.0})


@query("K2_field_weighted_bm25", f"with {FIELDS_SQL} select query_id, doc_id, round(sum(s * case field when 'name' then 8 else 3 end), 6) as score from f group by 1, 2")
def k2(spark, d):
    return retrieval.field_bm25(fields(spark, d), retrieval.query_terms(field_queries(spark, d), "query_id", "text"))


@query("K3_boosts", f"with {FIELDS_SQL}, s as (select query_id, doc_id, round(sum(s * case field when 'name' then 8 else 3 end), 6) as score from f group by 1, 2) select query_id, doc_id, round(score + case when q.text = p.name then 25.0 else 0.0 end + case when q.text = p.name or q.text = split_part(p.name, ' ', 2) || ' ' || split_part(p.name, ' ', 1) then 8.0 else 0.0 end, 6) as score from s join q using (query_id) join places p on p.poi_id = doc_id")
def k3(spark, d):
    q = field_queries(spark, d).select("query_id", T.fold(F.col("text")).alias("q_name"), retrieval.simple_tokens(F.col("text")).alias("q_tokens"))
    docs = places(spark, d).select(F.col("poi_id").alias("doc_id"), T.fold(F.col("name")).alias("d_name"), retrieval.simple_tokens(F.col("name")).alias("d_tokens"))
    return retrieval.boosted(k2(spark, d), q, docs)


@query("K7_dense_exact", f"with {DENSE_SQL} select query_id, doc_id, score, rank from dense where rank <= 10")
def k7(spark, d):
    return dense(spark, d, 10).select("query_id", "doc_id", "score", "rank")


FUSED_SQL = f"""{DENSE_SQL}, second as (select query_id, doc_id, cast(row_number() over (partition by query_id order by abs(doc_id - query_id), doc_id) as integer) as rank from dense),
u as (select query_id, doc_id, rank from dense union all select query_id, doc_id, rank from second),
fused as (select query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) as rrf, min(rank) as best_rank from u where rank <= 50 group by 1, 2),
rrf as (select *, cast(row_number() over (partition by query_id order by rrf desc, best_rank, doc_id) as integer) as rank from fused)"""


def branches(spark, d):
    a = dense(spark, d)
    order = Window.partitionBy("query_id").orderBy(F.abs(F.col("doc_id") - F.col("query_id")), "doc_id")
    return a, a.withColumn("rank", F.row_number().over(order))


@query("K8_rrf", f"with {FUSED_SQL} select query_id, doc_id, rrf, best_rank, rank from rrf")
def k8(spark, d):
    return retrieval.reciprocal_rank_fusion(list(branches(spark, d)))


@query("K9_branch_evidence", f"with {FUSED_SQL} select query_id, doc_id, a.rank as lexical_rank, b.rank as dense_rank, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) as rrf from dense a full join (select * from second where rank <= 25) b using (query_id, doc_id)")
def k9(spark, d):
    a, b = branches(spark, d)
    return retrieval.branch_evidence(a, b.filter("rank <= 25"))


@query("K10_length_router", f"with {PLACES_SQL} select poi_id, cast(length(replace(street, ' ', '')) as integer) as compact_len, case when length(replace(street, ' ', '')) < 8 then 'lexical_only' else 'hybrid' end as route from places")
def k10(spark, d):
    return retrieval.route(places(spark, d).select("poi_id", "street"), "street", least=8).select("poi_id", "compact_len", "route")


@query("K11_degradation", "select event_id, case when k % 5 = 0 and k % 2 = 0 then 'lexical' when k % 2 = 0 and k % 3 = 0 then 'hybrid' when k % 2 = 0 then 'lexical' when k % 5 <> 0 and k % 3 = 0 then 'dense' end as served, case when k % 2 = 0 or (k % 5 <> 0 and k % 3 = 0) then 200 else 503 end as status from (select event_id, event_id as k from events)")
def k11(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "lexical_only").otherwise("hybrid").alias("route"), (F.col("event_id") % 2 == 0).alias("lexical_ok"), (F.col("event_id") % 3 == 0).alias("dense_ok"))
    return retrieval.degrade(e).select("event_id", "served", "status")


RESCUE_SQL = f"""{PLACES_SQL}, {ANCHORS_SQL}, aq as (select anchor_id as query_id, lat, lon, case anchor_id % 3 when 0 then 'red' when 1 then 'blue bolt' else 'small g' end as q from anchors),
rh as (select query_id, poi_id as doc_id, {haversine_sql('a.lat', 'a.lon', 'p.lat', 'p.lon', 6371008.8)} as m from aq a join places p on starts_with(p.name, a.q)),
rr as (select query_id, doc_id, round(m, 2) as distance_m, cast(row_number() over (partition by query_id order by m, doc_id) as integer) as rank from rh where m <= 5000)"""


def rescued(spark, d):
    form = F.col("anchor_id") % 3
    q = F.when(form == 0, "red").when(form == 1, "blue bolt").otherwise("small g")
    a = anchors(spark, d).select(F.col("anchor_id").alias("query_id"), "lat", "lon", q.alias("q_fold"))
    p = places(spark, d).select(F.col("poi_id").alias("doc_id"), T.fold(F.col("name")).alias("name_fold"), "lat", "lon")
    return retrieval.nearby_rescue(a, p)


@query("K12_nearby_rescue", f"with {RESCUE_SQL} select query_id, doc_id, distance_m, rank from rr where rank <= 15")
def k12(spark, d):
    return rescued(spark, d).withColumn("distance_m", F.round("distance_m", 2))


@query("K14_name_match_class", f"with {PLACES_SQL} select poi_id, case when name = 'red bolt' then 3 when starts_with(name, 'red bo') then 1 end as level from places where name <> 'red bolt' or true")
def k14(spark, d):
    from quarry.operators.ranking import name_level

    q = F.array(F.lit("red"), F.lit("bo"))
    exact = F.array(F.lit("red"), F.lit("bolt"))
    toks = T.text_tokens(F.col("name"))
    return places(spark, d).select("poi_id", F.greatest(name_level(exact, toks), name_level(q, toks)).alias("level"))


@query("K15_token_overlap", f"with {PLACES_SQL} select poi_id, round((case when split_part(name, ' ', 1) = 'red' or split_part(name, ' ', 2) = 'red' then 1.0 else 0.0 end + case when regexp_matches(name, '\\bbol') then 0.5 else 0.0 end) / 2, 6) as overlap from places")
def k15(spark, d):
    from quarry.operators.ranking import token_overlap

    return places(spark, d).select("poi_id", F.round(token_overlap(F.array(F.lit("red"), F.lit("bol")), T.text_tokens(F.concat_ws(" ", "name", "street"))), 6).alias("overlap"))


@query("K18_geo_blend", f"with {PLACES_SQL}, r as (select poi_id, row_number() over (partition by street order by k) as rank, {haversine_sql('20.99', '105.81', 'lat', 'lon', 6371008.8)} as m from places) select poi_id, round(0.65 * (0.65 * (1.0 / (60 + rank)) / (1.0 / 61)) + 0.35 * exp(-m / 5000), 6) as score from r")
def k18(spark, d):
    w = Window.partitionBy("street").orderBy("k")
    r = places(spark, d).select("poi_id", "lat", "lon", (1.0 / (60 + F.row_number().over(w))).alias("rrf"), F.lit(1.0 / 61).alias("best"))
    text = 0.65 * F.col("rrf") / F.col("best")
    m = geo.haversine(F.lit(20.99), F.lit(105.81), F.col("lat"), F.col("lon"))
    return r.select("poi_id", F.round(0.65 * text + 0.35 * F.exp(-m / 5000), 6).alias("score"))


COHORT_SQL = f"""{PLACES_SQL}, r as (select street as query_id, poi_id as doc_id, name, row_number() over (partition by street order by k) as rank, {haversine_sql('20.99', '105.81', 'lat', 'lon', 6371008.8)} as m from places),
h as (select *, rank <= 10 and 61.0 / (60 + rank) >= 0.5 and split_part(name, ' ', 1) = first_value(split_part(name, ' ', 1)) over (partition by query_id order by rank) as c from r),
n as (select *, row_number() over (partition by query_id, c order by rank) as slot, row_number() over (partition by query_id, c order by round(0.35 * exp(-m / 5000), 9) desc, rank) as turn from h)"""


@query("K19_geo_cohort", f"with {COHORT_SQL} select a.query_id, a.doc_id, cast(case when a.c then b.rank else a.rank end as integer) as rank from n a join n b on a.query_id = b.query_id and a.c = b.c and a.turn = b.slot where a.c union all select query_id, doc_id, cast(rank as integer) from n where not c")
def k19(spark, d):
    from quarry.operators.ranking import geo_cohort

    w = Window.partitionBy("street").orderBy("k")
    first = F.split("name", " ")[0]
    m = geo.haversine(F.lit(20.99), F.lit(105.81), F.col("lat"), F.col("lon"))
    r = places(spark, d).select(F.col("street").alias("query_id"), F.col("poi_id").alias("doc_id"), F.row_number().over(w).alias("rank"), first.alias("match_class"), m.alias("distance_m"))
    r = r.withColumn("rrf_ratio", 61.0 / (60 + F.col("rank")))
    return geo_cohort(r).select("query_id", "doc_id", "rank")


@query("K21_history_cohort", f"with {COHORT_SQL}, g as (select *, row_number() over (partition by query_id, rank <= 10 and c order by rank) as s2, row_number() over (partition by query_id, rank <= 10 and c order by case when cast(substr(doc_id, 3) as bigint) % 7 = 0 then 0 else 1 end, rank) as t2 from h) select a.query_id, a.doc_id, cast(b.rank as integer) as rank from g a join g b on a.query_id = b.query_id and a.c = b.c and a.t2 = b.s2 where a.c union all select query_id, doc_id, cast(rank as integer) from g where not c")
def k21(spark, d):
    from quarry.operators.ranking import history_cohort

    w = Window.partitionBy("street").orderBy("k")
    r = places(spark, d).select(F.col("street").alias("query_id"), F.col("poi_id").alias("doc_id"), F.row_number().over(w).alias("rank"), F.split("name", " ")[0].alias("cohort_key"), F.when(F.col("k") % 7 == 0, 0).alias("preferred_rank"))
    return history_cohort(r).select("query_id", "doc_id", "rank")


@query("K22_loss_class", "select event_id, case when event_id % 11 = 0 then 'retrieval_miss' when event_id % 7 = 0 then 'lost_at_dedup_or_cap' when event_id % 5 = 0 then 'lost_below_top_k' end as loss from events")
def k22(spark, d):
    from quarry.operators.ranking import loss_class

    k = F.col("event_id")
    stages = table(spark, d, "events").select("event_id", (k % 11 != 0).alias("retrieved"), (k % 11 != 0).alias("rescued"), ((k % 11 != 0) & (k % 7 != 0)).alias("deduped"))
    stages = stages.withColumns({c: F.col("deduped") for c in ("after_geo", "after_name_address", "after_match")}).withColumn("in_top", F.col("deduped") & (k % 5 != 0))
    return stages.select("event_id", loss_class().alias("loss"))


@query("K24_brand_lookup", f"""with {PLACES_SQL}, i as (select lower(brand) as key, 'g:' || lower(brand) as group_id, case when k % 3 = 0 then 'accepted' when k % 3 = 1 then 'review' else 'excluded' end as status from (select brand, min(k) as k from places group by 1)),
q as (select poi_id as query_id, lower(brand) as exact_key from places) select query_id, group_id, case status when 'accepted' then 100 when 'review' then 80 else 10 end as score, true as is_primary, false as ambiguous from q join i on exact_key = key""")
def k24(spark, d):
    p = places(spark, d)
    first = p.groupBy("brand").agg(F.min("k").alias("k"))
    status = F.when(F.col("k") % 3 == 0, "accepted").when(F.col("k") % 3 == 1, "review").otherwise("excluded")
    i = first.select(F.lower("brand").alias("key"), F.concat(F.lit("g:"), F.lower("brand")).alias("group_id"), status.alias("status"))
    q = p.select(F.col("poi_id").alias("query_id"), F.lower("brand").alias("exact_key"), F.lower("brand").alias("stripped_key"))
    return identity.lookup_scores(q, i)


@query("K26_group_ready_prefix", f"with {PLACES_SQL}, n as (select distinct brand || ' ' || name as t from places), p as (select t, i, substr(t, 1, i) as pre from (select t, unnest(range(2, length(t) + 1)) as i from n)), c as (select pre, count(*) as n from p group by 1) select t, cast(min(i) as integer) as ready from p join c using (pre) where c.n = 1 group by 1")
def k26(spark, d):
    n = places(spark, d).select(F.concat_ws(" ", "brand", "name").alias("t")).distinct()
    p = n.select("t", F.posexplode(T.edge_ngrams(F.col("t"), 200)).alias("i", "pre")).filter("i >= 1")
    alone = p.groupBy("pre").agg(F.count("*").alias("n")).filter("n = 1").select("pre")
    return p.join(alone, "pre", "left_semi").groupBy("t").agg((F.min("i") + 1).alias("ready"))


@query("K27_tiered_match", f"with {PLACES_SQL} select poi_id, case when name = 'red bolt' then 100 when starts_with(name, 'red') then 80 when contains(name, 'red') then 60 else 20 + 10 * (case when contains(name, 'bolt') then 1 else 0 end) end as score from places")
def k27(spark, d):
    n = F.col("name")
    hits = F.contains(n, F.lit("bolt")).cast("int")
    return places(spark, d).select("poi_id", F.when(n == "red bolt", 100).when(F.startswith(n, F.lit("red")), 80).when(F.contains(n, F.lit("red")), 60).otherwise(20 + 10 * hits).alias("score"))


@query("K28_map_clusters", f"with {PLACES_SQL} select cast(floor(lat / 0.004) as bigint) as r, cast(floor(lon / 0.004) as bigint) as c, count(*) as n, min(poi_id) as sample from places group by 1, 2")
def k28(spark, d):
    return places(spark, d).groupBy(geo.cell(F.col("lat"), 0.004).alias("r"), geo.cell(F.col("lon"), 0.004).alias("c")).agg(F.count("*").alias("n"), F.min("poi_id").alias("sample"))
