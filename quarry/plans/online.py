"""Queries of streams, file sources, parsing functions and the whole search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import parsing
from quarry.functions import text as T
from quarry.plans import suggest
from quarry.plans.registry import query
from quarry.plans.views import ANCHORS_SQL, PLACES_SQL, anchors, haversine_sql, places, table
from quarry.sources import files
from quarry.sources.shared import scratch
from quarry.streaming import online as S


def stream(spark, d):
    return S.events(spark, f"{d}/events.parquet")


@query("A3_A4_csv_twin", f"with {PLACES_SQL} select poi_id, name, k % 2 = 0 as even, poi_id || '|p:0' as ids, false as bad from places")
def a3(spark, d):
    p = places(spark, d).select("poi_id", "name", (F.col("k") % 2 == 0).alias("even"), F.array(F.col("poi_id"), F.lit("p:0")).alias("ids"))
    folder = scratch(spark, "csv")
    files.write_csv(p, folder)
    rows, _ = files.read_csv(spark, folder, p.schema)
    return rows.select("poi_id", "name", "even", F.array_join("ids", "|").alias("ids"), F.col("_bad").alias("bad"))


@query(
    "A5_twin_parity",
    f"""with {PLACES_SQL} select poi_id, name, 'left' as side from places where k % 53 = 0 or k % 37 = 0
union all select poi_id, '  ' || upper(name), 'right' from places where k % 37 = 0 and k % 53 <> 0""",
)
def a5(spark, d):
    """A twin without some rows and with other names in some: the differences are those."""
    p, folder = places(spark, d).select("poi_id", "name", "k"), scratch(spark, "twin")
    changed = F.when(F.col("k") % 37 == 0, F.concat(F.lit("  "), F.upper("name"))).otherwise(F.col("name"))
    files.write_csv(p.filter("k % 53 <> 0").withColumn("name", changed), folder)
    rows, _ = files.read_csv(spark, folder, p.schema)
    return files.parity(p, rows.drop("_bad")).select("poi_id", "name", "side")


@query("A7_json_lines_round_trip", "select event_id, event_type, value, false as broken from events")
def a7(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    folder = scratch(spark, "jsonl")
    files.write_json_lines(e, folder)
    rows = files.read_json_lines(spark, folder, "event_id long, event_type string, value double")
    return rows.select("record.*", F.col("error").isNotNull().alias("broken"))


@query("A8_vector_store", "select vec_id, cast(len(embedding) as integer) as dim, round(list_sum(list_transform(embedding, lambda x: x::double)), 5) as total from embeddings")
def a8(spark, d):
    folder = scratch(spark, "vectors")
    files.write_vectors(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), folder)
    v = spark.read.parquet(folder)
    return v.select(F.col("id").alias("vec_id"), F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("A21_immutable_release", f"with {PLACES_SQL} select count(*) as n_rows, true as hashed from places")
def a21(spark, d):
    m = files.release(places(spark, d).select("poi_id", "name"), scratch(spark, "release"), "poi_id")
    return m.select("n_rows", (F.char_length("keys_sha256") == 64).alias("hashed"))


@query("N1_session_membership", "select event_id, user_id, case when user_id in (select user_id from events where event_type = 'signup') then 200 else 401 end as status from events")
def n1(spark, d):
    known = table(spark, d, "events").filter("event_type = 'signup'").select("user_id")
    return S.available(S.session_membership(stream(spark, d), known), "n1")


@query("N2_displayed_exposures", "select e.event_id as exposure_id, d.event_id as display_id from events e join events d on e.user_id = d.user_id and e.event_type = 'view' and d.event_type = 'click' and d.ts >= e.ts and d.ts <= e.ts + interval 15 minutes")
def n2(spark, d):
    pick = lambda t: stream(spark, d).filter(F.col("event_type") == t)
    return S.available(S.displayed_exposures(pick("view"), pick("click")), "n2")


@query("N4_select_idempotency", "with c as (select event_id, ts, concat(user_id, ':', event_id % 97) as key, event_id % 2 as payload from events where event_type = 'click') select event_id, case when payload = first_value(payload) over (partition by key order by ts, event_id) then 200::bigint else 409::bigint end as status from c")
def n4(spark, d):
    c = stream(spark, d).filter("event_type = 'click'").select("event_id", "ts", F.concat_ws(":", "user_id", F.col("event_id") % 97).alias("key"), (F.col("event_id") % 2).cast("string").alias("payload"))
    return S.available(S.select_status(c), "n4")


@query("N4_first_of_key", "select count(distinct event_id) as n from events")
def n4b(spark, d):
    return S.available(S.first_of_key(stream(spark, d), ["event_id"], "1 hour").select("event_id"), "n4b").agg(F.count("*").alias("n"))


@query("N6_late_gate", "select event_id, case when value > 45 then 'dropped' when value < 15 then 'rejected' else 'used' end as gate from events")
def n6(spark, d):
    e = stream(spark, d)
    shift = F.when(F.col("value") > 45, 121).when(F.col("value") < 15, -31).otherwise(0)
    now = F.timestamp_seconds(F.col("ts").cast("double") + shift)
    return S.available(S.gate_late(e.withColumn("now", now), "now").select("event_id", "gate"), "n6")


@query("N7_session_windows", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as sid from g) select user_id, count(distinct sid) as sessions, count(*) as events from s group by 1")
def n7(spark, d):
    w = S.available(S.session_windows(stream(spark, d), "6 hours"), "n7", "complete")
    return w.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("N7_tumbling_windows", "select event_type, count(distinct time_bucket(interval 1 hour, ts)) as windows, count(*) as n from events group by 1")
def n7b(spark, d):
    w = S.available(S.tumbling(stream(spark, d), "1 hour"), "n7b", "complete")
    return w.groupBy("event_type").agg(F.count("*").alias("windows"), F.sum("n").alias("n"))


@query("N8_latest_revision", "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by 1")
def n8(spark, d):
    return S.available(S.latest_revision(stream(spark, d), "event_id", "event_type"), "n8", "complete")


@query("G22_query_structure", f"with {PLACES_SQL} select poi_id, housenumber || ' ' || cast(k % 9 as varchar) as keys, true as house_street, false as medial from places")
def g22(spark, d):
    q = F.concat("housenumber", F.lit("/"), (F.col("k") % 9).cast("string"), F.lit(" "), "name")
    p = places(spark, d).select("poi_id", parsing.query_structure(q).alias("s"))
    return p.select("poi_id", F.array_join("s.keys", "|").alias("keys"), F.col("s.house_street"), F.col("s.medial_number").alias("medial"))


@query("G35_typo_classes", f"with {PLACES_SQL} select poi_id, case k % 3 when 0 then 'terminal_delete' when 1 then 'internal_delete' else 'substitute' end as kind from places")
def g35(spark, d):
    n = F.col("name")
    typo = F.when(F.col("k") % 3 == 0, F.expr("left(name, length(name) - 1)")).when(F.col("k") % 3 == 1, F.expr("substring(name, 2)")).otherwise(F.concat(F.lit("#"), F.expr("substring(name, 2)")))
    return places(spark, d).select("poi_id", parsing.slip(n, typo)["kind"].alias("kind"))


@query("K16_K17_phrase_evidence", f"with {PLACES_SQL} select poi_id, cast(case when name = 'red bolt' then 2 when split_part(name, ' ', 1) = 'red' or split_part(name, ' ', 2) = 'bolt' then 1 else 0 end as double) as hits from places")
def k16(spark, d):
    p = places(spark, d)
    e = parsing.match_evidence(F.lit("red bolt 7"), F.col("name"), F.col("street"), F.lit(""))
    return p.select("poi_id", e["span"].cast("double").alias("hits"))


@query("K13_candidate_dedup")
def k13(spark, d):
    w = Window.partitionBy("region_id").orderBy("k")
    c = places(spark, d).select(F.col("region_id").alias("query_id"), F.col("poi_id").alias("doc_id"), "name", "lat", "lon", F.lit(None).cast("string").alias("branch"), F.concat("brand", F.lit("/"), "street").alias("entity"), F.row_number().over(w).alias("rank")).filter("rank <= 100")
    return suggest.candidate_dedup(c)


@query("R6_suggest")
def r6(spark, d):
    return suggest.suggest(places(spark, d), asked(spark, d).select("query_id", "text", "lat", "lon"), top_k=10)


@query("R7_trace_stages")
def r7(spark, d):
    """The searches of R6 with each one's own place as its target."""
    q = asked(spark, d).select("query_id", "text", "lat", "lon", F.concat(F.lit("p:"), F.col("query_id").cast("string")).alias("target_poi_id"))
    return suggest.trace(places(spark, d), q)


@query("R5_origins", f"with {PLACES_SQL} select poi_id, cast(rank as integer) as rank from (select poi_id, row_number() over (order by poi_id) as rank from places where name = 'red bolt' and destination_searchable) where rank <= 50")
def r5(spark, d):
    p = places(spark, d).filter(F.col("destination_searchable") & (T.fold(F.col("name")) == "red bolt"))
    return p.select("poi_id").orderBy("poi_id").limit(50).withColumn("rank", F.row_number().over(Window.orderBy("poi_id")))


@query("R1_status", f"with {PLACES_SQL} select count(*) as n, count(*) > 0 as ready from places where destination_searchable")
def r1(spark, d):
    return suggest.status(places(spark, d).filter("destination_searchable"))


@query("K25_brand_context", f"with {PLACES_SQL} select brand, count(*) filter (where destination_searchable) as accepted, count(*) as members, count(distinct category) as groups from places group by 1")
def k25(spark, d):
    return places(spark, d).groupBy("brand").agg(F.count_if("destination_searchable").alias("accepted"), F.count("*").alias("members"), F.countDistinct("category").alias("groups"))


@query("K31_family_groups", f"with {PLACES_SQL}, g as (select brand, category, count(*) filter (where destination_searchable) as n from places group by 1, 2) select brand, string_agg(category || ':' || n, '|' order by n desc, category) as groups from g group by 1")
def k31(spark, d):
    g = places(spark, d).groupBy("brand", "category").agg(F.count_if("destination_searchable").alias("n"))
    entry = F.struct((-F.col("n")).alias("o"), "category", "n")
    return g.groupBy("brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.concat_ws(":", x["category"], x["n"])), "|").alias("groups"))


@query("S2_address_scope", f"with {PLACES_SQL}, c as (select street, region_id, count(*) as n from places group by 1, 2), s as (select street, count(*) as n from places group by 1) select poi_id, case when c.n > 1 then 'strict' when s.n > 1 then 'fallback' else 'broad' end as scope from places join c using (street, region_id) join s using (street)")
def s2(spark, d):
    p = places(spark, d)
    c = p.groupBy("street", "region_id").agg(F.count("*").alias("c_n"))
    s = p.groupBy("street").agg(F.count("*").alias("s_n"))
    scope = F.when(F.col("c_n") > 1, "strict").when(F.col("s_n") > 1, "fallback").otherwise("broad")
    return p.join(c, ["street", "region_id"]).join(s, "street").select("poi_id", scope.alias("scope"))


@query("S4_scope_lanes", f"with {PLACES_SQL}, l as (select street as query_id, poi_id as doc_id, case when region_id < 2 then 'protected' when region_id < 8 then 'scope' else 'reserve' end as lane, k as rank from places), r as (select *, row_number() over (partition by query_id, lane order by rank) as i from l) select query_id, doc_id, lane from r where i <= case lane when 'protected' then 5 when 'reserve' then 10 else 35 end")
def s4(spark, d):
    lane = F.when(F.col("region_id") < 2, "protected").when(F.col("region_id") < 8, "scope").otherwise("reserve")
    rows = places(spark, d).select(F.col("street").alias("query_id"), F.col("poi_id").alias("doc_id"), lane.alias("lane"), F.col("k").alias("rank"))
    return suggest.lane_quotas(rows, {"protected": 5, "reserve": 10, "scope": 35}).select("query_id", "doc_id", "lane")


#: Requests of every fiftieth customer: an address, a name or a brand in capitals.
ASKED_SQL = """asked as (select c_custkey as query_id, k, street, a.lat as a_lat, a.lon as a_lon, timestamp '2024-01-10 00:00:00' + to_hours(cast(c_custkey % 400 as integer)) as asked_at, cast(c_custkey / 50 as bigint) % 15 as user_id,
  case cast(c_custkey / 50 as bigint) % 3 when 0 then name || ' ' || housenumber || ' ' || street || ' shop' when 1 then name else upper(brand) end as text
  from customer join places on k = c_custkey join anchors a on anchor_id = c_custkey where c_custkey % 50 = 0)"""


def asked(spark, d):
    c = table(spark, d, "customer").filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("query_id"), F.floor(F.col("c_custkey") / 50).alias("n"))
    rows = c.join(places(spark, d).select(F.col("k").alias("query_id"), "name", "housenumber", "street", "brand").hint("merge"), "query_id").join(anchors(spark, d).withColumnRenamed("anchor_id", "query_id").hint("merge"), "query_id")
    text = F.when(F.col("n") % 3 == 0, F.concat_ws(" ", "name", "housenumber", "street", F.lit("shop"))).when(F.col("n") % 3 == 1, F.col("name")).otherwise(F.upper("brand"))
    at = F.timestamp_micros(F.lit(1_704_844_800_000_000) + (F.col("query_id") % 400) * 3_600_000_000)
    return rows.select("query_id", text.alias("text"), "lat", "lon", at.alias("asked_at"), (F.col("n") % 15).alias("user_id"), "street")


DIGITS_SQL = "array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: regexp_matches(t, '[0-9]')), ' ')"


@query(
    "S1_ranker_features",
    f"""with {PLACES_SQL}, {ANCHORS_SQL}, {ASKED_SQL},
c as (select * from (select query_id, text, a_lat, a_lon, asked_at, user_id, p.*, row_number() over (partition by query_id order by abs(p.k - query_id), poi_id) as rank from asked join places p using (street)) where rank <= 20),
h as (select query_id, 'p:' || (event_id % 200) as doc_id, ts, asked_at from events join asked using (user_id) where ts <= asked_at),
hp as (select h.*, brand, category from h join places on poi_id = doc_id),
n0 as (select query_id, count(*) as n_past from hp group by 1),
n1 as (select query_id, doc_id, count(*) as n_poi, max(ts) as last, count(*) filter (where least(abs(hour(ts) - hour(asked_at)), 24 - abs(hour(ts) - hour(asked_at))) <= 2) as n_hour from hp group by 1, 2),
n2 as (select query_id, brand, count(*) as n_brand from hp group by 1, 2), n3 as (select query_id, category, count(*) as n_category from hp group by 1, 2),
r as (select *, {DIGITS_SQL} as keys, regexp_extract_all(lower(text), '[a-z0-9]+') as toks, pi() * 2 * hour(asked_at) / 24 as hr, pi() * 2 * ((dayofweek(asked_at) + 6) % 7) / 7 as wd, {haversine_sql('a_lat', 'a_lon', 'lat', 'lon', 6371008.8)} as m
  from c left join n0 using (query_id) left join n1 on n1.query_id = c.query_id and n1.doc_id = c.poi_id left join n2 on n2.query_id = c.query_id and n2.brand = c.brand left join n3 on n3.query_id = c.query_id and n3.category = c.category),
s as (select *, contains(' ' || keys || ' ', ' ' || housenumber || ' ') as same from r)
select c_query as query_id, poi_id as doc_id, """
    + ", ".join(
        f"round(cast({x} as double), 6) as {n}"
        for n, x in {
            "stage1_rr": "1.0 / (1 + rank)", "lexical_rr": "case when k % 3 = 0 then 0 else 1.0 / (1 + rank) end", "lexical_missing": "k % 3 = 0", "dense_cosine": "case when k % 4 = 0 then 0 else 1.0 / (1 + rank) end", "dense_missing": "k % 4 = 0",
            "name_exact": "lower(text) = name or lower(text) = lower(brand)", "address_joint_match": "same and len(list_filter(string_split(street, ' '), lambda t: not list_contains(toks, t))) = 0",
            "ref_namespace_match": "k % 6 = 3 and list_contains(toks, housenumber) and contains(text, 'shop')", "explicit_mismatch": "keys <> '' and not same", "primary_scope_member": "region_id < 5",
            "from_global": "k % 5 = 0", "from_geo_rescue": "k % 5 = 1", "from_history_rescue": "k % 5 = 2", "log1p_distance_m": "ln(1 + m)", "origin_missing": "false", "history_missing": "n_past is null",
            "poi_frequency": "coalesce(n_poi / n_past, 0)", "brand_frequency": "coalesce(n_brand / n_past, 0)", "category_frequency": "coalesce(n_category / n_past, 0)", "log1p_recency_hours": "coalesce(ln(1 + epoch_us(asked_at - last) / 3.6e9), 0)", "recency_missing": "n_poi is null",
            "hour_sin": "sin(hr)", "hour_cos": "cos(hr)", "weekday_sin": "sin(wd)", "weekday_cos": "cos(wd)", "same_hour_affinity": "coalesce(n_hour / n_past, 0)", "query_char_count": "length(text)", "has_address_pattern": "keys <> ''", "has_code_pattern": "text like 'BRAND#%'",
        }.items()
    )
    + " from (select s.*, s.query_id as c_query from s)",
)
def s1(spark, d):
    a, k = asked(spark, d), F.col("k")
    p = places(spark, d)
    near = Window.partitionBy("query_id").orderBy(F.abs(k - F.col("query_id")), "poi_id")
    c = a.select("query_id", "street").join(p, "street").withColumn("rank", F.row_number().over(near)).filter("rank <= 20")
    lane = F.when(k % 5 == 0, "global").when(k % 5 == 1, "geo_rescue").when(k % 5 == 2, "history_rescue").otherwise("scope")
    c = c.select("query_id", F.col("poi_id").alias("doc_id"), "rank", F.when(k % 3 != 0, F.col("rank")).alias("lexical_rank"), F.when(k % 4 != 0, 1.0 / (1 + F.col("rank"))).alias("dense_cosine"), lane.alias("lane"), (F.col("region_id") < 5).alias("primary_scope"),
        "name", F.array("brand").alias("aliases"), "housenumber", "street", "brand", "category", F.when(k % 2 == 1, F.col("housenumber")).alias("ref"), F.when(k % 3 == 0, "retail").alias("namespace"), "lat", "lon")
    e = table(spark, d, "events").select("user_id", F.concat(F.lit("p:"), (F.col("event_id") % 200).cast("string")).alias("doc_id"), F.col("ts").cast("timestamp").alias("occurred_at"))
    history = e.join(a.select("query_id", "user_id"), "user_id").join(p.select(F.col("poi_id").alias("doc_id"), "brand", "category"), "doc_id").select("query_id", "doc_id", "brand", "category", "occurred_at")
    out = suggest.ranker_features(c, a.drop("user_id", "street"), history)
    return out.select("query_id", "doc_id", *[F.round(n, 6).alias(n) for n in suggest.FEATURES])
