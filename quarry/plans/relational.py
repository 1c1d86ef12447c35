"""Queries of the scan, predicate, join, aggregate, window and set operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import geo
from quarry.functions import text as T
from quarry.operators import tables as R
from quarry.plans.registry import query
from quarry.plans.views import ANCHORS_SQL, PLACES_SQL, anchors, haversine_sql, places, table

MIGRATIONS_SQL = f"""{PLACES_SQL},
m2 as (select poi_id as old_poi_id, case when k % 23 = 0 then null when k % 17 = 0 and k > 0 then concat('p:', cast(k - 1 as varchar)) else poi_id end as canonical_poi_id,
  case when k % 23 = 0 then 'drop' when k % 17 = 0 and k > 0 then 'merge' else 'keep' end as action from places),
m3 as (select poi_id as old_poi_id, case when k % 29 = 0 then null when k % 19 = 0 and k > 0 then concat('p:', cast(k - 1 as varchar)) else poi_id end as canonical_poi_id,
  case when k % 29 = 0 then 'drop' when k % 19 = 0 and k > 0 then 'merge' else 'keep' end as action from places)"""


def migration(spark, sf_dir, drop: int, merge: int):
    k = F.col("k")
    dropped, merged = k % drop == 0, (k % merge == 0) & (k > 0)
    to = F.when(dropped, None).when(merged, F.concat(F.lit("p:"), (k - 1).cast("string"))).otherwise(F.col("poi_id"))
    action = F.when(dropped, "drop").when(merged, "merge").otherwise("keep")
    return places(spark, sf_dir).select(F.col("poi_id").alias("old_poi_id"), to.alias("canonical_poi_id"), action.alias("action"))


@query("A1_scan_projection", "select l_orderkey, l_extendedprice from lineitem where l_shipdate < timestamp '1996-01-01' and l_quantity > 45")
def a1(spark, d):
    return table(spark, d, "lineitem").filter((F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") > 45)).select("l_orderkey", "l_extendedprice")


@query("A6_json_lines", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def a6(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("A10_multi_get", f"with {PLACES_SQL}, ids as (select custkey, rank, concat('p:', cast((custkey * 31 + rank * 7) % 2500 as varchar)) as poi_id from (select c_custkey as custkey from customer), (select unnest(range(1, 6)) as rank)) select custkey, cast(rank as integer) as rank, poi_id, name from ids join places using (poi_id)")
def a10(spark, d):
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank"))
    ids = ids.withColumn("poi_id", F.concat(F.lit("p:"), ((F.col("custkey") * 31 + F.col("rank") * 7) % 2500).cast("string")))
    return ids.join(places(spark, d).select("poi_id", "name"), "poi_id").select("custkey", "rank", "poi_id", "name")


@query("A11_backfill_codes", f"with {PLACES_SQL} select poi_id, replace(name, ' ', '') || housenumber as code from places")
def a11(spark, d):
    return places(spark, d).select("poi_id", T.alnum_compact(F.concat("name", F.lit(" "), "housenumber")).alias("code"))


@query("A12_keyset_page", "select o_orderkey, o_custkey from orders where o_orderkey > 1000 order by o_orderkey limit 10000")
def a12(spark, d):
    return table(spark, d, "orders").filter("o_orderkey > 1000").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(10_000)


@query("A13_geojson_features", f"""with {PLACES_SQL} select poi_id, '{{"type":"Feature","id":"' || poi_id || '","name":"' || name || '"}}' as feature, round(lon, 6) as lon, round(lat, 6) as lat from places where lat is not null and lon is not null""")
def a13(spark, d):
    p = places(spark, d).filter("lat is not null and lon is not null")
    return p.select("poi_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("poi_id").alias("id"), "name")).alias("feature"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("A16_strip_controls", "select doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') as clean from documents")
def a16(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "").alias("clean"))


@query("A18_merge_duplicate_keys", "select o_custkey as key, count(*) as n from (select o_custkey from orders union all select c_custkey from customer) group by 1 having count(*) > 1")
def a18(spark, d):
    parts = [table(spark, d, "orders").select(F.col("o_custkey").alias("key")), table(spark, d, "customer").select(F.col("c_custkey").alias("key"))]
    return R.merge_unique(parts, "key")[1]


@query("A19_upsert", "select c_custkey, case when c_custkey % 3 = 0 then 'patched' else c_mktsegment end as c_mktsegment from customer")
def a19(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return R.upsert(base, base.filter("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("patched")), "c_custkey")


@query("A20_pool_hash", f"with {PLACES_SQL} select brand, sha256(string_agg(distinct poi_id, chr(10) order by poi_id) || chr(10)) as pool_sha256 from places group by brand")
def a20(spark, d):
    return places(spark, d).groupBy("brand").agg(R.pool_hash(F.col("poi_id")).alias("pool_sha256"))


@query("A22_vector_reuse", "select vec_id, case when label % 3 = 0 then 'encode' else 'reuse' end as how from embeddings")
def a22(spark, d):
    new = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("passage "), F.col("label").cast("string")).alias("passage"))
    old = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") % 3 != 0, F.concat(F.lit("passage "), F.col("label").cast("string"))).alias("old_passage"))
    return new.join(old, "vec_id", "left").select("vec_id", F.when(F.col("passage").eqNullSafe(F.col("old_passage")), "reuse").otherwise("encode").alias("how"))


@query("B1_searchable_filter", f"with {PLACES_SQL} select poi_id, name from places where destination_searchable")
def b1(spark, d):
    return places(spark, d).filter("destination_searchable").select("poi_id", "name")


@query("B2_bbox_range", f"with {PLACES_SQL} select poi_id from places where lat between 20.985 - 500 / 111195.0 and 20.985 + 500 / 111195.0 and lon between 105.805 - 500 / (111195.0 * greatest(0.2, abs(cos(radians(20.985))))) and 105.805 + 500 / (111195.0 * greatest(0.2, abs(cos(radians(20.985)))))")
def b2(spark, d):
    lat, lon = F.lit(20.985), F.lit(105.805)
    dlat, dlon = geo.bbox(lat, lon, 500.0)
    return places(spark, d).filter(F.col("lat").between(lat - dlat, lat + dlat) & F.col("lon").between(lon - dlon, lon + dlon)).select("poi_id")


@query("B3_exact_or_prefix", f"with {PLACES_SQL} select poi_id, name = 'red bolt' as exact, starts_with(name, 'red') as prefix from places where name = 'red bolt' or starts_with(name, 'red')")
def b3(spark, d):
    name = T.fold(F.col("name"))
    return places(spark, d).select("poi_id", (name == "red bolt").alias("exact"), F.startswith(name, F.lit("red")).alias("prefix")).filter("exact or prefix")


@query("B4_codes_in_list", f"with {PLACES_SQL} select poi_id, housenumber from places where housenumber in ('7', '11', '28', '42')")
def b4(spark, d):
    codes = spark.createDataFrame([("7",), ("11",), ("28",), ("42",)], "housenumber string")
    return places(spark, d).select("poi_id", "housenumber").join(codes, "housenumber", "left_semi").select("poi_id", "housenumber")


@query("B6_junk_reason", """with n as (select doc_id, substr(text, 1, 40) as name, lang from documents)
select doc_id, case when lang = 'es' then 'outside_admin_vn' when regexp_matches(name, '^(Unknown|no name)$', 'i') then 'generic_no_name' end as reason from n""")
def b6(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("name"), F.when(F.col("lang") != "es", F.col("lang")).alias("province"))
    return docs.select("doc_id", T.junk_reason(F.col("name"), F.col("province")).alias("reason"))


@query("B7_single_character", "select doc_id, length(regexp_replace(text, '\\s', '', 'g')) = 1 as single from documents")
def b7(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.char_length(F.regexp_replace("text", r"\s", "")) == 1).alias("single"))


@query("B8_usable_address", f"with {PLACES_SQL}, a as (select poi_id, housenumber || ' ' || street as address from places) select poi_id, case when length(regexp_replace(address, '[^0-9A-Za-z]', '', 'g')) >= 3 and regexp_matches(address, '[A-Za-z]') then address end as address from a")
def b8(spark, d):
    a = F.concat_ws(" ", "housenumber", "street")
    ok = (F.char_length(F.regexp_replace(a, r"[^\p{L}\p{N}]", "")) >= 3) & a.rlike(r"\p{L}")
    return places(spark, d).select("poi_id", F.when(ok, a).alias("address"))


@query("B9_name_is_address", f"with {PLACES_SQL} select poi_id, (category = 'PROMO' or name = housenumber || ' ' || street) as name_is_address from places")
def b9(spark, d):
    return places(spark, d).select("poi_id", ((F.col("category") == "PROMO") | (T.fold(F.col("name")) == T.fold(F.concat_ws(" ", "housenumber", "street")))).alias("name_is_address"))


@query("B10_filtered_aggregates", f"with {PLACES_SQL} select category, count(*) filter (where name ilike '%BOLT%') as bolts, count(*) filter (where regexp_matches(name, '^(red|blue) ')) as colours, count(*) filter (where starts_with(brand, 'Brand#1')) as ones, count(*) as n from places group by category")
def b10(spark, d):
    name = F.col("name")
    return places(spark, d).groupBy("category").agg(F.count_if(name.ilike("%BOLT%")).alias("bolts"), F.count_if(name.rlike("^(red|blue) ")).alias("colours"), F.count_if(F.startswith("brand", F.lit("Brand#1"))).alias("ones"), F.count("*").alias("n"))


#: Queries about a brand: its words and others, by the place's number.
BRAND_QUERY_SQL = """brands as (select poi_id, k, lower(brand) as brand, case when k % 3 = 0 then 'cafe' when k % 3 = 1 then 'hotel' else 'none' end as ns,
  case k % 8 when 0 then brand when 1 then 'Cafe ' || brand when 2 then brand || ' hotel khách' when 3 then brand || ' ' || name when 4 then brand || ' ' || lower(brand) || '  COFFEE' when 5 then name when 6 then 'khách sạn ' || brand else brand || ' cafe cafe cafe' end as q from places)"""
NAMESPACES_SQL = "words(ns, word) as (values " + ", ".join(f"('{ns}', '{w}')" for ns, own in T.NAMESPACE_TOKENS.items() for w in own) + ")"


def brand_queries(spark, d):
    k, b, n = F.col("k") % 8, F.col("brand"), F.col("name")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    q = F.when(k == 0, b).when(k == 1, text("Cafe ", b)).when(k == 2, text(b, " hotel khách")).when(k == 3, text(b, " ", n)).when(k == 4, text(b, " ", F.lower(b), "  COFFEE"))
    q = q.when(k == 5, n).when(k == 6, text("khách sạn ", b)).otherwise(text(b, " cafe cafe cafe"))
    ns = F.when(F.col("k") % 3 == 0, "cafe").when(F.col("k") % 3 == 1, "hotel").otherwise("none")
    return places(spark, d).select("poi_id", "brand", q.alias("q"), ns.alias("ns"))


@query(
    "B11_bare_brand",
    f"""with {PLACES_SQL}, {BRAND_QUERY_SQL}, {NAMESPACES_SQL},
t as (select *, string_split(regexp_replace(lower(q), '\\s+', ' ', 'g'), ' ') as toks, string_split(brand, ' ') as own, list_distinct(coalesce((select list(word) || list(strip_accents(word)) from words where words.ns = brands.ns), [])) as allowed from brands)
select poi_id, array_to_string(toks, ' ') = brand or (contains(array_to_string(toks, ' '), brand) and len(toks) <= len(own) + 2
       and len(list_filter(toks, lambda x: not list_contains(own, x) and not list_contains(allowed, x) and not list_contains(allowed, strip_accents(x)))) = 0) as bare from t""",
)
def b11(spark, d):
    return brand_queries(spark, d).select("poi_id", T.is_bare_brand(F.col("q"), F.col("brand"), F.col("ns")).alias("bare"))


@query(
    "B12_namespace_token",
    f"""with {PLACES_SQL}, {BRAND_QUERY_SQL}, {NAMESPACES_SQL}
select poi_id, exists(select 1 from words where words.ns = brands.ns and (contains(lower(q), word) or contains(strip_accents(lower(q)), strip_accents(word)))) as has_token from brands""",
)
def b12(spark, d):
    return brand_queries(spark, d).select("poi_id", T.has_namespace_token(F.col("q"), F.col("ns")).alias("has_token"))


@query("B13_exclusion_list", "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'MACHINERY')")
def b13(spark, d):
    out = table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(out, "o_custkey", "left_anti").select("o_orderkey")


@query("C1_left_join", "select o_orderkey, c_name from orders left join customer on o_custkey = c_custkey")
def c1(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("C2_enrich_with_misses", f"with {PLACES_SQL} select l_orderkey, l_linenumber, name, name is null as missing from lineitem left join places on k = l_partkey + 5")
def c2(spark, d):
    left = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") + 5).alias("k"))
    return R.require_all(left, places(spark, d).select("k", "name"), "k").select("l_orderkey", "l_linenumber", "name", "missing")


@query("C3_join_using_case_order", f"with {PLACES_SQL}, g as (select brand, count(*) as n from places group by brand) select poi_id, brand, n, case category when 'PROMO' then 0 when 'ECONOMY' then 1 else 2 end as ord from places join g using (brand)")
def c3(spark, d):
    p = places(spark, d)
    g = p.groupBy("brand").agg(F.count("*").alias("n"))
    ord_ = F.when(F.col("category") == "PROMO", 0).when(F.col("category") == "ECONOMY", 1).otherwise(2)
    return p.join(g, "brand").select("poi_id", "brand", "n", ord_.alias("ord"))


@query("C5_migration_remap", f"with {MIGRATIONS_SQL}, corpus as (select poi_id from places where k % 17 <> 0 and k % 23 <> 0) select p.poi_id, case when c.poi_id is not null then 'keep' when t.poi_id is not null then 'merged' else 'unresolved' end as status, coalesce(c.poi_id, t.poi_id) as new_id from places p left join corpus c on c.poi_id = p.poi_id left join m2 on m2.old_poi_id = p.poi_id left join corpus t on t.poi_id = m2.canonical_poi_id")
def c5(spark, d):
    p = places(spark, d)
    corpus = p.filter("k % 17 <> 0 and k % 23 <> 0").select("poi_id")
    return R.remap(p.select("poi_id"), corpus, migration(spark, d, 23, 17), "poi_id").select("poi_id", "status", "new_id")


@query("C6_composed_migration", f"with {MIGRATIONS_SQL} select m2.old_poi_id, case when m2.action = 'drop' or coalesce(m3.action, 'drop') = 'drop' then 'drop' when m2.action = 'merge' or m3.action = 'merge' then 'merge' else 'keep' end as action, case when m2.action = 'drop' or coalesce(m3.action, 'drop') = 'drop' then null else m3.canonical_poi_id end as canonical_poi_id from m2 left join m3 on m3.old_poi_id = m2.canonical_poi_id")
def c6(spark, d):
    return R.compose_migrations(migration(spark, d, 23, 17), migration(spark, d, 29, 19))


@query("C7_array_remap", f"with {MIGRATIONS_SQL}, r as (select c_custkey as key, concat('p:', cast(c_custkey % 50 as varchar)) as intended, list_transform(range(0, 6), lambda i: concat('p:', cast((c_custkey % 40) + 17 * i as varchar))) as ids from customer), e as (select key, unnest(ids) as id, unnest(range(0, 6)) as p from r union all select key, intended, -1 from r), m as (select key, canonical_poi_id as id, min(p) as p from e join m2 on m2.old_poi_id = e.id where canonical_poi_id is not null group by 1, 2) select key, string_agg(id, '|' order by p) as ids from m group by key")
def c7(spark, d):
    r = table(spark, d, "customer").select(
        F.col("c_custkey").alias("key"),
        F.concat(F.lit("p:"), (F.col("c_custkey") % 50).cast("string")).alias("intended"),
        F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("p:"), (F.col("c_custkey") % 40 + 17 * i).cast("string"))).alias("ids"),
    )
    return R.remap_arrays(r, "ids", "key", "intended", migration(spark, d, 23, 17)).select("key", F.array_join("ids", "|").alias("ids"))


@query("C8_grid_pairs", f"with {PLACES_SQL}, c as (select *, cast(floor(lat / 0.001) as bigint) as r, cast(floor(lon / 0.001) as bigint) as q from places), s as (select i, j from (select unnest([-1, 0, 1]) as i), (select unnest([-1, 0, 1]) as j)), p as (select a.poi_id as id, b.poi_id as id2, {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} as m from c a cross join s join c b on b.r = a.r + s.i and b.q = a.q + s.j where a.poi_id < b.poi_id) select id, id2, round(m, 2) as distance_m from p where m < 50")
def c8(spark, d):
    own = places(spark, d).select(F.col("poi_id").alias("id"), "lat", "lon")
    other = own.select(F.col("id").alias("id2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return geo.near_pairs(own, other, 50.0).filter("id < id2").select("id", "id2", F.round("distance_m", 2).alias("distance_m"))


@query("C9_same_key_proximity", f"with {PLACES_SQL} select a.poi_id as id, b.poi_id as id2 from places a join places b on a.name = b.name and a.street = b.street and a.poi_id < b.poi_id where {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} < 600")
def c9(spark, d):
    own = places(spark, d).select(F.col("poi_id").alias("id"), T.fold(F.col("name")).alias("name_fold"), "street", "lat", "lon")
    other = own.select(F.col("id").alias("id2"), "name_fold", "street", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    m = geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"), geo.CLEANING)
    return own.join(other, ["name_fold", "street"]).filter((F.col("id") < F.col("id2")) & (m < 600)).select("id", "id2")


@query("C10_nearest_same_name", f"with {PLACES_SQL}, p as (select a.poi_id as id, b.poi_id as id2, round({haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 2) as distance_m from places a join places b on a.name = b.name and a.street = b.street and a.poi_id <> b.poi_id), r as (select *, cast(row_number() over (partition by id order by distance_m nulls last, id2) as integer) as rank from p) select id, id2, distance_m, rank from r where rank <= 8")
def c10(spark, d):
    own = places(spark, d).select(F.col("poi_id").alias("id"), "name", "street", "lat", "lon")
    other = own.select(F.col("id").alias("id2"), "name", "street", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    m = F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"), geo.CLEANING), 2)
    rows = own.join(other, ["name", "street"]).filter("id <> id2").select("id", "id2", m.alias("distance_m"))
    order = Window.partitionBy("id").orderBy(F.asc_nulls_last("distance_m"), "id2")
    return rows.withColumn("rank", F.row_number().over(order)).filter("rank <= 8")


@query("C11_radius_join", f"with {PLACES_SQL}, {ANCHORS_SQL} select anchor_id, poi_id, round({haversine_sql('a.lat', 'a.lon', 'p.lat', 'p.lon', 6371008.8)}, 2) as distance_m from anchors a, places p where {haversine_sql('a.lat', 'a.lon', 'p.lat', 'p.lon', 6371008.8)} < 100")
def c11(spark, d):
    left = anchors(spark, d)
    right = places(spark, d).select("poi_id", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return geo.near_pairs(left, right, 100.0, size=0.001, radius=geo.SERVING).select("anchor_id", "poi_id", geo.hundredths(F.col("distance_m")).alias("distance_m"))


@query("C12_semi_anti", "select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as has_orders from customer")
def c12(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))


@query("C16_as_of_history", """with h as (select user_id, 'p:' || cast(event_id % 2000 as varchar) as poi_id, ts from events where event_type = 'purchase'), r as (select event_id as request_id, user_id, ts as cutoff from events where event_type = 'view'), l as (select request_id, poi_id, max(h.ts) as ts from r join h using (user_id) where h.ts <= cutoff group by 1, 2), n as (select *, cast(row_number() over (partition by request_id order by ts desc, poi_id) as integer) as rank from l) select request_id, poi_id, rank from n where rank <= 20""")
def c16(spark, d):
    e = table(spark, d, "events")
    history = e.filter("event_type = 'purchase'").select("user_id", F.concat(F.lit("p:"), (F.col("event_id") % 2000).cast("string")).alias("poi_id"), "ts")
    requests = e.filter("event_type = 'view'").select(F.col("event_id").alias("request_id"), "user_id", F.col("ts").alias("cutoff"))
    return R.as_of_history(history, requests, 20).select("request_id", "poi_id", "rank")


@query("C17_polygon_containment", f"with {PLACES_SQL} select poi_id, lat + lon <= 126.795 and lat >= 20.98 and lon >= 105.80 as inside from places where abs(lat + lon - 126.795) > 1e-6 and lat > 20.98001 and lon > 105.80001")
def c17(spark, d):
    corner = lambda a, b: F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon"))
    ring = F.array(corner(20.98, 105.80), corner(20.995, 105.80), corner(20.98, 105.815))
    p = places(spark, d).filter("abs(lat + lon - 126.795) > 1e-6 and lat > 20.98001 and lon > 105.80001")
    return p.select("poi_id", geo.covers(F.col("lat"), F.col("lon"), ring).alias("inside"))


@query("C18_sibling_groups", f"with {PLACES_SQL}, g as (select distinct brand, category from places) select a.brand, a.category, b.category as sibling from g a join g b on a.brand = b.brand and a.category <> b.category")
def c18(spark, d):
    g = places(spark, d).select("brand", "category").distinct()
    return g.join(g.withColumnRenamed("category", "sibling"), "brand").filter("category <> sibling").select("brand", "category", "sibling")


@query("D1_value_counts", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2")
def d1(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("D2_conditional_counts", "select o_custkey, count(*) filter (where o_orderstatus = 'F') as n_f, count(*) filter (where o_orderstatus = 'O') as n_o, sum(case when o_orderstatus = 'P' then 1 else 0 end)::bigint as n_p from orders group by 1")
def d2(spark, d):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, d, "orders").groupBy("o_custkey").agg(n("F").alias("n_f"), n("O").alias("n_o"), n("P").alias("n_p"))


@query("D3_distinct_counts", "select l_suppkey, count(distinct l_partkey) as parts, count(distinct l_returnflag) as flags from lineitem group by 1")
def d3(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_returnflag").alias("flags"))


@query("D4_named_aggregates_top", f"with {PLACES_SQL} select name, count(*) as n, sum(case when destination_searchable then 1 else 0 end)::bigint as searchable, string_agg(distinct brand, '|' order by brand) as brands from places group by name order by n desc, name limit 50")
def d4(spark, d):
    g = places(spark, d).groupBy("name").agg(F.count("*").alias("n"), F.count_if("destination_searchable").alias("searchable"), F.array_join(F.array_sort(F.collect_set("brand")), "|").alias("brands"))
    return g.orderBy(F.desc("n"), "name").limit(50)


@query("D5_mode_tie_break", f"with {PLACES_SQL}, c as (select brand, name, count(*) as n from places group by 1, 2), r as (select *, row_number() over (partition by brand order by n desc, lower(name), name) as r from c) select brand, name, n from r where r = 1")
def d5(spark, d):
    return R.mode_of(places(spark, d), "brand", "name", T.normalized(F.col("name")))


@query("D6_count_map_json", f"with {PLACES_SQL}, c as (select brand, category, count(*) as n from places group by 1, 2) select brand, '{{' || string_agg('\"' || category || '\":' || n, ',' order by category) || '}}' as counts from c group by brand")
def d6(spark, d):
    return R.count_map(places(spark, d), "brand", "category")


@query("D7_quantifiers", "select o_custkey, bool_and(o_totalprice > 1000) as all_large, bool_or(o_orderpriority = '1-URGENT') as any_urgent from orders group by 1")
def d7(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_totalprice") > 1000).alias("all_large"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"))


@query("D8_inverse_index", f"with {PLACES_SQL} select street, string_agg(distinct poi_id, '|' order by poi_id) as ids from places group by 1")
def d8(spark, d):
    return places(spark, d).groupBy("street").agg(F.array_join(F.array_sort(F.collect_set("poi_id")), "|").alias("ids"))


@query("D9_exact_quantiles", "select l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.9), 4) as p90, round(quantile_cont(l_extendedprice, 0.95), 4) as p95, round(quantile_cont(l_extendedprice, 0.99), 4) as p99 from lineitem group by 1")
def d9(spark, d):
    q = F.percentile("l_extendedprice", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95), F.lit(0.99)))
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(q.alias("q"))
    return g.select("l_returnflag", *[F.round(F.get("q", F.lit(i)), 4).alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))])


@query("D10_nearest_rank", "with r as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events) select event_type, max(case when r = greatest(1, ceil(0.5 * n)) then value end) as p50, max(case when r = greatest(1, ceil(0.95 * n)) then value end) as p95 from r group by 1")
def d10(spark, d):
    return R.nearest_rank(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("D11_approx_quantile", "select event_type, count(*) filter (where value < q) as below, count(*) filter (where value = q) as equal, count(*) as n from events join (select event_type, quantile_disc(value, 0.5) as q from events group by 1) using (event_type) group by 1")
def d11(spark, d):
    """The approximate median, by how many values are below it and at it: exact while a group has fewer values than the
    accuracy, else off by n / accuracy places at most."""
    e = table(spark, d, "events")
    q = e.groupBy("event_type").agg(F.percentile_approx("value", 0.5, 1_000_000).alias("q"))
    return e.join(F.broadcast(q), "event_type").groupBy("event_type").agg(F.count_if(F.col("value") < F.col("q")).alias("below"), F.count_if(F.col("value") == F.col("q")).alias("equal"), F.count("*").alias("n"))


@query("D12_mean_of_means", "select round(avg(m), 6) as mean_of_means from (select o_custkey, avg(o_totalprice) as m from orders group by 1)")
def d12(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m")).agg(F.round(F.avg("m"), 6).alias("mean_of_means"))


@query("D13_spearman", "with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as a, rank() over (order by l_discount) + (count(*) over (partition by l_discount) - 1) / 2.0 as b from lineitem) select round(corr(a, b), 6) as rho from r")
def d13(spark, d):
    return R.spearman(table(spark, d, "lineitem"), "l_quantity", "l_discount")


@query("D14_right_closed_bins", "select case when n_chars > 0 and n_chars <= 500 then '(0, 500]' when n_chars > 500 and n_chars <= 2000 then '(500, 2000]' when n_chars > 2000 and n_chars <= 10000 then '(2000, 10000]' end as bin, count(*) as n, round(avg(n_chars), 4) as mean_chars from documents group by 1")
def d14(spark, d):
    return table(spark, d, "documents").groupBy(R.bins(F.col("n_chars"), [0, 500, 2000, 10000]).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("D15_pivot_row_max", "select o_custkey, max(case when o_orderstatus = 'F' then o_totalprice end) as F, max(case when o_orderstatus = 'O' then o_totalprice end) as O, max(case when o_orderstatus = 'P' then o_totalprice end) as P, max(o_totalprice) as top from orders group by 1")
def d15(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_totalprice"))
    return g.select("o_custkey", "F", "O", "P", F.greatest("F", "O", "P").alias("top"))


@query("D16_size_buckets", f"with {PLACES_SQL}, g as (select name, count(*) as n, avg(lat) as m from places group by 1) select case when n < 20 then 'small' when n < 40 then 'medium' else 'large' end as bucket, count(*) as groups, round(avg(m), 6) as mean_lat from g group by 1")
def d16(spark, d):
    g = places(spark, d).groupBy("name").agg(F.count("*").alias("n"), F.avg("lat").alias("m"))
    bucket = F.when(F.col("n") < 20, "small").when(F.col("n") < 40, "medium").otherwise("large")
    return g.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("groups"), F.round(F.avg("m"), 6).alias("mean_lat"))


@query("D17_contingency", "select c_mktsegment, count(*) filter (where c_custkey % 10 < 7) as train, count(*) filter (where c_custkey % 10 in (7, 8)) as dev, count(*) filter (where c_custkey % 10 = 9) as test from customer group by 1")
def d17(spark, d):
    split = F.when(F.col("c_custkey") % 10 < 7, "train").when(F.col("c_custkey") % 10 < 9, "dev").otherwise("test")
    return table(spark, d, "customer").withColumn("split", split).groupBy("c_mktsegment").pivot("split", ["train", "dev", "test"]).count().na.fill(0)


@query("D19_name_ambiguity", f"with {PLACES_SQL}, g as (select name, count(*) as n from places group by 1) select count(*) filter (where n >= 2) as groups, sum(n) filter (where n >= 2)::bigint as pois, max(n) as largest from g")
def d19(spark, d):
    g = places(spark, d).groupBy(T.fold(F.col("name")).alias("f")).agg(F.count("*").alias("n"))
    return g.agg(F.count_if(F.col("n") >= 2).alias("groups"), F.sum(F.when(F.col("n") >= 2, F.col("n"))).alias("pois"), F.max("n").alias("largest"))


@query("D20_completeness", "select round(avg(case when text is not null and text <> '' then 1.0 else 0.0 end), 6) as text_rate, round(avg(case when lang is not null then 1.0 else 0.0 end), 6) as lang_rate, round(avg(case when n_chars between 100 and 5000 then 1.0 else 0.0 end), 6) as size_rate from documents")
def d20(spark, d):
    rate = lambda c, n: F.round(F.avg(c.cast("int").cast("double")), 6).alias(n)
    return table(spark, d, "documents").agg(rate(F.col("text").isNotNull() & (F.col("text") != ""), "text_rate"), rate(F.col("lang").isNotNull(), "lang_rate"), rate(F.col("n_chars").between(100, 5000), "size_rate"))


@query("D21_unresolved_repeats", f"with {PLACES_SQL} select name, count(*) as n from places where brand <> 'Brand#1' and not destination_searchable group by 1 having count(*) >= 3")
def d21(spark, d):
    p = places(spark, d)
    known = p.filter("brand = 'Brand#1' or destination_searchable").select("poi_id")
    return p.join(known, "poi_id", "left_anti").groupBy("name").agg(F.count("*").alias("n")).filter("n >= 3")


@query("E1_rank_enumeration", "select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as integer) as rank from orders")
def e1(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("rank"))


@query("E2_top_k_per_group", "with r as (select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as integer) as rank from orders) select * from r where rank <= 3")
def e2(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank")).filter("rank <= 3")


@query("E5_rank_of_target", "with t as (select o_custkey as query_id, max(o_orderkey) as t_idx from orders group by 1), s as (select t.*, o_totalprice as t_score from t join orders on o_orderkey = t_idx) select query_id, 1 + count(*) filter (where o_totalprice > t_score or (o_totalprice = t_score and o_orderkey < t_idx)) as rank from s join orders on o_custkey = query_id group by 1")
def e5(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("score"))
    return R.rank_of_target(o, o.groupBy("query_id").agg(F.max("idx").alias("t_idx")))


@query("E6_first_stable_hit", "with e as (select user_id, row_number() over (partition by user_id order by ts, event_id) as i, value < 30 as hit from events), s as (select *, min(hit::int) over (partition by user_id order by i rows between current row and unbounded following) as stays from e) select user_id, cast(min(case when hit then i end) as integer) as first_hit, cast(min(case when stays = 1 then i end) as integer) as first_stable from s group by 1")
def e6(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", F.row_number().over(w).alias("i"), (F.col("value") < 30).cast("int").alias("hit"))
    on = Window.partitionBy("user_id").orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    s = e.withColumn("stays", F.min("hit").over(on))
    return s.groupBy("user_id").agg(F.min(F.when(F.col("hit") == 1, F.col("i"))).alias("first_hit"), F.min(F.when(F.col("stays") == 1, F.col("i"))).alias("first_stable"))


@query("E7_three_in_a_row", "with e as (select user_id, row_number() over (partition by user_id order by ts, event_id) as i, (value < 40)::int as hit from events), s as (select *, sum(hit) over w as h, count(*) over w as n from e window w as (partition by user_id order by i rows between current row and 2 following)) select user_id, cast(min(case when h = 3 and n = 3 then i end) as integer) as first_run from s group by 1")
def e7(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", F.row_number().over(w).alias("i"), (F.col("value") < 40).cast("int").alias("hit"))
    three = Window.partitionBy("user_id").orderBy("i").rowsBetween(0, 2)
    s = e.withColumns({"h": F.sum("hit").over(three), "n": F.count("*").over(three)})
    return s.groupBy("user_id").agg(F.min(F.when((F.col("h") == 3) & (F.col("n") == 3), F.col("i"))).alias("first_run"))


@query("E9_slot_permutation", """with r as (select o_custkey as query_id, o_orderkey as doc_id, o_orderstatus = 'F' as c, o_totalprice as s, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rank from orders),
n as (select *, row_number() over (partition by query_id, c order by rank) as slot, row_number() over (partition by query_id, c order by s desc, doc_id) as turn from r)
select a.query_id, a.doc_id, cast(case when a.c then b.rank else a.rank end as integer) as rank from n a join n b on a.query_id = b.query_id and a.c = b.c and a.turn = b.slot""")
def e9(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("st"), F.col("o_totalprice").alias("s"), F.row_number().over(w).alias("rank"))
    return R.permute_cohort(r, F.col("st") == "F", [F.desc("s"), F.asc("doc_id")]).select("query_id", "doc_id", "rank")


@query("E10_source_quotas", """with c as (select l_partkey as q, l_orderkey as item, case l_returnflag when 'A' then 'lexical' when 'N' then 'dense' else 'random' end as source, l_linenumber + l_orderkey * 10 as rank from lineitem),
f as (select *, row_number() over (partition by q, item order by case source when 'lexical' then 0 when 'dense' then 1 else 2 end, rank) as r from c),
n as (select *, row_number() over (partition by q, source order by rank, item) as o from f where r = 1) select q, item, source from n where o <= 3""")
def e10(spark, d):
    src = F.when(F.col("l_returnflag") == "A", "lexical").when(F.col("l_returnflag") == "N", "dense").otherwise("random")
    c = table(spark, d, "lineitem").select(F.col("l_partkey").alias("q"), F.col("l_orderkey").alias("item"), src.alias("source"), (F.col("l_linenumber") + F.col("l_orderkey") * 10).alias("rank"))
    p = F.when(F.col("source") == "lexical", 0).when(F.col("source") == "dense", 1).otherwise(2)
    return R.quota_dedup(c, "q", "item", p, 3).select("q", "item", "source")


@query("E12_keep_best_evidence", f"with {PLACES_SQL}, r as (select *, row_number() over (partition by name order by case category when 'PROMO' then 3 when 'LARGE' then 2 else 1 end desc, k) as r from places) select name, poi_id from r where r = 1")
def e12(spark, d):
    power = F.when(F.col("category") == "PROMO", 3).when(F.col("category") == "LARGE", 2).otherwise(1)
    return R.keep_first(places(spark, d), ["name"], [power.desc(), F.asc("k")]).select("name", "poi_id")


@query("E16_dense_renumber", "select c_custkey, 'case-' || lpad(cast(dense_rank() over (order by c_mktsegment) as varchar), 5, '0') as case_id from customer")
def e16(spark, d):
    c = table(spark, d, "customer")
    ids = c.select("c_mktsegment").distinct().withColumn("n", F.dense_rank().over(Window.orderBy("c_mktsegment")))
    return c.join(ids, "c_mktsegment").select("c_custkey", F.format_string("case-%05d", "n").alias("case_id"))


@query("F1_union_all", "select 'customer' as kind, c_nationkey as nation, count(*) as n from customer group by 2 union all select 'supplier', s_nationkey, count(*) from supplier group by 2")
def f1(spark, d):
    own = lambda t, c: table(spark, d, t).groupBy(F.col(c).alias("nation")).agg(F.count("*").alias("n")).select(F.lit(t).alias("kind"), "nation", "n")
    return own("customer", "c_nationkey").unionByName(own("supplier", "s_nationkey"))


@query("F2_set_algebra", "select 'union' as op, count(*) as n from (select l_partkey as k from lineitem union select o_custkey from orders) union all select 'intersect', count(*) from (select l_partkey as k from lineitem intersect select o_custkey from orders) union all select 'except', count(*) from (select l_partkey as k from lineitem except select o_custkey from orders)")
def f2(spark, d):
    a, b = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    rows = [p.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, p in parts.items()]
    return rows[0].union(rows[1]).union(rows[2])


@query("F3_symmetric_difference", "with a as (select distinct l_partkey as k from lineitem where l_returnflag = 'A' and l_linenumber = 1), b as (select distinct l_partkey as k from lineitem where l_returnflag = 'R' and l_linenumber = 1) select coalesce(a.k, b.k) as k, a.k is not null as only_left from a full join b on a.k = b.k where a.k is null or b.k is null")
def f3(spark, d):
    of = lambda f, name: table(spark, d, "lineitem").filter((F.col("l_returnflag") == f) & (F.col("l_linenumber") == 1)).select(F.col("l_partkey").alias(name)).distinct()
    return of("A", "a").join(of("R", "b"), F.col("a") == F.col("b"), "full").filter("a is null or b is null").select(F.coalesce("a", "b").alias("k"), F.col("a").isNotNull().alias("only_left"))


@query("F4_table_parity", "select count(*) filter (where side = 'l') as only_left, count(*) filter (where side = 'r') as only_right from ((select c_custkey, c_nationkey, 'l' as side from customer where c_custkey % 2 = 0))")
def f4(spark, d):
    a = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    b = a.filter("c_custkey % 2 <> 0")
    left, right = a.exceptAll(b).agg(F.count("*").alias("only_left")), b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return left.crossJoin(right)


@query("F5_jaccard_top_sets", "with s as (select o_custkey, list(distinct o_orderstatus) as a, list(distinct o_orderpriority[1:1]) as b from orders group by 1) select o_custkey, round(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as jaccard_distance from s")
def f5(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a"), F.collect_set(F.substring("o_orderpriority", 1, 1)).alias("b"))
    return s.select("o_custkey", F.round(1 - T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard_distance"))
