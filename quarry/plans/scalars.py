"""Queries of the scalar text, geo, time and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import geo
from quarry.functions import text as T
from quarry.plans.registry import query
from quarry.plans.views import ANCHORS_SQL, PLACES_SQL, anchors, fold_sql, haversine_sql, places, table

TOKEN_SQL = "[a-z0-9]+(?:[/-][a-z0-9]+)*"
#: A label with a code, a path and capitals, made from a place.
LABEL = "concat('Toa S', cast(k % 50 as string), '.', cast(k % 7 as string), ' ', housenumber, '/', cast(k % 9 as string), ' ', name)"
LABEL_SQL = f"{PLACES_SQL}, labels_ as (select poi_id, k, {LABEL.replace('string', 'varchar')} as label from places)"


def labels(spark, d):
    return places(spark, d).selectExpr("poi_id", "k", f"{LABEL} as label")


@query("G1_fold", f"select doc_id, {fold_sql('text')} as folded from documents")
def g1(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("G2_fold_words", f"select doc_id, trim(regexp_replace(regexp_replace({fold_sql('text')}, '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')) as folded from documents")
def g2(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fold_words(F.col("text")).alias("folded"))


@query("G3_fold_keep_space", "select doc_id, strip_accents(replace(lower(text), 'ß', 'ss')) as folded from documents")
def g3(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fold_keep_space(F.col("text")).alias("folded"))


@query("G4_normalized", "select doc_id, trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\\s+', ' ', 'g')) as normalized from documents")
def g4(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalized(F.col("text")).alias("normalized"))


@query("G5_strip_diacritics", "select doc_id, strip_accents(text) as plain from documents")
def g5(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_diacritics(F.col("text")).alias("plain"))


@query("G6_alnum_compact", f"with {LABEL_SQL} select poi_id, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') as compact from labels_")
def g6(spark, d):
    return labels(spark, d).select("poi_id", T.alnum_compact(F.col("label")).alias("compact"))


@query("G7_compact_plus", f"with {PLACES_SQL} select poi_id, regexp_replace(lower(brand || '+ ' || name), '[^a-z0-9+]', '', 'g') as compact from places")
def g7(spark, d):
    return places(spark, d).select("poi_id", T.compact_alnum_plus(F.concat("brand", F.lit("+ "), "name")).alias("compact"))


@query("G8_match_key", f"with {PLACES_SQL} select poi_id, regexp_replace(replace(lower(brand || '+ ' || name), '+', 'plus'), '[^a-z0-9]+', '', 'g') as key from places")
def g8(spark, d):
    return places(spark, d).select("poi_id", T.match_key(F.concat("brand", F.lit("+ "), "name")).alias("key"))


@query("G9_ascii_slug", f"with {PLACES_SQL} select poi_id, coalesce(nullif(trim(regexp_replace(lower(case when k % 5 = 0 then '--' else brand end), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unnamed') as slug from places")
def g9(spark, d):
    return places(spark, d).select("poi_id", T.ascii_slug(F.when(F.col("k") % 5 == 0, "--").otherwise(F.col("brand"))).alias("slug"))


@query("G10_glue_codes", f"with {LABEL_SQL} select poi_id, regexp_replace(label, 'S([0-9]+)\\.([0-9]+)', 's\\1\\2') as glued from labels_")
def g10(spark, d):
    return labels(spark, d).select("poi_id", T.glue_code_spans(F.col("label")).alias("glued"))


@query("G11_token_kinds", f"with {LABEL_SQL}, t as (select unnest(regexp_extract_all(lower(label), '{TOKEN_SQL}')) as tok from labels_) select case when regexp_matches(tok, '[a-z]') and regexp_matches(tok, '[0-9]') then 'code' when regexp_matches(tok, '[a-z]') then 'letter' when regexp_matches(tok, '[0-9]') then 'number' else 'other' end as kind, count(*) as n from t group by 1")
def g11(spark, d):
    t = labels(spark, d).select(F.explode(T.text_tokens(F.col("label"))).alias("tok"))
    return t.groupBy(T.token_kind(F.col("tok")).alias("kind")).agg(F.count("*").alias("n"))


@query("G12_query_codes", f"with {LABEL_SQL} select poi_id, 's' || cast(k % 50 as varchar) || cast(k % 7 as varchar) as codes from labels_")
def g12(spark, d):
    return labels(spark, d).select("poi_id", F.array_join(T.query_codes(F.col("label")), "|").alias("codes"))


@query("G13_index_codes", f"with {LABEL_SQL}, p as (select poi_id, unnest(list_concat([lower(label)], string_split(lower(label), ' '))) as t from labels_), k as (select distinct poi_id, regexp_replace(t, '[^a-z0-9]', '', 'g') as c from p) select poi_id, string_agg(c, '|' order by c) as codes from k where length(c) >= 2 and regexp_matches(c, '[0-9]') group by 1")
def g13(spark, d):
    return labels(spark, d).select("poi_id", F.array_join(T.index_codes(F.col("label")), "|").alias("codes"))


@query("G14_text_tokens", f"with {LABEL_SQL} select poi_id, array_to_string(regexp_extract_all(lower(label), '{TOKEN_SQL}'), '|') as toks from labels_")
def g14(spark, d):
    return labels(spark, d).select("poi_id", F.array_join(T.text_tokens(F.col("label")), "|").alias("toks"))


@query("G15_whitespace_tokens", f"select doc_id, cast(len(list_filter(string_split({fold_sql('text')}, ' '), lambda x: x <> '')) as integer) as n_tokens from documents")
def g15(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.words(F.col("text"))).alias("n_tokens"))


@query("G16_letter_runs", f"with {LABEL_SQL} select poi_id, 'toa|' || replace(split_part(label, ' ', 4) || ' ' || split_part(label, ' ', 5), ' ', ' ') as runs from labels_")
def g16(spark, d):
    runs = T.letter_runs(T.text_tokens(F.col("label")))
    return labels(spark, d).select("poi_id", F.array_join(F.transform(runs, lambda r: F.array_join(r, " ")), "|").alias("runs"))


@query("G17_compact_length", f"with {LABEL_SQL} select poi_id, cast(length(regexp_replace(label, '[.\\-\\s]', '', 'g')) as integer) as n from labels_")
def g17(spark, d):
    return labels(spark, d).select("poi_id", T.compact_length(F.col("label")).alias("n"))


@query("G18_expand_query", f"with {PLACES_SQL} select poi_id, case k % 3 when 0 then 'bệnh viện ' || name when 1 then name || ' trung học phổ thông' else name end as expanded from places")
def g18(spark, d):
    q = F.when(F.col("k") % 3 == 0, F.concat(F.lit("BV "), "name")).when(F.col("k") % 3 == 1, F.concat("name", F.lit("  thpt"))).otherwise(F.col("name"))
    return places(spark, d).select("poi_id", T.expand_query(q).alias("expanded"))


@query("G19_has_accents", f"select doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) <> {fold_sql('text')} as accented from documents")
def g19(spark, d):
    # as in the SQL, a null text has no answer
    return table(spark, d, "documents").select("doc_id", F.when(F.col("text").isNotNull(), T.has_accents(F.col("text"))).alias("accented"))


@query("G20_path_atoms", f"with {LABEL_SQL} select poi_id, array_to_string(string_split(replace(replace(array_to_string(regexp_extract_all(lower(label), '{TOKEN_SQL}'), '|'), '/', '|'), '-', '|'), '|'), '|') as atoms from labels_")
def g20(spark, d):
    return labels(spark, d).select("poi_id", F.array_join(T.path_atoms(F.col("label")), "|").alias("atoms"))


@query("G23_housenumber_path_key", f"with {PLACES_SQL} select poi_id, housenumber || ' ' || cast(k % 9 as varchar) as key from places")
def g23(spark, d):
    return places(spark, d).select("poi_id", T.housenumber_path_key(F.concat("housenumber", F.lit("/"), (F.col("k") % 9).cast("string"))).alias("key"))


@query("G24_clean_address", f"with {PLACES_SQL} select poi_id, housenumber || 'a' as h, case when k % 2 = 0 then street else name end as s from places")
def g24(spark, d):
    return places(spark, d).select("poi_id", T.clean_housenumber(F.concat("housenumber", F.lit(" A"))).alias("h"), T.clean_street(F.when(F.col("k") % 2 == 0, F.concat(F.lit("Đường "), "street")).otherwise(F.concat(F.lit("Phố "), "name"))).alias("s"))


@query("G25_strip_business_prefix", f"with {PLACES_SQL} select poi_id, name as stripped from places")
def g25(spark, d):
    return places(spark, d).select("poi_id", T.strip_business_prefix(F.concat(F.element_at(F.array(F.lit("quan ca phe "), F.lit("shop "), F.lit("")), (F.col("k") % 3 + 1).cast("int")), "name")).alias("stripped"))


@query("G27_numbers", f"with {LABEL_SQL} select poi_id, array_to_string(regexp_extract_all(lower(label), '[0-9]+[a-z]?'), '|') as numbers from labels_")
def g27(spark, d):
    return labels(spark, d).select("poi_id", F.array_join(T.numbers(T.fold(F.col("label"))), "|").alias("numbers"))


@query("G28_levenshtein", f"with {PLACES_SQL}, n as (select distinct name from places) select a.name as a, b.name as b, cast(levenshtein(a.name, b.name) as integer) as edits from n a join n b on a.name[1:1] = b.name[1:1] and a.name < b.name")
def g28(spark, d):
    n = places(spark, d).select(F.col("name").alias("a")).distinct().withColumn("c", F.substring("a", 1, 1))
    return n.join(n.withColumnRenamed("a", "b"), "c").filter("a < b").select("a", "b", F.levenshtein("a", "b").alias("edits"))


@query("G30_name_similarity", f"with {PLACES_SQL}, n as (select distinct name from places), p as (select a.name as a, b.name as b from n a join n b on a.name[1:1] = b.name[1:1] and a.name < b.name) select a, b, case when least(length(a), length(b)) >= 6 and abs(length(a) - length(b)) <= 3 and 1 - levenshtein(a, b) / greatest(length(a), length(b))::double >= 0.88 then 'levenshtein' end as reason from p")
def g30(spark, d):
    n = places(spark, d).select(F.col("name").alias("a")).distinct().withColumn("c", F.substring("a", 1, 1))
    return n.join(n.withColumnRenamed("a", "b"), "c").filter("a < b").select("a", "b", T.name_similarity(F.col("a"), F.col("b")).alias("reason"))


@query("G31_graphemes", "select doc_id, cast(length(text) as integer) as n from documents")
def g31(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.graphemes(F.col("text"))).alias("n"))


@query("G34_one_slip", f"with {PLACES_SQL}, n as (select distinct name from places) select name, true as slip from n")
def g34(spark, d):
    swapped = F.concat(F.substring("name", 2, 1), F.substring("name", 1, 1), F.expr("substring(name, 3)"))
    return places(spark, d).select("name").distinct().select("name", T.one_slip(F.col("name"), swapped).alias("slip"))


@query(
    "G36_remove_housenumber",
    f"""with {PLACES_SQL}, q as (select poi_id, housenumber, case k % 4 when 0 then housenumber || ' ' || street when 1 then 'A' || housenumber || '/2 ' || street when 2 then housenumber || ', ' || name || ' ' || housenumber else name || ' ' || housenumber || ' , hue' end as q from places)
select poi_id, case when len(regexp_extract_all(regexp_replace(' ' || q || ' ', '([^A-Za-z0-9_/-])', '\\1\\1', 'g'), '[^A-Za-z0-9_/-]' || housenumber || '[^A-Za-z0-9_/-]')) = 1
       then trim(regexp_replace(regexp_replace(' ' || q || ' ', '([^A-Za-z0-9_/-])' || housenumber || '([^A-Za-z0-9_/-])', '\\1 \\2'), '\\s+', ' ', 'g')) end as rest from q""",
)
def g36(spark, d):
    k = F.col("k") % 4
    q = F.when(k == 0, F.concat("housenumber", F.lit(" "), "street")).when(k == 1, F.concat(F.lit("A"), "housenumber", F.lit("/2 "), "street"))
    q = q.when(k == 2, F.concat("housenumber", F.lit(", "), "name", F.lit(" "), "housenumber")).otherwise(F.concat("name", F.lit(" "), "housenumber", F.lit(" , hue")))
    return places(spark, d).select("poi_id", T.remove_housenumber(q, F.col("housenumber")).alias("rest"))


@query(
    "G39_language_bucket",
    r"""select doc_id, case when not regexp_matches(text, '\p{L}') then 'other' when regexp_matches(text, '[^\x00-\x7F]') then 'vi' else 'en' end as bucket,
       length(regexp_replace(word, '[^\p{L}\p{N}]', '', 'g')) between 2 and 5 and regexp_matches(word, '\p{Lu}') and upper(word) = word as acronym
from (select *, string_split(text, ' ')[1] as word from documents)""",
)
def g39(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.language_bucket(t).alias("bucket"), T.is_acronym(F.split(t, " ")[0]).alias("acronym"))


@query("G41_passage", f"with {PLACES_SQL} select poi_id, case when brand = name then name else name || ', ' || brand || ', ' || street end as passage from places")
def g41(spark, d):
    parts = F.array("name", "brand", F.lit(""), "name", "street")
    keep = F.filter(parts, lambda p: p != "")
    return places(spark, d).select("poi_id", F.array_join(F.array_distinct(keep), ", ").alias("passage"))


#: A category in the places' own form, of their number and type.
KINDS = ("amenity=atm", "amenity=bank", "amenity=fuel", "Amenity=Cafe", "amenity=fast_food", "shop=convenience", "shop=supermarket", "shop=chemist", "tourism=hotel", "shop=shoes", "office=yes", "healthcare=pharmacy;amenity=bank")
KINDS_SQL = "lower(category) || ';' || list_extract([" + ", ".join(f"'{x}'" for x in KINDS) + f"], cast(k % {len(KINDS)} as integer) + 1)"


def kind_of():
    return F.concat(F.lower("category"), F.lit(";"), F.element_at(F.array(*map(F.lit, KINDS)), (F.col("k") % len(KINDS)).cast("int") + 1))


@query(
    "G42_category_namespace",
    f"""with {PLACES_SQL}, c as (select poi_id, {KINDS_SQL} as c from places),
signs(ord, ns, sign) as (values """
    + ", ".join(f"({i}, '{ns}', '{sign}')" for i, (ns, signs) in enumerate(T.CATEGORY_NAMESPACES) for sign in signs)
    + """)
select poi_id, replace(replace(c, '=', ' '), '_', ' ') as words, coalesce((select arg_min(ns, ord) from signs where contains(lower(c.c), sign)), 'other_reviewed') as namespace from c""",
)
def g42(spark, d):
    return places(spark, d).select("poi_id", T.category_text(kind_of()).alias("words"), T.namespace_for(kind_of()).alias("namespace"))


@query("G43_edge_ngrams", f"with {PLACES_SQL}, t as (select distinct unnest(string_split(name, ' ')) as tok from places) select tok, substr(tok, 1, n) as gram from (select tok, unnest(range(1, least(20, length(tok)) + 1)) as n from t)")
def g43(spark, d):
    t = places(spark, d).select(F.explode(F.split("name", " ")).alias("tok")).distinct()
    return t.select("tok", F.explode(T.edge_ngrams(F.col("tok"))).alias("gram"))


@query("G44_subtitle_parse", f"with {PLACES_SQL} select poi_id, category || ' · ' || street as subtitle from places")
def g44(spark, d):
    context = F.concat_ws("|", "category", F.lit(""), "street")
    return places(spark, d).select("poi_id", F.array_join(F.filter(F.split(context, r"\|"), lambda x: x != ""), " · ").alias("subtitle"))


@query("H1_haversine", f"with {PLACES_SQL} select poi_id, round({haversine_sql('20.99', '105.81', 'lat', 'lon', 6371008.8)}, 2) as metres from places")
def h1(spark, d):
    return places(spark, d).select("poi_id", F.round(geo.haversine(F.lit(20.99), F.lit(105.81), F.col("lat"), F.col("lon")), 2).alias("metres"))


@query("H3_decay", f"with {PLACES_SQL} select poi_id, round(0.35 * exp(-({haversine_sql('20.99', '105.81', 'lat', 'lon', 6371008.8)}) / 5000), 6) as points from places")
def h3(spark, d):
    return places(spark, d).select("poi_id", F.round(geo.decay(geo.haversine(F.lit(20.99), F.lit(105.81), F.col("lat"), F.col("lon"))), 6).alias("points"))


@query("H4_polyline", f"with {ANCHORS_SQL} select anchor_id, 3 as n, cast(38.5 as double) as lat, cast(-120.2 as double) as lon from anchors")
def h4(spark, d):
    points = geo.decode_polyline(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@"))
    return anchors(spark, d).select("anchor_id", F.size(points).alias("n"), F.get(points, F.lit(0))["lat"].alias("lat"), F.get(points, F.lit(0))["lon"].alias("lon"))


@query("H5_grid_cells", f"with {PLACES_SQL} select cast(floor(lat / 0.001) as bigint) as r, cast(floor(lon / 0.001) as bigint) as c, count(*) as n from places group by 1, 2")
def h5(spark, d):
    return places(spark, d).groupBy(geo.cell(F.col("lat"), 0.001).alias("r"), geo.cell(F.col("lon"), 0.001).alias("c")).agg(F.count("*").alias("n"))


@query("H6_vector_norm", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as norm from embeddings")
def h6(spark, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(total), 5).alias("norm"))


@query("H7_finite_coordinates", f"with {PLACES_SQL} select poi_id, k % 11 <> 0 as ok from places")
def h7(spark, d):
    lat = F.when(F.col("k") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("lat"))
    return places(spark, d).select("poi_id", geo.finite(lat, F.col("lon")).alias("ok"))


@query("H8_distance_text", f"with {PLACES_SQL}, m as (select poi_id, round({haversine_sql('20.99', '105.81', 'lat', 'lon', 6371008.8)}) as m from places) select poi_id, case when m < 1000 then cast(cast(m as bigint) as varchar) || ' m' else 'km' end as shown from m")
def h8(spark, d):
    m = F.round(geo.haversine(F.lit(20.99), F.lit(105.81), F.col("lat"), F.col("lon")))
    shown = geo.display_distance(m)
    return places(spark, d).select("poi_id", F.when(F.endswith(shown, F.lit("km")), "km").otherwise(shown).alias("shown"))


@query("I1_iso_to_utc", "select event_id, cast(floor(epoch(ts)) as bigint) as epoch from events")
def i1(spark, d):
    iso = F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return table(spark, d, "events").select("event_id", F.unix_timestamp(F.to_timestamp(iso)).alias("epoch"))


@query("I2_staleness", "select event_id, case when value > 200 then 'inaccurate' when value > 120 then 'stale' when value < 0.05 then 'future' else 'ok' end as gate from events")
def i2(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.when(v > 200, "inaccurate").when(v > 120, "stale").when(v < 0.05, "future").otherwise("ok").alias("gate"))


@query("I4_time_features", "select event_id, round(sin(2 * pi() * hour(ts) / 24), 6) as hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) as hour_cos, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) as day_sin from events")
def i4(spark, d):
    h, w = F.hour("ts"), F.weekday("ts")
    turn = lambda f, x, n: F.round(f(2 * F.pi() * x / n), 6)
    return table(spark, d, "events").select("event_id", turn(F.sin, h, 24).alias("hour_sin"), turn(F.cos, h, 24).alias("hour_cos"), turn(F.sin, w, 7).alias("day_sin"))


@query("J1_id_lists", f"with {PLACES_SQL} select poi_id, poi_id || ',p:0' as ids from places")
def j1(spark, d):
    raw = F.when(F.col("k") % 2 == 0, F.concat(F.lit('["'), "poi_id", F.lit('", "p:0"]'))).otherwise(F.concat("poi_id", F.lit("|p:0")))
    ids = F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).otherwise(F.split(raw, r"\|"))
    return places(spark, d).select("poi_id", F.array_join(ids, ",").alias("ids"))


@query("J3_contiguous_span", f"with {PLACES_SQL} select poi_id, name = 'red bolt' or starts_with(name, 'red bo') as hit from places")
def j3(spark, d):
    span = F.array(F.lit("red"), F.lit("bo"))
    return places(spark, d).select("poi_id", T.contains_span(span, T.text_tokens(F.col("name")), True).alias("hit"))


@query("J4_adjacent_pairs", f"with {PLACES_SQL} select poi_id, replace(name, ' ', '+') as pairs from places")
def j4(spark, d):
    t = F.split("name", " ")
    pairs = F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.concat_ws("+", F.get(t, i), F.get(t, i + 1)))
    return places(spark, d).select("poi_id", F.array_join(pairs, "|").alias("pairs"))


@query("J7_map_merge", "select o_custkey, cast(count(*) filter (where o_orderstatus = 'F') as bigint) as f, count(*) as n from orders group by 1")
def j7(spark, d):
    one = F.map_from_arrays(F.array("o_orderstatus"), F.array(F.lit(1)))
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(one).alias("maps"))
    zero = F.create_map(F.lit("F"), F.lit(0))
    merged = F.aggregate("maps", zero, lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))))
    return g.select("o_custkey", F.element_at(merged, "F").cast("long").alias("f"), F.aggregate(F.map_values(merged), F.lit(0), lambda s, x: s + x).cast("long").alias("n"))


@query("J8_schema_rules", "select conv_id, turn, 'role' as rule from conversations where role not in ('user', 'assistant') union all select conv_id, turn, 'text' from conversations where length(text) < 20")
def j8(spark, d):
    rules = F.array(F.when(~F.col("role").isin("user", "assistant"), F.lit("role")), F.when(F.char_length("text") < 20, F.lit("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
