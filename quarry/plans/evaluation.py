"""Queries of metrics, splits, training data, corpus building and validators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import geo
from quarry.functions import text as T
from quarry.operators import checks, identity, metrics, training, validators
from quarry.operators import tables as R
from quarry.plans.registry import query
from quarry.plans.search import DENSE_SQL, dense
from quarry.plans.views import PLACES_SQL, haversine_sql, places, table
from quarry.sources.shared import reliable

QRELS_SQL = f"""{DENSE_SQL}, qs as (select vec_id as query_id, label from embeddings where vec_id % 50 = 0),
best as (select query_id, min(rank) as best_rank from qs left join dense using (query_id) join embeddings e on e.vec_id = doc_id and e.label = qs.label group by 1),
ranks as (select query_id, best_rank from qs left join best using (query_id))"""


def queries_of(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")


def qrels(spark, d):
    """Vectors with the query's label are relevant to it."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return queries_of(spark, d).join(e, "label").filter("query_id <> doc_id").select("query_id", "doc_id")


def ranks(spark, d):
    return metrics.best_ranks(dense(spark, d), qrels(spark, d), queries_of(spark, d))


@query("M1_best_rank", f"with {QRELS_SQL} select query_id, cast(coalesce(best_rank, 51) as integer) as best_rank from ranks")
def m1(spark, d):
    return metrics.best_ranks(dense(spark, d), qrels(spark, d), queries_of(spark, d), miss=51)


def summary_sql(source: str, by: str = "") -> str:
    cols = ", ".join(f"round(avg(case when best_rank <= {k} then 1.0 else 0.0 end), 6) as r{k}" for k in (1, 5, 10, 50))
    return f"select {by + ', ' if by else ''}count(*) as n, {cols}, round(avg(case when best_rank <= 10 then 1.0 / best_rank else 0.0 end), 6) as mrr10, round(avg(case when best_rank <= 50 then 0.0 else 1.0 end), 6) as miss50 from {source}{' group by ' + by if by else ''}"


@query("M2_recall_mrr", f"with {QRELS_SQL} {summary_sql('ranks')}")
def m2(spark, d):
    return metrics.summary(ranks(spark, d))


@query("M3_depth_needed", f"with {QRELS_SQL}, o as (select coalesce(best_rank, 51) as r, row_number() over (order by coalesce(best_rank, 51)) as i, count(*) over () as n from ranks) select cast(max(case when i = ceil(0.5 * n) and r <= 50 then r end) as integer) as k50, cast(max(case when i = ceil(0.95 * n) and r <= 50 then r end) as integer) as k95 from o")
def m3(spark, d):
    return metrics.depth_needed(ranks(spark, d), {"k50": 0.5, "k95": 0.95}, 50)


@query("M4_slices", f"with {QRELS_SQL}, s as (select label, best_rank from ranks join qs using (query_id)) {summary_sql('s', 'label')}")
def m4(spark, d):
    return metrics.summary(ranks(spark, d).join(queries_of(spark, d), "query_id"), by=("label",))


SECOND_SQL = "b as (select query_id, case when query_id % 3 = 0 then null else query_id % 7 + 1 end as best_rank from qs)"


def second(spark, d):
    return queries_of(spark, d).select("query_id", F.when(F.col("query_id") % 3 != 0, F.col("query_id") % 7 + 1).alias("best_rank"))


@query("M5_rescue_oracle", f"with {QRELS_SQL}, {SECOND_SQL}, j as (select coalesce(a.best_rank <= 5, false) as x, coalesce(b.best_rank <= 5, false) as y from ranks a join b using (query_id)) select count(*) filter (where x and not y) as only_a, count(*) filter (where y and not x) as only_b, count(*) filter (where x and y) as both, count(*) filter (where not x and not y) as neither, count(*) filter (where x or y) as either from j")
def m5(spark, d):
    return metrics.rescue(ranks(spark, d), second(spark, d), 5)


@query("M6_prefix_metrics", "with e as (select user_id as query_id, row_number() over (partition by user_id order by ts, event_id) as idx, (floor(value) <= 40)::int as hit from events), w as (select *, sum(hit) over (partition by query_id order by idx range between current row and 2 following) as run from e) select query_id, cast(min(case when hit = 1 then idx end) as integer) as first_hit, cast(min(case when run = 3 then idx end) as integer) as stable_hit, round(avg(hit), 6) as auc from w group by 1")
def m6(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.row_number().over(w).alias("idx"), F.floor("value").alias("rank"))
    return metrics.prefix_metrics(e, k=40)


@query("M7_ready_prefixes", "with e as (select user_id as query_id, row_number() over (partition by user_id order by ts, event_id) as idx, (floor(value) <= 40)::int as hit from events) select query_id, round(avg(hit), 6) as auc, cast(min(case when hit = 1 then idx end) as integer) as first_hit from e where idx >= 2 + query_id % 3 group by 1")
def m7(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.row_number().over(w).alias("idx"), F.floor("value").alias("rank"))
    return metrics.prefix_metrics(e.filter(F.col("idx") >= 2 + F.col("query_id") % 3), k=40).select("query_id", "auc", "first_hit")


@query("M8_brand_metrics", f"""with {PLACES_SQL}, run as (select street as query_id, poi_id as doc_id, brand, category, row_number() over (partition by street order by k) as rank from places), q as (select street as query_id, min(brand) as family from places group by 1),
rel as (select query_id, poi_id as doc_id from q join places on brand = family and category in ('PROMO', 'LARGE')), need as (select query_id, count(*) as n from rel group by 1), g as (select query_id, min(rank) as first, count(*) filter (where rank <= 20) as found from run join rel using (query_id, doc_id) group by 1),
w as (select distinct query_id from run join q using (query_id) where rank <= 20 and brand = family and category not in ('PROMO', 'LARGE'))
select q.query_id, family, cast(coalesce(first, 51) as integer) as first, round(coalesce(found / n::double, 0.0), 6) as coverage, w.query_id is not null and (first is null or first > 20) as false_branch from q left join need using (query_id) left join g using (query_id) left join w using (query_id)""")
def m8(spark, d):
    p = places(spark, d)
    run = p.select(F.col("street").alias("query_id"), F.col("poi_id").alias("doc_id"), F.row_number().over(Window.partitionBy("street").orderBy("k")).alias("rank"))
    q = p.groupBy(F.col("street").alias("query_id")).agg(F.min("brand").alias("family")).withColumn("group", F.col("family"))
    own = F.col("category").isin("PROMO", "LARGE")
    rel = q.join(p.filter(own).select(F.col("brand").alias("family"), F.col("poi_id").alias("doc_id")), "family").select("query_id", "doc_id")
    siblings = p.filter(~own).select(F.col("brand").alias("group"), F.col("poi_id").alias("doc_id"))
    return metrics.brand_metrics(run, q, rel, siblings)


@query(
    "M9_bootstrap_interval",
    f"""with m as (select l_suppkey, avg(l_discount) as m from lineitem group by 1), f as (select m, row_number() over (order by l_suppkey) - 1 as i, count(*) over () as n from m),
s as (select unnest(range(200)) as sample), p as (select sample, {training.hash_order_sql(20260926, 'sample', 'i')} % n as i from s cross join (select i, n from f)),
b as (select sample, avg(m) as mean from p join f using (i) group by 1), o as (select mean, row_number() over (order by mean) - 1 as r from b)
select round((select mean from o where r = 4), 6) as low, round((select mean from o where r = 194), 6) as high, round(avg(m), 6) as mean, count(*) as n_families from m""",
)
def m9(spark, d):
    out = metrics.bootstrap(table(spark, d, "lineitem"), "l_suppkey", "l_discount", draws=200)
    return out.select(*[F.round(c, 6).alias(c) for c in ("low", "high", "mean")], "n_families")


TYPING_SQL = """t as (select user_id as session_id, row_number() over (partition by user_id order by ts, event_id) as step, value < 40 as hit from events),
l as (select *, min(hit::int) over (partition by session_id order by step rows between current row and unbounded following) as lasts from t),
s as (select session_id, count(*) as n, min(case when hit then step end) as first, min(case when lasts = 1 then step end) as stable, arg_max(hit, step) as final_hit from l group by 1)"""


@query("M11_typing_sessions", f"with {TYPING_SQL} select count(*) as sessions, round(avg((first is not null)::int), 6) as found_rate, round(avg((stable is not null)::int), 6) as stable_found_rate, round(avg(final_hit::int), 6) as final_hit_rate, round(avg((first is not null and not final_hit)::int), 6) as transient_rate, round(avg(coalesce(first, n + 1)), 6) as first_mean, round(avg(coalesce(stable, n + 1)), 6) as stable_mean, round(avg(coalesce(n - stable, 0)), 6) as saved_mean from s")
def m11(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("event_index"), (F.col("value") < 40).alias("hit"))
    return metrics.session_summary(metrics.typing_sessions(e))


@query("M12_known_compatible", "with r as (select o_custkey, list(distinct o_orderstatus) as a from orders group by 1) select o_custkey, round(len(list_intersect(a, ['F', 'O'])) / 2.0, 6) as coverage from r")
def m12(spark, d):
    known = F.array(F.lit("F"), F.lit("O"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a")).select("o_custkey", F.round(F.size(F.array_intersect("a", known)) / 2, 6).alias("coverage"))


@query("M13_all_variants_hit", "select o_custkey, bool_and(o_totalprice > 5000) as all_hit, bool_or(o_totalprice <= 5000) as any_miss from orders group by 1")
def m13(spark, d):
    hit = F.col("o_totalprice") > 5000
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_and(hit).alias("all_hit"), F.bool_or(~hit).alias("any_miss"))


@query("M14_miss_classes", f"with {QRELS_SQL} select case when query_id % 20 = 10 then 'absent' when best_rank is null or best_rank > 50 then 'candidate' when best_rank > 20 then 'rank' else 'hit20' end as class, count(*) as n from ranks group by 1")
def m14(spark, d):
    r = ranks(spark, d)
    return r.groupBy(metrics.miss_class(F.col("query_id") % 20 != 10, F.col("best_rank")).alias("class")).agg(F.count("*").alias("n"))


@query("M15_winner", "select l_returnflag as arm, round(avg(l_discount), 6) as score from lineitem group by 1 order by score desc, arm limit 1")
def m15(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(F.round(F.avg("l_discount"), 6).alias("score"))
    return g.orderBy(F.desc("score"), "arm").limit(1)


@query("M16_latency_summary", "select event_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(max(value), 6) as worst from events group by 1")
def m16(spark, d):
    r = lambda c, n: F.round(c, 6).alias(n)
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), r(F.avg("value"), "mean"), r(F.percentile("value", 0.5), "p50"), r(F.percentile("value", 0.95), "p95"), r(F.max("value"), "worst"))


@query("M17_gate_table", f"with {QRELS_SQL}, {SECOND_SQL}, u as (select 'dense' as arm, best_rank from ranks union all select 'other', best_rank from b), m as ({summary_sql('u', 'arm')}) select arm, r10, mrr10, r10 >= 0.5 as pass, cast(row_number() over (order by r10 desc, mrr10 desc, arm) as integer) as place from m")
def m17(spark, d):
    rows = ranks(spark, d).select(F.lit("dense").alias("arm"), "best_rank").unionByName(second(spark, d).select(F.lit("other").alias("arm"), F.col("best_rank").cast("int").alias("best_rank")))
    m = metrics.summary(rows, by=("arm",))
    return m.select("arm", "r10", "mrr10", (F.col("r10") >= 0.5).alias("pass"), F.row_number().over(Window.orderBy(F.desc("r10"), F.desc("mrr10"), "arm")).alias("place"))


@query("S5_rescue_harm", f"with {QRELS_SQL}, {SECOND_SQL}, j as (select coalesce(a.best_rank <= 1, false) as x, coalesce(b.best_rank <= 1, false) as y from ranks a join b using (query_id)) select round(avg(case when not x then y::int end), 6) as rescue_rate, round(avg(case when x then (not y)::int end), 6) as harm_rate from j")
def s5(spark, d):
    return metrics.rescue_and_harm(ranks(spark, d), second(spark, d), 1)


@query("S6_ann_overlap", f"with {DENSE_SQL}, l as (select query_id, doc_id from dense where rank <= 10), a as (select query_id, doc_id from dense where rank <= 10 and doc_id % 4 <> 0) select query_id, round(count(a.doc_id) / count(*)::double, 6) as overlap from l left join a using (query_id, doc_id) group by 1")
def s6(spark, d):
    run = dense(spark, d, 10)
    return metrics.overlap_at(run, run.filter("doc_id % 4 <> 0"), 10)


@query("O2_case_split", f"select o_orderkey, case when {training.hash_order_sql(7, 'o_orderkey')} % 10000 < 1000 then 'dev' else 'train' end as split from orders")
def o2(spark, d):
    return training.case_split(table(spark, d, "orders"), "o_orderkey", 0.1, 7).select("o_orderkey", "split")


@query(
    "O1_stratified_split",
    f"""with r as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by {training.hash_order_sql(42, 'c_custkey')}, c_custkey) as i, count(*) over (partition by c_mktsegment) as n from customer)
select c_custkey, case when i <= round(n * 0.1) then 'test' when i <= round(n * 0.1) + round(n * 0.05) then 'dev' else 'train' end as split from r""",
)
def o1(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("stratum"))
    return training.stratified_split(rows, "c_custkey", "stratum", {"test": 0.1, "dev": 0.05}, "train", 42).select("c_custkey", "split")


@query("O4_prefix_points", f"with {PLACES_SQL}, t as (select poi_id, name || ' ' || street as q from places), c as (select poi_id, q, [split_part(q, ' ', 1), array_to_string(string_split(q, ' ')[1:3], ' '), rtrim(substr(q, 1, greatest(4, cast(floor(length(q) * 0.6) as bigint))))] as p from t), u as (select distinct poi_id, q, unnest(p) as prefix from c) select poi_id, prefix, false as \"full\" from u where prefix <> q union all select poi_id, q, true from t")
def o4(spark, d):
    t = places(spark, d).select("poi_id", F.concat_ws(" ", "name", "street").alias("q"))
    return t.select("poi_id", F.explode(training.prefix_points(F.col("q"))).alias("p")).select("poi_id", "p.prefix", "p.full")


@query("O4_prefix_labels", f"with {PLACES_SQL}, t as (select poi_id as case_id, name as q from places), c as (select case_id, q, [split_part(q, ' ', 1), case when length(q) >= 8 then rtrim(substr(q, 1, greatest(4, cast(floor(length(q) * 0.6) as bigint)))) end] as p from t), u as (select distinct case_id, q, unnest(p) as prefix from c), a as (select case_id, prefix, false as f from u where prefix is not null and prefix <> q union all select case_id, q, true from t), n as (select distinct name from places), m as (select *, (select count(*) from n where starts_with(n.name, a.prefix)) as hits from a) select case_id, prefix, f as \"full\", case when f then 'positive' when length(prefix) <= 3 then 'ignore' when hits <= 1 then 'positive' when hits <= 20 then 'multi_positive' else 'ignore' end as label_state, round(1.0 / count(*) over (partition by case_id), 6) as sample_weight from m")
def o4b(spark, d):
    t = places(spark, d).select(F.col("poi_id").alias("case_id"), F.explode(training.prefix_points(F.col("name"))).alias("p"))
    return training.label_prefixes(t.select("case_id", "p.prefix", "p.full"), places(spark, d).select("name"))


@query("O5_hard_negatives", """with c as (select l_partkey as query_id, l_orderkey as doc_id, case l_returnflag when 'A' then 'lexical' when 'N' then 'dense' else 'random' end as source, min(l_linenumber + l_orderkey * 10) as rank from lineitem group by 1, 2, 3),
b as (select distinct l_partkey as query_id, l_orderkey as doc_id from lineitem where l_orderkey % 11 = 0), o as (select c.* from c anti join b using (query_id, doc_id)),
l as (select * from (select *, row_number() over (partition by query_id order by rank, doc_id) as i from o where source = 'lexical') where i <= 3),
d as (select * from (select *, row_number() over (partition by query_id order by rank, doc_id) as i from o anti join l using (query_id, doc_id) where source = 'dense') where i <= 3),
r as (select * from (select *, row_number() over (partition by query_id order by rank, doc_id) as i from o anti join l using (query_id, doc_id) anti join d using (query_id, doc_id) where source = 'random') where i <= 2),
u as (select *, 1 as p from l union all select *, 2 from d union all select *, 3 from r) select query_id, doc_id, source from (select *, row_number() over (partition by query_id order by p, rank, doc_id) as j from u) where j <= 7""")
def o5(spark, d):
    src = F.when(F.col("l_returnflag") == "A", "lexical").when(F.col("l_returnflag") == "N", "dense").otherwise("random")
    li = table(spark, d, "lineitem")
    c = li.select(F.col("l_partkey").alias("query_id"), F.col("l_orderkey").alias("doc_id"), src.alias("source"), (F.col("l_linenumber") + F.col("l_orderkey") * 10).alias("rank"))
    blocked = li.filter("l_orderkey % 11 = 0").select(F.col("l_partkey").alias("query_id"), F.col("l_orderkey").alias("doc_id")).distinct()
    return training.hard_negatives(c, blocked, {"lexical": 3, "dense": 3, "random": 2}, most=7).select("query_id", "doc_id", "source")


@query("O11_group_pairs", "with p as (select l_orderkey as query_id, 'p:' || l_partkey as doc_id, case l_returnflag when 'A' then 'positive' when 'N' then 'negative' else 'ignore' end as label from lineitem) select query_id, coalesce(string_agg(distinct case when label = 'positive' then doc_id end, '|' order by case when label = 'positive' then doc_id end), '') as positives, coalesce(string_agg(distinct case when label = 'negative' then doc_id end, '|' order by case when label = 'negative' then doc_id end), '') as negatives, coalesce(string_agg(distinct case when label = 'ignore' then doc_id end, '|' order by case when label = 'ignore' then doc_id end), '') as ignores from p group by 1")
def o11(spark, d):
    label = F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "N", "negative").otherwise("ignore")
    return training.group_pairs(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("doc_id"), label.alias("label")))


@query("O12_masked_loss", "with s as (select l_suppkey as query_id, l_discount * 100 as score, l_returnflag = 'A' as positive from lineitem where l_returnflag <> 'R'), t as (select query_id, max(score) as top from s group by 1) select query_id, round(ln(sum(exp(score - top))) - ln(sum(case when positive then exp(score - top) end)), 6) as loss from s join t using (query_id) group by 1")
def o12(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_discount") * 100).alias("score"), (F.col("l_returnflag") == "A").alias("positive"), (F.col("l_returnflag") == "R").alias("masked"))
    return training.masked_loss(s)


@query("O13_char_prefixes", f"with {PLACES_SQL}, n as (select distinct name from places) select name, n as idx, substr(name, 1, n) as prefix from (select name, unnest(range(1, length(name) + 1)) as n from n)")
def o13(spark, d):
    n = places(spark, d).select("name").distinct()
    return n.select("name", F.posexplode(T.edge_ngrams(F.col("name"), 200)).alias("i", "prefix")).select("name", (F.col("i") + 1).cast("long").alias("idx"), "prefix")


@query("O15_eligibility", "select l_returnflag as split, count(*) filter (where l_quantity >= 10 and l_discount > 0) as eligible, count(*) as n from lineitem group by 1")
def o15(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("split")).agg(F.count_if((F.col("l_quantity") >= 10) & (F.col("l_discount") > 0)).alias("eligible"), F.count("*").alias("n"))


@query("L7_brand_families", f"with {PLACES_SQL} select lower(regexp_replace(brand, '[^A-Za-z0-9]+', '', 'g')) as family_key, min(brand) as canonical, count(*) as n_members, 'brand:' || regexp_replace(lower(min(brand)), '[^a-z0-9]+', '_', 'g') as family_id from places group by 1")
def l7(spark, d):
    return identity.brand_families(places(spark, d)).select("family_key", "canonical", "n_members", "family_id")


@query("L8_membership_cascade", f"with {PLACES_SQL}, c as (select poi_id, brand, 4 as power, 'explicit' as evidence from places where k % 3 = 0 union all select poi_id, brand, 3, 'exact_name' from places where k % 2 = 0 union all select poi_id, brand, 1, 'stripped' from places), r as (select *, row_number() over (partition by poi_id order by power desc) as r from c) select poi_id, brand, evidence from r where r = 1")
def l8(spark, d):
    p = places(spark, d)
    part = lambda where, power, name: p.filter(where).select("poi_id", "brand", F.lit(power).alias("power"), F.lit(name).alias("evidence"))
    rows = part("k % 3 = 0", 4, "explicit").unionByName(part("k % 2 = 0", 3, "exact_name")).unionByName(part("true", 1, "stripped"))
    return R.keep_first(rows, ["poi_id"], [F.desc("power")]).select("poi_id", "brand", "evidence")


@query("L9_membership_status", f"with {PLACES_SQL}, g as (select brand, count(*) as n, count(*) filter (where destination_searchable) as strong from places group by 1) select brand, case when n < 2 then 'singleton' when strong < 2 then 'review' when brand like '%7' then 'generic' else 'accepted' end as status from g")
def l9(spark, d):
    g = places(spark, d).groupBy("brand").agg(F.count("*").alias("n"), F.count_if("destination_searchable").alias("strong"))
    return g.select("brand", F.when(F.col("n") < 2, "singleton").when(F.col("strong") < 2, "review").when(F.endswith("brand", F.lit("7")), "generic").otherwise("accepted").alias("status"))


@query("L11_group_summary", f"with {PLACES_SQL}, g as (select brand, category, count(*) as n, count(*) filter (where destination_searchable) as searchable from places group by 1, 2) select brand || ':' || category as group_id, n, searchable, cast(sum(n) over (partition by brand) as bigint) as family_size from g")
def l11(spark, d):
    g = places(spark, d).groupBy("brand", "category").agg(F.count("*").alias("n"), F.count_if("destination_searchable").alias("searchable"))
    return g.select(F.concat_ws(":", "brand", "category").alias("group_id"), "n", "searchable", F.sum("n").over(Window.partitionBy("brand")).alias("family_size"))


@query("L14_collision_payloads", f"with {PLACES_SQL}, r as (select name, poi_id, row_number() over (partition by name order by k) as i, count(*) over (partition by name) as n from places) select name, string_agg(poi_id, '|' order by i) as sample, max(n) > 5 as truncated from r where i <= 5 group by 1")
def l14(spark, d):
    w = Window.partitionBy("name")
    r = places(spark, d).select("name", "poi_id", F.row_number().over(w.orderBy("k")).alias("i"), F.count("*").over(w).alias("n"))
    s = F.transform(F.array_sort(F.collect_list(F.struct("i", "poi_id"))), lambda x: x["poi_id"])
    return r.filter("i <= 5").groupBy("name").agg(F.array_join(s, "|").alias("sample"), (F.max("n") > 5).alias("truncated"))


@query("L16_protected_ids", f"with {PLACES_SQL}, u as (select poi_id, 1 as tier from places where k % 5 = 0 union all select poi_id, 2 from places where k % 3 = 0) select poi_id, min(tier) as tier from u group by 1")
def l16(spark, d):
    p = places(spark, d)
    u = p.filter("k % 5 = 0").select("poi_id", F.lit(1).alias("tier")).unionByName(p.filter("k % 3 = 0").select("poi_id", F.lit(2).alias("tier")))
    return u.groupBy("poi_id").agg(F.min("tier").alias("tier"))


@query("L2_duplicate_pairs", f"with {PLACES_SQL} select a.poi_id as id, b.poi_id as id2, case when a.name = b.name then 'exact_fold' else 'levenshtein' end as name_reason, 'same_house_and_street' as address_reason from places a join places b on a.poi_id < b.poi_id and a.housenumber = b.housenumber and a.street = b.street and (a.name = b.name or (least(length(a.name), length(b.name)) >= 6 and abs(length(a.name) - length(b.name)) <= 3 and 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))::double >= 0.88)) where {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} < 3000")
def l2(spark, d):
    p = places(spark, d)
    own = p.select(F.col("poi_id").alias("id"), "name", "housenumber", "street", "lat", "lon")
    other = own.select(F.col("id").alias("id2"), F.col("name").alias("name2"), "housenumber", "street", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    # names are compared once for each pair of them that an address has, and only similar ones meet
    names = own.select("housenumber", "street", "name").distinct()
    # written, so that the comparison is not planned below the distinct
    similar = reliable(names.join(names.withColumnRenamed("name", "name2").hint("merge"), ["housenumber", "street"]).select("name", "name2").distinct())
    similar = similar.withColumn("name_reason", T.name_similarity(F.col("name"), F.col("name2"))).filter("name_reason is not null")
    rows = own.join(similar, "name").join(other.hint("merge"), ["housenumber", "street", "name2"]).filter("id < id2")
    m = geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"), geo.CLEANING)
    h, s = T.clean_housenumber(F.col("housenumber")), T.clean_street(F.col("street"))
    rows = rows.filter(m < 3000).withColumn("address_reason", identity.address_reason(h, s, h, s))
    return rows.filter("name_reason is not null").select("id", "id2", "name_reason", "address_reason")


@query("E11_greedy_keepers")
def e11(spark, d):
    return identity.near_keepers(places(spark, d).select(F.col("poi_id").alias("id"), F.col("k").alias("priority"), "lat", "lon"), 50.0)


@query("L4_migration_table")
def l4(spark, d):
    p = places(spark, d).withColumn("province", F.when(F.col("k") % 23 != 0, F.lit("Hanoi")))
    return identity.clean_corpus(p, [(~F.col("destination_searchable")).cast("int"), F.col("k")], metres=60.0)


#: Members of brand groups, with faults in some: column -> SQL over part, portable between both engines.
MEMBERS = {
    "poi_id": "concat('p:', cast(p_partkey as string))",
    "brand_family_id": "concat('brand:', lower(replace(p_brand, '#', '_')))",
    "brand_namespace": "case when p_partkey % 103 = 0 then 'spa' when p_partkey % 89 = 0 then 'other_reviewed' when p_partkey % 4 = 0 then 'cafe' when p_partkey % 4 = 1 then 'hotel' when p_partkey % 4 = 2 then 'bank' else 'retail' end",
    "brand_canonical": "p_brand",
    "brand_fold": "case when p_partkey % 109 = 0 then upper(p_brand) else lower(p_brand) end",
    "destination_searchable": "(p_size % 10) <> 0",
    "membership_status": "case when p_partkey % 113 = 0 then 'pending' when p_partkey % 7 = 3 then 'needs_review' when p_partkey % 7 = 5 then 'excluded' else 'accepted' end",
    "review_status": "case when p_partkey % 131 = 0 then 'odd' when p_partkey % 127 = 0 or p_partkey % 7 = 3 then 'needs_review' else 'accepted' end",
    "group_version": "case when p_partkey % 137 = 0 then 'v0' else 'v1' end",
}
MEMBERS_SQL = "m as (select *, case when poi_id like '%77' then 'x' else concat(brand_family_id, ':', brand_namespace) end as brand_group_id from (select " + ", ".join(f"{x} as {n}" for n, x in MEMBERS.items()) + " from part))"


def members(spark, d):
    rows = table(spark, d, "part").selectExpr(*[f"{x} as {n}" for n, x in MEMBERS.items()])
    return rows.withColumn("brand_group_id", F.when(F.col("poi_id").like("%77"), "x").otherwise(F.concat_ws(":", "brand_family_id", "brand_namespace")))


@query(
    "P3_release_rules",
    f"""with {MEMBERS_SQL}, ok as (select * from m where membership_status = 'accepted')
select 'known_namespace' as rule, poi_id as key from m where brand_namespace not in ('atm', 'bank', 'fuel', 'cafe', 'restaurant', 'convenience_store', 'supermarket', 'pharmacy', 'hotel', 'retail', 'other_reviewed')
union all select 'known_membership_status', poi_id from m where membership_status not in ('accepted', 'needs_review', 'excluded')
union all select 'known_review_status', poi_id from m where review_status not in ('authored', 'accepted', 'needs_review')
union all select 'member_version', poi_id from m where group_version <> 'v1'
union all select 'group_is_family_and_namespace', poi_id from m where brand_group_id <> brand_family_id || ':' || brand_namespace
union all select 'fold_of_canonical', poi_id from m where brand_fold <> lower(brand_canonical)
union all select 'accepted_is_searchable', poi_id from ok where not destination_searchable
union all select 'accepted_is_reviewed', poi_id from ok where review_status = 'needs_review'
union all select 'accepted_has_a_namespace', poi_id from ok where brand_namespace = 'other_reviewed'
union all select 'accepted_group_of_two', brand_group_id from ok group by brand_group_id having count(*) < 2
union all select 'one_row_a_member', brand_group_id || '|' || poi_id from m group by brand_group_id, poi_id having count(*) > 1
union all select 'explicit_family', brand_family_id from m where brand_family_id like '%7' group by brand_family_id""",
)
def p3(spark, d):
    m = members(spark, d)
    families = m.select("brand_family_id").distinct().select("brand_family_id", F.when(F.col("brand_family_id").like("%7"), "derived").otherwise("explicit_brand").alias("candidate_source"), F.lit("v1").alias("group_version"))
    return validators.brand_members(m, families, "v1")


@query("P4_foreign_keys", "select 'customer_exists' as rule, cast(o_custkey as varchar) as key from orders where o_custkey not in (select c_custkey from customer where c_custkey % 9 <> 0)")
def p4(spark, d):
    return checks.foreign_key(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").filter("c_custkey % 9 <> 0"), "c_custkey", "customer_exists")


@query("P5_group_sizes", "select 'lines_per_order' as rule, cast(l_orderkey as varchar) as key from lineitem group by l_orderkey having count(*) < 2 or count(*) > 6")
def p5(spark, d):
    return checks.group_size(table(spark, d, "lineitem"), "l_orderkey", 2, 6, "lines_per_order")


@query("P8_split_leaks", "with s as (select lower(text) as key, case when doc_id % 10 < 8 then 'train' else 'test' end as split from documents) select md5(key) as key, string_agg(distinct split, '|' order by split) as splits from s group by 1 having count(distinct split) > 1")
def p8(spark, d):
    s = table(spark, d, "documents").select("text", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test").alias("split"))
    return checks.cross_split_leaks(s, F.md5(F.lower("text")), "split")


@query("P10_coverage_quotas", "select event_type, count(*) as n, cast(2200 as bigint) as least from events group by 1 having count(*) < 2200")
def p10(spark, d):
    e = table(spark, d, "events")
    minima = e.select("event_type").distinct().withColumn("least", F.lit(2200).cast("long"))
    return checks.quotas(e, "event_type", minima).select("event_type", "n", "least")


@query("P12_ambiguous_queries", f"with {PLACES_SQL}, g as (select name, street, string_agg(poi_id, '|' order by poi_id) as ids from places group by 1, 2) select name as query, count(distinct ids) as n_sets from g group by 1 having count(distinct ids) > 1")
def p12(spark, d):
    g = places(spark, d).groupBy("name", "street").agg(F.collect_list("poi_id").alias("ids"))
    return checks.ambiguous_queries(g, T.normalized(F.col("name")), F.col("ids"))


@query("P_verdicts", f"with {PLACES_SQL}, e as (select 'brand_shape' as rule from places where not regexp_matches(brand, '^Brand#[0-9]$') union all select 'size_range' from places where cast(housenumber as integer) > 50), n as (select unnest(['brand_shape', 'size_range', 'searchable_known']) as rule) select rule, count(e.rule) as n, case when count(e.rule) = 0 then 'PASS' else 'FAIL' end as verdict from n left join e using (rule) group by 1")
def p_verdicts(spark, d):
    rules = {"brand_shape": F.col("brand").rlike("^Brand#[0-9]$"), "size_range": F.col("housenumber").cast("int") <= 50, "searchable_known": F.col("destination_searchable").isNotNull()}
    return checks.verdict(checks.row_rules(places(spark, d), F.col("poi_id"), rules), list(rules))
