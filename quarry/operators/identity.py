"""Greedy keeper selection, spatial dedup and brand resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.geo import Grid, near_pairs
from quarry.sources.shared import reliable


def keepers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, keeper): each node kept, or given to its best kept neighbour; equal to going through nodes by priority.

    nodes: id, priority (unique, smaller first); edges: a, b, each pair once. In rounds, a node is kept if it comes
    before all its undecided neighbours, and its neighbours are then settled. The number of rounds follows the longest
    decreasing chain, not the table; each round is checkpointed and only a count comes to the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    p = nodes.select("id", "priority")
    both = reliable(both.join(p.select(F.col("id").alias("a"), F.col("priority").alias("pa")), "a").join(p.select(F.col("id").alias("b"), F.col("priority").alias("pb")), "b"))
    state = reliable(both.select(F.col("a").alias("id"), F.col("pa").alias("priority")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        open_ = state.filter("kept is null").select("id")
        live = both.join(open_.withColumnRenamed("id", "a"), "a", "left_semi").join(open_.withColumnRenamed("id", "b"), "b", "left_semi")
        first = live.groupBy("a").agg(F.min("pb").alias("best")).withColumnRenamed("a", "id")
        step = state.join(first, "id", "left").withColumn("now", F.col("kept").isNull() & (F.col("best").isNull() | (F.col("priority") < F.col("best"))))
        step = reliable(step.select("id", "priority", "kept", "now"))
        lost = live.join(step.filter("now").select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).distinct().withColumn("lost", F.lit(True))
        state = reliable(step.join(lost, "id", "left").select("id", "priority", F.when(F.col("now"), True).when(F.col("lost"), False).otherwise(F.col("kept")).alias("kept")))
        if not state.filter("kept is null").limit(1).count():
            break
    kept = state.filter("kept").select(F.col("id").alias("b"))
    best = both.join(kept, "b", "left_semi").groupBy("a").agg(F.min(F.struct("pb", "b")).alias("k")).select(F.col("a").alias("id"), F.col("k.b").alias("own"))
    return nodes.select("id").join(state.select("id", "kept"), "id", "left").join(best, "id", "left").select("id", F.when(F.coalesce("kept", F.lit(True)), F.col("id")).otherwise(F.col("own")).alias("keeper"))


def near_keepers(nodes: DataFrame, metres: float) -> DataFrame:
    """(id, keeper) as `keepers` has it, neighbours being all nodes nearer than `metres`, without a table of their pairs.

    nodes: id, priority (unique, smaller first), lat, lon; one without finite coordinates has no neighbours. In rounds, the
    first undecided node of each quarter of a grid cell is kept if no undecided node near it comes before it, and those near
    it are then settled. So a node meets a few firsts of a round and the kept nodes around it, however many lie near.
    """
    grid = Grid(metres)
    points = nodes.select("id", "priority", "lat", "lon")
    ends = lambda df: df.select(*[F.col(c).alias(f"{c}2") for c in points.columns])
    halves = [F.floor(F.col("lat") / grid.size * 2).alias("_i"), F.floor((F.col("lon") + 180) / 360 * grid.columns(F.col("r")) * 2).alias("_j")]
    open_ = reliable(grid.home(points, "lat", "lon").drop("r", "c"))
    kept = open_.limit(0)
    while open_.limit(1).count():
        firsts = grid.home(open_, "lat", "lon").groupBy("r", "c", *halves).agg(F.min_by(F.struct(*points.columns), "priority").alias("f")).select("f.*")
        later = near_pairs(firsts, ends(open_), metres).filter("priority2 < priority").select("id").distinct()
        now = reliable(firsts.join(later.hint("merge"), "id", "left_anti"))
        kept = kept.unionByName(now)
        settled = near_pairs(now, ends(open_), metres).select(F.col("id2").alias("id")).distinct()
        open_ = reliable(open_.join(settled.hint("merge"), "id", "left_anti"))
    best = near_pairs(kept, ends(points), metres).groupBy(F.col("id2").alias("id")).agg(F.min_by("id", "priority").alias("keeper"))
    return nodes.select("id").join(best.hint("merge"), "id", "left").select("id", F.coalesce("keeper", "id").alias("keeper"))


def address_reason(h1: Column, s1: Column, h2: Column, s2: Column) -> Column:
    """Why two cleaned addresses may be one place, or null."""
    no_h, no_s = h1.isNull() & h2.isNull(), s1.isNull() & s2.isNull()
    clash = (s1.isNotNull() & s2.isNotNull() & (s1 != s2)) | (h1.isNotNull() & h2.isNotNull() & (h1 != h2))
    one_h, one_s = h1.isNull() != h2.isNull(), s1.isNull() != s2.isNull()
    return (
        F.when(clash, F.lit(None).cast("string"))
        .when(no_h & no_s, "both_no_address")
        .when(no_h & ~no_s & ~one_s, "same_street_no_housenumber")
        .when(one_h & ~one_s, "one_house_street_compatible")
        .when(~one_h & ~one_s, "same_house_and_street")
        .when(one_s, "one_street_compatible")
    )


def duplicate_pairs(places: DataFrame, metres: float = 50.0) -> DataFrame:
    """Pairs nearer than `metres` with similar names and compatible addresses: id < id2, distance_m, both reasons.

    Every pair under the distance is compared, also across cells in either direction. Names are compared once for each
    pair of them that neighbouring cells hold, and only places of similar names meet.
    """
    cols = {"name": "name", "h": "h", "s": "s"}
    own = places.select(F.col("poi_id").alias("id"), "lat", "lon", "name", T.clean_housenumber(F.col("housenumber")).alias("h"), T.clean_street(F.col("street")).alias("s"))
    other = own.select(F.col("id").alias("id2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), *[F.col(c).alias(f"{c}2") for c in cols])
    grid = Grid(metres)
    names = grid.around(own, "lat", "lon").select("name", "r", "c").distinct()
    names = names.join(grid.home(other, "lat2", "lon2").select("name2", "r", "c").distinct().hint("merge"), ["r", "c"]).select("name", "name2").distinct()
    # written, so that the comparison is not planned below the distinct
    similar = reliable(names).withColumn("name_reason", T.name_similarity(F.col("name"), F.col("name2"))).filter("name_reason is not null")
    pairs = near_pairs(own.join(similar, "name"), other, metres, on=("name2",)).filter("id < id2")
    pairs = pairs.withColumns({"address_reason": address_reason(F.col("h"), F.col("s"), F.col("h2"), F.col("s2"))})
    return pairs.filter("name_reason is not null and address_reason is not null").select("id", "id2", "distance_m", "name_reason", "address_reason")


def clean_corpus(places: DataFrame, priority: list[Column], metres: float = 50.0) -> DataFrame:
    """Migration table: old_poi_id, canonical_poi_id, action (keep, merge, drop), reason."""
    junk = places.withColumn("reason", T.junk_reason(F.col("name"), F.col("province")))
    good = junk.filter("reason is null")
    nodes = good.select(F.col("poi_id").alias("id"), F.struct(*priority, F.col("poi_id")).alias("priority"))
    pairs = reliable(duplicate_pairs(good, metres))
    owner = keepers(nodes, pairs.select(F.col("id").alias("a"), F.col("id2").alias("b")))
    both = pairs.select("id", F.col("id2").alias("keeper"), "address_reason").unionByName(pairs.select(F.col("id2").alias("id"), F.col("id").alias("keeper"), "address_reason"))
    out = owner.join(both, ["id", "keeper"], "left").select(F.col("id").alias("old_poi_id"), F.col("keeper").alias("canonical_poi_id"), F.when(F.col("id") == F.col("keeper"), "keep").otherwise("merge").alias("action"), F.col("address_reason").alias("reason"))
    return out.unionByName(junk.filter("reason is not null").select(F.col("poi_id").alias("old_poi_id"), F.lit(None).cast("string").alias("canonical_poi_id"), F.lit("drop").alias("action"), "reason"))


def brand_families(places: DataFrame) -> DataFrame:
    """family_key, canonical name (mode), stable id: brand:slug, with a hash suffix where slugs clash, n_members."""
    keyed = places.filter("brand is not null and brand <> ''").withColumn("family_key", T.match_key(F.col("brand")))
    counts = keyed.groupBy("family_key", "brand").agg(F.count("*").alias("n"))
    order = Window.partitionBy("family_key").orderBy(F.desc("n"), T.normalized(F.col("brand")), "brand")
    best = counts.withColumn("_r", F.row_number().over(order)).groupBy("family_key").agg(F.max(F.when(F.col("_r") == 1, F.col("brand"))).alias("canonical"), F.sum("n").alias("n_members"))
    slug = T.ascii_slug(F.col("canonical"))
    clash = F.count("*").over(Window.partitionBy("slug")) > 1
    return best.withColumn("slug", slug).withColumn("family_id", F.concat(F.lit("brand:"), "slug", F.when(clash, F.concat(F.lit("_"), F.substring(F.sha1("family_key"), 1, 8))).otherwise(""))).drop("slug")


def lookup_scores(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Exact key 100 (accepted), 80 (review), 50, 10 by status; stripped key 90, 70, 40, 5. The best is primary.

    queries: query_id, exact_key, stripped_key; index: key, group_id, status.
    """
    points = lambda a: F.when(F.col("status") == "accepted", a[0]).when(F.col("status") == "review", a[1]).when(F.col("status") == "excluded", a[3]).otherwise(a[2])
    exact = queries.join(index, F.col("exact_key") == F.col("key")).select("query_id", "group_id", points((100, 80, 50, 10)).alias("score"))
    stripped = queries.filter("stripped_key <> exact_key").join(index, F.col("stripped_key") == F.col("key")).select("query_id", "group_id", points((90, 70, 40, 5)).alias("score"))
    rows = exact.unionByName(stripped).groupBy("query_id", "group_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id")
    top = F.max("score").over(w)
    rows = rows.withColumn("is_primary", F.col("score") == top)
    return rows.withColumn("ambiguous", F.sum(F.col("is_primary").cast("int")).over(w) > 1)


def representatives(rows: DataFrame, group: str, protected: list[DataFrame]) -> DataFrame:
    """The row that stands for each group.

    First rows of protected ids (columns poi_id; the first table before the second), then access points to be kept, named
    categories before bare addresses and buildings, rows with a house number, a street, a direct address, aliases, nodes
    before ways, and the smallest id. rows: poi_id, preserve_individual_access_point, category, housenumber, street,
    address_status, aliases, osm_type.
    """
    for i, ids in enumerate(protected):
        rows = rows.join(ids.select("poi_id").distinct().withColumn(f"_in{i}", F.lit(True)), "poi_id", "left")
    category = F.coalesce("category", F.lit(""))
    known = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    signs = [F.col(f"_in{i}") for i in range(len(protected))]
    signs += [F.col("preserve_individual_access_point"), ~(F.startswith(category, F.lit("address=")) | F.startswith(category, F.lit("building="))), known("housenumber"), known("street")]
    signs += [F.col("address_status") == "direct", F.size("aliases") > 0, F.col("osm_type") == "node"]
    order = F.struct(*[(~F.coalesce(x, F.lit(False))).alias(f"k{i}") for i, x in enumerate(signs)], F.col("poi_id").alias("id"))
    best = rows.groupBy(group).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns if c != group and not c.startswith("_in")]), order).alias("_best"))
    return best.select(group, "_best.*")
