"""Inverted index, BM25, dense search, fusion and candidate operators. Batch forms keyed by query_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.geo import SERVING, Grid, haversine
from quarry.sources.shared import reliable


def simple_tokens(c: Column) -> Column:
    return F.regexp_extract_all(T.fold(c), F.lit("[a-z0-9]+"), F.lit(0))


class Index:
    """Postings, document lengths and corpus statistics of one text column.

    The statistics are one row; document frequencies are a table and are joined on the term. postings carries tf, so a
    term of every document is as many rows as documents and is never gathered. An index is computed from documents where
    it is asked, or written once (`store`) and opened again (`open`).
    """

    #: Parts that the postings are stored in, by their term.
    PARTS = 64

    def __init__(self, postings: DataFrame, stats: DataFrame, frequencies: DataFrame):
        self.postings, self.stats, self.frequencies = postings, stats, frequencies

    @classmethod
    def of(cls, docs: DataFrame, id_col: str, text_col: str, tokens=simple_tokens) -> Index:
        tok = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("toks"))
        lengths = tok.select("doc_id", F.size("toks").alias("dl"))
        # the outer form keeps the planner from testing, and so computing, the tokens a second time
        terms = tok.select("doc_id", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term")).filter("term is not null")
        postings = terms.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")).withColumn("part", cls.part(F.col("term")))
        stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
        return cls(postings, stats, postings.groupBy("part", "term").agg(F.count("*").alias("df")))

    @classmethod
    def part(cls, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(cls.PARTS)).cast("int")

    def store(self, folder: str) -> None:
        """Writes the tables, postings and frequencies in folders by part and the postings' rows in order of their term, so
        that a query's terms open a few parts and, in them, a few row groups. A part of a frequent term is many files."""
        spark = self.postings.sparkSession
        rows = self.postings.repartition("part", F.pmod(F.xxhash64("doc_id"), F.lit(4))).sortWithinPartitions("part", "term", "doc_id")
        rows.write.partitionBy("part").parquet(f"{folder}/postings")
        stored = spark.read.schema(self.postings.schema).parquet(f"{folder}/postings")
        stored.groupBy("part", "term").agg(F.count("*").alias("df")).repartition("part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{folder}/frequencies")
        kind = F.lit(None).cast(self.postings.schema["doc_id"].dataType)  # an index without postings has no file that says it
        self.stats.withColumn("doc_id", kind).write.parquet(f"{folder}/stats")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        stats = spark.read.parquet(f"{folder}/stats")
        kind = stats.schema["doc_id"].dataType.simpleString()
        postings = spark.read.schema(f"term string, doc_id {kind}, tf long, dl int, part int").parquet(f"{folder}/postings")
        frequencies = spark.read.schema("term string, df long, part int").parquet(f"{folder}/frequencies")
        return cls(postings, stats.drop("doc_id"), frequencies)

    def hits(self, terms: DataFrame) -> DataFrame:
        """The postings of the terms of a table, opened by part."""
        wanted = terms.select("term").distinct().withColumn("part", self.part(F.col("term")))
        return self.postings.join(wanted, ["part", "term"], "left_semi")

    def weights(self, terms: DataFrame) -> DataFrame:
        """The terms with the document frequencies of those that any document has, by part, and the statistics."""
        df = terms.withColumn("part", self.part(F.col("term"))).join(self.frequencies, ["part", "term"])
        return df.crossJoin(F.broadcast(self.stats))  # one row


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def query_terms(queries: DataFrame, id_col: str, text_col: str, first: int | None = None, tokens=simple_tokens) -> DataFrame:
    """(query_id, term, qtf): a repeated query token counts as often as it stands there."""
    toks = tokens(F.col(text_col))
    if first:
        toks = F.slice(toks, 1, first)
    return queries.select(F.col(id_col).alias("query_id"), F.explode(toks).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25(index: Index, terms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, n_terms) over the postings of the query terms alone.

    Query terms carry their weights to the postings, which are joined by part and term: parts without a query term are not
    read. A hot term's postings are split by the adaptive skew join where the query terms are too many to be sent along.
    """
    weighted = index.weights(terms).select("part", "term", "query_id", "qtf", "avgdl", idf(F.col("n_docs"), F.col("df")).alias("idf"))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hits = index.postings.join(weighted, ["part", "term"])
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * tf), 6).alias("score"), F.count("*").alias("n_terms"))


def ranked(scores: DataFrame, k: int | None = None, by: tuple[str, ...] = ("query_id",), doc: str = "doc_id") -> DataFrame:
    """Rank from 1 by score, ties to the smaller id; the first k of each query."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(doc))))
    return out.filter(F.col("rank") <= k) if k else out


class FieldIndex:
    """Postings of several weighted text columns in one table, so that documents are read and counted once. A row with a
    column `times` stands for so many documents of its texts."""

    def __init__(self, docs: DataFrame, id_col: str, weights: dict[str, float], tokens=simple_tokens):
        """tokens: a function of a column, or one for each column."""
        own = tokens if isinstance(tokens, dict) else dict.fromkeys(weights, tokens)
        cells = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(float(w)).alias("weight"), own[c](F.col(c)).alias("toks")) for c, w in weights.items()])
        times = (F.col("times") if "times" in docs.columns else F.lit(1)).cast("long").alias("times")
        rows = docs.select(F.col(id_col).alias("doc_id"), times, F.explode(cells).alias("c")).select("doc_id", "times", "c.field", "c.weight", "c.toks", F.size("c.toks").alias("dl"))
        self.stats = rows.groupBy("field").agg(F.sum("times").alias("n_docs"), (F.sum(F.col("dl") * F.col("times")) / F.sum("times")).alias("avgdl"))
        terms = rows.select("doc_id", "times", "field", "weight", "dl", F.explode_outer("toks").alias("term")).filter("term is not null")
        self.postings = terms.groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.first("weight").alias("weight"), F.first("times").alias("times"))


def field_bm25(index: FieldIndex, terms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Sum over fields of weight times BM25; candidates are documents with a query term in any field."""
    hits = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("field", "term").agg(F.sum("times").alias("df"))
    # a row for each field
    weighted = terms.join(df, "term").join(F.broadcast(index.stats), "field").select("query_id", "field", "term", "qtf", "avgdl", idf(F.col("n_docs"), F.col("df")).alias("idf"))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.hint("merge").join(weighted, ["field", "term"]).groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("qtf") * F.col("idf") * tf), 6).alias("score"))


def boosted(scores: DataFrame, queries: DataFrame, docs: DataFrame, name: float = 25.0, cover: float = 8.0) -> DataFrame:
    """Adds boosts to BM25 scores: equal folded names, and all query tokens in the document.

    queries: query_id, q_name (folded), q_tokens; docs: doc_id, d_name (folded), d_tokens.
    """
    out = scores.join(queries, "query_id").join(docs, "doc_id")
    exact = F.when(F.col("q_name") == F.col("d_name"), name).otherwise(0.0)
    covered = F.when(F.size(F.array_except("q_tokens", "d_tokens")) == 0, cover).otherwise(0.0)
    return out.select("query_id", "doc_id", F.round(F.col("score") + exact + covered, 6).alias("score"))


def minimum_should_match(terms: DataFrame, postings: DataFrame, share: float = 0.5) -> DataFrame:
    """Documents that hold at least floor(share * n) (at least one) of a query's distinct terms."""
    need = terms.groupBy("query_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).cast("long").alias("need"))
    got = terms.join(postings.select("term", "doc_id"), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("n_terms"))
    return got.join(need, "query_id").filter("n_terms >= need").select("query_id", "doc_id", "n_terms")


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, blocks: int | None = None, decimals: int = 6) -> DataFrame:
    """Exact inner-product top-k, ties to the smaller id. vectors: doc_id, v; queries: query_id, q.

    The stated query set meets all vectors in blocks: query vectors are copied to each of `blocks` groups of vectors (16, or
    as many as the vectors have partitions), an
    equi-join pairs them, and each group keeps k rows a query before the rows of a query come together.
    """
    blocks = blocks or max(16, vectors.rdd.getNumPartitions())
    v = vectors.withColumn("_g", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    q = queries.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = v.join(q, "_g").select("query_id", "doc_id", "_g", F.round(dot, decimals).alias("score"))
    first = ranked(scored, k, ("query_id", "_g"))
    return ranked(first.drop("rank", "_g"), k)


def reciprocal_rank_fusion(branches: list[DataFrame], c: int = 60, depth: int = 50) -> DataFrame:
    """(query_id, doc_id, rrf, best_rank, rank) of branches (query_id, doc_id, rank); ties by best rank, then id."""
    rows = None
    for b in branches:
        own = b.select("query_id", "doc_id", "rank").filter(F.col("rank") <= depth)
        rows = own if rows is None else rows.unionByName(own)
    fused = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("rrf"), F.min("rank").alias("best_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "best_rank", "doc_id")
    return fused.withColumn("rank", F.row_number().over(order))


def branch_evidence(lexical: DataFrame, dense: DataFrame, c: int = 60) -> DataFrame:
    """Ranks of both branches, null where a branch lacks the document, and their fused score."""
    left = lexical.select("query_id", "doc_id", F.col("rank").alias("lexical_rank"))
    right = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"))
    part = lambda r: F.coalesce(1.0 / (c + F.col(r)), F.lit(0.0))
    return left.join(right, ["query_id", "doc_id"], "full").withColumn("rrf", F.round(part("lexical_rank") + part("dense_rank"), 9))


def route(queries: DataFrame, text_col: str, least: int = 5) -> DataFrame:
    """Short queries go to the lexical branch alone."""
    n = T.compact_length(F.col(text_col))
    return queries.withColumn("compact_len", n).withColumn("route", F.when(n < least, "lexical_only").otherwise("hybrid"))


def degrade(branches: DataFrame) -> DataFrame:
    """route, lexical_ok, dense_ok -> served branch, reason and status."""
    lex, dense, short = F.col("lexical_ok"), F.col("dense_ok"), F.col("route") == "lexical_only"
    served = F.when(short & lex, "lexical").when(lex & dense, "hybrid").when(lex, "lexical").when(~short & dense, "dense")
    reason = F.when(short & lex, "short_query").when(lex & dense, "ok").when(lex, "dense_failed").when(~short & dense, "lexical_failed").otherwise("all_failed")
    return branches.withColumns({"served": served, "reason": reason, "status": F.when(served.isNull(), 503).otherwise(200)})


def nearby_rescue(anchors: DataFrame, places: DataFrame, metres: float = 5000.0, keep: int = 15, least: int = 3) -> DataFrame:
    """Places near an anchor whose folded name equals or begins with the anchor's query; the nearest `keep`.

    anchors: query_id (unique), q_fold, lat, lon; places: doc_id, name_fold, lat, lon. Both conditions are in the join's
    key: the grid cells that an anchor's circle may touch, and the whole query, which meets the beginnings of names of the
    lengths that queries have (one number each comes to the driver). So only pairs that match by name and lie near are made.

    Circles grow fourfold in rounds up to `metres`. An anchor with `keep` places in its circle is done, as no place outside
    is nearer, and only the others go on; of places at one point `keep` are enough.
    """
    a = anchors.filter(F.char_length("q_fold") >= least).select("query_id", "lat", "lon", F.col("q_fold").alias("_p"))
    lengths = sorted(r[0] for r in a.select(F.char_length("_p")).distinct().collect())
    begins = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.char_length("name_fold"))
    p = places.select("doc_id", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.explode(F.transform(begins, lambda n: F.substring("name_fold", F.lit(1), n))).alias("_p"))
    p = p.join(a.select("_p").distinct(), "_p", "left_semi")
    at_point = Window.partitionBy("_p", "lat2", "lon2").orderBy("doc_id")
    p = reliable(p.withColumn("_i", F.row_number().over(at_point)).filter(F.col("_i") <= keep).drop("_i"))
    d = haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"), SERVING)
    order = Window.partitionBy("query_id").orderBy("distance_m", "doc_id")
    out = None
    for within in [metres / 4**i for i in range(4, -1, -1)]:
        grid = Grid(within, radius=SERVING)
        hits = grid.around(a, "lat", "lon").join(grid.home(p, "lat2", "lon2").hint("merge"), ["r", "c", "_p"]).withColumn("distance_m", d).filter(F.col("distance_m") <= within)
        hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep).select("query_id", "doc_id", "distance_m", "rank")
        if within < metres:
            hits = reliable(hits)
            full = hits.filter(F.col("rank") == keep).select("query_id")
            a, hits = reliable(a.join(full.hint("merge"), "query_id", "left_anti")), hits.join(full.hint("merge"), "query_id", "left_semi")
        out = hits if out is None else out.unionByName(hits)
    return out


def merge_rescue(fused: DataFrame, rescued: DataFrame, c: int = 60) -> DataFrame:
    """Rescued ids not yet present go before the fused ones with scores just above the best of them."""
    new = rescued.join(fused.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("rank")
    new = new.withColumn("pos", F.row_number().over(order)).withColumn("n_new", F.count("*").over(Window.partitionBy("query_id")))
    best = fused.groupBy("query_id").agg(F.max("rrf").alias("best"))
    base = F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(1.0 / (c + 1)))
    rows = new.join(best, "query_id", "left").select("query_id", "doc_id", F.round(base + (F.col("n_new") - F.col("pos") + 1) * 1e-6, 9).alias("rrf"), F.lit(True).alias("nearby_rescue"))
    both = rows.unionByName(fused.select("query_id", "doc_id", "rrf", F.lit(False).alias("nearby_rescue")))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("nearby_rescue"), F.desc("rrf"), "doc_id")))


def and_postings(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Documents that hold every term of the query: relational division."""
    need = terms.groupBy("query_id").agg(F.count("*").alias("need"))
    got = terms.join(postings.select("term", "doc_id"), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("got"))
    return got.join(need, "query_id").filter("got = need").select("query_id", "doc_id")


def cells(vectors: DataFrame, centroids: list[tuple[int, list[float]]], probes: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, cell) for each of the `probes` nearest centroids by inner product, ties to the smaller number."""
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.lit(float(x)) for x in c]).alias("c")) for i, c in centroids])
    dot = lambda c: F.aggregate(F.zip_with(F.col(vec_col), c, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    near = F.slice(F.array_sort(F.transform(table, lambda t: F.struct((-dot(t["c"])).alias("d"), t["i"].alias("i")))), 1, probes)
    placed = vectors.withColumn("_cells", F.transform(near, lambda x: x["i"]))
    return placed.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.explode("_cells").alias("cell"))


def ann_top_k(vectors: DataFrame, queries: DataFrame, k: int, n_cells: int = 16, probes: int = 6) -> DataFrame:
    """Approximate inner-product top-k over an inverted file: a vector lies in its nearest cell, a query visits `probes`.

    The centroids are the `n_cells` vectors that come first in a hash order, the only sample; every vector is indexed.
    vectors: doc_id, v; queries: query_id, q.
    """
    chosen = vectors.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_cells).collect()  # n_cells rows
    centroids = [(i, list(r["v"])) for i, r in enumerate(chosen)]
    homes = cells(vectors, centroids, 1, "doc_id", "v").select(F.col("id").alias("doc_id"), "v", "cell")
    asked = cells(queries, centroids, probes, "query_id", "q").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "cell")
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = homes.join(asked, "cell").select("query_id", "doc_id", F.round(dot, 6).alias("score"))
    return ranked(scored, k)


def fuzzy_terms(terms: DataFrame, vocabulary: DataFrame, edits: int = 1, prefix: int = 1, least: int = 4) -> DataFrame:
    """(query_id, term, match): vocabulary terms of letters within `edits` of a query term, with an equal beginning as
    the join key."""
    q = terms.filter(F.col("term").rlike(rf"^\p{{L}}{{{least},}}$")).withColumn("_p", F.substring("term", 1, prefix))
    v = vocabulary.select(F.col("term").alias("match"), F.substring("term", 1, prefix).alias("_p")).filter(F.abs(F.char_length("match")) >= least - edits)
    near = (F.abs(F.char_length("term") - F.char_length("match")) <= edits) & (F.levenshtein("term", "match") <= edits)
    return q.join(v, "_p").filter(near).select("query_id", "term", "match")


def best_fields(index: FieldIndex, terms: DataFrame) -> DataFrame:
    """The best single field's weighted BM25 of each document, in place of the sum over fields."""
    hits = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("field", "term").agg(F.sum("times").alias("df"))
    weighted = terms.join(df, "term").join(F.broadcast(index.stats), "field").select("query_id", "field", "term", "qtf", "avgdl", idf(F.col("n_docs"), F.col("df")).alias("idf"))
    tf = F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    by_field = hits.hint("merge").join(weighted, ["field", "term"]).groupBy("query_id", "doc_id", "field").agg(F.sum(F.col("weight") * F.col("qtf") * F.col("idf") * tf).alias("score"))
    return by_field.groupBy("query_id", "doc_id").agg(F.round(F.max("score"), 6).alias("score"))
