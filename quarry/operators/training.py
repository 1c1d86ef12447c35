"""Splits, sampling, prefix expansion and hard negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.tables import keep_first


def hash_order(seed: int, *keys: str) -> Column:
    """A fixed random order, a number below 2**60: the same on any partitioning and in any engine that knows MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *keys)), 1, 15), 16, 10).cast("long")


def hash_order_sql(seed: int, *keys: str) -> str:
    """The same in DuckDB's SQL."""
    return f"cast('0x' || substr(md5(concat_ws('|', {seed}, {', '.join(keys)})), 1, 15) as bigint)"


def stratified_split(rows: DataFrame, key: str, stratum: str, shares: dict[str, float], rest: str, seed: int) -> DataFrame:
    """Assigns shares of each stratum in hash order, rounded within the stratum; the others go to `rest`."""
    w = Window.partitionBy(stratum)
    out = rows.withColumns({"_i": F.row_number().over(w.orderBy(hash_order(seed, key), key)), "_n": F.count("*").over(w)})
    split, before = F.lit(rest), F.lit(0)
    cuts = []
    for name, share in shares.items():
        upto = before + F.round(F.col("_n") * share)
        cuts.append((name, before, upto))
        before = upto
    for name, low, high in cuts:
        split = F.when((F.col("_i") > low) & (F.col("_i") <= high), name).otherwise(split)
    return out.withColumn("split", split).drop("_i", "_n")


def case_split(rows: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """About `share` of the keys go to dev, by their hash."""
    dev = F.pmod(hash_order(seed, key), F.lit(10_000)) < int(share * 10_000)
    return rows.withColumn("split", F.when(dev, "dev").otherwise("train"))


def prefix_points(text: Column) -> Column:
    """Prefixes at an early word, a middle word and inside a token, then the whole text: structs (prefix, full)."""
    w = F.split(F.trim(text), r"\s+")
    n, t = F.size(w), F.trim(text)
    early = F.when(n >= 2, F.get(w, F.lit(0)))
    middle = F.when(n >= 3, F.array_join(F.slice(w, F.lit(1), F.floor(n / 2).cast("int") + 1), " "))
    cut = F.when(F.char_length(t) >= 8, F.rtrim(F.substring(t, F.lit(1), F.greatest(F.lit(4), F.floor(F.char_length(t) * 0.6).cast("int")))))
    partial = F.filter(F.array_distinct(F.array(early, middle, cut)), lambda p: p.isNotNull() & (p != t))
    return F.concat(F.transform(partial, lambda p: F.struct(p.alias("prefix"), F.lit(False).alias("full"))), F.array(F.struct(t.alias("prefix"), F.lit(True).alias("full"))))


def label_prefixes(prefixes: DataFrame, names: DataFrame) -> DataFrame:
    """State of each (case_id, prefix, full) by how many distinct names begin with it; weight 1 / rows of the case.

    names: name (folded). Names are counted by each of their own prefixes, an equi-join with one row for each prefix
    length, in place of a range join.
    """
    grams = names.select("name").distinct().select(F.explode(F.transform(F.sequence(F.lit(4), F.greatest(F.char_length("name"), F.lit(4))), lambda n: F.substring("name", F.lit(1), n))).alias("p"))
    counts = grams.groupBy("p").agg(F.count("*").alias("n_names"))
    rows = prefixes.join(counts, F.lower("prefix") == F.col("p"), "left")
    n = F.coalesce("n_names", F.lit(0))
    state = F.when(F.col("full"), "positive").when(F.char_length("prefix") <= 3, "ignore").when(n <= 1, "positive").when(n <= 20, "multi_positive").otherwise("ignore")
    weight = 1.0 / F.count("*").over(Window.partitionBy("case_id"))
    return rows.select("case_id", "prefix", "full", state.alias("label_state"), F.round(weight, 6).alias("sample_weight"))


def hard_negatives(candidates: DataFrame, blocked: DataFrame, quotas: dict[str, int], most: int = 8) -> DataFrame:
    """(query_id, doc_id, source, rank): unblocked candidates, each from its first source, up to the quotas and `most`.

    candidates: query_id, doc_id, source, rank, in the sources' order of `quotas`; blocked: query_id, doc_id. A source
    whose candidate was taken by an earlier source goes on to its next, so sources are filled one after the other.
    """
    open_ = candidates.join(blocked.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    taken = None
    for source, quota in quotas.items():
        own = keep_first(open_.filter(F.col("source") == source), ["query_id", "doc_id"], [F.asc("rank")])
        if taken is not None:
            own = own.join(taken.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        order = Window.partitionBy("query_id").orderBy("rank", "doc_id")
        own = own.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= quota).drop("_i").select("query_id", "doc_id", "source", "rank")
        taken = own if taken is None else taken.unionByName(own)
    place = F.array_position(F.array(*[F.lit(s) for s in quotas]), F.col("source"))
    order = Window.partitionBy("query_id").orderBy(place, "rank", "doc_id")
    return taken.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= most).drop("_i")


def group_pairs(pairs: DataFrame) -> DataFrame:
    """Sorted positives, negatives and ignored documents of each query."""
    of = lambda label: F.array_join(F.array_sort(F.collect_set(F.when(F.col("label") == label, F.col("doc_id")))), "|").alias(f"{label}s")
    return pairs.groupBy("query_id").agg(of("positive"), of("negative"), of("ignore"))


def masked_loss(scores: DataFrame) -> DataFrame:
    """-log of the positives' share of the softmax over unmasked documents, per query, shifted by the maximum."""
    live = scores.filter(~F.col("masked"))
    top = live.groupBy("query_id").agg(F.max("score").alias("top"))
    e = F.exp(F.col("score") - F.col("top"))
    return live.join(top, "query_id").groupBy("query_id").agg(F.round(F.log(F.sum(e)) - F.log(F.sum(F.when(F.col("positive"), e))), 6).alias("loss"))


def epoch_sample(rows: DataFrame, keys: list[str], weight: Column, seed: int) -> DataFrame:
    """The rows of one epoch: each stays with the probability of its weight, by its hash under the epoch's seed."""
    return rows.filter(F.pmod(hash_order(seed, *keys), F.lit(1_000_000)) < weight * 1_000_000)


def pooled_positives(rows: DataFrame, query: str, doc: str, seed: int, least: int = 2, most: int = 4) -> DataFrame:
    """Of each query's distinct positives `least` to `most`, the number by the query's hash, the choice in hash order."""
    want = least + F.pmod(hash_order(seed, query), F.lit(most - least + 1))
    place = F.row_number().over(Window.partitionBy(query).orderBy(hash_order(seed, query, doc), doc))
    return rows.select(query, doc).distinct().withColumn("_i", place).filter(F.col("_i") <= want).drop("_i")


def conflict_free_batches(rows: DataFrame, query: str, target: str, size: int, seed: int = 0, salts: int = 1) -> DataFrame:
    """Every row with the batch it belongs to: at most `size` rows, no two of one query or one target.

    A row's class is its place among the rows of its query and its place among those of its target, both in hash order.
    Two rows of one query differ in the first, two of one target in the second, so rows of a class never conflict; a
    class is cut into batches. No group is larger than a query's or a target's rows, or a class's share of one of `salts`
    parts, which are to grow with the table; at most one batch of each class and part is not full.
    """
    order = hash_order(seed, query, target)
    rows = rows.withColumn("_h", order)
    rows = rows.withColumns({
        "_i": F.row_number().over(Window.partitionBy(query).orderBy("_h", target)),
        "_j": F.row_number().over(Window.partitionBy(target).orderBy("_h", query)),
        "_s": F.pmod("_h", F.lit(salts)),
    })
    at = F.row_number().over(Window.partitionBy("_i", "_j", "_s").orderBy("_h", query, target))
    return rows.withColumn("batch", F.concat_ws("-", "_i", "_j", "_s", F.floor((at - 1) / size))).drop("_h", "_i", "_j", "_s")
