"""The pipeline's stages and their order, on the smallest documents table."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = set(docs.columns)
    before = {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert set(out.columns) == names
        rows = out.collect()
        kept = {r.doc_id for r in rows}
        assert len(rows) == len(kept) and kept <= before
        docs, before = spark.createDataFrame(rows, out.schema), kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == before


def test_labels_agree(spark):
    kept = {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").distinct().collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    good = [r.doc_id for r in labels if r.quality == 1 and len(texts[r.doc_id].split()) >= 20]
    copies = {i for i in good if sum(texts[j] == texts[i] for j in texts) > 1}
    assert sum(i in kept for i in good if i not in copies) >= 0.95 * len([i for i in good if i not in copies])


def test_each_row_has_its_own_verdict(spark):
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice(["ba", "ko", "ri", "ten", "lu", "sha"]) for _ in range(rnd.randrange(1, 4))) for _ in range(300)]
    prose = [" ".join(rnd.choice(vocab) for _ in range(150)) for _ in range(150)]
    text, other = prose[:2]
    planted = [(None, text), (None, "too short"), (-1, other), (-1, "too short"), (-2, text), (-2, text)]
    rows = [(i, t, "en", "prose", 1) for i, t in enumerate(prose[2:])] + [(i, t, "en", "planted", 1) for i, t in planted]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    good = corpus_pipeline.quality_rules(spark, more, DATA)
    assert sorted((r.doc_id or 0, r.text) for r in good.filter("source = 'planted'").collect()) == sorted((i or 0, t) for i, t in planted if t != "too short")
    known = corpus_pipeline.language(spark, good, DATA).filter("source = 'planted'")
    assert known.count() == 4
    # one row of each group of copies: the smallest id's, null last
    once = corpus_pipeline.near_duplicates(spark, known, DATA).collect()
    assert sorted((r.doc_id, r.text) for r in once) == sorted([(-1, other), (-2, text)])
    alone = corpus_pipeline.near_duplicates(spark, known.filter("doc_id is null"), DATA).collect()
    assert [(r.doc_id, r.text) for r in alone] == [(None, text)]


def test_stages_stand_empty_tables_and_extra_columns(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars int"
    none = spark.createDataFrame([], kinds + ", key long, fp long, kept boolean")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice(["ba", "ko", "ri", "ten", "lu", "sha"]) for _ in range(rnd.randrange(1, 4))) for _ in range(200)]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(80)), [None, "aa"][i % 2], "s", 1, 7, 8, False) for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None, None, None, None)], kinds + ", key long, fp long, kept boolean")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(out.collect(), out.schema).withColumn("key", F.lit(1)).withColumn("kept", F.lit(True))
    kept = docs.collect()
    assert {r.doc_id for r in kept} <= set(range(60)) and len(kept) >= 57
    assert {r.lang for r in kept} == {"aa"}  # the language stage fills what is missing


def test_near_duplicates_go_by_five_words(spark):
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    near = list(base)
    near[1500] = "altered"
    rows = [(1, " ".join(base), "en", "s", 1), (2, " ".join(near), "en", "s", 1), (3, " ".join(base).upper(), "en", "s", 1), (4, " ".join(rnd.sample(base, 3000)), "en", "s", 1)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"), DATA)
    assert sorted(r.doc_id for r in out.collect()) == [1, 4]
