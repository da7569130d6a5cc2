"""The pipeline on a small table and on edge cases."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL


def test_stages_in_order_and_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    columns, before = docs.columns, docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1 and toxic = 0")
    originals = spark.read.parquet(f"{SMALL}/documents.parquet")
    once = originals.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    clean = labels.join(once, "doc_id")
    assert clean.join(docs, "doc_id").count() >= 0.9 * clean.count()
    want = docs.selectExpr("doc_id")
    packed = corpus_pipeline.pack(spark, docs, SMALL)
    assert {r[0] for r in packed.select("doc_id").collect()} == {r[0] for r in want.collect()}


def test_stages_on_edge_cases(spark, edge_docs, no_docs, tmp_path):
    for name, df in (("edge", edge_docs.drop("kept")), ("none", no_docs)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, SMALL).count() <= max(60_000, df.count())


def _planted(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies_of_a_few_edits_are_one(spark):
    words = [f"word{i}" for i in range(200)]
    edited = [w if i not in (30, 100, 170) else "other" for i, w in enumerate(words)]
    far = [w if i % 12 else "other" for i, w in enumerate(words)]
    df = _planted(spark, [" ".join(words), " ".join(edited), " ".join(far)])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, SMALL).collect()) == [0, 2]


def test_passages_of_over_fifty_words_go(spark):
    own = lambda k, n: " ".join(f"t{k}x{i}" for i in range(n))
    texts = []
    for n in range(50, 61):
        passage = " ".join(f"p{n}" for _ in range(n - 10)) + " " + " ".join(f"q{i}n{n}" for i in range(10))
        assert n == 50 or len(passage) < 400
        texts += [f"{own(2 * n, 40)} {passage} {own(-n, 5)}", f"{own(2 * n + 1, 30)}\n{passage}"]
    out = {r["doc_id"]: r["text"].split() for r in corpus_pipeline.repeated_passages(spark, _planted(spark, texts), SMALL).collect()}
    for i in range(22):
        left = len(texts[i].split()) - (50 + i // 2 if i >= 2 else 0)
        assert len(out[i]) == left, (i, len(out[i]))
