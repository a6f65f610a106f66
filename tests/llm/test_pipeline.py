import public_tokenizers
import test_near_dedup
import test_quality_rules
from pyspark.sql import functions as F

import corpus_pipeline
from pointweave.llm import language_id, quality_rules


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (_, language), (_, rules), (_, near), (_, packed) = corpus_pipeline.STAGES
    own = {r.doc_id: r for r in docs.collect()}

    one = language(spark, docs, sf)
    assert one.columns == docs.columns and one.where("lang is null").isEmpty()
    pred = {r.doc_id: r for r in language_id.identify(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    ids = {d for d in own if pred[d].lang_pred != "und" and pred[d].score >= 0.5}
    assert {r.doc_id for r in one.collect()} == ids and len(ids) >= 0.95 * len(own)

    two = rules(spark, one, sf)
    judged = {r.doc_id: r for r in quality_rules.judge(one, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    keep = {d for d in ids if (c := test_quality_rules.brute(own[d].text))[0] >= 50 and 100 * c[4] <= 50 * c[0] and not judged[d].failed_rules}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == keep

    three = near(spark, two, sf)
    groups = test_near_dedup.brute({d: own[d].text for d in keep}, 80)
    left = {d for d in keep if groups[d][1] == d}
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == left

    four = packed(spark, three, sf).collect()
    assert {r.doc_id for r in four} == left
    assert all(sum(p.length for p in four if p.doc_id == d) == next(p.doc_tokens for p in four if p.doc_id == d) for d in left)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == left


def test_odd_rows_in_every_stage(spark, odd):
    """Nulls, empty texts, ties, repeated rows, clashing names and a very long text."""
    sf = "/root/testdata/sf0.001"
    long = spark.createDataFrame([(900, "many words of a long text " * 100_000, None)], "doc_id long, text string, lang string")
    some = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = odd.unionByName(long, allowMissingColumns=True).unionByName(some, allowMissingColumns=True)
    docs = docs.withColumns({"kept": F.lit(1), "component_id": F.lit("x"), "stratum": F.lit(None).cast("string"), "score": F.lit("y")}).cache()
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert out.columns == docs.columns and {(r.doc_id, r.text) for r in rows} <= texts, name
        if name == "language ID":
            assert all(r.lang for r in rows) and all(any(c.isalpha() for c in r.text) for r in rows if r.doc_id is None or r.doc_id >= 900)
        if name == "quality rules":
            assert all(len(r.text.split()) >= 50 for r in rows if r.doc_id == 900)
    (_, pack) = corpus_pipeline.STAGES[-1]
    assert sum(r.length for r in pack(spark, docs, sf).collect() if r.doc_id == 900) > 100_000


def test_empty_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0
