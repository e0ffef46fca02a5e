import sys

import pytest

import corpus_pipeline
from heatwise.llm import secrets
from heatwise.llm.queries import QUERIES

sys.path.insert(0, __file__.rpartition("/")[0])
SF = "/root/testdata/sf0.01"
NUMBERS = ["toxicity", "quality_rules", "minhash_near_dedup", "secret_scans", "packing"]


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == NUMBERS


def test_stages_apply_the_operators(spark):
    """Each stage keeps just what its operator decides on that stage's own input."""
    from test_neardup import brute
    from heatwise.llm.scratch import Scratch
    scratch = Scratch(spark, "t")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)

    kept = scratch.keep(stage["toxicity"](spark, docs, SF), "a")
    op10 = {r.doc_id: r.predicted for r in QUERIES["op10_toxicity"](spark, SF).collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {i for i, p in op10.items() if not p}

    before = kept
    kept = scratch.keep(stage["quality_rules"](spark, before, SF), "b")
    from heatwise.llm import quality
    measured = quality.with_measures(before)
    judged = quality.with_verdict(measured, quality.fit(measured)).select("doc_id", "kept").collect()
    good = {r.doc_id for r in judged if r.kept}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == good and len(good) > 500

    before = kept
    kept = scratch.keep(stage["minhash_near_dedup"](spark, before, SF), "c")
    classes = brute([(r.doc_id, r.text) for r in before.collect()])
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(classes.values()))

    before = {r.doc_id: r for r in kept.collect()}
    kept = scratch.keep(stage["secret_scans"](spark, kept, SF), "d")
    after = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == columns and after.keys() == before.keys()
    for i, r in after.items():
        assert r.text == secrets.redacted(before[i].text, secrets.spans(before[i].text)) and r.n_chars == len(r.text)
    assert any(after[i].text != before[i].text for i in after)

    rows = stage["packing"](spark, kept, SF).collect()
    assert {r.doc_id for r in rows} == after.keys()
    assert all(sum(r.length for r in rows if r.doc_id == i) == next(r.doc_tokens for r in rows if r.doc_id == i) for i in list(after)[:50])


def test_run_and_empty_table(spark, tmp_path):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 100
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_and_repeats_pass_all_stages(spark, tmp_path):
    import pyspark.sql.functions as F
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("extra", F.lit(1)).withColumn("kept", F.lit("x"))
    odd = docs.limit(5).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(5)) \
        .unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(2).withColumn("lang", F.lit(None).cast("string")))
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100
