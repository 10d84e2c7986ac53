from pyspark.sql import functions as F

import corpus_pipeline as P
from chainloom.llm.exactdedup import exact_groups
from chainloom.session import written

SF = "/root/testdata/sf0.001"


def test_each_stage_keeps_what_it_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, last = docs.columns, None
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        docs = written(stage(spark, docs, SF), name)
        ids, kept = [{r.doc_id for r in x.select("doc_id").collect()} for x in (before, docs)]
        assert kept <= ids and docs.count() == len(kept)
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
        if name == "exact_dedup":
            assert kept == {r.doc_id for r in exact_groups(before).where("kept").collect()}
        last = docs
    assert last.where("not round_trip").count() == 0
    assert P.run(spark, SF).count() == last.count() > 100


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["lang_pred", "lang_score", "key", "_key", "__spans", "n"]
    for c in names:
        docs = docs.withColumn(c, F.lit(c))
    one = docs.where("lang = 'en' and length(text) > 200").orderBy("doc_id").limit(1)
    odd = one.unionByName(one).unionByName(one.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(one.withColumn("text", F.lit(None).cast("string")))
    docs = docs.unionByName(odd)
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.where(" or ".join(f"`{c}` is distinct from '{c}'" for c in names)).count() == 0
    assert docs.where("doc_id is null or text is null").count() == 0 and docs.count() == docs.dropDuplicates(["doc_id"]).count()
