"""The pipeline, and what the driver expects of the registration."""

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__
from stowage.llm import quality, queries, secret_scan, simhash

SF = "/root/testdata/sf0.001"


def test_registration():
    names = __spark_entry__.queries()
    assert set(queries.registered()) < set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.registered()) == list(range(1, 14))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    good = stages[0](spark, docs.withColumn("extra", F.lit(1)), SF)
    assert good.columns == corpus_pipeline.COLUMNS
    wanted = quality.quality_scores(docs, labels).where("predicted = 1")
    assert {r[0] for r in good.select("doc_id").collect()} == {r[0] for r in wanted.select("doc_id").collect()}
    single = stages[1](spark, docs, SF)
    classes = simhash.near_duplicates(docs).select("component_id").distinct()
    assert sorted(r[0] for r in single.select("doc_id").collect()) == sorted(r[0] for r in classes.collect())
    clean = stages[2](spark, docs, SF)
    assert clean.count() == docs.count() and clean.columns == corpus_pipeline.COLUMNS
    left = secret_scan.scan_secrets(clean)
    assert left.where("n_assign + n_access + n_hex > 0").isEmpty()
    assert clean.where("n_chars <> char_length(text)").isEmpty()
    for stage in stages[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    filled = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("first"))
    assert out.count() > 0 and filled.where("n > 1024 OR first <> 0").isEmpty()


def test_odd_rows_through_all_stages(spark):
    """Null, empty, very long and repeated rows, null ids and sources and clashing columns."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS)
    good = docs.join(labels.where("quality = 1"), "doc_id").select("text").first()["text"]
    rows = [
        (10**6, None, "en", "src0", None), (10**6 + 1, "", None, None, 0), (None, good + " one two three", "en", None, 9),
        (10**6 + 2, good, "en", "src1", 9), (10**6 + 2, good, "en", "src1", 9), (10**6 + 3, (good + " ") * 400, None, "src2", 9),
        (None, None, None, None, None), (10**6 + 4, "password=" + "k3y9" * 9 + " " + good, "de", "src3", 9),
    ]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    odd = docs.unionByName(spark.createDataFrame(rows, kinds))
    for name in ("_doc", "_copies", "rows", "size", "fp", "secrets", "score"):
        odd = odd.withColumn(name, F.lit("x"))
    before = odd.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = corpus_pipeline.materialize(stage(spark, odd, SF), name)
        assert odd.columns == corpus_pipeline.COLUMNS
        if name != "mix_sources":
            assert 0 < odd.count() <= before
            before = odd.count()
        if name == "simhash_near_dedup":  # one row of each id and text is left
            assert odd.where("doc_id IS NOT NULL").groupBy("doc_id", "text").count().where("count > 1").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, SF)
    want = {r["doc_id"]: r["count"] for r in odd.groupBy("doc_id").count().collect()}
    assert {r["doc_id"]: r["count"] for r in packed.where("piece = 0").groupBy("doc_id").count().collect()} == want
    # every sequence is filled from 0 without a gap
    ends = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.where("n <> end OR n > 1024").isEmpty()
