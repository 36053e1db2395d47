"""The pipeline against its operators, on odd input, and after a failure."""

import uuid

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import language, mixing, near, packing, quality




def test_stages_follow_one_another(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r["doc_id"] for r in quality.judge(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("keep").collect()}
    docs = docs.filter(docs.doc_id.isin(list(good)))
    net = language.train(docs)
    known = {r["doc_id"] for r in language.predict(docs, net).filter(f"score >= {language.MIN_SCORE} AND lang_pred <> 'und'").collect()}
    docs = docs.filter(docs.doc_id.isin(list(known)))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    single = {r["doc_id"] for r in near.keep_one(docs).collect()}
    # of the rows that went, each has a like one that stays or went too; of those that stay none is like another
    assert all(any(near.jaccard(texts[i], texts[j]) >= 0.8 for j in texts if j != i) for i in set(texts) - single)
    docs = docs.filter(docs.doc_id.isin(list(single)))
    copies = {r["doc_id"]: r["copies"] for r in mixing.with_copies(docs).filter("copies > 0").collect()}
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert set(got.doc_id) == set(copies) and 0.5 < len(good) / 200 <= 1
    tokens = {r["doc_id"]: r["doc_tokens"] for r in packing.pack(docs).collect()}
    assert got.length.sum() == sum(tokens[i] * n for i, n in copies.items())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "dedup", "mixing", "packing"]


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents(spark, odd, labels, tmp_path, empty):
    docs = odd.drop("__text", "block")
    docs = docs.filter("doc_id > 1000000") if empty else docs.unionByName(docs)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(got) != empty and {"doc_id", "sequence_id", "offset"} <= set(got[0].asDict() if got else {"doc_id", "sequence_id", "offset"})


def test_a_failed_run_goes_on(spark, tmp_path, monkeypatch):
    """Finished stages aren't run again, half-written ones are."""
    sf, folder, done = "/root/testdata/sf0.001", f"{tmp_path}/{uuid.uuid4().hex}", []

    def noted(name, stage, fails=False):
        def run(spark, docs, sf_dir):
            done.append(name)
            out = stage(spark, docs, sf_dir)
            return out.withColumn("doc_id", F.raise_error(F.lit("lost")).cast("long")) if fails else out

        return name, run

    stages = [("first", lambda s, d, _: d.filter("doc_id % 3 > 0")), ("second", lambda s, d, _: d.filter("doc_id % 2 > 0")), ("third", lambda s, d, _: d.select("doc_id"))]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [noted(n, f, n == "second") for n, f in stages])
    with pytest.raises(Exception, match="lost"):
        corpus_pipeline.run(spark, sf, folder)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [noted(n, f) for n, f in stages])
    got = {r[0] for r in corpus_pipeline.run(spark, sf, folder).collect()}
    assert done == ["first", "second", "second", "third"]
    assert got == {r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 3 > 0 AND doc_id % 2 > 0").select("doc_id").collect()}


def test_another_input_starts_anew(spark, tmp_path, monkeypatch):
    done, folder, data = [], f"{tmp_path}/out", f"{tmp_path}/in"

    def stage(spark, docs, sf_dir):
        done.append(docs.count())
        return docs.select("doc_id")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("only", stage)])
    for n in (3, 3, 5):
        if n != (done or [0])[-1]:
            for name in ("documents", "labels"):
                spark.range(n).withColumnRenamed("id", "doc_id").write.mode("overwrite").parquet(f"{data}/{name}.parquet")
        assert corpus_pipeline.run(spark, data, folder).count() == n
    assert done == [3, 5]
    corpus_pipeline.forget(spark, folder)
    assert corpus_pipeline.run(spark, data, folder).count() == 5 and done == [3, 5, 5]
