import corpus_pipeline
from sombra.llm import common, jaccard, pii, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = docs, docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        before, kept = kept, spark.read.parquet(str(tmp_path / name))
        counts.append(kept.count())
        if name == "toxicity":
            scores = toxicity.score(before, toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet")))
            assert {r.doc_id for r in scores.where("predicted = 0").collect()} == {r.doc_id for r in kept.collect()}
        if name == "ngram_join":
            groups = jaccard.jaccard_components(before, k=5, pct=80)
            assert {r.component_id for r in groups.collect()} == {r.doc_id for r in kept.collect()}
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    left = [s for r in kept.collect() for s in pii.base_spans(r.text)]
    assert not left
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in kept.collect()}


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_stages_on_odd_rows_and_an_empty_table(spark, odd_docs, no_docs):
    """Nulls, empty and long texts, repeats and clashing names in every stage."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, SF)
        ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in out.select("doc_id").distinct().collect())
        if name == "packing":
            assert [i for ok, i in ids if ok] == [1, 2, 3, 4, 5, 6, 7, 8]
        elif name == "ngram_join":
            # one of the copies 1 and 6; texts without words link with nothing
            assert [i for ok, i in ids if ok] == [1, 2, 3, 4, 5, 7, 8] and out.where("doc_id is null").count() == 2
        else:
            assert out.columns == odd_docs.columns and (False, 0) in ids
            assert name != "pii" or out.count() == odd_docs.count()
        assert stage(spark, no_docs, SF).collect() == [], name
    slim = odd_docs.select("doc_id", "text")
    assert corpus_pipeline.STAGES[2][1](spark, slim, SF).columns == ["doc_id", "text"]


def test_a_worker_drops_the_memos_of_other_operators():
    toxicity.reader(["abc"])
    own = lambda batches: batches
    own.__module__ = toxicity.__name__
    assert list(common.lean(own)([])) == [] and toxicity._READERS
    own.__module__ = jaccard.__name__
    assert list(common.lean(own)([1, 2])) == [1, 2] and not toxicity._READERS
