import pytest

from cloakstone.llm import decontaminate, queries

from .util import DOCS, awkward, clashing, shingles

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    verdicts = {r.doc_id: r.kept for r in queries.op7_quality_rules(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    now, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = corpus_pipeline.written(stage(spark, now, sf_dir), "test")
        assert after.schema == docs.schema, name
        ids = {r.doc_id for r in after.collect()}
        assert ids <= {r.doc_id for r in now.collect()}
        if name == "quality_rules":
            assert ids == {d for d, kept in verdicts.items() if kept}
        if name == "ngram_jaccard_join":
            kept = [(d, shingles(texts[d])) for d in sorted(ids)]
            for i, (a, x) in enumerate(kept):
                for b, y in kept[i + 1 :]:
                    assert 100 * len(x & y) < 80 * len(x | y), (a, b)
        if name == "benchmark_decontamination":
            assert decontaminate.find(after, queries.table(spark, sf_dir, "benchmark")).count() == 0
        now = after
        sizes.append(len(ids))
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4]
    final = corpus_pipeline.run(spark, sf_dir)
    assert final.count() == sizes[4] and final.where("not round_trip").count() == 0


def test_stages_of_awkward_and_no_rows(spark, sf_dir):
    for rows in (awkward(), []):
        now = spark.createDataFrame(rows, DOCS)
        for _, stage in corpus_pipeline.STAGES:
            now = corpus_pipeline.written(stage(spark, now, sf_dir), "test")
        assert now.count() <= len(rows)


def test_each_stage_alone_keeps_awkward_rows_whole(spark, sf_dir):
    docs = spark.createDataFrame(awkward(), DOCS)
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, sf_dir).schema == docs.schema, name
        other = clashing(spark)
        assert stage(spark, other, sf_dir).schema == other.schema, name
