import corpus_pipeline
from locusflow.llm import queries, toxicity
from locusflow.llm.common import fold
from test_jaccard import kept as brute

SF = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels, fold("doc_id", 4) != 2)
    s = model.scorer()
    all_ = {r.doc_id: r for r in docs.collect()}
    one = corpus_pipeline.toxicity_stage(spark, docs, SF)
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    assert kept == {i for i, r in all_.items() if s(r.text) < toxicity.THRESHOLD}
    two = corpus_pipeline.language_stage(spark, one, SF)
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == {i for i in kept if any(c.isalpha() for c in all_[i].text)}
    three = corpus_pipeline.dedup_stage(spark, two, SF)
    rows = sorted(((r.doc_id, r.text) for r in two.collect()))
    best = brute([t for _, t in rows])
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == {rows[i][0] for i in best}
    last = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in three.collect()}


def test_stages_survive_empty_and_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a text of words", "en", "s", 5), (None, "quite another matter altogether", "en", "s", 5), (3, "hello there world again", "en", "s", 9), (3, "hello there world again", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d, n in ((docs, 3), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, SF)
        assert d.count() == n
        assert (corpus_pipeline.packing_stage(spark, d, SF).count() > 0) == bool(n)


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
