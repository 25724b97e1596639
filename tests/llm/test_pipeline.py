import corpus_pipeline as P
from guildspark.llm.common import cut, read

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(P.STAGES):
        before, docs = docs, cut(stage(spark, docs, SF), "test")
        if k < 4:
            assert docs.columns == columns, name
        ids = {r[0] for r in docs.select("doc_id").collect()}
        assert ids <= {r[0] for r in before.select("doc_id").collect()} and len(ids) >= 100
    assert docs.columns == ["doc_id", "n_ids", "ids"] and docs.count() == len(ids)
    assert all(r["n_ids"] == len(r["ids"] or []) for r in docs.collect())


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "x y z", "en", "s", 5), (2, "", "en", None, 0), (2, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = cut(stage(spark, docs, SF), "test")
    assert docs.count() >= 1
