import corpus_pipeline
from gridloom.llm import pieces

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_end_in_pieces(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SMALL)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        kept = spark.createDataFrame(out.collect(), out.schema)
        seen.append(kept)
    good = [k for k, r in labels.items() if r.quality == 1 and r.toxic == 0]
    after = {r.doc_id for r in seen[0].collect()}
    assert sum(k in after for k in good) >= 0.9 * len(good)
    texts = [r.text for r in seen[1].collect()]
    assert len(set(texts)) == len(texts)
    assert all(len(r.text) <= len(before[r.doc_id]) and r.n_chars == len(r.text) for r in seen[2].collect())
    assert all(r.lossless for r in seen[4].collect())
    back = {r.doc_id: r.text for r in pieces.decode(seen[4]).collect()}
    assert back == {r.doc_id: r.text for r in seen[3].collect()}
