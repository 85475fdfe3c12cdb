import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.select("text").distinct().count() == counts[-1]
    done = corpus_pipeline.run(spark, sf)
    assert done.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and done.count() > 0
