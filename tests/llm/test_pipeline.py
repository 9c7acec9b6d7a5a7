import random

import corpus_pipeline
from corpora import corpus, documents, words


def test_stages_keep_what_is_clean(spark, tmp_path):
    rng = random.Random(2)
    d = str(tmp_path)
    item = words(rng, 40)
    texts = corpus() + [f"{words(rng, 30)}\n{item}\n{words(rng, 30)}", "toxicword " * 30, words(rng, 60) + "\n" + words(rng, 30)]
    docs = documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out = corpus_pipeline.run(spark, d)
    ids = {r["doc_id"] for r in out.collect()}
    n = len(texts)
    assert n - 3 not in ids and n - 1 in ids
    assert {0, 1, 2} <= ids  # null and empty texts are kept
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns, name


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x[: x.index("_") + 1] for x in names if x.startswith("op") and x[2].isdigit()}
    assert "pipeline" in names and set(entry.oracle_sql()) <= names
