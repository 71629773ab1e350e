"""Guards of the shared parts: components, scratch tables, and the pipeline's contract."""

import random

from pyspark.sql import functions as F

from folioscope.llm import components, scratch


def test_components_against_a_loop(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for x in parent:
        assert got.get(x, x) == root(x)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scratch(spark):
    df = spark.range(5).withColumn("x", F.lit("a"))
    assert scratch.materialize(df, "t").count() == 5
    assert scratch.unused("Key", ["key", "KEY_"]) == "Key__"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    texts = [" ".join(word() for _ in range(80)) for _ in range(60)]
    texts[1] = texts[0]
    texts[2] = texts[0] + " more"
    texts = [t.upper().replace(" ", "!! ") if k % 5 == 4 else t for k, t in enumerate(texts)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)] + [(100, None, None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 5 != 4), 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "tokens":
            assert docs.columns == columns
    ids = {r.doc_id for r in docs.collect()}
    assert 1 not in ids and 2 not in ids and not any(i % 5 == 4 for i in ids if i < 60)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
