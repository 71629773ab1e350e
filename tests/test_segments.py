"""Segments are merged without a shuffle of single postings, and what is no longer read does not stay on disk."""

import random
import time

import pytest
from pyspark.sql import functions as F

from folioscope import scratch
from folioscope.operators import index, search

FIELDS = "document_id long, ocr_text string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _texts(rng, ids):
    return {k: rng.choice([None, "", "one two one", " ".join(rng.choices(["Ärger", "b", "c", "dd"], k=rng.randint(1, 9)))]) for k in ids}


@pytest.fixture(scope="module")
def changed(spark):
    """Texts before and after a change: some other, some gone, some new, a range that only one of both has."""
    rng = random.Random(5)
    old = _texts(rng, [*range(90), 5000])
    new = {k: v for k, v in old.items() if k % 7} | _texts(rng, [k for k in range(90) if k % 3 == 0 and k % 7]) | {7000: "far b"}
    other = {k for k in old | new if (k in old, old.get(k)) != (k in new, new.get(k))}
    frame = lambda d: spark.createDataFrame(list(d.items()), FIELDS)
    fresh, dead = frame({k: new[k] for k in other & set(new)}), frame({k: old[k] for k in other & set(old)})
    lens = search.lengths(frame(new)).withColumn("epoch", F.when(F.col("document_id").isin(*other), 2).otherwise(1).cast("bigint"))
    return [index.segment(frame(old), None, 1, 16), index.segment(fresh, dead, 2, 16)], lens, frame(new), other


def _spelt(rows):
    return {(r.term, r.block): (r.n, r.max_tf, r.min_dl, [tuple(d) for d in r.docs]) for r in rows.collect()}


def test_merged_is_the_index_of_the_texts_as_they_are(spark, changed):
    (first, second), lens, new, other = changed
    rows = index.merged(first.unionByName(second), lens, 16)
    alike = {k: (n, tf, dl, [(d[0], d[1], d[2], 2 if d[0] in other else 1, d[4]) for d in docs]) for k, (n, tf, dl, docs) in _spelt(index.segment(new, None, 1, 16)).items()}
    assert _spelt(rows) == alike and len(alike) > 20
    assert index.merged(first.limit(0), lens, 16).count() == 0 and index.merged(first, lens.limit(0), 16).filter(F.size("docs") > 0).count() == 0


def test_counts_to_be_taken_off_stay_without_documents(spark, changed):
    (_, second), lens, _, _ = changed
    only = _spelt(index.merged(second, lens, 16))
    assert any(n < 0 and not docs for n, _, _, docs in only.values())
    assert only == {k: v for k, v in _spelt(second).items() if v[0] or v[3]}


def test_merging_shuffles_no_postings(spark, changed):
    (first, second), lens, _, _ = changed
    assert "Generate" not in _plan(index.merged(first.unionByName(second), lens, 16))
    with scratch.buckets(spark, "block", 4) as add:
        add(first)
        both = add(second)
        assert both.count() == first.count() + second.count()
        rows = index.merged(both, lens, 16)
        assert _plan(rows).count("Exchange") == 1  # of lengths
        assert _spelt(rows) == _spelt(index.merged(first.unionByName(second), lens, 16))
    assert not spark.catalog.listTables()


def _shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").splitlines()
    return {f for f in files if "/shuffle_" in f}


def test_what_a_table_shuffled_goes_with_its_writing(spark):
    before, key = _shuffled(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key, None)
    with scratch.rounds(spark) as keep:
        first = keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
        end = time.time() + 20
        while _shuffled(spark) - before and time.time() < end:
            time.sleep(0.1)
        assert not _shuffled(spark) - before
        assert spark.conf.get(key, None) == setting
        path = first.inputFiles()[0]
        second = keep(first.groupBy().sum("count"))
        scratch.release(first)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        assert not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    assert second.first()[0] == 1000
