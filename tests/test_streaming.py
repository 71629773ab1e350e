"""States of a stream of listings against the batch and against a loop."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioscope.operators import ingest
from folioscope.streaming.sightings import state_store, track

DAY = datetime(2026, 1, 1)
LISTING = "rel_path string, size_bytes long, mtime double, scanned_at timestamp"


def run(spark, folder, batches, patience, occurrences=None):
    """Rows of each micro-batch; a batch is a file."""
    source, out = str(folder / "in"), []
    spark.createDataFrame([], LISTING).write.parquet(source)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, LISTING).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LISTING).parquet(source)
        with state_store(spark):
            query = (
                track(stream, patience, occurrences).writeStream.format("parquet")
                .option("path", str(folder / "out")).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
            )
            query.awaitTermination()
        rows = [(r.rel_path, r.state, r.at) for r in spark.read.parquet(str(folder / "out")).collect()]
        out.append(sorted(set(rows) - {x for o in out for x in o}))
    return out


def by_a_loop(batches, patience):
    """States and sweeps after each batch, the clock being the latest sighting so far."""
    known, out, clock = {}, [], datetime.min
    for rows in batches:
        told = []
        for path, size, mtime, at in sorted(rows, key=lambda r: r[3]):
            if path is None or path in known and at <= known[path][2]:
                continue
            old = known.get(path)
            told.append((path, "new" if old is None else "unchanged" if not old[3] and old[:2] == (size, mtime) else "changed", at))
            known[path] = (size, mtime, at, False)
        clock = max([clock, *(r[3] for r in rows)])
        for path, (size, mtime, at, missing) in known.items():
            if not missing and at + patience <= clock:
                told.append((path, "missing", at + patience))
                known[path] = (size, mtime, at, True)
        out.append(sorted(told))
    return out


def test_states_against_a_loop(spark, tmp_path):
    rng = random.Random(2)
    paths = [f"a/{k}.pdf" for k in range(30)]
    batches = [[(p, rng.choice([None, 1, 2]), 1.0, DAY + timedelta(days=day)) for p in rng.sample(paths, 14)] for day in (0, 1, 3, 4, 7)]
    batches[1] += [(None, 1, 1.0, DAY + timedelta(days=1)), (paths[0], 9, 9.0, DAY + timedelta(days=1, hours=1)), (paths[0], 9, 9.0, DAY + timedelta(days=1, hours=2))]
    patience = timedelta(days=2, hours=12)
    got, wanted = run(spark, tmp_path, batches, patience), by_a_loop(batches, patience)
    assert got == wanted
    assert {s for rows in wanted for _, s, _ in rows} == {"new", "changed", "unchanged", "missing"}


def test_stream_agrees_with_the_batch(spark, tmp_path):
    kind = "rel_path string, size_bytes long, mtime double, seen_at timestamp, missing_since timestamp"
    stored = spark.createDataFrame([(f"p{k}", k % 3, 1.0, DAY, DAY if k % 5 == 0 else None) for k in range(40)], kind)
    rows = [(f"p{k}", k % 2, 1.0, DAY + timedelta(days=9)) for k in range(20, 60)]
    listing = spark.createDataFrame(rows, LISTING)
    got = run(spark, tmp_path, [rows], timedelta(days=5), stored)[0]
    states = {(r.rel_path, r.state) for r in ingest.classify(listing, stored).collect()}
    swept = {(r.rel_path, "missing") for r in ingest.missing(stored.filter(F.col("missing_since").isNull()), listing).collect()}
    assert {(p, s) for p, s, _ in got} == states | swept and len(got) == len(states | swept)
