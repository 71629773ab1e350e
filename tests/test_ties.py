"""Plans are folded by targets that suffixed paths tie together, not by folders."""

from pyspark.sql import functions as F

from folioscope.operators import plan


def _targets(spark, rows):
    df = spark.createDataFrame([(k, sha, f"in/{k}.pdf", "f", name, False, False) for k, (sha, name) in enumerate(rows)], "document_id long, sha256 string, rel_path string, folder string, party string, on_disk boolean, suffixed_on_disk boolean")
    return plan.targets(df.withColumns({c: F.lit(None).cast("string") for c in ("doc_date", "doc_type", "detail")}), "{party}")


def _loop(rows):
    """The fold over the whole folder, in order of id."""
    taken, out = set(), []
    for k, (sha, name) in enumerate(rows):
        path = f"f/{name}.pdf"
        if path.lower() in taken:
            path = f"f/{name}_{sha[:6]}.pdf"
            if path.lower() in taken:
                out.append((k, "collision", None))
                continue
        taken.add(path.lower())
        out.append((k, "move", path))
    return out


def test_ties_of_suffixed_paths_run_through_several_targets(spark):
    one, two = "abcdef" + "0" * 58, "123456" + "0" * 58
    rows = [(one, f"n{k}") for k in range(200)] + [(one, "a"), (one, "a"), (two, "A_abcdef"), (two, "a_abcdef"), (one, "a_abcdef_123456"), (two, "a_abcdef"), (two, "b"), (one, "b"), (one, "B")]
    targets = _targets(spark, rows)
    for found in (plan.fold(targets), plan.claims(targets)):
        assert sorted((r.document_id, r.status, r.final_path) for r in found.collect()) == _loop(rows)


def test_only_tied_targets_are_folded_together(spark):
    one = "abcdef" + "0" * 58
    rows = [(one, f"n{k}") for k in range(200)] + [(one, "a"), (one, "a"), (one, "a_abcdef")]
    found = plan._clashes(_targets(spark, rows), lambda df: df.localCheckpoint())
    assert sorted(map(tuple, found.collect())) == [("f/a.pdf", "f/a.pdf"), ("f/a_abcdef.pdf", "f/a.pdf")]
