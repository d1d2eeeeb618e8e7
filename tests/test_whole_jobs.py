"""Queries that were once made smaller cover all their rows."""

from loomlake.plans.registry import QUERIES


def test_leading_questions_of_all_objects_and_parts(spark, sf):
    n = lambda t: spark.read.parquet(f"{sf}/{t}.parquet").count()
    assert QUERIES["f7_leading_question"](spark, sf).count() == n("part") + n("lineitem")


def test_references_keep_every_object(spark, sf):
    """Weak, rejected and surplus references are told, not dropped, and quality is asked of the selected ones only."""
    out = QUERIES["build_references"](spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert any(r.selected and not r.socratic for r in out) and all(r.selected for r in out if r.socratic)
    assert all((r.reject_reason is None) == r.selected and (r.kind is None) == (r["rank"] is None) for r in out)
