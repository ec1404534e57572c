"""Counts of a run's stages."""

from digestflow.operators import run


def test_stages_are_counted_one_by_one(spark):
    """The report's own query reads counts, and has no stage's plan in it."""
    got = run.report({"some": spark.range(7).where("id > 2"), "none": spark.range(0), "joined": spark.range(5).join(spark.range(3), "id")})
    assert {r.stage: r.n for r in got.collect()} == {"some": 4, "none": 0, "joined": 3}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
