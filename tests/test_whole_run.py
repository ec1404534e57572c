"""The whole run as a job: a crash between any two tables, snapshots, side outputs, stored vectors, repeated batches."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from digestflow.operators import run
from digestflow.streaming import whole_run

NOW = dt.datetime(2026, 9, 2, 12)
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def landed(spark, texts, first=0, error=None):
    rows = [("s", str(first + i), f"https://x.test/{first + i}", NOW + dt.timedelta(minutes=first + i), None, t, None, None, [], None, first + i, None) for i, t in enumerate(texts)]
    rows += [("bad", None, None, None, None, None, None, None, None, None, None, error)] if error else []
    return spark.createDataFrame(rows, whole_run.LANDED)


def scorer(requests):
    return [json.dumps({"relevance_score": 0.9, "noise_score": 0.0, "uncertain": False, "reason": "r"}) for _ in requests]


@pytest.fixture
def job():
    return whole_run.Job(run.Profile("p", 1, "c", "all", tau=0.8), scorer, lambda r: ["A summary"] * len(r))


def counts(state):
    return {n: state.read(n).count() for n in ("materials", "clusters", "screenings", "digests", "digest_items", "posts", "cursors")}


def test_a_run_that_breaks_off_anywhere_is_repeated(spark, tmp_path, job, monkeypatch):
    """Broken off at a table, and after all of them, readers see nothing of it; the repetition commits the whole, once."""
    state, items = whole_run.RunTables(spark, f"file://{tmp_path}/t"), landed(spark, [BASE + " a", "other words", "other words", " "])

    def broken(*args, **kwargs):
        raise RuntimeError("stopped")

    plain = whole_run.replace(job, vectors=None)
    with monkeypatch.context() as m:
        m.setattr(state["posts"], "append", broken)
        with pytest.raises(RuntimeError):
            whole_run.run_batch(items, state, "1", plain)
    assert not any(counts(state).values()) and state["materials"].read().count() == 3
    with monkeypatch.context() as m:  # after every table, before the commit
        m.setattr(state.commits, "append", broken)
        with pytest.raises(RuntimeError):
            whole_run.run_batch(items, state, "1", plain)
    assert not any(counts(state).values()) and state["posts"].read().count() == 2
    whole_run.run_batch(items, state, "1", plain)
    once = counts(state)
    assert once == {"materials": 3, "clusters": 2, "screenings": 2, "digests": 1, "digest_items": 2, "posts": 2, "cursors": 1}
    whole_run.run_batch(items, state, "1", plain)  # committed: nothing happens
    assert counts(state) == once and state.reports().count() == 1


def test_snapshots_side_outputs_and_stored_vectors(spark, tmp_path, job):
    state, encoded = whole_run.RunTables(spark, f"file://{tmp_path}/t"), spark.sparkContext.accumulator(0)

    def vectors(materials):
        def count(batches):
            for batch in batches:
                encoded.add(batch.num_rows)
                yield batch

        return run.encoded(materials.mapInArrow(count, materials.schema))

    job = whole_run.replace(job, vectors=vectors)
    whole_run.run_batch(landed(spark, [BASE + " a", "other words altogether"]), state, "1", job)
    before = state.snapshot()
    seen = before.read("materials").count()
    whole_run.run_batch(landed(spark, [BASE + " b"], 2, ("timeout", "no answer", True)), state, "2", job)
    # a snapshot stays what it was while others write
    assert before.read("materials").count() == seen == 2 and before.read("clusters").count() == 2
    now = state.snapshot()
    assert now.read("materials").count() == 3
    # the second batch found the first one's text by its stored vector: three texts were encoded, none twice
    assert encoded.value == 3 and now.read("vectors").count() == 3
    assert [r.kind for r in now.read("links").collect()] == ["semantic"]
    assert sorted(r.n_members for r in now.read("clusters").collect()) == [1, 1, 2] and now.read("members").count() == 4
    # the reader's error is kept, and its source has no cursor
    assert [(r.source_id, r.code, r.retryable) for r in now.read("errors").collect()] == [("bad", "timeout", True)]
    assert [(r.source_id, r.cursor.external_id) for r in now.cursors().collect()] == [("s", "2")]
    reports = {r.batch_id: r for r in state.reports().collect()}
    assert (reports["2"].sources, reports["2"].collected_items, reports["2"].stored_materials, reports["2"].clusters, reports["2"].digest_posts, reports["2"].resumed_digests) == (2, 1, 1, 1, 1, 1)
    # another batch without rows commits too
    whole_run.run_batch(landed(spark, []), state, "3", whole_run.replace(job, vectors=None))
    assert state.reports().count() == 3


def test_backfill_ignores_cursors(spark, tmp_path, job):
    state, plain = whole_run.RunTables(spark, f"file://{tmp_path}/t"), whole_run.replace(job, vectors=None)
    whole_run.run_batch(landed(spark, ["late"], 5), state, "1", plain)
    landed(spark, ["early", "earlier"]).write.parquet(f"{tmp_path}/landing")
    whole_run.run_batch(spark.read.schema(whole_run.LANDED).parquet(f"{tmp_path}/landing"), state, "2", plain)
    assert state.read("materials").count() == 1  # before the cursor
    whole_run.backfill(spark, f"{tmp_path}/landing", state, "all", whole_run.replace(plain, min_published_at=F.lit(NOW).cast("timestamp")))
    assert state.read("materials").count() == 3
    assert [r.cursor.external_id for r in state.snapshot().cursors().collect()] == ["5"]
