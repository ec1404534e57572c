"""Whole runs: stages, repeated preparation, runs that break off, lookback in micro-batches, links of both kinds."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from digestflow.operators import dedup, digest, ingest, run, tables
from digestflow.sources import feeds
from digestflow.streaming import jobs

NOW = dt.datetime(2026, 9, 2, 12)
RAW = "source_id string, external_id string, original_url string, published_at timestamp, title string, raw_text string, raw_html string, documents array<string>, batch_pos long"
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()


def raw(spark, texts, at=NOW, first=0):
    rows = [("s", str(first + i), f"https://x.test/{first + i}", at + dt.timedelta(minutes=i), None, t, None, None, first + i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, RAW).withColumn("attachments", F.array().cast(feeds.ATTACHMENTS))


def stored_of(spark, texts, at):
    items = raw(spark, texts, at, 100).withColumn("extracted_text", F.col("raw_text"))
    return ingest.normalize_materials(items, F.lit(at))[0]


def scorer(requests):
    return [json.dumps({"relevance_score": 0.9, "noise_score": 0.0, "uncertain": False, "reason": "r"}) for _ in requests]


def go(spark, items, stored, **more):
    scored = spark.createDataFrame([], "profile_id string, profile_version int, model string, prompt_version string, cluster_id string")
    profile = run.Profile("p", 1, "c", "all", tau=0.8)
    return run.feed_run(items, stored, scored, profile, F.lit(NOW + dt.timedelta(hours=1)), scorer, lambda r: ["A summary"] * len(r), **more)


def test_run_groups_with_the_lookback(spark):
    base = " ".join(WORDS)
    stored = stored_of(spark, [base + " stored", "an old text of its own"], NOW - dt.timedelta(days=2))
    items = raw(spark, [base + " new", base + " new", "something else entirely here", "an old text of its own", " "])
    stages = go(spark, items, stored)
    n = {r.stage: r.n for r in run.report(stages).collect()}
    # the copy of a new text and that of a stored one go; the near copy joins the stored text's cluster
    assert (n["materials"], n["new"], n["unique"], n["clusters"], n["accepted"], n["digest_items"], n["errors"]) == (4, 4, 2, 2, 2, 2, 1)
    assert {r.kind for r in stages["links"].collect()} == {"exact_content", "semantic"}
    sizes = sorted(r.n_members for r in stages["clusters"].collect())
    assert sizes == [1, 3]
    assert [r.code for r in stages["errors"].collect()] == ["empty_content"]


def test_run_against_a_ledger_changes_nothing_twice(spark):
    items, stored = raw(spark, ["first text", "second text"]), stored_of(spark, ["old"], NOW - dt.timedelta(days=1))
    one = go(spark, items, stored, vectors=None)
    ledger = tuple(tables.written(one[k], k) for k in ("digests", "digest_items", "posts"))
    again = go(spark, items, stored, vectors=None, ledger=ledger)
    assert [again[k].count() for k in ("digests", "digest_items", "posts")] == [0, 0, 0]
    # a run that broke off before its posts were in is completed
    half = go(spark, items, stored, vectors=None, ledger=(ledger[0], ledger[1], ledger[2].limit(0)))
    assert [half[k].count() for k in ("digests", "digest_items", "posts")] == [0, 0, 2]
    other = ledger[0].withColumn("channel_id", F.lit("elsewhere"))
    clash = go(spark, items, stored, vectors=None, ledger=(other, ledger[1].limit(0), ledger[2].limit(0)))
    assert [clash[k].count() for k in ("digests", "digest_items", "posts")] == [0, 0, 0]
    assert [r.code for r in clash["errors"].collect()] == ["digest_collision"]


ITEMS = "source_id string, external_id string, published_at timestamp, text string, batch_pos long"


def items_of(spark, texts, first=0):
    return spark.createDataFrame([("s", f"{first + i:03}", NOW + dt.timedelta(minutes=first + i), t, first + i) for i, t in enumerate(texts)], ITEMS)


def test_batches_look_back(spark, tmp_path):
    base = " ".join(WORDS)
    state = jobs.FeedTables(spark, f"file://{tmp_path}/t")
    jobs.process_batch(items_of(spark, [base + " a", "other words altogether"]), state, "1", lookback_days=7, tau=0.8)
    jobs.process_batch(items_of(spark, [base + " b"], 2), state, "2", lookback_days=7, tau=0.8)
    links = state.links.read().collect()
    assert [(r.kind, r.duplicate_of_id) for r in links] == [("semantic", state.materials.read().where("external_id = '000'").first().id)]


@pytest.mark.parametrize("table", ["links", "materials", "cursors"])
def test_a_run_that_breaks_off_is_repeated(spark, tmp_path, table, monkeypatch):
    items = items_of(spark, ["a", "b", "a"])
    state = jobs.FeedTables(spark, f"file://{tmp_path}/t")

    def broken(*args, **kwargs):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(getattr(state, table), "append", broken)
        with pytest.raises(RuntimeError):
            jobs.process_batch(items, state, "1")
    for _ in range(2):  # again, and again after all was written
        jobs.process_batch(items, state, "1")
        assert state.materials.read().count() == 3 and state.links.read().count() == 1
        assert [r.cursor.external_id for r in state.latest_cursors().collect()] == ["002"]


def test_retryable_errors_hold_a_source_back(spark, tmp_path):
    state = jobs.FeedTables(spark, f"file://{tmp_path}/t")
    errors = spark.createDataFrame([("s", "article_missing", True)], "source_id string, code string, retryable boolean")
    jobs.process_batch(items_of(spark, ["a"]), state, "1", errors=errors)
    assert state.materials.read().count() == 1 and state.latest_cursors().count() == 0
    assert [r.code for r in state.errors.read().collect()] == ["article_missing"]


def test_links_of_both_kinds(spark):
    ddl = "material_id string, duplicate_of_id string, kind string, similarity double"
    exact = spark.createDataFrame([("b", "a", "exact_content", 1.0)], ddl)
    semantic = spark.createDataFrame([("b", "a", "semantic", 1.0), ("c", "a", "semantic", 0.9)], ddl)
    assert {tuple(r) for r in dedup.all_links(exact, semantic).collect()} == {("b", "a", "exact_content", 1.0), ("c", "a", "semantic", 0.9)}


def brute_parts(text, room):
    """Longest heads that fit, given back to the last space or line end in their second half."""
    parts = []
    while len(text) > room:
        stop = next((i for i in range(room, room // 2 - 1, -1) if text[i] in "\n "), room)
        parts.append(text[:stop].rstrip())
        text = text[stop:].lstrip()
    return parts + [text] if text or not parts else parts


def test_parts_of_posts():
    rng = random.Random(7)
    for _ in range(500):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 80)))
        assert digest._pieces(text, 12) == brute_parts(text, 12)


def test_metadata_reaches_materials(spark):
    items = raw(spark, ["t"]).withColumns({"extracted_text": F.col("raw_text"), "metadata": F.lit('{"views":"3"}'), "attachment_errors": F.array(F.lit("f: no reference"))})
    assert [json.loads(r.metadata) for r in ingest.normalize_materials(items, F.lit(NOW))[0].collect()] == [{"views": "3", "extraction": {"attachment_errors": ["f: no reference"]}}]


def test_rows_are_numbered_over_ranges(spark):
    """A key with most rows, ties, null keys and null places; numbers as a window over whole keys gives them."""
    rng = random.Random(2)
    rows = [(rng.choice(["big"] * 8 + ["small", None]), rng.choice([None, *range(300)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o long, tie long")
    got = {r.tie: r.nr for r in tables.numbered(df, ["k"], ["o", "tie"], "nr").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2])), 1):
            want[r[2]] = i
    assert got == want
    assert tables.numbered(df.limit(0), ["k"], ["o"], "nr").count() == 0


def test_digest_ids_stream_over_their_items(spark):
    """The hash of the canonical JSON of all items in order, for a digest of many items and for small ones."""
    rows = [(p, 2, "c", i, f"c{i}", f'S "{i}" é', [f"https://x.test/{i}"], [NOW + dt.timedelta(minutes=i)]) for p, n in (("big", 3000), ("one", 1), ("two", 2)) for i in range(n)]
    random.Random(1).shuffle(rows)
    ddl = "profile_id string, profile_version int, channel_id string, position long, cluster_id string, summary string, source_links array<string>, source_dates array<timestamp>"
    got = {r.profile_id: r.id for r in digest.digest_ids(spark.createDataFrame(rows, ddl)).collect()}
    for p in ("big", "one", "two"):
        items = [{"position": r[3], "cluster_id": r[4], "summary": r[5], "source_links": r[6], "source_dates": [d.strftime("%Y-%m-%dT%H:%M:%SZ") for d in r[7]]} for r in sorted(rows, key=lambda r: r[3]) if r[0] == p]
        body = json.dumps({"profile_id": p, "profile_version": 2, "items": items}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert got[p] == hashlib.sha256(body.encode()).hexdigest()


def test_caps_are_taken_before_the_shuffle(spark):
    plan = feeds.capped(spark.range(10).selectExpr("concat('s', id % 2) AS source_id", "id AS batch_pos"), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
