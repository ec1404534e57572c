"""Similarity pairs by bands against all pairs, and leaders against the sequential rule, in few rounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from digestflow.operators import dedup


def sequential(pos, pairs):
    """id -> whether it leads, taken in order of (pos, id)."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    lead = {}
    for i in sorted(pos, key=lambda i: (pos[i], i)):
        lead[i] = not any(lead.get(j) for j in near.get(i, ()))
    return lead


@pytest.fixture
def rounds(monkeypatch):
    """How many rounds an election has taken."""
    n, write = [0], dedup.written

    def counted(df, name):
        n[0] += name == "settled"
        return write(df, name)

    monkeypatch.setattr(dedup, "written", counted)
    return n


@pytest.mark.parametrize(("per_task", "most"), [(dedup.SETTLED, 1)])
def test_a_long_chain_takes_few_rounds(spark, rounds, per_task, most):
    n = 10_000
    nodes, pairs = spark.range(n).selectExpr("id", "id AS pos"), spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b")
    got = dedup.greedy_leaders(nodes, pairs, per_task)
    assert got.agg(F.count("*"), F.count_if(F.col("leader") == (F.col("id") % 2 == 0))).first() == (n, n)
    assert rounds[0] <= most


@pytest.mark.parametrize("per_task", [dedup.SETTLED, 400])
def test_leaders_are_those_of_the_sequential_rule(spark, per_task):
    """A random graph with a hub, repeated pairs, ties of position and rows without pairs."""
    rng = random.Random(per_task)
    pos = {i: rng.randrange(40) for i in range(300)}
    pairs = [tuple(sorted(rng.sample(range(280), 2))) for _ in range(500)] + [(0, i) for i in range(1, 200)]
    got = dedup.greedy_leaders(spark.createDataFrame(list(pos.items()), "id long, pos long"), spark.createDataFrame(pairs, "a long, b long"), per_task)
    assert {r.id: r.leader for r in got.collect()} == sequential(pos, pairs)
    none = dedup.greedy_leaders(spark.createDataFrame([(1, 5)], "id long, pos long"), spark.createDataFrame([], "a long, b long"))
    assert [(r.id, r.leader) for r in none.collect()] == [(1, True)]


@pytest.mark.parametrize("block", [2048, 16])
def test_bands_find_what_all_pairs_do(spark, block):
    """Groups of alike vectors, one of them above a block; zero and null vectors."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 24))
    rows = [(f"v{i:03}", [float(x) for x in base[0 if i < 60 else i % 12] + 0.1 * rng.standard_normal(24)]) for i in range(160)]
    rows += [("zero", [0.0] * 24), ("none", None)]
    df = spark.createDataFrame(rows, "id string, vec array<double>")
    exact = {(r.a, r.b): r.similarity for r in dedup.similarity_pairs(df, 0.9, block=block).collect()}
    bands = {(r.a, r.b): r.similarity for r in dedup.similarity_pairs(df, 0.9, mode="bands", block=block, bits=6).collect()}
    assert len(exact) > 1000 and bands.keys() == exact.keys()
    assert all(abs(bands[k] - exact[k]) < 1e-9 for k in exact)
    assert dedup.similarity_pairs(df.limit(0), 0.9, mode="bands").count() == 0


def test_texts_are_encoded_once(spark):
    df = spark.createDataFrame([(i, f"word{i} word{i + 1} word{i % 3}") for i in range(50)], "id long, dedup_text string")
    calls = spark.sparkContext.accumulator(0)

    def counting(texts):
        calls.add(len(texts))
        return dedup.hashed_counts(texts)

    dedup.similarity_pairs(dedup.encode(df, counting), 0.9, mode="bands").count()
    assert calls.value == 50


def test_edges_and_leaders_are_in_no_broadcast(spark, monkeypatch):
    """Tables of pairs take few bytes in Parquet where ids occur again, and many in the table of a broadcast join."""
    plans, write = [], dedup.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(dedup, "written", lambda df, name: (plans.append(plan(df)), write(df, name))[1])
    ids = [f"id-{i:064}" for i in range(60)]
    nodes = write(spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, pos long"), "nodes")
    pairs = write(spark.createDataFrame([(ids[i], ids[j], 0.95) for i in range(60) for j in range(i + 1, 60) if (i + j) % 7 == 0], "a string, b string, similarity double"), "pairs")
    leaders = dedup.greedy_leaders(nodes, pairs, 100)
    members, _ = dedup.clusters(write(leaders, "leaders"), pairs, nodes.select("id"))
    assert {r.id: r.leader for r in leaders.collect()} == sequential(dict(map(tuple, nodes.collect())), [(r.a, r.b) for r in pairs.collect()])
    assert len(plans) > 5 and not [p for p in [*plans, plan(leaders), plan(members)] if "BroadcastHashJoin" in p]
