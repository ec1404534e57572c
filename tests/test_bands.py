"""Pairs by bands: what moves besides the vectors, and blocks that rows are sent to whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from digestflow.operators import dedup


@pytest.fixture
def seen(monkeypatch):
    """name -> how many rows the first argument of a step of dedup has had."""
    counts = {}

    def watch(name):
        step = getattr(dedup, name)

        def counted(first, *rest):
            counts[name] = first.count()
            return step(first, *rest)

        monkeypatch.setattr(dedup, name, counted)

    for name in ("_verified", "_in_all_blocks"):
        if hasattr(dedup, name):
            watch(name)
    return counts


def frame(spark, m, kind="array<float>", ids=lambda i: f"v{i:04}"):
    return spark.createDataFrame([(ids(i), [float(x) for x in row]) for i, row in enumerate(m)], f"id string, vec {kind}")


def rows(df):
    return {(r.a, r.b): r.similarity for r in df.collect()}


def test_wide_vectors_move_for_likely_pairs_only(spark, seen):
    """Vectors with cosines of about 0.7, and some near ones: few of the former are verified by their vectors."""
    rng = np.random.default_rng(1)
    m = np.sqrt(0.7) * np.ones(600) + np.sqrt(0.3) * rng.standard_normal((150, 600))
    m[100:] = m[:50] + 0.05 * rng.standard_normal((50, 600))
    df = frame(spark, m)
    want, got = rows(dedup.similarity_pairs(df, 0.9)), rows(dedup.similarity_pairs(df, 0.9, mode="bands"))
    assert len(want) >= 50 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert seen["_verified"] < 1000  # of 11,175 pairs


@pytest.mark.parametrize("block", [2048, 32])
def test_a_pair_is_found_about_once(spark, seen, block):
    """Alike vectors agree in nearly all bands, in groups of a few and of more than a block."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((20, 16))
    m = np.array([base[0 if i < 80 else i % 20] + 0.1 * rng.standard_normal(16) for i in range(200)])
    df = frame(spark, m, "array<double>")
    want, got = rows(dedup.similarity_pairs(df, 0.9)), dedup.similarity_pairs(df, 0.9, mode="bands", block=block)
    assert len(want) > 3000 and seen["_in_all_blocks"] < 1.2 * len(want)
    assert rows(got).keys() == want.keys() and got.count() == len(want)


def test_blocks_of_rows_give_each_pair_once(spark, monkeypatch):
    """Many blocks, pairs within and across them, repeated pairs."""
    monkeypatch.setattr(dedup, "BLOCK_BYTES", 100)
    n = 300
    vectors = spark.range(n).select("id", F.encode(F.lpad(F.col("id").cast("string"), 8, "0"), "utf-8").alias("vec"))
    pairs = spark.range(n * 40).selectExpr(f"id % {n} AS a", f"(id * 7 + id div {n}) % {n} AS b").where("a != b").repartition(5)
    near = lambda x, y: np.where(x[:, -1] == y[:, -1], 1.0, np.nan)
    got = dedup._in_all_blocks(pairs.unionByName(pairs), vectors, "bigint", 8 * n, lambda v: dedup._flat(v, np.uint8), near).select("a", "b").collect()
    want = {(r.a, r.b) for r in pairs.where("a % 10 = b % 10").collect()}
    assert want and len(got) == len(want) and {tuple(r) for r in got} == want
    assert dedup._in_all_blocks(pairs.limit(0), vectors, "bigint", 8 * n, lambda v: dedup._flat(v, np.uint8), near).count() == 0
