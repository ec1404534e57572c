"""Queries against their SQL on inputs that the small test tables don't have."""

import duckdb
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from digestflow.operators import dedup
from digestflow.plans import feed_queries, stream_queries


def assert_same(spark, path, name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        spark.createDataFrame(df).coalesce(1).write.parquet(f"{path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    got, want = queries()[name](spark, str(path)).toPandas(), con.execute(oracle_sql()[name]).fetchdf()
    assert sorted(map(str, got[sorted(got)].values.tolist())) == sorted(map(str, want[sorted(got)].values.tolist()))
    return got


def test_page_titles_cut_within_a_reference(spark, tmp_path):
    html = [f"<h1>{t}</h1>" for t in ("a &amp;&amp", "b &am", "c &lt;d&gt; &quot", " ")]
    got = assert_same(spark, tmp_path, "page_titles", pages=pd.DataFrame({"page_id": range(4), "url": "https://x.test/", "html": html}))
    assert "a &&" in set(got["title"])


def alike(n):
    return pd.DataFrame({"vec_id": range(n), "embedding": [[float((i // 3 * 7 + j * j) % 11 - 5) + i / 1000 for j in range(64)] for i in range(n)]})


def test_banded_pairs_of_different_vectors(spark, tmp_path):
    got = assert_same(spark, tmp_path, "banded_pairs_vec", embeddings=alike(6))
    assert ((got["b"] - got["a"]) % 1000000000 != 0).any()


def documents(ids, text):
    return pd.DataFrame({"doc_id": ids, "text": [text(i) for i in ids], "source": "web", "lang": "en"})


def test_feed_run_of_clusters_over_budget_and_of_many_posts(spark, tmp_path):
    ids = list(range(100, 1100))
    got = assert_same(spark, tmp_path, "feed_run", documents=documents(ids, lambda i: "many copies" if i % 2 and i < 500 else "some copies" if i % 2 and i < 620 else f"text {i}"))
    assert dict(got.values.tolist())["errors"] == 1


def test_run_reports_of_more_than_a_week(spark, tmp_path):
    got = assert_same(spark, tmp_path, "run_reports", documents=documents([*range(0, 3000, 100), *range(29000, 30000, 100), 59999], lambda i: f"text {i}"))
    assert set(got["stored_materials"]) == {10, 1}


def test_lookback_stream_of_different_vectors(spark, tmp_path):
    got = assert_same(spark, tmp_path, "lookback_stream", embeddings=alike(7))
    assert (got["copy"] == got["copy_of"]).any()


def test_encoder_gets_few_texts_at_a_time(spark):
    def encoder(texts):
        assert len(texts) <= dedup.PIECE
        return dedup.hashed_counts(texts, 8)

    rows = spark.range(0, 2000, 1, 1).select("id", F.concat(F.lit("word "), "id").alias("dedup_text"))
    assert dedup.encode(rows, encoder).where("size(vec) = 8").count() == 2000


def test_queries_bound_arrow_batches_by_bytes(spark, tmp_path):
    spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("0123456789"), 1000).alias("text")).write.parquet(f"{tmp_path}/t.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    found = [r.n for r in feed_queries.table(spark, str(tmp_path), "t").coalesce(1).mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) >= 3000 * 10000 and max(found) < 10e6


def test_landed_halves_keep_their_files(spark, tmp_path):
    spark.createDataFrame(documents(range(200), lambda i: f"text {i}")).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    state = stream_queries.landed_run(spark, str(tmp_path), vectors=None)
    assert state.reports().count() == 2
    landed = spark.read.parquet(state["posts"].path.removesuffix("tables/posts") + "landing")
    assert landed.select(F.input_file_name()).distinct().count() > 2
