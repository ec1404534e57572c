"""Registered queries over streams: whole runs from landed items to posts, their side outputs, and lookback over stored vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from digestflow.operators import run, tables
from digestflow.streaming import jobs, whole_run

from .feed_queries import CANON, table
from .run_queries import POSTS, by_fours, first_digit, lead_id, raw_documents

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


#: Files of a batch that takes all that has landed.
ALL_FILES = 1_000_000


def landed_run(spark, sf_dir, errors: bool = False, **options) -> whole_run.RunTables:
    """Documents landed in two halves, by time, and run as a stream of two batches, each half as it lands; with errors, each fiftieth is a row of a
    reader that failed, half of them to be tried again."""
    base = f"{tables.shared_dir(spark)}/run-{uuid.uuid4().hex}"
    n = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] + 1
    d, failed = F.col("batch_pos"), F.col("batch_pos") % 50 == 7 if errors else F.lit(False)
    error = F.when(failed, F.struct(F.lit("timeout").alias("code"), F.lit("no answer").alias("message"), (d % 100 == 7).alias("retryable")))
    rows = raw_documents(spark, sf_dir).withColumns({"title": F.lit(None).cast("string"), "metadata": F.lit(None).cast("string"), "error": error})
    columns = spark.createDataFrame([], whole_run.LANDED).columns
    rows = tables.written(rows.select(*columns), "raw")
    state = whole_run.RunTables(spark, f"{base}/tables")
    job = whole_run.Job(run.Profile("p", 1, "c", "all"), first_digit, lead_id, **options)
    for k in range(2):  # in order, in as many files as rows were read in
        rows.where((d * 2 >= n) == F.lit(bool(k))).write.mode("append").parquet(f"{base}/landing")
        whole_run.run_landed(spark, f"{base}/landing", state, f"{base}/checkpoint", job, files_per_batch=ALL_FILES)
    return state


#: t: the time of each batch k is that of its latest document, and what is more than 7 days (10,080 minutes) older isn't fresh, nor in its
#: lookback; m: fresh documents with text, their batch and group g; u: the first of equal texts.
BATCHES = f"""WITH RECURSIVE d AS (SELECT *, (doc_id * 2 >= (SELECT max(doc_id) + 1 FROM documents))::INT AS k FROM documents), t AS (SELECT k, max(doc_id) - 10080 AS cut FROM d GROUP BY k),
m AS (SELECT doc_id, source, doc_id // 4 AS g, k, cut, sha256(source || chr(31) || doc_id) AS id, {CANON} AS h FROM d JOIN t USING (k)
    WHERE doc_id >= cut AND trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) <> ''),
u AS (SELECT m.* FROM m JOIN (SELECT min(doc_id) AS doc_id FROM m GROUP BY h) USING (doc_id))"""
#: n: members of a batch's clusters: new ones of a group with what the batches before have stored of it; p: with exact copies of each.
REACHING = "n AS (SELECT DISTINCT u.k, u.g, m.doc_id, m.id FROM u JOIN m ON m.g = u.g AND (m.k < u.k AND m.doc_id >= u.cut OR m.doc_id = u.doc_id))"
SINGLE = "n AS (SELECT k, doc_id AS g, doc_id, id FROM u)"
COPIES = """p AS (SELECT k, g, doc_id, false AS copy, id AS of_id FROM n UNION ALL
    SELECT n.k, n.g, m.doc_id, true, n.id FROM m JOIN u USING (h) JOIN n ON n.doc_id = u.doc_id AND n.k = m.k WHERE m.doc_id <> u.doc_id)"""


@query(f"""{BATCHES}, {REACHING}, {COPIES}, {POSTS} SELECT 'Digest' || chr(10) || chr(10) || split_part(rest, chr(10), 1) AS post, count(*) AS n FROM w GROUP BY 1""")
def streamed_posts(spark, sf_dir):
    """From landed items to posts in two micro-batches; clusters of the second reach back to what the first has stored."""
    state = landed_run(spark, sf_dir, vectors=by_fours)
    return state.read("posts").groupBy(F.substring_index("text", "\n", 3).alias("post")).agg(F.count("*").alias("n"))


@query(f"""{BATCHES}, e AS (SELECT source, doc_id, (doc_id * 2 >= (SELECT max(doc_id) + 1 FROM documents))::INT AS k FROM documents WHERE doc_id % 50 = 7),
x AS (SELECT DISTINCT source, k FROM e WHERE doc_id % 100 = 7),
i AS (SELECT source, doc_id, (doc_id * 2 >= (SELECT max(doc_id) + 1 FROM documents))::INT AS k FROM documents WHERE doc_id % 50 <> 7 AND (SELECT true))
SELECT source AS source_id, coalesce((SELECT max(i.doc_id) FROM i WHERE i.source = s.source AND (i.source, i.k) NOT IN (FROM x)), -1) AS last_doc,
    (SELECT count(*) FROM e WHERE e.source = s.source) AS n_errors, (SELECT count(*) FROM e WHERE e.source = s.source AND doc_id % 100 = 7) AS n_retryable
FROM (SELECT DISTINCT source FROM documents) s""")
def stream_side_outputs(spark, sf_dir):
    """Readers' errors beside the items of a stream: each source's errors, and how far its cursor moved (not past a retryable one)."""
    state = landed_run(spark, sf_dir, errors=True, vectors=None).snapshot()
    errors = state.read("errors").where("code = 'timeout'").groupBy("source_id").agg(F.count("*").alias("n_errors"), F.count_if("retryable").alias("n_retryable"))
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct()
    none = {"n_errors": 0, "n_retryable": 0, "last_doc": -1}
    cursors = state.cursors().select("source_id", F.col("cursor.external_id").cast("bigint").alias("last_doc"))
    return sources.join(cursors, "source_id", "left").join(errors, "source_id", "left").fillna(none)


@query(f"""{BATCHES}, {SINGLE}, {COPIES}, {POSTS} SELECT 'stream-' || k AS batch_id,
    (SELECT count(DISTINCT source) FROM documents d WHERE (d.doc_id * 2 >= (SELECT max(doc_id) + 1 FROM documents))::INT = b.k) AS sources,
    (SELECT count(*) FROM documents d WHERE (d.doc_id * 2 >= (SELECT max(doc_id) + 1 FROM documents))::INT = b.k) AS collected_items,
    (SELECT count(*) FROM documents d WHERE (d.doc_id * 2 >= (SELECT max(doc_id) + 1 FROM documents))::INT = b.k AND trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '') AS extraction_failures,
    (SELECT count(*) FROM m WHERE m.k = b.k) AS stored_materials, (SELECT count(*) FROM u WHERE u.k = b.k) AS clusters,
    (SELECT count(*) FROM w WHERE w.k = b.k) AS digest_posts, b.k::BIGINT AS resumed_digests FROM (SELECT unnest([0, 1]) AS k) b""")
def run_reports(spark, sf_dir):
    """What each run of a stream counted while it wrote: sources, items, failures, materials, clusters, posts, digests still open."""
    return landed_run(spark, sf_dir, vectors=None).reports().drop("attempt")


# s: pairs, the earlier one by time and id first; e: those that each batch sees; w: its leaders, by rounds, as a row leads if all before it that it is
# similar to follow; l: members and leaders of clusters with a row of the batch
@query("""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, k, sha256('v' || chr(31) || vec_id || '-' || k) AS id, list_transform(embedding::DOUBLE[], lambda x, i: (x + k * (((vec_id * 31 + i * 17) % 11) - 5) / 200.0)::FLOAT::DOUBLE) AS e
    FROM embeddings, (SELECT unnest([0, 1, 2]) AS k)),
s AS MATERIALIZED (SELECT a.id AS before, a.k AS k, b.id AS after, b.k AS after_k, b.vec_id FROM v a JOIN v b ON a.k = b.k AND a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.9
    UNION ALL SELECT a.id, a.k, b.id, b.k, b.vec_id FROM v a JOIN v b ON a.k = b.k - 1 WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
e AS MATERIALIZED (SELECT batch, s.* FROM s, (SELECT unnest([0, 1, 2]) AS batch) WHERE after_k <= batch AND k >= batch - 1),
w AS (SELECT 0 AS round, batch, id, NULL::BOOLEAN AS lead FROM (SELECT batch, before AS id FROM e UNION SELECT batch, after FROM e)
    UNION ALL SELECT round + 1, w.batch, w.id, coalesce(lead, CASE WHEN led THEN false WHEN open THEN NULL ELSE true END)
    FROM w LEFT JOIN (SELECT e.batch, e.after AS id, bool_or(b.lead) AS led, bool_or(b.lead IS NULL) AS open FROM e JOIN w b ON b.batch = e.batch AND b.id = e.before GROUP BY 1, 2) d ON d.batch = w.batch AND d.id = w.id
    WHERE (SELECT bool_or(lead IS NULL) FROM w)),
f AS (SELECT batch, id, lead FROM w WHERE round = (SELECT max(round) FROM w)),
l AS (SELECT e.*, max(after_k) OVER (PARTITION BY e.batch, before) AS newest FROM e JOIN f a ON a.batch = e.batch AND a.id = before AND a.lead JOIN f b ON b.batch = e.batch AND b.id = after AND NOT b.lead)
SELECT vec_id, after_k AS copy, k AS copy_of FROM l WHERE newest = batch""")
def lookback_stream(spark, sf_dir):
    """Vectors and two shifted copies of each, three days apart, as three micro-batches that look back four days: each copy is
    linked to the one before, whose vector is stored, and to none further back; so is each to near copies that lead, once in each
    batch that adds to their cluster."""
    base, e = f"{tables.shared_dir(spark)}/lookback-{uuid.uuid4().hex}", table(spark, sf_dir, "embeddings")
    name = F.concat_ws("-", "vec_id", "k")
    rows = e.select("vec_id", F.explode(F.array(*map(F.lit, range(3)))).alias("k")).select(
        F.lit("v").alias("source_id"), name.alias("external_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("k") * 259200).alias("published_at"), name.alias("text"),
        F.col("vec_id").alias("batch_pos"), "k",
    )
    for k in range(3):
        rows.where(F.col("k") == k).drop("k").coalesce(1).write.mode("append").parquet(f"{base}/landing")

    def shifted(materials):
        own = materials.withColumns({"vec_id": F.split_part("external_id", F.lit("-"), F.lit(1)).cast("bigint"), "k": F.split_part("external_id", F.lit("-"), F.lit(2)).cast("int")})
        both = tables.shuffled(own).join(e.select("vec_id", F.expr("transform(embedding, x -> cast(x AS double))").alias("e")), "vec_id")
        return both.withColumn("vec", F.transform("e", lambda x, i: (x + F.col("k") * ((F.col("vec_id") * 31 + (i + 1) * 17) % 11 - 5) / 200.0).cast("float")))

    state = jobs.FeedTables(spark, f"{base}/tables")
    schema = "source_id string, external_id string, published_at timestamp, text string, batch_pos bigint"
    jobs.run_available(spark, f"{base}/landing", schema, state, f"{base}/checkpoint", files_per_batch=1, lookback_days=4, vectors=shifted, tau=0.9)
    m = state.materials.read().select("id", "external_id")
    found = state.links.read().join(tables.shuffled(m.toDF("material_id", "a")), "material_id").join(tables.shuffled(m.toDF("duplicate_of_id", "b")), "duplicate_of_id")
    part = lambda c, k: F.split_part(c, F.lit("-"), F.lit(k))
    return found.select(part("a", 1).cast("bigint").alias("vec_id"), part("a", 2).cast("int").alias("copy"), part("b", 2).cast("int").alias("copy_of"))


@query("""SELECT conv_id::VARCHAR AS source_id, max(turn) AS message_id, -1::BIGINT AS us, 'message' AS kind FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id
UNION ALL SELECT event_type, max(event_id) FILTER (ts = (SELECT max(ts) FROM events x WHERE x.event_type = e.event_type)), epoch_us(max(ts)), 'published' FROM events e GROUP BY event_type""")
def stateful_cursors(spark, sf_dir):
    """Cursors as a stream's state, in two micro-batches each: turns of conversations by number, events by time and identifier."""
    base, schema = f"{tables.shared_dir(spark)}/cursors-{uuid.uuid4().hex}", "source_id string, external_id string, published_at timestamp"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("source_id"), F.col("turn").cast("string").alias("external_id"), F.lit(None).cast("timestamp").alias("published_at"), (F.col("turn") % 2 == 0).alias("even"))
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("external_id"), F.col("ts").cast("timestamp").alias("published_at"), (F.col("event_id") % 2 == 0).alias("even"))
    found = []
    for kind, rows in (("message", turns), ("published", events)):
        for even in (True, False):
            rows.where(F.coalesce("even", F.lit(True)) == even).drop("even").coalesce(1).write.mode("append").parquet(f"{base}/{kind}")
        kept = tables.Table(spark, f"{base}/{kind}-table")
        jobs.run_cursors(spark, f"{base}/{kind}", schema, kept, f"{base}/{kind}-checkpoint", kind == "message", files_per_batch=1)
        last = kept.read(jobs.CURSORS).groupBy("source_id").agg(F.max("cursor").alias("c"))
        number = F.col("c.message_id") if kind == "message" else F.col("c.external_id").cast("bigint")
        found.append(last.select("source_id", number.alias("message_id"), F.coalesce(F.unix_micros("c.published_at"), F.lit(-1).cast("bigint")).alias("us"), F.lit(kind).alias("kind")))
    return found[0].unionByName(found[1])
