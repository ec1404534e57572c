"""Registered queries over the feed operators: the given tables, seen as the feed's tables, and DuckDB SQL for the same.

Adapters: documents are materials (source, doc_id as text, one minute apart from 2024-01-01); labels are scores; events
are items of the source event_type; pages are landed pages; customers are profiles; orders and lines are digests and
posts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from digestflow.functions import text as T
from digestflow.functions import urls as U
from digestflow.operators import contracts, dedup, digest, ingest, registry, screening, tables
from digestflow.sources import feeds, pages
from digestflow.streaming import jobs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables.bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("external_id"),
        F.format_string("https://%s.example.test/doc/%d", "source", "doc_id").alias("original_url"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("published_at"),
        F.col("text").alias("extracted_text"), F.col("doc_id").alias("batch_pos"),
    )


def materials(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Documents by their number, with content hash: the rows that dedup works on.

    spread: dealt out before hashing, as a table of one row group is one partition.
    """
    d = table(spark, sf_dir, "documents")
    d = d.repartition("doc_id") if spread else d
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_id"), T.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("published_at"), F.col("doc_id").alias("batch_pos"), "text",
    )


def items_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("source_id"), F.col("event_id").cast("string").alias("external_id"), F.col("ts").cast("timestamp").alias("published_at"), F.col("props").alias("text"), F.col("event_id").alias("batch_pos"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    both = d.select("doc_id", "source").join(s, "doc_id", "left")
    return both.select("doc_id", "source", F.col("quality").cast("double").alias("relevance_score"), F.col("toxic").cast("double").alias("noise_score"), F.col("quality").isNull().alias("uncertain"))


CANON = r"lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"
SCORES = "(SELECT d.doc_id, d.source, l.quality, l.toxic, l.doc_id IS NULL OR (l.quality >= 0.6 AND l.toxic <= 0.7) AS accepted FROM documents d LEFT JOIN labels l USING (doc_id))"


@query(f"""SELECT s.source, count(*) AS n_documents, count(*) FILTER (u) AS n_unique, count(*) FILTER (u AND accepted) AS n_accepted
FROM (SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY {CANON}) AS u FROM documents) JOIN {SCORES} s USING (doc_id) GROUP BY s.source""")
def screen_counts(spark, sf_dir):
    """Per source: documents, those that are no reprint, and of these the ones that survive screening."""
    unique, _ = dedup.exact(materials(spark, sf_dir), materials(spark, sf_dir).limit(0))
    rated = scores(spark, sf_dir).withColumn("accepted", screening.verdict())
    both = rated.join(unique.select(F.col("id").alias("doc_id"), F.lit(True).alias("u")), "doc_id", "left")
    return both.groupBy("source").agg(F.count("*").alias("n_documents"), F.count("u").alias("n_unique"), F.count_if(F.col("u") & F.col("accepted")).alias("n_accepted"))


@query(f"SELECT doc_id AS material_id, m AS duplicate_of_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {CANON}) AS m FROM documents) WHERE doc_id <> m")
def exact_duplicate_links(spark, sf_dir):
    m = materials(spark, sf_dir)
    return dedup.exact(m, m.limit(0))[1].select("material_id", "duplicate_of_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {CANON}) AS m FROM documents) WHERE doc_id = m")
def unique_materials(spark, sf_dir):
    m = materials(spark, sf_dir)
    return dedup.exact(m, m.limit(0))[0].select(F.col("id").alias("doc_id"))


@query("SELECT doc_id, sha256(source || chr(31) || doc_id::VARCHAR) AS id FROM documents")
def material_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.material_id(F.col("source"), F.col("doc_id").cast("string")).alias("id"))


LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"


@query(f"""SELECT sha256(source || chr(31) || doc_id::VARCHAR) AS id, doc_id::VARCHAR AS external_id, left({LINES}[1], 240) AS title,
length(array_to_string({LINES}, chr(10) || chr(10)))::BIGINT AS n_chars, 'https://' || source || '.example.test/doc/' || doc_id AS original_url FROM documents WHERE len({LINES}) > 0""")
def normalized_materials(spark, sf_dir):
    rows, _ = ingest.normalize_materials(items_of_documents(spark, sf_dir), F.lit("2024-06-01").cast("timestamp"))
    return rows.select("id", "external_id", "title", F.char_length("text").cast("long").alias("n_chars"), "original_url")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def known_id_antijoin(spark, sf_dir):
    m = materials(spark, sf_dir)
    return dedup.drop_known(m, m.where("id % 3 = 0")).select(F.col("id").alias("doc_id"))


@query(f"""WITH d AS (SELECT doc_id, {CANON} AS h FROM documents), s AS (SELECT h, min(doc_id) AS s FROM d WHERE doc_id % 2 = 0 GROUP BY h),
n AS (SELECT doc_id, h, min(doc_id) OVER (PARTITION BY h) AS f FROM d WHERE doc_id % 2 = 1)
SELECT doc_id AS material_id, coalesce(s, f) AS duplicate_of_id FROM n LEFT JOIN s USING (h) WHERE doc_id <> coalesce(s, f)""")
def stored_hash_lookup(spark, sf_dir):
    """Even documents are stored, odd ones new: stored ones win."""
    m = materials(spark, sf_dir)
    return dedup.exact(m.where("id % 2 = 1"), m.where("id % 2 = 0"))[1].select("material_id", "duplicate_of_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-18 00:00:00'")
def fresh_events(spark, sf_dir):
    return ingest.fresh(items_of_events(spark, sf_dir), F.lit("2024-01-25").cast("timestamp"), 7).select(F.col("batch_pos").alias("event_id"))


@query("SELECT event_id, epoch_us(ts) AS us FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00'")
def lookback_events(spark, sf_dir):
    """The backfill's explicit bound instead of the profile's days."""
    rows = ingest.fresh(items_of_events(spark, sf_dir), F.lit("2024-01-25").cast("timestamp"), 7, F.lit("2024-01-20 12:00:00").cast("timestamp"))
    return rows.select(F.col("batch_pos").alias("event_id"), F.unix_micros("published_at").alias("us"))


def half_way(spark, sf_dir) -> DataFrame:
    """Cursors of the sources at the middle of January, none for one of them."""
    seen = items_of_events(spark, sf_dir).where("published_at < timestamp '2024-01-15'")
    none = seen.limit(0).select("source_id").withColumn("cursor", F.lit(None).cast("struct<published_at:timestamp,external_id:string,message_id:bigint>"))
    found = ingest.next_cursors(seen, none)
    return found.withColumn("cursor", F.when(F.col("source_id") != "view", F.col("cursor")))


HALF = "(SELECT event_type, CASE WHEN event_type <> 'view' THEN max((ts, event_id::VARCHAR)) END AS c FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1)"


@query(f"SELECT event_id FROM events LEFT JOIN {HALF} USING (event_type) WHERE c IS NULL OR (ts, event_id::VARCHAR) > c")
def after_cursor(spark, sf_dir):
    return ingest.after_cursor(items_of_events(spark, sf_dir), half_way(spark, sf_dir)).select(F.col("batch_pos").alias("event_id"))


@query(f"""SELECT event_type AS source_id, epoch_us(max(ts)) AS us, arg_max(event_id::VARCHAR, (ts, event_id::VARCHAR)) AS external_id FROM events
WHERE event_type <> (SELECT min(event_type) FROM events) GROUP BY 1""")
def next_cursors(spark, sf_dir):
    """All sources move on but the first by name, which has a retryable error."""
    e = items_of_events(spark, sf_dir)
    errors = e.agg(F.min("source_id").alias("source_id")).withColumn("retryable", F.lit(True))
    c = ingest.next_cursors(e, half_way(spark, sf_dir), errors)
    return c.select("source_id", F.unix_micros("cursor.published_at").alias("us"), "cursor.external_id")


@query(f"""SELECT event_type AS source_id, epoch_us(max(ts)) AS us FROM events GROUP BY 1""")
def commit_cursors(spark, sf_dir):
    old = half_way(spark, sf_dir)
    table_, unknown = ingest.commit_cursors(old, ingest.next_cursors(items_of_events(spark, sf_dir), old))
    return table_.select("source_id", F.unix_micros("cursor.published_at").alias("us"))


@query("SELECT event_type AS source_id, max(event_id) AS message_id FROM events GROUP BY 1")
def message_cursors(spark, sf_dir):
    e = items_of_events(spark, sf_dir)
    c = ingest.next_cursors(e, half_way(spark, sf_dir), by_message=True)
    return c.select("source_id", "cursor.message_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 50")
def newest_per_source(spark, sf_dir):
    return feeds.capped(items_of_events(spark, sf_dir), 50, newest=True).select(F.col("batch_pos").alias("event_id"))


@query(f"SELECT doc_id FROM {SCORES} WHERE accepted")
def screen_accept(spark, sf_dir):
    return screening.accept(scores(spark, sf_dir)).select("doc_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def latest_per_group(spark, sf_dir):
    return screening.latest(table(spark, sf_dir, "conversations"), "conv_id", F.desc("turn")).select("conv_id", "turn", "role")


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '[?&]utm_source=[^&]*', ''), '/$', '') AS url FROM pages""")
def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.canonicalize_url(F.col("url")).alias("url"))


@query(r"""SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www\.', '') AS label,
CASE WHEN regexp_matches(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '\.(rss|xml|atom)$|/feed') THEN 'native_rss' ELSE 'universal_scraper' END AS collector FROM pages""")
def link_labels(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.link_label(F.col("url")).alias("label"), U.infer_collector(F.col("url")).alias("collector"))


@query(r"""WITH l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS base, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages)
SELECT page_id, base || h AS url FROM l WHERE h LIKE '/%' GROUP BY ALL""")
def page_links(spark, sf_dir):
    return pages.discover_links(table(spark, sf_dir, "pages")).select("page_id", "url")


# references of HTML hold without their semicolon too (a heading may be cut within one); a heading without text is none
@query(r"""SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '') AS title FROM pages""")
def page_titles(spark, sf_dir):
    return pages.clean_pages(table(spark, sf_dir, "pages")).select("page_id", "title")


@query()
def page_texts(spark, sf_dir):
    """Clean text of every page, normalized, with its hash; pages without text are missing."""
    clean = pages.clean_pages(table(spark, sf_dir, "pages")).where("text IS NOT NULL")
    return clean.select("page_id", T.display_text("text").alias("text"), T.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT 'pages' AS source_id, 'article_date_missing' AS code, false AS retryable, count(*) AS n_errors FROM pages HAVING count(*) > 0")
def page_errors(spark, sf_dir):
    """Every page is an article without a date."""
    p = table(spark, sf_dir, "pages").dropDuplicates(["page_id"])
    p = p.select(F.concat("url", F.lit("#"), F.col("page_id")).alias("url"), "html", "page_id")
    links = p.select(F.lit("pages").alias("source_id"), "url", F.lit(None).cast("string").alias("title"), F.col("page_id").alias("pos"))
    return tables.error_summary(pages.pages_to_raw_items(links, p)[1])


PAIRS = "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4"


@query(PAIRS)
def similar_pairs_vec(spark, sf_dir):
    return dedup.similarity_pairs(vectors(spark, sf_dir), 0.4).select("a", "b")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT vec_id + 1000000000 * k AS id, list_transform(e, lambda x, i: x + k * (((vec_id * 31 + i * 17) % 11) - 5) / 200.0) AS e
FROM v, (SELECT unnest([0, 1, 2]) AS k)) SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM d a JOIN d b ON a.id < b.id
WHERE list_cosine_similarity(a.e, b.e) >= 0.8""")
def banded_pairs_vec(spark, sf_dir):
    """Vectors with two shifted copies each, by bands: every pair at 0.8 or more that comparing all finds (recall 1)."""
    return dedup.similarity_pairs(shifted_vectors(spark, sf_dir), 0.8, mode="bands", bits=8).select("a", "b", F.round("similarity", 6).alias("similarity"))


def shifted_vectors(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("transform(embedding, x -> cast(x AS double))").alias("e"), F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    moved = F.transform("e", lambda x, i: x + F.col("k") * ((F.col("vec_id") * 31 + (i + 1) * 17) % 11 - 5) / 200.0)
    return v.select((F.col("vec_id") + F.lit(1000000000) * F.col("k")).alias("id"), moved.alias("vec"))


def vectors(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("vec_id").alias("pos"))


def leaders(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf_dir)
    pairs = tables.written(dedup.similarity_pairs(v, 0.4), "pairs")
    return tables.written(dedup.greedy_leaders(v.select("id", "pos"), pairs), "leaders"), pairs


LEADERS = """RECURSIVE e AS (SELECT b.vec_id AS id, list(a.vec_id) AS before FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4 GROUP BY 1),
v AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n, coalesce(before, []) AS before FROM embeddings LEFT JOIN e ON id = vec_id),
w AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS l UNION ALL SELECT v.n, CASE WHEN list_has_any(v.before, w.l) THEN w.l ELSE list_append(w.l, v.vec_id) END FROM w JOIN v ON v.n = w.n + 1),
f AS (SELECT unnest(l) AS vec_id FROM (SELECT l FROM w ORDER BY n DESC LIMIT 1))"""


@query(f"WITH {LEADERS} SELECT vec_id FROM f")
def leaders_vec(spark, sf_dir):
    return leaders(spark, sf_dir)[0].where("leader").select(F.col("id").alias("vec_id"))


@query(f"""WITH {LEADERS}, m AS (SELECT f.vec_id AS rep, v.vec_id AS id FROM f JOIN v ON list_contains(v.before, f.vec_id) WHERE v.vec_id NOT IN (SELECT vec_id FROM f)
UNION ALL SELECT vec_id, vec_id FROM f) SELECT rep::VARCHAR AS representative_id, count(*) AS n_members, sum(id)::BIGINT AS id_sum FROM m GROUP BY rep HAVING max(id % 2) = 1""")
def clusters_vec(spark, sf_dir):
    """Odd vectors are new, even ones the lookback: clusters with a new member."""
    found, pairs = leaders(spark, sf_dir)
    c, _ = dedup.clusters(found, pairs, vectors(spark, sf_dir).where("id % 2 = 1").select("id"))
    return c.groupBy("representative_id").agg(F.count("*").alias("n_members"), F.sum(F.col("material_id").cast("long")).alias("id_sum"))


@query()
def similar_docs(spark, sf_dir):
    """Pairs of unique documents whose whole texts the default encoder finds alike, by bands of signs."""
    m = tables.written(materials(spark, sf_dir, spread=True), "hashed")
    unique, _ = dedup.exact(m, m.limit(0))
    texts = unique.select("id", T.dedup_text(F.lit(""), F.coalesce("text", F.lit(""))).alias("dedup_text"))
    pairs = dedup.similarity_pairs(dedup.encode(texts), 0.9, mode="bands")
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


def document_clusters(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A cluster per unique document, with its exact duplicates attached, as rows of members, and the materials."""
    m = materials(spark, sf_dir)
    hashed = tables.written(m.select("id", "content_hash", "published_at", "batch_pos"), "hashed")
    unique, links = dedup.exact(hashed, hashed.limit(0))
    own = F.col("id").cast("string")
    c = unique.select(own.alias("representative_id"), own.alias("material_id"), F.lit(1.0).alias("similarity"))
    mats = m.select("id", F.substring("text", 1, 60).alias("title"), "text", F.concat(F.lit("https://x.test/"), "id").alias("original_url"), "published_at")
    return tables.written(dedup.identified(dedup.attach_exact(c, links)), "document-clusters"), mats


@query(f"""SELECT min(doc_id)::VARCHAR AS representative_id, count(*) AS n_members, sha256(array_to_string(list_sort(list(doc_id::VARCHAR)), chr(31))) AS id FROM documents GROUP BY {CANON}""")
def attached_clusters(spark, sf_dir):
    c, _ = document_clusters(spark, sf_dir)
    return c.where("pos = 0").select("representative_id", "n_members", "id")


@query(rf"""WITH d AS (SELECT {CANON} AS c, length(doc_id::VARCHAR) + length(to_json(left(coalesce(text, ''), 60))::VARCHAR) + 37 AS head,
    to_json(left(coalesce(text, ''), 16000))::VARCHAR AS j, substr(j, 2, length(j) - 2) AS e FROM documents),
g AS (SELECT c, count(*) AS n, sum(head) + count(*) + 1 AS used FROM d GROUP BY c),
m AS (SELECT c, length(regexp_replace(left(e, ((16000 - used) // n)::BIGINT), '(^|[^\\])((?:\\\\)*)\\(?:u[0-9A-Fa-f]{{0,3}})?$', '\1\2')) AS k FROM d JOIN g USING (c) WHERE used + n <= 16000)
SELECT (SELECT count(*) FROM g WHERE used + n <= 16000) AS n_requests, (SELECT sum(k) FROM m)::BIGINT + (SELECT sum(used) FROM g WHERE used + n <= 16000)::BIGINT AS n_chars,
    (SELECT count(*) FROM g WHERE used + n > 16000) AS n_errors""")
def screening_requests(spark, sf_dir):
    """How many clusters are asked about, in how many characters, and how many have too many members for a request."""
    c, m = document_clusters(spark, sf_dir)
    rows, errors = screening.pack_prompts(c, m, 16_000)
    sums = rows.agg(F.count("*").alias("n_requests"), F.sum(F.char_length("documents")).alias("n_chars"))
    return sums.join(F.broadcast(errors.agg(F.count("*").alias("n_errors"))), F.lit(True))


def answers(spark, sf_dir) -> DataFrame:
    """Answers of a deterministic scorer; every seventh has a key too many, every eleventh is fenced."""
    s = scores(spark, sf_dir).withColumn("reason", F.col("source"))
    body = F.to_json(F.struct("relevance_score", "noise_score", "uncertain", "reason"))
    full = s.where("relevance_score IS NOT NULL")
    extra = F.to_json(F.struct("relevance_score", "noise_score", "uncertain", "reason", F.lit(1).alias("more")))
    text = F.when(F.col("doc_id") % 7 == 0, extra).when(F.col("doc_id") % 11 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return full.select(F.col("doc_id").cast("string").alias("cluster_id"), text.alias("response"))


@query("SELECT doc_id::VARCHAR AS cluster_id, quality::DOUBLE AS relevance_score, toxic::DOUBLE AS noise_score FROM documents JOIN labels USING (doc_id) WHERE doc_id % 7 <> 0")
def parsed_scores(spark, sf_dir):
    rows, _ = screening.screening_rows(answers(spark, sf_dir), "p", 1, "fake", "v1", F.lit("2024-06-01").cast("timestamp"))
    return rows.select("cluster_id", "relevance_score", "noise_score")


@query("SELECT doc_id::VARCHAR AS cluster_id FROM documents JOIN labels USING (doc_id) WHERE doc_id % 7 = 0")
def invalid_answers(spark, sf_dir):
    return screening.screening_rows(answers(spark, sf_dir), "p", 1, "fake", "v1", F.lit("2024-06-01").cast("timestamp"))[1].select("cluster_id")


@query(f"SELECT min(doc_id)::VARCHAR AS representative_id FROM documents GROUP BY {CANON} HAVING min(doc_id) % 5 <> 0")
def needs_scoring(spark, sf_dir):
    c, _ = document_clusters(spark, sf_dir)
    done = c.where((F.col("pos") == 0) & (F.col("representative_id").cast("long") % 5 == 0)).select(F.col("id").alias("cluster_id"), F.lit("p").alias("profile_id"), F.lit(1).alias("profile_version"), F.lit("m").alias("model"), F.lit("v1").alias("prompt_version"))
    return screening.needs_scoring(c, done, "p", 1, "m", "v1").where("pos = 0").select("representative_id")


@query("""SELECT doc_id::VARCHAR AS cluster_id, quality = 1 AND toxic = 0 AS accepted FROM documents JOIN labels USING (doc_id) ORDER BY doc_id DESC LIMIT 50""")
def screening_review(spark, sf_dir):
    """Documents scored one minute after the other: the newest fifty with today's verdict."""
    s = scores(spark, sf_dir).where("NOT uncertain")
    rows = s.select(F.col("doc_id").cast("string").alias("cluster_id"), F.lit("p").alias("profile_id"), F.timestamp_seconds(F.col("doc_id") * 60).alias("created_at"), F.lit("m").alias("model"), F.lit("v").alias("prompt_version"), "relevance_score", "noise_score", "uncertain")
    own = F.col("doc_id").cast("string")
    d = table(spark, sf_dir, "documents")
    c = d.select(own.alias("id"), own.alias("representative_id"))
    m = d.select("doc_id", "source").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.lit("https://x.test/").alias("original_url"))
    return screening.review(rows, c, m, "p", 50).select("cluster_id", "accepted")


@query(f"""SELECT min(doc_id)::VARCHAR AS representative_id, count(*) AS n_links, list(doc_id ORDER BY doc_id)[1] AS first_id FROM documents
GROUP BY {CANON} HAVING length(trim(left(min_by(text, doc_id), 600))) > 0""")
def digest_items(spark, sf_dir):
    c, m = document_clusters(spark, sf_dir)
    summaries = c.where("pos = 0").select(F.col("id").alias("cluster_id"), F.col("representative_id").cast("long").alias("rep")).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rep"), F.regexp_replace(F.substring("text", 1, 600), "(?i)https?://", "").alias("summary")), "rep")
    items, _ = digest.digest_items(summaries, c, m)
    first = F.regexp_extract(F.get("source_links", F.lit(0)), "/([0-9]+)$", 1).cast("long")
    return items.select(F.col("rep").cast("string").alias("representative_id"), F.size("source_links").cast("long").alias("n_links"), first.alias("first_id"))


@query()
def digest_posts(spark, sf_dir):
    """Documents, whole, as digest items, one digest per source: posts of at most 1000 characters."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    items = d.select(F.col("source").alias("digest_id"), F.col("doc_id").alias("position"), digest.html_escaped(F.col("text")).alias("text"))
    return digest.split_posts(items, "Digest", 1000)


def ledger(spark, sf_dir) -> DataFrame:
    """Orders as digests, their line numbers as posts; a post with a line of return flag N isn't sent."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(F.col("l_returnflag") == "N").alias("open"), F.max("l_shipdate").alias("day"))
    return li.select(
        F.col("l_orderkey").alias("digest_id"), F.col("l_linenumber").cast("int").alias("position"), F.lit("post").alias("text"),
        F.when(~F.col("open"), F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("message_id"), F.when(~F.col("open"), F.col("day").cast("timestamp")).alias("sent_at"),
    )


LEDGER = "(SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'N') AS open, max(l_shipdate) AS day FROM lineitem GROUP BY 1, 2)"


@query(f"""SELECT l_orderkey AS digest_id, list(l_orderkey * 10 + l_linenumber ORDER BY l_linenumber)::VARCHAR AS message_ids, epoch_us(max(day)::TIMESTAMP) AS us
FROM {LEDGER} GROUP BY 1 HAVING bool_and(NOT open)""")
def delivery_receipts(spark, sf_dir):
    r = digest.delivery_receipts(ledger(spark, sf_dir))
    return r.select("digest_id", F.concat(F.lit("["), F.array_join("message_ids", ", "), F.lit("]")).alias("message_ids"), F.unix_micros("sent_at").alias("us"))


@query(f"SELECT l_orderkey AS digest_id, l_linenumber::BIGINT AS position FROM {LEDGER} WHERE open")
def pending_posts(spark, sf_dir):
    p = ledger(spark, sf_dir)
    return digest.pending_posts(p, p.where("message_id IS NOT NULL")).select("digest_id", F.col("position").cast("long").alias("position"))


@query(f"SELECT l_orderkey AS digest_id, l_linenumber::BIGINT AS position, l_orderkey * 10 + l_linenumber AS message_id FROM {LEDGER}")
def applied_receipts(spark, sf_dir):
    """Every post is confirmed twice; the first receipt of those that weren't sent counts."""
    p = ledger(spark, sf_dir)
    log = p.select("digest_id", "position", (F.col("digest_id") * 10 + F.col("position")).alias("message_id"), F.lit("2024-01-02").cast("timestamp").alias("sent_at"))
    kept, _, _ = digest.apply_receipts(p, log.union(log))
    return kept.select("digest_id", F.col("position").cast("long").alias("position"), "message_id")


@query(f"SELECT o_orderkey AS id, count(*) AS n_posts FROM orders JOIN {LEDGER} ON l_orderkey = o_orderkey WHERE open GROUP BY 1")
def pending_digests(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("sent_at"))
    p = ledger(spark, sf_dir)
    return digest.pending_digests(o, p, p.where("message_id IS NOT NULL")).select("id", F.size("posts").cast("long").alias("n_posts"))


DUE_NOW = "TIMESTAMP '2024-01-15 07:17:00'"


@query(f"""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 7)::INT END AS w, (c_custkey % 24)::INT AS h, {DUE_NOW} + INTERVAL 3 HOUR AS t FROM customer),
a AS (SELECT *, date_trunc('day', t) - to_days((CASE WHEN w IS NULL THEN 0 ELSE (isodow(t) - 1 - w + 7) % 7 END)::INT) + to_hours(h) AS slot FROM c),
b AS (SELECT *, CASE WHEN slot > t THEN slot - to_days(CASE WHEN w IS NULL THEN 1 ELSE 7 END) ELSE slot END AS last_slot FROM a)
SELECT c_custkey, c_custkey % 10 = 1 OR (last_slot > t - INTERVAL 6 HOUR AND last_slot <= t) AS due FROM b""")
def delivery_due(spark, sf_dir):
    """Customers as profiles: one slot by number, every tenth without any."""
    c = table(spark, sf_dir, "customer")
    slot = F.struct(F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 7).cast("int").alias("weekday"), (F.col("c_custkey") % 24).cast("int").alias("hour"))
    slots = F.when(F.col("c_custkey") % 10 != 1, F.array(slot))
    return c.select("c_custkey", digest.due(slots, F.lit("2024-01-15 07:17:00").cast("timestamp")).alias("due"))


@query("""WITH RECURSIVE l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 4 AS k FROM events),
w AS (SELECT user_id, 1::BIGINT AS n, CASE WHEN k = 3 THEN 0 ELSE 1 END::BIGINT AS version, CASE WHEN k = 3 THEN 1 ELSE 0 END::BIGINT AS rejected FROM l WHERE n = 1
UNION ALL SELECT w.user_id, l.n,
  CASE WHEN (w.version = 0 AND k <> 3) OR (w.version > 0 AND k < 2) THEN w.version + 1 ELSE w.version END,
  CASE WHEN (w.version = 0 AND k <> 3) OR (w.version > 0 AND k < 2) THEN w.rejected ELSE w.rejected + 1 END
  FROM w JOIN l ON l.user_id = w.user_id AND l.n = w.n + 1)
SELECT user_id::VARCHAR AS profile_id, max(version) AS version, max(rejected) AS rejected FROM w GROUP BY 1""")
def profile_fold(spark, sf_dir):
    """A user's events as changes: the first valid one creates; then every fourth is blank and every fourth stale."""
    e = table(spark, sf_dir, "events")
    nr = F.col("event_id") % 4
    # what a change expects is the version that the good ones before it made
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    marked = e.select("user_id", "event_id", nr.alias("k"))
    marked = marked.withColumn("first_good", F.min(F.when(F.col("k") != 3, F.col("event_id"))).over(Window.partitionBy("user_id")))
    good = F.when((F.col("event_id") == F.col("first_good")) | ((F.col("event_id") > F.col("first_good")) & (F.col("k") < 2)), 1).otherwise(0)
    marked = marked.withColumn("expected", F.coalesce(F.sum(good).over(w), F.lit(0)).cast("int"))
    log = marked.select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("profile_id"), F.when(F.col("expected") == 0, "create").otherwise("update").alias("op"),
        (F.col("expected") - F.when((F.col("k") == 2) & (F.col("expected") > 0), 1).otherwise(0)).alias("expected_version"), F.when(F.col("k") == 3, " ").otherwise("about x").alias("description"),
        F.lit(None).cast("int").alias("freshness_days"), F.lit(None).cast("string").alias("summary_length"),
    )
    state, rejected = registry.fold_profiles(log)
    n = rejected.groupBy("profile_id").agg(F.count("*").alias("rejected"))
    return state.select("profile_id", F.col("version").cast("long").alias("version")).join(n, "profile_id", "left").fillna(0, ["rejected"])


@query("""WITH l AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 2 THEN 'delete' ELSE 'add' END AS op FROM events),
a AS (SELECT user_id, min(event_id) AS f FROM l WHERE op = 'add' GROUP BY 1), s AS (SELECT l.*, lag(op) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM l JOIN a USING (user_id))
SELECT user_id::VARCHAR AS id, arg_max(op, event_id) = 'add' AS enabled FROM s WHERE op IS DISTINCT FROM b AND NOT (op = 'delete' AND b IS NULL) GROUP BY 1""")
def source_fold(spark, sf_dir):
    """A user's events add and delete one locator, in capitals every second time."""
    e = table(spark, sf_dir, "events")
    u = F.col("user_id").cast("string")
    url = F.concat(F.when(F.col("event_id") % 2 == 0, "HTTPS://U.test/").otherwise("https://u.test/"), u)
    log = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 2, "delete").otherwise("add").alias("op"), u.alias("id"), url.alias("locator"), F.lit("website").alias("kind"))
    return registry.fold_sources(log)[0].select("id", "enabled")


@query("SELECT (SELECT count(*) FROM documents) AS collected, (SELECT count(*) FROM labels) AS scored, (SELECT count(*) FROM pages) AS pages")
def run_report(spark, sf_dir):
    return tables.run_report(collected=table(spark, sf_dir, "documents"), scored=table(spark, sf_dir, "labels"), pages=table(spark, sf_dir, "pages"))


@query("SELECT conv_id, min(turn) AS turn FROM conversations WHERE conv_id % 2 = 1 GROUP BY 1")
def first_wins_append(spark, sf_dir):
    """Conversations with even numbers are stored; of the others the first turn comes in."""
    c = table(spark, sf_dir, "conversations")
    return tables.first_wins(c, c.where("conv_id % 2 = 0"), ["conv_id"], ["turn"]).select("conv_id", "turn")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 0")
def conflicting_rows(spark, sf_dir):
    """Even documents are the lookback; those that three divides are new with another source."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return dedup.combine(d.where("id % 2 = 0"), d.where("id % 3 = 0").withColumn("source", F.lit("other")))[1]


@query("""SELECT doc_id AS id, r AS rule FROM (SELECT doc_id, unnest([CASE WHEN length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) > 0 THEN NULL ELSE 'text_filled' END,
CASE WHEN doc_id % 4 = 0 THEN 'url_http' END, CASE WHEN doc_id % 9 = 0 THEN 'title_filled' END]) AS r FROM documents) WHERE r IS NOT NULL""")
def contract_violations(spark, sf_dir):
    """Every fourth document has an ftp URL, every ninth a blank title."""
    m = materials(spark, sf_dir).withColumn("original_url", F.when(F.col("id") % 4 == 0, "ftp://x/").otherwise("https://x.test/")).withColumn("title", F.when(F.col("id") % 9 == 0, " ").otherwise("t"))
    rules = {k: v for k, v in contracts.materials().items() if k != "id_sha256"}
    return contracts.violations(m, rules)


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'unknown_collector' WHEN 1 THEN 'collector_kind' WHEN 2 THEN 'cursor_kind' END AS rule FROM customer WHERE c_custkey % 4 < 3""")
def audited_sources(spark, sf_dir):
    """Customers as sources with one fault each, every fourth without."""
    k = F.col("c_custkey") % 4
    cursor = F.struct(F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("string").alias("external_id"), F.when(k == 2, 5).cast("bigint").alias("message_id"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("website").alias("kind"), F.when(k == 0, "other").when(k == 1, "web_preview").otherwise("native_rss").alias("collector"), cursor.alias("cursor"))
    return ingest.audit_sources(c)


@query("SELECT event_type AS source_id, count(*) AS n, epoch_us(max(ts)) AS us FROM events GROUP BY 1")
def stream_replay(spark, sf_dir):
    """The events as a stream that runs until nothing is left: stored materials and the last cursor of each source."""
    base = f"{tables.shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    items_of_events(spark, sf_dir).write.parquet(f"{base}/landing")
    state = jobs.FeedTables(spark, f"{base}/tables")
    schema = "source_id string, external_id string, published_at timestamp, text string, batch_pos bigint"
    jobs.run_available(spark, f"{base}/landing", schema, state, f"{base}/checkpoint", use_cursors=False)  # files in no order of time
    stored, cursors = state.materials.read(), state.latest_cursors()
    counted = stored.groupBy("source_id").agg(F.count("*").alias("n"))
    return counted.join(cursors.select("source_id", F.unix_micros("cursor.published_at").alias("us")), "source_id")
