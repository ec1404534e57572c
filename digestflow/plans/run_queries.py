"""Registered queries over whole runs, readers and composed digests, on feed files and items derived from the given tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from digestflow.functions import text as T
from digestflow.operators import dedup, digest, ingest, run, tables
from digestflow.sources import feeds, pages
from digestflow.streaming import jobs

from .feed_queries import CANON, LINES, items_of_documents, items_of_events, ledger, materials, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def first_digit(requests: list[str]) -> list[str]:
    """A deterministic scorer: relevant unless the first material's id begins with c, d, e or f."""
    out = []
    for request in requests:
        lead = json.loads(request.split("\n", 1)[1])[0]["material_id"]
        out.append(json.dumps({"relevance_score": 0.1 if lead[0] in "cdef" else 0.9, "noise_score": 0.0, "uncertain": False, "reason": "by id"}))
    return out


def lead_id(requests: list[str]) -> list[str]:
    return ["Item " + json.loads(r.split("\n", 1)[1])[0]["material_id"][:8] for r in requests]


def raw_documents(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = items_of_documents(spark, sf_dir).withColumnRenamed("extracted_text", "raw_text")
    return rows.select("*", none.alias("raw_html"), F.lit(None).cast("array<string>").alias("documents"), F.array().cast(feeds.ATTACHMENTS).alias("attachments"))


#: p (k, g, doc_id, copy, of_id): the members of clusters, copies with the member they copy -> j: how many characters of a request a
#: member's id and title take; r: clusters, and whether these leave a character of 16,000 to each text (else there is no request, but an
#: error); w: their posts from where each begins: an item is cut at the last space or line end within 4,096 characters with the header,
#: unless that is in the first half.
POSTS = f"""j AS (SELECT k, g, doc_id, copy, of_id, source, sha256(source || chr(31) || doc_id) AS id, length(to_json(left({LINES}[1], 240))::VARCHAR) + 101 AS head FROM p JOIN documents USING (doc_id)),
r AS (SELECT k, g, arg_min(id, doc_id) FILTER (NOT copy) AS rep, sum(head) + 2 * count(*) + 1 <= 16000 AS fits FROM j GROUP BY k, g),
o AS (SELECT k, g, rep, source, doc_id, row_number() OVER (PARTITION BY k, g ORDER BY copy, of_id <> rep, of_id, doc_id) AS i FROM j JOIN r USING (k, g) WHERE fits AND rep < 'c'),
w AS (SELECT k, g, '• Item ' || left(rep, 8) || chr(10) || 'Источники:' || chr(10) || string_agg(i || '. <a href="https://' || source || '.example.test/doc/' || doc_id || '">' || source || '.example.test</a>' || chr(10)
        || strftime(TIMESTAMP '2024-01-01 03:00:00' + to_minutes(doc_id), '%d.%m.%Y'), chr(10) ORDER BY i) AS rest FROM o GROUP BY k, g, rep
    UNION ALL SELECT k, g, regexp_replace(substr(rest, CASE WHEN b >= 2044 THEN b ELSE 4088 END + 1), '^\\s+', '') FROM (SELECT *, length(regexp_extract(left(rest, 4089), '^((?:.|\\n)*)[ \\n]', 1)) AS b FROM w WHERE length(rest) > 4088))"""

RUN = f"""WITH RECURSIVE m AS (SELECT doc_id, doc_id // 4 AS g, sha256(source || chr(31) || doc_id) AS id, {CANON} AS h FROM documents WHERE trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) <> ''),
f AS (SELECT * FROM m WHERE doc_id % 2 = 1 AND doc_id >= 100), s AS (SELECT DISTINCT h FROM m WHERE doc_id % 2 = 0),
u AS (SELECT min(doc_id) AS doc_id FROM f WHERE h NOT IN (FROM s) GROUP BY h),
c AS (SELECT g, min(doc_id) AS doc_id, count(*) AS n FROM m WHERE doc_id IN (FROM u) OR doc_id % 2 = 0 AND doc_id >= 100 GROUP BY g HAVING bool_or(doc_id IN (FROM u))),
n AS (SELECT m.doc_id, m.g, m.id FROM m JOIN c USING (g) WHERE m.doc_id IN (FROM u) OR m.doc_id % 2 = 0 AND m.doc_id >= 100),
x AS (SELECT f.doc_id, coalesce(e.d, o.d) AS target FROM f LEFT JOIN (SELECT h, min(doc_id) AS d FROM m WHERE doc_id % 2 = 0 GROUP BY h) e USING (h) JOIN (SELECT h, min(doc_id) AS d FROM f GROUP BY h) o USING (h) WHERE f.doc_id NOT IN (FROM u)),
p AS (SELECT 0 AS k, g, doc_id, false AS copy, id AS of_id FROM n UNION ALL SELECT 0, n.g, x.doc_id, true, n.id FROM x JOIN n ON n.doc_id = x.target), {POSTS},
a AS (FROM r WHERE fits AND rep < 'c')"""


def by_fours(materials):
    """Vectors that documents of four successive numbers share, and no others come near."""
    value = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.xxhash64(F.expr("cast(external_id AS bigint) div 4"), i) % 1000).cast("float"))
    return materials.withColumn("vec", value)


@query(f"""{RUN} SELECT 'materials' AS stage, count(*) AS n FROM m WHERE doc_id % 2 = 1 UNION ALL SELECT 'fresh', count(*) FROM f UNION ALL SELECT 'new', count(*) FROM f
UNION ALL SELECT 'unique', count(*) FROM u UNION ALL SELECT 'vectors', count(*) FROM f UNION ALL SELECT 'links', (SELECT count(*) FROM f) - (SELECT count(*) FROM u) + (SELECT sum(n - 1)::BIGINT FROM c)
UNION ALL SELECT 'clusters', count(*) FROM c UNION ALL SELECT 'members', count(*) FROM p
UNION ALL SELECT 'screenings', count(*) FROM r WHERE fits UNION ALL SELECT 'accepted', count(*) FROM a UNION ALL SELECT 'digests', 1 UNION ALL SELECT 'digest_items', count(*) FROM a
UNION ALL SELECT 'posts', count(*) FROM w UNION ALL SELECT 'errors', (SELECT count(*) FROM documents WHERE doc_id % 2 = 1) - (SELECT count(*) FROM m WHERE doc_id % 2 = 1) + (SELECT count(*) FROM r WHERE NOT fits)""")
def feed_run(spark, sf_dir):
    """Odd documents are raw items, even ones stored; seven days back from 01:40 on the eighth: rows of each stage of a whole run,
    whose clusters reach into the lookback."""
    now = F.lit("2024-01-08 01:40:00").cast("timestamp")
    stored, _ = ingest.normalize_materials(items_of_documents(spark, sf_dir).where("batch_pos % 2 = 0"), now)
    scored = spark.createDataFrame([], "profile_id string, profile_version int, model string, prompt_version string, cluster_id string")
    stages = run.feed_run(raw_documents(spark, sf_dir).where("batch_pos % 2 = 1"), tables.written(stored, "stored"), scored, run.Profile("p", 1, "c", "all"), now, first_digit, lead_id, vectors=by_fours)
    return run.report(stages)


def landed_feeds(spark, sf_dir, kind: str, rows):
    """Feed files of documents: texts in Base64, so that any character comes through."""
    n = F.col("doc_id").cast("string")
    when = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    body, path = F.base64(F.col("text").cast("binary")), f"{tables.shared_dir(spark)}/landed-{kind}-{uuid.uuid4().hex}"
    if kind == "rss":
        parts = [
            "<item><guid>", n, "</guid><title>Title ", n, "</title><link>/", F.col("source"), "//doc/./", n, "?utm_source=feed&amp;b=2&amp;a=1</link><pubDate>", F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss"),
            " +0000</pubDate><author>Author ", n, "</author><description>", F.coalesce(body, F.lit("")), "</description><enclosure url=\"https://files.test/", n, "/a.pdf\" type=\"application/pdf\" length=\"", n, "\"/></item>",
        ]
    else:
        parts = [
            "<entry><id>", n, "</id><title>Title ", n, "</title><link rel=\"alternate\" href=\"https://feeds.test/", F.col("source"), "/doc/", n, "\"/><link rel=\"enclosure\" href=\"https://files.test/", n,
            "/a.mp3\" type=\"audio/mpeg\" length=\"", n, "\"/><updated>", F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "</updated><author><name>Author ", n, "</name></author><content type=\"text\">", F.coalesce(body, F.lit("")), "</content></entry>",
        ]
    # a file per source: its head, its entries, its foot
    line = rows.select(F.col("source").alias("feed"), F.lit(1).alias("o"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("value"))
    ends = ("<rss version=\"2.0\"><channel>", "</channel></rss>") if kind == "rss" else ("<feed xmlns=\"http://www.w3.org/2005/Atom\">", "</feed>")
    sources = rows.select(F.col("source").alias("feed")).distinct()
    for o, text in zip((0, 2), ends):
        line = line.unionByName(sources.select("feed", F.lit(o).alias("o"), F.lit(text).alias("value")))
    line.repartition("feed").sortWithinPartitions("feed", "o").select("feed", "value").write.partitionBy("feed").text(path)
    entries = feeds.read_feed(spark, path, kind).withColumns({"source_id": F.lit(kind), "batch_pos": F.col("id").cast("long"), "base_url": F.lit("https://FEEDS.test/feed.xml")})
    return feeds.feed_to_raw_items(entries, channel=kind == "atom")


@query("""SELECT CASE doc_id % 2 WHEN 0 THEN 'rss' ELSE 'atom' END AS source_id, doc_id::VARCHAR AS external_id,
'https://feeds.test/' || source || '/doc/' || doc_id || CASE doc_id % 2 WHEN 0 THEN '?a=1&b=2' ELSE '' END AS url, 1704067200 + doc_id * 60 AS seconds, 'Title ' || doc_id AS title,
CASE WHEN coalesce(text, '') <> '' THEN sha256(text) END AS body, CASE doc_id % 2 WHEN 0 THEN 'document' ELSE 'audio' END AS kind, CASE doc_id % 2 WHEN 0 THEN 'a.pdf' ELSE 'a.mp3' END AS name, doc_id AS size,
'native_rss,https://FEEDS.test/feed.xml,Author ' || doc_id AS metadata FROM documents""")
def feed_entries(spark, sf_dir):
    """Documents through landed RSS (relative links, own ids) and Atom files (numeric message ids) and back."""
    from digestflow.functions.urls import canonicalize_url

    d = table(spark, sf_dir, "documents")
    items = landed_feeds(spark, sf_dir, "rss", d.where("doc_id % 2 = 0"))[0].unionByName(landed_feeds(spark, sf_dir, "atom", d.where("doc_id % 2 = 1"))[0])
    a = F.get("attachments", F.lit(0))
    return items.select(
        "source_id", "external_id", canonicalize_url(F.col("original_url")).alias("url"), F.unix_seconds("published_at").alias("seconds"), "title",
        F.sha2(F.unbase64("raw_html"), 256).alias("body"), a["kind"].alias("kind"), a["name"].alias("name"), a["size"].alias("size"),
        F.concat_ws(",", *[F.get_json_object("metadata", f"$.{c}") for c in ("collector", "feed_url", "author")]).alias("metadata"),
    )


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'raw' WHEN doc_id % 3 = 1 THEN 'page ' || doc_id || chr(10) || chr(10) || 'attached' END AS text,
CASE WHEN doc_id % 3 = 2 THEN CASE doc_id % 2 WHEN 0 THEN 'attachment_unavailable' ELSE 'empty_content' END END AS code FROM documents""")
def extracted_items(spark, sf_dir):
    """Raw text first, else the page with its attached documents, each part once; without text, why."""
    d, third = table(spark, sf_dir, "documents"), F.col("doc_id") % 3
    file = F.struct(F.lit("document").alias("kind"), F.lit("f").alias("name"), F.lit(1).cast("bigint").alias("size"), F.lit("https://x.test/f").alias("download_ref"), F.lit(None).cast("string").alias("mime_type"))
    rows = d.select(
        "doc_id", F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("external_id"), F.when(third == 0, "raw").alias("raw_text"),
        F.when(third == 1, F.concat(F.lit("<html><body><script>x()</script><p>page "), "doc_id", F.lit("</p></body></html>"))).alias("raw_html"),
        F.when(third == 1, F.array(F.lit("attached"), F.lit("ATTACHED "))).alias("documents"), F.when(F.col("doc_id") % 2 == 0, F.array(file)).otherwise(F.array().cast(feeds.ATTACHMENTS)).alias("attachments"),
    )
    good, bad = ingest.extract_items(rows)
    return good.select("doc_id", F.col("extracted_text").alias("text"), F.lit(None).cast("string").alias("code")).unionByName(
        bad.select(F.col("external_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "code")
    )


ITEMS = """SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p, '{"cluster_id":"c' || doc_id || '","position":' || doc_id || ',"source_dates":["' ||
strftime(TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%SZ') || '"],"source_links":["https://www.x.test/' || doc_id || '"],"summary":"A & B ' || doc_id || '"}' AS j FROM documents"""


def digest_inputs(spark, sf_dir):
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    return d.select(
        F.col("source").alias("profile_id"), F.lit(2).alias("profile_version"), F.lit("c").alias("channel_id"), F.col("doc_id").alias("position"), F.concat(F.lit("c"), n).alias("cluster_id"),
        F.concat(F.lit("A & B "), n).alias("summary"), F.array(F.concat(F.lit("https://www.x.test/"), n)).alias("source_links"),
        F.array(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)).alias("source_dates"),
    )


@query(f"""WITH i AS ({ITEMS}), g AS (SELECT source, sha256('{{"items":[' || string_agg(j, ',' ORDER BY doc_id) || '],"profile_id":"' || source || '","profile_version":2}}') AS id FROM i GROUP BY source)
SELECT id AS digest_id, (p - 1)::INT AS position, 'News' || chr(10) || chr(10) || '• A &amp; B ' || doc_id || chr(10) || 'Источники:' || chr(10) || '1. <a href="https://www.x.test/' || doc_id || '">x.test</a>' || chr(10) ||
strftime(TIMESTAMP '2024-01-01 03:00:00' + doc_id * INTERVAL 1 MINUTE, '%d.%m.%Y') AS text FROM i JOIN g USING (source)""")
def composed_posts(spark, sf_dir):
    """Each source's documents as one digest: ids of canonical JSON, formatted items, posts in order."""
    return digest.compose(digest_inputs(spark, sf_dir), "News", F.lit("2024-06-01").cast("timestamp"))[2]


@query("""SELECT source AS profile_id, count(*) FILTER (source NOT IN (SELECT DISTINCT source FROM documents WHERE source LIKE '%1')) AS n_posts FROM documents GROUP BY source HAVING n_posts > 0""")
def prepared_digests(spark, sf_dir):
    """Digests prepared again after those of some sources were stored: only the others' rows are new."""
    now, items = F.lit("2024-06-01").cast("timestamp"), tables.written(digest_inputs(spark, sf_dir), "prepared")
    old = digest.compose(items.where("profile_id LIKE '%1'"), "News", now)
    digests, _, posts, _ = digest.prepare(items, old, "News", now)
    return posts.join(digests.select(F.col("id").alias("digest_id"), "profile_id"), "digest_id").groupBy("profile_id").agg(F.count("*").alias("n_posts"))


@query("""SELECT doc_id, sha256('https://x.test/' || doc_id || chr(10) || source) AS fallback, sha256('https://x.test/' || doc_id || chr(10)) AS untitled, source || chr(10) || chr(10) || doc_id AS joined,
CASE WHEN length(source) > 4 THEN left(source, 3) || '…' ELSE source END AS short, 'Line ' || doc_id AS first, source || chr(10) || 'x ' || doc_id AS dedup,
'{"source":"' || source || '","extraction":{"errors":["e"]}}' AS metadata FROM documents""")
def text_rules(spark, sf_dir):
    """Fallback ids, distinct parts, truncation, first lines, the text that is compared, and nested metadata."""
    n, source = F.col("doc_id").cast("string"), F.col("source")
    url = F.concat(F.lit("https://x.test/"), n)
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.fallback_external_id(url, source).alias("fallback"), T.fallback_external_id(url, F.lit(None).cast("string")).alias("untitled"),
        T.join_distinct(F.array(source, F.concat(F.lit(" "), F.upper(source)), F.lit(None).cast("string"), n, F.lit(" "))).alias("joined"), T.truncated(F.concat(F.lit(" "), source), 4).alias("short"),
        T.first_line(F.concat(F.lit("\n  \n Line "), n, F.lit(" \nmore"))).alias("first"), T.dedup_text(F.concat(source, F.lit(" ")), F.concat(F.lit(" x "), n)).alias("dedup"),
        T.merge_metadata(F.create_map(F.lit("source"), source), F.struct(F.array(F.lit("e")).alias("errors"))).alias("metadata"),
    )


@query(f"""WITH m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {CANON}) AS t FROM documents), e AS (SELECT doc_id AS a, t AS b FROM m WHERE doc_id <> t),
s AS (SELECT doc_id AS a, doc_id - 1 AS b FROM documents WHERE doc_id > 0 UNION SELECT a, b FROM e) SELECT a AS material_id, b AS duplicate_of_id, CASE WHEN (a, b) IN (FROM e) THEN 'exact_content' ELSE 'semantic' END AS kind FROM s""")
def all_links(spark, sf_dir):
    """Exact links with semantic ones to the document before, and a semantic one beside each exact one."""
    m = materials(spark, sf_dir)
    links = dedup.exact(m, m.limit(0))[1]
    near = m.where("id > 0").select(F.col("id").alias("material_id"), (F.col("id") - 1).alias("duplicate_of_id")).union(links.select("material_id", "duplicate_of_id"))
    near = near.select("*", F.lit("semantic").alias("kind"), F.lit(0.95).alias("similarity"))
    return dedup.all_links(links, near).select("material_id", "duplicate_of_id", "kind")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN floor(o_custkey * 1024.0)::BIGINT WHEN 1 THEN (o_custkey * 1048576 + 524288)::BIGINT ELSE -1 END AS bytes FROM orders")
def file_sizes(spark, sf_dir):
    k, n = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit("PDF, "), n, F.lit(" КБ"))).when(k == 1, F.concat(n, F.lit(",5 MB"))).otherwise(F.lit("no size"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.coalesce(pages.size_to_bytes(text), F.lit(-1).cast("long")).alias("bytes"))


@query("SELECT page_id, 1704067200 + page_id * 60 AS seconds FROM pages")
def page_dates(spark, sf_dir):
    """Pages with a date as a meta property, in JSON-LD or in a time element."""
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    meta = F.concat(F.lit('<meta property="article:published_time" content="'), when, F.lit('">'))
    data = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","datePublished":"'), when, F.lit('"}]}</script>'))
    time = F.concat(F.lit('<time datetime="'), when, F.lit('">then</time>'))
    k = F.col("page_id") % 3
    html = F.concat(F.when(k == 0, meta).when(k == 1, data).otherwise(time), F.coalesce("html", F.lit("")))
    rows = pages.clean_pages(table(spark, sf_dir, "pages").withColumn("html", html))
    return rows.select("page_id", F.unix_seconds(pages.published_at(F.col("dates"))).alias("seconds"))


@query("""SELECT p.page_id AS id, (p.page_id * 7919 % 1000) * 60 AS seconds, 't' || page_id AS title, row_number() OVER (ORDER BY p.page_id * 7919 % 1000, sha256('https://x.test/a/' || page_id || chr(10))) AS n,
'{"collector":"universal_scraper","listing_url":"https://x.test/list"}' AS metadata, p.page_id % 4 = 0 AS last FROM pages p WHERE page_id % 2 = 0""")
def page_items(spark, sf_dir):
    """Links with landed pages, found by canonical URL and ordered by date; odd pages have no date and become errors.  Every fourth
    page has landed twice."""
    p = table(spark, sf_dir, "pages").select("page_id")
    url = F.concat(F.lit("https://x.test/a/"), F.col("page_id").cast("string"))
    when = F.date_format(F.timestamp_seconds(F.col("page_id") * 7919 % 1000 * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    date = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<time datetime="'), when, F.lit('">x</time>'))).otherwise("")
    body = F.concat(F.lit("<html><body>"), date, F.lit("<p>"), F.col("word"), F.lit("</p></body></html>"))
    twice = p.withColumn("word", F.lit("a text")).unionByName(p.where("page_id % 4 = 0").withColumn("word", F.lit("text")))
    fetched = F.timestamp_seconds(F.char_length("word") * -1)
    landed = twice.select(F.concat(url, F.lit("/?utm_source=x")).alias("url"), body.alias("html"), fetched.alias("fetched_at"))
    links = p.select(F.lit("s").alias("source_id"), url.alias("url"), F.concat(F.lit("t"), "page_id").alias("title"), F.col("page_id").alias("pos"), F.lit("https://x.test/list").alias("listing_url"))
    items, _ = pages.pages_to_raw_items(links, landed)
    return items.select(
        F.regexp_extract("original_url", "[0-9]+$", 0).cast("long").alias("id"), F.unix_seconds("published_at").alias("seconds"), "title", F.col("batch_pos").alias("n"), "metadata",
        F.col("raw_html").contains("<p>text</p>").alias("last"),
    )


@query("""SELECT conv_id::VARCHAR AS source_id, turn::VARCHAR AS external_id, sha256(coalesce(text, '')) AS body, '<div class="tgme_widget_message_text"><b>' || sha256(coalesce(text, '')) || '</b></div>' AS html,
dense_rank() OVER (PARTITION BY conv_id ORDER BY turn * 7 % 5, turn) AS n, CASE turn % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' END AS mime, '{"collector":"web_preview","telegram_post":"chan/' || turn || '"}' AS metadata
FROM conversations WHERE turn IS NOT NULL""")
def message_cards(spark, sf_dir):
    """Turns as message cards of a channel per conversation, by date and number, each with a file."""
    n, when = F.col("turn").cast("string"), F.date_format(F.timestamp_seconds(F.col("turn") * 7 % 5 * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = F.concat(F.lit("a"), F.element_at(F.array(*map(F.lit, (".pdf", ".txt", ""))), (F.col("turn") % 3 + 1).cast("int")))
    card = F.concat(
        F.lit('<div data-post="chan/'), n, F.lit('"><p>head</p>\n<div class="tgme_widget_message_text"><b>'), F.sha2(F.coalesce("text", F.lit("")), 256), F.lit('</b></div><a class="tgme_widget_message_document_wrap">'),
        F.lit('<div class="tgme_widget_message_document_title">'), name, F.lit('</div></a><time datetime="'), when, F.lit('">x</time></div>'),
    )
    items, _ = pages.explode_message_cards(table(spark, sf_dir, "conversations").where("turn IS NOT NULL").select(F.col("conv_id").cast("string").alias("source_id"), card.alias("html")))
    mime = F.get("attachments", F.lit(0))["mime_type"]
    return items.select("source_id", "external_id", F.col("raw_text").alias("body"), F.col("raw_html").alias("html"), F.col("batch_pos").alias("n"), mime.alias("mime"), "metadata")


@query("""SELECT conv_id::VARCHAR AS source_id, turn::VARCHAR AS external_id, 'https://t.me/chan/' || turn AS url, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CASE turn % 2 WHEN 0 THEN 'document.pdf' END AS file FROM conversations""")
def message_items(spark, sf_dir):
    """Turns as exported messages of a channel per conversation, every second with a file."""
    file = F.struct(F.lit(None).cast("string").alias("name"), F.lit("application/pdf").alias("mime_type"), F.lit(5).alias("size"), F.lit("/f").alias("ref"))
    m = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("source_id"), F.lit("chan").alias("handle"), F.col("turn").alias("message_id"), F.timestamp_seconds(F.col("turn") * 60).alias("date"), F.col("text").alias("message"),
        F.lit(1).alias("views"), F.lit(0).alias("forwards"), F.lit(None).cast("long").alias("grouped_id"), F.when(F.col("turn") % 2 == 0, file).alias("file"),
    )
    rows = pages.messages_to_raw_items(m)
    return rows.select("source_id", "external_id", F.col("original_url").alias("url"), F.col("batch_pos").alias("n"), F.get("attachments", F.lit(0))["name"].alias("file"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END::BIGINT AS kind_order FROM customer WHERE c_custkey % 5 <> 0""")
def run_context(spark, sf_dir):
    """Customers as sources: the enabled ones, with the order of their kinds."""
    k = F.col("c_custkey") % 3
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(k == 0, "website").when(k == 1, "telegram").otherwise("manual").alias("kind"), F.concat(F.lit("l"), F.col("c_custkey") % 7).alias("normalized_locator"), (F.col("c_custkey") % 5 != 0).alias("enabled"))
    profiles = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.lit(True).alias("enabled"))
    kept, _ = ingest.load_context(sources, profiles, profiles.first().id)
    return kept.select("id", ingest.kind_order(F.col("kind")).cast("long").alias("kind_order"))


@query("SELECT event_type AS source_id, count(*) AS n, count(*) FILTER (ts < TIMESTAMP '2024-01-10') AS n_old FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1")
def backfilled(spark, sf_dir):
    """A stream over the second half, then a backfill of all from a bound on: earlier items come in, known ones don't again."""
    base = f"{tables.shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    schema = "source_id string, external_id string, published_at timestamp, text string, batch_pos bigint"
    items_of_events(spark, sf_dir).write.parquet(f"{base}/all")
    items_of_events(spark, sf_dir).where("published_at >= '2024-01-10'").write.parquet(f"{base}/late")
    state = jobs.FeedTables(spark, f"{base}/tables")
    jobs.run_available(spark, f"{base}/late", schema, state, f"{base}/checkpoint")
    jobs.backfill(spark, f"{base}/all", schema, state, "one", F.lit("2024-01-05").cast("timestamp"))
    return state.materials.read().groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("published_at") < "2024-01-10").alias("n_old"))


@query("SELECT o_orderkey AS id, count(*) FILTER (l_returnflag = 'N') = 0 AS sent FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def completed_digests(spark, sf_dir):
    posts = ledger(spark, sf_dir)
    digests = posts.select(F.col("digest_id").alias("id"), F.lit(None).cast("timestamp").alias("sent_at")).distinct()
    return digest.complete(digests, posts).select("id", F.col("sent_at").isNotNull().alias("sent"))
