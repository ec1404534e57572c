"""Landed feeds and text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from digestflow.functions.dates import parse_datetime
from digestflow.functions.text import blank_to_null, fallback_external_id
from digestflow.functions.urls import absolute_url

ATTACHMENTS = "array<struct<kind:string,name:string,size:bigint,download_ref:string,mime_type:string>>"

#: What is read of an entry, in either format; elements that a feed lacks are null.
RSS = """guid struct<_VALUE: string, _isPermaLink: string>, title string, link string, pubDate string, description string,
 `content:encoded` string, enclosure array<struct<_url: string, _type: string, _length: string, _title: string>>, author string, `dc:creator` string, _corrupt string"""
ATOM = """id string, title string, link array<struct<_href: string, _rel: string, _type: string, _length: string, _title: string>>, published string,
 updated string, content struct<_VALUE: string, _type: string>, summary string, author array<struct<name: string, email: string>>, _corrupt string"""


def read_feed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Entries of landed feed files (kind ``rss`` or ``atom``), one shape for both: file, corrupt and the entry's parts.

    A file that is no feed gives no entries here; see feed_errors().
    """
    schema, tag = (RSS, "item") if kind == "rss" else (ATOM, "entry")
    raw = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(schema).load(path)
    raw = raw.withColumn("file", F.input_file_name())
    none = F.lit(None).cast("string")
    if kind == "rss":
        enclosures = F.transform("enclosure", lambda e: F.struct(e["_url"].alias("href"), e["_type"].alias("type"), e["_length"].alias("length"), e["_title"].alias("title")))
        return raw.select(
            "file", F.col("guid._VALUE").alias("id"), "title", F.col("link").alias("link"), F.col("pubDate").alias("published"), none.alias("updated"),
            F.col("`content:encoded`").alias("content"), none.alias("summary"), "description", enclosures.alias("enclosures"),
            F.coalesce(blank_to_null(F.col("author")), blank_to_null(F.col("`dc:creator`"))).alias("author"), F.col("_corrupt").alias("corrupt"),
        )
    main = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    enclosures = F.transform(
        F.filter("link", lambda x: x["_rel"] == "enclosure"),
        lambda e: F.struct(e["_href"].alias("href"), e["_type"].alias("type"), e["_length"].alias("length"), e["_title"].alias("title")),
    )
    first = F.get("author", F.lit(0))
    name, mail = blank_to_null(first["name"]), blank_to_null(first["email"])
    author = F.coalesce(F.concat(name, F.lit(" ("), mail, F.lit(")")), name, mail)
    return raw.select(
        "file", "id", "title", F.get(main, F.lit(0))["_href"].alias("link"), "published", "updated", F.col("content._VALUE").alias("content"), "summary",
        none.alias("description"), enclosures.alias("enclosures"), author.alias("author"), F.col("_corrupt").alias("corrupt"),
    )


def feed_errors(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """feed_parse_failed for each file at path without a readable entry."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    # the title is used as well: Spark won't scan for the corrupt-record column alone
    readable = F.coalesce(F.col("corrupt").isNull() | (F.char_length("title") < 0), F.lit(False))
    entries = read_feed(spark, path, kind).where(readable).select("file").distinct()
    plain = F.regexp_replace("file", "^file:/+", "/")
    bad = files.withColumn("key", plain).join(entries.select(plain.alias("key")), "key", "left_anti")
    return bad.select(
        F.lit(None).cast("string").alias("source_id"), F.lit("feed_parse_failed").alias("code"), F.concat(F.lit("no entries in "), F.col("file")).alias("message"),
        F.lit(None).cast("string").alias("external_id"), F.lit(False).alias("retryable"),
    )


def entry_body(content: Column, summary: Column, description: Column) -> Column:
    """The content, else the summary, else the description; blank ones don't count."""
    return F.coalesce(*[blank_to_null(c) for c in (content, summary, description)])


def attachment_kind(mime: Column) -> Column:
    family = F.lower(F.substring_index(mime, "/", 1))
    return F.when(family.isin("image", "video", "audio"), family).when(family.isin("application", "text"), "document").otherwise("other")


def entry_attachments(enclosures: Column) -> Column:
    def one(e: Column) -> Column:
        leaf = F.nullif(F.substring_index(F.regexp_replace(F.regexp_replace(e["href"], r"^[^:]+://[^/?#]*", ""), r"[?#].*$", ""), "/", -1), F.lit(""))
        return F.struct(
            attachment_kind(e["type"]).alias("kind"), F.coalesce(blank_to_null(e["title"]), leaf, F.lit("attachment")).alias("name"),
            e["length"].try_cast("bigint").alias("size"), e["href"].alias("download_ref"), e["type"].alias("mime_type"),
        )

    return F.coalesce(F.transform(enclosures, one), F.array().cast(ATTACHMENTS))


def numeric_message_id(url: Column, entry_id: Column) -> Column:
    """The last path segment of the URL, else of the entry's id, if it is all digits."""
    path = [F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), "/+$", "") for c in (url, entry_id)]
    return F.coalesce(*[F.nullif(F.regexp_extract(p, r"(?:^|/)([0-9]+)$", 1), F.lit("")) for p in path])


def feed_to_raw_items(entries: DataFrame, channel: bool = False, collector: str = "native_rss") -> tuple[DataFrame, DataFrame]:
    """entries (source_id, batch_pos and read_feed's columns) -> raw items, errors (entry_invalid).

    An entry needs a link and a date; the link is taken against the feed's URL (entries' column base_url, if they have it)
    and must come out absolute.  Its id is its own, else a hash of link and title; for channels the number of the message.
    What an entry says besides goes along as metadata: its author, own id and dates, with the collector and the feed's URL.
    """
    given = lambda c: F.col(c) if c in entries.columns else F.lit(None).cast("string")
    link, feed_url, author = blank_to_null(F.col("link")), given("base_url"), given("author")
    if "base_url" in entries.columns:
        link = F.coalesce(absolute_url(F.col("base_url"), link), link)
    own = F.coalesce(blank_to_null(F.col("id")), fallback_external_id(link, F.col("title")))
    rows = entries.withColumns(
        {
            "link": link,
            "external_id": numeric_message_id(link, F.col("id")) if channel else own,
            "published_at": F.coalesce(parse_datetime(F.col("published"), (), "UTC"), parse_datetime(F.col("updated"), (), "UTC")),
        }
    )
    why = (
        F.when(F.col("corrupt").isNotNull(), "entry can't be read")
        .when(~F.coalesce(F.col("link").rlike("^(?i)https?://[^/]"), F.lit(False)), "no absolute link")
        .when(F.col("published_at").isNull(), "no published or updated date")
        .when(F.col("external_id").isNull(), "no numeric message id")
    )
    rows = rows.withColumn("why", why)
    items = rows.where("why IS NULL").select(
        "source_id", "external_id", F.col("link").alias("original_url"), "published_at", blank_to_null(F.col("title")).alias("title"),
        F.lit(None).cast("string").alias("raw_text"), entry_body(F.col("content"), F.col("summary"), F.col("description")).alias("raw_html"),
        entry_attachments(F.col("enclosures")).alias("attachments"), "batch_pos",
        F.to_json(F.struct(F.lit(collector).alias("collector"), feed_url.alias("feed_url"), author.alias("author"), F.col("id").alias("entry_id"), "published", "updated")).alias("metadata"),
    )
    errors = rows.where("why IS NOT NULL").select("source_id", F.lit("entry_invalid").alias("code"), F.col("why").alias("message"), "external_id", F.lit(False).alias("retryable"))
    return items, errors


def capped(items: DataFrame, most: int | None, newest: bool = False) -> DataFrame:
    """The first (or last) ``most`` items of each source by batch_pos; all of them for None.

    Spark limits each source within a task before the shuffle (WindowGroupLimit), so no task gets a whole source.
    """
    if most is None:
        return items
    order = F.desc("batch_pos") if newest else F.asc("batch_pos")
    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy("source_id").orderBy(order)))
    return ranked.where(F.col("_rank") <= most).drop("_rank")


def read_text_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Whole text and markdown files -> (path, text), and errors for blank ones."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    blank = blank_to_null(F.col("text")).isNull()
    errors = files.where(blank).select(F.lit("document_blank").alias("code"), F.col("path").alias("message"), F.lit(False).alias("retryable"))
    return files.where(~blank), errors
