"""Landed HTML pages: clean text, titles, dates and links, listing pages, and message cards of channel previews."""

from __future__ import annotations

import mimetypes
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestflow.functions.dates import parse_datetime
from digestflow.functions.html import Page
from digestflow.functions.text import blank_to_null, fallback_external_id, first_line
from digestflow.functions.urls import absolute_url, canonicalize_url
from digestflow.operators.tables import numbered, written

#: Units of file sizes, Latin and Cyrillic.
SIZE_UNITS = {"B": 1, "Б": 1, "KB": 1024, "КБ": 1024, "MB": 1024**2, "МБ": 1024**2, "GB": 1024**3, "ГБ": 1024**3}


def _mapped(pages: DataFrame, keys: Sequence[str], facts, schema: pa.DataType, ddl: str) -> DataFrame:
    """pages (keys..., html) -> keys and a column ``found``: facts(Page) for each page, a partition at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [facts(Page(html or "")) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(found, schema)], [*keys, "found"])

    rows = pages.select(*dict.fromkeys((*keys, "html")))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(read, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"found {ddl}"]))


def _link_facts(page: Page) -> list[dict]:
    return [{"href": x["href"], "title": " ".join(x["parts"]) or None, "pos": i} for i, x in enumerate(page.links) if (x["href"] or "").strip()]


def clean_pages(pages: DataFrame, keys: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """pages (keys, html) -> keys, text (without boilerplate elements), title, dates (candidates), links; null text if none."""
    kind = pa.struct([("text", pa.string()), ("title", pa.string()), ("dates", pa.list_(pa.string())), ("links", pa.list_(pa.string()))])

    def facts(page: Page) -> dict:
        return {"text": "\n".join(page.text) or None, "title": page.title(), "dates": page.dates(), "links": [x["href"] for x in _link_facts(page)]}

    out = _mapped(pages, keys, facts, kind, "struct<text:string,title:string,dates:array<string>,links:array<string>>")
    return out.select(*keys, "found.*")


def discover_links(pages: DataFrame, include: str | None = None, exclude: str | None = None, page_key: str = "page_id") -> DataFrame:
    """Listing pages (page_key, url, html) -> page_key, url, title, pos, listing_url: one row per page and linked URL.

    URLs are absolute http(s); of several links to one URL the longest title counts (the first of equals) and the first
    place.  include and exclude are regular expressions that a URL must and must not contain.
    """
    kind = pa.list_(pa.struct([("href", pa.string()), ("title", pa.string()), ("pos", pa.int32())]))
    links = _mapped(pages, (page_key, "url"), _link_facts, kind, "array<struct<href:string,title:string,pos:int>>")
    links = links.select(page_key, F.col("url").alias("base"), F.explode("found").alias("x"))
    links = links.select(page_key, absolute_url(F.col("base"), F.col("x.href")).alias("url"), F.col("x.title").alias("title"), F.col("x.pos").alias("pos"), F.col("base").alias("listing_url"))
    links = links.where(F.col("url").rlike("^https?://"))
    links = links.where(F.col("url").rlike(include)) if include else links
    links = links.where(~F.col("url").rlike(exclude)) if exclude else links
    best = F.max_by("title", F.struct(F.char_length(F.coalesce("title", F.lit(""))), -F.col("pos")))
    return links.groupBy(page_key, "url").agg(best.alias("title"), F.min("pos").alias("pos"), F.min("listing_url").alias("listing_url"))


def published_at(dates: Column, formats: Sequence[str] = (), naive_tz: str = "Europe/Moscow") -> Column:
    """The first candidate that can be read as a date."""
    read = F.transform(dates, lambda d: parse_datetime(d, formats, naive_tz))
    return F.get(F.filter(read, lambda t: t.isNotNull()), F.lit(0))


def with_places(items: DataFrame, order: Sequence[str]) -> DataFrame:
    """Raw items with batch_pos, from 1 by published_at and order within their source.  Bodies stay out of the sort: places are
    counted over keys and joined to the items (rows that agree in all of the key are numbered together, as one)."""
    key = ["source_id", "published_at", *order]
    places = numbered(items.select(*key).distinct(), ["source_id"], key[1:], "batch_pos").withColumnsRenamed({c: f"_p_{c}" for c in key})
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    return items.join(places, same).drop(*[f"_p_{c}" for c in key])


def pages_to_raw_items(links: DataFrame, pages: DataFrame, formats: Sequence[str] = (), naive_tz: str = "Europe/Moscow", collector: str = "universal_scraper") -> tuple[DataFrame, DataFrame]:
    """links (source_id, url, title, pos; listing_url, if known) with landed pages (url, html; fetched_at, if known) -> raw items, errors.

    Items are numbered by date and id within their source, and carry their collector and listing page.  Of several landed pages
    of one URL the last fetched counts, else the least by its text.  A page without a date gives the error article_date_missing,
    a link without a landed page article_missing (to be tried again).
    """
    # one page per canonical URL
    one = F.max_by("html", F.struct(F.unix_micros("fetched_at"), "html")) if "fetched_at" in pages.columns else F.min("html")
    landed = pages.withColumn("_key", canonicalize_url(F.col("url"))).groupBy("_key").agg(one.alias("html"))
    facts = clean_pages(landed, ("_key", "html")).drop("text", "links")
    both = links.withColumnRenamed("title", "listed").withColumn("_key", canonicalize_url(F.col("url"))).join(facts, "_key", "left").drop("_key")
    both = both.withColumn("published_at", published_at(F.col("dates"), formats, naive_tz)).withColumn("external_id", fallback_external_id(F.col("url"), F.lit(None).cast("string")))
    # written: each page is read once for items, their places and errors
    both = written(both.drop("dates"), "articles")
    listing = F.col("listing_url") if "listing_url" in links.columns else F.lit(None).cast("string")
    items = both.where("published_at IS NOT NULL").select(
        "source_id", "external_id", F.col("url").alias("original_url"), "published_at", F.coalesce("title", "listed").alias("title"),
        F.lit(None).cast("string").alias("raw_text"), F.col("html").alias("raw_html"), F.to_json(F.struct(F.lit(collector).alias("collector"), listing.alias("listing_url"))).alias("metadata"),
    )
    items = with_places(items, ["external_id"])
    missing = F.col("html").isNull()
    errors = both.where("published_at IS NULL").select(
        "source_id", F.when(missing, "article_missing").otherwise("article_date_missing").alias("code"),
        F.concat(F.lit("no date: "), F.col("url")).alias("message"), "external_id", missing.alias("retryable"),
    )
    return items, errors


def size_to_bytes(text: Column) -> Column:
    """ "2.5 MB" (also in Cyrillic, with a decimal comma) -> bytes; null if there is no size."""
    size = rf"(?iu)([\d.,]+)\s*({'|'.join(SIZE_UNITS)})(?![\p{{L}}\d_])"
    number, unit = F.replace(F.regexp_extract(text, size, 1), F.lit(","), F.lit(".")), F.upper(F.regexp_extract(text, size, 2))
    times = F.create_map(*[F.lit(x) for k, v in SIZE_UNITS.items() for x in (k, v)])
    return F.floor(number.try_cast("double") * F.try_element_at(times, unit)).cast("long")


def explode_message_cards(previews: DataFrame, naive_tz: str = "UTC", collector: str = "web_preview") -> tuple[DataFrame, DataFrame]:
    """previews (source_id, html) -> raw items of the message cards, errors (bad cards; pages without cards).

    Items are numbered by date and message number within their source, and carry the HTML of their text, their collector and
    post; a file's MIME type follows from its name.
    """
    file = pa.struct([("name", pa.string()), ("extra", pa.string()), ("mime", pa.string())])
    kind = pa.list_(pa.struct([("post", pa.string()), ("url", pa.string()), ("datetime", pa.string()), ("text", pa.string()), ("html", pa.string()), ("files", pa.list_(file))]))

    def attached(f: dict) -> dict:
        name = " ".join(f["name"]["parts"]) or "document"
        return {"name": name, "extra": " ".join(f["extra"]["parts"]), "mime": mimetypes.guess_type(name)[0]}

    def facts(page: Page) -> list[dict]:
        return [
            {
                "post": c["post"], "url": c.get("url"), "datetime": c.get("datetime"), "text": "\n".join(c["body"]["parts"]) or None if "body" in c else None,
                "html": page.source(c["body"]) if "body" in c else None, "files": [attached(f) for f in c["files"]],
            }
            for c in page.cards
        ]

    ddl = "array<struct<post:string,url:string,datetime:string,text:string,html:string,files:array<struct<name:string,extra:string,mime:string>>>>"
    cards = _mapped(previews, ("source_id",), facts, kind, ddl).select("source_id", F.explode_outer("found").alias("c"))
    cards = cards.select("source_id", "c.*")
    number = F.regexp_extract("post", "/([0-9]+)$", 1)
    cards = cards.withColumn("external_id", F.nullif(number, F.lit(""))).withColumn("published_at", parse_datetime(F.col("datetime"), (), naive_tz))
    good = F.col("external_id").isNotNull() & F.col("published_at").isNotNull()
    attachment = F.transform(
        "files",
        lambda f: F.struct(
            F.lit("document").alias("kind"), f["name"].alias("name"), size_to_bytes(f["extra"]).alias("size"),
            F.lit(None).cast("string").alias("download_ref"), f["mime"].alias("mime_type"),
        ),
    )
    cards = written(cards, "cards")
    items = cards.where(good).select(
        "source_id", "external_id", F.coalesce("url", F.concat(F.lit("https://t.me/"), F.col("post"))).alias("original_url"), "published_at",
        first_line(F.col("text")).alias("title"), F.col("text").alias("raw_text"), F.col("html").alias("raw_html"), attachment.alias("attachments"),
        F.to_json(F.struct(F.lit(collector).alias("collector"), F.col("post").alias("telegram_post"))).alias("metadata"), F.col("external_id").try_cast("decimal(38,0)").alias("_nr"),
    )
    items = with_places(items, ["_nr", "external_id"]).drop("_nr")
    none = F.col("post").isNull()
    errors = cards.where(~F.coalesce(good, F.lit(False))).select(
        "source_id", F.when(none, "preview_layout_changed").otherwise("card_invalid").alias("code"),
        F.when(none, "no message cards").otherwise(F.concat(F.lit("bad card "), F.coalesce("post", F.lit("")))).alias("message"), "external_id", F.lit(False).alias("retryable"),
    )
    return items, errors


def messages_to_raw_items(messages: DataFrame) -> DataFrame:
    """Exported messages (source_id, handle, message_id, date, message, views, forwards, grouped_id, file) -> raw items.

    file: struct<name, mime_type, size, ref> or null; a file without a name is called by its kind.
    """
    text = blank_to_null(F.col("message"))
    names = F.create_map(*[F.lit(x) for x in ("application/pdf", "document.pdf", "text/plain", "document.txt", "text/markdown", "document.md")])
    name = F.coalesce(blank_to_null(F.col("file.name")), F.try_element_at(names, F.col("file.mime_type")), F.lit("document"))
    attachment = F.struct(
        F.lit("document").alias("kind"), name.alias("name"), F.col("file.size").cast("long").alias("size"), F.col("file.ref").alias("download_ref"), F.col("file.mime_type").alias("mime_type")
    )
    rows = messages.select(
        "source_id", F.col("message_id").cast("string").alias("external_id"), F.concat(F.lit("https://t.me/"), "handle", F.lit("/"), F.col("message_id")).alias("original_url"),
        F.col("date").alias("published_at"), first_line(text).alias("title"), text.alias("raw_text"),
        F.when(F.col("file").isNull(), F.array().cast("array<struct<kind:string,name:string,size:bigint,download_ref:string,mime_type:string>>")).otherwise(F.array(attachment)).alias("attachments"),
        F.to_json(F.struct("message_id", "views", "forwards", "grouped_id", F.col("handle").alias("channel"))).alias("metadata"),
        F.col("message_id").alias("_nr"),
    )
    return numbered(rows, ["source_id"], ["published_at", "_nr"], "batch_pos").drop("_nr")
