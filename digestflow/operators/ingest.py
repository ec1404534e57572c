"""From raw items to materials: extraction, normalization, cursors, freshness, source checks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from digestflow.functions import text as T
from digestflow.functions.html import Page
from digestflow.functions.urls import canonicalize_url

#: Which collectors and cursors go with a kind of source, and the order of the kinds.
KINDS = ("website", "telegram", "manual")
COLLECTORS = {"native_rss": ("website", "telegram"), "rss_bridge": ("telegram",), "universal_scraper": ("website",), "web_preview": ("telegram",), "telethon": ("telegram",)}
CURSORS = {"website": "published", "telegram": "message"}


def kind_order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def extract_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items (raw_text, raw_html, documents: array<string>, attachments, ...) with extracted_text, and failures.

    The raw text, else the page's text, then the texts of attached documents, each part once.  Attached documents without
    a reference, or whose reference is remote or relative, give attachment_errors; an item without any text fails with
    attachment_unavailable if it has such errors, else with empty_content.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ["\n".join(Page(h).text) or None if h else None for h in batch.column("_html").to_pylist()]
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "_html"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string())], [*[n for n in batch.schema.names if n != "_html"], "_page"])

    have = F.coalesce("raw_text", F.lit("")) != ""
    given = items.withColumn("_html", F.when(~have, F.col("raw_html")))
    out = StructType([*items.schema, StructField("_page", StringType())])
    given = given.mapInArrow(read, out)
    ref = lambda a: a["download_ref"]
    documents = F.filter("attachments", lambda a: a["kind"] == "document")
    wrong = F.transform(
        F.filter(documents, lambda a: ref(a).isNull() | ~(ref(a).startswith("/") | ref(a).startswith("file:"))),
        lambda a: F.concat(a["name"], F.when(ref(a).isNull(), ": no reference").otherwise(": not a local file")),
    )
    wrong = F.coalesce(wrong, F.array().cast("array<string>"))
    parts = F.concat(F.array(F.coalesce(F.nullif("raw_text", F.lit("")), "_page")), F.coalesce("documents", F.array().cast("array<string>")))
    rows = given.withColumn("attachment_errors", wrong).withColumn("extracted_text", T.join_distinct(parts)).drop("_page")
    failures = rows.where("extracted_text IS NULL").select(
        "source_id", F.when(F.size("attachment_errors") > 0, "attachment_unavailable").otherwise("empty_content").alias("code"),
        F.coalesce(F.nullif(F.array_join("attachment_errors", "; "), F.lit("")), F.lit("no text")).alias("message"), "external_id", F.lit(False).alias("retryable"),
    )
    return rows.where("extracted_text IS NOT NULL"), failures


def normalize_materials(items: DataFrame, fetched_at: Column) -> tuple[DataFrame, DataFrame]:
    """Extracted items -> materials, errors (material_invalid: no text, URL, id or date).

    An item's metadata (a JSON object, where items have it) goes along, with the attachment errors of its extraction.
    """
    rows = items.withColumns({"text": T.display_text(F.col("extracted_text")), "url": canonicalize_url(F.col("original_url"))})
    bad = (
        F.when(F.col("text").isNull(), "blank text").when(F.col("url").isNull(), "no absolute http(s) URL")
        .when(F.col("external_id").isNull() | F.col("source_id").isNull(), "no identity").when(F.col("published_at").isNull(), "no date")
    )
    rows = rows.withColumn("why", bad)
    extracted = F.col("title") if "title" in items.columns else F.lit(None).cast("string")
    materials = rows.where("why IS NULL").select(
        T.material_id(F.col("source_id"), F.col("external_id")).alias("id"), "source_id", "external_id", F.col("url").alias("original_url"), "published_at",
        fetched_at.alias("fetched_at"), T.choose_title(extracted, F.lit(None).cast("string"), F.col("text")).alias("title"), "text",
        F.lit(None).cast("string").alias("language"), T.content_hash(F.col("text")).alias("content_hash"), "batch_pos",
        *([_metadata(items).alias("metadata")] if "metadata" in items.columns else []),
    )
    errors = rows.where("why IS NOT NULL").select("source_id", F.lit("material_invalid").alias("code"), F.col("why").alias("message"), "external_id", F.lit(False).alias("retryable"))
    return materials, errors


def _metadata(items: DataFrame) -> Column:
    given = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    faults = F.col("attachment_errors") if "attachment_errors" in items.columns else F.array().cast("array<string>")
    return T.merge_metadata(given, F.when(F.size(faults) > 0, F.struct(faults.alias("attachment_errors"))))


def fresh(materials: DataFrame, now: Column, freshness_days: int, min_published_at: Column | None = None) -> DataFrame:
    """Materials not older than the cut-off (inclusive); min_published_at replaces it (backfill)."""
    bound = now - F.make_interval(days=F.lit(freshness_days)) if min_published_at is None else min_published_at
    return materials.where(F.col("published_at") >= bound)


def after_cursor(items: DataFrame, cursors: DataFrame, by_message: bool = False) -> DataFrame:
    """Items strictly after their source's cursor; a source without one passes all.

    cursors: source_id, cursor struct<published_at, external_id, message_id>.  Sites compare (published_at, external_id
    as text), channels the number of the message.
    """
    both = items.join(cursors.select("source_id", "cursor"), "source_id", "left")
    c = F.col("cursor")
    if by_message:
        new = c["message_id"].isNull() | (F.col("external_id").try_cast("bigint") > c["message_id"])
    else:
        place = F.struct(F.col("published_at").alias("p"), F.col("external_id").alias("e"))
        none = c["published_at"].isNull() | c["external_id"].isNull()
        new = none | (place > F.struct(c["published_at"].alias("p"), c["external_id"].alias("e")))
    return both.where(new).drop("cursor")


def next_cursors(seen: DataFrame, cursors: DataFrame, errors: DataFrame | None = None, by_message: bool = False) -> DataFrame:
    """source_id, cursor for each source that advances: to its latest item seen, never back.

    A source with a retryable error keeps its cursor.  (Both kinds only move forward.)
    """
    if by_message:
        latest = seen.groupBy("source_id").agg(F.max(F.col("external_id").try_cast("bigint")).alias("m")).where("m IS NOT NULL")
        latest = latest.withColumn("new", F.struct(F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("string").alias("external_id"), F.col("m").alias("message_id")))
    else:
        latest = seen.groupBy("source_id").agg(F.max(F.struct("published_at", "external_id")).alias("m"))
        latest = latest.withColumn("new", F.struct(F.col("m.published_at").alias("published_at"), F.col("m.external_id").alias("external_id"), F.lit(None).cast("bigint").alias("message_id")))
    both = latest.join(cursors.select("source_id", "cursor"), "source_id", "left")
    keys = ["message_id"] if by_message else ["published_at", "external_id"]
    ahead = F.struct(*[F.col(f"new.{k}").alias(k) for k in keys]) > F.struct(*[F.col(f"cursor.{k}").alias(k) for k in keys])
    old_null = F.col(f"cursor.{keys[0]}").isNull()
    both = both.where(old_null | ahead).select("source_id", F.col("new").alias("cursor"))
    return both if errors is None else both.join(errors.where("retryable").select("source_id").distinct(), "source_id", "left_anti")


def commit_cursors(cursors: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cursor table with updates applied, and the updates of unknown sources."""
    new = updates.select("source_id", F.col("cursor").alias("_new"))
    table = cursors.join(new, "source_id", "left").withColumn("cursor", F.coalesce("_new", "cursor")).drop("_new").select(*cursors.columns)
    return table, updates.join(cursors, "source_id", "left_anti")


def audit_sources(sources: DataFrame) -> DataFrame:
    """id, rule for sources whose collector is unknown or doesn't go with the kind or the cursor's shape."""
    allowed = F.create_map(*[x for k, v in COLLECTORS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    kinds = F.try_element_at(allowed, F.col("collector"))
    shape = F.when(F.col("cursor.message_id").isNotNull(), "message").when(F.col("cursor.published_at").isNotNull(), "published")
    by_number = (F.col("kind") == "telegram")
    rules = F.array_compact(F.array(
        F.when(kinds.isNull(), "unknown_collector"),
        F.when(kinds.isNotNull() & ~F.array_contains(kinds, F.col("kind")), "collector_kind"),
        F.when(shape.isNotNull() & (shape != F.when(by_number, "message").otherwise("published")), "cursor_kind"),
    ))
    return sources.select("id", F.explode(rules).alias("rule"))


def load_context(sources: DataFrame, profiles: DataFrame, profile_id: str, include_disabled: bool = False) -> tuple[DataFrame, DataFrame]:
    """The enabled sources with their rank, and the profile; both from frames of pinned table versions.

    Raises LookupError for a missing or disabled profile.
    """
    found = profiles.where(F.col("id") == profile_id)
    row = found.select("enabled").first()
    if row is None or not row.enabled:
        raise LookupError(f"profile {profile_id} is {'missing' if row is None else 'disabled'}")
    kept = sources if include_disabled else sources.where("enabled")
    return kept.orderBy(kind_order(F.col("kind")), "normalized_locator", "id"), found
