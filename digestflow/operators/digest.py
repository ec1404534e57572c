"""Digest items, length-limited posts, and the delivery ledger."""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from digestflow.functions.urls import link_label

from .screening import cluster_materials
from .tables import written

#: The limits of a post, the hours between runs, and the wording of a post's link list.
POST_LIMIT, POST_LEAST, RUN_HOURS, SUMMARY_CHARS, SOURCES_LINE = 4096, 128, 6, 1500, "Источники:"
DISPLAY_TZ = "Europe/Moscow"
BREAK, WORD = re.compile("[\n ]"), re.compile(r"\S+")


def digest_items(summaries: DataFrame, clusters: DataFrame, materials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """summaries (cluster_id, summary, ...) with links and dates of all members in order, and the summaries that don't fit.

    A summary is not blank, has at most 1500 characters and no URL.
    """
    fits = (F.trim("summary") != "") & (F.char_length("summary") <= SUMMARY_CHARS) & ~F.col("summary").rlike("(?i)https?://")
    bad = summaries.where(~F.coalesce(fits, F.lit(False))).withColumn("code", F.lit("summary_invalid"))
    members, _ = cluster_materials(clusters, materials, "original_url", "published_at")
    rows = summaries.where(fits).join(members, "cluster_id")
    return rows.select(
        *summaries.columns, F.transform("members", lambda m: m["original_url"]).alias("source_links"), F.transform("members", lambda m: m["published_at"]).alias("source_dates")
    ), bad


def html_escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def format_item(summary: Column, links: Column, dates: Column, tz: str = DISPLAY_TZ) -> Column:
    """The escaped summary, then numbered links, each with its date in the display zone if dates are given."""
    def line(link: Column, i: Column) -> Column:
        anchor = F.concat((i + 1).cast("string"), F.lit('. <a href="'), html_escaped(link), F.lit('">'), html_escaped(link_label(link)), F.lit("</a>"))
        day = F.date_format(F.from_utc_timestamp(F.get(dates, i), tz), "dd.MM.yyyy")
        return F.concat_ws("\n", anchor, day)

    return F.concat_ws("\n", F.concat(F.lit("• "), html_escaped(summary)), F.lit(SOURCES_LINE), F.array_join(F.transform(links, line), "\n"))


def _pieces(text: str, limit: int) -> list[str]:
    """Parts of at most ``limit`` characters, cut at the last line end or space unless that is in the first half.

    Places to break are found once, so the work grows with the text alone.
    """
    breaks, words = [m.start() for m in BREAK.finditer(text)], [m.span() for m in WORD.finditer(text)]
    begins, ends = [a for a, _ in words], [b for _, b in words]
    spans, start = [], 0
    while len(text) - start > limit:
        k = bisect_right(breaks, start + limit) - 1
        stop = breaks[k] if k >= 0 and breaks[k] - start >= limit // 2 else start + limit
        # the part ends with the last word that begins before ``stop``; the next one begins at the first word from there
        last = bisect_left(begins, stop) - 1
        spans.append((start, max(start, min(stop, ends[last]) if last >= 0 else start)))
        after = bisect_right(ends, stop)
        start = max(stop, begins[after]) if after < len(words) else len(text)
    if start < len(text) or not spans:
        spans.append((start, len(text)))
    return [text[a:b] for a, b in spans]


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's other columns, where keys are equal or both null."""
    other = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]
    return left.join(other, on).drop(*[f"_r{k}" for k in keys])


def split_posts(items: DataFrame, header: str, limit: int = POST_LIMIT) -> DataFrame:
    """items (digest_id, position, text) -> digest_id, position, text of the posts: header, empty line, part of one item.

    Items never share a post; posts are numbered through the digest.  Positions come from the number of posts of the
    items before, so a digest's posts are never gathered.  Items at one position come in the order of a hash of their texts.
    """
    room = limit - len(header.strip()) - 2
    if not POST_LEAST <= limit <= POST_LIMIT or not header.strip() or room < 2:
        raise ValueError(f"limit must be {POST_LEAST} to {POST_LIMIT} and leave room after a header that isn't blank")
    head = header.strip() + "\n\n"

    @F.pandas_udf(ArrayType(StringType()))
    def posts(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [head + p for p in _pieces(t, room)])

    # texts never meet: counts alone are put in order, by ranges of items with a running sum over the ranges before
    earlier = (Window.unboundedPreceding, -1)
    key = ["digest_id", "_item", "_hash"]
    rows = items.select("digest_id", F.col("position").alias("_item"), F.xxhash64("text").alias("_hash"), posts("text").alias("_posts"))
    counts = rows.groupBy(*key).agg(F.sum(F.size("_posts")).alias("_n"))
    partitions = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, since ranges are drawn from a sample
    counts = written(counts.repartitionByRange(partitions, *key).withColumn("_range", F.spark_partition_id()), "post-counts")
    sums = counts.groupBy("digest_id", "_range").agg(F.sum("_n").alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy("digest_id").orderBy("_range").rowsBetween(*earlier)), F.lit(0)))
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("digest_id", "_range").orderBy("_item", "_hash").rowsBetween(*earlier)), F.lit(0))
    bases = _joined(counts.withColumn("_within", within), sums.drop("_sum"), ["digest_id", "_range"])
    bases = bases.select(*key, (F.col("_before") + F.col("_within")).alias("_base"))
    # rows with equal place and text follow each other
    again = F.coalesce(F.sum(F.size("_posts")).over(Window.partitionBy(*key).orderBy(F.lit(0)).rowsBetween(*earlier)), F.lit(0))
    rows = _joined(rows.withColumn("_again", again), bases, key)
    rows = rows.select("digest_id", (F.col("_base") + F.col("_again")).alias("_base"), F.posexplode("_posts").alias("_i", "text"))
    return rows.select("digest_id", (F.col("_base") + F.col("_i")).cast("int").alias("position"), "text")


DIGEST = ["profile_id", "profile_version", "channel_id"]
#: How a digest's items are ordered.
PLACE = ["position", "cluster_id", "summary", "source_links", "source_dates"]


def digest_ids(items: DataFrame) -> DataFrame:
    """items -> profile_id, profile_version, channel_id, id: the SHA-256 of the canonical JSON of profile and ordered items.

    Items come sorted and go into one hash each by each, so a task holds a batch of rows whatever a digest's size.
    """
    iso = F.transform("source_dates", lambda d: F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = items.select(*DIGEST, *PLACE[:-1], iso.alias("source_dates"))
    kinds = dict(rows.dtypes)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, first = None, None, True
        dumped = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)

        def close() -> pa.RecordBatch:
            sha.update(f'],"profile_id":{dumped(now[0])},"profile_version":{int(now[1])}}}'.encode())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(now, types)] + [pa.array([sha.hexdigest()])], [*DIGEST, "id"])

        for batch in batches:
            types = [batch.column(c).type for c in DIGEST]
            for row in batch.to_pylist():
                key = [row[c] for c in DIGEST]
                if key != now:
                    if sha:
                        yield close()
                    now, sha, first = key, hashlib.sha256(b'{"items":['), True
                sha.update((("" if first else ",") + dumped({c: row[c] for c in PLACE})).encode())
                first = False
        if sha:
            yield close()

    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *DIGEST).sortWithinPartitions(*DIGEST, *PLACE).mapInArrow(hashed, ", ".join(f"{c} {kinds[c]}" for c in DIGEST) + ", id string")


def compose(items: DataFrame, header: str, created_at: Column, limit: int = POST_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """items (profile_id, profile_version, channel_id, position, cluster_id, summary, source_links, source_dates) ->
    digests, digest items, posts.  A profile without items gets no digest."""
    ids = written(digest_ids(items), "digest-ids")
    digests = ids.select("id", *DIGEST, created_at.alias("created_at"), F.lit(None).cast("timestamp").alias("sent_at"))
    own = items.join(ids.withColumnRenamed("id", "digest_id"), DIGEST)
    text = own.select("digest_id", "position", format_item(F.col("summary"), F.col("source_links"), F.col("source_dates")).alias("text"))
    return digests, own.select("digest_id", "position", "cluster_id", "summary", "source_links"), split_posts(text, header, limit)


def prepare(items: DataFrame, stored: tuple[DataFrame, DataFrame, DataFrame], header: str, created_at: Column, limit: int = POST_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """compose() against what is stored (digests, items, posts): the rows to append to each, and ids that collide.

    A digest that is stored for the same profile, version and channel gives no rows, so a repeated run changes nothing; one
    that is stored for another is a collision and gives none either.  Digest items and posts without their digest's row, as
    after a run that broke off before it, are completed: rows are compared by digest and position.
    """
    digests, parts, posts = compose(items, header, created_at, limit)
    bad = collisions(digests, stored[0])
    digests = digests.join(stored[0].select("id"), "id", "left_anti")
    key, skip = ["digest_id", "position"], bad.withColumnRenamed("id", "digest_id")
    rest = [new.join(skip, "digest_id", "left_anti").join(old.select(*key), key, "left_anti") for new, old in ((parts, stored[1]), (posts, stored[2]))]
    return digests, *rest, bad


def collisions(digests: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids of digests that are stored for another profile, version or channel."""
    old = stored.select("id", *[F.col(c).alias(f"_{c}") for c in ("profile_id", "profile_version", "channel_id")])
    same = (F.col("profile_id") == F.col("_profile_id")) & (F.col("profile_version") == F.col("_profile_version")) & F.col("channel_id").eqNullSafe(F.col("_channel_id"))
    return digests.join(old, "id").where(~same).select("id")


def pending_posts(posts: DataFrame, receipts: DataFrame) -> DataFrame:
    """Posts (digest_id, position, ...) without a receipt, in order."""
    return posts.join(receipts.select("digest_id", "position"), ["digest_id", "position"], "left_anti").orderBy("digest_id", "position")


def pending_digests(digests: DataFrame, posts: DataFrame, receipts: DataFrame) -> DataFrame:
    """Digests that aren't sent, oldest first, with their posts that aren't."""
    left = posts.join(receipts.select("digest_id", "position"), ["digest_id", "position"], "left_anti")
    grouped = left.groupBy("digest_id").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("posts"))
    return digests.where("sent_at IS NULL").join(grouped.withColumnRenamed("digest_id", "id"), "id").orderBy("created_at", "id")


def apply_receipts(posts: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """log (digest_id, position, message_id, sent_at) -> posts with their first receipt, conflicts, receipts of no post.

    A later receipt with the same message is a repetition; with another one it is a conflict and changes nothing.
    """
    key = ["digest_id", "position"]
    first = log.groupBy(*key).agg(F.min(F.struct("sent_at", "message_id")).alias("r")).select(*key, F.col("r.message_id").alias("_m"), F.col("r.sent_at").alias("_s"))
    own = posts.join(first, key, "left")
    kept = own.withColumns({"message_id": F.coalesce("message_id", "_m"), "sent_at": F.when(F.col("message_id").isNull(), F.col("_s")).otherwise(F.col("sent_at"))}).drop("_m", "_s")
    conflicts = log.join(kept.select(*key, F.col("message_id").alias("_m")), key).where("message_id != _m").select(*log.columns)
    return kept, conflicts, log.join(posts, key, "left_anti")


def delivery_receipts(posts: DataFrame) -> DataFrame:
    """digest_id, message_ids (in order), sent_at (the last) of the digests whose posts are all confirmed."""
    done = F.count_if(F.col("message_id").isNull() | F.col("sent_at").isNull())
    rows = posts.groupBy("digest_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "message_id"))), lambda x: x["message_id"]).alias("message_ids"), F.max("sent_at").alias("sent_at"), done.alias("open")
    )
    return rows.where("open = 0").drop("open")


def complete(digests: DataFrame, posts: DataFrame) -> DataFrame:
    """Digests with sent_at set once all of their posts are confirmed."""
    done = delivery_receipts(posts).select(F.col("digest_id").alias("id"), F.col("sent_at").alias("_sent"))
    return digests.join(done, "id", "left").withColumn("sent_at", F.coalesce("sent_at", "_sent")).drop("_sent").select(*digests.columns)


def due(send_times: Column, now: Column, tz: str = DISPLAY_TZ, hours: int = RUN_HOURS) -> Column:
    """Whether a slot (weekday 0 = Monday or null for daily, hour) came in the last ``hours``; without slots, always.

    The session's time zone must be UTC.
    """
    local = F.from_utc_timestamp(now, tz)
    today = F.date_trunc("day", local)

    def came(slot: Column) -> Column:
        back = F.when(slot["weekday"].isNull(), 0).otherwise(F.pmod(F.weekday(local) - slot["weekday"], F.lit(7)))
        at = today - F.make_interval(days=back) + F.make_interval(hours=slot["hour"])
        cycle = F.when(slot["weekday"].isNull(), 1).otherwise(7)
        at = F.when(at > local, at - F.make_interval(days=cycle)).otherwise(at)
        return (at > local - F.make_interval(hours=F.lit(hours))) & (at <= local)

    return F.coalesce(F.size(send_times) <= 0, F.lit(True)) | F.coalesce(F.exists(send_times, came), F.lit(False))
