"""One run of the feed, from raw items to posts: the operators in their order, for batch, backfill and micro-batch alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestflow.functions import text as T

from . import dedup, digest, ingest, screening, tables

Answers = Callable[[list[str]], list[str]]


@dataclass(frozen=True)
class Profile:
    """Whom a run is for, and how."""

    id: str
    version: int
    channel_id: str
    interests: str
    header: str = "Digest"
    freshness_days: int = 7
    lookback_days: int = 7
    tau: float = 0.9
    model: str = "default"
    prompt_version: str = "v1"
    length_text: str = "Short."
    tone: str | None = None


def encoded(materials: DataFrame) -> DataFrame:
    """materials with ``vec``, by the default encoder over title and text."""
    return dedup.encode(materials.withColumn("dedup_text", T.dedup_text(F.coalesce("title", F.lit("")) if "title" in materials.columns else F.lit(""), F.coalesce("text", F.lit("")))))


def grouped(
    unique: DataFrame, lookback: DataFrame, vectors: Callable[[DataFrame], DataFrame] | None, tau: float, own: DataFrame | None = None, known: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Members of clusters of unique new materials with what the lookback has, and their semantic links.

    The order of leaders is by time, then id.  Without vectors every new material is a cluster of its own.  own (id, vec) has
    the vectors of unique, if they were made before; known (id, vec) stored ones of the lookback, of which only rows without
    one are then encoded.
    """
    columns = [c for c in unique.columns if c in lookback.columns]
    both, _ = dedup.combine(lookback.select(*columns), unique.select(*columns)) if vectors else (unique, None)
    nodes = both.select("id", F.unix_micros("published_at").alias("pos"))
    if vectors:
        own = vectors(unique).select("id", "vec") if own is None else own.join(tables.shuffled(unique.select("id")), "id", "left_semi")
        old = lookback.join(tables.shuffled(unique.select("id")), "id", "left_anti")
        if known is None:
            vecs = own.unionByName(vectors(old).select("id", "vec"))
        else:
            vecs = own.unionByName(known.join(tables.shuffled(old.select("id")), "id", "left_semi")).unionByName(vectors(old.join(tables.shuffled(known.select("id")), "id", "left_anti")).select("id", "vec"))
        pairs = tables.written(dedup.similarity_pairs(vecs, tau, mode="bands"), "run-pairs")
    else:
        pairs = unique.sparkSession.createDataFrame([], "a string, b string, similarity double")
    leaders = tables.written(dedup.greedy_leaders(nodes, pairs), "run-leaders")
    return dedup.clusters(leaders, pairs, unique.select("id"))


def feed_run(
    raw_items: DataFrame, stored: DataFrame, scored: DataFrame, profile: Profile, now: Column, score: Answers, summarize: Answers,
    vectors: Callable[[DataFrame], DataFrame] | None = encoded, min_published_at: Column | None = None, ledger: tuple[DataFrame, DataFrame, DataFrame] | None = None,
    known_vectors: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """raw_items (see extract_items) against stored materials and scores -> a table for each stage.

    errors: of extraction, normalization, scoring and summaries; materials, fresh, new and unique; vectors of new (id,
    published_at, vec), if there are any; links (exact and semantic); clusters and their members, a row each; screenings; accepted; digests, digest_items and posts (against ledger, if given: only new rows).
    min_published_at replaces the freshness window (backfill).  known_vectors (id, vec) save encoding the lookback.  Nothing is stored here; the caller appends the tables.
    """
    tables.bounded_batches(raw_items.sparkSession)
    extracted, failures = ingest.extract_items(raw_items)
    materials, invalid = ingest.normalize_materials(extracted, now)
    materials = tables.written(materials, "run-materials")
    fresh = ingest.fresh(materials, now, profile.freshness_days, min_published_at)
    new = tables.written(tables.first_wins(fresh, stored, ["id"], ["batch_pos"]), "run-new")
    unique, exact_links = dedup.exact(new, stored)
    unique, exact_links = tables.written(unique, "run-unique"), tables.written(exact_links, "run-exact")
    own = tables.written(vectors(new).select("id", "published_at", "vec"), "run-vectors") if vectors else None
    lookback = ingest.fresh(stored, now, profile.lookback_days)
    found, semantic = grouped(unique, lookback, vectors, profile.tau, own.select("id", "vec") if vectors else None, known_vectors)
    clusters = tables.written(dedup.identified(dedup.attach_exact(found, exact_links)), "run-clusters")
    known = stored.select(*[c for c in materials.columns if c in stored.columns])
    every, _ = dedup.combine(known, materials.select(*known.columns))
    open_ = screening.needs_scoring(clusters, scored, profile.id, profile.version, profile.model, profile.prompt_version)
    requests, unpacked = screening.screening_requests(open_, every, profile.interests)
    rows, unread = screening.screening_rows(screening.score(requests, score), profile.id, profile.version, profile.model, profile.prompt_version, now)
    screenings = tables.written(rows, "run-screenings")
    accepted = clusters.join(screenings.where(screening.verdict()).select(F.col("cluster_id").alias("id")), "id", "left_semi")
    asked, unasked = screening.summary_requests(accepted, every, profile.length_text, profile.tone)
    summaries = screening.score(asked, summarize).select("cluster_id", F.trim("response").alias("summary"))
    items, bad = digest.digest_items(tables.written(summaries, "run-summaries"), accepted, every)
    # the place of an item is its representative's time, which its links' first date is; ties by cluster
    place = F.unix_micros(F.get("source_dates", F.lit(0)))
    items = tables.written(items.select(
        F.lit(profile.id).alias("profile_id"), F.lit(profile.version).alias("profile_version"), F.lit(profile.channel_id).alias("channel_id"), place.alias("position"),
        "cluster_id", "summary", "source_links", "source_dates",
    ), "run-items")
    digests, parts, posts, collided = (
        (*digest.compose(items, profile.header, now), None) if ledger is None else digest.prepare(items, ledger, profile.header, now)
    )
    name = lambda df, code: df.select(F.lit(None).cast("string").alias("source_id"), F.lit(code).alias("code"), F.col("cluster_id").alias("external_id"))
    errors = failures.select("source_id", "code", "external_id").unionByName(invalid.select("source_id", "code", "external_id"))
    for df, code in ((unpacked, "request_unpacked"), (unread, "answer_invalid"), (unasked, "request_unpacked"), (bad, "summary_invalid")):
        errors = errors.unionByName(name(df, code))
    if collided is not None:
        errors = errors.unionByName(name(collided.withColumnRenamed("id", "cluster_id"), "digest_collision"))
    encoded_rows = {"vectors": own} if vectors else {}
    heads = lambda df: df.where("pos = 0").select("id", "representative_id", "n_members")
    return {
        "materials": materials, "fresh": fresh, "new": new, "unique": unique, **encoded_rows, "links": dedup.all_links(exact_links, semantic), "clusters": heads(clusters),
        "members": clusters.select(F.col("id").alias("cluster_id"), "pos", "material_id", "similarity"), "screenings": screenings, "accepted": heads(accepted), "digests": digests, "digest_items": parts, "posts": posts, "errors": errors,
    }


def report(stages: dict[str, DataFrame]) -> DataFrame:
    """stage, n: how many rows each stage of a run has.

    Each is counted by itself, and its count written: in one query the plans of all stages run at once, and the driver holds them all.
    """
    counts = [tables.written(df.agg(F.lit(name).alias("stage"), F.count("*").alias("n")), "stage-count") for name, df in stages.items()]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out
