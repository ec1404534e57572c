"""Current state and rejected changes from change logs of sources and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from digestflow.functions.text import stripped
from digestflow.functions.urls import normalize_locator

from .tables import numbered, ranged, running_sum, with_bases, written

#: Ranges of a profile's fields.
FRESHNESS, LENGTHS = (1, 365), ("brief", "normal", "detailed")


def fold_sources(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """log (seq, op add|delete, id, locator, kind) -> state (id, normalized_locator, locator, kind, enabled), rejected.

    A locator has one source: adding it again is a duplicate while that is enabled, and restores it under its old id
    when it was deleted.  Deleting what isn't enabled changes nothing and is rejected as absent.  An id belongs to the
    locator it was first added with.  A delete names the id alone.
    """
    added = log.where("op = 'add'").withColumn("normalized_locator", normalize_locator(F.col("locator")))
    invalid = added.where("normalized_locator IS NULL").select("seq", "op", "id", F.lit("invalid_locator").alias("reason"))
    added = added.where("normalized_locator IS NOT NULL")
    owner = added.groupBy("normalized_locator").agg(F.min_by("id", "seq").alias("own_id"))
    adds = added.join(owner, "normalized_locator").select("seq", "op", "id", "own_id", "normalized_locator", "locator", "kind")
    deletes = log.where("op = 'delete'").join(owner.select("normalized_locator", F.col("own_id").alias("id")), "id", "left")
    absent = deletes.where("normalized_locator IS NULL").select("seq", "op", "id", F.lit("absent").alias("reason"))
    deletes = deletes.where("normalized_locator IS NOT NULL").select("seq", "op", "id", F.col("id").alias("own_id"), "normalized_locator", "locator", "kind")
    events = adds.unionByName(deletes)
    # after any add a source is enabled and after any delete it isn't, so the event before decides
    before = F.lag("op").over(Window.partitionBy("normalized_locator").orderBy("seq"))
    events = events.withColumn("before", before)
    reason = F.when((F.col("op") == "add") & (F.col("before") == "add"), "duplicate").when((F.col("op") == "delete") & (F.coalesce("before", F.lit("delete")) == "delete"), "absent")
    events = events.withColumn("reason", reason)
    rejected = events.where("reason IS NOT NULL").select("seq", "op", "id", "reason").unionByName(invalid).unionByName(absent)
    good = events.where("reason IS NULL")
    last_add = F.max_by(F.struct("locator", "kind"), F.when(F.col("op") == "add", F.col("seq")))
    state = good.groupBy("normalized_locator").agg(F.first("own_id").alias("id"), last_add.alias("s"), (F.max_by("op", "seq") == "add").alias("enabled"))
    return state.select("id", "normalized_locator", "s.locator", "s.kind", "enabled"), rejected


def _version_chain(candidates: DataFrame) -> DataFrame:
    """candidates (profile_id, nr, level) -> those that count: of level 0 a profile's first, of each next level the first after
    the one of the level before.

    Each candidate points to the first one of the next level after it; the pointers are followed by doubling, so a chain of n
    changes takes about log2(n) joins.  A level's candidates are searched in ranges, however many they are.
    """
    own = candidates.select("profile_id", "level", "nr", F.col("nr").alias("target"))
    asks = candidates.select("profile_id", (F.col("level") + 1).alias("level"), "nr", F.lit(None).cast("long").alias("target"))
    keys, backwards = ("profile_id", "level"), (Window.unboundedPreceding, -1)
    placed = ranged(own.unionByName(asks), keys, ["nr"], "levels")
    # the nearest target after a row: in its range, else the first of the ranges after it
    least = placed.groupBy(*keys, "_range").agg(F.min("target").alias("_least"))
    later = F.min("_least").over(Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(*backwards))
    within = F.last("target", ignorenulls=True).over(Window.partitionBy(*keys, "_range").orderBy(F.desc("nr")).rowsBetween(*backwards))
    found = with_bases(placed.withColumn("_within", within), least.select(*keys, "_range", later.alias("_later")), keys).where("target IS NULL")
    jumps = written(found.select("profile_id", "nr", F.coalesce("_within", "_later").alias("to")).where("to IS NOT NULL"), "jumps")
    reached = written(candidates.where("level = 0").groupBy("profile_id").agg(F.min("nr").alias("nr")), "reached")
    while True:
        more = written(reached.join(jumps, ["profile_id", "nr"]).select("profile_id", F.col("to").alias("nr")), "reached")
        if more.isEmpty():
            return reached
        reached = reached.unionByName(more)
        jumps = written(jumps.join(jumps.select("profile_id", F.col("nr").alias("to"), F.col("to").alias("beyond")), ["profile_id", "to"]).select("profile_id", "nr", F.col("beyond").alias("to")), "jumps")


def fold_profiles(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """log (seq, profile_id, op create|update, expected_version, description, freshness_days, summary_length) -> state (profile_id,
    version, description, freshness_days, summary_length), rejected (seq, profile_id, reason).

    A change counts if it expects the current version; null fields of an update keep their values.  Rejected are creates
    of what exists, updates of what doesn't, stale versions, blank descriptions and values out of range, and changes that name no
    profile.  Changes of one seq go by their fields.  A profile of which no change counts has version 0.  No task and no row
    holds a profile's log: which changes count follows from a chain of versions, the rest are sums over ranges.
    """
    columns = ["seq", "op", "expected_version", "description", "freshness_days", "summary_length"]
    nameless = log.where("profile_id IS NULL").select("seq", "profile_id", F.lit("no_profile").alias("reason"))
    create, text = F.col("op") == "create", stripped(F.col("description"))
    unfit = (
        F.when(create & F.col("description").isNull() | (text == ""), "blank_description").when(~F.col("freshness_days").between(*FRESHNESS), "freshness_range")
        .when(~F.col("summary_length").isin(*LENGTHS), "summary_length")
    )
    changes = numbered(log.where("profile_id IS NOT NULL").select("profile_id", *columns), ["profile_id"], columns, "nr")
    changes = written(changes.withColumn("unfit", unfit), "changes")
    level = F.when(create, 0).when(F.col("expected_version") > 0, F.col("expected_version"))
    candidates = changes.where("unfit IS NULL").select("profile_id", "nr", level.cast("long").alias("level")).where("level IS NOT NULL")
    counted = _version_chain(candidates).withColumn("counts", F.lit(1))
    marked = changes.join(counted, ["profile_id", "nr"], "left").fillna(0, ["counts"])
    marked = written(running_sum(marked, ["profile_id"], ["nr"], F.col("counts"), "version"), "marked")
    good = F.col("counts") == 1
    last = lambda c, kept: F.max_by(kept, F.when(good & F.col(c).isNotNull(), F.col("nr")))
    state = marked.groupBy("profile_id").agg(
        F.sum("counts").cast("int").alias("version"), last("description", text).alias("description"),
        F.coalesce(last("freshness_days", F.col("freshness_days").cast("int")), F.lit(7)).alias("freshness_days"),
        F.coalesce(last("summary_length", F.col("summary_length")), F.lit("normal")).alias("summary_length"),
    )
    exists = F.col("version") > 0
    reason = (
        F.when(create & exists, "exists").when(~create & ~exists, "missing").when(~create & ~F.col("expected_version").eqNullSafe(F.col("version")), "stale_version").otherwise(F.col("unfit"))
    )
    return state, marked.where(~good).select("seq", "profile_id", reason.alias("reason")).unionByName(nameless)
