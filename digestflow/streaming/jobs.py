"""The feed as a stream: landed files in, materials, links and cursors out, with the same operators as a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from digestflow.functions.text import content_hash, material_id
from digestflow.operators import dedup, ingest, run
from digestflow.operators.tables import Table, bounded_batches, first_wins, written


def hashed(items: DataFrame) -> DataFrame:
    """Landed items (source_id, external_id, published_at, text, batch_pos) with their id as materials."""
    return items.withColumn("content_hash", content_hash(F.col("text")))


CURSORS = "source_id string, cursor struct<published_at:timestamp,external_id:string,message_id:bigint>"


def dated(vectors: DataFrame) -> DataFrame:
    """vectors (id, published_at, vec, ...) as they are stored: id, vec, day."""
    return vectors.select("id", "vec", F.to_date("published_at").alias("day"))


def recent(vectors: DataFrame, now: Column, days: int) -> DataFrame:
    """id, vec of stored vectors of so many days back; only these days' files are read."""
    return vectors.where(F.col("day") >= F.to_date(now - F.make_interval(days=F.lit(days)))).select("id", "vec")


class FeedTables:
    """Where a feed keeps its materials, links, errors and vectors (by day), and how each batch moved the cursors."""

    def __init__(self, spark: SparkSession, path: str):
        self.materials, self.links, self.cursors, self.errors = (Table(spark, f"{path}/{n}") for n in ("materials", "links", "cursors", "errors"))
        self.vectors = Table(spark, f"{path}/vectors", ["day"])

    def latest_cursors(self, besides: str | None = None) -> DataFrame:
        """source_id, cursor: where each source stands, without the moves of the batch ``besides``."""
        return self.cursors.read(CURSORS, besides).groupBy("source_id").agg(F.max("cursor").alias("cursor"))


def process_batch(
    items: DataFrame, tables: FeedTables, batch_id: str, min_published_at=None, use_cursors: bool = True, errors: DataFrame | None = None, lookback_days: int | None = None,
    vectors: Callable[[DataFrame], DataFrame] = run.encoded, tau: float = 0.9,
) -> None:
    """One finite run over items: cursors, cut-off, known ids, exact duplicates against all history; cursors last.

    With lookback_days, unique items are also compared with what is stored of so many days before the batch's latest, and
    semantic links are kept beside the exact ones.  Vectors are stored by day, so a batch encodes its own items only.  errors (source_id, code, retryable, ...) go to a table of their own, and a
    source with a retryable one keeps its cursor.

    Every table is partitioned by batch_id, and a batch sees what other batches wrote, not itself.  So a run that broke off
    is repeated without harm: it finds the same rows again and replaces its own.
    """
    bounded_batches(items.sparkSession)
    items = written(items, "batch-items")
    cursors = tables.latest_cursors(besides=batch_id)
    new = ingest.after_cursor(items, cursors) if use_cursors else items
    new = new if min_published_at is None else new.where(F.col("published_at") >= min_published_at)
    found = new.withColumn("id", material_id(F.col("source_id"), F.col("external_id")))
    stored = tables.materials.read(hashed(found).schema, besides=batch_id)
    fresh = written(hashed(first_wins(found, stored, ["id"], ["batch_pos"])), "batch-fresh")
    unique, links = dedup.exact(fresh, stored)
    links = links.select(*dedup.LINKS)
    if lookback_days is not None:
        now = fresh.agg(F.max("published_at")).first()[0]
        if now is not None:
            own = written(dated(vectors(fresh)), "batch-vectors")
            known = recent(tables.vectors.read(own.schema, besides=batch_id), F.lit(now), lookback_days)
            _, semantic = run.grouped(unique, ingest.fresh(stored, F.lit(now), lookback_days), vectors, tau, own.select("id", "vec"), known)
            links = dedup.all_links(links, semantic)
            tables.vectors.append(own, batch_id)
    if errors is not None:
        tables.errors.append(errors, batch_id)
    tables.links.append(links, batch_id)
    tables.materials.append(fresh, batch_id)
    tables.cursors.append(ingest.next_cursors(items, cursors, errors), batch_id)


def run_available(spark: SparkSession, landing: str, schema: str, tables: FeedTables, checkpoint: str, min_published_at=None, files_per_batch: int = 100, use_cursors: bool = True, **lookback) -> None:
    """Process what has landed and stop; the next call goes on from there.  lookback: lookback_days, vectors and tau of process_batch.

    An item before the cursor that an earlier batch moved is skipped; without use_cursors, for files that land out of the
    order of time, known ids alone are.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    query = (
        stream.writeStream.foreachBatch(lambda df, n: process_batch(df, tables, f"stream-{n}", min_published_at, use_cursors, **lookback))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def backfill(spark: SparkSession, landing: str, schema: str, tables: FeedTables, run_id: str, min_published_at=None, **lookback) -> None:
    """The same run over everything landed, without regard to cursors; they still move forward."""
    process_batch(spark.read.schema(schema).parquet(landing), tables, f"backfill-{run_id}", min_published_at, use_cursors=False, **lookback)


def cursor_stream(items: DataFrame, by_message: bool = False) -> DataFrame:
    """A stateful stream of cursors: source_id, cursor whenever a source's latest item moves on; where they go is the caller's.

    Sites move by (published_at, external_id), channels (by_message) by the number of the message; items without one are passed over.
    """

    def latest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = best = tuple(state.get) if state.exists else None
        for batch in batches:
            if by_message:
                numbers = pd.to_numeric(batch["external_id"], errors="coerce").dropna()
                row = (None, None, int(numbers.max())) if len(numbers) else None
                ahead = row is not None and (best is None or row[2] > best[2])
            else:
                dated = batch.dropna(subset=["published_at", "external_id"]).sort_values(["published_at", "external_id"])
                row = (dated.iloc[-1]["published_at"], dated.iloc[-1]["external_id"], None) if len(dated) else None
                ahead = row is not None and (best is None or row[:2] > best[:2])
            best = row if ahead else best
        if best is not None and best != old:
            state.update(best)
            yield pd.DataFrame({"source_id": [key[0]], "published_at": pd.Series([best[0]], dtype="datetime64[ns]"), "external_id": [best[1]], "message_id": pd.Series([best[2]], dtype="Int64")})

    kind = "published_at timestamp, external_id string, message_id bigint"
    rows = items.select("source_id", "published_at", "external_id").where("source_id IS NOT NULL")
    moved = rows.groupBy("source_id").applyInPandasWithState(latest, f"source_id string, {kind}", kind, "update", GroupStateTimeout.NoTimeout)
    return moved.select("source_id", F.struct("published_at", "external_id", "message_id").alias("cursor"))


def run_cursors(spark: SparkSession, landing: str, schema: str, cursors: Table, checkpoint: str, by_message: bool = False, files_per_batch: int = 100) -> None:
    """The cursors of all that has landed since the last call, kept as state and written to a table batch by batch; then stop."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    query = (
        cursor_stream(stream, by_message).writeStream.outputMode("update").foreachBatch(lambda df, n: cursors.append(df, f"stream-{n}"))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def deduplicated_stream(items: DataFrame, delay: str = "7 days") -> DataFrame:
    """Bounded state: repeats of a content hash within ``delay`` go (without links); late rows are dropped by the watermark."""
    hashed = items.withColumn("content_hash", content_hash(F.col("text")))
    return hashed.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["content_hash"])
