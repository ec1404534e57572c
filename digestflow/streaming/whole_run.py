"""The whole feed as a job, batch or stream: from landed items to posts, with one commit record per batch.

A batch writes its rows of every table under a name of its own attempt, and then one row to ``commits``.  Readers see the
rows of committed attempts only, so of a batch that broke off between any two tables nothing is seen, and its repetition starts
from the same state; a batch that is repeated after its commit does nothing.  A snapshot is a list of committed attempts: all
reads of it share one state, whatever is written meanwhile.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from digestflow.operators import ingest, run
from digestflow.operators.tables import Table, written
from digestflow.sources.feeds import ATTACHMENTS

from .jobs import CURSORS, dated, recent

#: What readers land: items, and rows whose ``error`` is set in place of an item that could not be read.
LANDED = (
    "source_id string, external_id string, original_url string, published_at timestamp, title string, raw_text string, raw_html string, documents array<string>, "
    f"attachments {ATTACHMENTS}, metadata string, batch_pos bigint, error struct<code:string,message:string,retryable:boolean>"
)

SCHEMAS = {
    "materials": "id string, source_id string, external_id string, original_url string, published_at timestamp, fetched_at timestamp, title string, text string, language string, content_hash string, batch_pos bigint, metadata string",
    "vectors": "id string, vec array<float>, day date",
    "links": "material_id string, duplicate_of_id string, kind string, similarity double",
    "clusters": "id string, representative_id string, n_members bigint",
    "members": "cluster_id string, pos bigint, material_id string, similarity double",
    "screenings": "cluster_id string, profile_id string, profile_version int, model string, prompt_version string, relevance_score double, noise_score double, uncertain boolean, reason string, created_at timestamp",
    "digests": "id string, profile_id string, profile_version int, channel_id string, created_at timestamp, sent_at timestamp",
    "digest_items": "digest_id string, position bigint, cluster_id string, summary string, source_links array<string>",
    "posts": "digest_id string, position int, text string",
    "errors": "source_id string, code string, message string, external_id string, retryable boolean",
    "cursors": CURSORS,
    "receipts": "digest_id string, position int, message_id bigint, sent_at timestamp",
}
REPORT = ("sources", "collected_items", "extraction_failures", "stored_materials", "clusters", "digest_posts", "resumed_digests")
COMMITS = f"batch_id string, attempt string, {', '.join(f'{c} bigint' for c in REPORT)}"
#: What a batch writes.
WRITTEN = ("vectors", "links", "clusters", "members", "screenings", "errors", "materials", "digests", "digest_items", "posts", "cursors")


class Snapshot:
    """All tables as of one list of commits."""

    def __init__(self, tables: RunTables, attempts: list[str]):
        self.tables, self.attempts = tables, attempts

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read(SCHEMAS[name], only=self.attempts)

    def cursors(self) -> DataFrame:
        """source_id, cursor: where each source stands."""
        return self.read("cursors").groupBy("source_id").agg(F.max("cursor").alias("cursor"))


class RunTables:
    """The stored tables of a feed below one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.all = spark, {n: Table(spark, f"{path}/{n}", ["day"] if n == "vectors" else ()) for n in SCHEMAS}
        self.commits = Table(spark, f"{path}/commits")

    def __getitem__(self, name: str) -> Table:
        return self.all[name]

    def reports(self) -> DataFrame:
        """One row per committed batch: batch_id, attempt and what the run counted."""
        return self.commits.read(COMMITS)

    def snapshot(self) -> Snapshot:
        """What is committed now; the list has an entry per batch."""
        return Snapshot(self, sorted(r.attempt for r in self.reports().select("attempt").collect()))

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)


@dataclass(frozen=True)
class Job:
    """How batches of a feed are run.

    now: the time of the run; None for the latest published_at of each batch.  use_cursors: whether items before their
    source's cursor are skipped; by_message: whether cursors count messages.
    """

    profile: run.Profile
    score: run.Answers
    summarize: run.Answers
    vectors: Callable[[DataFrame], DataFrame] | None = run.encoded
    now: Column | None = None
    min_published_at: Column | None = None
    use_cursors: bool = True
    by_message: bool = False


def run_batch(landed: DataFrame, tables: RunTables, batch_id: str, job: Job) -> None:
    """One finite run over landed rows (LANDED): everything from cursors to posts, then the commit.

    Readers' errors go to the errors table beside the run's own; a source with a retryable one keeps its cursor.  Of known and
    duplicate items, clusters, scores, digests and posts a batch sees what other batches committed.
    """
    if tables.reports().where(F.col("batch_id") == batch_id).take(1):
        return
    state, attempt, counts = tables.snapshot(), f"{batch_id}-{uuid.uuid4().hex[:8]}", {}

    def watched(df: DataFrame, name: str, n: Column | None = None) -> DataFrame:
        """df, whose rows are counted while it is written."""
        counts[name] = Observation()
        return df.observe(counts[name], (F.count(F.lit(1)) if n is None else n).alias("n"))

    landed = written(watched(landed, "collected_items", F.count_if(F.col("error").isNull())), "landed")
    items, failed = landed.where("error IS NULL").drop("error"), landed.where("error IS NOT NULL")
    failed = failed.select("source_id", "error.code", "error.message", "external_id", F.coalesce("error.retryable", F.lit(False)).alias("retryable"))
    cursors, stored = state.cursors(), state.read("materials")
    new = ingest.after_cursor(items, cursors, job.by_message) if job.use_cursors else items
    now = F.lit(items.agg(F.max("published_at")).first()[0]).cast("timestamp") if job.now is None else job.now
    known = recent(state.read("vectors"), now, job.profile.lookback_days) if job.vectors else None
    digests, posts = state.read("digests"), state.read("posts")
    stages = run.feed_run(
        new, stored, state.read("screenings"), job.profile, now, job.score, job.summarize, job.vectors, job.min_published_at,
        (digests, state.read("digest_items"), posts), known,
    )
    errors = stages["errors"].withColumns({"message": F.lit(None).cast("string"), "retryable": F.lit(False)}).unionByName(failed)
    rows = {
        **{n: stages[n] for n in ("links", "clusters", "members", "screenings", "digests", "digest_items", "posts")},
        "vectors": dated(stages["vectors"]) if job.vectors else None, "materials": stages["new"], "errors": errors,
        "cursors": ingest.next_cursors(items, cursors, failed, job.by_message),
    }
    names = {"materials": "stored_materials", "clusters": "clusters", "posts": "digest_posts"}
    failures = F.count_if(F.col("code").isin("empty_content", "attachment_unavailable"))

    def put(name: str) -> None:
        if rows[name] is not None:
            df = tables.spark.createDataFrame([], SCHEMAS[name]).unionByName(rows[name], allowMissingColumns=True).select(*_columns(name))
            df = watched(df, "extraction_failures", failures) if name == "errors" else watched(df, names[name]) if name in names else df
            tables[name].append(df, attempt)

    with ThreadPoolExecutor(4) as pool:  # in any order: nothing is seen before the commit
        list(pool.map(put, WRITTEN))
    waiting = posts.join(state.read("receipts"), ["digest_id", "position"], "left_anti").select("digest_id").distinct()
    told = {k: o.get["n"] for k, o in counts.items()} | {"sources": landed.select("source_id").distinct().count(), "resumed_digests": waiting.count()}
    tables.commits.append(tables.spark.createDataFrame([(batch_id, attempt, *(told[c] for c in REPORT))], COMMITS).coalesce(1), attempt)


def _columns(name: str) -> list[str]:
    return StructType.fromDDL(SCHEMAS[name]).names


def run_landed(spark: SparkSession, landing: str, tables: RunTables, checkpoint: str, job: Job, files_per_batch: int = 100) -> None:
    """Run all that has landed since the last call, a micro-batch of files at a time, and stop."""
    stream = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    query = (
        stream.writeStream.foreachBatch(lambda df, n: run_batch(df, tables, f"stream-{n}", job))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def backfill(spark: SparkSession, landing: str, tables: RunTables, run_id: str, job: Job) -> None:
    """The same run over everything landed, as one batch without regard to cursors; they still move forward."""
    run_batch(spark.read.schema(LANDED).parquet(landing), tables, f"backfill-{run_id}", replace(job, use_cursors=False))
