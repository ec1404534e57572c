"""Written tables: intermediate ones in the shared folder, and stored ones partitioned by batch."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own on a single machine, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-digestflow-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: short lineage that outlives its executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle: for tables of ids and pairs that grow with the input.

    Spark takes a file's bytes for its rows'; ids that occur again and again take a byte or two in Parquet and some 200 in the
    table that a broadcast join builds on the driver.
    """
    return df.hint("merge")


#: Bytes of an Arrow batch between Spark and a worker of Python, at most.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let this session's Arrow batches hold BATCH_BYTES at most (Spark's default is 64 MB a task, before any copy of it)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Table:
    """A Parquet table partitioned by batch: a batch that is written again replaces its own partition and nothing else.

    Rows may not have a column ``_batch``.  Columns in ``by`` divide a batch further, so that reads prune by them too.
    """

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str] = ()):
        self.spark, self.path, self.by = spark, path.rstrip("/"), tuple(by)

    def read(self, schema: StructType | str | None = None, besides: str | None = None, only: Sequence[str] | None = None) -> DataFrame | None:
        """The table's rows, with a schema without those of the batch ``besides``, or those of the batches ``only``.

        Where nothing was written yet, no rows, or None without a schema.
        """
        # limit(0): known to be empty when a query over it is planned, so that joins with it cost nothing
        rows = None if schema is None else self.spark.createDataFrame([], schema).limit(0)
        reader = self.spark.read if rows is None else self.spark.read.schema(StructType([*rows.schema, StructField("_batch", StringType())]))
        try:
            stored = reader.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return rows
        stored = stored if besides is None else stored.where(F.col("_batch") != besides)
        return (stored if only is None else stored.where(F.col("_batch").isin(*only))).drop("_batch")

    def append(self, df: DataFrame, batch_id: str) -> None:
        """df as the rows of batch_id, in place of what an earlier attempt at this batch has written."""
        rows = df.withColumn("_batch", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch", *self.by).parquet(self.path)


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ranges") -> DataFrame:
    """df, written in ranges of keys and order, with the range's number as ``_range``: a key has as many ranges as its rows need."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, since ranges are drawn from a sample
    return written(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), name)


def with_bases(rows: DataFrame, bases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with what bases say of their keys (nulls are equal) and ``_range``."""
    other = bases.withColumnsRenamed({k: f"_b_{k}" for k in (*keys, "_range")})
    same = F.lit(True)
    for k in (*keys, "_range"):
        same = same & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    return rows.join(other, same).drop(*[f"_b_{k}" for k in (*keys, "_range")])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """df with ``name``: the sum of value over a row and those of its keys before it, by order (nulls first).

    Rows are sorted by range, each range sums its own, and sums over the ranges before are added; so a key's rows are
    summed by as many tasks as it has ranges.  Nulls in keys are one key.
    """
    placed = ranged(df.withColumn("_value", value), keys, order)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum")).select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = F.sum("_value").over(Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    own = with_bases(placed.withColumn("_within", within), bases, keys)
    return own.withColumn(name, (F.col("_base") + F.col("_within")).cast("long")).select(*df.columns, name)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with ``name``: a row's number from 1 among those of its keys, by order (nulls first), counted over ranges."""
    return running_sum(df, keys, order, F.lit(1), name)


def first_wins(df: DataFrame, stored: DataFrame | None, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of df whose keys neither stored nor an earlier row of df (by order) has; null keys never conflict.

    Rows are shuffled once, by their keys, and of those that share keys a task sends the first of its own only.
    """
    some, none = (joint.join(f"`{k}` IS {what}" for k in keys) for joint, what in ((" AND ", "NOT NULL"), (" OR ", "NULL")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = df.where(some).withColumn("_nr", place).where("_nr = 1").drop("_nr")
    kept = kept if stored is None else kept.join(stored.select(*keys), list(keys), "left_anti")
    return kept.unionByName(df.where(none)).select(*df.columns)


def append_first_wins(df: DataFrame, table: Table, keys: Sequence[str], order: Sequence[str], batch_id: str) -> None:
    """Append to table what conflicts with nothing of other batches; rows that do are skipped."""
    table.append(first_wins(df, table.read(df.schema, besides=batch_id), keys, order), batch_id)


def run_report(**counted: DataFrame) -> DataFrame:
    """One row: the number of rows of each table given."""
    parts = [df.agg(F.count("*").alias(name)) for name, df in counted.items()]
    out = parts[0]
    for part in parts[1:]:  # single rows
        out = out.join(F.broadcast(part), F.lit(True))
    return out


def error_summary(errors: DataFrame) -> DataFrame:
    return errors.groupBy("source_id", "code", "retryable").agg(F.count("*").alias("n_errors"))
