"""What the operators share: written intermediate tables, joins with hot keys, and text conventions."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator of words in every operator here.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than a HOT-th of all rows is hot; so fewer than HOT keys are.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; a cluster has none that all its machines see, so it raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-digestflow-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    Tables lie below a folder of the application's name, which may go once its results are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, by_key: DataFrame, keys: list[str], held: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) to by_key, which has one row per key and in ``held`` how many rows have it, of ``total``.

    Keys of more than total / HOT rows, fewer than HOT by their number, are broadcast, so their rows stay where they are;
    only the others are shuffled.  Both tables are read twice: they should be written ones.
    """
    hot = by_key.where(F.col(held) > total / HOT)
    marks = F.broadcast(hot.select(*keys))
    cold = by_key.where(F.col(held) <= total / HOT)
    few, rest = rows.join(F.broadcast(hot), keys), rows.join(marks, keys, "left_anti").join(cold, keys, how)
    return few.unionByName(rest)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def sliced(batches, rows: int = 512, size: int = 4 << 20):
    """Arrow batches in slices of few rows and bytes: bounds what a worker holds as Python objects.

    A slice has at most ``size`` bytes of text, or one row.
    """
    for batch in batches:
        lengths = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                lengths += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
