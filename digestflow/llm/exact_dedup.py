"""Exact deduplication over an extendible-hash index on shared files.

Texts are equal when they are identical after each run of ASCII white space became one space; null is the empty text.

* Each row gives an entry (id, 64-bit key of its text, SHA-256), written once to the shared folder.
* The directory starts as one bucket and doubles: in each round every bucket of more than ``capacity`` entries splits by
  one more bit of the key.  A bucket still overfull at the last depth, as under a hot text, is dealt to as many pages as
  it needs by the rows' ids.
* Owner tasks take whole buckets, or pages of one: a range of keys each.  An owner gets its rows' texts, chains those of
  one key, compares them byte by byte, and writes one link per different text, in the order of the keys, to its file of the index.
* A page of a split bucket hands on its links' texts, and the pages' chains are joined byte by byte as well.
* Each row looks up its bucket and key in the index.  Keys that very many rows look up are broadcast.

All of it is DataFrame functions.  Each text is shuffled once, to its owner, and no owner gets more rows than a bucket holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE, join_hot, n_partitions, staged

#: A directory has 2**MAX_DEPTH cells at most, whatever the input.
MAX_DEPTH = 20
#: Entries of a bucket, unless the table is so large that the directory would not hold buckets that small.
CAPACITY = 256


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def text_key(norm: Column, key_bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(norm), 64 - key_bits)


def directory(entries: DataFrame, capacity: int, key_bits: int, depth: int) -> DataFrame:
    """cell (the first ``depth`` bits of a key) -> bucket (``local depth/prefix``) and pages; at most 2**depth rows."""
    cells = entries.groupBy(F.shiftrightunsigned("key", key_bits - depth).alias("cell")).agg(F.count("*").alias("n"))
    now = staged(cells.select("cell", "n", F.lit(0).alias("local"), F.lit(0).cast("long").alias("prefix")), "directory")
    while True:
        held = now.groupBy("local", "prefix").agg(F.sum("n").alias("held"))
        full = held.where((F.col("held") > capacity) & (F.col("local") < depth))
        if not full.take(1):
            break
        # the cells of a full bucket part by the next bit of their keys
        split = now.join(full.select("local", "prefix", F.lit(1).alias("more")), ["local", "prefix"], "left")
        split = split.withColumn("local", F.col("local") + F.coalesce("more", F.lit(0)))
        now = staged(split.select("cell", "n", "local", F.expr(f"shiftrightunsigned(cell, {depth} - local)").alias("prefix")), "directory")
    pages = F.greatest(F.lit(1), F.ceil(F.col("held") / capacity)).cast("long")
    return now.join(held, ["local", "prefix"]).select("cell", F.concat_ws("/", "local", "prefix").alias("bucket"), pages.alias("pages"))


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, key_bits: int = 64
) -> tuple[DataFrame, DataFrame]:
    """Write the index of docs.  Returns its entries (id, key, sha, bucket) and its links (bucket, key, sha, keep_id, group_size).

    capacity: entries of a bucket; by default CAPACITY, or what fills a directory of MAX_DEPTH - 3 bits.
    """
    norm = normalized(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("key", text_key(F.col("norm"), key_bits))
    entries = staged(rows.select("id", "key", F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-entries")
    n = entries.count()
    # buckets are half full on average, and three bits beyond an even split find room for uneven ones
    capacity = capacity or max(CAPACITY, n >> (MAX_DEPTH - 3))
    depth = max(1, min(MAX_DEPTH, key_bits, (n // capacity + 1).bit_length() + 3))
    cells = F.broadcast(directory(entries, capacity, key_bits, depth))
    cell = F.shiftrightunsigned("key", key_bits - depth).alias("cell")
    owned = rows.select("id", "norm", "key", cell).join(cells, "cell")
    # the id is null-safe here: xxhash64 skips nulls
    owned = owned.withColumn("page", F.pmod(F.xxhash64("id"), "pages")).drop("cell")
    owned = owned.repartition(n_partitions(docs.sparkSession), "bucket", "page")
    # grouped where the rows are: an owner compares its texts' bytes
    links = owned.groupBy("bucket", "page", "key", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"), F.max("pages").alias("pages"))
    links = links.select(
        "bucket", "page", "key", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "n", F.when(F.col("pages") > 1, F.col("norm")).alias("text")
    )
    index = staged(links.sortWithinPartitions("bucket", "page", "key"), "dedup-index")
    return staged(entries.select("id", "key", "sha", cell).join(cells, "cell").select("id", "key", "sha", "bucket"), "dedup-lookups"), chained(index)


def chained(index: DataFrame) -> DataFrame:
    """The links of the index files with those of split buckets' pages joined: bucket, key, sha, keep_id, group_size."""
    links = index.groupBy("bucket", "key", "sha", "text").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return links.drop("text")


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, key_bits: int = 64
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    The row with the smallest id of its group stays; a null id counts as larger than any other and as equal to null.
    Rows that repeat both id and text cannot be told apart and share one verdict.  An empty table gives no rows; extra
    columns of docs are not read.  key_bits below 64 makes collisions likely (for tests).
    """
    return looked_up(*build_index(docs, id_col, text_col, capacity, key_bits))


def looked_up(entries: DataFrame, links: DataFrame) -> DataFrame:
    """The verdict on each entry (id, key, sha, bucket), from the links of its bucket."""
    found = join_hot(entries, staged(links, "dedup-links"), ["bucket", "key", "sha"], "group_size", entries.count())
    return found.select(
        "id",
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; rows that repeat both id and text all stay or all go."""
    gone = (
        duplicate_groups(docs, id_col, text_col)
        .where(~F.col("kept"))
        .select(F.col("id").alias("_gone_id"), F.col("text_sha256").alias("_gone_sha"))
        .distinct()
    )
    same_text = F.sha2(normalized(docs[text_col]), 256) == gone["_gone_sha"]
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone_id"]) & same_text, "left_anti")
