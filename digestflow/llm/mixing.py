"""Mixing sources to target weights: fixed-length blocks, multinomial shard counts, pseudorandom index permutations.

* The documents of a source, in an order drawn from a hash of their ids, form one stream of words, cut into blocks of
  ``block`` words (the last may be shorter).  A document's place in the stream comes from sums per hash bucket, so no
  task sees a whole source.
* Each output shard draws its number of blocks per source from a multinomial over what the sources have left of their
  quotas; the counts of all shards so add up to the quotas.
* A source's slot r takes block perm(r mod n_blocks) of pass r div n_blocks, by a Feistel permutation keyed by source,
  pass and seed; slots and documents are joined by (source, block).

The plan on the driver has a row per shard and source: at most PLAN_CELLS, whatever the input.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, n_partitions, staged

MAX_SOURCES = 100_000
PLAN_CELLS = 4_000_000
#: Blocks of an output shard, as far as PLAN_CELLS allows, and slots that a row of the plan gives at once.
SHARD_BLOCKS, EXPLODED = 4096, 65_536
#: Documents of a hash bucket of the largest source, unless a source would have more than MOST_BUCKETS of them.
BUCKET_ROWS, MOST_BUCKETS = 256, 65_536
MAX_REPEATS = 3


def share_out(sizes: Sequence[float], weights: Sequence[float], repeats: float = MAX_REPEATS) -> list[float]:
    """Targets that share sum(sizes) by weight, none above repeats * size; what is above goes to the others by weight."""
    targets, left, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        whole = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / whole > repeats * sizes[i]}
        for i in over or free:
            targets[i] = float(repeats * sizes[i]) if over else left * weights[i] / whole
        if not over:
            break
        left -= sum(targets[i] for i in over)
        free -= over
    return targets


def draw_shards(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Multinomial counts (shard, source) whose sums over the shards are the quotas."""
    left, rng = quotas.astype(np.int64).copy(), np.random.default_rng(seed)
    ends = np.linspace(0, left.sum(), shards + 1).round().astype(np.int64)
    counts = np.zeros((shards, len(left)), np.int64)
    for j, size in enumerate(np.diff(ends)):
        while size > 0:
            drawn = np.minimum(rng.multinomial(size, left / left.sum()), left)
            counts[j] += drawn
            left -= drawn
            size -= drawn.sum()
    return counts


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at index: four Feistel rounds, walking on while out of range."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask, x = (np.uint64(1) << half) - np.uint64(1), index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> half, x[todo] & mask
        for k in range(4):
            word = np.uint64((key * 4 + k) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            left, right = right, left ^ (_mixed(right + word) & mask)
        x[todo] = left << half | right
        todo = x >= n
    return x.astype(np.int64)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


class Mix:
    """A mix of docs: ``sources`` (source, s, source_size, target, ...), ``documents`` and ``picks``.

    ``weights`` repeat over the sources in code-point order, null last.  An empty table, or one without words, gives a
    mix that takes nothing.  Ids may repeat or be null: rows are told apart by their place in the stream.  Reruns agree.
    """

    def __init__(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = (5, 2, 1), block: int = 512, seed: int = 7,
    ):
        self.docs, self.columns, self.block, self.seed = docs, (id_col, text_col, source_col), block, seed
        spark = docs.sparkSession
        self.sized = staged(_sized(docs, id_col, text_col, source_col), "mix-sizes")
        counts = [F.sum("size").alias("size"), F.count("*").alias("rows")]
        found = self.sized.groupBy("source").agg(*counts).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found = sorted(found, key=lambda r: (r.source is None, r.source or ""))
        self.buckets = max(1, min(MOST_BUCKETS, max((r["rows"] for r in found), default=1) // BUCKET_ROWS))
        sizes = [r["size"] for r in found]
        targets = share_out(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
        blocks = [-(-n // block) for n in sizes]
        quotas = [round(t / n * b) if n else 0 for t, n, b in zip(targets, sizes, blocks)]
        shards = max(1, min(4096, PLAN_CELLS // max(1, len(sizes)), sum(quotas) // SHARD_BLOCKS + 1))
        counts = draw_shards(np.array(quotas, np.int64), shards, seed)
        first = np.cumsum(counts, 0) - counts
        plan = [
            (j, i, blocks[i], int(first[j, i]), int(counts[j, i])) for j in range(shards) for i in range(len(sizes)) if counts[j, i]
        ]
        self.sources = spark.createDataFrame(
            [(r.source, i, int(n), float(t)) for i, (r, n, t) in enumerate(zip(found, sizes, targets))],
            "source string, s int, source_size long, target double",
        )
        self.plan = spark.createDataFrame(plan, "shard int, s int, blocks long, first long, n long")

    def slots(self) -> DataFrame:
        """One row per slot of the mix: shard, s (source), block."""
        seed = self.seed

        @F.pandas_udf("long")
        def place(s: pd.Series, rank: pd.Series, blocks: pd.Series) -> pd.Series:
            s, rank, blocks = s.to_numpy(), rank.to_numpy(), blocks.to_numpy()
            out, turn = np.zeros(len(s), np.int64), rank // np.maximum(blocks, 1)
            for i, e in set(zip(s.tolist(), turn.tolist())):
                at = (s == i) & (turn == e)
                n = int(blocks[at][0])
                out[at] = permuted(rank[at] % n, n, (seed * 1_000_003 + i) * 64 + e)
            return pd.Series(out)

        starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(EXPLODED).cast("long")))
        parts = self.plan.withColumn("from", starts).repartition(n_partitions(self.plan.sparkSession), "shard", "s", "from")
        last = F.least(F.col("n"), F.col("from") + EXPLODED) - 1
        each = parts.withColumn("i", F.explode(F.sequence(F.col("from"), last)))
        return each.select("shard", "s", place("s", F.col("first") + F.col("i"), "blocks").alias("block"))

    def documents(self) -> DataFrame:
        """id, source, size, s, source_size, target and start: the document's place in its source's stream."""
        rows = self.sized.join(F.broadcast(self.sources), self.sized["source"].eqNullSafe(self.sources["source"])).select(
            "id", self.sized["source"], "size", "s", "source_size", "target", F.xxhash64("id", F.lit(self.seed)).alias("h")
        )
        rows = rows.withColumn("bucket", F.pmod("h", F.lit(self.buckets)))
        sums = rows.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
        before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("s", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
        within = Window.partitionBy("s", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))
        return rows.join(sums, ["s", "bucket"]).withColumn("start", start).drop("h", "bucket", "base")

    def picks(self) -> DataFrame:
        """One row per document and block of it: the columns of documents(), at, words (its share) and times."""
        block = self.block
        rows = self.documents().where("size > 0")
        spans = rows.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
        begin = F.greatest(F.col("start"), F.col("block") * block)
        end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
        spans = spans.withColumn("at", begin - F.col("start")).withColumn("words", end - begin)
        times = self.slots().groupBy("s", "block").agg(F.count("*").alias("times"))
        # sizes that Spark guesses for exploded slots are far too low: not to be broadcast
        return spans.join(times.hint("merge"), ["s", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))

    def taken(self) -> DataFrame:
        """One row per row of docs: id, source, size, source_size, target, taken (words, repeats counted)."""
        keys = ["id", "source", "size", "s", "start", "source_size", "target"]
        some = self.picks().groupBy(*keys).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        none = self.documents().where("size = 0").select(*keys).withColumn("taken", F.lit(0).cast("long"))
        return some.unionByName(none).drop("s", "start")

    def mixed(self) -> DataFrame:
        """The mixed rows: each document as often as it is taken, all columns kept.

        Copy e of a document has the words of its blocks that the mix takes e times or more; where these are all, the
        text is the whole text, else these words joined by spaces.
        """
        id_col, text_col, source_col = self.columns
        keys = ["_mix_id", "_mix_source", "_mix_size", "_mix_row"]
        spans = self.picks().where("times > 0").groupBy("id", "source", "size", "s", "start").agg(
            F.array_sort(F.collect_list(F.struct("at", "words", "times"))).alias("_mix_spans")
        )
        alike = Window.partitionBy("id", "source", "size").orderBy("start")
        spans = spans.select(
            F.col("id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size"),
            F.row_number().over(alike).alias("_mix_row"), "_mix_spans",
        )
        same = Window.partitionBy(*keys[:3]).orderBy(text_col)
        rows = self.docs.withColumns(
            {
                "_mix_id": F.col(id_col),
                "_mix_source": F.col(source_col).cast("string"),
                "_mix_size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"),
            }
        ).withColumn("_mix_row", F.row_number().over(same))
        on = [rows[k].eqNullSafe(spans[k]) for k in keys]
        both = rows.join(spans, on).select(*[rows[c] for c in self.docs.columns], rows["_mix_size"], "_mix_spans")
        most = F.aggregate("_mix_spans", F.lit(0).cast("long"), lambda a, x: F.greatest(a, x["times"]))
        each = both.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), most)))
        used = F.filter("_mix_spans", lambda x: x["times"] >= F.col("_mix_copy"))
        got = F.aggregate(used, F.lit(0).cast("long"), lambda a, x: a + x["words"])
        words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))
        part = F.transform(F.array(words), lambda w: F.flatten(F.transform(used, lambda x: F.slice(w, (x["at"] + 1).cast("int"), x["words"].cast("int")))))[0]
        text = F.when(got == F.col("_mix_size"), F.col(text_col)).otherwise(F.array_join(part, " "))
        return each.withColumn(text_col, text).select(*self.docs.columns)
