"""Known items, verbatim repeats, similarity pairs, leaders, clusters."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType

from digestflow.functions.text import UNIT_SEPARATOR

from .tables import bounded_batches, numbered, shuffled, written

#: Groups of rows that are compared pair by pair in one go.
SMALL = 64
#: Signs of a row that are compared before vectors are.
SKETCH = 256
#: Rows whose vectors a worker holds at once, and rows of a block whose pairs are verified by their vectors.
PIECE, VERIFIED = 256, 512
#: Bytes of a row that is sent to all pairs of blocks, at most, of a block of such rows, and of one that is worth a task of its own.
NARROW, BLOCK_BYTES, TASK_BYTES = 1024, 64 << 20, 1 << 20
#: Keys that are counted in one table which all tasks get.
FEW_KEYS = 1 << 19
#: Edges of a task in which leaders are settled one after another.
SETTLED = 1 << 20
#: A cluster as rows: its id, representative and size with each of its members.
MEMBERS = ("id", "representative_id", "n_members", "pos", "material_id", "similarity")
LINKS = ("material_id", "duplicate_of_id", "kind", "similarity")


def drop_known(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New materials whose id is in no history."""
    return new.join(stored.select("id"), "id", "left_anti")


def all_links(*tables: DataFrame) -> DataFrame:
    """Exact and semantic links in one table; of links between the same two materials, the more similar, exact before semantic."""
    every = tables[0].select(*LINKS)
    for other in tables[1:]:
        every = every.unionByName(other.select(*LINKS))
    place = F.struct("similarity", (F.col("kind") == "exact_content").alias("exact"))
    best = every.groupBy("material_id", "duplicate_of_id").agg(F.max_by(F.struct("kind", "similarity"), place).alias("l"))
    return best.select("material_id", "duplicate_of_id", "l.kind", "l.similarity")


def repeated_ids(batch: DataFrame) -> DataFrame:
    """Ids that a batch has more than once (an error of its producer)."""
    return batch.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def exact(new: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """new (id, content_hash, batch_pos, ...) -> unique materials, links of the others.

    A stored material with the same hash comes first (the earliest by published_at, id, in all of history), else the
    first of the batch by batch_pos.  Both sides are reduced to one row per hash before they meet.  Only hashes that occur again are
    looked up, and these are written before: where they are few, Spark knows it and doesn't shuffle the rows.
    """
    earliest = stored.groupBy("content_hash").agg(F.min(F.struct("published_at", "id")).alias("s")).select("content_hash", F.col("s.id").alias("stored_id"))
    first = new.groupBy("content_hash").agg(F.min(F.struct("batch_pos", "id")).alias("f"), F.count("*").alias("n")).select("content_hash", F.col("f.id").alias("first_id"), "n")
    again = first.join(earliest, "content_hash", "left").where("n > 1 OR stored_id IS NOT NULL")
    target = written(again.select("content_hash", F.coalesce("stored_id", "first_id").alias("target")), "targets")
    both = new.where("content_hash IS NOT NULL").join(target, "content_hash", "left")
    links = both.where("id != target").select(
        F.col("id").alias("material_id"), F.col("target").alias("duplicate_of_id"), F.lit("exact_content").alias("kind"), F.lit(1.0).alias("similarity"), "batch_pos"
    )
    return both.where("id = coalesce(target, id)").select(*new.columns), links


def combine(lookback: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lookback and new rows, one per id, and the ids whose rows disagree."""
    every = lookback.unionByName(new)
    marked = every.groupBy("id").agg(F.count_distinct(F.xxhash64(*[F.col(c) for c in every.columns])).alias("n"))
    return every.dropDuplicates(["id"]), marked.where("n > 1").select("id")


class _Places(dict):
    """word -> CRC-32, of a batch."""

    def __missing__(self, word: str) -> int:
        found = self[word] = zlib.crc32(word.encode())
        return found


def hashed_counts(texts: pd.Series, dims: int = 4096) -> list[np.ndarray]:
    """The default encoder: square roots of hashed word counts, of unit length."""
    out, places = [], _Places()
    for text in texts:
        at = np.fromiter(map(places.__getitem__, (text or "").lower().split()), np.int64)
        v = np.sqrt(np.bincount(at % dims, minlength=dims)).astype(np.float32)
        n = np.linalg.norm(v)
        out.append(v / n if n else v)
    return out


def encode(df: DataFrame, encoder: Callable[[pd.Series], list] = hashed_counts, text_col: str = "dedup_text") -> DataFrame:
    """df with ``vec``: encoder over at most PIECE texts at a time, so a worker's memory doesn't follow Arrow's batches."""

    @F.pandas_udf(ArrayType(FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for start in range(0, len(batch), PIECE):
                yield pd.Series([np.asarray(v, np.float32) for v in encoder(batch.iloc[start : start + PIECE])])

    return df.withColumn("vec", vectors(F.col(text_col)))


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups of adjacent rows with equal key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        if not len(keys):
            continue
        last = int(np.argmax(keys == keys[-1]))  # where the group that may go on begins
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _compared(keyed: DataFrame, payload: str, block: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], load: Callable[[pa.Array], np.ndarray], kind: str, rowwise: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, found_before: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None, few_keys: bool = True) -> DataFrame:
    """keyed (key, id, payload) -> a, b, value of pairs within a key: near(left rows, right rows) gives NaN for the others.

    rowwise, if given, does the same for one row each: groups of SMALL rows or fewer are then compared all at once.
    found_before (left rows, right rows, their ``band``, a further column of keyed), if given, says which pairs another key has too: these are left out.
    few_keys: there are at most FEW_KEYS of them, whose sizes all tasks get, so rows are shuffled once.

    Keys with more than ``block`` rows are cut into blocks, and each pair of blocks goes to a task of its own.
    """
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    cut = keyed.join(F.broadcast(sizes) if few_keys else sizes, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = cut.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, 2).otherwise(F.when(F.col("own") == low, 0).otherwise(1))
    # the band goes in a number with the side
    side = F.col("band") * 4 + side if found_before else side
    dealt = dealt.select(F.xxhash64("key", low, high).alias("task"), side.alias("side"), "id", payload)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "task"):
            ids, task, side = np.array(table["id"].to_pylist(), object if kind == "string" else None), table["task"].to_numpy(), table["side"].to_numpy()
            rows, id_type = table[payload].combine_chunks(), table.schema.field("id").type
            side, band = side & 3, side >> 2
            starts = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
            out: list[list] = [[], [], []]

            def keep(x: np.ndarray, y: np.ndarray, found: np.ndarray) -> None:
                for column, v in zip(out, (np.where(x < y, x, y), np.where(x < y, y, x), found)):
                    column.extend(v.tolist())

            ends = np.append(starts[1:], len(task))
            few = np.repeat(ends - starts <= (SMALL if rowwise else 1), ends - starts)
            if rowwise and few.any():
                some, m = np.flatnonzero(few), load(rows)
                for step in range(1, SMALL):
                    i = some[some + step < len(task)]
                    some = i = i[task[i] == task[np.minimum(i + step, len(task) - 1)]]
                    if not len(i):
                        break
                    i = i[(side[i] == 2) | (side[i] != side[i + step])]
                    value = rowwise(m[i], m[i + step])
                    i, value = i[~np.isnan(value)], value[~np.isnan(value)]
                    ok = ids[i] != ids[i + step]
                    if found_before:
                        ok &= ~found_before(m[i], m[i + step], band[i])
                    keep(ids[i][ok], ids[i + step][ok], value[ok])
            for s, e in zip(starts.tolist(), ends.tolist()):
                if e - s < 2 or few[s]:
                    continue
                m, own, names = load(rows.slice(s, e - s)), side[s:e], ids[s:e]
                left, right = np.flatnonzero(own != 1), np.flatnonzero(own != 0)
                for start in range(0, len(left), 512):
                    part = left[start : start + 512]
                    value = near(m[part], m[right])
                    i, j = np.nonzero(~np.isnan(value))
                    x, y = names[part[i]], names[right[j]]
                    ok = (x != y) & ((own[part[i]] == 0) | (x < y))
                    if found_before:
                        at = np.flatnonzero(ok)
                        ok[at] = ~found_before(m[part[i[at]]], m[right[j[at]]], np.full(len(at), band[s]))
                    keep(x[ok], y[ok], value[i[ok], j[ok]])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], id_type), pa.array(out[1], id_type), pa.array(out[2], pa.float64())], ["a", "b", "value"])

    partitions = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(partitions, "task").sortWithinPartitions("task").mapInArrow(compare, f"a {kind}, b {kind}, value double")


def bands_for(tau: float, bits: int, recall: float) -> int:
    """Bands of ``bits`` signs after which a pair at tau agrees in none with probability 1 - recall at most; 24 at least."""
    agree = (1 - math.acos(tau) / math.pi) ** bits
    return 24 if agree == 1 else max(24, math.ceil(math.log(1 - recall) / math.log1p(-agree)))


def similarity_pairs(df: DataFrame, tau: float = 0.9, mode: str = "exact", block: int = 2048, bands: int | None = None, bits: int = 12, seed: int = 5, recall: float = 0.999999) -> DataFrame:
    """df (id, vec) -> a, b (a < b), similarity: pairs with a cosine of tau or more.

    ``exact`` compares every two rows, a pair of blocks to a task, so its work is quadratic.  ``bands`` compares rows
    that agree in one of ``bands`` groups of ``bits`` signs of random projections: first SKETCH of their signs (a pair is out
    if these differ five standard deviations more than tau lets them), then the vectors, in pairs of blocks; vectors of more than NARROW bytes
    only where all signs differ by no more than six standard deviations from what tau lets them.  Vectors are
    evaluated and written once, as bytes.  Zero and null vectors are like nothing.  Ids must be unique and not null.  Unless given, ``bands`` follows from ``recall``, the least chance that a pair at tau agrees in
    one of them (bands_for).
    """
    if not 0 < tau <= 1:
        raise ValueError("tau must be above 0 and at most 1")
    bands = bands or bands_for(tau, bits, recall)
    kind = dict(df.dtypes)["id"]
    rows = df.select("id", "vec")
    bounded_batches(df.sparkSession)

    def matrix(vectors: pa.Array) -> np.ndarray:
        return unit(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1))

    def unit(vectors) -> np.ndarray:
        m = np.asarray(vectors, np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        near = x @ y.T
        return np.where(near >= tau, np.clip(near, 0, 1), np.nan)

    if mode == "exact":
        stored = written(rows, "vectors").where("vec IS NOT NULL")
        return _compared(stored.withColumn("key", F.lit(0).cast("long")), "vec", block, cosines, matrix, kind).withColumnRenamed("value", "similarity")

    # of the vectors' numbers, as bytes: readers of lists hold thousands of rows' elements and their levels at once
    number = {"array<float>": np.float32, "array<double>": np.float64}.get(dict(rows.dtypes)["vec"])
    if number is None:
        rows, number = rows.withColumn("vec", F.col("vec").cast("array<double>")), np.float64

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that have a direction, their vectors as bytes, with their signs, from one evaluation of the vectors."""
        planes = None
        for batch in (b.slice(i, PIECE) for b in batches for i in range(0, b.num_rows, PIECE)):
            batch = batch.filter(pc.is_valid(batch.column(1)))
            if not batch.num_rows:
                continue
            own = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(number, copy=False).reshape(batch.num_rows, -1)
            m = own.astype(np.float32, copy=False)
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((m.shape[1], bands * bits), np.float32)
            some = m.any(axis=1)
            kept, on = batch.column(0).filter(pa.array(some)), np.packbits(m[some] @ planes > 0, axis=1)
            yield pa.RecordBatch.from_arrays([kept, *(pa.array([x.tobytes() for x in part], pa.binary()) for part in (own[some], on))], ["id", "vec", "packed"])

    def from_bytes(vectors: pa.Array) -> np.ndarray:
        return unit(_flat(vectors, number))

    def cosines_each(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        cos = (unit(x) * unit(y)).sum(1).clip(0, 1)
        return np.where(cos >= tau, cos, np.nan)

    @F.pandas_udf(ArrayType(LongType()))
    def keys(packed: pd.Series) -> pd.Series:
        on = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1)[:, : bands * bits]
        return pd.Series(list(on.reshape(len(packed), bands, bits) @ (1 << np.arange(bits)) + (np.arange(bands) << bits)))

    # signs that travel to the bands: whole 64-bit words of the first of them
    sketch = min(SKETCH, bands * bits // 64 * 64) or bands * bits
    apart = math.acos(tau) / math.pi
    most = sketch * (apart + 5 * math.sqrt(apart * (1 - apart) / sketch)) + 1

    def differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = np.zeros((len(x), len(y)), np.uint16)
        for k in range(x.shape[1]):
            n += np.bitwise_count(x[:, k][:, None] ^ y[:, k])
        return np.where(n <= most, n, np.nan)

    def differ_each(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = np.bitwise_count(x ^ y).sum(1)
        return np.where(n <= most, n, np.nan)

    def words(packed: pa.Array) -> np.ndarray:
        flat = _flat(packed, np.uint8)
        return np.pad(flat, ((0, 0), (0, -flat.shape[1] % 8))).view(np.uint64)

    # bands that lie within the sketch whole: a pair that agrees in one of them is found in the first of those alone
    inside = np.zeros((sketch // bits, math.ceil(sketch / 8) * 8), np.uint8)
    for k in range(len(inside)):
        inside[k, k * bits : (k + 1) * bits] = 1
    inside = np.packbits(inside, axis=1)
    inside = np.pad(inside, ((0, 0), (0, -inside.shape[1] % 8))).view(np.uint64)

    def found_before(x: np.ndarray, y: np.ndarray, band: np.ndarray) -> np.ndarray:
        apart, before, left = x ^ y, np.zeros(len(x), bool), np.arange(len(x))
        for k, mask in enumerate(inside):
            left = left[band[left] > k]
            if not len(left):
                break
            at = np.flatnonzero(mask)
            agree = ((apart[left][:, at] & mask[at]) == 0).all(1)
            before[left[agree]], left = True, left[~agree]
        return before

    mean = bands * bits * apart

    def differ_in_all(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = np.bitwise_count(x ^ y).sum(1)
        return np.where(n <= mean + 6 * math.sqrt(mean * (1 - apart)) + 1, n, np.nan)

    stored = written(rows.mapInArrow(signed, f"id {kind}, vec binary, packed binary"), "vectors")
    keyed = stored.select("id", F.explode(keys("packed")).alias("key"), F.substring("packed", 1, math.ceil(sketch / 8)).alias("packed"))
    keyed = keyed.withColumn("band", F.shiftright("key", bits).cast("int"))
    found = _compared(keyed, "packed", block, differ, words, kind, differ_each, found_before, bands << bits <= FEW_KEYS).select("a", "b")
    n, width = stored.agg(F.count("*"), F.coalesce(F.max(F.length("vec")), F.lit(0))).first()
    if width <= NARROW:
        return _in_all_blocks(found, stored.select("id", "vec"), kind, n * width, lambda v: _flat(v, number), cosines_each).withColumnRenamed("value", "similarity")
    likely = _in_all_blocks(found, stored.select("id", "packed"), kind, n * math.ceil(bands * bits / 8), words, differ_in_all)
    return _verified(written(likely.select("a", "b"), "candidates"), stored.select("id", "vec"), tau, kind, from_bytes, min(block, VERIFIED))


def _flat(rows: pa.Array, number: type) -> np.ndarray:
    """Binary values of one length as a matrix of numbers, not copied."""
    if not len(rows):
        return np.zeros((0, 1), number)
    ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1]
    return np.frombuffer(rows.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(number).reshape(len(rows), -1)


def _in_all_blocks(found: DataFrame, rows: DataFrame, kind: str, size: int, load: Callable[[pa.Array], np.ndarray], near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """found (a, b, maybe repeated) -> a, b, value of those whose rows' near(left, right) isn't NaN, once each.

    Rows (id, payload) of ``size`` bytes in all are dealt to blocks by their ids, and each pair of blocks is one task's, which gets both blocks whole: so
    a pair moves once, knows its task by itself, and a row moves as many times as there are blocks, whatever its number of pairs.
    A task holds two blocks, and of pairs a batch.
    """
    spark = rows.sparkSession
    busy = math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))  # blocks whose pairs are two tasks for each core
    blocks = max(1, math.ceil(size / BLOCK_BYTES), min(busy, math.ceil(size / TASK_BYTES)))
    payload = rows.columns[1]
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    task = lambda x, y: F.least(x, y) * blocks + F.greatest(x, y)
    none = F.lit(None)
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = dealt.select(task(block("id"), F.col("other")).alias("task"), F.lit(0).alias("side"), F.col("id").alias("a"), none.cast(kind).alias("b"), payload)
    sent = sent.unionByName(found.select(task(block("a"), block("b")).alias("task"), F.lit(1).alias("side"), "a", "b", none.cast("binary").alias(payload)))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known, m, last = None, [], None, None, None
        for batch in batches:
            task, is_pair = batch.column("task").to_numpy(), batch.column("side").to_numpy() == 1
            starts = np.flatnonzero(np.append(True, (task[1:] != task[:-1]) | (is_pair[1:] != is_pair[:-1]))).tolist() if len(task) else []
            for s, e in zip(starts, [*starts[1:], len(task)]):
                if task[s] != now:
                    now, held, known, m, last = task[s], [], None, None, None
                if not is_pair[s]:
                    held.append(batch.select(["a", payload]).slice(s, e - s))
                    continue
                if known is None:
                    both = pa.Table.from_batches(held).combine_chunks()
                    known, m, held = both["a"].chunk(0), load(both[payload].chunk(0)), []
                a, b = (batch.column(c).slice(s, e - s) for c in ("a", "b"))
                left, right = (pc.index_in(c, known).to_numpy() for c in (a, b))
                # pairs come sorted, so repeated ones follow each other
                new = np.append(last != (left[0], right[0]), (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
                last, at = (left[-1], right[-1]), np.flatnonzero(new)
                value = np.concatenate([np.zeros(0), *(near(m[left[i]], m[right[i]]) for i in (at[k : k + 512] for k in range(0, len(at), 512)))])
                ok = ~np.isnan(value)
                kept = pa.array(at[ok])
                yield pa.RecordBatch.from_arrays([a.take(kept), b.take(kept), pa.array(value[ok], pa.float64())], ["a", "b", "value"])

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = sent.repartition(partitions, "task").sortWithinPartitions("task", "side", "a", "b")
    return ordered.mapInArrow(verify, f"a {kind}, b {kind}, value double")


def _verified(candidates: DataFrame, vectors: DataFrame, tau: float, kind: str, matrix: Callable[[pa.Array], np.ndarray], block: int) -> DataFrame:
    """candidates (a, b) whose vectors' cosine is tau or more, with it.

    A row's home is the least row it is a candidate with, or itself, so a group of alike rows has one; homes above ``block`` rows
    are cut into blocks.  A pair of blocks is one task's, and a row's vector goes there once, whatever its number of pairs.
    """
    both = candidates.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(candidates.select(F.col("b").alias("id"), F.col("a").alias("other")))
    home = both.groupBy("id").agg(F.least(F.first("id"), F.min("other")).alias("home"))
    sizes = home.groupBy("home").agg(F.count("*").alias("n"))
    placed = home.join(shuffled(sizes), "home").select("id", F.xxhash64("home", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block))).alias("at"))
    keyed = candidates.join(shuffled(placed.toDF("a", "pa")), "a").join(shuffled(placed.toDF("b", "pb")), "b").select(F.xxhash64(F.least("pa", "pb"), F.greatest("pa", "pb")).alias("task"), "a", "b")
    keyed = written(keyed, "block-pairs")
    needed = keyed.select("task", F.col("a").alias("id")).unionByName(keyed.select("task", F.col("b").alias("id"))).distinct()
    none = F.lit(None)
    sent = needed.join(shuffled(vectors), "id").select("task", F.lit(0).alias("side"), F.col("id").alias("a"), none.cast(kind).alias("b"), "vec")
    sent = sent.unionByName(keyed.select("task", F.lit(1).alias("side"), "a", "b", none.cast(dict(vectors.dtypes)["vec"]).alias("vec")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "task"):
            task, is_pair = table["task"].to_numpy(), table["side"].to_numpy() == 1
            starts = np.flatnonzero(np.append(True, task[1:] != task[:-1])).tolist()
            while starts:  # some whole groups at a time, of about 1,024 vectors or one group
                room = int(np.searchsorted(np.cumsum(~is_pair[starts[0] :]), 1024)) + starts[0]
                k = max(1, int(np.searchsorted(starts, room, "right")) - 1) if room < len(task) else len(starts)
                begin, end = starts[0], starts[k] if k < len(starts) else len(task)
                starts = starts[k:]
                part, pair, of = table.slice(begin, end - begin), is_pair[begin:end], task[begin:end]
                a, b = part["a"].to_pylist(), part["b"].to_pylist()
                place = {(of[i], a[i]): k for k, i in enumerate(np.flatnonzero(~pair).tolist())}
                m, rows = matrix(part["vec"].filter(pa.array(~pair)).combine_chunks()), np.flatnonzero(pair).tolist()
                left, right = (np.array([place[of[i], side[i]] for i in rows], np.int64) for side in (a, b))
                cos = np.concatenate([np.zeros(0), *((m[left[i : i + 512]] * m[right[i : i + 512]]).sum(1) for i in range(0, len(rows), 512))]).clip(0, 1)
                near, id_type = np.flatnonzero(cos >= tau), table.schema.field("a").type
                yield pa.RecordBatch.from_arrays([pa.array([side[rows[i]] for i in near.tolist()], id_type) for side in (a, b)] + [pa.array(cos[near])], ["a", "b", "similarity"])

    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(partitions, "task").sortWithinPartitions("task", "side").mapInArrow(verify, f"a {kind}, b {kind}, similarity double")


def greedy_leaders(nodes: DataFrame, pairs: DataFrame, per_task: int = SETTLED) -> DataFrame:
    """nodes (id, pos) -> id, pos, leader (boolean): a row leads if no leader before it (by pos) is in a pair with it.

    In each round, undecided rows with no undecided row before them lead.  Then each task takes a range of positions, of about
    ``per_task`` edges, and goes through its rows in order: a row is decided as soon as one before it leads, or all of them
    follow; only what hangs on another task's undecided rows stays for the next round.  So a chain takes as many rounds as it has
    ranges, and what is left is dealt to fewer of them.  Each round is written; ties of pos go by id.
    """
    place = nodes.select("id", F.struct("pos", "id").alias("p"))
    ends = pairs.select("a", "b").join(shuffled(place.toDF("a", "pa")), "a").join(shuffled(place.toDF("b", "pb")), "b")
    first = F.col("pa") < F.col("pb")
    edges = written(ends.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("before"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("after"),
        F.greatest("pa", "pb").alias("at"),
    ), "edges")
    kind = dict(nodes.dtypes)["id"]
    undecided = edges.select(F.col("before").alias("id")).union(edges.select("after")).distinct()
    alone = nodes.select("id").join(shuffled(undecided), "id", "left_anti").withColumn("leader", F.lit(True))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, lead, open_ = {}, None, False, False  # of this range's rows: True, False, or None while undecided

        def close() -> None:
            known[now] = False if lead else None if open_ else True

        for batch in batches:
            for after, before, leads in zip(*(batch.column(c).to_pylist() for c in ("after", "before", "leads"))):
                if after != now:
                    if now is not None:
                        close()
                    now, lead, open_ = after, False, False
                state = True if leads else known.get(before)
                lead, open_ = lead or state is True, open_ or state is None
        if now is not None:
            close()
        done = [(i, v) for i, v in known.items() if v is not None]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in done], batch.column("after").type), pa.array([v for _, v in done])], ["id", "leader"])

    decided = []
    while undecided.take(1):
        free = written(undecided.join(shuffled(edges.select(F.col("after").alias("id"))), "id", "left_anti"), "free")
        ranges = max(1, math.ceil(edges.count() / per_task))
        marked = edges.join(shuffled(free.select(F.col("id").alias("before"), F.lit(True).alias("leads"))), "before", "left")
        sent = marked.repartitionByRange(ranges, "at").sortWithinPartitions("at").select("after", "before", "leads")
        settled = written(sent.mapInArrow(settle, f"id {kind}, leader boolean"), "settled")
        new = free.withColumn("leader", F.lit(True)).unionByName(settled)
        if ranges == 1:  # nothing hangs on another task
            decided.append(new)
            break
        left = written(edges.join(shuffled(settled.select(F.col("id").alias("after"))), "after", "left_anti").join(shuffled(new.toDF("before", "leads")), "before", "left"), "left")
        followers = written(left.where("leads").select(F.col("after").alias("id")).distinct(), "followers")
        decided.append(new.unionByName(followers.withColumn("leader", F.lit(False))))
        undecided = written(undecided.join(shuffled(decided[-1].select("id")), "id", "left_anti"), "undecided")
        still = left.where("leads IS NULL").join(shuffled(followers.toDF("after")), "after", "left_anti").join(shuffled(followers.toDF("before")), "before", "left_anti")
        edges = written(still.select("before", "after", "at"), "edges")
    for part in decided:
        alone = alone.unionByName(part)
    return nodes.select("id", "pos").join(shuffled(alone), "id")


def clusters(leaders: DataFrame, pairs: DataFrame, new_ids: DataFrame, assign: str = "all") -> tuple[DataFrame, DataFrame]:
    """Members (representative_id, material_id, similarity) of clusters that hold a new id, a row each, and their links.

    ``all``: a row is in the cluster of every leader before it that it is similar to; ``best``: only in the most similar
    one's.  A leader is a member of its own cluster with similarity 1.  See identified() for ids and places.
    """
    lead = leaders.where("leader").select("id")
    place = F.struct("pos", "id")
    both = pairs.select("a", "b", "similarity").union(pairs.select("b", "a", "similarity")).toDF("rep", "member", "similarity")
    members = both.join(shuffled(leaders.where("leader").select(F.col("id").alias("rep"), place.alias("rp"))), "rep")
    members = members.join(shuffled(leaders.where("NOT leader").select(F.col("id").alias("member"), place.alias("mp"))), "member").where("rp < mp").drop("rp", "mp")
    if assign == "best":
        best = members.groupBy("member").agg(F.max_by("rep", F.struct("similarity", "rep")).alias("rep"))
        members = members.join(shuffled(best), ["member", "rep"])
    own = lead.select(F.col("id").alias("rep"), F.col("id").alias("member"), F.lit(1.0).alias("similarity"))
    every = own.unionByName(members.groupBy("rep", "member").agg(F.max("similarity").alias("similarity")))
    with_new = every.join(shuffled(new_ids.select(F.col("id").alias("member"))), "member", "left_semi").select("rep").distinct()
    kept = every.join(shuffled(with_new), "rep", "left_semi")
    out = kept.select(F.col("rep").cast("string").alias("representative_id"), F.col("member").cast("string").alias("material_id"), "similarity")
    links = out.where("material_id != representative_id")
    return out, links.select("material_id", F.col("representative_id").alias("duplicate_of_id"), F.lit("semantic").alias("kind"), "similarity")


def attach_exact(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of clusters with the exact duplicates of each: further rows, with copy_of (the member) and batch_pos.

    What is a member already stays as it is; of several members that a material copies the first in the cluster's order counts.
    """
    second = F.col("material_id") != F.col("representative_id")
    own = members.select("representative_id", F.col("material_id").alias("copy_of"), second.alias("second"))
    copies = links.select(F.col("duplicate_of_id").cast("string").alias("copy_of"), F.col("material_id").cast("string").alias("material_id"), "batch_pos")
    more = copies.join(shuffled(own), "copy_of").join(shuffled(members.select("representative_id", "material_id")), ["representative_id", "material_id"], "left_anti")
    first = more.groupBy("representative_id", "material_id").agg(F.min(F.struct("second", "copy_of", "batch_pos")).alias("o"))
    added = first.select("representative_id", "material_id", F.lit(1.0).alias("similarity"), "o.copy_of", "o.batch_pos")
    return members.unionByName(added, allowMissingColumns=True)


def cluster_ids(members: DataFrame) -> DataFrame:
    """representative_id, id, n_members: the SHA-256 of each cluster's ordered member ids.

    Sorted ids stream into one hash a cluster, so a task holds a batch of rows whatever a cluster's size; the hash itself is
    sequential, so one task reads the ids (and nothing else) of a cluster.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, n = None, None, 0
        for batch in batches:
            done = []
            for rep, rows in groupby(zip(*(batch.column(c).to_pylist() for c in range(2))), itemgetter(0)):
                ids = [member for _, member in rows]
                if rep != now:
                    if sha:
                        done.append((now, sha.hexdigest(), n))
                    now, sha, n = rep, hashlib.sha256(), 0
                sha.update(((UNIT_SEPARATOR if n else "") + UNIT_SEPARATOR.join(ids)).encode())
                n += len(ids)
            yield told(done)
        if sha:
            yield told([(now, sha.hexdigest(), n)])

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(kinds.items())})

    kinds = {"representative_id": pa.string(), "id": pa.string(), "n_members": pa.int64()}
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.select("representative_id", "material_id").repartition(n, "representative_id").sortWithinPartitions("representative_id", "material_id")
    return rows.mapInArrow(hashed, "representative_id string, id string, n_members bigint")


def identified(members: DataFrame) -> DataFrame:
    """Members of clusters, as clusters() or attach_exact() give them -> MEMBERS: a row each, with the cluster's id and size.

    A cluster's places count from 0: the representative, then its members by id, then exact copies in the order of the members
    they copy and of the batch.  A cluster is nowhere one row: clusters(), copies and places are joins, sums and sorted ranges
    over members, so its size is bounded by no task's memory.
    """
    none = {c: F.lit(None).cast(k) for c, k in (("copy_of", "string"), ("batch_pos", "bigint")) if c not in members.columns}
    of = F.coalesce("copy_of", "material_id")
    rows = members.withColumns(none) if none else members
    rows = written(rows.select(
        "representative_id", "material_id", "similarity", F.col("copy_of").isNotNull().alias("_copy"), (of != F.col("representative_id")).alias("_second"), of.alias("_of"), "batch_pos"
    ), "members")
    placed = numbered(rows, ["representative_id"], ["_copy", "_second", "_of", "batch_pos", "material_id"], "pos")
    return placed.join(shuffled(cluster_ids(rows)), "representative_id").withColumn("pos", F.col("pos") - 1).select(*MEMBERS)


def gathered(found: DataFrame) -> DataFrame:
    """MEMBERS -> id, representative_id, material_ids (in order), similarities (map): one row per cluster.

    For readers that want a cluster as one value; nothing in the library does, since the row grows with the cluster.
    """
    each = F.array_sort(F.collect_list(F.struct("pos", "material_id", "similarity")))
    rows = found.groupBy("id", "representative_id").agg(each.alias("m"))
    pair = F.transform("m", lambda x: F.struct(x["material_id"], x["similarity"]))
    return rows.select("id", "representative_id", F.col("m.material_id").alias("material_ids"), F.map_from_entries(pair).alias("similarities"))
