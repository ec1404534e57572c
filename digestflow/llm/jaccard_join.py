"""N-gram Jaccard join by chosen paths.

A document is the set of its runs of N words.  Documents with equal sets share a representative.

1. Paths.  In each of the runs a set chooses every token x with probability CHOICES / (tau * size), by a hash of run and
   token that all sets share; a chosen token is a bucket.  A bucket of more than LIMIT sets splits: each of its sets
   chooses again, by a hash of the bucket and the token, and so on, down to DEPTH levels.  Two sets of similarity tau or
   more share CHOICES chosen tokens on average in a bucket, so their common buckets are a branching process: the share s
   of buckets below which they meet in the end obeys s = 1 - exp(-CHOICES * s) at any depth, and a run misses them with
   exp(-CHOICES * s) at most.  runs_for() takes as many runs as the target recall needs if every bucket of a pair splits.
2. A large bucket whose sets are alike on the whole does not shrink when they choose again; it is compared as it is, as
   is what is still large at the last level.  The average similarity is read off the shares of ones among the sketches'
   bits.  This decides about work alone: a pair that a bucket holds is compared in it or goes on to its children.
3. Small buckets are compared by brute force: pairs of 1-bit minwise sketches.  Larger ones are cut into blocks of
   SIDE sets, and each pair of blocks is compared by a task of its own.  A pair whose sketches agree well below tau
   still counts (at 0.8, 256 independent bits overlook one with probability 6.4e-7, besides what the paths miss); a
   bucket hands on a spanning forest of such pairs, never the pairs.
4. The forest's components are candidate groups: every link lies within one.  Their texts are fetched once, and each
   pair within a group is compared exactly, by the tokens that two or more of a block pair share.  Links are counted,
   and the spanning forest of the links gives the classes: a group that hangs together by candidate pairs alone falls
   apart here.

Words part at ASCII white space; a text of fewer than N words is one token, and a text without words is like no other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import WORD, n_partitions, sliced, staged
from .components import components
from .rolling import mixed

LIMIT, SIDE, BLOCK, DEPTH, SKETCH, CACHE = 512, 8192, 512, 8, 256, 100_000
#: Tokens that two sets at tau choose in common, on average, in a bucket.  Pairs less similar than tau / CHOICES meet in
#: ever fewer buckets below one, so a bucket whose average similarity is below WORTH, well under that, shrinks by splitting.
CHOICES, WORTH = 1.5, 0.3
#: Of chosen buckets to be split, so many at most are broadcast to the texts (some 20 MB); beyond that, texts are shuffled.
BROADCAST = 500_000
#: Bits of a sketch that tell whether a large bucket's sets are alike.
BITS = 32
#: Pairs count as candidates if their sketches' estimate is this far below tau: over five standard deviations.
SLACK = 0.2

_WORD = re.compile(WORD)
_FACTORS, _SHIFTS = (x.astype(np.uint32) for x in np.random.default_rng(0xC0DE).integers(0, 2**32, (2, SKETCH), dtype=np.uint64) | np.uint64(1))
_MULTIPLIERS = np.random.default_rng(0xC0FFEE).integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


class Words(dict):
    """word -> 64-bit hash, with a bounded memory."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Sets of 64-bit hashes of runs of n words."""

    def __init__(self, n: int):
        self.n, self.words = n, Words()

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text or "")
        if not words:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(words))
        total = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            total += hashes[k : k + len(total)] * _MULTIPLIERS[k]
        return np.unique(mixed(total))


def runs_for(recall: float) -> int:
    """Runs after which a pair at tau is missed with probability 1 - recall at most, though all its buckets split."""
    survival = 1.0
    for _ in range(DEPTH - 1):
        survival = 1 - math.exp(-CHOICES * survival)
    return math.ceil(-math.log(1 - recall) / (CHOICES * survival))


def chosen(tokens: np.ndarray, parents: np.ndarray, tau: float) -> np.ndarray:
    """The buckets below parents (64-bit) that a set chooses.

    A parent's hash function is linear over 32 bits: pairwise independent, which is all that the choice of paths asks for.
    """
    share = CHOICES / (tau * len(tokens))
    least = np.uint32(min(2**32 - 1, math.ceil(2**32 * share)))
    short, keys = tokens.astype(np.uint32), mixed(parents)
    factors, shifts = (keys >> np.uint64(32)).astype(np.uint32) | np.uint32(1), keys.astype(np.uint32)
    out, step = [np.zeros(0, np.uint64)], max(1, (1 << 18) // len(tokens))
    for start in range(0, len(parents), step):
        h = short * factors[start : start + step, None] + shifts[start : start + step, None]
        i, j = np.nonzero(h <= least)
        out.append(mixed(tokens[j] ^ mixed(parents[start + i] + np.uint64(1))))
    return np.concatenate(out)


def sketch(tokens: np.ndarray) -> bytes:
    """SKETCH bits: a bit of the least value under each of SKETCH hash functions."""
    least, short = np.full(SKETCH, 2**32 - 1, np.uint32), (tokens >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(tokens), 256):
        np.minimum(least, (short[start : start + 256, None] * _FACTORS + _SHIFTS).min(0), out=least)
    return np.packbits(((least ^ least >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(31)).astype(np.uint8)).tobytes()


def roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for the graph of pairs (k, 2) over range(n)."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        np.minimum.at(root, root[pairs[:, 0]], low)
        np.minimum.at(root, root[pairs[:, 1]], low)
        root = root[root]
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
    return root


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of rows with equal, adjacent ``key``; a table may hold many groups, but no part of one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(key)[-1].as_py()
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(keys == last)) if keys[0] != last else 0
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def signatures(rows: DataFrame, n: int, tau: float, runs: int) -> DataFrame:
    """rows (id, rec, text) -> id, rec, fp (hash of the set; null if empty), sketch, and the paths of the first level."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        seeds = mixed(np.arange(1, runs + 1, dtype=np.uint64))
        for batch in sliced(batches):
            fps, sketches, paths = [], [], []
            for text in batch.column(2).to_pylist():
                tokens = shingles(text)
                fps.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                sketches.append(sketch(tokens) if len(tokens) else None)
                paths.append(chosen(tokens, seeds, tau).astype(np.int64) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.binary()), pa.array(sketches, pa.binary()), pa.array(paths, pa.list_(pa.int64()))],
                ["id", "rec", "fp", "sketch", "paths"],
            )

    return rows.select("id", "rec", "text").mapInArrow(sign, "id long, rec long, fp binary, sketch binary, paths array<long>")


def chosen_again(rows: DataFrame, members: DataFrame, n: int, tau: float) -> DataFrame:
    """rec and path: the buckets that the sets of members (rec, path) choose below theirs."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        for batch in sliced(batches):
            paths = [
                chosen(shingles(text), np.array(parents, np.int64).astype(np.uint64), tau).astype(np.int64)
                for text, parents in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.list_(pa.int64()))], ["rec", "paths"])

    parents = members.groupBy("rec").agg(F.collect_list("path").alias("parents"))
    few = members.count() <= BROADCAST
    texts = rows.select("rec", "text").join(F.broadcast(parents) if few else parents.hint("shuffle_hash"), "rec")
    return texts.select("rec", "text", "parents").mapInArrow(choose, "rec long, paths array<long>").select("rec", F.explode("paths").alias("path"))


def alike(members: DataFrame, sketches: DataFrame, tau: float) -> DataFrame:
    """path and alike, for the buckets of members (path, rec): whether splitting is not worth while."""
    word = F.conv(F.hex(F.substring("sketch", 1, BITS // 8)), 16, 10).cast("long")
    bits = members.join(sketches.select("rec", word.alias("word")), "rec")
    shares = [F.avg(F.getbit("word", F.lit(i))) for i in range(BITS)]
    agree = sum((p * p + (1 - p) * (1 - p) for p in shares), F.lit(0.0)) / BITS
    return bits.groupBy("path").agg((2 * agree - 1 >= WORTH * tau / 0.8).alias("alike"))


def buckets(reps: DataFrame, rows: DataFrame, n: int, tau: float) -> DataFrame:
    """reps (rec, sketch, paths) -> path, rec, size: the buckets to be compared; rows: (rec, text)."""
    found, done = reps.select("rec", F.explode("paths").alias("path")), None
    for depth in range(1, DEPTH + 1):
        # written, so that the join has plain shuffles on both sides and Spark can split a hot bucket's
        counts = staged(found.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), "bucket-sizes")
        sized = staged(found.join(counts, "path"), "paths")
        small, large = sized.where(F.col("size") <= LIMIT), sized.where(F.col("size") > LIMIT)
        split = None
        if depth < DEPTH and counts.where(F.col("size") > LIMIT).take(1):
            judged = staged(alike(large, reps, tau), "alike")
            split = staged(large.join(judged.where("NOT alike"), "path", "left_semi"), "split")
            large = large.join(judged.where("alike"), "path", "left_semi")
        both = small.unionByName(large)
        done = both if done is None else done.unionByName(both)
        if split is None or not split.take(1):
            return done
        found = chosen_again(rows, split, n, tau)
    return done


def blocked(members: DataFrame, key: str, size: str, limit: int) -> DataFrame:
    """Rows of members dealt to tasks: groups up to limit as they are, larger ones once per pair of blocks.

    Adds ``task`` (a hash of group and block pair) and ``side`` (0, 1: compare across; null: compare all).
    """
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / limit)).cast("int")
    rows = members.withColumn("_n", n).withColumn("_own", F.pmod(F.xxhash64("rec", F.lit(3)), F.col("_n")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    side = F.when(F.col("_own") == F.col("_other"), None).otherwise(F.when(F.col("_own") < F.col("_other"), 0).otherwise(1))
    task = F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other"))
    return rows.withColumn("side", side.cast("int")).withColumn("task", task).drop("_n", "_own", "_other")


def _sketch_pairs(sketches: np.ndarray, side: np.ndarray, most: int) -> np.ndarray:
    """Pairs (k, 2) of rows whose sketches differ in ``most`` bits or fewer."""
    left = np.flatnonzero(side != 1)
    out = [np.zeros((0, 2), np.int64)]
    for start in range(0, len(left), 128):
        rows = left[start : start + 128]
        differ = np.zeros((len(rows), len(sketches)), np.uint16)
        for word in range(sketches.shape[1]):
            differ += np.bitwise_count(sketches[rows, word][:, None] ^ sketches[:, word])
        i, j = np.nonzero(differ <= most)
        i = rows[i]
        ok = np.where(side[i] == 0, side[j] == 1, i < j)
        out.append(np.stack([i[ok], j[ok]], 1))
    return np.concatenate(out)


def candidate_edges(members: DataFrame, tau: float) -> DataFrame:
    """members (path, rec, size, sketch) -> edges (a, b): per bucket a spanning forest of the pairs that look alike."""
    # bits of two sets differ with probability (1 - similarity) / 2
    most = int(SKETCH * (1 - max(0.0, tau - SLACK)) / 2)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "task"):
            task, rec = table["task"].to_numpy(), table["rec"].to_numpy()
            side = table["side"].fill_null(-1).to_numpy()
            sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(rec), -1)
            starts = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
            ends = np.append(starts[1:], len(task))
            twos = starts[ends - starts == 2]
            near = np.bitwise_count(sketches[twos] ^ sketches[twos + 1]).sum(1) <= most
            edges = [np.stack([rec[twos], rec[twos + 1]], 1)[near]]
            for s, e in zip(starts.tolist(), ends.tolist()):
                if e - s > 2:
                    root = roots(e - s, _sketch_pairs(sketches[s:e], side[s:e], most))
                    own = np.flatnonzero(root != np.arange(e - s))
                    edges.append(np.stack([rec[s + root[own]], rec[s + own]], 1))
            both = np.concatenate(edges)
            yield pa.RecordBatch.from_arrays([pa.array(both.min(1)), pa.array(both.max(1))], ["a", "b"])

    dealt = blocked(members, "path", "size", SIDE).select("task", "side", "rec", "sketch")
    dealt = dealt.repartition(n_partitions(members.sparkSession), "task").sortWithinPartitions("task")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def exact_links(sets: list[np.ndarray], side: np.ndarray, tau: float) -> np.ndarray:
    """Pairs (k, 2) of sets with Jaccard similarity tau or more; side as in blocked()."""
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        lo, hi = np.searchsorted(column, [start, start + 2048])
        part = np.zeros((len(sets), 2048), np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes - common
    i, j = np.nonzero(common >= tau * union - 1e-3)
    ok = np.where(side[i] == 0, side[j] == 1, (side[i] == -1) & (i < j)) & (common[i, j] >= np.ceil(tau * union[i, j] - 1e-6))
    return np.stack([i[ok], j[ok]], 1)


def link_counts(members: DataFrame, n: int, tau: float) -> DataFrame:
    """members (root, rec, size, copies, text) -> rec, root (of a spanning forest of the links), links (copies counted)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        for table in _grouped(batches, "task"):
            task, rec, copies = (table[c].to_numpy() for c in ("task", "rec", "copies"))
            side, text = table["side"].fill_null(-1).to_numpy(), table["text"]
            starts = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(task)]):
                pairs = exact_links([shingles(t) for t in text[s:e].to_pylist()], side[s:e], tau)
                links = np.zeros(e - s, np.int64)
                np.add.at(links, pairs[:, 0], copies[s:e][pairs[:, 1]])
                np.add.at(links, pairs[:, 1], copies[s:e][pairs[:, 0]])
                root = rec[s:e][roots(e - s, pairs)]
                yield pa.RecordBatch.from_arrays([pa.array(rec[s:e]), pa.array(root), pa.array(links)], ["rec", "root", "links"])

    dealt = blocked(members, "root", "size", BLOCK).select("task", "side", "rec", "copies", "text")
    dealt = dealt.repartition(n_partitions(members.sparkSession), "task").sortWithinPartitions("task")
    return dealt.mapInArrow(compare, "rec long, root long, links long")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with _near_rec, a number of its own for each row, and _near_tie, which orders rows of one id.

    The number is the id; where an id is null or repeats, the rows are written with numbers from Spark, so no hash can
    take two rows for one.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    if not ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").take(1):
        return docs.withColumns({"_near_rec": F.col(id_col).cast("long"), "_near_tie": F.lit("")})
    tie = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    return staged(docs.withColumns({"_near_rec": F.monotonically_increasing_id(), "_near_tie": tie}), "numbered")


def classes(docs: DataFrame, id_col: str, text_col: str, n: int, tau: float, recall: float) -> DataFrame:
    """docs of numbered() -> rec, id, tie, root (a number for each class), n_links."""
    runs = runs_for(recall)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col("_near_rec").alias("rec"))
    signed = staged(signatures(rows, n, tau, runs), "signatures")
    # one set per representative
    reps = signed.where("fp IS NOT NULL").groupBy("fp").agg(F.min("rec").alias("rep"), F.count("*").alias("copies"))
    of = signed.select("id", "rec", "fp").join(reps, "fp", "left")
    of = staged(of.select("id", "rec", F.coalesce("rep", "rec").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")), "copies")
    weights = of.where("rec = rep").select("rec", "copies")
    own = signed.where("fp IS NOT NULL").join(weights, "rec", "left_semi")
    own = staged(own.drop("id", "fp"), "sets")
    found = buckets(own, rows, n, tau)
    groups = components(candidate_edges(found.join(own.select("rec", "sketch"), "rec"), tau))
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    members = groups.withColumnRenamed("node", "rec").join(sizes, "root").join(weights, "rec")
    texts = rows.select("rec", "text").join(members.hint("shuffle_hash"), "rec")
    linked = staged(link_counts(texts, n, tau), "links")
    found = components(linked.select(F.col("rec").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rec")
    links = linked.groupBy("rec").agg(F.sum("links").alias("links")).join(found, "rec", "left")
    links = links.select(F.col("rec").alias("rep"), F.coalesce("root", "rec").alias("root"), "links")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    return of.join(links, "rep", "left").select("rec", "id", F.coalesce("root", "rep").alias("root"), n_links.alias("n_links"))


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, tau: float = 0.8, recall: float = 0.999999
) -> DataFrame:
    """One row per row of docs: id, class_id (the least id of its class), n_links (other rows at tau or more).

    A class is a connected component of the links; rows with equal sets are linked, so rows that repeat both id and text
    link each other.  Ids are numbers and may repeat or be null; a class whose ids are all null has a null class_id.
    Null, empty and blank texts have no link, and are classes of their own.
    """
    whole = classes(numbered(docs, id_col, text_col), id_col, text_col, n, tau, recall)
    least = whole.where("n_links > 0").groupBy("root").agg(F.min("id").alias("class_id"))
    linked_rows = whole.where("n_links > 0").join(least, "root").select("id", "class_id", "n_links")
    return linked_rows.unionByName(whole.where("n_links = 0").select("id", F.col("id").alias("class_id"), "n_links"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, tau: float = 0.8, recall: float = 0.999999
) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each class the row with the least id.

    A row goes by its own number, so other rows with its id stay.  Where several rows of a class have its least id, the
    one with the least SHA-256 of its text stays, and of rows that repeat both, one.  Null ids come after all others.
    """
    rows = numbered(docs, id_col, text_col)
    linked = classes(rows, id_col, text_col, n, tau, recall).where("n_links > 0").join(rows.select(F.col("_near_rec").alias("rec"), "_near_tie"), "rec")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "_near_tie", "rec")
    first = linked.groupBy("root").agg(F.min(place).alias("first"))
    gone = linked.join(first, "root").where(F.col("rec") != F.col("first.rec")).select(F.col("rec").alias("_near_rec"))
    return rows.join(gone, "_near_rec", "left_anti").select(*docs.columns)
