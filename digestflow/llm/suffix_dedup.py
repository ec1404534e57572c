"""Removal of repeated byte strings, by deep-shallow suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts somewhere else.  Nobody sorts all suffixes at once:

1. Each window of LENGTH bytes has one anchor, its least K-gram by hash (the leftmost of equals).  Equal windows have
   equal anchors at equal offsets, so only suffixes of windows with the same anchor need be put in order, and anchors
   that occur once are done with.  About one byte in eighty is an anchor; only its hash, its place and a digest of its
   context (the bytes of all its windows) are shuffled.
2. A context that occurs twice repeats with all its windows; this settles the insides of copies, whatever their number,
   by counts that are summed up before they meet.
3. Anchors with a context of their own and another one beside it are the edges of copies.  Of each of their distinct
   contexts one is fetched, and they are sorted twice: rightwards from the anchor, and leftwards before it.  Multikey
   quicksort goes to a shallow depth; what still ties goes through a blind trie, which looks at branching bytes alone and
   then compares once.  The sorts give the longest common prefixes of neighbours, and with them, for every offset, which
   windows are equal.
4. An anchor with more than GROUP distinct contexts is not gathered at all: its windows are grouped by their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import HOT, join_hot, n_partitions, sliced, staged
from .jaccard_join import _grouped
from .rolling import sliding_min, window_hashes

LENGTH, K, GROUP, SHALLOW, PAIRS = 200, 40, 4096, 8, 48
PART = 1 << 20


def anchors(data: bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, place, and first and last window start, of each anchor of data; data is scanned in overlapping parts."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for base in range(0, max(1, len(data) - length + 1), PART):
        part = np.frombuffer(data, np.uint8)[base : base + PART + length - 1]
        if len(part) < length:
            break
        h = window_hashes(part, k)
        # the place in the low bits breaks ties to the left and comes out with the minimum
        place = np.uint64(0x3FFFFF)
        least = sliding_min(h & ~place | np.arange(len(h), dtype=np.uint64), length - k + 1) & place
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        at = least[first].astype(np.int64)
        for column, x in zip(out, (h[at].astype(np.int64), at + base, first + base, np.append(first[1:], len(least)) - 1 + base)):
            column.append(x)
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie_sort(items: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """Distinct strings in order.  A node is [depth, {byte: child}], a leaf an item; -1 is the end of a string."""
    root: list | tuple = items[0]
    for item in items[1:]:
        text, node = item[0], root
        # blind descent: look at branching bytes only
        while isinstance(node, list):
            byte = text[node[0]] if node[0] < len(text) else -1
            node = node[1].get(byte) or next(iter(node[1].values()))
        depth = common_prefix(text, node[0])
        other = node[0][depth] if depth < len(node[0]) else -1
        own = text[depth] if depth < len(text) else -1
        above, node, via = None, root, None
        while isinstance(node, list) and node[0] < depth:
            above, via = node, text[node[0]] if node[0] < len(text) else -1
            node = node[1][via]
        if isinstance(node, list) and node[0] == depth:
            node[1][own] = item
        else:
            split = [depth, {other: node, own: item}]
            if above is None:
                root = split
            else:
                above[1][via] = split
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out.append(node)
    return out


def deep_shallow_sort(strings: list[bytes], start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings and the longest common prefix of each with the one before it (0 for the first)."""
    groups: dict[bytes, list[int]] = {}
    for i, s in enumerate(strings):
        groups.setdefault(s, []).append(i)
    distinct = [(s, k) for k, s in enumerate(groups)]
    members = list(groups.values())
    done: list[tuple[bytes, int]] = []
    # multikey quicksort on the byte at ``depth``; an explicit stack, last part first
    stack = [(distinct, start)]
    while stack:
        part, depth = stack.pop()
        if len(part) < 2:
            done += part
        elif depth >= start + SHALLOW:
            done += blind_trie_sort(part)
        else:
            byte = lambda item, d=depth: item[0][d] if d < len(item[0]) else -1
            pivot = byte(part[len(part) // 2])
            less, same, more = [], [], []
            for item in part:
                b = byte(item)
                (less if b < pivot else same if b == pivot else more).append(item)
            stack += [(more, depth), (same, depth + 1), (less, depth)]
    order, lcp, before = [], [], None
    for s, k in done:
        for n, i in enumerate(members[k]):
            order.append(i)
            lcp.append(len(s) if n else 0 if before is None else common_prefix(s, before))
        before = s
    return np.array(order), np.array(lcp)


def repeated_offsets(lefts: list[bytes], rights: list[bytes], low: np.ndarray, high: np.ndarray, length: int, k: int = 0) -> np.ndarray:
    """For contexts around one anchor, whether the window that starts ``o`` bytes before it also stands in another.

    lefts: the bytes before the anchor, reversed; rights: from the anchor (of k bytes) on; windows: o from low to high.
    Returns (context, o) flags.
    """
    n, most = len(lefts), int(high.max())
    out = np.zeros((n, most + 1), bool)
    same = all(r[:k] == rights[0][:k] for r in rights)
    (r_order, r_lcp), (l_order, l_lcp) = deep_shallow_sort(rights, k if same else 0), deep_shallow_sort(lefts)
    if n <= PAIRS:
        # two contexts match as far as the least common prefix between their places in either order
        right, left = (_all_prefixes(o, p) for o, p in ((r_order, r_lcp), (l_order, l_lcp)))
        for i in range(n):
            for j in range(i):
                begin, end = max(length - right[i][j], low[i], low[j]), min(left[i][j], high[i], high[j])
                if begin <= end:
                    out[i, begin : end + 1] = out[j, begin : end + 1] = True
        return out
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(low.min()), most + 1):
        right[r_order] = np.cumsum(r_lcp < length - o)
        left[l_order] = np.cumsum(l_lcp < o)
        own = np.flatnonzero((low <= o) & (o <= high))
        _, back, times = np.unique(right[own] * (n + 1) + left[own], return_inverse=True, return_counts=True)
        out[own, o] = times[back] > 1
    return out


def _all_prefixes(order: np.ndarray, lcp: np.ndarray) -> list[list[int]]:
    """Common prefix of every two strings, from their order and the common prefixes of neighbours."""
    n, place, near = len(order), order.tolist(), lcp.tolist()
    out = [[0] * n for _ in range(n)]
    for i in range(n):
        least = 1 << 30
        for j in range(i + 1, n):
            least = min(least, near[j])
            out[place[i]][place[j]] = out[place[j]][place[i]] = least
    return out


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"))
    # whole numbers that are unique are keys themselves, in few bytes
    if dict(rows.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint") and not rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").take(1):
        return rows.withColumn("rk", F.col("id").cast("long"))
    # 128 bits: no two different rows of any table share a key
    halves = [F.xxhash64("id", "bytes"), F.xxhash64(F.lit("second"), "bytes", "id")]
    return rows.withColumn("rk", F.concat(*[F.unhex(F.lpad(F.hex(h), 16, "0")) for h in halves]))


def repeated_runs(rows: DataFrame, length: int, k: int) -> DataFrame:
    """rows (id, rk, bytes) -> rk, first, last: runs of window starts whose windows stand elsewhere too."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)["rk"]
    key_type = pa.int64() if kind == "bigint" else pa.binary()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            digests: list[bytes] = []
            keys: list = []
            for rk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, at, first, last = anchors(data, length, k)
                high, low = at - first, at - last
                digests += [xxhash.xxh3_128_digest(data[b : e + length], x << 16 | y) for b, e, x, y in zip(first.tolist(), last.tolist(), high.tolist(), low.tolist())]
                keys += [rk] * len(h)
                for column, x in zip(cols, (h, at, high, low)):
                    column.append(x)
            h, *places = (pa.array(np.concatenate(c).astype(t)) for c, t in zip(cols, (np.int64, np.int32, np.int16, np.int16)))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([h, pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(keys, key_type), *places], ["h", "d1", "d2", "rk", "at", "high", "low"])

    found = rows.where(F.length("bytes") >= length).select("rk", "bytes").mapInArrow(find, f"h long, d1 long, d2 long, rk {kind}, at int, high short, low short")
    again = staged(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "again")
    n_found = again.agg(F.sum("n")).first()[0] or 0
    # hot anchors, fewer than HOT, are known without a join: their rows get keys that part them
    hot = F.broadcast(again.where(F.col("n") > n_found / HOT).select("h", F.lit(True).alias("hot")))
    marked = found.join(hot, "h", "left").withColumn("k", F.when(F.col("hot"), F.xxhash64("rk", "at")).otherwise(F.col("h")))
    marked = marked.join(again.select(F.col("h").alias("k"), F.lit(True).alias("more")), "k", "left").where("hot OR more")
    places = staged(marked.drop("k", "hot", "more"), "anchors")
    contexts = places.groupBy("h", "d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("rk", "at", "high", "low")).alias("rep"))
    contexts = staged(contexts, "contexts")
    repeated = join_hot(places, contexts.where("n > 1").select("h", "d1", "d2", "n"), ["h", "d1", "d2"], "n", n_found)
    repeated = repeated.select("rk", (F.col("at") - F.col("high")).alias("first"), (F.col("at") - F.col("low")).alias("last"))
    edges = contexts.groupBy("h").agg(F.count("*").alias("contexts"), F.count_if(F.col("n") == 1).alias("own")).where("contexts > 1 AND own > 0")
    edges = staged(edges, "edges")
    edges = join_hot(contexts.select("h", "n", "rep.*"), edges.select("h", "contexts"), ["h"], "contexts", n_found)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("h", "n", "at", "high", "low")
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), key_type, pa.binary())
        for batch in sliced(batches):
            out: list[list] = [[] for _ in types]
            for rk, data, places in zip(*(batch.column(c).to_pylist() for c in ("rk", "bytes", "places"))):
                for p in places:
                    for column, x in zip(out, (*(p[x] for x in names), rk, data[p["at"] - p["high"] : p["at"] - p["low"] + length])):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [*names, "rk", "context"])

    def strings(wanted: DataFrame) -> DataFrame:
        wanted = wanted.groupBy("rk").agg(F.collect_list(F.struct("h", "n", "at", "high", "low")).alias("places"))
        # id goes along unused, so that these joins and the final one read one and the same shuffle of the texts
        texts = rows.join(wanted.hint("shuffle_hash"), "rk").select("id", "rk", "bytes", "places")
        return texts.mapInArrow(fetch, f"h long, n long, at int, high short, low short, rk {kind}, context binary")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "h"):
            h, n, at = (table[c].to_numpy() for c in ("h", "n", "at"))
            rk = table["rk"].to_pylist()
            high, low = (table[c].to_numpy().astype(np.int64) for c in ("high", "low"))
            context = table["context"].to_pylist()
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            out: list[list[int]] = [[], [], []]
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(h)]):
                lefts = [context[i][: high[i]][::-1] for i in range(s, e)]
                rights = [context[i][high[i] :] for i in range(s, e)]
                flags = repeated_offsets(lefts, rights, low[s:e], high[s:e], length, k)
                for i in range(s, e):
                    if n[i] == 1 and flags[i - s].any():
                        on = np.flatnonzero(np.diff(np.concatenate([[0], flags[i - s].astype(np.int8), [0]])))
                        for a, b in zip(on[::2].tolist(), on[1::2].tolist()):
                            for column, x in zip(out, (rk[i], int(at[i]) - b + 1, int(at[i]) - a)):
                                column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (key_type, pa.int32(), pa.int32()))], ["rk", "first", "last"])

    usual = strings(edges.where(F.col("contexts") <= GROUP)).repartition(n_partitions(spark), "h").sortWithinPartitions("h")
    usual = usual.mapInArrow(decide, f"rk {kind}, first int, last int")
    # crowded anchors: one row per window, by digest
    each = strings(edges.where(F.col("contexts") > GROUP)).withColumn("o", F.explode(F.sequence(F.col("low").cast("int"), F.col("high").cast("int"))))
    each = each.withColumn("window", F.unhex(F.sha2(F.substring("context", F.col("high") - F.col("o") + 1, F.lit(length)), 256)))
    many = each.groupBy("h", "o", "window").agg(F.count("*").alias("times")).where("times > 1").drop("times")
    start = F.col("at") - F.col("o")
    crowded = each.where("n = 1").join(many, ["h", "o", "window"]).select("rk", start.alias("first"), start.alias("last"))
    return repeated.unionByName(usual).unionByName(crowded)


def covered(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under windows that start at first..last."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end), kept (binary).

    Texts are UTF-8 bytes; a null text is empty.  Rows are told apart by their ids, or, where these repeat or are null, by 128 bits of hash of id and text; where both repeat, the
    rows are copies of each other and lose every byte if they have ``length`` bytes or more.
    """
    rows = _documents(docs, id_col, text_col)
    runs = repeated_runs(rows, length, k).groupBy("rk").agg(F.collect_set(F.struct("first", "last")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            removed, spans, sha, kept = [], [], [], []
            for data, runs in zip(batch.column("bytes").to_pylist(), batch.column("runs").to_pylist()):
                own = covered([(r["first"], r["last"]) for r in runs or ()], length)
                at, parts = 0, []
                for a, b in own:
                    parts.append(data[at:a])
                    at = b
                kept.append(b"".join([*parts, data[at:]]))
                removed.append(len(data) - len(kept[-1]))
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
                spans.append([{"start": a, "end": b} for a, b in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(map(len, batch.column("bytes").to_pylist()), pa.int64()), pa.array(removed, pa.int64()), pa.array(map(len, spans), pa.int64()),
                 pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
            )

    whole = rows.join(runs.hint("shuffle_hash"), "rk", "left").select("id", "rk", "bytes", "runs")
    kind = dict(rows.dtypes)["id"]
    return whole.mapInArrow(
        cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start int, end int>>, kept binary"
    )
