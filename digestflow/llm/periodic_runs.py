"""Runs of repeated words within a document, by seeds extended along diagonals.

A run is a stretch of consecutive words with smallest period q and at least max(SHORTEST, 2q) words that no neighbouring
word extends.  On the diagonal of lag q (places i and i + q) it is a stretch of at least max(SHORTEST - q, q) equal words,
so six at least with SHORTEST = 12.  Seeds are indexed at sizes 6, 12, 24, ...; lags from a size up to its double use that
size, which such a stretch holds whole.

* Grams get exact numbers, a size from pairs of the size before; grams that occur once in their document have none and
  take no part in larger sizes.
* Occurrences of a gram at most half its size apart lie at its own period and form a chain.  Of two places in chains, the
  pair one period to the left has the same lag and touches, so only pairs with the first place of a chain are listed, and
  none within a chain but its first step: at most a constant number for each word and size, also where one word is repeated
  a million times.
* Along each lag a table of the furthest covered place drops seeds that an earlier one reaches.  The others are extended
  to both sides by the numbered grams, largest size first.

A document is the unit of work: nothing is shuffled, and memory and time are about linear in its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import sliced

SHORTEST, SEED = 12, 6
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class _Words(dict):
    """word -> number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _numbered(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For each of n places (and one beyond) the number of its key, or -1 where no other place has it."""
    out = np.full(n + 1, -1, np.int64)
    if len(keys):
        number, distinct = pd.factorize(keys)
        again = np.bincount(number, minlength=len(distinct))[number] > 1
        out[at[again]] = number[again]
    return out


def _joined(grams: np.ndarray, step: int, size: int, ends: np.ndarray) -> np.ndarray:
    """Numbers of the grams of ``size`` words, each of two that lie ``step`` apart."""
    n = len(grams) - 1
    at = np.flatnonzero(grams[: max(0, n - step)] >= 0)
    at = at[(grams[at + step] >= 0) & (at + size <= ends[at])]
    return _numbered(grams[at] * (n + 1) + grams[at + step], at, n)


def _ranges(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, i) for every i in [first[k], stop[k])."""
    n = np.maximum(stop - first, 0)
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[k]


def _seeds(grams: np.ndarray, size: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i and lags q (least <= q < most) of pairs of equal grams, each run's leftmost pairs among them; by lag, then place."""
    place = np.flatnonzero(grams >= 0)
    place = place[np.argsort(grams[place], kind="stable")]
    wide = 4 * len(grams) + 2 * most
    key = grams[place] * wide + place
    head = np.append(True, np.diff(key) > size // 2)[: len(key)]
    heads = np.flatnonzero(head)
    chain_end = np.append(heads[1:], len(key))
    # the first step of a chain, pairs from its first place on, and pairs that end there
    step = heads[chain_end - heads > 1]
    left, right = [step], [step + 1]
    k, j = _ranges(np.maximum(np.searchsorted(key, key[heads] + least), chain_end), np.searchsorted(key, key[heads] + most))
    left, right = [*left, heads[k]], [*right, j]
    k, i = _ranges(np.searchsorted(key, key[heads] - most, "right"), np.minimum(np.searchsorted(key, key[heads] - least, "right"), heads))
    left, right = np.concatenate([*left, i]), np.concatenate([*right, heads[k]])
    lag = place[right] - place[left]
    ok = (lag >= least) & (lag < most)
    pair = np.unique(lag[ok] * wide + place[left[ok]])
    return pair % wide, pair // wide


def runs_of(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents of ``lengths`` words each, one after another -> document, start (in it), length, period of every run, in that order."""
    n, doc = len(words), np.repeat(np.arange(len(lengths)), lengths)
    stops = np.cumsum(lengths)
    ends, begins = stops[doc], (stops - lengths)[doc]
    words = np.append(words, -1)
    kinds = int(words.max(initial=0)) + 1
    at = np.flatnonzero(np.arange(n) + 2 <= ends)
    pairs = _numbered((doc[at] * kinds + words[at]) * kinds + words[at + 1], at, n)
    triples = _joined(pairs, 1, 3, ends)
    grams = {SEED: _joined(triples, 3, SEED, ends)}
    size, longest = SEED, int(lengths.max(initial=0))
    while 4 * size <= longest and (grams[size] >= 0).any():
        grams[2 * size] = _joined(grams[size], size, 2 * size, ends)
        size *= 2
    tables = [*sorted(grams.items(), reverse=True), (3, triples), (2, pairs)]

    def reach(x: np.ndarray, lag: np.ndarray, way: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How far from x on (way 1), or up to x (way -1), words equal those ``lag`` further, in documents from begin to end."""
        x = x.copy()
        for k, (size, table) in enumerate(tables):
            live = np.arange(len(x))
            while len(live):
                y = x[live] if way > 0 else x[live] - size
                live, y = live[(y >= 0) & (y + lag[live] <= n)], y[(y >= 0) & (y + lag[live] <= n)]
                same = (table[y] >= 0) & (table[y] == table[y + lag[live]])
                live = live[same]
                x[live] += way * size
                live = live[:0] if k else live
        for _ in range(2):
            y = x if way > 0 else x - 1
            inside = (y >= begin) & (y + lag < end)
            y = np.where(inside, y, 0)
            x = x + way * (inside & (words[y] == words[np.where(inside, y + lag, n)]))
        return x

    found = []
    for size, table in grams.items():
        i, lag = _seeds(table[:n], size, 1 if size == SEED else size, 2 * size)
        if not len(i):
            continue
        # the furthest covered place of each lag: seeds on it are not extended again
        fresh = np.append(True, (lag[1:] != lag[:-1]) | (doc[i[1:]] != doc[i[:-1]]) | (i[1:] - i[:-1] > size))
        i, lag = i[fresh], lag[fresh]
        begin, end = begins[i], ends[i]
        left, right = reach(i, lag, -1, begin, end), reach(i + size, lag, 1, begin, end)
        length = right - left + lag
        keep = length >= np.maximum(SHORTEST, 2 * lag)
        found.append(np.stack([left[keep], length[keep], lag[keep]]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # a stretch that is found at several lags has the least of them as its period
    first = np.append(True, (np.diff(start) != 0) | (np.diff(length) != 0))[: len(start)]
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    return doc[start], start - begins[start], length, period


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, runs (start, length, period; by start, then period) and collapsed, the text
    with only the first period of each run, its words joined by one space.

    Words are runs of other than ASCII white space.  A null text has no words; its collapsed text is empty.  Ids may repeat
    or be null; columns of docs other than the two aren't read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            texts = [(t or b"").split() for t in batch.column(1).to_pylist()]  # bytes are split at ASCII white space
            lengths, number = np.array([len(t) for t in texts], np.int64), _Words()
            words = np.fromiter((number[w] for t in texts for w in t), np.int64, int(lengths.sum()))
            doc, start, length, period = runs_of(words, lengths)
            begins = np.cumsum(lengths) - lengths
            # words from a run's first period on are dropped
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, begins[doc] + start + period, 1)
            np.add.at(cover, begins[doc] + start + length, -1)
            dropped = np.cumsum(cover) > 0
            for d in np.unique(doc).tolist():
                b = int(begins[d])
                texts[d] = [w for w, gone in zip(texts[d], dropped[b : b + len(texts[d])].tolist()) if not gone]
            offsets = np.append(0, np.cumsum(np.bincount(doc, minlength=len(texts)))).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets), runs), pa.array([b" ".join(t) for t in texts], pa.binary()).cast(pa.string())],
                ["id", "n_words", "runs", "collapsed"],
            )

    return rows.mapInArrow(look, f"id {dict(rows.dtypes)['id']}, n_words long, runs {RUNS}, collapsed string")
