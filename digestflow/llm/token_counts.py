"""Token counts by a map-side two-tier lookup.

A text is cut into units: white space with the run of other characters after it.  Such a cut always parts two
pre-tokens, so a text's count is the sum over its units, and no pre-token is ever shuffled.

* Tier 1: a broadcast table of the most frequent units' token counts.  Each task counts the units of its whole
  partition and hands on its TASK_TOP most frequent; their sums over all tasks give the TABLE most frequent, each of at
  most UNIT_CHARS characters: a proven bound of a few MB.
* Tier 2: each worker encodes the units it misses and keeps their counts in a cache of at most CACHE units.

The table only saves work: any table gives the same counts.  Texts with other than ASCII white space, and files that
are not byte-level BPE (the cut would not be exact for them), are encoded whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from ._shared import sliced

TABLE, TASK_TOP, UNIT_CHARS, CACHE, COUNTED = 65_536, 2_048, 24, 400_000, 200_000

UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


@lru_cache(maxsize=2)
def whole_counter(path: str):
    """text -> number of tokens, by the library for the file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    try:
        return byte_bpe.load(path).count
    except ValueError:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def by_units(path: str) -> bool:
    if path.endswith(".model"):
        return False
    try:
        byte_bpe.load(path)
    except ValueError:
        return False
    return True


def frequent_units(docs: DataFrame, text_col: str) -> DataFrame:
    """The TABLE most frequent units of all texts: unit, n."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                seen.update(UNIT.findall(text or ""))
                if len(seen) > COUNTED:  # keeps the heavy ones; only the lookup's hit rate depends on it
                    seen = Counter(dict(seen.most_common(COUNTED // 4)))
        best = [(u, n) for u, n in seen.most_common(2 * TASK_TOP) if len(u) <= UNIT_CHARS][:TASK_TOP]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["unit", "n"])

    found = docs.select(text_col).mapInArrow(top, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return found.orderBy(F.desc("n"), "unit").limit(TABLE)


class Lookup(dict):
    """Tier 1, falling back to the worker's cache and, beyond it, to the encoder."""

    def __init__(self, table: dict[str, int], count):
        super().__init__(table)
        self.count, self.cache = count, {}

    def __missing__(self, unit: str) -> int:
        n = self.cache.get(unit)
        if n is None:
            n = self.count(unit)
            if len(self.cache) >= CACHE:
                self.cache.clear()
            if len(unit) <= 256:
                self.cache[unit] = n
        return n


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens of the whole text by the library for the file at path.

    A null text has 0 bytes and 0 tokens.  Ids may repeat or be null; columns of docs other than the two aren't read.
    """
    spark, split = docs.sparkSession, by_units(path)
    table = None
    if split:
        count = byte_bpe.load(path).count
        rows = frequent_units(docs, text_col).collect()
        table = spark.sparkContext.broadcast({r.unit: count(r.unit) for r in rows})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = whole_counter(path)
        lookup = Lookup(table.value, whole) if split else None
        for batch in sliced(batches):
            n = []
            for text in batch.column(1).to_pylist():
                if not text:
                    n.append(0)
                elif lookup is None or byte_bpe.OTHER_SPACE.search(text):
                    n.append(whole(text))
                else:
                    n.append(sum(map(lookup.__getitem__, UNIT.findall(text))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
    )
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long")
