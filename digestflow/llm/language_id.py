"""Language identification by prediction by partial matching.

One variable-order byte context tree per language: for each context of up to ORDER bytes, how often each byte followed.
A byte that its context has seen costs -log2(c / (t + d)) bits (c: its count, t: the context's total, d: its distinct
bytes); else the escape costs -log2(d / (t + d)) and the next shorter context decides; below the empty context a byte
costs 8 bits.  Statistics are frozen after training, so the cost of a byte depends on its ORDER predecessors alone, and
a text's code length under every language is a sum over table lookups, exact for the model (escapes without exclusion).

The training sample is bounded: TRAIN_BYTES of text per language, in expectation, drawn by a hash of the text; so is the
model, by MAX_LANGUAGES * TRAIN_BYTES entries.  Prediction reads whole texts and nothing but texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._shared import sliced

ORDER = 3
TRAIN_BYTES = 1_000_000
MAX_LANGUAGES = 400
UNDETERMINED = "und"
#: What stands before a text's first byte.
PAD = b"\n" * ORDER
PART = 1 << 18


def grams(data: np.ndarray) -> np.ndarray:
    """The ORDER + 1 bytes that end at each byte after the padding, as one number."""
    n = len(data) - ORDER
    out = np.zeros(n, np.uint32)
    for k in range(ORDER + 1):
        out = out << np.uint32(8) | data[k : k + n]
    return out


class Index:
    """Finds the place of 32-bit keys in an array, by open addressing; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint32(0))
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys)), self._hash(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of those that want the same slot, the last gets it
            lost = self.slots[at] != todo
            todo, at = todo[lost], at[lost] + 1 & (1 << self.bits) - 1

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._hash(keys)
        found = self.slots[at]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(wrong):
            at[wrong] = at[wrong] + 1 & (1 << self.bits) - 1
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[found[wrong]] != keys[wrong])]
        return found


@dataclass
class Model:
    """languages, and per order the costs of seen (context, byte) pairs and of escapes from seen contexts, in bits."""

    languages: list[str]
    pairs: list[tuple[Index, np.ndarray]]
    escapes: list[tuple[Index, np.ndarray]]

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        """counts: language -> (grams of ORDER + 1 bytes, how often)."""
        languages = sorted(counts)
        pairs, escapes = [], []
        for order in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (order + 1)) - 1)
            seen = []
            for language in languages:
                keys, back = np.unique(counts[language][0] & mask, return_inverse=True)
                n = np.bincount(back, counts[language][1])
                contexts, of = np.unique(keys >> np.uint32(8), return_inverse=True)
                total, distinct = np.bincount(of, n), np.bincount(of)
                seen.append((keys, np.log2(total + distinct)[of] - np.log2(n), contexts, np.log2(total + distinct) - np.log2(distinct)))
            keys, contexts = (np.unique(np.concatenate([x[k] for x in seen])) for k in (0, 2))
            leave = np.zeros((len(contexts) + 1, len(languages)), np.float32)
            for i, x in enumerate(seen):
                leave[np.searchsorted(contexts, x[2]), i] = x[3]
            escapes.append((Index(contexts), leave))
            cost = leave[np.searchsorted(contexts, keys >> np.uint32(8))]
            if order:
                below = np.uint32((1 << 8 * order) - 1)
                cost = cost + pairs[-1][1][pairs[-1][0].find(keys & below)]
            else:
                cost = cost + np.float32(8)
            for i, x in enumerate(seen):
                cost[np.searchsorted(keys, x[0]), i] = x[1]
            pairs.append((Index(keys), cost.astype(np.float32)))
        return cls(languages, pairs, escapes)

    def byte_costs(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte in each language."""
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        todo = np.arange(len(keys))
        for order in range(ORDER, -1, -1):
            index, cost = self.pairs[order]
            own = keys[todo] & np.uint32((1 << 8 * (order + 1)) - 1)
            at = index.find(own)
            out[todo] += np.where((at >= 0)[:, None], cost[at], 0)
            todo, own = todo[at < 0], own[at < 0]
            index, leave = self.escapes[order]
            out[todo] += leave[index.find(own >> np.uint32(8))]  # a context that nobody has seen finds the last row: 0
        out[todo] += 8
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language; long texts go in parts of PART bytes."""
        out = np.zeros((len(texts), len(self.languages)))
        group: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal group, size
            if group:
                data = np.frombuffer(b"".join(x for _, x in group), np.uint8)
                cost = self.byte_costs(grams(data))
                ends = np.cumsum([len(x) for _, x in group])
                for (i, x), end in zip(group, ends.tolist()):
                    # the last ORDER grams before a text's padding span two texts: they count for neither
                    out[i] += cost[end - len(x) : end - ORDER].sum(0, dtype=np.float64)
            group, size = [], 0

        for i, text in enumerate(texts):
            padded = PAD + text
            for start in range(0, len(text), PART):
                piece = padded[start : start + PART + ORDER]
                group.append((i, piece))
                size += len(piece)
                if size >= PART:
                    flush()
        flush()
        return out


def has_letter(text: str) -> bool:
    return bool(re.search("[A-Za-z]", text)) or any(map(str.isalpha, text))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the non-null languages of docs; None where no text has one.  Null and empty texts teach nothing."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text != ''")
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, TRAIN_BYTES / r.n))])
    drawn = (F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            by: dict[str, list[bytes]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text.encode())
            for lang, texts in by.items():
                found = [np.unique(grams(np.frombuffer(PAD + t, np.uint8)), return_counts=True) for t in texts]
                keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                n = np.bincount(back, np.concatenate([c for _, c in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = rows.where(drawn).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    by = {k: (g["gram"].to_numpy().astype(np.uint32), g["n"].to_numpy().astype(np.float64)) for k, g in counted.groupby("lang")}
    return Model.fit(by) if by else None


def predict(rows: DataFrame, model: Model | None) -> DataFrame:
    """rows (row, text) -> row, lang_pred, score.

    score is the share of the predicted language in 2**-(code length) over all of them.  ``und`` and 0 where the text is
    null or has no letter, or nothing was learned; ties go to the first language by name.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if model and t and has_letter(t)]
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if known:
                bits = model.code_lengths([texts[i].encode() for i in known])
                best = bits.argmin(1)
                weight = np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000))
                scores[known] = 1 / weight.sum(1)
                for i, b in zip(known, best.tolist()):
                    names[i] = model.languages[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores)], ["row", "lang_pred", "score"])

    out = StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.select("row", "text").mapInArrow(name, out)


def held_out(id_col: str) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score, learned from the documents that aren't held out."""
    model = train(docs.where(~held_out(id_col)), text_col, lang_col)
    rows = docs.select(F.struct(F.col(id_col).alias("id"), held_out(id_col).alias("held_out")).alias("row"), F.col(text_col).alias("text"))
    return predict(rows, model).select("row.*", "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns kept, whose language is told with a score of at least ``least``."""
    model = train(docs.where(~held_out(id_col)), text_col, lang_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    told = predict(rows, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return told.select("row.*")
