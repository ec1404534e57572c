"""BPE encoding and decoding with content-defined chunk reuse.

* Texts are cut where a rolling hash says so; equal passages of different documents give equal chunks.
* Chunks that occur more than once are encoded once, at one document that holds them, and their ids go to the others.
* Each document is put together from such ids and from its other stretches, encoded in place.  A join is repaired by
  encoding anew a window around it.  The window begins and ends at sure places, where every pre-tokenization parts
  whatever stands around, and takes in some text on both sides of the join; it is right when its first and last tokens
  agree with those that both sides have there, up to a further sure place.  Until then it widens.  Windows that grow into
  each other are encoded as one, so every byte is encoded twice at most, plus what windows double.

Sure places are those after a letter, digit or sign that no version of Unicode classes otherwise and before ASCII white
space or, after letters, another sign; a special token's text has none.  So texts without white space have them too.

Texts with other than ASCII white space are encoded whole.  Only hashes, the shared chunks' ids and each text once
(compressed) are shuffled.  Rows are keyed by 128 bits of hash of id and text, so null or repeated ids do no harm;
chunks by 128 bits too.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from ._shared import join_hot, sliced, staged
from .rolling import window_hashes

WINDOW, MASK, SHORTEST, LONGEST = 48, (1 << 10) - 1, 256, 8192

#: Fixed ranges of characters that every version of Unicode has as letters.
LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u0e01-\u0e30\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: Signs that every version has neither as letters nor as numbers; ' may begin a pre-token that ends in letters.
SIGN = "!-/:-@\\[-`{-~\u2010-\u2027\u3001-\u3003\u3008-\u3011\uff01\uff08-\uff0f\uff1a\uff1b\uff1f"
#: A sure place: a letter before it and a sign, digit or white space behind it; or a sign before white space.
SURE = re.compile(f"(?<=[{LETTER}])(?=[{SIGN}0-9 \t-\r])|(?<=[{SIGN}0-9])(?=[ \t-\r])")
#: Characters of text around a join in which sure places are sought at first.
NEAR = 64


def chunk_cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of a UTF-8 text, each at a character's start or the text's end."""
    array = np.frombuffer(data, np.uint8)
    hits = np.flatnonzero((window_hashes(array, WINDOW) & np.uint64(MASK)) == 0) + WINDOW
    cuts, start = [], 0
    for hit in [*hits.tolist(), len(data)]:
        while hit - start > LONGEST:
            start = _character(data, start + LONGEST)
            cuts.append(start)
        if hit - start >= SHORTEST or hit == len(data):
            end = _character(data, hit)
            if end > start:
                cuts.append(end)
                start = end
    return cuts


def _character(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _sure(data: bytes, lo: int, hi: int, banned: list[tuple[int, int]]) -> list[int]:
    """The sure places of data between lo and hi that no special token covers."""
    # some bytes around, so that a place at the edge sees its neighbours; a cut character there is no letter or sign
    base = max(0, lo - 4)
    text = data[base : hi + 4].decode("utf-8", "surrogateescape")
    ascii_only = len(text) == min(len(data), hi + 4) - base
    out, seen, at = [], 0, base
    for m in SURE.finditer(text):
        if ascii_only:
            at = base + m.start()
        else:
            at += len(text[seen : m.start()].encode("utf-8", "surrogateescape"))
            seen = m.start()
        if lo <= at <= hi and not any(a < at < b for a, b in banned):
            out.append(at)
    return out


class _Pieces:
    """Stretches of a text with ids of their own, and where their tokens end."""

    def __init__(self, bpe: byte_bpe.ByteBPE, spans: list[tuple[int, int]], ids: list[np.ndarray]):
        self.starts = [a for a, _ in spans]
        self.spans, self.ids = spans, ids
        self.ends = [a + np.cumsum(bpe.lengths[x]) for (a, _), x in zip(spans, ids)]

    def cut(self, lo: int, hi: int) -> list[np.ndarray] | None:
        """The ids of the bytes from lo to hi, piece by piece; None if one of the two isn't a token's edge."""
        out = []
        for k in range(bisect_right(self.starts, lo) - 1, len(self.spans)):
            start, end = self.spans[k]
            if start >= hi:
                break
            first, last = (int(np.searchsorted(self.ends[k], x)) + 1 if x > start else 0 for x in (lo, min(hi, end)))
            for x, n in ((max(lo, start), first), (min(hi, end), last)):
                if n and self.ends[k][n - 1] != x:
                    return None
            out.append(self.ids[k][first:last])
        return out


def encode_with(bpe: byte_bpe.ByteBPE, data: bytes, known: dict[tuple[int, int], np.ndarray], spent: list[int] | None = None) -> np.ndarray:
    """The ids of the text in data; known: ids of some of its stretches (start, end), each encoded by itself.

    spent, if given, gets the number of bytes encoded in each call of the encoder.
    """
    spent = [] if spent is None else spent

    def encoded(lo: int, hi: int) -> np.ndarray:
        spent.append(hi - lo)
        return bpe.encode(data[lo:hi].decode())

    spans, at = [], 0
    for start, end in sorted(known):
        if start >= at:
            spans += [(at, start)] * (start > at) + [(start, end)]
            at = end
    spans += [(at, len(data))] * (len(data) > at)
    if len(spans) < 2:
        return known[spans[0]] if spans and spans[0] in known else encoded(0, len(data))
    pieces = _Pieces(bpe, spans, [known[s] if s in known else encoded(*s) for s in spans])
    banned = [m.span() for m in bpe.special_bytes.finditer(data)]
    n = len(data)

    every: list[list[int]] = []

    def places(lo: int, hi: int) -> list[int]:
        # where sure places are rare, those of the whole text are found once
        if hi - lo <= 16 * NEAR:
            return _sure(data, lo, hi, banned)
        if not every:
            every.append(_sure(data, 0, n, banned))
        return every[0][bisect_left(every[0], lo) : bisect_right(every[0], hi)]

    def edges(candidates: Iterable[int]) -> list[int]:
        """The first two of candidates that are edges of the tokens there."""
        return list(islice((p for p in candidates if pieces.cut(p, p) is not None), 2))

    def window(join: int, reach: int) -> tuple[int, int, int, int]:
        """Outer and inner sure places on both sides of a join, those nearest at about reach bytes; else the text's ends."""
        left = right = None
        while left is None or right is None:
            if left is None:
                found = edges(reversed(places(max(0, join - reach), join - 1)))
                left = found[::-1] if len(found) > 1 else [0, 0] if join <= reach else None
            if right is None:
                found = edges(places(join + 1, min(n, join + reach)))
                right = found if len(found) > 1 else [n, n] if join + reach >= n else None
            reach *= 4
        return left[0], left[1], right[0], right[1]

    def wider(lo: int, hi: int, reach: int) -> tuple[int, int, int, int]:
        """The window from reach bytes before lo to reach bytes behind hi, at sure places."""
        left, right = edges(places(0, lo - reach)[::-1]) if lo > reach else [], edges(places(hi + reach, n)) if hi + reach < n else []
        left, right = left[::-1] if len(left) > 1 else [0, 0], right if len(right) > 1 else [n, n]
        return left[0], left[1], right[0], right[1]

    joins, todo = [a for a, _ in spans[1:]], []
    for join in joins:
        if not todo or join >= todo[-1][3]:
            todo.append([*window(join, NEAR), NEAR])
        elif todo[-1][3] < n:
            # the window before reaches over this join: one window for both
            todo[-1][2:4] = window(join, NEAR)[2:]
    repaired: list[tuple[int, int, np.ndarray]] = []
    k = 0
    while k < len(todo):
        lo, inner_lo, inner_hi, hi, reach = todo[k]
        if repaired and lo < repaired[-1][1]:
            # reaches into the window before: encode both as one
            before = repaired.pop()
            lo, inner_lo = before[0], before[0]
        while k + 1 < len(todo) and todo[k + 1][0] < hi:
            k += 1
            if todo[k][3] > hi:
                inner_hi, hi = todo[k][2:4]
        ids = encoded(lo, hi)
        front, back = pieces.cut(lo, inner_lo), pieces.cut(inner_hi, hi)
        ok = True
        for part, side in ((front, 0), (back, 1)):
            if part is None:
                ok = False
                continue
            want = np.concatenate([np.zeros(0, ids.dtype), *part])
            got = ids[: len(want)] if side == 0 else ids[len(ids) - len(want) :]
            ok &= len(got) == len(want) and bool((got == want).all())
        if ok or (lo == 0 and hi == n):
            repaired.append((lo, hi, ids))
            k += 1
        else:
            reach = 4 * max(reach, hi - lo)
            todo[k] = [*wider(lo, hi, reach), reach]
    out, at = [np.zeros(0, np.uint32)], 0
    for lo, hi, ids in repaired:
        out += [*pieces.cut(at, lo), ids] if at < lo else [ids]
        at = hi
    if at < n:
        out += pieces.cut(at, n)
    return np.concatenate(out)


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, schema)], schema=schema)


#: A row's key: two 64-bit hashes of id, carried columns and text.
KEY = ["r1", "r2"]


def shared_chunks(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """rows (r1, r2, text) -> every chunk (r1, r2, h1, h2, start, size), those that occur again (h1, h2, n, rep), and the number of all."""
    schema = pa.schema([(x, pa.int64()) for x in (*KEY, "h1", "h2")] + [("start", pa.int32()), ("size", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[list[int]] = [[] for _ in schema]
            for r1, r2, text in zip(*(c.to_pylist() for c in batch.columns)):
                if byte_bpe.OTHER_SPACE.search(text):
                    continue
                data, start = text.encode(), 0
                for end in chunk_cuts(data):
                    if end - start >= SHORTEST:
                        digest = xxhash.xxh3_128_digest(data[start:end])
                        for column, x in zip(out, (r1, r2, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), start, end - start)):
                            column.append(x)
                    start = end
            yield _batch(schema, *out)

    kinds = "r1 long, r2 long, h1 long, h2 long, start int, size int"
    chunks = staged(rows.where("text != ''").select(*KEY, "text").mapInArrow(cut, kinds), "bpe-chunks")
    again = chunks.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "start", "size")).alias("rep"))
    return chunks, staged(again.where("n > 1"), "bpe-shared"), chunks.count()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the columns named in carry, n_tokens, ids_sha256, decoded_sha256, token_ids.

    Ids are those of the tokenizers library for the byte-level BPE file at path, without added special tokens, and
    decoding is its decode with special tokens kept.  A null text is the empty text; an empty table gives no rows.
    """
    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

    kept = docs.select(F.struct(F.col(id_col).alias("id"), *[F.col(c) for c in carry]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = kept.withColumns({"r1": F.xxhash64("row", "text"), "r2": F.xxhash64(F.lit("second"), "text", "row")})
    chunks, shared, n_chunks = shared_chunks(rows)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for batch in sliced(batches):
            z = pa.array([pack(t.encode()) for t in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], z], ["row", *KEY, "z"])

    row_type = rows.schema["row"]
    keys = [StructField(k, LongType(), False) for k in KEY]
    packed = rows.select("row", *KEY, "text").mapInArrow(compress, StructType([row_type, *keys, StructField("z", BinaryType(), False)]))

    def encode_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, unpack = byte_bpe.load(path), zstandard.ZstdDecompressor().decompress
        for batch in sliced(batches):
            h1, h2, n, ids = [], [], [], []
            for z, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = unpack(z)
                for part in parts:
                    h1.append(part["h1"])
                    h2.append(part["h2"])
                    n.append(part["n"])
                    ids.append(bpe.encode(data[part["start"] : part["start"] + part["size"]].decode()).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (h1, h2, n)), pa.array(ids, pa.binary())], ["h1", "h2", "n", "ids"])

    wanted = shared.groupBy(*[F.col(f"rep.{k}").alias(k) for k in KEY]).agg(F.collect_list(F.struct("h1", "h2", "n", "rep.start", "rep.size")).alias("parts"))
    # row goes along unused, so that both joins read one and the same shuffle of packed
    encoded = packed.join(wanted.hint("shuffle_hash"), KEY).select("z", "parts", "row").mapInArrow(encode_shared, "h1 long, h2 long, n long, ids binary")
    # identical rows of docs share a key and encode the same chunk: one of them is enough
    encoded = encoded.groupBy("h1", "h2").agg(F.any_value("n").alias("n"), F.any_value("ids").alias("ids"))
    # a chunk has at most LONGEST bytes, so fewer than HOT chunks of ids are a few MB; both ways of the join read one shuffle
    reused = join_hot(chunks, encoded, ["h1", "h2"], "n", n_chunks).groupBy(*KEY).agg(F.collect_list(F.struct("start", "size", "ids")).alias("parts"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, unpack = byte_bpe.load(path), zstandard.ZstdDecompressor().decompress
        for batch in sliced(batches, size=1 << 20):
            n, sha, back, tokens = [], [], [], []
            for z, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = unpack(z)
                known = {(p["start"], p["start"] + p["size"]): np.frombuffer(p["ids"], "<u4") for p in parts or ()}
                ids = encode_with(bpe, data, known)
                n.append(len(ids))
                sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                tokens.append(ids.astype(np.int32))
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
            ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["row", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"],
            )

    out = StructType([
        row_type, StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()),
        StructField("token_ids", ArrayType(IntegerType())),
    ])
    whole = packed.join(reused.hint("shuffle_hash"), KEY, "left").select("row", "z", "parts").mapInArrow(assemble, out)
    return whole.select("row.*", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


def decode(tokens: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """tokens with a column text: its ids decoded, special tokens kept; null ids give a null text."""

    @F.pandas_udf("string")
    def text(ids):
        bpe = byte_bpe.load(path)
        return ids.map(lambda x: None if x is None else bpe.decode(np.asarray(x, np.int64)))

    return tokens.withColumn("text", text(F.col(ids_col)))
