"""Token ids as flat binary files that training jobs map into memory.

A folder holds shards in the order of documents, and ``manifest.json``:

* ``<shard>.bin``: ids of document after document, little-endian unsigned integers of the width that the vocabulary needs;
* ``<shard>.off``: n + 1 little-endian unsigned 64-bit offsets, where each document begins in the shard and the last ends;
* ``<shard>.ids``: the documents' own ids, an Arrow file of one column.

The manifest lists shards with their sizes and with bases, the ids and documents in all shards before, which are prefix sums;
so places in shards are written without knowledge of other shards.

Texts are sorted by range of their ids.  Each task encodes its range and writes shards of at most SHARD bytes, under names of its
own attempt; the rows that tell of shards are written by Spark's committer, so what a lost or repeated attempt left is in no
manifest.  Only these rows, one per shard, reach the driver.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import byte_bpe
from ._shared import n_partitions, sliced, staged

SHARD = 1 << 30


def width_of(path: str, end_id: int) -> str:
    """The least of 2 and 4 bytes that holds every id, as a NumPy type."""
    return "<u2" if max(len(byte_bpe.load(path).lengths) - 1, end_id) < 1 << 16 else "<u4"


class _Shard:
    """One shard while it is written."""

    def __init__(self, folder: str, name: str, id_type: pa.DataType):
        self.store, self.base = fs.FileSystem.from_uri(folder)
        self.name, self.id_type = name, id_type
        self.store.create_dir(self.base, recursive=True)
        self.out, self.size, self.offsets, self.ids = self.store.open_output_stream(f"{self.base}/{name}.bin"), 0, [0], []

    def add(self, ids: pa.Array, encoded: list[bytes], width: int) -> None:
        data = b"".join(encoded)
        ends = np.cumsum([len(e) for e in encoded]) // width + self.offsets[-1]
        self.out.write(data)
        self.size += len(data)
        self.offsets.extend(ends.tolist())
        self.ids.append(ids)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        with self.store.open_output_stream(f"{self.base}/{self.name}.off") as f:
            f.write(np.array(self.offsets, "<u8").tobytes())
        table = pa.table({"id": pa.chunked_array(self.ids, self.id_type)})
        with self.store.open_output_stream(f"{self.base}/{self.name}.ids") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)
        return self.name, len(self.offsets) - 1, self.offsets[-1]


def write(docs: DataFrame, path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD) -> dict:
    """Encode the whole texts of docs with the tokenizer file at path, end_id behind each, into a new folder (a URI that
    driver and executors share); returns the manifest.

    Documents stand in ascending order of id, null ids first, those of one id by a hash of the text.  A null text is empty: its
    end id alone.  Columns of docs other than the two aren't read.  An empty table gives a manifest without shards.
    """
    spark = docs.sparkSession
    if not 0 <= end_id < 1 << 32:
        raise ValueError("end_id must fit into 32 bits")
    kind = width_of(path, end_id)
    width, end = np.dtype(kind).itemsize, np.array([end_id], kind).tobytes()
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the last column parts equal rows, so that a range can end among them
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("nr"))
    by = ["id", "tie", "nr"]
    ordered = rows.repartitionByRange(n_partitions(spark), *by).sortWithinPartitions(*by).select("id", "text")
    id_type = to_arrow_type(rows.schema["id"].dataType)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, shard, told = byte_bpe.load(path), TaskContext.get().partitionId(), None, []
        for batch in batches:
            for piece in sliced([batch], size=min(4 << 20, shard_bytes)):
                if shard is None or shard.size >= shard_bytes:
                    if shard:
                        told.append((part, len(told), *shard.close()))
                    shard = _Shard(folder, f"{part:06d}-{len(told):04d}-{uuid.uuid4().hex[:12]}", id_type)
                shard.add(piece.column(0), [bpe.encode(t).astype(kind).tobytes() + end for t in piece.column(1).to_pylist()], width)
        if shard:
            told.append((part, len(told), *shard.close()))
        columns = list(zip(*told)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "seq", "name", "documents", "tokens"])

    shards = staged(ordered.mapInArrow(encode, "part int, seq int, name string, documents long, tokens long"), "token-shards")
    manifest: dict = {"dtype": kind, "end_id": end_id, "documents": 0, "tokens": 0, "shards": []}
    for s in shards.orderBy("part", "seq").collect():
        manifest["shards"].append({"name": s.name, "documents": s.documents, "tokens": s.tokens, "first_document": manifest["documents"], "first_token": manifest["tokens"]})
        manifest["documents"] += s.documents
        manifest["tokens"] += s.tokens
    manifest["id"] = rows.schema["id"].dataType.simpleString()
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _mapped(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: mapped into memory where the file system is local, else read."""
    if store.type_name == "local":
        return np.memmap(path, kind, "r") if store.get_file_info(path).size else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


class TokenFiles:
    """A folder of token files for one process: documents and stretches of ids by their places among all."""

    def __init__(self, folder: str):
        self.store, self.base = fs.FileSystem.from_uri(folder)
        with self.store.open_input_file(f"{self.base}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.shards = self.manifest["shards"]
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of a shard."""
        if k not in self._open:
            path = f"{self.base}/{self.shards[k]['name']}"
            self._open[k] = _mapped(self.store, f"{path}.bin", self.manifest["dtype"]), _mapped(self.store, f"{path}.off", "<u8")
        return self._open[k]

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, with the end id."""
        if not 0 <= i < self.manifest["documents"]:
            raise IndexError(i)
        k = bisect_right(self.shards, i, key=lambda s: s["first_document"]) - 1
        ids, offsets = self.shard(k)
        at = i - self.shards[k]["first_document"]
        return ids[int(offsets[at]) : int(offsets[at + 1])]

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids number start to stop of all, across shards."""
        start, stop = max(0, start), min(stop, self.manifest["tokens"])
        k, out = bisect_right(self.shards, start, key=lambda s: s["first_token"]) - 1, []
        while start < stop:
            first = self.shards[k]["first_token"]
            part = self.shard(k)[0][start - first : stop - first]
            out.append(part)
            start, k = start + len(part), k + 1
        return np.concatenate(out) if out else np.zeros(0, self.manifest["dtype"])


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """id, start (ids before the document), n_tokens (with the end id), ids_crc32 (of its ids as little-endian unsigned 32-bit
    integers) and, if asked for, token_ids of every document in a folder; a shard is one task's."""
    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    kind = manifest["dtype"]
    ddl = f"id {manifest['id']}, start long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * with_ids
    shards = [(s["name"], s["first_token"]) for s in manifest["shards"]]
    listed = spark.createDataFrame(shards, "name string, first long").repartition(max(1, len(shards)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns)):
                ids, offsets = (_mapped(store, f"{base}/{name}.{e}", k) for e, k in (("bin", kind), ("off", "<u8")))
                offsets, done = offsets.astype(np.int64), 0
                with store.open_input_file(f"{base}/{name}.ids") as f:
                    own = pa.ipc.open_file(f)
                    for k in range(own.num_record_batches):
                        column = own.get_batch(k).column(0)
                        at = offsets[done : done + len(column) + 1]
                        done += len(column)
                        sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                        out = [column, pa.array(at[:-1] + first), pa.array(np.diff(at)), pa.array(sums, pa.int64())]
                        if with_ids:
                            out.append(pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(ids[at[0] : at[-1]].astype(np.int64))))
                        yield pa.RecordBatch.from_arrays(out, ["id", "start", "n_tokens", "ids_crc32", "token_ids"][: len(out)])

    return listed.mapInArrow(look, ddl)
