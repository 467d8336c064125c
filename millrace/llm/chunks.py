"""Whole documents in compressed chunks, and exchanges of small requests and replies between them.

A chunk is a row ``(chunk, size, blob)``: an id, its bytes of text and an Arrow stream of some whole documents.
An operator that needs facts about all documents sends packed requests from each chunk to numbered parts
(ranges of a hash), combines them there, and returns packed replies to the chunk. Texts move once for each
answer, facts as a few bytes a symbol, and no task holds more than one chunk or one part.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK_BYTES = 4 << 20
PART_BYTES = 32 << 20
REQUEST = "part int, chunk string, payload binary"
REPLY = "chunk string, part int, payload binary"
REQUEST_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.string()), ("payload", pa.binary())])
REPLY_ARROW = pa.schema([("chunk", pa.string()), ("part", pa.int32()), ("payload", pa.binary())])


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, written to the session's shared checkpoint folder. Where none is set: on one machine to a folder of our
    own; on a cluster that is an error, as executors don't see each other's disks."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="millrace-"))
    return df.checkpoint()


def own_columns(df: DataFrame, *fresh: str) -> Column:
    """All columns of a frame but those of the given names as one struct, ``own``, so that no name can clash."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in fresh)).alias("own")


def with_ids(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of documents, doc_id as long and text as string."""
    kinds = {"doc_id": "long", "text": "string"}
    return docs.select(*(F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in columns))


def slices(batch: pa.RecordBatch | pa.Table, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Consecutive whole rows with about ``most`` bytes of text at a time; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        stop = max(stop, at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def make_chunks(docs: DataFrame) -> DataFrame:
    """Documents (with doc_id, text and any other columns) as checkpointed chunks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch):
                sink = pa.BufferOutputStream()
                options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
                with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                    out.write(pa.Table.from_batches([rows]).combine_chunks())
                yield pa.RecordBatch.from_pydict(
                    {"chunk": [f"{task}-{n}"], "size": [rows.column("text").nbytes], "blob": [sink.getvalue().to_pybytes()]}
                )
                n += 1

    return checkpointed(docs.mapInArrow(pack, "chunk string, size long, blob binary"))


def part_count(chunks: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Parts for this much text: their number follows the data, so that one part stays small."""
    total = chunks.agg(F.sum("size")).first()[0] or 0
    return max(8, -(-int(total) // part_bytes))


class Texts:
    """The documents of a chunk: bytes of all texts end to end, with where each begins."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        self.table = table
        text = table.column("text")
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        text = pc.fill_null(text, "").cast(pa.large_binary())
        if len(text) == 0:
            self.bounds, self.data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
            return
        bounds = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.bounds, self.data = bounds - bounds[0], data[bounds[0] : bounds[-1]]

    @classmethod
    def of_blob(cls, blob: bytes) -> Texts:
        return cls(pa.ipc.open_stream(blob).read_all())

    def ids(self) -> np.ndarray:
        """doc_id as int64; a null one counts as the largest."""
        return pc.fill_null(self.table.column("doc_id"), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.bounds) - 1


def squeeze(*arrays: np.ndarray) -> bytes:
    """Integer arrays as compressed bytes; the bytes of equal weight stand together."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        body = a.view(np.uint8).reshape(a.size, a.itemsize).T.tobytes() if a.size else b""
        out.append(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") + body)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unsqueeze(payload: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    at, out = 0, []
    while at < len(raw):
        kind, n = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        body = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 12).reshape(kind.itemsize, n).T
        out.append(np.ascontiguousarray(body).view(kind).reshape(n))
        at += 12 + n * kind.itemsize
    return out


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def ask(chunks: DataFrame, request: Callable[[Texts], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Each chunk's requests, as (part, chunk, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                rows = [(part, chunk, payload) for part, payload in request(Texts.of_blob(blob.as_py()))]
                yield from rows_of(REQUEST_ARROW, rows).to_batches()

    return chunks.select("chunk", "blob").mapInArrow(run, REQUEST)


def grouped(requests: DataFrame, parts: int):
    """Requests by part, dealt to as many tasks: parts are small in bytes but not in work, so they aren't joined."""
    return requests.repartition(parts, "part").groupBy("part")


def combine(requests: DataFrame, parts: int, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """All requests of a part together; ``reply`` returns one payload for each, in their order."""

    def run(table: pa.Table) -> pa.Table:
        answers = reply([x.as_py() for x in table.column("payload")])
        return rows_of(
            REPLY_ARROW,
            list(zip(table.column("chunk").to_pylist(), table.column("part").to_pylist(), answers, strict=True)),
        )

    return grouped(requests, parts).applyInArrow(run, REPLY)


def answered(
    chunks: DataFrame, replies: DataFrame, use: Callable[[str, Texts, pa.Table], pa.Table], schema: str | StructType
) -> DataFrame:
    """Each chunk with all replies that it got (a table chunk, part, payload and whatever else the replies carry)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [
            use(chunk, Texts.of_blob(blob.as_py()), right)
            for chunk, blob in zip(left.column("chunk").to_pylist(), left.column("blob"), strict=True)
        ]
        return pa.concat_tables(out)

    return chunks.select("chunk", "blob").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def spread(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each part's keys begin and end, in sorted keys below 2**bits."""
    edges = [(i << bits) // parts for i in range(parts + 1)]
    return np.searchsorted(keys, np.array(edges[:-1], np.uint64)).tolist() + [len(keys)]
