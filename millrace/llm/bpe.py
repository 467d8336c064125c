"""Operator 1: byte-level BPE encoding and decoding in padded numpy matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.chunks import slices, with_ids

NONE = np.int32(2**31 - 1)
TWO_SPACES = re.compile(r"\s\s")
#: Longest piece in a matrix; longer ones are merged with a heap.
WIDEST = 256
#: Words, and bytes of these, whose encoding a worker remembers; it forgets all when there are more.
REMEMBERED, REMEMBERED_BYTES = 200_000, 8 << 20


def cut_at_spaces(text: str) -> list[str]:
    first, *rest = text.split(" ")
    return [*([first] if first else []), *[" " + x for x in rest]]


class PairTable:
    """Ranks of pairs of tokens in an open-addressing hash table."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        slot, todo, self.probes = self._slots(keys), np.arange(len(keys)), 0
        while len(todo):
            free = self.keys[slot[todo]] < 0
            _, first = np.unique(slot[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], ranks[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE for pairs that no merge makes, or with a padding of -1."""
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], NONE)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        at = slot.ravel()[todo]
        for _ in range(self.probes):
            if not len(todo):
                break
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.keys[at]
            hit = there == keys.ravel()[todo]
            out.ravel()[todo[hit]] = self.ranks[at[hit]]
            more = ~hit & (there >= 0)
            todo, at = todo[more], at[more]
        return out


class BytePairs:
    """An encoder for a file of ranks and a pattern that splits texts into pieces."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.pattern = regex.compile(pattern)
        #: Words are cut at spaces and plain ones taken whole by what the usual pattern does.
        self.usual = pattern == public_tokenizers.PATTERN
        self.names = {rank: str(rank) for rank in self.ranks.values()}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("every byte needs a rank")
        pairs = [
            (self.ranks[token[:i]] << 32 | self.ranks[token[i:]], rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        self.pairs = PairTable(np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64))
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.known_pieces: dict[str, tuple[int, str, bytes]] = {}
        self.held = 0

    def encode_pieces(self, pieces: Sequence[bytes]) -> list[list[int]]:
        """Token ids of each piece."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = [rank]
            elif len(piece) > WIDEST:
                out[i] = self._encode_long(piece)
            else:
                buckets.setdefault(max(0, len(piece) - 1).bit_length(), []).append(i)
        for which in buckets.values():
            for at in range(0, len(which), 1 << 15):
                self._encode_bucket(pieces, which[at : at + (1 << 15)], out)
        return out

    def _encode_bucket(self, pieces: Sequence[bytes], which: list[int], out: list) -> None:
        """One matrix: a row for each piece, padded with -1. In each round every row merges its leftmost pair of
        least rank; rows without one leave."""
        lengths = np.array([len(pieces[i]) for i in which], np.int64)
        inside = np.arange(lengths.max()) < lengths[:, None]
        ids = np.full(inside.shape, -1, np.int32)
        ids[inside] = self.single[np.frombuffer(b"".join(pieces[i] for i in which), np.uint8)]
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        row_of = np.array(which)
        while len(row_of):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row_of), np.int64)
            rows = np.arange(len(row_of))
            least = ranks[rows, at] if ranks.shape[1] else np.full(len(row_of), NONE)
            if (done := least == NONE).any():
                for i, row, n in zip(row_of[done].tolist(), ids[done].tolist(), lengths[done].tolist(), strict=True):
                    out[i] = row[:n]
                keep = ~done
                width = int(lengths[keep].max(initial=1))
                ids, ranks, row_of = ids[keep, :width], ranks[keep, : width - 1], row_of[keep]
                lengths, at, least = lengths[keep], at[keep], least[keep]
                rows = rows[: len(row_of)]
                if not len(row_of):
                    return
            ids[rows, at] = least
            steps = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, steps + (steps > at[:, None]), axis=1)
            lengths = lengths - 1
            steps = steps[:-1]
            ranks = np.take_along_axis(ranks, steps + (steps > at[:, None]), axis=1)
            if ranks.shape[1]:
                before = np.maximum(at - 1, 0)
                new = self.pairs.find(ids[rows, before], ids[rows, before + 1])
                ranks[rows, before] = new
                after = np.minimum(at, ranks.shape[1] - 1)
                ranks[rows, after] = self.pairs.find(ids[rows, after], ids[rows, after + 1])

    def _encode_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece, in n log n: a heap of pairs over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = lambda i: self.ranks.get(self.bytes_of[ids[i]] + self.bytes_of[ids[after[i]]]) if after[i] < n else None
        heap = [(r, i) for i in range(n - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or pair(i) != rank:
                continue
            j = after[i]
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for p in (before[i], i):
                if p >= 0 and (r := pair(p)) is not None:
                    heapq.heappush(heap, (r, p))
        return [x for x in ids if x >= 0]

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def texts(self, texts: Sequence[str]) -> Iterator[tuple[int, str, bytes]]:
        """For each text: how many tokens, their ids joined by commas, and the bytes that these decode to.

        By the usual pattern, where no two white spaces meet, no piece reaches over a space but at its front, so texts are
        cut before each space and what follows is looked up; other texts are split as they are.
        """
        split = [cut_at_spaces(t) if self.usual and not TWO_SPACES.search(t) else self.pattern.findall(t) for t in texts]
        new = list(set().union(*split).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.known_pieces.clear()
            self.held = 0
            new = list(set().union(*split))
        self.held += sum(map(len, new))
        self._learn(new)
        for parts in split:
            counts, ids, raw = zip(*map(self.known.__getitem__, parts), strict=True) if parts else ((), (), ())
            yield sum(counts), ",".join(ids), b"".join(raw)

    def _learn(self, parts: list[str]) -> None:
        split = [self._pieces(p) for p in parts]
        if len(self.known_pieces) > REMEMBERED:
            self.known_pieces.clear()
        new = list(set().union(*split).difference(self.known_pieces))
        found = self.encode_pieces([p.encode() for p in new])
        names = self.names
        for piece, ids in zip(new, found, strict=True):
            self.known_pieces[piece] = (len(ids), ",".join([names[i] for i in ids]), self.decode(ids))
        known = self.known_pieces
        for part, own in zip(parts, split, strict=True):
            if len(own) == 1:
                self.known[part] = known[own[0]]
            else:
                counts, ids, raw = zip(*[known[p] for p in own], strict=True)
                self.known[part] = (sum(counts), ",".join(ids), b"".join(raw))

    def _pieces(self, part: str) -> list[str]:
        """The pieces of a word after a space; by the usual pattern plain words need no match."""
        if self.usual and part[0] == " " and part[1:].isalpha():
            return [part]
        if self.usual and part[0] == " " and part[-1] in ".," and part[1:-1].isalpha():
            return [part[:-1], part[-1]]
        return self.pattern.findall(part)


@lru_cache(maxsize=2)
def _encoder(rank_file: bytes, pattern: str) -> BytePairs:
    return BytePairs(rank_file, pattern)


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Most bytes of a rank file that goes to the executors with the code.
RANK_FILE_BYTES = 64 << 20


def rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        found = f.read(RANK_FILE_BYTES + 1)
    if len(found) > RANK_FILE_BYTES:
        raise ValueError(f"{path} has more than {RANK_FILE_BYTES} bytes")
    return found


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, token_ids: bool = True) -> DataFrame:
    """Encodes whole texts as tiktoken does without special tokens, and decodes the ids.

    Returns the documents' columns with n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256
    (of the decoded bytes) and, if token_ids, the ids as array<int>; columns of these names in the input are
    replaced. Null text counts as empty: no tokens. Rows are independent: repeated rows give equal results.
    """
    fresh = StructType.fromDDL(RESULT + (", token_ids array<int>" if token_ids else ""))
    docs = docs.drop(*fresh.names)
    schema = StructType([*docs.schema.fields, *fresh.fields])
    ranks = docs.sparkSession.sparkContext.broadcast(rank_file(ranks_path))
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = list(encoder.texts(texts))
                columns = [
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([sha(ids.encode()) for _, ids, _ in rows]),
                    pa.array([sha(raw) for _, _, raw in rows]),
                ]
                if token_ids:
                    ids = np.array(",".join(i for _, i, _ in rows if i).split(",") if any(n for n, _, _ in rows) else [], np.int32)
                    bounds = np.cumsum([0, *(n for n, _, _ in rows)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *fresh.names])

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def decode_tokens(tokens: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of token_ids. Null ids give null; an id without a token fails."""
    schema = StructType([*tokens.drop("decoded").schema.fields, *StructType.fromDDL("decoded binary").fields])
    ranks = tokens.sparkSession.sparkContext.broadcast(rank_file(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoder(ranks.value, pattern).decode
        for batch in batches:
            raw = [None if ids is None else decode(ids) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "decoded"])

    return tokens.drop("decoded").mapInArrow(run, schema)


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = with_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe(docs, path, token_ids=False).drop("text")
