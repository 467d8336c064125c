"""Operator 2: suffix-array deduplication by a distributed merge of front-coded sorted runs.

Only suffixes that start at anchors (places chosen by content, see ``symbols.minimizers``) and whose first
bytes occur in other documents too are sorted: each window of ``length`` bytes that occurs again holds such
an anchor. A chunk sorts its suffixes, with some bytes to their left, into one run for each part of the hash
range; runs travel front-coded. A part merges its runs with a loser tree that keeps, for each suffix, how
much of it is known to agree with the last one put out, and compares only what comes after. From the merged
order and its common prefixes follows, for each suffix and each offset, the least doc_id that has the window.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.llm.chunks import REQUEST, Texts, answered, combine, make_chunks, part_count, squeeze, unsqueeze, with_ids
from millrace.llm.repeats import Anchors, by_kind

#: Text for one part, and how many of its suffixes are merged at a time, as Python strings.
PART_BYTES, RANGE_ROWS = 6 << 20, 20_000
NO_ID = np.iinfo(np.int64).max


def front_coded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of bytes as what each shares with the one before, and the rest of all."""
    shared = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        shared[1:] = (rows[1:] != rows[:-1]).argmax(axis=1)
    return shared, rows[np.arange(rows.shape[1]) >= shared[:, None]]


def front_decoded(shared: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    own = np.arange(width) >= shared[:, None]
    rows = np.zeros(own.shape, np.uint8)
    rows[own] = rest
    source = np.maximum.accumulate(np.where(own, np.arange(len(rows))[:, None], 0), axis=0)
    return np.take_along_axis(rows, source, axis=0)


def merged(runs: list[list[bytes]], shared: list[list[int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Run of each string in the merged order, and what each shares with the one before.

    A loser tree. ``known[i]`` is what the head of run i shares with the last string that beat it, so of two
    heads the one that shares more is the less; only for equal counts are bytes compared, and from there on.
    """
    leaves = 1 << max(0, (len(runs) - 1).bit_length())
    at = [0] * leaves
    head = [r[0] if r else None for r in runs] + [None] * (leaves - len(runs))
    known = [0 if h is not None else -1 for h in head]
    losers = [-1] * leaves

    def beats(a: int, b: int) -> bool:
        """Whether the head of a goes first; sets what the loser shares with it."""
        if known[a] != known[b]:
            return known[a] > known[b]
        if known[a] < 0:
            return True
        x, y, n = head[a], head[b], known[a]
        different = int.from_bytes(x[n:], "big") ^ int.from_bytes(y[n:], "big")
        same = width - (different.bit_length() + 7) // 8
        if x[same:] <= y[same:]:
            known[b] = same
            return True
        known[a] = same
        return False

    winners = list(range(leaves))
    level = leaves
    tree = [-1] * leaves + winners
    for node in range(leaves - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    winner = tree[1] if level > 1 else 0
    order, common = [], []
    total = sum(map(len, runs))
    for _ in range(total):
        order.append(winner)
        common.append(known[winner])
        i = at[winner] = at[winner] + 1
        if i < len(runs[winner]):
            head[winner], known[winner] = runs[winner][i], shared[winner][i]
        else:
            head[winner], known[winner] = None, -1
        node = (winner + leaves) >> 1
        while node:
            other = losers[node]
            k, o = known[winner], known[other]
            if k < o or (k == o and not beats(winner, other)):
                losers[node], winner = winner, other
            node >>= 1
    return np.array(order, np.int64), np.array(common, np.int64)


class Suffixes:
    """Suffixes at anchors as rows of bytes: what follows, what stands before (nearest first), and how much is real."""

    def __init__(self, length: int):
        self.length, self.before = length, length - (length + 1) // 2
        self.width = length + self.before + 2
        if self.width > 255:
            raise ValueError("length: at most 168")

    def rows(self, data: np.ndarray, bounds: np.ndarray, places: np.ndarray) -> np.ndarray:
        doc = np.searchsorted(bounds, places, "right") - 1
        left = np.minimum(places - bounds[doc], self.before)
        right = np.minimum(bounds[doc + 1] - places, self.length)
        out = np.zeros((len(places), self.width), np.uint8)
        padded = np.concatenate([data, np.zeros(self.length, np.uint8)])
        steps = np.arange(self.length)
        out[:, : self.length] = padded[places[:, None] + steps] * (steps < right[:, None])
        steps = np.arange(self.before)
        back = np.maximum(places[:, None] - 1 - steps, 0)
        out[:, self.length : -2] = padded[back] * (steps < left[:, None])
        out[:, -2], out[:, -1] = left, right
        return out

    def distinct(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct rows in order, and which of them each row is."""
        flat = np.ascontiguousarray(rows).view(f"S{self.width}").ravel()
        _, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
        return rows[first], inverse

    def least_ids(self, rows: np.ndarray, common: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For each sorted row and offset o: the least id whose window from o bytes before its anchor is the same."""
        n = len(rows)
        out = np.full((self.before + 1, n), NO_ID, np.int64)
        left, right = rows[:, -2], rows[:, -1]
        before = np.ascontiguousarray(rows[:, self.length : -2])
        order = np.argsort(before.view(f"S{self.before}").ravel(), kind="stable")
        sorted_before = before[order]
        apart = sorted_before[1:] != sorted_before[:-1]
        same = np.where(apart.any(axis=1), apart.argmax(axis=1), self.before)
        for o in range(self.before + 1):
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], same < o]))
            follows = np.cumsum(np.concatenate([[0], common[1:] < self.length - o]))
            real = np.flatnonzero((left >= o) & (right >= self.length - o))
            if len(real):
                key = follows[real] * n + rank[real]
                by = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
                least = np.minimum.reduceat(ids[real][by], first)
                out[o, real[by]] = np.repeat(least, np.diff(np.append(first, len(by))))
        return out


def ranges(tables: list[np.ndarray], k: int) -> Iterator[list[tuple[int, int]]]:
    """Where sorted tables are cut so that about RANGE_ROWS of their rows are taken at a time, from all tables alike.
    Rows that share their first ``k`` bytes are never parted: no shorter agreement counts."""
    heads = [np.ascontiguousarray(t[:, :k]).view(f"S{k}").ravel() for t in tables]
    step = max(1, RANGE_ROWS // max(1, 4 * len(tables)))
    sample = np.sort(np.concatenate([h[::step] for h in heads]))
    pivots = np.unique(sample[:: max(1, RANGE_ROWS // step)])[1:]
    cuts = [[0, *np.searchsorted(h, pivots).tolist(), len(h)] for h in heads]
    for i in range(len(pivots) + 1):
        yield [(c[i], c[i + 1]) for c in cuts]


def merged_ids(tables: list[np.ndarray], ids: list[np.ndarray], suffixes: Suffixes) -> list[bytes]:
    """For each table of sorted rows: the least ids of its rows' windows by offset, over all tables, packed."""
    strings = [t.view(f"S{suffixes.width}").ravel().tolist() for t in tables]
    order, common = merged(strings, [front_coded(t)[0].tolist() for t in tables], suffixes.width)
    del strings
    at = np.argsort(order, kind="stable")  # rows of each run come in their own order
    rows = np.argsort(at)
    least = suffixes.least_ids(np.concatenate(tables)[rows], common, np.concatenate(ids)[rows])
    starts = np.cumsum([0, *map(len, tables)]).tolist()
    return [squeeze(np.diff(least[:, at[a:b]], axis=0, prepend=0).ravel()) for a, b in zip(starts, starts[1:], strict=False)]


def find_repeats(chunks: DataFrame, length: int) -> tuple[DataFrame, Anchors, Suffixes]:
    total = chunks.agg(F.sum("size")).first()[0] or 0
    anchors = Anchors(length, total, part_count(chunks, PART_BYTES), lambda t: (t.data, t.bounds), across=True)
    suffixes = Suffixes(length)
    bits = anchors.repeated(chunks)

    def runs(chunk: str, texts: Texts, replies: pa.Table) -> pa.Table:
        rows = []
        for part, sorted_rows, least, _, _ in sorted_runs(texts, by_kind(replies)[0], anchors, suffixes):
            shared, rest = front_coded(sorted_rows)
            rows.append((part, chunk, squeeze(shared, rest, least)))
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary())], ["part", "chunk", "payload"])

    def merge(payloads: list[bytes]) -> list[bytes]:
        tables, ids = [], []
        for p in payloads:
            shared, rest, least = unsqueeze(p)
            tables.append(front_decoded(shared, rest, suffixes.width))
            ids.append(least)
        replies: list[list[bytes]] = [[] for _ in payloads]
        for cuts in ranges(tables, anchors.k):
            within = [i for i, (lo, hi) in enumerate(cuts) if hi > lo]
            for i, reply in zip(within, merged_ids([tables[i][slice(*cuts[i])] for i in within], [ids[i][slice(*cuts[i])] for i in within], suffixes), strict=True):
                replies[i].append(reply)
        return [pickle.dumps(pieces) for pieces in replies]

    found = combine(answered(chunks, bits, runs, REQUEST), anchors.parts, merge).withColumn("kind", F.lit(1))
    return bits.unionByName(found), anchors, suffixes


def sorted_runs(texts: Texts, bits: dict[int, bytes], anchors: Anchors, suffixes: Suffixes) -> Iterator[tuple]:
    """For each part of a chunk: its distinct suffix rows in order, their least ids, the places, and their rows."""
    data, bounds, places, parts, _ = anchors.candidates(texts, bits)
    ids = texts.ids()
    order = np.argsort(parts, kind="stable")
    places, parts = places[order], parts[order]
    cuts = np.flatnonzero(np.diff(parts)) + 1
    for group in np.split(np.arange(len(places)), cuts) if len(places) else ():
        own = places[group]
        rows, inverse = suffixes.distinct(suffixes.rows(data, bounds, own))
        least = np.full(len(rows), NO_ID, np.int64)
        np.minimum.at(least, inverse, ids[np.searchsorted(bounds, own, "right") - 1])
        yield int(parts[group[0]]), rows, least, own, inverse


def covered_bytes(texts: Texts, replies: pa.Table, anchors: Anchors, suffixes: Suffixes) -> np.ndarray:
    """Which bytes of a chunk lie in a window that a document of a smaller id has too."""
    bits, found = by_kind(replies)
    ids, bounds = texts.ids(), texts.bounds
    starts = np.zeros(len(texts.data) + suffixes.length + 1, np.int32)
    for part, rows, _, places, inverse in sorted_runs(texts, bits, anchors, suffixes):
        pieces = [unsqueeze(piece)[0].reshape(suffixes.before + 1, -1) for piece in pickle.loads(found[part])]
        least = np.cumsum(np.concatenate(pieces, axis=1), axis=0)
        own = ids[np.searchsorted(bounds, places, "right") - 1]
        for o in range(suffixes.before + 1):
            starts[places[least[o][inverse] < own] - o] = 1
    ends = np.concatenate([np.zeros(suffixes.length, np.int32), starts[: -suffixes.length]])
    return (np.cumsum(starts - ends) > 0)[: len(texts.data)]


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept "


def suffix_dedup(docs: DataFrame, length: int = 50, as_text: bool = False) -> DataFrame:
    """Removes every byte covered by ``length`` bytes in a row that also start in a document of smaller id.

    Returns the documents' columns with n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and
    kept (the remaining bytes, which may begin or end inside a character; as_text: as a string, without bytes that are no
    whole character); columns of these names in the input are replaced. Null text counts as empty; a null doc_id is above all others; rows of one doc_id never
    remove each other's bytes, whether equal or not; an empty table gives an empty one. Windows never cross
    documents and are judged on the input.
    """
    fresh = StructType.fromDDL(RESULT + ("string" if as_text else "binary"))
    docs = docs.drop(*fresh.names)
    schema = StructType([*docs.schema.fields, *fresh.fields])
    typed = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    chunks = make_chunks(typed)
    replies, anchors, suffixes = find_repeats(chunks, length)
    arrow = to_arrow_schema(schema)

    def use(chunk: str, texts: Texts, found: pa.Table) -> pa.Table:
        gone = covered_bytes(texts, found, anchors, suffixes)
        rows = []
        for lo, hi in zip(texts.bounds.tolist(), texts.bounds[1:].tolist(), strict=False):
            cut = gone[lo:hi]
            spans = int(np.count_nonzero(cut[1:] & ~cut[:-1])) + int(hi > lo and cut[0])
            kept = texts.data[lo:hi][~cut].tobytes() if spans else texts.data[lo:hi].tobytes()
            rows.append((hi - lo, int(np.count_nonzero(cut)), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if as_text else kept))
        out = texts.table
        for name, column in zip(fresh.names, zip(*rows, strict=True) if rows else [[]] * 5, strict=True):
            out = out.append_column(name, pa.array(column))
        return out.cast(arrow)

    return answered(chunks, replies, use, schema)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = with_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return suffix_dedup(docs, 50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
