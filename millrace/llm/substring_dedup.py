"""Operator 7: removal of passages of words that occur elsewhere, by suffix automata of reference shards.

Documents are cut into runs of windows with a common anchor (words chosen by content, see ``symbols.window_runs``); each
window is in one run. A shard is a bounded set of the passages of runs whose anchor occurs more than once, and has an
automaton over their words. Passages go only to the shard that can hold their copies, by the hash of the anchor, and
stream through its automaton there for their matching statistics: to send every automaton to every document would cost
the square of the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.llm.automaton import SuffixAutomaton
from millrace.llm.chunks import (
    REQUEST,
    REQUEST_ARROW,
    Texts,
    answered,
    combine,
    make_chunks,
    part_count,
    rows_of,
    squeeze,
    unsqueeze,
    with_ids,
)
from millrace.llm.repeats import Anchors, by_kind
from millrace.llm.symbols import mix, window_runs, word_hashes, words_of

#: Words of reference passages in one automaton, about.
SHARD_WORDS = 20_000
#: Text for one part: its distinct passages are held as bytes.
PART_BYTES = 8 << 20
_WEIGHTS = np.random.default_rng(7).integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)


def word_symbols(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = words_of(texts.data, texts.bounds)
    return word_hashes(texts.data, starts, ends), bounds


def distinct_passages(symbols: np.ndarray, runs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of windows (first word, windows): one of each distinct passage of words, and which passage each has."""
    first, words = runs[:, 0], runs[:, 1] + length - 1
    steps = np.arange(int(words.max(initial=0)))
    at = np.minimum(first[:, None] + steps, max(0, len(symbols) - 1))
    keys = mix((symbols[at] * (steps < words[:, None]) * _WEIGHTS[: len(steps)]).sum(axis=1, dtype=np.uint64) + words.astype(np.uint64) * _WEIGHTS[-1])
    _, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return index, inverse


def chosen_passages(texts: Texts, bits: dict[int, bytes], anchors: Anchors, length: int):
    """For each part of a chunk: runs of windows, the hashes of their anchors, one of each distinct passage, and which."""
    symbols, _, runs, parts, hashes = anchors.candidates(texts, bits)
    order = np.argsort(parts, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1) if len(order) else ():
        yield int(parts[group[0]]), runs[group], hashes[group], *distinct_passages(symbols, runs[group], length)


def repeated_windows(passages: list[bytes], times: list[int], hashes: np.ndarray, length: int) -> np.ndarray:
    """For each passage (words joined by one space), as bits: which of its windows occur more than once in all of them.

    Passages of equal anchors go to one shard after another, whole groups at a time: a window has copies in its own
    group only. A group larger than a shard streams through the automata of all its shards.
    """
    order = np.argsort(hashes, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(hashes[order])) + 1).tolist(), len(order)]
    out = np.zeros(len(passages), np.uint64)
    shard: list[int] = []
    size = 0
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        group = order[lo:hi].tolist()
        shard += group
        size += sum(passages[i].count(b" ") + 1 for i in group)
        if size >= SHARD_WORDS or hi == len(order):
            stream(passages, times, shard, length, out)
            shard, size = [], 0
    return out


def stream(passages: list[bytes], times: list[int], shard: list[int], length: int, out: np.ndarray) -> None:
    """Builds automata over the words of a shard's passages, each as often as it occurs, and streams all of them through:
    a window occurs as often as the state says in which the match of its words ends."""
    number: dict[bytes, int] = {}
    members = [[number.setdefault(w, len(number)) for w in passages[i].split(b" ")] for i in shard]
    counts = [[0] * (len(m) - length + 1) for m in members]
    at = 0
    while at < len(members):
        automaton, size, reference = SuffixAutomaton(), 0, at
        while at < len(members) and (size < 2 * SHARD_WORDS or at == reference):
            automaton.add(members[at], times[shard[at]])
            size += len(members[at])
            at += 1
        automaton.finish()
        for own, member in zip(counts, members, strict=True):
            for j, n in enumerate(automaton.occurrences(member, length)):
                own[j] += n
    for i, own in zip(shard, counts, strict=True):
        out[i] = sum(1 << j for j, n in enumerate(own) if n > 1)


def find_repeats(chunks: DataFrame, length: int) -> tuple[DataFrame, Anchors]:
    total = chunks.agg(F.sum("size")).first()[0] or 0
    anchors = Anchors(length, total, part_count(chunks, PART_BYTES), word_symbols, across=False, choose=window_runs)
    bits = anchors.repeated(chunks)

    def send(chunk: str, texts: Texts, replies: pa.Table) -> pa.Table:
        starts, ends, _ = words_of(texts.data, texts.bounds)
        raw = texts.data.tobytes()
        rows = []
        for part, runs, hashes, index, inverse in chosen_passages(texts, by_kind(replies)[0], anchors, length):
            first = runs[index, 0]
            last = first + runs[index, 1] + length - 2
            body = b"\n".join(b" ".join(raw[a:b].split()) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True))
            times = np.bincount(inverse, minlength=len(index)).astype(np.int32)
            rows.append((part, chunk, squeeze(hashes[index], times, np.frombuffer(body, np.uint8))))
        return rows_of(REQUEST_ARROW, rows)

    def search(payloads: list[bytes]) -> list[bytes]:
        number: dict[bytes, int] = {}
        owned, times, hashes = [], [], []
        for p in payloads:
            own_hashes, own_times, body = unsqueeze(p)
            owned.append(np.array([number.setdefault(x, len(number)) for x in body.tobytes().split(b"\n")], np.int32))
            times.append(own_times)
            hashes.append(own_hashes)
        which, first = np.unique(np.concatenate(owned), return_index=True)
        total = np.bincount(np.concatenate(owned), np.concatenate(times), len(which)).astype(np.int64)
        bits_of = repeated_windows(list(number), total.tolist(), np.concatenate(hashes)[first], length)
        return [squeeze(bits_of[own]) for own in owned]

    replies = combine(answered(chunks, bits, send, REQUEST), anchors.parts, search).withColumn("kind", F.lit(1))
    return bits.unionByName(replies), anchors


RESULT = "n_words long, n_removed long, kept_sha256 string, kept string"


def substring_dedup(docs: DataFrame, length: int = 35) -> DataFrame:
    """Removes every word covered by ``length`` words in a row that also start anywhere else, in any document.

    Returns the documents' columns with n_words, n_removed, kept_sha256 and kept (the remaining words, joined by
    one space); columns of these names in the input are replaced. Words are runs of bytes other than ASCII white
    space. Null text has no words; repeated rows are copies of each other, whatever their doc_id; windows never
    cross documents and are judged on the input; an empty table gives an empty one. length: up to 63.
    """
    if not 2 <= length <= 63:
        raise ValueError("length: 2 to 63 words")
    fresh = StructType.fromDDL(RESULT)
    docs = docs.drop(*fresh.names)
    schema = StructType([*docs.schema.fields, *fresh.fields])
    chunks = make_chunks(docs.withColumn("text", F.col("text").cast("string")))
    replies, anchors = find_repeats(chunks, length)
    arrow = to_arrow_schema(schema)

    def use(chunk: str, texts: Texts, replies: pa.Table) -> pa.Table:
        bits, found = by_kind(replies)
        starts, ends, bounds = words_of(texts.data, texts.bounds)
        marks = np.zeros(len(starts) + length + 1, np.int32)
        for part, runs, _, _, inverse in chosen_passages(texts, bits, anchors, length):
            mask = unsqueeze(found[part])[0][inverse]
            for j in range(int(runs[:, 1].max())):
                marks[runs[(mask >> np.uint64(j)) & np.uint64(1) == 1, 0] + j] = 1
        gone = np.cumsum(marks - np.concatenate([np.zeros(length, np.int32), marks[:-length]]))[: len(starts)] > 0
        rows = []
        for i in range(len(texts)):
            words = texts.data[texts.bounds[i] : texts.bounds[i + 1]].tobytes().split()
            cut = gone[bounds[i] : bounds[i + 1]]
            removed = int(np.count_nonzero(cut))
            if removed:
                words = [w for w, x in zip(words, cut.tolist(), strict=True) if not x]
            kept = b" ".join(words)
            rows.append((len(cut), removed, hashlib.sha256(kept).hexdigest(), kept.decode()))
        out = texts.table
        for name, column in zip(fresh.names, zip(*rows, strict=True) if rows else [[]] * 4, strict=True):
            out = out.append_column(name, pa.array(column))
        return out.cast(arrow)

    return answered(chunks, replies, use, schema)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = with_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return substring_dedup(docs, 35).select("doc_id", "n_words", "n_removed", "kept_sha256")
