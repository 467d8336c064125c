"""Anchors whose symbols occur more than once: the common first step of both deduplications of passages."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import Texts, ask, checkpointed, combine, spread, squeeze, unsqueeze
from millrace.llm.symbols import BASE, minimizers, mix

#: What turns a chunk into its symbols and their bounds by document, and what finds anchors in these: places, or rows
#: that say more of each, and their hashes.
Symbols = Callable[[Texts], tuple[np.ndarray, np.ndarray]]
Choice = Callable[[np.ndarray, np.ndarray, int, int], tuple[np.ndarray, np.ndarray]]


class Anchors:
    """Anchors of windows of ``length`` symbols, and which of them may lie in a window that occurs again."""

    def __init__(self, length: int, total: int, parts: int, symbols: Symbols, across: bool, choose: Choice = minimizers):
        self.k, self.w = (length + 1) // 2, length - (length + 1) // 2 + 1
        self.parts, self.symbols, self.across, self.choose = parts, symbols, across, choose
        #: Bits of hash that are exchanged: enough that few of the anchors of this much text meet by chance.
        self.bits = min(62, max(32, int(total).bit_length() + 12))

    def find(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, bounds, places of anchors, and their short hashes. An anchor's own hash is the least of several, so it
        is hashed again: parts are ranges of what is spread evenly."""
        symbols, bounds = self.symbols(texts)
        places, hashes = self.choose(symbols, bounds, self.k, self.w)
        return symbols, bounds, places, mix(hashes + BASE) >> np.uint64(64 - self.bits)

    def repeated(self, chunks: DataFrame) -> DataFrame:
        """Replies to each chunk: for its distinct hashes in order, a bit that says whether it occurs again.

        Across: only if it occurs in documents of different ids (as far as one chunk can tell).
        """

        def request(texts: Texts):
            _, bounds, places, hashes = self.find(texts)
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, int)
            if self.across and len(first):
                ids = texts.ids()[np.searchsorted(bounds, places[order], "right") - 1]
                again = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
            else:
                again = np.diff(np.append(first, len(hashes))) > 1
            keys = hashes[first]
            at = spread(keys, self.bits, self.parts)
            for part, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
                if hi > lo:
                    step = np.diff(keys[lo:hi], prepend=np.uint64(0))
                    yield part, squeeze(step, np.packbits(again[lo:hi]))

        def reply(payloads: list[bytes]) -> list[bytes]:
            runs = []
            for p in payloads:
                step, again = unsqueeze(p)
                runs.append((np.cumsum(step, dtype=np.uint64), np.unpackbits(again, count=len(step)).astype(bool)))
            every = np.sort(np.concatenate([k for k, _ in runs]))
            twice = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(k[a] for k, a in runs)]))
            out = []
            for keys, _ in runs:
                at = np.searchsorted(twice, keys).clip(max=max(0, len(twice) - 1))
                out.append(np.packbits(twice[at] == keys if len(twice) else np.zeros(len(keys), bool)).tobytes())
            return out

        return checkpointed(combine(ask(chunks, request), self.parts, reply).withColumn("kind", F.lit(0)))

    def candidates(self, texts: Texts, bits: dict[int, bytes]):
        """Symbols, bounds, and of anchors that occur again the places, parts and short hashes."""
        symbols, bounds, places, hashes = self.find(texts)
        keys, inverse = np.unique(hashes, return_inverse=True)
        at = spread(keys, self.bits, self.parts)
        chosen = np.zeros(len(keys), bool)
        part_of = np.zeros(len(keys), np.int64)
        for part, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
            if hi > lo:
                chosen[lo:hi] = np.unpackbits(np.frombuffer(bits[part], np.uint8), count=hi - lo)
                part_of[lo:hi] = part
        take = chosen[inverse]
        return symbols, bounds, places[take], part_of[inverse][take], hashes[take]


def by_kind(replies) -> tuple[dict[int, bytes], dict[int, bytes]]:
    """Payloads by part: of kind 0 and of kind 1."""
    out: tuple[dict, dict] = ({}, {})
    columns = (replies.column(c).to_pylist() for c in ("kind", "part", "payload"))
    for kind, part, payload in zip(*columns, strict=True):
        out[kind][part] = payload
    return out
