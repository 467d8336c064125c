"""Operator 6: scores of texts by a causal self-attention model over subword ids, and by counts of words.

From each place the model attends to the tokens before it and to three experts. What it finds at an earlier place is the
token that followed there; what an expert holds is the next token's share in the counts over all training documents: its
own, that after the last token, that after the last two. The probability of a token is what all attention finds of it. The
weights (queries and keys of tokens, by distance, and of experts by how often they saw the context) are fitted in numpy on
all whole training texts: in each epoch every chunk goes on from the same weights, and the results are averaged by tokens.
A training text's own occurrence of a token is taken out of all counts when that token is learned or scored, so that
training texts and others are scored alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import _encoder, rank_file
from millrace.llm.chunks import CHUNK_BYTES, REQUEST, REQUEST_ARROW, Texts, checkpointed, grouped, part_count, rows_of, slices, spread, squeeze, unsqueeze, with_ids
from millrace.llm.langid import held_out
from millrace.llm.symbols import BASE, LOWER, mix, word_hashes, words_of

#: Tokens in a row of a window, whose context is the row before and its own earlier tokens; width of queries and keys;
#: tokens with a query and key each (rarer ones share the second half); levels of how often a context was seen.
HALF, WIDTH, SLOTS, LEVELS = 16, 8, 2048, 16
#: The step of each round over all training texts, and rows of a batch.
RATES, BATCH = (0.02,), 512
#: Text for one part of the counts.
PART_BYTES = 8 << 20
EXPERTS = 3
#: Words, and tokens of these, that a worker remembers; it forgets all when there are more.
REMEMBERED, REMEMBERED_TOKENS = 1 << 20, 8 << 20
COUNTS = pa.schema([("chunk", pa.string()), ("part", pa.int32()), ("payload", pa.binary()), ("words", pa.int64())])
READY = "chunk string, tokens long, words long, payload binary"
READY_ARROW = pa.schema([("chunk", pa.string()), ("tokens", pa.int64()), ("words", pa.int64()), ("payload", pa.binary())])


def numbered(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below 2**bits in order, and which of these each key is.

    Integers sort much faster than their places do, so each place stands below its key's high bits; keys that differ
    in the low bits only are then put right.
    """
    if not len(keys):
        return keys, np.zeros(0, np.int32)
    low = len(keys).bit_length()
    drop = max(0, bits + low - 64)
    packed = keys >> np.uint64(drop)
    packed <<= np.uint64(low)
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << low) - 1)).view(np.int64)
    packed >>= np.uint64(low)
    found = keys[order] if drop else packed
    if (found[1:] < found[:-1]).any():
        again = np.argsort(found, kind="stable")
        order, found = order[again], found[again]
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    which = np.empty(len(keys), np.int32)
    number = np.cumsum(new, dtype=np.int32)
    number -= 1
    which[order] = number
    return found[new], which


def narrow(a: np.ndarray) -> np.ndarray:
    """Integers from 0 in as few bytes each as the largest needs."""
    return a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a


class Subwords:
    """Tokens of words, remembered by the words' 64-bit hashes as flat arrays."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]):
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.keys, self.starts, self.sizes, self.ids = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0, np.int32)

    def known(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.append(self.keys, np.uint64(0))[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def tokens(self, keys: np.ndarray, words: Callable[[np.ndarray], list[bytes]], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens of a sequence of words, and how many each word has. keys: distinct words' hashes in order;
        words: gives some of these; which: the sequence."""
        new = np.flatnonzero(~self.known(keys))
        if len(self.keys) + len(new) > REMEMBERED or len(self.ids) > REMEMBERED_TOKENS:
            self.forget()
            new = np.arange(len(keys))
        if len(new):
            found = self.encode(words(new))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            starts = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))])
            every = np.concatenate([self.keys, keys[new]])
            order = np.argsort(every, kind="stable")
            self.keys, self.starts, self.sizes = every[order], np.concatenate([self.starts, starts])[order], np.concatenate([self.sizes, sizes])[order]
        at = np.searchsorted(self.keys, keys)
        sizes = self.sizes[at][which]
        places = np.repeat(self.starts[at][which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.ids[places], sizes


@lru_cache(maxsize=1)
def _subwords(ranks: bytes) -> Subwords:
    encoder = _encoder(ranks, public_tokenizers.PATTERN)
    return Subwords(lambda words: encoder.encode_pieces([b" " + w for w in words]))


def leading(ranks: dict[bytes, int]) -> np.ndarray:
    """Which tokens begin a word: those that begin with a space, as each word is encoded after one and holds none."""
    out = np.zeros(max(ranks.values()) + 1, bool)
    out[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True
    return out


class WordsOf:
    """Words of texts in tokens: the text of each word, how many each text has, a hash of each distinct word, and which of
    these each word is. ``leads``: which tokens begin a word."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, leads: np.ndarray):
        starts = np.flatnonzero(leads[ids])
        self.doc = np.repeat(np.arange(len(sizes)), sizes)[starts]
        self.each = np.bincount(self.doc, minlength=len(sizes)).astype(np.int64)
        wide = ids.itemsize
        hashes = word_hashes(ids.view(np.uint8), wide * starts, wide * np.append(starts[1:], len(ids))[: len(starts)])
        self.keys, self.inverse = numbered(hashes >> np.uint64(1), 63)


class Tokenised:
    """Some texts as tokens: ids (words in lower case, each encoded after a space), how many tokens each text has, whether
    it is for training, and its doc_id."""

    names = ("ids", "sizes", "training", "doc_id", "no_id")

    def __init__(self, payload: bytes):
        self.__dict__.update(zip(self.names, unsqueeze(payload), strict=True))
        self.training = self.training.astype(bool)

    @staticmethod
    def pack(texts: Texts, training: np.ndarray, subwords: Subwords, size: int) -> bytes:
        data = LOWER[texts.data]
        starts, ends, bounds = words_of(data, texts.bounds)
        keys, which = numbered(word_hashes(data, starts, ends), 64)
        one = np.zeros(len(keys), np.int64)
        one[which] = np.arange(len(which))
        raw = data.tobytes()
        words = lambda new: [raw[a:b] for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)]
        ids, each = subwords.tokens(keys, words, which)
        total = np.concatenate([[0], np.cumsum(each)])[bounds]
        no_id = np.array(texts.table.column("doc_id").is_null()).astype(np.uint8)
        kind = np.uint16 if size <= 1 << 16 else np.int32
        return squeeze(ids.astype(kind), np.diff(total), training.astype(np.uint8), texts.ids(), no_id)


def whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive whole rows with about CHUNK_BYTES of text at a time, however few a batch has."""
    held: list[pa.Table] = []
    for batch in batches:
        found = list(slices(pa.concat_tables([*held, pa.Table.from_batches([batch])]).combine_chunks()))
        yield from found[:-1]
        held = found[-1:]
    yield from held


def tokenised(docs: DataFrame, subwords: Callable[[], Subwords], size: int) -> DataFrame:
    """Documents (doc_id, text, training) as checkpointed chunks of tokens: (chunk, size, payload)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, rows in enumerate(whole_rows(batches)):
            texts = Texts(rows)
            payload = Tokenised.pack(texts, np.array(rows.column("training")), subwords(), size)
            yield pa.RecordBatch.from_pydict({"chunk": [f"{task}-{n}"], "size": [len(texts.data)], "payload": [payload]})

    return checkpointed(docs.mapInArrow(pack, "chunk string, size long, payload binary"))


class ChunkTokens:
    """Tokens of a chunk's texts, each text with its end: what each is, what stands before it, and the pairs and triples
    of tokens that it ends, as numbers. ``size`` counts tokens with the end, which also stands before a text."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, size: int):
        self.lengths = sizes + 1
        last = np.cumsum(self.lengths) - 1
        self.target = np.full(int(self.lengths.sum()), size - 1, np.int64)
        inside = np.ones(len(self.target), bool)
        inside[last] = False
        self.target[inside] = ids
        self.first = np.zeros(len(self.target), bool)
        self.first[last - sizes] = True
        self.before = np.roll(self.target, 1)
        self.before[self.first] = size - 1
        self.doc = np.repeat(np.arange(len(sizes)), self.lengths)
        self.size = size

    @cached_property
    def pairs(self) -> np.ndarray:
        return self.before * self.size + self.target

    @cached_property
    def triples(self) -> np.ndarray:
        return ((np.roll(self.before, 1) + 1) * self.size * self.size + self.pairs)[~self.first]

    def grams(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs and triples, by so many bits of their hash, in order; and which each pair, then each triple, is."""
        every = np.concatenate([self.pairs, self.triples]).view(np.uint64)
        every += BASE
        every = mix(every)
        every >>= np.uint64(64 - bits)
        return numbered(every, bits)


def gram_bits(size: int) -> int:
    """Bits of hash by which pairs and triples are told: so many that about one in 2,000 in this much text meets another."""
    return min(63, max(36, size.bit_length() + 11))


@dataclass
class Evidence:
    """Rows of HALF tokens, each text in rows of its own: slots of what stands before each, the tokens themselves (-1: none),
    each expert's share and place among the levels of all experts (an expert's first: the context was never seen), and
    whether the row before belongs to the same text."""

    slots: np.ndarray
    targets: np.ndarray
    shares: np.ndarray
    levels: np.ndarray
    follows: np.ndarray

    @classmethod
    def of(cls, tokens: ChunkTokens, pairs: np.ndarray, triples: np.ndarray, own: np.ndarray, counts: np.ndarray, slots: np.ndarray) -> Evidence:
        """pairs, triples: how often those that a token ends occur in training; own: 1 for a token counted there."""
        lengths, total = tokens.lengths, int(counts.sum())
        rows = -(-lengths // HALF)
        follows = np.ones(int(rows.sum()), bool)
        follows[np.cumsum(rows) - rows] = False
        at = np.repeat((np.cumsum(rows) - rows) * HALF - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(own))
        out = cls(
            np.zeros((len(follows), HALF), slots.dtype), np.full((len(follows), HALF), -1, np.int32),
            np.zeros((len(follows), HALF, EXPERTS), np.float32), np.broadcast_to(LEVEL_AT, (len(follows), HALF, EXPERTS)).copy(), follows,
        )
        out.levels[..., 0] += 1
        out.slots.ravel()[at] = slots[tokens.before]
        out.targets.ravel()[at] = tokens.target
        shares, levels = out.shares.reshape(-1, EXPERTS), out.levels.reshape(-1, EXPERTS)
        shares[at, 0] = (counts[tokens.target] - own + 1) / np.maximum(1, total - own + len(counts))
        after_two = np.where(tokens.first, 0, np.roll(pairs, 1)) - own * ~tokens.first
        for i, c, context in ((1, pairs, counts[tokens.before] - own), (2, triples, after_two)):
            shares[at, i] = np.minimum(1, (c - own * (c > 0)) / np.maximum(1, context))
            # frexp: the bits of a count, which are one more than its logarithm's whole part; none: 0
            levels[at, i] += np.minimum(LEVELS, np.frexp(np.maximum(0, context).astype(np.float64))[1]).astype(np.int16)
        return out

    def batch(self, rows: np.ndarray) -> tuple:
        """Of some rows: slots, slots of the window, which scores are of a place with the same token (also where none may be
        attended to), shares, levels, and whether the row before may be attended to."""
        before = np.maximum(rows - 1, 0)
        slots, targets = self.slots[rows], self.targets[rows]
        window = np.concatenate([self.slots[before], slots], axis=1)
        said = np.concatenate([self.targets[before], targets], axis=1)
        same = np.flatnonzero(said[:, None, :] == targets[:, :, None])
        return slots, window, same + EXPERTS * (same // (2 * HALF)), self.shares[rows], self.levels[rows], self.follows[rows]


#: Places of a window that stand before each token of its second half; and how far before.
EARLIER = np.arange(2 * HALF) < np.arange(HALF)[:, None] + HALF
DISTANCE = np.clip(np.arange(HALF)[:, None] + HALF - np.arange(2 * HALF), 0, 2 * HALF - 1)
#: Scores of a token, for places and experts; where an expert's levels begin; the score of what may not be attended to;
#: and the size of scores up to which these may be raised as they are.
SCORES, LEVEL_AT, NEVER, PLAIN = 2 * HALF + EXPERTS, np.arange(EXPERTS, dtype=np.int16) * (LEVELS + 1), -1e9, 60


class Attention:
    """One head of causal attention over the places of a window and the experts."""

    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed).normal(0, 0.5, (SLOTS, WIDTH)).astype(np.float32)
        self.w = {
            "q": draw, "k": draw.copy(), "expert": np.zeros((EXPERTS, WIDTH), np.float32),
            "level": np.repeat(np.array([[1], [3], [3]], np.float32), LEVELS, axis=1), "distance": np.zeros(2 * HALF, np.float32),
        }

    def raised(self, slots, window, same, shares, levels, follows):
        """Attention to places, then experts, before it is made to sum to one; its sum; it times the probability that each
        finds for the token (of places with the same token, as all others find none; and of experts); the sum of that;
        and q and k."""
        w = self.w
        q, k = w["q"].take(slots, axis=0), w["k"].take(window, axis=0)
        scores = np.empty((*slots.shape, SCORES), q.dtype)
        places, experts = scores[..., : 2 * HALF], scores[..., 2 * HALF :]
        np.matmul(q, k.transpose(0, 2, 1), out=places)
        of_levels = np.pad(w["level"], ((0, 0), (1, 0)), constant_values=NEVER).take(levels)
        np.add((q.reshape(-1, WIDTH) @ w["expert"].T).reshape(experts.shape), of_levels, out=experts)
        # over whole rows of scores, with nothing for experts, as that is one run of memory
        scores += np.pad(np.where(EARLIER, w["distance"][DISTANCE], NEVER), ((0, 0), (0, EXPERTS))).astype(q.dtype)
        places[~follows, :, :HALF] = NEVER
        if scores.max(initial=0) > PLAIN or experts[..., 0].min(initial=0) < -PLAIN:
            scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        of_places, of_experts = scores.ravel()[same], experts * shares
        total = np.bincount(same // SCORES, of_places, slots.size).reshape(slots.shape) + of_experts @ np.ones(EXPERTS, q.dtype)
        return scores, scores @ np.ones(SCORES, q.dtype), of_places, of_experts, total, q, k

    def attend(self, *batch):
        """Attention weights over places, then experts; their sum; and the probability that all attention finds."""
        scores, every, _, _, total, _, _ = self.raised(*batch)
        return scores / every[..., None], every, total / every

    def gradient(self, slots, window, same, shares, levels, follows, real) -> dict[str, np.ndarray]:
        """Of the mean of -log probability over real tokens."""
        d, every, of_places, of_experts, total, q, k = self.raised(slots, window, same, shares, levels, follows)
        weight = (real / max(1, int(real.sum()))).astype(d.dtype)
        d *= (weight / every)[..., None]
        weight /= np.maximum(total, 1e-30 * every).astype(d.dtype)
        places, experts = d[..., : 2 * HALF], d[..., 2 * HALF :]
        d.ravel()[same] -= of_places * weight.ravel()[same // SCORES]
        experts -= of_experts * weight[..., None]
        # as one run of memory each, which multiplies faster
        places, flat = np.ascontiguousarray(places), experts.reshape(-1, EXPERTS)
        out = {
            "expert": flat.T @ q.reshape(-1, WIDTH),
            "level": np.bincount(levels.ravel(), flat.ravel(), EXPERTS * (LEVELS + 1)).reshape(EXPERTS, -1)[:, 1:],
            "distance": np.bincount(DISTANCE.ravel(), places.sum(axis=0).ravel(), 2 * HALF),
        }
        for name, at, g in (("q", slots, (places @ k).reshape(-1, WIDTH) + flat @ self.w["expert"]), ("k", window, places.transpose(0, 2, 1) @ q)):
            at, g = at.ravel(), g.reshape(-1, WIDTH).T
            out[name] = np.stack([np.bincount(at, column, SLOTS) for column in g], axis=1)
        return {name: g.astype(self.w[name].dtype) for name, g in out.items()}

    def fit(self, evidence: Evidence, rate: float, seed: int) -> None:
        """Adam, once over all rows in a fixed random order."""
        first = {k: np.zeros_like(x) for k, x in self.w.items()}
        second = {k: np.zeros_like(x) for k, x in self.w.items()}
        order = np.random.default_rng(seed).permutation(len(evidence.slots))
        for step, at in enumerate(range(0, len(order), BATCH), 1):
            rows = np.sort(order[at : at + BATCH])
            for k, g in self.gradient(*evidence.batch(rows), evidence.targets[rows] >= 0).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.w[k] -= rate * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8))

    def log10(self, evidence: Evidence, lengths: np.ndarray) -> np.ndarray:
        """Log-probability, base 10, of each text and its end: each token is scored once, with the row before its own
        and what stands before it in its own for context."""
        total = np.zeros(len(evidence.slots))
        for at in range(0, len(total), BATCH):
            rows = np.arange(at, min(at + BATCH, len(total)))
            found = self.attend(*evidence.batch(rows))[2]
            total[rows] = (np.log10(np.maximum(found, 1e-30)) * (evidence.targets[rows] >= 0)).sum(axis=1)
        rows = -(-lengths // HALF)
        return np.add.reduceat(total, np.cumsum(rows) - rows) if len(rows) else np.zeros(0)


def slots_of(counts: np.ndarray) -> np.ndarray:
    """The slot of each token: the most frequent have one each, the others share as many."""
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return np.where(rank < SLOTS // 2, rank, SLOTS // 2 + rank % (SLOTS // 2))


class Ready:
    """A chunk with all that its scores need, as one payload of integers."""

    names = ("ids", "sizes", "training", "bits", "of_grams", "of_words", "doc_id", "no_id")

    @staticmethod
    def pack(**arrays: np.ndarray) -> bytes:
        return squeeze(*(arrays[n] for n in Ready.names))

    def __init__(self, payload: bytes):
        self.__dict__.update(zip(self.names, unsqueeze(payload), strict=True))

    def evidence(self, counts: np.ndarray, slots: np.ndarray, training: bool) -> tuple[Evidence, np.ndarray]:
        """Rows of all texts, or of those for training; and how many tokens each text has."""
        tokens = ChunkTokens(self.ids.astype(np.int64), self.sizes, len(counts))
        pairs, triples = self.gram_counts(tokens)
        own = self.training[tokens.doc].astype(np.int64)
        if training:
            keep = self.training.astype(bool)
            inside = keep[tokens.doc]
            ids = self.ids[np.repeat(keep, self.sizes)].astype(np.int64)
            tokens, pairs, triples, own = ChunkTokens(ids, self.sizes[keep], len(counts)), pairs[inside], triples[inside], own[inside]
        return Evidence.of(tokens, pairs, triples, own, counts, slots), tokens.lengths

    def gram_counts(self, tokens: ChunkTokens) -> tuple[np.ndarray, np.ndarray]:
        """How often the pair and the triple that each token ends occur in training (triples: 0 for a text's first)."""
        of_grams = self.of_grams[tokens.grams(int(self.bits[0]))[1]].astype(np.int64)
        triples = np.zeros(len(tokens.target), np.int64)
        triples[~tokens.first] = of_grams[len(tokens.target) :]
        return of_grams[: len(tokens.target)], triples

    def words(self, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: words, those of them that training has, and the sum of log10 of one more than their counts there."""
        words, counts, n = WordsOf(self.ids, self.sizes, leads), self.of_words.astype(np.int64), len(self.sizes)
        known = np.bincount(words.doc, (counts > 0)[words.inverse], n).astype(np.int64)
        return words.each, known, np.bincount(words.doc, np.log10(counts + 1)[words.inverse], n)


def fitted(ready: DataFrame, counts: np.ndarray) -> tuple[Attention, int]:
    """The model after len(RATES) rounds over all training texts; and how many distinct training words there are.

    A round's result is the mean of the chunks' weights by their tokens, so it doesn't depend on which task has which
    chunk. It is summed in a tree: one set of weights for each task, and few of these at the driver.
    """
    context, model, words = ready.sparkSession.sparkContext, Attention(), 0
    known = context.broadcast((counts, slots_of(counts)))
    for epoch, rate in enumerate(RATES):
        now = context.broadcast(model)

        def learn(part, now=now, epoch=epoch, rate=rate):
            total, words, weights = 0, 0, {k: np.zeros(x.shape) for k, x in now.value.w.items()}
            for row in part:
                words += row.words
                if row.tokens:
                    evidence, lengths = Ready(bytes(row.payload)).evidence(*known.value, training=True)
                    own = Attention()
                    own.w = {k: x.copy() for k, x in now.value.w.items()}
                    own.fit(evidence, rate, epoch)
                    n = int(lengths.sum())
                    total, weights = total + n, {k: x + n * own.w[k].astype(np.float64) for k, x in weights.items()}
            yield total, words, weights

        total, words, weights = ready.rdd.mapPartitions(learn).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1], {k: x + b[2][k] for k, x in a[2].items()}))
        model = Attention()
        model.w = {k: (x / max(1, total)).astype(np.float32) for k, x in weights.items()}
        now.destroy()
    return model, words


def trained(ready: DataFrame, counts: np.ndarray) -> Attention:
    return fitted(ready, counts)[0]


def totals(chunks: DataFrame, size: int, leads) -> tuple[np.ndarray, int]:
    """Training counts of tokens, with ends as the last; and how many training words there are."""

    def count(part):
        total, words = np.zeros(size, np.int64), 0
        for row in part:
            texts = Tokenised(bytes(row.payload))
            ids = texts.ids[np.repeat(texts.training, texts.sizes)]
            total += np.bincount(ids, minlength=size)
            total[-1] += texts.training.sum()
            words += int(leads.value[ids].sum())
        yield total, words

    rows = chunks.select("payload").rdd
    if not rows.getNumPartitions():
        return np.zeros(size, np.int64), 0
    return rows.mapPartitions(count).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))


def prepared(docs: DataFrame, ranks_path: str) -> tuple[DataFrame, np.ndarray, int]:
    """Chunks ready to be learned from and scored (one row each), the training counts of tokens (the last: ends), and
    how many training words there are.

    What is ready isn't written: take its ``rdd`` each time, whose shuffled tokens and counts are then used again.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(rank_file(ranks_path))
    of_ranks = _encoder(ranks.value, public_tokenizers.PATTERN).ranks
    size, leads = len(of_ranks) + 1, docs.sparkSession.sparkContext.broadcast(leading(of_ranks))
    docs = docs.select("doc_id", "text", F.coalesce("training", F.lit(False)).alias("training"))
    chunks = tokenised(docs, lambda: _subwords(ranks.value), size)
    parts, bits = part_count(chunks, PART_BYTES), gram_bits(int(chunks.agg(F.sum("size")).first()[0] or 0))

    def edge(wide: int, part: int) -> int:
        """Where a part's keys begin, from which they are told."""
        return (part << wide) // parts

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload"), strict=True):
                texts = Tokenised(payload.as_py())
                words, tokens = WordsOf(texts.ids, texts.sizes, leads.value), ChunkTokens(texts.ids.astype(np.int64), texts.sizes, size)
                grams, which = tokens.grams(bits)
                of_words = np.bincount(words.inverse, texts.training[words.doc], len(words.keys)).astype(np.int32)
                counted = texts.training[tokens.doc]
                of_grams = np.bincount(which, np.concatenate([counted, counted[~tokens.first]]), len(grams)).astype(np.int32)
                at, cuts = spread(words.keys, 63, parts), spread(grams, bits, parts)
                rows = []
                for p in range(parts):
                    w, g = slice(at[p], at[p + 1]), slice(cuts[p], cuts[p + 1])
                    if w.stop > w.start or g.stop > g.start:
                        steps = (narrow(np.diff(x, prepend=np.uint64(edge(wide, p)))) for x, wide in ((words.keys[w], 63), (grams[g], bits)))
                        rows.append((p, chunk, squeeze(*steps, narrow(of_words[w]), narrow(of_grams[g]))))
                yield from rows_of(REQUEST_ARROW, rows).to_batches()

    def add(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        sent = [unsqueeze(p.as_py()) for p in table.column("payload")]
        answers = []
        for keys, counts, wide in ((0, 2, 63), (1, 3, bits)):
            told = np.concatenate([np.cumsum(s[keys], dtype=np.uint64) for s in sent])
            every, inverse = numbered(told, (edge(wide, part + 1) - edge(wide, part)).bit_length())
            total = np.bincount(inverse, np.concatenate([s[counts] for s in sent]), len(every)).astype(np.int64)
            cuts = np.cumsum([0, *(len(s[keys]) for s in sent)]).tolist()
            answers.append([narrow(total[inverse[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)])
            if not keys:
                distinct = int((total > 0).sum())
        rows = zip(table.column("chunk").to_pylist(), *answers, strict=True)
        # the part's distinct words are told once, with its first reply
        return rows_of(COUNTS, [(c, part, squeeze(a, b), 0 if i else distinct) for i, (c, a, b) in enumerate(rows)])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        replied = dict(zip(right.column("part").to_pylist(), right.column("payload"), strict=True))
        found = [unsqueeze(replied[p].as_py()) for p in sorted(replied)]
        of_words, of_grams = (narrow(np.concatenate([np.zeros(0, np.uint8), *(f[i] for f in found)])) for i in range(2))
        for chunk, payload in zip(left.column("chunk").to_pylist(), left.column("payload"), strict=True):
            texts = Tokenised(payload.as_py())
            ready = Ready.pack(
                ids=texts.ids, sizes=texts.sizes, training=texts.training.astype(np.uint8), bits=np.array([bits]),
                of_grams=of_grams, of_words=of_words, doc_id=texts.doc_id, no_id=texts.no_id,
            )
            rows.append((chunk, int(texts.sizes[texts.training].sum() + texts.training.sum()), sum(right.column("words").to_pylist()), ready))
        return rows_of(READY_ARROW, rows)

    requests = chunks.select("chunk", "payload").mapInArrow(send, REQUEST)
    counted = grouped(requests, parts).applyInArrow(add, "chunk string, part int, payload binary, words long")
    ready = chunks.select("chunk", "payload").groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(join, READY)
    return ready, *totals(chunks, size, leads)


RESULT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def attention_scores(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Scores every whole text; learns from rows whose column ``training`` is true.

    Returns doc_id, training, n_tokens (words and one end), n_known (of these, found in training), train_tokens,
    base_score (add-one unigram of words, log10) and score (log10 probability by the attention model, over subwords
    and one end). Words are lower-cased in A-Z and counted by a 64-bit hash, over all training rows. Null text is
    empty: one token, the end. With no training rows the counts are zero and the weights untrained. Repeated rows
    count and score each; doc_id may be null.
    """
    context = docs.sparkSession.sparkContext
    ready, counts, n = prepared(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ranks_path)
    model, v = fitted(ready, counts) if counts[-1] else (Attention(), 0)
    ends = int(counts[-1])
    n, v = n + ends, v + (ends > 0)
    leads = leading(_encoder(rank_file(ranks_path), public_tokenizers.PATTERN).ranks)
    learned = context.broadcast((counts, slots_of(counts), model, leads))

    def score(part):
        counts, slots, model, leads = learned.value
        for row in part:
            own = Ready(bytes(row.payload))
            evidence, lengths = own.evidence(counts, slots, training=False)
            n_words, known, base = own.words(leads)
            columns = (
                own.training.astype(bool), n_words + 1, known + (ends > 0), np.full(len(lengths), n),
                base + np.log10(ends + 1) - (n_words + 1) * np.log10(n + v + 1), model.log10(evidence, lengths),
            )
            ids = np.where(own.no_id.astype(bool), None, own.doc_id.astype(object)).tolist()
            yield from zip(ids, *(c.tolist() for c in columns), strict=True)

    return docs.sparkSession.createDataFrame(ready.rdd.mapPartitions(score), "doc_id long, training boolean, " + RESULT, verifySchema=False)


def op6_attention_lm(spark, sf_dir: str) -> DataFrame:
    docs = with_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    out = F.coalesce(held_out(7, 2), F.lit(False))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    scored = attention_scores(docs.withColumn("training", ~out), path)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
