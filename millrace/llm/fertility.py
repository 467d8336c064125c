"""Operator 3: quality rules from the fertility of two public tokenizers, with bands by script fitted on good documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.bpe import _encoder, rank_file
from millrace.llm.chunks import Texts, checkpointed, slices, with_ids
from millrace.llm.symbols import words_of
from millrace.llm.wordtokens import WordTokens


@dataclass(frozen=True)
class Band:
    """What clean text of a script keeps to: characters a token of either vocabulary, share of byte-fallback tokens, and bits
    of entropy of its tokens. Entropy rises with the number of tokens: what counts is its rest over ``STEP`` bits for each
    doubling, up to ``MOST_DOUBLINGS``."""

    least_chars: float
    most_chars: float
    least_bpe_chars: float
    most_bpe_chars: float
    most_bytes: float
    least_rest: float
    least_bpe_rest: float


STEP, MOST_DOUBLINGS = 0.2, 11
#: How many good documents of a script it takes to fit its band; the share at either end that is left out; and how much wider
#: than the rest's range the band is on each side.
LEAST_DOCS, TAIL, MARGIN = 40, 0.005, 0.25
#: For scripts that no good documents show.
WIDE = Band(0.25, 8.0, 0.25, 12.0, 0.95, 0.0, 0.0)
#: By most letters.
SCRIPTS = ("latin", "cyrillic", "greek", "cjk", "arabic", "other", "none")
#: First and last code points of the scripts.
RANGES = (
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0x24F), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F),
    ("other", 0x530, 0x5FF), ("other", 0x780, 0x1DFF), ("other", 0x2C00, 0x2DFF), ("cjk", 0x3040, 0x30FF),
    ("cjk", 0x3400, 0x9FFF), ("cjk", 0xAC00, 0xD7AF), ("other", 0xA000, 0xABFF), ("cjk", 0x20000, 0x2FFFF),
)
_SCRIPT_OF = np.full(0x30000, SCRIPTS.index("none"), np.uint8)
for _name, _first, _last in RANGES:
    _SCRIPT_OF[_first : _last + 1] = SCRIPTS.index(_name)

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double, "
    "bpe_tokens long, chars_per_bpe_token double, bpe_entropy double"
)


class Fertility(WordTokens):
    """Token ids of words by a sentencepiece model."""

    def __init__(self, model: bytes):
        model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = model.get_piece_size()
        self.is_byte = np.array([model.is_byte(i) for i in range(self.size)])
        super().__init__(lambda words: model.encode([w.decode() for w in words], num_threads=1))


class BpeFertility(WordTokens):
    """Token ids of words, each after a space, by the ranks of a byte-level BPE."""

    def __init__(self, ranks: bytes):
        pairs = _encoder(ranks, public_tokenizers.PATTERN)
        self.size = len(pairs.ranks)

        def encode(words: list[bytes]) -> list[list[int]]:
            texts = [w.decode() for w in words]
            # By the usual pattern a word of letters is one piece.
            parted = [i for i, t in enumerate(texts) if not (pairs.usual and t.isalpha())]
            pieces = [b" " + w for w in words]
            more = []
            for i in parted:
                own = pairs.pattern.findall(" " + texts[i])
                pieces[i] = own[0].encode()
                more.append([p.encode() for p in own[1:]])
            found = pairs.encode_pieces(pieces + [p for own in more for p in own])
            rest = iter(found[len(words) :])
            out = found[: len(words)]
            for i, own in zip(parted, more, strict=True):
                if own:
                    out[i] = [*out[i], *(x for _ in own for x in next(rest))]
            return out

        super().__init__(encode)


@lru_cache(maxsize=2)
def _fertility(model: bytes, ranks: bytes) -> tuple[Fertility, BpeFertility]:
    first, second = Fertility(model), BpeFertility(ranks)
    first.follower = second
    return first, second


def token_counts(n: int, numbers: np.ndarray, bounds: np.ndarray, model: WordTokens) -> tuple[np.ndarray, ...]:
    """Ids of the tokens of n texts, the text of each, how many each text has, and their entropy in bits; words are given by numbers."""
    ids, sizes = model.tokens(numbers)
    ids = ids.astype(np.int64)
    doc = np.repeat(np.repeat(np.arange(n), np.diff(bounds)), sizes)
    tokens = np.bincount(doc, minlength=n)
    keys = np.sort(doc * model.size + ids)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    of = keys[first] // model.size
    entropy = np.log2(np.maximum(tokens, 1)) - np.bincount(of, counts * np.log2(counts), n) / np.maximum(tokens, 1)
    return ids, doc, tokens, np.maximum(entropy, 0)


def repeat_words(numbers: np.ndarray) -> int:
    """Words in windows of three that are found twice or more among a text's words, given by numbers."""
    if len(numbers) < 4:
        return 0
    if numbers.max() >= 1 << 21:
        numbers = np.unique(numbers, return_inverse=True)[1]
    if numbers.max() >= 1 << 21:
        pairs = np.unique(numbers[:-1] * (int(numbers.max()) + 1) + numbers[1:], return_inverse=True)[1]
        keys = pairs[:-1] * (int(numbers.max()) + 1) + numbers[2:]
    else:
        keys = (numbers[:-2] << 42) | (numbers[1:-1] << 21) | numbers[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(numbers), bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(np.count_nonzero(covered))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> int:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    counts = np.bincount(_SCRIPT_OF[np.minimum(points, len(_SCRIPT_OF) - 1)], minlength=len(SCRIPTS))
    counts[SCRIPTS.index("none")] = 0
    return int(counts.argmax()) if counts.any() else SCRIPTS.index("none")


def measured(docs: DataFrame, model_path: str, ranks_path: str) -> DataFrame:
    """Documents with all columns of RESULT; of ``kept`` what the base rules say."""
    fresh = StructType.fromDDL(RESULT)
    docs = docs.drop(*fresh.names).withColumn("text", F.col("text").cast("string"))
    schema = StructType([*docs.schema.fields, *fresh.fields])
    shared = docs.sparkSession.sparkContext.broadcast((rank_file(model_path), rank_file(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bpe = _fertility(*shared.value)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                texts = Texts(part)
                starts, ends, bounds = words_of(texts.data, texts.bounds)
                n_words = np.diff(bounds)
                raw = texts.data.tobytes()
                words = raw_words(raw, texts.bounds)
                numbers = model.numbers(words)
                _, _, bpe_tokens, bpe_entropy = token_counts(len(texts), numbers, bounds, bpe)
                ids, doc, tokens, entropy = token_counts(len(texts), numbers, bounds, model)
                fallback = np.bincount(doc, model.is_byte[ids], len(texts))
                heads = np.zeros(len(texts.data) + 1, np.int64)
                np.cumsum((texts.data & 0xC0) != 0x80, out=heads[1:])
                chars = np.concatenate([[0], np.cumsum(heads[ends] - heads[starts])])
                signs = np.concatenate([[0], np.cumsum(SYMBOLS[texts.data])])
                cuts = texts.bounds.tolist()
                lines = np.array([duplicate_lines(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], np.int64)
                repeats = np.array([repeat_words(numbers[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)], np.int64)
                scripts = [SCRIPTS[script_of(t or "")] for t in part.column("text").to_pylist()]
                word_chars = chars[bounds[1:]] - chars[bounds[:-1]]
                many = np.maximum(tokens, 1)
                failed = (n_words < 50) | (100 * repeats > 50 * n_words)
                columns = [
                    n_words, word_chars, signs[texts.bounds[1:]] - signs[texts.bounds[:-1]], lines, repeats, failed, ~failed, scripts, tokens,
                    word_chars / many, fallback / many, entropy, bpe_tokens, word_chars / np.maximum(bpe_tokens, 1), bpe_entropy,
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, columns)], [*part.schema.names, *fresh.names])

    return docs.mapInArrow(run, schema)


def rest(entropy: str, tokens: str) -> Column:
    """Bits of entropy over what so many tokens have by their number."""
    return F.col(entropy) - STEP * F.least(F.lit(MOST_DOUBLINGS), F.log2(F.greatest(tokens, F.lit(1))))


def fitted_bands(docs: DataFrame, good: DataFrame, model_path: str, ranks_path: str) -> dict[str, Band]:
    """The band of each script that at least LEAST_DOCS of the documents (doc_id, text) called good (doc_id) are of: their
    range without TAIL at either end, and MARGIN of it besides."""
    return bands_of(measured(docs.select("doc_id", "text"), model_path, ranks_path), good)


def bands_of(found: DataFrame, good: DataFrame) -> dict[str, Band]:
    """Bands from all measured documents that are called good. Ends of ranges are exact: counts of values to five places
    tell where they lie, and only values of these places are looked at, so that no task holds all."""
    chosen = good.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    few = found.where("not base_failed").withColumn("doc_id", F.col("doc_id").cast("long")).join(chosen, "doc_id", "left_semi")
    values = {
        "chars": F.col("chars_per_token"), "bpe_chars": F.col("chars_per_bpe_token"), "bytes": F.col("byte_share"),
        "rest": rest("token_entropy", "n_tokens"), "bpe_rest": rest("bpe_entropy", "bpe_tokens"),
    }
    each = few.select("script", F.explode(F.create_map(*(c for n, v in values.items() for c in (F.lit(n), v)))).alias("name", "value")).withColumn("bin", F.round("value", 5))
    ranges: dict[str, dict[str, list[float]]] = {}
    for (script, name), counts in ranked_values(each).items():
        ranges.setdefault(script, {})[name] = [quantile(counts, q) for q in (TAIL, 1 - TAIL)]
    out = {}
    for script, own in ranges.items():
        low = {n: own[n][0] - MARGIN * (own[n][1] - own[n][0]) for n in values}
        high = {n: own[n][1] + MARGIN * (own[n][1] - own[n][0]) for n in values}
        out[script] = Band(low["chars"], high["chars"], low["bpe_chars"], high["bpe_chars"], high["bytes"] + 0.01, low["rest"], low["bpe_rest"])
    return out


def ranked_values(each: DataFrame) -> dict[tuple[str, str], tuple[int, list[tuple[int, int, float]]]]:
    """Of values (script, name, value, bin), by script and name: how many there are, and (first rank, count, value) of those around both ends."""
    by = Window.partitionBy("script", "name")
    counts = each.groupBy("script", "name", "bin").agg(F.count("*").alias("n"))
    counts = counts.withColumn("start", F.sum("n").over(by.orderBy("bin")) - F.col("n")).withColumn("total", F.sum("n").over(by))
    needed = F.lit(False)
    for q in (TAIL, 1 - TAIL):
        rank = F.floor(q * (F.col("total") - 1))
        needed |= (F.col("start") <= rank + 1) & (F.col("start") + F.col("n") > rank)
    places = counts.where((F.col("total") >= LEAST_DOCS) & needed).drop("n")
    rows = each.join(F.broadcast(places), ["script", "name", "bin"]).groupBy("script", "name", "bin", "start", "total", "value").agg(F.count("*").alias("n")).collect()
    out: dict[tuple[str, str], tuple[int, list[tuple[int, int, float]]]] = {}
    last = None
    for row in sorted(rows, key=lambda r: (r["script"], r["name"], r["bin"], r["value"])):
        here = row["script"], row["name"], row["bin"]
        rank = rank if here == last else row["start"]
        out.setdefault(here[:2], (row["total"], []))[1].append((rank, row["n"], row["value"]))
        rank, last = rank + row["n"], here
    return out


def quantile(counts: tuple[int, list[tuple[int, int, float]]], q: float) -> float:
    """The value at a share of ranks, between two neighbours in proportion."""
    total, ranks = counts
    at = q * (total - 1)
    low = math.floor(at)
    value = lambda rank: next(v for first, n, v in ranks if first <= rank < first + n)
    return value(low) + (at - low) * (value(min(low + 1, total - 1)) - value(low))


def fertility_rules(docs: DataFrame, model_path: str, ranks_path: str, bands: dict[str, Band] | None = None) -> DataFrame:
    """Measures and verdict for each whole text, with the documents' columns; columns of these names are replaced.

    Words are runs of bytes other than ASCII white space. base_failed: fewer than 50 words, or more than half of
    them in repeated windows of three. kept: not base_failed, and inside the band of the script of most letters, by
    both vocabularies; a script without a band has the widest. A null or empty text has no words: all counts are 0, the
    measures 0, the script "none", and it isn't kept. Rows are independent; repeated rows get equal results; an empty
    table gives an empty one.
    """
    return judged(measured(docs, model_path, ranks_path), bands)


def judged(found: DataFrame, bands: dict[str, Band] | None = None) -> DataFrame:
    """Measured documents with their verdict."""
    inside = F.lit(False)
    for script in SCRIPTS:
        band = (bands or {}).get(script, WIDE)
        fits = F.col("chars_per_token").between(band.least_chars, band.most_chars) & F.col("chars_per_bpe_token").between(band.least_bpe_chars, band.most_bpe_chars)
        fits &= (F.col("byte_share") <= band.most_bytes) & (rest("token_entropy", "n_tokens") >= band.least_rest)
        inside |= (F.col("script") == script) & fits & (rest("bpe_entropy", "bpe_tokens") >= band.least_bpe_rest)
    return found.withColumn("kept", ~F.col("base_failed") & inside)


def raw_words(raw: bytes, bounds: np.ndarray) -> list[bytes]:
    cuts = bounds.tolist()
    return [w for a, b in zip(cuts, cuts[1:], strict=False) for w in raw[a:b].split()]


def op3_fertility(spark, sf_dir: str) -> DataFrame:
    docs = with_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    paths = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = checkpointed(measured(docs, *paths).drop("text"))
    return judged(found, bands_of(found, good))
