"""Operator 10: language identification by cross-parsing with suffix automata of labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.automaton import SuffixAutomaton
from millrace.llm.chunks import Texts, slices, with_ids

#: Bounds of what is learned: labelled documents and bytes of text for each language, and bytes in all, which many
#: languages share.
SAMPLE_DOCS, SAMPLE_BYTES, ALL_BYTES = 64, 24_000, 256_000
#: Bytes that are parsed at once: a longer text is parsed in pieces, each from its own beginning.
PIECE = 256
#: Longest phrases, on average, that a language's own text is taken to have.
LONGEST = 20
RESULT = "lang_pred string, score double"


#: ASCII other than letters as a space, A-Z as a-z, the rest as it is.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[128:] = np.arange(128, 256)
LETTERS[97:123] = LETTERS[65:91] = np.arange(97, 123)


def running_text(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, what else there is between them as one space; and where each text begins."""
    data = LETTERS[texts.data]
    space = data == 32
    after = np.concatenate([[True], space[:-1]]) if len(space) else space
    after[texts.bounds[:-1][texts.bounds[:-1] < len(data)]] = True
    keep = ~(space & after)
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[texts.bounds]


class Parser:
    """For one language, a table of the states of a suffix automaton over its text."""

    def __init__(self, sample: bytes):
        self.symbol = np.zeros(256, np.int64)
        used = sorted(set(sample))
        self.symbol[used] = np.arange(1, len(used) + 1)
        automaton = SuffixAutomaton()
        automaton.add(sample)
        self.next = np.zeros((len(automaton.next), len(used) + 1), np.int32)
        for state, edges in enumerate(automaton.next):
            for byte, to in edges.items():
                self.next[state, self.symbol[byte]] = to
        #: Phrases a byte that the language's own text needs: measured on the sample's second half, parsed with the first,
        #: but no fewer than one in LONGEST bytes.
        self.own = 1.0

    def phrases(self, padded: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each row of bytes: phrases of a parse that takes the longest match each time, across words. A byte that the
        language never uses is a phrase of its own. Any part of a phrase is one too, so no parse has fewer."""
        state = np.zeros(len(padded), np.int64)
        count = np.zeros(len(padded), np.int64)
        for i in range(padded.shape[1]):
            live = i < lengths
            s = self.symbol[padded[:, i]]
            to = self.next[state, s]
            fails = (to == 0) & live
            # a new phrase starts with this byte, or is this byte
            count += fails & (state > 0)
            fresh = self.next[0, s]
            count += fails & (fresh == 0)
            state = np.where(live, np.where(to == 0, fresh, to), state)
        return count + (state > 0)


@lru_cache(maxsize=2)
def _parsers(samples: tuple[tuple[str, bytes], ...]) -> dict[str, Parser]:
    out = {}
    for lang, sample in samples:
        out[lang] = Parser(sample)
        half = len(sample) // 2
        if half:
            padded, lengths, _ = as_rows(np.frombuffer(sample[half:], np.uint8), np.array([0, len(sample) - half]))
            out[lang].own = max(1 / LONGEST, float(Parser(sample[:half]).phrases(padded, lengths).sum() / lengths.sum()))
    return out


def as_rows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of texts as padded rows, the shorter ones first; their lengths; and whose they are."""
    sizes = np.diff(bounds)
    pieces = -(-sizes // PIECE)
    first = np.repeat(bounds[:-1], pieces) + PIECE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    lengths = np.minimum(first + PIECE, np.repeat(bounds[1:], pieces)) - first
    order = np.argsort(lengths, kind="stable")
    first, lengths = first[order], lengths[order]
    padded = np.concatenate([data, np.zeros(PIECE, np.uint8)])[first[:, None] + np.arange(int(lengths.max(initial=0)))]
    return padded, lengths, np.repeat(np.arange(len(sizes)), pieces)[order]


def rates(texts: Texts, parsers: dict[str, Parser]) -> np.ndarray:
    """Phrases a byte of each text by language, relative to what the language's own text needs."""
    data, bounds = running_text(texts)
    padded, lengths, of_doc = as_rows(data, bounds)
    out = np.zeros((len(parsers), len(texts)))
    for at in range(0, len(lengths), 1 << 13):
        rows = slice(at, at + (1 << 13))
        block = padded[rows, : int(lengths[rows].max())]
        for i, parser in enumerate(parsers.values()):
            out[i] += np.bincount(of_doc[rows], parser.phrases(block, lengths[rows]), len(texts))
    own = np.array([p.own for p in parsers.values()])
    return out / np.maximum(np.diff(bounds), 1) / own[:, None]


def learned_samples(labelled: DataFrame, docs: int = SAMPLE_DOCS, most: int = SAMPLE_BYTES, in_all: int = ALL_BYTES) -> tuple[tuple[str, bytes], ...]:
    """Text of some documents for each language, chosen by a hash of doc_id: at most ``docs`` of them and ``most``
    bytes. Many languages share ``in_all`` bytes."""
    labelled = labelled.where("lang is not null and text is not null")
    most = max(1, min(most, in_all // max(1, labelled.select("lang").distinct().count())))
    each = Window.partitionBy("lang")
    ranked = labelled.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("rank", F.row_number().over(each.orderBy("h", "doc_id")))
    chosen = ranked.where(F.col("rank") <= docs).select("lang", "doc_id", "rank", F.ceil(F.lit(most) / F.count("*").over(each)).cast("int").alias("share"))
    text = labelled.select("lang", "doc_id", "text").join(F.broadcast(chosen), ["lang", "doc_id"])
    rows = text.select("lang", "rank", "share", F.expr("substring(text, 1, share + 1)").alias("text")).dropDuplicates(["lang", "rank"])
    found: dict[str, list] = {}
    for r in rows.collect():
        found.setdefault(r.lang, []).append((r.rank, first_words(r.text.lower().encode(), r.share)))
    out = []
    for lang, texts in sorted(found.items()):
        raw = b" ".join(b for _, b in sorted(texts)).translate(LETTERS.tobytes())
        if raw.split():
            out.append((lang, b" ".join(raw.split())))
    return tuple(out)


def identify_language(docs: DataFrame, labelled: DataFrame, unknown: str = "und") -> DataFrame:
    """Adds lang_pred and score to documents, having learned from ``labelled`` (doc_id, text, lang).

    Each whole text, its letters with one space for all else between them, is parsed into the fewest phrases that occur in a
    language's sample, for each language; the language that needs the fewest, relative to its own text, wins (ties: the first by name). score
    is the margin to the others: one less the winner's rate over the mean of the others', between 0 and 1; 1 if
    there is but one language. A text that is null or has no letter gets ``unknown`` and score 0, as do all if
    nothing was learned. Columns of these names in the input are replaced; repeated rows get equal results.
    """
    fresh = StructType.fromDDL(RESULT)
    docs = docs.drop(*fresh.names).withColumn("text", F.col("text").cast("string"))
    schema = StructType([*docs.schema.fields, *fresh.fields])
    samples = docs.sparkSession.sparkContext.broadcast(learned_samples(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsers = _parsers(samples.value)
        names = list(parsers)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                texts = part.column("text").to_pylist()
                pred, score = [unknown] * len(texts), [0.0] * len(texts)
                if parsers:
                    lowered = pa.table([pc.utf8_lower(part.column("text"))], ["text"])
                    found = rates(Texts(lowered), parsers)
                    best = found.argmin(axis=0)
                    least = found.min(axis=0)
                    rest = (found.sum(axis=0) - least) / max(1, len(names) - 1)
                    for i, text in enumerate(texts):
                        if text and has_letter(text):
                            pred[i] = names[best[i]]
                            score[i] = float(min(1.0, max(0.0, 1 - least[i] / rest[i]))) if rest[i] > 0 else 1.0
                columns = [*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *fresh.names])

    return docs.mapInArrow(run, schema)


def first_words(raw: bytes, most: int) -> bytes:
    """The words that so many bytes hold, or as much of a longer first one."""
    return raw if len(raw) <= most else raw[:most].rpartition(b" ")[0] or raw[:most]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(modulus: int, remainder: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus == remainder


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = with_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    out = F.coalesce(held_out(5, 0), F.lit(False))
    found = identify_language(docs.drop("lang"), docs.where(~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
