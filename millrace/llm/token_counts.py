"""Operator 12: token counts of documents from pre-tokens, each of which is counted once in the whole corpus.

A task turns some MB of text into its distinct pre-tokens and, for each of these, the documents that hold it and how often.
Distinct pre-tokens go to parts by their hash, where each is tokenised once and its number of pieces sent back; there the
numbers meet the documents' frequencies and are summed. Neither ids nor texts are kept or moved.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import TWO_SPACES, cut_at_spaces, rank_file
from millrace.llm.chunks import REQUEST, REQUEST_ARROW, Texts, checkpointed, combine, part_count, rows_of, slices, squeeze, unsqueeze, with_ids

#: Bytes of text that a task turns into pre-tokens at a time; pre-tokens that are tokenised at a time.
PACK_BYTES, AT_ONCE = 8 << 20, 1 << 14
PACKED = "chunk string, size long, words binary, freqs binary"
RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


class PreTokens:
    """Splits texts as a byte-level tokenizer of the ``tokenizers`` library does, and counts the pieces of pre-tokens."""

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        about = json.loads(file)
        split = about.get("pre_tokenizer") or {}
        added = about.get("added_tokens") or []
        if about.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
            raise ValueError("only tokenizers that split bytes by the usual pattern, without a normalizer, are counted")
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take white space or whole words aren't counted")
        self.library = Tokenizer.from_str(file.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def segments(self, text: str) -> list[str]:
        """The text between added tokens, each of which is one token."""
        return self.special.split(text) if self.special else [text]

    def pieces(self, part: str) -> list[str]:
        """Pre-tokens. Characters that Python's tables don't know may be letters for one library and not for another."""
        if not part.isascii() and any(unicodedata.category(c) == "Cn" for c in set(part)):
            return [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return self.pattern.findall(part)

    def parts(self, text: str) -> list[str]:
        """Pre-tokens, or several at a time: where no two white spaces meet, no pre-token reaches over a space but at its front."""
        return self.pieces(text) if TWO_SPACES.search(text) else cut_at_spaces(text)

    def counts(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for at in range(0, len(words), AT_ONCE):
            found = self.library.encode_batch_fast([w.decode() for w in words[at : at + AT_ONCE]], add_special_tokens=False)
            out[at : at + AT_ONCE] = np.fromiter(map(len, found), np.int64, len(found))
        return out

    def frequencies(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pre-tokens; for each pair of one and a document that holds it, in order, their numbers and how often;
        and how many added tokens each document has."""
        flat: list[str] = []
        ends, special = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            segments = self.segments(text)
            special[i] = len(segments) - 1
            for s in segments:
                flat += self.parts(s)
            ends.append(len(flat))
        number = {p: i for i, p in enumerate(dict.fromkeys(flat))}
        of = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        doc = np.repeat(np.arange(len(texts)), np.diff([0, *ends]))
        del flat
        split = [self.pieces(p) for p in number]
        words = {w: i for i, w in enumerate(dict.fromkeys(w for own in split for w in own))}
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        pieces = np.fromiter((words[w] for own in split for w in own), np.int64, int(sizes.sum()))
        starts, many = np.cumsum(sizes) - sizes, sizes[of]
        at = np.repeat(starts[of] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        keys, times = np.unique(pieces[at] * max(1, len(texts)) + np.repeat(doc, many), return_counts=True)
        return list(words), *np.divmod(keys, max(1, len(texts))), times, special


@lru_cache(maxsize=2)
def _pre_tokens(file: bytes) -> PreTokens:
    return PreTokens(file)


def packed(words: list[bytes], *more: np.ndarray) -> bytes:
    return squeeze(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.uint32, len(words)), *more)


def unpacked(payload: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    text, sizes, *more = unsqueeze(payload)
    raw, ends = text.tobytes(), np.cumsum(sizes, dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], more


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row, as the ``tokenizers`` library counts the tokens of its whole text.

    tokenizer_path: a byte-level BPE as JSON. Strings of added tokens inside texts are one token, as the library's default
    has it; begin and end tokens, truncation and padding are left out. Null and empty texts have no bytes and no tokens.
    Rows are independent: repeated rows and rows of one id, null included, each have their own count. Other columns
    are left out; an empty table gives an empty one. over_limit: n_tokens > limit.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rank_file(tokenizer_path))
    _pre_tokens(shared.value)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, task, n = _pre_tokens(shared.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, PACK_BYTES):
                texts = [t or "" for t in rows.column("text").to_pylist()]
                words, word, doc, times, special = split.frequencies(texts)
                raw = [w.encode() for w in words]
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
                order = np.argsort(hashes, kind="stable")
                n_bytes = np.diff(Texts(rows).bounds)
                present = rows.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                ids = rows.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
                first = np.searchsorted(word, np.arange(len(raw)))
                place = np.empty(len(raw), np.int64)
                place[order] = np.arange(len(raw))
                sizes = np.diff(np.append(first, len(word)))
                moved = np.argsort(place[word], kind="stable")
                doc = doc[moved]
                step = np.diff(doc, prepend=0)
                starts = np.cumsum(sizes[order]) - sizes[order]
                step[starts] = doc[starts]
                freqs = squeeze(
                    ids, present.astype(np.uint8), n_bytes, special.astype(np.uint32),
                    *(x.astype(np.uint32) for x in (sizes[order], step, times[moved])),
                )
                blob = packed([raw[i] for i in order.tolist()], (hashes[order] >> np.uint64(32)).astype(np.uint32))
                yield pa.RecordBatch.from_pydict({"chunk": [f"{task}-{n}"], "size": [rows.column("text").nbytes], "words": [blob], "freqs": [freqs]})
                n += 1

    chunks = checkpointed(docs.select("doc_id", "text").mapInArrow(pack, PACKED))
    parts = part_count(chunks)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("words"), strict=True):
                words, (hashes,) = unpacked(blob.as_py())
                at = np.searchsorted(hashes.astype(np.uint64) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1)).tolist()
                rows = [(p, chunk, packed(words[a:b])) for p, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
                yield from rows_of(REQUEST_ARROW, rows).to_batches()

    def reply(payloads: list[bytes]) -> list[bytes]:
        split = _pre_tokens(shared.value)
        asked = [unpacked(p)[0] for p in payloads]
        number = {w: i for i, w in enumerate(dict.fromkeys(w for words in asked for w in words))}
        counts = split.counts(list(number)).astype(np.uint32)
        return [squeeze(counts[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]) for words in asked]

    replies = combine(chunks.select("chunk", "words").mapInArrow(ask, REQUEST), parts, reply)

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        found = sorted(zip(right.column("part").to_pylist(), right.column("payload").to_pylist(), strict=True))
        counts = np.concatenate([unsqueeze(p)[0] for _, p in found]).astype(np.int64) if found else np.zeros(0, np.int64)
        for freqs in left.column("freqs").to_pylist():
            ids, present, n_bytes, special, sizes, step, times = (x.astype(np.int64) for x in unsqueeze(freqs))
            starts = np.cumsum(sizes) - sizes
            run = np.cumsum(step)
            doc = run - np.repeat(run[starts] - step[starts], sizes)
            weights = np.repeat(counts, sizes) * times
            tokens = special + np.bincount(doc, weights, len(ids)).astype(np.int64)
            out.append(pa.table([pa.array(ids, mask=present == 0), n_bytes, tokens, tokens > limit], schema=RESULT_ARROW))
        return pa.concat_tables(out)

    return chunks.select("chunk", "freqs").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(total, RESULT)


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = with_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
