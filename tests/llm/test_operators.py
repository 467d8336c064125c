"""The training-data operators against brute force, public libraries and SQL, on small tables with odd rows."""

import base64
import collections
import hashlib
import math
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import queries
from millrace.llm.automaton import SuffixAutomaton
from millrace.llm.bpe import REMEMBERED_BYTES, BytePairs, byte_bpe, decode_tokens
from millrace.llm.chunks import Texts
from millrace.llm.components import components
from millrace.llm.decontamination import decontaminate
from millrace.llm.fertility import MARGIN, MOST_DOUBLINGS, STEP, TAIL, WIDE, bands_of, fertility_rules, fitted_bands
from millrace.llm.langid import Parser, as_rows, identify_language, learned_samples, running_text
from millrace.llm.lm import LEVELS, Attention, ChunkTokens, Evidence, Ready, attention_scores, numbered, prepared, slots_of, trained
from millrace.llm.ngram_join import ngram_jaccard
from millrace.llm.quotation import link_quotations
from millrace.llm.sharding import SHARDS_SQL, extendible_shards
from millrace.llm.substring_dedup import substring_dedup
from millrace.llm.suffix_dedup import suffix_dedup

DATA = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 977}x{i}" for i in range(4000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ROWS = [
    (1, f"It begins here. {PASSAGE} and ends.", "en", 7), (2, f"Other words, then {PASSAGE} too", "en", 7),
    (3, None, "en", 7), (4, "", None, 7), (5, "   \n\t ", "en", 7), (6, LONG, "en", 7), (7, LONG + " more", "de", 7),
    (8, "a" * 3000, "xx", 7), (9, "ab ab ab ab " * 40, "en", 7), (9, "ab ab ab ab " * 40, "en", 7), (10, "été 日本語 😀 naïve", "fr", 7),
    (11, "One Two", "en", 7), (12, "one  two", "en", 7), (None, "one two", "en", 7), (13, "x\n\n  y \x00 z", "en", 7),
]
SCHEMA = "doc_id long, text string, lang string, n_bytes int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def keyed(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_bpe_equals_tiktoken(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(RANKS).read_bytes().splitlines())}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = byte_bpe(docs, RANKS)
    for r in found.collect():
        ids = encoding.encode_ordinary(r.text or "")
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == sha(",".join(map(str, ids)).encode())
        assert r.decoded_sha256 == sha((r.text or "").encode())
    assert all((r.text or "").encode() == bytes(r.decoded) for r in decode_tokens(found, RANKS).collect())


def test_bpe_by_another_pattern(docs, spark):
    """A pattern that parts capitals, and one that leaves spaces alone; a memory that is often full."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(RANKS).read_bytes().splitlines())}
    odd = spark.createDataFrame([(1, "say HelloWorldAgain now"), (2, "a  b\n c"), (3, "é HelloWorld")], "doc_id long, text string")
    for pattern in (r"\s+|[A-Z][a-z]*|[^A-Z\s]+", r" ?[^ ]+| +"):
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for r in byte_bpe(docs.select("doc_id", "text").unionByName(odd), RANKS, pattern).collect():
            assert r.token_ids == encoding.encode_ordinary(r.text or "")
    pairs = BytePairs(Path(RANKS).read_bytes(), public_tokenizers.PATTERN)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i in range(4):
        text = " ".join(f"w{i}{j}" + "x" * 400 for j in range(9000))
        assert [n for n, _, _ in pairs.texts([text])] == [len(encoding.encode_ordinary(text))]
        assert pairs.held <= 9000 * 420 + REMEMBERED_BYTES


def brute_suffix(rows, length):
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: math.inf if r[0] is None else r[0]):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], math.inf if i is None else i)
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (math.inf if i is None else i):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        yield i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))


@pytest.mark.parametrize("length", [6, 50])
def test_suffix_dedup_equals_brute_force(docs, length):
    found = suffix_dedup(docs, length)
    assert keyed(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute_suffix(ROWS, length), key=repr)


def brute_substring(rows, length):
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    times = collections.Counter(tuple(w[p : p + length]) for _, w in words for p in range(len(w) - length + 1))
    for i, w in words:
        gone = bytearray(len(w))
        for p in range(len(w) - length + 1):
            if times[tuple(w[p : p + length])] > 1:
                gone[p : p + length] = b"\1" * length
        yield i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))


@pytest.mark.parametrize("length", [4, 35])
def test_substring_dedup_equals_brute_force(docs, length):
    found = substring_dedup(docs, length)
    assert keyed(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute_substring(ROWS, length), key=repr)


def test_automaton_counts():
    automaton = SuffixAutomaton()
    for s in ("abcabc", "abc", "xbca"):
        automaton.add(s)
    assert automaton.finish().occurrences("abcab", 2) == [3, 4, 2, 3]


def lower_text(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()


def brute_components(rows, n, percent):
    sets = {i: {tuple(w[p : p + n]) for p in range(max(1, len(w) - n + 1))} if (w := lower(t)) else set() for i, t, *_ in rows if i is not None}
    up = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = max(up[a], up[b]), min(up[a], up[b])
                up = {k: new if v == old else v for k, v in up.items()}
    return sets, up


def test_ngram_join_equals_brute_force(spark, docs):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 400, 120)]
    near = []
    for k in range(60):
        words = list(base)
        for p in rng.integers(0, 120, k % 5):
            words[p] = f"new{k}{p}"
        near.append((100 + k, " ".join(words), "en", 1))
    rows = [r for r in ROWS if r[0] is not None] + near
    sets, up = brute_components(rows, 3, 90)
    found = ngram_jaccard(spark.createDataFrame(rows, SCHEMA), 3, 90)
    for r in found.collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), up[r.doc_id])
    assert [r.component_id for r in ngram_jaccard(docs, 3, 90).where("doc_id is null").collect()] == [11]


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(90, 80), (5, 5)], "a long, b long")
    found = dict(keyed(components(links), "node", "component"))
    assert found == {**{i: 0 for i in range(51)}, 80: 80, 90: 80}


def test_fertility_base_rules(docs):
    for r in fertility_rules(docs, PIECES, RANKS).collect():
        raw = (r.text or "").encode()
        words, lines, dup, seen = raw.split(), raw.split(b"\n"), 0, set()
        for line in lines:
            if line.split():
                dup += line in seen
                seen.add(line)
        grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {p + j for p in range(len(words) - 2) if grams[tuple(words[p : p + 3])] > 1 for j in range(3)}
        assert (r.n_words, r.n_dup_lines, r.n_repeat_words) == (len(words), dup, len(covered))
        assert r.word_chars == sum(len(w.decode()) for w in words)
        assert r.n_symbols == sum((r.text or "").count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(words) < 50 or 2 * len(covered) > len(words))
        assert not (r.base_failed and r.kept)


def entropy(ids):
    return sum(-n / len(ids) * math.log2(n / len(ids)) for n in collections.Counter(ids).values()) if ids else 0.0


def test_bands_are_fitted_on_all_good_documents(spark):
    """More good documents than were once looked at, of which the last have other values."""
    rows = [(i, False, "latin", 2.0 + i / 10_000 + (3.0 if i >= 5000 else 0.0), 0.25) for i in range(6000)]
    found = spark.createDataFrame(rows, "doc_id long, base_failed boolean, script string, chars_per_token double, byte_share double")
    found = found.selectExpr("*", "chars_per_token + 1e-7 * (doc_id % 3) as chars_per_bpe_token", "100L as n_tokens", "100L as bpe_tokens", "chars_per_token as token_entropy", "5.0D as bpe_entropy")
    bands = bands_of(found, spark.range(6000).withColumnRenamed("id", "doc_id"))
    low, high = np.quantile([r[3] for r in rows], [TAIL, 1 - TAIL])
    assert np.allclose([bands["latin"].least_chars, bands["latin"].most_chars], [low - MARGIN * (high - low), high + MARGIN * (high - low)], rtol=1e-12)
    assert bands["latin"].most_bytes == 0.26 and bands_of(found, spark.range(30).withColumnRenamed("id", "doc_id")) == {}


def test_two_vocabularies_share_numbers(monkeypatch):
    """Words are looked up once for both vocabularies of operator 3, also after they were forgotten; odd words are cut by the pattern."""
    from millrace.llm import fertility, wordtokens
    from millrace.llm.bpe import _encoder, rank_file

    monkeypatch.setattr(wordtokens, "REMEMBERED", 12)
    paths = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    fertility._fertility.cache_clear()
    model, bpe = fertility._fertility(*map(rank_file, paths))
    pairs = _encoder(rank_file(paths[1]), public_tokenizers.PATTERN)
    batches = ["Haus don't x's 3rd a1b2 straße", "été\u0301 naïve, \u00a0x\u2028y x\u00a0 ²x 日本 Ⅷ", "ª'll 'll' ...! Haus Haus ʰa \u0301 we've"]
    for text in batches * 2:
        words = [w.encode() for w in text.split(" ")]
        numbers = model.numbers(words)
        ids, sizes = bpe.tokens(numbers)
        expected = [[i for ids in pairs.encode_pieces([p.encode() for p in pairs.pattern.findall(" " + w.decode())]) for i in ids] for w in words]
        assert sizes.tolist() == list(map(len, expected)) and ids.tolist() == [i for own in expected for i in own]
        assert len(bpe.bounds) == len(model.bounds) == len(model.known) + 1 and not bpe.known
        ids, sizes = model.tokens(numbers)
        assert ids.tolist() == [i for own in model.encode(words) for i in own]
    fertility._fertility.cache_clear()


def test_fertility_equals_brute_force(spark):
    """Tokens, fallback, entropy and the verdict, of whole texts, by the tokenizers' own libraries."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    bands = fitted_bands(docs, docs.where(docs.doc_id.isin(*good)).select("doc_id"), PIECES, RANKS)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(RANKS).read_bytes().splitlines())}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    fit, found = [], fertility_rules(docs, PIECES, RANKS, bands).collect()
    for r in found:
        words = [w.decode() for w in (r.text or "").encode().split()]
        ids = [i for w in words for i in model.encode(w)]
        other = [i for w in words for i in bpe.encode_ordinary(" " + w)]
        chars = sum(map(len, words))
        own = {
            "chars": chars / max(1, len(ids)), "bpe_chars": chars / max(1, len(other)), "bytes": sum(map(model.is_byte, ids)) / max(1, len(ids)),
            "rest": entropy(ids) - STEP * min(MOST_DOUBLINGS, math.log2(max(1, len(ids)))), "bpe_rest": entropy(other) - STEP * min(MOST_DOUBLINGS, math.log2(max(1, len(other)))),
        }
        assert (r.n_tokens, r.bpe_tokens) == (len(ids), len(other))
        assert np.allclose([r.chars_per_token, r.chars_per_bpe_token, r.byte_share, r.token_entropy, r.bpe_entropy], [own["chars"], own["bpe_chars"], own["bytes"], entropy(ids), entropy(other)])
        b = bands.get(r.script, WIDE)
        inside = b.least_chars <= own["chars"] <= b.most_chars and b.least_bpe_chars <= own["bpe_chars"] <= b.most_bpe_chars
        inside = inside and own["bytes"] <= b.most_bytes and own["rest"] >= b.least_rest - 1e-9 and own["bpe_rest"] >= b.least_bpe_rest - 1e-9
        assert r.kept == (not r.base_failed and inside)
        if r.doc_id in good and not r.base_failed and r.script == "latin":
            fit.append(own)
    low, high = (np.quantile([f["chars"] for f in fit], q) for q in (TAIL, 1 - TAIL))
    assert abs(bands["latin"].least_chars - (low - MARGIN * (high - low))) < 1e-9 and abs(bands["latin"].most_chars - (high + MARGIN * (high - low))) < 1e-9
    kept = sum(r.kept for r in found if r.doc_id in good and not r.base_failed)
    assert kept >= 0.98 * len(fit)


def test_parse_has_the_fewest_phrases():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sample = bytes(rng.choice(list(b"ab c"), 60).tolist())
        text = bytes(rng.choice(list(b"ab cd"), 40).tolist())
        fewest = [0] + [len(text)] * len(text)
        for j in range(1, len(text) + 1):
            fewest[j] = min(fewest[i] + 1 for i in range(j) if text[i:j] in sample or i == j - 1)
        padded, lengths, _ = as_rows(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert Parser(sample).phrases(padded, lengths).sum() == fewest[-1]


def test_language_equals_brute_force(spark):
    """Predictions by a parse over whole texts that looks up every phrase in the samples as strings."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    samples = learned_samples(docs)

    def parse(text, sample):
        at = n = 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in sample:
                size += 1
            at, n = at + size, n + 1
        return n

    own = {lang: max(1 / 20, sum(parse(s[len(s) // 2 :][i : i + 256], s[: len(s) // 2]) for i in range(0, len(s) - len(s) // 2, 256)) / (len(s) - len(s) // 2)) for lang, s in samples}
    for r in identify_language(docs.orderBy("doc_id").limit(40), docs).collect():
        text = running_text(Texts(pa.table({"text": [(r.text or "").lower()]})))[0].tobytes()
        rate = {lang: sum(parse(text[i : i + 256], s) for i in range(0, len(text), 256)) / max(1, len(text)) / own[lang] for lang, s in samples}
        expected = min(sorted(rate), key=rate.get) if any(map(str.isalpha, r.text or "")) else "und"
        assert r.lang_pred == expected


def test_many_languages(spark):
    rows = [(i, "".join(chr(97 + (i * k) % 26) for k in range(1, 30)), f"l{i:03}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = learned_samples(docs, in_all=900)
    assert len(samples) == 90 and all(len(s) <= 10 for _, s in samples)
    assert identify_language(docs, docs).where("lang_pred is null").count() == 0


def test_language_held_out_accuracy(spark):
    found = queries.QUERIES["op10_language_id"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id")
    rows = found.where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(docs):
    found = dict((r.doc_id, r.lang_pred) for r in identify_language(docs, docs).collect())
    assert found[3] == found[4] == found[5] == "und" and found[8] == "xx"
    assert {r.lang_pred for r in identify_language(docs, docs.limit(0)).collect()} == {"und"}


def test_attention_scores(docs):
    counts, held = collections.Counter(), lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    for i, t, *_ in ROWS:
        if not held(i):
            counts.update([*lower(t), None])
    n, v = sum(counts.values()), len(counts)
    rows = docs.selectExpr("doc_id", "text", "coalesce(crc32(cast(doc_id as string)) % 7 <> 2, true) as training")
    expected = []
    for i, t, *_ in ROWS:
        w = [*lower(t), None]
        expected.append((i, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    found = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in attention_scores(rows, RANKS).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def some_evidence(rng, size=300):
    ids, sizes = rng.integers(0, 40, 70), np.array([40, 0, 30])
    tokens = ChunkTokens(ids, sizes, size)
    counts = np.bincount(tokens.target, minlength=size)
    pairs, triples = (np.unique(x, return_inverse=True, return_counts=True)[1:] for x in (tokens.pairs, tokens.triples))
    of_triples = np.zeros(len(tokens.target), np.int64)
    of_triples[~tokens.first] = triples[1][triples[0]]
    return tokens, Evidence.of(tokens, pairs[1][pairs[0]], of_triples, np.zeros(len(tokens.target), np.int64), counts, slots_of(counts))


def test_attention_gradient_is_right():
    model, rows = Attention(), np.arange(6)
    model.w = {k: x.astype(np.float64) for k, x in model.w.items()}
    _, evidence = some_evidence(np.random.default_rng(0))
    real = evidence.targets[rows] >= 0

    def loss():
        return -np.log(model.attend(*evidence.batch(rows))[2][real]).mean()

    gradient = model.gradient(*evidence.batch(rows), real)
    slot = int(evidence.slots[0, 5])
    for name, at in (("expert", (1, 4)), ("distance", (2,)), ("q", (slot, 1)), ("k", (slot, 1)), ("level", (1, 2)), ("level", (2, 0))):
        model.w[name][at] += 1e-4
        up = loss()
        model.w[name][at] -= 2e-4
        down = loss()
        model.w[name][at] += 1e-4
        assert abs((up - down) / 2e-4 - gradient[name][at]) < 1e-5


def test_attention_gives_probabilities():
    """Over all tokens that could come next, the model's probabilities sum to one."""
    size, model = 300, Attention()
    tokens, evidence = some_evidence(np.random.default_rng(3), size)
    pairs, triples, counts = collections.Counter(tokens.pairs.tolist()), collections.Counter(tokens.triples.tolist()), np.bincount(tokens.target, minlength=size)
    ends = size - 1
    a = model.attend(*evidence.batch(np.arange(1, 2)))[0]
    at, said = 20, tokens.target[:20]
    before = int(tokens.target[at - 1]), int(tokens.target[at - 2])
    total = 0.0
    for x in range(size):
        two, three = pairs[before[0] * size + x], triples[(before[1] + 1) * size * size + before[0] * size + x]
        # the window of the second row begins with the first token of the text
        own = a[0, 4, :20] @ (said == x) + a[0, 4, 32] * (counts[x] + 1) / (counts.sum() + size)
        own += a[0, 4, 33] * two / max(1, counts[before[0]]) + a[0, 4, 34] * three / max(1, pairs[before[1] * size + before[0]])
        total += own
    assert abs(total - 1) < 1e-5 and ends not in said


def brute_scores(texts, held, model, counts, encode):
    """The model's log10 probability of each text, token by token."""
    size, w = len(counts), model.w
    slots = slots_of(counts)
    sequences = [[*encode(t), size - 1] for t in texts]
    pairs, triples = collections.Counter(), collections.Counter()
    for seq, out in zip(sequences, held, strict=True):
        if not out:
            full = [size - 1, *seq]
            pairs.update(zip(full, full[1:], strict=False))
            triples.update(zip(full, full[1:], full[2:], strict=False))
    for seq, out in zip(sequences, held, strict=True):
        own, full, score = 0 if out else 1, [size - 1, *seq], 0.0
        for t, x in enumerate(seq):
            prev = full[t]
            q = w["q"][slots[prev]]
            parts = []
            for j in range(max(0, t // 16 * 16 - 16), t):
                parts.append((q @ w["k"][slots[full[j]]] + w["distance"][t - j], float(seq[j] == x)))
            contexts = [1, counts[prev] - own, pairs[full[t - 1], prev] - own if t else 0]
            shares = [(counts[x] - own + 1) / (counts.sum() - own + size), (pairs[prev, x] - own) / max(1, contexts[1]), (triples[full[t - 1], prev, x] - own) / max(1, contexts[2]) if t else 0]
            for e in range(3):
                if contexts[e] > 0:
                    parts.append((q @ w["expert"][e] + w["level"][e, min(LEVELS - 1, int(math.log2(contexts[e])))], shares[e]))
            a = np.exp(np.array([p[0] for p in parts], np.float64))
            score += math.log10(a @ np.array([p[1] for p in parts]) / a.sum())
        yield score


def test_attention_scores_equal_brute_force(spark):
    texts = ["Red green blue red green blue " * 9, "", "blue red", "one two three " * 30 + "red", "Red green blue one", "two " * 33, "two " * 32, "two " * 31]
    held = [False, False, False, False, True, False, True, False]
    rows = spark.createDataFrame([(i, t, not out) for i, (t, out) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, training boolean")
    ready, counts, _ = prepared(rows, RANKS)
    model = trained(ready, counts)
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(RANKS).read_bytes().splitlines())}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = list(brute_scores(texts, held, model, counts, lambda t: [i for w in lower(t) for i in encoding.encode_ordinary(" " + w.decode())]))
    found = {r.doc_id: r.score for r in attention_scores(rows, RANKS).collect()}
    assert all(abs(found[i] - x) < 1e-3 * max(1, abs(x)) for i, x in enumerate(expected))


def test_attention_beats_bigrams_on_held_out_texts(spark):
    """By token, against pairs of tokens interpolated with single ones at the best fixed weight for these very texts."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id", "text", "crc32(cast(doc_id as string)) % 7 <> 2 as training")
    ready, counts, _ = prepared(docs, RANKS)
    own = [Ready(bytes(r.payload)) for r in ready.select("payload").collect()]
    model, score, pairs, n = trained(ready, counts), 0.0, [], 0
    for chunk in own:
        evidence, lengths = chunk.evidence(counts, slots_of(counts), training=False)
        out = chunk.training == 0
        score += model.log10(evidence, lengths)[out].sum()
        n += lengths[out].sum()
        tokens = ChunkTokens(chunk.ids.astype(np.int64), chunk.sizes, len(counts))
        at = out[tokens.doc]
        pairs.append((chunk.gram_counts(tokens)[0][at] / np.maximum(1, counts[tokens.before[at]]), (counts[tokens.target[at]] + 1) / (counts.sum() + len(counts))))
    two, one = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    assert score / n > max(np.log10(x * two + (1 - x) * one).mean() for x in np.arange(0.05, 1, 0.05)) + 0.05


def test_attention_writes_tokens_once_in_whole_chunks(spark):
    """Small batches make no small chunks, and all passes share one checkpoint: what is ready isn't written again."""
    rows = spark.createDataFrame([(i, f"red green {i} blue", i % 3 > 0) for i in range(40)], "doc_id long, text string, training boolean").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        attention_scores(rows.limit(1), RANKS).count()
        folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
        before = set(folder.glob("rdd-*"))
        assert attention_scores(rows, RANKS).count() == 40
        assert len(set(folder.glob("rdd-*")) - before) == 1
        assert prepared(rows, RANKS)[0].count() == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("bits", [5, 36, 50, 63])
def test_numbered_equals_unique(bits):
    keys = np.random.default_rng(bits).integers(0, 1 << bits, 30000).astype(np.uint64)
    keys[:10000] = keys[10000:20000] ^ np.uint64(1)
    for x in (keys, keys[:1], keys[:0]):
        for found, expected in zip(numbered(x, bits), np.unique(x, return_inverse=True), strict=True):
            assert (found == expected).all() and len(found) == len(expected)


def test_attention_learns_from_every_training_text_to_its_end(spark):
    def score(texts):
        rows = [(i, t, True) for i, t in enumerate(texts)] + [(9999, "red green blue red green blue", False)]
        found = attention_scores(spark.createDataFrame(rows, "doc_id long, text string, training boolean").coalesce(1), RANKS)
        return found.where("doc_id = 9999").first().score

    # Orders of words that leave all counts as they are: only what the weights learn from can tell them apart.
    head, tail = ["same"] * 3000, ["red", "green", "blue"] * 400
    assert abs(score([" ".join(head + tail)]) - score([" ".join(head + sorted(tail))])) > 1e-6
    hashes = spark.range(450).selectExpr("id", "xxhash64(id) AS h").orderBy("h").collect()
    texts = {r.id: "red green blue " * 3 for r in hashes}
    last = {**texts, **{r.id: "blue blue blue green green green red red red" for r in hashes[400:]}}
    assert abs(score([texts[i] for i in range(450)]) - score([last[i] for i in range(450)])) > 1e-6


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal_sql(spark, duck, name):
    df, other = queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    at = [other.columns.index(c) for c in columns]
    assert keyed(df, *columns) == sorted((tuple(r[i] for i in at) for r in other.fetchall()), key=repr)


def test_decontamination_of_odd_rows(spark, docs):
    benchmark = spark.createDataFrame([(1, PASSAGE.upper()), (2, None), (3, "!!"), (4, "One two")], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate(docs, benchmark, 10).collect()}
    assert found[1].n_hit == 60 and found[1].items_sha256 == sha(b"1") and "shared" not in found[1].clean_text
    assert found[11].n_hit == found[12].n_hit == 2 and found[None].contaminated
    assert not found[3].contaminated and found[3].n_words == 0 and not found[6].contaminated
    assert decontaminate(docs, benchmark.limit(0), 10).where("contaminated").count() == 0


def test_shards_fit_their_limit(spark, docs):
    found = extendible_shards(docs, 4000).collect()
    assert len(found) == len(ROWS)
    pages = collections.Counter()
    for r in found:
        pages[r.shard, r.page] += r.n_bytes
    rows = collections.Counter((r.shard, r.page) for r in found)
    assert all(b <= 4000 or rows[k] == 1 for k, b in pages.items())
    alike = spark.createDataFrame([(1, "z" * 100)] * 50, "doc_id long, text string")
    assert extendible_shards(alike.repartition(7), 1000).count() == alike.count()
    pages = collections.Counter(r.page for r in extendible_shards(alike.repartition(7), 1000).collect())
    assert sorted(pages) == list(range(len(pages)))
    pages = collections.Counter(r.page for r in extendible_shards(alike, 1000).collect())
    assert sorted(pages.values()) == [10] * 5
    assert extendible_shards(docs.limit(0), 10).count() == 0


@pytest.mark.parametrize("limit", [3000, 20_000])
def test_many_shards_equal_sql(spark, duck, limit):
    found = extendible_shards(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), limit).drop("text")
    other = duck.sql(SHARDS_SQL.replace("{limit}", str(limit)))
    assert found.select("shard").distinct().count() > 20
    assert keyed(found, *sorted(found.columns)) == sorted((tuple(r[other.columns.index(c)] for c in sorted(found.columns)) for r in other.fetchall()), key=repr)


CLASHES = ("hash", "lines", "up", "hit_words", "row", "own", "words", "body_", "h", "place", "part", "chunk", "label", "prefix", "bytes", "hits", "first")


@pytest.fixture(scope="module")
def clashing(spark):
    """Rows with columns named as operators' own are, all of the value 'mine'."""
    rows = [(1, f"> x\n{PASSAGE}", "user"), (1, f"{PASSAGE} too", "user"), (2, None, "user"), (None, "", "user")]
    df = spark.createDataFrame([(i, n, t, r, i) for n, (i, t, r) in enumerate(rows)], "doc_id long, turn long, text string, role string, conv_id long")
    for c in CLASHES:
        df = df.withColumn(c, F.lit("mine"))
    return df


def test_clashing_names(spark, clashing):
    benchmark = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    plain = clashing.drop(*CLASHES).withColumn("lang", F.lit("en"))
    lang = plain.select("doc_id", "text", "lang")
    for operator in (
        lambda d: byte_bpe(d, RANKS), lambda d: suffix_dedup(d, 50), lambda d: fertility_rules(d, PIECES, RANKS), lambda d: extendible_shards(d, 100),
        lambda d: substring_dedup(d, 35), lambda d: decontaminate(d, benchmark, 10), link_quotations, lambda d: identify_language(d, lang),
    ):
        found, expected = operator(clashing), operator(clashing.drop(*CLASHES))
        assert {tuple(r[c] for c in CLASHES) for r in found.select(*(f"`{c}`" for c in CLASHES)).collect()} == {("mine",) * len(CLASHES)}
        assert keyed(found, *expected.columns) == keyed(expected, *expected.columns)
    for operator in (lambda d: ngram_jaccard(d, 3, 90), lambda d: attention_scores(d.withColumn("training", F.lit(True)), RANKS).drop("score")):
        assert keyed(operator(clashing), "doc_id") == keyed(operator(plain), "doc_id")


def test_rows_of_one_id(clashing, spark):
    benchmark = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    rows = spark.createDataFrame([(5, PASSAGE), (5, "clean words"), (5, PASSAGE), (None, PASSAGE)], "doc_id long, text string")
    assert keyed(decontaminate(rows, benchmark, 10), "doc_id", "n_hit") == sorted([(5, 0), (5, 60), (5, 60), (None, 60)], key=repr)
    assert identify_language(rows.selectExpr("doc_id", "text"), rows.selectExpr("doc_id", "text", "'en' as lang")).where("lang_pred = 'en'").count() == 4


def test_quotations(spark):
    rows = [
        (1, 0, "user", "How does it  work?\nTell me"), (1, 1, "assistant", "> how does it work?\n> tell me\nLike this."),
        (1, 2, "user", "Ann wrote:\n> > How does it work? Tell me\n> Like this.\nThanks"), (1, 3, "user", None),
        (1, 4, "user", "> never said\nHm"), (2, 0, "user", "> Like this.\nElsewhere"), (None, 0, "user", "x"), (None, None, "user", "> x"),
    ]
    found = {(r.conv_id, r.turn): r for r in link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(found) == len(rows)
    assert found[1, 1].parent_turn == 0 and found[1, 1].body == "Like this."
    assert (found[1, 2].parent_turn, found[1, 2].thread_turn, found[1, 2].n_linked, found[1, 2].max_level) == (1, 0, 2, 2)
    assert found[1, 2].body == "Thanks" and found[1, 3].body == ""
    assert found[1, 4].parent_turn is None and found[1, 4].n_quotes == 1 and found[2, 0].parent_turn is None


def test_quotations_of_a_part(spark):
    rows = [
        (1, 0, "user", "First line here.\nSecond  line.\nThird one that is long enough to wrap\nLast."), (1, 1, "assistant", "Second line. Third"),
        (1, 2, "user", "> first line here.\n> second line.\nYes"), (1, 3, "user", "> Third one that\n> is long\nAh"),
        (1, 4, "user", "> Second line. Third\nA whole body goes first"), (1, 5, "user", "> line here. Third one\nNot in a row"),
        (1, 6, "user", "> irst line here.\nPart of a word"), (1, 7, "user", "> comes later\nHm"), (1, 8, "user", "This comes later indeed"),
        (2, 0, "user", "x"), (2, 1, "user", "> First line here.\n> Second line.\nElsewhere"), (2, 2, "user", ">\n> \nNothing"),
    ]
    found = {(r.conv_id, r.turn): r for r in link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(found) == len(rows)
    assert [found[1, k].parent_turn for k in range(9)] == [None, None, 0, 0, 1, None, None, None, None]
    assert [found[1, k].n_linked for k in range(9)] == [0, 0, 1, 1, 1, 0, 0, 0, 0] and found[1, 2].thread_turn == 0
    assert found[2, 1].parent_turn is None and found[2, 2].parent_turn is None


def test_empty_tables(spark, docs):
    none, benchmark = docs.limit(0), spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert suffix_dedup(none).count() == substring_dedup(none).count() == ngram_jaccard(none).count() == 0
    assert byte_bpe(none, RANKS).count() == fertility_rules(none, PIECES, RANKS).count() == decontaminate(none, benchmark).count() == 0
    assert identify_language(none, none).count() == 0 and fitted_bands(none, none, PIECES, RANKS) == {}
    assert link_quotations(none.selectExpr("doc_id as conv_id", "doc_id as turn", "'user' as role", "text")).count() == 0
    assert attention_scores(none.selectExpr("doc_id", "text", "true as training"), RANKS).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, against plain loops over the same rows."""
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "decontamination", "tokens"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = [(9001, "Ein \ufffd Zeichen " + PASSAGE, "de", "web", 9), (9002, "\ufffd davor " + PASSAGE + " ".join(f" danach{i}" for i in range(90)), "de", "web", 9), (9003, None, None, None, None), (9004, "a b c d e", "en", "web", 9), (9004, "a b c d e", "en", "web", 9), (9004, "quite another text", "en", "web", 9), (None, "a b c d e", "en", "web", 9)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in kept.collect()]
        kept = stage(spark, kept, DATA)
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        after = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) if "text" in kept.columns else None
        if name == "language_id":
            expected = [(i, t) for i, t in before if any(map(str.isalpha, t or ""))]
        elif name == "near_duplicates":
            sets, up = brute_components([(n, t) for n, (_, t) in enumerate(before)], 5, 80)
            least = {}
            for n, (i, _) in enumerate(before):
                rank = (i is None, i or 0)
                least[up[n]] = min(least.get(up[n], rank), rank)
            expected, seen = [], set()
            for n, (i, t) in enumerate(before):
                if (i is None, i or 0) == least[up[n]] and up[n] not in seen:
                    seen.add(up[n])
                    expected.append((i, t))
            assert len(after) == len(expected) and {i for i, _ in after} == {i for i, _ in expected}
            continue
        elif name == "repeated_passages":
            first = {}
            for i, t in sorted(before, key=lambda r: math.inf if r[0] is None else r[0]):
                b = t.encode()
                for p in range(len(b) - 99):
                    first.setdefault(b[p : p + 100], math.inf if i is None else i)
            expected = []
            for i, t in before:
                b = t.encode()
                gone = bytearray(len(b))
                for p in range(len(b) - 99):
                    if first[b[p : p + 100]] < (math.inf if i is None else i):
                        gone[p : p + 100] = b"\1" * 100
                left = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")
                if not any(gone) or left.strip(" "):
                    expected.append((i, left if any(gone) else t))
            assert any(t.startswith("\ufffd davor") and "shared3" not in t for _, t in after)
        elif name == "decontamination":
            def normal(t):
                return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in lower_text(t)).split(" ")
            items = [[w for w in normal(r.text) if w] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            grams = {tuple(w[p : p + min(10, len(w))]) for w in items for p in range(len(w) - min(10, len(w)) + 1)}
            expected = []
            for i, t in before:
                w = [x for x in normal(t) if x]
                if not any(tuple(w[p : p + n]) in grams for n in {len(g) for g in grams} for p in range(len(w) - n + 1)):
                    expected.append((i, t))
        else:
            assert kept.count() == len(before)
            continue
        assert after == sorted(expected, key=repr)
