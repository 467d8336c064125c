"""A few of many notes for a context: without near copies, with some of every kind, the best first."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.vectors import ordered_independent
from millrace.sources.shared import settled
from millrace.sources.tables import table

#: When word sets are near copies, words that turn a note's sense, half-lives in days, the least of age's factor.
CONTAINED, JACCARD = 0.85, 0.72
NEGATIONS = ("nicht", "kein", "keine", "nie", "not", "no", "never")
HALF_LIFE, LONG_LIFE, LEAST_AGE = 180.0, 365.0, 0.35
#: What word sets of near copies share at least, of the smaller: by containment, or as follows from the Jaccard bound.
SHARED = min(CONTAINED, 2 * JACCARD / (1 + JACCARD))
#: Words of the sets of a share at most, where a set counts as some words more; words of a share, up to so many shares, where there are few.
SHARE, PART, FEW, EACH = 8_000_000, 1_000_000, 3, 16
#: Words with a short number; about so many sets they are counted in; bits of a sketch; cells of candidates that are marked at once.
COMMON, SAMPLED, BITS, CELLS = 65_536, 20_000, 1024, 4_000_000


def note_score(confidence: Column, mentions: Column, age_days: Column, half_life: Column, relevance: Column) -> Column:
    """Confidence by mentions, less with age, more if it is on the question."""
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.0))))
    age = F.when(age_days.isNull() | half_life.isNull(), 1.0).otherwise(F.greatest(F.lit(LEAST_AGE), F.exp(-F.log(F.lit(2.0)) * F.greatest(age_days, F.lit(0.0)) / half_life)))
    return bounded * (1 + F.log1p(F.greatest(mentions, F.lit(1)))) * age * (1 + 0.75 * relevance)


def near_word_sets(rows: DataFrame) -> DataFrame:
    """(a, b): items (group, item, words) of a group whose word sets are near copies: one holds 85 % of the smaller, or they overlap by
    72 %, and they agree in negations. Sets are distinct: equal ones should be one item.

    Exact, with words by 64-bit hashes; those that are frequent in a bounded sample of sets go by a number of 16 bits. Sets of a group that agree in
    negations are dealt into shares, each two of which meet in one task, whole: a set goes once to each share, and only near pairs leave the task, so
    that no candidate is ever shuffled."""
    return met_word_sets(word_sets(rows.select("group", "item", "words")))


def word_sets(rows: DataFrame) -> DataFrame:
    """Rows with their sets of words as numbers (common, hashes) and ``key``, within which these are compared, instead of their words; as a table."""
    words = F.array_distinct(F.coalesce("words", F.array().cast("array<string>")))
    turns = F.array_join(F.array_sort(F.array_intersect(words, F.array(*map(F.lit, NEGATIONS)))), " ")
    hashed = rows.withColumns({"key": F.struct("group", turns.alias("turns")), "hashes": F.transform(words, lambda w: F.xxhash64(w))}).drop("words")
    return settled(numbered(hashed, common_words(hashed, rows.count())))


def met_word_sets(sets: DataFrame) -> DataFrame:
    """(a, b): near copies among sets (key, item, common, hashes), as ``word_sets`` has them."""
    sized = sets.withColumn("size", F.size("common") + F.size("hashes")).where("size > 0")
    held = settled(sized.groupBy("key").agg(F.sum(F.col("size") + EACH).alias("held")))
    shares = F.greatest(F.ceil(F.col("held") / SHARE), F.least(F.lit(FEW), F.ceil(F.col("held") / PART))).cast("int")
    dealt = sized.join(held.select("key", shares.alias("shares")), "key").withColumn("own", F.pmod(F.xxhash64("item"), F.col("shares")).cast("int"))
    left = dealt.select("key", F.col("own").alias("s"), F.explode(F.sequence("own", F.col("shares") - 1)).alias("t"), "item", "common", "hashes")
    right = dealt.where("own > 0").select(F.col("key").alias("to_key"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("to_s"), F.col("own").alias("to_t"), F.col("item").alias("to_item"), F.col("common").alias("to_common"), F.col("hashes").alias("to_hashes"))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        met = []
        if x.num_rows:
            alone = x.column("s")[0] == x.column("t")[0]
            x = WordSets(x.column("item"), x.column("common"), x.column("hashes"))
            if alone:
                met = [near_of(x, x)]
            elif y.num_rows:
                y = WordSets(y.column("to_item"), y.column("to_common"), y.column("to_hashes"))
                met = [near_of(x, y), near_of(y, x)]
        return pa.table({c: np.concatenate([np.zeros(0, np.int64), *(m[i] for m in met)]) for i, c in enumerate("ab")})

    return left.groupBy("key", "s", "t").cogroup(right.groupBy("to_key", "to_s", "to_t")).applyInArrow(run, "a long, b long")


def common_words(sized: DataFrame, sets: int) -> np.ndarray:
    """Hashes of the words that most sets of a sample have, 65,536 at most, in their order. Which these are bears on size and speed only."""
    some = sized.where(F.pmod(F.xxhash64("item"), F.lit(max(1, sets // SAMPLED))) == 0)
    counts = some.select(F.explode("hashes").alias("word")).groupBy("word").count().where("count > 1")
    return np.sort(np.array([r.word for r in counts.orderBy(F.desc("count"), "word").limit(COMMON).collect()], np.int64))


def numbered(rows: DataFrame, known: np.ndarray) -> DataFrame:
    """Rows with ``common``, the places of known words, which ``hashes`` then has no more."""
    schema = rows.drop("hashes").withColumns({"common": F.array().cast("array<smallint>"), "hashes": F.array().cast("array<bigint>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, flat = pc.list_value_length(batch.column("hashes")).to_numpy(), pc.list_flatten(batch.column("hashes")).to_numpy()
            at = np.searchsorted(known, flat)
            hit = known[np.minimum(at, len(known) - 1)] == flat if len(known) else np.zeros(len(flat), bool)
            ends = np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(sizes)])]
            common = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[hit].astype(np.uint16).view(np.int16)))
            rest = pa.ListArray.from_arrays(pa.array((np.concatenate([[0], np.cumsum(sizes)]) - ends).astype(np.int32)), pa.array(flat[~hit]))
            made = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"common": common, "hashes": rest}
            yield pa.RecordBatch.from_arrays([made[f.name] for f in schema], schema.names)

    return rows.mapInArrow(run, schema)


class WordSets:
    """Sets of words of one share, from the least to the largest: numbers of common words and hashes of others, each set's in a row."""

    def __init__(self, items: pa.ChunkedArray, common: pa.ChunkedArray, hashes: pa.ChunkedArray):
        ids = items.to_numpy().astype(np.int64)
        lengths = [pc.list_value_length(c).to_numpy().astype(np.int64) for c in (common, hashes)]
        order = np.lexsort((ids, lengths[0] + lengths[1]))
        self.ids, self.sizes = ids[order], (lengths[0] + lengths[1])[order]
        self.parts, self.ends = [], []
        for column, length, kind in zip((common, hashes), lengths, (np.uint16, np.int64), strict=True):
            starts = (np.cumsum(length) - length)[order]
            flat = pc.list_flatten(column).to_numpy().view(kind)
            out, length = np.empty(len(flat), kind), length[order]
            ends = np.concatenate([[0], np.cumsum(length)])
            for rows in _parted(length):
                out[ends[rows.start] : ends[rows.stop]] = flat[_ranges(starts[rows], length[rows])]
            self.parts.append(out)
            self.ends.append(ends)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.missing = self.sizes - np.ceil(self.sizes * SHARED - 1e-9).astype(np.int64)

    def words(self, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of these sets: the common words and the others, and where each of them stands if a set has its common ones first."""
        (common, rare), (c, r) = self.parts, self.ends
        first = self.first[rows] - self.first[rows.start]
        known, rest = np.diff(c[rows.start : rows.stop + 1]), np.diff(r[rows.start : rows.stop + 1])
        return common[c[rows.start] : c[rows.stop]], rare[r[rows.start] : r[rows.stop]], _ranges(first, known), _ranges(first + known, rest)

    def sketches(self, rows: slice) -> np.ndarray:
        out = np.empty((rows.stop - rows.start, BITS // 64), np.uint64)
        for i in range(rows.start, rows.stop, 4096):
            part = slice(i, min(i + 4096, rows.stop))
            common, rare, *at = self.words(part)
            owner, held = np.repeat(np.arange(part.stop - i), self.sizes[part]), np.zeros((part.stop - i, BITS), bool)
            for values, places in zip((common, rare), at, strict=True):
                held[owner[places], (values & values.dtype.type(BITS - 1)).astype(np.int64)] = True
            out[i - rows.start : part.stop - rows.start] = np.packbits(held, axis=1).view(np.uint64)
        return out


class WordIndex:
    """Sets with their words as numbers of the share: by set, and by word the places of the sets that have it, sorted."""

    def __init__(self, sets: WordSets):
        self.known, whole = np.unique(sets.parts[1]), slice(0, len(sets.ids))
        self.codes, self.sketches = np.empty(sets.first[-1], np.int32), sets.sketches(whole)
        key = np.empty(len(self.codes), np.int64)
        for rows in _parted(sets.sizes):
            at = slice(sets.first[rows.start], sets.first[rows.stop])
            self.codes[at] = self.coded(sets, rows)
            key[at] = self.codes[at].astype(np.int64) << 32 | np.repeat(np.arange(rows.start, rows.stop), sets.sizes[rows])
        key.sort()
        self.owners = (key.view(np.int32)[::2] if sys.byteorder == "little" else key.view(np.int32)[1::2]).copy()
        del key
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.codes, minlength=COMMON + len(self.known)))])
        # Cells of each set, a power of two of four times its words at least: which of them its words fall into.
        self.width = np.int64(1) << np.ceil(np.log2(4 * sets.sizes)).astype(np.int64)
        self.begin = np.cumsum(self.width) - self.width
        self.cells = np.zeros(self.width.sum(), bool)
        for rows in _parted(sets.sizes):
            size = sets.sizes[rows]
            self.cells[np.repeat(self.begin[rows], size) + (self.codes[sets.first[rows.start] : sets.first[rows.stop]] & np.repeat(self.width[rows] - 1, size))] = True

    def coded(self, sets: WordSets, rows: slice) -> np.ndarray:
        """Numbers of the words of these sets; those that the share doesn't have are -1."""
        common, rare, known, rest = sets.words(rows)
        out = np.full(len(common) + len(rare), -1, np.int32)
        out[known] = common
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, rare), len(self.known) - 1)
            out[rest] = np.where(self.known[at] == rare, at + COMMON, -1)
        return out

    def holding(self, places: np.ndarray, code: np.ndarray, least: int) -> np.ndarray:
        """Of these sets those that may have so many of the words, and all that have them."""
        code = code[code >= 0]
        if len(code) < least:
            return places[:0]
        step, found = max(1, 500_000 // max(1, len(code))), [places[:0]]
        for k in range(0, len(places), step):
            to = places[k : k + step]
            found.append(to[np.count_nonzero(self.cells[self.begin[to, None] + (code & (self.width[to, None] - 1))], axis=1) >= least])
        return np.concatenate(found)


def near_of(x: WordSets, y: WordSets) -> tuple[np.ndarray, np.ndarray]:
    """Ids of near copies of which the smaller (ties: the lesser id) is in x, the larger in y. A set's words that are rarest in y, so many that no near
    copy can miss all of them, name the candidates; words that the larger one's sketch, then its cells have not rule most of these out."""
    none = np.zeros(0, np.int64)
    n = len(y.ids)
    if not n or not len(x.ids):
        return none, none
    index, met = WordIndex(y), ([], [])
    marks = np.zeros(len(index.starts), np.uint8)
    # The first of y's sets that are larger.
    larger, last = np.searchsorted(y.sizes, x.sizes, "left"), np.searchsorted(y.sizes, x.sizes, "right")
    for i in np.nonzero(larger < last)[0]:
        larger[i] += np.searchsorted(y.ids[larger[i] : last[i]], x.ids[i], "right")
    for rows in _parted(x.sizes + 1_000_000 * n // CELLS, 1_000_000):
        code, sizes, missing = index.coded(x, rows), x.sizes[rows], x.missing[rows]
        owner, first = np.repeat(np.arange(len(sizes)), sizes), x.first[rows] - x.first[rows.start]
        df = np.where(code >= 0, index.starts[code + 1] - index.starts[code], 0)
        order = np.argsort((owner << 32) + df)
        rare = order[(np.arange(len(order)) - first[owner] <= missing[owner]) & (df[order] > 0)]
        pairs = _candidates(index, code[rare], df[rare], owner[rare], larger[rows], len(sizes), n)
        if not len(pairs):
            continue
        sketches = x.sketches(rows)
        a, b = pairs // n, pairs % n
        fits = np.concatenate([np.bitwise_count(sketches[a[i : i + 8192]] & ~index.sketches[b[i : i + 8192]]).sum(axis=1, dtype=np.int64) <= missing[a[i : i + 8192]] for i in range(0, len(a), 8192)])
        a, b = a[fits], b[fits]
        turns = np.concatenate([[0], np.nonzero(np.diff(a))[0] + 1, [len(a)]]) if len(a) else [0]
        for i, j in zip(turns[:-1], turns[1:], strict=True):
            at, size, miss = first[a[i]], sizes[a[i]], missing[a[i]]
            own, may = code[order[at : at + size]], b[i:j]
            for most in (min(size, 2 * miss + 1), size):
                may = index.holding(may, own[:most], most - miss)
            own = own[own >= 0]
            marks[own] = 1
            for part in _parted(y.sizes[may], 1_000_000):
                to = may[part]
                held = y.sizes[to]
                both = np.add.reduceat(marks[index.codes[_ranges(y.first[to], held)]], np.cumsum(held) - held, dtype=np.int64)
                to = to[(both / size >= CONTAINED) | (both / (size + held - both) >= JACCARD)]
                met[0].append(np.full(len(to), x.ids[rows.start + a[i]]))
                met[1].append(y.ids[to])
            marks[own] = 0
    return tuple(np.concatenate([none, *m]) for m in met)


def _candidates(index: WordIndex, code: np.ndarray, df: np.ndarray, owner: np.ndarray, larger: np.ndarray, sets: int, n: int) -> np.ndarray:
    """owner * n + place, sorted, each once: sets of the index, from ``larger`` on, that have a word of an owner."""
    few = df.sum() < sets * n // 64
    marked, found = np.zeros(0 if few else sets * n, bool), [np.zeros(0, np.int64)]
    for part in _parted(df):
        to, own = index.owners[_ranges(index.starts[code[part]], df[part])], np.repeat(owner[part], df[part])
        fits = to >= larger[own]
        pairs = own[fits] * n + to[fits]
        if few:
            found.append(pairs)
        else:
            marked[pairs] = True
    return np.unique(np.concatenate(found)) if few else np.flatnonzero(marked)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers from each first one on, so many as are counted."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


def _parted(count: np.ndarray, most: int = 2_000_000) -> Iterator[slice]:
    """Slices of rows of about ``most`` counted things, or one row."""
    ends = np.cumsum(count)
    start = 0
    while start < len(count):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield slice(start, stop)
        start = stop


def distinct_notes(rows: DataFrame) -> DataFrame:
    """Notes (group, item, score, words) that stay if one goes through each group by score (ties: the least item) and leaves out near copies
    of what stays. Equal word sets are one, of the best note; the rest is rounds over near pairs, so a group may be the whole table.
    Notes without words stay."""
    same = F.sha2(F.concat_ws("\x1f", F.array_sort(F.array_distinct("words"))), 256)
    sets = word_sets(rows.select("group", "item", "score", "words", same.alias("same")))
    empty = F.size("common") + F.size("hashes") == 0
    first = Window.partitionBy("group", "same").orderBy(F.desc("score"), "item")
    one = settled(sets.where(~empty).select("group", "same", "score", "item").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("item", "score"))
    place = one.select("item", F.struct(F.negative("score").alias("score"), "item").alias("place"))
    kept = ordered_independent(place, met_word_sets(sets.select("key", "item", "common", "hashes").join(one.select("item"), "item", "left_semi")))
    return rows.join(kept.select("item").unionByName(sets.where(empty).select("item")), "item", "left_semi")


def covering(rows: DataFrame, n: int, first: tuple[str, ...]) -> DataFrame:
    """n notes of each group with their place: the best of each category of ``first``, then the best of each type that isn't chosen yet, in
    the order of their names, then by score."""
    order = (F.desc("score"), "item")
    of = lambda *keys: F.row_number().over(Window.partitionBy("group", *keys).orderBy(*order))
    listed = F.array_position(F.array(*map(F.lit, first)), F.col("category"))
    rows = rows.withColumn("by_category", F.when((listed > 0) & (of("category") == 1), listed))
    rows = rows.withColumn("chosen", F.col("by_category").isNotNull())
    typed = F.row_number().over(Window.partitionBy("group", "type", "chosen").orderBy(*order))
    rows = rows.withColumn("by_type", F.when(~F.col("chosen") & (F.coalesce("type", F.lit("")) != "") & (typed == 1), F.col("type")))
    step = F.when(F.col("chosen"), 0).when(F.col("by_type").isNotNull(), 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("group").orderBy(step, F.coalesce("by_category", F.lit(0)), F.coalesce("by_type", F.lit("")), *order))
    return rows.withColumn("place", place).where(F.col("place") <= n).drop("by_category", "by_type", "chosen")


def hybrid_selection(rows: DataFrame, n: int, first: tuple[str, ...]) -> DataFrame:
    """(group, item, place): ``covering`` of ``distinct_notes``: rows have group, item, score, words, category and type."""
    return covering(distinct_notes(rows), n, first).select("group", "item", "place")


def _notes(s, d):
    """Documents as notes of a language: every word of theirs, by source and length; each also shouted, and with a word more."""
    docs = table(s, d, "documents")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0))
    score = note_score(F.col("doc_id") % 100 / 100, F.col("n_chars") % 9, (F.col("doc_id") % 400).cast("double"), F.when(F.col("doc_id") % 3 == 0, HALF_LIFE).otherwise(LONG_LIFE), F.lit(0.0))
    rows = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("item"), F.round(score, 6).alias("score"), words.alias("words"), F.col("source").alias("category"), F.concat(F.lit("t"), F.col("doc_id") % 4).alias("type"))
    more = rows.where("item % 5 = 0").withColumns({"item": F.col("item") + 10_000_000, "words": F.array_append("words", F.lit("besides")), "score": F.round(F.col("score") * 0.9, 6)})
    turned = rows.where("item % 10 = 1").withColumns({"item": F.col("item") + 20_000_000, "words": F.array_union("words", F.array(F.lit("not")))})
    return rows.unionByName(more).unionByName(turned)


QUERIES = {
    "distinct_notes": lambda s, d: distinct_notes(_notes(s, d)).select("group", "item"),
    "hybrid_selection": lambda s, d: hybrid_selection(_notes(s, d), 20, ("src1", "src2", "src3")),
}
ORACLE_SQL: dict[str, str] = {}
