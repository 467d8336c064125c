"""Operator 4: n-gram Jaccard join as a blocked sparse product of documents by n-grams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import REQUEST, Texts, checkpointed, grouped, slices, squeeze, unsqueeze, with_ids
from millrace.llm.components import components
from millrace.llm.symbols import mix, word_hashes, words_of

#: Counters of the sketch of n-gram frequencies (a power of two), in slices: a fixed size, whatever the corpus.
COUNTERS, SLICES = 1 << 20, 16
#: Entries of the incidence matrix in one block of columns.
BLOCK_ENTRIES = 400_000
#: Columns of so many documents have all their open pairs listed at once. In larger ones a document is held against so
#: many neighbours in a random order, before all open pairs are.
NEAR = 32
#: Bits of a set's parity sketch, for sets of as many n-grams; larger sets have a finer one besides, of about one bit for
#: each n-gram. Two sketches differ in no more bits than the sets do in n-grams.
PARITY_BITS = 512
#: Entries, each with its document's sketch, in one block of columns that are still open.
OPEN_ENTRIES = 100_000
#: Documents whose pairs one task compares, at least.
TASK_IDS = 500
#: Most documents whose ids are broadcast to fetch their n-grams; more are joined.
BROADCAST_IDS = 1_000_000
_WEIGHTS = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: Texts, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct n-word shingles as sorted 64-bit hashes; fewer words are one shingle."""
    starts, ends, bounds = words_of(texts.data, texts.bounds)
    words = word_hashes(texts.data, starts, ends, lower=True)
    if len(words) >= n:
        total = words[: len(words) - n + 1] * _WEIGHTS[0]
        for j in range(1, n):
            total = total + words[j : len(words) - n + 1 + j] * _WEIGHTS[j]
        shingles = mix(total)
    for lo, hi in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        if hi - lo >= n:
            yield np.unique(shingles[lo : hi - n + 1])
        elif hi > lo:
            own = words[lo:hi]
            yield mix((own * _WEIGHTS[: hi - lo]).sum(keepdims=True, dtype=np.uint64) + np.uint64(hi - lo))
        else:
            yield np.zeros(0, np.uint64)


def frequency_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents have an n-gram, as the logarithm of a count for each value of its first bits."""
    width = COUNTERS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in slices(batch):
                sets = [s for s in shingle_sets(Texts(part), n) if len(s)]
                if sets:
                    at = (np.concatenate(sets) >> np.uint64(44)).astype(np.int64)
                    counts += np.bincount(at, minlength=COUNTERS)
        for i in range(SLICES):
            own = counts[i * width : (i + 1) * width]
            if own.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "payload": [squeeze(own)]})

    def add(table: pa.Table) -> pa.Table:
        total = sum(unsqueeze(p.as_py())[0] for p in table.column("payload"))
        level = np.ceil(np.log2(1 + total)).astype(np.uint8)
        return pa.table({"slice": table.column("slice")[:1], "payload": pa.array([squeeze(level)], pa.binary())})

    kind = "slice int, payload binary"
    out = np.zeros(COUNTERS, np.uint8)
    for row in docs.select("text").mapInArrow(count, kind).groupBy("slice").applyInArrow(add, kind).collect():
        out[row["slice"] * width : (row["slice"] + 1) * width] = unsqueeze(row.payload)[0]
    return out


def parity(own: np.ndarray, bits: int) -> bytes:
    """For each value of the last bits of some hashes, whether an odd number of them have it."""
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, at the size of the smaller."""
    x, y = (np.frombuffer(v, np.uint64) for v in sorted((x, y), key=len))
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)))).sum(dtype=np.int64))


def features(docs: DataFrame, n: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(doc_id, n_shingles, sig, prefix, odd, fine): the set's size, a digest of it, its rarest n-grams (so many that two
    sets that agree enough share one of them), and its parity sketches (fine: null for small sets)."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value.astype(np.uint64) << np.uint64(56)
        for batch in batches:
            for part in slices(batch):
                sizes, sigs, prefixes, odds, fine = [], [], [], [], []
                for own in shingle_sets(Texts(part), n):
                    keys = level[(own >> np.uint64(44)).astype(np.int64)] | (own >> np.uint64(8))
                    keep = len(own) - (percent * len(own) + 99) // 100 + 1 if len(own) else 0
                    first = np.sort(np.partition(keys, keep - 1)[:keep]) if 0 < keep < len(keys) else np.sort(keys)
                    sizes.append(len(own))
                    sigs.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    prefixes.append(first.tobytes())
                    odds.append(parity(own, PARITY_BITS))
                    fine.append(parity(own, 1 << (len(own) - 1).bit_length()) if len(own) > PARITY_BITS else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (sigs, prefixes, odds, fine))],
                    ["doc_id", "n_shingles", "sig", "prefix", "odd", "fine"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, sig binary, prefix binary, odd binary, fine binary")


def packed(own: np.ndarray) -> bytes:
    """A sorted set as steps between the first 48 bits of its hashes."""
    return squeeze(np.diff(own >> np.uint64(16), prepend=np.uint64(0)))


def unpacked(payload: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(payload)[0], dtype=np.uint64)


def alike(na: np.ndarray, nb: np.ndarray, overlap: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes with such an overlap, or one of at most this, reach the similarity."""
    return 100 * overlap >= percent * (na + nb - overlap)


def block_pairs(keys, nodes, sizes, places, percent: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pairs of neighbours by size in the columns of one block, with how many columns they share, after the bounds;
    and all entries of columns that have documents of like size, with how many entries the column has."""
    order = np.lexsort((nodes, sizes, keys))
    keys, nodes, sizes, places = keys[order], nodes[order], sizes[order], places[order]
    left, right = [], []
    for step in (1, 2):
        near = np.flatnonzero(keys[:-step] == keys[step:]) if len(keys) > step else np.zeros(0, np.int64)
        left.append(near)
        right.append(near + step)
    i, j = np.concatenate(left), np.concatenate(right)
    rest = np.minimum(sizes[i] - places[i], sizes[j] - places[j])
    good = (nodes[i] != nodes[j]) & alike(sizes[i], sizes[j], np.minimum(rest, sizes[i]), percent)
    i, j = i[good], j[good]
    a, b = np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j])
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    joined = (keys[1:] == keys[:-1]) & alike(sizes[1:], sizes[:-1], np.minimum(sizes[1:], sizes[:-1]), percent)
    open_ = np.concatenate([[False], joined]) | np.concatenate([joined, [False]]) if len(keys) else np.zeros(0, bool)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    each = np.diff(np.append(starts, len(keys)))
    many = np.repeat(each, each)
    return [a[new], b[new], np.diff(np.append(new, len(a)))], [x[open_] for x in (keys, nodes, sizes, places, many)]


ENTRY = "a long, b long, shared long, gram long, size long, place long"


def candidate_pairs(reps: DataFrame, percent: int) -> DataFrame:
    """The product of the incidence matrix of rare n-grams with its transpose, in blocks of columns: of the pairs in a
    column, in order of size, the neighbours (a, b, shared); and the entries (gram, a, size, place) that may make more, shared being
    how many the column has."""
    entries = reps.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    parts = max(8, -(-int(entries) // 8 // BLOCK_ENTRIES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [p.as_py() for p in batch.column("prefix")]
            keys = np.frombuffer(b"".join(raw), np.uint64)
            counts = np.array([len(p) // 8 for p in raw], np.int64)
            row = np.repeat(np.arange(len(raw)), counts)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)
            part = (mix(keys) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((keys, part))
            nodes, sizes = batch.column("node").to_numpy(), batch.column("n_shingles").to_numpy()
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = []
            for p, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if hi > lo:
                    o = order[lo:hi]
                    step = np.diff(keys[o], prepend=np.uint64(0))
                    rows.append((p, "", squeeze(step, nodes[row[o]], sizes[row[o]].astype(np.int32), place[o].astype(np.int32))))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            kinds = (pa.int32(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "chunk", "payload"])

    def multiply(table: pa.Table) -> pa.Table:
        parts = [unsqueeze(p.as_py()) for p in table.column("payload")]
        keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        nodes, sizes, places = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 2, 3))
        (a, b, shared), (gram, node, size, place, many) = block_pairs(keys, nodes, sizes, places, percent)
        none = lambda n: pa.nulls(n, pa.int64())
        pairs = pa.table([pa.array(a), pa.array(b), pa.array(shared), none(len(a)), none(len(a)), none(len(a))], names=ENTRY_NAMES)
        wide = pa.table([pa.array(node), none(len(node)), pa.array(many), pa.array(gram.view(np.int64)), pa.array(size), pa.array(place)], names=ENTRY_NAMES)
        return pa.concat_tables([pairs, wide])

    blocks = reps.select("node", "n_shingles", "prefix").mapInArrow(send, REQUEST)
    return checkpointed(grouped(blocks, parts).applyInArrow(multiply, ENTRY))


ENTRY_NAMES = [c.split()[0] for c in ENTRY.split(", ")]


def close(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b, apart): of pairs those whose parity sketches allow the similarity, and in how many bits these differ."""
    for side in ("a", "b"):
        sketch = F.coalesce("fine", "odd").alias(f"odd_{side}")
        pairs = pairs.join(reps.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), sketch), side)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            found = np.array([apart(x.as_py(), y.as_py()) for x, y in zip(batch.column("odd_a"), batch.column("odd_b"), strict=True)], np.int64)
            good = pa.array(alike(na, nb, (na + nb - found) // 2, percent))
            yield pa.RecordBatch.from_arrays([*batch.select(["a", "b"]).columns, pa.array(found)], ["a", "b", "apart"]).filter(good)

    return pairs.select("a", "b", "n_a", "n_b", "odd_a", "odd_b").mapInArrow(compare, "a long, b long, apart long")


def best_of(pairs: DataFrame) -> DataFrame:
    """(a, b): for each document of some pairs the one that it is least apart from."""
    both = pairs.select("a", "b", "apart").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
    chosen = both.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("to"))
    return chosen.select(F.least("a", "to.b").alias("a"), F.greatest("a", "to.b").alias("b")).distinct()


def labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries with the component that their document is known to be of."""
    return entries.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("component", "a")).drop("component")


def small_columns(entries: DataFrame, percent: int, blocks: int) -> DataFrame:
    """All pairs (a, b) in a column, within the bounds of size and place, of documents not yet of one component."""

    def pair(table: pa.Table) -> pa.Table:
        gram, node, size, place, label = (table.column(c).to_numpy() for c in ("gram", "a", "size", "place", "label"))
        order = np.lexsort((size, gram))
        gram, node, size, place, label = gram[order], node[order], size[order], place[order], label[order]
        found, left, step = [], np.arange(len(order)), 1
        while len(left):
            left = left[left + step < len(order)]
            left = left[(gram[left] == gram[left + step]) & (percent * size[left + step] <= 100 * size[left])]
            i, j = left, left + step
            good = (label[i] != label[j]) & alike(size[i], size[j], np.minimum(size[i] - place[i], size[j] - place[j]), percent)
            found.append((np.minimum(node[i], node[j])[good], np.maximum(node[i], node[j])[good]))
            step += 1
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        new = np.unique(np.stack([a, b]), axis=1)
        return pa.table({"a": pa.array(new[0]), "b": pa.array(new[1])})

    own = entries.select(F.pmod("gram", F.lit(blocks)).alias("block"), "gram", "a", "size", "place", "label")
    return own.groupBy("block").applyInArrow(pair, "a long, b long").distinct()


def large_columns(entries: DataFrame, reps: DataFrame, percent: int, seed: int | None) -> DataFrame:
    """Pairs (a, b, apart) in large columns, within the bounds of size, place and sketches, of documents not yet of one
    component: all of them, or, with a seed, for each document the least apart of its neighbours in a random order, which
    joins most of a large group of near copies.

    A column above OPEN_ENTRIES is dealt over several blocks. With a seed, each has a random share of it. Without, each
    has a share of its largest component and all others: pairs of these others are the first block's, and there are none
    inside the component.
    """
    mixed = entries.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("gram")
    own = entries.join(mixed, "gram", "left_semi")
    deals = F.ceil(F.col("shared") / OPEN_ENTRIES).cast("int")
    share = F.pmod(F.xxhash64("a", F.lit(seed or 0)), deals).cast("int")
    if seed is None:
        hot = own.where(f"shared > {OPEN_ENTRIES}").groupBy("gram", "label").agg(F.count("*").alias("k"))
        own = own.join(hot.groupBy("gram").agg(F.max_by("label", F.struct("k", "label")).alias("most")), "gram", "left")
        own = own.withColumn("other", F.coalesce(F.col("label") != F.col("most"), F.lit(True)))
        share = F.explode(F.when(F.col("other"), F.sequence(F.lit(0), deals - 1)).otherwise(F.array(share)))
    else:
        own = own.withColumn("other", F.lit(False))
    own = checkpointed(own.select("gram", "a", "size", "place", "label", "other", share.alias("share")))
    blocks = max(8, -(-own.count() // OPEN_ENTRIES))
    own = own.join(reps.select(F.col("node").alias("a"), "odd"), "a").withColumn("block", F.pmod(F.xxhash64("gram", "share"), F.lit(blocks)))

    def pair(table: pa.Table) -> pa.Table:
        gram, node, size, place, label, share, other = (table.column(c).to_numpy() for c in ("gram", "a", "size", "place", "label", "share", "other"))
        odd = np.frombuffer(b"".join(x.as_py() for x in table.column("odd")), np.uint64).reshape(len(node), -1)
        chance = mix((node ^ gram).view(np.uint64) + np.uint64(seed or 0))
        order = np.lexsort((size if seed is None else chance, share, gram))
        gram, node, size, place, label, share, other, odd = (x[order] for x in (gram, node, size, place, label, share, other, odd))
        found, left, step = [(np.zeros(0, np.int64),) * 3], np.arange(len(order)), 1
        while len(left) and (seed is None or step <= NEAR):
            left = left[left + step < len(order)]
            left = left[(gram[left] == gram[left + step]) & (share[left] == share[left + step])]
            if seed is None:
                # In order of size, a document too large for this one is followed by larger ones only.
                left = left[percent * size[left + step] <= 100 * size[left]]
            i, j = left, left + step
            good = (label[i] != label[j]) & alike(size[i], size[j], np.minimum(size[i] - place[i], size[j] - place[j]), percent)
            good &= ~(other[i] & other[j] & (share[i] > 0))
            i, j = i[good], j[good]
            differ = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64)
            good = alike(size[i], size[j], (size[i] + size[j] - differ) // 2, percent)
            found.append((i[good], j[good], differ[good]))
            step += 1
        i, j, differ = (np.concatenate(x) for x in zip(*found, strict=True))
        if seed is not None:
            by = np.lexsort((differ, node[i]))
            best = by[np.flatnonzero(np.diff(node[i][by], prepend=-1))]
            i, j, differ = i[best], j[best], differ[best]
        return pa.table({"a": pa.array(np.minimum(node[i], node[j])), "b": pa.array(np.maximum(node[i], node[j])), "apart": pa.array(differ)})

    found = own.select("block", "gram", "a", "size", "place", "label", "share", "other", "odd").groupBy("block").applyInArrow(pair, "a long, b long, apart long")
    return found.distinct()


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose whole sets reach the similarity. Sets are fetched for these documents only."""
    ids = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    count = ids.count()
    few = count <= BROADCAST_IDS
    own = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [packed(s) for s in shingle_sets(Texts(part), n)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary())], ["node", "grams"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ga"), batch.column("gb"), strict=True):
                x, y = unpacked(x.as_py()), unpacked(y.as_py())
                both = np.sort(np.concatenate([x, y]), kind="stable")
                overlap = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(bool(alike(len(x), len(y), overlap, percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    grams = checkpointed(own.mapInArrow(sets, "node long, grams binary"))
    joined = pairs.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    joined = joined.join(grams.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    joined = joined.select("a", "b", "ga", "gb").coalesce(max(8, count // TASK_IDS))
    return checkpointed(joined.mapInArrow(compare, "a long, b long"))


def ngram_jaccard(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document: the size of its set of n-word shingles, and the least
    doc_id that links reach. Two documents link if their sets' Jaccard similarity is percent / 100 or more.

    Words are lower-cased in A-Z. A text of fewer words is one shingle; null, empty or blank text has none and links
    with nothing. Equal sets are one class, compared once. Rows of one doc_id count as one document and each gets
    its own n_shingles; a null doc_id is its own, null component. An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = frequency_sketch(docs, n)
    found = checkpointed(features(docs, n, percent, sketch))
    classes = checkpointed(found.where("n_shingles > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("node")))
    reps = found.join(classes, "sig").where("doc_id = node").dropDuplicates(["sig"])
    reps = checkpointed(reps.select("node", "n_shingles", "prefix", "odd", "fine"))
    entries = candidate_pairs(reps, percent)
    links = None

    def verify(pairs: DataFrame) -> DataFrame:
        """The components that the links so far make with those among some pairs."""
        nonlocal links
        more = verified(checkpointed(pairs.select("a", "b")), docs, n, percent)
        labels = components(more if links is None else links.unionByName(more))
        # Stars say what all links so far say, in fewer rows and partitions.
        links = labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        return labels

    labels = verify(best_of(checkpointed(close(entries.where("b is not null").select("a", "b").distinct(), reps, percent))))
    entries = entries.where("gram is not null").select("gram", "a", "size", "place", "shared")
    small, large = entries.where(F.col("shared") <= NEAR), entries.where(F.col("shared") > NEAR)
    blocks = max(8, -(-small.count() // OPEN_ENTRIES))
    labels = verify(close(small_columns(labelled(small, labels), percent, blocks), reps, percent))
    for seed in (1, 2, None) if not large.isEmpty() else ():
        pairs = large_columns(labelled(large, labels), reps, percent, seed)
        pairs = close(pairs.select("a", "b").distinct(), reps, percent)
        labels = verify(pairs if seed is None else best_of(checkpointed(pairs)))
    own = found.select("doc_id", F.col("sig").alias("own"))
    doubles = own.join(classes, own.own == classes.sig).where("doc_id <> node")
    repeated = doubles.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    bridges = doubles.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    labels = components(links.unionByName(bridges))
    out = found.select("doc_id", "n_shingles", "sig").join(classes, "sig", "left")
    out = out.join(labels, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = with_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return ngram_jaccard(docs, 3, 90)


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS node, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY 1, 3),
grams AS (SELECT node, n, unnest(s) AS g FROM classes),
links AS (
  SELECT x.node AS a, y.node AS b FROM grams x JOIN grams y ON x.g = y.g AND x.node < y.node
  AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
least_of AS (SELECT a AS node, least(min(b), a) AS component FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(l.component, c.node, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON len(s.s) > 0 AND list_sort(s.s) = c.s LEFT JOIN least_of l ON l.node = c.node
"""
