"""Operator 11: hard negatives by a dual-tree search over anchors and candidates.

Equal vectors of one label are one point, with the least ids of its rows: no more of them can be among the first. A tree of
hyperplanes, fitted on a bounded sample, deals points into cells and cells into blocks of bounded size; a block is stored in
the order of a balanced tree, whose nodes are balls. The inner products of two balls lie in an interval around that of their
centres, so whole groups of anchors drop whole groups of candidates, first by cell, then down both trees; leaves that are left are
scored exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.chunks import checkpointed, rows_of, squeeze, unsqueeze

#: Points of a block of candidates, of anchors, and of a leaf; levels of the tree of cells at most; points that it is fitted on.
BLOCK, ANCHOR_BLOCK, LEAF, MOST_LEVELS, SAMPLE = 4096, 1024, 64, 10, 8192
#: Leaves that are scored at once, best first, before bounds are looked at again.
AT_ONCE = 8
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Intervals are this much wider, relative to the norms, than computed in floating point.
SLACK = 1e-9
FOUND = "block long, place int, a long, which int, score long, id long"
FOUND_ARROW = pa.schema(
    [("block", pa.int64()), ("place", pa.int32()), ("a", pa.int64()), ("which", pa.int32()), ("score", pa.int64()), ("id", pa.int64())]
)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable_rows(embeddings: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, vec) with whole numbers: one row for each vec_id (of several the least label and vector), without rows
    that have a null id, label, vector or component, an empty vector, or a component that isn't finite."""
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x")
    )
    finite = F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & finite)
    rows = rows.select("vec_id", F.struct("label", F.transform("x", lambda x: F.floor(x * 256)).alias("vec")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.vec")


class Cells:
    """Hyperplanes at the nodes of a balanced tree, and the centres of its leaves."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.planes = np.zeros((1 << levels, sample.shape[1]))
        self.cuts = np.zeros(1 << levels)
        self.centres = np.zeros((1 << levels, sample.shape[1]))
        groups = [np.arange(len(sample))]
        for level in range(levels):
            parted = []
            for at, own in enumerate(groups):
                node = (1 << level) + at
                if len(own):
                    x = sample[own]
                    away = x - x.mean(axis=0)
                    far = away[np.argmax((away**2).sum(axis=1))]
                    for _ in range(4):
                        far = (away * (away @ far)[:, None]).sum(axis=0)
                        far = far / max(float(np.linalg.norm(far)), 1e-300)
                    along = x @ far
                    self.planes[node], self.cuts[node] = far, np.median(along)
                    left = along <= self.cuts[node]
                    parted += [own[left], own[~left]]
                else:
                    parted += [own, own]
            groups = parted
        for at, own in enumerate(groups):
            self.centres[at] = sample[own].mean(axis=0) if len(own) else 0

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (np.einsum("ij,ij->i", x, self.planes[node]) > self.cuts[node])
        return node - (1 << self.levels)


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def in_order(x: np.ndarray) -> np.ndarray:
    """Rows in the order of a balanced tree that halves them along their widest axis, down to leaves."""

    def part(own: np.ndarray, levels: int) -> list[np.ndarray]:
        if not levels:
            return [own]
        axis = int(np.argmax(x[own].max(axis=0) - x[own].min(axis=0)))
        half = len(own) // 2
        own = own[np.argsort(x[own, axis], kind="stable")]
        return part(own[:half], levels - 1) + part(own[half:], levels - 1)

    return np.concatenate(part(np.arange(len(x)), depth(len(x))))


def depth(n: int) -> int:
    return max(0, (max(1, n // LEAF)).bit_length() - 1)


def halves(n: int, levels: int) -> np.ndarray:
    bounds = [0, n]
    for _ in range(levels):
        bounds = [b for a, z in zip(bounds, bounds[1:], strict=False) for b in (a, a + (z - a) // 2)] + [n]
    return np.array(bounds)


class Block:
    """Points in the order of their tree: vectors, labels, ids of rows (those of point i from cuts[i] to cuts[i + 1])."""

    def __init__(self, blob: bytes):
        flat, self.labels, self.cuts, self.ids = unsqueeze(blob)
        n = len(self.labels)
        self.x = flat.reshape(n, -1)
        self.largest = int(np.abs(self.x).max(initial=0))
        self.real = self.x.astype(np.float64)
        self.levels = depth(n)
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for level in range(self.levels + 1):
            bounds = halves(n, level)
            sizes = np.diff(bounds)
            centres = np.add.reduceat(self.real, bounds[:-1], axis=0) / sizes[:, None]
            away = ((self.real - np.repeat(centres, sizes, axis=0)) ** 2).sum(axis=1)
            self.nodes.append((bounds, centres, np.sqrt(np.maximum.reduceat(away, bounds[:-1]))))

    def at(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.nodes[min(level, self.levels)]


@lru_cache(maxsize=24)
def _block(blob: bytes) -> Block:
    return Block(blob)


def interval(centres: np.ndarray, radii: np.ndarray, others: np.ndarray, other_radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of any points of two balls, for all pairs of balls."""
    norms, other_norms = np.linalg.norm(centres, axis=1), np.linalg.norm(others, axis=1)
    middle = centres @ others.T
    wide = radii[:, None] * other_norms + norms[:, None] * other_radii + radii[:, None] * other_radii
    wide += SLACK * ((norms + radii)[:, None] * (other_norms + other_radii) + 1)
    return middle - wide, middle + wide


def products(a: Block, rows: slice, b: Block, at: np.ndarray) -> np.ndarray:
    most = a.x.shape[1] * a.largest * b.largest
    if most < 1 << 53:
        return (a.real[rows] @ b.real[at].T).astype(np.int64)
    if most >= 1 << 63:
        raise ValueError("components are too large for scores of 64 bits")
    return a.x[rows] @ b.x[at].T


def dual_tree(a: Block, least: np.ndarray, most: np.ndarray, b: Block, same: bool, take: int) -> list[tuple[int, int, int, int]]:
    """(place of the anchor, window, score, id) of the first ``take`` rows of b for each anchor and window, by score and then id.

    least, most: windows of each anchor, a row of each; rows of its label count if ``same``, else those of others. Nodes whose
    interval no window of any anchor below meets are dropped together.
    """
    least = least.copy()
    n, windows = least.shape
    held: list[list[list[tuple[int, int]]]] = [[[] for _ in range(windows)] for _ in range(n)]
    alive = np.ones((1, 1), bool)
    for level in range(max(a.levels, b.levels) + 1):
        a_bounds, centres, radii = a.at(level)
        b_bounds, others, other_radii = b.at(level)
        if level:
            alive = np.repeat(alive, 2, axis=0) if level <= a.levels else alive
            alive = np.repeat(alive, 2, axis=1) if level <= b.levels else alive
        low, high = interval(centres, radii, others, other_radii)
        floor = np.minimum.reduceat(least.min(axis=1), a_bounds[:-1])
        ceiling = np.maximum.reduceat(most.max(axis=1), a_bounds[:-1])
        alive = alive & (high >= floor[:, None]) & (low <= ceiling[:, None])
        if not alive.any():
            return []
    for leaf, (lo, hi) in enumerate(zip(a_bounds[:-1].tolist(), a_bounds[1:].tolist(), strict=True)):
        todo = np.flatnonzero(alive[leaf])
        todo = todo[np.argsort(-high[leaf, todo], kind="stable")]
        for first in range(0, len(todo), AT_ONCE):
            some = todo[first : first + AT_ONCE]
            some = some[high[leaf, some] >= least[lo:hi].min()]
            if not len(some):
                break
            at = np.concatenate([np.arange(b_bounds[i], b_bounds[i + 1]) for i in some])
            scores = products(a, slice(lo, hi), b, at)
            fits = (a.labels[lo:hi, None] == b.labels[at]) == same
            for j in range(windows):
                hit = fits & (scores >= least[lo:hi, j, None]) & (scores <= most[lo:hi, j, None])
                for row in np.flatnonzero(hit.any(axis=1)).tolist():
                    of = np.flatnonzero(hit[row])
                    order = np.lexsort((b.ids[b.cuts[at[of]]], -scores[row, of]))[:take]
                    best = held[lo + row][j]
                    for i in of[order].tolist():
                        best += [(-int(scores[row, i]), int(x)) for x in b.ids[b.cuts[at[i]] : b.cuts[at[i] + 1]]]
                    best.sort()
                    del best[take:]
                    if len(best) == take:
                        least[lo + row, j] = max(least[lo + row, j], -best[-1][0])
    return [(i, j, -score, x) for i, own in enumerate(held) for j, best in enumerate(own) for score, x in best]


def in_cells(points: DataFrame, cells: Cells) -> DataFrame:
    """Points (label, vec, ids) with the cell of each."""
    shared, dims = points.sparkSession.sparkContext.broadcast(cells), cells.planes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = shared.value.of(matrix(batch.column("vec"), dims).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    return checkpointed(points.mapInArrow(run, "label long, vec array<long>, ids array<long>, cell int"))


def in_blocks(points: DataFrame, cells: Cells, most: int) -> DataFrame:
    """Points in blocks of about ``most`` of one cell: (block, cell, radius, blob); the radius is about the cell's centre."""
    shared, dims = points.sparkSession.sparkContext.broadcast(cells), cells.planes.shape[1]
    found = dict(points.groupBy("cell").agg(F.count("*")).collect())
    blocks = F.array(*(F.lit(-(-found.get(i, 1) // most)) for i in range(1 << cells.levels)))
    salt = F.pmod(F.xxhash64("label", F.element_at("ids", 1)), F.element_at(blocks, F.col("cell") + 1))
    schema = pa.schema([("block", pa.int64()), ("cell", pa.int32()), ("radius", pa.float64()), ("blob", pa.binary())])

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        first = pc.list_element(table.column("ids"), 0).to_numpy()
        table = table.take(pa.array(np.argsort(first, kind="stable")))
        x = matrix(table.column("vec"), dims)
        order = in_order(x)
        cell = table.column("cell")[0].as_py()
        radius = float(np.sqrt(((x - shared.value.centres[cell]) ** 2).sum(axis=1).max()))
        table, x = table.take(pa.array(order)).combine_chunks(), x[order]
        ids = table.column("ids").combine_chunks()
        cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))])
        blob = squeeze(x.ravel(), table.column("label").to_numpy(), cuts, ids.flatten().to_numpy(zero_copy_only=False))
        return rows_of(schema, [(table.column("block")[0].as_py(), cell, radius, blob)])

    dealt = points.withColumn("block", F.shiftleft(F.col("cell").cast("long"), 32) + salt)
    return checkpointed(dealt.groupBy("block").applyInArrow(pack, "block long, cell int, radius double, blob binary"))


def visits(anchors: DataFrame, cells: Cells, radii: np.ndarray) -> DataFrame:
    """(block, cell) for each cell, other than its own, that has a score that some anchor of the block may still want."""
    shared = anchors.sparkSession.sparkContext.broadcast((cells.centres, radii))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, about = shared.value
        there = np.flatnonzero(about >= 0)
        for batch in batches:
            out: list[list[int]] = [[], []]
            for block, own, blob, windows in zip(*(batch.column(c).to_pylist() for c in ("block", "cell", "blob", "windows")), strict=True):
                _, middle, radius = _block(blob).at(0)
                least, most = unsqueeze(windows)
                low, high = interval(middle, radius, centres[there], about[there])
                go = there[(high[0] >= least.min()) & (low[0] <= most.max())]
                go = go[go != own].tolist()
                out[0] += [block] * len(go)
                out[1] += go
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32())], ["block", "cell"])

    return anchors.select("block", "cell", "blob", "windows").mapInArrow(run, "block long, cell int")


def searched(anchors: DataFrame, candidates: DataFrame, go: DataFrame, same: bool, take: int) -> DataFrame:
    """What each block of anchors finds in the blocks of the cells that it visits."""
    pairs = go.join(anchors.select("block", F.col("blob").alias("a_blob"), "windows"), "block")
    pairs = pairs.join(candidates.select("cell", "blob"), "cell").select("block", "a_blob", "windows", "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, a_blob, windows, blob = (c[i].as_py() for c in batch.columns)
                a = _block(a_blob)
                least, most = (w.reshape(len(a.labels), -1) for w in unsqueeze(windows))
                found = dual_tree(a, least, most, _block(blob), same, take)
                ids = a.ids.tolist()
                yield from rows_of(FOUND_ARROW, [(block, place, ids[place], j, score, x) for place, j, score, x in found]).to_batches()

    return pairs.mapInArrow(run, FOUND)


def best(found: DataFrame, take: int) -> DataFrame:
    """The first rows for each anchor and window, with their rank from 1."""
    order = Window.partitionBy("block", "place", "which").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)


def rounds(anchors: DataFrame, candidates: DataFrame, cells: Cells, radii: np.ndarray, same: bool, take: int) -> DataFrame:
    """The best rows of all candidates for each anchor and window: first from the anchors' own cell, whose scores bound what is
    then looked for in the other cells."""
    near = checkpointed(best(searched(anchors, candidates, anchors.select("block", "cell"), same, take), take))
    last = near.where(F.col("rank") == take).select("block", "place", "which", "score")

    def raised(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        least, most = unsqueeze(row["windows"])
        least = least.reshape(len(_block(row["blob"]).labels), -1).copy()
        at = tuple(right.column(c).to_numpy() for c in ("place", "which"))
        least[at] = np.maximum(least[at], right.column("score").to_numpy())
        row["windows"] = squeeze(least.ravel(), most)
        return pa.Table.from_pylist([row], left.schema)

    narrowed = anchors.groupBy("block").cogroup(last.groupBy("block")).applyInArrow(raised, anchors.schema)
    narrowed = checkpointed(narrowed)
    far = searched(narrowed, candidates, visits(narrowed, cells, radii), same, take)
    return checkpointed(best(near.drop("rank").unionByName(far), take))


def hard_negatives(
    embeddings: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, levels: int | None = None
) -> DataFrame:
    """The hardest wrong rows for each anchor and each of its best right ones.

    embeddings has vec_id, embedding and what ``label`` and ``anchors`` (a condition on vec_id) are made of; other columns
    don't matter. Components become floor(256 * x); a score is the inner product with the anchor, higher first, ties by vec_id.
    An anchor's positives are its first other rows of its label; for each of them the first rows of other labels with
    ``low * positive_score <= 100 * score <= high * positive_score`` are returned, ranked from 1. Rows with a null id, label,
    vector or component, an empty vector or a component that isn't finite take no part, nor do vectors of another
    length than most have; of rows of one vec_id the least (label, vector) counts. No rows give none. Components so large that
    a score has no 64 bits are an error. levels: of the tree of cells, for tests.
    """
    spark = embeddings.sparkSession
    rows = checkpointed(usable_rows(embeddings, label))
    lengths = rows.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if lengths is None:
        return spark.createDataFrame([], RESULT)
    rows = rows.where(F.size("vec") == lengths.dims)
    least = Window.partitionBy("label", "vec").orderBy("vec_id")
    first = rows.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= max(positives + 1, negatives))
    points = first.groupBy("label", "vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asking = rows.where(anchors)
    groups = checkpointed(asking.groupBy("label", "vec").agg(F.min("vec_id").alias("a")))

    if levels is None:
        levels = min(MOST_LEVELS, max(0, (-(-rows.count() // BLOCK) - 1).bit_length()))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").collect()
    cells = Cells(np.array([r.vec for r in sample], np.float64), levels)
    candidates = in_blocks(in_cells(points, cells), cells, BLOCK)
    radii = np.full(1 << levels, -1.0)
    for cell, radius in candidates.groupBy("cell").agg(F.max("radius")).collect():
        radii[cell] = radius
    blocks = in_blocks(in_cells(groups.select("label", "vec", F.array("a").alias("ids")), cells), cells, ANCHOR_BLOCK)

    def anything(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(_block(b).labels) for b in batch.column("blob").to_pylist()]
            windows = [squeeze(np.full(n, LOWEST), np.full(n, HIGHEST)) for n in sizes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(windows, pa.binary())], [*batch.schema.names, "windows"])

    open_windows = checkpointed(blocks.mapInArrow(anything, "block long, cell int, radius double, blob binary, windows binary"))
    right = rounds(open_windows, candidates, cells, radii, True, positives + 1)

    def between(left: pa.Table, found: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        shape = len(_block(row["blob"]).labels), positives + 1
        lowest, highest = np.full(shape, HIGHEST), np.full(shape, LOWEST)
        at, score = (found.column("place").to_numpy(), found.column("rank").to_numpy() - 1), found.column("score").to_numpy()
        lowest[at], highest[at] = -((-low * score) // 100), (high * score) // 100
        row["windows"] = squeeze(lowest.ravel(), highest.ravel())
        return pa.Table.from_pylist([row], left.schema)

    scores = right.select("block", "place", "rank", "score")
    bounded = open_windows.groupBy("block").cogroup(scores.groupBy("block")).applyInArrow(between, open_windows.schema)
    wrong = rounds(checkpointed(bounded), candidates, cells, radii, False, negatives)

    right = right.select("a", (F.col("rank") - 1).alias("which"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    wrong = wrong.select("a", "which", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    own = asking.join(groups, ["label", "vec"]).select(F.col("vec_id").alias("anchor_id"), "a")
    own = own.join(right, "a").where("positive_id <> anchor_id")
    order = F.row_number().over(Window.partitionBy("anchor_id").orderBy("which"))
    own = own.withColumn("nth", order).where(F.col("nth") <= positives)
    return own.join(wrong, ["a", "which"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings, F.col("vec_id") % 50 == 0, label)


OP11_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, list_inner_product(a.vec, b.vec)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER w::INTEGER AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id
WHERE s.label <> s.anchor_label AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3"""
