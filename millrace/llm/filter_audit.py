"""Operator 13: how filters on documents act alone and behind others, in every order.

Texts are sorted by ranges of (fingerprint, doc_id), and inside a range by fingerprint, text and doc_id, so that copies stand
together and a large group of them is split over ranges. Each row compares its text with its predecessor's; copies over a
range's edge are found from the few fingerprints that are at an edge. What remains of a document is a mask of the filters that
it fails; masks are counted by part, and every order of the filters is summed up from these counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import Texts, checkpointed, slices

FILTERS = "ABCDE"
#: Bytes that filter D looks for, and those that filter C counts.
SIGNS, CAPITALS, CONTINUED = (np.zeros(256, bool) for _ in range(3))
SIGNS[list(b"#$%&*|")] = True
CAPITALS[ord("A") : ord("Z") + 1] = True
CONTINUED[0x80:0xC0] = True
#: Texts that are measured at a time, in bytes.
AT_ONCE = 8 << 20
LAST_ID = np.iinfo(np.int64).max
JUDGED = "doc_id long, part string, mask int, fp long, place int, digest binary"


def masks(rows: pa.RecordBatch) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    texts = Texts(rows)
    raw, cuts = texts.data.tobytes(), texts.bounds.tolist()
    words = np.zeros((len(texts), 2), np.int64)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        own = raw[a:b].split()
        words[i] = len(own), len(set(own))

    def count(which: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(which[texts.data])])[texts.bounds])

    points = np.diff(texts.bounds) - count(CONTINUED)
    fails = [words[:, 0] < 100, 100 * words[:, 1] < 80 * words[:, 0], 100 * count(CAPITALS) > 10 * points, count(SIGNS) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


class Copies:
    """Which rows of a sorted range have a predecessor of the same text and a smaller doc_id. A null doc_id is above all."""

    def __init__(self) -> None:
        self.last: tuple[int, str, int, bool] | None = None

    def of(self, fps: np.ndarray, texts: list[str], ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts), bool)
        same = np.flatnonzero(fps[1:] == fps[:-1]) + 1
        for i in [0][: len(texts)] + same.tolist():
            before = self.last if i == 0 else (fps[i - 1], texts[i - 1], ids[i - 1], out[i - 1])
            if before is not None and before[0] == fps[i] and before[1] == texts[i]:
                out[i] = before[2] < ids[i] or before[3]
        if len(texts):
            self.last = int(fps[-1]), texts[-1], int(ids[-1]), bool(out[-1])
        return out


def judged(docs: DataFrame, part: Column) -> DataFrame:
    """(doc_id, part, mask, ...) of each row: five bits, of which the last says that a smaller doc_id has the same text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), text.alias("text"))
    order = F.coalesce("doc_id", F.lit(LAST_ID))
    rows = rows.withColumn("fp", F.xxhash64("text")).withColumn("order", order)
    rows = rows.repartitionByRange("fp", "order").sortWithinPartitions("fp", "text", "order")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, place = Copies(), TaskContext.get().partitionId()
        for batch in batches:
            for some in slices(batch, AT_ONCE):
                fps, ids = (some.column(c).to_numpy() for c in ("fp", "order"))
                texts = some.column("text").to_pylist()
                mask = masks(some) | copies.of(fps, texts, ids).astype(np.int32) << 4
                #: Rows of a range's first and last fingerprint are of the first or last of their batch.
                edge = ((fps == fps[0]) | (fps == fps[-1])).tolist()
                digests = [hashlib.sha256(t.encode()).digest() if e else None for t, e in zip(texts, edge, strict=True)]
                columns = [some.column("doc_id"), some.column("part"), pa.array(mask, pa.int32()), some.column("fp")]
                columns += [pa.array(np.full(len(texts), place, np.int32)), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "mask", "fp", "place", "digest"])

    rows = checkpointed(rows.mapInArrow(judge, JUDGED))
    edges = rows.groupBy("place").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    edges = edges.select("place", F.explode(F.array("a", "b")).alias("fp")).distinct()
    split = edges.groupBy("fp").count().where("count > 1").select("fp")
    least = F.min(F.coalesce("doc_id", F.lit(LAST_ID))).alias("least")
    first = rows.join(F.broadcast(split), "fp", "left_semi").where("digest is not null").groupBy("fp", "digest").agg(least)
    again = F.coalesce(F.col("least") < F.coalesce("doc_id", F.lit(LAST_ID)), F.lit(False))
    mask = F.when(again, F.col("mask").bitwiseOR(16)).otherwise(F.col("mask"))
    return rows.join(F.broadcast(first), ["fp", "digest"], "left").select("doc_id", "part", mask.alias("mask"))


def counters(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, counts, good, toxic): documents, good ones and toxic ones of each of the 32 masks."""
    marks = [F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")]
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(*marks)
    rows = rows.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    each = rows.join(labels, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("quality", "toxic"))
    )
    columns = {"counts": "n", "good": "quality", "toxic_ones": "toxic"}
    by_mask = [F.array(*(F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(32))).alias(name) for name, c in columns.items()]
    return each.groupBy("part").agg(*by_mask)


def filter_audit(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """One row for each part, order of the five filters and step, with what the step's filter does there.

    docs has doc_id, text and what ``part`` is made of; labels has doc_id, quality, toxic. Other columns don't matter.
    A document fails A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * capitals A-Z > 10 * code points; D: any of
    ``#$%&*|``; E: some smaller doc_id of the table has the same text. A null text is empty; a null part is the empty
    string; a null doc_id is above all others and has no label; rows of one doc_id don't make copies of each other, but each
    counts. Several labels of one doc_id count as the greatest. No documents give no parts and no rows.
    Counts: kept (after this step), removed (here), redundant (failing, removed earlier), unique_fails (failing this filter only),
    good_lost, toxic_lost (removed here with quality or toxic 1), shapley (removed by this filter, over all 120 orders).
    """
    part = F.coalesce(part.cast("string"), F.lit(""))
    found = counters(judged(docs, part), labels)
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = found.select("*", F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumn("own", bits(F.substr("filter_order", F.col("step"), F.lit(1))))
    steps = steps.withColumn("before", bits(F.substr("filter_order", F.lit(1), F.col("step") - 1)))

    def total(counts: str, *conditions) -> Column:
        def add(so_far: Column, m: Column) -> Column:
            fits = F.lit(True)
            for condition in conditions:
                fits &= condition(m)
            return so_far + F.when(fits, F.get(counts, m)).otherwise(F.lit(0))

        return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), add)

    own, before = F.col("own"), F.col("before")
    fails, passed = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(before) == 0)
    #: A document that fails k filters is removed by each of them in 120 / k of the orders.
    share = F.aggregate(
        F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"),
        lambda so_far, m: so_far + F.when(fails(m), F.get("counts", m) * (120 / F.bit_count(m)).cast("long")).otherwise(F.lit(0)),
    )
    return steps.select(
        "part", "filter_order", "step",
        total("counts", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("counts", fails, passed).alias("removed"),
        total("counts", fails, lambda m: ~passed(m)).alias("redundant"),
        total("counts", lambda m: m == own).alias("unique_fails"),
        total("good", fails, passed).alias("good_lost"),
        total("toxic_ones", fails, passed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return filter_audit(docs.select("doc_id", "text", "lang"), labels, F.col("lang"))


OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents),
masks AS (
  SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(first_id < coalesce(doc_id, 9223372036854775807), false)::INT AS mask
  FROM texts),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
counts AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM masks LEFT JOIN marks USING (doc_id) GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, 1 << (instr('ABCDE', substr(filter_order, step, 1)) - 1) AS own,
         coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', substr(filter_order, i::INT, 1)) - 1))), 0)::INT AS before
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step))
SELECT part, filter_order, step,
       coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * (120 // greatest(bit_count(mask::INT), 1))) FILTER (mask & own <> 0), 0)::BIGINT AS shapley
FROM counts, steps GROUP BY ALL"""
