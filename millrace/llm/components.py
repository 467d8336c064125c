"""Connected components of a graph of links, as DataFrames throughout."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import checkpointed

#: Links that one partition takes: about 50 MB of a task's memory while they are contracted.
PARTITION_LINKS = 250_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition as a star for each of its components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    stars = [(x, r) for x in parent if (r := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], pa.int64()) for i in (0, 1)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each end of a link (columns a and b, long): the least node that links reach.

    Each partition joins what its own links join; then rounds of large and small stars, in which every node hands
    the least of its neighbours to the others, until nothing changes. The number of rounds grows with the logarithm
    of the longest path. Contracted links are dealt over as many partitions as their count needs; links so few that
    they are one partition need no rounds. Null ends are left out.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    links = checkpointed(links.distinct())
    parts = max(1, -(-links.count() // PARTITION_LINKS))
    links = checkpointed(links.coalesce(parts).mapInArrow(_contract, "a long, b long"))
    before, parts = None, links.rdd.getNumPartitions()
    while parts > 1:
        needed = max(1, -(-links.count() // PARTITION_LINKS))
        if needed < parts:
            links = checkpointed(links.coalesce(needed).mapInArrow(_contract, "a long, b long"))
            parts = needed
            continue
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        links = checkpointed(links.mapInArrow(_contract, "a long, b long"))
        parts = links.rdd.getNumPartitions()
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
