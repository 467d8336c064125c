"""Operator 5: sharding by extendible hashing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.chunks import checkpointed, own_columns

RESULT = ("n_bytes", "shard", "depth", "page", "shard_bytes", "shard_docs")
#: Bits of the directory that are settled in one pass, and in all.
STEP, MOST_BITS = 12, 48
#: Hashes whose rows alone exceed the limit, that are broadcast so that their rows aren't shuffled by hash; each stands for more
#: than the limit in bytes. Beyond so many of them the join by hash is left to Spark, which splits a large partition.
MOST_ALIKE = 100_000


def _prefix(bits: int):
    """The first ``bits`` bits of a row's 48-bit hash, as a number."""
    return F.shiftright("hash", MOST_BITS - bits)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_docs) of each shard: the shortest hash prefix whose rows fit the limit.

    Only prefixes that are too large are looked at more closely, STEP bits at a time, on sums by prefix: rows move
    once for each pass, as partial sums. A prefix of all bits is a shard whatever its size.
    """
    leaves, heavy, done = None, None, 0
    while done < MOST_BITS:
        most = min(done + STEP, MOST_BITS)
        open_rows = rows if heavy is None else rows.join(heavy, _prefix(done) == F.col("open"), "left_semi")
        sums = open_rows.groupBy(_prefix(most).alias("p")).agg(F.sum("bytes").alias("b"), F.sum("docs").alias("n"))
        depths = sums.select(F.explode(F.sequence(F.lit(done), F.lit(most))).alias("depth"), "p", "b", "n")
        nodes = depths.groupBy("depth", F.expr(f"shiftright(p, {most} - depth)").alias("prefix")).agg(
            F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs")
        )
        nodes = checkpointed(nodes.where((F.col("depth") > done) | F.lit(done == 0)))
        full = nodes.where(F.col("shard_bytes") > limit)
        fits = nodes.where((F.col("shard_bytes") <= limit) | (F.col("depth") == MOST_BITS))
        parents = full.where(F.col("depth") < MOST_BITS).select(
            (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")
        )
        settled = fits.where("depth = 0").unionByName(fits.join(parents, ["depth", "prefix"], "left_semi"))
        if done:
            first = fits.where(F.col("depth") == done + 1)
            settled = settled.unionByName(first)
        leaves = settled if leaves is None else leaves.unionByName(settled)
        heavy = full.where(F.col("depth") == most).select(F.col("prefix").alias("open"))
        done = most
        if heavy.isEmpty():
            break
    return leaves.dropDuplicates(["depth", "prefix"])


def extendible_shards(docs: DataFrame, limit: int) -> DataFrame:
    """Assigns each document to a shard of at most ``limit`` bytes of text.

    Returns the documents' columns with n_bytes, shard (the bits of the hash prefix; "" if one shard holds all),
    depth, page, shard_bytes and shard_docs (of all pages); columns of these names in the input are replaced. The
    hash is of doc_id and text, so rows of one doc_id spread if their texts differ. Rows that agree in both can't
    be told apart by any number of bits: if they alone exceed the limit, their shard is divided into pages of as
    many rows as fit. A text above the limit is a shard or page of its own. Null text has no bytes. An empty
    table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    keyed = docs.select(
        own_columns(docs, *RESULT), F.octet_length(text).cast("long").alias("n_bytes"), F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").alias("hash")
    )
    sums = checkpointed(keyed.groupBy("hash").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs")))
    leaves = directory(sums, limit)
    depths = [r.depth for r in leaves.select("depth").distinct().orderBy("depth").collect()]
    place = sums.select("hash", F.explode(F.array(*map(F.lit, depths)) if depths else F.array().cast("array<int>")).alias("depth"))
    place = place.withColumn("prefix", F.expr(f"shiftright(hash, {MOST_BITS} - depth)"))
    place = place.join(leaves, ["depth", "prefix"]).select(
        "hash", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs",
        F.expr("substring(lpad(bin(prefix), depth, '0'), 1, depth)").alias("shard"),
    )
    alike = (F.col("depth") == MOST_BITS) & (F.col("shard_bytes") > limit)
    shown = ["own.*", *RESULT]
    first_page = F.lit(0).cast("long").alias("page")
    large = checkpointed(place.where(alike))
    many = large.count()
    if not many:
        return keyed.join(place, "hash").select("*", first_page).select(*shown)
    hot = F.broadcast(large) if many <= MOST_ALIKE else large
    rest = keyed.join(hot.select("hash"), "hash", "left_anti").join(place, "hash").select("*", first_page)
    return rest.select(*shown).unionByName(paged(checkpointed(keyed.join(hot, "hash")), limit).select(*shown))


def paged(rows: DataFrame, limit: int) -> DataFrame:
    """Rows that share a hash, as many on a page as fit. They are numbered within each partition of the checkpointed
    frame, after the numbers of the partitions before it, so that no task has all rows of a hash."""
    rows = rows.withColumn("dealt", F.spark_partition_id())
    counts = rows.groupBy("hash", "dealt").agg(F.count("*").alias("k"), F.max("n_bytes").alias("most"))
    before = F.sum("k").over(Window.partitionBy("hash").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("hash", "dealt", F.coalesce(before, F.lit(0)).alias("before"), F.max("most").over(Window.partitionBy("hash")).alias("most"))
    rows = rows.join(counts, ["hash", "dealt"])
    nth = F.row_number().over(Window.partitionBy("hash", "dealt").orderBy("n_bytes")) - 1 + F.col("before")
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("most", F.lit(1)))).cast("long")
    return rows.withColumn("page", F.floor(nth / each).cast("long"))


SHARD_BYTES, SMALL_BYTES = 16 << 20, 48 << 10


def shards_of_documents(spark, sf_dir: str, limit: int) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string"))
    return extendible_shards(docs, limit).drop("text")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return shards_of_documents(spark, sf_dir, SHARD_BYTES)


def small_shards(spark, sf_dir: str) -> DataFrame:
    """The same operator with a limit that small tables exceed many times."""
    return shards_of_documents(spark, sf_dir, SMALL_BYTES)


#: With {limit} for the bytes of a shard; right where no shard has pages.
SHARDS_SQL = """
WITH rows AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 12))::BIGINT AS hash
  FROM documents),
nodes AS (
  SELECT d.depth, hash >> (48 - d.depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs
  FROM rows, (SELECT unnest(range(0, 49))::INT AS depth) d GROUP BY 1, 2),
leaf AS (
  SELECT hash, min(depth) AS depth FROM (
    SELECT DISTINCT hash, n.depth FROM rows JOIN nodes n
    ON rows.hash >> (48 - n.depth) = n.prefix AND (n.shard_bytes <= {limit} OR n.depth = 48)) GROUP BY 1)
SELECT r.doc_id, r.n_bytes,
       CASE WHEN l.depth = 0 THEN '' ELSE right(lpad(bin(n.prefix), 48, '0'), l.depth) END AS shard,
       l.depth, 0::BIGINT AS page, n.shard_bytes, n.shard_docs
FROM rows r JOIN leaf l USING (hash) JOIN nodes n ON n.depth = l.depth AND n.prefix = r.hash >> (48 - l.depth)
"""
OP5_SQL, SMALL_SHARDS_SQL = (SHARDS_SQL.replace("{limit}", str(limit)) for limit in (SHARD_BYTES, SMALL_BYTES))
