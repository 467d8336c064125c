"""Operator 8: benchmark decontamination with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import checkpointed, own_columns

#: Most bytes that are broadcast, of window hashes (eight each) or of documents' keys with their hits (sixteen a hit and
#: forty a document); with more, the join shuffles.
BROADCAST_BYTES = 16 << 20
RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII other than digits and letters (A-Z are lower case by then).
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def normal_words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z lower-cased; none for null."""
    words = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(words, lambda w: w != "")


def windows(words: str, width: int) -> Column:
    """Places (from 1) of all windows of so many words; none for a shorter text."""
    return F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - (width - 1))).otherwise(
        F.array().cast("array<int>")
    )


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, gram, n): the distinct windows of each item; a shorter item is one window."""
    words = benchmark.select(F.col("item_id"), normal_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(width))
    at = F.sequence(F.lit(1), F.size("words") - n + 1)
    return (
        words.select("item_id", n.alias("n"), "words", F.explode(at).alias("at"))
        .select("item_id", F.expr("slice(words, at, n)").alias("gram"), "n")
        .distinct()
    )


def occurrences(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(row, place, gram, n): where windows of items occur in documents (row, words).

    Windows are told by hash first, in one scan of all documents for all sizes of window, and those found by their
    words.
    """
    known = checkpointed(grams.select("n", F.xxhash64("n", "gram").alias("h"), "gram").distinct())
    sizes = [r.n for r in known.select("n").distinct().orderBy("n").collect()]
    hashes = known.select("h").distinct()
    if 8 * hashes.count() <= BROADCAST_BYTES:
        hashes = F.broadcast(hashes)

    def hashed(n: int) -> Column:
        window = lambda i: F.struct(i.alias("place"), F.lit(n).alias("n"), F.xxhash64(F.lit(n), F.slice("words", i, n)).alias("h"))
        return F.transform(windows("words", n), window)

    every = F.concat(*map(hashed, sizes)) if sizes else F.array().cast("array<struct<place:int,n:int,h:bigint>>")
    found = docs.select("row", F.explode(every).alias("w")).select("row", "w.place", "w.n", "w.h")
    found = found.join(hashes, "h", "left_semi").groupBy("row").agg(F.collect_set(F.struct("place", "n")).alias("hits"))
    found = checkpointed(found)
    few = (found.agg(F.sum(40 + 16 * F.size("hits"))).first()[0] or 0) <= BROADCAST_BYTES
    read = docs.join(F.broadcast(found) if few else found, "row").select("row", "words", F.explode("hits").alias("w"))
    read = read.select("row", "w.place", "w.n", F.slice("words", F.col("w.place"), F.col("w.n")).alias("gram"))
    return read.join(known.select("n", "gram"), ["n", "gram"], "left_semi").distinct()


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """For each document with a hit: row (its key), n_hit, n_items and items_sha256, hit_words (places from 1)."""
    grams = item_windows(benchmark, width)
    found = checkpointed(occurrences(docs, grams))
    words = found.select("row", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("n") - 1)).alias("place"))
    words = words.groupBy("row").agg(F.collect_set("place").alias("hit_words"))
    items = found.select("row", "gram").distinct().join(grams.select("gram", F.col("item_id").cast("string")), "gram")
    items = items.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return words.join(items, "row").select(
        "row",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "hit_words",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Marks the words of documents inside any window of ``width`` words of a benchmark item.

    Returns the documents' columns with n_words, n_hit, n_items (items with windows found), items_sha256 (of their
    ids, sorted as strings and joined by commas), contaminated, and clean_text: the normalised words that are not
    hit, joined by one space, where any is hit; else the text as it is. Columns of these names in the input are
    replaced. Null text has no words; items without words are ignored; an item_id that is null counts for hits but
    not among the items. Rows that share doc_id and text are equal and get equal results. An empty benchmark
    contaminates nothing; an empty table gives an empty one.
    """
    text = F.col("text").cast("string")
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h")).alias("row")
    hits = benchmark_hits(docs.select(key, normal_words(text).alias("words")), benchmark, width).dropDuplicates(["row"])
    counted = docs.select(own_columns(docs, *RESULT), key, F.size(normal_words(text)).cast("long").alias("n_words"))
    joined = counted.join(hits, "row", "left")
    text = F.col("own.text").cast("string")
    left = F.filter(
        F.transform(normal_words(text), lambda w, i: F.when(~F.array_contains("hit_words", i + 1), w)),
        lambda w: w.isNotNull(),
    )
    found = joined.select(
        "own",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        F.when(F.col("n_hit") > 0, F.array_join(left, " ")).otherwise(text).alias("clean_text"),
    )
    return found.select("own.*", *RESULT)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string"))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark, 10).drop("text", "clean_text")


OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (
    SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bw)),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM dw, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
found AS (SELECT p.doc_id, p.n, p.i, g.item_id FROM places p JOIN grams g ON p.n = g.n AND p.g = g.g),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       coalesce(i.items_sha256, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""
