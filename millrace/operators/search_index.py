"""A positional inverted index kept as a table, and searches by words, prefixes and phrases.

Documents are dealt into shards by a hash of their id. A posting list is a row (shard, term, and for each document that has it: its
place in the shard, id, length, frequency, positions), in one folder for each bucket. A bucket is a hash of a term's first two letters,
so that a word and all that begins with it lie in one: a search reads the buckets of its words only. A shard is scored by itself, and
only its best leave it: no task holds more than one, and their number follows the words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.operators.knowledge import triples
from millrace.sources.shared import settled, shared_folder
from millrace.sources.tables import table

#: Fixed values of the ranking.
K1, B, LEAST_IDF, RRF, PHRASE_BONUS = 1.2, 0.75, 1e-6, 60, 0.2
WORD = r"[\p{L}\p{N}_]{2,}"
BUCKETS = 64
#: Words of a shard of documents; words of the queries that meet a shard together.
SHARD_WORDS, PACK_WORDS = 1 << 18, 1 << 10
#: Shards of a task, where there are more tasks than TASKS.
TASK_SHARDS, TASKS = 16, 32


def search_words(text: Column) -> Column:
    """Words of two letters, digits or underscores and more, in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def bucket_of(term: Column) -> Column:
    return (F.crc32(F.substring(term, 1, 2)) % BUCKETS).cast("int")


def write_index(docs: DataFrame, path: str) -> None:
    """Writes the index of documents (id, text) to a folder. Null and empty texts are counted but hold nothing; rows of one id are one
    document each if their lengths differ, so an id should have one row."""
    texts = docs.select("id", F.col("text").cast("string").alias("text"))
    about = texts.select(F.size(search_words(F.col("text"))).alias("length")).agg(F.count("*").alias("docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean"), F.sum("length").alias("words"))
    about = about.withColumn("shards", F.greatest(F.lit(1), F.coalesce(F.expr(f"words div {SHARD_WORDS}"), F.lit(0))).cast("int"))
    about.coalesce(1).write.parquet(f"{path}/about")
    shards = docs.sparkSession.read.parquet(f"{path}/about").first().shards
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).repartition(tasks_of(shards), "shard").sortWithinPartitions("shard")
    words = dealt.select("shard", "id", search_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    schema = StructType.fromDDL(f"shard int, term string, docs array<int>, ids array<{docs.schema['id'].dataType.simpleString()}>, lengths array<int>, counts array<int>, positions array<int>")
    arrow = to_arrow_schema(schema)
    lists = words.groupBy("shard").applyInArrow(lambda rows: posting_lists(rows, arrow), schema)
    lists.withColumn("bucket", bucket_of(F.col("term"))).write.partitionBy("bucket").parquet(f"{path}/postings")


def tasks_of(groups: int) -> int:
    return max(min(groups, TASKS), -(-groups // TASK_SHARDS))


def posting_lists(rows: pa.Table, schema: pa.Schema) -> pa.Table:
    """The posting lists of a shard's documents (shard, id, words). Places follow the ids, so that equal scores stand in their order."""
    rows = rows.append_column("length", pc.list_value_length(rows.column("words")))
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending"), ("length", "ascending")], null_placement="at_start")).combine_chunks()
    ids, length = (rows.column(c).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(c).type) for c in ("id", "length"))
    sizes = length.to_numpy().astype(np.int64)
    # Rows alike in id and length are one place.
    fresh = np.ones(len(ids), bool)
    if len(ids) > 1:
        fresh[1:] = ~same_as_next(ids) | (sizes[1:] != sizes[:-1])
    place = np.cumsum(fresh) - 1
    coded = rows.column("words").combine_chunks().flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(ids)), sizes)
    position = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = coded.indices.to_numpy().astype(np.int64)
    order = np.lexsort((position, place[doc], code))
    code, doc, position = code[order], doc[order], position[order]
    new_term = np.append(True, code[1:] != code[:-1])
    at = np.flatnonzero(new_term | np.append(True, place[doc][1:] != place[doc][:-1]))
    heads = np.flatnonzero(new_term[at])
    bounds = pa.array(np.append(heads, len(at)), pa.int32())
    one = doc[at]
    listed = lambda values: pa.ListArray.from_arrays(bounds, values)
    within = pa.ListArray.from_arrays(pa.array(np.append(at[heads], len(code)), pa.int32()), pa.array(position, pa.int32()))
    columns = [
        pa.repeat(rows.column("shard")[0], len(heads)), coded.dictionary.take(pa.array(code[at[heads]])), listed(pa.array(place[one], pa.int32())),
        listed(ids.take(pa.array(one))), listed(pa.array(sizes[one], pa.int32())), listed(pa.array(np.diff(np.append(at, len(code))), pa.int32())), within,
    ]
    return pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def same_as_next(values: pa.Array) -> np.ndarray:
    """Whether each value but the last equals the next one; nulls are equal."""
    a, b = values[:-1], values[1:]
    return np.array(pc.fill_null(pc.equal(a, b), False)) | np.array(pc.and_(a.is_null(), b.is_null()))


def postings(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame:
    """Posting lists of some buckets: folders of others aren't opened."""
    return spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets))


def asked_words(queries: DataFrame) -> DataFrame:
    """(query_id, n, at, word, bucket) of queries (query_id, text): their words in order."""
    rows = queries.select("query_id", search_words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    return rows.select("query_id", "n", F.posexplode("words").alias("at", "word")).withColumn("bucket", bucket_of(F.col("word")))


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 100) -> DataFrame:
    """(query_id, id, bm25, phrase, rank): the best documents for each query (query_id, text).

    Each word of a query counts with all that begins with it, and, if there are several, so does the phrase of them all, word
    for word: each of these is a part with its own frequency in a document and its own weight. Documents with the phrase come
    first, then by BM25 (ties: the least id). Queries are read whole; a query without words finds nothing. A word that a query has twice
    counts twice.
    """
    asked = asked_words(queries)
    buckets = sorted(r.bucket for r in asked.select("bucket").distinct().collect())
    packs = max(1, -(-asked.count() // PACK_WORDS))
    asked = asked.withColumn("pack", F.pmod(F.xxhash64("query_id"), F.lit(packs)).cast("int")).withColumn("head", F.substring("word", 1, 2))
    about = spark.read.parquet(f"{path}/about")
    tasks = tasks_of(about.first().shards * packs)
    lists = postings(spark, path, buckets).withColumn("head", F.substring("term", 1, 2))
    key, each = (frame.schema[c].dataType.simpleString() for frame, c in ((queries, "query_id"), (lists, "ids")))

    def met(words: DataFrame, *more: str) -> DataFrame:
        """Lists with what is asked of them: a list meets the queries of a pack that have words with its first two letters."""
        grouped = words.groupBy("pack", "bucket", "head").agg(F.collect_list(F.struct("query_id", "n", "at", "word", *more)).alias("asks"))
        rows = lists.join(grouped, ["bucket", "head"]).withColumn("asks", F.filter("asks", lambda a: F.startswith(F.col("term"), a.word)))
        return rows.where(F.size("asks") > 0).drop("bucket", "head").repartition(tasks, "shard", "pack").groupBy("shard", "pack")

    counted = StructType.fromDDL(f"query_id {key}, at int, df long")
    counts_arrow = to_arrow_schema(counted)

    def count(rows: pa.Table) -> pa.Table:
        shard = Shard(rows)
        out = [(q, at, np.count_nonzero(f)) for q, parts in shard.queries() for at, f in parts]
        return shard.table(counts_arrow, [q for q, _, _ in out], [at for _, at, _ in out], [n for _, _, n in out])

    df = met(asked).applyInArrow(count, counted).where("df > 0").groupBy("query_id", "at").agg(F.sum("df").alias("df"))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weights = settled(df.join(F.broadcast(about.select("docs", "mean")), F.lit(True)).select("query_id", "at", idf.alias("idf"), "mean"))
    phrases = weights.where("at = -1").select("query_id", F.col("idf").alias("phrase_idf"))
    weighed = asked.join(weights, ["query_id", "at"]).join(phrases, "query_id", "left")

    found = StructType.fromDDL(f"query_id {key}, id {each[len('array<'):-1]}, bm25 double, phrase boolean")
    found_arrow = to_arrow_schema(found)

    def best(rows: pa.Table) -> pa.Table:
        shard = Shard(rows)
        out = [(q, *shard.best(q, parts, k)) for q, parts in shard.queries()]
        whole = lambda i: np.concatenate([x[i] for x in out])
        return shard.table(found_arrow, np.repeat([q for q, *_ in out], [len(x[1]) for x in out]), shard.ids.take(pa.array(whole(1))), whole(2), whole(3))

    scored = met(weighed, "idf", "phrase_idf", "mean").applyInArrow(best, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("phrase"), F.desc("bm25"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Shard:
    """The posting lists of a shard that a pack of queries asks for (term, docs, ids, lengths, counts, positions, asks). Queries are numbers here."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        flat = lambda c: rows.column(c).combine_chunks().flatten()
        places, self.f, self.positions = (flat(c).to_numpy().astype(np.int64) for c in ("docs", "counts", "positions"))
        # Only documents with a word that is asked for count here.
        _, first, self.doc = np.unique(places, return_index=True, return_inverse=True)
        self.ids, self.lengths = flat("ids").take(pa.array(first)), flat("lengths").to_numpy()[first].astype(np.float64)
        #: The first document of each document's id.
        self.of = np.arange(len(first))
        if len(first) > 1:
            self.of = np.maximum.accumulate(np.where(np.append(True, ~same_as_next(self.ids)), self.of, 0))
        self.bounds = np.append(0, np.cumsum(pc.list_value_length(rows.column("docs")).to_numpy()))
        self.within = np.append(0, np.cumsum(self.f))
        asks = rows.column("asks").combine_chunks()
        self.row = pc.list_parent_indices(asks).to_numpy().astype(np.int64)
        asks = asks.flatten()
        coded = asks.field("query_id").dictionary_encode(null_encoding="encode")
        self.names, self.query = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.n, self.at = (asks.field(c).to_numpy() for c in ("n", "at"))
        self.exact = pc.equal(rows.column("term").combine_chunks().take(pa.array(self.row)), asks.field("word")).to_numpy(zero_copy_only=False)
        if asks.type.get_field_index("idf") >= 0:
            self.idf, self.phrase_idf, self.mean = (asks.field(c).to_numpy(zero_copy_only=False) for c in ("idf", "phrase_idf", "mean"))

    def table(self, schema: pa.Schema, query, *columns) -> pa.Table:
        columns = [self.names.take(pa.array(query, pa.int64())), *columns]
        return pa.table([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def entries(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """What some lists hold, as places in all entries."""
        if len(rows) == 1:
            return np.arange(bounds[rows[0]], bounds[rows[0] + 1])
        sizes = bounds[rows + 1] - bounds[rows]
        return np.repeat(bounds[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())

    def queries(self) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
        """Each query with its parts: the place of a word in it (-1: the phrase), and how often each document has it."""
        order = np.lexsort((self.at, self.query))
        cuts = np.flatnonzero(np.append(True, np.diff(self.query[order]) != 0)) if len(order) else []
        for own in np.split(order, cuts[1:]) if len(order) else []:
            steps = np.flatnonzero(np.diff(self.at[own])) + 1
            words, parts = np.split(own, steps), []
            for asks in words:
                held = self.entries(self.row[asks], self.bounds)
                parts.append((int(self.at[asks[0]]), np.bincount(self.doc[held], self.f[held], len(self.ids))))
            if len(words) == self.n[own[0]] > 1 and all(self.exact[asks].any() for asks in words):
                parts.append((-1, self.phrase([(at, self.row[asks[self.exact[asks]]]) for (at, _), asks in zip(parts, words, strict=True)])))
            yield int(self.query[own[0]]), parts

    def phrase(self, words: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """How often each document has words (place in the query, lists) one after the other, each beginning counted once."""
        starts = None
        for at, rows in sorted(words, key=lambda w: int((self.bounds[w[1] + 1] - self.bounds[w[1]]).sum())):
            held = self.entries(rows, self.bounds)
            position = self.positions[self.entries(held, self.within)]
            keys = (np.repeat(self.doc[held], self.f[held]) << 32) + (position - at + (1 << 31))
            starts = np.unique(keys) if starts is None else starts[np.isin(starts, keys)]
        return np.bincount(starts >> 32, minlength=len(self.ids))

    def best(self, query: int, parts: list[tuple[int, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first k documents for a query: places, scores, and whether they have the phrase."""
        own = self.query == query
        idf = dict(zip(self.at[own].tolist(), self.idf[own].tolist(), strict=True)) | {-1: self.phrase_idf[own][0]}
        rest = K1 * (1 - B + B * self.lengths / self.mean[own][0])
        total, hit, phrase = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool), np.zeros(len(self.ids), bool)
        for at, f in parts:
            if not f.any():
                continue
            total += idf[at] * f * (K1 + 1) / (f + rest)
            hit |= f > 0
            if at == -1:
                phrase = f > 0
        total, hit, phrase = (np.bincount(self.of, x, len(self.ids)) for x in (total, hit, phrase))
        total, phrase = np.floor(total * 1e6 + 0.5) / 1e6, phrase > 0
        at = np.flatnonzero(hit)
        if len(at) > k:
            # Phrases come before all scores; of those as good as the last one, the least ids.
            worth = np.where(phrase[at], 1, 0) * (2 * total.max() + 2) + total[at]
            last = np.partition(worth, len(at) - k)[len(at) - k]
            better, level = at[worth > last], at[worth == last]
            at = np.sort(np.append(better, level[: k - len(better)]))
        return at, total[at], phrase[at]


def fused_search(lexical: DataFrame, other: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): a search's ranks and another's (query_id, id, rank, score) by reciprocal rank, with a bonus for the
    phrase and a share of the other's score."""
    a = lexical.select("query_id", "id", F.col("rank").alias("a"), "phrase")
    both = a.join(other.select("query_id", "id", F.col("rank").alias("b"), F.col("score").alias("s")), ["query_id", "id"], "full")
    part = lambda c: F.when(F.col(c).isNull(), 0.0).otherwise(1 / (RRF + F.col(c)))
    score = part("a") + part("b") + F.when(F.col("phrase"), PHRASE_BONUS).otherwise(0.0) + 0.35 * F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.0))
    rows = both.select("query_id", "id", F.round(score, 6).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def like_pattern(query: str) -> str:
    """A pattern for LIKE that finds the words of a query in order, whatever stands between them; underscores are spaces, signs that
    LIKE knows are taken as they are."""
    own = " ".join(query.replace("_", " ").split())
    return "%" + "%".join(w.replace("\\", "\\\\").replace("%", "\\%") for w in own.split()) + "%" if own else "%"


def flexible_matches(rows: DataFrame, columns: tuple[str, ...], query: str) -> DataFrame:
    """Rows one of whose columns, with spaces for underscores, has the words of a query in order, in any case."""
    own = lambda c: F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "_", " "), " {2,}", " "))
    fits = F.lit(False)
    for c in columns:
        fits |= F.lower(own(c)).like(like_pattern(query.lower()))
    return rows.where(fits)


def _booking_texts(s, d):
    orders, customer = table(s, d, "orders"), table(s, d, "customer")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", "c_name", "o_orderpriority", "c_mktsegment", F.concat(F.lit("from nation_"), "c_nationkey")).alias("text"))


def _statement_texts(s, d):
    return triples(s, d).select(F.col("triple_id").alias("id"), F.concat_ws(" ", "subject", "predicate", "object").alias("text"))


def _questions(s, d):
    n = F.col("n_nationkey")
    text = F.when(n % 5 == 0, F.concat(F.lit("building from nation_"), n)).when(n % 5 == 1, F.concat(F.lit("Customer 0000000"), n)).when(n % 5 == 2, "URG").when(n % 5 == 3, F.concat(F.lit("specified, machinery; nation_"), n)).otherwise("automobile from automobile")
    return table(s, d, "nation").select(n.alias("query_id"), text.alias("text"))


def _indexed(s, docs):
    path = f"{shared_folder(s)}/index-{uuid.uuid4().hex}"
    write_index(docs, path)
    return path


def _fused(s, d):
    lexical = search_index(s, _indexed(s, _booking_texts(s, d)), _questions(s, d), 50)
    other = table(s, d, "orders").select((F.col("o_orderkey") % 25).cast("int").alias("query_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 97 / 97).alias("score"))
    other = other.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("rank <= 50")
    return fused_search(lexical, other)


QUERIES = {
    "booking_search": lambda s, d: search_index(s, _indexed(s, _booking_texts(s, d)), _questions(s, d), 100),
    "statement_search": lambda s, d: search_index(s, _indexed(s, _statement_texts(s, d)), table(s, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("urgent n"), "n_nationkey").alias("text")), 100),
    "fused_booking_search": _fused,
    "flexible_search": lambda s, d: flexible_matches(triples(s, d).withColumn("predicate", F.translate("predicate", " ", "_")), ("subject", "predicate", "object"), "Not  specified").select("triple_id"),
}
_BOOK = "SELECT o_orderkey AS id, concat_ws(' ', c_name, o_orderpriority, c_mktsegment, 'from nation_' || c_nationkey) AS text FROM orders JOIN customer ON o_custkey = c_custkey"
_SAID = "SELECT o_orderkey AS id, 'c' || o_custkey || ' ' || o_orderpriority || ' n' || (c_nationkey * 4 + o_orderkey % 4) AS text FROM orders JOIN customer ON o_custkey = c_custkey"
_ASK = "SELECT n_nationkey AS query_id, CASE n_nationkey % 5 WHEN 0 THEN 'building from nation_' || n_nationkey WHEN 1 THEN 'Customer 0000000' || n_nationkey WHEN 2 THEN 'URG' WHEN 3 THEN 'specified, machinery; nation_' || n_nationkey ELSE 'automobile from automobile' END AS text FROM nation"
_FIND = r"""WITH docs AS ({docs}), ask AS ({ask}),
dw AS (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM docs), dt AS (SELECT id, len(w) AS length, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM dw),
qw AS (SELECT query_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM ask), qt AS (SELECT query_id, w, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS q_at FROM qw),
a AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM dw),
ph AS (SELECT query_id, id, any_value(length) AS length, 0 AS q_at, count(*) AS f FROM (SELECT query_id, id, pos - q_at AS start, any_value(n) AS n, any_value(length) AS length, count(DISTINCT q_at) AS k FROM qt JOIN dt ON term = word WHERE n > 1 GROUP BY 1, 2, 3) WHERE k = n GROUP BY 1, 2),
pt AS (SELECT query_id, id, any_value(length) AS length, q_at, count(*) AS f FROM qt JOIN dt ON starts_with(term, word) GROUP BY query_id, id, q_at UNION ALL SELECT query_id, id, length, q_at, f FROM ph),
wt AS (SELECT query_id, q_at, greatest(1e-6, ln((docs - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM pt, a GROUP BY query_id, q_at, docs),
sc AS (SELECT query_id, id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS bm25, max(q_at = 0) AS phrase FROM pt JOIN wt USING (query_id, q_at), a GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY phrase DESC, bm25 DESC, id)::INT AS rank FROM sc)"""
_IN_BOOKINGS = _FIND.replace("{docs}", _BOOK).replace("{ask}", _ASK)
ORACLE_SQL = {
    "booking_search": f"{_IN_BOOKINGS} SELECT query_id, id, bm25, phrase, rank FROM r WHERE rank <= 100",
    "statement_search": _FIND.replace("{docs}", _SAID).replace("{ask}", "SELECT n_nationkey AS query_id, 'urgent n' || n_nationkey AS text FROM nation") + " SELECT query_id, id, bm25, phrase, rank FROM r WHERE rank <= 100",
    "fused_booking_search": f"""{_IN_BOOKINGS}, o AS (SELECT (o_orderkey % 25)::INT AS query_id, o_orderkey AS id, o_orderkey % 97 / 97 AS s, row_number() OVER (PARTITION BY o_orderkey % 25 ORDER BY o_orderkey % 97 DESC, o_orderkey) AS b FROM orders),
f AS (SELECT query_id, id, round(coalesce(1 / (60 + a), 0) + coalesce(1 / (60 + b), 0) + CASE WHEN phrase THEN 0.2::DOUBLE ELSE 0 END + 0.35::DOUBLE * coalesce(s, 0), 6) AS score FROM (SELECT query_id, id, rank AS a, phrase FROM r WHERE rank <= 50) FULL JOIN (SELECT * FROM o WHERE b <= 50) USING (query_id, id))
SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM f) WHERE rank <= 10""",
    "flexible_search": "SELECT o_orderkey AS triple_id FROM orders WHERE lower(o_orderpriority) LIKE '%not%specified%'",
}
