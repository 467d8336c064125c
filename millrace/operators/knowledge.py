"""Operators on triples (triple_id, subject, predicate, object, confidence and what else is known of them)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.tables import table

# Words that are no entities, predicates that say nothing, states and their weights.
NOTHING = ("none", "null", "n/a", "unknown", "unbekannt", "")
PRONOUNS = ("er", "sie", "es", "he", "she", "it", "they", "this", "that", "dies", "das")
GENERIC = ("is", "ist", "was", "war", "are", "sind", "has", "hat", "have")
TITLES = ("dr", "prof", "mr", "mrs", "ms", "herr", "frau")
HARD, SOFT = ("confirmed_false", "retracted", "superseded", "contradicted"), ("disputed", "uncertain", "challenged")


def triples(spark, d: str) -> DataFrame:
    """An order as a statement on its customer: where they are, with the order's priority as predicate."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("triple_id"), F.concat(F.lit("c"), "o_custkey").alias("subject"), F.col("o_orderpriority").alias("predicate"),
        F.concat(F.lit("n"), F.col("c_nationkey") * 4 + F.col("o_orderkey") % 4).alias("object"), (F.col("o_orderkey") % 10 / 10).alias("confidence"),
        F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("valid_from"), F.date_add(F.to_date("o_orderdate"), 365).alias("valid_to"),
    )


T = """WITH triples AS (SELECT o_orderkey AS triple_id, 'c' || o_custkey AS subject, o_orderpriority AS predicate, 'n' || (c_nationkey * 4 + o_orderkey % 4) AS object, (o_orderkey % 10 / 10)::DOUBLE AS confidence,
  o_orderkey AS doc_id, o_orderdate::DATE AS valid_from, o_orderdate::DATE + 365 AS valid_to FROM orders JOIN customer ON o_custkey = c_custkey)"""


def normal_entity(name: Column) -> Column:
    """Lower case, without underscores, parentheses and titles, white space as one space."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.translate(name, "_", " ")), r"\([^)]*\)", " "), r"(^|\s)(?:" + "|".join(TITLES) + r")\.?\s", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def valid_triples(rows: DataFrame, least: int = 2) -> DataFrame:
    """Statements whose sides are long enough, are no empty words or pronouns, and differ."""
    side = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    good = lambda c: (F.length(side(c)) >= least) & ~side(c).isin(*NOTHING, *PRONOUNS)
    return rows.where(good("subject") & good("object") & (F.length(side("predicate")) >= least) & (side("subject") != side("object")))


def quality_triples(rows: DataFrame, least: float = 0.5, lowered: float = 0.25) -> DataFrame:
    """Valid statements of sure enough source: no numbers as entities, no long names, no empty predicates; the best of equal ones.
    Documents that would lose all keep those above a lower threshold."""
    good = ~F.col("subject").rlike(r"^[0-9.,\s]+$") & (F.length("subject") <= 80) & (F.length("object") <= 80) & (F.size(F.split("object", r"\s+")) <= 8) & ~F.lower("predicate").isin(*GENERIC)
    rows = valid_triples(rows).where(good & (F.col("confidence") >= lowered)).withColumn("sure", F.col("confidence") >= least)
    rows = rows.withColumn("any_sure", F.max("sure").over(Window.partitionBy("doc_id"))).where(F.col("sure") | ~F.col("any_sure"))
    same = Window.partitionBy(F.lower("subject"), F.lower("predicate"), F.lower("object")).orderBy(F.desc("confidence"), "triple_id")
    return rows.withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth", "sure", "any_sure")


def bad_documents(rows: DataFrame, grounding: float = 0.3, share: float = 0.5, least: int = 2) -> DataFrame:
    """(subject, n, failed): sources with so many statements of which such a share is not grounded."""
    sums = rows.groupBy("subject").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < grounding).alias("failed"))
    return sums.where((F.col("n") >= least) & (F.col("failed") >= share * F.col("n")))


def top_entities(rows: DataFrame, kind: str = "object", top: int = 20) -> DataFrame:
    return rows.groupBy(F.col(kind).alias("entity")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(top)


def resolved_contradictions(rows: DataFrame, gap: float = 0.15) -> DataFrame:
    """(triple_id, state): of statements on one subject and predicate with several objects the best stays; others are contradicted if they
    hold in its time and are clearly worse, disputed if they hold in its time, else superseded."""
    each = Window.partitionBy("subject", "predicate")
    order = each.orderBy(F.desc("confidence"), F.desc("valid_from"), F.desc("triple_id")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = lambda c: F.first(c).over(order)
    rows = rows.withColumns({"lo": F.min("object").over(each), "hi": F.max("object").over(each)}).where("lo <> hi")
    rows = rows.withColumns({"best_id": best("triple_id"), "best_object": best("object"), "best": best("confidence"), "since": best("valid_from"), "until": best("valid_to")})
    overlaps = (F.col("valid_from") <= F.col("until")) & (F.col("valid_to") >= F.col("since"))
    state = (
        F.when((F.col("triple_id") == F.col("best_id")) | (F.col("object") == F.col("best_object")), "kept")
        .when(overlaps & (F.col("best") - F.col("confidence") >= gap), "contradicted").when(overlaps, "disputed").otherwise("superseded")
    )
    return rows.select("triple_id", state.alias("state"))


def lifecycle_score(score: Column, confidence: Column, evidence: Column, grounding: Column, state: Column) -> Column:
    """A score blended with what is known of a statement's source, and cut where it is contradicted."""
    bounded = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    score = F.when(confidence.isNull(), score).otherwise(0.35 * score + 0.65 * bounded(confidence))
    score = F.when(evidence.isNull(), score).otherwise(0.5 * score + 0.5 * bounded(evidence))
    score = F.when(grounding.isNull(), score).when(grounding < 0, 0.9 * score).otherwise(0.6 * score + 0.4 * bounded(grounding))
    return score * F.when(state.isin(*HARD), 0.15).when(state.isin(*SOFT), 0.55).otherwise(1.0)


def graph_edges(rows: DataFrame) -> DataFrame:
    """(a, b, predicate): each pair of entities once, whichever way, with its last predicate."""
    both = rows.where("subject <> object").select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b"), "predicate", "triple_id")
    return both.groupBy("a", "b").agg(F.max_by("predicate", "triple_id").alias("predicate"))


def two_hops(rows: DataFrame, seeds: DataFrame, first: int = 5, second: int = 10) -> DataFrame:
    """(seed, entity, triple_id, hop): for each seed its statements, and the statements of the ``first`` other entities of these with the
    shortest names, ``second`` each: so no hub hands out all its pairs."""
    ends = rows.select("triple_id", F.explode(F.array(F.struct(F.col("subject").alias("entity"), F.col("object").alias("other")), F.struct(F.col("object").alias("entity"), F.col("subject").alias("other")))).alias("e")).select("triple_id", "e.*")
    one = ends.join(seeds, ends.entity == seeds.seed).select("seed", "other", "triple_id")
    new = one.select("seed", F.col("other").alias("entity")).distinct()
    nth = F.row_number().over(Window.partitionBy("seed").orderBy(F.length("entity"), "entity"))
    new = new.withColumn("nth", nth).where(F.col("nth") <= first).select("seed", "entity")
    capped = ends.withColumn("nth", F.row_number().over(Window.partitionBy("entity").orderBy("triple_id"))).where(F.col("nth") <= second)
    two = new.join(capped, "entity").select("seed", "entity", "triple_id").join(one.select("seed", "triple_id"), ["seed", "triple_id"], "left_anti")
    two = two.groupBy("seed", "triple_id").agg(F.min("entity").alias("entity"))
    one = one.groupBy("seed", "triple_id").agg(F.min("other").alias("entity"))
    return one.select("seed", "entity", "triple_id", F.lit(1).alias("hop")).unionByName(two.select("seed", "entity", "triple_id", F.lit(2).alias("hop")))


def communities(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(node, community) by propagation of labels: in each round a node takes the label that it and its neighbours have most often (ties: the
    least). The number of rounds is fixed, so the plan is."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    both = both.unionByName(labels.select(F.col("node").alias("a"), F.col("node").alias("b")))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.count("*").alias("k"))
        labels = votes.groupBy("node").agg(F.min(F.struct(F.negative("k").alias("k"), "label"))["label"].alias("label"))
    return labels.withColumnRenamed("label", "community")


def community_metrics(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(community, nodes, edges, density) of each community."""
    inside = edges.join(members.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(members.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").where("ca = cb")
    counts = inside.groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("edges"))
    sizes = members.groupBy("community").agg(F.count("*").alias("nodes"))
    many = F.col("nodes") * (F.col("nodes") - 1) / 2
    found = sizes.join(counts, "community", "left").select("community", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))
    return found.withColumn("density", F.round(F.when(F.col("nodes") > 1, F.col("edges") / many).otherwise(0.0), 6))


def triangles(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, clustering): each edge points from the end of less degree, so that a hub's pairs are not listed."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    ranked = edges.join(degree.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(degree.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    first = F.struct("da", "a") < F.struct("db", "b")
    out = ranked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"))
    paths = out.select("u", "v").join(out.select("u", F.col("v").alias("w")), "u").where("v < w")
    closed = paths.join(edges.select(F.col("a").alias("v"), F.col("b").alias("w")), ["v", "w"])
    each = closed.select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    found = degree.join(each, "node", "left").select("node", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"))
    return found.withColumn("clustering", F.round(F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0), 6))


def entity_merges(rows: DataFrame) -> DataFrame:
    """(entity, canonical): names with one normal form, and the most frequent of them."""
    counts = rows.select(F.explode(F.array("subject", "object")).alias("entity")).groupBy("entity").agg(F.count("*").alias("k"))
    forms = counts.withColumn("form", normal_entity(F.col("entity")))
    best = forms.groupBy("form").agg(F.max_by("entity", F.struct("k", "entity")).alias("canonical"), F.count("*").alias("names")).where("names > 1")
    return forms.join(best, "form").where("entity <> canonical").select("entity", "canonical")


def consistent(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples without invalid and equal ones (the first stays), and (entity, frequency) of what they speak of."""
    first = Window.partitionBy("subject", "predicate", "object").orderBy("triple_id")
    kept = valid_triples(rows).withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return kept, kept.select(F.explode(F.array("subject", "object")).alias("entity")).groupBy("entity").agg(F.count("*").alias("frequency"))


def with_context(hits: DataFrame, rows: DataFrame, most: int = 5) -> DataFrame:
    """Search hits (doc_id) with up to so many statements of each document, the surest first."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "triple_id"))
    said = F.concat_ws(" ", "subject", "predicate", "object")
    own = rows.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", said.alias("said")))), lambda x: x["said"]), "; ").alias("context"))
    return hits.join(own, "doc_id", "left")


def source_join(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(triple_id, chunk_id): a statement's chunk where it is known, else all of its document: two equi-joins, not one on either."""
    known = rows.where("source_chunk_id is not null").join(chunks, F.col("source_chunk_id") == F.col("chunk_id")).select("triple_id", "chunk_id")
    other = rows.where("source_chunk_id is null").join(chunks, rows.doc_id == chunks.doc_id).select("triple_id", "chunk_id")
    return known.unionByName(other)


def latest(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """The rows of the latest time of each key; ties all stay."""
    return rows.withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(at)))).where("place = 1").drop("place")


def _seeds(s, d):
    return table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey") * 4).alias("seed"))


def _chunks(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") * 2).alias("chunk_id")).unionByName(table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") * 2 + 1).alias("chunk_id")))


def _sourced(s, d):
    return triples(s, d).withColumn("source_chunk_id", F.when(F.col("predicate") == "1-URGENT", F.col("doc_id") * 2))


def _lifecycle(s, d):
    state = F.when(F.col("predicate") == "1-URGENT", "retracted").when(F.col("predicate") == "2-HIGH", "disputed").otherwise("none")
    score = lifecycle_score(F.lit(0.5), F.col("confidence"), F.when(F.col("confidence") > 0.3, F.col("confidence")), F.col("confidence") - 0.2, state)
    return triples(s, d).select("triple_id", F.round(score, 6).alias("score"))


def _odd(s, d, each: int = 4):
    """Statements, ``each`` of a document, of which some speak of nothing, of a pronoun, of a number, of themselves, or say nothing."""
    k = F.col("triple_id") % 17
    subject = F.when(k == 0, "").when(k == 1, "He").when(k == 2, F.col("object")).when(k == 3, " x ").when(k == 4, "12 345.6").when(k == 5, F.lit(None)).when(k == 9, "unknown").otherwise(F.col("subject"))
    rows = triples(s, d).withColumn("doc_id", F.floor(F.col("triple_id") / each))
    return rows.withColumns({"subject": subject, "predicate": F.when(k == 6, "IS").when(k == 7, "y").otherwise(F.col("predicate")), "object": F.when(k == 8, F.repeat(F.lit("word "), 9)).otherwise(F.col("object")), "confidence": F.col("triple_id") * 7 % 20 / 20})


QUERIES = {
    "valid_triples": lambda s, d: valid_triples(_odd(s, d)).select("triple_id"),
    "quality_triples": lambda s, d: quality_triples(_odd(s, d)).select("triple_id", "confidence"),
    "bad_sources": lambda s, d: bad_documents(triples(s, d)),
    "top_entities": lambda s, d: top_entities(triples(s, d)),
    "resolved_contradictions": lambda s, d: resolved_contradictions(triples(s, d)),
    "lifecycle_score": _lifecycle,
    "graph_edges": lambda s, d: graph_edges(triples(s, d)),
    "two_hops": lambda s, d: two_hops(triples(s, d), _seeds(s, d)).select("seed", "triple_id", "hop"),
    "communities": lambda s, d: communities(graph_edges(triples(s, d)), 3),
    "community_metrics": lambda s, d: community_metrics(graph_edges(triples(s, d)), table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("community")).unionByName(graph_edges(triples(s, d)).select(F.col("b").alias("node")).distinct().withColumn("community", F.concat(F.lit("n"), F.floor(F.substring("node", 2, 9).cast("int") / 4))))),
    "triangles": lambda s, d: triangles(table(s, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("p"), "l_suppkey").alias("b")).where("a < b").distinct()),
    "entity_merges": lambda s, d: entity_merges(triples(s, d).withColumn("subject", F.concat(F.when(F.col("triple_id") % 3 == 0, "Dr. ").otherwise(""), "subject"))),
    "consistent_frequency": lambda s, d: consistent(triples(s, d))[1],
    "with_context": lambda s, d: with_context(table(s, d, "labels").select("doc_id"), _odd(s, d, 9)),
    "source_join": lambda s, d: source_join(_sourced(s, d), _chunks(s, d)),
    "latest_statements": lambda s, d: latest(triples(s, d), ["subject"], "valid_from").select("triple_id", "subject"),
}
_ODD = T + f""", odd AS (SELECT triple_id, CASE triple_id % 17 WHEN 0 THEN '' WHEN 1 THEN 'He' WHEN 2 THEN object WHEN 3 THEN ' x ' WHEN 4 THEN '12 345.6' WHEN 5 THEN NULL WHEN 9 THEN 'unknown' ELSE subject END AS subject, CASE triple_id % 17 WHEN 6 THEN 'IS' WHEN 7 THEN 'y' ELSE predicate END AS predicate,
  CASE triple_id % 17 WHEN 8 THEN repeat('word ', 9) ELSE object END AS object, triple_id * 7 % 20 / 20 AS confidence, triple_id // 4 AS doc_id FROM triples),
valid AS (SELECT * FROM odd WHERE length(trim(subject)) >= 2 AND length(trim(object)) >= 2 AND length(trim(predicate)) >= 2 AND lower(trim(subject)) <> lower(trim(object)) AND lower(trim(subject)) NOT IN {NOTHING + PRONOUNS} AND lower(trim(object)) NOT IN {NOTHING + PRONOUNS})"""
_EDGES = T + ", edges AS (SELECT least(subject, object) AS a, greatest(subject, object) AS b, arg_max(predicate, triple_id) AS predicate FROM triples GROUP BY 1, 2)"
_ENDS = T + ", ends AS (SELECT triple_id, subject AS entity, object AS other FROM triples UNION ALL SELECT triple_id, object, subject FROM triples)"
_PP = "WITH edges AS (SELECT DISTINCT 'p' || l_partkey AS a, 'p' || l_suppkey AS b FROM lineitem WHERE 'p' || l_partkey < 'p' || l_suppkey), two AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges)"
ORACLE_SQL = {
    "valid_triples": f"{_ODD} SELECT triple_id FROM valid",
    "quality_triples": f"{_ODD}, s AS (SELECT * FROM valid WHERE confidence >= 0.25 AND NOT regexp_matches(subject, '^[0-9.,\\s]+$') AND length(subject) <= 80 AND length(object) <= 80 AND len(string_split_regex(object, '\\s+')) <= 8 AND lower(predicate) NOT IN {GENERIC}), k AS (SELECT *, max(confidence >= 0.5) OVER (PARTITION BY doc_id) AS sure FROM s) SELECT triple_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY lower(subject), lower(predicate), lower(object) ORDER BY confidence DESC, triple_id) AS nth FROM k WHERE confidence >= 0.5 OR NOT sure) WHERE nth = 1",
    "bad_sources": f"{T} SELECT subject, count(*) AS n, count(*) FILTER (confidence < 0.3) AS failed FROM triples GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (confidence < 0.3) >= 0.5 * count(*)",
    "top_entities": f"{T} SELECT object AS entity, count(*) AS n FROM triples GROUP BY 1 ORDER BY n DESC, entity LIMIT 20",
    "resolved_contradictions": f"{T}, b AS (SELECT subject, predicate, arg_max(triple_id, (confidence, valid_from, triple_id)) AS id FROM triples GROUP BY 1, 2 HAVING count(DISTINCT object) > 1) SELECT t.triple_id, CASE WHEN t.object = w.object THEN 'kept' WHEN t.valid_from <= w.valid_to AND t.valid_to >= w.valid_from THEN CASE WHEN w.confidence - t.confidence >= 0.15 THEN 'contradicted' ELSE 'disputed' END ELSE 'superseded' END AS state FROM triples t JOIN b USING (subject, predicate) JOIN triples w ON w.triple_id = b.id",
    "lifecycle_score": f"{T}, a AS (SELECT *, 0.35::DOUBLE * 0.5 + 0.65::DOUBLE * confidence AS s FROM triples), e AS (SELECT *, CASE WHEN confidence > 0.3 THEN 0.5::DOUBLE * s + 0.5::DOUBLE * confidence ELSE s END AS s2 FROM a), g AS (SELECT *, CASE WHEN confidence - 0.2::DOUBLE < 0 THEN 0.9::DOUBLE * s2 ELSE 0.6::DOUBLE * s2 + 0.4::DOUBLE * (confidence - 0.2::DOUBLE) END AS s3 FROM e) SELECT triple_id, round(s3 * CASE predicate WHEN '1-URGENT' THEN 0.15::DOUBLE WHEN '2-HIGH' THEN 0.55::DOUBLE ELSE 1 END, 6) AS score FROM g",
    "graph_edges": f"{_EDGES} SELECT * FROM edges",
    "two_hops": f"{_ENDS}, one AS (SELECT entity AS seed, other, triple_id FROM ends WHERE entity IN (SELECT 'n' || (n_nationkey * 4) FROM nation)), new AS (SELECT seed, other AS entity FROM (SELECT DISTINCT seed, other FROM one) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY length(other), other) <= 5), capped AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY entity ORDER BY triple_id) <= 10) SELECT DISTINCT seed, triple_id, 1 AS hop FROM one UNION ALL SELECT * FROM (SELECT DISTINCT seed, triple_id, 2 FROM new JOIN capped USING (entity)) WHERE (seed, triple_id) NOT IN (SELECT (seed, triple_id) FROM one)",
    "community_metrics": f"{_EDGES}, m AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS community FROM customer UNION ALL SELECT DISTINCT b, 'n' || (substr(b, 2)::INT // 4) FROM edges), k AS (SELECT x.community, count(*) AS edges FROM edges JOIN m x ON a = x.node JOIN m y ON b = y.node WHERE x.community = y.community GROUP BY 1), z AS (SELECT community, count(*) AS nodes FROM m GROUP BY 1) SELECT community, nodes, coalesce(edges, 0) AS edges, round(CASE WHEN nodes > 1 THEN coalesce(edges, 0) / (nodes * (nodes - 1) / 2) ELSE 0 END, 6)::DOUBLE AS density FROM z LEFT JOIN k USING (community)",
    "triangles": f"{_PP}, g AS (SELECT a AS node, count(*) AS degree FROM two GROUP BY 1), t AS (SELECT x.a AS node, count(*) // 2 AS triangles FROM two x JOIN two y ON x.b = y.a JOIN two z ON y.b = z.a AND z.b = x.a GROUP BY 1) SELECT node, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 6)::DOUBLE AS clustering FROM g LEFT JOIN t USING (node)",
    "entity_merges": f"{T}, k AS (SELECT entity, count(*) AS k FROM (SELECT CASE WHEN triple_id % 3 = 0 THEN 'Dr. ' ELSE '' END || subject AS entity FROM triples UNION ALL SELECT object FROM triples) GROUP BY 1), f AS (SELECT *, replace(entity, 'Dr. ', '') AS form FROM k), b AS (SELECT form, arg_max(entity, (k, entity)) AS canonical FROM f GROUP BY 1 HAVING count(*) > 1) SELECT entity, canonical FROM f JOIN b USING (form) WHERE entity <> canonical",
    "consistent_frequency": f"{T}, k AS (SELECT DISTINCT subject, predicate, object FROM triples WHERE length(subject) >= 2 AND length(object) >= 2) SELECT entity, count(*) AS frequency FROM (SELECT subject AS entity FROM k UNION ALL SELECT object FROM k) GROUP BY 1",
    "with_context": f"{_ODD}, n AS (SELECT *, row_number() OVER (PARTITION BY triple_id // 9 ORDER BY confidence DESC, triple_id) AS nth FROM odd), c AS (SELECT triple_id // 9 AS doc_id, string_agg(concat_ws(' ', subject, predicate, object), '; ' ORDER BY nth) AS context FROM n WHERE nth <= 5 GROUP BY 1) SELECT l.doc_id, context FROM labels l LEFT JOIN c USING (doc_id)",
    "source_join": f"{T} SELECT triple_id, unnest(CASE WHEN predicate = '1-URGENT' THEN [doc_id * 2] ELSE [doc_id * 2, doc_id * 2 + 1] END) AS chunk_id FROM triples",
    "latest_statements": f"{T} SELECT triple_id, subject FROM triples QUALIFY rank() OVER (PARTITION BY subject ORDER BY valid_from DESC) = 1",
}
