"""What lies within some steps of many seeds at once, and statements for a question by its entities, communities and second steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.communities import _by_nation, community_triples
from millrace.operators.knowledge import _EDGES, T, graph_edges, lifecycle_score, triples
from millrace.operators.vectors import approximate_topk
from millrace.sources.shared import settled
from millrace.sources.tables import table

#: What an entity found by a community or by a second step counts, and the least likeness of an entity.
BY_COMMUNITY, BY_STEP, LEAST_ALIKE = 0.4, 0.3, 0.3


def subgraph_nodes(edges: DataFrame, seeds: DataFrame, hops: int = 2, each: int = 10) -> DataFrame:
    """(seed, node, hop): for each seed (seed, node) all nodes within so many steps, at the least number of them.

    A node hands out its first ``each`` neighbours only (by name), at every step, so that a hub adds no more than others; the cut
    is made once, on the neighbours, before they meet the seeds. What a seed has seen is taken out by an anti-join, step by step.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    nth = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    near = settled(both.withColumn("nth", nth).where(F.col("nth") <= each).select("a", "b"))
    seen = frontier = settled(seeds.select("seed", "node").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, hops + 1):
        new = frontier.select("seed", F.col("node").alias("a")).join(near, "a").select("seed", F.col("b").alias("node")).distinct()
        frontier = settled(new.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def subgraph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, a, b): edges with both ends among a seed's nodes (seed, node)."""
    a, b = nodes.select("seed", F.col("node").alias("a")), nodes.select(F.col("seed").alias("other"), F.col("node").alias("b"))
    return edges.select("a", "b").distinct().join(a, "a").join(b, "b").where("seed = other").select("seed", "a", "b")


def entity_topk(queries: DataFrame, entities: DataFrame, k: int = 15, least: float = LEAST_ALIKE, recall: float = 0.95) -> DataFrame:
    """(query_id, entity, score, rank): the entities (entity, embedding) most like each query (query_id, embedding), above a likeness.
    Names are numbered by a hash for the index; a query that is an entity itself is its own neighbour here."""
    named = entities.select(F.xxhash64("entity").alias("vec_id"), "entity", "embedding")
    asked = queries.select((F.col("query_id") * 2 + 1).cast("long").alias("query_id"), "embedding")
    found = approximate_topk(named.select("vec_id", "embedding"), asked, k, recall=recall)
    found = found.where(F.col("score") > least).join(named.select("vec_id", "entity"), "vec_id")
    return found.select(F.shiftright("query_id", 1).alias("query_id"), "entity", "score", "rank")


def statement_candidates(matched: DataFrame, rows: DataFrame, members: DataFrame, k: int = 5, entities: int = 10, second: int = 5, each: int = 10) -> DataFrame:
    """(query_id, triple_id, hop, score, rank): the best k statements for each query's matched entities (query_id, entity, score).

    Statements on the first ``entities`` entities (by score, 4 k of each by id) have their scores; those that members of the
    entities' communities add, 0.4; those on the ``second`` shortest new names of the first ones, ``each`` of these, 0.3. A
    statement counts once, at its first way: 1, then 1.5 by community, then 2. The score is blended with what is known of the
    statement (confidence, evidence, grounding, state: columns of ``rows``, null where unknown).
    """
    matched = matched.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entity"))).where(F.col("nth") <= entities).drop("nth")
    matched = settled(matched)
    sides = F.explode(F.array_distinct(F.array("subject", "object")))
    ends = rows.select("triple_id", "subject", "object", sides.alias("entity"))
    cut = lambda frame, n: frame.withColumn("nth", F.row_number().over(Window.partitionBy("entity").orderBy("triple_id"))).where(F.col("nth") <= n).drop("nth")
    one = cut(ends.join(matched.select("entity").distinct(), "entity", "left_semi"), 4 * k).join(matched, "entity")
    first = settled(one.groupBy("query_id", "triple_id", "subject", "object").agg(F.max("score").alias("score")).withColumn("hop", F.lit(1.0)))
    by_community = community_triples(matched.select("query_id", "entity"), members, rows, each=2 * k)
    by_community = by_community.select("query_id", "triple_id", F.lit(BY_COMMUNITY).alias("score"), F.lit(1.5).alias("hop"))
    new = first.select("query_id", F.explode(F.array("subject", "object")).alias("entity")).distinct().join(matched.select("query_id", "entity"), ["query_id", "entity"], "left_anti")
    new = new.where(F.length(F.trim("entity")) >= 3)
    new = new.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.length("entity"), "entity"))).where(F.col("nth") <= second).select("query_id", "entity")
    two = cut(ends.join(new.select("entity").distinct(), "entity", "left_semi"), each).join(new, "entity").select("query_id", "triple_id", F.lit(BY_STEP).alias("score"), F.lit(2.0).alias("hop"))
    every = first.select("query_id", "triple_id", "score", "hop").unionByName(by_community).unionByName(two)
    once = every.groupBy("query_id", "triple_id").agg(F.min(F.struct("hop", F.negative("score").alias("less"))).alias("way"))
    once = once.select("query_id", "triple_id", F.col("way.hop").alias("hop"), F.negative("way.less").alias("entity_score"))
    known = [F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("confidence", "double"), ("evidence", "double"), ("grounding", "double"), ("state", "string"))]
    judged = once.join(rows.select("triple_id", *known), "triple_id")
    state = F.coalesce("state", F.lit("none"))
    score = F.round(lifecycle_score(F.col("entity_score"), F.col("confidence"), F.col("evidence"), F.col("grounding"), state), 6)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "triple_id")
    found = judged.select("query_id", "triple_id", "hop", score.alias("score")).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k)


def _seeds(s, d):
    return table(s, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("seed"), F.concat(F.lit("c"), "c_custkey").alias("node"))


def _edges(s, d):
    return graph_edges(triples(s, d))


def _matched(s, d):
    own = table(s, d, "customer").where("c_custkey % 4 = 1")
    return own.select(F.col("c_nationkey").alias("query_id"), F.concat(F.lit("c"), "c_custkey").alias("entity"), (F.col("c_custkey") % 11 / 11).alias("score"))


def _entity_vectors(s, d):
    rows = table(s, d, "embeddings")
    moved = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i % 8 == 0, 0.05).otherwise(0.0))
    return rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), moved.alias("embedding")), rows.select(F.concat(F.lit("e"), "vec_id").alias("entity"), "embedding")


QUERIES = {
    "subgraph_nodes": lambda s, d: subgraph_nodes(_edges(s, d), _seeds(s, d), 3, 6),
    "subgraph_edges": lambda s, d: subgraph_edges(_edges(s, d), subgraph_nodes(_edges(s, d), _seeds(s, d), 2, 6)).groupBy("seed").agg(F.count("*").alias("edges")),
    "statement_candidates": lambda s, d: statement_candidates(_matched(s, d), triples(s, d), _by_nation(s, d), 10),
    "entity_topk": lambda s, d: entity_topk(*_entity_vectors(s, d), 3),
}
_HOPS = f"""{_EDGES}, ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), near AS (SELECT a, b FROM ways QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) <= 6),
h0 AS (SELECT c_custkey AS seed, 'c' || c_custkey AS node FROM customer WHERE c_custkey % 5 = 0),
h1 AS (SELECT DISTINCT seed, b AS node FROM h0 JOIN near ON node = a EXCEPT SELECT * FROM h0),
h2 AS (SELECT DISTINCT seed, b AS node FROM h1 JOIN near ON node = a EXCEPT (SELECT * FROM h0 UNION SELECT * FROM h1)),
h3 AS (SELECT DISTINCT seed, b AS node FROM h2 JOIN near ON node = a EXCEPT (SELECT * FROM h0 UNION SELECT * FROM h1 UNION SELECT * FROM h2))"""
ORACLE_SQL = {
    "subgraph_nodes": f"{_HOPS} SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3",
    "subgraph_edges": f"{_HOPS}, n AS (SELECT * FROM h0 UNION SELECT * FROM h1 UNION SELECT * FROM h2) SELECT x.seed, count(*) AS edges FROM edges JOIN n x ON a = x.node JOIN n y ON b = y.node AND x.seed = y.seed GROUP BY 1",
    "statement_candidates": f"""{T}, m AS (SELECT 'c' || c_custkey AS node, c_nationkey AS community FROM customer WHERE 'c' || c_custkey IN (SELECT subject FROM triples) UNION ALL SELECT DISTINCT object, substr(object, 2)::INT // 4 FROM triples), size AS (SELECT community, count(*) AS size FROM m GROUP BY 1),
matched AS (SELECT c_nationkey AS query_id, 'c' || c_custkey AS entity, c_custkey % 11 / 11 AS score FROM customer WHERE c_custkey % 4 = 1 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 11 DESC, 'c' || c_custkey) <= 10),
ends AS (SELECT triple_id, subject, object, subject AS entity FROM triples UNION ALL SELECT triple_id, subject, object, object FROM triples WHERE subject <> object), nth AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY triple_id) AS nth FROM ends),
one AS (SELECT query_id, triple_id, any_value(subject) AS subject, any_value(object) AS object, max(score) AS score FROM nth JOIN matched USING (entity) WHERE nth <= 40 GROUP BY 1, 2),
chosen AS (SELECT query_id, community, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community) AS rank FROM (SELECT query_id, community, round(count(*) / sqrt(any_value(size)), 6) AS score FROM matched JOIN m ON entity = node JOIN size USING (community) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community) <= 3),
wanted AS (SELECT query_id, rank, community, node AS entity FROM chosen JOIN m USING (community) WHERE (query_id, node) NOT IN (SELECT (query_id, entity) FROM matched) QUALIFY row_number() OVER (PARTITION BY query_id, community ORDER BY node) <= 10),
seen AS (SELECT DISTINCT query_id, triple_id FROM ends JOIN matched USING (entity)),
cf AS (SELECT query_id, rank, community, w.entity, triple_id FROM wanted w JOIN ends USING (entity) WHERE NOT EXISTS (SELECT 1 FROM seen z WHERE z.query_id = w.query_id AND z.triple_id = ends.triple_id) QUALIFY row_number() OVER (PARTITION BY query_id, w.entity ORDER BY triple_id) <= 20),
com AS (SELECT query_id, triple_id FROM (SELECT query_id, triple_id, min((rank, entity, community)) AS f FROM cf GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY f, triple_id) <= 50),
new AS (SELECT * FROM (SELECT DISTINCT query_id, entity FROM (SELECT query_id, unnest([subject, object]) AS entity FROM one) WHERE (query_id, entity) NOT IN (SELECT (query_id, entity) FROM matched) AND length(entity) >= 3) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(entity), entity) <= 5),
every AS (SELECT query_id, triple_id, 1.0 AS hop, score FROM one UNION ALL SELECT query_id, triple_id, 1.5, 0.4 FROM com UNION ALL SELECT query_id, triple_id, 2.0, 0.3 FROM nth JOIN new USING (entity) WHERE nth <= 10),
once AS (SELECT query_id, triple_id, min((hop, -score)) AS way FROM every GROUP BY 1, 2)
SELECT query_id, triple_id, hop, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, triple_id)::INT AS rank FROM (SELECT query_id, triple_id, way[1]::DOUBLE AS hop, round(0.35::DOUBLE * -way[2] + 0.65::DOUBLE * confidence, 6) AS score FROM once JOIN triples USING (triple_id)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, triple_id) <= 10""",
}
