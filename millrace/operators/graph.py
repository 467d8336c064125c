"""Operators on a graph of triples derived from orders: customers, their nation, and what they buy with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.sources.tables import table


def triples(spark, d):
    """(subject, predicate, object, confidence): one for each order."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("subject"), F.col("o_orderpriority").alias("predicate"),
        F.concat(F.lit("n"), (F.col("c_nationkey") * 4 + F.col("o_orderkey") % 4).cast("string")).alias("object"), (F.col("o_orderkey") % 7 / 10).alias("confidence"), F.col("o_orderkey").alias("triple_id"),
    )


T = """WITH triples AS (SELECT 'c' || o_custkey AS subject, o_orderpriority AS predicate, 'n' || (c_nationkey * 4 + o_orderkey % 4) AS object,
  (o_orderkey % 7) / 10 AS confidence, o_orderkey AS triple_id FROM orders JOIN customer ON o_custkey = c_custkey)
"""


def kg_noisy_or(spark, d):
    """Equal triples as one: the chance that any of them holds, at most 0.99."""
    odds = 1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))
    return triples(spark, d).groupBy("subject", "predicate", "object").agg(F.round(F.least(F.lit(0.99), F.greatest(F.max("confidence"), odds)), 12).alias("confidence"), F.count("*").alias("mentions"))


def predicate_idf(spark, d):
    rows = triples(spark, d).groupBy(F.lower(F.trim("predicate")).alias("predicate")).agg(F.count("*").alias("f"))
    total = triples(spark, d).agg(F.count("*").alias("n"))
    idf = F.log((F.col("n") + 1) / (F.col("f") + 1)) / F.log((F.col("n") + 1) / F.lit(2))
    return rows.join(F.broadcast(total)).select("predicate", F.round(F.when(idf <= 0.05, 0.0).otherwise(F.least(idf, F.lit(1.0))), 6).alias("idf"))


def entity_frequency(spark, d):
    rows = triples(spark, d)
    return rows.select(F.explode(F.array("subject", "object")).alias("entity")).groupBy("entity").agg(F.count("*").alias("frequency"))


def kg_contradictions(spark, d):
    """For each subject and predicate with several objects, the object of most confidence wins."""
    rows = triples(spark, d)
    w = Window.partitionBy("subject", "predicate")
    many = rows.withColumns({"lo": F.min("object").over(w), "hi": F.max("object").over(w)}).where("lo <> hi")
    rank = F.row_number().over(w.orderBy(F.desc("confidence"), "triple_id"))
    return many.withColumn("i", rank).where("i = 1").select("subject", "predicate", "object", "triple_id")


def edges(spark, d):
    return triples(spark, d).select("subject", "object").distinct()


def node_degree(spark, d):
    e = edges(spark, d)
    both = e.select(F.col("subject").alias("node")).unionByName(e.select(F.col("object").alias("node")))
    return both.groupBy("node").agg(F.count("*").alias("degree"))


QUERIES = {f.__name__: f for f in (kg_noisy_or, predicate_idf, entity_frequency, kg_contradictions, node_degree)}
ORACLE_SQL = {
    "kg_noisy_or": T + "SELECT subject, predicate, object, round(least(0.99, greatest(max(confidence), 1 - exp(sum(ln(1 - confidence))))), 12) AS confidence, count(*) AS mentions FROM triples GROUP BY 1, 2, 3",
    "predicate_idf": T + "SELECT predicate, round(CASE WHEN i <= 0.05 THEN 0 ELSE least(i, 1) END, 6)::DOUBLE AS idf FROM (SELECT lower(trim(predicate)) AS predicate, ln(((SELECT count(*) FROM triples) + 1) / (count(*) + 1)) / ln(((SELECT count(*) FROM triples) + 1) / 2) AS i FROM triples GROUP BY 1)",
    "entity_frequency": T + "SELECT entity, count(*) AS frequency FROM (SELECT subject AS entity FROM triples UNION ALL SELECT object FROM triples) GROUP BY 1",
    "kg_contradictions": T + "SELECT subject, predicate, object, triple_id FROM (SELECT *, min(object) OVER w AS lo, max(object) OVER w AS hi, row_number() OVER (PARTITION BY subject, predicate ORDER BY confidence DESC, triple_id) AS i FROM triples WINDOW w AS (PARTITION BY subject, predicate)) WHERE lo <> hi AND i = 1",
    "node_degree": T + "SELECT node, count(*) AS degree FROM (SELECT DISTINCT subject AS node, object AS other FROM triples UNION ALL SELECT DISTINCT object, subject FROM triples) GROUP BY 1",
}
