"""Entities that are the same: names merged where case, likeness of vectors and words agree, without chains.

Names (entity, frequency, embedding) that differ in case and outer white space only are one. Of the rest, pairs alike by cosine make a
graph, which is cut into cliques as a loop would that takes the node of most neighbours, its nearest neighbour, then all that are
near to every member, and begins again. Nodes that no node within two steps outranks take their cliques at once: that gives
the loop's result in few rounds.
"""

from __future__ import annotations

from decimal import ROUND_CEILING, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.knowledge import normal_entity, triples
from millrace.operators.vectors import equal_vectors, matrix, near_pairs, unit_vectors
from millrace.sources.shared import settled


def case_classes(names: DataFrame) -> DataFrame:
    """(entity, canonical): for each name the most frequent one that differs in case and outer white space only (ties: the greatest)."""
    key = F.lower(F.trim("entity"))
    best = names.groupBy(key.alias("key")).agg(F.max_by("entity", F.struct("frequency", "entity")).alias("canonical"))
    return names.withColumn("key", key).join(best, "key").select("entity", "canonical")


def grown(vectors: pa.Table, least: float) -> pa.Table:
    """(node, clique) of a centre's neighbours (centre, x, score, embedding): a task holds their vectors, not which of them are neighbours."""
    # What rounds to the least number of five places that is enough.
    least = float(Decimal(repr(least)).quantize(Decimal("1e-5"), ROUND_CEILING) - Decimal("5e-6"))
    x, score, units = vectors.column("x").to_numpy(), vectors.column("score").to_numpy(), matrix(vectors.column("embedding"))
    order = np.argsort(x)
    x, score, units = x[order], score[order], units[order]
    near = lambda i, of: np.einsum("ij,ij->i", of, np.broadcast_to(units[i], of.shape)) >= least
    member = int(np.lexsort((x, score))[-1])
    members, open_to = [member], np.delete(np.arange(len(x)), member)
    of = units[open_to]
    while len(open_to):
        fits = near(member, of)
        if not fits.all():
            open_to, of = open_to[fits], of[fits]
        if len(open_to):
            member, open_to, of = int(open_to[0]), open_to[1:], of[1:]
            members.append(member)
    nodes = [*x[members].tolist(), vectors.column("centre")[0].as_py()]
    return pa.table({"node": pa.array(nodes, pa.int64()), "clique": pa.array(nodes[-1:] * len(nodes), pa.int64())})


def cliques(pairs: DataFrame, sizes: DataFrame, units: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """(node, clique): greedy cliques of a graph of pairs (a, b, score) of nodes (node, size), named by the node that each began with.

    A node stands for ``size`` equal ones. The node of most neighbours, its equals included (ties: the least), begins; its nearest
    neighbour (ties: the greatest) joins, then, from the least, every node that all members are next to. Nodes left without
    neighbours are a clique if they stand for several, else in none. With ``units`` (node, embedding), nodes are neighbours where these are at
    least so alike, and ``pairs`` has all of them: then no neighbours of neighbours are joined, whose number is the square of a node's.
    """
    both = pairs.select("a", "b", "score").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    left = settled(both.where("a <> b").groupBy("a", "b").agg(F.max("score").alias("score")))
    out = None
    while not left.isEmpty():
        weights = left.join(sizes.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.sum("size").alias("others"))
        weights = weights.join(sizes.withColumnRenamed("node", "a"), "a")
        ranks = weights.select(F.col("a").alias("node"), F.struct((F.col("others") + F.col("size")).alias("degree"), F.negative("a").alias("least")).alias("rank"))
        near = left.join(ranks.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.max("rank").alias("near"))
        one = ranks.join(near, "node").select("node", "rank", F.greatest("rank", "near").alias("top"))
        far = left.join(one.select(F.col("node").alias("b"), "top"), "b").groupBy(F.col("a").alias("node")).agg(F.max("top").alias("far"))
        centres = settled(one.join(far, "node").where((F.col("rank") >= F.col("top")) & (F.col("rank") >= F.col("far"))).select("node"))
        spokes = left.join(centres.withColumnRenamed("node", "a"), "a").select(F.col("a").alias("centre"), F.col("b").alias("x"), "score")
        if units is not None:
            held = spokes.join(units.withColumnRenamed("node", "x"), "x").select("centre", "x", "score", "embedding")
            found = settled(held.groupBy("centre").applyInArrow(lambda t: grown(t, least), "node long, clique long"))
            out, left = _without(out, left, found)
            continue
        inner = spokes.select("centre", "x").join(left.select(F.col("a").alias("x"), F.col("b").alias("y")), "x").join(spokes.select("centre", F.col("x").alias("y")), ["centre", "y"])
        rows = spokes.select("centre", "x", F.lit(None).cast("long").alias("y"), "score").unionByName(inner.select("centre", "x", "y", F.lit(0.0).alias("score")))

        def grow(table: pa.Table) -> pa.Table:
            centre = table.column("centre")[0].as_py()
            next_to: dict[int, set[int]] = {}
            scores: dict[int, float] = {}
            for x, y, score in zip(*(table.column(c).to_pylist() for c in ("x", "y", "score")), strict=True):
                if y is None:
                    scores[x] = score
                else:
                    next_to.setdefault(x, set()).add(y)
            first = max(scores, key=lambda x: (scores[x], x))
            members = [first]
            fits = set(next_to.get(first, ())) & set(scores)
            for x in sorted(scores):
                if x in fits:
                    members.append(x)
                    fits &= next_to.get(x, set())
            members.append(centre)
            return pa.table({"node": pa.array(members, pa.int64()), "clique": pa.array([centre] * len(members), pa.int64())})

        found = settled(rows.groupBy("centre").applyInArrow(grow, "node long, clique long"))
        out, left = _without(out, left, found)
    many = sizes.where("size > 1").select("node", F.col("node").alias("clique"))
    return many if out is None else out.unionByName(many.join(out, "node", "left_anti"))


def _without(out: DataFrame | None, left: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All cliques so far, and the pairs of nodes that are in none."""
    gone = found.select("node")
    left = left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
    return found if out is None else settled(out.unionByName(found)), settled(left)


def name_words(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal_entity(name), " "), lambda w: w != ""))


def accepted(members: DataFrame, least: float, sure: float, lexical: float) -> DataFrame:
    """Members (entity, vector, canonical, canonical_vector) alike enough to their canonical name, or less so but with words in common."""
    a, b = name_words(F.col("entity")), name_words(F.col("canonical"))
    words = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    score = F.round(F.aggregate(F.zip_with("vector", "canonical_vector", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 5)
    rows = members.withColumns({"score": score, "words": F.round(words, 6)})
    return rows.where((F.col("score") >= sure) | ((F.col("score") >= least) & (F.col("words") >= lexical)))


def resolve_entities(names: DataFrame, least: float = 0.92, sure: float | None = None, lexical: float = 0.35) -> DataFrame:
    """(entity, canonical, reason) of every name that is merged into another: by case, or by a clique; a name that is merged by case
    goes where the one goes that it is merged into.

    names: (entity, frequency, embedding), one row for each name. A clique's canonical name is its most frequent (ties: the
    greatest); a member is merged if it is at least ``sure`` alike (by default 0.03 above
    ``least``), or shares ``lexical`` of its words. Names without a vector merge by case only. No name is merged over a third:
    every accepted member was compared with its canonical name itself. All pairs are found.
    """
    sure = min(0.995, least + 0.03) if sure is None else sure
    names = settled(names.where("entity is not null").select("entity", F.coalesce("frequency", F.lit(1)).cast("long").alias("frequency"), "embedding"))
    cases = case_classes(names)
    by_case = cases.where("entity <> canonical").select("entity", "canonical", F.lit("case").alias("reason"))
    alone = names.join(cases.where("entity = canonical").select("entity"), "entity", "left_semi").where("embedding is not null")
    alone = alone.groupBy("entity").agg(F.max(F.struct("frequency", "embedding")).alias("row")).select("entity", "row.*")
    alone = settled(alone.withColumn("vec_id", F.xxhash64("entity")))
    classes = settled(equal_vectors(unit_vectors(alone.select("vec_id", "embedding"))))
    sizes = classes.groupBy(F.col("first").alias("node")).agg(F.count("*").alias("size"))
    one = classes.where("vec_id = first")
    links = settled(near_pairs(one, least))
    grouped = cliques(links, settled(sizes), one.select(F.col("vec_id").alias("node"), "embedding"), least).join(classes.withColumnRenamed("first", "node"), "node").join(alone.drop("embedding"), "vec_id")
    best = F.max_by(F.struct(F.col("entity").alias("canonical"), F.col("embedding").alias("canonical_vector")), F.struct("frequency", "entity"))
    grouped = grouped.join(grouped.groupBy("clique").agg(best.alias("best")), "clique").select("entity", F.col("embedding").alias("vector"), "best.*").where("entity <> canonical")
    alike = accepted(grouped, least, sure, lexical).select("entity", "canonical", F.lit("alike").alias("reason"))
    on = alike.select(F.col("entity").alias("canonical"), F.col("canonical").alias("further"))
    by_case = by_case.join(on, "canonical", "left").select("entity", F.coalesce("further", "canonical").alias("canonical"), "reason")
    return by_case.unionByName(alike)


def renamed(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """Statements (triple_id, subject, predicate, object, confidence) with canonical names; equal ones become one, of the least id,
    with the confidence that at least one of them holds."""
    for side in ("subject", "object"):
        to = merges.select(F.col("entity").alias(side), "canonical")
        rows = rows.join(to, side, "left").withColumn(side, F.coalesce("canonical", side)).drop("canonical")
    doubt = F.exp(F.sum(F.log(F.greatest(1 - F.coalesce("confidence", F.lit(0.0)), F.lit(1e-12)))))
    return rows.groupBy("subject", "predicate", "object").agg(F.min("triple_id").alias("triple_id"), F.round(1 - doubt, 6).alias("confidence"), F.count("*").alias("merged"))


def _names(s, d):
    """Customers of the statements as entities, each with a shouted and a titled form, whose vectors are a little moved."""
    from millrace.operators.vectors import _vectors

    counts = triples(s, d).groupBy("subject").agg(F.count("*").alias("frequency")).withColumn("n", F.substring("subject", 2, 12).cast("long"))
    vectors = _vectors(s, d).select(F.col("vec_id").alias("n"), "embedding")
    base = counts.join(vectors, "n").select("n", F.concat(F.lit("Customer "), "n").alias("entity"), "frequency", "embedding")
    moved = lambda k: F.transform("embedding", lambda x, i: x + F.when(i % 9 == k, 0.13).otherwise(0.0))
    loud = base.select(F.upper("entity").alias("entity"), (F.col("frequency") - 1).alias("frequency"), "embedding")
    titled = base.where("n % 2 = 0").select(F.concat(F.lit("Dr. "), "entity").alias("entity"), F.lit(1).cast("long").alias("frequency"), moved(1).alias("embedding"))
    other = base.where("n % 5 = 0").select(F.concat(F.lit("Client no "), "n").alias("entity"), F.lit(2).cast("long").alias("frequency"), moved(2).alias("embedding"))
    return base.drop("n").unionByName(loud).unionByName(titled).unionByName(other)


QUERIES = {
    "resolve_entities": lambda s, d: resolve_entities(_names(s, d)),
    "renamed_statements": lambda s, d: renamed(triples(s, d), triples(s, d).select(F.col("object").alias("entity"), F.concat(F.lit("n"), F.floor(F.substring("object", 2, 9).cast("int") / 4)).alias("canonical")).distinct()),
}
_T = """WITH triples AS (SELECT o_orderkey AS triple_id, 'c' || o_custkey AS subject, o_orderpriority AS predicate, 'n' || (c_nationkey * 4 + o_orderkey % 4) AS object, (o_orderkey % 10 / 10)::DOUBLE AS confidence FROM orders JOIN customer ON o_custkey = c_custkey)"""
ORACLE_SQL = {
    "resolve_entities": f"""{_T}, base AS (SELECT vec_id AS n, k AS f, embedding::DOUBLE[] AS e FROM embeddings JOIN (SELECT substr(subject, 2)::BIGINT AS n, count(*) AS k FROM triples GROUP BY 1) ON n = vec_id),
w AS (SELECT n, f, e, list_transform(e, lambda x, i: x + CASE WHEN (i - 1) % 9 = 1 THEN 0.13::DOUBLE ELSE 0 END) AS dr,
  list_transform(e, lambda x, i: x + CASE WHEN (i - 1) % 9 = 2 THEN 0.13::DOUBLE ELSE 0 END) AS cl FROM base),
s AS (SELECT n, f, 'Customer ' || n AS b, 'Dr. Customer ' || n AS d, 'Client no ' || n AS c, CASE WHEN n % 2 = 0 THEN round(list_inner_product(e, dr) / sqrt(list_inner_product(e, e) * list_inner_product(dr, dr)), 5) ELSE 0 END AS bd, CASE WHEN n % 5 = 0 THEN round(list_inner_product(e, cl) / sqrt(list_inner_product(e, e) * list_inner_product(cl, cl)), 5) ELSE 0 END AS bc, CASE WHEN n % 10 = 0 THEN round(list_inner_product(dr, cl) / sqrt(list_inner_product(dr, dr) * list_inner_product(cl, cl)), 5) ELSE 0 END AS dc FROM w),
g AS (SELECT *, CASE WHEN least(bd, bc, dc) >= 0.92 THEN [b, d, c] WHEN greatest(bd, bc, dc) < 0.92 THEN [] WHEN bd >= bc AND bd >= dc THEN [b, d] WHEN bc >= dc THEN [b, c] ELSE [d, c] END AS clique FROM s),
m AS (SELECT *, unnest(clique) AS entity FROM g),
r AS (SELECT *, CASE entity WHEN b THEN f WHEN d THEN 1 ELSE 2 END AS k FROM m),
z AS (SELECT *, first_value(entity) OVER (PARTITION BY n ORDER BY k DESC, entity DESC) AS canonical FROM r),
y AS (SELECT entity, canonical, CASE WHEN [entity, canonical] IN ([b, d], [d, b]) THEN bd WHEN [entity, canonical] IN ([b, c], [c, b]) THEN bc ELSE dc END AS score, entity <> c AND canonical <> c AS words FROM z WHERE entity <> canonical),
alike AS (SELECT entity, canonical, 'alike' AS reason FROM y WHERE score >= 0.95 OR (score >= 0.92 AND words))
SELECT * FROM alike UNION ALL SELECT upper(b), coalesce(a.canonical, b), 'case' FROM s LEFT JOIN alike a ON a.entity = b""",
    "renamed_statements": f"{_T} SELECT subject, predicate, 'n' || (substr(object, 2)::INT // 4) AS object, min(triple_id) AS triple_id, round(1 - exp(sum(ln(greatest(1 - confidence, 1e-12)))), 6) AS confidence, count(*) AS merged FROM triples GROUP BY 1, 2, 3",
}
