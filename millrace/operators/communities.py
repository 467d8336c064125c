"""Communities of weighted graphs by modularity, and retrieval by them.

Edges are rows (a, b, weight) in either direction. Detection moves nodes to the neighbouring community that gains most, round by
round, contracts communities to nodes and begins again. All sums are joins and aggregations by node or community, so hubs are
combined before they are shuffled; a round is kept only if modularity rises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.knowledge import _EDGES, T, graph_edges, triples
from millrace.sources.shared import settled
from millrace.sources.tables import table

#: Gains are compared to so many decimals, so that equal ones tie on every cluster.
DECIMALS = 9
#: Rows of a table that may be broadcast in a round; larger ones would go through the driver in every round.
BROADCAST_ROWS = 10_000


def weighted(edges: DataFrame) -> DataFrame:
    """(a, b, weight): each pair of different nodes once, weights summed; 1 where there is no weight. Null ends go."""
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), weight.alias("weight"))
    return pairs.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def by_key(rows: DataFrame, most: int | None) -> DataFrame:
    """Rows to be joined, at most so many of them: never broadcast beyond BROADCAST_ROWS. None: Spark decides."""
    return rows if most is None or most <= BROADCAST_ROWS else rows.hint("merge")


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of a division (node, community) of the nodes of a graph, and how many nodes and communities it has.
    A graph without edges has modularity 0."""
    return _modularity(both_ways(weighted(edges)), members.select("node", "community"), resolution)


def _modularity(ways: DataFrame, members: DataFrame, resolution: float, nodes: int | None = None) -> DataFrame:
    own, other = members.select(F.col("node").alias("a"), F.col("community").alias("ca")), members.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    own, other = by_key(own, nodes), by_key(other, nodes)
    parts = ways.join(own, "a").join(other, "b").groupBy(F.col("ca").alias("community")).agg(
        F.sum("weight").alias("total"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside")
    )
    sums = parts.agg(F.sum("total").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("total") * F.col("total")).alias("squares"))
    sizes = members.agg(F.count("*").alias("nodes"), F.countDistinct("community").alias("communities"))
    score = F.coalesce(F.col("inside") / F.col("m2") - resolution * F.col("squares") / (F.col("m2") * F.col("m2")), F.lit(0.0))
    return sums.join(sizes, F.lit(True)).select(F.round(score, DECIMALS).alias("modularity"), "nodes", "communities")


def _moved(ways: DataFrame, strength: DataFrame, members: DataFrame, m2: float, turn: int, shares: int, resolution: float, nodes: int, groups: int) -> DataFrame:
    """Members after one round, in which one in ``shares`` nodes may move, chosen by a hash of node and round. A node that is
    alone joins another that is alone only if that has the lesser community, so that they don't change places. There are so many
    nodes, and at most so many communities (groups)."""
    state = members.join(by_key(strength, nodes), "node")
    totals = state.groupBy("community").agg(F.sum("k").alias("total"), F.count("*").alias("size"))
    links = ways.where("a <> b").join(by_key(members.withColumnRenamed("node", "b"), nodes), "b")
    links = links.groupBy(F.col("a").alias("node"), "community").agg(F.sum("weight").alias("inside"))
    links = links.unionByName(members.select("node", "community", F.lit(0.0).alias("inside"))).groupBy("node", "community").agg(F.sum("inside").alias("inside"))
    mine = state.join(by_key(totals.select("community", F.col("size").alias("own_size")), groups), "community")
    mine = mine.select("node", "k", F.col("community").alias("own"), "own_size")
    options = links.join(by_key(totals, groups), "community").join(by_key(mine, nodes), "node")
    rest = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
    gain = F.round(F.col("inside") - resolution * F.col("k") * rest / m2, DECIMALS)
    stays = F.col("community") == F.col("own")
    free = F.pmod(F.xxhash64(F.col("node").cast("string"), F.lit(turn)), F.lit(shares)) == 0
    allowed = free & ((F.col("own_size") > 1) | (F.col("size") > 1) | (F.col("community") < F.col("own")))
    order = F.struct(F.negative(gain).alias("gain"), (~stays).alias("away"), "community")
    best = options.where(stays | allowed).groupBy("node").agg(F.min(order).alias("best"))
    return best.select("node", F.col("best.community").alias("community"))


def modularity_communities(edges: DataFrame, resolution: float = 1.0, sweeps: int = 6, levels: int = 6, least: float = 1e-4) -> DataFrame:
    """(node, community) of every node that has an edge: communities of high modularity, named by their least node.

    A sweep is two rounds of moves; one that doesn't raise modularity by ``least`` is undone, and the next lets fewer nodes move at
    once, or ends the level. Then communities become the nodes of the next level, until one changes nothing. A higher
    resolution gives smaller communities. Order and partitioning of the edges don't matter; a graph without edges gives no rows.
    """
    ways = settled(both_ways(weighted(edges)))
    m2 = ways.agg(F.sum("weight")).first()[0]
    found = settled(ways.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    if not m2:
        return found
    best, turn, nodes = None, 0, found.count()
    for _ in range(levels):
        strength = settled(ways.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k")))
        members = strength.select("node", F.col("node").alias("community"))
        if best is None:
            best = _modularity(ways, members, resolution, nodes).first().modularity
        # Nodes move to communities that there are: these never become more.
        before, shares, groups = best, 2, nodes
        for _ in range(sweeps):
            tried = settled(_moved(ways, strength, members, m2, turn, shares, resolution, nodes, groups))
            tried = settled(_moved(ways, strength, tried, m2, turn + 1, shares, resolution, nodes, groups))
            turn += 2
            now = _modularity(ways, tried, resolution, nodes).first()
            if now.modularity >= best + least:
                members, best, groups = tried, now.modularity, now.communities
            elif shares == 2:
                shares = 8
            else:
                break
        if best == before:
            break
        names = members.groupBy("community").agg(F.min("node").alias("name"))
        members = settled(members.join(by_key(names, groups), "community").select("node", F.col("name").alias("community")))
        now = by_key(members.select(F.col("node").alias("was"), "community"), nodes)
        found = settled(found.withColumnRenamed("community", "was").join(now, "was").select("node", "community"))
        a, b = (by_key(members.select(F.col("node").alias(c), F.col("community").alias(f"c{c}")), nodes) for c in "ab")
        ways = ways.join(a, "a").join(b, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("weight").alias("weight"))
        ways, nodes = settled(ways), groups
    return found


def community_profiles(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(community, size, edges, density, share): share is the part of the graph's modularity that falls on one community of all."""
    pairs = weighted(edges)
    a, b = (members.select(F.col("node").alias(c), F.col("community").alias(f"c{c}")) for c in "ab")
    inside = pairs.join(a, "a").join(b, "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("edges"))
    sizes = members.groupBy("community").agg(F.count("*").alias("size"))
    found = sizes.join(inside, "community", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    density = F.when(F.col("size") > 1, 2 * F.col("edges") / (F.col("size") * (F.col("size") - 1))).otherwise(0.0)
    whole = modularity(edges, members).select((F.col("modularity") / F.greatest("communities", F.lit(1))).alias("share"))
    return found.join(F.broadcast(whole), F.lit(True)).select("community", "size", "edges", F.round(density, 6).alias("density"), F.round("share", 6).alias("share"))


def label_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def community_relevance(queries: DataFrame, labels: DataFrame, members: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, community, score, rank): for each query (query_id, text) the communities whose nodes' labels (node, label) share
    most words with it, on average over the nodes, with a bonus for density and less for size. Words are met by an equi-join
    on what a community's labels hold; communities without any word of a query don't take part."""
    named = members.join(labels, "node")
    held = named.select("community", F.explode(label_words(F.col("label"))).alias("word")).groupBy("community", "word").agg(F.count("*").alias("nodes"))
    words = queries.select("query_id", label_words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    asked = words.select("query_id", "n", F.explode("words").alias("word"))
    hits = asked.join(held, "word").groupBy("query_id", "community").agg(F.sum(F.col("nodes") / F.col("n")).alias("hits"))
    profile = community_profiles(edges, members).select("community", "size", "density")
    score = (F.col("hits") / F.col("size") + 0.3 * F.col("density")) / (1 + 0.01 * F.col("size"))
    rows = hits.join(profile, "community").select("query_id", "community", F.round(score, 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "community")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def community_triples(matched: DataFrame, members: DataFrame, rows: DataFrame, top: int = 3, entities: int = 10, each: int = 10, most: int = 50) -> DataFrame:
    """(query_id, community, entity, triple_id): statements on members of the communities of a query's matched entities (query_id,
    entity) that aren't matched themselves.

    A community counts by matched members over the root of its size; the first ``top`` of a query expand by ``entities``
    members (by name), ``each`` statements of these (by id), ``most`` in all. Statements on matched entities are left out. Members
    and statements are cut per community and entity before they meet the queries, so a hub hands out no more than it may.
    """
    matched = matched.select("query_id", "entity").distinct()
    sizes = members.groupBy("community").agg(F.count("*").alias("size"))
    hits = matched.join(members, matched.entity == members.node).groupBy("query_id", "community").agg(F.count("*").alias("hits"))
    score = F.round(F.col("hits") / F.sqrt("size"), 6)
    chosen = hits.join(sizes, "community").withColumn("score", score)
    chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "community"))).where(F.col("rank") <= top)
    asked = chosen.select("query_id", "community", "rank", "hits")
    # A query's matched members of a community are at most ``hits`` of its first names: so many more cover the cut.
    deepest = asked.groupBy("community").agg(F.max("hits").alias("deepest"))
    named = members.join(deepest, "community").withColumn("nth", F.row_number().over(Window.partitionBy("community").orderBy("node")))
    named = named.where(F.col("nth") <= F.col("deepest") + entities).select("community", F.col("node").alias("entity"))
    wanted = asked.join(named, "community").join(matched, ["query_id", "entity"], "left_anti")
    wanted = wanted.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "community").orderBy("entity"))).where(F.col("nth") <= entities)
    sides = F.explode(F.array_distinct(F.array("subject", "object")))
    ends = rows.select("triple_id", sides.alias("entity"))
    ends = ends.join(named.select("entity").distinct(), "entity", "left_semi")
    seen = rows.select("triple_id", sides.alias("entity")).join(matched, "entity").select("query_id", "triple_id").distinct()
    found = wanted.select("query_id", "community", "rank", "entity").join(ends, "entity").join(seen, ["query_id", "triple_id"], "left_anti")
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "entity").orderBy("triple_id"))).where(F.col("nth") <= each)
    once = found.groupBy("query_id", "triple_id").agg(F.min(F.struct("rank", "entity", "community")).alias("first")).select("query_id", "triple_id", "first.*")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "entity", "triple_id"))
    return once.withColumn("place", place).where(F.col("place") <= most).select("query_id", "community", "entity", "triple_id")


def _by_nation(s, d):
    """Customers and what they are said to be at, by nation: a division that SQL knows too."""
    own = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_nationkey").alias("nation"))
    there = triples(s, d).select(F.col("object").alias("node")).distinct()
    there = there.withColumn("nation", F.floor(F.substring("node", 2, 9).cast("int") / 4).cast("int"))
    both = own.unionByName(there)
    return both.join(graph_edges(triples(s, d)).select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select("node", F.col("nation").alias("community"))


def _labels(s, d):
    own = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat_ws(" ", "c_mktsegment", F.concat(F.lit("N"), "c_nationkey")).alias("label"))
    there = triples(s, d).select(F.col("object").alias("node")).distinct()
    return own.unionByName(there.select("node", F.concat(F.lit("place N"), F.floor(F.substring("node", 2, 9).cast("int") / 4)).alias("label")))


def _asked(s, d):
    nations = table(s, d, "nation")
    return nations.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("building Place n"), "n_nationkey").alias("text"))


def _matched(s, d):
    own = table(s, d, "customer").where("c_custkey % 3 = 0")
    return own.select(F.col("c_nationkey").alias("query_id"), F.concat(F.lit("c"), "c_custkey").alias("entity"))


QUERIES = {
    "modularity_communities": lambda s, d: modularity_communities(graph_edges(triples(s, d))),
    "modularity_by_nation": lambda s, d: modularity(graph_edges(triples(s, d)), _by_nation(s, d)),
    "community_profiles": lambda s, d: community_profiles(graph_edges(triples(s, d)), _by_nation(s, d)),
    "community_relevance": lambda s, d: community_relevance(_asked(s, d), _labels(s, d), _by_nation(s, d), graph_edges(triples(s, d))),
    "community_triples": lambda s, d: community_triples(_matched(s, d), _by_nation(s, d), triples(s, d)),
}
_M = f"""{_EDGES}, nodes AS (SELECT a AS node FROM edges UNION SELECT b FROM edges),
m AS (SELECT node, c_nationkey AS community, lower(c_mktsegment || ' N' || c_nationkey) AS label FROM nodes JOIN customer ON node = 'c' || c_custkey
  UNION ALL SELECT node, substr(node, 2)::INT // 4, 'place n' || (substr(node, 2)::INT // 4) FROM nodes WHERE node LIKE 'n%'),
w AS (SELECT x.community AS ca, y.community AS cb FROM edges JOIN m x ON a = x.node JOIN m y ON b = y.node),
tot AS (SELECT community, count(*) AS total, count(*) FILTER (same) AS inside FROM (SELECT ca AS community, ca = cb AS same FROM w UNION ALL SELECT cb, ca = cb FROM w) GROUP BY 1),
q AS (SELECT round(sum(inside) / sum(total) - sum(total * total) / (sum(total) * sum(total)), 9) AS modularity FROM tot),
size AS (SELECT community, count(*) AS size FROM m GROUP BY 1),
prof AS (SELECT community, size, coalesce(inside, 0) // 2 AS edges, CASE WHEN size > 1 THEN 2 * (coalesce(inside, 0) // 2) / (size * (size - 1)) ELSE 0 END AS density FROM size LEFT JOIN tot USING (community))"""
ORACLE_SQL = {
    "modularity_by_nation": f"{_M} SELECT modularity::DOUBLE AS modularity, count(*) AS nodes, count(DISTINCT community) AS communities FROM m, q GROUP BY 1",
    "community_profiles": f"{_M} SELECT community, size, edges::BIGINT AS edges, round(density, 6)::DOUBLE AS density, round(modularity / (SELECT count(*) FROM size), 6)::DOUBLE AS share FROM prof, q",
    "community_relevance": f"{_M}, h AS (SELECT community, unnest(list_distinct(string_split(label, ' '))) AS word FROM m), k AS (SELECT community, word, count(*) AS nodes FROM h GROUP BY 1, 2), a AS (SELECT n_nationkey AS query_id, unnest(['building', 'place', 'n' || n_nationkey]) AS word FROM nation), s AS (SELECT query_id, community, sum(nodes / 3) AS hits FROM a JOIN k USING (word) GROUP BY 1, 2) SELECT * FROM (SELECT query_id, community, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community)::INT AS rank FROM (SELECT query_id, community, round((hits / size + 0.3::DOUBLE * round(density, 6)) / (1 + 0.01::DOUBLE * size), 6) AS score FROM s JOIN prof USING (community))) WHERE rank <= 5",
    "community_triples": f"""{_M}, matched AS (SELECT c_nationkey AS query_id, 'c' || c_custkey AS entity FROM customer WHERE c_custkey % 3 = 0),
chosen AS (SELECT query_id, community, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community) AS rank FROM (SELECT query_id, community, round(count(*) / sqrt(any_value(size)), 6) AS score FROM matched JOIN m ON entity = node JOIN size USING (community) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community) <= 3),
wanted AS (SELECT query_id, community, rank, node AS entity FROM chosen JOIN m USING (community) WHERE (query_id, node) NOT IN (SELECT (query_id, entity) FROM matched) QUALIFY row_number() OVER (PARTITION BY query_id, community ORDER BY node) <= 10),
ends AS (SELECT triple_id, subject AS entity FROM triples UNION SELECT triple_id, object FROM triples),
seen AS (SELECT DISTINCT query_id, triple_id FROM ends JOIN matched USING (entity)),
found AS (SELECT query_id, community, rank, w.entity, triple_id FROM wanted w JOIN ends USING (entity) WHERE NOT EXISTS (SELECT 1 FROM seen z WHERE z.query_id = w.query_id AND z.triple_id = ends.triple_id) QUALIFY row_number() OVER (PARTITION BY query_id, w.entity ORDER BY triple_id) <= 10),
once AS (SELECT query_id, triple_id, min((rank, entity, community)) AS f FROM found GROUP BY 1, 2)
SELECT query_id, f[3] AS community, f[2] AS entity, triple_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f, triple_id) AS place FROM once) WHERE place <= 50""",
}
