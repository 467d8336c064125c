"""Other ways to put a question, by rules, and tools for a question: a catalog as rows, ranked by words and by another ranking."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.search_index import _FIND, _indexed, search_index
from millrace.sources.tables import table

# What is added where a word stands; English names of German terms; openings of questions.
ADDED = (("vergleich", "Vor- und Nachteile"), ("unterschied", "Vor- und Nachteile"), ("wirksamkeit", "Studie Evidenz"), ("wirkung", "Studie Evidenz"), ("therapie", "Leitlinie Empfehlung"), ("behandlung", "Leitlinie Empfehlung"))
ENGLISH = (
    ("kognitive verhaltenstherapie", "cognitive behavioral therapy CBT"), ("achtsamkeit", "mindfulness"), ("neuroplastizität", "neuroplasticity"), ("angststörung", "anxiety disorder"),
    ("depression", "depression treatment"), ("burnout", "burnout syndrome"), ("ptbs", "PTSD"), ("emdr", "EMDR therapy effectiveness"), ("psychotherapie", "psychotherapy"), ("stressbewältigung", "stress management"),
)
OPENINGS = ("was ist", "wie funktioniert", "welche", "warum")
RRF = 60


def expansions(queries: DataFrame, most: int = 3, added=ADDED, english=ENGLISH, openings=OPENINGS) -> DataFrame:
    """(query_id, nth, query): other forms of each query (query_id, text), in this order: with what its words call for, once each; the
    first foreign name that it holds; without the first opening of a question, if more than five characters are left. None is
    equal to the query or to an earlier one but for case; ``most`` of them. Null queries have none."""
    low = F.lower(F.col("text"))
    more = [F.when(low.contains(word), F.concat(F.col("text"), F.lit(f" {addition}"))) for word, addition in added]
    named = F.coalesce(*(F.when(low.contains(word), F.lit(name)) for word, name in english))
    bare = F.coalesce(*(F.when(low.contains(o), F.trim(F.replace(low, F.lit(o), F.lit("")))) for o in openings))
    every = F.array_compact(F.array(*more, named, F.when(F.length(bare) > 5, bare)))
    fresh = F.filter(every, lambda x, i: (F.lower(x) != low) & ~F.exists(F.slice(every, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    return queries.select("query_id", F.posexplode(F.slice(fresh, 1, most)).alias("nth", "query"))


def tool_catalog(spark: SparkSession, schemas: list[dict]) -> DataFrame:
    """(tool, description, parameters, required): function schemas (name, description, parameters with properties and required) as
    rows; names are unique. What is searched is the name, the description and the names and descriptions of parameters."""
    rows = []
    for s in (x.get("function", x) for x in schemas):
        properties = (s.get("parameters") or {}).get("properties") or {}
        said = " ".join([s["name"].replace("_", " "), s.get("description") or "", *(f"{n.replace('_', ' ')} {p.get('description') or ''}" for n, p in sorted(properties.items()))])
        rows.append((s["name"], said, json.dumps(properties, sort_keys=True, ensure_ascii=False), list((s.get("parameters") or {}).get("required") or [])))
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("a tool's name twice")
    return spark.createDataFrame(rows, "tool string, description string, parameters string, required array<string>")


def ranked_tools(tools: DataFrame, rankings: list[DataFrame], queries: DataFrame, k: int = 12) -> DataFrame:
    """(query_id, id, place, part): for each query (query_id) all core tools (id, core) in their order, then the k best others by reciprocal
    ranks over all rankings (query_id, id, rank), ties by id. Tools that no ranking has come last and are left out here: their order
    is the catalog's, the same for every query, so they aren't listed for each."""
    core = tools.where("core").withColumn("nth", F.row_number().over(Window.partitionBy("core").orderBy("id")))
    given = queries.select("query_id", F.lit(True).alias("core")).join(F.broadcast(core.select("core", "id", "nth")), "core")
    first = given.select("query_id", "id", F.col("nth").alias("place"), F.lit("core").alias("part"))
    number = core.agg(F.count("*").alias("cores"))
    every = None
    for r in rankings:
        own = r.select("query_id", "id", (1 / (RRF + F.col("rank"))).alias("score"))
        every = own if every is None else every.unionByName(own)
    others = every.join(tools.where("not core").select("id"), "id", "left_semi")
    fused = others.groupBy("query_id", "id").agg(F.round(F.sum("score"), 9).alias("score"))
    fused = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    placed = fused.join(F.broadcast(number), F.lit(True)).select("query_id", "id", (F.col("rank") + F.col("cores")).cast("int").alias("place"), F.lit("ranked").alias("part"))
    return first.unionByName(placed)


def _parts(s, d):
    rows = table(s, d, "part")
    return rows.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand", F.concat(F.lit("size"), "p_size")).alias("text"), (F.col("p_partkey") % 500 == 7).alias("core"))


def _wishes(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.when(F.col("item_id") % 3 == 0, "cold widget").when(F.col("item_id") % 3 == 1, "economy").otherwise("small gear promo"), F.concat(F.lit("size"), F.col("item_id") % 40), F.substring_index("text", " ", 2)).alias("text"))


def _ranked(s, d):
    lexical = search_index(s, _indexed(s, _parts(s, d).select("id", "text")), _wishes(s, d), 30)
    other = table(s, d, "part").select((F.col("p_partkey") % 13).alias("query_id"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    other = other.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("rank <= 30").join(_wishes(s, d).select("query_id"), "query_id", "left_semi")
    return ranked_tools(_parts(s, d), [lexical, other], _wishes(s, d), 12)


def _asked(s, d) -> DataFrame:
    words: Column = F.array(*(F.lit(x) for x in ("Was ist", "Welche Wirkung hat", "Vergleich von", "Unterschied zur Therapie bei", "Warum", "PTBS und", "Achtsamkeit: wie funktioniert")))
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.get(words, (F.col("item_id") % 7).cast("int")), F.substring_index("text", " ", 3)).alias("text"))


QUERIES = {"query_expansions": lambda s, d: expansions(_asked(s, d)), "ranked_tools": _ranked}
_Q = "SELECT item_id AS query_id, CASE item_id % 7 WHEN 0 THEN 'Was ist' WHEN 1 THEN 'Welche Wirkung hat' WHEN 2 THEN 'Vergleich von' WHEN 3 THEN 'Unterschied zur Therapie bei' WHEN 4 THEN 'Warum' WHEN 5 THEN 'PTBS und' ELSE 'Achtsamkeit: wie funktioniert' END || ' ' || array_to_string(string_split(text, ' ')[1:3], ' ') AS text FROM benchmark"
_FOUND = _FIND.replace("{docs}", "SELECT p_partkey AS id, concat_ws(' ', p_name, p_type, p_brand, 'size' || p_size) AS text FROM part").replace(
    "{ask}", "SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'cold widget' WHEN 1 THEN 'economy' ELSE 'small gear promo' END || ' size' || (item_id % 40) || ' ' || array_to_string(string_split(text, ' ')[1:2], ' ') AS text FROM benchmark"
)
ORACLE_SQL = {
    "query_expansions": f"""WITH q AS ({_Q}), l AS (SELECT *, lower(text) AS low FROM q),
e AS (SELECT query_id, low, list_filter([{', '.join(f"CASE WHEN contains(low, '{w}') THEN text || ' {a}' END" for w, a in ADDED)}, CASE {' '.join(f"WHEN contains(low, '{w}') THEN '{a}'" for w, a in ENGLISH)} END,
  CASE {' '.join(f"WHEN contains(low, '{o}') THEN CASE WHEN length(trim(replace(low, '{o}', ''))) > 5 THEN trim(replace(low, '{o}', '')) END" for o in OPENINGS)} END], lambda x: x IS NOT NULL) AS e FROM l),
u AS (SELECT query_id, low, unnest(e) AS query, generate_subscripts(e, 1) AS i FROM e),
f AS (SELECT query_id, query, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS nth FROM (SELECT * FROM u WHERE lower(query) <> low QUALIFY row_number() OVER (PARTITION BY query_id, lower(query) ORDER BY i) = 1))
SELECT query_id, nth::INT AS nth, query FROM f WHERE nth < 3""",
    "ranked_tools": f"""{_FOUND}, o AS (SELECT p_partkey % 13 AS query_id, p_partkey AS id, row_number() OVER (PARTITION BY p_partkey % 13 ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
every AS (SELECT query_id, id, rank FROM r WHERE rank <= 30 UNION ALL SELECT query_id, id, rank FROM o WHERE rank <= 30 AND query_id IN (SELECT item_id FROM benchmark)),
f AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 9) AS score FROM every WHERE id % 500 <> 7 GROUP BY 1, 2), c AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) AS nth FROM part WHERE p_partkey % 500 = 7)
SELECT item_id AS query_id, id, nth::INT AS place, 'core' AS part FROM benchmark, c
UNION ALL SELECT query_id, id, (rank + (SELECT count(*) FROM c))::INT, 'ranked' FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 12""",
}
