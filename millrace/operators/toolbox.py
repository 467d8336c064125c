"""What pages say of themselves, dates and months, searches of lines, read-only SQL, the catalog, clean-up plans, caches by age, and prototypes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.quality import _KIND, _T, _dealt, marked, rated
from millrace.operators.vectors import dot
from millrace.sources.tables import LEDGER_SQL, ledger, table

# Patterns, formats and words that results depend on.
TITLE, HEADING = r"(?is)<title[^>]*>(.*?)</title>", r"(?is)<h1[^>]*>(.*?)</h1>"
CANONICAL, LANGUAGE = r"(?i)<link[^>]*rel=\"canonical\"[^>]*href=\"([^\"]*)\"", r"(?i)<html[^>]*lang=\"([A-Za-z-]*)\""
META, LINKED = r"(?i)<meta[^>]*(?:name|property)=", r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "yyyyMMdd")
FUNCTIONS = frozenset(
    "abs array array_agg avg bool_and bool_or cast ceil coalesce collect_list collect_set concat concat_ws contains corr count count_if current_date date_add date_diff date_format date_sub "
    "date_trunc datediff day dayofweek dense_rank element_at exp explode first first_value floor greatest hour if ifnull initcap instr isnull lag last last_value lead least left length ln "
    "locate log log10 lower lpad ltrim max max_by mean median min min_by minute mod month months_between named_struct nullif nvl percentile position pow power quarter rank regexp_count "
    "regexp_extract regexp_like regexp_replace repeat replace reverse right round row_number rpad rtrim second sequence sign size split sqrt startswith std stddev stddev_pop stddev_samp "
    "struct substr substring sum to_date to_timestamp trim trunc try_cast try_divide upper var_pop var_samp variance weekofyear year".split()
)
#: Words that stand before a bracket without being functions.
BEFORE = frozenset("select where and or not in on as over from join by having when then else case exists any all union intersect except with values distinct between like rlike filter using within order partition group limit".split())
ENDS = frozenset("where group having order limit union intersect except window qualify offset".split())
REFUSED = frozenset("insert update delete merge overwrite transform map reduce into".split())
TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")
RECENT, PAST, CHANGE = ("recent", "aktuell", "today", "heute"), ("history", "früher", "historical"), ("evolution", "entwicklung", "trend")


def inner(html: Column, pattern: str) -> Column:
    """The text of the first element that a pattern finds, without tags."""
    found = F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), pattern, 1), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(found, r"\s+", " "))


def page_metadata(pages: DataFrame) -> DataFrame:
    """(page_id, title, canonical, language, metas, blocks): the first heading, else the title; how many descriptions and linked-data
    blocks a page has."""
    html = F.coalesce("html", F.lit(""))
    heading, title = inner(F.col("html"), HEADING), inner(F.col("html"), TITLE)
    return pages.select(
        "page_id", F.when(heading != "", heading).otherwise(title).alias("title"), F.regexp_extract(html, CANONICAL, 1).alias("canonical"),
        F.lower(F.regexp_extract(html, LANGUAGE, 1)).alias("language"), F.regexp_count(html, F.lit(META)).alias("metas"), F.regexp_count(html, F.lit(LINKED)).alias("blocks"),
    )


def extraction_quality(meta: DataFrame, length: Column) -> DataFrame:
    """(page_id, quality): for a title, enough text, descriptions and a language."""
    part = lambda when, value: F.when(when, value).otherwise(0.0)
    score = part(F.col("title") != "", 0.3) + part(length > 100, 0.3) + part(F.col("metas") > 0, 0.2) + part(F.col("language") != "", 0.2)
    return meta.select("page_id", F.round(score, 6).alias("quality"))


def flexible_date(text: Column) -> Column:
    """The first reading of a date that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in FORMATS))


def shifted_month(month: Column, by: int) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), by), "yyyy-MM")


def temporal_class(text: Column) -> Column:
    """range, year, evolution, historical, recent or none: the first that fits."""
    low = F.lower(F.coalesce(text, F.lit("")))
    some = lambda names: F.greatest(*(low.contains(n) for n in names))
    years = F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(r"\b(?:19|20)[0-9]{2}\b"), 0)))
    return F.when(years >= 2, "range").when(years == 1, "year").when(some(CHANGE), "evolution").when(some(PAST), "historical").when(some(RECENT), "recent").otherwise("none")


def matching_lines(docs: DataFrame, pattern: str, context: int = 1) -> DataFrame:
    """(doc_id, line, found, around): lines of texts that a pattern finds, counted from 1, with those about them."""
    lines = docs.select("doc_id", F.split("text", "\n").alias("lines"))
    each = lines.select("doc_id", "lines", F.posexplode("lines").alias("at", "found")).where(F.col("found").rlike(pattern))
    first = F.greatest(F.col("at") + 1 - context, F.lit(1))
    around = F.array_join(F.slice("lines", first, F.col("at") + 1 + context - first + 1), "\n")
    return each.select("doc_id", (F.col("at") + 1).alias("line"), "found", around.alias("around"))


def statement_words(text: str) -> list[str]:
    """Words, brackets, commas and dots of a statement in lower case; texts in quotes as one mark, comments left out. Quoted names are
    refused: they could hold a path."""
    found = re.findall(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`|[A-Za-z_]\w*|[0-9][\w.]*|\S", text, re.S)
    if "`" in found:
        raise ValueError("no quoted names")
    return ["''" if t[0] in "'\"" else t.lower() for t in found if not t.startswith(("--", "/*"))]


def read_relations(found: list[str]) -> set[str]:
    """Names that a statement reads from, those of its own WITH included: what stands after FROM, JOIN and each comma of a FROM clause.
    Names in parts are refused, as they reach files and catalogs."""
    out: set[str] = set()
    for start in (i for i, t in enumerate(found) if t == "from"):
        depth, expected = 0, True
        for i in range(start + 1, len(found)):
            t = found[i]
            depth += {"(": 1, ")": -1}.get(t, 0)
            if depth < 0 or (depth == 0 and t in ENDS):
                break
            if expected and t != "lateral":
                if t != "(":
                    if found[i + 1 : i + 2] in (["."], ["("]) or not re.fullmatch(r"[a-z_]\w*", t):
                        raise ValueError(f"can't read from {t}")
                    out.add(t)
                expected = False
            elif depth == 0 and t in (",", "join"):
                expected = True
    return out


def read_only_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame], args: dict | None = None, limit: int = 100) -> DataFrame:
    """The rows of one SELECT or WITH over the given tables, 1 to 500 of them; anything else is refused before it is planned.

    Only names of ``tables`` and of the statement's own WITH are read, only functions of a list are called, no word changes
    data or runs a script. FROM inside a function (extract, trim) and quoted names are refused too. The tables are put in
    for their names as named parameters can't be: under names of this call alone, which are dropped again.
    """
    found = statement_words(text.strip().rstrip(";"))
    if ";" in found or not found or found[0] not in ("select", "with") or REFUSED & {t for i, t in enumerate(found) if found[i - 1 : i] != ["."]} - {"map"} or ("using", "''") in zip(found, found[1:], strict=False):
        raise ValueError("one SELECT or WITH only")
    called = {t for t, after in zip(found, found[1:], strict=False) if after == "(" and re.fullmatch(r"[a-z_]\w*", t)}
    named = {t for i, t in enumerate(found) if found[i + 1 : i + 3] == ["as", "("] and found[i - 1] in ("with", ",", "recursive")}
    if unknown := called - FUNCTIONS - BEFORE - named:
        raise ValueError(f"unknown functions: {', '.join(sorted(unknown))}")
    wanted = read_relations(found) - named
    if unknown := wanted - {t.lower() for t in tables}:
        raise ValueError(f"unknown tables: {', '.join(sorted(unknown))}")
    try:
        for name, df in tables.items():
            if name.lower() in wanted:
                df.createOrReplaceTempView(name)
        return spark.sql(text.strip().rstrip(";"), args=args or {}).limit(min(500, max(1, limit)))
    finally:
        for name in tables:
            if name.lower() in wanted:
                spark.catalog.dropTempView(name)


def schema_catalog(spark: SparkSession, d: str, names: tuple[str, ...] = TABLES) -> DataFrame:
    """(table_name, column_name, type, rows) of tables: columns and types from their schemas, rows counted by a job over each."""
    columns = [(t, f.name, f.dataType.simpleString()) for t in names for f in table(spark, d, t).schema.fields]
    described = spark.createDataFrame(columns, "table_name string, column_name string, type string")
    counts = None
    for t in names:
        one = table(spark, d, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return described.join(counts, "table_name").select("table_name", "column_name", "type", "rows")


def row_sentences(rows: DataFrame) -> Column:
    """A table's row as a sentence: column is value; nulls are left out."""
    return F.concat_ws("; ", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c} is "), F.col(c).cast("string"))) for c in rows.columns))


def calculated(formula: str) -> Column:
    """A formula of columns, numbers and a few functions; other names with a bracket are refused."""
    known = {"sqrt", "sin", "cos", "tan", "log", "log10", "exp", "abs", "ceil", "floor", "pow"}
    if re.search(r"[^A-Za-z0-9_+\-*/().,% ]", formula) or any(f.lower() not in known for f in re.findall(r"([A-Za-z_]\w*)\s*\(", formula)):
        raise ValueError("only arithmetic and " + ", ".join(sorted(known)))
    return F.expr(formula)


def remediation(docs: DataFrame) -> DataFrame:
    """(doc_id, tier): auto for hard defects, recommended for texts that an earlier document has, observe for low scores."""
    rows = rated(docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))).select("doc_id", F.size("flags").alias("flags"), "score", "digest")
    first = docs.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("digest")).agg(F.min("doc_id").alias("first_id"))
    tier = F.when(F.col("flags") > 0, "auto").when(F.col("doc_id") > F.col("first_id"), "recommended").when(F.col("score") < 0.7, "observe")
    return rows.join(first, "digest").select("doc_id", tier.alias("tier")).where("tier is not null")


def cache_hits(rows: DataFrame) -> DataFrame:
    """(item_id, hit): whether a key (key, kind, ts) was asked for so lately that its answer still holds: 5, 30 or 60 minutes by kind."""
    minutes = F.when(F.col("kind") == "click", 5).when(F.col("kind") == "view", 30).otherwise(60)
    before = F.lag("us").over(Window.partitionBy("key", "kind").orderBy("us", "item_id"))
    rows = rows.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.select("item_id", F.coalesce(F.col("us") - before <= minutes.cast("long") * 60_000_000, F.lit(False)).alias("hit"))


def fetch_gate(states: DataFrame, now: str, most: int = 3) -> DataFrame:
    """(url, fetch): no fetch while a URL has failed too often in a row and its time to try again hasn't come."""
    return states.select("url", (~((F.col("failures") >= most) & (F.col("next_retry") > F.lit(now).cast("timestamp_ntz")))).alias("fetch"))


def prototypes(vectors: DataFrame) -> DataFrame:
    """(label, centre): the mean of each label's vectors, place by place, so that no task has all of a label."""
    places = vectors.select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return places.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("centre"))


def nearest_prototype(vectors: DataFrame, centres: DataFrame, most: int = 10_000) -> DataFrame:
    """(vec_id, label, score): the label whose centre is most alike. Fails beyond ``most`` labels, which are broadcast."""
    if centres.count() > most:
        raise ValueError(f"more than {most} labels")
    pairs = vectors.select("vec_id", "embedding").crossJoin(F.broadcast(centres))
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    score = F.round(dot(F.col("embedding"), F.col("centre")) / (norm("embedding") * norm("centre")), 5)
    return pairs.select("vec_id", "label", score.alias("score")).groupBy("vec_id").agg(F.max(F.struct("score", F.negative("label").alias("l"))).alias("m")).select("vec_id", F.negative("m.l").alias("label"), "m.score")


def _dates(s, d):
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    text = F.coalesce(*(F.when(k == i, F.date_format(day, f)) for i, f in enumerate(FORMATS)), F.lit("soon"))
    return table(s, d, "orders").select("o_orderkey", flexible_date(text).alias("day"))


def _adhoc(s, d):
    tables = {name: table(s, d, name) for name in ("orders", "customer", "nation")}
    text = "WITH t AS (SELECT c_mktsegment AS segment, replace(n_name, 'A', 'a') AS nation, count(*) AS n FROM orders o JOIN customer ON o_custkey = c_custkey, nation WHERE n_nationkey = c_nationkey AND o_totalprice > :least GROUP BY 1, 2) SELECT * FROM t ORDER BY n DESC, segment, nation;"
    return read_only_sql(s, text, tables, {"least": 1000.0}, 60)


def _gate(s, d):
    rows = table(s, d, "events").groupBy(F.concat(F.lit("u"), "user_id").alias("url")).agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.max("ts").alias("last"))
    return fetch_gate(rows.withColumn("next_retry", F.expr("last + interval 1 day")), "2024-01-31 00:00:00")


def _worn(s, d):
    """Pages of which some have lost their titles, descriptions or language, or nearly all."""
    k, html = F.col("page_id") % 7, F.col("html")
    html = F.when(k == 0, F.regexp_replace(html, "(?is)<(title|h1)[^>]*>.*?</(title|h1)>", "")).when(k == 1, F.concat(html, F.lit('<meta name="description" content="x">'))).when(k == 2, F.regexp_replace(html, '(?i) lang="[^"]*"', "")).when(k == 3, "<p>x</p>").otherwise(html)
    return table(s, d, "pages").withColumn("html", html)


QUERIES = {
    "page_metadata": lambda s, d: page_metadata(table(s, d, "pages")),
    "extraction_quality": lambda s, d: extraction_quality(page_metadata(_worn(s, d)).join(_worn(s, d).select("page_id", F.length("html").alias("size")), "page_id"), F.col("size")),
    "flexible_dates": _dates,
    "shifted_months": lambda s, d: ledger(s, d).select("month").distinct().select("month", shifted_month(F.col("month"), -5).alias("before"), shifted_month(F.col("month"), 13).alias("after")),
    "temporal_classes": lambda s, d: table(s, d, "documents").select("doc_id", temporal_class(F.concat("text", F.when(F.col("doc_id") % 3 == 0, " trend of 1999").otherwise(" today"))).alias("kind")),
    "matching_lines": lambda s, d: matching_lines(table(s, d, "documents"), "(?i)license").select("doc_id", "line", F.md5("around").alias("around_md5")),
    "adhoc_sql": _adhoc,
    "schema_catalog": schema_catalog,
    "row_sentences": lambda s, d: table(s, d, "part").select("p_partkey", row_sentences(table(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).alias("sentence")),
    "calculator": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(calculated("l_extendedprice * (1 - l_discount) + sqrt(l_quantity) - pow(l_tax, 2)"), 4).alias("value")),
    "remediation": lambda s, d: remediation(marked(_dealt(s, d))),
    "cache_hits": lambda s, d: cache_hits(table(s, d, "events").select(F.col("event_id").alias("item_id"), F.col("user_id").alias("key"), F.col("event_type").alias("kind"), "ts")),
    "fetch_gate": _gate,
    "nearest_prototype": lambda s, d: nearest_prototype(table(s, d, "embeddings"), prototypes(table(s, d, "embeddings"))),
}
_IN = lambda p: f"trim(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '{p}', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_META = f"WITH m AS (SELECT page_id, CASE WHEN {_IN(HEADING)} <> '' THEN {_IN(HEADING)} ELSE {_IN(TITLE)} END AS title, regexp_extract(html, '{CANONICAL}', 1) AS canonical, lower(regexp_extract(html, '{LANGUAGE}', 1)) AS language, len(regexp_extract_all(html, '{META}'))::INT AS metas, len(regexp_extract_all(html, '{LINKED}'))::INT AS blocks, length(html) AS size FROM pages)"
_WORN = _META.replace("FROM pages)", "FROM worn)").replace("WITH m AS", """WITH worn AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN regexp_replace(html, '(?is)<(title|h1)[^>]*>.*?</(title|h1)>', '', 'g') WHEN 1 THEN html || '<meta name="description" content="x">' WHEN 2 THEN regexp_replace(html, '(?i) lang="[^"]*"', '', 'g') WHEN 3 THEN '<p>x</p>' ELSE html END AS html FROM pages), m AS""")
_HAS = lambda names: " OR ".join(f"contains(t, '{n}')" for n in names)
ORACLE_SQL = {
    "page_metadata": f"{_META} SELECT page_id, title, canonical, language, metas, blocks FROM m",
    "extraction_quality": f"{_WORN} SELECT page_id, round(CASE WHEN title <> '' THEN 0.3 ELSE 0 END + CASE WHEN size > 100 THEN 0.3 ELSE 0 END + CASE WHEN metas > 0 THEN 0.2 ELSE 0 END + CASE WHEN language <> '' THEN 0.2 ELSE 0 END, 6)::DOUBLE AS quality FROM m",
    "flexible_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN o_orderdate::DATE END AS day FROM orders",
    "shifted_months": "WITH " + LEDGER_SQL + " SELECT DISTINCT month, strftime((month || '-01')::DATE - INTERVAL 5 MONTH, '%Y-%m') AS before, strftime((month || '-01')::DATE + INTERVAL 13 MONTH, '%Y-%m') AS after FROM ledger",
    "temporal_classes": f"SELECT doc_id, CASE WHEN y >= 2 THEN 'range' WHEN y = 1 THEN 'year' WHEN {_HAS(CHANGE)} THEN 'evolution' WHEN {_HAS(PAST)} THEN 'historical' WHEN {_HAS(RECENT)} THEN 'recent' ELSE 'none' END AS kind FROM (SELECT doc_id, t, len(list_distinct(regexp_extract_all(t, '\\b(?:19|20)[0-9]{{2}}\\b'))) AS y FROM (SELECT doc_id, lower(text || CASE WHEN doc_id % 3 = 0 THEN ' trend of 1999' ELSE ' today' END) AS t FROM documents))",
    "matching_lines": "SELECT doc_id, line::INT AS line, md5(array_to_string(l[greatest(line - 1, 1):line + 1], chr(10))) AS around_md5 FROM (SELECT doc_id, l, generate_subscripts(l, 1) AS line, unnest(l) AS found FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(found, '(?i)license')",
    "adhoc_sql": "SELECT c_mktsegment AS segment, replace(n_name, 'A', 'a') AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 1000 GROUP BY 1, 2 ORDER BY n DESC, segment, nation LIMIT 60",
    "schema_catalog": "WITH n AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in TABLES) + f") SELECT table_name, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE data_type END AS type, rows FROM information_schema.columns JOIN n USING (table_name) WHERE table_name IN {TABLES}",
    "row_sentences": "SELECT p_partkey, 'p_partkey is ' || p_partkey || '; p_name is ' || p_name || '; p_brand is ' || p_brand || '; p_type is ' || p_type || '; p_size is ' || p_size AS sentence FROM part",
    "calculator": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + sqrt(l_quantity) - pow(l_tax, 2), 4) AS value FROM lineitem",
    "remediation": f"{_T}{_KIND}, z AS (SELECT doc_id, CASE WHEN flags <> '' THEN 'auto' WHEN doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) THEN 'recommended' WHEN score < 0.7 THEN 'observe' END AS tier FROM s) SELECT * FROM z WHERE tier IS NOT NULL",
    "cache_hits": "SELECT event_id AS item_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 30 ELSE 60 END * 60000000::BIGINT, false) AS hit FROM events",
    "fetch_gate": "SELECT 'u' || user_id AS url, NOT (count(*) FILTER (event_type = 'error') >= 3 AND max(ts) + INTERVAL 1 DAY > TIMESTAMP '2024-01-31') AS fetch FROM events GROUP BY user_id",
    "nearest_prototype": "WITH p AS (SELECT label, k, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY k) AS centre FROM p GROUP BY 1) SELECT vec_id, label, score FROM (SELECT vec_id, c.label, round(list_cosine_similarity(embedding::DOUBLE[], centre), 5) AS score FROM embeddings, c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1",
}
