"""Gates, fusions and re-rankings of search results (query_id, item_id, score and what else is known), vectors, and near copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.passages import ORACLE_SQL as PASSAGES_SQL
from millrace.operators.passages import doc_simhash
from millrace.operators.quality import terms
from millrace.sources.tables import table

# Bands, weights and lists that results depend on.
TRACKING = r"(^|&)(?:utm_[^=&]*|ref|fbclid|gclid)=[^&]*"
#: Suffixes of two labels under which names are given away, as country code registries do.
SHARED = r"(?:co|com|net|org|gov|ac|edu|or|ne|go)\.(?:uk|au|nz|za|jp|kr|in|br|mx|ar|tr|cn|tw|hk|sg|il|th|id|my|ke|ng|eg|ua|pl|at)"


def ranked(rows: DataFrame, by: str = "query_id", score: str = "score", item: str = "item_id") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), item)))


def adaptive_relevance(rows: DataFrame, least: float = 0.3, floor: int = 1, adaptive_from: int = 3) -> DataFrame:
    """Results at or above a threshold, which is raised to mean less deviation where a query has enough of them; the best ``floor`` stay."""
    each = Window.partitionBy("query_id")
    limit = F.when(F.count("*").over(each) >= adaptive_from, F.greatest(F.lit(least), F.avg("score").over(each) - F.stddev_pop("score").over(each))).otherwise(least)
    return ranked(rows.withColumn("limit", limit)).where((F.col("score") >= F.col("limit")) | (F.col("rank") <= floor)).drop("limit")


def relevance_bands(rows: DataFrame, sure: float = 0.5, maybe: float = 0.3, web_below: float = 0.5) -> DataFrame:
    """Results with their band; irrelevant ones go, but the best stays; needs_web where too few of a query's results are relevant."""
    band = F.when(F.col("score") >= sure, "relevant").when(F.col("score") >= maybe, "ambiguous").otherwise("irrelevant")
    share = F.avg(F.when(F.col("score") >= sure, 1.0).otherwise(0.0)).over(Window.partitionBy("query_id"))
    found = ranked(rows.withColumns({"band": band, "needs_web": share < web_below}))
    return found.where((F.col("band") != "irrelevant") | (F.col("rank") == 1))


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:@]+)", 1)


def site(url: Column) -> Column:
    """The registrable domain: the last two labels of the host, three under a shared suffix as co.uk."""
    name = host(url)
    wide = F.regexp_extract(name, r"([^.]+\." + SHARED + r")$", 1)
    return F.when(wide != "", wide).otherwise(F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1))


def normal_url(url: Column) -> Column:
    """https, the host in lower case without www, without tracking parameters, fragment and closing slash; also where no scheme stood."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"^(?i)www\.", "")
    name = F.regexp_extract(rest, r"^([^/?]*)", 1)
    rest = F.concat(F.lit("https://"), F.lower(name), F.substring(rest, F.length(name) + 1, F.length(rest)))
    path, asked = F.substring_index(rest, "?", 1), F.when(F.locate("?", rest) > 0, F.substring(rest, F.locate("?", rest) + 1, F.length(rest))).otherwise("")
    kept = F.regexp_replace(F.regexp_replace(asked, TRACKING, ""), "^&", "")
    return F.concat(F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def allowed(rows: DataFrame, blocked: list[str]) -> DataFrame:
    """Results with a URL of a site that is not blocked."""
    return rows.where((F.coalesce("url", F.lit("")) != "") & ~site(F.col("url")).isin(*blocked))


def diverse(rows: DataFrame, each: int = 2) -> DataFrame:
    """All results, those of a site after the first ``each`` moved behind the others."""
    nth = F.row_number().over(Window.partitionBy("query_id", "site").orderBy(F.desc("score"), "item_id"))
    rows = rows.withColumn("overflow", nth > each)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("overflow", F.desc("score"), "item_id")))


def fair_quota(rows: DataFrame, k: int, kinds: int = 3, least: int = 3) -> DataFrame:
    """k results of each query: first a share of each kind, then by score."""
    nth = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "item_id"))
    rows = rows.withColumn("owed", nth <= max(least, k // kinds))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("owed"), F.desc("score"), "item_id"))).where(F.col("place") <= k)


def fresh_first(rows: DataFrame, now: str, half_life: float = 168.0) -> DataFrame:
    """Results by 0.6 / (rank + 1) and 0.4 of what is left of their freshness after half-lives of hours; unknown ages count half."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    fresh = F.when(F.col("ts").isNull(), 0.5).otherwise(F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / half_life))
    return ranked(rows).withColumn("fresh_score", F.round(0.6 / F.col("rank") + 0.4 * fresh, 6))


def budgeted(rows: DataFrame, most: int = 5000, least: int = 800, decay: float = 0.7) -> DataFrame:
    """Results with the characters that each may show, which shrink with its rank."""
    return ranked(rows).withColumn("budget", F.least(F.lit(most), F.greatest(F.lit(least), F.floor(most * F.pow(F.lit(decay), F.col("rank") - 1)))).cast("int"))


def weighted_fusion(first: DataFrame, second: DataFrame, a: float = 0.7, b: float = 0.3) -> DataFrame:
    both = first.select("query_id", "item_id", F.col("score").alias("x")).join(second.select("query_id", "item_id", F.col("score").alias("y")), ["query_id", "item_id"], "full")
    return both.select("query_id", "item_id", F.round(a * F.coalesce("x", F.lit(0.0)) + b * F.coalesce("y", F.lit(0.0)), 6).alias("score"))


def smart_fusion(first: DataFrame, second: DataFrame, k: int, quota: float = 0.18, least: float = 0.25, bonus: float = 0.3) -> DataFrame:
    """Results of a first source, with a bonus where the second has them too, and a share of the second's own that are good enough."""
    both = first.select("query_id", "item_id", F.col("score").alias("x")).join(second.select("query_id", "item_id", F.col("score").alias("y")), ["query_id", "item_id"], "full")
    rows = both.select("query_id", "item_id", F.col("x").isNull().alias("other"), F.when(F.col("x").isNull(), F.col("y")).otherwise(F.col("x") + bonus * F.coalesce("y", F.lit(0.0))).alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id", "other").orderBy(F.desc("score"), "item_id"))
    rows = rows.where(~F.col("other") | (F.col("score") >= least)).withColumn("nth", nth).where(~F.col("other") | (F.col("nth") <= max(1, int(k * quota))))
    return ranked(rows.select("query_id", "item_id", "other", F.round("score", 6).alias("score"))).where(F.col("rank") <= k)


def merged_results(own: DataFrame, web: DataFrame, k: int, boost: float = 0.1) -> DataFrame:
    """The best of two sources, own ones ahead by a little, one for each text's first 100 characters."""
    rows = own.withColumn("score", F.col("score") + boost).withColumn("kind", F.lit("own")).unionByName(web.withColumn("kind", F.lit("web")))
    nth = F.row_number().over(Window.partitionBy("query_id", F.substring("text", 1, 100)).orderBy(F.desc("score"), "item_id"))
    return ranked(rows.withColumn("nth", nth).where("nth = 1").drop("nth")).where(F.col("rank") <= k)


def score_trend(rows: DataFrame, least: float = 0.05) -> DataFrame:
    """(query_id, trend): the mean of a series' last three scores against the three before."""
    back = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ts"), F.desc("item_id")))
    means = rows.withColumn("back", back).groupBy("query_id").agg(F.avg(F.when(F.col("back") <= 3, F.col("score"))).alias("late"), F.avg(F.when(F.col("back").between(4, 6), F.col("score"))).alias("early"))
    change = F.col("late") - F.col("early")
    return means.where("early is not null").select("query_id", F.when(change > least, "improving").when(change < -least, "declining").otherwise("stable").alias("trend"))


def evicted(rows: DataFrame, most: int, share: float = 0.8) -> DataFrame:
    """Entries (item_id, size, used_at) that go, the least recently used first, until the rest is a share of the bound; none below it. The
    running sum is taken over days first, so that no task has all entries."""
    day = F.to_date("used_at")
    days = rows.groupBy(day.alias("day")).agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = days.select("day", before.alias("before"), F.sum("size").over(Window.partitionBy()).alias("total"))
    running = F.sum("size").over(Window.partitionBy("day").orderBy("used_at", "item_id")) - F.col("size")
    gone = rows.withColumn("day", day).join(F.broadcast(sums), "day").withColumn("ahead", F.col("before") + running)
    return gone.where((F.col("total") > most) & (F.col("total") - F.col("ahead") > share * most)).select("item_id")


def simhash_pairs(prints: DataFrame, most: int = 3) -> DataFrame:
    """(a, b, distance): fingerprints (doc_id, simhash) that differ in at most three bits, so that one of their four quarters is equal. Equal
    prints are joined as one, with the least id of each; a quarter that very many prints share is one key."""
    classes = prints.groupBy("simhash").agg(F.min("doc_id").alias("doc_id"))
    quarters = classes.select("doc_id", "simhash", F.posexplode(F.array(*(F.shiftrightunsigned("simhash", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(4)))).alias("quarter", "value"))
    other = quarters.select(F.col("doc_id").alias("b"), F.col("simhash").alias("other"), "quarter", "value")
    pairs = quarters.join(other, ["quarter", "value"]).where("doc_id < b")
    distance = F.bit_count(F.col("simhash").bitwiseXOR(F.col("other"))).cast("int")
    return pairs.where(distance <= most).select(F.col("doc_id").alias("a"), "b", distance.alias("distance")).distinct()


def compressed(rows: DataFrame, query: list[str], least: int = 150) -> DataFrame:
    """(doc_id, kept, sentences): for texts long enough the sentences that share as many words with a query as the middle one does."""
    asked = F.array(*map(F.lit, query))
    sentences = rows.where(F.length("text") >= least).select("doc_id", F.posexplode(F.filter(F.split("text", r"[.!?]+\s+"), lambda x: x != "")).alias("nth", "sentence"))
    scored = sentences.withColumn("score", F.size(F.array_intersect(terms(F.col("sentence")), asked)) / F.lit(float(len(query))))
    middle = scored.groupBy("doc_id").agg(F.percentile("score", F.lit(0.5)).alias("middle"), F.count("*").alias("sentences")).where("sentences > 2")
    kept = scored.join(middle, "doc_id").where(F.col("score") >= F.greatest("middle", F.lit(0.01)))
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"), F.first("sentences").alias("sentences"))


def temporal_boost(rows: DataFrame, first: int, last: int, boost: float = 0.15) -> DataFrame:
    """Scores raised where one of the years in a text's first 500 characters, or its own year, is in a range."""
    years = F.transform(F.regexp_extract_all(F.substring("text", 1, 500), F.lit(r"\b(?:19|20)[0-9]{2}\b"), 0), lambda y: y.cast("int"))
    fits = F.exists(years, lambda y: y.between(first, last)) | F.coalesce(F.col("year").between(first, last), F.lit(False))
    return rows.withColumn("score", F.round(F.col("score") * F.when(fits, 1 + boost).otherwise(1.0), 6))


def answer_grounding(answers: DataFrame, evidence: DataFrame, supported: float = 0.25) -> DataFrame:
    """(answer_id, grounding, unsupported): how much of the weight of each sentence's words its best evidence covers, on average; and the
    share of sentences below a threshold. Words weigh the more the fewer pieces of evidence have them."""
    has = evidence.select("answer_id", "evidence_id", F.explode(terms(F.col("text"))).alias("term"))
    total = evidence.groupBy("answer_id").agg(F.count("*").alias("n"))
    idf = has.groupBy("answer_id", "term").agg(F.count("*").alias("df")).join(total, "answer_id").select("answer_id", "term", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
    sentences = answers.select("answer_id", F.posexplode(F.filter(F.split("text", r"[.!?]+\s+"), lambda x: x != "")).alias("nth", "sentence"))
    asked = sentences.select("answer_id", "nth", F.explode(terms(F.col("sentence"))).alias("term")).join(total, "answer_id").join(idf, ["answer_id", "term"], "left")
    asked = asked.select("answer_id", "nth", "term", F.coalesce("idf", F.log(1 + F.col("n"))).alias("idf"))
    whole = asked.groupBy("answer_id", "nth").agg(F.sum("idf").alias("whole"))
    covered = asked.join(has, ["answer_id", "term"]).groupBy("answer_id", "nth", "evidence_id").agg(F.sum("idf").alias("covered"))
    best = covered.groupBy("answer_id", "nth").agg(F.max("covered").alias("covered"))
    share = F.coalesce("covered", F.lit(0.0)) / F.col("whole")
    found = whole.join(best, ["answer_id", "nth"], "left").select("answer_id", share.alias("share"))
    return found.groupBy("answer_id").agg(F.round(F.avg("share"), 6).alias("grounding"), F.round(F.avg(F.when(F.col("share") < supported, 1.0).otherwise(0.0)), 6).alias("unsupported"))


def welch(rows: DataFrame, z: float = 1.96) -> DataFrame:
    """One row: t of two groups' values (group 1 and 0), p by the normal distribution's tail, the interval of the difference, and whether a
    fall of a fifth is an alert."""
    g = rows.groupBy("group").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    pick = lambda c, k: F.max(F.when(F.col("group") == k, F.col(c)))
    one = g.agg((pick("m", 1) - pick("m", 0)).alias("d"), F.sqrt(pick("v", 1) / pick("n", 1) + pick("v", 0) / pick("n", 0)).alias("se"), pick("m", 0).alias("base"))
    # Without any spread there is no t: p is 1.
    ratio = F.try_divide("d", "se")
    t = F.coalesce(F.abs(ratio), F.lit(0.0))
    # The tail of the normal distribution by a fixed polynomial (Abramowitz and Stegun 26.2.17).
    k = 1 / (1 + 0.2316419 * t)
    tail = F.exp(-t * t / 2) / 2.5066282746310002 * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    return one.select(F.round(F.coalesce(ratio, F.lit(0.0)), 6).alias("t"), F.round(F.when(ratio.isNull(), 1.0).otherwise(2 * tail), 6).alias("p"), F.round(F.col("d") - z * F.col("se"), 4).alias("low"), F.round(F.col("d") + z * F.col("se"), 4).alias("high"), (F.col("d") <= -0.2 * F.col("base")).alias("alert"))


def results(spark, d: str) -> DataFrame:
    """Events as search results: a user's query, with a score below one."""
    rows = table(spark, d, "events")
    return rows.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("item_id"), F.round(F.least(F.col("value") / 200, F.lit(1.0)), 6).alias("score"), F.col("event_type").alias("kind"), "ts", F.concat("event_type", F.lit(" "), F.substring("props", 1, 8)).alias("text"))


def pages(spark, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.floor(F.col("page_id") / 25).alias("query_id"), F.col("page_id").alias("item_id"), (F.length("html") % 97 / 97).alias("score"), "url", site(F.col("url")).alias("site"))


def _answers(s, d):
    items = table(s, d, "benchmark").select(F.col("item_id").alias("answer_id"), "text")
    docs = table(s, d, "documents").select((F.col("doc_id") % 20).alias("answer_id"), F.col("doc_id").alias("evidence_id"), "text")
    return items, docs


R, P = (lambda s, d: results(s, d)), (lambda s, d: pages(s, d))
VIEWS = lambda s, d: results(s, d).where("kind = 'view'").select("query_id", "item_id", "score")
CLICKS = lambda s, d: results(s, d).where("kind <> 'error'").select("query_id", "item_id", F.round(1 - F.col("score"), 6).alias("score"))
QUERIES = {
    "adaptive_relevance": lambda s, d: adaptive_relevance(R(s, d)).select("query_id", "item_id", "rank"),
    "relevance_bands": lambda s, d: relevance_bands(R(s, d)).select("query_id", "item_id", "band", "needs_web"),
    "normal_urls": lambda s, d: table(s, d, "pages").select("page_id", F.when(F.col("page_id") % 4 == 1, F.regexp_replace(F.upper("url"), "^[A-Z]+://", "")).when(F.col("page_id") % 4 == 2, F.regexp_replace("url", r"^(https?://)([^/]+)", "$1WWW.$2.co.uk")).otherwise(F.col("url")).alias("raw")).select("page_id", normal_url(F.col("raw")).alias("url"), host(F.col("raw")).alias("host"), site(F.col("raw")).alias("site")),
    "allowed_pages": lambda s, d: allowed(P(s, d), ["example.com"]).select("item_id"),
    "diverse_pages": lambda s, d: diverse(P(s, d)).select("query_id", "item_id", "overflow", "place"),
    "fair_quota": lambda s, d: fair_quota(R(s, d), 12).select("query_id", "item_id", "place"),
    "fresh_first": lambda s, d: fresh_first(R(s, d), "2024-02-01 00:00:00").select("query_id", "item_id", "fresh_score"),
    "budgeted": lambda s, d: budgeted(R(s, d)).select("query_id", "item_id", "budget"),
    "weighted_fusion": lambda s, d: weighted_fusion(VIEWS(s, d), CLICKS(s, d)),
    "smart_fusion": lambda s, d: smart_fusion(VIEWS(s, d), CLICKS(s, d), 12),
    "merged_results": lambda s, d: merged_results(R(s, d).where("kind = 'view'").drop("kind"), R(s, d).where("kind <> 'view'").drop("kind"), 10).select("query_id", "item_id", "kind", "rank"),
    "score_trend": lambda s, d: score_trend(R(s, d)),
    "evicted": lambda s, d: evicted(table(s, d, "events").select(F.col("event_id").alias("item_id"), F.floor("value").cast("long").alias("size"), F.col("ts").alias("used_at")), 20_000),
    "simhash_pairs": lambda s, d: simhash_pairs(doc_simhash(s, d)),
    "compressed": lambda s, d: compressed(table(s, d, "documents").select("doc_id", "text"), ["the", "und", "les", "los", "and", "die"]),
    "temporal_boost": lambda s, d: temporal_boost(table(s, d, "documents").select("doc_id", "text", (F.col("n_chars") % 100 / 100).alias("score"), (F.col("n_chars") % 50 + 1980).cast("int").alias("year")), 1990, 2005).select("doc_id", "score"),
    "answer_grounding": lambda s, d: answer_grounding(*_answers(s, d)),
    "welch": lambda s, d: welch(table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select(F.col("quality").alias("group"), F.col("n_chars").alias("value"))),
}
_R = "WITH r AS (SELECT user_id AS query_id, event_id AS item_id, round(least(value / 200, 1), 6) AS score, event_type AS kind, ts, event_type || ' ' || substr(props, 1, 8) AS text FROM events)"
_P = r"WITH u AS (SELECT page_id, url, length(html) AS n, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages), p AS (SELECT page_id // 25 AS query_id, page_id AS item_id, n % 97 / 97 AS score, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS site FROM u)"
_BOTH = _R + ", v AS (SELECT query_id, item_id, score AS x FROM r WHERE kind = 'view'), c AS (SELECT query_id, item_id, round(1 - score, 6) AS y FROM r WHERE kind <> 'error'), j AS (SELECT query_id, item_id, x, y FROM v FULL JOIN c USING (query_id, item_id))"
_TERM = "list_distinct(list_filter(regexp_extract_all(lower({c}), '[\\p{L}\\p{N}_]+'), lambda x: length(x) >= 3))"
ORACLE_SQL = {
    "adaptive_relevance": f"{_R} SELECT query_id, item_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank, CASE WHEN count(*) OVER w >= 3 THEN greatest(0.3, avg(score) OVER w - stddev_pop(score) OVER w) ELSE 0.3 END AS low FROM r WINDOW w AS (PARTITION BY query_id)) WHERE score >= low OR rank = 1",
    "relevance_bands": f"{_R} SELECT query_id, item_id, CASE WHEN score >= 0.5 THEN 'relevant' WHEN score >= 0.3 THEN 'ambiguous' ELSE 'irrelevant' END AS band, share < 0.5 AS needs_web FROM (SELECT *, avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0 END) OVER (PARTITION BY query_id) AS share, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM r) WHERE score >= 0.3 OR rank = 1",
    "normal_urls": r"WITH b AS (SELECT page_id, CASE page_id % 4 WHEN 1 THEN regexp_replace(upper(url), '^[A-Z]+://', '') WHEN 2 THEN regexp_replace(url, '^(https?://)([^/]+)', '\1WWW.\2.co.uk') ELSE url END AS raw FROM pages), c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(raw, '#.*$', ''), '^[A-Za-z]+://', ''), '^(?i)www\.', '') AS rest, regexp_extract(lower(raw), '^(?:[a-z]+://)?([^/?#:]+)', 1) AS host FROM b), u AS (SELECT *, 'https://' || lower(regexp_extract(rest, '^([^/?]*)', 1)) || substr(rest, length(regexp_extract(rest, '^([^/?]*)', 1)) + 1) AS u FROM c), q AS (SELECT *, regexp_replace(string_split(u, '?')[1], '/+$', '') AS path, regexp_replace(regexp_replace(CASE WHEN contains(u, '?') THEN substr(u, instr(u, '?') + 1) ELSE '' END, '(^|&)(?:utm_[^=&]*|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS asked FROM u) SELECT page_id, path || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END AS url, host, CASE WHEN host LIKE '%.co.uk' THEN regexp_extract(host, '([^.]+\.co\.uk)$', 1) ELSE regexp_extract(host, '([^.]+\.[^.]+)$', 1) END AS site FROM q",
    "allowed_pages": f"{_P} SELECT item_id FROM p WHERE site <> 'example.com'",
    "diverse_pages": f"{_P} SELECT query_id, item_id, overflow, row_number() OVER (PARTITION BY query_id ORDER BY overflow, score DESC, item_id)::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, site ORDER BY score DESC, item_id) > 2 AS overflow FROM p)",
    "fair_quota": f"{_R} SELECT * FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY owed DESC, score DESC, item_id)::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, item_id) <= 4 AS owed FROM r)) WHERE place <= 12",
    "fresh_first": f"{_R} SELECT query_id, item_id, round(0.6::DOUBLE / rank + 0.4::DOUBLE * pow(0.5, greatest((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 3.6e9, 0) / 168), 6) AS fresh_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM r)",
    "budgeted": f"{_R} SELECT query_id, item_id, least(5000, greatest(800, floor(5000 * pow(0.7, rank - 1))))::INT AS budget FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM r)",
    "weighted_fusion": f"{_BOTH} SELECT query_id, item_id, round(0.7::DOUBLE * coalesce(x, 0) + 0.3::DOUBLE * coalesce(y, 0), 6) AS score FROM j",
    "smart_fusion": f"{_BOTH}, s AS (SELECT query_id, item_id, x IS NULL AS other, round(CASE WHEN x IS NULL THEN y ELSE x + 0.3::DOUBLE * coalesce(y, 0) END, 6) AS score FROM j) SELECT * FROM (SELECT query_id, item_id, other, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, other ORDER BY score DESC, item_id) AS nth FROM s WHERE NOT other OR score >= 0.25) WHERE NOT other OR nth <= 2) WHERE rank <= 12",
    "merged_results": f"{_R}, b AS (SELECT query_id, item_id, CASE WHEN kind = 'view' THEN 'own' ELSE 'web' END AS kind, text, CASE WHEN kind = 'view' THEN score + 0.1::DOUBLE ELSE score END AS score FROM r) SELECT * FROM (SELECT query_id, item_id, kind, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, substr(text, 1, 100) ORDER BY score DESC, item_id) AS nth FROM b) WHERE nth = 1) WHERE rank <= 10",
    "score_trend": f"{_R} SELECT query_id, CASE WHEN l - e > 0.05 THEN 'improving' WHEN l - e < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM (SELECT query_id, avg(score) FILTER (back <= 3) AS l, avg(score) FILTER (back BETWEEN 4 AND 6) AS e FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, item_id DESC) AS back FROM r) GROUP BY 1) WHERE e IS NOT NULL",
    "evicted": "SELECT event_id AS item_id FROM (SELECT event_id, coalesce(sum(floor(value)::BIGINT) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, sum(floor(value)::BIGINT) OVER () AS total FROM events) WHERE total > 20000 AND total - ahead > 0.8 * 20000",
    "simhash_pairs": f"WITH s AS ({PASSAGES_SQL['doc_simhash']}), c AS (SELECT simhash, min(doc_id) AS doc_id FROM s GROUP BY 1) SELECT a.doc_id AS a, b.doc_id AS b, bit_count(xor(a.simhash, b.simhash))::INT AS distance FROM c a JOIN c b ON a.doc_id < b.doc_id AND bit_count(xor(a.simhash, b.simhash)) <= 3",
    "welch": "WITH g AS (SELECT quality AS g, avg(n_chars) AS m, var_samp(n_chars) AS v, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1), o AS (SELECT max(m) FILTER (g = 1) - max(m) FILTER (g = 0) AS d, sqrt(max(v / n) FILTER (g = 1) + max(v / n) FILTER (g = 0)) AS se, max(m) FILTER (g = 0) AS base FROM g), k AS (SELECT *, abs(d / se) AS t, 1 / (1 + 0.2316419::DOUBLE * abs(d / se)) AS k FROM o) SELECT round(d / se, 6) AS t, round(2 * exp(-t * t / 2) / 2.5066282746310002::DOUBLE * k * (0.319381530::DOUBLE + k * (-0.356563782::DOUBLE + k * (1.781477937::DOUBLE + k * (-1.821255978::DOUBLE + k * 1.330274429::DOUBLE)))), 6) AS p, round(d - 1.96::DOUBLE * se, 4) AS low, round(d + 1.96::DOUBLE * se, 4) AS high, d <= -0.2 * base AS alert FROM k",
    "temporal_boost": r"SELECT doc_id, round(n_chars % 100 / 100 * CASE WHEN n_chars % 50 + 1980 BETWEEN 1990 AND 2005 OR len(list_filter(regexp_extract_all(substr(text, 1, 500), '\b(?:19|20)[0-9]{2}\b'), lambda y: y::INT BETWEEN 1990 AND 2005)) > 0 THEN 1.15::DOUBLE ELSE 1 END, 6) AS score FROM documents",
    "compressed": "WITH s AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[.!?]+\\s+'), lambda x: x <> '')) AS s FROM documents WHERE length(text) >= 150), c AS (SELECT doc_id, len(list_intersect(" + _TERM.replace("{c}", "s") + ", ['the', 'und', 'les', 'los', 'and', 'die'])) / 6 AS score FROM s), m AS (SELECT doc_id, quantile_cont(score, 0.5) AS m, count(*) AS sentences FROM c GROUP BY 1 HAVING count(*) > 2) SELECT doc_id, count(*) AS kept, any_value(sentences) AS sentences FROM c JOIN m USING (doc_id) WHERE score >= greatest(m, 0.01) GROUP BY 1",
    "answer_grounding": "WITH ev AS (SELECT doc_id % 20 AS id, doc_id AS ev, unnest(" + _TERM.replace("{c}", "text") + ") AS t FROM documents), tot AS (SELECT doc_id % 20 AS id, count(*) AS n FROM documents GROUP BY 1), idf AS (SELECT id, t, ln(1 + n / count(*)) AS w FROM ev JOIN tot USING (id) GROUP BY id, t, n), se AS (SELECT item_id AS id, s, generate_subscripts(s, 1) AS nth, unnest(s) AS x FROM (SELECT item_id, list_filter(string_split_regex(text, '[.!?]+\\s+'), lambda x: x <> '') AS s FROM benchmark)), st AS (SELECT id, nth, unnest(" + _TERM.replace("{c}", "x") + ") AS t FROM se), a AS (SELECT st.id, nth, st.t, coalesce(w, ln(1 + n)) AS w FROM st JOIN tot USING (id) LEFT JOIN idf USING (id, t)), wh AS (SELECT id, nth, sum(w) AS whole FROM a GROUP BY 1, 2), co AS (SELECT id, nth, max(c) AS c FROM (SELECT a.id, nth, ev, sum(w) AS c FROM a JOIN ev USING (id, t) GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT id AS answer_id, round(avg(coalesce(c, 0) / whole), 6) AS grounding, round(avg(CASE WHEN coalesce(c, 0) / whole < 0.25 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS unsupported FROM wh LEFT JOIN co USING (id, nth) GROUP BY 1",
}
