"""Feedback, sessions, telemetry, retention, and states kept as journals: operators on frames, applied to the tables by the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.tables import table


def satisfaction_sets(rows: DataFrame) -> DataFrame:
    """(source, kind, n, satisfaction): of feedback (source, kind, good) in all, by source and by kind, in one pass."""
    sets = rows.groupingSets([[], ["source"], ["kind"]], "source", "kind")
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("good"), 6).alias("satisfaction"))


def insights(rows: DataFrame, least: int = 3, share: float = 0.2) -> DataFrame:
    """(name, value): the source of most satisfaction among those with enough feedback, and kinds that have a large share of bad feedback."""
    by = rows.groupBy("source").agg(F.count("*").alias("n"), F.avg("good").alias("p")).where(F.col("n") >= least)
    best = by.agg(F.max_by("source", F.struct("p", F.col("n"), "source")).alias("value")).select(F.lit("best_source").alias("name"), "value")
    bad = rows.where("good = 0").groupBy("kind").agg(F.count("*").alias("k"))
    total = rows.agg(F.count_if(F.col("good") == 0).alias("all_bad"))
    often = bad.join(F.broadcast(total), F.lit(True)).where(F.col("k") >= share * F.col("all_bad")).select(F.lit("frequent_reason").alias("name"), F.col("kind").alias("value"))
    return best.unionByName(often)


def breakdown(rows: DataFrame) -> DataFrame:
    """(kind, good, n, percent): each value's share of its kind."""
    counts = rows.groupBy("kind", "good").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("kind")), 4))


def daily_trend(rows: DataFrame, last: str, days: int = 30) -> DataFrame:
    """(day, n, mean) of the days up to one."""
    day = F.to_date("ts")
    return rows.where((day <= last) & (day > F.date_sub(F.lit(last).cast("date"), days))).groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def period_comparison(rows: DataFrame, day: str) -> DataFrame:
    """(kind, before, recent, change): means before a day and from it on."""
    late = F.to_date("ts") >= day
    means = rows.groupBy("kind").agg(F.avg(F.when(~late, F.col("value"))).alias("b"), F.avg(F.when(late, F.col("value"))).alias("r"))
    return means.select("kind", F.round("b", 6).alias("before"), F.round("r", 6).alias("recent"), F.round(F.col("r") - F.col("b"), 6).alias("change"))


def wilson(good: Column, n: Column, z: float = 1.96) -> Column:
    """The lower bound of a share."""
    p = good / n
    return (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def utility_scores(rows: DataFrame) -> DataFrame:
    """(chunk_id, n, utility): of chunks named in feedback (chunk_ids: a JSON array, good)."""
    each = rows.select("good", F.explode(F.from_json("chunk_ids", "array<bigint>")).alias("chunk_id"))
    sums = each.groupBy("chunk_id").agg(F.count("*").alias("n"), F.sum("good").alias("k"))
    return sums.select("chunk_id", "n", F.round(wilson(F.col("k"), F.col("n")), 6).alias("utility"))


def age_buckets(rows: DataFrame, day: str) -> DataFrame:
    """(bucket, n): of rows by the age of ``at``, or unknown."""
    age = F.datediff(F.lit(day).cast("date"), "at")
    bucket = F.when(age.isNull(), "unknown").when(age < 30, "month").when(age < 90, "quarter").when(age < 365, "year").when(age < 1095, "three_years").otherwise("older")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def mood_slopes(rows: DataFrame, decay: float = 0.9) -> DataFrame:
    """(user_id, n, mean, slope) of a user's whole series (ts, item_id, value): weights fall by a tenth with each later value; the slope is by
    hours, with weights on the residuals, so squared."""
    age = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("item_id"))) - 1
    start = F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id"))
    rows = rows.withColumns({"w": F.pow(F.lit(decay), age), "x": (F.unix_micros(F.col("ts").cast("timestamp")) - start) / 3.6e9}).withColumn("q", F.col("w") * F.col("w"))
    sums = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.expr("w * value")).alias("swy"), *(F.sum(F.expr(e)).alias(a) for a, e in (("s", "q"), ("sx", "q * x"), ("sy", "q * value"), ("sxx", "q * x * x"), ("sxy", "q * x * value"))))
    bend = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when((F.col("n") > 1) & (bend > 0), (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / bend)
    return sums.select("user_id", "n", F.round(F.col("swy") / F.col("sw"), 5).alias("mean"), F.round(slope, 5).alias("slope"))


def last_trend(rows: DataFrame, k: int = 5, low: float = 50.0) -> DataFrame:
    """(user_id, first, last, mean, lows, alert): a user's last k values, and whether two or more of these are low."""
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("item_id")))
    recent = rows.withColumn("back", back).where(F.col("back") <= k)
    found = recent.groupBy("user_id").agg(F.max_by("value", "back").alias("first"), F.min_by("value", "back").alias("last"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") < low).alias("lows"))
    return found.withColumn("alert", F.col("lows") >= 2)


def session_list(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    """(conv_id, messages, last_turn): a page of sessions, the newest first."""
    return rows.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn")).orderBy(F.desc("conv_id")).offset(offset).limit(limit)


def recent_users(rows: DataFrame, limit: int) -> DataFrame:
    return rows.groupBy("user_id").agg(F.max("ts").alias("seen")).orderBy(F.desc("seen"), "user_id").limit(limit)


def percentile_report(rows: DataFrame, accuracy: int | None = None) -> DataFrame:
    """(route, day, n, mean, p50, p90, p99) in all, by route and by day: exact, or with an accuracy in bounded memory."""
    rows = rows.withColumn("day", F.to_date("ts"))
    at = F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))
    p = F.percentile("value", at) if accuracy is None else F.percentile_approx("value", at, accuracy)
    sums = rows.groupingSets([[], ["route"], ["day"]], "route", "day").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), p.alias("p"))
    return sums.select("route", "day", "n", "mean", *(F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("p50", "p90", "p99"))))


def extraction_report(rows: DataFrame, since: str, until: str, least: float = 0.05) -> DataFrame:
    """(kind, n, mean, trend): a window of time against the one as long before it; stable if that has no rows or a mean of 0."""
    a, b = F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")
    now = (F.col("ts") >= a) & (F.col("ts") < b)
    old = (F.col("ts") >= a - (b - a)) & (F.col("ts") < a)
    sums = rows.groupBy("kind").agg(F.count_if(now).alias("n"), F.avg(F.when(now, F.col("value"))).alias("m"), F.avg(F.when(old, F.col("value"))).alias("o"))
    change = F.try_divide("m", "o") - 1
    return sums.where("n > 0").select("kind", "n", F.round("m", 6).alias("mean"), F.when(change > least, "improving").when(change < -least, "declining").otherwise("stable").alias("trend"))


def admitted(rows: DataFrame, most: int = 5, seconds: int = 10) -> DataFrame:
    """(item_id, before, admitted): whether a user has made fewer than so many requests in the seconds before each."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    window = Window.partitionBy("user_id").orderBy("us").rangeBetween(-seconds * 1_000_000, 0)
    found = rows.withColumn("us", us).withColumn("before", F.count("*").over(window) - 1)
    return found.select("item_id", "before", (F.col("before") < most).alias("admitted"))


def sequence_breaks(rows: DataFrame) -> DataFrame:
    """(run, item_id, step): events whose number does not follow on the one before in their run by one."""
    step = F.col("number") - F.lag("number").over(Window.partitionBy("run").orderBy("number", "item_id"))
    return rows.withColumn("step", step).where("step <> 1").select("run", "item_id", "step")


def novelty(rows: DataFrame, now: str, half_life: float = 86_400.0, limit: int = 100) -> DataFrame:
    """(path, novelty): how lately and in how many ways something changed, by its last changes: weights by kind fall with age."""
    back = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("item_id")))
    recent = rows.withColumn("back", back).where(F.col("back") <= limit)
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    weight = F.when(F.col("kind") == "signup", 1.0).when(F.col("kind") == "view", 0.75).when(F.col("kind") == "error", 0.35).otherwise(0.5)
    sums = recent.groupBy("path").agg(F.avg(weight * F.exp(-F.greatest(age, F.lit(0.0)) / half_life)).alias("a"), F.countDistinct("kind").alias("kinds"))
    return sums.select("path", F.round(0.7 * F.col("a") + 0.25 * F.least(F.lit(1.0), F.col("kinds") / min(limit, 10)), 6).alias("novelty"))


def retained(rows: DataFrame, day: str, days: int) -> DataFrame:
    """Rows whose time to live has not ended: ``until``, or else so many days after the earliest of their times."""
    ends = F.coalesce("until", F.date_add(F.least("created", "fetched", "seen"), days))
    return rows.where(ends.isNull() | (ends >= day))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Child rows of no deleted parent."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def upserted(rows: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """A table after changes: of each key the row of the highest version."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version)))
    return rows.unionByName(changes).withColumn("nth", nth).where("nth = 1").drop("nth")


def unscored(rows: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    return rows.join(scored.select(key), key, "left_anti")


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): of two snapshots (path, digest): added, deleted or modified."""
    both = before.select("path", F.col("digest").alias("old")).join(after.select("path", F.col("digest").alias("new")), "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def journal_state(journal: DataFrame) -> DataFrame:
    """(item_id, revision, after): the state that a journal (item_id, revision, expected, after) leads to: only changes that expected the
    revision before theirs count, up to the first that did not; a null ``after`` deletes."""
    order = Window.partitionBy("item_id").orderBy("revision")
    follows = F.coalesce(F.col("expected") == F.lag("revision").over(order), F.lit(True))
    valid = journal.withColumn("good", follows).withColumn("good", F.min(F.col("good").cast("int")).over(order)).where("good = 1")
    last = valid.groupBy("item_id").agg(F.max("revision").alias("revision"), F.max_by(F.struct("after"), "revision")["after"].alias("after"))
    return last.where("after is not null")


def quarantined(rows: DataFrame, reasons: DataFrame, day: str, keep_days: int = 30) -> DataFrame:
    """(item_id, status, backup): rows with a reason (item_id, reason, since, restored) are put away as JSON, purged after some days, unless
    they were restored; others stay active."""
    found = rows.join(reasons, "item_id", "left")
    status = F.when(F.col("reason").isNull() | F.col("restored"), "active").when(F.date_add("since", keep_days) < day, "purged").otherwise("quarantined")
    backup = F.when(status == "quarantined", F.to_json(F.struct(*(F.col(c) for c in rows.columns))))
    return found.select("item_id", status.alias("status"), backup.alias("backup"))


def events(s, d) -> DataFrame:
    return table(s, d, "events").select(F.col("event_id").alias("item_id"), "user_id", F.col("event_type").alias("kind"), "value", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))


def feedback(s, d) -> DataFrame:
    return table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select("doc_id", "source", F.col("lang").alias("kind"), F.col("quality").alias("good"))


def _retained(s, d):
    day = F.to_date("o_orderdate")
    rows = table(s, d, "orders").select("o_orderkey", day.alias("created"), F.date_add(day, (F.col("o_orderkey") % 50).cast("int")).alias("fetched"), F.date_sub(day, (F.col("o_orderkey") % 9).cast("int")).alias("seen"), F.when(F.col("o_orderstatus") == "P", F.date_add(day, 2000)).alias("until"))
    return retained(rows, "2000-01-01", 900)


def _journal(s, d):
    rows = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").cast("long").alias("revision"))
    rows = rows.agg(F.max("l_quantity").alias("q"), F.min("l_returnflag").alias("flag"), F.min("l_shipdate").cast("string").alias("at"))
    return journal_state(rows.select("item_id", "revision", F.when(F.col("q") > 48, F.lit(0)).otherwise(F.col("revision") - 1).cast("long").alias("expected"), F.when(F.col("flag") != "R", F.col("at")).alias("after")))


def _quarantined(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("status_code"))
    reasons = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("item_id"), F.lit("urgent").alias("reason"), F.to_date("o_orderdate").alias("since"), (F.col("o_orderstatus") == "F").alias("restored"))
    return quarantined(rows, reasons, "2000-01-01", 365)


QUERIES = {
    "satisfaction_sets": lambda s, d: satisfaction_sets(feedback(s, d)),
    "feedback_insights": lambda s, d: insights(feedback(s, d)),
    "feedback_breakdown": lambda s, d: breakdown(feedback(s, d)),
    "daily_trend": lambda s, d: daily_trend(events(s, d), "2024-01-25", 20),
    "period_comparison": lambda s, d: period_comparison(events(s, d), "2024-01-20"),
    "chunk_utility": lambda s, d: utility_scores(events(s, d).select(F.concat(F.lit("["), "k", F.lit(","), F.col("k") + 1, F.lit("]")).alias("chunk_ids"), (F.col("value") > 100).cast("int").alias("good"))),
    "age_buckets": lambda s, d: age_buckets(table(s, d, "orders").select(F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("at")), "2001-08-01"),
    "mood_slopes": lambda s, d: mood_slopes(events(s, d)),
    "last_trend": lambda s, d: last_trend(events(s, d)),
    "session_page": lambda s, d: session_list(table(s, d, "conversations"), 20, 10),
    "recent_users": lambda s, d: recent_users(events(s, d), 10),
    "percentile_report": lambda s, d: percentile_report(events(s, d).withColumnRenamed("kind", "route")),
    "extraction_report": lambda s, d: extraction_report(events(s, d), "2024-01-15 00:00:00", "2024-01-29 00:00:00"),
    "admitted": lambda s, d: admitted(events(s, d), 2, 7200),
    "sequence_breaks": lambda s, d: sequence_breaks(events(s, d).select(F.col("user_id").alias("run"), "item_id", F.col("k").alias("number"))),
    "novelty": lambda s, d: novelty(events(s, d).withColumnRenamed("user_id", "path"), "2024-01-31 00:00:00"),
    "retained": lambda s, d: _retained(s, d).select("o_orderkey"),
    "orphan_lines": lambda s, d: without(table(s, d, "lineitem"), table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select("l_orderkey", "l_linenumber"),
    "upserted": lambda s, d: upserted(table(s, d, "customer").select("c_custkey", F.lit(0).alias("version"), "c_name"), table(s, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lit(1).alias("version"), F.col("s_name").alias("c_name")), ["c_custkey"], "version"),
    "unscored": lambda s, d: unscored(table(s, d, "documents"), table(s, d, "labels"), "doc_id").select("doc_id"),
    "file_changes": lambda s, d: file_changes(table(s, d, "documents").where("doc_id % 2 = 0 or source <> 'src1'").select(F.col("doc_id").alias("path"), F.md5("text").alias("digest")), table(s, d, "documents").where("source <> 'src2'").select(F.col("doc_id").alias("path"), F.md5(F.when(F.col("lang") == "fr", F.upper("text")).otherwise(F.col("text"))).alias("digest"))),
    "journal_state": _journal,
    "quarantined": _quarantined,
    "quarantine_counts": lambda s, d: _quarantined(s, d).groupBy("status").agg(F.count("*").alias("n")),
}
_E = "WITH e AS (SELECT event_id AS item_id, user_id, event_type AS kind, value, ts, (props->>'$.k')::BIGINT AS k FROM events)"
_FB = "WITH f AS (SELECT doc_id, source, lang AS kind, quality AS good FROM labels JOIN documents USING (doc_id))"
_QU = "WITH q AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderpriority <> '1-URGENT' OR o_orderstatus = 'F' THEN 'active' WHEN o_orderdate::DATE + 365 < DATE '2000-01-01' THEN 'purged' ELSE 'quarantined' END AS status, o_orderstatus FROM orders)"
ORACLE_SQL = {
    "satisfaction_sets": f"{_FB} SELECT source, kind, count(*) AS n, round(avg(good), 6) AS satisfaction FROM f GROUP BY GROUPING SETS ((), (source), (kind))",
    "feedback_insights": f"{_FB} SELECT 'best_source' AS name, (SELECT source FROM f GROUP BY 1 HAVING count(*) >= 3 ORDER BY avg(good) DESC, count(*) DESC, source DESC LIMIT 1) AS value UNION ALL SELECT 'frequent_reason', kind FROM f WHERE good = 0 GROUP BY kind HAVING count(*) >= 0.2 * (SELECT count(*) FROM f WHERE good = 0)",
    "feedback_breakdown": f"{_FB} SELECT kind, good, n, round(100 * n / sum(n) OVER (PARTITION BY kind), 4) AS percent FROM (SELECT kind, good, count(*) AS n FROM f GROUP BY 1, 2)",
    "daily_trend": f"{_E} SELECT ts::DATE AS day, count(*) AS n, round(avg(value), 6) AS mean FROM e WHERE ts::DATE <= DATE '2024-01-25' AND ts::DATE > DATE '2024-01-25' - 20 GROUP BY 1",
    "period_comparison": f"{_E} SELECT kind, round(b, 6) AS before, round(r, 6) AS recent, round(r - b, 6) AS change FROM (SELECT kind, avg(value) FILTER (ts::DATE < DATE '2024-01-20') AS b, avg(value) FILTER (ts::DATE >= DATE '2024-01-20') AS r FROM e GROUP BY 1)",
    "chunk_utility": f"{_E}, c AS (SELECT unnest([k, k + 1]) AS chunk_id, (value > 100)::INT AS good FROM e), g AS (SELECT chunk_id, count(*) AS n, avg(good) AS p FROM c GROUP BY 1) SELECT chunk_id, n, round((p + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt((p * (1 - p) + 3.8416::DOUBLE / (4 * n)) / n)) / (1 + 3.8416::DOUBLE / n), 6) AS utility FROM g",
    "age_buckets": "SELECT CASE WHEN a IS NULL THEN 'unknown' WHEN a < 30 THEN 'month' WHEN a < 90 THEN 'quarter' WHEN a < 365 THEN 'year' WHEN a < 1095 THEN 'three_years' ELSE 'older' END AS bucket, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN DATE '2001-08-01' - o_orderdate::DATE END AS a FROM orders) GROUP BY 1",
    "mood_slopes": f"{_E}, w AS (SELECT user_id, value, pow(0.9, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) - 1) AS w, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9 AS x FROM e), s AS (SELECT user_id, count(*) AS n, sum(w * value) / sum(w) AS m, sum(w * w) AS s, sum(w * w * x) AS sx, sum(w * w * value) AS sy, sum(w * w * x * x) AS sxx, sum(w * w * x * value) AS sxy FROM w GROUP BY 1) SELECT user_id, n, round(m, 5) AS mean, round(CASE WHEN n > 1 AND s * sxx - sx * sx > 0 THEN (s * sxy - sx * sy) / (s * sxx - sx * sx) END, 5) AS slope FROM s",
    "last_trend": f"{_E}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS back FROM e) SELECT user_id, arg_max(value, back) AS first, arg_min(value, back) AS last, round(avg(value), 6) AS mean, count(*) FILTER (value < 50) AS lows, count(*) FILTER (value < 50) >= 2 AS alert FROM b WHERE back <= 5 GROUP BY 1",
    "session_page": "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY 1 ORDER BY conv_id DESC LIMIT 20 OFFSET 10",
    "recent_users": f"{_E} SELECT user_id, max(ts) AS seen FROM e GROUP BY 1 ORDER BY seen DESC, user_id LIMIT 10",
    "percentile_report": f"{_E} SELECT kind AS route, day, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM (SELECT *, ts::DATE AS day FROM e) GROUP BY GROUPING SETS ((), (kind), (day))",
    "extraction_report": f"{_E} SELECT kind, n, round(m, 6) AS mean, CASE WHEN m / o - 1 > 0.05 THEN 'improving' WHEN m / o - 1 < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM (SELECT kind, count(*) FILTER (ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-29') AS n, avg(value) FILTER (ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-29') AS m, avg(value) FILTER (ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-15') AS o FROM e GROUP BY 1) WHERE n > 0",
    "admitted": f"{_E} SELECT item_id, b - 1 AS before, b - 1 < 2 AS admitted FROM (SELECT item_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW) AS b FROM e)",
    "sequence_breaks": f"{_E} SELECT * FROM (SELECT user_id AS run, item_id, k - lag(k) OVER (PARTITION BY user_id ORDER BY k, item_id) AS step FROM e) WHERE step <> 1",
    "novelty": f"{_E}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS back FROM e) SELECT user_id AS path, round(0.7::DOUBLE * avg(CASE kind WHEN 'signup' THEN 1.0 WHEN 'view' THEN 0.75 WHEN 'error' THEN 0.35 ELSE 0.5 END::DOUBLE * exp(-(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 1e6 / 86400)) + 0.25::DOUBLE * least(1, count(DISTINCT kind) / 10), 6) AS novelty FROM b WHERE back <= 100 GROUP BY 1",
    "retained": "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'P' THEN o_orderdate::DATE + 2000 ELSE o_orderdate::DATE - (o_orderkey % 9)::INT + 900 END >= DATE '2000-01-01'",
    "orphan_lines": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')",
    "upserted": "SELECT c_custkey, CASE WHEN s_name IS NULL THEN 0 ELSE 1 END AS version, coalesce(s_name, c_name) AS c_name FROM customer FULL JOIN supplier ON c_custkey = s_suppkey",
    "unscored": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "file_changes": "SELECT doc_id AS path, CASE WHEN source = 'src2' THEN 'deleted' WHEN doc_id % 2 <> 0 AND source = 'src1' THEN 'added' ELSE 'modified' END AS change FROM documents WHERE source = 'src2' OR (doc_id % 2 <> 0 AND source = 'src1') OR (lang = 'fr' AND upper(text) <> text)",
    "journal_state": "WITH j AS (SELECT l_orderkey AS item_id, l_linenumber::BIGINT AS revision, CASE WHEN max(l_quantity) > 48 THEN 0 ELSE l_linenumber - 1 END AS expected, CASE WHEN min(l_returnflag) <> 'R' THEN strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') END AS after FROM lineitem GROUP BY l_orderkey, l_linenumber), b AS (SELECT *, coalesce(expected = lag(revision) OVER w, true) AS good FROM j WINDOW w AS (PARTITION BY item_id ORDER BY revision)), g AS (SELECT *, bool_and(good) OVER (PARTITION BY item_id ORDER BY revision) AS ok FROM b), l AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY revision DESC) AS back FROM g WHERE ok) SELECT item_id, revision, after FROM l WHERE back = 1 AND after IS NOT NULL",
    "quarantined": f"""{_QU} SELECT item_id, status, CASE WHEN status = 'quarantined' THEN '{{"item_id":' || item_id || ',"status_code":"' || o_orderstatus || '"}}' END AS backup FROM q""",
    "quarantine_counts": f"{_QU} SELECT status, count(*) AS n FROM q GROUP BY 1",
}
