"""Sessions, feedback and telemetry; event-time windows are extensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.sources.tables import table


def events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def latency_percentiles(spark, d):
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), p.alias("p"))
    return rows.select("event_type", "n", "mean", *(F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("p50", "p90", "p99"))))


def session_stats(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("messages"), *(F.count_if(F.col("role") == r).alias(r) for r in ("user", "assistant", "system"))
    )


def message_search(spark, d):
    found = table(spark, d, "conversations").where(F.col("text").ilike("%the%"))
    return found.select("conv_id", "turn", F.substring("text", 1, 200).alias("preview")).orderBy(F.desc("conv_id"), F.desc("turn")).limit(100)


def dup_suppression_30s(spark, d):
    """Events that no event of the same user and type precedes within 30 seconds."""
    w = Window.partitionBy("user_id", "event_type").orderBy("us", "event_id")
    rows = events(spark, d).withColumn("gap", F.col("us") - F.lag("us").over(w))
    return rows.where("gap is null or gap > 30000000").select("event_id", "user_id", "event_type")


def rate_limit_window(spark, d):
    """Events of a user in the hour up to each one."""
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return events(spark, d).select("event_id", F.count("*").over(w).alias("in_window"))


def session_windows(spark, d):
    """Sessions that end after half an hour without an event."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    new = F.coalesce((F.col("us") - F.lag("us").over(w) > 1_800_000_000).cast("long"), F.lit(1))
    rows = events(spark, d).withColumn("new", new)
    rows = rows.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


def tumbling_counts(spark, d):
    """Events by hour and type."""
    return events(spark, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))


def satisfaction(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("satisfaction"), F.sum("toxic").alias("toxic"))


def wilson_utility(spark, d, z: float = 1.96):
    """Lower bound of the share of good documents of each source."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.avg("quality").alias("p"))
    n, p = F.col("n"), F.col("p")
    low = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return rows.select("source", "n", F.round(low, 6).alias("utility"))


def age_distribution(spark, d):
    """Orders by age at a reference day."""
    age = F.datediff(F.lit("2001-08-01").cast("date"), F.to_date("o_orderdate"))
    bucket = F.when(age < 30, "month").when(age < 90, "quarter").when(age < 365, "year").when(age < 1095, "three").otherwise("older")
    return table(spark, d, "orders").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (latency_percentiles, session_stats, message_search, dup_suppression_30s, rate_limit_window, session_windows, tumbling_counts, satisfaction, wilson_utility, age_distribution)}
ORACLE_SQL = {
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "session_stats": "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user, count(*) FILTER (role = 'assistant') AS assistant, count(*) FILTER (role = 'system') AS system FROM conversations GROUP BY 1",
    "message_search": "SELECT conv_id, turn, substr(text, 1, 200) AS preview FROM conversations WHERE text ILIKE '%the%' ORDER BY conv_id DESC, turn DESC LIMIT 100",
    "dup_suppression_30s": "SELECT event_id, user_id, event_type FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events) WHERE gap IS NULL OR gap > 30000000",
    "rate_limit_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_window FROM events",
    "session_windows": "SELECT user_id, session, count(*) AS n, min(ts) AS began, max(ts) AS ended FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2",
    "tumbling_counts": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "satisfaction": "SELECT source, count(*) AS n, round(avg(quality), 6) AS satisfaction, sum(toxic)::BIGINT AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "wilson_utility": "SELECT source, n, round((p + 3.8416 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS utility FROM (SELECT source, count(*) AS n, avg(quality) AS p FROM labels JOIN documents USING (doc_id) GROUP BY 1)",
    "age_distribution": "SELECT CASE WHEN a < 30 THEN 'month' WHEN a < 90 THEN 'quarter' WHEN a < 365 THEN 'year' WHEN a < 1095 THEN 'three' ELSE 'older' END AS bucket, count(*) AS n FROM (SELECT DATE '2001-08-01' - o_orderdate::DATE AS a FROM orders) GROUP BY 1",
}
