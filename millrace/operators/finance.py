"""Filters, reports and budgets of bookings: each operator takes frames and parameters; the queries apply them to the tables.

Bookings: tx_id, account_id, booking_date, month, amount_cents (negative: expense), currency, counterparty, category, purpose.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ledger import UNIQUE_SQL, transfer_events, unique_transfers
from millrace.sources.tables import LEDGER_SQL, ledger, table


def spent_cents() -> Column:
    return F.greatest(-F.col("amount_cents"), F.lit(0))


def gained_cents() -> Column:
    return F.greatest(F.col("amount_cents"), F.lit(0))


def bookings(spark, d: str) -> DataFrame:
    """The ledger with the customer's nation as counterparty and segment as category."""
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    who = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    who = who.select(F.col("c_custkey").alias("account_id"), "nation", F.col("c_mktsegment").alias("category"))
    rows = ledger(spark, d).withColumnRenamed("counterparty", "purpose").join(who, "account_id")
    return rows.select("tx_id", "account_id", "booking_date", "month", "amount_cents", "currency", F.col("nation").alias("counterparty"), "category", "purpose")


BOOKINGS = "WITH " + LEDGER_SQL + """,
bookings AS (SELECT tx_id, account_id, booking_date, month, amount_cents, currency, n_name AS counterparty, c_mktsegment AS category, counterparty AS purpose
  FROM ledger JOIN customer ON account_id = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def like_needle(value: str) -> str:
    """A search term as a LIKE pattern for any place of a text: quotes go, * and ? are wildcards."""
    plain = value.strip().strip("\"'").replace("*", "%").replace("?", "_")
    return "%" + re.sub("%+", "%", plain).strip("%") + "%"


def filter_bookings(
    rows: DataFrame, account: int | None = None, start: str | None = None, end: str | None = None, needle: str | None = None,
    category: str | None = None, least: int | None = None, most: int | None = None, limit: int = 500, offset: int = 0,
) -> DataFrame:
    """Bookings of an account, between two days, with a needle in counterparty, purpose or category, of a category, between
    two amounts; the latest first, 1 to 500 of them."""
    if account is not None:
        rows = rows.where(F.col("account_id") == account)
    if start is not None:
        rows = rows.where(F.col("booking_date") >= start)
    if end is not None:
        rows = rows.where(F.col("booking_date") <= end)
    if needle:
        rows = rows.where(F.col("counterparty").ilike(like_needle(needle)) | F.col("purpose").ilike(like_needle(needle)) | F.col("category").ilike(like_needle(needle)))
    if category is not None:
        rows = rows.where(F.col("category") == category)
    if least is not None:
        rows = rows.where(F.col("amount_cents") >= least)
    if most is not None:
        rows = rows.where(F.col("amount_cents") <= most)
    return rows.orderBy(F.desc("booking_date"), F.desc("tx_id")).offset(offset).limit(min(500, max(1, limit)))


def normal_name(name: Column) -> Column:
    """Lower case, white space as one space; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(name), r"\s+", " ")), F.lit(""))


def signature() -> Column:
    """A digest that equal bookings of an account share."""
    text = lambda c: F.coalesce(F.trim(F.lower(c)), F.lit(""))
    return F.sha2(F.concat_ws("\x1f", F.col("account_id"), F.col("booking_date"), F.col("amount_cents"), text("counterparty"), text("purpose")), 256)


def new_bookings(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Of imported rows the first of each signature that is not known yet."""
    signed = rows.withColumn("signature", signature())
    first = Window.partitionBy("signature").orderBy("tx_id")
    fresh = signed.join(known.select(signature().alias("signature")).distinct(), "signature", "left_anti")
    return fresh.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def transaction_nature(rows: DataFrame, links: DataFrame, settled: DataFrame, kinds: DataFrame) -> DataFrame:
    """(tx_id, nature): internal_transfer for a leg of a link (out_id, in_id), a settlement (tx_id), or where the category of most
    confidence (tx_id, category_id, kind, confidence) is one of transfers; else ordinary."""
    legs = links.select(F.col("out_id").alias("tx_id")).union(links.select("in_id")).union(settled.select("tx_id")).distinct().withColumn("inside", F.lit(True))
    best = kinds.groupBy("tx_id").agg(F.max_by("kind", F.struct("confidence", -F.col("category_id"))).alias("kind"))
    found = rows.select("tx_id").join(legs, "tx_id", "left").join(best, "tx_id", "left")
    inside = F.coalesce("inside", F.lit(False)) | F.coalesce(F.col("kind") == "transfer", F.lit(False))
    return found.select("tx_id", F.when(inside, "internal_transfer").otherwise("ordinary").alias("nature"))


def counterparty_costs(rows: DataFrame, needle: str) -> DataFrame:
    """Costs, refunds and net of counterparties like a needle, by currency and (currency null) in all, in one pass."""
    rows = rows.where(F.col("counterparty").ilike(like_needle(needle)))
    sums = rows.rollup("currency").agg(F.sum(spent_cents()).alias("expense"), F.sum(gained_cents()).alias("refund"), F.sum("amount_cents").alias("net"), F.count("*").alias("n"), F.grouping_id().alias("level"))
    return sums.withColumn("level", F.col("level").cast("int"))


def category_costs(rows: DataFrame, wanted: str, suffixes: tuple[str, ...] = ("s", "es", "n", "en")) -> DataFrame:
    """Expense, refund and net of the one category that a name means: the same but for case and an ending. A name that more than
    one category fits gives no rows."""
    forms = [wanted.lower(), *(wanted.lower().removesuffix(s) for s in suffixes), *(wanted.lower() + s for s in suffixes)]
    fits = rows.where(F.lower("category").isin(forms))
    one = fits.agg(F.countDistinct("category").alias("k")).where("k = 1")
    sums = fits.groupBy("category", "currency").agg(F.sum(spent_cents()).alias("expense"), F.sum(gained_cents()).alias("refund"), F.sum("amount_cents").alias("net"), F.count("*").alias("n"))
    return sums.join(F.broadcast(one), F.lit(True)).drop("k")


def monthly_report(rows: DataFrame, top: int = 10) -> DataFrame:
    """For each month and currency: (part, name, income, expense, n, rank): totals, each category, and the counterparties of most
    expense."""
    flows = [F.sum(gained_cents()).alias("income"), F.sum(spent_cents()).alias("expense"), F.count("*").alias("n")]
    by = ["month", "currency"]
    totals = rows.groupBy(*by).agg(*flows).select(*by, F.lit("total").alias("part"), F.lit("").alias("name"), "income", "expense", "n", F.lit(1).alias("rank"))
    kinds = rows.groupBy(*by, "category").agg(*flows).select(*by, F.lit("category").alias("part"), F.col("category").alias("name"), "income", "expense", "n", F.lit(1).alias("rank"))
    names = rows.groupBy(*by, "counterparty").agg(*flows).where("expense > 0")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("expense"), "counterparty"))
    names = names.withColumn("rank", rank).where(F.col("rank") <= top).select(*by, F.lit("counterparty").alias("part"), F.col("counterparty").alias("name"), "income", "expense", "n", "rank")
    return totals.unionByName(kinds).unionByName(names)


def budgets_of(rows: DataFrame) -> DataFrame:
    """(category, month, budget): what a category spent in the month before, as a budget for a month."""
    spent = rows.groupBy("category", "month").agg(F.sum(spent_cents()).alias("budget"))
    return spent.select("category", F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "yyyy-MM").alias("month"), "budget")


def budget_against_actual(rows: DataFrame, budgets: DataFrame, first: str, last: str) -> DataFrame:
    """(category, month, budget, actual, remaining, n, within) of each month between two, spent or not; only where there is a
    budget or a booking. At most 120 months."""
    months = rows.sparkSession.sql("SELECT explode(slice(sequence(to_date(:a), to_date(:b), interval 1 month), 1, 120)) AS day", args={"a": first + "-01", "b": last + "-01"})
    categories = rows.select("category").distinct()
    spine = categories.crossJoin(F.broadcast(months)).select("category", F.date_format("day", "yyyy-MM").alias("month"))
    actual = rows.groupBy("category", "month").agg(F.sum(spent_cents()).alias("actual"), F.count("*").alias("n"))
    found = spine.join(budgets, ["category", "month"], "left").join(actual, ["category", "month"], "left").where("budget is not null or n > 0")
    spent, allowed = F.coalesce("actual", F.lit(0)), F.coalesce("budget", F.lit(0))
    return found.select("category", "month", "budget", spent.alias("actual"), (allowed - spent).alias("remaining"), F.coalesce("n", F.lit(0)).alias("n"), (spent <= allowed).alias("within"))


def recurring(rows: DataFrame) -> DataFrame:
    """Expenses by currency and counterparty, with the share of all months in which they occur, and how steady they are."""
    rows = rows.where("amount_cents < 0")
    groups = rows.groupBy("currency", "counterparty").agg(
        F.count("*").alias("n"), F.countDistinct("month").alias("months"), F.sum(spent_cents()).alias("total"), F.avg(spent_cents()).alias("mean"), F.stddev_pop(spent_cents()).alias("sd")
    )
    groups = groups.join(F.broadcast(rows.agg(F.countDistinct("month").alias("all_months"))), F.lit(True))
    steady = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.col("sd") / F.col("mean")))
    return groups.select("currency", "counterparty", "n", "months", "total", (F.col("months") / F.col("all_months")).alias("coverage"), steady.alias("stability"))


def cost_structure(rows: DataFrame, coverage: float = 0.6, stability: float = 0.8) -> DataFrame:
    """Fixed and variable costs of each currency, and their shares."""
    groups = recurring(rows).withColumn("fixed", (F.col("coverage") >= coverage) & (F.col("stability") >= stability))
    sums = groups.groupBy("currency").agg(F.sum(F.when(F.col("fixed"), F.col("total")).otherwise(0)).alias("fixed"), F.sum("total").alias("total"))
    return sums.select("currency", "fixed", (F.col("total") - F.col("fixed")).alias("variable"), F.round(F.col("fixed") / F.col("total"), 6).alias("fixed_share"))


def cost_drivers(rows: DataFrame, top: int = 10) -> DataFrame:
    """The counterparties of most expense in each currency."""
    rank = F.row_number().over(Window.partitionBy("currency").orderBy(F.desc("total"), "counterparty"))
    return recurring(rows).withColumn("rank", rank).where(F.col("rank") <= top).select("currency", "counterparty", "total", "rank")


def recurring_pairs(rows: DataFrame, least: int = 3, fixed_only: bool = False) -> DataFrame:
    """(currency, counterparty, n, amounts) with so many expenses, if wanted of one amount only."""
    groups = rows.where("amount_cents < 0").groupBy("currency", "counterparty").agg(F.count("*").alias("n"), F.countDistinct("amount_cents").alias("amounts"))
    return groups.where((F.col("n") >= least) & ((F.col("amounts") == 1) | F.lit(not fixed_only)))


def savings_potential(rows: DataFrame, top: int = 5, share: float = 0.1) -> DataFrame:
    """The categories of most expense in each currency, and what a share of that is."""
    sums = rows.groupBy("currency", "category").agg(F.sum(spent_cents()).alias("expense"))
    rank = F.row_number().over(Window.partitionBy("currency").orderBy(F.desc("expense"), "category"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("potential", F.floor(F.col("expense") * share).cast("long"))


def currencies(rows: DataFrame) -> DataFrame:
    return rows.select("currency").distinct().orderBy("currency")


def apply_rules(rows: DataFrame, by_iban: DataFrame, by_name: DataFrame) -> DataFrame:
    """(tx_id, category): by the rule for the IBAN, else for the counterparty's normal name. Both have one row a key."""
    found = rows.select("tx_id", "iban", normal_name(F.col("counterparty")).alias("name"))
    found = found.join(by_iban.select("iban", F.col("category").alias("first")), "iban", "left")
    found = found.join(by_name.select(F.col("name"), F.col("category").alias("second")), "name", "left")
    return found.select("tx_id", F.coalesce("first", "second").alias("category")).where("category is not null")


def anomalies(rows: DataFrame, least: float = 2.0) -> DataFrame:
    """Months whose expense is so many deviations from the mean of its currency, of at least three months."""
    each = Window.partitionBy("currency")
    months = rows.where("amount_cents < 0").groupBy("currency", "month").agg(F.sum(spent_cents()).alias("spent"))
    months = months.withColumns({"mean": F.avg("spent").over(each), "sd": F.stddev_pop("spent").over(each), "k": F.count("*").over(each)})
    z = F.round((F.col("spent") - F.col("mean")) / F.col("sd"), 6)
    return months.where("k >= 3 and sd > 0").select("currency", "month", "spent", z.alias("z")).where(F.abs("z") >= least)


def iban_remainder(iban: Column) -> Column:
    """A number's remainder by 97, as the checksum of IBANs has it: 1 for a valid one, null for what is no IBAN."""
    plain = F.upper(F.regexp_replace(iban, r"\s", ""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    digits = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    value = F.aggregate(digits, F.lit(0), lambda r, v: ((r * F.when(v > 9, 100).otherwise(10) + v) % 97).cast("int"))
    return F.when(plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), value)


def cents(amount: Column) -> Column:
    """An amount in cents, half of one away from zero, by decimals."""
    return F.round(amount.cast("string").cast("decimal(24,8)") * 100, 0).cast("long")


def goal_progress(goals: DataFrame, contributions: DataFrame, day: str) -> DataFrame:
    """(goal_id, target, saved, percent) by a day: what was put aside for each goal, at most all of it; a goal of 0 is reached."""
    until = contributions.where(F.col("booking_date") <= day).groupBy("goal_id").agg(F.sum("cents").alias("saved"))
    saved = F.coalesce("saved", F.lit(0))
    return goals.join(until, "goal_id", "left").select("goal_id", "target", saved.alias("saved"), F.round(F.least(F.lit(100.0), F.coalesce(F.try_divide(100 * saved, F.col("target")), F.lit(100.0))), 6).alias("percent"))


def monthly_rate(contributions: DataFrame, day: str, most: int = 12) -> DataFrame:
    """(goal_id, rate): the mean of the last months, up to a day, in which something was put aside."""
    months = contributions.where(F.col("booking_date") <= day).groupBy("goal_id", F.date_format("booking_date", "yyyy-MM").alias("month")).agg(F.sum("cents").alias("cents"))
    nth = F.row_number().over(Window.partitionBy("goal_id").orderBy(F.desc("month")))
    return months.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("goal_id").agg(F.round(F.avg("cents"), 6).alias("rate"))


def goal_projection(progress: DataFrame, rates: DataFrame, day: str, horizon: int = 60) -> DataFrame:
    """(goal_id, missing, rate, months, reached): how many months at its rate each goal still takes; null beyond the horizon."""
    missing = F.greatest(F.col("target") - F.col("saved"), F.lit(0))
    months = F.when(missing == 0, 0).when(F.col("rate") > 0, F.ceil(missing / F.col("rate")))
    found = progress.join(rates, "goal_id", "left").select("goal_id", missing.alias("missing"), "rate", F.when(months <= horizon, months).cast("int").alias("months"))
    return found.withColumn("reached", F.date_format(F.add_months(F.lit(day).cast("date"), F.col("months")), "yyyy-MM"))


def goals_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each account as a goal of ten million cents, and its income as contributions."""
    own = rows.where("amount_cents > 0").select(F.col("account_id").alias("goal_id"), "booking_date", F.col("amount_cents").alias("cents"))
    return rows.select(F.col("account_id").alias("goal_id")).distinct().withColumn("target", F.lit(10_000_000).cast("long")), own


DAY = "1999-06-30"
GOALS = BOOKINGS + """, goals AS (SELECT DISTINCT account_id AS goal_id, 10000000::BIGINT AS target FROM bookings),
contributions AS (SELECT account_id AS goal_id, booking_date, amount_cents AS cents FROM bookings WHERE amount_cents > 0),
progress AS (SELECT goal_id, target, coalesce(saved, 0)::BIGINT AS saved FROM goals LEFT JOIN (SELECT goal_id, sum(cents) AS saved FROM contributions WHERE booking_date <= DATE '1999-06-30' GROUP BY 1) USING (goal_id)),
rates AS (SELECT goal_id, round(avg(cents), 6) AS rate FROM (SELECT goal_id, strftime(booking_date, '%Y-%m') AS month, sum(cents) AS cents, row_number() OVER (PARTITION BY goal_id ORDER BY strftime(booking_date, '%Y-%m') DESC) AS nth FROM contributions WHERE booking_date <= DATE '1999-06-30' GROUP BY 1, 2) WHERE nth <= 12 GROUP BY 1)"""


def _natures(spark, d):
    rows = transfer_events(spark, d).withColumnRenamed("event_id", "tx_id")
    kinds = rows.select("tx_id", F.col("user_id").alias("category_id"), F.when(F.col("event_type") == "signup", "transfer").otherwise("expense").alias("kind"), F.lit(1.0).alias("confidence"))
    return transaction_nature(rows, unique_transfers(spark, d), rows.where("event_type = 'error'"), kinds)


def _rules(spark, d):
    rows = bookings(spark, d).withColumn("iban", F.concat(F.lit("X"), F.col("account_id")))
    by_iban = table(spark, d, "supplier").select(F.concat(F.lit("X"), F.col("s_suppkey")).alias("iban"), F.lit("supplier").alias("category"))
    by_name = table(spark, d, "nation").where("n_regionkey = 1").select(normal_name(F.col("n_name")).alias("name"), F.lit("region").alias("category"))
    return apply_rules(rows, by_iban, by_name)


def _iban(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.format_string("DE%02d%010d%08d", (F.col("c_custkey") % 90 + 8).cast("int"), F.col("c_custkey") * 7919, F.col("c_nationkey") * 1000).alias("iban"))
    return rows.select("c_custkey", "iban", iban_remainder(F.col("iban")).alias("remainder"))


QUERIES = {
    "filter_bookings": lambda s, d: filter_bookings(bookings(s, d), start="1996-01-01", end="1999-12-31", needle="'*-m?d*'", most=0, limit=9999),
    "booking_signatures": lambda s, d: bookings(s, d).select("tx_id", signature().alias("signature"), normal_name(F.col("purpose")).alias("name")),
    "new_bookings": lambda s, d: new_bookings(bookings(s, d), bookings(s, d).where("booking_date < date'1998-01-01'")).select("tx_id", "account_id"),
    "transaction_nature": _natures,
    "counterparty_costs": lambda s, d: counterparty_costs(bookings(s, d), "'*_1*'"),
    "category_costs": lambda s, d: category_costs(bookings(s, d), "Machineries".removesuffix("ies") + "ys"),
    "monthly_report": lambda s, d: monthly_report(bookings(s, d)),
    "budget_against_actual": lambda s, d: budget_against_actual(bookings(s, d), budgets_of(bookings(s, d)), "1995-01", "2001-12"),
    "cost_structure": lambda s, d: cost_structure(bookings(s, d)),
    "cost_drivers": lambda s, d: cost_drivers(bookings(s, d)),
    "recurring_pairs": lambda s, d: recurring_pairs(bookings(s, d)),
    "savings_potential": lambda s, d: savings_potential(bookings(s, d)),
    "currencies": lambda s, d: currencies(bookings(s, d)),
    "apply_rules": _rules,
    "uncategorised": lambda s, d: bookings(s, d).join(_rules(s, d), "tx_id", "left_anti").select("tx_id", "counterparty"),
    "anomalies": lambda s, d: anomalies(bookings(s, d)),
    "iban_checksum": _iban,
    "money_cents": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", cents(F.col("l_extendedprice")).alias("cents")),
    "goal_progress": lambda s, d: goal_progress(*goals_of(bookings(s, d)), DAY),
    "monthly_rate": lambda s, d: monthly_rate(goals_of(bookings(s, d))[1], DAY),
    "goal_projection": lambda s, d: goal_projection(goal_progress(*goals_of(bookings(s, d)), DAY), monthly_rate(goals_of(bookings(s, d))[1], DAY), DAY),
}
_SUMS = "sum(greatest(amount_cents, 0))::BIGINT AS income, sum(greatest(-amount_cents, 0))::BIGINT AS expense, count(*) AS n"
_NET = "sum(greatest(-amount_cents, 0))::BIGINT AS expense, sum(greatest(amount_cents, 0))::BIGINT AS refund, sum(amount_cents)::BIGINT AS net, count(*) AS n"
_SIGN = "sha256(concat_ws(chr(31), account_id, booking_date, amount_cents, lower(counterparty), lower(purpose)))"
_RULES = BOOKINGS + """, found AS (SELECT tx_id, coalesce(CASE WHEN account_id IN (SELECT s_suppkey FROM supplier) THEN 'supplier' END, CASE WHEN counterparty IN (SELECT n_name FROM nation WHERE n_regionkey = 1) THEN 'region' END) AS category FROM bookings)"""
_RECURRING = BOOKINGS + """, groups AS (SELECT currency, counterparty, count(*) AS n, sum(-amount_cents)::BIGINT AS total, count(DISTINCT month) / (SELECT count(DISTINCT month) FROM bookings WHERE amount_cents < 0) AS coverage,
 greatest(0, 1 - least(1, stddev_pop(-amount_cents) / avg(-amount_cents))) AS stability FROM bookings WHERE amount_cents < 0 GROUP BY 1, 2)"""
ORACLE_SQL = {
    "filter_bookings": f"{BOOKINGS} SELECT * FROM bookings WHERE booking_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND amount_cents <= 0 AND (counterparty ILIKE '%-m_d%' OR purpose ILIKE '%-m_d%' OR category ILIKE '%-m_d%') ORDER BY booking_date DESC, tx_id DESC LIMIT 500",
    "booking_signatures": f"{BOOKINGS} SELECT tx_id, {_SIGN} AS signature, lower(trim(purpose)) AS name FROM bookings",
    "new_bookings": f"{BOOKINGS} SELECT min(tx_id) AS tx_id, any_value(account_id) AS account_id FROM bookings GROUP BY account_id, booking_date, amount_cents, lower(counterparty), lower(purpose) HAVING min(booking_date) >= DATE '1998-01-01'",
    "transaction_nature": UNIQUE_SQL + " SELECT event_id AS tx_id, CASE WHEN event_id IN (SELECT out_id FROM uniq UNION SELECT in_id FROM uniq) OR event_type IN ('error', 'signup') THEN 'internal_transfer' ELSE 'ordinary' END AS nature FROM ev",
    "counterparty_costs": f"{BOOKINGS} SELECT currency, {_NET}, grouping(currency)::INT AS level FROM bookings WHERE counterparty ILIKE '%_1%' GROUP BY ROLLUP (currency)",
    "category_costs": f"{BOOKINGS} SELECT category, currency, {_NET} FROM bookings WHERE category = 'MACHINERY' GROUP BY 1, 2",
    "monthly_report": f"{BOOKINGS} SELECT month, currency, 'total' AS part, '' AS name, {_SUMS}, 1 AS rank FROM bookings GROUP BY 1, 2 UNION ALL SELECT month, currency, 'category', category, {_SUMS}, 1 FROM bookings GROUP BY 1, 2, category UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY month, currency ORDER BY expense DESC, name)::INT AS rank FROM (SELECT month, currency, 'counterparty' AS part, counterparty AS name, {_SUMS} FROM bookings GROUP BY 1, 2, 4) WHERE expense > 0) WHERE rank <= 10",
    "budget_against_actual": f"{BOOKINGS}, a AS (SELECT category, month, sum(greatest(-amount_cents, 0))::BIGINT AS actual, count(*) AS n FROM bookings GROUP BY 1, 2), b AS (SELECT category, strftime((month || '-01')::DATE + INTERVAL 1 MONTH, '%Y-%m') AS month, actual AS budget FROM a), s AS (SELECT category, strftime(day, '%Y-%m') AS month FROM (SELECT DISTINCT category FROM bookings), (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS day)) SELECT category, month, budget, coalesce(actual, 0) AS actual, coalesce(budget, 0) - coalesce(actual, 0) AS remaining, coalesce(n, 0) AS n, coalesce(actual, 0) <= coalesce(budget, 0) AS within FROM s LEFT JOIN b USING (category, month) LEFT JOIN a USING (category, month) WHERE budget IS NOT NULL OR n > 0",
    "cost_structure": f"{_RECURRING} SELECT currency, sum(CASE WHEN coverage >= 0.6 AND stability >= 0.8 THEN total ELSE 0 END)::BIGINT AS fixed, sum(CASE WHEN coverage >= 0.6 AND stability >= 0.8 THEN 0 ELSE total END)::BIGINT AS variable, round(sum(CASE WHEN coverage >= 0.6 AND stability >= 0.8 THEN total ELSE 0 END) / sum(total), 6) AS fixed_share FROM groups GROUP BY 1",
    "cost_drivers": f"{_RECURRING} SELECT * FROM (SELECT currency, counterparty, total, row_number() OVER (PARTITION BY currency ORDER BY total DESC, counterparty)::INT AS rank FROM groups) WHERE rank <= 10",
    "recurring_pairs": f"{BOOKINGS} SELECT currency, counterparty, count(*) AS n, count(DISTINCT amount_cents) AS amounts FROM bookings WHERE amount_cents < 0 GROUP BY 1, 2 HAVING count(*) >= 3",
    "savings_potential": f"{BOOKINGS} SELECT *, floor(expense * 0.1::DOUBLE)::BIGINT AS potential FROM (SELECT *, row_number() OVER (PARTITION BY currency ORDER BY expense DESC, category)::INT AS rank FROM (SELECT currency, category, sum(greatest(-amount_cents, 0))::BIGINT AS expense FROM bookings GROUP BY 1, 2)) WHERE rank <= 5",
    "currencies": f"{BOOKINGS} SELECT DISTINCT currency FROM bookings ORDER BY 1",
    "apply_rules": f"{_RULES} SELECT * FROM found WHERE category IS NOT NULL",
    "uncategorised": f"{_RULES} SELECT tx_id, counterparty FROM bookings WHERE tx_id NOT IN (SELECT tx_id FROM found WHERE category IS NOT NULL)",
    "anomalies": f"{BOOKINGS} SELECT currency, month, spent, round(z, 6) AS z FROM (SELECT *, (spent - avg(spent) OVER w) / stddev_pop(spent) OVER w AS z, count(*) OVER w AS k FROM (SELECT currency, month, sum(-amount_cents)::BIGINT AS spent FROM bookings WHERE amount_cents < 0 GROUP BY 1, 2) WINDOW w AS (PARTITION BY currency)) WHERE k >= 3 AND abs(round(z, 6)) >= 2",
    "iban_checksum": "SELECT c_custkey, iban, (((substr(iban, 5) || '1314' || substr(iban, 3, 2))::HUGEINT) % 97)::INT AS remainder FROM (SELECT c_custkey, printf('DE%02d%010d%08d', c_custkey % 90 + 8, c_custkey * 7919, c_nationkey * 1000) AS iban FROM customer)",
    "money_cents": "SELECT l_orderkey, l_linenumber, round(l_extendedprice::VARCHAR::DECIMAL(24, 8) * 100, 0)::BIGINT AS cents FROM lineitem",
    "goal_progress": f"{GOALS} SELECT goal_id, target, saved, round(least(100, 100 * saved / target), 6)::DOUBLE AS percent FROM progress",
    "monthly_rate": f"{GOALS} SELECT * FROM rates",
    "goal_projection": f"{GOALS}, m AS (SELECT goal_id, greatest(target - saved, 0) AS missing, rate, CASE WHEN target <= saved THEN 0 WHEN rate > 0 THEN ceil((target - saved) / rate) END AS months FROM progress LEFT JOIN rates USING (goal_id)) SELECT goal_id, missing, rate, k AS months, strftime(DATE '1999-06-30' + to_months(k), '%Y-%m') AS reached FROM (SELECT *, CASE WHEN months <= 60 THEN months END::INT AS k FROM m)",
}
