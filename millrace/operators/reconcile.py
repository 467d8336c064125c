"""Records of two sources matched one to one in stages, each of which takes what the last has left, and what a difference costs.

A stage pairs rows of equal keys in a fixed order: the k-th of one source with the k-th of the other where all that counts is equal, or,
where words decide, the pairs of most words in common first, key by key. All of it is joins and groups by keys, so that sources
of any size are matched; rows of a key that can't be told apart are one class, whose pairs are never listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import settled
from millrace.sources.tables import table

#: The shortest word that counts, and how many must agree where amounts differ.
WORD, LEAST = r"[\p{L}\p{N}]{3,}", 2
FIELDS = ("id", "scope", "booking_date", "value_date", "amount_cents", "words")


def words_of(*columns: str) -> Column:
    """Distinct words of three letters or digits and more, in lower case, of some columns."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *columns)), F.lit(WORD), 0)))


def paired_by_number(a: DataFrame, b: DataFrame, keys: list[str], order: tuple[str, ...] = ("id",)) -> DataFrame:
    """(a_id, b_id): the k-th row of a key on one side with the k-th on the other. Null keys are equal to each other."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    key = F.struct(*keys)
    x = a.select(F.col("id").alias("a_id"), key.alias("key"), number.alias("nth"))
    y = b.select(F.col("id").alias("b_id"), key.alias("other"), number.alias("other_nth"))
    return x.join(y, F.col("key").eqNullSafe(F.col("other")) & (F.col("nth") == F.col("other_nth"))).select("a_id", "b_id")


def without(rows: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    return rows.join(pairs.select(F.col(side).alias("id")), "id", "left_anti")


def best_words(a: DataFrame, b: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(a_id, b_id): one to one, of rows of equal keys those with most words in common first (ties: least a, then least b), at least
    ``least`` of them. Rows with the same words are one class, so that a key with very many equal rows lists few pairs: a key is
    one group of classes with their ids, and the rows of a class take part in the order of these."""
    key = F.struct(*keys).alias("key")
    classes = lambda rows: rows.groupBy(key, "words").agg(F.array_sort(F.collect_list("id")).alias("ids")).groupBy("key")
    return classes(a).cogroup(classes(b)).applyInArrow(lambda x, y: _best_words(x, y, least), "a_id long, b_id long")


def _best_words(x: pa.Table, y: pa.Table, least: int) -> pa.Table:
    """The pairs of one key. From the most words in common down, each row of the one side in the order of ids takes, of the classes of
    the other that have as many with its own, the row of the least id that is left."""
    a, b = ([np.asarray(ids, dtype=np.int64) for ids in side["ids"].to_pylist()] if side.num_rows else [] for side in (x, y))
    a_ids, b_ids = [], []
    if a and b:
        held = {}
        for j, words in enumerate(y["words"].to_pylist()):
            for word in words or ():
                held.setdefault(word, []).append(j)
        common = np.zeros((len(a), len(b)), dtype=np.uint16)
        for i, words in enumerate(x["words"].to_pylist()):
            for word in words or ():
                common[i, held.get(word, [])] += 1
        end = np.iinfo(np.int64).max
        heads, at = np.array([ids[0] for ids in b]), [0] * len(b)
        for level in sorted((int(c) for c in np.unique(common) if c >= least), reverse=True):
            near = {i: np.flatnonzero(row) for i, row in enumerate(common == level) if len(a[i]) and row.any()}
            if not near:
                continue
            order = np.concatenate([a[i] for i in near])
            owner = np.repeat(list(near), [len(a[i]) for i in near])
            left = {i: [] for i in near}
            by_id = np.argsort(order, kind="stable")
            for one, i in zip(order[by_id].tolist(), owner[by_id].tolist()):
                best = near[i]
                j = int(best[heads[best].argmin()]) if len(best) else -1
                if j < 0 or heads[j] == end:
                    near[i] = best[:0]
                    left[i].append(one)
                    continue
                a_ids.append(one)
                b_ids.append(int(heads[j]))
                at[j] += 1
                heads[j] = b[j][at[j]] if at[j] < len(b[j]) else end
            for i, ids in left.items():
                a[i] = np.asarray(ids, dtype=np.int64)
    return pa.table({"a_id": pa.array(a_ids, pa.int64()), "b_id": pa.array(b_ids, pa.int64())})


def reconciled(truth: DataFrame, stored: DataFrame, least: int = LEAST) -> DataFrame:
    """(scope, truth_id, stored_id, outcome) of every row of both sides: (id, scope, booking_date, value_date, amount_cents, words).

    Only rows of one scope (say a statement) match, one to one, in stages: equal dates and amount (matched); equal booking date and
    amount, those of most words in common first (matched_by_words); equal booking date and at least ``least`` words in common
    (sign_flip where the amounts are opposite, else wrong_amount). What is left is missing from the stored side, or extra
    there. Ties go to the least ids; null fields are equal to each other; an empty side leaves the other missing or extra.
    """
    a, b = (settled(rows.select(*FIELDS)) for rows in (truth, stored))
    exact = settled(paired_by_number(a, b, ["scope", "booking_date", "value_date", "amount_cents"]))
    a2, b2 = settled(without(a, exact, "a_id")), settled(without(b, exact, "b_id"))
    by_amount = settled(best_words(a2, b2, ["scope", "booking_date", "amount_cents"], 0))
    a3, b3 = settled(without(a2, by_amount, "a_id")), settled(without(b2, by_amount, "b_id"))
    by_words = settled(best_words(a3, b3, ["scope", "booking_date"], least))
    amount = lambda rows, c: rows.select(F.col("id").alias(f"{c}_id"), F.col("amount_cents").alias(c))
    wrong = by_words.join(amount(a3, "a"), "a_id").join(amount(b3, "b"), "b_id")
    wrong = wrong.select("a_id", "b_id", F.when(F.col("b") == -F.col("a"), "sign_flip").otherwise("wrong_amount").alias("outcome"))
    pairs = exact.withColumn("outcome", F.lit("matched")).unionByName(by_amount.withColumn("outcome", F.lit("matched_by_words"))).unionByName(wrong)
    found = pairs.join(a.select(F.col("id").alias("a_id"), "scope"), "a_id").select("scope", F.col("a_id").alias("truth_id"), F.col("b_id").alias("stored_id"), "outcome")
    none = F.lit(None).cast("long")
    missing = without(a3, by_words, "a_id").select("scope", F.col("id").alias("truth_id"), none.alias("stored_id"), F.lit("missing").alias("outcome"))
    extra = without(b3, by_words, "b_id").select("scope", none.alias("truth_id"), F.col("id").alias("stored_id"), F.lit("extra").alias("outcome"))
    return found.unionByName(missing).unionByName(extra)


def repairs(outcomes: DataFrame, truth: DataFrame, stored: DataFrame) -> DataFrame:
    """(operation, truth_id, stored_id, old_cents, new_cents): what makes the stored side true: updates, deletions and insertions."""
    old, new = stored.select(F.col("id").alias("stored_id"), F.col("amount_cents").alias("old_cents")), truth.select(F.col("id").alias("truth_id"), F.col("amount_cents").alias("new_cents"))
    operation = F.when(F.col("outcome") == "missing", "insert").when(F.col("outcome") == "extra", "delete").when(F.col("outcome").isin("sign_flip", "wrong_amount"), "update")
    rows = outcomes.withColumn("operation", operation).where("operation is not null").join(old, "stored_id", "left").join(new, "truth_id", "left")
    return rows.select("operation", "truth_id", "stored_id", "old_cents", "new_cents")


def _truth(s, d):
    """Orders as a statement's bookings: what should be stored."""
    rows = table(s, d, "orders")
    about = F.concat_ws(" ", F.concat(F.lit("from"), F.col("o_custkey") % 9), F.concat(F.lit("prio"), F.substring("o_orderpriority", 1, 1)), F.concat(F.lit("desk"), F.col("o_orderkey") % 6))
    day = F.to_date("o_orderdate")
    return rows.withColumn("about", about).select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("scope"), F.trunc(day, "month").alias("booking_date"), day.alias("value_date"),
        (F.floor(F.col("o_totalprice") / 50_000) * 100 + 100).cast("long").alias("amount_cents"), words_of("about").alias("words"),
    )


def _stored(s, d):
    """The same, as a careless import left it: some rows gone, doubled, dated otherwise, with the sign or the amount wrong."""
    rows = _truth(s, d).withColumn("k", F.col("id") % 23).where("k <> 0")
    amount = F.when(F.col("k") == 1, -F.col("amount_cents")).when(F.col("k") == 2, F.col("amount_cents") + 7).otherwise(F.col("amount_cents"))
    value = F.when(F.col("k") == 3, F.date_add("value_date", 1)).when(F.col("k") == 4, F.lit(None)).otherwise(F.col("value_date"))
    rows = rows.withColumns({"amount_cents": amount, "value_date": value})
    doubled = rows.where("k = 5").withColumn("id", F.col("id") + 100_000_000)
    return rows.unionByName(doubled).drop("k")


QUERIES = {
    "reconciled": lambda s, d: reconciled(_truth(s, d), _stored(s, d)),
    "repairs": lambda s, d: repairs(reconciled(_truth(s, d), _stored(s, d)), _truth(s, d), _stored(s, d)),
}
def _stage(name: str, keys: str, a: str, b: str, least: int) -> str:
    """Pairs of most words in common, one to one, taken in order by a recursion over the pairs of each key."""
    return f"""
{name}_p AS (SELECT k, x, y, row_number() OVER (PARTITION BY k ORDER BY c DESC, x, y) AS i FROM (SELECT md5(concat_ws('|', {keys.replace('@', 'a.')})) AS k, a.id AS x, b.id AS y, len(list_intersect(a.words, b.words)) AS c FROM {a} a JOIN {b} b ON {' AND '.join(f'a.{k.strip()[1:]} = b.{k.strip()[1:]}' for k in keys.split(','))}) WHERE c >= {least}),
{name}_r(k, i, xs, ys) AS (SELECT DISTINCT k, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM {name}_p UNION ALL
  SELECT k, i, CASE WHEN f THEN list_append(xs, x) ELSE xs END, CASE WHEN f THEN list_append(ys, y) ELSE ys END FROM (SELECT r.k, r.xs, r.ys, p.x, p.y, p.i, NOT (list_contains(r.xs, p.x) OR list_contains(r.ys, p.y)) AS f FROM {name}_r r JOIN {name}_p p ON p.k = r.k AND p.i = r.i + 1)),
{name} AS (SELECT unnest(xs) AS x, unnest(ys) AS y FROM (SELECT arg_max(xs, i) AS xs, arg_max(ys, i) AS ys FROM {name}_r GROUP BY k))"""


_OUT = f"""WITH RECURSIVE t AS (SELECT o_orderkey AS id, o_custkey % 40 AS scope, date_trunc('month', o_orderdate)::DATE AS day, o_orderdate::DATE AS value, floor(o_totalprice / 50000)::BIGINT * 100 + 100 AS cents, ['from' || (o_custkey % 9), 'prio' || substr(o_orderpriority, 1, 1), 'desk' || (o_orderkey % 6)] AS words FROM orders),
k AS (SELECT id, scope, day, CASE id % 23 WHEN 3 THEN value + 1 WHEN 4 THEN NULL ELSE value END AS value, CASE id % 23 WHEN 1 THEN -cents WHEN 2 THEN cents + 7 ELSE cents END AS cents, words FROM t WHERE id % 23 <> 0),
u AS (SELECT * FROM k UNION ALL SELECT id + 100000000, scope, day, value, cents, words FROM k WHERE id % 23 = 5),
tn AS (SELECT *, row_number() OVER (PARTITION BY scope, day, value, cents ORDER BY id) AS nth FROM t), un AS (SELECT *, row_number() OVER (PARTITION BY scope, day, value, cents ORDER BY id) AS nth FROM u),
one AS (SELECT tn.id AS x, un.id AS y FROM tn JOIN un ON tn.scope = un.scope AND tn.day = un.day AND tn.cents = un.cents AND tn.value IS NOT DISTINCT FROM un.value AND tn.nth = un.nth),
t2 AS (SELECT * FROM t WHERE id NOT IN (SELECT x FROM one)), u2 AS (SELECT * FROM u WHERE id NOT IN (SELECT y FROM one)),
{_stage("two", "@scope, @day, @cents", "t2", "u2", 0)},
t3 AS (SELECT * FROM t2 WHERE id NOT IN (SELECT x FROM two)), u3 AS (SELECT * FROM u2 WHERE id NOT IN (SELECT y FROM two)),
{_stage("three", "@scope, @day", "t3", "u3", 2)},
o AS (SELECT x AS truth_id, y AS stored_id, 'matched' AS outcome FROM one UNION ALL SELECT x, y, 'matched_by_words' FROM two
  UNION ALL SELECT x, y, CASE WHEN b.cents = -a.cents THEN 'sign_flip' ELSE 'wrong_amount' END FROM three JOIN t3 a ON a.id = x JOIN u3 b ON b.id = y
  UNION ALL SELECT id, NULL, 'missing' FROM t3 WHERE id NOT IN (SELECT x FROM three) UNION ALL SELECT NULL, id, 'extra' FROM u3 WHERE id NOT IN (SELECT y FROM three))"""
ORACLE_SQL = {
    "reconciled": f"{_OUT} SELECT coalesce(t.scope, u.scope) AS scope, truth_id, stored_id, outcome FROM o LEFT JOIN t ON t.id = truth_id LEFT JOIN u ON u.id = stored_id",
    "repairs": f"{_OUT} SELECT CASE outcome WHEN 'missing' THEN 'insert' WHEN 'extra' THEN 'delete' ELSE 'update' END AS operation, truth_id, stored_id, u.cents AS old_cents, t.cents AS new_cents FROM o LEFT JOIN t ON t.id = truth_id LEFT JOIN u ON u.id = stored_id WHERE outcome NOT LIKE 'matched%'",
}
