"""Operator 9: conversations ordered by replies, from quotations, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.chunks import checkpointed, own_columns

MARKS = r"^(?:[ \t]*>)+"
#: Lines that announce a quotation, dropped where one follows.
ATTRIBUTION = r"(?:wrote|schrieb|écrit|escribió)[^:\n]{0,80}:[ \t]*$"
RESULT = ("body", "n_quotes", "n_linked", "max_level", "parent_turn", "thread_turn")


def normal(text: Column) -> Column:
    """Lower case, white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def hashed(text: Column) -> Column:
    return F.md5(normal(text))


def words(text: Column) -> Column:
    """A hash of each word of the normal form."""
    return F.transform(F.filter(F.split(normal(text), " "), lambda word: word != ""), lambda word: F.xxhash64(word))


def _body(lines: str) -> Column:
    """Lines outside quotations, without those that announce one."""
    quoted = lambda line: F.coalesce(line, F.lit("")).rlike(MARKS)
    kept = F.filter(
        lines,
        lambda line, i: ~quoted(line) & ~(line.rlike(ATTRIBUTION) & quoted(F.try_element_at(F.col(lines), i + 2))),
    )
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, first, hash, n, key): each run of lines quoted equally deep, where it begins, the hash of
    its text, how many words it has and the hash of these."""
    lines = messages.where(F.col("text").rlike("(?m)" + MARKS)).select("conv_id", "turn", F.posexplode("lines").alias("at", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    lines = lines.select("conv_id", "turn", "at", F.length(F.regexp_replace(marks, r"[ \t]", "")).alias("level"), F.regexp_replace("line", MARKS, "").alias("line"))
    # Runs of equal level: a message is one row before the explode, so its lines are few enough for one window.
    same = Window.partitionBy("conv_id", "turn", "level").orderBy("at")
    runs = lines.where("level > 0").withColumn("run", F.col("at") - F.row_number().over(same))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), " ")
    found = runs.groupBy("conv_id", "turn", "level", "run").agg(F.min("at").alias("first"), text.alias("said")).withColumn("words", words(F.col("said")))
    return found.select("conv_id", "turn", "level", "first", hashed(F.col("said")).alias("hash"), F.size("words").alias("n"), F.xxhash64("words").alias("key"))


def in_a_row(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv_id, n, key, within): the first message whose body has n words of this key in a row, for each n that a
    wanted passage of the conversation has. One row for each run of words, never one for each pair of messages."""
    lengths = wanted.where("n > 0").groupBy("conv_id").agg(F.collect_set("n").alias("lengths"))
    said = messages.where("body <> ''").select("conv_id", "turn", words(F.col("body")).alias("words")).join(lengths, "conv_id")
    said = said.select("conv_id", "turn", "words", F.explode(F.filter("lengths", lambda n: n <= F.size("words"))).alias("n"))
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.xxhash64(F.slice("words", i, F.col("n"))))
    return said.select("conv_id", "turn", "n", F.explode(runs).alias("key")).groupBy("conv_id", "n", "key").agg(F.min("turn").alias("within"))


def link_quotations(conversations: DataFrame) -> DataFrame:
    """Messages without their quotations, linked to what they quote.

    Parses nested levels of ">", hashes each quoted passage in normal form, and joins it to the first message of the
    same conversation whose body, or one line of it, reads so, if that came before; else to the first earlier one whose
    body has its words in a row (some of its lines, part of a line, wrapped or not). Returns the messages' columns
    with body (text outside quotations), n_quotes, n_linked, max_level, parent_turn (what the least deep, first
    linked passage quotes) and thread_turn (where the chain of parents begins; a message without a parent begins its
    own), partitioned and sorted by conv_id, thread_turn, turn: each thread from its beginning, replies after what
    they quote. Columns of these names in the input are replaced. Null text has an empty body and no quotations;
    messages with a null conv_id or turn are never linked; of messages that share both, each gets the links of all. An empty
    table gives an empty one.
    """
    text = F.col("text").cast("string")
    messages = conversations.select(own_columns(conversations, *RESULT), "conv_id", "turn", text.alias("text"), F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"))
    messages = messages.withColumn("body", _body("lines"))
    quotes = checkpointed(passages(messages.select("conv_id", "turn", "text", "lines")))
    said = messages.where("body <> ''").select(
        "conv_id", "turn", F.explode(F.array_distinct(F.concat(F.array("body"), F.split("body", "\n")))).alias("said")
    )
    said = said.where(normal(F.col("said")) != "").groupBy("conv_id", hashed(F.col("said")).alias("hash")).agg(F.min("turn").alias("origin"))
    earlier = lambda c: F.when(F.col(c) < F.col("turn"), F.col(c))
    linked = checkpointed(quotes.join(said, ["conv_id", "hash"], "left").withColumn("origin", earlier("origin")))
    partial = linked.where("origin is null and n > 0")
    if not partial.isEmpty():
        linked = linked.join(in_a_row(messages, partial), ["conv_id", "n", "key"], "left").withColumn("origin", F.coalesce("origin", earlier("within")))
    counted = linked.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quotes"),
        F.count("origin").alias("n_linked"),
        F.max("level").alias("max_level"),
        F.min(F.when(F.col("origin").isNotNull(), F.struct("level", "first", "origin")))["origin"].alias("parent_turn"),
    )
    counted = checkpointed(counted)
    roots = _roots(counted.where("parent_turn is not null").select("conv_id", "turn", F.col("parent_turn").alias("up")))
    out = messages.select("own", "conv_id", "turn", "body").join(counted, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    out = out.select(
        "own",
        "body",
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.coalesce("max_level", F.lit(0)).alias("max_level"),
        "parent_turn",
        F.coalesce("up", "turn").alias("thread_turn"),
    ).select("own.*", *RESULT)
    return out.repartitionByRange("conv_id", "thread_turn", "turn").sortWithinPartitions("conv_id", "thread_turn", "turn")


def _roots(links: DataFrame) -> DataFrame:
    """Each linked message with the beginning of its chain: every round doubles how far ``up`` reaches."""
    links = checkpointed(links)
    while True:
        further = links.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("beyond"))
        moved = checkpointed(links.join(further, ["conv_id", "up"], "left"))
        if moved.where("beyond is not null").isEmpty():
            return links
        links = moved.select("conv_id", "turn", F.coalesce("beyond", "up").alias("up"))


def op9_quotation(spark, sf_dir: str) -> DataFrame:
    found = link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return found.withColumn("body_sha256", F.sha2("body", 256)).drop("text", "body")


OP9_SQL = r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM conversations),
marked AS (
  SELECT *, regexp_matches(line, '^(?:[ \t]*>)+') AS quoted,
         length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[ \t]', '', 'g')) AS level,
         regexp_replace(line, '^(?:[ \t]*>)+', '') AS rest
  FROM lines),
bodies AS (
  SELECT conv_id, turn, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (
           NOT quoted AND NOT (announces AND coalesce(next_quoted, false))), ''), '^\s+|\s+$', '', 'g') AS body
  FROM (SELECT *, regexp_matches(line, '(?:wrote|schrieb|écrit|escribió)[^:\n]{0,80}:[ \t]*$') AS announces,
               lead(quoted) OVER (PARTITION BY conv_id, turn ORDER BY place) AS next_quoted FROM marked)
  GROUP BY 1, 2),
runs AS (
  SELECT *, place - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY place) AS run FROM marked WHERE level > 0),
quotes AS (
  SELECT conv_id, turn, level, min(place) AS first,
         md5(trim(regexp_replace(lower(string_agg(rest, ' ' ORDER BY place)), '\s+', ' ', 'g'))) AS hash
  FROM runs GROUP BY conv_id, turn, level, run),
said AS (
  SELECT conv_id, turn, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS t FROM (
    SELECT conv_id, turn, body AS t FROM bodies
    UNION ALL SELECT conv_id, turn, unnest(string_split(body, chr(10))) FROM bodies)),
origins AS (SELECT conv_id, md5(t) AS hash, min(turn) AS origin FROM said WHERE t <> '' GROUP BY 1, 2),
linked AS (
  SELECT q.*, CASE WHEN o.origin < q.turn THEN o.origin END AS origin
  FROM quotes q LEFT JOIN origins o USING (conv_id, hash)),
counted AS (
  SELECT conv_id, turn, count(*) AS n_quotes, count(origin) AS n_linked, max(level) AS max_level,
         arg_min(origin, level * 1000000000 + first) FILTER (origin IS NOT NULL) AS parent_turn
  FROM linked GROUP BY 1, 2),
chain AS (
  SELECT conv_id, turn, parent_turn AS up FROM counted WHERE parent_turn IS NOT NULL
  UNION SELECT c.conv_id, c.turn, p.parent_turn FROM chain c JOIN counted p
  ON p.conv_id = c.conv_id AND p.turn = c.up WHERE p.parent_turn IS NOT NULL),
roots AS (SELECT conv_id, turn, min(up) AS up FROM chain GROUP BY 1, 2)
SELECT m.conv_id, m.turn, m.role, coalesce(c.n_quotes, 0)::BIGINT AS n_quotes, coalesce(c.n_linked, 0)::BIGINT AS n_linked,
       coalesce(c.max_level, 0)::INT AS max_level, c.parent_turn, coalesce(r.up, m.turn) AS thread_turn,
       sha256(b.body) AS body_sha256
FROM conversations m JOIN bodies b USING (conv_id, turn) LEFT JOIN counted c USING (conv_id, turn)
LEFT JOIN roots r USING (conv_id, turn)
"""
