"""Personal data cut out of texts once, by its resolved spans, and put back: numbered placeholders with a map, or digests, stars, nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.quality import KINDS, pii_spans
from millrace.sources.shared import checkpointed
from millrace.sources.tables import table

PLACEHOLDER = "<(?:" + "|".join(kind for kind, _, _ in KINDS) + ")_[0-9]+>"


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents whose text has, for each of its spans (doc_id, start, end, put), what is to be put there. Spans don't overlap; all
    are cut in one pass over the text, so that nothing is found in what was put."""
    ordered = F.sort_array(F.collect_list(F.struct("start", "end", "put")))
    own = spans.groupBy("doc_id").agg(ordered.alias("spans"))
    rows = docs.join(own, "doc_id", "left")
    piece = lambda text, a, b: F.substring(text, a + 1, b - a)
    grown = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], piece(F.col("text"), acc["at"], s["start"]), s["put"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))),
    )
    return rows.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(grown)).drop("spans")


def anonymised(docs: DataFrame, mode: str = "replace", salt: str = "") -> DataFrame:
    """Documents (doc_id, text; one row an id) without personal data: by the kind's placeholder (replace), nothing (redact), stars for all
    but the first character of each word (mask), or a salted digest (hash)."""
    kind, found = F.col("kind"), F.col("found")
    starred = F.array_join(F.transform(F.split(found, r"\s+"), lambda w: F.when(F.length(w) <= 1, "*").otherwise(F.concat(F.substring(w, 1, 1), F.repeat(F.lit("*"), F.length(w) - 1)))), " ")
    digest = F.substring(F.sha2(F.concat(F.lit(salt), found), 256), 1, 12)
    put = {"replace": F.concat(F.lit("<"), kind, F.lit(">")), "redact": F.lit(""), "mask": starred, "hash": F.concat(F.lit("<"), kind, F.lit(":"), digest, F.lit(">"))}[mode]
    return cut(docs, pii_spans(docs).withColumn("put", put))


def pseudonymised(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with ``<KIND_n>`` in place of personal data, and the map (doc_id, placeholder, value) back.

    In a document equal values of a kind have one number, in the order of their first places; numbers begin after any
    that the text itself has in such a form, so that what was there before is left alone when values are put back. Null texts
    stay null and have no entries. doc_id is unique; other columns stay.
    """
    text = F.coalesce("text", F.lit(""))
    own = F.transform(F.regexp_extract_all(text, F.lit(PLACEHOLDER), 0), lambda p: F.regexp_extract(p, "[0-9]+", 0).cast("decimal(38,0)"))
    taken = docs.select("doc_id", F.coalesce(F.array_max(own), F.lit(0)).cast("decimal(38,0)").alias("taken"))
    spans = checkpointed(pii_spans(docs))
    firsts = spans.groupBy("doc_id", "kind", "found").agg(F.min("start").alias("first"))
    ranked = firsts.groupBy("doc_id", "kind").agg(F.sort_array(F.collect_list(F.struct("first", "found"))).alias("values"))
    numbers = ranked.select("doc_id", "kind", F.posexplode("values").alias("nth", "value")).join(taken, "doc_id")
    named = F.concat(F.lit("<"), "kind", F.lit("_"), (F.col("taken") + F.col("nth") + 1).cast("string"), F.lit(">"))
    names = numbers.select("doc_id", "kind", F.col("value.found").alias("found"), named.alias("put"))
    replaced = cut(docs, spans.join(names, ["doc_id", "kind", "found"]).select("doc_id", "start", "end", "put"))
    return replaced, names.select("doc_id", F.col("put").alias("placeholder"), F.col("found").alias("value"))


def restored(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Documents with the values of a map (doc_id, placeholder, value) put back, all in one pass; placeholders that it doesn't have stay."""
    own = entries.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("entries"))
    hits, parts = F.regexp_extract_all("text", F.lit(PLACEHOLDER), 0), F.split("text", PLACEHOLDER)
    back = F.transform(hits, lambda h: F.coalesce(F.try_element_at(F.col("entries"), h), h))
    joined = F.array_join(F.zip_with(parts, back, lambda p, b: F.concat(p, F.coalesce(b, F.lit("")))), "")
    rows = docs.join(own, "doc_id", "left")
    return rows.withColumn("text", F.when(F.col("entries").isNull(), F.col("text")).otherwise(joined)).drop("entries")


def _round_trip(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    replaced, entries = pseudonymised(docs)
    back = restored(checkpointed(replaced), checkpointed(entries))
    return back.select("doc_id", F.md5("text").alias("restored_md5"))


def _unnamed(s, d):
    """What personal data of each kind the placeholders leave: none."""
    replaced, _ = pseudonymised(table(s, d, "documents").select("doc_id", "text"))
    found = [F.sum(F.regexp_count("text", F.lit(pattern))).alias(kind.lower()) for kind, pattern, _ in KINDS[:2]]
    return replaced.agg(F.count("*").alias("docs"), *found)


QUERIES = {
    "pseudonyms_restored": _round_trip,
    "pseudonyms_left": _unnamed,
    "pseudonym_map": lambda s, d: pseudonymised(table(s, d, "documents").select("doc_id", "text"))[1],
    "pii_hashed": lambda s, d: anonymised(table(s, d, "documents").select("doc_id", "text"), "hash", "salt").select("doc_id", F.md5("text").alias("hashed_md5")),
}
ORACLE_SQL = {
    "pseudonyms_restored": "SELECT doc_id, md5(text) AS restored_md5 FROM documents",
    "pseudonyms_left": "SELECT count(*) AS docs, 0::BIGINT AS email, 0::BIGINT AS iban FROM documents",
}
