"""Corpus rules, deduplication by fingerprint, personal data, language heuristics and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.sources.tables import table

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IBAN = r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b"
DATE = r"\b[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\b"
#: Function words by language, as padded needles.
WORDS = {
    "en": (" the ", " and ", " of ", " is "), "de": (" der ", " die ", " und ", " ist "),
    "fr": (" le ", " la ", " et ", " les "), "es": (" el ", " los ", " que ", " una "),
}


def defects(text):
    n = F.length(text)
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]"))
    return F.array_compact(
        F.array(
            F.when(n < 50, "trivial"),
            F.when(symbols * 20 > n, "symbols"),
            F.when(F.regexp_count(text, F.lit(r"https?://")) > 5, "url_dump"),
            F.when(F.lower(text).contains("cookie"), "cookie_banner"),
        )
    )


def doc_exact_dedup(spark, d):
    """The first document of each text, told by a hash of its normal form, and how many share it."""
    key = F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")))
    return table(spark, d, "documents").groupBy(key.alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def doc_language(spark, d):
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), r"[\s.,]+", " "), F.lit(" "))
    docs = table(spark, d, "documents").select("doc_id", padded.alias("t"))
    hits = [(sum((F.when(F.col("t").contains(w), 1).otherwise(0) for w in ws), F.lit(0))).alias(lang) for lang, ws in WORDS.items()]
    scored = docs.select("doc_id", *hits)
    best = F.greatest(*WORDS)
    guess = F.coalesce(*(F.when((F.col(x) == best) & (best >= 2), x) for x in WORDS), F.lit("unknown"))
    return scored.select("doc_id", guess.alias("language"), best.alias("hits"))


def pii_counts(spark, d):
    c = lambda p, n: F.regexp_count("text", F.lit(p)).alias(n)
    return table(spark, d, "documents").select("doc_id", c(EMAIL, "emails"), c(IBAN, "ibans"), c(DATE, "dates")).where("emails + ibans + dates > 0")


def pii_masked(spark, d):
    masked = F.regexp_replace(F.regexp_replace("text", EMAIL, "<EMAIL>"), IBAN, "<IBAN>")
    return table(spark, d, "documents").select("doc_id", F.md5(masked).alias("masked_md5"), (masked != F.col("text")).alias("changed"))


def url_key(url):
    """Scheme, www, fragment, query and closing slash aside."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), r"^https?://(www\.)?|[?#].*$", ""), r"/+$", "")


def url_normalize_dedup(spark, d):
    pages = table(spark, d, "pages").select(url_key(F.col("url")).alias("key"), "page_id")
    return pages.groupBy("key").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


def source_diversity(spark, d):
    """Pages by their place among those of their host, and whether that is after the second."""
    host = F.regexp_extract(url_key(F.col("url")), r"^[^/]+", 0)
    pages = table(spark, d, "pages").select("page_id", host.alias("host"))
    return pages.withColumn("nth", F.row_number().over(Window.partitionBy("host").orderBy("page_id"))).withColumn("overflow", F.col("nth") > 2)


def doc_sentences(spark, d):
    """Sentences of each document: how many, and the longest."""
    s = F.filter(F.split("text", r"[.!?]+\s+"), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("sentences"), F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0)).cast("long").alias("longest"))


QUERIES = {f.__name__: f for f in (doc_exact_dedup, doc_language, pii_counts, pii_masked, url_normalize_dedup, source_diversity, doc_sentences)}


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


_HITS = ", ".join("(" + " + ".join(f"(CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END)" for w in ws) + f") AS {lang}" for lang, ws in WORDS.items())
_NORMAL = r"regexp_replace(lower(text), '\s+', ' ', 'g')"
_KEY = r"regexp_replace(regexp_replace(lower(url), '^https?://(www\.)?|[?#].*$', '', 'g'), '/+$', '', 'g')"
ORACLE_SQL = {
    "doc_exact_dedup": f"SELECT md5(trim({_NORMAL})) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "doc_language": f"SELECT doc_id, CASE WHEN hits < 2 THEN 'unknown' {' '.join(f'WHEN {x} = hits THEN {chr(39)}{x}{chr(39)}' for x in WORDS)} END AS language, hits FROM (SELECT *, greatest({', '.join(WORDS)}) AS hits FROM (SELECT doc_id, {_HITS} FROM (SELECT doc_id, ' ' || regexp_replace(lower(text), '[\\s.,]+', ' ', 'g') || ' ' AS t FROM documents)))",
    "pii_counts": f"SELECT * FROM (SELECT doc_id, {_n(EMAIL)}::INT AS emails, {_n(IBAN)}::INT AS ibans, {_n(DATE)}::INT AS dates FROM documents) WHERE emails + ibans + dates > 0",
    "pii_masked": f"SELECT doc_id, md5(m) AS masked_md5, m <> text AS changed FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, '{EMAIL}', '<EMAIL>', 'g'), '{IBAN}', '<IBAN>', 'g') AS m FROM documents)",
    "url_normalize_dedup": f"SELECT {_KEY} AS key, min(page_id) AS page_id, count(*) AS copies FROM pages GROUP BY 1",
    "source_diversity": f"SELECT page_id, host, nth::INT AS nth, nth > 2 AS overflow FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS nth FROM (SELECT page_id, regexp_extract({_KEY}, '^[^/]+') AS host FROM pages))",
    "doc_sentences": r"SELECT doc_id, len(s)::BIGINT AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::BIGINT AS longest FROM (SELECT doc_id, list_filter(string_split_regex(text, '[.!?]+\s+'), lambda x: x <> '') AS s FROM documents)",
}
