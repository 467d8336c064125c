"""Rules on texts: kinds, defects, scores, boilerplate, personal data, claims and what supports them.

Each rule is a function of a column, so that it joins any frame; the queries apply them to the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.tables import table

# Patterns, word lists, weights and thresholds that results depend on.
FORMULA = (
    r"(?i)(?:[=≈≠≤≥∑∏∫∂√∞±×÷∈∉⊂⊃∪∩∧∨¬∀∃]|\b(?:sin|cos|tan|log|ln|exp|lim|inf|sup|max|min|arg)\s*\(|\b[0-9]+\s*[+\-*/^]\s*[0-9]+"
    r"|\b[a-z]\s*=\s*[a-z0-9+\-*/^()\s]+|\$[^$]+\$|\\(?:frac|sqrt|sum|prod|int|partial|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|sigma|omega)\b)"
)
TABLE = r"(?:(?:\|[^|]+){2,}\||\t[^\t]+\t)"
#: The same rows, told apart without a step back: Java's group of open width takes a frame of the stack for each cell, and the stack's
#: end ends the executor.
TABLE_RUNS = r"(?:\|[^|]++\|(?:[^|]++\|)++|\t[^\t]++\t)"
CODE = r"(?i)(?:(?:def|class|function|return|import|from|if|else|for|while|try|except)\s|(?:public|private|static|void|int|string|bool)\s|\{[^}]*\}|(?:=>|->|::|\.\.|\.\.\.))"
DEFINITION = r"(?i)(?:\b(?:Definition|Def\.|Satz|Theorem|Lemma|Korollar|Axiom|Postulat)\s*[:0-9.]|\b(?:bezeichnet|definiert als|heißt|ist definiert|wird definiert|means|is defined as|refers to)\b)"
LEGAL = r"(?i)(?:§\s*[0-9]+|\b(?:Abs\.|Absatz|Artikel|Art\.)\s*[0-9]+|\b(?:gemäß|laut|nach Maßgabe|vorbehaltlich|unbeschadet)\b|\b(?:pursuant to|in accordance with|notwithstanding|hereinafter)\b)"
GARBAGE = r"(?:[\x00-\x08\x0B\x0C\x0E-\x1F]|â€|Ã¤|Ã¶|Ã¼|Ãœ|Â§|�)"
COOKIE = r"(?i)(?:cookie|datenschutz|privacy\s*policy|akzeptieren|accept\s*all|ablehnen|reject|einstellungen\s*speichern|save\s*preferences)"
BOILERPLATE = r"(?i)(?:cookie|privacy\s*policy|datenschutz|terms\s+of\s+service|impressum|all\s+rights\s+reserved|copyright|sign\s+in|log\s+in|menu|navigation|kontakt|contact|about\s+us|über\s+uns)"
URL = r"(?i)(?:https?://|www\.)[^\s]+"
SEPARATORS = r"(?i)(?:(?:\s[|/›>»•·]\s){2,}|(?:home|start|startseite)\s*[|/›>»•·])"
CRUMBS = r"(?i)(?:home|start|kontakt|contact|about)\s*[|•·/>]"
SENTENCE = r"[.!?]\s+[A-ZÄÖÜ]"
WORD = r"[\p{L}\p{N}_]+"
EMAIL, DAY = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", r"\b[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}\b"
IBAN = r"\b[A-Z]{2}[0-9]{2}\s?[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\s?[0-9]{0,2}\b"
PHONE = r"(?:\+49|0049|\b0)[\s\-./]?[0-9]{2,5}[\s\-./]?[0-9]{3,10}\b"
KINDS = (("EMAIL", EMAIL, 0.95), ("IBAN", IBAN, 0.95), ("PHONE", PHONE, 0.80), ("DATE", DAY, 0.70))
NOISE = ("click here", "subscribe", "advertisement", "cookie", "privacy policy", "navigation")
YES, NO = ("ja", "yes", "korrekt", "wahr", "stimmt"), ("nein", "no", "falsch", "nicht", "unmöglich")
HIGH = ("gov.", "edu.", "ac.uk", "bbc.com", "reuters.com", "nytimes.com", "wikipedia.org", "nature.com", "science.org")
MEDIUM = (".org", "guardian.com", "washingtonpost.com", "cnn.com", "bloomberg.com", "techcrunch.com")


def plain(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def letters(text: Column, pattern: str) -> Column:
    """How many characters a class of characters keeps."""
    return F.length(F.regexp_replace(text, pattern, ""))


def url_share(text: Column) -> Column:
    return F.length(F.array_join(F.regexp_extract_all(text, F.lit(URL), 0), "")) / F.greatest(F.length(text), F.lit(1))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with ``m``: all counts that kinds, defects and scores of a text are made of, each taken once. Words are a column of
    their own first, and the counts come out of a one-row generator: the optimiser puts neither a text nor a count in
    again where it is used."""
    rows = docs.withColumn("plain_text", plain(F.col(text))).withColumn("plain_words", words(F.col("plain_text")))
    t, own = F.col("plain_text"), F.col("plain_words")
    counts = {
        "n": F.length(t), "words": F.size(own), "formulas": count(t, FORMULA), "tables": count(t, TABLE_RUNS), "definitions": count(t, DEFINITION), "legal": count(t, LEGAL),
        "code": count(t, CODE), "garbage": count(t, GARBAGE), "cookies": count(t, COOKIE), "separators": count(t, SEPARATORS), "crumbs": count(t, CRUMBS),
        "sentences": count(t, SENTENCE), "boilerplate": count(t, BOILERPLATE), "urls": url_share(t), "letters": letters(t, r"[^\p{L}]"), "ends": t.rlike(r"[.!?]$"),
        "distinct": F.size(F.array_distinct(F.transform(own, F.lower))), "named": F.size(F.filter(own, lambda w: w.rlike(r"^\p{Lu}."))), "numbers": F.size(F.filter(own, lambda w: w.rlike(r"[0-9]"))),
    }
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array(F.struct(*(c.alias(n) for n, c in counts.items())))).alias("m"))


def kind_of(m: Column) -> Column:
    """formula, table, definition, legal, code or prose: the first whose signs are enough. Null and short texts are prose."""
    return (
        F.when(m["n"] < 5, "prose")
        .when((m["formulas"] >= 3) | (m["formulas"] > 0.05 * F.greatest(m["words"], F.lit(1))), "formula")
        .when(m["tables"] >= 2, "table").when((m["definitions"] >= 1) & (m["n"] < 500), "definition")
        .when(m["legal"] >= 2, "legal").when(m["code"] >= 3, "code").otherwise("prose")
    )


def flags_of(m: Column) -> Column:
    """Which hard defects a text has: trivial (alone), encoding_garbage, cookie_banner, pure_navigation, url_dump."""
    signs = F.when(m["separators"] >= 2, 2).otherwise(0) + F.when(m["crumbs"] >= 2, 2).otherwise(0)
    found = F.array(
        F.when((m["garbage"] >= 3) | ((m["garbage"] >= 1) & (m["n"] < 100)), "encoding_garbage"),
        F.when(m["cookies"] >= 3, "cookie_banner"),
        F.when((m["sentences"] == 0) & (signs >= 2), "pure_navigation"),
        F.when(m["urls"] > 0.6, "url_dump"),
    )
    return F.when(m["n"] < 15, F.array(F.lit("trivial"))).otherwise(F.array_compact(found))


def score_of(m: Column, kind: Column, flags: Column) -> Column:
    """From 1.0 less what eight signs cost, some of them for prose only; hard defects decide alone."""
    n, k = m["n"], F.greatest(m["words"], F.lit(1))
    cost = lambda *cases: _first(cases)
    share = m["letters"] / F.greatest(n, F.lit(1))
    terse, dense = kind.isin("formula", "definition", "table"), kind.isin("formula", "table", "code")
    score = 1.0 - (
        cost((terse & (n < 15), 0.2), (terse, 0.0), ((kind == "code") & (n < 20), 0.3), (kind == "code", 0.0), (n < 30, 0.4), (n < 80, 0.2), (n < 150, 0.05))
        + cost((dense & (share < 0.10), 0.15), (dense, 0.0), (share < 0.40, 0.4), (share < 0.55, 0.15))
        + cost(((kind == "prose") & (m["sentences"] == 0) & ~m["ends"] & (n > 100), 0.15))
        + cost((m["boilerplate"] >= 3, 0.5), (m["boilerplate"] >= 2, 0.3), (m["boilerplate"] >= 1, 0.15))
        + cost((m["urls"] > 0.5, 0.45), (m["urls"] > 0.3, 0.25))
        + cost((m["separators"] >= 2, 0.35))
        + cost((~kind.isin("formula", "code") & (m["distinct"] < 0.3 * k) & (k > 20), 0.2))
        + cost(((kind == "prose") & (m["named"] + m["numbers"] < 0.02 * k) & (k > 30), 0.1))
    )
    has = lambda flag: F.array_contains(flags, flag)
    return (
        F.when((n < 10) | has("trivial"), 0.0).when(has("encoding_garbage"), 0.05).when(has("cookie_banner") | has("pure_navigation"), 0.1)
        .otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))
    )


def _first(cases: tuple) -> Column:
    """The value of the first case that holds; 0 if none."""
    out = None
    for when, value in cases:
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(0.0)


def rated(docs: DataFrame, text: str = "text", least: float = 0.2) -> DataFrame:
    """Documents with content_type, flags, score and noise (too short, a defect, or a score below ``least``) of a text, from
    one pass over it. Null texts are empty: prose, trivial, 0, noise."""
    m = F.col("m")
    rows = measured(docs, text).withColumn("content_type", kind_of(m)).withColumn("flags", flags_of(m))
    rows = rows.withColumn("score", score_of(m, F.col("content_type"), F.col("flags")))
    return rows.withColumn("noise", (m["n"] < 10) | (F.size("flags") > 0) | (F.col("score") < least)).drop("m")


def boilerplate(docs: DataFrame, least_docs: int = 5, least_part: float = 0.01, least_share: float = 0.3) -> DataFrame:
    """(doc_id, fingerprint, docs): documents that begin like many others: 500 characters of the normal form, longer than 50, in at
    least five of them and one in a hundred. ``least_share`` is for corpora of one source: of all documents, or of a smaller number."""
    opening = F.trim(F.regexp_replace(F.lower(F.substring("text", 1, 500)), r"\s+", " "))
    marked = docs.select("doc_id", opening.alias("opening")).where(F.length("opening") > 50).select("doc_id", F.md5("opening").alias("fingerprint"))
    total = docs.agg(F.countDistinct("doc_id").alias("all_docs"))
    shared = marked.groupBy("fingerprint").agg(F.countDistinct("doc_id").alias("docs")).join(F.broadcast(total), F.lit(True))
    shared = shared.where(F.col("docs") >= F.greatest(F.lit(least_docs), F.col("all_docs") * least_part, F.col("all_docs") * least_share))
    return marked.join(shared.select("fingerprint", "docs"), "fingerprint").select("doc_id", "fingerprint", "docs")


def text_quality(text: Column) -> Column:
    """Length, structure, clean characters and variety of words, weighted."""
    t = F.coalesce(text, F.lit(""))
    own = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    ends, paragraphs = letters(t, r"[^.!?]"), F.size(F.split(t, "\n\n"))
    structure = F.least(F.lit(1.0), (ends / 10 + paragraphs / 3) / 2)
    clean = 1.0 - F.least(F.lit(1.0), 10 * letters(t, r"[\p{L}\p{N}_\s.,!?;:\-]") / F.greatest(F.length(t), F.lit(1)))
    variety = F.when(F.size(own) > 10, 0.2 * F.least(F.lit(1.0), 2 * F.size(F.array_distinct(own)) / F.size(own))).otherwise(0.1)
    score = 0.3 * F.least(F.lit(1.0), F.length(t) / 500) + 0.3 * structure + 0.2 * clean + variety
    return F.when(t == "", 0.0).otherwise(F.round(F.least(F.lit(1.0), score), 6))


def content_quality(text: Column, query: str | None = None) -> Column:
    """Length, depth, absence of noise, and how many words of a query occur, weighted."""
    t = F.coalesce(text, F.lit(""))
    n, low = F.length(t), F.lower(t)
    size = F.when(n > 2000, 1.0).when(n > 500, 0.8).when(n > 200, 0.6).when(n > 100, 0.4).otherwise(0.2)
    depth = F.least(F.lit(1.0), letters(t, r"[^.!?]") * 0.1 + F.size(F.split(t, "\n\n")) * 0.2)
    noise = F.greatest(F.lit(0.0), 1.0 - 0.2 * sum((F.when(low.contains(w), 1).otherwise(0) for w in NOISE), F.lit(0)))
    asked = (query or "").lower().split()
    fits = F.lit(0.5) if not asked else sum((F.when(low.contains(w), 1).otherwise(0) for w in asked), F.lit(0)) / len(asked)
    return F.when(t == "", 0.0).otherwise(F.round(F.least(F.lit(1.0), 0.3 * size + 0.3 * depth + 0.2 * noise + 0.2 * fits), 6))


def _spans(kind: str, pattern: str, score: float) -> Column:
    """The hits of a pattern in column ``text``: each begins where the parts that hits cut the text into, and the hits before it, end."""
    hits, parts = F.regexp_extract_all("text", F.lit(pattern), 0), F.split("text", pattern)
    length = lambda found, n: F.aggregate(F.slice(found, F.lit(1), n), F.lit(0), lambda s, p: s + F.length(p))

    def span(hit: Column, i: Column) -> Column:
        start = length(parts, i + 1) + length(hits, i)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), F.lit(score).alias("score"), hit.alias("found"))

    return F.transform(hits, span)


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, score, found): personal data of texts; of two that overlap the one of higher score, then the one
    that begins first, stays. Places count characters from 0."""
    each = [_spans(*kind) for kind in KINDS]
    spans = docs.where("text is not null").select("doc_id", F.explode(F.concat(*each)).alias("s")).select("doc_id", "s.*")
    others = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "score", "kind")).alias("all_spans"))
    beats = lambda o: (o["start"] < F.col("end")) & (o["end"] > F.col("start")) & ((o["score"] > F.col("score")) | ((o["score"] == F.col("score")) & (F.struct(o["start"], o["kind"]) < F.struct("start", "kind"))))
    return spans.join(others, "doc_id").where(~F.exists("all_spans", beats)).drop("all_spans")


def anonymised(text: Column, mode: str = "replace") -> Column:
    """A text without personal data, kind after kind: by placeholders (replace), nothing (redact), stars (mask). For resolved spans,
    digests and numbered placeholders see ``pseudonyms``."""
    for kind, pattern, _ in KINDS:
        text = F.regexp_replace(text, pattern, {"replace": f"<{kind}>", "redact": "", "mask": "****"}[mode])
    return text


def claims(docs: DataFrame) -> DataFrame:
    """(doc_id, nth, claim): sentences of at least 15 characters; long ones are parted at conjunctions, parts under 16 are left out."""
    sentences = F.filter(F.split(F.trim("text"), r"[.!?]+\s+"), lambda s: F.length(s) >= 15)
    parts = F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) <= 100, F.array(s)).otherwise(F.filter(F.split(s, r",? (?:und|sowie|aber|jedoch|während|and|but|while) "), lambda p: F.length(p) > 15))))
    return docs.select("doc_id", F.posexplode(parts).alias("nth", "claim"))


def terms(text: Column, least: int = 3) -> Column:
    """Distinct words of so many characters, in lower case."""
    return F.array_distinct(F.filter(words(F.lower(F.coalesce(text, F.lit("")))), lambda w: F.length(w) >= least))


def grounded(subject: Column, other: Column, text: Column) -> Column:
    """Whether a word of either side of a statement occurs in a text; a side without words is no objection."""
    low = F.lower(F.coalesce(text, F.lit("")))
    one = lambda side: (F.size(terms(side)) == 0) | F.exists(terms(side), lambda w: low.contains(w))
    return one(subject) & one(other)


def authority(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    any_of = lambda names: F.greatest(*(low.contains(n) for n in names))
    return F.when(any_of(HIGH), 0.15).when(any_of(MEDIUM), 0.08).otherwise(0.0)


def contradictions(pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, kind) of pairs of texts (a_id, a_text, b_id, b_text): numbers among the first three that are a fifth apart, or one
    says yes where the other says no."""
    numbers = lambda c: F.slice(F.transform(F.regexp_extract_all(c, F.lit("[0-9]+(?:\\.[0-9]+)?"), 0), lambda x: x.cast("double")), 1, 3)
    says = lambda c, names: F.size(F.array_intersect(words(F.lower(c)), F.array(*map(F.lit, names)))) > 0
    differ = F.exists(numbers("a_text"), lambda x: F.exists(numbers("b_text"), lambda y: (x > 0) & (F.abs(x - y) > 0.2 * x)))
    opposed = (says("a_text", YES) & says("b_text", NO)) | (says("a_text", NO) & says("b_text", YES))
    kind = F.when(differ, "numerical").when(opposed, "factual")
    return pairs.select("a_id", "b_id", kind.alias("kind")).where("kind is not null")


def snippet(text: Column, needle: str, before: int = 500, after: int = 1500, most: int = 8000) -> Column:
    """What surrounds the first place of a needle, with an ellipsis where it is cut; without one, the beginning."""
    t = F.coalesce(text, F.lit(""))
    at = F.locate(needle.lower(), F.lower(t))
    first = F.greatest(at - before, F.lit(1))
    last = F.least(at + len(needle) - 1 + after, F.length(t))
    around = F.concat(F.when(first > 1, "...").otherwise(""), F.substring(t, first, last - first + 1), F.when(last < F.length(t), "...").otherwise(""))
    return F.when(at > 0, around).otherwise(F.substring(t, 1, most))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(F.array_union(a, b)) > 0, both / F.size(F.array_union(a, b))).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def bigrams(tokens: Column) -> Column:
    """Neighbouring words of an array, joined by a space."""
    return F.when(F.size(tokens) > 1, F.zip_with(F.slice(tokens, F.lit(1), F.size(tokens) - 1), F.slice(tokens, F.lit(2), F.size(tokens) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def token_estimate(text: Column, per_token: float = 4.0) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / per_token).cast("long")


def audit(docs: DataFrame) -> DataFrame:
    """One row of figures on a corpus: documents, mean score, how many have each defect, are noise, or repeat another."""
    rows = rated(docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest")))
    flags = [F.count_if(F.array_contains("flags", f)).alias(f) for f in ("trivial", "encoding_garbage", "cookie_banner", "pure_navigation", "url_dump")]
    return rows.agg(F.count("*").alias("docs"), F.round(F.avg("score"), 6).alias("mean_score"), *flags, F.count_if("noise").alias("noise"), (F.count("*") - F.countDistinct("digest")).alias("repeats"))


#: What the queries put before a text, by doc_id, so that every kind, defect and cost occurs; without a text where ``alone``.
MARKS = (
    ("f(x) = sin(x) + 2 * x; y = 3 + 4; z = 5", True), ("|a|b|c| and |d|e|f| with |g|h|i|", True), ("Definition: a lemma refers to a thing that is small", True),
    ("pursuant to Art. 5 and in accordance with Art. 6 ", False), ("def f(x): return {x} import y; class A -> B :: c ", False), ("â€ Ã¤ Ã¶ broken ", False), ("Ã¼ alone", True),
    ("We use cookies. Accept all? Reject? Privacy policy. ", False), ("Home | Start | Kontakt | About | Menu | Contact", True), ("https://a.example/x https://b.example/y", True),
    ("https://a.example/x/long/way/to/go is where it stands, as told here", True), ("tiny", True), ("a bit more than tiny", True), ("12345 67890 ------ 4321 ++++ 999 8 7 6 5 4", True),
    ("all rights reserved ", False), ("contact and copyright ", False), ("sign in, log in or contact ", False), ("one two " * 30, True), ("no sentence in lower case but many words " * 4, True),
    ("a / b / c / d and on. And so forth ", False),
)
EVERY = 60
#: What one in three documents begins with, where boilerplate is looked for: more characters than are compared.
OPENING = "This page is served by a shared host and says so at great length. " * 8


def marked(docs: DataFrame) -> DataFrame:
    """Whole documents, one in three of them with a mark."""
    text = F.coalesce("text", F.lit(""))
    out = text
    for i, (mark, alone) in enumerate(MARKS):
        out = F.when(F.col("doc_id") % EVERY == i, F.lit(mark) if alone else F.concat(F.lit(mark), text)).otherwise(out)
    return docs.select("doc_id", out.alias("text"))


def _docs(s, d):
    return table(s, d, "documents")


def _dealt(s, d):
    """Documents over all cores: a table of a single file is one task, and the rules take far longer than to deal its rows out. A
    table that is read in as many partitions as there are cores, as any large one, stays as it is."""
    docs, cores = _docs(s, d).select("doc_id", "text"), s.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def _each(name: str, rule):
    return lambda s, d: _docs(s, d).select("doc_id", rule(F.col("text")).alias(name))


def _bench_pairs(s, d):
    items = table(s, d, "benchmark")
    a, b = items.select(F.col("item_id").alias("a_id"), F.col("text").alias("a_text")), items.select((F.col("item_id") - 1).alias("a_id"), F.col("item_id").alias("b_id"), F.col("text").alias("b_text"))
    return a.join(b, "a_id")


QUERIES = {
    "content_types": lambda s, d: rated(marked(_dealt(s, d))).select("doc_id", "content_type"),
    "defect_flags": lambda s, d: rated(marked(_dealt(s, d))).select("doc_id", F.array_join("flags", ",").alias("flags")),
    "structural_scores": lambda s, d: rated(marked(_dealt(s, d))).select("doc_id", "score"),
    "noise_gate": lambda s, d: rated(marked(_dealt(s, d))).where("noise").select("doc_id"),
    "short_texts": lambda s, d: _docs(s, d).where((F.length(F.coalesce("text", F.lit(""))) < 50) | ((F.length("text") >= 20) & (url_share(F.col("text")) >= 0.5))).select("doc_id"),
    "boilerplate_documents": lambda s, d: boilerplate(_docs(s, d).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(OPENING), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))),
    "text_quality": _each("quality", text_quality),
    "content_quality": _each("quality", lambda t: content_quality(t, "the und los")),
    "pii_spans": lambda s, d: pii_spans(_docs(s, d)),
    "pii_redacted": _each("redacted_md5", lambda t: F.md5(anonymised(t, "redact"))),
    "pii_starred": _each("masked_md5", lambda t: F.md5(anonymised(t, "mask"))),
    "claims": lambda s, d: claims(_docs(s, d)).select("doc_id", "nth", F.md5("claim").alias("claim_md5")),
    "grounding": lambda s, d: _docs(s, d).select("doc_id", grounded(F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.get(F.split("text", " "), 0)), F.when(F.col("doc_id") % 4 == 1, "zzzz qqqq").otherwise("the und les los"), F.col("text")).alias("grounded")),
    "domain_authority": lambda s, d: table(s, d, "pages").select("page_id", authority(F.col("url")).alias("authority")),
    "contradictions": lambda s, d: contradictions(_bench_pairs(s, d).withColumns({"a_text": F.concat_ws(" ", "a_text", F.col("a_id") % 7 * 10 + 10, F.when(F.col("a_id") % 2 == 0, "ja")), "b_text": F.concat_ws(" ", "b_text", F.col("b_id") % 7 * 10 + 8, F.when(F.col("b_id") % 3 == 0, "no"))})),
    "snippets": _each("snippet_md5", lambda t: F.md5(snippet(t, " the "))),
    "word_overlap": lambda s, d: _bench_pairs(s, d).select("a_id", "b_id", F.round(jaccard(terms(F.col("a_text")), terms(F.col("b_text"))), 6).alias("jaccard"), F.round(containment(terms(F.col("a_text")), terms(F.col("b_text"))), 6).alias("containment")),
    "query_terms": lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(terms(F.col("text")), "|").alias("tokens"), F.array_join(bigrams(terms(F.col("text"))), "|").alias("pairs")),
    "token_estimates": _each("tokens", token_estimate),
    "quality_audit": lambda s, d: audit(marked(_dealt(s, d))),
}


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{q(pattern)}'))"


_MARKED = "SELECT doc_id, CASE doc_id % " + str(EVERY) + " " + " ".join(f"WHEN {i} THEN '{q(mark)}'" + ("" if alone else " || coalesce(text, '')") for i, (mark, alone) in enumerate(MARKS)) + " ELSE coalesce(text, '') END AS text FROM documents"
_T = r"WITH marked AS (" + _MARKED + r"), d AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM marked), "
_W = f"regexp_extract_all(t, '{WORD}')"
_URLS = f"length(array_to_string(regexp_extract_all(t, '{URL}'), '')) / greatest(length(t), 1)"
_KIND = f"""k AS (SELECT *, length(t) AS n, {_W} AS w, greatest(len({_W}), 1) AS wc, {_URLS} AS url, CASE WHEN length(t) < 5 THEN 'prose' WHEN {_n(FORMULA)} >= 3 OR {_n(FORMULA)} > 0.05 * greatest(len({_W}), 1) THEN 'formula' WHEN {_n(TABLE)} >= 2 THEN 'table'
  WHEN {_n(DEFINITION)} >= 1 AND length(t) < 500 THEN 'definition' WHEN {_n(LEGAL)} >= 2 THEN 'legal' WHEN {_n(CODE)} >= 3 THEN 'code' ELSE 'prose' END AS kind FROM d),
f AS (SELECT *, CASE WHEN n < 15 THEN 'trivial' ELSE concat_ws(',', CASE WHEN {_n(GARBAGE)} >= 3 OR ({_n(GARBAGE)} >= 1 AND n < 100) THEN 'encoding_garbage' END, CASE WHEN {_n(COOKIE)} >= 3 THEN 'cookie_banner' END,
  CASE WHEN {_n(SENTENCE)} = 0 AND ({_n(SEPARATORS)} >= 2 OR {_n(CRUMBS)} >= 2) THEN 'pure_navigation' END, CASE WHEN url > 0.6 THEN 'url_dump' END) END AS flags FROM k),
p AS (SELECT *, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) / greatest(n, 1) AS share FROM f),
s AS (SELECT *, CASE WHEN n < 10 OR flags = 'trivial' THEN 0.0 WHEN contains(flags, 'encoding_garbage') THEN 0.05 WHEN contains(flags, 'cookie_banner') OR contains(flags, 'pure_navigation') THEN 0.1 ELSE round(greatest(0, least(1, 1.0::DOUBLE - (
  CASE WHEN kind IN ('formula', 'definition', 'table') THEN CASE WHEN n < 15 THEN 0.2 ELSE 0 END WHEN kind = 'code' THEN CASE WHEN n < 20 THEN 0.3 ELSE 0 END WHEN n < 30 THEN 0.4 WHEN n < 80 THEN 0.2 WHEN n < 150 THEN 0.05 ELSE 0 END
  + CASE WHEN kind IN ('formula', 'table', 'code') THEN CASE WHEN share < 0.1 THEN 0.15 ELSE 0 END WHEN share < 0.4 THEN 0.4 WHEN share < 0.55 THEN 0.15 ELSE 0 END
  + CASE WHEN kind = 'prose' AND {_n(SENTENCE)} = 0 AND NOT regexp_matches(t, '[.!?]$') AND n > 100 THEN 0.15 ELSE 0 END
  + CASE WHEN {_n(BOILERPLATE)} >= 3 THEN 0.5 WHEN {_n(BOILERPLATE)} >= 2 THEN 0.3 WHEN {_n(BOILERPLATE)} >= 1 THEN 0.15 ELSE 0 END + CASE WHEN url > 0.5 THEN 0.45 WHEN url > 0.3 THEN 0.25 ELSE 0 END
  + CASE WHEN {_n(SEPARATORS)} >= 2 THEN 0.35 ELSE 0 END + CASE WHEN kind NOT IN ('formula', 'code') AND len(list_distinct(list_transform(w, lambda x: lower(x)))) < 0.3 * wc AND wc > 20 THEN 0.2 ELSE 0 END
  + CASE WHEN kind = 'prose' AND len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}.'))) + len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) < 0.02 * wc AND wc > 30 THEN 0.1 ELSE 0 END)::DOUBLE)), 6) END::DOUBLE AS score FROM p)"""
_NOISE = "(n < 10 OR flags <> '' OR score < 0.2)"
_TERMS = "list_distinct(list_filter(regexp_extract_all(lower({c}), '" + WORD + "'), lambda x: length(x) >= 3))"
_FIRST = lambda c: f"""(WITH o AS (SELECT unnest(regexp_extract_all(lower({c}), '{WORD}')) AS x, generate_subscripts(regexp_extract_all(lower({c}), '{WORD}'), 1) AS i) SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM o WHERE length(x) >= 3 GROUP BY x))"""
_PAIRS = "WITH p AS (SELECT a.item_id AS a_id, b.item_id AS b_id, a.text AS a_text, b.text AS b_text FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"


def _without(mark: str) -> str:
    out = "text"
    for kind, pattern, _ in KINDS:
        out = f"regexp_replace({out}, '{pattern}', '{mark.replace('KIND', kind)}', 'g')"
    return out


ORACLE_SQL = {
    "content_types": f"{_T}{_KIND} SELECT doc_id, kind AS content_type FROM k",
    "defect_flags": f"{_T}{_KIND} SELECT doc_id, flags FROM f",
    "structural_scores": f"{_T}{_KIND} SELECT doc_id, score FROM s",
    "noise_gate": f"{_T}{_KIND} SELECT doc_id FROM s WHERE {_NOISE}",
    "short_texts": f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id FROM d WHERE length(t) < 50 OR (length(t) >= 20 AND {_URLS} >= 0.5)",
    "boilerplate_documents": f"WITH m AS (SELECT doc_id, trim(regexp_replace(lower(substr(CASE WHEN doc_id % 3 = 0 THEN '{OPENING}' || coalesce(text, '') ELSE text END, 1, 500)), '\\s+', ' ', 'g')) AS o FROM documents), s AS (SELECT o, count(DISTINCT doc_id) AS docs FROM m WHERE length(o) > 50 GROUP BY 1) SELECT doc_id, md5(o) AS fingerprint, docs FROM m JOIN s USING (o) WHERE docs >= greatest(5, 0.3 * (SELECT count(DISTINCT doc_id) FROM documents))",
    "text_quality": f"SELECT doc_id, CASE WHEN t = '' THEN 0.0 ELSE round(least(1, 0.3::DOUBLE * least(1, length(t) / 500) + 0.3::DOUBLE * least(1, (length(regexp_replace(t, '[^.!?]', '', 'g')) / 10 + len(string_split(t, chr(10) || chr(10))) / 3) / 2) + 0.2::DOUBLE * (1 - least(1, 10 * length(regexp_replace(t, '[\\p{{L}}\\p{{N}}_\\s.,!?;:\\-]', '', 'g')) / greatest(length(t), 1))) + CASE WHEN len(w) > 10 THEN 0.2::DOUBLE * least(1, 2 * len(list_distinct(w)) / len(w)) ELSE 0.1 END), 6) END::DOUBLE AS quality FROM (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents)",
    "content_quality": "SELECT doc_id, CASE WHEN t = '' THEN 0.0 ELSE round(least(1, 0.3::DOUBLE * CASE WHEN n > 2000 THEN 1.0 WHEN n > 500 THEN 0.8 WHEN n > 200 THEN 0.6 WHEN n > 100 THEN 0.4 ELSE 0.2 END + 0.3::DOUBLE * least(1, length(regexp_replace(t, '[^.!?]', '', 'g')) * 0.1::DOUBLE + len(string_split(t, chr(10) || chr(10))) * 0.2::DOUBLE) + 0.2::DOUBLE * greatest(0, 1 - 0.2::DOUBLE * (" + " + ".join(f"contains(lower(t), '{w}')::INT" for w in NOISE) + ")) + 0.2::DOUBLE * ((contains(lower(t), 'the')::INT + contains(lower(t), 'und')::INT + contains(lower(t), 'los')::INT) / 3)), 6) END::DOUBLE AS quality FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents)",
    "pii_redacted": f"SELECT doc_id, md5({_without('')}) AS redacted_md5 FROM documents",
    "pii_starred": f"SELECT doc_id, md5({_without('****')}) AS masked_md5 FROM documents",
    "claims": r"WITH c AS (SELECT doc_id, flatten(list_transform(list_filter(string_split_regex(trim(text), '[.!?]+\s+'), lambda s: length(s) >= 15), lambda s: CASE WHEN length(s) <= 100 THEN [s] ELSE list_filter(string_split_regex(s, ',? (?:und|sowie|aber|jedoch|während|and|but|while) '), lambda p: length(p) > 15) END)) AS c FROM documents) SELECT doc_id, (generate_subscripts(c, 1) - 1)::INT AS nth, md5(unnest(c)) AS claim_md5 FROM c",
    "grounding": "SELECT doc_id, (doc_id % 3 <> 0 OR contains(t, lower(source))) AND CASE WHEN doc_id % 4 = 1 THEN contains(t, 'zzzz') OR contains(t, 'qqqq') ELSE contains(t, 'the') OR contains(t, 'und') OR contains(t, 'les') OR contains(t, 'los') END AS grounded FROM (SELECT *, lower(coalesce(text, '')) AS t FROM documents)",
    "domain_authority": "SELECT page_id, CASE WHEN " + " OR ".join(f"contains(lower(url), '{x}')" for x in HIGH) + " THEN 0.15 WHEN " + " OR ".join(f"contains(lower(url), '{x}')" for x in MEDIUM) + " THEN 0.08 ELSE 0 END::DOUBLE AS authority FROM pages",
    "contradictions": f"{_PAIRS}, t AS (SELECT a_id, b_id, concat_ws(' ', a_text, a_id % 7 * 10 + 10, CASE WHEN a_id % 2 = 0 THEN 'ja' END) AS x, concat_ws(' ', b_text, b_id % 7 * 10 + 8, CASE WHEN b_id % 3 = 0 THEN 'no' END) AS y FROM p), n AS (SELECT *, list_transform(regexp_extract_all(x, '[0-9]+(?:\\.[0-9]+)?')[1:3], lambda v: v::DOUBLE) AS nx, list_transform(regexp_extract_all(y, '[0-9]+(?:\\.[0-9]+)?')[1:3], lambda v: v::DOUBLE) AS ny, regexp_extract_all(lower(x), '{WORD}') AS wx, regexp_extract_all(lower(y), '{WORD}') AS wy FROM t), k AS (SELECT a_id, b_id, CASE WHEN len(list_filter(nx, lambda u: u > 0 AND len(list_filter(ny, lambda v: abs(u - v) > 0.2 * u)) > 0)) > 0 THEN 'numerical' WHEN (len(list_intersect(wx, {list(YES)})) > 0 AND len(list_intersect(wy, {list(NO)})) > 0) OR (len(list_intersect(wx, {list(NO)})) > 0 AND len(list_intersect(wy, {list(YES)})) > 0) THEN 'factual' END AS kind FROM n) SELECT * FROM k WHERE kind IS NOT NULL",
    "snippets": "WITH s AS (SELECT doc_id, coalesce(text, '') AS t, instr(lower(coalesce(text, '')), ' the ') AS k FROM documents), r AS (SELECT *, greatest(k - 500, 1) AS a, least(k + 4 + 1500, length(t)) AS b FROM s) SELECT doc_id, md5(CASE WHEN k > 0 THEN CASE WHEN a > 1 THEN '...' ELSE '' END || substr(t, a, b - a + 1) || CASE WHEN b < length(t) THEN '...' ELSE '' END ELSE substr(t, 1, 8000) END) AS snippet_md5 FROM r",
    "word_overlap": f"{_PAIRS}, s AS (SELECT a_id, b_id, {_TERMS.replace('{c}', 'a_text')} AS a, {_TERMS.replace('{c}', 'b_text')} AS b FROM p), n AS (SELECT *, len(list_intersect(a, b)) AS k FROM s) SELECT a_id, b_id, round(k / (len(a) + len(b) - k), 6) AS jaccard, round(k / least(len(a), len(b)), 6) AS containment FROM n",
    "query_terms": f"SELECT item_id, array_to_string(w, '|') AS tokens, array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|') AS pairs FROM (SELECT item_id, {_FIRST('text')} AS w FROM benchmark)",
    "token_estimates": "SELECT doc_id, ceil(length(coalesce(text, '')) / 4)::BIGINT AS tokens FROM documents",
    "quality_audit": f"{_T}{_KIND} SELECT count(*) AS docs, round(avg(score), 6) AS mean_score, " + ", ".join(f"count(*) FILTER (contains(flags, '{x}')) AS {x}" for x in ("trivial", "encoding_garbage", "cookie_banner", "pure_navigation", "url_dump")) + f", count(*) FILTER ({_NOISE}) AS noise, count(*) - count(DISTINCT coalesce(text, '')) AS repeats FROM s",
}
