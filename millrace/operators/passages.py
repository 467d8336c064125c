"""Passages of documents, fingerprints of their terms, texts of pages, and occurrences in order."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.retrieval import TERMS, terms
from millrace.sources.tables import LEDGER_SQL, ledger, table

#: Most characters of a passage; passages that leave a task at once; white space.
PASSAGE, BATCH = 800, 10_000
SPACES = re.compile(r"\s*")
#: Elements whose text is not of the page's own, and such whose end closes a line.
ASIDE = {"script", "style", "nav", "aside", "footer", "form", "noscript", "template", "iframe", "svg"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "div", "tr", "article", "section", "blockquote", "pre"}


def packed(text: str | None, most: int = PASSAGE) -> Iterator[str]:
    """Whole sentences, as many as fit in a passage; a longer sentence is cut at its size. Null or blank text: none."""
    own = ""
    for sentence in re.split(r"(?<=[.!?])\s+", (text or "").strip()):
        at = 0
        while len(sentence) - at > most:
            if own:
                yield own
                own = ""
            yield sentence[at : at + most]
            at = SPACES.match(sentence, at + most).end()
        sentence = sentence[at:]
        if own and len(own) + 1 + len(sentence) > most:
            yield own
            own = sentence
        else:
            own = f"{own} {sentence}" if own and sentence else own or sentence
    if own:
        yield own


def chunk_documents(spark, d) -> DataFrame:
    """(doc_id, chunk_id, text): the passages of each document in order."""

    schema = pa.schema([("doc_id", pa.int64()), ("chunk_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ((doc_id, k, part) for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True) for k, part in enumerate(packed(text)))
            while rows := list(itertools.islice(found, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, chunk_id long, text string")


class Page(HTMLParser):
    """Title, lines of text outside of menus, scripts and notices, and links of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self.links, self.aside, self.in_title = "", [], 0, [], False

    def handle_starttag(self, tag, attrs) -> None:
        marks = set((dict(attrs).get("class") or "").split())
        if tag in ASIDE or self.aside and tag == self.aside[-1] or marks & {"ad", "ads", "comment", "comments", "cookie"}:
            if tag not in ("br", "img", "input", "meta", "link", "hr"):
                self.aside.append(tag)
        elif tag == "title":
            self.in_title = True
        elif tag == "a" and not self.aside:
            self.links += 1
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag) -> None:
        if self.aside and tag == self.aside[-1]:
            self.aside.pop()
        if tag == "title":
            self.in_title = False
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data) -> None:
        if self.in_title:
            self.title += data
        elif not self.aside:
            self.parts.append(data)


def read_page(html: str | None) -> tuple[str, str, int]:
    page = Page()
    page.feed(html or "")
    page.close()
    lines = (" ".join(line.split()) for line in "".join(page.parts).split("\n"))
    return " ".join(page.title.split()), "\n".join(line for line in lines if line), page.links


def page_extract(spark, d) -> DataFrame:
    """(page_id, title, text, links) of each page; null html gives empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [read_page(html) for html in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], **{c: [r[i] for r in read] for i, c in enumerate(("title", "text", "links"))}})

    return table(spark, d, "pages").select("page_id", "html").mapInPandas(run, "page_id long, title string, text string, links long")


def doc_simhash(spark, d) -> DataFrame:
    """(doc_id, simhash): of each bit, whether more of a document's terms have it in their hash than not."""
    found = terms(table(spark, d, "documents"), "doc_id")
    halves = [F.conv(F.substring(F.md5("term"), at, 8), 16, 10).cast("long") for at in (1, 9)]
    found = found.select("doc_id", halves[0].alias("h0"), halves[1].alias("h1"))
    votes = [F.sum(F.shiftright(f"h{i // 32}", i % 32).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"v{i}") for i in range(64)]
    bits = [F.when(F.col(f"v{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(64)]
    value = bits[0]
    for bit in bits[1:]:
        value = value.bitwiseOR(bit)
    return found.groupBy("doc_id").agg(*votes).select("doc_id", value.alias("simhash"))


def debounce(spark, d) -> DataFrame:
    """Events of a user and type that none follows within half an hour."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    events = table(spark, d, "events").withColumn("next", F.lead("ts").over(w))
    return events.where("next is null or next - ts >= interval 30 minutes").select("event_id", "user_id", "event_type")


def sequence_gaps(spark, d) -> DataFrame:
    """Turns that do not follow on the one before in their conversation; one in five turns is taken out first, as if lost."""
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    turns = table(spark, d, "conversations").where("(conv_id + turn) % 5 <> 3").withColumn("before", before)
    return turns.where("before is not null and turn <> before + 1").groupBy("conv_id", "before", "turn").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (chunk_documents, page_extract, doc_simhash, debounce, sequence_gaps)}

_VOTES = ", ".join(f"sum(((h{i // 32} >> {i % 32}) & 1) * 2 - 1) AS v{i}" for i in range(64))
_BITS = " + ".join(f"(CASE WHEN v{i} > 0 THEN {1 << i if i < 63 else '(-9223372036854775807 - 1)'}::BIGINT ELSE 0 END)" for i in range(63, -1, -1))
ORACLE_SQL = {
    "doc_simhash": f"SELECT doc_id, ({_BITS})::BIGINT AS simhash FROM (SELECT doc_id, {_VOTES} FROM (SELECT doc_id, ('0x' || substr(m, 1, 8))::BIGINT AS h0, ('0x' || substr(m, 9, 8))::BIGINT AS h1 FROM (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '{TERMS}'))) AS m FROM documents)) GROUP BY doc_id)",
    "debounce": "SELECT event_id, user_id, event_type FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS next FROM events) WHERE next IS NULL OR next - ts >= INTERVAL 30 MINUTE",
    "sequence_gaps": "SELECT conv_id, before, turn, count(*) AS n FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations WHERE (conv_id + turn) % 5 <> 3) WHERE before IS NOT NULL AND turn <> before + 1 GROUP BY 1, 2, 3",
}
