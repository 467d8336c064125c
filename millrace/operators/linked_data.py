"""JSON-LD of pages as entities and properties, opening hours, valid JSON, and the sections of a page that a question is about.

Blocks are parsed to VARIANT once; lists, ``@graph`` and nested types are walked by paths, so that a page may have any shape. Blocks that
are no JSON are kept as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.tables import table

# What results depend on.
SCRIPT = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
DAYS = (("Monday", "Montag"), ("Tuesday", "Dienstag"), ("Wednesday", "Mittwoch"), ("Thursday", "Donnerstag"), ("Friday", "Freitag"), ("Saturday", "Samstag"), ("Sunday", "Sonntag"))
TIME = r"[0-9]{1,2}[:.][0-9]{2}\s*[-–]\s*[0-9]{1,2}[:.][0-9]{2}"
DAY = (
    r"(?i)(?:Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|"
    r"Mo\b|Di\b|Mi\b|Do\b|Fr\b|Sa\b|So\b|Mon\b|Tue\b|Wed\b|Thu\b|Fri\b|Sat\b|Sun\b|Mo\s*[-–]\s*Fr|Mo\s*[-–]\s*Sa|Mo\s*[-–]\s*So)"
)
ADDRESS = r"(?i)(?:[0-9]{4,5}\s+[\p{L}\p{N}_]+|(?:Strasse|Straße|str\.|weg|platz|gasse|allee)\b)"
PHONE, PRICE = r"(?:\+[0-9]{1,3}[\s.-]?)?\(?[0-9]{2,4}\)?[\s.-]?[0-9]{3}[\s.-]?[0-9]{2,4}", r"(?:CHF|EUR|€|Fr\.?)\s*[0-9]+[.,]?[0-9]*"
ASKED = (
    (("öffnung", "offen", "geöffnet", "open", "hours", "uhr", "zeit"), (TIME, DAY)), (("adresse", "address", "standort", "location", "strasse", "straße"), (ADDRESS,)),
    (("preis", "price", "kosten", "cost", "chf", "eur", "€"), (PRICE,)), (("telefon", "phone", "anruf", "call", "nummer"), (PHONE,)),
)


def get(variant: str, path: str, kind: str) -> Column:
    return F.expr(f'try_variant_get({variant}, "{path}", "{kind}")')


def parsed(text: Column) -> Column:
    """A text as VARIANT; null where it is no JSON. The parser stops after a value, so a text must also be one inside a list and inside
    an object: nothing may follow."""
    inside = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    listed = F.call_function("try_variant_get", inside, F.lit("$"), F.lit("array<variant>"))
    keyed = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}")))
    return F.when((F.size(listed) == 1) & keyed.isNotNull(), F.get(listed, 0))


def valid_json(text: Column) -> Column:
    """Whether a text is JSON, with white space about it at most; null is not."""
    return parsed(text).isNotNull()


def json_ld_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block, valid, v): each block of linked data of a page, in order from 0, as VARIANT; null where it is no JSON."""
    bodies = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(SCRIPT), 1)
    rows = pages.select("page_id", F.posexplode(bodies).alias("block", "body"))
    rows = rows.withColumn("v", parsed(F.col("body")))
    return rows.select("page_id", "block", F.col("v").isNotNull().alias("valid"), "v")


def json_ld_entities(pages: DataFrame) -> DataFrame:
    """(page_id, block, nth, type, entity): what valid blocks speak of: the object itself or each of a list, followed by what its
    ``@graph`` holds. type: the first of its types; null without one. Values that are no objects are left out."""
    blocks = json_ld_blocks(pages).where("valid")
    items = F.coalesce(get("v", "$", "array<variant>"), F.array("v"))
    rows = blocks.select("page_id", "block", F.posexplode(items).alias("item", "e"))
    inside = F.concat(F.array("e"), F.coalesce(get("e", "$['@graph']", "array<variant>"), F.expr("cast(array() as array<variant>)")))
    rows = rows.select("page_id", "block", "item", F.posexplode(inside).alias("part", "entity"))
    kind = F.coalesce(F.get(get("entity", "$['@type']", "array<string>"), 0), get("entity", "$['@type']", "string"))
    rows = rows.where(F.expr("schema_of_variant(entity) like 'OBJECT%'"))
    return rows.select("page_id", "block", (F.col("item") * 100_000 + F.col("part")).alias("nth"), kind.alias("type"), "entity")


def json_ld_properties(pages: DataFrame) -> DataFrame:
    """(page_id, block, nth, type, property, value): each property of each entity; lists and objects as JSON text."""
    rows = json_ld_entities(pages).select("page_id", "block", "nth", "type", F.explode(get("entity", "$", "map<string,variant>")).alias("property", "v"))
    return rows.select("page_id", "block", "nth", "type", "property", F.coalesce(get("v", "$", "string"), F.expr("to_json(v)")).alias("value"))


def opening_hours(pages: DataFrame) -> DataFrame:
    """(page_id, hours): of the first entity of a page that says when it is open: its openingHours, a line each, else
    the days with opens and closes of its openingHoursSpecification, days in German, every day where none is named."""
    rows = json_ld_entities(pages)
    plain = F.coalesce(F.array_join(get("entity", "$.openingHours", "array<string>"), "\n"), get("entity", "$.openingHours", "string"))
    names = F.create_map(*(F.lit(x) for en, de in DAYS for x in (en, de, f"https://schema.org/{en}", de)))
    field = lambda x, path, kind: F.call_function("try_variant_get", x, F.lit(path), F.lit(kind))

    def line(x: Column) -> Column:
        days = F.coalesce(field(x, "$.dayOfWeek", "array<string>"), F.array_compact(F.array(field(x, "$.dayOfWeek", "string"))))
        named = F.array_join(F.transform(days, lambda day: F.coalesce(F.try_element_at(names, day), day)), ", ")
        opens, closes = field(x, "$.opens", "string"), field(x, "$.closes", "string")
        said = F.concat(F.when(named == "", "Täglich").otherwise(named), F.lit(": "), opens, F.lit(" - "), closes)
        return F.when((opens != "") & (closes != ""), said)

    specs = F.array_join(F.array_compact(F.transform(get("entity", "$.openingHoursSpecification", "array<variant>"), line)), "\n")
    hours = F.coalesce(F.when(plain != "", plain), F.when(specs != "", specs))
    rows = rows.select("page_id", F.struct("block", "nth", hours.alias("hours")).alias("found")).where("found.hours is not null")
    return rows.groupBy("page_id").agg(F.min("found").alias("first")).select("page_id", F.col("first.hours").alias("hours"))


def asked_patterns(query: str) -> list[str]:
    low = query.lower()
    found = [p for words, patterns in ASKED if any(w in low for w in words) for p in patterns]
    return found or [TIME, DAY, ADDRESS, PHONE]


def relevant_sections(pages: DataFrame, query: str, radius: int = 500, least: int = 50, most: int = 10) -> DataFrame:
    """(page_id, nth, section): what surrounds the places of a page's text that fit a question (hours, address, price, telephone; all
    if it names none), ranges that touch as one, in order; those of more than ``least`` characters, ``most`` of a page."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]+>", " "), r"\s+", " ")
    rows = pages.select("page_id", text.alias("text")).withColumn("n", F.length("text"))
    ranges = []
    for pattern in asked_patterns(query):
        hits, parts = F.regexp_extract_all("text", F.lit(pattern), 0), F.split("text", pattern)
        ends = F.aggregate(
            F.arrays_zip(parts.alias("p"), hits.alias("h")), F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["p"]) + F.coalesce(F.length(x["h"]), F.lit(0))).alias("at"),
                F.when(x["h"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["p"])).alias("a"), (acc["at"] + F.length(x["p"]) + F.length(x["h"])).alias("b"))))).alias("out"),
            ),
            lambda acc: acc["out"],
        )
        ranges.append(ends)
    spans = F.transform(F.concat(*ranges), lambda s: F.struct(F.greatest(s["a"] - radius, F.lit(0)).alias("a"), F.least(s["b"] + radius, F.col("n")).alias("b")))
    merged = F.aggregate(
        F.sort_array(spans), F.expr("cast(array() as array<struct<a:int,b:int>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= s["a"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["b"]).alias("b")))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    sections = F.transform(merged, lambda s: F.trim(F.substring(F.col("text"), s["a"] + 1, s["b"] - s["a"])))
    kept = F.slice(F.filter(sections, lambda x: F.length(x) > least), 1, most)
    return rows.select("page_id", F.posexplode(kept).alias("nth", "section"))


def _linked(s, d):
    """Pages with linked data made of what they are: an object, a list, a graph, two blocks, and one that is broken, by page_id."""
    pages = table(s, d, "pages")
    own = F.concat(F.lit('{"@type":"Article","url":"'), "url", F.lit('","position":'), "page_id", F.lit(',"author":{"@type":"Person","name":"A"},"tags":["x","y"]}'))
    shop = F.concat(F.lit('{"@type":["Store","Place"],"name":"S'), "page_id", F.lit('","openingHours":["Mo-Fr 09:00-17:00","Sa 10:00-12:00"]}'))
    spec = F.lit('{"@context":"https://schema.org","@graph":[{"@type":"Thing"},{"@type":"Cafe","openingHoursSpecification":[{"dayOfWeek":["Monday","https://schema.org/Friday"],"opens":"08:00","closes":"12:00"},{"opens":"13:00","closes":"14:00"},{"dayOfWeek":"Sunday","opens":"","closes":"9"}]}]}')
    block = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    k = F.col("page_id") % 5
    data = F.when(k == 0, block(own)).when(k == 1, block(F.concat(F.lit(" ["), own, F.lit(","), shop, F.lit("]\n")))).when(k == 2, block(spec)).when(k == 3, F.concat(block(F.lit('{"@type":')), block(shop))).otherwise("")
    return pages.withColumn("html", F.concat(F.coalesce("html", F.lit("")), data))


def _asking(s, d):
    return table(s, d, "pages").withColumn("html", F.concat("html", F.when(F.col("page_id") % 3 == 0, "<p>Tel. 044 123 4567, CHF 12.50 a day</p>").otherwise("")))


QUERIES = {
    "json_ld_blocks": lambda s, d: json_ld_blocks(_linked(s, d)).select("page_id", "block", "valid"),
    "json_ld_properties": lambda s, d: json_ld_properties(_linked(s, d)),
    "opening_hours": lambda s, d: opening_hours(_linked(s, d)),
    "relevant_sections": lambda s, d: relevant_sections(_asking(s, d), "Was ist der Preis?").select("page_id", "nth", F.md5("section").alias("section_md5")),
    "json_validity": lambda s, d: table(s, d, "events").select("event_id", valid_json(F.when(F.col("event_id") % 7 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))).alias("valid")),
}
_LD = """WITH p AS (SELECT page_id, page_id % 5 AS k, '{"@type":"Article","url":"' || url || '","position":' || page_id || ',"author":{"@type":"Person","name":"A"},"tags":["x","y"]}' AS own, '{"@type":["Store","Place"],"name":"S' || page_id || '","openingHours":["Mo-Fr 09:00-17:00","Sa 10:00-12:00"]}' AS shop FROM pages)"""
ORACLE_SQL = {
    "json_ld_blocks": f"{_LD} SELECT page_id, 0::INT AS block, k <> 3 AS valid FROM p WHERE k < 4 UNION ALL SELECT page_id, 1, true FROM p WHERE k = 3",
    "json_ld_properties": f"""{_LD}, e AS (SELECT page_id, 0::INT AS block, 0::INT AS nth, 'Article' AS type, own AS j FROM p WHERE k IN (0, 1) UNION ALL SELECT page_id, CASE k WHEN 3 THEN 1 ELSE 0 END, CASE k WHEN 1 THEN 100000 ELSE 0 END, 'Store', shop FROM p WHERE k IN (1, 3)),
o AS (SELECT page_id, block, nth, type, unnest(json_keys(j)) AS property, j FROM e)
SELECT page_id, block, nth, type, property, j::JSON ->> ('$."' || property || '"') AS value FROM o
UNION ALL SELECT page_id, 0, 0, NULL, '@context', 'https://schema.org' FROM p WHERE k = 2
UNION ALL SELECT page_id, 0, 0, NULL, '@graph', '[{{"@type":"Thing"}},{{"@type":"Cafe","openingHoursSpecification":[{{"closes":"12:00","dayOfWeek":["Monday","https://schema.org/Friday"],"opens":"08:00"}},{{"closes":"14:00","opens":"13:00"}},{{"closes":"9","dayOfWeek":"Sunday","opens":""}}]}}]' FROM p WHERE k = 2
UNION ALL SELECT page_id, 0, 1, 'Thing', '@type', 'Thing' FROM p WHERE k = 2 UNION ALL SELECT page_id, 0, 2, 'Cafe', '@type', 'Cafe' FROM p WHERE k = 2
UNION ALL SELECT page_id, 0, 2, 'Cafe', 'openingHoursSpecification', '[{{"closes":"12:00","dayOfWeek":["Monday","https://schema.org/Friday"],"opens":"08:00"}},{{"closes":"14:00","opens":"13:00"}},{{"closes":"9","dayOfWeek":"Sunday","opens":""}}]' FROM p WHERE k = 2""",
    "opening_hours": f"{_LD} SELECT page_id, CASE WHEN k = 2 THEN 'Montag, Freitag: 08:00 - 12:00' || chr(10) || 'Täglich: 13:00 - 14:00' ELSE 'Mo-Fr 09:00-17:00' || chr(10) || 'Sa 10:00-12:00' END AS hours FROM p WHERE k IN (1, 2, 3)",
    "json_validity": "SELECT event_id, json_valid(CASE WHEN event_id % 7 = 0 THEN props || '}' ELSE props END) AS valid FROM events",
}
