"""WARC derivative builder: from response records to linked metadata and plain-text conversion records.

A record is a row with ``headers`` (a map of the named WARC fields) and ``block`` (its text). From each response two records derive. Both
refer to the response by its id, carry its target, date and payload digest, and have ids made from the response's id, so that a rerun
makes the same ones. The metadata record is JSON of the source's WARC and HTTP fields, its digests, title and links. The conversion
record is the page's text. All of it is row by row: nothing is shuffled.

Files: ``read_records`` cuts WARC files at the version line, so large files are split over tasks; ``write_records`` writes whole
records as text. Both are for records of UTF-8 text; ``intact`` tells whether a block has the length that its header states.

Defined results: a null or empty html is an empty payload; a null url leaves out the target; repeated rows give equal records; records
of other types derive nothing; a response without an id has no refers-to and ids made from its block; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.0"
CRLF = "\r\n"
#: The alphabets of base 32 digits as Spark counts them and as digests write them.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Order in which fields are written.
FIELDS = [
    "WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "WARC-Block-Digest",
    "Content-Type", "Content-Length",
]
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>"
BREAKS = (
    r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|dl|dt|dd|table|tr|article|section|nav|aside|main|header|footer|title|head|body|html|form|"
    r"blockquote|pre|hr|option|select)\b[^>]*>"
)
TAGS = r"<[^>]*>"
#: Named entities that are decoded, the ampersand last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def digest(text: Column) -> Column:
    """``sha1:`` and the base 32 digest of the UTF-8 bytes."""
    number = F.sha1(text)
    groups = [F.lpad(F.conv(F.substring(number, k, 10), 16, 32), 8, "0") for k in range(1, 40, 10)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*groups), DIGITS, BASE32))


def record_id(*parts: Column) -> Column:
    """A urn made from the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def fields(**values: Column) -> Column:
    """A map of named WARC fields (underscores for hyphens); null values are left out."""
    names = {name.lower().replace("-", "_"): name for name in FIELDS}
    entries = [F.struct(F.lit(names[k]).alias("k"), v.alias("v")) for k, v in values.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of fetched pages (url, html); ``pages`` says nothing of the time, so it is a parameter."""
    html = F.coalesce(F.col("html"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.octet_length(html).cast("string"), F.lit(CRLF + CRLF))
    built = pages.withColumn("block", F.concat(http, html))
    return built.withColumn("headers", fields(
        warc_type=F.lit("response"),
        warc_record_id=record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))),
        warc_target_uri=F.col("url"), warc_date=F.lit(date), warc_payload_digest=digest(html), warc_block_digest=digest(F.col("block")),
        content_type=F.lit("application/http; msgtype=response"), content_length=F.octet_length("block").cast("string"),
    )).drop("html", "url")


def page_text(html: Column) -> Column:
    """The visible text: hidden parts and tags go, block tags break lines, entities are decoded, blanks collapse, empty lines go."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BREAKS, "\n"), TAGS, "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t\\r\\x0B\\f\\x{A0}]+", " "), " ?\\n[ \\n]*", "\n")
    return F.btrim(text, F.lit(" \n"))


def derive(records: DataFrame) -> DataFrame:
    """The metadata and the conversion record of each response of ``records``: headers and block in the place of the source's."""
    source = records.where(F.col("headers")["WARC-Type"] == "response")
    parts = F.split(F.coalesce("block", F.lit("")), CRLF + CRLF, 2)
    source = source.withColumn("_http", parts[0]).withColumn("_html", F.coalesce(F.get(parts, 1), F.lit("")))
    of = lambda name: F.col("headers")[name]
    source = source.withColumns({
        "_own": F.coalesce(of("WARC-Record-ID"), F.md5("block")),
        "_digest": F.coalesce(of("WARC-Payload-Digest"), digest(F.col("_html"))),
        "_text": page_text(F.col("_html")),
    })
    lines = F.split("_http", CRLF)
    envelope = F.to_json(F.struct(
        F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])).alias("warc"),
        lines[0].alias("status"),
        F.slice(lines, 2, F.size(lines)).alias("http"),
        F.struct(F.col("_digest").alias("payload"), digest(F.col("_text")).alias("text")).alias("digests"),
        F.btrim(F.regexp_extract("_html", "(?is)<title[^>]*>(.*?)</title", 1)).alias("title"),
        F.regexp_extract_all("_html", F.lit("(?i)href=\"([^\"]*)\""), 1).alias("links"),
    ))
    made = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/json").alias("type"), envelope.alias("block")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("type"), F.col("_text").alias("block")))
    out = source.withColumn("_made", F.explode(made))
    block = F.col("_made.block")
    return out.withColumn("headers", fields(
        warc_type=F.col("_made.kind"), warc_record_id=record_id(F.col("_made.kind"), F.col("_own")), warc_refers_to=of("WARC-Record-ID"),
        warc_target_uri=of("WARC-Target-URI"), warc_date=of("WARC-Date"), warc_payload_digest=F.col("_digest"),
        warc_block_digest=digest(block), content_type=F.col("_made.type"), content_length=F.octet_length(block).cast("string"),
    )).withColumn("block", block).drop("_http", "_html", "_own", "_digest", "_text", "_made")


def record_text(headers: Column, block: Column) -> Column:
    """The whole record up to the blank lines that end it: version line, fields in their order, others by name, blank line, block."""
    known = F.array(*(F.lit(n) for n in FIELDS))
    others = F.array_sort(F.filter(F.map_keys(headers), lambda k: ~F.array_contains(known, k)))
    line = lambda k: F.concat(k, F.lit(": "), headers[k])
    lines = F.transform(F.concat(F.filter(known, lambda k: F.map_contains_key(headers, k)), others), line)
    return F.concat(F.lit(VERSION + CRLF), F.array_join(lines, CRLF), F.lit(CRLF + CRLF), block)


def write_records(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write (headers, block) as WARC files, a file for each partition."""
    text = F.concat(record_text(F.col("headers"), F.col("block")), F.lit(CRLF))
    records.select(text.alias("value")).write.option("lineSep", CRLF).option("compression", compression).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(headers, block, intact) of the records of WARC files; a file is cut where a version line begins a record."""
    raw = spark.read.option("lineSep", VERSION + CRLF).text(path).where(F.length("value") > 0)
    parts = F.split("value", CRLF + CRLF, 2)
    named = F.transform(F.split(parts[0], CRLF), lambda line: F.split(line, ": ?", 2))
    headers = F.map_from_entries(F.transform(
        F.filter(named, lambda p: F.size(p) == 2), lambda p: F.struct(p[0].alias("k"), p[1].alias("v"))))
    read = raw.select(headers.alias("headers"), F.regexp_replace(F.get(parts, 1), "\\r\\n\\r\\n$", "").alias("block"))
    length = F.try_to_number(F.col("headers")["Content-Length"], F.lit("999999999999"))
    return read.withColumn("intact", F.coalesce(F.octet_length("block") == length, F.lit(False)))
