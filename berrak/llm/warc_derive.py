"""Derivatives of web archives: from response records to linked metadata and conversion records.

A response record has a target URI, a date, HTTP headers and a payload. From each, two records
are derived that refer to it by its identifier: ``metadata`` with facts about the fetch
(application/warc-fields), and ``conversion`` with the page's text (text/plain). Identifiers come
from the content, so that a second run gives the same records. Digests are labelled SHA-256 in
hexadecimal.

All of it is column expressions; each response is read once and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berrak.llm.tables import quoted

#: Elements that hold no text, and elements that end a line.
HIDDEN = ("script", "style", "noscript", "template")
BLOCKS = "p|br|div|li|ul|ol|h[1-6]|tr|table|nav|article|section|header|footer|title|body|html|blockquote|pre|hr|dt|dd"
#: Character references that are resolved; &amp; comes last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
DATE = "2024-01-01T00:00:00Z"
SOFTWARE = "berrak/0.1"
#: The columns of a response that are read, and all names that stand for something here.
RESPONSE = ("record_id", "target_uri", "date", "http_headers", "payload")
NAMES = {*RESPONSE, "record_type", "refers_to", "content_type", "block_digest", "payload_digest", "content_length", "block", "record", "text", "id"}


def plain_text(html: Column) -> Column:
    """The text of a page: block elements end lines, other tags vanish, white space collapses.

    Comments, elements and tags that nothing closes stay as they are. Each pattern is held once against a
    stretch without an end: the second alternatives take such a stretch whole and give it back.
    """
    hidden = "|".join(HIDDEN)
    out = F.regexp_replace(html, "(?s)<!--(?:.*?-->|(?<=(<!--))(.*))", "$1$2")
    out = F.regexp_replace(out, f"(?is)<(?:{hidden})(?:[^>]*>.*?</(?:{hidden})\\s*>|(?<=(<(?:{hidden})))([^>]*(?:>.*)?))", "$1$2")
    # Lone spaces, by far the most, are no match that way.
    out = F.regexp_replace(out, "[\t\r\n\f][ \t\r\n\f]*| [ \t\r\n\f]+", " ")

    def untagged(x: Column) -> Column:
        rest = F.substring_index(x, ">", -1)  # has no whole tag
        lines = F.regexp_replace(F.left(x, F.length(x) - F.length(rest)), f"(?i)</?(?:{BLOCKS})(?:[ /][^>]*)?>", "\n")
        return F.concat(F.regexp_replace(lines, "<[a-zA-Z/!?][^>]*>", ""), rest)

    # One element, so that the text is worked out once though it is named several times.
    out = F.transform(F.array(out), untagged)[0]
    for name, value in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(value))
    # White space around a line's end, beginning at the first space of its run.
    out = F.regexp_replace(out, "(?: (?<! {2}) *+)?+\n[ \n]*", "\n")
    return F.trim(out, F.lit(" \n"))


def record_id(kind: str, *parts: Column) -> Column:
    """A urn:uuid from a record's kind and content."""
    digest = F.md5(F.concat_ws("\n", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    cut = [F.substr(digest, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of fetched pages (page_id, url, html). Null html is an empty payload."""
    payload = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        "page_id",
        record_id("response", F.col("page_id"), F.col("url"), payload).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        head.alias("http_headers"),
        payload.alias("payload"),
    )


def _header(name: str, value: Column) -> Column:
    """A header line; none where the value is null. Line breaks in values become spaces."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\\r\\n]+", " "), F.lit("\r\n"))


def derive(source: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A metadata and a conversion record for every response record, as rows.

    Columns: ``keep``, record_type, record_id, refers_to, target_uri, date, content_type,
    block_digest, payload_digest (of the source's payload), content_length (bytes), block, and
    record: the whole as WARC/1.1 text. Null URIs leave their header out; empty payloads give
    empty conversions; repeated responses give repeated records. A kept column that bears one of these names,
    or a name of a response's own column, is called ``source_`` and its name.
    """
    kept = {c: f"source_{c}" if c in NAMES else c for c in keep}
    source = source.select(*[F.col(quoted(c)).alias(name) for c, name in kept.items()], *RESPONSE)
    keep = tuple(map(quoted, kept.values()))
    based = source.withColumns({"text": plain_text(F.col("payload")), "payload_digest": sha256(F.col("payload"))})
    fields = F.concat(
        F.lit("via: "), F.coalesce(F.regexp_replace("target_uri", "[\\r\\n]+", " "), F.lit("")), F.lit("\r\nsource-record: "), F.col("record_id"),
        F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"), F.lit("\r\nsource-length: "), F.octet_length("payload").cast("string"),
        F.lit("\r\nsource-http-headers: "), F.replace(F.rtrim(F.replace(F.col("http_headers"), F.lit("\r\n"), F.lit(" "))), F.lit("\r"), F.lit("")),
        F.lit("\r\ntext-length: "), F.octet_length("text").cast("string"), F.lit("\r\ntitle: "),
        plain_text(F.regexp_extract("payload", "(?is)<title[^>]*>(.*?)</title|<title.*", 1)), F.lit("\r\n"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), record_id("metadata", F.col("record_id")).alias("id"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), record_id("conversion", F.col("record_id")).alias("id"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    rows = based.select(*keep, F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.inline(kinds))
    rows = rows.withColumnRenamed("id", "record_id").withColumns({"block_digest": sha256(F.col("block")), "content_length": F.octet_length("block").cast("long")})
    names = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"))
    head = F.concat(F.lit("WARC/1.1\r\n"), *(F.coalesce(_header(n, F.col(c)), F.lit("")) for n, c in names), F.lit(f"Software: {SOFTWARE}\r\nContent-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"))
    return rows.withColumn("record", F.concat(head, F.col("block"), F.lit("\r\n\r\n"))).select(*keep, "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "payload_digest", "content_length", "block", "record")
