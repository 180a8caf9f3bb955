"""WARC derivatives: each response becomes a metadata and a plain-text conversion record.

Both refer to the response by its record id, keep its target address, date and
payload digest, and carry a digest of their own block; the metadata record also
keeps the source's own headers.  Record id, date and headers are read from columns
where the caller has them.  Without a column for ids, a response is known by a
digest of its id, address and payload; without a date, by the date of no date.
All of it is column expressions over one scan; nothing is shuffled.

Defined results: a null body is an empty payload; a null address gives no address
line; control characters, which could begin a header of their own, are left out
of header values and stay in columns; repeated rows are one response, so they give
its records again under the same ids; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

#: Names of characters in HTML, from the standard library; a space that doesn't break is a space in plain text.
ENTITIES = {name: " " if code == 0xA0 else chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}
REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});"
#: Stands for a date that the source doesn't tell; a record must have one.
NO_DATE = "1970-01-01T00:00:00Z"
_CONTROL = r"[\x00-\x1F\x7F]+"


def _character(name: Column) -> Column:
    """What a reference stands for; null for unknown names, a replacement character for numbers of no character."""
    code = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10).cast("long")).when(name.startswith("#"), F.substr(name, F.lit(2)).cast("long"))
    good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    numbered = F.when(code == 0xA0, " ").when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair]), name)
    return F.when(name.startswith("#"), numbered).otherwise(named)


def resolved(text: Column) -> Column:
    """A text with its character references replaced, once each: what they make is no reference."""
    names = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    pieces = F.zip_with(F.split(text, REFERENCE, -1), names, lambda before, name: F.concat(before, F.when(name.isNull(), "").otherwise(F.coalesce(_character(name), F.concat(F.lit("&"), name, F.lit(";"))))))
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def plain_text(html: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags; runs of white space become one space."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(text.cast("binary")))


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _safe(value: Column) -> Column:
    return F.regexp_replace(value, _CONTROL, "")


def _line(name: str, value: Column) -> Column:
    """A header line; nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), _safe(value), F.lit("\r\n")), F.lit(""))


def _source_lines(df: DataFrame, headers_col: str) -> Column:
    """The source's headers as lines of a metadata block: from a map of names, or from a text of lines with a colon."""
    headers = F.col(headers_col)
    if isinstance(df.schema[headers_col].dataType, MapType):
        pairs = F.array_sort(F.map_entries(headers))
        lines = F.transform(pairs, lambda x: F.concat(x["key"], F.lit(": "), F.coalesce(x["value"], F.lit(""))))
    else:
        lines = F.filter(F.split(headers, "\r?\n", -1), lambda x: x.contains(":"))
    return F.coalesce(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("source-header: "), _safe(x), F.lit("\r\n"))), ""), F.lit(""))


def derivatives(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", record_id_col: str | None = None, date_col: str | None = None, headers_col: str | None = None,
) -> DataFrame:
    """page_id, warc_type, record_id, refers_to, target_uri, payload, block_digest, header and content of two records a response."""
    given = lambda name: F.col(name).cast("string") if name else F.lit(None).cast("string")
    date = F.col(date_col) if date_col else F.lit(None).cast("string")
    if date_col and df.schema[date_col].dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
        date = F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    source = df.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"), given(record_id_col).alias("own"),
        F.coalesce(date, F.lit(NO_DATE)).alias("date"), (_source_lines(df, headers_col) if headers_col else F.lit("")).alias("lines"),
    )
    source = source.withColumn("payload", _digest(F.col("body")))
    source = source.withColumn("refers_to", F.coalesce("own", _record_id(F.lit("response"), F.col("page_id").cast("string"), F.col("target_uri"), F.col("payload"))))
    source = source.withColumn("plain", plain_text(F.col("body")))
    facts = F.concat(_line("content-length", F.octet_length("body").cast("string")), _line("payload-digest", F.col("payload")), F.col("lines"))
    text = F.trim(F.regexp_replace(resolved(F.col("plain")), r"[ \t\r\n]+", " "))
    made = [F.struct(F.lit(kind).alias("warc_type"), F.lit(mime).alias("mime"), block.alias("content")) for kind, mime, block in (("metadata", "application/warc-fields", facts), ("conversion", "text/plain", text))]
    rows = source.select("page_id", "target_uri", "payload", "refers_to", "date", F.explode(F.array(*made)).alias("x")).select("*", "x.*").drop("x")
    rows = rows.withColumn("block_digest", _digest(F.col("content"))).withColumn("record_id", _record_id(F.col("warc_type"), F.col("refers_to"), F.col("block_digest")))
    header = F.concat(
        F.lit("WARC/1.0\r\n"), _line("WARC-Type", F.col("warc_type")), _line("WARC-Record-ID", F.col("record_id")), _line("WARC-Date", F.col("date")), _line("WARC-Refers-To", F.col("refers_to")),
        _line("WARC-Target-URI", F.col("target_uri")), _line("WARC-Block-Digest", F.col("block_digest")), _line("WARC-Payload-Digest", F.col("payload")), _line("Content-Type", F.col("mime")),
        _line("Content-Length", F.octet_length("content").cast("string")), F.lit("\r\n"),
    )
    return rows.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "payload", "block_digest", header.alias("header"), "content")
