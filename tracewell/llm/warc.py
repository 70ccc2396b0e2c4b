"""WARC derivatives: metadata and plain-text conversion records of archived responses."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"
RESPONSE = "response_id string, target_uri string, warc_date string, content_type string, payload string, payload_digest string"
RECORD = (
    "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "source_content_type string, source_payload_digest string, block_digest string, content_length long, block string"
)

_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_BREAKS = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)(?:[\s/][^<>]*)?>", re.I)
# a tag ends at the first > outside quotes; an unfinished one is text
_TAG = re.compile(r"<[a-zA-Z/!?](?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+>|<[a-zA-Z/!?][^<>]*>")
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_CHARSET = re.compile(r"<meta\b[^>]*?\bcharset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
# control characters and the line ends of Unicode
_CONTROL_CHARS = "".join(map(chr, [*range(32), *range(127, 160), 0x2028, 0x2029]))
_CONTROL = re.compile(f"[{_CONTROL_CHARS}]")
_HREF = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1('\x00'.join(parts).encode()).digest()[:16], version=5)}>"


def _tidy(text: str) -> str:
    return " ".join(html.unescape(text).split())


def plain_text(page: str) -> str:
    """Visible text, a line per block element, without scripts, styles, comments and the title."""
    body = _TAG.sub("", _BREAKS.sub("\n", _DROPPED.sub(" ", page)))
    return "\n".join(line for line in (_tidy(x) for x in body.split("\n")) if line)


def one_line(value: str) -> str:
    """A field value that cannot end its line: control characters in percent notation."""
    return _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def metadata_fields(page: str, uri: str) -> str:
    """warc-fields block: what the page says of itself and every link target once, in order."""
    visible = _DROPPED.sub(" ", page)
    fields = [("title", _tidy(_TAG.sub("", m[1]))) for m in [_TITLE.search(page)] if m]
    fields += [("language", m[1].lower()) for m in [_LANG.search(visible)] if m]
    fields += [("charset", m[1].lower()) for m in [_CHARSET.search(visible)] if m]
    links = dict.fromkeys(_tidy("".join(groups)) for groups in _HREF.findall(visible))
    for link in links:
        try:
            fields.append(("outlink", urljoin(uri, link)))
        except ValueError:
            fields.append(("outlink", link))
    return "".join(f"{name}: {one_line(value)}\r\n" for name, value in fields)


def responses_from_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html", date: str = DATE) -> DataFrame:
    """Pages seen as archived responses, with record id and payload digest; ``page_id`` is kept.

    A null url or body is an empty one. The id is made of url and digest: equal captures are equal.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri, payload in zip(batch.column(1), batch.column(2)):
                uri, payload = uri.as_py() or "", payload.as_py() or ""
                check = digest(payload.encode("utf-8", "replace"))
                rows.append((record_id("response", uri, check), uri, date, "text/html", payload, check))
            columns = list(zip(*rows)) if rows else [[]] * 6
            names = ["page_id", *[x.split()[0] for x in RESPONSE.split(", ")]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns]], names=names)

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url), F.col(body)).mapInArrow(build, f"page_id long, {RESPONSE}")


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    for batch in batches:
        rows, at = [], []
        for i in range(batch.num_rows):
            source, uri, date, kind, payload, check = (batch.column(c)[i].as_py() or "" for c in [x.split()[0] for x in RESPONSE.split(", ")])
            check = check or digest(payload.encode("utf-8", "replace"))
            for record_type, content_type, block in (
                ("metadata", "application/warc-fields", metadata_fields(payload, uri)),
                ("conversion", "text/plain; charset=utf-8", plain_text(payload)),
            ):
                raw = block.encode("utf-8", "replace")
                rows.append((record_type, record_id(record_type, source, digest(raw)), source, uri, date, content_type, kind, check, digest(raw), len(raw), block))
                at.append(i)
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        arrays = [pa.array(c, pa.int64() if n == "content_length" else pa.string()) for n, c in zip(names, columns)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(at, pa.int64())), *arrays], names=["page_id", *names])


def derivatives(responses: DataFrame) -> DataFrame:
    """One metadata and one conversion record per response, linked to it by ``refers_to``.

    ``responses``: page_id and the columns of ``responses_from_pages``. Target, date, content type
    and payload digest of the source are kept; a missing digest is computed. Null values count as
    empty ones, a null page_id stays null, repeated responses give repeated records with equal ids.
    Each response is read alone, so there is no shuffle. Other columns are not read.
    """
    names = ["page_id", *[x.split()[0] for x in RESPONSE.split(", ")]]
    return responses.select(*names).mapInArrow(_derive, f"page_id long, {RECORD}")


def serialized(records: DataFrame) -> DataFrame:
    """(record): each record as WARC/1.1 text, without the line end that the text sink adds.

    Control characters in a header value, line ends among them, are written in percent notation.
    """
    shown = lambda value: reduce(lambda v, c: F.replace(v, F.lit(c), F.lit(one_line(c))), _CONTROL_CHARS, value)
    safe = lambda value: F.when(value.rlike(f"[{_CONTROL_CHARS}]"), shown(value)).otherwise(value)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), safe(F.coalesce(value, F.lit(""))), F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Refers-To-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To-Date", F.col("warc_date")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Source-Content-Type", F.col("source_content_type")),
        line("WARC-Source-Payload-Digest", F.col("source_payload_digest")),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")),
    )
    return records.select(F.concat(head, F.lit("\r\n"), F.col("block"), F.lit("\r\n")).alias("record"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Part files of whole records below ``path``, by Spark's text sink on any storage it reaches."""
    serialized(records).write.option("lineSep", "\r\n").option("compression", compression).text(path)
