"""WARC derivatives: texts, links between records, digests, and a round trip through files."""

import base64
import gzip
import hashlib
import re
from html.parser import HTMLParser
from pathlib import Path

from tracewell.llm import warc as W


class Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.links, self.hidden = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title", "noscript", "template")
        if tag == "a":
            self.links += [" ".join(v.split()) for k, v in attrs if k == "href" and v is not None]

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title", "noscript", "template")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def test_text_and_links_against_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for page in pages:
        parser = Visible()
        parser.feed(page.html)
        parser.close()
        assert "".join(W.plain_text(page.html).split()) == "".join("".join(parser.parts).split())
        links = re.findall(r"^outlink: (.*)\r$", W.metadata_fields(page.html, ""), re.M)
        assert links == list(dict.fromkeys(parser.links))


def test_text_of_odd_markup():
    cases = {
        "<p>a<b>b</b></p>c": "ab\nc", "a<br>b<BR/>c": "a\nb\nc", "<a title='x>y' href=z>t</a>": "t", "1 < 2 and 3 > 2": "1 < 2 and 3 > 2", "<p>x &amp;lt; &eacute;&#65;": "x &lt; éA",
        "<script>if (a<b) '</p>'</script>t": "t", "<style>p{}": "", "<!-- <p>no</p> -->y<!-- open": "y", "<title>T</title>b": "b", "": "", "<pre>a\n  b</pre>": "a\nb", "a<unfinished": "a<unfinished", "<p class=\"open>x</p>": "x",
    }
    for page, text in cases.items():
        assert W.plain_text(page) == text, page
    assert W.plain_text("<" * 200_000) == "<" * 200_000
    assert W.metadata_fields("<html lang=EN><title>A &amp;\n b</title><meta charset='UTF-8'><a href='/x'>1</a><a href=\"/x\">2</a><a href=http://[>3</a>", "http://h/p") == (
        "title: A & b\r\nlanguage: en\r\ncharset: utf-8\r\noutlink: http://h/x\r\noutlink: http://[\r\n"
    )


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_records_link_to_their_source(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    responses = {r.page_id: r for r in W.responses_from_pages(pages).collect()}
    source = {r.page_id: r for r in pages.collect()}
    records = W.derivatives(W.responses_from_pages(pages)).collect()
    assert len(records) == 2 * len(source) and len({r.record_id for r in records}) == len(records)
    for r in records:
        response = responses[r.page_id]
        assert (r.refers_to, r.target_uri, r.warc_date, r.source_content_type) == (response.response_id, source[r.page_id].url, response.warc_date, "text/html")
        assert r.source_payload_digest == sha(source[r.page_id].html.encode())
        assert r.block_digest == sha(r.block.encode()) and r.content_length == len(r.block.encode())


def test_files_round_trip(spark, folder, tmp_path):
    records = W.derivatives(W.responses_from_pages(spark.read.parquet(f"{folder}/pages.parquet").limit(20)))
    W.write_warc(records, str(tmp_path / "out"))
    got = []
    for part in Path(tmp_path / "out").glob("*.gz"):
        data = gzip.open(part).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            size = int(fields["Content-Length"])
            block, end, data = rest[:size], rest[size : size + 4], rest[size + 4 :]
            assert end == b"\r\n\r\n" and sha(block) == fields["WARC-Block-Digest"]
            got.append((fields["WARC-Type"], fields["WARC-Record-ID"], fields["WARC-Refers-To"], fields["WARC-Source-Payload-Digest"], block.decode()))
    assert sorted(got) == sorted((r.record_type, r.record_id, r.refers_to, r.source_payload_digest, r.block) for r in records.collect())


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://a", "<p>x"), (3, "http://a", "<p>x"), (None, "http://b", "<a href=c>y</a>" * 20_000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, block string")
    records = W.derivatives(W.responses_from_pages(frame)).collect()
    assert len(records) == 10
    twice = [r for r in records if r.page_id == 3]
    assert len({tuple(r) for r in twice}) == 2
    assert [r.block for r in records if r.page_id == 1] == ["", ""]
    meta = [r for r in records if r.page_id is None and r.record_type == "metadata"]
    assert meta[0].block == "outlink: http://b/c\r\n"
    assert W.derivatives(W.responses_from_pages(frame.limit(0))).collect() == []


def test_control_characters_forge_no_header(spark):
    url = "http://a/x\r\nWARC-Type: forged\n\u2028\x85\x00y"
    pages = spark.createDataFrame([(1, url, "<title>t</title><a href='b&#13;&#10;WARC-Type: forged'>z</a>")], "page_id long, url string, html string")
    records = W.derivatives(W.responses_from_pages(pages))
    assert {r.target_uri for r in records.collect()} == {url}
    for (record,) in W.serialized(records).collect():
        head = record.split("\r\n\r\n")[0]
        lines = head.splitlines()
        assert len(lines) == 13 and [x for x in lines if x.startswith("WARC-Type")] == [lines[1]] and "forged" not in lines[1]
        assert "WARC-Target-URI: http://a/x%0D%0AWARC-Type: forged%0A%E2%80%A8%C2%85%00y" in lines
    (meta,) = [r.block for r in records.collect() if r.record_type == "metadata"]
    assert all(x.split(":")[0] in ("title", "outlink") for x in meta.split("\r\n") if x)
