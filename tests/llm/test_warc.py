import base64
import hashlib
from html.parser import HTMLParser

from trustdesk.llm import warc
from trustdesk.llm.common import table
from trustdesk.llm.queries import QUERIES

DATE = "2024-06-30T12:00:00Z"


class Plain(HTMLParser):
    """Text by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.out += ["\n"] if tag in warc.BLOCKS else []

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        self.out += ["\n"] if tag in warc.BLOCKS else []

    def handle_data(self, data):
        self.out += [] if self.skip else [" ".join(("|" + data + "|").split())[1:-1]]


def plain(page):
    p = Plain()
    p.feed(page)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    want = {r["record_id"]: r for r in warc.responses(pages, DATE).collect()}
    html = {r["url"]: r["html"] for r in pages.collect()}
    got = QUERIES["op3_warc_derivatives"](spark, sf_dir).collect()
    assert len(got) == 2 * len(want) and len({r["record_id"] for r in got}) == len(got)
    for r in got:
        page = html[r["target_uri"]]
        assert want[r["refers_to"]]["target_uri"] == r["target_uri"]
        assert r["block_digest"] == sha1(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
        assert r["source_digest"] == sha1(page.encode())
        if r["record_type"] == "conversion":
            assert r["block"] == plain(page)
        else:
            assert f"source-payload-digest: {r['source_digest']}\r\n" in r["block"]
            assert "source-http-content-type: text/html; charset=utf-8\r\n" in r["block"] and "outlink: " in r["block"]


def test_files_give_back_the_records(spark, sf_dir, tmp_path):
    sources = warc.responses(table(spark, sf_dir, "pages"), DATE)
    records = sources.unionByName(warc.derive(sources))
    warc.write(records.repartition(3), f"{tmp_path}/w")
    key = lambda r: r["record_id"]
    back = sorted(warc.read(spark, f"{tmp_path}/w").collect(), key=key)
    for a, b in zip(sorted(records.collect(), key=key), back, strict=True):
        assert a == b


def test_edges(spark, tmp_path):
    page = "<a href='/x?a=1&amp;b'>l</a><a href=y>m</a><a href='http://['>n</a>" + "<p>é " * 40000
    rows = [(1, None, None, 1), (2, "http://h/a\r\nb", "", 2), (3, "http://h/d/", page, 3), (3, "http://h/d/", page, 3),
            (None, "http://h/", "<title>T &lt;\n1</title>\x00<script>x", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, block int")
    made = warc.derive(warc.responses(df, DATE)).collect()
    assert len(made) == 10 and len({r["record_id"] for r in made}) == 8
    text = {(r["target_uri"], r["record_type"]): r["block"].decode() for r in made}
    assert text[None, "conversion"] == "" and "outlink: http://h/x?a=1&b\r\noutlink: http://h/d/y\r\n" in text["http://h/d/", "metadata"]
    assert text["http://h/", "metadata"].startswith("title: T < 1\r\n")
    assert text["http://h/d/", "conversion"].count("é") == 40000
    assert warc.derive(warc.responses(df.where("false"), DATE)).count() == 0
    odd = spark.createDataFrame([(None, "response", "u", None, None, None, None), ("<urn:x>", "request", "u", None, None, None, b"z")], warc.RECORD)
    out = warc.derive(odd).collect()
    assert len(out) == 2 and all(warc.REFERS not in r["headers"] for r in out)
    warc.write(warc.derive(odd), f"{tmp_path}/odd")
    assert warc.read(spark, f"{tmp_path}/odd").count() == 2
