import re

import duckdb

from tests.oracle_check import difference, duck
from trustdesk.llm import url_rules
from trustdesk.llm.queries import ORACLES, QUERIES

URLS = [None, "", "no scheme", "http://A.Example.NET/en/x", "http://example.net/en", "http://example.net", "https://Net/",
        "https://notexample.net/en/a?page=1&ref=z", "ftp://x.example.com/de/?q", "http://example.com/DE/", "http://w.org/fr/#a",
        "http://w.org/frx", "http://q.com/cart", "http://q.com/CART?x", "http://q.com/cartoon", "http://q.com/cart/manual",
        "http://q.com/a.exe", "http://q.com/a.exe?b", "http://ads.q.com/", "http://docs.q.com/login/", "x://y://z/p",
        "http://q.com/search?lang=de&q=1", "http://q.com/\nfeed/", "http://q.com/feed/", "http://q.com/feed/", "http://"]


def brute(url):
    url = url or ""
    low = "".join(c.lower() if c < "\x80" else c for c in url)
    fits = lambda p: re.search(url_rules.to_regex(p), low, re.S)
    hit = any(fits(p) for p in url_rules.PATTERNS if p[:2] != "@@")
    return "block" if hit and not any(fits(p) for p in url_rules.PATTERNS if p[:2] == "@@") else "allow"


def test_edges(spark):
    rows = [(i, u, 1, "x") for i, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string, host int, verdict string")
    got = {r["page_id"]: r for r in url_rules.judge(df).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        r = got[i]
        if r["rule"] is None:
            assert r["verdict"] == brute(u), u
    pick = {u: got[i] for i, u in enumerate(URLS)}
    assert pick["http://A.Example.NET/en/x"]["rule"] == "example.net/en/" and pick["http://A.Example.NET/en/x"]["host"] == "a.example.net"
    assert pick["http://example.net/en"]["rule"] == "net/" and pick["http://example.net"]["rule"] is None
    assert pick["https://Net/"]["verdict"] == "block" and pick["https://notexample.net/en/a?page=1&ref=z"]["rule"] == "net/"
    assert pick["ftp://x.example.com/de/?q"]["verdict"] == "block" and pick["http://example.com/DE/"]["rule"] is None
    assert pick["http://w.org/fr/#a"]["rule"] == "org/fr/" and pick["http://w.org/frx"]["rule"] is None
    assert (pick[None]["host"], pick[None]["path"]) == ("", "") and pick["x://y://z/p"]["host"] == "y:"


def test_each_rule_is_found_by_its_token(spark):
    texts = ["http://h/" + p.removeprefix("@@").replace("*", "abc").replace("^", "/").strip("|") for p in url_rules.PATTERNS]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, url string")
    for r in url_rules.judge(df).collect():
        assert r["verdict"] == brute(texts[r["page_id"]]), texts[r["page_id"]]
    by_token, rest = url_rules.index_rules(["/a*b/", "x/rare/common/"], {"rare": 1, "common": 9})
    assert list(by_token) == ["rare"] and len(rest) == 1


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(df).count() == 0 and url_rules.judge(df, [], []).count() == 0


def test_query(spark, sf_dir):
    name = "op9_url_rules"
    assert difference(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLES[name]) is None


def test_edges_against_sql(spark, tmp_path):
    spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = QUERIES["op9_url_rules"](spark, str(tmp_path))
    assert difference(df, con, ORACLES["op9_url_rules"]) is None
