import re

import duckdb
import numpy as np
import pytest

from tests.oracle_check import difference, duck
from trustdesk.llm import decontam
from trustdesk.llm.common import table
from trustdesk.llm.queries import ORACLES, QUERIES

NAME = "op5_decontamination"


def brute_words(text):
    low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items):
    out = []
    for t in texts:
        w = brute_words(t)
        hit, ids = set(), set()
        for name, text in items:
            iw = brute_words(text)
            n = min(10, len(iw))
            for i in range(len(iw) - n + 1 if iw else 0):
                for j in range(len(w) - n + 1):
                    if w[j:j + n] == iw[i:i + n]:
                        hit |= set(range(j, j + n))
                        ids.add(name)
        out.append((len(w), hit, sorted(str(i) for i in ids - {None})))
    return out


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (20, "Short ITEM"), (3, ""), (None, "unnamed words here"),
         (4, None), (1, "one two three four five six seven eight nine ten eleven"), (5, "rep rep rep rep rep rep rep rep rep rep rep rep"),
         (6, "übergröße naïve")]
TEXTS = [None, "", "!!!", "one two three four five six seven eight nine ten", "x two three four five six seven eight nine ten eleven y",
         "short item short, item. Short\nitem!", "here unnamed words here unnamed", "rep " * 50, "rep " * 9, "ÜbergröSSE übergröße NAïVE z",
         "one two three four five six seven eight nine ten eleven " * 40, "item short " * 9000, "\x00one\x00two three"]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block,shard", [(16 << 20, 1 << 20), (60, 40)])
def test_edges(spark, docs_of, bench, block, shard, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_WORDS", shard)
    found = decontam.find(docs_of(TEXTS), bench, block=block)
    got = {r["doc_id"]: r for r in found.collect()}
    assert "odd.name" in found.columns and len(got) == len(TEXTS)
    for i, (n, hit, ids) in enumerate(brute(TEXTS, ITEMS)):
        r = got[i + 1]
        spans = [(s["begin"], s["end"]) for s in r["spans"]]
        assert r["n_words"] == n and {k for a, b in spans for k in range(a, b)} == hit and sorted(r["items"]) == ids, TEXTS[i]
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:])), spans


def test_cut(docs_of, bench):
    cut = decontam.cut(decontam.find(docs_of(["a (Short, item) b", "clean text", None, "short item"]), bench))
    assert [r["text"] for r in cut.orderBy("doc_id").collect()] == ["a () b", "clean text", None, ""]


def test_empty(spark, docs_of, empty, bench):
    assert decontam.find(empty, bench).count() == 0
    none = decontam.find(docs_of(["some words"]), bench.where("false")).collect()
    assert none[0]["spans"] == [] and none[0]["n_words"] == 2


def test_index_against_scan():
    rng = np.random.default_rng(5)
    symbols = rng.integers(0, 4, 3000)
    symbols[-1] = 0
    index = decontam.FMIndex(symbols)
    patterns, lengths = [], []
    for n in (1, 2, 5):
        for _ in range(20):
            patterns.append(np.pad(rng.integers(1, 6, n), (0, 5 - n)))
            lengths.append(n)
    lo, hi = index.search(np.array(patterns), np.array(lengths))
    for p, n, a, b in zip(patterns, lengths, lo, hi, strict=True):
        want = [i for i in range(3000 - n + 1) if (symbols[i:i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, b))) == want


def test_query(spark, sf_dir):
    assert difference(QUERIES[NAME](spark, sf_dir), duck(sf_dir), ORACLES[NAME]) is None


def test_edges_against_sql(spark, docs_of, bench, tmp_path):
    docs_of(TEXTS).drop("odd.name").write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert difference(QUERIES[NAME](spark, str(tmp_path)), con, ORACLES[NAME]) is None


def test_cut_keeps_every_document(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    once = decontam.cut(decontam.find(docs, bench))
    assert once.count() == docs.count()
    before = decontam.find(docs, bench).where("size(spans) > 0").count()
    assert before > 0
