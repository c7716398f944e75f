import hashlib

import corpus_pipeline as pipeline
import numpy as np
import pytest

from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_suffix_dedup import brute as brute_repeats
from trustdesk.llm import decontam
from trustdesk.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_cut(text, hit):
    """Text without its hit words and what stands between neighbouring ones."""
    import re

    raw = text.encode()
    at = [m.span() for m in re.finditer(decontam.WORD, raw.lower())]
    mask = np.zeros(len(raw), bool)
    for k in hit:
        mask[at[k][0]:at[k + 1][0] if k + 1 in hit else at[k][1]] = True
    return bytes(np.frombuffer(raw, np.uint8)[~mask]).decode()


def brute(docs, items):
    """Rows after each stage but the last two columns' worth of work, from ``{doc_id: text}``."""
    root = brute_components({i: brute_fingerprint(t) for i, t in docs.items()})
    docs = {i: t for i, t in docs.items() if root[i] == i}
    masks = brute_repeats([(i, t.encode()) for i, t in docs.items()])
    cut = {i: bytes(np.frombuffer(t.encode(), np.uint8)[~masks[i]]).decode("utf-8", "ignore") for i, t in docs.items()}
    docs = {i: t for i, t in cut.items() if t.strip(" ") or not masks[i].any()}
    hits = brute_hits(list(docs.values()), items)
    docs = {i: brute_cut(t, hit) for (i, t), (_, hit, _) in zip(docs.items(), hits, strict=True)}
    return docs


def test_against_brute_force(spark, sf_dir, shared):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    first = pipeline.language(spark, table(spark, sf_dir, "documents"), sf_dir)
    assert first.columns == COLUMNS
    kept = {r["doc_id"] for r in first.collect()}
    assert all(not any(c.isalpha() for c in docs[i]) for i in set(docs) - kept)
    want = brute({i: docs[i] for i in kept}, items)
    got = {r["doc_id"]: r for r in pipeline.run(spark, sf_dir).collect()}
    assert set(got) == {i for i, t in want.items() if t.strip(" ")}
    for i, r in got.items():
        assert r["text_sha256"] == hashlib.sha256(want[i].encode()).hexdigest() and r["round_trip"]


@pytest.mark.parametrize("stage", pipeline.STAGES[:-1])
def test_stages_keep_columns_and_clean_documents(spark, sf_dir, shared, stage):
    name, function = stage
    clean = [(i, f"Document {i} speaks of number {i * 7919} and of {'abcdefghij'[i % 10] * 5} things alone.", "en", "s", 5, None, i)
             for i in range(12)]
    df = spark.createDataFrame(clean, "doc_id long, text string, lang string, source string, n_chars long, spans int, fp long")
    out = function(spark, df, sf_dir)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == sorted(clean), name
    assert function(spark, df.where("false"), sf_dir).count() == 0


def test_decisions_take_effect(spark, sf_dir, shared):
    passage = " ".join(f"word{i} shared{i * 7}" for i in range(30))
    item = table(spark, sf_dir, "benchmark").first()["text"]
    rows = [(1, "one own text. " + passage, "en", "s", 1), (2, "some other start. " + passage + " end", "en", "s", 1),
            (3, "12345 !!", "en", "s", 1), (4, "before " + item + " after", "en", "s", 1), (5, passage, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert 3 not in {r["doc_id"] for r in pipeline.language(spark, df, sf_dir).collect()}
    copies = spark.createDataFrame([*rows, (9, rows[0][1], "en", "s", 1)], df.schema)
    kept = {r["doc_id"] for r in pipeline.near_copies(spark, copies, sf_dir).collect()}
    assert 9 not in kept and {1, 3, 4} <= kept
    cut = {r["doc_id"]: r for r in pipeline.passages(spark, df, sf_dir).collect()}
    assert cut[1]["text"] == rows[0][1] and passage not in cut[2]["text"] and 5 not in cut
    assert cut[2]["text"].startswith("some other star") and cut[2]["text"].endswith(" end")
    assert cut[2]["n_chars"] == len(cut[2]["text"])
    clean = {r["doc_id"]: r["text"] for r in pipeline.test_data(spark, df, sf_dir).collect()}
    assert clean[1] == rows[0][1] and item not in clean[4] and clean[4].startswith("before ")
