import collections
import hashlib
import random

import pytest
import regex
import xxhash

from tests.llm.conftest import EDGES
from trustdesk.llm import imatch
from trustdesk.llm.common import table
from trustdesk.llm.queries import QUERIES


def edited_texts(rows):
    """rows: (id, text); id -> (edited text, next id), by sorting them all."""
    line = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = {}
    for k, (i, t) in enumerate(line):
        after = line[(k + 1) % len(line)]
        third = len(t) // 3
        out[i] = t[:len(t) - third] + after[1][:third], after[0]
    return out


def signs(text):
    return dict((s[:2], s[2:]) for s in text.split(".")) if text else {}


def brute_likeness(a, b):
    a, b = signs(a), signs(b)
    either = set(a) | set(b)
    return sum(a.get(k) == b.get(k) for k in either) / len(either) if either else 1.0


@pytest.mark.parametrize("rows", [2048, 7])
def test_query(spark, sf_dir, monkeypatch, rows):
    monkeypatch.setattr(imatch.with_next, "__defaults__", (rows,))
    texts = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    want = edited_texts(texts)
    got = {r["doc_id"]: r for r in QUERIES["op8_imatch"](spark, sf_dir).collect()}
    assert len(got) == len(texts)
    better = 0
    for i, t in texts:
        r = got[i]
        edited, after = want[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - brute_likeness(r["fingerprint"], r["edited_fingerprint"])) < 1e-9
        assert abs(r["near_next"] - brute_likeness(r["fingerprint"], got[after]["fingerprint"])) < 1e-9
        better += r["near_edited"] > r["near_next"]
    assert better / len(texts) > 0.9
    same = {}
    for i, t in texts:
        assert same.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_lexicon_keeps_the_band(docs_of):
    df = docs_of([f"common rare own{i}" if i < 2 else f"common mid own{i}" if i < 6 else f"common only{i}" for i in range(20)])
    assert imatch.lexicon(df, least=0.0, most=0.2).count() == 2
    assert imatch.lexicon(df, least=0.2, most=0.2).count() == 1
    assert imatch.lexicon(df, least=0.0, most=1.0).count() == 3


def test_edges(spark, edges, empty, docs_of):
    got = {r["doc_id"]: r for r in imatch.against_edits(edges, least=0.0, most=1.0).collect()}
    want = edited_texts([(i + 1, t) for i, t in enumerate(EDGES)])
    for i, t in enumerate(EDGES):
        assert got[i + 1]["edited"] == want[i + 1][0] and got[i + 1]["n_chars"] == len(t or "")
    assert got[7]["fingerprint"] == got[8]["fingerprint"] != "" and got[1]["fingerprint"] == ""
    assert imatch.against_edits(empty).count() == 0
    alone = imatch.against_edits(docs_of(["abcdef"])).collect()
    assert alone[0]["edited"] == "abcdab"


def test_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "aaa"), (1, "bbb"), (None, "ccc"), (7, "ddd"), (7, "ddd")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["edited"]) for r in imatch.against_edits(df).collect())
    assert got == [(0, "ccd"), (1, "aab"), (1, "bbc"), (7, "dda"), (7, "ddd")]


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def brute_terms(text):
    """Distinct term hashes of a text."""
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    return {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words}


def chained(terms):
    value = 42
    for t in sorted(terms):
        value = xxhash.xxh64_intdigest(t.to_bytes(8, "little", signed=True), value)
    return value & 0xFFFFFFFF


def folded(terms):
    """The hash of the first term, then that of each hash and the next term."""
    def of(*numbers):
        value = 42
        for n in numbers:
            value = xxhash.xxh64_intdigest(n.to_bytes(8, "little", signed=True), value)
        return signed(value)

    first, *rest = sorted(terms)
    value = of(first)
    for t in rest:
        value = of(value, t)
    return value & 0xFFFFFFFF


def member(t, k):
    return ((t >> 32) % imatch.SUBSETS + k * (1 + (t >> 44 & 0xFFF) % (imatch.SUBSETS - 1))) % imatch.SUBSETS


def brute_lexicon(texts, least=imatch.LEAST, most=imatch.MOST):
    different = set(texts)
    n = collections.Counter(t for text in different for t in brute_terms(text))
    return {t for t, k in n.items() if k >= 2 and least * len(different) <= k <= most * len(different)}


def brute_fingerprint(text, lexicon):
    found = brute_terms(text)
    if not found:
        return ""
    subsets = collections.defaultdict(set)
    for t in found & lexicon:
        for k in range(imatch.EACH):
            subsets[member(t & ((1 << 64) - 1), k)].add(t)
    return ".".join([*(f"{s:02x}{folded(x):08x}" for s, x in sorted(subsets.items())), f"{imatch.SUBSETS:02x}{chained(found):08x}"])


def test_against_brute_force(spark, sf_dir):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    lexicon = brute_lexicon([t for _, t in texts])
    found = {r["term"] for r in imatch.lexicon(table(spark, sf_dir, "documents")).collect()}
    assert found == lexicon and len(lexicon) > 100
    want = edited_texts(texts)
    got = {r["doc_id"]: r for r in QUERIES["op8_imatch"](spark, sf_dir).collect()}
    for i, t in texts:
        assert got[i]["fingerprint"] == brute_fingerprint(t, lexicon)
        assert got[i]["edited_fingerprint"] == brute_fingerprint(want[i][0], lexicon)


def test_an_edited_text_has_the_fingerprint_of_the_document_with_that_text(spark):
    """Whatever its original was like: document 1 becomes the text of document 5."""
    rows = [(0, "zz" * 30), (1, "one two " + "abc " * 3 + "tail of it"), (2, "w3 w4 w5 w6 w7 w8 w9")]
    edited = edited_texts(rows)
    rows.append((5, edited[1][0]))
    rows += [(10 + i, f"one two abc tail w{i % 9}") for i in range(30)]
    assert edited_texts(rows)[1][0] == edited[1][0]
    got = {r["doc_id"]: r for r in imatch.against_edits(spark.createDataFrame(rows, "doc_id long, text string"), most=1.0).collect()}
    assert got[1]["edited_fingerprint"] == got[5]["fingerprint"] != got[1]["fingerprint"]


def test_likeness_has_no_cliff(spark):
    """One word of twenty changed costs about the signatures of that word, with few terms in the lexicon as with many."""
    base = [f"w{k}" for k in range(20)]
    for banded in (20, 8, 7, 3):
        rows = [(1, " ".join(base)), (0, " ".join([*base[:19], "other"]))]
        rows += [(10 + i, " ".join(base[:banded])) for i in range(2)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: r for r in imatch.against_edits(df, least=0.0, most=1.0).collect()}
        assert got[1]["near_next"] > 0.6


def test_a_third_of_copies(spark):
    """Copies push no terms out of the lexicon."""
    usual = [" ".join(f"w{(i * 7 + k * k) % 220}" for k in range(14)) + f" own{i}" for i in range(40)]
    copy = " ".join(f"w{k * 8}" for k in range(26)) + " end"
    odd = [" ".join(f"odd{j}x{k}" for k in range(30)) for j in range(2)]
    texts = [*usual, *odd, *[copy] * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lexicon = brute_lexicon(texts)
    assert {r["term"] for r in imatch.lexicon(df).collect()} == lexicon
    assert len(lexicon & brute_terms(copy)) >= 10
    got = {r["doc_id"]: r for r in imatch.against_edits(df).collect()}
    assert {got[i]["fingerprint"] for i in range(42, 62)} == {brute_fingerprint(copy, lexicon)}
    assert got[41]["near_next"] < 0.2                                       # two texts of words of their own


def test_many_repeated_texts_are_joined(spark, monkeypatch):
    texts = [f"word{i % 7} other{i % 5} more{i % 3}" for i in range(60)] + [f"word{i % 7} own{i}" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bound in (imatch.REPEATED, 0):
        monkeypatch.setattr(imatch, "REPEATED", bound)
        assert {r["term"] for r in imatch.lexicon(df, most=0.5).collect()} == brute_lexicon(texts, most=0.5)


def test_sub_lexicons_overlap():
    rng = random.Random(1)
    terms = [rng.getrandbits(64) for _ in range(4000)]
    members = [{member(t, k) for k in range(imatch.EACH)} for t in terms]
    assert all(len(m) == imatch.EACH for m in members)
    sizes = collections.Counter(s for m in members for s in m)
    assert len(sizes) == imatch.SUBSETS and max(sizes.values()) < 3 * min(sizes.values())


def test_plan_is_native(spark, sf_dir):
    plan = imatch.against_edits(table(spark, sf_dir, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan
