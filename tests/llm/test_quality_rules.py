import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES
from trustdesk.llm import hash_arrays, quality_rules as rules
from trustdesk.llm.common import table
from trustdesk.llm.queries import QUERIES

N = rules.ORDER


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for k in range(3)}
    earlier, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in earlier
            earlier.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(hit), n < 50 or 100 * len(hit) > 50 * n)


def symbols(text):
    words = (text or "").encode().split()
    return [255] * (N - 1) + list(b" ".join(words)) + [254] if words else []


def kneser_ney(texts):
    """A function from context and symbol to probability, counted one symbol at a time."""
    top = collections.Counter(tuple(s[i:i + N]) for s in map(symbols, texts) for i in range(len(s) - N + 1))
    counts = {N: top}
    for k in range(N - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    off = {}
    for k, c in counts.items():
        n = [sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            off[k] = [0] + [min(max(j - (j + 1) * y * n[j] / n[j - 1], 0), j) for j in (1, 2, 3)]
        else:
            off[k] = [0, 0.5, 1.0, 1.5]
    after = {k: collections.defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            after[k][g[:-1]].append(v)

    def probability(g):
        if not g:
            return 1 / 256
        k, below = len(g), probability(g[1:])
        seen = after[k].get(g[:-1])
        if not seen:
            return below
        own = counts[k][g]
        mass = sum(off[k][min(v, 3)] for v in seen)
        return (max(own - off[k][min(own, 3)], 0) + mass * below) / sum(seen)

    return probability


def brute_bits(docs):
    """docs: (fold, text) in order."""
    other = [kneser_ney([t for f, t in docs if f == 1 - which]) for which in (0, 1)]
    out = []
    for f, t in docs:
        s = symbols(t)
        logs = [math.log2(other[f](tuple(s[i:i + N]))) for i in range(len(s) - N + 1)]
        out.append(-sum(logs) / len(logs) if logs else None)
    return out


def brute_bands(rows):
    """rows: language, text, bits, failed; the band of each language."""
    groups = collections.defaultdict(dict)
    for lang, text, bits, failed in rows:
        if not failed:
            groups[lang][text] = math.floor(bits * rules.STEPS)
    out = {}
    for lang, texts in groups.items():
        steps = sorted(texts.values())
        q1, q3 = (steps[math.ceil(len(steps) * k / 4) - 1] for k in (1, 3))
        wide = rules.FENCE * max((q3 - q1) / rules.STEPS, rules.SPREAD)
        out[lang] = q1 / rules.STEPS - wide, (q3 + 1) / rules.STEPS + wide
    return out


@pytest.mark.parametrize("bound", [hash_arrays.BOUND, 0])
def test_against_brute_force(spark, sf_dir, shared, bound):
    """Both ways of looking up, on the documents of fewest characters and odd ones."""
    docs = table(spark, sf_dir, "documents").where("n_chars < 1500").unionByName(
        spark.createDataFrame([(9001 + i, t, None, "s", 0) for i, t in enumerate(EDGES[:-2])],
                              "doc_id long, text string, lang string, source string, n_chars long"))
    rows = docs.select("*", rules.fold().alias("fold")).collect()
    want = brute_bits([(r["fold"], r["text"]) for r in rows])
    got = {r["doc_id"]: r for r in rules.judge(docs, keep=["doc_id"], bound=bound).collect()}
    assert len(got) == len(rows)
    band = brute_bands([(r["lang"], r["text"], got[r["doc_id"]]["bits"], got[r["doc_id"]]["base_failed"]) for r in rows])
    for r, bits in zip(rows, want, strict=True):
        mine = got[r["doc_id"]]
        assert tuple(mine[n] for n in rules.RULES.names[:6]) == brute_rules(r["text"])
        if bits is None:
            assert mine["bits"] is None and mine["perplexity"] is None and not mine["kept"]
            continue
        assert mine["bits"] == pytest.approx(bits, abs=1e-4) and mine["perplexity"] == pytest.approx(2 ** mine["bits"])
        if r["lang"] in band:
            assert (mine["lower"], mine["upper"]) == pytest.approx(band[r["lang"]])
            assert mine["kept"] == (not mine["base_failed"] and mine["lower"] <= mine["bits"] <= mine["upper"])
        else:
            assert mine["lower"] is None and not mine["kept"]


def test_word_rules_over_whole_table(spark, sf_dir, shared):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    got = QUERIES["op11_quality_rules"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[n] for n in rules.RULES.names[:6]) == brute_rules(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def test_bands_reject_what_reads_otherwise(spark, sf_dir, shared):
    """A text in other letters falls out of the band of its language, one of few words by the rules; prose stays."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en' and not text rlike '[#*$%&|<>0-9]'").select("doc_id", "text", "lang")
    some = docs.where(F.size(F.split("text", " ")) > 80)
    mixed = some.limit(1).select((F.col("doc_id") + 10000).alias("doc_id"), F.translate(
        "text", "abcdefghijklmnopqrstuvwxyz", "qxzjkvwpygfbmucldrhsnioate").alias("text"), "lang")
    same = docs.limit(1).select((F.col("doc_id") + 20000).alias("doc_id"), F.repeat(F.lit("n o t "), 100).alias("text"), "lang")
    got = rules.judge(docs.unionByName(mixed).unionByName(same), keep=["doc_id"]).collect()
    assert all(r["bits"] > r["upper"] and not r["kept"] for r in got if r["doc_id"] // 10000 == 1)
    assert all(r["base_failed"] and not r["kept"] for r in got if r["doc_id"] // 10000 == 2)
    clean = [r for r in got if r["doc_id"] < 10000 and not r["base_failed"]]
    assert sum(r["kept"] for r in clean) >= 0.95 * len(clean)


def test_edges(edges, empty, shared):
    got = rules.judge(edges)
    assert got.columns == [*edges.columns, *rules.RULES.names, "perplexity", "lower", "upper", "kept"]
    rows = got.collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        assert tuple(r[n] for n in rules.RULES.names[:6]) == brute_rules(r["text"])
    assert len({r["bits"] for r in rows if r["text"] == "word"}) == 1
    assert rules.judge(empty).count() == 0
    assert rules.judge(empty, bound=0).count() == 0


def test_one_text_copied(spark, shared):
    """Copies all lie in one fold, so the other knows none of their n-grams; they do not move the quartiles."""
    df = spark.createDataFrame([(i, "same words " * 40, "en") for i in range(50)], "doc_id long, text string, lang string")
    bits = {r["bits"] for r in rules.judge(df, keep=["doc_id"]).collect()}
    assert len(bits) == 1 and bits.pop() == pytest.approx(8.0)


def test_long_text_in_chunks(spark, shared, monkeypatch):
    docs = ["a few words of the first " * 30, "other words for the second one " * 40, "x"]
    whole = [(rules.ngrams(__import__("numpy").frombuffer(rules.stream(d.encode().split()), "u1"))) for d in docs]
    monkeypatch.setattr(rules, "TOGETHER", 64)
    parts = collections.defaultdict(list)
    for grams, owners in rules.windows(rules.stream(d.encode().split()) for d in docs):
        at = 0
        for i, n in owners:
            parts[i] += grams[at:at + n].tolist()
            at += n
        assert at == len(grams)
    assert [parts[i] for i in range(3)] == [w.tolist() for w in whole]


def test_sorted_hashes():
    import numpy as np

    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    h[:50] = np.arange(50)
    known = hash_arrays.Sorted(h, np.arange(len(h)).reshape(-1, 1) + 1)
    assert (known.find(h)[:, 0] == np.arange(len(h)) + 1).all()
    assert (known.find(h[100:] + np.uint64(1))[:, 0] == 0).all()
