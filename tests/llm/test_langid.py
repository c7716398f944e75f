import zlib
from collections import Counter

from trustdesk.llm import langid
from trustdesk.llm.common import table
from trustdesk.llm.queries import QUERIES


def brute_grams(text):
    words, word = [], ""
    for c in text.lower():
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    words += [word] if word else []
    out = Counter()
    gapped = "\0" + "\0".join(words) + "\0"
    for n in (1, 2, 3):
        for i in range(len(gapped) - n + 1 if words else 0):
            g = gapped[i:i + n]
            if g != "\0" and not (n == 3 and g[1] == "\0"):
                out[g] += 1
    return out


def ranked(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))][:langid.PROFILE]


def brute_predict(profiles, text):
    mine = ranked(brute_grams(text or ""))
    if not mine:
        return "und", 0.0
    def off(p):
        place = {g: i for i, g in enumerate(p)}
        return sum(abs(place[g] - i) if g in place else langid.PROFILE for i, g in enumerate(mine))
    best = min(sorted(profiles), key=lambda name: off(profiles[name]))
    return best, 1 - off(profiles[best]) / (langid.PROFILE * len(mine))


def test_query_against_brute_force_and_held_out(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in docs}
    counts = {}
    for r in docs:
        if not held[r["doc_id"]]:
            counts.setdefault(r["lang"], Counter()).update(brute_grams(r["text"]))
    profiles = {name: ranked(c) for name, c in counts.items()}
    got = {r["doc_id"]: r for r in QUERIES["op2_language_id"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    right = 0
    for r in docs:
        g = got[r["doc_id"]]
        assert g["held_out"] == held[r["doc_id"]]
        name, score = brute_predict(profiles, r["text"])
        assert g["lang_pred"] == name and abs(g["score"] - score) < 1e-9
        right += name == r["lang"]
    assert right / len(docs) > 0.97


def test_edges(edges, empty):
    profiles = langid.train(edges)
    assert set(profiles) == {"en"}
    got = {r["doc_id"]: r for r in langid.predict(edges, profiles).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[5]["lang_pred"] == "en"
    assert got[5]["score"] == got[6]["score"]
    assert langid.train(empty) == {} and langid.predict(empty, profiles).count() == 0
    assert {r["lang_pred"] for r in langid.predict(edges, {}).collect()} == {"und"}


def test_large_alphabets_count_alike():
    text = "".join(chr(0x4E00 + i * 7 % 5000) for i in range(3000))
    keys, counts = langid.count_ngrams(langid.codes(text))
    want = brute_grams(text)
    assert counts.sum() == sum(want.values()) and len(keys) == len(want)
