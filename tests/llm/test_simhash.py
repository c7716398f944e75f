import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES
from trustdesk.llm import simhash
from trustdesk.llm.common import table
from trustdesk.llm.components import components
from trustdesk.llm.queries import QUERIES


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split() if w]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance=4):
    """fps: id -> unsigned fingerprint."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array([fps[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= distance):
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query(spark, sf_dir, shared):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps)
    got = QUERIES["op1_simhash"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]


def clustered(seed, n, size):
    """Fingerprints in dense balls, so that values are crowded and chains of links occur."""
    rng = np.random.default_rng(seed)
    out = []
    for centre in rng.integers(0, 2**63, n, dtype=np.uint64):
        for _ in range(size):
            flips = rng.choice(64, rng.integers(0, 8), replace=False)
            out.append(int(centre) ^ sum(1 << int(b) for b in flips))
    return out


@pytest.mark.parametrize("crowd", [2, 1000])
def test_all_links_are_found_in_dense_groups(spark, shared, crowd):
    values = sorted(set(clustered(3, 6, 60)))
    fps = dict(enumerate(values))
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    edges = simhash.links(df, 4, crowd)
    root = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in components(edges).collect()}
    want = brute_components(fps)
    groups = {}
    for i, v in fps.items():
        groups.setdefault(want[i], set()).add(root.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("rows", [10, 10**6, 10**9, 10**12])
def test_thresholds_keep_the_principle(rows):
    plan = simhash.allocate(rows, np.full((64, 64), rows // 4) + np.diag(np.full(64, rows // 4)), 4)
    assert sum(t + 1 for _, t in plan) == 5
    bits = [b for g, _ in plan for b in g]
    assert len(bits) == len(set(bits))


def test_plan_follows_size():
    both = lambda n: np.full((64, 64), n // 4) + np.diag(np.full(64, n // 4))
    assert len(simhash.allocate(10**10, both(10**10), 4)) < len(simhash.allocate(10**5, both(10**5), 4))


def test_edges_and_extra_columns(spark, edges, shared):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(edges).collect()}
    assert len(got) == len(EDGES)
    want = brute_components({i + 1: brute_fingerprint(t) for i, t in enumerate(EDGES)})
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert got[1]["fp"] == got[2]["fp"] == 0
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_repeated_and_missing_ids(spark, shared):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "quite other words"), (None, "third text here")],
                               "doc_id long, text string")
    found = simhash.near_duplicates(df).collect()
    assert len(found) == 5
    assert [r["component_id"] for r in found if r["doc_id"] == 1] == [1, 1]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(df).collect())
    assert (1, "a b") in kept and (2, "quite other words") in kept and len([k for k in kept if k[1] == "a b"]) == 1


def test_clean_rows_of_repeated_and_missing_ids_stay(spark, shared):
    rows = [(1, "a b"), (None, "a b"), (None, "third text here"), (None, "fourth text of its own"), (5, "a b"),
            (5, "fifth text is no copy"), (6, "one of two texts"), (6, "quite another sixth"), (7, "same row"), (7, "same row")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(df).collect()))
    assert got == [(0, "fourth text of its own"), (0, "third text here"), (1, "a b"), (5, "fifth text is no copy"),
                   (6, "one of two texts"), (6, "quite another sixth"), (7, "same row")]


def test_empty(spark, empty, shared):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_long_chain(spark, shared):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (1, 0)], "u long, v long")
    found = components(edges.orderBy(F.rand(1)))
    assert {(r["node"], r["root"]) for r in found.collect()} == {(i, 0) for i in range(n + 1)}
