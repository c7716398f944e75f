import hashlib

import numpy as np
import pytest

from tests.llm.conftest import EDGES
from trustdesk.llm import suffix_dedup as sd
from trustdesk.llm.common import table
from trustdesk.llm.queries import QUERIES


def brute(rows, length=100):
    """Removed bytes as a mask, for rows of (id, bytes) with distinct ids."""
    seen, masks = {}, {}
    for d, t in sorted(rows):
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            s = hashlib.blake2b(t[i:i + length], digest_size=12).digest()
            if seen.setdefault(s, (d, i)) != (d, i):
                mask[i:i + length] = True
        masks[d] = mask
    return masks


def spans_of(mask):
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return [tuple(x) for x in edge.reshape(-1, 2).tolist()]


def check(found, rows, length=100):
    got = {r["doc_id"]: [(s["begin"], s["end"]) for s in r["spans"]] for r in found.collect()}
    want = brute(rows, length)
    assert len(got) == len(want)
    for d, mask in want.items():
        assert got[d] == spans_of(mask), d


def planted(seed, n):
    """Texts with shared passages of many lengths, copies with changed letters, and periodic stretches."""
    rng = np.random.default_rng(seed)
    letters = np.frombuffer(b"abcdefghij klmn", np.uint8)
    make = lambda k: letters[rng.integers(0, len(letters), k)].tobytes()
    shared = [make(int(k)) for k in (60, 99, 100, 101, 130, 170, 400, 1000)]
    out = []
    for _ in range(n):
        parts = [make(int(rng.integers(0, 300)))]
        for _ in range(int(rng.integers(0, 4))):
            parts += [shared[int(rng.integers(0, len(shared)))], make(int(rng.integers(0, 120)))]
        if rng.random() < 0.2:
            parts.append(bytes([97 + int(rng.integers(0, 3))]) * int(rng.integers(90, 400)) + b"xyz" * int(rng.integers(20, 90)))
        text = bytearray(b"".join(parts))
        if out and rng.random() < 0.3:
            text = bytearray(out[int(rng.integers(0, len(out)))])
            for _ in range(int(rng.integers(0, 4))):
                if text:
                    text[int(rng.integers(0, len(text)))] = 90
        out.append(bytes(text))
    return out


@pytest.mark.parametrize("size,run,batch,chunk", [(32 << 20, 150_000, 20_000, 1 << 20), (4000, 300, 50, 700)])
def test_planted_passages(spark, shared, monkeypatch, size, run, batch, chunk):
    for name, value in (("RANGE", size), ("RUN", run), ("BATCH", batch), ("CHUNK", chunk)):
        monkeypatch.setattr(sd, name, value)
    rows = list(enumerate(planted(7, 120)))
    df = spark.createDataFrame([(d, t.decode()) for d, t in rows], "doc_id long, text string").repartition(5)
    check(sd.find(df), rows)


def test_torn_grams_meet_by_digest(spark, shared, monkeypatch):
    monkeypatch.setattr(sd, "RANGE", 3000)
    rng = np.random.default_rng(3)
    word = lambda: bytes(rng.integers(97, 123, 150, dtype=np.uint8))
    passage = word()
    rows = [(d, word() + passage + word()) for d in range(60)]
    df = spark.createDataFrame([(d, t.decode()) for d, t in rows], "doc_id long, text string").repartition(4)
    sizes = []
    send = sd.send_digests
    monkeypatch.setattr(sd, "send_digests", lambda *a: sizes.append(len(a[0])) or send(*a))
    check(sd.find(df), rows)
    cuts, torn = sd.splitters(df.selectExpr("doc_id as doc", "0L as tie", "cast(text as binary) as text"), 1.0, 7, 100, 32)
    context = sd.surroundings(rows[0][1], np.arange(len(rows[0][1])), 100, 32)
    keys = np.tile(np.array([5, 0]), (len(context), 1))
    assert len(torn) and list(sd.sort_run(context, keys, np.arange(len(context)), cuts, torn, 100, 32))


def test_loser_tree_keeps_prefixes():
    rng = np.random.default_rng(2)
    runs = []
    for _ in range(7):
        strings = sorted({bytes(rng.integers(97, 99, rng.integers(1, 12), dtype=np.uint8)) for _ in range(40)})
        run, last = [], b""
        for s in strings:
            run.append((sd.common(last, s, 0), s, b"", 0, 0, 0))
            last = s
        runs.append(run)
    out = list(sd.merge([*runs, []]))
    assert [x[1] for x in out] == sorted(s for r in runs for _, s, *_ in r)
    assert all(b[0] == sd.common(a[1], b[1], 0) for a, b in zip(out, out[1:], strict=False))
    assert list(sd.merge([])) == list(sd.merge([[]])) == []


def test_hash_collisions_are_settled_by_bytes(monkeypatch):
    texts = [bytes(np.random.default_rng(i % 3).integers(97, 123, 180, dtype=np.uint8)) for i in range(5)]
    context = np.concatenate([sd.surroundings(t, np.array([70]), 100, 32) for t in texts])
    args = np.zeros(5, np.int64), context, np.array([[i, 0] for i in range(5)]), np.full(5, 70), 100, 32
    want = sd.equal_strings(*args)
    monkeypatch.setattr(sd, "mixed", lambda x: x & np.uint64(0))
    got = sd.equal_strings(*args)
    assert all((a == b).all() for a, b in zip(want, got, strict=True)) and want[0][:, 0].tolist() == [3, 4]


def test_edges_and_extra_columns(spark, edges, shared):
    check(sd.find(edges), [(i + 1, (t or "").encode()) for i, t in enumerate(EDGES)])
    cut = sd.cut_text(sd.find(edges))
    assert set(edges.columns) < set(cut.columns) and cut.where("text is null").count() == 1


def test_repeated_rows_and_missing_ids(spark, shared):
    long = "the quick brown fox jumps over the lazy dog and so on " * 3
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (None, "x" + long), (0, "short")], "doc_id long, text string")
    got = [(r["doc_id"], r["text"], len(r["spans"])) for r in sd.find(df).collect()]
    own = [n for d, t, n in got if d == 1]
    assert own[0] == own[1] and all(n for d, t, n in got if d is None and t == long)


def test_torn_characters_do_not_stay(spark, shared):
    base = "".join(chr(0x3B1 + i % 24) for i in range(77)) * 2
    df = spark.createDataFrame([(1, "a" + base), (2, "é" + base + "€")], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in sd.cut_text(sd.find(df)).collect()}
    assert texts[2] == "é€"


def test_empty(empty, shared):
    assert sd.find(empty).count() == 0


def test_query(spark, sf_dir, shared):
    rows = [(r["doc_id"], r["text"].encode()) for r in table(spark, sf_dir, "documents").collect()]
    want = brute(rows)
    got = {r["doc_id"]: r for r in QUERIES["op6_suffix_dedup"](spark, sf_dir).collect()}
    for d, t in rows:
        mask = want[d]
        kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
        assert tuple(got[d]) == (d, len(t), int(mask.sum()), len(spans_of(mask)), hashlib.sha256(kept).hexdigest())


def gram_group(n, seed=2):
    """Contexts of one gram, some with strings that repeat, in any order."""
    rng = np.random.default_rng(seed)
    before = 68
    context = rng.integers(1, 5, (n, 168)).astype(np.uint8)
    context[:, before:before + 32] = 7
    again = rng.integers(0, n // 2, n // 3)
    shift = rng.integers(0, before + 1, n // 3)
    for row, (other, c) in enumerate(zip(again.tolist(), shift.tolist()), n - n // 3):
        context[row, c:c + 100] = context[other, c:c + 100]
    context[::11, :rng.integers(1, 60)] = 0
    context[5::13, 110:] = 0
    keys = np.stack((rng.permutation(n), np.zeros(n, np.int64)), 1)
    return np.zeros(n, np.int64), context, keys, rng.integers(100, 1000, n)


def test_large_groups_by_distance(monkeypatch):
    made = gram_group(3000)
    small = sd.equal_strings(*made, 100, 32)
    monkeypatch.setattr(sd, "BATCH", 100)
    large = sd.equal_strings(*made, 100, 32)
    assert len(small[0]) > 500
    assert all((np.concatenate([x[0], x[1][:, None], x[2][:, None]], 1) == np.concatenate([y[0], y[1][:, None], y[2][:, None]], 1)).all()
               for x, y in [(small, large)])
    monkeypatch.setattr(sd, "mixed", lambda x: x & np.uint64(0x3F))
    odd = sd.equal_strings(*made, 100, 32)
    assert (odd[0] == small[0]).all() and (odd[1] == small[1]).all() and (odd[2] == small[2]).all()


def test_memory_of_one_gram_in_very_many_contexts():
    import tracemalloc

    made = gram_group(200_000)
    tracemalloc.start()
    found = sd.equal_strings(*made, 100, 32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found[0]) > 40_000 and peak < 6 * made[1].nbytes


def test_memory_of_surroundings():
    import tracemalloc

    text = bytes(range(97, 122)) * 20_000
    places = np.arange(0, 400_000, 5)
    tracemalloc.start()
    got = sd.surroundings(text, places, 100, 32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.shape == (80_000, 168) and peak < 2 * got.nbytes


def sized_groups(sizes, seed=4):
    """Rows of groups of given sizes, mixed, each group with strings that repeat and texts that end."""
    made = [gram_group(n, seed + k) for k, n in enumerate(sizes)]
    group = np.repeat(np.arange(len(sizes)), sizes)
    context = np.concatenate([m[1] for m in made])
    order = np.random.default_rng(seed).permutation(len(group))
    return group[order], context[order], np.stack((np.arange(len(group)), np.zeros(len(group), np.int64)), 1)


def first_and_last(group, context, length=100, before=68):
    """By brute force: lowest and highest distance of a string that an earlier row of the group has."""
    seen, out = set(), []
    for g, row in zip(group.tolist(), context, strict=True):
        strings = [(g, c, row[c:c + length].tobytes()) for c in range(before + 1) if row[c:c + length].all()]
        hit = [c for s in strings for c in [s[1]] if s in seen]
        out.append((min(hit), max(hit)) if hit else (before + 1, -1))
        seen.update(strings)
    return out


@pytest.mark.parametrize("settle", ["by_pairs", "by_hash", "by_distance"])
@pytest.mark.parametrize("bits", [64, 5])
def test_each_way_finds_the_same_strings(monkeypatch, settle, bits):
    monkeypatch.setattr(sd, "BATCH", 50)
    if bits < 64:  # many strings of one hash
        monkeypatch.setattr(sd, "mixed", lambda x: x & np.uint64(2**bits - 1))
    group, context, _ = sized_groups([2, 2, 3, 5, 16, 17, 60, 120])
    lowest, highest = getattr(sd, settle)(group, context, 100, 68)
    want = first_and_last(group, context)
    assert list(zip(lowest.tolist(), highest.tolist(), strict=True)) == want and sum(h >= 0 for _, h in want) > 40


def test_small_groups_need_no_hashes(monkeypatch):
    """Every row was once hashed at each of its 69 distances, though most groups have two rows."""
    group, context, keys = sized_groups([2, 3, sd.PAIRED] * 5)
    want = [w for w in first_and_last(group, context) if w[1] >= 0]
    monkeypatch.setattr(sd, "mixed", None)
    _, begin, end = sd.equal_strings(group, context, keys, np.full(len(keys), 500), 100, 32)
    assert [(b - 500 + 68, e - 500 + 68 - 100) for b, e in zip(begin.tolist(), end.tolist(), strict=True)] == want


def test_common_prefix_of_any_strings():
    rng = np.random.default_rng(6)
    for _ in range(3000):
        a, b = (bytes(rng.integers(0, 2, rng.integers(0, 100), dtype=np.uint8)) for _ in "ab")
        k = int(rng.integers(0, len(a) + 1))
        b = a[:k] + b
        want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        begin = int(rng.integers(0, want + 1))
        assert sd.common(a, b, begin) == sd.common(b, a, begin) == want
