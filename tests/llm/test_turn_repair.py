import collections
import hashlib
import random
import re
import zlib

import pytest

from trustdesk.llm import turn_repair as repair
from trustdesk.llm.common import table
from trustdesk.llm.queries import QUERIES

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    """Rows (conv, turn, role, text) by conversation, after the damage, in order; every conversation is there."""
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def brute_repair(rows, found):
    """Cost, audit and repaired lines by the best (cost, letters) from every row and state, relaxed to the end."""
    n = len(rows)
    big = (10 ** 9, "")
    best = [[big] * 4 for _ in range(n + 1)]
    back = {}
    for i in range(n, -1, -1):
        if i == n:
            best[i][0] = best[i][3] = (0, "")
        else:
            (role, text), fault = rows[i], found[i]
            more = 3 * (fault == "truncated")
            for q in range(4):
                ways = [(4, "D", q, None)]
                if fault not in ("blank", "duplicate"):
                    for name, to in (("user", 2), ("assistant", 3)):
                        if (to == 2) == (q in (0, 1, 3)):
                            ways.append((3 + more, "R", to, (name, text)))
                    to = {"s": 1, "u": 2, "a": 3}.get(role[:1])
                    if to == 1 and q == 0 or to == 2 and q in (0, 1, 3) or to == 3 and q == 2:
                        ways.append((more, "K", to, (role, text)))
                for cost, letter, to, line in ways:
                    new = cost + best[i + 1][to][0], letter + best[i + 1][to][1]
                    if new < best[i][q]:
                        best[i][q], back[i, q] = new, (i + 1, to, line)
        for _ in range(3):
            for q, to, name in ((0, 2, "user"), (1, 2, "user"), (2, 3, "assistant"), (3, 2, "user")):
                new = 3 + best[i][to][0], "I" + best[i][to][1]
                if new < best[i][q]:
                    best[i][q], back[i, q] = new, (i, to, (name, ""))
    lines, at = [], (0, 0)
    while best[at[0]][at[1]] != (0, "") or at[0] < n:
        i, q, line = back[at]
        lines += [line] if line else []
        at = i, q
    return *best[0][0], "\n".join(f"{r}:{t}" for r, t in lines)


def brute(rows):
    out = {}
    for conv, mine in damaged(rows).items():
        found, seen = [], set()
        for _, role, text in mine:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            found.append("blank" if not said else "duplicate" if (role, text) in seen else
                         "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        known = {t for t, *_ in mine if t is not None}
        initials = [r[:1] for _, r, _ in mine]
        cost, audit, text = brute_repair([(r, t) for _, r, t in mine], found)
        if mine:
            assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in text.split("\n") if line)) or "\n" in "".join(t for *_, t in mine)
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, found.count("blank"), found.count("duplicate"),
                     found.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                     cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def random_rows(rng, n, conv):
    said = ["Yes.", "No!", "Cut off", " \t\n", "", "why? ", "Line one.\nline two.", "é. ", None]
    return [(conv, rng.choice([k, k, k, k + 1, None]) if rng.random() < 0.1 else k,
             rng.choice(["user", "assistant", "user", "assistant", "user", "assistant", "system", "tool", "", None, "ai", "unknown"]),
             rng.choice(said) if rng.random() < 0.5 else f"Text {k} of {conv}{rng.choice(['.', '', '?'])}") for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, 7.0) for r in rows],
                                 "conv_id long, turn long, role string, text string, audit string, cost int, gaps double")


def results(df):
    assert df.columns == COLUMNS
    rows = df.collect()
    got = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(11)
    rows = [r for c in range(150) for r in random_rows(rng, rng.randrange(1, 12), c)]
    rows += [r for c in range(150, 158) for r in random_rows(rng, rng.randrange(30, 90), c)]
    rows += random_rows(rng, 9, None) + [rows[3], rows[3], rows[7]]
    return rows


def test_against_brute_force(spark, shared, mixed):
    assert results(repair.repair(frame(spark, mixed))) == brute(mixed)


def test_large_conversations_against_brute_force(spark, shared, mixed, monkeypatch):
    """The same conversations cut into segments of a few rows, through all steps of large ones."""
    monkeypatch.setattr(repair, "LARGE", 4)
    monkeypatch.setattr(repair, "SEGMENT", 3)
    monkeypatch.setattr(repair, "WINDOW", 2)
    assert results(repair.repair(frame(spark, mixed))) == brute(mixed)


def test_one_very_long_conversation(spark, shared):
    rng = random.Random(5)
    rows = random_rows(rng, 6000, 1) + random_rows(rng, 5, 2)
    assert results(repair.repair(frame(spark, rows))) == brute(rows)


def test_whole_table(spark, sf_dir, shared):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert results(QUERIES["op13_turn_repair"](spark, sf_dir)) == brute(rows)


def test_repaired_turns(spark, shared, mixed, monkeypatch):
    want = {c: r[-1] for c, r in brute(mixed).items()}
    for large in (repair.LARGE, 20):
        monkeypatch.setattr(repair, "LARGE", large)
        monkeypatch.setattr(repair, "SEGMENT", 8 if large == 20 else 1024)
        lines = collections.defaultdict(list)
        for r in sorted(repair.turns(frame(spark, mixed)).collect(), key=lambda r: (r["part"], r["position"])):
            assert r["edit"] in "KRI"
            lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
        assert {c: hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() for c in want} == want


def test_no_rows(spark, shared):
    empty = frame(spark, [(1, 1, "user", "x")]).where("false")
    assert repair.repair(empty).count() == 0 and repair.turns(empty).count() == 0
    gone = next(t for t in range(100) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    assert results(repair.repair(frame(spark, [(3, gone, "user", "x.")]))) == {
        3: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_prices_are_dual_feasible_and_exact():
    """No arc undercuts a price and the first price of each window is the cost of the cheapest repair."""
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randrange(1, 40)
        kinds = [(rng.choice(["system", "user", "assistant", "tool"]), rng.randrange(4)) for _ in range(n)]
        edges = [repair.arcs_of(*k) for k in kinds]
        begins, solved = repair.solve(edges)
        for begin, prices in zip(begins, solved):
            for i in range(len(prices) - 1):
                for q in range(4):
                    assert all(prices[i][q] <= cost + prices[i + 1][r] for _, cost, r in edges[begin + i][q])
                    assert prices[i][q] <= 3 + prices[i][repair.INSERT[q]]
        names = {repair.BLANK: "blank", repair.DUPLICATE: "duplicate", repair.CUT_OFF: "truncated", repair.SOUND: ""}
        cost, audit, _ = brute_repair([(r, "t") for r, _ in kinds], [names[f] for _, f in kinds])
        assert solved[0][0][0] == cost
        assert "".join(repair.trace(edges, (begins, solved), 0)[0]) == audit
