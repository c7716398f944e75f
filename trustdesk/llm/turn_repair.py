"""Conversation repair: the cheapest edits that make the turns of a conversation alternate.

A conversation's rows and the state of the dialogue span a lattice: a node is the number of rows read and what was said last, an
arc an edit with its integer cost. Bertsekas' auction finds the shortest path: it starts at a node with prices that are no
higher than what an arc costs on top of the price behind it, extends the path along an arc whose cost just bridges two prices, or
raises the price of its end and contracts. Converged prices are those of the dual problem; arcs without slack from which the end
can be reached without slack are tight, and all cheapest repairs run along tight arcs. A letter of an edit leads from a state to
one other only, so that taking the least letter at each node spells the least of them.

Long conversations are priced window by window from the end, since a window's prices need the exact ones at its end alone.
Conversations of more than LARGE rows or LARGE_BYTES are cut into segments that are priced apart for each state they may end in,
chained by those tables of four by four costs, and traced apart for each state they may start in.

States: 0 nothing said, 1 a system turn, 2 a user turn, 3 an assistant turn. Fixed costs: see COST.
"""

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from trustdesk.llm.common import column, stored
from trustdesk.operators.skew import salted_join

COST = {"D": 4, "I": 3, "K": 0, "R": 3}
TRUNCATED = 3
#: Cheapest edits behind the last row, by state: all but 0 and 3 have turns to add.
AT_END = (0, 6, 3, 0)
STATES = range(4)
#: Rows that are priced together, rows of a segment, and sizes from which a conversation is cut into segments.
WINDOW, SEGMENT, LARGE, LARGE_BYTES = 16, 1024, 4096, 8 << 20
FAR = 1 << 40
BLANKS = " \t\n\x0b\x0c\r"
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)
ROLE = {2: "user", 3: "assistant"}
RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``copies`` of the rows after the damage that a checksum of the row's
    place chooses; dropped rows have no copy. A null role or text is one space."""
    place = F.concat(*[F.coalesce(column(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", None, "turn")])
    kind = F.crc32(place.cast("binary")) % 20
    role, text = (F.coalesce(column(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        column("conv_id").alias("conv_id"), column("turn").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


@functools.cache
def arcs(initial: str, gone: bool, cut_off: bool):
    """For each state the edits of a row: letter, cost and next state, the least letter first."""
    more = TRUNCATED if cut_off else 0
    out = []
    for q in STATES:
        found = [("D", COST["D"], q)]
        if not gone:
            answer = 3 if q == 2 else 2
            to = {"s": 1 if q == 0 else None, "u": 2 if q != 2 else None, "a": 3 if q == 2 else None}.get(initial)
            if to is not None:
                found.append(("K", COST["K"] + more, to))
            found.append(("R", COST["R"] + more, answer))
        out.append(tuple(found))
    return tuple(out)


INSERT = (2, 2, 3, 2)


def arcs_of(role, fault):
    return arcs(role[:1] if role[:1] in ("s", "u", "a") else "", fault in (BLANK, DUPLICATE), fault == CUT_OFF)


def faults(rows, seen=None):
    """The first fault of each (role, text), in order."""
    seen = set() if seen is None else seen
    out = []
    for row in rows:
        said = row[1].strip(BLANKS)
        out.append(BLANK if not said else DUPLICATE if row in seen else CUT_OFF if said[-1] not in ".!?" else SOUND)
        seen.add(row)
    return out


def auction(edges, begin, origins, after):
    """Prices of the nodes of a window, ``prices[i][q]`` from row ``begin`` of ``edges`` on, dual optimal from each origin.

    ``after`` holds the prices behind the window's last row; they are exact and stay. Prices start at their least, which no
    arc undercuts, since costs are not negative.
    """
    size, low = len(edges), min(after)
    prices = [[low] * 4 for _ in range(size - begin)] + [list(after)]
    last = len(prices) - 1
    for origin in origins:
        path = [(0, origin)]
        while True:
            i, q = path[-1]
            if i == last:
                break
            here, best, to = prices[i], FAR * 2, None
            ahead = prices[i + 1]
            for _, cost, r in edges[begin + i][q]:
                if cost + ahead[r] < best:
                    best, to = cost + ahead[r], (i + 1, r)
            r = INSERT[q]
            if COST["I"] + here[r] < best:
                best, to = COST["I"] + here[r], (i, r)
            if here[q] < best:
                here[q] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
    return prices


def solve(edges, after=AT_END, origins=STATES):
    """Prices of all windows, from the end; the first row of each window is exact in all its states (the very first in the
    ``origins``)."""
    begins = list(range(0, len(edges), WINDOW))
    out = []
    for begin in reversed(begins):
        out.append(auction(edges[:begin + WINDOW], begin, STATES if begin else origins, after))
        after = out[-1][0]
    return begins, out[::-1]


def trace(edges, solved, state, last=True):
    """Letters of the least cheapest repair from ``state`` on, with the states that they lead to.

    ``last`` is whether the end of the conversation follows, where missing turns are added.
    """
    letters, states = [], []
    for begin, prices in zip(*solved, strict=True):
        i, end = 0, len(prices) - 1
        alive = [[None] * 4 for _ in range(end)] + [[True] * 4]

        def leads(i, q):
            if alive[i][q] is None:
                price = prices[i][q]
                alive[i][q] = any(price == cost + prices[i + 1][r] and leads(i + 1, r) for _, cost, r in edges[begin + i][q]) or (
                    price == COST["I"] + prices[i][INSERT[q]] and leads(i, INSERT[q]))
            return alive[i][q]

        while i < end:
            price = prices[i][state]
            steps = [(letter, i + 1, r) for letter, cost, r in edges[begin + i][state]
                     if price == cost + prices[i + 1][r] and leads(i + 1, r)]
            r = INSERT[state]
            if price == COST["I"] + prices[i][r] and leads(i, r):
                steps.append(("I", i, r))
            letter, i, state = min(steps)
            letters.append(letter)
            states.append(state)
    while last and AT_END[state]:
        state = INSERT[state]
        letters.append("I")
        states.append(state)
    return letters, states


def repaired(rows, letters, states):
    """(edit, role, text) of the turns that stay or are added, from (role, text) rows."""
    left, out = iter(rows), []
    for letter, state in zip(letters, states, strict=True):
        if letter == "I":
            out.append((letter, ROLE[state], ""))
            continue
        role, text = next(left)
        if letter != "D":
            out.append((letter, role if letter == "K" else ROLE[state], text))
    return out


def lines(turns):
    return "\n".join([f"{role}:{text}" for _, role, text in turns])


def illegal(initials):
    return sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))


def one(turns, rows):
    """The result of a conversation from its turns and its (role, text) rows, and its repaired turns."""
    found = faults(rows)
    edges = [arcs_of(role, fault) for (role, _), fault in zip(rows, found, strict=True)]
    solved = solve(edges, origins=(0,))
    letters, states = trace(edges, solved, 0)
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    made = repaired(rows, letters, states)
    return (gaps, found.count(BLANK), found.count(DUPLICATE), found.count(CUT_OFF), illegal([r[:1] for r, _ in rows]),
            solved[1][0][0][0] if rows else 0, "".join(letters), hashlib.sha256(lines(made).encode()).hexdigest()), made


ORDER = ["turn", "role", "text"]


def sizes(rows: DataFrame) -> DataFrame:
    """Conversations that are large, at most (all rows) / LARGE and (all bytes) / LARGE_BYTES of them."""
    n = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"))
    return n.where((F.col("n") > LARGE) | (F.col("bytes") > LARGE_BYTES)).select(F.col("conv_id").alias("large_id"))


def whole(rows: DataFrame, solved, schema: str) -> DataFrame:
    """What ``solved`` makes of each conversation: rows of one conversation after another, one of them in memory."""
    kind = rows.schema["conv_id"].dataType

    def run(batches):
        now, held, started = None, ([], []), False
        for batch in batches:
            out = []
            for conv, turn, role, text, copies in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not started or conv != now:
                    if started:
                        out += solved(now, *held)
                    now, held, started = conv, ([], []), True
                for _ in range(copies):
                    held[0].append(turn)
                    held[1].append((role, text))
            if out:
                yield batch_of(out)
        if started:
            yield batch_of(solved(now, *held))

    def batch_of(out):
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    rest = rows.sparkSession.createDataFrame([], schema).schema
    full = StructType([StructField("conv_id", kind), *rest])
    arrow = to_arrow_schema(full)
    names, types = arrow.names, arrow.types
    line = rows.select("conv_id", "turn", "role", "text", "copies").repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return line.mapInArrow(run, full)


def split(conversations: DataFrame):
    """Damaged rows of the small conversations and, where there are any, of the large ones."""
    rows = damage(conversations)
    large = stored(sizes(rows), "large")
    if not large.limit(1).count():
        return rows, None
    same = F.col("conv_id").eqNullSafe(F.col("large_id"))
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


def repair(conversations: DataFrame) -> DataFrame:
    """One row per ``conv_id``: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and
    ``repaired_sha256``, the digest of the repaired turns.

    Rows of one turn come in the order of role and text; rows without a turn come first, rows without an id are one
    conversation. Repeated rows are duplicates. A conversation without rows after the damage has zeros, an empty audit
    and the digest of nothing. Extra columns do not matter.
    """
    small, large = split(conversations)
    done = whole(small, lambda conv, turns, rows: [(conv, *one(turns, rows)[0])], RESULT)
    return done if large is None else done.unionByName(from_segments(large))


def turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations, a row per turn: ``conv_id``, ``part`` and ``position``, which order them, ``edit`` (K, R
    or I), ``role`` and ``text``."""
    schema = "part long, position long, edit string, role string, text string"
    small, large = split(conversations)
    made = whole(small, lambda conv, at, rows: [(conv, 0, i, *t) for i, t in enumerate(one(at, rows)[1])] or [(conv, 0, None, *[None] * 3)],
                 schema).where("position is not null")
    if large is None:
        return made
    chosen, _ = traced(large)
    pieces = chosen.select("conv_id", "part", F.posexplode("turns").alias("position", "t"))
    return made.unionByName(pieces.select("conv_id", "part", F.col("position").cast("long").alias("position"), "t.edit", "t.role", "t.text"))


# large conversations -------------------------------------------------------------------------------------------------

ROW = "struct<role: string, text: string, fault: int>"


def flagged(rows: DataFrame) -> DataFrame:
    """Rows of large conversations, one for each copy, with ``fault``; equal texts are told by a 128-bit digest."""
    alike = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).where("copies > 0")
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    marked = alike.withColumns({"key": key, "digest": F.md5("text"), "at": F.struct(F.col("turn"))})
    first = marked.groupBy("key", "role", "digest").agg(F.min("at").alias("first"))
    counts = marked.groupBy("key", "role", "digest").agg(F.count("*").alias("n"))
    met = salted_join(marked, first, ["key", "role", "digest"], ["turn"], counts=counts, hot_rows=SEGMENT * 64)
    said = F.btrim("text", F.lit(BLANKS))
    repeat = (F.col("no") > 1) | ~F.col("turn").eqNullSafe(F.col("first.turn"))
    single = met.withColumn("no", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    fault = F.when(said == "", BLANK).when(repeat, DUPLICATE).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), CUT_OFF).otherwise(SOUND)
    return single.select("conv_id", "turn", "role", "text", "no", fault.alias("fault"))


def segments(rows: DataFrame) -> DataFrame:
    """Rows in order, packed: ``conv_id``, ``part``, which orders the segments of a conversation, and ``rows``."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    line = flagged(rows).repartitionByRange(F.col("conv_id"), *ORDER, F.col("no")).sortWithinPartitions("conv_id", *ORDER, "no")

    def run(batches):
        base, n, held, now, started = TaskContext.get().partitionId() << 32, 0, [], None, False
        for batch in batches:
            out = []
            for conv, role, text, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if started and (conv != now or len(held) == SEGMENT):
                    out.append((now, base + n, held))
                    n, held = n + 1, []
                now, started = conv, True
                held.append({"role": role, "text": text, "fault": fault})
            yield from packed(out, batch.column(0).type)
            kind_of = batch.column(0).type
        if held:
            yield from packed([(now, base + n, held)], kind_of)

    of = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.int32())]))

    def packed(out, conv_type):
        for conv, part, held in out:
            yield pa.RecordBatch.from_arrays([pa.array([conv], conv_type), pa.array([part]), pa.array([held], of)],
                                             names=["conv_id", "part", "rows"])

    return stored(line.select("conv_id", "role", "text", "fault").mapInArrow(
        run, f"conv_id {kind}, part long, rows array<{ROW}>"), "segments")


def edges_of(rows):
    return [arcs_of(r["role"], r["fault"]) for r in rows]


def costs(found: DataFrame) -> DataFrame:
    """For each segment its costs from each state at its begin to each at its end, packed by rows."""
    kind = found.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for rows in batch.column(2).to_pylist():
                edges, table = edges_of(rows), [[FAR] * 4 for _ in STATES]
                # nothing leads back to states 0 and 1: all rows go, or all but one system turn that is kept first
                gone = COST["D"] * len(rows)
                kept = [cost for row in edges for letter, cost, r in row[0] if r == 1]
                table[0][0] = table[1][1] = gone
                table[0][1] = min(kept) + gone - COST["D"] if kept else FAR
                for end, after in ((2, (3, 3, 0, 3)), (3, (6, 6, 3, 0))):
                    for q, cost in enumerate(solve(edges, after)[1][0][0]):
                        table[q][end] = cost
                out.append([c for line in table for c in line])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))],
                                             names=["conv_id", "part", "costs"])

    return found.mapInArrow(run, f"conv_id {kind}, part long, costs array<long>")


def chained(steps: DataFrame, begin, step, backward: bool, name: str) -> DataFrame:
    """``part`` and what holds before each step of its conversation, walked in order; four numbers are held at a time."""
    def run(batches):
        now, state, started = None, None, False
        for batch in batches:
            out = []
            for conv, part, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not started or conv != now:
                    now, state, started = conv, list(begin), True
                out.append((part, list(state)))
                state = step(state, value)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out]), pa.array([s for _, s in out], pa.list_(pa.int64()))],
                                                 names=["part", name])

    order = F.col("part").desc() if backward else F.col("part")
    line = steps.toDF("conv_id", "part", "value").repartition("conv_id").sortWithinPartitions("conv_id", order)
    return line.mapInArrow(run, f"part long, {name} array<long>")


def behind(prices, table):
    return [min(table[4 * q + r] + prices[r] for r in STATES) for q in STATES]


def traced(rows: DataFrame):
    """Segments of large conversations with their repaired ``turns``, ``letters`` and ``cost`` of the whole conversation at
    its first segment; and the segments."""
    found = segments(rows)
    kind = found.schema["conv_id"].dataType.simpleString()
    table = stored(costs(found), "costs")
    after = stored(chained(table, AT_END, behind, True, "after"), "after")

    def solved(rows, after):
        edges = edges_of(rows)
        return edges, solve(edges, tuple(after))

    def ways(batches):
        """The state that each state at a segment's begin leads to."""
        for batch in batches:
            out = []
            for rows, after in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                edges, prices = solved(rows, after)
                out.append([trace(edges, prices, q, last=False)[1][-1] for q in STATES])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))],
                                             names=["conv_id", "part", "to"])

    priced = found.join(after, "part").select("conv_id", "part", "rows", "after")
    to = priced.mapInArrow(ways, f"conv_id {kind}, part long, to array<long>")
    at = stored(chained(to, [0], lambda state, to: [to[state[0]]], False, "at"), "at")
    ends = found.groupBy("conv_id").agg(F.max("part").alias("part")).select("part", F.lit(True).alias("last"))

    def write(batches):
        for batch in batches:
            out = []
            for rows, after, at, last in zip(*[batch.column(i).to_pylist() for i in range(2, 6)], strict=True):
                edges, prices = solved(rows, after)
                letters, states = trace(edges, prices, at[0], last)
                made = repaired([(r["role"], r["text"]) for r in rows], letters, states)
                out.append(("".join(letters), prices[1][0][0][0], [dict(zip(("edit", "role", "text"), t, strict=True)) for t in made]))
            turn = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array([o[i] for o in out], t) for i, t in
                                                     enumerate((pa.string(), pa.int64(), pa.list_(turn)))]],
                names=["conv_id", "part", "letters", "cost", "turns"])

    ready = priced.join(at, "part").join(ends, "part", "left").select(
        "conv_id", "part", "rows", "after", "at", F.coalesce("last", F.lit(False)).alias("last"))
    return ready.mapInArrow(write, f"conv_id {kind}, part long, letters string, cost long, "
                                   "turns array<struct<edit: string, role: string, text: string>>"), found


def from_segments(rows: DataFrame) -> DataFrame:
    """Results of large conversations. The digest of one is of all its turns in order: its pieces stream through one task, all
    other work is spread over the segments."""
    rows = stored(rows, "rows")
    chosen, found = traced(rows)
    kind = found.schema["conv_id"].dataType.simpleString()
    known = rows.where("copies > 0 and turn is not null").select("conv_id", "turn").distinct()
    gaps = known.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))

    def run(batches):
        now, started, digest, letters, cost, first = None, False, None, [], 0, True
        for batch in batches:
            out = []
            for conv, _, said, price, made in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not started or conv != now:
                    if started:
                        out.append((now, cost, "".join(letters), digest.hexdigest()))
                    now, started, digest, letters, cost, first = conv, True, hashlib.sha256(), [], price, True
                letters.append(said)
                for t in made:
                    digest.update(("" if first else "\n").encode() + f"{t['role']}:{t['text']}".encode())
                    first = False
            conv_type = batch.column(0).type
            yield from packed(out, conv_type)
        if started:
            yield from packed([(now, cost, "".join(letters), digest.hexdigest())], conv_type)

    def packed(out, conv_type):
        if out:
            columns = list(zip(*out, strict=True))
            types = conv_type, pa.int64(), pa.string(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             names=["conv_id", "cost", "audit", "repaired_sha256"])

    line = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    digests = line.mapInArrow(run, f"conv_id {kind}, cost long, audit string, repaired_sha256 string")
    def fault_is(k):
        return lambda r: r["fault"] == k

    # faults and neighbours inside a segment, then the neighbours across two segments
    initials = F.transform("rows", lambda r: F.left(r["role"], F.lit(1)))
    pairs = F.zip_with(F.slice(initials, F.lit(1), F.size("rows") - 1), F.slice(initials, F.lit(2), F.size("rows") - 1),
                       lambda x, y: F.concat(x, y))
    wrong = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))
    summary = stored(found.select(
        "conv_id", "part", *[F.size(F.filter("rows", fault_is(k))).alias(n) for n, k in (
            ("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT_OFF))],
        wrong.alias("illegal"), F.array(F.element_at(initials, 1), F.element_at(initials, -1)).alias("ends")), "summary")

    def across(batches):
        now, end, started = None, None, False
        for batch in batches:
            out = []
            for conv, _, ends in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if started and conv == now:
                    out.append((conv, illegal([end, ends[0]])))
                now, end, started = conv, ends[1], True
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], batch.column(0).type),
                                              pa.array([n for _, n in out], pa.int64())], names=["conv_id", "illegal"])

    seams = summary.select("conv_id", "part", "ends").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        across, f"conv_id {kind}, illegal long")
    counted = ("blank", "duplicate", "truncated", "illegal")
    zero = [F.lit(0).cast("long").alias(n) for n in counted[:3]]
    both = summary.select("conv_id", *[F.col(n).cast("long") for n in counted]).unionByName(seams.select("conv_id", *zero, "illegal"))
    totals = both.groupBy("conv_id").agg(*[F.sum(n).alias(n) for n in counted])

    def joined(a, b):
        right = b.withColumnRenamed("conv_id", "other_id")
        return a.join(right, F.col("conv_id").eqNullSafe(F.col("other_id")), "left").drop("other_id")

    out = joined(joined(digests, totals), gaps)
    return out.select("conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), *counted, "cost", "audit", "repaired_sha256")
