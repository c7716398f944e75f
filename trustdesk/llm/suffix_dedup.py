"""Repeated passages by a distributed merge sort of suffixes that never compares a known common prefix again.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Sorting every suffix is not needed: in
each such string one gram is smallest by hash, at the same place in all copies of the string, so that suffixes that
start at a smallest gram (anchors) are enough.

1. Tasks send the hashes of their anchor grams, each once, to the task of its hash range, and learn which occur more
   than once. A gram that a task itself sees twice needs no answer.
2. Suffixes at repeated anchors, up to ``length`` bytes long and with the bytes before them as satellite data, are
   sorted in runs. Equal ones of a run are settled there: all but the earliest go. Runs are dealt by sampled splitters
   and sent front-coded, that is without the prefix shared with the suffix before.
3. Each task merges its runs by a loser tree that keeps the common prefix of every loser with the last winner.
   Suffixes that share their whole gram come out side by side; among them equal strings are found at every distance
   from the anchor, compared byte by byte, and all but the earliest mark their bytes.

A gram so frequent that a splitter falls into its suffixes would be torn between two tasks. Its suffixes are not sent:
each string around it goes as a digest, once a run with its earliest place there, to the task of its digest range.
"""

import struct
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from trustdesk.llm.common import column, give_back, kept_columns, map_arrow, parts_of, stored, utf8

LENGTH, GRAM = 100, 32
#: Text bytes that are hashed together, and bytes of text for one range of gram hashes or of suffixes.
CHUNK, RANGE = 1 << 20, 32 << 20
#: Ranges at least, so that small tables are dealt like large ones.
RANGES = 32
#: Anchors whose grams are sent together, suffixes of a sorted run, suffixes of a batch of groups compared together.
GRAMS = 300_000
RUN, BATCH = 80_000, 5_000
#: Bytes of two suffixes that are compared as one number, rows of a group whose contexts are compared two by two.
WORD, PAIRED = 32, 16
#: Documents whose anchors give the splitters; they decide how evenly suffixes are dealt and nothing else.
SPLITTER_DOCS, SPLITTER_PLACES = 2000, 32
#: Compression of texts on their way between tasks.
LEVEL = 5
BASE = 0x9E3779B97F4A7C15
KEY = ["doc", "tie"]
SPAN = StructType([StructField("begin", LongType()), StructField("end", LongType())])


# --- bytes of several arrays ----------------------------------------------------------------------------
def pack(*arrays) -> bytes:
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    head = struct.pack(f"<{len(arrays) + 1}Q", len(raw), *[a.nbytes for a in arrays])
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, *types) -> list:
    total, *sizes = struct.unpack_from(f"<{len(types) + 1}Q", data)
    raw = pa.decompress(data[8 * (len(types) + 1):], total, codec="zstd", asbytes=True) if total else b""
    ends = np.cumsum([0, *sizes])
    return [np.frombuffer(raw[a:b], t) for a, b, t in zip(ends, ends[1:], types, strict=False)]


def squeezed(text: bytes) -> bytes:
    """A text as it travels: its length and its zstd form."""
    return struct.pack("<Q", len(text)) + pa.Codec("zstd", compression_level=LEVEL).compress(text, asbytes=True) if text else b""


def restored(data: bytes) -> bytes:
    if not data:
        return b""
    return pa.decompress(data[8:], struct.unpack_from("<Q", data)[0], codec="zstd", asbytes=True)


# --- anchors ----------------------------------------------------------------------------------------------
def powers(n):
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def sliding(f, x, width):
    """``f`` (minimum or maximum) over every ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        x = f(x[:-step], x[step:])
        step *= 2
    return f(x[:len(x) - (width - step)], x[width - step:]) if width > step else x


def mixed(x):
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def chunk_anchors(data, piece, length, gram):
    """Places and hashes of the anchors of a chunk; ``piece`` numbers the pieces of text in it, without separators."""
    n = len(data)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = powers(n)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(up * (data.astype(np.uint64) + np.uint64(1)))))
    hashes = mixed((sums[gram:] - sums[:-gram]) * down[:n - gram + 1]) | np.uint64(1)
    width = length - gram + 1
    least = sliding(np.minimum, hashes, width)
    least[piece[length - 1:] != piece[:n - length + 1]] = 0
    # a place is an anchor if it has the least hash of some string that lies in one piece
    around = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    at = np.flatnonzero(sliding(np.maximum, around, width)[:len(hashes)] == hashes)
    return at, hashes[at]


def anchors(texts, length, gram):
    """``(text number, place, hash)`` arrays for chunks of whole texts; long texts are cut with an overlap."""
    parts, where, size = [], [], 0

    def done():
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts])
        number = np.repeat(np.arange(len(parts)), sizes)
        at, hashes = chunk_anchors(data, number, length, gram)
        texts_of, offsets = np.array(where).T
        begins = np.cumsum(sizes) - sizes
        return texts_of[number[at]], at - begins[number[at]] + offsets[number[at]], hashes

    for i, t in enumerate(texts):
        for begin in range(0, max(1, len(t) - length + 1), CHUNK):
            parts.append(t[begin:begin + CHUNK + length - 1])
            where.append((i, begin))
            size += len(parts[-1])
            if size >= CHUNK:
                yield done()
                parts, where, size = [], [], 0
    if parts:
        yield done()


SENT = StructType([StructField("part", IntegerType()), StructField("doc", LongType()), StructField("tie", LongType()),
                   StructField("data", BinaryType())])


def sent(part, docs, ties, data):
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(docs, pa.int64()), pa.array(ties, pa.int64()),
                                       pa.array(data, pa.binary())], names=SENT.names)


def for_tasks(parts, data):
    """Packed arrays for the tasks of some ranges."""
    return sent(parts, [0] * len(parts), [0] * len(parts), data)


def by_document(keys, *values):
    """One row of packed values a document, with a negative part: it passes the next task unread."""
    if not len(keys):
        return
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, values = keys[order], [v[order].astype("<i8") for v in values]
    at = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
    data = [pack(*v) for v in zip(*[np.split(v, at[1:]) for v in values], strict=True)]
    yield sent(-1 - (keys[at, 1] & 0xFFFF), keys[at, 0], keys[at, 1], data)


def ranges_of(batches):
    """The packed arrays of each range in a partition sorted by range; rows for documents are passed on."""
    part, blobs = None, []
    for batch in batches:
        direct = batch.filter(pc.less(batch.column(0), 0))
        if direct.num_rows:
            yield None, direct
        for p, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if p >= 0:
                if p != part and blobs:
                    yield part, blobs
                    blobs = []
                part = p
                blobs.append(data)
    if blobs:
        yield part, blobs


def send_grams(parts, length, gram):
    """Map side of step 1: the distinct gram hashes of each run of texts by range, and answers known already."""
    def flush(keys, doc, place, hashes):
        keys, doc, place, hashes = np.concatenate(keys), *map(np.concatenate, (doc, place, hashes))
        order = np.argsort(hashes, kind="stable")
        h = hashes[order]
        first = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.empty(0, bool)
        alone = first & np.concatenate((first[1:], [True])) if len(h) else first
        again = order[~alone]
        sent = order[first]
        known = ~alone[first]
        part = (hashes[sent] >> np.uint64(40)).astype(np.int64) % parts
        for p in np.unique(part):
            mine = sent[part == p]
            back = np.where(known[part == p], np.uint8(1), np.uint8(0))
            used, local = np.unique(doc[mine], return_inverse=True)
            short = (hashes[mine] & np.uint64((1 << 48) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            yield for_tasks([p], [pack(
                short, np.diff(local, prepend=0).astype("<i4"), place[mine].astype("<i8"), back, keys[used])])
        yield from by_document(keys[doc[again]], place[again])

    def run(batches):
        waiting, rows, size = ([], [], [], []), 0, 0
        for batch in parts_of(batches):
            ids, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = batch.column(2).to_pylist()
            waiting[0].append(np.stack((ids, ties), 1))
            for text, place, hashes in anchors(texts, length, gram):
                for column, values in zip(waiting[1:], (text + rows, place, hashes), strict=True):
                    column.append(values)
                size += len(text)
            rows += len(texts)
            if size >= GRAMS:
                yield from flush(*waiting)
                waiting, rows, size = ([], [], [], []), 0, 0
        if size:
            yield from flush(*waiting)
        waiting = batch = None
        give_back()

    return run


def meet_grams(batches):
    """Reduce side of step 1: answers for the grams of one range that several runs hold."""
    for part, blobs in ranges_of(batches):
        if part is None:
            yield blobs
            continue
        got = [unpack(b, np.uint8, "<i4", "<i8", np.uint8, "<i8") for b in blobs]
        h = np.concatenate([np.pad(g[0].reshape(-1, 6), ((0, 0), (0, 2))) for g in got]).view("<u8").ravel()
        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        counts, begin = counts[inverse], 0
        for _, local, place, back, keys in got:
            ask = (counts[begin:begin + len(local)] > 1) & (back == 0)
            begin += len(local)
            yield from by_document(keys.reshape(-1, 2)[np.cumsum(local)[ask]], place[ask])


# --- sorted runs ------------------------------------------------------------------------------------------
def surroundings(text, places, length, gram):
    """Bytes before and from each place, one more than their value, 0 where the text has none."""
    before = length - gram
    data = np.concatenate((np.zeros(before, np.uint8), np.frombuffer(text, np.uint8) + np.uint8(1),
                           np.zeros(length, np.uint8)))
    # all windows as a view, made for every document and so without numpy's helper
    return np.ndarray((len(text) + 1, before + length), np.uint8, data, 0, (1, 1))[places]


def prefix_lengths(rows):
    """Common prefix of each row with the row before."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    return np.concatenate(([0], np.where(differ.any(1), differ.argmax(1), rows.shape[1])))


def sort_run(context, keys, places, cuts, torn, length, gram):
    """Sort one run, settle its equal suffixes, and give the rest front-coded by range."""
    before = length - gram
    enough = (context != 0).sum(1) >= length
    context, keys, places = context[enough], keys[enough], places[enough]
    if not len(context):
        return
    rank = np.lexsort((places, keys[:, 1], keys[:, 0]))
    context, keys, places = context[rank], keys[rank], places[rank]
    turned = np.ascontiguousarray(np.concatenate((context[:, before:], context[:, :before]), 1))
    order = np.argsort(turned.view(f"S{turned.shape[1]}").ravel(), kind="stable")
    turned, context, keys, places = turned[order], context[order], keys[order], places[order]
    same = prefix_lengths(turned) == turned.shape[1]
    if same.any():
        left, right = (context[same, :before] != 0).sum(1), (context[same, before:] != 0).sum(1)
        yield from by_document(keys[same], places[same] - left, places[same] + right)
    split = np.isin(np.ascontiguousarray(turned[:, :gram]).view(f"S{gram}").ravel(), torn)
    yield from send_digests(context[~same & split], keys[~same & split], places[~same & split], len(cuts) + 1, length, gram)
    whole = ~same & ~split
    turned, keys, places = turned[whole], keys[whole], places[whole]
    heads = np.ascontiguousarray(turned[:, :16]).view("S16").ravel()
    part = np.searchsorted(cuts, heads, "right")
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else part
    for a, b in zip(edges, edges[1:], strict=False):
        suffix, known = turned[a:b, :length], prefix_lengths(turned[a:b, :length])
        rest = suffix[(np.arange(length) >= known[:, None]) & (suffix != 0)]
        sizes = (suffix != 0).sum(1)
        left = turned[a:b, length:]
        yield for_tasks([part[a]], [pack(known.astype(np.uint8), sizes.astype(np.uint8), rest, (left != 0).sum(1).astype(np.uint8),
                                        left[left != 0], keys[a:b, 0], keys[a:b, 1], places[a:b].astype("<i8"))])


def send_digests(context, keys, places, parts, length, gram):
    """Strings around torn grams as digests, each with its earliest place in the run; the other places go at once."""
    order, seen, found = np.lexsort((places, keys[:, 1], keys[:, 0])), {}, [[], []]
    for i in order:
        row, left = context[i].tobytes(), length - gram
        for begin in range(left + 1):
            string = row[begin:begin + length]
            if b"\0" not in string:
                # with its distance from the anchor: a string around two equal grams is one string, seen twice
                digest = blake2b(begin.to_bytes(4) + string, digest_size=16).digest()
                place = int(places[i]) - left + begin
                if seen.setdefault(digest, (i, place)) != (i, place):
                    found[0].append(i)
                    found[1].append(place)
    if found[0]:
        at = np.array(found[1])
        yield from by_document(keys[found[0]], at, at + length)
    by_part = {}
    for digest, (i, place) in seen.items():
        by_part.setdefault(int.from_bytes(digest[:4], "little") % parts, []).append((digest, i, place))
    for part, some in by_part.items():
        digests, rows, at = zip(*some, strict=True)
        yield for_tasks([parts + part], [pack(np.frombuffer(b"".join(digests), np.uint8), keys[list(rows)],
                                              np.array(at, "<i8"))])


def meet_digests(blobs, length):
    """Places whose string starts earlier in another run."""
    got = [unpack(b, "<u8", "<i8", "<i8") for b in blobs]
    digests, keys = (np.concatenate([g[i].reshape(-1, 2) for g in got]) for i in (0, 1))
    places = np.concatenate([g[2] for g in got])
    order = np.lexsort((places, keys[:, 1], keys[:, 0], digests[:, 1], digests[:, 0]))
    later = order[1:][(digests[order][1:] == digests[order][:-1]).all(1)]
    yield from by_document(keys[later], places[later], places[later] + length)


def send_runs(cuts, torn, length, gram):
    """Map side of step 2."""
    def run(batches):
        contexts, keys, places, size = [], [], [], 0
        for batch in parts_of(batches):
            for doc, tie, text, lists in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                text, at = restored(text), np.unique(np.concatenate([unpack(x, "<i8")[0] for x in lists]))
                for begin in range(0, len(at), RUN):
                    some = at[begin:begin + RUN]
                    contexts.append(surroundings(text, some, length, gram))
                    keys.append(np.repeat(np.array([[doc, tie]], np.int64), len(some), 0))
                    places.append(some)
                    size += len(some)
                    if size >= RUN:
                        yield from sort_run(*map(np.concatenate, (contexts, keys, places)), cuts, torn, length, gram)
                        contexts, keys, places, size = [], [], [], 0
        if size:
            yield from sort_run(*map(np.concatenate, (contexts, keys, places)), cuts, torn, length, gram)
        contexts = keys = places = None
        give_back()

    return run


# --- merging ----------------------------------------------------------------------------------------------
def read_run(data):
    """Suffixes of a front-coded run in order: common prefix with the one before, suffix, bytes before it, place."""
    known, sizes, rest, lefts, before, docs, ties, places = unpack(
        data, np.uint8, np.uint8, np.uint8, np.uint8, np.uint8, "<i8", "<i8", "<i8")
    rest, before, now, at, back = rest.tobytes(), before.tobytes(), b"", 0, 0
    for k, size, left, doc, tie, place in zip(known.tolist(), sizes.tolist(), lefts.tolist(), docs.tolist(), ties.tolist(),
                                              places.tolist(), strict=True):
        k = min(k, size)
        now = now[:k] + rest[at:at + size - k]
        at += size - k
        yield k, now, before[back:back + left], doc, tie, place
        back += left


def common(a, b, begin):
    """Length of the common prefix of two strings that agree up to ``begin``."""
    while True:
        x, y = a[begin:begin + WORD], b[begin:begin + WORD]
        if x != y:
            n = min(len(x), len(y))
            differ = int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])
            return begin + n - (differ.bit_length() + 7) // 8
        if len(x) < WORD:
            return begin + len(x)
        begin += WORD


def merge(runs):
    """Suffixes of sorted runs in order, each with its common prefix with the one before.

    The leaf and every loser carry their common prefix with the last winner. Of two, the one with the longer prefix
    is smaller; only at equal prefixes are bytes compared, and then from the prefix on.
    """
    streams = [iter(r) for r in runs]
    size = 1
    while size < len(streams):
        size *= 2
    heads = [next(s, None) for s in streams] + [None] * (size - len(streams))
    # a run at its end has a prefix below all others
    prefix, losers = [0 if h else -1 for h in heads], [0] * size

    def play(a, b):
        """Winner and loser; the loser's prefix becomes the one with the winner if bytes were compared."""
        if prefix[a] != prefix[b] or prefix[a] < 0:
            return (a, b) if prefix[a] >= prefix[b] else (b, a)
        x, y = heads[a][1], heads[b][1]
        n = common(x, y, prefix[a])
        first, second = (a, b) if x[n:n + 1] <= y[n:n + 1] else (b, a)
        prefix[second] = n
        return first, second

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        pairs = [play(winners[2 * i], winners[2 * i + 1]) for i in range(level)]
        winners = [w for w, _ in pairs]
        losers[level:2 * level] = [x for _, x in pairs]
    winner = winners[0]
    while heads[winner] is not None:
        _, suffix, before, doc, tie, place = heads[winner]
        yield prefix[winner], suffix, before, doc, tie, place
        heads[winner] = head = next(streams[winner], None)
        prefix[winner] = now = head[0] if head else -1
        node = (winner + size) // 2
        while node:
            other = losers[node]
            if now < prefix[other]:
                winner, losers[node] = other, winner
                now = prefix[other]
            elif now == prefix[other] >= 0:
                winner, losers[node] = play(winner, other)
                now = prefix[winner]
            node //= 2


def equal_strings(group, context, keys, places, length, gram):
    """Spans of strings around anchors of one group that also start earlier, one span an anchor.

    Rows of small groups are compared two by two, those of others over all distances from the anchor at once, and very
    large ones distance by distance.
    """
    before = length - gram
    rank = np.lexsort((places, keys[:, 1], keys[:, 0]))
    group, context, keys, places = group[rank], context[rank], keys[rank], places[rank]
    if len(context) > 2 * BATCH:
        lowest, highest = by_distance(group, context, length, before)
    else:
        _, of, sizes = np.unique(group, return_inverse=True, return_counts=True)
        small = sizes[of] <= PAIRED
        lowest, highest = np.empty((2, len(context)), np.int64)
        for some, settle in ((small, by_pairs), (~small, by_hash)):
            if some.any():
                lowest[some], highest[some] = settle(group[some], context[some], length, before)
    hit = highest >= 0
    return (keys[hit], places[hit] - before + lowest[hit], places[hit] - before + highest[hit] + length) if hit.any() else None


def by_pairs(group, context, length, before):
    """Lowest and highest distance at which a row has a string that an earlier row has, from what each two rows share."""
    lowest, highest = np.full(len(context), before + 1), np.full(len(context), -1)
    order = np.argsort(group, kind="stable")
    group, rows = group[order], context[order]
    number = np.arange(len(group))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), number, 0))
    step = 1
    while len(at := np.flatnonzero(number - first >= step)):
        for a in range(0, len(at), BATCH):
            some = at[a:a + BATCH]
            differ = (rows[some] != rows[some - step]) | (rows[some] == 0)
            left, right = differ[:, before - 1::-1] if before else differ[:, :0], differ[:, before:]
            shared = [np.where(x.any(1), x.argmax(1), x.shape[1]) if x.shape[1] else np.zeros(len(some), np.int64) for x in (left, right)]
            least, most = before - shared[0], before + shared[1] - length
            good, mine = least <= most, order[some]
            lowest[mine[good]] = np.minimum(lowest[mine], least)[good]
            highest[mine[good]] = np.maximum(highest[mine], most)[good]
        step += 1
    return lowest, highest


def by_hash(group, context, length, before):
    """The same from hashes of all strings around the anchors, which meet first and are compared then."""
    up, down = powers(before + length)
    sums = np.concatenate((np.zeros((len(context), 1), np.uint64), np.cumsum(context.astype(np.uint64) * up, 1)), 1)
    begins = np.arange(before + 1)
    hashes = mixed((sums[:, begins + length] - sums[:, begins]) * down[begins])
    left, right = before - (context[:, :before] != 0).sum(1), before + (context[:, before:] != 0).sum(1)
    which, column = np.nonzero((begins >= left[:, None]) & (begins + length <= right[:, None]))
    lowest, highest = np.full(len(context), before + 1), np.full(len(context), -1)
    if not len(which):
        return lowest, highest
    value = mixed(hashes[which, column] ^ mixed(group[which].astype(np.uint64) * np.uint64(before + 1) + column.astype(np.uint64)))
    order = np.argsort(value)
    new = np.concatenate(([True], value[order][1:] != value[order][:-1]))
    first = np.minimum.reduceat(order, np.flatnonzero(new))[np.cumsum(new) - 1]
    later = order != first
    i, j = order[later], first[later]
    # compare the bytes: once for each two contexts that meet, over all strings around their anchors
    pairs, of = np.unique(which[i] * len(context) + which[j], return_inverse=True)
    good = (group[which[i]] == group[which[j]]) & (column[i] == column[j])
    for a in range(0, len(pairs), 1 << 16):
        some = pairs[a:a + (1 << 16)]
        differ = context[some // len(context)] != context[some % len(context)]
        before_it = np.zeros((len(some), before + length + 1), np.int16)
        np.cumsum(differ, 1, out=before_it[:, 1:])
        mine = np.flatnonzero((of >= a) & (of < a + len(some)))
        row, begin = of[mine] - a, column[i[mine]]
        good[mine] &= before_it[row, begin + length] == before_it[row, begin]
    found = i[good]
    if not good.all():  # two strings of one hash: settle all strings of such hashes by their bytes
        seen, more = {}, []
        odd = np.isin(value, value[i[~good]])
        found = found[~odd[found]]
        for e in np.flatnonzero(odd):
            c = column[e]
            key = (group[which[e]], c, context[which[e], c:c + length].tobytes())
            more += [e] if key in seen else []
            seen.setdefault(key, e)
        found = np.concatenate((found, np.array(more, np.int64)))
    np.minimum.at(lowest, which[found], column[found])
    np.maximum.at(highest, which[found], column[found])
    return lowest, highest


def by_distance(group, context, length, before):
    """Lowest and highest distance at which a row has a string that an earlier row has; a few numbers a row are held."""
    up, down = powers(before + length)
    left, right = before - (context[:, :before] != 0).sum(1), before + (context[:, before:] != 0).sum(1)
    lowest, highest = np.full(len(context), before + 1), np.full(len(context), -1)
    total = np.zeros(len(context), np.uint64)
    for k in range(length - 1):
        total += context[:, k].astype(np.uint64) * up[k]
    for c in range(before + 1):
        total += context[:, c + length - 1].astype(np.uint64) * up[c + length - 1]
        if c:
            total -= context[:, c - 1].astype(np.uint64) * up[c - 1]
        rows = np.flatnonzero((c >= left) & (c + length <= right))
        value = mixed(mixed(total[rows] * down[c]) ^ mixed(group[rows].astype(np.uint64)))
        order = np.argsort(value, kind="stable")
        new = np.concatenate(([True], value[order][1:] != value[order][:-1])) if len(rows) else np.empty(0, bool)
        later = rows[order[~new]]
        first = rows[order[np.flatnonzero(new)[np.cumsum(new) - 1]]][~new] if len(rows) else later
        good = group[later] == group[first]
        for a in range(0, len(later), 1 << 16):
            some = slice(a, a + (1 << 16))
            good[some] &= (context[later[some], c:c + length] == context[first[some], c:c + length]).all(1)
        hit = later[good]
        if not good.all():  # two strings of one hash: settle all strings of such hashes by their bytes
            odd, seen, more = np.isin(value, value[np.searchsorted(rows, later[~good])]), set(), []
            hit = np.setdiff1d(hit, rows[odd])
            for r in rows[odd].tolist():
                string = int(group[r]), context[r, c:c + length].tobytes()
                more += [r] if string in seen else []
                seen.add(string)
            hit = np.concatenate((hit, np.array(more, np.int64)))
        lowest[hit] = np.minimum(lowest[hit], c)
        highest[hit] = c
    return lowest, highest


def merge_runs(parts, length, gram):
    """Reduce side of steps 2 and 3."""
    before = length - gram

    def as_arrays(waiting):
        raw = b"".join(w[2].rjust(before, b"\0") + w[1].ljust(length, b"\0") for w in waiting)
        return (np.array([w[0] for w in waiting], np.int64), np.frombuffer(raw, np.uint8).reshape(-1, before + length),
                np.array([w[3:5] for w in waiting], np.int64).reshape(-1, 2), np.array([w[5] for w in waiting], np.int64))

    def settle(waiting, packed):
        found = equal_strings(*map(np.concatenate, zip(*packed, as_arrays(waiting), strict=True)), length, gram)
        if found:
            yield from by_document(*found)

    def merged(blobs):
        waiting, packed, group, alone, held = [], [], 0, True, None
        for n, *rest in merge([read_run(b) for b in blobs]):
            if n < gram:
                group, alone = group + 1, True
                if packed or len(waiting) >= BATCH:
                    yield from settle(waiting, packed)
                    waiting, packed = [], []
            elif alone:
                waiting.append((group, *held))
                alone = False
            held = rest
            if not alone:
                waiting.append((group, *rest))
                if len(waiting) >= 2 * BATCH:  # a large group waits as plain bytes
                    packed.append(as_arrays(waiting))
                    waiting = []
        if waiting or packed:
            yield from settle(waiting, packed)

    def run(batches):
        for part, blobs in ranges_of(batches):
            if part is None:
                yield blobs
            elif part < parts:
                yield from merged(blobs)
            else:
                yield from meet_digests(blobs, length)
        give_back()

    return run


# --- operator ---------------------------------------------------------------------------------------------
def splitters(rows: DataFrame, share: float, ranges: int, length, gram):
    """Heads of suffixes that cut the sampled ones into even ranges, and the grams that they fall into."""
    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for text, place, _ in anchors(texts, length, gram):
                for i in np.unique(text):
                    at = place[text == i]
                    at = at[::max(1, len(at) // SPLITTER_PLACES)]
                    heads = surroundings(texts[i], at, length, gram)[:, length - gram:length]
                    yield pa.RecordBatch.from_arrays([pa.array([h.tobytes() for h in heads], pa.binary())], names=["head"])

    if ranges < 2:
        return np.empty(0, "S16"), np.empty(0, f"S{gram}")
    found = rows.sample(share, seed=1).mapInArrow(run, "head binary").collect()
    heads = np.sort(np.array([bytes(r["head"]) for r in found], f"S{gram}"))
    if not len(heads):
        return np.empty(0, "S16"), np.empty(0, f"S{gram}")
    torn = np.unique(heads[np.arange(1, ranges) * len(heads) // ranges])
    return torn.astype("S16"), torn


SPANS = StructType([StructField("spans", ArrayType(SPAN))])


def travelling(df: DataFrame, keep, text) -> DataFrame:
    """Columns ``keep`` and a text as ``_text``, compressed for a shuffle; null stays null."""
    def start():
        return lambda texts: [pa.array([t if t is None else squeezed(t) for t in texts.to_pylist()], pa.binary())]

    return map_arrow(df, [text], StructType([StructField("_text", BinaryType())]), start, keep)


def find(docs: DataFrame, length=LENGTH, gram=GRAM, doc_id="doc_id", text="text", keep=None) -> DataFrame:
    """``docs`` with ``spans``, the byte ranges to remove, merged and in order.

    Documents are ordered by id; those without one come last, and those that share one by a hash of their text. Equal
    rows count as one document and get the same spans. A null text and one shorter than ``length`` bytes have none. A
    column named ``spans`` is replaced. Texts are dealt by document, grams and suffixes by range, so a source or group
    of copies is no task of its own; a passage in very many documents costs one suffix a run.
    """
    spark = docs.sparkSession
    key = [F.coalesce(column(doc_id).cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64(utf8(text)).alias("tie")]
    rows = docs.select(*key, utf8(text).alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("bytes")).first()
    ranges = max(RANGES, -(-(size["bytes"] or 0) // RANGE))

    def dealt(df):
        return df.repartition(ranges, "part").sortWithinPartitions("part")

    grams = dealt(rows.mapInArrow(send_grams(ranges, length, gram), SENT)).mapInArrow(meet_grams, SENT)
    places = grams.groupBy(*KEY).agg(F.collect_list("data").alias("places"))
    cuts, torn = splitters(rows, min(1.0, SPLITTER_DOCS / max(size["n"], 1)), ranges, length, gram)
    texts = travelling(rows, [*KEY], F.col("text")).join(places, KEY).select(*KEY, "_text", "places").dropDuplicates(KEY)
    runs = dealt(texts.mapInArrow(send_runs(cuts, torn, length, gram), SENT))
    found = runs.mapInArrow(merge_runs(len(cuts) + 1, length, gram), SENT)
    found = stored(found.groupBy(*KEY).agg(F.collect_list("data").alias("marks")), "marks")

    def start():
        def one(blobs):
            pairs = [unpack(b, "<i8", "<i8") for b in blobs or ()]
            if not pairs:
                return np.empty((0, 2), np.int64)
            begin, end = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
            order = np.argsort(begin, kind="stable")
            begin, reach = begin[order], np.maximum.accumulate(end[order])
            new = np.concatenate(([True], begin[1:] > reach[:-1]))
            return np.stack((begin[new], reach[np.concatenate((new[1:], [True]))]), 1)

        def step(blobs, *texts):
            spans = [one(b) for b in blobs.to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, spans)]), pa.int32())
            flat = np.concatenate(spans)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["begin", "end"])
            back = [pa.array([t if t is None else restored(t) for t in x.to_pylist()], pa.binary()) for x in texts]
            return [pa.ListArray.from_arrays(ends, pairs), *back]

        return step

    stay = kept_columns(docs, keep, SPANS.names)
    others = [c for c in stay if c != text]
    row = F.struct(*[column(c) for c in others]) if others else F.struct(F.lit(0).alias("_none"))
    own = docs.select(row.alias("row"), *key, column(text).cast("binary").alias("text"))
    if text in stay:
        marked = travelling(own, ["row", *KEY], F.col("text")).join(found, KEY, "left")
        made = StructType([*SPANS, StructField("text", BinaryType())])
        done = map_arrow(marked, [F.col("marks"), F.col("_text")], made, start, keep=["row"])
    else:
        done = map_arrow(own.drop("text").join(found, KEY, "left"), [F.col("marks")], SPANS, start, keep=["row"])
    return done.select(*[(F.col("text").cast("string") if c == text else F.col("row").getField(c)).alias(c) for c in stay], "spans")


def kept_bytes(spans, raw: bytes) -> bytes:
    done, out = 0, []
    for s in spans or ():
        out.append(raw[done:s["begin"]])
        done = s["end"]
    return b"".join([*out, raw[done:]])


def cut(found: DataFrame, name="kept", text="text", keep=None) -> DataFrame:
    """``found`` with ``name``, the bytes of the text outside the spans; a null text is empty."""
    def start():
        return lambda texts, spans: [pa.array([kept_bytes(s, t) for t, s in zip(
            texts.to_pylist(), spans.to_pylist(), strict=True)], pa.binary())]

    return map_arrow(found, [utf8(text), F.col("spans")], StructType([StructField(name, BinaryType())]), start, keep)


def cut_text(found: DataFrame, text="text", keep=None) -> DataFrame:
    """``found`` with its text cut; of a character that a span tears apart, nothing stays. Null stays null."""
    def one(raw, spans):
        return raw if raw is None else kept_bytes(spans, raw).decode("utf-8", "ignore") if spans else raw.decode("utf-8", "replace")

    def start():
        return lambda texts, spans: [pa.array([one(t, s) for t, s in zip(
            texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())]

    raw = column(text).cast("binary")
    return map_arrow(found, [raw, F.col("spans")], StructType([StructField(text, StringType())]), start, keep)
