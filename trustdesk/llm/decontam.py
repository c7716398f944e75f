"""Benchmark decontamination by an FM-index over every shard of training text.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of characters beyond ASCII. The windows of a test
item are its runs of ten words, or all of its words if it has fewer. A shard is a stretch of documents inside one
task. Its index covers the runs of words that occur in the benchmark, since no window can leave such a run or fit
into one that is shorter than the shortest window. All windows are searched backwards at once through the ranks of a
wavelet tree; occurrences are found from sampled suffix positions, and overlapping ones are merged into spans.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from trustdesk.llm.common import column, kept_columns, map_arrow, utf8

WINDOW = 10
#: Words of a shard. A longer document is a shard of its own.
SHARD_WORDS = 1 << 20
#: Benchmark bytes that are sent to the tasks in one pass; a larger benchmark takes several passes.
BLOCK_BYTES = 16 << 20
SAMPLE = 8
WORD = rb"[0-9a-z\x80-\xff]+"
SPAN = StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())])
FOUND = StructType([StructField("n_words", LongType()), StructField("spans", ArrayType(SPAN)),
                    StructField("items", ArrayType(StringType()))])


def words(text: bytes) -> list:
    return re.findall(WORD, text.lower())


class Windows:
    """The distinct windows of a block of items as rows of symbols from 1, and the items that have each."""

    def __init__(self, items, window):
        self.vocabulary, self.names, found = {}, [], {}
        for name, text in items:
            item = len(self.names)
            self.names.append(name)
            symbols = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text or b"")]
            for i in range(max(1, len(symbols) - window + 1) if symbols else 0):
                found.setdefault(tuple(symbols[i:i + window]), set()).add(item)
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.symbols = np.zeros((len(found), window), np.int64)
        for row, w in enumerate(found):
            self.symbols[row, :len(w)] = w
        owners = [sorted(o) for o in found.values()]
        self.first = np.cumsum([0, *map(len, owners)])
        self.owners = np.array([o for own in owners for o in own], np.int64)


class WaveletTree:
    """Ranks of symbols in a sequence, one bit array a level, from the highest bit down."""

    def __init__(self, sequence, largest):
        self.levels, self.zeros = [], []
        self.shifts = list(range(max(1, int(largest).bit_length()) - 1, -1, -1))
        for shift in self.shifts:
            bits = sequence >> shift & 1
            ones = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bits, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(len(sequence) - int(ones[-1]))
            sequence = np.concatenate((sequence[bits == 0], sequence[bits == 1]))

    def rank(self, symbol, i):
        """Occurrences of each ``symbol`` before each ``i``."""
        begin = np.zeros_like(i)
        for shift, ones, zeros in zip(self.shifts, self.levels, self.zeros, strict=True):
            up = (symbol >> shift & 1).astype(bool)
            begin = np.where(up, zeros + ones[begin], begin - ones[begin])
            i = np.where(up, zeros + ones[i], i - ones[i])
        return i - begin

    def access(self, i):
        """Symbol at each ``i``."""
        out = np.zeros_like(i)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            up = ones[i + 1] > ones[i]
            out = out << 1 | up
            i = np.where(up, zeros + ones[i], i - ones[i])
        return out


def suffix_array(symbols):
    """Order of the suffixes; every 0 ends a run and counts as smaller than all symbols and than later 0s."""
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols + int(ends.sum()))
    step = 1
    while True:
        following = np.zeros(n, np.int64)
        following[:max(0, n - step)] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + following
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([0], np.diff(key[order]) != 0)))
        if new.max() == n - 1:
            return order
        rank, step = new, 2 * step


class FMIndex:
    """Index of runs of symbols, each run ended by a 0."""

    def __init__(self, symbols):
        order = suffix_array(symbols)
        bwt = symbols[order - 1]
        self.n = len(symbols)
        self.tree = WaveletTree(bwt, symbols.max())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols))))
        # every eighth position and each start of a run: the walk back to a sample never leaves its run
        sampled = (order % SAMPLE == 0) | (bwt == 0)
        self.sampled = np.concatenate(([0], np.cumsum(sampled)))
        self.positions = order[sampled]

    def search(self, patterns, lengths):
        """First and last row (exclusive) of the suffixes that begin with each pattern."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for j in range(patterns.shape[1] - 1, -1, -1):
            at = np.flatnonzero((lengths > j) & (lo < hi) & (patterns[:, j] < len(self.before) - 1))
            gone = (lengths > j) & (patterns[:, j] >= len(self.before) - 1)
            hi[gone] = lo[gone]
            c = patterns[at, j]
            lo[at], hi[at] = self.before[c] + self.tree.rank(c, lo[at]), self.before[c] + self.tree.rank(c, hi[at])
        return lo, np.maximum(lo, hi)

    def locate(self, rows):
        """Text position of the suffix in each row."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1), 0
        left = np.arange(len(rows))
        while len(left):
            r = rows[left]
            hit = self.sampled[r + 1] > self.sampled[r]
            out[left[hit]] = self.positions[self.sampled[r[hit]]] + steps
            left, r, steps = left[~hit], r[~hit], steps + 1
            c = self.tree.access(r)
            rows[left] = self.before[c] + self.tree.rank(c, r)
        return out


def ranges(lo, hi):
    """All numbers of the ranges and the range that each comes from."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which], which


def search_shard(texts, windows: Windows):
    """Number of words, merged hit spans and item numbers of each document of a shard."""
    get, parts = windows.vocabulary.get, []
    for t in texts:
        parts.append(np.array([get(w, 0) for w in words(t)] + [0], np.int64))
    counts = np.array([len(p) - 1 for p in parts])
    nothing = np.empty((0, 2), np.int64)
    if not len(windows.lengths) or not parts:
        return counts, [nothing] * len(texts), [nothing[:, 0]] * len(texts)
    begins = np.cumsum(counts + 1) - counts - 1
    everything = np.concatenate(parts)
    known = everything > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
    runs = edge.reshape(-1, 2)
    runs = runs[runs[:, 1] - runs[:, 0] >= windows.lengths.min()]
    # each run goes with the foreign word or the end of the document behind it
    at, _ = ranges(runs[:, 0], runs[:, 1] + 1)
    if not len(at):
        return counts, [nothing] * len(texts), [nothing[:, 0]] * len(texts)
    index = FMIndex(everything[at])
    lo, hi = index.search(windows.symbols, windows.lengths)
    rows, which = ranges(lo, hi)
    first = at[index.locate(rows)]
    doc = np.searchsorted(begins, first, "right") - 1
    cover = np.zeros(len(everything) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + windows.lengths[which], -1)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(cover) > 0).view(np.int8)))))
    spans = edge.reshape(-1, 2)
    owner = np.searchsorted(begins, spans[:, 0], "right") - 1
    spans = spans - begins[owner][:, None]
    seen = np.unique(doc * len(windows.lengths) + which)
    w, d = seen % len(windows.lengths), seen // len(windows.lengths)
    own, source = ranges(windows.first[w], windows.first[w + 1])
    pairs = np.unique(d[source] * len(windows.names) + windows.owners[own])
    pair_doc, numbers = pairs // len(windows.names), pairs % len(windows.names)
    docs = np.arange(len(texts) + 1)
    cut, cut_items = np.searchsorted(owner, docs), np.searchsorted(pair_doc, docs)
    return (counts, [spans[a:b] for a, b in zip(cut, cut[1:], strict=False)],
            [numbers[a:b] for a, b in zip(cut_items, cut_items[1:], strict=False)])


def shards(texts):
    """Slices of the texts of a batch with about SHARD_WORDS words each, taking six bytes for a word."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= 6 * SHARD_WORDS:
            yield texts[begin:i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield texts[begin:]


def blocks(benchmark: DataFrame, item_id, text, size):
    """The items in blocks of about ``size`` bytes, each small enough for the driver and the tasks."""
    items = benchmark.select(column(item_id).cast("string").alias("id"), utf8(text).alias("text"))
    total = items.agg(F.sum(F.length("text") + 16).alias("n")).first()["n"] or 0
    n = max(1, -(-total // size))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r["id"], bytes(r["text"])) for r in part.collect()]


def one_pass(docs, windows, text, keep):
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def start():
        windows = shared.value
        names = windows.names

        def step(texts):
            texts = texts.to_pylist()
            n, spans, items = [], [], []
            for shard in shards(texts):
                for out, made in zip((n, spans, items), search_shard(shard, windows), strict=True):
                    out.extend(made)
            ends = pa.array(np.cumsum([0, *map(len, spans)]), pa.int32())
            flat = np.concatenate(spans).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["begin", "end"])
            listed = [sorted({names[i] for i in x} - {None}) for x in items]
            return [pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pairs),
                    pa.array(listed, pa.list_(pa.string()))]

        return step

    return map_arrow(docs, [utf8(text)], FOUND, start, keep)


def find(docs: DataFrame, benchmark: DataFrame, text="text", item_id="item_id", item_text="text", window=WINDOW,
         keep=None, block=BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (hit words from ``begin`` to before ``end``, merged) and ``items``.

    ``items`` are the ids of the items with an occurring window, as sorted strings; an item without an id hits words
    but is not listed. A null or wordless text has no spans. Input columns of these names are replaced. No row of
    ``docs`` moves between tasks; a benchmark beyond ``block`` bytes takes one pass a block.
    """
    stay = kept_columns(docs, keep, FOUND.names)
    out, passes = docs, 0
    for items in blocks(benchmark, item_id, item_text, block):
        names = [f"_{c}_{passes}" for c in FOUND.names]
        out = one_pass(out, Windows(items, window), text, None if passes else sorted({*stay, text}, key=docs.columns.index))
        out = out.withColumnsRenamed(dict(zip(FOUND.names, names, strict=True)))
        passes += 1
    every = lambda c: F.flatten(F.array(*[F.col(f"_{c}_{i}") for i in range(passes)]))
    spans = every("spans") if passes == 1 else joined(every("spans"))
    return out.select(*[column(c) for c in stay], F.col("_n_words_0").alias("n_words"), spans.alias("spans"),
                      F.array_sort(F.array_distinct(every("items"))).alias("items"))


def joined(spans):
    """Sorted spans, those that overlap or touch made one."""
    def add(done, x):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end"))
        return (F.when((F.size(done) > 0) & (last["end"] >= x["begin"]),
                       F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer)))
                .otherwise(F.concat(done, F.array(x))))

    return F.aggregate(F.array_sort(spans), F.array().cast(ArrayType(SPAN)), add)


def cut(found: DataFrame, text="text", keep=None) -> DataFrame:
    """``found`` with each hit span taken out of its text, from the first letter of its first word to the last of its last.

    What stands around a span stays as it is; a text without spans is not changed.
    """
    keep = [c for c in (found.columns if keep is None else keep) if c not in (text, "spans")]
    made = StructType([StructField(text, StringType())])

    def start():
        def one(raw, spans):
            if not spans or raw is None:
                return raw
            at = [m.span() for m in re.finditer(WORD, raw.lower())]
            kept, done = [], 0
            for s in spans:
                kept.append(raw[done:at[s["begin"]][0]])
                done = at[s["end"] - 1][1]
            return b"".join([*kept, raw[done:]])

        def step(texts, spans):
            done = [one(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)]
            return [pa.array([t if t is None else t.decode("utf-8", "replace") for t in done], pa.string())]

        return step

    return map_arrow(found, [column(text).cast("binary"), column("spans")], made, start, keep)


#: SQL for the contract's digest of ``find``: every window of every item against every window of every document.
ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
  FROM iw, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, places.n FROM places JOIN windows USING (n, words)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit
          FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(i, i + n)) AS t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
