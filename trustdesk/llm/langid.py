"""Language identification by rank-order profiles of letter n-grams.

Texts are lower-cased, every run of characters that are no letters becomes one gap, and the n-grams of one to three
characters are counted (a gap alone and n-grams around a gap do not count). A profile lists the most frequent n-grams
in order. The distance of a document to a language is the sum, over the n-grams of its own profile, of how far out of
place each stands there; one that the language lacks costs the profile length.
"""

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from trustdesk.llm.common import column, map_arrow

#: Length of the profiles, the one value beside the n-gram lengths that the method has.
PROFILE = 300
#: Characters that are counted together before a task passes its counts on.
TOGETHER = 1 << 20
GAP = 1
BITS = 21
PREDICTION = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def codes(text: str) -> np.ndarray:
    """Letters as code point plus two, each gap as one GAP, with a gap at both ends; empty without a letter."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[raw]
    if not is_letter.any():
        return np.empty(0, np.int64)
    x = np.concatenate(([GAP], np.where(is_letter, raw.astype(np.int64) + 2, GAP), [GAP]))
    return x[np.concatenate(([True], (x[1:] != GAP) | (x[:-1] != GAP)))]


def count_ngrams(x: np.ndarray):
    """Packed n-grams in ascending order, by length and then by characters, and their counts."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    present = np.zeros(x.max() + 1, bool)
    present[x] = True
    alphabet = np.flatnonzero(present)
    y, size = (np.cumsum(present) - 1)[x], len(alphabet)
    letter = x != GAP
    grams = [(y[letter],), (y[:-1], y[1:]),
             tuple(z[letter[1:-1]] for z in (y[:-2], y[1:-1], y[2:]))]
    keys, counts = [], []
    for parts in grams:
        flat = functools.reduce(lambda a, b: a * size + b, parts)
        if size ** len(parts) <= max(1 << 16, 4 * len(flat)):
            n = np.bincount(flat, minlength=0)
            at = np.flatnonzero(n)
            n = n[at]
        else:
            at, n = np.unique(flat, return_counts=True)
        key = np.zeros(len(at), np.int64)
        for power in range(len(parts) - 1, -1, -1):
            key = (key << BITS) | alphabet[(at // size ** power) % size]
        keys.append(key)
        counts.append(n)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    real = keys != (GAP << BITS | GAP)
    return keys[real], counts[real]


def top(keys, counts, size):
    """The most frequent keys in rank order; the smaller key first among equals."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))[:size]]


def train(docs: DataFrame, text="text", lang="lang", size=PROFILE) -> dict:
    """Profiles by language, from all rows with a language.

    Counts are summed inside each batch, then by n-gram over all tasks; only ``size`` rows a language reach the
    driver. Rows without text or language teach nothing.
    """
    def counted(name, parts):
        keys, counts = count_ngrams(np.concatenate(parts))
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(counts.astype(np.int64))],
            names=["lang", "ngram", "n"])

    def run(batches):
        waiting = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = waiting.setdefault(name, [])
                parts.append(codes(body))
                if len(parts) % 64 == 0 and sum(map(len, parts)) >= TOGETHER:
                    yield counted(name, waiting.pop(name))
        for name, parts in waiting.items():
            yield counted(name, parts)

    known = docs.where(column(lang).isNotNull() & column(text).isNotNull()).select(
        column(lang).cast("string"), column(text))
    counts = known.mapInArrow(run, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "ngram")
    best = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    profiles = {}
    for r in sorted(best.select("lang", "place", "ngram").collect()):
        profiles.setdefault(r["lang"], []).append(r["ngram"])
    return profiles


def predict(docs: DataFrame, profiles: dict, text="text", keep=None, size=PROFILE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    The nearest profile wins, the first by name among equals. The score is one less the distance as a share of the
    largest possible. A null text, one without a letter, or no profiles at all give ``und`` and 0. Input columns of
    these names are replaced.
    """
    known = sorted((name, np.array(p, np.int64)) for name, p in profiles.items())

    def start():
        order = [(name, np.argsort(p), np.sort(p)) for name, p in known]

        def one(body):
            mine = top(*count_ngrams(codes(body or "")), size)
            if not len(mine) or not order:
                return "und", 0.0
            place = np.arange(len(mine))
            best = None
            for name, ranks, keys in order:
                at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                off = int(np.where(keys[at] == mine, np.abs(ranks[at] - place), size).sum())
                if best is None or off < best[1]:
                    best = name, off
            return best[0], 1 - best[1] / (size * len(mine))

        def step(texts):
            names, scores = zip(*map(one, texts.to_pylist()), strict=True)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return step

    return map_arrow(docs, [column(text)], PREDICTION, start, keep)


def fold(doc_id="doc_id"):
    """Remainder by five of the checksum of the id; a row without an id is never learned from."""
    return F.coalesce(F.crc32(column(doc_id).cast("string").cast("binary")) % 5, F.lit(0))
