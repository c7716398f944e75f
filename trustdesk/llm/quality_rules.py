"""Quality rules: word counts of each document, and bands of n-gram perplexity for each language.

The language model is a modified Kneser-Ney model over the UTF-8 bytes of a document's words, joined by one space,
with ORDER - 1 start marks before them and one end mark behind them (bytes that UTF-8 never has). Its n-grams are counted
over all documents by Spark. Texts are dealt into two folds by their hash and each is scored by the counts of the other fold,
so that neither a text nor its copies vouch for themselves.

The highest order has counts; an n-gram of a lower order has the number of different bytes before it, start marks
included. Each order has its three discounts, from the numbers of n-grams seen one to four times; where one of those is
zero the discounts are PLAIN. The lowest order is mixed with 1/256. The probability of every n-gram of the corpus, in either
fold, is stored in sorted hash arrays.

A document's bits are its mean negative base-2 logarithm a byte, and its perplexity two to that power. A language's band runs
from FENCE quartile distances below the lower quartile of bits to as many above the upper one, over its different texts that
pass the word rules; a quartile distance counts as SPREAD at least.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from trustdesk.llm import hash_arrays
from trustdesk.llm.common import column, kept_columns, stored, utf8

ORDER = 5
START, END = 0xFF, 0xFE
#: Discounts where the counts of counts do not give any.
PLAIN = (0.5, 1.0, 1.5)
#: Width of a band in quartile distances on either side, the least quartile distance in bits, and steps of a bit.
FENCE, SPREAD, STEPS = 3, 0.1, 1000
#: Fewest words, and the largest share of words in repeated windows, in hundredths.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Bytes that are looked at together.
TOGETHER = 1 << 20
#: Different n-grams that a task holds before it merges or sends them.
HELD = 1 << 22
SPACES = b"\t\n\x0b\x0c\r "
SYMBOLS = b"#*$%&|<>"
INNER = bytes(range(0x80, 0xC0))
RULES = StructType([StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                   + [StructField("base_failed", BooleanType()), StructField("bits", DoubleType())])


def repeated_words(words) -> int:
    """Words in three-word windows that are found twice or more."""
    if len(words) < 4:
        return 0
    number = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    size = len(number)
    pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
    _, window, n = np.unique(pair[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    often = n[window] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k:len(words) - 2 + k] |= often
    return int(hit.sum())


def word_rules(raw: bytes, words):
    """``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and ``base_failed`` of a text."""
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    n, repeats = len(words), repeated_words(words)
    return (n, len(raw.translate(None, SPACES + INNER)), len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeats, n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n)


def stream(words) -> bytes:
    return bytes([START] * (ORDER - 1)) + b" ".join(words) + bytes([END]) if words else b""


def ngrams(raw: np.ndarray) -> np.ndarray:
    """Packed n-grams that begin at each byte but the last ones."""
    x = raw.astype(np.uint64)
    out = x[:len(x) - ORDER + 1].copy()
    for k in range(1, ORDER):
        out <<= np.uint64(8)
        out |= x[k:len(x) - ORDER + 1 + k]
    return out


def windows(streams):
    """For chunks of the streams: packed n-grams, and the number of n-grams of each (stream, chunk) with its stream."""
    held, owners, size = [], [], 0
    for i, s in enumerate(streams):
        for begin in range(0, len(s) - ORDER + 1, TOGETHER):
            part = np.frombuffer(s, np.uint8, min(TOGETHER + ORDER - 1, len(s) - begin), begin)
            held.append(part)
            owners.append((i, len(part) - ORDER + 1))
            size += len(part)
            if size >= TOGETHER:
                yield joined(held), owners
                held, owners, size = [], [], 0
    if held:
        yield joined(held), owners


def joined(parts):
    """N-grams inside the parts, none across two of them."""
    flat = ngrams(np.concatenate(parts))
    ends = np.cumsum([len(p) for p in parts])[:-1]
    inside = np.ones(len(flat), bool)
    for k in range(1, ORDER):
        inside[ends - k] = False
    return flat[inside]


def summed(keys, numbers):
    """Distinct keys and the sums of their numbers."""
    order = np.argsort(keys)
    keys, numbers = keys[order], numbers[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(numbers, first)


def count(docs: DataFrame, text="text") -> DataFrame:
    """``gram``, ``n0`` and ``n1``: the n-grams of all documents with their counts in each fold.

    A task sums what it has seen and sends each of its n-grams once, or more often if it has very many.
    """
    def run(batches):
        held, size = [], 0

        def sums():
            keys, numbers = summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            return pa.RecordBatch.from_arrays(
                [pa.array((keys >> np.uint64(1)).view(np.int64)), pa.array(np.where(keys & np.uint64(1), 0, numbers)),
                 pa.array(np.where(keys & np.uint64(1), numbers, 0))], names=["gram", "n0", "n1"])

        for batch in batches:
            for which in (0, 1):
                texts = [t for t, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if f == which]
                for grams, _ in windows(stream(t.split()) for t in texts):
                    keys, n = np.unique(grams, return_counts=True)
                    held.append((keys << np.uint64(1) | np.uint64(which), n.astype(np.int64)))
                    size += len(keys)
                    if size > HELD:
                        keys, n = summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
                        held, size = [(keys, n)], len(keys)
                        if size > HELD // 2:
                            yield sums()
                            held, size = [], 0
        if held:
            yield sums()

    rows = docs.select(utf8(text).alias("text"), fold(text).alias("fold")).where(F.length("text") > 0)
    seen = rows.mapInArrow(run, "gram long, n0 long, n1 long")
    return seen.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fold(text="text"):
    return F.pmod(F.xxhash64(utf8(text)), F.lit(2)).cast("int")


def discounts(levels):
    """Three discounts for each order and fold, from the counts of counts: eight numbers an order reach the driver."""
    seen = [[F.sum((F.col(f"n{f}") == k).cast("long")).alias(f"f{f}k{k}") for k in (1, 2, 3, 4)] for f in (0, 1)]
    both = None
    for k, level in levels.items():
        row = level.agg(*seen[0], *seen[1]).withColumn("order", F.lit(k))
        both = row if both is None else both.unionByName(row)
    found = {}
    for r in both.collect():
        for f in (0, 1):
            found[r["order"], f] = from_counts([r[f"f{f}k{k}"] or 0 for k in (1, 2, 3, 4)])
    return found


def from_counts(n):
    if not all(n):
        return PLAIN
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def model(grams: DataFrame) -> DataFrame:
    """``gram``, ``lp0`` and ``lp1``: base-2 logarithms of the probability of each n-gram's last byte in its context.

    ``lp0`` is for texts of fold 0 and comes from the counts of fold 1, and the other way round. ``grams`` is stored. Keys of
    the joins are contexts and shorter n-grams, which at most 256 rows share.
    """
    levels = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")
        level = levels[k + 1].groupBy(shorter).agg(*[F.sum((F.col(f"n{f}") > 0).cast("long")).alias(f"n{f}") for f in (0, 1)])
        levels[k] = stored(level, "level")
    off = discounts(levels)
    known = None
    for k in range(1, ORDER + 1):
        def discount(n, f):
            one, two, more = (F.lit(d) for d in off[k, f])
            return F.when(n == 0, F.lit(0.0)).when(n == 1, one).when(n == 2, two).otherwise(more)

        context = F.shiftright("gram", 8).alias("context")
        totals = levels[k].groupBy(context).agg(*[x for f in (0, 1) for x in (
            F.sum(f"n{f}").alias(f"t{f}"), F.sum(discount(F.col(f"n{f}"), f)).alias(f"off{f}"))])
        rows = levels[k].withColumn("context", context).join(totals, "context")
        if known is None:
            rows = rows.withColumns({f"below{f}": F.lit(1 / 256) for f in (0, 1)})
        else:
            shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
            rows = rows.withColumn("shorter", shorter).join(known, "shorter")
        rows = rows.select("gram", *[F.when(F.col(f"t{f}") == 0, F.col(f"below{f}")).otherwise(
            (F.greatest(F.col(f"n{f}") - discount(F.col(f"n{f}"), f), F.lit(0.0)) + F.col(f"off{f}") * F.col(f"below{f}"))
            / F.col(f"t{f}")).alias(f"p{f}") for f in (0, 1)])
        known = rows.select(F.col("gram").alias("shorter"), F.col("p0").alias("below0"), F.col("p1").alias("below1"))
    return rows.select("gram", F.log2("p1").alias("lp0"), F.log2("p0").alias("lp1"))


class Scorer:
    """Word rules and bits of blocks of texts."""

    width = 2

    def hashes(self, texts, folds):
        for grams, _ in windows(stream((t or b"").split()) for t in texts.to_pylist()):
            yield hash_arrays.hashed(grams)

    def results(self, find, texts, folds):
        raw = texts.to_pylist()
        words = [t.split() for t in raw]
        which = folds.to_numpy()
        total = np.zeros(len(raw))
        for grams, owners in windows(stream(w) for w in words):
            values = find(hash_arrays.hashed(grams))
            ends = np.cumsum([n for _, n in owners])
            at = np.array([i for i, _ in owners])
            sums = np.add.reduceat(values.astype(np.float64), np.concatenate(([0], ends[:-1])), axis=0)
            np.add.at(total, at, sums[np.arange(len(at)), which[at]])
        rules = [word_rules(t, w) for t, w in zip(raw, words, strict=True)]
        sizes = [sum(map(len, w)) + len(w) for w in words]
        bits = [-s / n if n else None for s, n in zip(total.tolist(), sizes, strict=True)]
        columns = list(zip(*rules, strict=True)) or [()] * 6
        return [*[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.bool_()), pa.array(bits, pa.float64())]


def score(docs: DataFrame, text="text", keep=None, bound=hash_arrays.BOUND) -> DataFrame:
    """``docs`` with the word rules of each text and its ``bits``, null without a word."""
    grams = stored(count(docs, text), "grams")
    table = hash_arrays.store(model(grams), "<f4")
    return hash_arrays.apply(docs, [utf8(text), fold(text)], RULES, Scorer, table, "<f4", keep, bound)


def bands(scored: DataFrame, lang="lang", same="same") -> DataFrame:
    """``band_lang``, ``lower`` and ``upper`` bits of each language; documents without a language are one of their own.

    Quartiles are those of a histogram of bits over the different texts, at most some ten thousand rows a language.
    """
    step = F.floor(F.col("bits") * STEPS).cast("long")
    texts = scored.where(~F.col("base_failed")).select(column(lang).alias("band_lang"), column(same).alias("same"), step.alias("step"))
    bins = texts.distinct().groupBy("band_lang", "step").agg(F.count("*").alias("n"))
    line = Window.partitionBy("band_lang").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    upto = bins.withColumn("upto", F.sum("n").over(line)).withColumn("total", F.sum("n").over(Window.partitionBy("band_lang")))
    quartile = [F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("step"))).alias(f"q{k}") for k in (1, 3)]
    wide = F.greatest((F.col("q3") - F.col("q1")) / STEPS, F.lit(SPREAD)) * FENCE
    return upto.groupBy("band_lang").agg(*quartile).select(
        "band_lang", (F.col("q1") / STEPS - wide).alias("lower"), ((F.col("q3") + 1) / STEPS + wide).alias("upper"))


def judge(docs: DataFrame, text="text", lang="lang", keep=None, bound=hash_arrays.BOUND) -> DataFrame:
    """``docs`` with its word rules, ``bits``, ``perplexity``, its language's ``lower`` and ``upper`` and ``kept``.

    A document is kept if it passes the word rules and its bits lie in the band of its language. Null, empty and blank texts
    have zero counts, fail and have no perplexity; equal texts of one language have equal results; an empty table gives
    one. Columns of these names are replaced.
    """
    names = [*RULES.names, "perplexity", "lower", "upper", "kept"]
    stay = kept_columns(docs, keep, names)
    row = F.struct(*[column(c) for c in stay]) if stay else F.struct(F.lit(0).alias("_none"))
    apart = docs.select(row.alias("row"), column(lang).alias("lang"), column(text).alias("text"), F.xxhash64(utf8(text)).alias("same"))
    scored = stored(score(apart, keep=["row", "lang", "same"], bound=bound), "scored")
    judged = scored.join(bands(scored), F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    inside = F.coalesce((F.col("bits") >= F.col("lower")) & (F.col("bits") <= F.col("upper")), F.lit(False))
    return judged.select(*[F.col("row").getField(c).alias(c) for c in stay], *RULES.names,
                         F.pow(F.lit(2.0), "bits").alias("perplexity"), "lower", "upper", (~F.col("base_failed") & inside).alias("kept"))
