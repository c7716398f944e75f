"""Token ids in binary shards: one array of ids, document boundaries and document ids in Elias-Fano code.

A shard file holds the documents of one range of ids, in ascending order: a header, the ids as little-endian
integers of two or four bytes, and two monotone sequences (where each document ends in the id array, and the
document ids less their smallest). A monotone sequence of n values below u takes about 2 + log2(u/n) bits a value: the
low bits of each value packed, the high bits in unary. ``select`` finds a value from one sample in every 256 without a
table of 64-bit offsets. Files are written and read by Spark, so any shared store will do; a file ends with one line
feed that the writer adds.
"""

import struct
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from trustdesk.llm.common import column, give_back, parts_of, shared_path

#: Mark and layout of the header (mark, id width, null ids, documents, ids, smallest document id, two lengths).
MARK = b"EFTOKEN1"
HEADER = "<8sHxxxxxxQQQqQQ"
HEADER_BYTES = struct.calcsize(HEADER)
MONOTONE = "<QQB"
SAMPLE = 256
#: Text bytes aimed at in a shard; a longer document still goes whole into one.
SHARD_BYTES = 8 << 20
#: Stretches that a worker remembers, and bytes of the longest of them; a full table starts anew, results do not depend on it.
CACHE, REMEMBERED = 200_000, 48
#: A word of Latin letters with common marks behind it: its letters may be lowered and encoded apart from the marks.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]*[A-Za-zÀ-ÖØ-öø-þ][.,;:!?]*$"
#: These tables, by tokenizer file; a Python worker keeps them from task to task.
TABLES = {}


class EliasFano:
    """A sequence of values that never fall."""

    def __init__(self, n, low_bits, low, high):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        # byte of the high bits in which every 256th one lies, and the ones before that byte
        self.at = np.searchsorted(ones, np.arange(1, n + 1, SAMPLE)).astype(np.uint32)
        self.before = (ones[self.at] - np.bitwise_count(high[self.at])).astype(np.uint32)

    @classmethod
    def of(cls, values):
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = values & np.uint64((1 << bits) - 1)
        spread = (low[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        marks[ones] = 1
        return cls(n, bits, np.packbits(spread.ravel(), bitorder="little"), np.packbits(marks, bitorder="little"))

    def to_bytes(self):
        return struct.pack(MONOTONE, self.n, len(self.high), self.low_bits) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data):
        n, size, bits = struct.unpack_from(MONOTONE, data)
        lows = (n * bits + 7) // 8
        body = np.frombuffer(data, np.uint8, lows + size, struct.calcsize(MONOTONE))
        return cls(n, bits, body[:lows], body[lows:])

    def _low(self, i):
        out = 0
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= (int(self.low[at >> 3]) >> (at & 7) & 1) << b
        return out

    def select(self, i):
        """Value number ``i``: the sample before it, then the bytes up to its one."""
        at, seen = int(self.at[i // SAMPLE]), int(self.before[i // SAMPLE])
        while seen + int(self.high[at]).bit_count() <= i:
            seen += int(self.high[at]).bit_count()
            at += 1
        byte = int(self.high[at])
        for bit in range(8):
            seen += byte >> bit & 1
            if seen == i + 1:
                return (at * 8 + bit - i) << self.low_bits | self._low(i)
        raise IndexError(i)

    def each(self):
        """All values in order, by selects from sample to sample; no more than SAMPLE of them are unpacked at a time."""
        for first in range(0, self.n, SAMPLE):
            k, last = first // SAMPLE, min(first + SAMPLE, self.n)
            begin = int(self.at[k])
            end = int(self.at[k + 1]) + 1 if k + 1 < len(self.at) else len(self.high)
            skip = first - int(self.before[k])
            ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little"))[skip:skip + last - first]
            out = (ones + 8 * begin - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)
            if self.low_bits:
                at = first * self.low_bits
                bits = np.unpackbits(self.low[at >> 3:(last * self.low_bits + 7) >> 3], bitorder="little")[at & 7:]
                low = bits[:(last - first) * self.low_bits].reshape(last - first, -1)
                out |= (low.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
            yield from out.tolist()


def shard_bytes(doc_ids, arrays, width) -> bytes:
    """A shard of documents in ascending order of id, null ids first."""
    nulls = sum(d is None for d in doc_ids)
    ids = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(ids[0]) if len(ids) else 0
    ends = EliasFano.of(np.cumsum([len(a) for a in arrays], dtype=np.uint64)).to_bytes()
    names = EliasFano.of((ids - least).astype(np.uint64)).to_bytes()
    flat = np.concatenate(arrays).astype(f"<u{width}") if arrays else np.empty(0, f"<u{width}")
    head = struct.pack(HEADER, MARK, width, nulls, len(arrays), len(flat), least, len(ends), len(names))
    return head + ends + names + flat.tobytes()


class Shard:
    """A shard read from its file."""

    def __init__(self, data: bytes):
        mark, width, self.nulls, self.n_docs, self.n_ids, self.least, ends, names = struct.unpack_from(HEADER, data)
        if mark != MARK:
            raise ValueError("not a token shard")
        at = HEADER_BYTES
        self.ends = EliasFano.from_bytes(data[at:at + ends])
        self.names = EliasFano.from_bytes(data[at + ends:at + ends + names])
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at + ends + names)

    def document(self, i):
        """Ids of document number ``i`` by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0:self.ends.select(i)]

    def doc_ids(self):
        return [None] * self.nulls + [n + self.least for n in self.names.each()]


#: Letters that a word may end in, and the letter that marks each there: capitals, which lowered words do not have.
LAST = {chr(c): chr(c - 0x20) for c in (*range(0x61, 0x7B), *range(0xE0, 0xF7), *range(0xF8, 0xFF))} | {"ß": "×"}
WORD_END = "</w>"


def ranked(path):
    """A rank encoder for words of plain letters, one a line, and which ids end a word; None for other vocabularies.

    The vocabulary has letters and letters at the end of a word. A last letter is marked by its capital, so that both are
    plain bytes and merges are those of the file as long as ids follow the order of the merges.
    """
    import json

    import tiktoken

    with open(path) as f:
        model = json.load(f)["model"]
    letters, size = byte_letters(), len(model["vocab"])
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if model.get("end_of_word_suffix") != WORD_END or [model["vocab"].get(a + b) for a, b in merges] != list(range(512, 512 + len(merges))):
        return None
    last = {ord(k): ord(v) for k, v in LAST.items() if k.isascii()} | {k.encode()[1]: v.encode()[1] for k, v in LAST.items() if not k.isascii()}
    allowed = {*range(0x61, 0x7B), 0xC3, *range(0x9F, 0xC0)}
    ranks, ends = {}, np.zeros(size, bool)
    for token, i in model["vocab"].items():
        body = token.removesuffix(WORD_END)
        if not body or any(c not in letters for c in body):
            continue
        raw = bytes(letters[c] for c in body)
        if token.endswith(WORD_END):
            ends[i] = True
            if raw[-1] not in last or not allowed.issuperset(raw[:-1]):
                continue
            raw = raw[:-1] + bytes([last[raw[-1]]])
        elif not allowed.issuperset(raw):
            continue
        ranks[raw] = i
    # bytes that words of plain letters never have are tokens only for the library's sake
    ranks |= {bytes([b]): size + b for b in range(256) if bytes([b]) not in ranks}
    return tiktoken.Encoding("words", pat_str=r"[^\n]+", mergeable_ranks=ranks, special_tokens={}), ends


def byte_letters() -> dict:
    """The byte of each letter of a byte-level vocabulary: printable ones stand for themselves, others follow U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def byte_table(*pairs):
    """All byte values, with others in the place of some."""
    table = np.arange(256, dtype=np.uint8)
    for values, others in pairs:
        table[list(values)] = list(others)
    return table


#: Bytes of plain words in lower case, and last bytes of lowered words as LAST marks them.
LOWER = byte_table((range(0x41, 0x5B), range(0x61, 0x7B)), (range(0x80, 0x9F), range(0xA0, 0xBF)))
MARKED = byte_table((range(0x61, 0x7B), range(0x41, 0x5B)), (range(0xA0, 0xBF), range(0x80, 0x9F)), ([0x9F], [0x97]))
IS_MARK = np.isin(np.arange(256), list(b".,;:!?"))


def cut_at(ends, values, kind):
    """An Arrow array of stretches of flat values that end at ``ends``."""
    ends = pa.array(np.concatenate(([0], ends)), pa.int32())
    if pa.types.is_list(kind):
        return pa.ListArray.from_arrays(ends, pa.array(values))
    return pa.Array.from_buffers(kind, len(ends) - 1, [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(values))])


def encoder(path):
    """A function from texts to their ids as 32-bit bytes, as the tokenizers library gives them.

    The tokenizer of these files drops white space before its merges and composes no character across it, so a text
    is encoded stretch by stretch between ASCII white space. Arrow splits the texts of a call and numbers the different
    stretches; these are encoded once and their ids taken for every place. Words of plain letters are encoded by ranks,
    all of a call at once and without a table of known ones; everything else by the library, and short ones are remembered.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in TABLES:
        TABLES[path] = {}, Tokenizer.from_file(path), ranked(path)
    seen, tokenizer, by_rank = TABLES[path]
    ragged = pa.list_(pa.uint32())

    def library(stretches):
        """Ids of any stretches."""
        if len(seen) > CACHE:
            seen.clear()
        new = [w for w in stretches if w not in seen]
        texts = [w.decode("utf-8", "replace") for w in new]
        made = {w: array("I", e.ids) for w, e in zip(new, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True)}
        each = [made[w] if w in made else seen[w] for w in stretches]
        seen.update((w, i) for w, i in made.items() if len(w) <= REMEMBERED)
        return cut_at(np.cumsum([len(i) for i in each]), np.frombuffer(b"".join(each), np.uint32), ragged)

    def words(plain):
        """Ids of words of plain letters without the marks behind them, and these marks."""
        encoding, ends = by_rank
        sizes = pc.binary_length(plain).to_numpy()
        at = np.frombuffer(plain.buffers()[1], np.int32, len(plain) + 1, 4 * plain.offset)
        data = np.frombuffer(plain.buffers()[2], np.uint8, at[-1])[at[0]:]
        mark = IS_MARK[data]
        marks = np.diff(np.cumsum(np.concatenate(([False], mark)), dtype=np.int32)[at - at[0]])
        stops = np.cumsum(sizes - marks)
        letters = LOWER[data[~mark]]
        letters[stops - 1] = MARKED[letters[stops - 1]]
        lines = np.zeros(len(letters) + len(stops), np.uint8)
        lines[stops + np.arange(len(stops))] = 0x0A
        lines[lines == 0] = letters
        ids = np.array(encoding.encode_ordinary(lines.tobytes().decode()), np.uint32)
        found = cut_at(np.flatnonzero(ends[ids]) + 1, ids, ragged)
        if len(found) != len(plain):
            raise ValueError("a word without an end")
        return found, cut_at(np.cumsum(marks), data[mark], pa.binary())

    def encoded(distinct):
        """Ids of different stretches."""
        is_plain = pc.match_substring_regex(distinct, PLAIN) if by_rank else pa.array(np.zeros(len(distinct), bool))
        plain, rest = distinct.filter(is_plain), distinct.filter(pc.invert(is_plain)).view(pa.binary()).to_pylist()
        if not len(plain):
            return library(rest)
        found, marks = words(plain)
        marks = marks.dictionary_encode()
        # each stretch is a word and its marks, or a stretch of the library and nothing: marks have their empty one
        behind = [*marks.dictionary.to_pylist(), b""]
        all_ids = pa.concat_arrays([found, library([*behind, *rest])])
        of = np.empty((len(distinct), 2), np.int64)
        here = is_plain.to_numpy(zero_copy_only=False)
        of[here, 0], of[here, 1] = np.arange(len(found)), len(found) + marks.indices.to_numpy()
        of[~here, 0], of[~here, 1] = len(found) + len(behind) + np.arange(len(rest)), len(found) + len(behind) - 1
        taken = all_ids.take(pa.array(of.ravel()))
        return pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[::2]), taken.values)

    def ids(texts):
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        numbered = split.flatten().dictionary_encode()
        taken = encoded(numbered.dictionary).take(numbered.indices)
        flat, ends = taken.values.to_numpy(), taken.offsets.to_numpy()[split.offsets.to_numpy()]
        return [flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]

    return ids


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id="doc_id", text="text", vocabulary=1 << 16,
          shard=SHARD_BYTES) -> None:
    """Encode every whole text, append ``end_id`` and write shard files under ``path`` in ascending order of id.

    A null text is empty; documents of one id follow each other by text. Documents are dealt by ranges of ids, so
    one source or group of copies is no task of its own, and each task cuts its range into shards of about ``shard``
    text bytes.
    """
    width = 2 if vocabulary <= 1 << 16 else 4
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(column(text).cast("binary"), F.lit(b"")).alias("text"))

    def run(batches):
        encode, ids, arrays, size = None, [], [], 0
        end = np.array([end_id], np.uint32)
        for batch in parts_of(batches):
            encode = encode or encoder(tokenizer)
            lengths = pc.binary_length(batch.column(1)).to_pylist()
            for doc, length, raw in zip(batch.column(0).to_pylist(), lengths, encode(batch.column(1)), strict=True):
                if size and size + length > shard:
                    yield one(ids, arrays)
                    ids, arrays, size = [], [], 0
                ids.append(doc)
                arrays.append(np.concatenate((np.frombuffer(raw, "<u4"), end)).astype(f"<u{width}"))
                size += length + 1
        if ids:
            yield one(ids, arrays)
        ids = arrays = batch = raw = None
        give_back()

    def one(ids, arrays):
        return pa.RecordBatch.from_arrays([pa.array([shard_bytes(ids, arrays, width)], pa.binary())], names=["value"])

    total = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // (4 * shard)))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(run, StructType([StructField("value", BinaryType())]))
    # the text writer puts out a row's bytes as they are; one row a file makes each file a shard
    made.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read(spark, path: str) -> DataFrame:
    """Documents of the shards under ``path``: ``doc_id``, ``start`` over all shards, ``ids`` as binary (32 bits each).

    Starts are made of two levels of sums over the shards, so no task sees the documents of more than one range.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, HEADER_BYTES).alias("head"))

    def count(batches):
        for batch in batches:
            heads = [struct.unpack(HEADER, h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[4] for h in heads], pa.int64())],
                                             names=["path", "n"])

    part = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    number = F.regexp_extract("path", r"-c(\d+)[^/]*$", 1).cast("long")
    totals = files.mapInArrow(count, "path string, n long").select(
        "path", "n", part.alias("part"), number.alias("number"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.groupBy("part").agg(F.sum("n").alias("n")).withColumn("block", F.floor(F.col("part") / 4096))
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n"))
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.join(blocks.select("block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("block_base")), "block")
    base = base.select("part", (F.col("block_base") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("part_base"))
    starts = totals.join(base, "part").select(
        "path", (F.col("part_base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("base"))

    def run(batches):
        for batch in batches:
            for data, base in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                s = Shard(data.as_py())
                begin, begins, arrays = 0, [], []
                for end in s.ends.each():
                    begins.append(begin + base)
                    arrays.append(s.ids[begin:end].astype("<u4").tobytes())
                    begin = end
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids(), pa.int64()), pa.array(begins, pa.int64()),
                                                  pa.array(arrays, pa.binary())], names=["doc_id", "start", "ids"])

    content = spark.read.format("binaryFile").load(path).select("path", "content")
    return content.join(starts, "path").select("content", "base").mapInArrow(
        run, StructType([StructField("doc_id", LongType()), StructField("start", LongType()),
                         StructField("ids", BinaryType())]))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, **more) -> DataFrame:
    """Write the shards to a new folder in shared storage and read them back."""
    path = shared_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end_id, **more)
    return read(docs.sparkSession, path)
