"""Substring search through an index of letter triples.

Each text field of a record is stored lower-cased, under a number: the task that stored it and its row there. The different
triples of its letters are postings that lead back to this number. A pattern's literal parts have triples too: a field that
matches has all of them, so that postings of those triples give the candidates and the stored fields of the candidates
alone are compared with the pattern.
Fields are indexed in blocks of a few million letters. The postings of a triple in a block are one row, the distances
between its fields, about a byte each; these rows are dealt into slots by triple and sorted, so that a search reads the
row groups of its triples. A pattern without a part of three letters is compared with all stored fields, still without
the records themselves.
"""

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from trustdesk.functions.text import contains_pattern

TRIPLE, SLOTS = 3, 64
#: Bytes of text in a block, and letters that are sorted at once: few, so that they stay close to the processor.
BLOCK, STEP = 1 << 23, 1 << 16
#: Row groups of the stored fields, small enough to deal their texts evenly.
ROW_GROUP = 1 << 24
LETTERS = 0x110000
LISTS = "triple string, part int, base int, ats binary, slot int"
FIELDS = "field string, id string, text string, part int, at int"


@dataclass
class TextIndex:
    spark: SparkSession
    path: str

    def lists(self) -> DataFrame:
        """Postings as they are stored: a row for each triple of a block, its fields counted from ``base``."""
        return self.spark.read.schema(LISTS).parquet(f"{self.path}/postings")

    def postings(self) -> DataFrame:
        """One row for each triple of each field: ``part`` and ``at`` are the number of the field."""
        return self.lists().mapInArrow(_unpacked, "triple string, part int, at int, slot int")

    def fields(self) -> DataFrame:
        return self.spark.read.schema(FIELDS).parquet(f"{self.path}/fields")


def slot_of(c):
    return F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")


def triples_of(text):
    """Different triples of a text, found in one pass over it; none where it is shorter. Blocks give the same for many texts at once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{TRIPLE}}}))"), F.lit(1)))


# numbers as bytes ----------------------------------------------------------------------------------------------------


def pack(numbers: np.ndarray):
    """Numbers below 2^35 as bytes of seven bits, the lowest first, the last one of a number without the eighth; where each ends."""
    numbers = numbers.astype("uint64")
    size = np.ones(len(numbers), "int64")
    for k in range(1, 5):
        size += numbers >= 1 << 7 * k
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(ends) else 0, "uint8")
    for k in range(size.max(initial=0)):
        held = np.flatnonzero(size > k) if k else slice(None)
        more = (size[held] > k + 1).astype("uint8") << 7
        out[ends[held] - size[held] + k] = (numbers[held] >> 7 * k & 127).astype("uint8") | more
    return out, ends


def unpack(data: np.ndarray):
    """The numbers of ``pack``, and where each ends."""
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate([[0], ends])[:-1]
    numbers = np.zeros(len(ends), "int64")
    for k in range((ends - starts).max(initial=0)):
        held = np.flatnonzero(ends - starts > k)
        numbers[held] |= (data[starts[held] + k] & 127).astype("int64") << 7 * k
    return numbers, ends


def _bytes_of(column):
    """Offsets and bytes of an Arrow column of texts or bytes without nulls."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, "int64")[array.offset:array.offset + len(array) + 1] if offsets else np.zeros(1, "int64")
    data = np.frombuffer(data, "uint8") if data else np.zeros(0, "uint8")
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


# blocks --------------------------------------------------------------------------------------------------------------


def blocks(batches):
    """Stored fields in tables of about BLOCK bytes of text, each of one part; every text is in one of them."""
    held, size, now = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        part, length = batch["part"].to_numpy(), pc.binary_length(batch["text"]).to_numpy().astype("int64")
        step = (np.cumsum(length) - length) // (BLOCK // 8)
        cuts = [0, *np.flatnonzero((np.diff(part) != 0) | (np.diff(step) != 0)) + 1, batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and (part[a] != now or size >= BLOCK):
                yield now, pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size, now = size + int(length[a:b].sum()), part[a]
    if held:
        yield now, pa.Table.from_batches(held)


def letters_of(texts):
    """All letters of the texts as code points, and how many each text has."""
    offsets, data = _bytes_of(texts)
    letters = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    if len(letters) < len(data):
        begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return letters, np.diff(begun[offsets])
    return letters, np.diff(offsets)


def _different(sorted_numbers):
    new = np.ones(len(sorted_numbers), bool)
    np.not_equal(sorted_numbers[1:], sorted_numbers[:-1], out=new[1:])
    return new


def block_postings(letters, counts, at):
    """Different pairs (triple, field) of a block in order: known letters, the triples, where the pairs of each begin, fields.

    A triple is a number whose digits are the ranks of its letters. ``at`` is counted from zero.
    """
    seen = np.zeros(LETTERS, bool)
    seen[letters] = True
    known = np.flatnonzero(seen)
    rank = np.zeros(LETTERS, "uint64")
    rank[known] = np.arange(len(known), dtype="uint64")
    base, bits = np.uint64(len(known)), int(at.max(initial=0)).bit_length()
    at, ends = at.astype("uint64"), np.cumsum(counts)
    found = []
    wide = len(known) ** TRIPLE << bits >= 1 << 64
    for first in range(0, len(letters) - TRIPLE + 1, STEP):
        last = min(first + STEP + TRIPLE - 1, len(letters))
        a, b = np.searchsorted(ends, (first, last - 1), side="right") + (0, 1)
        field = np.repeat(at[a:b], np.diff(np.minimum(ends[a:b], last), prepend=first))
        code = rank[letters[first:last]]
        code = (code[:-2] * base + code[1:-1]) * base + code[2:]
        inside = field[:-2] == field[2:]
        code, field = code[inside], field[:-2][inside]
        if wide:
            found.append(np.unique(np.stack([code, field]), axis=1))
        else:
            pair = np.sort(code << np.uint64(bits) | field)
            found.append(pair[_different(pair)])
    if wide:
        # letters of very many kinds: triples and fields do not fit one number
        code, field = np.unique(np.concatenate(found, axis=1), axis=1)
    else:
        pair = np.sort(np.concatenate([*found, np.zeros(0, "uint64")]))
        pair = pair[_different(pair)]
        code, field = pair >> np.uint64(bits), pair & np.uint64((1 << bits) - 1)
    begins = np.flatnonzero(_different(code))
    return known, code[begins], begins, field.astype("int64")


def block_lists(part, fields) -> pa.RecordBatch:
    """The rows to store for a block."""
    at = fields["at"].to_numpy().astype("int64")
    base = at.min()
    known, triples, begins, field = block_postings(*letters_of(fields["text"]), at - base)
    steps = np.diff(field, prepend=0)
    steps[begins] = field[begins]
    data, ends = pack(steps)
    ends = np.concatenate([ends[begins[1:] - 1], ends[-1:]])
    size = np.uint64(len(known))
    spelled = known[np.stack([triples // size // size, triples // size % size, triples % size], axis=1).astype("int64")]
    text = spelled.astype("<u4").tobytes().decode("utf-32-le")
    lists = pa.Array.from_buffers(pa.binary(), len(triples), [None, pa.py_buffer(np.concatenate([[0], ends]).astype("int32")), pa.py_buffer(data)])
    same = lambda v: pa.array(np.full(len(triples), v, "int32"))
    return pa.RecordBatch.from_arrays(
        [pa.array([text[i:i + TRIPLE] for i in range(0, len(text), TRIPLE)], pa.string()), same(part), same(base), lists],
        ["triple", "part", "base", "ats"])


def _packed(batches):
    for part, fields in blocks(batches):
        yield block_lists(part, fields)


def list_fields(ats, base):
    """Fields of stored lists one after the other, and how many each list has."""
    offsets, data = _bytes_of(ats)
    steps, ends = unpack(data)
    upto = np.searchsorted(ends, offsets, side="right")
    total = np.concatenate([[0], np.cumsum(steps)])
    counts = np.diff(upto)
    return total[1:] + np.repeat(base.astype("int64") - total[upto[:-1]], counts), counts


def _unpacked(batches):
    for batch in batches:
        at, counts = list_fields(batch["ats"], batch["base"].to_numpy())
        row = pa.array(np.repeat(np.arange(batch.num_rows), counts))
        rows = batch.take(row)
        yield pa.RecordBatch.from_arrays([rows["triple"], rows["part"], pa.array(at.astype("int32")), rows["slot"]],
                                         ["triple", "part", "at", "slot"])


# building and searching ----------------------------------------------------------------------------------------------


def build(records: DataFrame, path: str, columns, id_col="unique_id") -> TextIndex:
    """Index the text ``columns`` of ``records`` under ``path``; null texts match nothing and are left out.

    One scan, whose texts stay in their tasks, and one shuffle of the packed postings.
    """
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.lower(F.col(c)).alias("text")) for c in columns])
    rows = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.inline(fields)).where("text IS NOT NULL")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    (rows.select("field", "id", "text").sortWithinPartitions("field").select("*", F.spark_partition_id().alias("part"), row.alias("at"))
     .write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/fields"))
    stored = TextIndex(records.sparkSession, path).fields()
    lists = stored.select("text", "part", "at").mapInArrow(_packed, "triple string, part int, base int, ats binary")
    (lists.withColumn("slot", slot_of("triple")).repartition(SLOTS, "slot").sortWithinPartitions("slot", "triple", "part", "base")
     .write.mode("overwrite").partitionBy("slot").parquet(f"{path}/postings"))
    return TextIndex(records.sparkSession, path)


def pattern_triples(term: str) -> list:
    """Triples that every text with the term in it has; ``%`` and ``_`` of the term are wildcards."""
    parts = re.split("[%_]+", term.lower())
    return sorted({p[i:i + TRIPLE] for p in parts for i in range(len(p) - TRIPLE + 1)})


def contains(text, term: str):
    """``text LIKE '%term%'`` in one pass: each part between ``%`` is sought behind the one before and never anew.

    Parts have a fixed length, so that the first place of each leaves most room for the next.
    """
    if "\\" in term:
        return text.like(contains_pattern(term))
    spell = lambda part: "".join("." * len(s) if s[0] == "_" else rf"\Q{s}\E" for s in re.findall("_+|[^_]+", part))
    return text.rlike(r"(?s)\A" + "".join(f"(?>.*?{spell(p)})" for p in term.lower().split("%") if p))


def _words_of(triples: int):
    """Numbers of the fields of a block that have all triples, as set bits of words of 64 fields."""
    def words(table):
        at, _ = list_fields(table["ats"], table["base"].to_numpy())
        at, n = np.unique(at, return_counts=True)
        at = at[n >= triples]
        begins = np.flatnonzero(_different(at >> 6))
        bit = np.uint64(1) << (at & 63).astype("uint64")
        bits = np.bitwise_or.reduceat(bit, begins) if len(at) else bit
        part = np.full(len(begins), table["part"][0].as_py(), "int32")
        return pa.table({"part": part, "word": (at[begins] >> 6).astype("int32"), "bits": bits.view("int64")})
    return words


def matching_ids(index: TextIndex, term: str, columns) -> DataFrame:
    """``id`` of each record that has the term in one of the ``columns``, by the index alone.

    The candidates go to every task, a number of 64 bits for 64 fields; what is no candidate is not compared.
    """
    triples = pattern_triples(term)
    fields = index.fields().where(F.col("field").isin(*columns))
    matches = contains(F.col("text"), term)
    if triples:
        slots = index.spark.range(1).select(F.array_distinct(F.array(*(slot_of(F.lit(t)) for t in triples)))).first()[0]
        held = index.lists().where(F.col("slot").isin(*slots) & F.col("triple").isin(*triples)).select("part", "base", "ats")
        words = held.groupBy("part", "base").applyInArrow(_words_of(len(triples)), "part int, word int, bits bigint")
        fields = fields.withColumn("word", F.shiftright("at", 6)).join(F.broadcast(words), ["part", "word"])
        # a condition on both sides of the join cannot be moved before it
        matches = F.when(F.expr("getbit(bits, at & 63)") == 1, matches)
    return fields.where(matches).select("id").distinct()


def matching(records: DataFrame, index: TextIndex, term: str, columns, id_col="unique_id") -> DataFrame:
    """Records with the term in one of the ``columns``, found by the index: the rows that a scan with the pattern gives."""
    return records.join(matching_ids(index, term, columns).withColumnRenamed("id", id_col), id_col, "left_semi")


def matching_by_scan(records: DataFrame, term: str, columns) -> DataFrame:
    """The same by comparing all records."""
    pattern = contains_pattern(term)
    return records.where(reduce(lambda a, b: a | b, (F.lower(c).like(pattern) for c in columns)))
