"""Sorted hash arrays: numbers kept under 64-bit keys, and their lookup for all rows of a table.

A table of keys is dealt into buckets by the top bits of its hashes and stored as one sorted array of hashes and one of
values a bucket. Keys and hashes are one to one, so that no two keys clash.

A table of at most BOUND entries goes to every task. A larger one stays where it is: documents are stored in blocks,
each block asks every bucket for the hashes it holds, once each, and the answers come back to the block in their order.
Both ways give the same values.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from trustdesk.llm.common import column, kept_columns, map_arrow, parts_of, stored

#: Odd, so that keys and hashes are one to one.
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Entries that all tasks may have: some 100 MB.
BOUND = 1 << 22
#: Entries of one bucket.
BUCKET = 1 << 20
TABLE = "bucket int, hashes binary, numbers binary"


def hashed(keys: np.ndarray) -> np.ndarray:
    return keys.astype(np.uint64) * ODD


class Sorted:
    """Sorted hashes and their values in memory, searched from where their top bits say."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray):
        self.hashes, self.numbers = hashes, numbers
        bits = max(1, len(hashes).bit_length())
        self.shift = np.uint64(64 - bits)
        edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.begin = np.append(np.searchsorted(hashes, edges), len(hashes)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Values of the hashes; those of a hash that is not there are zero."""
        if not len(self.hashes):
            return np.zeros((len(wanted), *self.numbers.shape[1:]), self.numbers.dtype)
        top = (wanted >> self.shift).astype(np.int64)
        at, last = self.begin[top], len(self.hashes) - 1
        found = self.hashes[np.minimum(at, last)]
        todo = np.flatnonzero((found < wanted) & (at < last))
        while len(todo):
            at[todo] += 1
            more = self.hashes[at[todo]]
            found[todo] = more
            todo = todo[(more < wanted[todo]) & (at[todo] < last)]
        values = self.numbers[np.minimum(at, last)]
        lost = found != wanted
        if lost.any():
            values[lost] = 0
        return values


def store(entries: DataFrame, dtype: str, bucket=BUCKET):
    """The stored table of ``entries``, whose first column is the key and whose others are values, and its size.

    Each value becomes a ``dtype``. Keys must be distinct. Buckets are even, since hashes are.
    """
    key, *names = entries.columns
    entries = stored(entries, "entries")
    n = entries.count()
    bits = (n // bucket).bit_length()

    def deal(batches):
        for batch in batches:
            h = hashed(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            numbers = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype(dtype) for i in range(len(names))], 1)
            at = (h >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)
            order = np.lexsort((h, at))
            for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                if len(part):
                    yield packed(int(at[part[0]]), h[part], numbers[part])

    def merge(batches):
        held, now = [], None
        for batch in batches:
            for b, hashes, numbers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if b != now and held:
                    yield merged(now, held)
                    held = []
                now = b
                held.append((np.frombuffer(hashes, np.uint64), np.frombuffer(numbers, dtype).reshape(-1, len(names))))
        if held:
            yield merged(now, held)

    def packed(b, h, numbers):
        return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([h.tobytes()], pa.binary()),
                                           pa.array([numbers.tobytes()], pa.binary())], names=["bucket", "hashes", "numbers"])

    def merged(b, held):
        h, numbers = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
        order = np.argsort(h)
        return packed(b, h[order], numbers[order])

    dealt = entries.mapInArrow(deal, TABLE).repartition("bucket").sortWithinPartitions("bucket")
    return stored(dealt.mapInArrow(merge, TABLE), "table"), n, bits


def apply(docs: DataFrame, inputs, outputs: StructType, start, table, dtype: str, keep=None, bound=BOUND) -> DataFrame:
    """Add ``outputs`` to the rows of ``docs``, from its ``inputs`` columns and the values that ``table`` has for them.

    ``start()`` runs once a task and gives an object with ``hashes(*arrays)``, all hashes that a block of rows needs in
    chunks of any size, repeats included, and ``results(find, *arrays)``, its output arrays, where ``find`` turns
    hashes into values. Without rows in ``table`` all values are zero.
    """
    rows, n, bits = table
    if n <= bound:
        found = sorted((r["bucket"], bytes(r["hashes"]), bytes(r["numbers"])) for r in rows.collect())
        sent = docs.sparkSession.sparkContext.broadcast((b"".join(h for _, h, _ in found), b"".join(v for *_, v in found)))

        def begin():
            worker, (hashes, numbers) = start(), sent.value
            h = np.frombuffer(hashes, np.uint64)
            known = Sorted(h, shaped(numbers, len(h), dtype, worker.width))
            return lambda *arrays: worker.results(known.find, *arrays)

        return map_arrow(docs, inputs, outputs, begin, keep)
    return by_blocks(docs, inputs, outputs, start, rows, bits, dtype, keep)


def shaped(raw, n, dtype, width):
    return np.frombuffer(raw, dtype).reshape(n, width)


def by_blocks(docs, inputs, outputs, start, rows, bits, dtype, keep):
    stay = kept_columns(docs, keep, outputs.names)
    row = F.struct(*[column(c) for c in stay]) if stay else F.struct(F.lit(0).alias("_none"))
    source = docs.select(row.alias("row"), *[c.alias(f"in{i}") for i, c in enumerate(inputs)])
    schema = StructType([StructField("block", StringType()), StructField("rows", ArrayType(source.schema))])

    def pack(batches):
        for part in parts_of(batches):
            whole = pa.StructArray.from_arrays(part.columns, names=part.schema.names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)],
                names=schema.names)

    def opened(packed_rows):
        """Columns of each block of a batch."""
        for i in range(len(packed_rows)):
            yield packed_rows[i].values.flatten()

    def wanted(worker, arrays):
        parts = [np.unique(h) for h in worker.hashes(*arrays)]
        return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)

    def ask(batches):
        worker = start()
        for batch in batches:
            for block, (_, *arrays) in zip(batch.column(0).to_pylist(), opened(batch.column(1)), strict=True):
                h = wanted(worker, arrays)
                at = (h >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)
                parts = [p for p in np.split(np.arange(len(h)), np.flatnonzero(np.diff(at)) + 1) if len(p)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at[p[0]] for p in parts], pa.int32()), pa.array([1] * len(parts), pa.int32()),
                     pa.array([block] * len(parts), pa.string()), pa.array([h[p].tobytes() for p in parts], pa.binary()),
                     pa.array([None] * len(parts), pa.binary())], names=["bucket", "kind", "block", "hashes", "numbers"])

    def answer(batches):
        worker, known, now = start(), None, None
        for batch in batches:
            for b, kind, block, hashes, numbers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                h = np.frombuffer(hashes, np.uint64)
                if kind == 0:
                    known, now = Sorted(h, shaped(numbers, len(h), dtype, worker.width)), b
                    continue
                values = known.find(h) if now == b else np.zeros((len(h), worker.width), dtype)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([b], pa.int32()),
                                                  pa.array([values.tobytes()], pa.binary())], names=["block", "bucket", "numbers"])

    names = [*source.schema.names[:1], *[f"out{i}" for i in range(len(outputs))]]

    def finish(batches):
        worker = start()
        for batch in batches:
            for answers, (mine, *arrays) in zip(batch.column(2).to_pylist(), opened(batch.column(1)), strict=True):
                h = wanted(worker, arrays)
                got = b"".join(a["numbers"] for a in sorted(answers or [], key=lambda a: a["bucket"]))
                local = Sorted(h, shaped(got, len(h), dtype, worker.width))
                yield pa.RecordBatch.from_arrays([mine, *worker.results(local.find, *arrays)], names=names)

    blocks = stored(source.mapInArrow(pack, schema), "blocks")
    asked = blocks.mapInArrow(ask, "bucket int, kind int, block string, hashes binary, numbers binary")
    model = rows.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("block"), "hashes", "numbers")
    both = model.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", "kind")
    answers = both.mapInArrow(answer, "block string, bucket int, numbers binary")
    gathered = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "numbers")).alias("answers"))
    result = StructType([source.schema["row"], *[StructField(f"out{i}", f.dataType) for i, f in enumerate(outputs)]])
    done = blocks.join(gathered, "block", "left").select("block", "rows", "answers").mapInArrow(finish, result)
    return done.select(*[F.col("row").getField(c).alias(c) for c in stay],
                       *[F.col(f"out{i}").alias(n) for i, n in enumerate(outputs.names)])
