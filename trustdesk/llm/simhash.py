"""Near-duplicates by SimHash, found through the generalised pigeonhole principle.

A fingerprint has a bit where over half the hashes of a document's word shingles have it. The 64 bits are dealt into
partitions of correlated bits. With thresholds t of at least -1 whose t + 1 add up to d + 1, two fingerprints that
differ in d bits or fewer differ in at most t bits in some partition; a threshold of -1 leaves its partition out. The
number of partitions and their thresholds come from a dynamic program over the probes and the candidates that each
would cost, estimated from the bits of all fingerprints. Each distinct fingerprint probes every value within the
threshold and candidates are verified on all bits.
"""

from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trustdesk.llm.common import column, map_arrow, stored, utf8
from trustdesk.llm.components import components

BITS, SEED = 64, 42
#: Cost of a probe, that is a row through a shuffle, in comparisons of two fingerprints.
PROBE = 25
#: A value that more distinct fingerprints share is searched through a pivot instead of pair by pair.
CROWD = 1000


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    if len(words) < shingle:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[a:b], SEED) for a, b in zip([0, *(e + 1 for e in ends)], ends[shingle - 1:], strict=False)]
    ones = np.zeros(BITS, np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[begin:begin + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle=4, text="text", keep=None) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long; 0 for a null or wordless text."""
    def start():
        return lambda texts: [pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())]

    return map_arrow(docs, [utf8(text)], StructType([StructField("fp", LongType())]), start, keep)


def bit_counts(distinct: DataFrame):
    """Rows and, for each two bits, the rows that have both, over all fingerprints: one 64 by 64 sum a task."""
    def run(batches):
        total = np.zeros((BITS, BITS), np.int64)
        rows = 0
        for batch in batches:
            raw = batch.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float64)
            total += (bits.T @ bits).astype(np.int64)
            rows += len(bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BITS * BITS + 1), pa.int32()), pa.array(np.append(total.ravel(), rows))], names=["cell", "n"])

    summed = distinct.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = np.zeros(BITS * BITS + 1, np.int64)
    for r in summed.collect():
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def correlated_groups(rows, both, parts):
    """Bits in ``parts`` groups of even size; each group grows by the bit most correlated with it."""
    p = np.diag(both) / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs(both / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        seed = max(left, key=lambda b: (related[b, left].sum(), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(left, key=lambda b: (related[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def within(rows, both, group, radius):
    """Estimated chance that two fingerprints differ in at most 0, 1, ... ``radius`` bits of a group."""
    p = np.diag(both)[group] / max(rows, 1)
    chance = np.zeros(radius + 1)
    chance[0] = 1
    for differ in 2 * p * (1 - p):
        chance[1:] = chance[1:] * (1 - differ) + chance[:-1] * differ
        chance[0] *= 1 - differ
    return np.cumsum(chance)


def allocate(rows, both, distance):
    """Partitions and thresholds of least estimated cost: ``[(bits, threshold), ...]`` without left-out ones."""
    best = None
    for parts in range(1, distance + 2):
        groups = correlated_groups(rows, both, parts)
        # plans[s]: cost and thresholds of the partitions so far whose thresholds plus one add up to s
        plans = {0: (0.0, [])}
        for group in groups:
            chance, grown = within(rows, both, group, distance), {}
            for used, (cost, chosen) in plans.items():
                for t in range(-1, min(distance - used, len(group) - 1) + 1):
                    probes = sum(comb(len(group), e) for e in range(t + 1))
                    more = rows * (rows * chance[t] / 2 + PROBE * (probes + 1)) if t >= 0 else 0.0
                    if used + t + 1 not in grown or cost + more < grown[used + t + 1][0]:
                        grown[used + t + 1] = cost + more, [*chosen, (group, t)]
            plans = grown
        if distance + 1 in plans and (best is None or plans[distance + 1][0] < best[0]):
            best = plans[distance + 1]
    return [(group, t) for group, t in best[1] if t >= 0]


def signed(n):
    return n - (1 << BITS) if n >> (BITS - 1) else n


def patterns(group, radius):
    """Differences within a radius on the bits of a group."""
    return [signed(sum(1 << b for b in bits)) for e in range(radius + 1) for bits in combinations(group, e)]


def differing(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(distinct: DataFrame, distance: int, crowd=CROWD) -> DataFrame:
    """Edges between distinct fingerprints whose components are those of all pairs within ``distance`` bits.

    Under values that few fingerprints share, all close pairs are edges. Under a crowded value, each fingerprint near
    the pivot of the value is linked to it; what this already joins need not be compared, so that only fingerprints
    that do not belong to the pivot's component are compared with the others, exactly.
    """
    rows, both = bit_counts(distinct)
    plan = allocate(rows, both, distance) if rows else []
    if not plan:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where("false")
    masks = [signed(sum(1 << b for b in group)) for group, _ in plan]
    entry = [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)]
    index = distinct.select(F.col("fp").alias("y"), F.explode(F.array(*entry)).alias("e")).select("e.*", "y")
    near = [distinct.select(F.lit(i).alias("part"), F.col("fp").alias("x"), F.explode(F.lit(patterns(group, t))).alias("p"))
            .select("part", F.col("x").bitwiseAND(F.lit(m)).bitwiseXOR(F.col("p")).alias("value"), "x")
            for i, ((group, t), m) in enumerate(zip(plan, masks, strict=True))]
    probes = near[0]
    for more in near[1:]:
        probes = probes.unionByName(more)
    key = ["part", "value"]
    crowded = stored(index.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(key), "crowded")
    close = differing("x", "y") <= distance
    if not crowded.limit(1).count():
        return probes.join(index, key).where((F.col("x") < F.col("y")) & close).select(
            F.col("x").alias("u"), F.col("y").alias("v"))
    pairs = probes.join(crowded, key, "left_anti").join(index, key).where((F.col("x") < F.col("y")) & close)
    many_probes, many = probes.join(crowded, key, "left_semi"), index.join(crowded, key, "left_semi")
    pivot = many.groupBy(key).agg(F.min_by("y", F.xxhash64("y")).alias("pivot"))
    star = many_probes.join(pivot, key).where((differing("x", "pivot") <= distance) & (F.col("x") != F.col("pivot")))
    first = stored(pairs.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(
        star.select(F.col("x").alias("u"), F.col("pivot").alias("v"))).distinct(), "links")
    root = stored(components(first), "roots")

    def labelled(df, name, label):
        at = root.select(F.col("node").alias(name), F.col("root").alias(label))
        return df.join(at, name, "left").withColumn(label, F.coalesce(label, name))

    centre = labelled(pivot, "pivot", "centre").drop("pivot")
    right = labelled(many, "y", "ly").join(centre, key).withColumn("other", F.col("ly") != F.col("centre"))
    left = labelled(many_probes, "x", "lx").join(centre, key)
    left = left.withColumn("other", F.explode(F.when(F.col("lx") == F.col("centre"), F.array(F.lit(True)))
                                              .otherwise(F.array(F.lit(True), F.lit(False)))))
    rest = left.drop("centre").join(right.drop("centre"), [*key, "other"]).where((F.col("lx") != F.col("ly")) & close)
    return first.unionByName(rest.select(F.col("lx").alias("u"), F.col("ly").alias("v")).distinct())


def owners(marked: DataFrame, distance: int, crowd=CROWD) -> DataFrame:
    """For each distinct ``fp`` of ``marked`` its smallest ``doc_id``, ``least``, and ``root``, which names its component."""
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    root = components(links(distinct, distance, crowd)).withColumnRenamed("node", "fp")
    return stored(distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "owner")


def near_duplicates(docs: DataFrame, distance=4, shingle=4, doc_id="doc_id", text="text", crowd=CROWD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp`` and ``component_id``, the smallest id of its component.

    Null and wordless texts have fingerprint 0 and link like any other. Rows without an id are members but name no
    component; a component of such rows only has a null one. Equal fingerprints are one node, so copies cost a sum.
    """
    marked = stored(fingerprints(docs.withColumnRenamed(doc_id, "doc_id"), shingle, text, keep=["doc_id"]), "fingerprints")
    owner = owners(marked, distance, crowd)
    named = owner.groupBy("root").agg(F.min("least").alias("component_id"))
    of = owner.join(named, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")


def row_hash(docs: DataFrame):
    """A hash of all columns but maps, which tells rows of one id, or of none, apart."""
    return F.xxhash64(*[column(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])


def rows_of(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """``doc_id``, ``text`` and ``row``, the hash of the row."""
    return docs.select(column(doc_id).alias("doc_id"), row_hash(docs).alias("row"), column(text).alias("text"))


def keep_one(docs: DataFrame, distance=4, shingle=4, doc_id="doc_id", text="text", crowd=CROWD) -> DataFrame:
    """One row of each component, with all its columns: that of smallest id, a row without an id if there is no other.

    Rows are chosen one by one, so that a repeated or missing id removes no row whose text is not a copy. Rows without an id
    come last, rows of one id follow each other by their hash; of rows that are the same in all columns one stays. The
    least row of a fingerprint is taken in each task before any shuffle, so that copies cost a minimum and no join.
    """
    marked = stored(fingerprints(rows_of(docs, doc_id, text), shingle, keep=["doc_id", "row"]), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    distinct = stored(marked.groupBy("fp").agg(F.min(rank).alias("least")), "distinct")
    root = components(links(distinct.select("fp"), distance, crowd)).withColumnRenamed("node", "fp")
    named = distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    chosen = named.groupBy("root").agg(F.min("least").alias("least")).select(
        F.col("least.doc_id").alias("_chosen_id"), F.col("least.row").alias("_chosen_row"))
    whole = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("_whole"),
                        column(doc_id).alias("_id"), row_hash(docs).alias("_row"))
    kept = whole.join(chosen, (F.col("_row") == F.col("_chosen_row")) & F.col("_id").eqNullSafe(F.col("_chosen_id")), "left_semi")
    if marked.groupBy("doc_id", "row").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["_id", "_row"])
    return kept.select(*[F.col("_whole").getField(c).alias(c) for c in docs.columns])
