"""Document fingerprints by I-Match over several randomised lexicons, with DataFrame functions only.

The lexicon holds the terms whose share of the different texts lies in a band: rarer terms are often errors, more frequent
ones say little. SUBSETS random sub-lexicons overlap; each term is in EACH of them, drawn by its hash. For each
sub-lexicon the sorted distinct terms that a text has of it are hashed into one signature, and one more signature hashes
all terms of the text, whatever their band. A fingerprint lists these signatures, of the sub-lexicons that the text
has terms in; it follows from the text and the lexicon alone, so that equal texts have equal ones. Two texts are as alike as
the share of signatures that agree, among the sub-lexicons that either has. Two texts without any word are alike.
"""

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from trustdesk.llm.common import column, kept_columns, stored

#: Band of the share of documents that hold a term. Its lower end bounds the lexicon: there are at most (distinct terms
#: a document) / LEAST such terms, however many documents there are, so that all tasks can have it.
LEAST, MOST = 0.005, 0.1
#: Sub-lexicons, and those that a term is in: each is a random share of EACH / SUBSETS of the lexicon.
SUBSETS, EACH = 128, 2
#: Repeated texts whose hashes, 16 bytes each, may go to every task.
REPEATED = 1 << 20
#: Slots of the table that the lexicon is looked up in.
SLOTS = 1 << 14
#: Documents of one range of ids when each meets its next one, and ranges at most, which bounds what the driver holds.
NEAR_ROWS, NEAR_RANGES = 2048, 4096
NO_ID = -(2**63)


def terms(text: Column) -> Column:
    """Hashes of the distinct words of a text: lower case, letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text="text", least=LEAST, most=MOST) -> DataFrame:
    """Hashes of the terms in the band, counted over the different texts; two of them at least must share a term.

    All rows are counted, then the repeats of a text are taken off again: only hashes of texts move to find those that
    occur more than once, and only such texts move to be counted once. Counts are summed in each task before a shuffle.
    Texts are told apart by a 64-bit hash.
    """
    rows = docs.select(column(text).alias("text"), F.xxhash64(column(text)).alias("same"))
    copies = stored(rows.groupBy("same").agg(F.count("*").alias("copies")), "copies")
    total, again = copies.count(), copies.where(F.col("copies") > 1)
    # a list of that size goes to every task, so that texts that occur once stay where they are; a longer one is joined
    again = F.broadcast(again) if again.count() <= REPEATED else again
    repeated = rows.join(again, "same").dropDuplicates(["same"])
    counted = rows.select("text", F.lit(1).cast("long").alias("weight")).unionByName(
        repeated.select("text", (1 - F.col("copies")).alias("weight")))
    seen = counted.select(F.explode(terms(F.col("text"))).alias("term"), "weight").groupBy("term").agg(F.sum("weight").alias("n"))
    return seen.where((F.col("n") >= 2) & (F.col("n") >= least * total) & (F.col("n") <= most * total)).select("term")


def in_lexicon(found: Column, table: Column) -> Column:
    return F.filter(found, lambda t: F.array_contains(F.get(table, F.pmod(t, F.lit(SLOTS)).cast("int")), t))


def packed(subset, sign):
    return F.shiftleft(subset.cast("long"), 32).bitwiseOR(sign.bitwiseAND(F.lit(0xFFFFFFFF)))


def signatures(found: Column, table: Column) -> Column:
    """Number of the sub-lexicon and signature, packed, for each sub-lexicon that the terms ``found`` are in, in order, and
    SUBSETS with the signature of all of them last; nothing without a term."""
    def member(t, k):
        first, step = F.shiftrightunsigned(t, 32).bitwiseAND(F.lit(SUBSETS - 1)), F.shiftrightunsigned(t, 44).bitwiseAND(F.lit(0xFFF))
        return F.struct((first + k * (1 + step % (SUBSETS - 1))).bitwiseAND(F.lit(SUBSETS - 1)).alias("subset"), t.alias("term"))

    def add(state, x):
        own = state["subset"] == x["subset"]
        return F.struct(
            F.when(own | (state["subset"] < 0), state["done"]).otherwise(
                F.concat(state["done"], F.array(packed(state["subset"], state["sign"])))).alias("done"),
            x["subset"].alias("subset"),
            F.when(own, F.xxhash64(state["sign"], x["term"])).otherwise(F.xxhash64(x["term"])).alias("sign"))

    used = in_lexicon(found, table)
    members = F.concat(*[F.transform(used, of_subset(member, k)) for k in range(EACH)])
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(-1).cast("long").alias("subset"),
                     F.lit(0).cast("long").alias("sign"))
    banded = F.aggregate(F.array_sort(members), start, add, lambda s: F.when(s["subset"] < 0, s["done"]).otherwise(
        F.concat(s["done"], F.array(packed(s["subset"], s["sign"])))))
    whole = F.array(packed(F.lit(SUBSETS), F.xxhash64(F.array_sort(found))))
    return F.when(F.size(found) == 0, F.array().cast("array<bigint>")).otherwise(F.concat(banded, whole))


def of_subset(member, k):
    return lambda t: member(t, k)


def likeness(a: Column, b: Column) -> Column:
    """Share of signatures that agree, between 0 and 1."""
    def subsets(x):
        return F.transform(x, lambda s: F.shiftrightunsigned(s, 32))

    either = F.size(a) + F.size(b) - F.size(F.array_intersect(subsets(a), subsets(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(signs: Column) -> Column:
    return F.array_join(F.transform(signs, lambda s: F.lower(F.lpad(F.hex(s), 10, "0"))), ".")


def with_signatures(docs: DataFrame, text="text", name="signatures", **band) -> DataFrame:
    """``docs`` with the signatures of each text; a null text counts as empty."""
    table = lookup(docs, text, **band)
    stay = kept_columns(docs, None, [name])
    whole = F.coalesce(column(text), F.lit(""))
    return docs.select(*[column(c) for c in stay], signatures(terms(whole), table).alias(name))


def lookup(docs: DataFrame, text="text", least=LEAST, most=MOST) -> Column:
    """The table of the lexicon as a constant: in each slot the terms with its low bits.

    The band bounds its size (see LEAST), a few terms for each one that a document holds; it is folded once a query.
    """
    table = [[] for _ in range(SLOTS)]
    for r in lexicon(docs, text, least, most).sort("term").collect():
        table[r["term"] % SLOTS].append(r["term"])
    return F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<array<bigint>>")


def with_next(docs: DataFrame, order: Column, tie, made: dict, wanted: dict, rows=NEAR_ROWS) -> DataFrame:
    """``docs`` with the columns ``made`` and with ``wanted`` columns of the next document in descending ``order``; after the last comes the first.

    Documents are dealt by ranges of the order. The largest document of a range also goes, as a guest, to the range
    above, where it follows the smallest, and the largest of all follows the smallest of all. A range has about ``rows``
    documents or, beyond NEAR_RANGES ranges, as many as that number of ranges leaves. ``wanted`` are computed after
    documents have moved.
    """
    n = docs.count()
    ranges = min(NEAR_RANGES, max(1, -(-n // rows)))
    shares = [i / ranges for i in range(1, ranges + 1)]
    found = docs.agg(F.percentile_approx(order, shares, 10 * ranges).alias("b")).first()["b"] if n else None
    bounds = sorted(set(found or [0]))
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    edge = F.lit(bounds)
    at = F.aggregate(F.lit(steps), F.lit(0), lambda below, step: F.when(
        (below + step <= len(bounds)) & (F.get(edge, below + step - 1) < F.col("_order")), below + step).otherwise(below))
    placed = docs.withColumn("_order", order).withColumn("_at", at)
    own = F.struct(F.col("_at").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("_at") + 1, F.lit(len(bounds))).alias("range"), F.lit(True).alias("guest"))
    largest = F.get(edge, F.col("_at")) == F.col("_order")
    dealt = placed.withColumn("_in", F.explode(F.when(largest, F.array(own, guest)).otherwise(F.array(own))))
    line = Window.partitionBy("_range").orderBy("_guest", F.desc("_order"), *tie)
    dealt = dealt.withColumns({"_range": F.col("_in.range"), "_guest": F.col("_in.guest")}).drop("_in", "_at")
    for name, c in made.items():
        dealt = (dealt.repartition("_range") if name == next(iter(made)) else dealt).withColumn(name, c)
    dealt = dealt.withColumns({name: F.lead(c).over(line) for name, c in wanted.items()})
    return dealt.where(~F.col("_guest")).drop("_range", "_guest", "_order")


def against_edits(docs: DataFrame, doc_id="doc_id", text="text", **band) -> DataFrame:
    """Fingerprints of each document and of its text with the last third replaced by the head of the next document's.

    Rows without an id come last; rows of one id follow each other by text. A null text is empty. Texts move once, alone;
    signatures are made where they arrive.
    """
    rows = docs.select(column(doc_id).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    table = lookup(rows, "text", **band)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    met = with_next(rows, order, ["text"], {"terms": terms(F.col("text")), "signs": signatures(F.col("terms"), table)},
                    {"next_text": F.col("text"), "next_signs": F.col("signs")})
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - third), F.left("next_text", third))
    out = met.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "signs", "next_signs")
    out = out.withColumn("edited_terms", terms(F.col("edited"))).withColumn("edited_signs", signatures(F.col("edited_terms"), table))
    return out.select("doc_id", "n_chars", "edited", as_text(F.col("signs")).alias("fingerprint"),
                      as_text(F.col("edited_signs")).alias("edited_fingerprint"),
                      likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
                      likeness(F.col("signs"), F.col("next_signs")).alias("near_next"))
