"""Cross-tokenizer alignment: which tokens of one vocabulary share bytes with which of another.

Both tokenizers see the same bytes, a space and the text. The token-byte incidence of each, a row a token and a column a byte, is
a sparse matrix in compressed rows that is built here from token lengths. Row products by Gustavson, A times B transposed,
give the overlap links with the number of bytes that two tokens share; those that end on the same byte are the links that
are counted. Offsets where tokens of both end cut the bytes into groups; rows of the transposed token-group incidences
are the groups, and their product gives the links of all tokens that share a group.

Both tokenizers start a token at a space between a character that is none and one that is not white space. Stretches between
such spaces are therefore tokenised and aligned on their own, each different one once as long as a task remembers it.
"""

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from trustdesk.llm import hash_arrays
from trustdesk.llm.common import lists, map_arrow, parts_of, stored, utf8
from trustdesk.llm.token_file import byte_letters

#: Different stretches and links that a task remembers; results do not depend on it.
REMEMBERED, LINKS = 500_000, 1 << 22
#: Stretches that the second tokenizer, whose work grows faster than its text, gets together.
IN_A_ROW = 24
#: Sums of products that are expanded together.
TOGETHER = 1 << 20
#: Different pairs that a task holds before it sends their counts.
HELD = 1 << 22
#: Code points whose class and white space all pattern engines agree on; other texts go to the slower library.
AGREED = re.compile("[\t\n\r -~¡-ɏЀ-ҁҊ-ӿ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥]*")
BETWEEN = re.compile(r"(?<=[^ ])(?= \S)")
ODD_SPACE = re.compile(r" (?:\s|\Z)")
OUTPUT = StructType([StructField(n, LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
                    + [StructField("groups", StringType())])


class Csr:
    """A sparse matrix in compressed rows."""

    def __init__(self, begins, columns, values, width):
        self.begins, self.columns, self.values, self.width = begins, columns, values, width

    @property
    def height(self):
        return len(self.begins) - 1

    def rows(self):
        return np.repeat(np.arange(self.height), np.diff(self.begins))

    def transposed(self):
        order = np.argsort(self.columns, kind="stable")
        begins = np.concatenate(([0], np.cumsum(np.bincount(self.columns, minlength=self.width))))
        return Csr(begins, self.rows()[order], self.values[order], self.height)


def incidence(owner_sizes, columns, width):
    """Rows with ones: row i has the next ``owner_sizes[i]`` of ``columns``."""
    return Csr(np.concatenate(([0], np.cumsum(owner_sizes))), columns, np.ones(len(columns), np.int64), width)


def product(a: Csr, b: Csr, together=TOGETHER):
    """Rows, columns and values of ``a`` times ``b`` in chunks of whole rows: each row of ``a`` adds up the rows of ``b``
    that its columns name."""
    sizes = np.diff(b.begins)
    work = np.concatenate(([0], np.cumsum(sizes[a.columns])))[a.begins]
    at = 0
    while at < a.height:
        end = max(at + 1, int(np.searchsorted(work, work[at] + together, "right")) - 1)
        mine = slice(a.begins[at], a.begins[end])
        n = sizes[a.columns[mine]]
        row = np.repeat(np.repeat(np.arange(at, end), np.diff(a.begins[at:end + 1])), n)
        first = np.repeat(b.begins[:-1][a.columns[mine]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(n) else n
        source = first + np.arange(len(row))
        key = row * b.width + b.columns[source]
        value = np.repeat(a.values[mine], n) * b.values[source]
        if len(key):
            if (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            yield key[head] // b.width, key[head] % b.width, np.add.reduceat(value, head)
        at = end


class Alignment:
    """Matrices, groups and links of two token sequences of the same bytes, from the tokens' lengths."""

    def __init__(self, a_sizes, b_sizes):
        self.a_ends, self.b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
        n = int(self.a_ends[-1]) if len(a_sizes) else 0
        self.a = incidence(a_sizes, np.arange(n), n)
        self.b = incidence(b_sizes, np.arange(n), n)
        self.group_ends = np.intersect1d(self.a_ends, self.b_ends, assume_unique=True)
        groups = len(self.group_ends)
        one = np.ones(len(a_sizes), np.int64), np.ones(len(b_sizes), np.int64)
        self.a_group = incidence(one[0], np.searchsorted(self.group_ends, self.a_ends), groups)
        self.b_group = incidence(one[1], np.searchsorted(self.group_ends, self.b_ends), groups)

    def overlaps(self):
        """Token of a, token of b and the bytes they share."""
        return joined(product(self.a, self.b.transposed()))

    def together(self):
        """The overlaps whose tokens end on the same byte."""
        i, j, _ = self.overlaps()
        same = self.a_ends[i] == self.b_ends[j]
        return i[same], j[same]

    def shared(self):
        """Chunks of token of a, token of b and 1 for tokens of one group; a group has all its pairs."""
        return product(self.a_group, self.b_group.transposed())

    def group_rows(self):
        """Tokens of a and of b by group."""
        return self.a_group.transposed(), self.b_group.transposed()


def joined(chunks):
    found = list(chunks)
    return tuple(np.concatenate([c[k] for c in found]) if found else np.empty(0, np.int64) for k in range(3))


class ByteLevel:
    """Byte-level BPE from a tokenizer file, without special tokens.

    Where the ids are the order of the merges, texts of AGREED code points are encoded by the ranks, which is faster; all
    others by the library that the file is for.
    """

    def __init__(self, body: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(body)
        self.library.encode_special_tokens = True
        model, letters = json.loads(body), byte_letters()
        vocabulary = model["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in vocabulary.items()}
        self.ranks = None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        special = {t["content"] for t in model["added_tokens"]}
        ordered = [i for i in (vocabulary.get(a + b, -1) for a, b in merges)] == list(range(256, 256 + len(merges)))
        cut = model["pre_tokenizer"] or {}
        if ordered and model["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get(
                "add_prefix_space"):
            import public_tokenizers
            import tiktoken

            ranks = {self.bytes_of[i]: i for t, i in vocabulary.items() if t not in special}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts):
        quick = [self.ranks is not None and AGREED.fullmatch(t) is not None for t in texts]
        slow = iter(self.library.encode_batch([t for t, q in zip(texts, quick, strict=True) if not q], add_special_tokens=False))
        return [self.ranks.encode_ordinary(t) if q else next(slow).ids for t, q in zip(texts, quick, strict=True)]


class Pieces:
    """Sentencepiece model with its pieces as bytes."""

    def __init__(self, body: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=body)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = {i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                         for i, p in enumerate(pieces)}
        # a piece with a space behind other text would cross the stretches
        self.whole = any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, texts):
        return self.model.encode(texts, num_threads=1)


class Stretches:
    """Aligned stretches of texts by number, with what is known of each; ``named`` ones have their groups in words."""

    def __init__(self, a: ByteLevel, b: Pieces, named=True):
        self.a, self.b, self.named = a, b, named
        size = max(a.bytes_of) + 1, max(b.bytes_of) + 1
        self.a_size = np.array([len(a.bytes_of.get(i, b"")) for i in range(size[0])])
        self.b_size = np.array([len(b.bytes_of.get(i, b"")) for i in range(size[1])])
        # ids in words with what follows: inside a group, at the end of its tokens of a, at its own end
        self.words = [f"{i}{mark}" for n, marks in zip(size, (",|", ",;"), strict=True) for mark in marks for i in range(n)]
        self.clear()

    def clear(self):
        self.number, self.text = {}, []
        self.valid = np.empty(0, bool)
        self.sizes = np.empty((0, 3), np.int64)
        self.pairs, self.pair_begins = np.empty(0, np.int64), np.zeros(1, np.int64)

    def cut(self, text):
        if self.b.whole:
            return [text]
        spaced = " " + text
        return [s[1:] for s in BETWEEN.split(spaced)] if ODD_SPACE.search(spaced) else text.split(" ")

    def encode(self, stretches):
        """Ids of both for all stretches in a row, the tokens of each, and which of them spell their bytes; others have none.

        Stretches that end in a character which is no space are encoded as one text, since tokens start where they do.
        """
        raw = [len(s.encode()) + 1 for s in stretches]
        if not self.b.whole and not any(s.endswith(" ") for s in stretches):
            text = " ".join(stretches)
            whole, ends = (" " + text).encode(), np.cumsum(raw)
            rows = [" ".join(stretches[k:k + IN_A_ROW]) for k in range(0, len(stretches), IN_A_ROW)]
            ids = [np.array(x, np.int64) for x in (self.a.encode([" " + text])[0], [i for x in self.b.encode(rows) for i in x])]
            stops = [np.cumsum(size[x]) for x, size in zip(ids, (self.a_size, self.b_size), strict=True)]
            at = [np.searchsorted(x, ends) for x in stops]
            if all(len(x) and x[-1] == len(whole) and (x[i] == ends).all() for x, i in zip(stops, at, strict=True)) and all(
                    b"".join(map(v.bytes_of.__getitem__, x.tolist())) == whole for v, x in zip((self.a, self.b), ids, strict=True)):
                return ids, [np.diff(i, prepend=-1) for i in at], np.array(raw), np.ones(len(stretches), bool)
        spaced = [" " + s for s in stretches]
        found = self.a.encode(spaced), self.b.encode(stretches)
        good = np.array([b"".join(map(self.a.bytes_of.__getitem__, x)) == s.encode() == b"".join(map(self.b.bytes_of.__getitem__, y))
                         for x, y, s in zip(*found, spaced, strict=True)])
        kept = [[x if g else [] for x, g in zip(ids, good, strict=True)] for ids in found]
        return ([np.array([i for x in ids for i in x], np.int64) for ids in kept],
                [np.array(list(map(len, ids)), np.int64) for ids in kept], np.where(good, raw, 0), good)

    def add(self, stretches):
        """Align new stretches in one go."""
        (a, b), (a_n, b_n), sizes, good = self.encode(stretches)
        found = Alignment(self.a_size[a], self.b_size[b])
        i, j = found.together()
        # bytes of the valid stretches end where groups end, so that each has whole groups and links
        ends = np.cumsum(sizes)
        groups = np.diff(np.searchsorted(found.group_ends, ends, "right"), prepend=0)
        link_at = np.searchsorted(found.a_ends[i], ends, "right")
        if self.named:
            self.text += self.groups_of(found, a, b, np.cumsum(a_n + b_n))
        self.number.update(zip(stretches, range(len(self.valid), len(self.valid) + len(stretches)), strict=True))
        self.valid = np.concatenate([self.valid, good])
        self.sizes = np.concatenate([self.sizes, np.stack([a_n, b_n, groups], 1)])
        self.pairs = np.concatenate([self.pairs, a[i] << 32 | b[j]])
        self.pair_begins = np.concatenate([self.pair_begins, self.pair_begins[-1] + link_at])

    def groups_of(self, found, a, b, ends):
        """The groups of each stretch in words, by the rows of both group incidences."""
        words, codes, at = self.words, [], []
        first = 0
        for ids, rows, n in zip((a, b), found.group_rows(), (len(self.a_size), len(self.b_size)), strict=True):
            last = np.zeros(len(ids), np.int64)
            last[rows.begins[1:] - 1] = n
            codes.append(ids[rows.columns] + last + first)
            at.append(rows.rows() * 2 + len(at))
            first += 2 * n
        order = np.argsort(np.concatenate(at), kind="stable")
        made = list(map(words.__getitem__, np.concatenate(codes)[order].tolist()))
        ends = ends.tolist()
        return ["".join(made[x:y])[:-1] for x, y in zip([0, *ends[:-1]], ends, strict=True)]

    def numbers(self, texts):
        """Numbers of each text's stretches, and whether the text has tokens."""
        if len(self.valid) > REMEMBERED or len(self.pairs) > LINKS:
            self.clear()
        cut = [self.cut(t) if t else [] for t in texts]
        new = list({s for c in cut for s in c if s not in self.number})
        if new:
            self.add(new)
        number = self.number.__getitem__
        found = [np.fromiter(map(number, c), np.int64, len(c)) for c in cut]
        known = [bool(len(x)) and bool(self.valid[x].all()) for x in found]
        return found, known


def decoded(texts):
    """Texts of byte strings; None where they are no UTF-8, which no token has."""
    out = []
    for t in texts.to_pylist():
        try:
            out.append((t or b"").decode())
        except UnicodeDecodeError:
            out.append("")
    return out


class Worker:
    """Digest of the alignment of blocks of texts, once the counts of id pairs are known."""

    width = 2

    def __init__(self, stretches):
        self.stretches = stretches

    def hashes(self, texts):
        found, known = self.stretches.numbers(decoded(texts))
        mine = [x for x, k in zip(found, known, strict=True) if k]
        if mine:
            yield hash_arrays.hashed(taken(self.stretches, np.unique(np.concatenate(mine))))

    def results(self, find, texts):
        s = self.stretches
        found, known = s.numbers(decoded(texts))
        sizes, links = s.sizes, np.diff(s.pair_begins)
        used = np.unique(np.concatenate([x for x, k in zip(found, known, strict=True) if k])) if any(known) else np.empty(0, np.int64)
        counts = find(hash_arrays.hashed(taken(s, used)))
        sums = np.zeros((len(s.valid), 2), np.int64)
        if len(used):
            begins = np.concatenate(([0], np.cumsum(links[used])[:-1]))
            sums[used] = np.add.reduceat(counts, begins, axis=0)
        rows = np.zeros((len(found), 6), np.int64)
        groups = []
        for r, (x, k) in enumerate(zip(found, known, strict=True)):
            if k:
                rows[r] = *sizes[x].sum(0), links[x].sum(), sums[x, 1].sum(), sums[x, 0].sum()
            groups.append(";".join([s.text[i] for i in x.tolist()]) if k else "")
        return [*[pa.array(rows[:, c]) for c in range(6)], pa.array(groups, pa.string())]


def taken(s: Stretches, numbers):
    """Pairs of the links of these stretches."""
    begins, n = s.pair_begins[numbers], np.diff(s.pair_begins)[numbers]
    first = np.repeat(begins - np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(n) else n
    return s.pairs[first + np.arange(len(first))] if len(first) else np.empty(0, np.int64)


def tokenizers_of(docs: DataFrame, a_path: str, b_path: str, named=True):
    """Both tokenizer files, a few megabytes whatever the input, for every task."""
    with open(a_path) as a, open(b_path, "rb") as b:
        sent = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))
    return lambda: Stretches(ByteLevel(sent.value[0]), Pieces(sent.value[1]), named)


def pair_counts(docs: DataFrame, a_path, b_path, text="text") -> DataFrame:
    """``pair`` (id of a and of b in one number), ``n``, the links that hold it in all documents, and ``best``, 1 where no
    other pair of its b id has more."""
    start = tokenizers_of(docs, a_path, b_path, named=False)

    def run(batches):
        stretches, pairs, counts, size = None, [], [], 0

        def sums():
            keys, which = np.unique(np.concatenate(pairs), return_inverse=True)
            n = np.bincount(which, np.concatenate(counts), len(keys)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            stretches = stretches or start()
            for part in parts_of([batch]):
                found, known = stretches.numbers(decoded(part.column(0)))
                mine = [x for x, k in zip(found, known, strict=True) if k]
                if not mine:
                    continue
                times = np.bincount(np.concatenate(mine))
                used = np.flatnonzero(times)
                keys, which = np.unique(taken(stretches, used), return_inverse=True)
                n = np.bincount(which, np.repeat(times[used], np.diff(stretches.pair_begins)[used]), len(keys))
                pairs.append(keys)
                counts.append(n)
                size += len(keys)
                if size > HELD:
                    yield sums()
                    pairs, counts, size = [], [], 0
        if pairs:
            yield sums()

    n = stored(docs.select(utf8(text)).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = n.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return n.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, text="text", keep=None, bound=hash_arrays.BOUND) -> DataFrame:
    """``docs`` with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups``.

    Links are the token pairs that end on the same byte; the count of an id pair is the number of links that hold it in all
    documents. ``n_best`` are the links whose count is the highest of their b id, ``count_sum`` adds up the counts of all.
    ``groups`` lists each group's ids as ``a1,a2|b1``, joined by ``;``. Null and empty texts and those whose tokens do not
    spell a space and the text have zeros and no groups; repeated rows count each. Columns of these names are replaced.
    """
    start = tokenizers_of(docs, a_path, b_path)
    table = hash_arrays.store(pair_counts(docs, a_path, b_path, text), "<i8")
    return hash_arrays.apply(docs, [utf8(text)], OUTPUT, lambda: Worker(start()), table, "<i8", keep, bound)


def links(docs: DataFrame, a_path: str, b_path: str, text="text", keep=None) -> DataFrame:
    """``docs`` with ``a_ids``, ``b_ids`` and, as positions in those, ``overlap_a``, ``overlap_b``, ``overlap_bytes`` (tokens that
    share bytes) and ``shared_a``, ``shared_b`` (tokens of one group, all pairs of it)."""
    start = tokenizers_of(docs, a_path, b_path)
    names = ["a_ids", "b_ids", "overlap_a", "overlap_b", "overlap_bytes", "shared_a", "shared_b"]

    def begin():
        s = start()

        def one(body):
            if not body:
                return [[]] * 7
            a, b = s.a.encode([" " + body])[0], s.b.encode([body])[0]
            raw = (" " + body).encode()
            if not b"".join(map(s.a.bytes_of.__getitem__, a)) == raw == b"".join(map(s.b.bytes_of.__getitem__, b)):
                return [[]] * 7
            found = Alignment(s.a_size[np.array(a)], s.b_size[np.array(b)])
            shared = joined(found.shared())
            return [a, b, *found.overlaps(), *shared[:2]]

        return lambda texts: [lists([np.asarray(x, np.int32) for x in column], np.int32)
                              for column in zip(*map(one, decoded(texts)), strict=True)]

    return map_arrow(docs, [utf8(text)], StructType([StructField(n, ArrayType(IntegerType())) for n in names]), begin, keep)
