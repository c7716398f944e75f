"""Byte-level BPE by a sentencepiece model that is written straight from a rank vocabulary.

Every byte stands for one character, so a token's bytes are a piece of text; the score of a piece is its negative
rank, so that the merge of lowest rank comes first; the normaliser is the identity. Texts are cut into pre-tokens by
the pattern of the vocabulary, each is encoded by the model on its own, and ids are decoded through the inverse of the
byte mapping.
"""

import base64
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from trustdesk.llm.common import column, lists, map_arrow, utf8

#: Character of byte b is chr(BASE + b): letters without case or width rules, none of them white space.
BASE = 0x100
#: Entries that a task keeps of each of its two caches; full caches start anew, results do not depend on it.
CACHE = 60_000
#: White space beyond ASCII: texts that hold it are cut by the pattern alone.
OTHER_SPACE = "[\x1c-\x1f\x85\xa0  -     　]"
#: Field numbers and kinds of the public model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
KIND_NORMAL, KIND_UNKNOWN, MODEL_BPE = 1, 2, 2
TRAINER_KIND, TRAINER_SIZE, TRAINER_UNKNOWN, TRAINER_START, TRAINER_END, TRAINER_PAD = 3, 4, 40, 41, 42, 43
NORMALIZER_NAME, NORMALIZER_PREFIX, NORMALIZER_SPACES, NORMALIZER_ESCAPE = 1, 3, 4, 5


def read_ranks(spark: SparkSession, path: str) -> dict:
    """Token bytes by rank from a rank file; bounded by the vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def number(field, n):
    return varint(field << 3) + varint(n)


def chunk(field, body):
    return varint(field << 3 | 2) + varint(len(body)) + body


def piece(text, score, kind):
    return chunk(PIECES, chunk(PIECE_TEXT, text.encode()) + varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", score)
                 + number(PIECE_KIND, kind))


def to_text(token: bytes) -> str:
    return token.decode("latin-1").translate(BYTE_TEXT)


BYTE_TEXT = {b: BASE + b for b in range(256)}


def model_bytes(ranks: dict) -> bytes:
    """A sentencepiece model whose piece ids are the ranks, with one unknown piece behind them.

    Ranks must run from 0 without a gap and hold every single byte.
    """
    by_rank = {r: t for t, r in ranks.items()}
    if set(by_rank) != set(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0, 1, 2, ... and include every byte")
    size = len(ranks)
    pieces = [piece(to_text(by_rank[r]), float(-r), KIND_NORMAL) for r in range(size)]
    trainer = number(TRAINER_KIND, MODEL_BPE) + number(TRAINER_SIZE, size + 1) + number(TRAINER_UNKNOWN, size)
    trainer += b"".join(number(f, -1) for f in (TRAINER_START, TRAINER_END, TRAINER_PAD))
    normalizer = chunk(NORMALIZER_NAME, b"identity")
    normalizer += b"".join(number(f, 0) for f in (NORMALIZER_PREFIX, NORMALIZER_SPACES, NORMALIZER_ESCAPE))
    return b"".join(pieces) + piece("<unk>", 0.0, KIND_UNKNOWN) + chunk(TRAINER, trainer) + chunk(NORMALIZER, normalizer)


class Encoder:
    """Encodes texts; pre-tokens and the stretches between white space and white space are looked up when seen again."""

    def __init__(self, model: bytes, pattern: str, ranks: dict):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern)
        # a token starts wherever white space follows other text, so these stretches can be encoded apart
        self.stretch = re.compile(r"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")
        self.odd = re.compile(OTHER_SPACE)
        self.whole = ranks
        self.tokens, self.stretches = {}, {}

    def fill(self, texts):
        """Encode stretches that are not known yet, all their new pre-tokens in one call."""
        cuts = [self.cut.findall(t) for t in texts]
        if len(self.tokens) > CACHE:
            self.tokens = {}
        new = list({t for c in cuts for t in c if t not in self.tokens})
        raw = [t.encode("utf-8", "surrogatepass") for t in new]
        # a token of the vocabulary stands for itself, whatever its merges
        merged = iter(self.pieces.encode([to_text(b) for b in raw if b not in self.whole], num_threads=1))
        for t, b in zip(new, raw, strict=True):
            ids = [self.whole[b]] if b in self.whole else next(merged)
            self.tokens[t] = np.array(ids, "<i4").tobytes()
        for t, c in zip(texts, cuts, strict=True):
            self.stretches[t] = b"".join([self.tokens[x] for x in c])

    def encode(self, texts) -> list:
        parts = [[t] if self.odd.search(t) else self.stretch.findall(t) for t in texts]
        if len(self.stretches) > CACHE:
            self.stretches = {}
        self.fill(list({p for found in parts for p in found if p not in self.stretches}))
        return [np.frombuffer(b"".join([self.stretches[p] for p in found]), "<i4") for found in parts]


class Decoder:
    """Bytes of ids, from the pieces of the model."""

    def __init__(self, model: bytes):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = pieces.get_piece_size() - 1
        self.bytes_of = [bytes(ord(c) - BASE for c in pieces.id_to_piece(i)) for i in range(size)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


IDS = StructField("ids", ArrayType(IntegerType()))
DECODED = StructField("decoded", BinaryType())


def encode(docs: DataFrame, ranks: dict, pattern: str, text="text", keep=None, back=False) -> DataFrame:
    """``docs`` with ``ids``, the token ids of the whole text; a null text has none.

    With ``back`` the ids are decoded again in the same pass, as ``decoded``. Columns of these names are replaced. No
    shuffle; the model, a few hundred kilobytes whatever the input, goes to every task.
    """
    model = docs.sparkSession.sparkContext.broadcast((model_bytes(ranks), ranks))

    def start():
        encoder = Encoder(model.value[0], pattern, model.value[1])
        decoder = Decoder(model.value[0]) if back else None

        def step(texts):
            ids = encoder.encode([t or "" for t in texts.to_pylist()])
            decoded = [pa.array([decoder.decode(x.tolist()) for x in ids], pa.binary())] if back else []
            return [lists(ids, np.int32), *decoded]

        return step

    return map_arrow(docs, [column(text)], StructType([IDS, DECODED] if back else [IDS]), start, keep)


def decode(encoded: DataFrame, ranks: dict, ids="ids", keep=None) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that its ids stand for; null ids decode to nothing."""
    model = encoded.sparkSession.sparkContext.broadcast(model_bytes(ranks))

    def start():
        decoder = Decoder(model.value)
        return lambda arrays: [pa.array([decoder.decode(x.as_py() or ()) for x in arrays], pa.binary())]

    return map_arrow(encoded, [column(ids)], StructType([DECODED]), start, keep)
