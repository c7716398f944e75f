import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.conftest import EDGES
from trustdesk.llm import spm_bpe, token_file
from trustdesk.llm.common import table
from trustdesk.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ranks(spark):
    return spm_bpe.read_ranks(spark, RANKS)


@pytest.fixture(scope="module")
def reference(ranks):
    with open(RANKS, "rb") as f:
        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})


def test_edge_texts_encode_as_the_library_does(edges, ranks, reference):
    out = spm_bpe.decode(spm_bpe.encode(edges, ranks, public_tokenizers.PATTERN), ranks)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(EDGES) and "odd.name" in out.columns and out.columns.count("ids") == 1
    for i, t in enumerate(EDGES):
        assert list(got[i + 1]["ids"]) == reference.encode_ordinary(t or ""), t
        assert bytes(got[i + 1]["decoded"]) == (t or "").encode()


def test_byte_bpe_query(spark, sf_dir, shared, reference):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    got = QUERIES["op4_byte_bpe"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_every_token_is_one_piece(ranks):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=spm_bpe.model_bytes(ranks))
    assert all(model.piece_to_id(spm_bpe.to_text(t)) == r for t, r in ranks.items())


def test_empty_tables_encode(empty, ranks, shared):
    assert spm_bpe.encode(empty, ranks, public_tokenizers.PATTERN).count() == 0
    assert token_file.round_trip(empty, WORDS, 2).count() == 0


def test_ranks_with_gaps_are_refused(ranks):
    with pytest.raises(ValueError):
        spm_bpe.model_bytes({k: v + 1 for k, v in ranks.items()})


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [3, 3, 9, 10_000_000], list(range(1000)),
                                    np.cumsum(np.random.default_rng(1).integers(0, 5000, 3000)).tolist()])
def test_elias_fano(values):
    ef = token_file.EliasFano.from_bytes(token_file.EliasFano.of(values).to_bytes())
    assert list(ef.each()) == values
    assert [ef.select(i) for i in range(len(values))] == values
    if len(values) > 100:
        assert len(ef.to_bytes()) * 8 / len(values) < 3 + np.log2(values[-1] / len(values) + 1) + 2


def expected(rows):
    tokenizer = Tokenizer.from_file(WORDS)
    start, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read_back(df):
    return [(r["doc_id"], r["start"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in df.orderBy("start").collect()]


@pytest.mark.parametrize("shard", [50, 8 << 20])
def test_shards_hold_edge_texts(edges, shared, shard):
    found = token_file.round_trip(edges, WORDS, 2, shard=shard)
    assert read_back(found) == expected([(i + 1, t) for i, t in enumerate(EDGES)])


def test_shards_hold_null_and_repeated_ids(spark, shared):
    rows = [(None, "b"), (None, "a"), (-5, "x y"), (3, "same"), (3, "same"), (3, "other"), (2**62, None)]
    found = token_file.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, 2)
    assert read_back(found) == expected(rows)


def test_token_query(spark, sf_dir, shared):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = QUERIES["op7_token_shards"](spark, sf_dir).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(texts)


def test_one_document_is_read_by_two_selects(spark, shared):
    shard = token_file.Shard(token_file.shard_bytes([4, 9], [np.array([1, 2]), np.array([7])], 2))
    assert shard.document(0).tolist() == [1, 2] and shard.document(1).tolist() == [7] and shard.doc_ids() == [4, 9]


def test_words_of_plain_letters_encode_as_the_library_does():
    """Every word of the vocabulary, random words, and words that end in each letter."""
    import json

    rng = np.random.default_rng(5)
    tokenizer = Tokenizer.from_file(WORDS)
    with open(WORDS) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    letters = list("abcdefghijklmnopqrstuvwxyzßàâäçèéêëîïñôöùûüþ")
    words = [w.removesuffix("</w>") for w in vocabulary if w.removesuffix("</w>").isascii() and w.removesuffix("</w>").isalpha()]
    words += ["".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(20000)]
    words += [w + x for w in ("", "a", "stra", "é") for x in [*letters, "ÿ", "Z", "É", "S!"]]
    got = token_file.encoder(WORDS)([w.encode() for w in words])
    for w, g, e in zip(words, got, tokenizer.encode_batch(words, add_special_tokens=False), strict=True):
        assert np.frombuffer(g, "<u4").tolist() == e.ids, w


def test_stretches_encode_as_whole_texts_do():
    rng = np.random.default_rng(11)
    bits = ["a", "B", "é", "É", "ß", "×", "÷", "ÿ", "'s", "'", "1", "٣", ".", ",", "!?", "-", " ", "  ", "\n", "́", " ", "\x1c",
            "the", "tion", "Σ", "ς", "İ", "<|endoftext|>", "漢", "😀", "_", " ", "ﬁ", "ŉ"]
    texts = ["".join(rng.choice(bits, 12)) for _ in range(3000)]
    tokenizer = Tokenizer.from_file(WORDS)
    got = token_file.encoder(WORDS)([t.encode() for t in texts])
    for t, g, e in zip(texts, got, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(g, "<u4").tolist() == e.ids, t


def test_a_worker_remembers_short_odd_stretches_only():
    """Its table once held every word, up to half a million of any length."""
    rng = np.random.default_rng(12)
    encode = token_file.encoder(WORDS)
    remembered = token_file.TABLES[WORDS][0]
    plain = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), 9)) + m for m in (".", ",", "") for _ in range(3000)]
    encode([" ".join(plain).encode()])
    assert not {w.encode() for w in plain} & set(remembered)
    odd = ["漢" * 5 + "x7", "1234-" * 1000]
    tokenizer = Tokenizer.from_file(WORDS)
    for _ in range(2):
        got = encode([" ".join(odd).encode()])[0]
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(" ".join(odd), add_special_tokens=False).ids
    assert odd[0].encode() in remembered and max(map(len, remembered)) <= token_file.REMEMBERED


def test_bytes_that_are_no_text_encode_as_replaced_ones():
    rng = np.random.default_rng(13)
    alphabet = np.frombuffer("abcXYZÀ×ßàÿŸ.,;:!? \n\0".encode() + b"\xff\x80", np.uint8)
    texts = [rng.choice(alphabet, 12).tobytes() for _ in range(3000)]
    tokenizer = Tokenizer.from_file(WORDS)
    for t, g in zip(texts, token_file.encoder(WORDS)(texts), strict=True):
        want = [i for w in t.split() for i in tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids]
        assert np.frombuffer(g, "<u4").tolist() == want, t
