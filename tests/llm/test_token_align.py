import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import EDGES
from trustdesk.llm import hash_arrays, token_align as align
from trustdesk.llm.common import table
from trustdesk.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, libraries):
    """Digest rows of the texts, from the whole texts' tokens and one offset at a time."""
    a, b = libraries
    letters = align.byte_letters()
    out, links_of = [], []
    for t in texts:
        whole = " " + (t or "")
        ai, bi = a.encode(whole, add_special_tokens=False).ids, b.encode(t or "")
        ab = [bytes(letters[c] for c in a.id_to_token(i)) for i in ai]
        bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in
              ((i, b.id_to_piece(i)) for i in bi)]
        if not t or b"".join(ab) != whole.encode() or b"".join(bb) != whole.encode():
            out.append((0, 0, 0, ""))
            links_of.append([])
            continue
        ends = [{}, {}]
        for k, tokens in enumerate((ab, bb)):
            at = 0
            for n, token in enumerate(tokens):
                at += len(token)
                ends[k][at] = n
        groups, links, last = [], [], (0, 0)
        for at in sorted(set(ends[0]) & set(ends[1])):
            i, j = ends[0][at], ends[1][at]
            groups.append(",".join(map(str, ai[last[0]:i + 1])) + "|" + ",".join(map(str, bi[last[1]:j + 1])))
            links.append((ai[i], bi[j]))
            last = i + 1, j + 1
        out.append((len(ai), len(bi), len(groups), ";".join(groups)))
        links_of.append(links)
    count = collections.Counter(x for links in links_of for x in links)
    best = collections.defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [(*o[:3], len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), o[3])
            for o, x in zip(out, links_of, strict=True)]


def row(r):
    return tuple(r[n] for n in align.OUTPUT.names)


@pytest.mark.parametrize("bound", [hash_arrays.BOUND, 0])
def test_edges_against_brute_force(edges, shared, libraries, bound):
    got = align.align(edges, A, B, bound=bound)
    assert got.columns == [*edges.columns, *align.OUTPUT.names]
    rows = got.collect()
    assert sorted(map(row, rows)) == sorted(brute(EDGES, libraries))
    assert any(r["n_a"] == 0 and r["text"] for r in rows) and any(r["n_a"] for r in rows)


def test_odd_texts_against_brute_force(spark, shared, libraries):
    rng = random.Random(3)
    parts = ["a", "word", " ", "  ", "\n", "\t", "\r\n", " \n ", "'s", "12", "€", "日本", "é", " ", " ", "\x1c", "\x85", "ẞ", "😀",
             "▁", "<s>", "<|endoftext|>", "<0x0A>", "​", "؟", "ж", "x" * 40, "..", "—"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: row(r) for r in align.align(df, A, B, keep=["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, libraries)


def test_query_against_brute_force(spark, sf_dir, shared, libraries):
    rows = table(spark, sf_dir, "documents").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_token_align"](spark, sf_dir).collect()}
    want = brute([r["text"] for r in rows], libraries)
    assert got == {r["doc_id"]: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")
                   for r, w in zip(rows, want, strict=True)}


def test_products_against_dense_ones():
    rng = np.random.default_rng(2)

    def matrix(dense):
        rows, columns = np.nonzero(dense)
        begins = np.concatenate(([0], np.cumsum((dense != 0).sum(1))))
        return align.Csr(begins, columns, dense[rows, columns], dense.shape[1])

    for together in (3, 1 << 20):
        for _ in range(20):
            x = rng.integers(0, 4, (rng.integers(1, 9), 7)) * rng.integers(0, 2, 7)
            y = rng.integers(0, 4, (7, rng.integers(1, 9))) * rng.integers(0, 2, (7, 1))
            i, j, v = align.joined(align.product(matrix(x), matrix(y), together))
            dense = np.zeros((x.shape[0], y.shape[1]), np.int64)
            dense[i, j] = v
            assert len(set(zip(i.tolist(), j.tolist()))) == len(i)
            assert (dense == x @ y).all()
            assert (np.nonzero(matrix(x).transposed().values)[0] == np.arange((x != 0).sum())).all()


def test_links(spark, shared, libraries):
    texts = [None, "", "naïve tokens of 日本 differ", "strawberries"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in align.links(df, A, B).collect():
        if not r["text"]:
            assert not r["a_ids"] and not r["overlap_a"]
            continue
        whole = " " + r["text"]
        spans = []
        for ids, size in ((r["a_ids"], lambda i: len(align.ByteLevel(open(A).read()).bytes_of[i])),
                          (r["b_ids"], lambda i: len(align.Pieces(open(B, "rb").read()).bytes_of[i]))):
            ends = np.cumsum([size(i) for i in ids])
            spans.append(list(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist())))
        assert spans[0][-1][1] == len(whole.encode())
        want = {(i, j): min(x[1], y[1]) - max(x[0], y[0]) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1])
                if min(x[1], y[1]) > max(x[0], y[0])}
        assert dict(zip(zip(r["overlap_a"], r["overlap_b"]), r["overlap_bytes"])) == want
        shared_pairs = set(zip(r["shared_a"], r["shared_b"]))
        assert set(want) <= shared_pairs


def test_empty_table(empty, shared):
    assert align.align(empty, A, B).count() == 0
    assert align.align(empty, A, B, bound=0).count() == 0
