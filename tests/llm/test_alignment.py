"""Alignment of two tokenizers against the libraries and byte offsets."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from llm.corpus_rows import EDGES, documents  # noqa: F401

from ledgerline.llm import token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    letters = token_alignment.byte_letters()
    names = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    return a, names, sentencepiece.SentencePieceProcessor(model_file=B)


def piece_bytes(model, i):
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


def plain_tokens(text, libraries):
    a, names, b = libraries
    if not text:
        return [], []
    sides = [(i, names[i]) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, piece_bytes(b, i)) for i in b.encode(text)]
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in sides):
        return [], []
    return sides


def plain(docs, libraries):
    rows, count = [], Counter()
    for d, text in docs:
        a, b = plain_tokens(text, libraries)
        ends = []
        for side in (a, b):
            at, here = 0, {}
            for i, x in side:
                at += len(x)
                here[at] = i
            ends.append(here)
        shared = sorted(set(ends[0]) & set(ends[1]))
        links = [(ends[0][e], ends[1][e]) for e in shared]
        groups, before = [], 0
        for e in shared:
            groups.append("|".join(",".join(str(i) for at, i in side.items() if before < at <= e) for side in ends))
            before = e
        count.update(links)
        rows.append([d, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (d, a, b, g, len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), h) for d, a, b, g, x, h in rows
    ]


def odd_texts(n, seed):
    rng = random.Random(seed)
    some = [*map(chr, range(32, 127)), *"\n\t\r▁é中́\x00\x85　\xa0\x1c", *["the", "ing", "  ", "\n\n", "aaaa", "==", "1234", "'s", " <|endoftext|>", "<s>"] * 3]
    return ["".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(n)]


DOCS = [*EDGES, *enumerate([*odd_texts(300, 1), "a\t  b", " x", "\nx", "x\n", "a \n\n  b", "中文" * 300, "Don't stop, it's ok. " * 20], 100)]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("bound", [1 << 20, 0], ids=["broadcast", "shuffled"])
def test_against_plain(documents, libraries, bound):
    out = token_alignment.align(documents(DOCS), A, B, broadcast_bytes=bound)
    assert out.columns == COLUMNS
    assert sorted(map(tuple, out.collect()), key=str) == sorted(plain(DOCS, libraries), key=str)


def test_small_memories_change_nothing(libraries):
    a, b = (open(p, "rb").read() for p in (A, B))
    small, large = token_alignment.Sides(a, b, 3), token_alignment.Sides(a, b, 10_000)
    texts = [t for _, t in DOCS]
    assert small.cuts and small.encode(texts) == large.encode(texts)
    for _ in range(2):
        assert small.align(small.encode(texts)) == large.align(large.encode(texts))


def test_empty(documents):
    assert token_alignment.align(documents([]), A, B).count() == 0
    only = token_alignment.align(documents([(1, None), (2, "")]), A, B).collect()
    assert sorted(map(tuple, only)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_links_take_as_few_bytes_as_ids_need(documents):
    """A batch of rows that a worker gets holds its links: two bytes an id where the vocabularies allow it."""
    rows = token_alignment.aligned_documents(documents([(1, "two words"), (2, None)]), A, B).collect()
    assert [(r["width"], len(r["links"])) for r in rows] == [(2, 4 * r["n_groups"]) for r in rows] and rows[0]["n_groups"] > 0
