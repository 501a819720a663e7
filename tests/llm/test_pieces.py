"""SentencePiece: pre-tokens, prefix table, codec and counts against the library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from llm.corpus_rows import EDGES, documents  # noqa: F401

from ledgerline.llm import piece_codec, token_counts
from ledgerline.llm.pieces import keys, library_lengths
from ledgerline.llm.prefix_table import PrefixTable, merge

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def prefix_table(library):
    return PrefixTable(library)


def _random_texts(n, seed):
    rng = random.Random(seed)
    some = [*map(chr, range(32, 127)), *"\n\t\r▁é中́\x00", *["the", "ing", "  ", "\n\n", "aaaa", "    ", "==", "1234"] * 3]
    return ["".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_codec_is_the_library(library):
    codec = piece_codec.Codec(open(MODEL, "rb").read(), cache_entries=500)
    for text in [*_random_texts(3000, 1), *(t or "" for _, t in EDGES), "ab" * 3000, " " * 3000, "=-" * 900]:
        assert codec.encode(text) == [*library.encode(text), 2], repr(text)


def test_lengths_of_pre_tokens_add_up(library):
    for text in _random_texts(2000, 2):
        assert sum(library_lengths(library, keys(text))) == len(library.encode(text)), repr(text)


def test_prefix_table_is_the_definition(prefix_table):
    rng = random.Random(3)
    letters = "▁thein gaos"
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14))).replace(" ", "")
        assert prefix_table.encode(text) == [prefix_table.ids[p] for p in merge(text, prefix_table.score)], text


def test_bounded_memory_changes_nothing(library):
    small = PrefixTable(library, memo_entries=7)
    for text in ["▁understanding", "▁▁▁indent", "▁aaaaaaa"]:
        assert small.encode(text) == library.encode(text[1:].replace("▁", " "))


def test_encode_decode(documents, library):
    rows = piece_codec.encode_decode(documents(EDGES), MODEL, digest=True).collect()
    ids = {r: [*library.encode(r[1] or ""), 2] for r in EDGES}
    want = sorted(
        (str(r[0]), len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(library.decode(i).encode()).hexdigest())
        for r, i in ((r, ids[r]) for r in EDGES)
    )
    assert sorted((str(r[0]), *r[1:]) for r in rows) == want
    full = piece_codec.encode_decode(documents([(1, "one two")]), MODEL).first()
    assert (full["ids"], full["decoded"]) == ([*library.encode("one two"), 2], "one two")


def test_token_counts(documents, library):
    rows = token_counts.token_counts(documents(EDGES), MODEL, limit=100, frequent=4, cache_entries=5).collect()
    n = [(str(d), len((t or "").encode()), len(library.encode(t or ""))) for d, t in EDGES]
    assert sorted((str(r[0]), *r[1:]) for r in rows) == sorted((*x, x[2] > 100) for x in n)


def test_empty_tables(documents):
    assert piece_codec.encode_decode(documents([]), MODEL).count() == 0
    assert token_counts.token_counts(documents([]), MODEL).count() == 0


def test_summary_is_bounded_and_low():
    from collections import Counter

    counts = Counter({f"k{i}": i for i in range(1, 100)})
    small = token_counts.trimmed(counts, 10)
    assert len(small) <= 10 and all(0 < n <= counts[k] for k, n in small.items()) and small["k99"] == 99 - 89


def test_a_worker_holds_one_thing(monkeypatch):
    from ledgerline.llm import common

    monkeypatch.setattr(common, "_held", {})
    key = common.identity("a", b"model")
    assert key == common.identity("a", b"model") != common.identity("a", b"ledom")
    first = common.held(key, list)
    assert common.held(key, list) is first and common.held("other", dict) == {} and key not in common._held
