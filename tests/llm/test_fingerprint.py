"""Locally consistent parsing and the fingerprints made of it."""

import hashlib
import random

import numpy as np
from llm.corpus_rows import EDGES, documents  # noqa: F401

from ledgerline.llm import phrase_fingerprint as pf


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(n))


def jaccard(a, b):
    sets = []
    for text in (a, b):
        sets.append({(level, int(x)) for level, (_, names) in enumerate(pf.parse_levels([text]), 1) if level >= pf.BASE_LEVEL for x in names})
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_labels_differ_and_are_below_six():
    rng = np.random.default_rng(1)
    names = rng.integers(0, 2**63, 10_000).astype(np.uint64)
    names[::7] ^= np.uint64(1 << 63)
    first = np.zeros(len(names), bool)
    first[[0, 100, 5000]] = True
    label = pf.toss(names, first)
    assert label.max() < 6 and (label[1:] != label[:-1])[~first[1:]].all()


def test_equal_substrings_share_their_inner_phrases():
    middle = words(300, 1)
    for level in (1, 2, 3):
        inner = []
        for before, after in (("", ""), ("x", "yy"), (words(40, 2), words(90, 3)), ("zz" * 77, "")):
            names = [n for _, n in pf.parse_levels([before + middle + after])][level - 1]
            inner.append(names)
        # The phrases of the middle but for a few at its ends stand in every text in the same order.
        core = inner[0][6:-6].tolist()
        for other in inner[1:]:
            text = ",".join(map(str, other.tolist()))
            assert ",".join(map(str, core)) in text


def test_parsing_together_is_parsing_alone():
    texts = ["", "a", "aa", "ab", "aaa" * 400, "ab" * 500, words(500, 4), "", words(3, 5), "\U0001F600é中" * 9, "x" * 5 + "y" * 9]
    together = pf.fingerprints(texts)
    assert [x.tolist() for x in together] == [pf.fingerprints([t])[0].tolist() for t in texts]
    assert [len(x) for x in together[:4]] == [0, 1, 1, 1] and all(len(x) <= pf.SIZE for x in together)
    assert all(len(n) <= max(1, len(o) // 2) for (_, n), (_, o) in zip(list(pf.parse_levels([texts[6]]))[1:], pf.parse_levels([texts[6]])))


def test_likeness_is_near_the_share_of_phrases():
    text = words(2000, 6)
    off = []
    for seed, share in enumerate((0.1, 0.3, 0.5, 0.8, 0.95)):
        other = text[: int(len(text) * share)] + words(2000, 20 + seed)[: int(len(text) * (1 - share))]
        off.append(abs(pf.likeness(*pf.fingerprints([text, other])) - jaccard(text, other)))
    assert max(off) < 0.15 and sum(off) / len(off) < 0.06
    assert pf.likeness(*pf.fingerprints([text, text])) == 1.0 and pf.likeness(*pf.fingerprints([text, words(2000, 9)])) < 0.05
    assert pf.likeness(*pf.fingerprints([text, "an insertion " + text])) > 0.9
    assert pf.likeness(*pf.fingerprints(["", ""])) == 1.0 and pf.likeness(*pf.fingerprints(["", "a"])) == 0.0


def plain(docs):
    rows = [(d, t or "") for d, t in docs]
    out = []
    for (d, text), (_, following) in zip(rows, [*rows[1:], *rows[:1]]):
        n = len(text) // 2
        changed = text[: len(text) - n] + following[:n]
        own, new, other = (pf.fingerprints([t])[0] for t in (text, changed, following))
        out.append((d, len(text), hashlib.sha256(changed.encode()).hexdigest(), pf.text_of(own), pf.text_of(new), pf.likeness(own, new), pf.likeness(own, other)))
    return out


def test_documents(documents, monkeypatch):
    docs = {d: t for d, t in EDGES if d is not None} | {100 + i: words(i * 7, i) for i in range(40)}
    docs = sorted(docs.items(), reverse=True)
    for parts in (1, 3):
        out = pf.fingerprint_documents(documents(docs, parts))
        assert sorted(map(tuple, out.collect())) == sorted(plain(docs))


def test_repeated_rows_and_rows_without_id(documents):
    docs = [(7, "a b c " * 9)] * 5 + [(8, words(30, 1)), (None, "x y"), (None, None)]
    out = pf.fingerprint_documents(documents(docs)).collect()
    assert len(out) == 8 and sorted(r["near_next"] for r in out if r["doc_id"] == 7)[1:] == [1.0] * 4
    assert len({r["fingerprint"] for r in out if r["doc_id"] == 7}) == 1
    last = [r for r in out if r["doc_id"] is None]
    assert len(last) == 2


def test_small_tables(documents):
    assert pf.fingerprint_documents(documents([])).count() == 0
    assert list(map(tuple, pf.fingerprint_documents(documents([(1, "one text")])).collect())) == plain([(1, "one text")])
    only = pf.fingerprint_documents(documents([(1, ""), (2, None)])).collect()
    assert [(r["fingerprint"], r["near_edited"], r["near_next"]) for r in only] == [("", 1.0, 1.0)] * 2
