"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.corpus_rows import EDGES, documents  # noqa: F401

from ledgerline.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, target, percent=5, least=20, buckets=10_000):
    found = [(d, *features(t)) for d, t in docs]
    s, t = (Counter(f % buckets for x in side for f in x) for side in ([x[2] for x in found], [features(x)[1] for x in target]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for d, words, fs in found:
        weight = sum(gain[f % buckets] for f in fs)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(fs), weight, score, None, len(words)])
    able = sorted((r for r in rows if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for place, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = place
    return rows


def some_texts(n, seed=5):
    rng = random.Random(seed)
    words = ["the", "Sea", "of", "été", "x1", "a-b", "中文", "long" * 80, "naïve", "END."]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def as_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank", "n_words")) for r in df.collect()), key=str)


def test_against_plain(documents):
    docs = [*EDGES, *((100 + i, t) for i, t in enumerate(some_texts(150)))]
    target = [*some_texts(20, 6), None, ""]
    out = importance.resample(documents(docs), documents(list(enumerate(target))), percent=20)
    assert as_rows(out) == sorted(map(tuple, plain(docs, target, 20)), key=str)
    assert sum(r["rank"] is not None for r in out.collect()) >= 20


def test_repeated_rows_have_ranks_of_their_own(documents):
    docs = [(7, "a b c " * 10)] * 30 + [(i, t) for i, t in enumerate(some_texts(30), 100)]
    out = importance.resample(documents(docs), documents([(1, "a b c")]), percent=50)
    ranks = sorted(r["rank"] for r in out.collect() if r["rank"])
    assert as_rows(out) == sorted(map(tuple, plain(docs, ["a b c"], 50)), key=str) and ranks == list(range(1, len(ranks) + 1))


def test_empty_tables(documents):
    assert importance.resample(documents([]), documents([(1, "a")])).count() == 0
    docs = [(1, "a b"), (2, None)]
    assert as_rows(importance.resample(documents(docs), documents([]))) == sorted(map(tuple, plain(docs, [])), key=str)


def test_long_texts_are_cut_without_loss(monkeypatch):
    text = " ".join(some_texts(40, 9))
    monkeypatch.setattr(importance, "PIECE_BYTES", 300)
    got = [b for x in importance._bucket_rows([{"doc_id": [1, 2, 3], "text": [text, None, text[:50]]}], 3, 1 << 17) for b in x["buckets"]]
    assert [sorted(np.frombuffer(b, "<u4").tolist()) for b in got] == [sorted(f % (1 << 17) for f in features(t)[1]) for t in (text, None, text[:50])]


@pytest.mark.parametrize("size", [1, 2, 7, 300])
def test_crc(size):
    rng = np.random.default_rng(size)
    text = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 200)
    length = np.where(rng.random(200) < 0.5, size, 3)
    assert importance.crc32_slices(text, start, length).tolist() == [zlib.crc32(text[s : s + n].tobytes()) for s, n in zip(start, length)]
