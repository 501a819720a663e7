"""Exact, near and line duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from llm.corpus_rows import EDGES, documents  # noqa: F401
from pyspark.sql import functions as F

from ledgerline.llm import exact_dedup, golomb, line_dedup, near_dedup
from ledgerline.llm.components import components


def _union(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _varied(seed, groups=6, size=25, words=40):
    """Groups of copies with a few words changed, some more than the threshold allows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, k = [], 100
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(words)] = rng.choice(vocabulary)
            rows.append((k, " ".join(text)))
            k += 1
    return rows


# --- building blocks


@pytest.mark.parametrize("n,below", [(0, 100), (1, 1), (1, 1 << 44), (5, 5), (1000, 1 << 20), (3000, 1 << 50)])
def test_golomb_round_trip(n, below):
    rng = np.random.default_rng(n)
    numbers = np.unique(rng.integers(0, below, n, dtype=np.uint64))
    data = golomb.encode(numbers, below)
    assert (golomb.decode(data) == numbers).all()
    if n == 1000:
        assert len(data) - 24 < n * (np.log2(below / n) + 2.1) / 8


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(300 + i, 301 + i) for i in range(40)] + [(7, 7)]
    want = _union(400, links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_up_finds_every_connection():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 14))
        alike = rng.random((n, n)) < 0.15
        alike |= alike.T
        np.fill_diagonal(alike, True)
        component, links = near_dedup.join_up(n, lambda i: alike[i])
        want = _union(n, [tuple(x) for x in np.argwhere(alike)])
        assert _union(n, links) == want
        assert len({(c, w) for c, w in zip(component, want)}) == len(set(want)) == len(set(component))


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(6)
    for common, other in ((900, 50), (800, 100), (500, 250)):
        both = rng.integers(0, 1 << 62, common, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 62, other, dtype=np.uint64)])) for _ in range(2))
        bits = np.unpackbits(np.frombuffer(near_dedup.signature(a)[1], np.uint8) ^ np.frombuffer(near_dedup.signature(b)[1], np.uint8)).sum()
        similarity = common / (common + 2 * other)
        assert near_dedup._most_differing_bits(similarity + 0.15) < bits < near_dedup._most_differing_bits(similarity - 0.15)


# --- exact


def _exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d))
    out = []
    for bare, some in groups.items():
        keep = min(some, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out += [(d, d if len(some) == 1 else keep, len(some), len(some) == 1 or d == keep, hashlib.sha256(bare.encode()).hexdigest()) for _, _, d in some]
    return sorted(map(str, out))


@pytest.mark.parametrize("bits", [44, 6])  # 6: nearly every text is an innocent suspect
def test_exact_dedup(documents, monkeypatch, bits):
    monkeypatch.setattr(exact_dedup, "BITS", bits)
    rows = EDGES + [(100 + i, f"text {i % 40}" + " " * (i % 3)) for i in range(200)]
    got = exact_dedup.exact_dedup(documents(rows, parts=5)).collect()
    assert sorted(str(tuple(r)) for r in got) == _exact(rows)


def _python_steps(plan):
    """Most Python steps in one stage of a plan, and those in the stage of its root: each takes a worker process for each task."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    below = [_python_steps(plan.children().apply(i)) for i in range(plan.children().size())]
    here = sum(n for _, n in below) + ("InPandas" in plan.nodeName() or "InArrow" in plan.nodeName())
    most = max([here, *(n for n, _ in below)])
    return (most, 0) if "Exchange" in plan.nodeName() else (most, here)


def test_one_worker_for_each_task(documents, monkeypatch):
    seen, write = [], exact_dedup.materialize
    monkeypatch.setattr(
        exact_dedup, "materialize", lambda df, name: seen.append(_python_steps(df._jdf.queryExecution().executedPlan())[0]) or write(df, name)
    )
    exact_dedup.exact_dedup(documents([(1, "a b"), (2, "ab"), (3, "c")], parts=2)).collect()
    assert max(seen) == 1


def test_exact_dedup_of_nothing(documents):
    assert exact_dedup.exact_dedup(documents([])).count() == 0


# --- near


def _near(rows, size, percent):
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w and d is not None else set())
    links = [
        (i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
        and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    place = {i: k for k, i in enumerate(order)}
    root = _union(len(rows), [(place[a], place[b]) for a, b in links])
    return {rows[i][0]: rows[order[root[place[i]]]][0] for i in range(len(rows)) if rows[i][0] is not None}


@pytest.mark.parametrize("piece", [2048, 4])  # 4: most buckets are cut into pieces
@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(documents, monkeypatch, piece, size):
    monkeypatch.setattr(near_dedup, "PIECE", piece)
    rows = [r for r in EDGES if r[0] is not None] + _varied(7)
    got = near_dedup.near_duplicates(documents(rows), shingle=size, percent=80).collect()
    want = _near(rows, size, 80)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_without_id_or_rows(documents):
    got = near_dedup.near_duplicates(documents([(None, "a b c"), (3, "a b c"), (2, "a b c")])).collect()
    assert sorted(str(tuple(r)) for r in got) == ["(2, 1, 2, True)", "(3, 1, 2, False)", "(None, 1, None, True)"]
    empty = near_dedup.near_duplicates(documents([]))
    assert empty.count() == 0 and empty.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]


@pytest.mark.parametrize("bytes_", [1 << 24, 2000])
def test_members_unlike_their_hub_in_blocks(spark, monkeypatch, bytes_):
    """A bucket whose hub is like nothing: every pair is found, and no task holds more than a block and a piece."""
    monkeypatch.setattr(near_dedup, "PIECE", 32)
    monkeypatch.setattr(near_dedup, "PIECE_BYTES", bytes_)
    rng, n = np.random.default_rng(3), 400
    sets = [np.unique(rng.integers(0, 1 << 62, 20, dtype=np.uint64)) for _ in range(n)]
    for i in range(10, n, 10):  # pairs of one set
        sets[i] = sets[i - 5]
    most = []
    alike_of, pieces = near_dedup._alike_sets, near_dedup._pieces

    def counted(rows, alike):
        most.append(rows.groupBy("bucket", "piece").agg(F.countDistinct("doc_id").alias("n")).agg(F.max("n"), F.count("n")).first())
        return pieces(rows, alike)

    monkeypatch.setattr(near_dedup, "_pieces", counted)
    members = spark.createDataFrame([(1, i, sets[i].nbytes) for i in range(n)], "bucket long, doc_id long, bytes long")
    data = spark.createDataFrame([(i, sets[i].tobytes()) for i in range(n)], "doc_id long, data binary")
    got = components(near_dedup._linked(members, data, lambda d: alike_of(d, 80), "test")).collect()
    assert {(r["node"], r["root"]) for r in got if r["node"] != r["root"]} == {(i, i - 5) for i in range(10, n, 10)}
    assert most[1][0] <= 2 * 32 * 1.8 and most[1][1] > 100


# --- lines


def _lines(rows):
    lines, where = [], []
    for k, (d, t) in enumerate(rows):
        for i, x in enumerate((t or "").split("\n")):
            if x := x.strip(" ").lower():
                lines.append(_windows(x))
                where.append((k, i))
    links = [(a, b) for a in range(len(lines)) for b in range(a) if 100 * len(lines[a] & lines[b]) >= 80 * len(lines[a] | lines[b])]
    root = _union(len(lines), links)
    gone = {where[i] for i in range(len(lines)) if root[i] != i}
    return {
        d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if (k, i) not in gone) for k, (d, t) in enumerate(rows)
    }


def test_line_dedup(documents):
    rng = random.Random(8)
    pool = [t for _, t in _varied(9, groups=5, size=12, words=30)] + ["Short line", "short line ", "  ", "", "a", "A"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(50)]
    rows += [(60, None), (61, "x" * 5000), (62, "word " * 3000), (63, "word " * 3000)]
    got = line_dedup.dedup_lines(documents(rows)).collect()
    want = _lines(rows)
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["n_lines"] - r["n_kept"] >= 0 for r in got) and len(got) == len(rows)


def test_line_dedup_edges(documents):
    got = line_dedup.dedup_lines(documents([(None, "same line"), (5, "Same line"), (5, "Same line"), (6, None)])).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(
        ["(5, 'Same line', 1, 1)"] * 2 + ["(6, '', 1, 1)", "(None, '', 1, 0)"]
    )
    assert line_dedup.dedup_lines(documents([])).count() == 0


def test_shingles_and_bands():
    lines = ["a", "one two three", "É  x", "word " * 30 + "end", "b" * 40]
    line, hashes = line_dedup.every_shingle(lines)
    assert [len(_windows(x)) for x in lines] == np.bincount(line).tolist()
    again, other = line_dedup.every_shingle(lines[::-1])
    assert sorted(hashes.tolist()) == sorted(other.tolist())
    row, names = line_dedup.bands(line, hashes)
    assert set(row) == set(range(5)) and (names >= 0).all()
    assert sorted(line_dedup.bands(again, other)[1].tolist()) == sorted(names.tolist())


def _windows(x):
    return {x[i : i + line_dedup.WIDTH] for i in range(max(1, len(x) - line_dedup.WIDTH + 1))}


def test_lines_by_every_window(documents):
    """Lines without spaces and with one long word: read to their ends, against brute force."""
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    lines = [
        "https://www.example.com/en/article/1234-old-mill", "https://www.example.com/fr/forum/99-new-ship",
        "中文" * 8 + "".join(map(chr, range(0x4E00, 0x4E20))), "中文" * 8 + "".join(map(chr, range(0x5E00, 0x5E20))),
        "short", "short", "shorter", "a" * 15, "a" * 16, "a" * 17,
    ]
    for n in (19, 20, 21, 25, 30, 47, 48, 60, 200):
        base = letters(n)
        lines += [base, "x" + base, base + "y", base[: n // 2] + "z" + base[n // 2 + 1 :], base[:16] + letters(n)]
    rows = [(i, line) for i, line in enumerate(lines)]
    got = {r["doc_id"]: r["n_kept"] for r in line_dedup.dedup_lines(documents(rows)).collect()}
    sets = [_windows(x) for x in lines]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = _union(len(sets), links)
    assert got == {i: int(root[i] == i) for i in range(len(sets))}
    assert got[0] == got[1] == got[2] == got[3] == 1 and 0 in got.values()


def test_short_sets_share_a_band():
    rng = random.Random(12)
    for _ in range(400):
        x = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(9, 37)))
        n = len(_windows(x))
        line, hashes = line_dedup.every_shingle([x, x[: len(x) - n // 5]])
        row, names = line_dedup.bands(line, hashes, line_dedup.SHORT)
        if 100 * len(_windows(x[: len(x) - n // 5])) >= 80 * n:
            assert set(names[row == 0]) & set(names[row == 1])


def test_one_character_edits_are_found(documents):
    rng = random.Random(13)
    rows = []
    for n in (60, 90, 120, 200):
        for _ in range(15):
            x = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n - 2))
            k = rng.randrange(n - 2)
            rows += [(len(rows), f"a{x}z"), (len(rows) + 1, f"a{x[:k]}#{x[k + 1:]}z")]
    got = {r["doc_id"]: r["n_kept"] for r in line_dedup.dedup_lines(documents(rows)).collect()}
    assert all(got[i] == 1 - i % 2 for i in range(len(rows)))


def test_lines_of_one_id_are_told_apart(documents, monkeypatch):
    """Ids of two bits: nearly all lines share theirs with others, and none is lost."""
    names = line_dedup._names
    monkeypatch.setattr(line_dedup, "_names", lambda line: (names(line)[0] & 3, names(line)[1]))
    rows = [(i, f"{i % 20} is a line of its own, {'abcdefghijklmnopqrst'[i % 20] * 40}") for i in range(40)]
    read = list(line_dedup._read([{"doc_id": [i for i, _ in rows], "text_hash": [0] * 40, "text": [t for _, t in rows]}]))[0]
    lines = documents(rows).sparkSession.createDataFrame(
        list(zip(read["id"], read["other"], read["doc_id"])), "id long, other long, doc_id long"
    )
    two = lines.groupBy("id").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low < high").select("id")
    got = line_dedup._told_apart(lines, two).collect()
    assert len({r["id"] for r in got}) == 20 and len({(r["id"], r["doc_id"] % 20) for r in got}) == 20


def test_unlike_lines_share_few_bands():
    """Bands that unlike lines share are what is shuffled and compared for nothing; similar lines share some all the same."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(60)]
    lines = [" ".join(rng.choices(words, k=30)) for _ in range(400)]
    row, names = line_dedup.bands(*line_dedup.every_shingle(lines), line_dedup.SHORT)
    _, where, n = np.unique(names, return_inverse=True, return_counts=True)
    assert (n[where] > 1).mean() < 0.01
    for x in lines[:50]:
        row, names = line_dedup.bands(*line_dedup.every_shingle([x, x[:90] + "#" + x[91:]]), line_dedup.SHORT)
        assert set(names[row == 0].tolist()) & set(names[row == 1].tolist())


def test_many_small_groups_at_once():
    """Groups that are read together are told apart, and the last of a group's lines is not compared once more."""
    rng = random.Random(17)
    groups = []
    for size in (2, 3, 2, 7, 1, 5):
        x = "".join(rng.choices("abcdefgh ", k=90))
        groups.append([x] + [rng.choice([x[:40] + "#" + x[41:], x[45:] + x[:45], "".join(rng.choices("abcdefgh ", k=60)), "abc"]) for _ in range(size - 1)])
    groups.append(groups[0][::-1])
    for lines, alike in zip(groups, line_dedup._AlikeLines(80).many([[x.encode() for x in g] for g in groups]), strict=True):
        sets = [_windows(x) for x in lines]
        for i in [*range(len(lines)), 0]:
            assert alike(i).tolist() == [100 * len(a & sets[i]) >= 80 * len(a | sets[i]) for a in sets]
    asked = []
    near_dedup.join_up(2, lambda i: (asked.append(i), np.arange(2) == i)[1])
    assert asked == [0]
