"""Main text, id files, decontamination, quality and URL templates."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm.corpus_rows import EDGES, documents  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import common, decontaminate, html_text, id_files, quality, rans, url_templates
from ledgerline.llm.decision_tree import decide, train
from ledgerline.llm.html_labels import PAGES
from ledgerline.llm.kneser_ney import CLASSES, Coding, class_of, discounts, unigram, TOKEN

WORDS = public_tokenizers.path("word_bpe_49k.json")

# --- main text


def test_decision_tree_learns_a_rule():
    rng = np.random.default_rng(1)
    x = rng.random((300, 4))
    y = (x[:, 2] > 0.4) & (x[:, 0] < 0.7)
    tree = train(x, y)
    assert np.mean([decide(tree, r) == v for r, v in zip(x, y)]) > 0.97


def test_held_out_pages():
    """Each labelled page by a tree that has not seen it."""
    right = total = 0
    for i, page in enumerate(PAGES):
        rest = [html_text.blocks(p, labelled=True) for k, p in enumerate(PAGES) if k != i]
        rows = np.array([x for found in rest for x in html_text.features(found)], float)
        tree = train(rows, np.array([b["keep"] == "1" for found in rest for b in found]))
        found = html_text.blocks(page, labelled=True)
        for b, x in zip(found, html_text.features(found)):
            right += decide(tree, x) == (b["keep"] == "1")
            total += 1
    assert right / total > 0.9


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("<", "<"), ("<script>var a = '<p>x</p>';</script>", ""),
    ("<article><p>a &amp;lt; b&nbsp;c\n\t d</p><p>&eacute;&#233;&#xE9;</p></article>", "a &lt; b c d\n\nééé"),
    ("<nav><a href=x>Menu</a></nav><article><h1>T</h1><p>One<br>two<b>three</b></p></article><footer>f</footer>", "T\n\nOne twothree"),
    ("<article><p>open <p>never closed <b>bold</article><footer>f", "open\n\nnever closed bold"),
    ("<article><p title='a > b'>kept</p><!-- <p>no</p> --><style>p{}</style><form><p>no</p></form><aside>no</aside></article>", "kept"),
    ("<article><p>text</p><div class='user-comments'><p>a reader says</p></div></article>", "text"),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page", [
    "<article class='post no-sidebar'>{}</article>", "<main class='with-sidebar'>{}</main>", "<body class='has-nav'>{}</body>",
    "<div class='post no-sidebar'>{}</div>", "<article class='post category-social'>{}</article>",
    "<head><title>T <p> t</title><meta charset=utf-8><p>{}", "<html><head><link href=x>{}", "<head><noscript><img src=x></noscript></head>{}",
    "<body><button>Menu{}", "<body><noscript>{}", "<body><iframe src=x>{}", "<body><svg><path d=x>{}", "<body><button>Menu{}<button>Go</button>",
    "<body><div><button>Menu</div>{}<div></button></div>", "<body><button><div>Share</div></button>{}",
])
def test_no_article_is_lost(page):
    text = "The boats came back one after another from the open sea while the morning light fell on the quiet harbour."
    assert html_text.main_text(page.format(f"<p>{text}</p><p>{text} Then rest.</p>")) == f"{text}\n\n{text} Then rest."


def test_math_and_comments():
    assert html_text.main_text("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>") == "so x=2 holds"
    page = "<article><p>text</p></article><section class=comments><article class='comment'><p>a reader says</p></article></section>"
    assert html_text.main_text(page) == "text"


@pytest.mark.parametrize("attribute", ["data-keep", "data-keep=1", 'data-keep-open="true"', 'data-keepalive="x"', 'data-keep="0"', "='", '"', "class", "class=", "id='a"])
def test_attributes_of_a_page_mean_nothing(attribute):
    text = "Morning light fell on the quiet harbour while the boats came back from the open sea."
    page = f"<body><article><p {attribute}>{text}</p><p>{text}</p></article></body>"
    if attribute.count("'") % 2 == attribute.count('"') % 2 == 0:
        assert html_text.main_text(page) == f"{text}\n\n{text}"
    else:
        html_text.main_text(page)  # a quote that is never closed may hide text, and must not fail


def test_odd_markup_never_fails():
    rng = random.Random(8)
    some = ["<div>", "</div>", "<p data-keep>", "<button", "</button>", "<a href='", ">", "<", "&#x110000;", "&amp", "<table><tr>", "<!--", "-->", "<svg>", "<h2>", "word", "<script>", "<math>", "\x00", "<header>", "</main>", "<main>", '"']
    for _ in range(3000):
        html_text.main_text("".join(rng.choice(some) for _ in range(rng.randint(1, 25))))


def test_deep_pages_take_linear_time():
    def seconds(depth):
        start = time.process_time()
        html_text.main_text("<button><nav>" + "<div>" * depth + "<p>one" + "</ul>" * depth + "</button>" + "<div>" * depth + "<p>x</p>" * depth)
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 12 * seconds(10_000) + 1


def test_extract(spark):
    long = "<article><p>" + "word " * 60_000 + "</p></article>"
    rows = [(1, "u", "<article><p>a</p></article>", "x"), (1, "u", "<article><p>a</p></article>", "x"), (None, None, None, "x"), (2, "v", long, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r["page_id"]), r["n_chars"]) for r in html_text.extract(df).collect())
    assert got == [("1", 1), ("1", 1), ("2", 299_999), ("None", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


# --- id files


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 150_000])
def test_rans_round_trip_and_checkpoints(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 999)
    coder = rans.Coder(rans.frequencies(np.bincount(ids, minlength=1000)))
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all()
    marks = int(np.frombuffer(block, "<u4", 6)[5])
    parts = [coder.decode(block, i, i + 1) for i in range(marks)]
    assert (np.concatenate([*parts, np.zeros(0, np.uint32)]) == ids).all()
    if n:
        damaged = bytearray(block)
        damaged[len(block) // 2] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            coder.decode(bytes(damaged))


def test_frequencies_give_every_id_a_share():
    freq = rans.frequencies(np.array([0, 10**9, 1, 0]))
    assert freq.min() >= 1 and freq.sum() == 1 << rans.SCALE


def test_id_files(documents, spark):
    rows = [r for r in EDGES if r[0] != 7] + [(20 + i, "some words here " * (i % 7)) for i in range(60)]
    library = Tokenizer.from_file(WORDS)
    start, want = 0, []
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = id_files.round_trip(documents(rows), WORDS, block_ids=500, cache_entries=3)
    assert sorted(map(tuple, got.collect())) == want
    assert id_files.round_trip(documents([]), WORDS).count() == 0


def test_tokenizer_is_the_library():
    tokenizer = id_files.Tokenizer(open(WORDS, "rb").read(), cache_entries=300)
    assert tokenizer.splits_signs and tokenizer.is_plain
    rng = random.Random(5)
    some = [*"ab,.AB1ǅŉſK \n\t'_-!É́éßΣσİ中　\xa0\x1f  ", "word", "'s", "The ", ", ", ". ", "<|endoftext|>", " <|startoftext|>"]
    for _ in range(6000):
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 14)))
        want = np.array(tokenizer.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert tokenizer.encode(text) == want, repr(text)


def test_files_are_in_document_order(documents, spark, tmp_path):
    manifest = id_files.write_ids(documents([(i, "a b c") for i in range(100, 0, -1)]), WORDS, str(tmp_path / "out"), block_ids=40).collect()
    freq = np.frombuffer(spark.read.parquet(str(tmp_path / "out/frequencies")).first()[0], "<u4")
    ids = []
    for r in sorted(manifest, key=lambda r: (r["path"], r["position"])):
        with open(r["path"].removeprefix("file:"), "rb") as f:
            assert f.read(4) == id_files.MAGIC
            f.seek(r["position"])
            ids += id_files.parse_block(f.read(r["size"]), rans.Coder(freq))[0].tolist()
    assert ids == list(range(1, 101))


# --- decontamination


def _contaminated(docs, items, window):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    words = lambda t: find((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, found = words(t), set()
        hit = [0] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if some := windows.get(tuple(w[k : k + n])):
                    found |= some
                    hit[k : k + n] = [1] * n
        h = sum(hit)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append(str((d, len(w), h, len(found), sha, h > 0 and 20 * h >= len(w))))
    return sorted(out)


def test_decontamination(documents, spark):
    rng = random.Random(2)
    vocabulary = ["the", "The", "É", "é", "a1", "x-y", "of", "word", "WORD", "z"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 12, 13, 14, 30]))) for i in range(25)] + [(99, None), (7, text(20)), (3, "The of"), (3, "The of")]
    docs = [(i, text(rng.randint(0, 80))) for i in range(60)]
    for i in range(60, 90):
        item = rng.choice(items)[1] or ""
        docs.append((i, f"{text(rng.randint(0, 60))}. {item.upper() if i % 2 else item}! {text(rng.randint(0, 90))}"))
    docs += EDGES + [(95, f"{text(20_000)} {items[3][1]}")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, key string")
    got = decontaminate.contamination(documents(docs), bench).collect()
    assert sorted(str(tuple(r)) for r in got) == _contaminated(docs, items, 13)
    none = decontaminate.contamination(documents(docs[:5]), bench.limit(0)).collect()
    assert {r["n_hit"] for r in none} == {0} and decontaminate.contamination(documents([]), bench).count() == 0


def test_decontamination_by_shuffles_only(documents, spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [(1, f"before {passage} after"), (2, passage[:40]), (3, None)]
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = decontaminate.contamination(documents(docs), bench)
    assert sorted(str(tuple(r)) for r in got.collect()) == _contaminated(docs, [(1, passage)], 13)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_signs_behind_a_word_need_no_whole_encoding(monkeypatch):
    """Letters and the signs behind them are encoded each once; all other words by the library as a whole."""
    tokenizer = id_files.Tokenizer(common.file_of(WORDS), 1000)
    library = Tokenizer.from_file(WORDS)
    rng = random.Random(11)
    letters = ["".join(rng.choice("abcXYZéßø") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    signs = ["$$$", "&&&", "!!", ".%%%", ",***", "###", "<|", '"', "^`", "-", "/", "~", "{}"]
    words = [a + rng.choice(signs) for a in letters] + ["don't!!", "a_b$$$", "x$$$y", "9!!", "<|endoftext|>", "a<|endoftext|>", "a'$$", "é\u0301!!"]
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    assert [np.frombuffer(tokenizer.encode(w), "<u4").tolist() for w in words] == want
    whole = []
    monkeypatch.setattr(tokenizer, "_ids", lambda text: whole.append(text) or library.encode(text, add_special_tokens=False).ids)
    tokenizer.encode(" ".join(a + "q$$$" for a in letters))
    assert not whole


# --- quality


def _perplexities(docs, trained, size):
    """The model by its formulas, one pair at a time. Trusted texts have few types, so all are in the vocabulary."""
    from collections import Counter

    words = sorted({t for d in trained for t in TOKEN.findall(docs[d])})
    code = Coding(words, {})
    pairs = Counter()
    for d in trained:
        ids = code(docs[d])[0]
        pairs.update(zip(ids, ids[1:]))
    disc = (0, *discounts([sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)]))
    first, off, before = Counter(), Counter(), np.zeros(code.size, np.int64)
    for (u, v), n in pairs.items():
        first[u] += n
        off[u] += min(disc[min(n, 3)], n)
        before[v] += 1
    lower = unigram(before)
    out = {}
    for d, t in docs.items():
        ids = code(t)[0]
        total = 0.0
        for u, v in zip(ids, ids[1:]):
            n = pairs[u, v]
            p = lower[v] * (off[u] / first[u] if first[u] else 1)
            total -= np.log(p + (max(n - disc[min(n, 3)], 0) / first[u] if n else 0))
        out[d] = (len(ids) - 1, total)
    return out


def test_kneser_ney_is_a_distribution():
    before = np.array([0, 3, 1, 0, 7, 1, 2, 1, 1, 2, 3, 4])
    assert unigram(before).sum() == pytest.approx(1) and (unigram(before) > 0).all()
    assert unigram(np.zeros(4, int)).sum() == pytest.approx(1)
    assert [CLASSES[class_of(t)] for t in ("a", "Ab", "AB", "12", "a1", "!!")] == ["<lower>", "<title>", "<upper>", "<number>", "<mixed>", "<sign>"]


def test_perplexities(documents, spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_IDS", 60)  # many blocks
    rng = random.Random(3)
    docs = {i: " ".join(rng.choice(["a", "b", "Cd", "e.", "12"]) for _ in range(rng.randint(0, 30))) for i in range(60)}
    trained = list(range(0, 60, 2))
    ids = spark.createDataFrame([(d,) for d in trained], "doc_id long")
    got = {r["doc_id"]: (r["n"], r["sum"]) for r in quality.perplexities(documents(list(docs.items())), ids, 1000).collect()}
    want = _perplexities(docs, trained, 1000)
    assert {d: n for d, (n, _) in got.items()} == {d: n for d, (n, _) in want.items()}
    assert all(got[d][1] == pytest.approx(want[d][1], rel=1e-5, abs=1e-6) for d in docs)


def test_ids_of_texts_are_not_shuffled(documents, spark):
    """Blocks are read where they are stored; pairs and counts move as packed lists."""
    docs = documents([(i, "the cat sat on the mat again") for i in range(300)] + [(None, "the mat"), (1 << 60, None)])
    found = quality.perplexities(docs, spark.createDataFrame([(i,) for i in range(290)], "doc_id long"), 1000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "ids#" not in plan
    got = {r["doc_id"]: (r["n"], r["sum"]) for r in found.collect()}
    assert len(got) == 302 and got[1 << 60] == (0, 0.0) and len({got[i] for i in range(300)}) == 1 and got[None][0] == 2


def test_packed_counts():
    n = np.array([1, 254, 255, 256, 3, 10**12, 1, 255])
    assert quality.unpacked_counts(quality.packed_counts(n), len(n)).tolist() == n.tolist()
    assert quality.unpacked_counts(quality.packed_counts(n[:0]), 0).tolist() == []


def test_words_outside_the_vocabulary_are_told_apart(documents, spark):
    """However small the vocabulary is, words outside it, and which of them follow each other, are judged by trusted texts."""
    rng = random.Random(6)
    first, second = ["amber", "birch", "cedar", "delta"], ["ember", "flint", "gravel", "harbor"]
    pairs = [f"{rng.choice(first)} {rng.choice(second)}" for _ in range(400)]
    asked = {1000: "the cat amber gravel", 1001: "the cat gravel amber", 1002: "the cat vjqxk wzpfh"}
    docs = [*((i, "the cat " + t) for i, t in enumerate(pairs)), *asked.items()]
    ids = spark.createDataFrame([(i,) for i in range(400)], "doc_id long")
    got = {r["doc_id"]: (r["n"], r["sum"]) for r in quality.perplexities(documents(docs), ids, 2).collect()}
    assert [got[d][0] for d in asked] == [4, 4, 4]
    trusted, turned, strange = (got[d][1] for d in asked)
    assert trusted + 1 < turned and turned + 5 < strange


def test_quality_separates(documents, spark):
    rng = random.Random(4)
    clean = lambda n: " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "today", "again."]) for _ in range(n))
    junk = lambda n: " ".join(f"{rng.choice('qxz')}{rng.randint(0, 9999)}$$$" for _ in range(n))
    rows = [(i, clean(rng.randint(5, 80)), rng.choice(["en", None])) for i in range(300)] + [(i, junk(30), "en") for i in range(300, 330)]
    rows += [(400, None, "en"), (401, "", "xx"), (402, clean(9), "xx"), (None, junk(9), "en"), (1, rows[1][1], rows[1][2])]
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(200)] + [(i, 0, 0) for i in range(300, 320)] + [(210, 1, 1), (None, 1, 0), (5, 1, None), (6, None, 0)],
        "doc_id long, quality int, toxic int",
    )
    got = quality.quality(documents(rows), labels, quantile=0.99).collect()
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert len(got) == len(rows) and not kept & set(range(300, 330)) and None not in kept
    assert len(kept & set(range(300))) >= 285 and {400, 401, 402} <= kept
    nothing = quality.quality(documents(rows[:20]), labels.limit(0)).collect()
    assert len(nothing) == 20 and all(r["kept"] for r in nothing)
    assert quality.quality(documents([]), labels).count() == 0


def test_quality_allowance_shrinks(documents, spark):
    """The limit comes close to the held-out quantile with the number of held-out texts."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat"]) for _ in range(rng.randint(5, 60)))) for i in range(600)]
    docs, labels = documents(rows), spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels, quantile=0.8).withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).collect()
    scores = sorted(r["score"] for r in got if r["held"])
    high, middle = scores[int(0.8 * len(scores))], scores[len(scores) // 2]
    assert got[0]["threshold"] < high + 0.2 * (high - middle)


# --- URLs


def test_url_parts_and_rules(spark):
    urls = [
        None, "", "no scheme/x", "http://A.Example.NET/en/1?x=://y#z", "ftp://host", "http://host?q", "http://h#f", "://h/p", "http:///p",
        "http://example.net/en/", "http://x.example.com/de/2", "http://a.org/fr/3", "http://notexample.com/de/1", "http://net/", "http://a.net",
    ]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(
        url_templates.host_of(F.col("url")).alias("host"), url_templates.path_of(F.col("url")).alias("path")
    )
    name, verdict = url_templates.rule_verdict(F.col("host"), F.col("path"))
    got = [tuple(r) for r in df.select("host", "path", name, verdict).collect()]
    assert got == [
        ("", "", None, None), ("", "", None, None), ("", "", None, None), ("a.example.net", "/en/1", "example.net/en/", "allow"),
        ("host", "", None, None), ("host", "", None, None), ("h", "", None, None), ("h", "/p", None, None), ("", "/p", None, None),
        ("example.net", "/en/", "example.net/en/", "allow"), ("x.example.com", "/de/2", "example.com/de/", "block"),
        ("a.org", "/fr/3", "org/fr/", "allow"), ("notexample.com", "/de/1", None, None), ("net", "/", "net/", "block"), ("a.net", "", None, None),
    ]


def test_templates_find_the_bad_branch(spark):
    rows, bad = [], []
    for i in range(400):
        section = ("news", "shop", "spam")[i % 3]
        rows.append((i, f"https://site.example/{section}/{i}", "x"))
        if i % 2:
            bad.append((i, section == "spam" or i % 50 == 1))
    rows += [(1000 + i, f"https://site.example/spam/{i}?q", "x") for i in range(5)] + [(2000, None, "x"), (2000, None, "x"), (2001, "https://site.example", "x")]
    rows += [(None, "https://site.example/news/9", "x"), (2002, "https://site.example/" + "a/" * 3000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad string")
    labels = spark.createDataFrame([*bad, (None, True), (2001, None)], "page_id long, bad boolean")
    got = url_templates.url_filter(pages, labels).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert all(by[i]["verdict"] == ("block" if i % 3 == 2 else "allow") for i in range(400))
    assert all(by[1000 + i]["verdict"] == "block" and by[1000 + i]["template"] == "/spam/**" for i in range(5))
    assert by[0]["template"] == by[1]["template"] and by[0]["template"].startswith("/news|+1~")
    assert by[2001]["template"] == "" and by[2000]["host"] == "" and by[2002]["template"].endswith("/**")
    # Share by hand: /spam has its own pages and, as prior, all others of the host; those have no pages of other hosts.
    spam, others = [x for i, x in bad if i % 3 == 2], [x for i, x in bad if i % 3 != 2]
    share = (sum(others) + 5 * 0.5) / (len(others) + 5)
    share = (sum(spam) + 5 * share) / (len(spam) + 5)
    assert by[2]["bad_share"] == pytest.approx(share, abs=1e-6)
    assert url_templates.url_filter(pages.limit(0), labels).count() == 0
    assert {r["verdict"] for r in url_templates.url_filter(pages, labels.limit(0), threshold=0.6).collect()} == {"allow"}


def test_templates_of_a_small_section_and_of_deep_paths(spark):
    """A bad section with a hundredth of its host's pages, and verdicts that differ far down."""
    rows, bad = [], []
    for i in range(3000):
        rows.append((i, f"https://site.example/{'spam' if i % 100 == 0 else f's{i % 7}'}/{i}"))
        bad.append((i, i % 100 == 0))
    for i in range(200):
        rows.append((5000 + i, f"https://deep.example/a/b/c/d/e/f/g/h/{'spam' if i % 2 else 'news'}/{i}"))
        bad.append((5000 + i, i % 2 == 1))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = url_templates.url_filter(pages, spark.createDataFrame(bad, "page_id long, bad boolean")).collect()
    assert len(got) == len(rows)
    assert {r["page_id"]: r["verdict"] == "block" for r in got} == dict(bad)


def test_evidence_counts_once(spark):
    """Three bad pages have one share, whatever the length of their paths and however far the tree goes."""
    rows, bad = [(i, f"https://other.example/{i}") for i in range(10)], [(i, False) for i in range(10)]
    for depth in range(1, 7):
        for i in range(3):
            rows.append((100 * depth + i, f"https://h{depth}.example/" + "/".join(["s"] * (depth - 1) + [str(i)])))
            bad.append((100 * depth + i, True))
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad boolean")
    for model in ({}, {"least_count": 1, "least_labelled": 1}):
        got = url_templates.url_filter(pages, labels, **model).collect()
        assert len({r["bad_share"] for r in got if r["page_id"] >= 100}) == 1


@pytest.mark.parametrize("siblings", [16, 60])
def test_any_number_of_similar_siblings_is_one_branch(spark, siblings):
    rows, bad = [], []
    for s in range(siblings):
        for i in range(20):
            rows.append((len(rows), f"https://h.example/bad{s}/{len(rows)}"))
            bad.append((len(rows) - 1, i < 19))
    for i in range(40 * siblings):
        rows.append((len(rows), f"https://h.example/good{i}/x"))
        bad.append((len(rows) - 1, i % 20 == 0))
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad boolean")
    got = url_templates.url_filter(pages, labels).collect()
    branches = {r["template"].split("/")[1] for r in got if "/bad" in r["path"]}
    assert len(branches) == 1 and branches != {"*"}
    assert all(r["verdict"] == ("block" if "/bad" in r["path"] else "allow") for r in got)


def test_pages_with_columns_of_the_results_names(spark):
    rows = [(i, f"https://h.example/{i}", "x", 1, "t", None) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path int, template string, rest string")
    got = url_templates.url_filter(pages, spark.createDataFrame([], "page_id long, bad boolean")).collect()
    assert sorted(r["path"] for r in got) == [f"/{i}" for i in range(5)]


def test_side_is_small_by_bytes(spark, monkeypatch):
    few = spark.createDataFrame([("x" * 3000, ["y" * 2000, None], [1, 2])] * 4 + [(None, None, None)], "a string, b array<string>, c array<long>")
    monkeypatch.setattr(common, "BROADCAST_BYTES", 20_000)
    assert not common.is_small(few) and common.is_small(few.select("c")) and common.is_small(few.limit(0))
