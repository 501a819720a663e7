"""Benchmark decontamination by winnowing (operator 8). DataFrame and SQL functions only.

Windows of `window` words of a benchmark item must not be found in a document. Both sides are fingerprinted: of
every `window - gram + 1` neighbouring k-gram hashes the smallest is kept. Equal windows keep equal hashes, so a
document without a fingerprint of the benchmark holds none of its windows, and every shared window is found.
Documents that share one are read again: around each shared k-gram, hits are extended to whole windows, which are
compared word by word with the benchmark's.

An item with fewer words than a window is one window of its own length; each such length has a pass of its own with
k-grams as long as the item, so nothing is left out.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import small
from ledgerline.session import materialize

# explode_outer throughout: for explode, Catalyst adds a filter on the array's size below, which would compute the chained
# array expressions again, twice as often at each step. The nulls of empty arrays match nothing.

#: Everything that is no word character: ASCII without digits and letters.
_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"


def words_of(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z alone; null has none."""
    # lower() is much faster than translate() and the same where there is nothing but ASCII.
    lowered = F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), _GAP), lambda w: w != "")


def _shift(a: Column, by: int, length: Column) -> Column:
    return F.slice(a, by + 1, F.greatest(length, F.lit(0)))


def _grow(a: Column, n: Column, have: int, want: int, join) -> tuple[Column, Column]:
    """From values over `have` neighbours to values over `want` (at most twice as many): join(a[i], a[i + want - have])."""
    by = want - have
    return F.zip_with(_shift(a, 0, n - by), _shift(a, by, n - by), join), n - by


def _steps(to: int) -> list[int]:
    """Lengths that double from 1 up to `to`."""
    have = [1]
    while have[-1] < to:
        have.append(min(2 * have[-1], to))
    return have


def _with_grams(df: DataFrame, gram: int, words: str = "words", n: str = "n_words") -> DataFrame:
    """Adds `grams`: a hash of every `gram` neighbouring words."""
    df = df.withColumns({"grams": F.transform(words, lambda w: F.xxhash64(w)), "n_grams": F.col(n)})
    lengths = _steps(gram)
    for have, want in zip(lengths, lengths[1:]):
        grams, left = _grow(F.col("grams"), F.col("n_grams"), have, want, lambda a, b: F.xxhash64(a, b))
        df = df.withColumns({"grams": grams, "n_grams": F.greatest(left, F.lit(0))})
    return df


def _with_fingerprints(df: DataFrame, grams_a_window: int) -> DataFrame:
    """Turns `grams` into the distinct minima of all runs of `grams_a_window`."""
    lengths = _steps(grams_a_window)
    for have, want in zip(lengths, lengths[1:]):
        low, left = _grow(F.col("grams"), F.col("n_grams"), have, want, lambda a, b: F.least(a, b))
        df = df.withColumns({"grams": low, "n_grams": F.greatest(left, F.lit(0))})
    return df.withColumn("grams", F.array_distinct("grams"))


def _windows(df: DataFrame, starts: Column, length: int) -> Column:
    return F.transform(starts, lambda s: F.struct(
        s.alias("start"), F.array_join(F.slice("words", s + 1, length), " ").alias("window")
    ))


def _printed(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, n_words, grams): the fingerprints of each document's windows of `length` words."""
    return _with_fingerprints(_with_grams(docs, gram), length - gram + 1).select("key", "n_words", "grams")


def _found(docs: DataFrame, printed: DataFrame, items: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, start, length, window): each place of a document where a window of `items` stands, of `length` words.

    `docs` has key and words, and `printed` its fingerprints; `items` has item_id, words and n_words, all of at least
    `length` words.
    """
    per_window = length - gram + 1
    prints = materialize(
        _with_fingerprints(_with_grams(items, gram), per_window).select(F.explode_outer("grams").alias("print")).distinct(),
        "prints",
    )
    shared = materialize(
        printed.select("key", F.explode_outer("grams").alias("print"))
        .join(small(prints), "print", "left_semi")
        .groupBy("key").agg(F.collect_set("print").alias("prints")),
        "shared",
    )
    windows = materialize(
        items.select(F.explode_outer(_windows(items, F.sequence(F.lit(0), F.col("n_words") - length), length)).alias("w"))
        .select("w.window").distinct(),
        "windows",
    )
    suspects = _with_grams(docs.join(small(shared), "key"), gram)
    places = F.filter(
        F.transform("grams", lambda g, i: F.when(F.array_contains("prints", g), i)), lambda i: i.isNotNull()
    )
    around = F.array_distinct(F.flatten(F.transform(places, lambda i: F.sequence(
        F.greatest(i - (per_window - 1), F.lit(0)), F.greatest(F.least(i, F.col("n_words") - length), F.lit(0))
    ))))
    starts = F.filter(around, lambda s: s <= F.col("n_words") - length)
    extended = suspects.withColumn("starts", starts)
    return (
        extended.select("key", F.explode_outer(_windows(extended, F.col("starts"), length)).alias("w"))
        .select("key", "w.start", "w.window")
        .join(small(windows), "window", "left_semi")
        .select("key", "start", F.lit(length).alias("length"), "window")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 6, share: int = 20) -> DataFrame:
    """One row for each doc_id: words, words inside a benchmark window, items found, and whether it is contaminated.

    contaminated: n_hit > 0 and share * n_hit >= n_words. A null text has no words; an empty benchmark hits
    nothing; item ids are compared as strings, and items with one id count once. Rows with one doc_id are one
    document if their texts are equal, else each has its own row. A null doc_id is judged like any other. Long texts
    are searched whole.
    """
    spark = docs.sparkSession
    key = F.struct("doc_id", F.xxhash64("text").alias("text")).alias("key")
    read = docs.select(key, words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    items = materialize(
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
        .withColumn("n_words", F.size("words")).where("n_words > 0"),
        "items",
    )
    short = [r[0] for r in items.where(F.col("n_words") < window).select("n_words").distinct().collect()]  # < window values
    # Stored: the fingerprints are a small part of the text, and the number of words is asked for again in the end.
    stored = materialize(_printed(read, window, gram), "printed")
    passes = [(stored, items.where(F.col("n_words") >= window), window, gram)]
    passes += [(_printed(read, n, n), items.where(F.col("n_words") == n), n, n) for n in sorted(short)]
    found = materialize(
        reduce(DataFrame.union, [_found(read, printed, some, length, k) for printed, some, length, k in passes]).distinct(), "found"
    )
    of_items = [
        some.select("item_id", F.explode_outer(_windows(some, F.sequence(F.lit(0), F.col("n_words") - length), length)).alias("w"))
        .select("item_id", F.lit(length).alias("length"), "w.window")
        for _, some, length, _ in passes
    ]
    items_hit = (
        found.select("key", "length", "window").distinct()
        .join(reduce(DataFrame.union, of_items).distinct(), ["length", "window"])
        .select("key", "item_id").distinct()
        .groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("items"))
    )
    # Words covered: each span counts from where the spans before it have ended. Starts are sorted, and so are ends
    # that have been passed, as the farthest end is carried along.
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            (acc["n"] + F.greatest(s["end"] - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    hits = (
        found.groupBy("key").agg(F.array_sort(F.collect_set(
            F.struct("start", (F.col("start") + F.col("length")).alias("end"))
        )).alias("spans"))
        .select("key", covered.cast("long").alias("n_hit"))
        .join(items_hit, "key")
        .select("key", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("sha"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0))
    return stored.select("key", "n_words").join(small(materialize(hits, "hits")), "key", "left").select(
        F.col("key.doc_id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"),
        n_hit.cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
