"""Document fingerprints by locally consistent parsing (operator 13).

A text is parsed into a hierarchy of phrases. On each level a run of equal names first becomes one name; then neighbours
differ, and deterministic coin tossing writes for each name the lowest bit in which it differs from the one before. A few
rounds of that leave labels below six whatever the names were; phrases end before local maxima of the labels. Where a phrase
ends depends on a few names around it alone, so equal substrings have equal phrases, but for some at their borders,
wherever they stand. A phrase is named by a hash of its names, which are the symbols of the next level.

The fingerprint is a sketch (the smallest hashes) of the set of phrases of some size, and likeness is the estimated share
of common phrases.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map, ascending

#: Phrases of this level and above are features; a phrase is some three symbols of the level below.
BASE_LEVEL = 2
#: Hashes of a fingerprint, 8 hexadecimal digits each.
SIZE = 128
#: Characters that are parsed together; a longer text is parsed alone, with some 100 bytes a character.
PIECE_CHARS = 1 << 19

_ROUNDS = 4  # of coin tossing: 64-bit names -> below 128 -> below 14 -> below 8 -> below 6
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of `x`."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, _ODD, np.uint64))


def toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six in which neighbours differ. `names` differ from their predecessors unless `first` marks a start."""
    label = names
    for _ in range(_ROUNDS):
        before = np.concatenate([label[:1], label[:-1]])
        differs = label ^ before
        differs[first] = 1  # nothing before: as if the lowest bit differed
        lowest = np.bitwise_count((differs & (~differs + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        label = lowest * np.uint64(2) + ((label >> lowest) & np.uint64(1))
    return label


def phrase_starts(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks where phrases begin: at the start of a text and at local maxima of the labels."""
    label = toss(names, first).astype(np.int8)
    label_before = np.concatenate([[-1], label[:-1]]).astype(np.int8)
    label_after = np.concatenate([label[1:], [-1]]).astype(np.int8)
    label_after[:-1][first[1:]] = -1  # nothing follows the last name of a text
    start = (label > label_before) & (label > label_after)
    second = np.concatenate([[False], first[:-1]])
    start[second] = False  # a start and the name after it stay together
    return start | first


def parse_levels(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level from 1 on, (text number, phrase name) of all phrases, in order; a text ends as one phrase."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    names = _mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + _ODD)
    owner = np.repeat(np.arange(len(texts)), sizes)
    while len(names):
        # Runs of equal names become one, named by what is repeated and how often.
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        change = np.flatnonzero(first | np.concatenate([[True], names[1:] != names[:-1]]))
        length = np.diff(np.append(change, len(names)))
        names, owner, first = names[change], owner[change], first[change]
        repeated = length > 1
        names = np.where(repeated, _mix(names * _ODD + length.astype(np.uint64)), names)
        same = np.flatnonzero(~first & (names == np.concatenate([names[:1], names[:-1]])))
        names[same] ^= np.uint64(1)  # two runs' names met by chance
        at = np.flatnonzero(phrase_starts(names, first))
        inside = np.arange(len(names)) - np.repeat(at, np.diff(np.append(at, len(names))))
        weighed = _mix(names) * _powers(int(inside.max()) + 1)[inside]
        names, owner = _mix(np.add.reduceat(weighed, at)), owner[at]
        yield owner, names
        # A text that is one phrase is done.
        alone = np.bincount(owner, minlength=len(texts))[owner] == 1
        names, owner = names[~alone], owner[~alone]


def fingerprints(texts: list[str], size: int = SIZE, base: int = BASE_LEVEL) -> list[np.ndarray]:
    """The `size` smallest hashes, ascending, of each text's phrases of level `base` and above, and of its last one."""
    owners, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for level, (owner, names) in enumerate(parse_levels(texts), 1):
        if level < base:
            alone = np.bincount(owner, minlength=len(texts))[owner] == 1
            owner, names = owner[alone], names[alone]
        owners.append(owner)
        hashes.append((_mix(names + np.uint64(level if level >= base else 0)) >> np.uint64(32)).astype(np.uint32))
    owner, found = np.concatenate(owners), np.concatenate(hashes)
    key = ascending(owner.astype(np.uint64) << np.uint64(32) | found)  # by text, then ascending, without repeats
    ends = np.searchsorted(key >> np.uint64(32), np.arange(len(texts) + 1))
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [low[i : min(j, i + size)] for i, j in zip(ends.tolist(), ends[1:].tolist())]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of common phrases, of all phrases of either text: of the `size` smallest hashes of both together,
    the share that both have. Exact if there are no more; two empty fingerprints are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:size]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def text_of(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """`text` with its last half replaced by as many first characters of the following one."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Fingerprinter:
    """Rows (doc_id, text) with the text that follows each, to result rows; parses many texts together."""

    def __init__(self, size: int, base: int) -> None:
        self.size, self.base = size, base

    def rows(self, ids: list, texts: list[str]) -> dict:
        """Results of all rows but the last, whose text follows the row before it."""
        changed = [edited(t, f) for t, f in zip(texts, texts[1:])]
        own = fingerprints(texts, self.size, self.base)
        new = fingerprints(changed, self.size, self.base)
        return {
            "doc_id": ids[:-1], "n_chars": list(map(len, texts[:-1])),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": list(map(text_of, own[:-1])), "edited_fingerprint": list(map(text_of, new)),
            "near_edited": [likeness(x, y, self.size) for x, y in zip(own, new)],
            "near_next": [likeness(x, y, self.size) for x, y in zip(own, own[1:])],
        }


def _with_next(source, size: int, base: int) -> Iterator[dict]:
    """Rows of some ranges in order; behind each range stands, marked, the text that follows its last row."""
    make = Fingerprinter(size, base)
    ids, texts, total = [], [], 0
    for batch in source:
        for doc_id, text, follows in zip(batch["doc_id"], batch["text"], batch["follows"], strict=True):
            ids.append(doc_id)
            texts.append(text)
            total += len(text)
            if len(ids) > 1 and (follows or total >= PIECE_CHARS):
                yield make.rows(ids, texts)
                ids, texts, total = ids[-1:], texts[-1:], len(text)
            if follows:
                ids, texts, total = [], [], 0


def _ranged(rows: DataFrame, ranges: int) -> DataFrame:
    """`rows` with `range`, `first` and `second`: their order is by range, then by first and second.

    Ids are cut at their quantiles, the largest ones first; rows without id follow, cut by the hash of their text.
    """
    shares = [i / ranges for i in range(1, ranges)]
    found = rows.agg(
        F.percentile_approx("doc_id", shares, 10_000).alias("edges"), F.count("*").alias("n"), F.count("doc_id").alias("named")
    ).first()  # a number for each range
    edges = sorted(set(found["edges"] or []))
    nameless = 1 + (found["n"] - found["named"]) * ranges // max(1, found["n"])
    by_id = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<long>"), lambda e: e > F.col("doc_id")))
    by_hash = F.floor((F.col("second").cast("double") / 2.0**64 + 0.5) * nameless)
    return rows.withColumn("first", F.bitwise_not("doc_id")).withColumn("second", F.xxhash64("text")).withColumn(
        "range", F.when(F.col("doc_id").isNotNull(), by_id).otherwise(len(edges) + 1 + F.least(by_hash, F.lit(nameless - 1))).cast("int")
    )


def fingerprint_documents(docs: DataFrame, size: int = SIZE, base: int = BASE_LEVEL) -> DataFrame:
    """One row for each row of `docs`: fingerprints of its text and of its edited text, and how alike they are.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many (or all) of the next document's,
    in descending order of doc_id; the last document's next one is the first. A null text counts as empty; an empty text
    has an empty fingerprint, two of which are alike by 1.0, and is alike to others by 0.0. Repeated ids are ordered by
    a hash of their text; rows without doc_id come last. A table of one row is followed by itself; an empty table gives an
    empty result. Texts are parsed whole. Only doc_id and text are read.

    Rows are dealt out by ranges of doc_id, which is the one shuffle of texts. The first text of each range goes to the
    range before it as well. Rows of one doc_id stay together; they stream past, nothing of them is collected.
    """
    spark = docs.sparkSession
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = _ranged(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), ranges)
    key = F.struct(F.coalesce("first", F.lit(0)).alias("first"), "second").alias("key")
    heads = rows.select("range", key).groupBy("range").agg(F.min("key").alias("key")).orderBy("range").collect()  # a row a range
    before = [(heads[i - 1]["range"], r["range"], *r["key"]) for i, r in enumerate(heads)]
    head = F.broadcast(spark.createDataFrame(before, "before int, __range int, __first long, __second long"))
    is_head = (F.col("range") == F.col("__range")) & (F.coalesce("first", F.lit(0)) == F.col("__first")) & (F.col("second") == F.col("__second"))
    following = rows.join(head, is_head).select("doc_id", "text", "first", "second", F.col("before").alias("range"))
    both = rows.withColumn("follows", F.lit(False)).unionByName(following.dropDuplicates(["range"]).withColumn("follows", F.lit(True)))
    dealt = both.repartitionByRange(ranges, "range").sortWithinPartitions("range", "follows", F.col("first").asc_nulls_last(), "second", "text")
    return arrow_map(dealt, ["doc_id", "text", "follows"], RESULT, lambda source: _with_next(source, size, base))
