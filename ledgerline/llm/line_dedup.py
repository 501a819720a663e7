"""Fuzzy line deduplication by MinHash (operator 4).

Lines are compared by their character shingles in lower case: all windows of 6 characters; a shorter line is one shingle.
Every shingle has one hash. The hash range is cut into 24 parts; the five smallest hashes from a part's start on are a
band, that is, MinHash samples under 24 rotations of one order. Two long lines have no band in common once in about 14,000
at similarity 0.8. A line of up to 32 shingles also has a band of four from each of its shingles on: of two such lines at 0.8
at least a fifth of these agree, so none is missed. Lines of 60 characters that differ in one are similar. Unlike lines share
bands too, the more the more lines there are: of 255,415 lines of 98 MB 24,826 share one with 16 parts and four hashes a band,
11,408 with 24 and five (both counted with one kind of band for short lines).

Lines with a band in common are compared by the exact Jaccard similarity of their whole shingle sets, in pieces (see
near_dedup); the lines themselves move there, as they are shorter than their sets. Distributed union-find makes groups of
the links, and one line of each group stays.

A form with DataFrame functions only, with fewer shingles, took 622 CPU seconds and 7.7 x disk a GB, and compared lines
pair by pair as rows; hence numpy over whole batches of text.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map, ascending, keep_ids, small
from ledgerline.llm.components import components
from ledgerline.llm.near_dedup import _linked, _mix
from ledgerline.session import materialize

WIDTH = 6
PARTS, SAMPLES = 24, 5  # bands of a long line, hashes of a band
SHORT_SAMPLES = 4  # with more, two short sets at 0.8 may have no band in common
#: Bits of a band's name. A name that two bands share by chance only costs a comparison.
BITS = 44
#: Sets of up to so many shingles also have a band from each shingle on.
SHORT = 32
DOCUMENTS_A_STEP = 100  # their shingles stay in a core's cache

_FACTORS = np.random.default_rng(16).integers(1, 1 << 62, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of the shingles at every position of lines in normal form, by line, repeated ones included."""
    text = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le"), "<u4")
    ends = np.flatnonzero(text == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - begins
    n = np.maximum(sizes - WIDTH + 1, 1)
    line = np.repeat(np.arange(len(lines)), n)
    place = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum())
    character = np.concatenate([text, np.zeros(WIDTH, "<u4")]).astype(np.uint64)
    hashes = np.zeros(len(text), np.uint64)
    for i in range(WIDTH):
        hashes += character[i : i + len(text)] * _FACTORS[i]
    found = _mix(hashes[place])
    for k in np.flatnonzero(sizes < WIDTH):  # one shingle, of what the line has
        name = hashlib.blake2b(lines[k].encode("utf-8", "surrogatepass"), digest_size=8).digest()
        found[np.searchsorted(line, k)] = int.from_bytes(name, "little")
    return line, found


def every_shingle(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, 40-bit hash in the high bits) of the distinct shingles at every position, ordered by line and hash."""
    line, hashes = _windows(lines)
    packed = ascending((line.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    return (packed >> np.uint64(40)).astype(np.int64), packed << np.uint64(24)


class _AlikeLines:
    """Exact similarity of whole sets. Many small groups are read at once, and compared with their first lines at once."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def __call__(self, data: list[bytes]) -> Callable[[int], np.ndarray]:
        return self.many([data])[0]

    def many(self, groups: list[list[bytes]]) -> list[Callable[[int], np.ndarray]]:
        sizes = np.array([len(g) for g in groups])
        ends = np.cumsum(sizes)
        line, hashes = _windows([d.decode("utf-8", "surrogatepass") for g in groups for d in g])
        group = np.repeat(np.arange(len(groups)), sizes)
        hashes += group.astype(np.uint64)[line] * np.uint64(0x9E3779B97F4A7C15)  # a group's shingles are its own
        order = np.argsort(hashes)
        token = np.empty(len(order), np.int64)
        token[order] = np.cumsum(np.diff(hashes[order], prepend=hashes[order[0]]) != 0)
        pairs = ascending((line << 32) | token)
        line, token = pairs >> 32, pairs & 0xFFFFFFFF
        starts = np.searchsorted(line, np.arange(len(group) + 1))
        n = np.diff(starts)
        mark = np.zeros(len(order), bool)

        def similar(own: np.ndarray, n_own: np.ndarray, begin: int, end: int) -> np.ndarray:
            mark[own] = True
            hits = np.cumsum(mark[token[starts[begin] : starts[end]]])
            mark[own] = False
            common = np.diff(hits[starts[begin + 1 : end + 1] - starts[begin] - 1], prepend=0)
            return 100 * common >= self.percent * (n[begin:end] + n_own - common)

        is_first = np.zeros(len(group), bool)
        is_first[ends - sizes] = True
        firsts = similar(token[is_first[line]], n[(ends - sizes)[group]], 0, len(group))

        def alike_of(begin: int, end: int) -> Callable[[int], np.ndarray]:
            def alike(i: int) -> np.ndarray:
                i += begin
                return similar(token[starts[i] : starts[i + 1]], n[i], begin, end) if i > begin else firsts[begin:end]

            return alike

        return [alike_of(end - size, end) for size, end in zip(sizes, ends, strict=True)]


def _bands_from(at: np.ndarray, line: np.ndarray, hashes: np.ndarray, part: np.ndarray, samples: int) -> np.ndarray:
    """Names of the bands of `samples` hashes from the places `at` on, going round at the end of a line's."""
    begin = np.searchsorted(line, line[at])
    size = np.searchsorted(line, line[at], "right") - begin
    name = part[at]
    for k in range(samples):
        name = _mix(name * np.uint64(0x9E3779B97F4A7C15) + hashes[begin + (at - begin + k) % size])
    return (name >> np.uint64(64 - BITS)).astype(np.int64)


def bands(line: np.ndarray, hashes: np.ndarray, short: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(line, band), by line: of each part of the hash range that has some, the first SAMPLES hashes, going round at the end.

    Sets of up to `short` hashes also have a band of SHORT_SAMPLES from each hash on.
    """
    part = (hashes >> np.uint64(32)) * np.uint64(PARTS) >> np.uint64(32)
    first = np.ones(len(line), bool)
    first[1:] = (line[1:] != line[:-1]) | (part[1:] != part[:-1])
    at = np.flatnonzero(first)
    names = _bands_from(at, line, hashes, part, SAMPLES)
    if short and len(line) and len(more := np.flatnonzero(np.bincount(line)[line] <= short)):
        names = np.concatenate([names, _bands_from(more, line, hashes, part, SHORT_SAMPLES)])
        at = np.concatenate([at, more])
    order = np.argsort(line[at], kind="stable")
    return line[at][order], names[order]


def _normal(text: str | None) -> list[tuple[int, str]]:
    """(place, normal form) of the lines that are not blank. Only line feeds end lines."""
    return [(i, n) for i, x in enumerate((text or "").split("\n")) if (n := x.strip(" ").lower())]


def _names(line: str) -> tuple[int, int]:
    """A line's id and, should two lines have one id, what tells them apart."""
    digest = hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _lists(line: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Values as n lists, by line."""
    offsets = np.searchsorted(line, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _read(source) -> Iterator[dict]:
    """A row for each line; its bands where the task sees it first. Texts of any length: a step holds whole documents."""
    seen: set[tuple[int, int]] = set()
    for batch in source:
        for at in range(0, len(batch["doc_id"]), DOCUMENTS_A_STEP):
            out: dict[str, list] = {"doc_id": [], "text_hash": [], "place": [], "id": [], "other": []}
            fresh, where = [], []
            for doc_id, text_hash, text in zip(*(batch[c][at : at + DOCUMENTS_A_STEP] for c in ("doc_id", "text_hash", "text")), strict=True):
                for place, line in _normal(text):
                    names = _names(line)
                    if names not in seen:
                        if len(seen) >= 250_000:
                            seen.clear()  # bounds memory; a line may then have its bands twice
                        seen.add(names)
                        fresh.append(line)
                        where.append(len(out["id"]))
                    for c, v in zip(out, (doc_id, text_hash, place, *names), strict=True):
                        out[c].append(v)
            if out["id"]:
                row, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if fresh:
                    row, values = bands(*every_shingle(fresh), SHORT)
                yield out | {"bands": _lists(np.array(where, np.int64)[row], values, len(out["id"]))}


def _own_lines(source) -> Iterator[dict]:
    for batch in source:
        for at in range(0, len(batch["text"]), DOCUMENTS_A_STEP):
            out: dict[str, list] = {"doc_id": [], "text_hash": [], "place": [], "data": []}
            for doc_id, text_hash, text in zip(*(batch[c][at : at + DOCUMENTS_A_STEP] for c in ("doc_id", "text_hash", "text")), strict=True):
                for place, line in _normal(text):
                    for c, v in zip(out, (doc_id, text_hash, place, line.encode("utf-8", "surrogatepass")), strict=True):
                        out[c].append(v)
            yield out


def _told_apart(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows of `lines` without `other`; different lines with one id (`shared`) have new ids of both their names."""
    id = F.when(F.col("__id").isNull(), F.col("id")).otherwise(F.xxhash64("id", "other")).alias("id")
    marked = lines.join(small(shared.select(F.col("id").alias("__id"))), F.col("id") == F.col("__id"), "left")
    return marked.select(id, *[c for c in lines.columns if c not in ("id", "other")])


def duplicate_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, place) of each line that goes: all of a group of equal or similar lines but the first."""
    read = materialize(
        arrow_map(
            docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), ["doc_id", "text", "text_hash"],
            "doc_id long, text_hash long, place int, id long, other long, bands array<long>", _read,
        ),
        "lines",
    )
    two = read.groupBy("id").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low < high").select("id")
    two = materialize(two, "one-id")
    lines = _told_apart(read, two)
    keys = lines.select("id", F.explode("bands").alias("bucket"))
    # Which bands have different lines: 28 bits of a line's id tell it (all but once in 268 million pairs), and shrink what is shuffled.
    some = keys.select("bucket", F.col("id").bitwiseAND((1 << 28) - 1).cast("int").alias("id"))
    shared = some.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("bucket")
    members = materialize(keys.join(small(materialize(shared, "buckets")), "bucket", "left_semi").distinct(), "members")
    # A member's line is read again at one place where it stands, from the documents that hold such places.
    ids = materialize(members.select("id").distinct(), "member-ids")
    places = lines.join(small(ids), "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc_id", "text_hash", "place")).alias("at"))
    places = materialize(places.select("id", "at.*"), "places")
    wanted = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    own = arrow_map(
        keep_ids(wanted, materialize(places.select("doc_id").distinct(), "place-docs"), "doc_id"), ["doc_id", "text", "text_hash"],
        "doc_id long, text_hash long, place int, data binary", _own_lines,
    )
    side = small(places.withColumnRenamed("doc_id", "__doc"))
    own = own.join(side, ["text_hash", "place"]).where(F.col("doc_id").eqNullSafe(F.col("__doc"))).select("id", "data")
    own = materialize(own, "sets")
    # A line's set takes some tens of bytes for each of its shingles.
    sizes = own.groupBy("id").agg((F.max(F.octet_length("data")) * F.lit(40).cast("long")).alias("bytes"))
    named = members.join(sizes, "id").select(F.col("id").alias("doc_id"), "bucket", "bytes")
    groups = components(_linked(named, own.withColumnRenamed("id", "doc_id"), _AlikeLines(percent), "lines"))

    root = F.coalesce("root", "id").alias("root")
    named = lines.join(small(groups.withColumnRenamed("node", "id")), "id", "left").select("doc_id", "text_hash", "place", root)
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_hash").alias("c"), F.col("place").alias("d"))
    first = named.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1")
    first = small(materialize(first.select("root", "first"), "firsts"))
    stays = (
        F.col("doc_id").eqNullSafe(F.col("first.b")) & (F.col("text_hash") == F.col("first.c")) & (F.col("place") == F.col("first.d"))
    )
    return named.join(first, "root").where(~stays).select("doc_id", "text_hash", "place")


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """`docs` with doc_id, the text without its duplicate lines, and the numbers of lines before and after.

    One row for each row of `docs`. Lines end with a line feed and are compared without outer spaces and in lower case.
    Blank lines are no duplicates and stay. Of similar lines (Jaccard similarity of at least `percent` %, or connected by
    such) the one in the smallest doc_id (null last), then the first in its text, stays; ties between rows with one
    doc_id go to the smaller hash of the text, and rows that are equal in doc_id and text are one document with one
    result. Null texts are empty. Lines are named by 128-bit hashes, which two different lines share once in 10^14 tables of
    10^12 lines. Whole texts are read.
    """
    gone = duplicate_lines(docs.select("doc_id", "text"), percent).groupBy("doc_id", "text_hash").agg(
        F.collect_set("place").alias("gone")
    )
    gone = materialize(gone.withColumnsRenamed({"doc_id": "__doc", "text_hash": "__hash"}), "gone")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_hash") == F.col("__hash"))
    rows = rows.join(small(gone), same, "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains("gone", i))
    return rows.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.coalesce(F.size("gone"), F.lit(0))).cast("long").alias("n_kept"),
    )
