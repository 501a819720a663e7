"""Exact duplicates by an exchange of Golomb-coded fingerprints (operator 7).

1. Each partition hashes its texts and stores a narrow row for each: id, length, SHA-256, short fingerprint.
2. It sends each owner of a fingerprint range the sorted fingerprints it has, once each, Golomb coded, with a
   bit for those it has more than once itself.
3. An owner answers each list with a bitmap: which fingerprints are there more than once in all.
4. Texts behind those bits are suspects. They alone are shuffled, and grouped by their bytes, so a fingerprint
   that two texts share by chance does no harm. Copies in one task are one row before the shuffle.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import golomb
from ledgerline.llm.common import arrow_map, keep_ids, small
from ledgerline.session import materialize

SPACE = b" \t\n\x0b\x0c\r"
#: Bits of a fingerprint. More bits make longer lists and fewer innocent suspects.
BITS = 44
SCHEMA = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"


def _fingerprints(source) -> Iterator[dict]:
    for batch in source:
        shas = [hashlib.sha256((t or "").encode().translate(None, SPACE)).digest() for t in batch["text"]]
        yield {
            "doc_id": batch["doc_id"], "part": batch["part"], "n_chars": [len(t or "") for t in batch["text"]],
            "sha": [s.hex() for s in shas],
            "fp": [int.from_bytes(s[:8], "big") >> (64 - BITS) for s in shas],
        }


def _lists(owners: int):
    """A task's fingerprints as one row for each owner of a range; `twice` marks what the task has repeatedly."""
    width = -(-(1 << BITS) // owners)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)  # narrow: 12 bytes a document of this task
        if not frames:
            return
        rows = pd.concat(frames)
        for part, some in rows.groupby("part"):
            values, counts = np.unique(some["fp"].to_numpy(np.uint64), return_counts=True)
            owner = (values // np.uint64(width)).astype(np.int64)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
                base = np.uint64(owner[a] * width)
                yield pd.DataFrame({
                    "owner": [owner[a]], "part": [part], "list": [golomb.encode(values[a:b] - base, width)],
                    "twice": [np.packbits(counts[a:b] > 1).tobytes()],
                })

    return run


def _answers(lists: pd.DataFrame) -> pd.DataFrame:
    """An owner's lists with the bitmap of what is there more than once in all of them."""
    decoded = [golomb.decode(x) for x in lists["list"]]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(d)).astype(bool) for t, d in zip(lists["twice"], decoded, strict=True)]
    values, counts = np.unique(np.concatenate(decoded), return_counts=True)
    again = np.union1d(values[counts > 1], np.concatenate([d[t] for d, t in zip(decoded, twice, strict=True)]))
    bits = [np.packbits(np.isin(d, again, assume_unique=True)).tobytes() for d in decoded]
    return pd.DataFrame({"owner": lists["owner"], "part": lists["part"], "list": lists["list"], "bits": bits})


def _marked(width: int):
    """Read an answered list back: the fingerprints whose bit is set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for owner, part, data, bits in zip(rows["owner"], rows["part"], rows["list"], rows["bits"], strict=True):
                values = golomb.decode(data)
                hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(values)).astype(bool)
                if hit.any():
                    yield pd.DataFrame({"part": part, "fp": (values[hit] + np.uint64(owner * width)).astype(np.int64)})

    return run


def _suspected(width: int):
    """An owner's answers, read back by the same worker: a second one for each task would take an executor's memory, and stay."""
    read = _marked(width)

    def run(lists: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"part": pd.Series(dtype="int32"), "fp": pd.Series(dtype="int64")}), *read(iter([_answers(lists)]))])

    return run


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs`: which row of its equal texts stays, and how many there are.

    Texts are equal if they are the same without ASCII white space; null counts as empty, and all empty texts are
    equal. The row with the most code points stays, then the smallest doc_id (null last). Rows with one doc_id
    count as a document each and have the same result. Text of any length is hashed and compared whole.
    """
    spark = docs.sparkSession
    narrow = materialize(
        arrow_map(
            docs.select("doc_id", "text").withColumn("part", F.spark_partition_id()), ["doc_id", "text", "part"],
            "doc_id long, part int, n_chars long, sha string, fp long", _fingerprints,
        ),
        "fingerprints",
    )
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = -(-(1 << BITS) // owners)
    lists = narrow.select("part", "fp").mapInPandas(_lists(owners), "owner long, part int, list binary, twice binary")
    marked = lists.groupBy("owner").applyInPandas(_suspected(width), "part int, fp long")
    suspects = materialize(narrow.join(marked, ["part", "fp"], "left_semi"), "suspects")

    # The bytes decide: suspects' texts, grouped by what they are.
    bytes_of = keep_ids(docs.select("doc_id", "text"), suspects, "doc_id").select(
        F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", "").alias("bytes")
    )
    groups = (
        bytes_of.groupBy("bytes").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
        .select(F.sha2("bytes", 256).alias("sha"), "group_size")
    )
    first = suspects.groupBy("sha").agg(
        F.min(F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))).alias("first")
    )
    groups = materialize(groups.join(first, "sha").select("sha", "group_size", F.col("first.c").alias("keep_id")), "groups")
    return narrow.join(small(groups), "sha", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
