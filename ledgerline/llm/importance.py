"""Importance resampling towards a target distribution (operator 11).

Documents are drawn in proportion to how much likelier their hashed n-grams are in a target corpus than in the source. A
feature's hash is a CRC-32. Distinct features of a piece of text are grouped by their length in bytes; the features of a
length are the rows of a two-dimensional array of bytes, and all their CRCs advance together, a column at a time. The
buckets are then scattered back to where the features stand.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map
from ledgerline.session import materialize

#: Bytes of normalised text that are worked on at once; a longer text is worked on in pieces that share two words.
PIECE_BYTES = 1 << 20
#: Longer features are few and would need an array, and a column loop, of their own each.
LONGEST_ROW = 256

_CODES = np.arange(256, dtype=np.uint8)
#: Byte to byte: A-Z in lower case, what stands in no word (ASCII other than digits and letters) becomes a space.
_WORD = (_CODES >= 0x80) | ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x41) & (_CODES <= 0x5A)) | ((_CODES >= 0x61) & (_CODES <= 0x7A))
_NORMAL = np.where(_WORD, np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 32, _CODES), 0x20).astype(np.uint8).tobytes()


def crc_steps() -> np.ndarray:
    """What each byte value does to a CRC-32 (reflected polynomial 0xEDB88320)."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1).astype(np.uint32)
    return steps


_STEPS = crc_steps()


def crc32_rows(rows: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of every row of a two-dimensional uint8 array."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in range(rows.shape[1]):
        crc = _STEPS[(crc ^ rows[:, column]) & 0xFF] ^ (crc >> 8)
    return ~crc


def crc32_slices(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices text[start : start + length], those of equal length together."""
    out = np.empty(len(start), np.uint32)
    if not len(start):
        return out
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    for size, here in zip(sizes.tolist(), np.split(order, first[1:]), strict=True):
        if size <= LONGEST_ROW:
            out[here] = crc32_rows(np.lib.stride_tricks.sliding_window_view(text, size)[start[here]])
        else:
            out[here] = [zlib.crc32(text[s : s + size]) for s in start[here].tolist()]
    return out


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def piece_buckets(words: list[bytes], own: np.ndarray, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to `width` words that start at an own word and stay within a segment.

    `own` has a row (own words, words) for each segment; `words` holds the segments one after the other. Returns the
    buckets in order of segments (within a segment by number of words), and how many each segment has.
    """
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(lengths + 1) - 1  # words are joined by one space
    begin = end - lengths
    text = np.frombuffer(b" ".join(words), np.uint8)
    segment = np.repeat(np.arange(len(own)), own[:, 1])
    last = np.cumsum(own[:, 1])
    is_own = np.arange(n) < (last - own[:, 1] + own[:, 0])[segment]
    stop = last[segment]
    name, distinct = pd.factorize(np.array(words, dtype=object))
    name, kinds = name.astype(np.int64), len(distinct)
    found, where = [], []
    code = name
    for k in range(1, width + 1):
        if k > 1:  # a run is named by the run that is a word shorter, and its last word
            code = pd.factorize(code[:-1] * kinds + name[k - 1 :])[0] if n >= k else code[:0]
        at = np.flatnonzero(is_own[: len(code)] & (np.arange(len(code)) + k <= stop[: len(code)]))
        codes, places = pd.factorize(code[at])
        first = np.empty(len(places), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]  # where each distinct run stands first
        s = begin[at[first]]
        crc = crc32_slices(text, s, end[at[first] + k - 1] - s)
        found.append((crc % buckets).astype(np.uint32)[codes])
        where.append(segment[at])
    where, found = np.concatenate(where), np.concatenate(found)
    return found[np.argsort(where, kind="stable")], np.bincount(where, minlength=len(own))


def _segments(texts: list[str | None], width: int) -> Iterator[tuple[list[int], list[bytes], np.ndarray]]:
    """(document of each segment, words, own) of about PIECE_BYTES; a long text makes several segments."""
    docs, words, own, size = [], [], [], 0
    for doc, text in enumerate(texts):
        all_words = normal_words(text)
        cuts = [0]
        if len(text or "") > PIECE_BYTES:
            total = np.cumsum(np.fromiter(map(len, all_words), np.int64, len(all_words)) + 1)
            cuts += (np.flatnonzero(np.diff(total // PIECE_BYTES)) + 1).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(all_words)], strict=True):
            part = all_words[a : b + width - 1]
            if b > a:
                docs.append(doc)
                words += part
                own.append((b - a, len(part)))
                size += sum(map(len, part)) + len(part)
            if size >= PIECE_BYTES:
                yield docs, words, np.array(own, np.int64)
                docs, words, own, size = [], [], [], 0
    if docs:
        yield docs, words, np.array(own, np.int64)


def _bucket_rows(source, width: int, buckets: int) -> Iterator[dict]:
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    for batch in source:
        texts = batch["text"]
        for at in range(0, len(texts), 2000):
            some = texts[at : at + 2000]
            parts: list[list[bytes]] = [[] for _ in some]
            n_words = np.zeros(len(some), np.int64)
            for docs, words, own in _segments(some, width):
                found, sizes = piece_buckets(words, own, width, buckets)
                np.add.at(n_words, docs, own[:, 0])
                data, ends = found.astype(kind).tobytes(), (np.cumsum(sizes) * np.dtype(kind).itemsize).tolist()
                for doc, a, b in zip(docs, [0, *ends], ends, strict=False):
                    parts[doc].append(data[a:b])
            yield {"doc_id": batch["doc_id"][at : at + 2000], "n_words": n_words.tolist(), "buckets": list(map(b"".join, parts))}


def hashed_features(docs: DataFrame, id_column: str = "doc_id", width: int = 3, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words and the bucket of every feature (little-endian, 2 bytes up to 65,536 buckets, else 4) of each row."""
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text"))
    schema = "doc_id long, n_words long, buckets binary"
    return arrow_map(named, ["doc_id", "text"], schema, lambda source: _bucket_rows(source, width, buckets))


def _kind(buckets: int) -> tuple[str, int]:
    return ("<u2", 2) if buckets <= 1 << 16 else ("<u4", 4)


def _totals(source, buckets: int) -> Iterator[dict]:
    total = np.zeros(buckets, np.int64)
    kind, _ = _kind(buckets)
    for batch in source:
        for data in batch["buckets"]:
            total += np.bincount(np.frombuffer(data, kind), minlength=buckets)
    at = np.flatnonzero(total)
    yield {"bucket": at, "n": total[at]}


def bucket_counts(features: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of all features; a task sends at most a row for each bucket."""
    rows = arrow_map(features, ["buckets"], "bucket long, n long", lambda source: _totals(source, buckets))
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): by how much, in thousandths of a log, a bucket is likelier in the target; one added to each count."""
    all_buckets = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    joined = all_buckets
    for name, counts in (("s", source), ("t", target)):
        joined = joined.join(counts.withColumnRenamed("n", name), "bucket", "left").fillna(0, name)
    size = lambda c: F.lit(c.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).cast("double") + buckets
    ratio = (F.col("t") + 1.0) * size(source) / ((F.col("s") + 1.0) * size(target))
    return joined.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def _weights(source, gains, buckets: int) -> Iterator[dict]:
    kind, width = _kind(buckets)
    table = gains.value
    for batch in source:
        weights = [int(table[np.frombuffer(data, kind)].sum()) for data in batch["buckets"]]
        features = [len(data) // width for data in batch["buckets"]]
        yield {"doc_id": batch["doc_id"], "n_words": batch["n_words"], "n_features": features, "weight": weights}


def draw(scored: DataFrame, percent: int) -> DataFrame:
    """`scored` (doc_id, score, eligible, more) with `rank`: 1, 2, ... of the highest scores, null for the rest.

    Of the N eligible rows floor(percent * N / 100) are drawn, ties to the smaller doc_id. Eligible rows are dealt out by
    ranges of (score, doc_id), numbered within their range, and the rows of earlier ranges are added; nothing but a count
    for each range comes together.
    """
    spark = scored.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    # A repeated row may repeat a third of all: equal rows are interchangeable, so any tie-break may deal them out.
    dealt = scored.where("eligible").withColumn("__tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(parts, *order, "__tie").withColumn("__part", F.spark_partition_id())
    dealt = materialize(dealt, "dealt")
    sizes = sorted((r["__part"], r["n"]) for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect())  # a row a range
    drawn, above, rows = sum(n for _, n in sizes) * percent // 100, 0, []
    for part, n in sizes:
        rows.append((part, above))
        above += n
    before = F.broadcast(spark.createDataFrame(rows, "__part int, __above long"))
    within = Window.partitionBy("__part").orderBy(*order, "__tie")
    place = F.col("__above") + F.row_number().over(within)
    ranked = dealt.join(before, "__part").withColumn("rank", F.when(place <= drawn, place))
    rest = scored.where("NOT eligible").withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*scored.columns, "rank").unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, width: int = 3, buckets: int = 10_000
) -> DataFrame:
    """Every row of `docs` with n_features, weight, score and, if it is drawn, its rank.

    Words are runs of digits, letters a-z and characters beyond ASCII, A-Z in lower case; features are all runs of 1 to
    `width` words, repeats counted. The score is the weight with Gumbel noise that depends on the seed and the doc_id
    alone, so the highest scores are a draw without replacement in proportion to exp(weight / 1000).

    A null or blank text has no features and weight 0. Repeated rows count each time and get ranks of their own. A row
    without doc_id counts in the bucket totals, but has no score and is not drawn. An empty table gives an empty result,
    an empty `target` the smoothed gains. Only doc_id and text of `docs` and text of `target` are read; other columns of
    any name don't matter.

    Features are hashed once and stored, 2 bytes each. What is sent to every worker is a gain for each bucket.
    """
    spark = docs.sparkSession
    features = materialize(hashed_features(docs, "doc_id", width, buckets), "hashed-features")
    wanted = hashed_features(target.select("text", F.lit(0).alias("doc_id")), "doc_id", width, buckets)
    counts = [materialize(bucket_counts(f, buckets), "bucket-counts") for f in (features, wanted)]
    table = np.zeros(buckets, np.int64)
    for r in bucket_gains(*counts, buckets).collect():  # a row for each bucket
        table[r["bucket"]] = r["gain"]
    gains = spark.sparkContext.broadcast(table)
    weighed = arrow_map(
        features, ["doc_id", "n_words", "buckets"], "doc_id long, n_words long, n_features long, weight long",
        lambda source: _weights(source, gains, buckets),
    )
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weighed.withColumn("score", F.col("weight") + noise)
    scored = scored.withColumn("eligible", (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull())
    return draw(materialize(scored, "scored"), percent).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
