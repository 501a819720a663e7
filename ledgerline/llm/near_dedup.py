"""Near-duplicate documents by MinHash bands and odd sketches (operator 1).

1. A document's distinct word shingles become 64-bit hashes. MinHash samples of the set give band keys, and the samples
   folded into a bitmap by parity give an odd sketch: the bits in which two sketches differ tell how many samples
   differ, most precisely for similar sets.
2. Documents with one set are a class with one representative; only representatives go on.
3. Representatives with a common band key are candidates. Sketches say which of them may be similar enough.
4. Candidates connected by sketches form clusters, in which links are confirmed on the full sets.
5. Distributed union-find makes components of the confirmed links.

No bucket or cluster is compared pair by pair as a whole, and none is held whole by a task: large ones are cut into
pieces, bounded by members and bytes, that all contain one common member, the hub. Members that a piece leaves unconnected
with the hub are then cut into blocks, bounded like pieces, and each block is compared with each piece by a task of its own.
Two members that are both connected with the hub need no comparison, so no link is lost that would connect anything.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ledgerline.llm.common import arrow_map, ascending, keep_ids
from ledgerline.llm.components import components
from ledgerline.session import materialize

BANDS, ROWS = 32, 5  # at similarity 0.8 a pair has no band in common once in 300,000
SKETCH_BITS = 512
#: A pair passes the sketch test if it looks no less similar than the threshold less this. Estimates from 160 samples
#: have a standard error of 0.032 at 0.8.
MARGIN = 0.17
PIECE = 2048  # members of a bucket or cluster that one step compares
PIECE_BYTES = 16 << 20  # and the bytes of what they are compared by; one member may have more
STEP_BYTES = 1 << 15  # of small pieces that are compared in one step
SCHEMA = "doc_id long, n_shingles long, component_id long, kept boolean"

_SEEDS = np.random.default_rng(20).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POP = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint16)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of shingle hashes; a word's hash is computed once while it is in the cache."""

    def __init__(self, size: int, cache_entries: int = 150_000) -> None:
        self.size, self.cache, self.cache_entries = size, {}, cache_entries

    def _word(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self.cache) >= self.cache_entries:
                self.cache.clear()
            self.cache[word] = value
        return value

    def __call__(self, text: str | None) -> np.ndarray:
        """Ascending distinct uint64 hashes: of every `size` neighbouring words, or of all words if there are fewer."""
        words = (text or "").encode().lower().split()  # bytes: A-Z only, and white space is [\x20\x09-\x0D]
        found = list(map(self.cache.get, words))
        if None in found:
            found = [self._word(w) if v is None else v for v, w in zip(found, words, strict=True)]
        if not found:
            return np.zeros(0, np.uint64)
        h = np.array(found, np.uint64)
        size = min(self.size, len(h))
        n = len(h) - size + 1
        out = np.full(n, size, np.uint64)
        for i in range(size):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i])
        return ascending(out)


def signature(shingles: np.ndarray) -> tuple[list[int], bytes]:
    """Band keys and the odd sketch of a set that is not empty."""
    low = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):  # bounds the memory a long text takes, and stays in a core's cache
        part = shingles[at : at + 1024] * _SEEDS[:, None]
        low = np.minimum(low, (part ^ (part >> np.uint64(32))).min(1))
    keys = np.zeros(BANDS, np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        keys = _mix(keys + row)
    bits = (_mix(low + np.arange(len(low), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    parity = (np.bincount(bits, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return keys.view(np.int64).tolist(), np.packbits(parity).tobytes()


def _most_differing_bits(similarity: float) -> float:
    """Of sketches of two sets with that similarity: expected number of differing bits."""
    samples = BANDS * ROWS
    return SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * samples * (1 - similarity)))


def _read(source, size: int) -> Iterator[dict]:
    shingler = Shingler(size)
    for batch in source:
        out = {"doc_id": batch["doc_id"], "n_shingles": [], "set_hash": [], "bands": [], "sketch": []}
        for text in batch["text"]:
            shingles = shingler(text)
            bands, sketch = signature(shingles) if len(shingles) else ([], b"")
            out["n_shingles"].append(len(shingles))
            out["set_hash"].append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
            out["bands"].append(bands)
            out["sketch"].append(sketch)
        yield out


def _sets(source, size: int) -> Iterator[dict]:
    shingler = Shingler(size)
    for batch in source:
        for at in range(0, len(batch["doc_id"]), 500):
            yield {
                "doc_id": batch["doc_id"][at : at + 500],
                "data": [shingler(t).tobytes() for t in batch["text"][at : at + 500]],
            }


# --- comparing inside a piece: `alike(i)` says which members are similar to member i ----------------------------


def join_up(n: int, alike: Callable[[int], np.ndarray]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Component of each of n members, and links that connect them.

    Compares the first member with all, then every member that is outside the largest component. Two members of different
    components are not both in the largest, so every pair that matters is looked at.
    """
    component = np.arange(n)
    links: list[tuple[int, int]] = []
    done = np.zeros(n, bool)
    at = 0
    while True:
        done[at] = True
        mates = np.flatnonzero(alike(at) & (component != component[at]))
        for mate in mates:
            if component[mate] != component[at]:
                links.append((at, int(mate)))
                component[component == component[mate]] = component[at]
        counts = np.bincount(component, minlength=n)
        if counts.max() == n or done.sum() >= n - 1:  # the last one was compared with all others
            break
        open_ones = np.flatnonzero(~done & (component != counts.argmax()))
        if not len(open_ones):
            break
        at = int(open_ones[0])
    return component, links


def _alike_sketches(data: list[bytes], most: float) -> Callable[[int], np.ndarray]:
    sketches = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
    return lambda i: _POP[sketches ^ sketches[i]].sum(1) <= most


def _alike_sets(data: list[bytes], percent: int) -> Callable[[int], np.ndarray]:
    sizes = np.array([len(d) // 8 for d in data])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    known, where = np.unique(np.frombuffer(b"".join(data), np.uint64), return_inverse=True)
    mark = np.zeros(len(known), bool)

    def alike(i: int) -> np.ndarray:
        own = where[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        common = np.add.reduceat(mark[where], starts)
        mark[own] = False
        return 100 * common >= percent * (sizes + sizes[i] - common)

    return alike


_LINK = "a long, b long, bucket long, alone boolean"


def _pieces(rows: DataFrame, alike_of: Callable[[list[bytes]], Callable[[int], np.ndarray]]) -> DataFrame:
    """Links inside each (bucket, piece) of `rows` (doc_id, data, bucket, piece, hub).

    Also a row (a, a, bucket, alone) for each member of a piece that is not connected with the hub, if there are
    several pieces. Rows of a piece come one after another; one piece at a time is held, and small ones before it up to
    STEP_BYTES. If `alike_of` has `many`, that reads several pieces at once.
    """
    kind = _parse_datatype_string(_LINK)
    arrow = to_arrow_schema(kind)

    many = getattr(alike_of, "many", lambda groups: [alike_of(data) for data in groups])

    def solve(waiting: list[tuple]) -> Iterator[tuple]:
        for (ids, _, bucket, several), alike in zip(waiting, many([data for _, data, *_ in waiting]), strict=True):
            component, links = join_up(len(ids), alike)
            yield from ((ids[a], ids[b], bucket, False) for a, b in links)
            if several:
                yield from ((ids[k], ids[k], bucket, True) for k in np.flatnonzero(component != component[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, unique = None, {}
        waiting, size = [], 0

        def finish() -> None:
            nonlocal size
            if len(unique) > 1:
                bucket, _, hub, several = now
                ids = [hub, *(i for i in unique if i != hub)] if hub in unique else list(unique)
                waiting.append((ids, [unique[i] for i in ids], bucket, several))
                size += sum(map(len, unique.values()))

        def solved() -> pa.RecordBatch:
            nonlocal size
            out = list(solve(waiting)) if waiting else []
            waiting.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), arrow)], schema=arrow) if out else pa.RecordBatch.from_pylist([], arrow)

        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in ("doc_id", "data", "bucket", "piece", "hub", "several")}
            for doc_id, row, *group in zip(c["doc_id"], c["data"], c["bucket"], c["piece"], c["hub"], c["several"], strict=True):
                if group != now:
                    if now is not None:
                        finish()
                        if size >= STEP_BYTES:
                            yield solved()
                    now, unique = group, {}
                unique[doc_id] = row
        if now is not None:
            finish()
        yield solved()

    columns = ["doc_id", "data", "bucket", "piece", "hub", "several"]
    return (
        rows.select(*columns).repartition("bucket", "piece").sortWithinPartitions("bucket", "piece").mapInArrow(run, kind)
    )


def _linked(members: DataFrame, data: DataFrame, alike_of, name: str) -> DataFrame:
    """Links (a, b) that connect the members (bucket, doc_id, bytes) of each bucket as all its similar pairs would.

    `data` (doc_id, data) is what they are compared by, some `bytes` each; it is joined last, so that it moves once for
    each piece. Buckets of more than PIECE members or PIECE_BYTES are cut; see the module's text. In the second pass a
    task holds one block of the members left alone and one piece, however many are alone.
    """
    # Buckets with the same members, as similar ones share many bands, are one: their ids are told by two hashes.
    whole = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("total"), F.min("doc_id").alias("hub"),
        F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"),
    ).where("size > 1")
    sizes = materialize(
        whole.groupBy("size", "hub", "x", "y").agg(F.min("bucket").alias("bucket"), F.min("total").alias("total")), f"{name}-sizes"
    )
    parts = F.least("size", F.greatest(F.ceil(F.col("size") / PIECE), F.ceil(F.col("total") / PIECE_BYTES))).cast("int")
    rows = members.join(sizes.select("bucket", "hub", parts.alias("n_pieces")), "bucket").withColumn("several", F.col("n_pieces") > 1)
    own = F.pmod(F.xxhash64("doc_id"), F.col("n_pieces")).cast("int")
    every = F.sequence(F.lit(0), F.col("n_pieces") - 1)
    own_pieces = F.when(F.col("doc_id") == F.col("hub"), every).otherwise(F.array(own))
    cut = rows.withColumn("piece", F.explode(own_pieces))
    found = materialize(_pieces(cut.join(data, "doc_id"), alike_of), f"{name}-links")
    alone = found.where("alone").select("bucket", F.col("a").alias("doc_id")).distinct()
    if not alone.isEmpty():
        # Few, or the bucket is a mixture whose parts have to be compared: a stated set against all, block by piece.
        alone = materialize(alone.join(rows.where("several"), ["bucket", "doc_id"]), f"{name}-alone")
        blocks = alone.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("total"))
        blocks = materialize(blocks.select("bucket", parts.alias("n_blocks")), f"{name}-blocks")
        tile = [F.col("bucket"), F.col("doc_id"), F.col("hub"), F.lit(False).alias("several")]
        left = alone.join(blocks, "bucket").select(
            *tile, F.explode(every).alias("p"), F.pmod(F.xxhash64("doc_id", F.lit("block")), F.col("n_blocks")).cast("int").alias("block"), "n_blocks"
        )
        right = rows.where("several").join(blocks, "bucket").select(
            *tile, own_pieces.alias("own"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), "n_blocks"
        ).withColumn("p", F.explode("own")).drop("own")
        again = left.unionByName(right.select(left.columns)).withColumn("piece", F.col("p") * F.col("n_blocks") + F.col("block"))
        found = found.where("NOT alone").unionByName(_pieces(again.join(data, "doc_id"), alike_of))
    return found.where("NOT alone").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of `docs`: size of its shingle set, smallest doc_id of its component, whether it stays.

    Two documents are linked if 100 * common shingles >= percent * all shingles of both. Words are separated by ASCII
    white space, A-Z count as a-z; a text of fewer words than a shingle is one shingle; null and empty texts have no
    shingle and no link. Whole texts are read. A row without doc_id cannot be named: it is linked with nothing and
    stays. Rows with one doc_id are judged by their own texts.
    """
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], SCHEMA)
    read = materialize(
        arrow_map(
            docs, ["doc_id", "text"], "doc_id long, n_shingles int, set_hash binary, bands array<long>, sketch binary",
            lambda source: _read(source, shingle),
        ),
        "signatures",
    )
    named = read.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialize(named.groupBy("set_hash").agg(F.min("doc_id").alias("rep")), "classes")
    reps = named.join(classes.select("set_hash", F.col("rep").alias("doc_id")), ["set_hash", "doc_id"], "left_semi").dropDuplicates(["set_hash"])
    keys = reps.select("doc_id", F.posexplode("bands").alias("band", "key")).select(
        "doc_id", F.xxhash64("band", "key").alias("bucket")
    )
    # Most keys have one member; only the others carry sketches on.
    shared = materialize(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "buckets")
    members = keys.join(shared, "bucket", "left_semi").withColumn("bytes", F.lit(SKETCH_BITS // 8))
    sketches = reps.select("doc_id", F.col("sketch").alias("data"))
    most = _most_differing_bits(percent / 100 - MARGIN)
    candidates = _linked(members, sketches, lambda data: _alike_sketches(data, most), "bands")
    clusters = components(candidates)

    texts = keep_ids(docs.select("doc_id", "text"), clusters.select(F.col("node").alias("doc_id")), "doc_id")
    sets = arrow_map(texts, ["doc_id", "text"], "doc_id long, data binary", lambda source: _sets(source, shingle))
    clustered = clusters.select(F.col("node").alias("doc_id"), F.col("root").alias("bucket")).join(
        reps.select("doc_id", (F.col("n_shingles") * F.lit(8).cast("long")).alias("bytes")), "doc_id"
    )
    confirmed = _linked(clustered, materialize(sets, "sets"), lambda data: _alike_sets(data, percent), "sets")
    roots = components(confirmed)

    smallest = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_hash", F.coalesce("root", "rep").alias("component")
    )
    component = F.when(F.col("component").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
    return read.select("doc_id", "n_shingles", "set_hash").join(smallest, "set_hash", "left").select(
        "doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
