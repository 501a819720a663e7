"""Token ids in entropy-coded binary files, and back (operator 6).

A file is `IDS1`, then blocks one after another. A block is: its number of documents and the length of each part (u32),
a zlib-compressed table of doc_id and length for each document, a rANS block of the ids (module rans), and the table's CRC-32.
Documents are in ascending doc_id order, within a file and from file to file by name. A manifest table tells where each
block is, so blocks are read back in parallel, and checkpoints allow parts of a block. All blocks share one frequency
table, kept as a Parquet table beside them.
"""

import re
import struct
import zlib
from collections.abc import Hashable, Iterator
from functools import lru_cache

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map, file_of, held, identity
from ledgerline.llm.rans import Coder, frequencies
from ledgerline.session import materialize, shared_dir

MAGIC = b"IDS1"
LONGEST_CACHED = 64
#: Where cutting off signs is not safe: signs in a row are one pre-token, an apostrophe begins one with the letters behind
#: it, `_` is a sign to the model, and control characters and letters beyond Latin (and İ) may turn into signs.
# Searched one by one, which is faster than as alternatives: each begins with one class of characters.
_SIGNS = (re.compile(r"['_]"), re.compile(r"[^\t\n -~¡-\u012F\u0131-\u024F]"), re.compile(r"[^\w\s][^\w\s]"))
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-\u012F\u0131-\u024F]+")
#: Letters with signs of ASCII behind them, apostrophe and `_` excepted: two pre-tokens.
_ENDED = re.compile(r"([A-Za-zÀ-ÖØ-öø-\u012F\u0131-\u024F]+)([!-&(-/:-@\[-^`{-~]+)")


def _byte_letters() -> list[str]:
    """A printable character for each byte, as byte-level models write them: its own one, or the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()
MANIFEST = "path string, position long, size long, shard int, first long, n_ids long"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Tokenizer:
    """Ids of texts by the tokenizers library, one word at a time while words are in the cache.

    Words are cut at spaces and line feeds. `check` proves that the model drops white space before it merges, so
    that no id and no normalisation crosses them.
    """

    def __init__(self, model: bytes, cache_entries: int) -> None:
        import tokenizers

        self.library = tokenizers.Tokenizer.from_buffer(model)
        for text in ("a b", "a\nb", "a \n b"):
            if self._ids(text) != self._ids("a") + self._ids("b"):
                raise ValueError("this tokenizer keeps white space; its texts can't be cut")
        some = ("word", "É1", "Az")
        self.splits_signs = all(self._ids(w + s) == self._ids(w.lower()) + self._ids(s) for w in some for s in ".,")
        self.splits_ends = all(self._ids(w + s) == self._ids(w) + self._ids(s) for w in some for s in ("$$$", "!!", ".%%%", '"', "<|", "^`-"))
        self.is_plain = all(self._plain(w) == self._ids(w) for w in ("word", "Éclair", "WORDS", "größe", "thaninbleß"))
        self.cache: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}  # the cache before; what is asked for again moves to the new one
        self.cache_entries = cache_entries

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _plain(self, word: str) -> list[int]:
        """Ids of a word of Latin letters: one pre-token, which goes to the library's model directly."""
        letters = word.lower()
        if not letters.isascii():  # an ASCII letter is written as itself
            letters = "".join(map(_BYTE_LETTERS.__getitem__, letters.encode()))
        return [t.id for t in self.library.model.tokenize(letters)]

    def _missed(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if self.splits_ends and (parts := _ENDED.fullmatch(word)):
                ids = b"".join([self.cache.get(x) or self._missed(x) for x in parts.groups()])
            else:
                found = self._plain(word) if self.is_plain and _PLAIN.fullmatch(word) else self._ids(word)
                ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= LONGEST_CACHED:
            if len(self.cache) >= self.cache_entries:
                self.old, self.cache = self.cache, {"": b""}
            self.cache[word] = ids
        return ids

    def words(self, text: str) -> list[str]:
        """Words that can be encoded one by one; a comma or full stop is cut off where it is a pre-token of its own."""
        if self.splits_signs and not any(x.search(text) for x in _SIGNS):
            if text.isascii():
                text = text.lower()  # as the model does; other letters are left to it
            text = text.replace(",", " ,").replace(".", " .")
        return text.replace("\n", " ").split(" ")

    def encode(self, text: str | None) -> bytes:
        """Little-endian u32 ids."""
        words = self.words(text or "")
        ids = list(map(self.cache.get, words))
        if None in ids:
            ids = [self._missed(w) if i is None else i for i, w in zip(ids, words, strict=True)]
        return b"".join(ids)


def _blocks(source, model, end_id: int, block_ids: int, cache_entries: int, key: Hashable) -> Iterator[dict]:
    """Runs of whole documents with at least `block_ids` ids, the last run excepted."""
    tokenizer = held(key, lambda: Tokenizer(model.value, cache_entries))
    end = np.array([end_id], "<u4").tobytes()
    docs, lengths, ids, size, first, shard = [], [], [], 0, 0, 0

    def block() -> dict:
        wide = np.frombuffer(b"".join(ids), "<u4")
        narrow = wide.astype("<u2") if not len(wide) or wide.max() < 1 << 16 else wide
        return {
            "shard": [shard], "first": [first], "n_ids": [size], "width": [narrow.itemsize],
            "docs": [np.array(docs, "<i8").tobytes()], "lengths": [np.array(lengths, "<u4").tobytes()], "ids": [narrow.tobytes()],
        }

    for batch in source:
        for doc_id, text, shard in zip(batch["doc_id"], batch["text"], batch["shard"], strict=True):
            coded = tokenizer.encode(text) + end
            docs.append(doc_id)
            lengths.append(len(coded) // 4)
            ids.append(coded)
            size += lengths[-1]
            if size >= block_ids:
                yield block()
                docs, lengths, ids, size, first = [], [], [], 0, first + size
    if docs:
        yield block()


def _counts(source) -> Iterator[dict]:
    total = np.zeros(0, np.int64)
    for batch in source:
        for data, width in zip(batch["ids"], batch["width"], strict=True):
            some = np.bincount(np.frombuffer(data, f"<u{width}"))
            if len(some) > len(total):
                some, total = total, some
            total = total.copy()
            total[: len(some)] += some
    used = np.flatnonzero(total)
    yield {"id": used.tolist(), "n": total[used].tolist()}


def _write(source, folder: str, freq) -> Iterator[dict]:
    """One file for each run of blocks of a shard; a file is complete before its name is in the manifest."""
    import uuid

    coder = Coder(np.frombuffer(freq.value, "<u4"))
    files, root = _opened(folder)
    out, shard, path, position = None, None, "", 0
    for batch in source:
        rows = []
        for i, (s, first) in enumerate(zip(batch["shard"], batch["first"], strict=True)):
            if s != shard:
                if out:
                    out.close()
                # An attempt that is lost leaves a file that no manifest names.
                name = f"ids-{s:07d}-{first:015d}-{uuid.uuid4().hex[:8]}.bin"
                shard, path, position = s, f"{folder}/{name}", len(MAGIC)
                out = files.open_output_stream(f"{root}/{name}")
                out.write(MAGIC)
            table = zlib.compress(batch["docs"][i] + batch["lengths"][i])
            coded = coder.encode(np.frombuffer(batch["ids"][i], f"<u{batch['width'][i]}").astype(np.int64))
            data = np.array([len(batch["docs"][i]) // 8, len(table), len(coded)], "<u4").tobytes() + table + coded
            data += zlib.crc32(table).to_bytes(4, "little")
            out.write(data)
            rows.append((path, position, len(data), s, first, batch["n_ids"][i]))
            position += len(data)
        if rows:
            yield dict(zip(("path", "position", "size", "shard", "first", "n_ids"), map(list, zip(*rows, strict=True)), strict=True))
    if out:
        out.close()


def parse_block(data: bytes, coder: Coder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, lengths and ids of a block; a damaged block is an error."""
    n, table_size, ids_size = (int(v) for v in np.frombuffer(data, "<u4", 3))
    table = data[12 : 12 + table_size]
    if zlib.crc32(table) != int.from_bytes(data[-4:], "little"):
        raise ValueError("damaged table of documents: its checksum does not fit")
    table = zlib.decompress(table)
    return (
        np.frombuffer(table, "<i8", n), np.frombuffer(table, "<u4", n, 8 * n),
        coder.decode(data[12 + table_size : 12 + table_size + ids_size]),
    )


@lru_cache(2)
def _coder(freq: bytes) -> Coder:
    return Coder(np.frombuffer(freq, "<u4"))


def _read(source, freq) -> Iterator[dict]:
    coder = _coder(freq.value)
    for batch in source:
        for path, position, size, shard, first in zip(*(batch[c] for c in ("path", "position", "size", "shard", "first")), strict=True):
            files, place = _opened(path)
            with files.open_input_file(place) as f:
                f.seek(position)
                docs, lengths, ids = parse_block(f.read(size), coder)
            ends = np.cumsum(lengths, dtype=np.int64)
            raw = ids.astype("<u4").tobytes()
            starts = ends - lengths
            yield {
                "doc_id": docs.tolist(), "shard": [shard] * len(docs), "before": (starts + first).tolist(), "n_tokens": lengths.tolist(),
                "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)],
            }


def write_ids(
    docs: DataFrame, model_path: str, folder: str, end_id: int = 2, vocabulary: int | None = None,
    block_ids: int = 1 << 18, cache_entries: int = 600_000,
) -> DataFrame:
    """Encode every text, write the files to `folder`, which all executors share, and return their manifest.

    Rows of `docs` (doc_id, text) are put in doc_id order; of equal doc_ids, all are written. Rows without doc_id are
    not documents of a file and are left out. A null or empty text has the end id alone. A block holds whole
    documents, so its size is bounded by `block_ids` and the longest text.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(file_of(model_path))
    ordered = (
        docs.select("doc_id", "text").where("doc_id IS NOT NULL").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        .withColumn("shard", F.spark_partition_id())
    )
    key = identity(f"id files {cache_entries}", model.value)
    blocks = materialize(
        arrow_map(
            ordered, ["doc_id", "text", "shard"],
            "shard int, first long, n_ids long, width int, docs binary, lengths binary, ids binary",
            lambda source: _blocks(source, model, end_id, block_ids, cache_entries, key), key,
        ),
        "blocks",
    )
    counted = (
        arrow_map(blocks, ["ids", "width"], "id long, n long", _counts).groupBy("id").agg(F.sum("n").alias("n")).collect()
    )  # at most a row for each id of the vocabulary
    counts = np.zeros(vocabulary or max([end_id + 1, *(r["id"] + 1 for r in counted)]), np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    freq = frequencies(counts)
    spark.createDataFrame([(freq.astype("<u4").tobytes(),)], "frequencies binary").coalesce(1).write.parquet(f"{folder}/frequencies")
    shared = spark.sparkContext.broadcast(freq.astype("<u4").tobytes())
    files, root = _opened(folder)
    files.create_dir(f"{root}/files", recursive=True)
    manifest = arrow_map(
        blocks, ["shard", "first", "n_ids", "width", "docs", "lengths", "ids"], MANIFEST,
        lambda source: _write(source, f"{folder}/files", shared),
    )
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document in the files of `folder`: ids of all documents before it, its number of ids, their CRC-32."""
    freq = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{folder}/frequencies").first()[0]))
    manifest = spark.read.parquet(f"{folder}/manifest")
    # One row for each shard, a partition of the writing job; only these few numbers are summed up in one task.
    shards = manifest.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base")
    )
    spread = manifest.select("path", "position", "size", "shard", "first").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "position")
    rows = arrow_map(
        spread, ["path", "position", "size", "shard", "first"],
        "doc_id long, shard int, before long, n_tokens long, ids_crc32 long", lambda source: _read(source, freq),
    )
    return rows.join(F.broadcast(shards), "shard").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, model_path: str, name: str = "ids", **options) -> DataFrame:
    """write_ids to a new folder in the shared one, then read_ids from it."""
    import uuid

    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    write_ids(docs, model_path, folder, **options)
    return read_ids(spark, folder)
