"""Alignment of two tokenizers' ids on the same texts (operator 12).

A is a byte-level BPE, B a SentencePiece BPE; both see a space and the text. After both have encoded a whole text, the
places where a token of A and a token of B that are marked by a leading space begin at the same byte are anchors: what is
before them ends together in both. Anchors cut a text into windows of ids, mostly a word each. A window is aligned once;
then its pair of id tuples gives the groups and links from a worker's memory.
"""

import hashlib
import json
import re
import struct
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import numpy as np
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map, file_of, held, identity
from ledgerline.llm.pieces import LONGEST_CACHED, SPACE, check, keys
from ledgerline.session import materialize

#: Fixed value: how a byte-level pre-tokenizer cuts texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, width int, links binary"
#: Windows of more bytes of ids are aligned each time, so that the memory's bytes are bounded by its entries.
LONGEST_WINDOW = 96
#: Characters that are aligned together.
PIECE_CHARS = 1 << 19
#: The table of id pairs is sent to every worker if it has at most so many bytes (17 a pair).
BROADCAST_BYTES = 64 << 20
#: Characters whose class (letter, digit, other) no version of Unicode has changed; in them words may be cut by another library.
_SETTLED = re.compile("[\n!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")
_LOST = (b"", b"")


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Memory:
    """Two generations of remembered values; the older one is dropped when the newer one is full."""

    def __init__(self, entries: int, keeps: Callable[[Any], bool]) -> None:
        self.entries, self.keeps = entries, keeps
        self.new: dict = {}
        self.old: dict = {}

    def many(self, asked: list, make: Callable[[list], Iterable]) -> list:
        """Values of all keys; `make` gives those that are not remembered."""
        found = list(map(self.new.get, asked))
        if None not in found:
            return found
        made = {k: self.old.get(k) for k, x in zip(asked, found, strict=True) if x is None}
        fresh = [k for k, x in made.items() if x is None]
        made |= zip(fresh, make(fresh), strict=True)
        for k, x in made.items():
            if self.keeps(k):
                if len(self.new) >= self.entries:
                    self.old, self.new = self.new, {}
                self.new[k] = x
        return [made[k] if x is None else x for k, x in zip(asked, found, strict=True)]


class Sides:
    """Both encoders, and the memories of encoded pre-tokens and aligned windows."""

    def __init__(self, a: bytes, b: bytes, entries: int) -> None:
        self.a = tokenizers.Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        check(self.b)
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, token))
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_length, self.b_length = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_first, self.b_first = (np.array([x[:1] in (b" ", b"\n") for x in y]) for y in (self.a_bytes, self.b_bytes))
        self.a_marked, self.b_marked = (np.array([x[:1] == b" " for x in y]) for y in (self.a_bytes, self.b_bytes))
        self.kind = "<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 0xFF00 else "<u4"
        self.width = np.dtype(self.kind).itemsize
        self.border = b"\xff" * self.width  # between the id tuples of a window; no id has a last byte like it
        decimal = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.digits = np.fromiter(map(len, decimal), np.int64, len(decimal))
        self.decimal = np.array(decimal).view(np.uint8).reshape(len(decimal), -1)
        self.words = Memory(entries, lambda key: len(key) <= LONGEST_CACHED)
        self.windows = Memory(entries, lambda window: len(window) <= LONGEST_WINDOW)
        self.fast = self._faster(json.loads(a), letters)
        some = "two words,\nand more\nhere's 12 _x <|endoftext|> ß 3.4"
        self.cuts = self._a_ids(" " + some) == [i for k in keys(some) for i in self._a_ids(k if k[:1] == "\n" else " " + k)]

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        return self.b.id_to_piece(i).replace(SPACE, " ").encode()

    def _faster(self, spec: dict, letters: dict[str, int]) -> tiktoken.Encoding | None:
        """A's vocabulary in a library that joins whatever two neighbours make a token, the token with the smallest id first.

        That is the same as A's list of joins if the list makes tokens in the order of their ids, each once, and A encodes
        every token's own text as that token: then what is left of that text before its last join are the two listed parts.
        Both need the usual pattern of pre-tokens. None if any of this does not hold.
        """
        joins = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [self.a.token_to_id("".join(m)) for m in joins]
        single = sorted(t for t in spec["model"]["vocab"] if len(t) == 1)
        if (
            spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            or spec["normalizer"] is not None or made != sorted(set(made)) or single != sorted(letters)
            or any([x.id for x in self.a.model.tokenize(self.a.id_to_token(i))] != [i] for i in made)
        ):
            return None
        ranks = {self.a_bytes[i]: i for i in [*made, *map(self.a.token_to_id, single)]}
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _a_ids(self, text: str) -> list[int]:
        return self.a.encode(text, add_special_tokens=False).ids

    def _checked(self, a: list[int], b: list[int], text: str) -> tuple[bytes, bytes]:
        """Both sides' ids, none if the bytes of a side are not those of the text."""
        data = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return _LOST
        form = "H" if self.width == 2 else "I"
        return struct.pack(f"<{len(a)}{form}", *a), struct.pack(f"<{len(b)}{form}", *b)

    def _encoded(self, some: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Both sides' ids of pre-tokens, many at a time: a token that begins with a space or line feed begins a pre-token."""
        quick = [k for k in some if self.fast is not None and _SETTLED.fullmatch(k)]
        rest = list(dict.fromkeys(some).keys() - set(quick))
        made = dict(zip(quick, self._encoded_alike(quick, True), strict=True))
        made |= zip(rest, self._encoded_alike(rest, False), strict=True)
        yield from map(made.__getitem__, some)

    def _encoded_alike(self, some: list[str], quick: bool) -> Iterator[tuple[bytes, bytes]]:
        for at in range(0, len(some), 2000):
            part = some[at : at + 2000]
            text = "".join([k if k[:1] == "\n" else " " + k for k in ["x", *part]])  # the library's own space is that before x
            found = self.fast.encode_ordinary(text) if quick else self._a_ids(text)
            a, b = np.array(found, self.kind), np.array(self.b.encode(text[1:]), self.kind)
            a_at, b_at = np.flatnonzero(self.a_first[a]), np.flatnonzero(self.b_first[b])
            if len(a_at) == len(b_at) == len(part) + 1 and self._checked(a.tolist(), b.tolist(), text) is not _LOST:
                sides = []
                for ids, first in ((a.tobytes(), a_at), (b.tobytes(), b_at)):
                    cut = [*(first[1:] * self.width).tolist(), len(ids)]
                    sides.append([ids[i:j] for i, j in zip(cut, cut[1:])])
                yield from zip(*sides, strict=True)
            else:
                yield from map(self._encoded_alone, part)

    def _encoded_alone(self, key: str) -> tuple[bytes, bytes]:
        if key[:1] == "\n":  # the library puts a space in front, which is an id of its own
            return self._checked(self._a_ids(key), self.b.encode(key)[1:], key)
        return self._checked(self._a_ids(" " + key), self.b.encode(key), " " + key)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Both sides' ids of each text; none if there is no text or a side does not keep its bytes."""
        found: list[list[str]] = []
        out = [_LOST] * len(texts)
        cut = []
        for i, text in enumerate(texts):
            if not text or SPACE in text:
                continue
            # With other white space, or two white spaces together, a text is encoded by the libraries as a whole.
            if not self.cuts or " ".join(text.split()) != text.replace("\n", " "):
                out[i] = self._checked(self._a_ids(" " + text), self.b.encode(text), " " + text)
            else:
                cut.append(i)
                found.append(keys(text))
        ids = self.words.many([k for some in found for k in some], self._encoded)
        lost = _LOST in ids
        start = 0
        for i, some in zip(cut, found, strict=True):
            own = ids[start : start + len(some)]
            start += len(some)
            if not lost or _LOST not in own:
                out[i] = b"".join([a for a, _ in own]), b"".join([b for _, b in own])
        return out

    def _digest_text(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> tuple[str, np.ndarray]:
        """Decimal ids, a comma behind each; behind a group's last id of A `|`, of B `;`. And where each group begins.

        `sides` has (ids, mark of the last id of each group) of A and B.
        """
        sizes = [self.digits[ids] + 1 for ids, _ in sides]
        ends = [np.cumsum(size) for size in sizes]
        upto = [np.concatenate([[0], end[last]]) for end, (_, last) in zip(ends, sides)]
        start = upto[0] + upto[1]
        out = np.empty(start[-1], np.uint8)
        for (ids, last), size, end, before, mark in zip(sides, sizes, ends, (upto[1][:-1], upto[0][1:]), "|;"):
            group = np.cumsum(last) - last
            at = end - size + before[group]
            for d in range(self.decimal.shape[1]):
                long = size - 1 > d
                out[at[long] + d] = self.decimal[ids[long], d]
            out[at + size - 1] = np.where(last, ord(mark), ord(","))
        return out.tobytes().decode("ascii"), start

    def _aligned(self, some: list[bytes]) -> Iterator[tuple[str, bytes]]:
        """Of each window its groups as text, and its links: the ids of A and B that end each group. All at once: windows
        end together on both sides, so laid end to end they keep their shared ends."""
        if not some:
            return
        halves = [w.split(self.border) for w in some]
        a, b = (np.frombuffer(b"".join([h[i] for h in halves]), self.kind) for i in (0, 1))
        a_end, b_end = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        is_end = np.zeros(a_end[-1] + 1, np.int8)
        is_end[a_end] += 1
        is_end[b_end] += 1
        a_last, b_last = is_end[a_end] == 2, is_end[b_end] == 2
        links = np.empty((np.count_nonzero(a_last), 2), self.kind)
        links[:, 0], links[:, 1] = a[a_last], b[b_last]
        text, start = self._digest_text([(a, a_last), (b, b_last)])
        window_end = np.cumsum(np.fromiter((len(h[1]) // self.width for h in halves), np.int64, len(some))) - 1
        groups = np.concatenate([[0], np.cumsum(b_last)[window_end]])
        cut, data, groups = start[groups].tolist(), links.tobytes(), (groups * 2 * self.width).tolist()
        for i, j, m, n in zip(cut, cut[1:], groups, groups[1:]):
            yield text[i : j - 1], data[m:n]

    def align(self, coded: list[tuple[bytes, bytes]]) -> list[tuple[str, bytes]]:
        """(groups, links) of each text."""
        a_all, b_all = b"".join([a for a, _ in coded]), b"".join([b for _, b in coded])
        if not a_all:
            return [("", b"")] * len(coded)
        a, b = np.frombuffer(a_all, self.kind), np.frombuffer(b_all, self.kind)
        a_length, b_length = self.a_length[a], self.b_length[b]
        a_end, b_end = np.cumsum(a_length), np.cumsum(b_length)
        a_at, b_at = np.flatnonzero(self.a_marked[a]), np.flatnonzero(self.b_marked[b])
        # Where marked tokens begin, as places in the ids of A by byte; each text begins with a space, so with an anchor.
        place = np.full(a_end[-1], -1, np.int64)
        place[(a_end - a_length)[a_at]] = a_at
        met = place[(b_end - b_length)[b_at]]
        a_cut, b_cut = met[met >= 0], b_at[met >= 0]
        first = np.searchsorted(a_cut, np.cumsum([0, *(len(x) // self.width for x, _ in coded)])).tolist()
        a_cut, b_cut = ([*(x * self.width).tolist(), len(y)] for x, y in ((a_cut, a_all), (b_cut, b_all)))
        border = self.border
        windows = [a_all[i:j] + border + b_all[m:n] for i, j, m, n in zip(a_cut, a_cut[1:], b_cut, b_cut[1:])]
        found = self.windows.many(windows, self._aligned)
        return [
            (";".join([x[0] for x in found[i:j]]), b"".join([x[1] for x in found[i:j]])) for i, j in zip(first, first[1:])
        ]


def _aligned(source, a, b, entries: int, key: Hashable) -> Iterator[dict]:
    sides = held(key, lambda: Sides(a.value, b.value, entries))
    for batch in source:
        for some in _pieces(batch["text"], PIECE_CHARS):
            coded = sides.encode(batch["text"][some])
            found = sides.align(coded)
            yield {
                "doc_id": batch["doc_id"][some],
                "n_a": [len(x) // sides.width for x, _ in coded], "n_b": [len(x) // sides.width for _, x in coded],
                "n_groups": [len(x) // (2 * sides.width) for _, x in found],
                "groups_sha256": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g, _ in found],
                "width": [sides.width] * len(coded), "links": [x for _, x in found],
            }


def _pieces(texts: list[str | None], size: int) -> Iterator[slice]:
    """Slices of rows with about `size` characters."""
    start, total = 0, 0
    for i, t in enumerate(texts, 1):
        total += len(t or "")
        if total >= size or i == len(texts):
            yield slice(start, i)
            start, total = i, 0


def aligned_documents(docs: DataFrame, a_path: str, b_path: str, entries: int = 150_000) -> DataFrame:
    """Of each row its ids' numbers, groups and links (id of A, id of B, each little-endian of `width` bytes: 2 if all ids fit)."""
    a, b = (docs.sparkSession.sparkContext.broadcast(file_of(p)) for p in (a_path, b_path))
    key = identity(f"alignment {entries}", a.value, b.value)
    return arrow_map(docs, ["doc_id", "text"], SCHEMA, lambda source: _aligned(source, a, b, entries, key), key)


def _codes(links: bytes, width: int) -> np.ndarray:
    pairs = np.frombuffer(links, f"<u{width}").astype(np.int64).reshape(-1, 2)
    return pairs[:, 1] << 32 | pairs[:, 0]


def _pair_counts(source, most: int = 1_000_000) -> Iterator[dict]:
    """(code, n) with codes b << 32 | a; sums are sent on when `most` codes are held."""
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merged(new: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        fresh, n = np.unique(np.concatenate(new), return_counts=True)
        both, where = np.unique(np.concatenate([codes, fresh]), return_inverse=True)
        return both, np.bincount(where, np.concatenate([counts, n]), len(both)).astype(np.int64)

    waiting, size = [], 0
    for batch in source:
        for links, width in zip(batch["links"], batch["width"], strict=True):
            waiting.append(_codes(links, width))
            size += len(waiting[-1])
            if size >= most:
                codes, counts = merged(waiting)
                waiting, size = [], 0
                if len(codes) >= most:
                    yield {"code": codes, "n": counts}
                    codes, counts = codes[:0], counts[:0]
    if waiting:
        codes, counts = merged(waiting)
    yield {"code": codes, "n": counts}


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(code, n, best): how many links hold a pair of ids, and whether no other A id has more links with its B id."""
    n = arrow_map(aligned, ["links", "width"], "code long, n long", _pair_counts).groupBy("code").agg(F.sum("n").alias("n"))
    n = materialize(n, "pair-counts").withColumn("b", F.shiftright("code", 32))
    most = n.groupBy("b").agg(F.max("n").alias("most"))
    return n.join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def _sums(source, table) -> Iterator[dict]:
    codes, counts, best = table.value
    for batch in source:
        width = max(batch["width"])  # the same in all rows
        sizes = [len(x) // (2 * width) for x in batch["links"]]
        at = np.searchsorted(codes, _codes(b"".join(batch["links"]), width))
        ends = np.cumsum([0, *sizes])
        sums = [np.concatenate([[0], np.cumsum(x[at])]) for x in (best, counts)]
        n_best, count_sum = ((s[ends[1:]] - s[ends[:-1]]).tolist() for s in sums)
        yield {k: v for k, v in batch.items() if k not in ("links", "width")} | {"n_links": sizes, "n_best": n_best, "count_sum": count_sum}


def _exploded(source) -> Iterator[dict]:
    """(row, code, times) of the distinct links of each row."""
    for batch in source:
        for row, links, width in zip(batch["row"], batch["links"], batch["width"], strict=True):
            codes, times = np.unique(_codes(links, width), return_counts=True)
            yield {"row": np.full(len(codes), row), "code": codes, "times": times}


def align(docs: DataFrame, a_path: str, b_path: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of `docs`: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the tokenizers file `a_path`, B the sentencepiece model `b_path`; neither adds special tokens, and their strings
    inside a text are plain text. Byte offsets where both sides' tokens end cut the ids into groups; the two tokens that
    end a group are linked. Counts of linked id pairs are over all rows.

    A text that is null, empty, or not kept byte for byte by both sides has no tokens: zeros and an empty digest. Texts of
    any length are encoded whole; a repeated row counts each time; a null doc_id is returned like any other. An empty table
    gives an empty result. Only doc_id and text are read.

    Texts are encoded once and stay where they are; their links are stored, 4 bytes each before
    compression (8 if a vocabulary has more than 65,280 ids), which also halves the batches that reach a worker. A task sums
    pairs before they are shuffled. The table of pairs is bounded by the vocabularies, but that bound is large, so its
    size is counted: up to `broadcast_bytes` every worker gets it, beyond it is joined by a shuffle of distinct links.
    """
    spark = docs.sparkSession
    aligned = materialize(aligned_documents(docs, a_path, b_path), "aligned")
    counts = materialize(pair_counts(aligned), "pairs")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    out = [*columns[:4], "n_links", "n_best", "count_sum", "groups_sha256"]
    if counts.count() * 17 <= broadcast_bytes:
        found = counts.orderBy("code").toArrow()
        codes, n, best = (found.column(c).to_numpy() for c in ("code", "n", "best"))
        table = spark.sparkContext.broadcast((codes, n, best.astype(np.int8)))
        schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long"
        return arrow_map(aligned, [*columns, "links", "width"], schema, lambda source: _sums(source, table)).select(out)
    rows = materialize(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned-rows")
    links = arrow_map(rows, ["row", "links", "width"], "row long, code long, times long", _exploded)
    sums = links.join(counts, "code").groupBy("row").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    return rows.join(sums, "row", "left").fillna(0, ["n_links", "n_best", "count_sum"]).select(out)
