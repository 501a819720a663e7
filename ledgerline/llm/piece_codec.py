"""SentencePiece encoding and decoding of whole texts (operator 9)."""

import hashlib
import struct
from collections.abc import Hashable, Iterator

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from ledgerline.llm.common import arrow_map, file_of, held, identity
from ledgerline.llm.pieces import LONGEST_CACHED, keys
from ledgerline.llm.prefix_table import PrefixTable

SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Texts to ids and back; each pre-token is encoded once while it is in the worker's cache."""

    def __init__(self, model: bytes, cache_entries: int) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table = PrefixTable(self.library)
        self.kind = "<u2" if self.library.get_piece_size() <= 1 << 16 else "<u4"
        self.decimal = list(map(str, range(self.library.get_piece_size())))
        self.end = self._packed([self.library.eos_id()])
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the cache before; what is asked for again moves to the new one
        self.cache_entries = cache_entries

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.kind == '<u2' else 'I'}", *ids)

    def _missed(self, key: str) -> bytes:
        ids = self.old.get(key) or self._packed(self.table.encode_key(key))
        if len(key) <= LONGEST_CACHED:
            if len(self.cache) >= self.cache_entries:
                self.old, self.cache = self.cache, {}
            self.cache[key] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids, the end id last."""
        get, missed = self.cache.get, self._missed
        found = keys(text or "")
        ids = list(map(get, found))
        if None in ids:
            ids = [i or missed(k) for i, k in zip(ids, found, strict=True)]
        return np.frombuffer(b"".join([*ids, self.end]), self.kind).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def _batches(source, model, cache_entries: int, digest: bool, key: Hashable) -> Iterator[dict]:
    codec = held(key, lambda: Codec(model.value, cache_entries))
    for batch in source:
        out: dict[str, list] = {"doc_id": batch["doc_id"], "n_tokens": []}
        out |= {"ids_sha256": [], "decoded_sha256": []} if digest else {"ids": [], "decoded": []}
        for text in batch["text"]:
            ids = codec.encode(text)
            decoded = codec.decode(ids)
            out["n_tokens"].append(len(ids))
            if digest:
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            else:
                out["ids"].append(ids)
                out["decoded"].append(decoded)
        yield out


def encode_decode(docs: DataFrame, model_path: str, cache_entries: int = 120_000, digest: bool = False) -> DataFrame:
    """Ids (end id last, no begin id) and decoded text of every row, or their digests.

    One row for each row of `docs`, repeated rows and null `doc_id` included; a null or empty text has the end
    id alone and decodes to an empty text. Texts of any length are encoded whole. No shuffle: a task reads its
    rows and returns theirs.
    """
    model = docs.sparkSession.sparkContext.broadcast(file_of(model_path))
    key = identity(f"codec {cache_entries}", model.value)
    return arrow_map(
        docs, ["doc_id", "text"], DIGEST if digest else SCHEMA,
        lambda source: _batches(source, model, cache_entries, digest, key), key,
    )
