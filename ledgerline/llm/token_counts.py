"""Token counts of whole texts by a two-tier map-side lookup (operator 2)."""

from collections import Counter
from collections.abc import Hashable, Iterator

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map, file_of, held, identity
from ledgerline.llm.pieces import LONGEST_CACHED, check, keys, library_lengths
from ledgerline.session import materialize

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def trimmed(counts: Counter, entries: int) -> Counter:
    """A Misra-Gries summary: at most `entries` keys, each count too low by at most the one that is taken off."""
    if len(counts) <= entries:
        return counts
    off = counts.most_common(entries + 1)[-1][1]
    return Counter({k: n - off for k, n in counts.items() if n > off})


def _summaries(source, entries: int) -> Iterator[dict]:
    counts: Counter = Counter()
    seen = 0
    for batch in source:
        for text in batch["text"]:
            found = keys(text or "")
            counts.update(found)
            seen += len(found)
            if len(counts) > 8 * entries:
                counts = trimmed(counts, entries)
    top = [(k, n) for k, n in trimmed(counts, entries).items() if len(k) <= LONGEST_CACHED]
    yield {"key": [None, *(k for k, _ in top)], "n": [0, *(n for _, n in top)], "seen": [seen, *[0] * len(top)]}


def frequent_lengths(docs: DataFrame, model_path: str, entries: int) -> tuple[list[str], bytes]:
    """The pre-tokens that make at least one in `entries` of all texts' pre-tokens and, a byte each, their numbers of ids.

    There are at most `entries` of them. A task sends a summary of at most that many keys, whatever it reads; the pre-tokens
    themselves stay where they are. A summary's counts may be a little low, which costs time later and never changes a result.
    """
    summaries = materialize(
        arrow_map(docs, ["text"], "key string, n long, seen long", lambda source: _summaries(source, entries)), "summaries"
    )
    seen = summaries.where("key IS NULL").agg(F.sum("seen")).first()[0] or 0
    top = (
        summaries.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"))
        .where(F.col("n") * entries >= seen).orderBy("key").collect()
    )
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    check(model)
    some = [r["key"] for r in top]
    lengths = library_lengths(model, some) if some else []
    short = [(k, n) for k, n in zip(some, lengths, strict=True) if n < 256]
    return [k for k, _ in short], bytes(n for _, n in short)


def _tiers(model: bytes, table: tuple[list[str], bytes]) -> tuple[sentencepiece.SentencePieceProcessor, dict[str, int], dict[str, int]]:
    """The library, the table of frequent lengths, and the worker's cache."""
    return sentencepiece.SentencePieceProcessor(model_proto=model), dict(zip(*table, strict=True)), {}


def _counts(source, model, table, cache_entries: int, limit: int, key: Hashable) -> Iterator[dict]:
    library, frequent, cache = held(key, lambda: _tiers(model.value, table.value))
    for batch in source:
        totals, open_keys = [], []
        for text in batch["text"]:
            found = keys(text or "")
            lengths = list(map(frequent.get, found))
            totals.append(sum(filter(None, lengths)))
            open_keys.append([k for k, n in zip(found, lengths, strict=True) if n is None])
        fresh = list({k for some in open_keys for k in some if k not in cache})
        lengths = dict(zip(fresh, library_lengths(library, fresh), strict=True)) if fresh else {}
        for i, some in enumerate(open_keys):
            totals[i] += sum(cache[k] if k in cache else lengths[k] for k in some)
        short = {k: n for k, n in lengths.items() if len(k) <= LONGEST_CACHED}
        if len(cache) + len(short) > cache_entries:
            cache.clear()
        cache |= short
        yield {
            "doc_id": batch["doc_id"], "n_bytes": [len((t or "").encode()) for t in batch["text"]],
            "n_tokens": totals, "over_limit": [n > limit for n in totals],
        }


def token_counts(
    docs: DataFrame, model_path: str, limit: int = 4096, frequent: int = 20_000, cache_entries: int = 150_000
) -> DataFrame:
    """Bytes and tokens of every row, by a SentencePiece BPE model, without begin and end ids.

    First tier: a broadcast table of the pre-tokens that make at least one in `frequent` of all, at most 64 characters
    each, so its size is bounded. Second tier: each worker encodes what it misses with the library, once while it is cached.
    One row for each row of `docs`, repeated rows and null `doc_id` included; null and empty texts have 0.
    """
    context = docs.sparkSession.sparkContext
    model = context.broadcast(file_of(model_path))
    table = context.broadcast(frequent_lengths(docs, model_path, frequent))
    key = identity("token counts", model.value, "\n\n".join(table.value[0]).encode(), table.value[1])
    return arrow_map(docs, ["doc_id", "text"], SCHEMA, lambda source: _counts(source, model, table, cache_entries, limit, key), key)
