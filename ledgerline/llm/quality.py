"""Quality classifier: perplexity under a Kneser-Ney model of trusted text, per language (operator 3).

1. Trusted texts give the vocabulary and the counts of neighbouring ids. Both are count tables, sharded by key. A word
   outside the vocabulary is a run of ids: the pieces that a SentencePiece model spells it in. So any number of words is told
   apart, as words before and behind others too, by counts that grow with the trusted texts.
2. All texts are stored as ids, in blocks. A block asks each shard for the distinct pairs it has, as one Golomb-coded
   list; the shard answers with a bit for each, and the counts of those it knows. This is the join of pairs and counts: a
   pair goes once for each block, and neither texts nor ids move: who asks and who scores reads a block where it is stored.
3. A block with its answers gives each of its documents a perplexity. What depends on one id alone (lower level,
   totals, back-off weights) is bounded by the vocabulary and broadcast.
4. Documents above their language's quantile of held-out trusted texts are rejected.
"""

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import golomb
from ledgerline.llm.common import arrow_map, ascending, file_of, keep_ids
from ledgerline.llm.kneser_ney import CLASSES, Coding, discounts, Spell, unigram, TOKEN
from ledgerline.session import materialize

SCHEMA = "doc_id long, lang string, n_tokens long, score double, perplexity double, threshold double, kept boolean"
BLOCK_IDS = 1_000_000
#: Words that are spelled at once, which bounds a worker's lists.
SPELLED = 10_000
#: The stored ids: pages of many documents are compressed together, and a block is found without reading the whole file.
STORED = {"compression": "zstd", "parquet.block.size": str(4 << 20), "parquet.page.size": str(4 << 20), "parquet.enable.dictionary": "false"}


def _tokens(source) -> Iterator[dict]:
    counts: Counter = Counter()

    def out() -> dict:
        return {"token": list(counts), "n": list(counts.values())}

    for batch in source:
        for text in batch["text"]:
            counts.update(TOKEN.findall(text or ""))
            if len(counts) > 200_000:  # bounds the worker; the sums are made behind the shuffle
                yield out()
                counts.clear()
    if counts:
        yield out()


def _speller(model: bytes) -> Spell:
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    text = [library.id_to_piece(i).lstrip("▁") or "▁" for i in range(library.get_piece_size())]
    return lambda tokens: (
        [(i, text[i]) for i in ids]
        for at in range(0, len(tokens), SPELLED) for ids in library.encode(tokens[at : at + SPELLED], num_threads=1)
    )


def _pieces(source, model) -> Iterator[dict]:
    spell, seen = _speller(model.value), set()
    for batch in source:
        seen.update(i for found in spell(batch["token"]) for i, _ in found)
    yield {"piece": sorted(seen)}


def _vocabulary(trusted: DataFrame, size: int, model) -> tuple[list[str], list[int]]:
    """Tokens that are at least so frequent that no more than `size` are, and the pieces in which all others are spelled.

    The limit is read from a histogram of frequencies in steps of a tenth of a power of two, some hundred rows.
    """
    counts = materialize(
        arrow_map(trusted, ["text"], "token string, n long", _tokens)
        .groupBy("token").agg(F.sum("n").alias("n"))
        .withColumn("step", F.floor(F.log2("n") * 10).cast("int")),
        "tokens",
    )
    steps = sorted(((r["step"], r["count"]) for r in counts.groupBy("step").count().collect()), reverse=True)
    least, have = math.inf, 0
    for step, n in steps:
        if have + n > size:
            break
        least, have = step, have + n
    vocabulary = sorted(r["token"] for r in counts.where(F.col("step") >= least).select("token").collect())
    rest = counts.where(F.col("step") < least)
    # At most a row for each piece of the model.
    pieces = arrow_map(rest, ["token"], "piece int", lambda source: _pieces(source, model)).distinct().collect()
    return vocabulary, [r["piece"] for r in pieces]


def _coded(source, units, model, block_ids: int) -> Iterator[dict]:
    """A row for each document, with its block and its ids."""
    coding = Coding(*units.value, _speller(model.value))
    kind = "<u4" if coding.size > 1 << 16 else "<u2"
    have, seq = 0, 0
    for batch in source:
        out: dict[str, list] = {"block": [], "n": [], "ids": []}
        for (ids, n), part in zip(coding.many(batch["text"]), batch["part"], strict=True):
            out["block"].append((part << 32) + seq)
            out["n"].append(n)
            out["ids"].append(np.array(ids, kind).tobytes())
            have += len(ids)
            if have >= block_ids:
                have, seq = 0, seq + 1
        yield out | {"doc_id": batch["doc_id"], "lang": batch["lang"]}


def _ids(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, "<u4" if size > 1 << 16 else "<u2").astype(np.uint64)


def _pair_counts(source, size: int) -> Iterator[dict]:
    held, have = [], 0

    def out() -> dict:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return {"pair": keys.astype(np.int64), "n": n}

    for batch in source:
        for data in batch["ids"]:
            a = _ids(data, size)
            held.append(a[:-1] * np.uint64(size) + a[1:])
            have += len(a)
            if have > 4_000_000:
                yield out()
                held, have = [], 0
    if held:
        yield out()


def _stored_block(block: int, paths: list[str]) -> pa.Table:
    """The documents of a block, from the files that hold them."""
    parts = []
    for path in paths:
        files, place = fs.FileSystem.from_uri(path)
        parts.append(pq.read_table(
            place, columns=["doc_id", "lang", "n", "ids"], filters=[("block", "=", block)], filesystem=files, use_threads=False
        ))
    return pa.concat_tables(parts)


def _pairs(docs: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All neighbouring ids of a block's documents, and where those of each document begin (and the last one's end)."""
    found = [a[:-1] * np.uint64(size) + a[1:] for a in (_ids(x.as_buffer(), size) for x in docs.column("ids"))]
    return np.concatenate([np.zeros(0, np.uint64), *found]), np.cumsum([0, *map(len, found)])


def _by_shard(pairs: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of ascending pairs by shard, in the order of shards: pair modulo shards is the shard."""
    shard = (pairs % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    return ((s, order[cuts[s] : cuts[s + 1]]) for s in range(shards) if cuts[s] < cuts[s + 1])


def _ask(source, shards: int, size: int) -> Iterator[dict]:
    """A block's distinct pairs, cut by shard; the rest of the division by shards is sent."""
    for batch in source:
        for block, paths in zip(batch["block"], batch["paths"], strict=True):
            pairs = ascending(_pairs(_stored_block(block, paths), size)[0])
            rows = [(s, pairs[at] // np.uint64(shards)) for s, at in _by_shard(pairs, shards)]
            yield {
                "block": [block] * len(rows), "shard": [s for s, _ in rows],
                "list": [golomb.encode(x, int(x[-1]) + 1) for _, x in rows],
            }


def packed_counts(n: np.ndarray) -> bytes:
    """Counts, most of them small: a byte each, and behind them those of 255 and more."""
    return zlib.compress(np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<i8").tobytes(), 6)


def unpacked_counts(data: bytes, size: int) -> np.ndarray:
    data = zlib.decompress(data)
    n = np.frombuffer(data, np.uint8, size).astype(np.int64)
    n[n == 255] = np.frombuffer(data, "<i8", offset=size)
    return n


def _known(source, shards: int, most: int = 1_000_000) -> Iterator[dict]:
    """Counted pairs as lists like those that are asked for, with their counts."""
    held, have = [], 0

    def out() -> dict:
        pairs, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(pairs)
        pairs, n = pairs[order], n[order]
        rows = [(s, pairs[at] // np.uint64(shards), n[at]) for s, at in _by_shard(pairs, shards)]
        return {
            "shard": [s for s, _, _ in rows], "list": [golomb.encode(x, int(x[-1]) + 1) for _, x, _ in rows],
            "n": [packed_counts(x) for _, _, x in rows],
        }

    for batch in source:
        held.append((np.array(batch["pair"], np.uint64), np.array(batch["n"], np.int64)))
        have += len(batch["n"])
        if have >= most:
            yield out()
            held, have = [], 0
    if have:
        yield out()


def _answer(shards: int):
    """Answers of one shard: a bit for each pair of a list, set if it was counted, and the counts of those."""

    def run(asked: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        lists = [(x := golomb.decode(data), unpacked_counts(n, len(x))) for data, n in zip(counted["list"], counted["n"], strict=True)]
        keys = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in lists)]) * np.uint64(shards)
        order = np.argsort(keys)
        n = np.concatenate([np.zeros(0, np.int64), *(x for _, x in lists)])[order]
        keys = keys[order] + np.uint64(counted["shard"].iloc[0] if len(counted) else 0)
        rows = []
        for block, shard, data in zip(asked["block"], asked["shard"], asked["list"], strict=True):
            pairs = golomb.decode(data) * np.uint64(shards) + np.uint64(shard)
            at = np.searchsorted(keys, pairs)
            hit = at < len(keys)
            hit[hit] = keys[at[hit]] == pairs[hit]
            if hit.any():
                rows.append((block, shard, np.packbits(hit).tobytes(), packed_counts(n[at[hit]])))
        return pd.DataFrame(rows, columns=["block", "shard", "known", "n"])

    return run


def _score(shards: int, model):
    """Sums of negative log probabilities of a block's documents. Which pairs the block has asked for follows from its ids."""

    def run(places: pa.Table, answers: pa.Table) -> pa.Table:
        size, d, lower, total, weight = model.value
        docs = pa.concat_tables([_stored_block(r["block"], r["paths"]) for r in places.to_pylist()])
        pairs, ends = _pairs(docs, size)
        asked = ascending(pairs)
        n = np.zeros(len(asked), np.int64)
        replies = {r["shard"]: r for r in answers.to_pylist()}
        for shard, at in _by_shard(asked, shards):
            if shard in replies:
                known = at[np.unpackbits(np.frombuffer(replies[shard]["known"], np.uint8), count=len(at)).astype(bool)]
                n[known] = unpacked_counts(replies[shard]["n"], len(known))
        u, v = (asked // np.uint64(size)).astype(np.int64), (asked % np.uint64(size)).astype(np.int64)
        high = np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3)], 0.0) / total[u]
        losses = np.append(-np.log(high + weight[u] * lower[v])[np.searchsorted(asked, pairs)], 0.0)
        sums = np.where(ends[1:] > ends[:-1], np.add.reduceat(losses, ends[:-1]), 0.0)
        return pa.table({"doc_id": docs.column("doc_id"), "lang": docs.column("lang"), "n": docs.column("n"), "sum": sums})

    return run


def perplexities(docs: DataFrame, trusted_ids: DataFrame, vocabulary: int, spelling: str | None = None) -> DataFrame:
    """(doc_id, lang, n, sum): number of tokens and negative log likelihood of every row of `docs`.

    `spelling` is the file of the SentencePiece model for words outside the vocabulary, piece_bpe_32k.model if none is named.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = spark.sparkContext.broadcast(file_of(spelling or public_tokenizers.path("piece_bpe_32k.model")))
    units = _vocabulary(keep_ids(docs, trusted_ids, "doc_id"), vocabulary, model)
    size = len(CLASSES) + sum(map(len, units))
    coding = spark.sparkContext.broadcast(units)
    rows = materialize(
        arrow_map(
            docs.select("doc_id", "lang", "text").withColumn("part", F.spark_partition_id().cast("long")),
            ["doc_id", "lang", "text", "part"],
            "block long, doc_id long, lang string, n long, ids binary",
            lambda source: _coded(source, coding, model, BLOCK_IDS),
        ),
        "coded", STORED,
    )
    counts = materialize(
        arrow_map(keep_ids(rows, trusted_ids, "doc_id"), ["ids"], "pair long, n long", lambda s: _pair_counts(s, size))
        .groupBy("pair").agg(F.sum("n").alias("n")),
        "pairs",
    )
    d = discounts([counts.where(f"n = {k}").count() for k in (1, 2, 3, 4)])
    off = F.least(F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2]), F.col("n"))
    before = np.zeros(size, np.int64)
    for r in counts.groupBy(F.expr(f"pair % {size}").alias("b")).agg(F.count("pair").alias("n")).collect():
        before[r["b"]] = r["n"]
    weight, total = np.ones(size), np.ones(size)
    # One row for each id of the vocabulary at most.
    for r in counts.groupBy(F.expr(f"pair div {size}").alias("a")).agg(F.sum("n").alias("n"), F.sum(off).alias("off")).collect():
        weight[r["a"]], total[r["a"]] = r["off"] / r["n"], r["n"]
    places = rows.groupBy("block").agg(F.collect_set("_metadata.file_path").alias("paths"))
    places = materialize(places, "places")
    asked = arrow_map(
        places.repartition(shards, "block"), ["block", "paths"], "block long, shard int, list binary", lambda s: _ask(s, shards, size)
    )
    known = arrow_map(counts, ["pair", "n"], "shard int, list binary, n binary", lambda s: _known(s, shards))
    answers = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(
        _answer(shards), "block long, shard int, known binary, n binary"
    )
    shared = spark.sparkContext.broadcast((size, d, unigram(before), total, weight))
    return places.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(shards, shared), "doc_id long, lang string, n long, sum double"
    )


def quality(
    docs: DataFrame, labels: DataFrame, vocabulary: int = 10_000, quantile: float = 0.995, weight: float = 20.0,
    slack: float = 0.5,
) -> DataFrame:
    """One row for each row of `docs`: tokens, smoothed mean negative log likelihood, perplexity, threshold, kept.

    Trusted texts are those of documents with quality 1 that no label calls toxic. Four fifths of them, by a hash of the
    id, train the model (all their tokens and pairs; the `vocabulary` most frequent words have an id of their own, all others are
    spelled in pieces), the rest sets the thresholds. A document's score is its negative log likelihood with `weight` more tokens of its language's
    mean, by number of tokens, so a short text is not rejected for one rare word. It is rejected if its score is above
    the `quantile` of its language's held-out texts, or of all of them if the language has none, by more than `slack` of the
    way from their median to that quantile, divided by sqrt(1 + number of held-out texts expected above it): the quantile of
    few texts is uncertain, that of many is not. A null language is a
    language. A text without tokens has its language's mean score. Without trusted texts nothing is rejected.
    Rows with one doc_id, and rows without, are judged each by its own text; labels without doc_id are ignored.
    """
    trusted = materialize(
        labels.where("doc_id IS NOT NULL").groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .where("quality = 1 AND coalesce(toxic, 0) = 0")
        .select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held_out")),
        "trusted",
    )
    scored = materialize(perplexities(docs, trusted.where("NOT held_out").select("doc_id"), vocabulary), "scored")
    held = scored.join(trusted.where("held_out"), "doc_id").where("n > 0")
    means = held.groupBy("lang").agg((F.sum("sum") / F.sum("n")).alias("mean"))
    total = held.agg(F.sum("sum").alias("s"), F.sum("n").alias("n")).first()
    mean = total["s"] / total["n"] if total["n"] else 0.0
    lang = F.coalesce("lang", F.lit("\x00")).alias("code")  # no language has this code
    means = F.broadcast(means.select(lang, "mean"))  # a row for each language with trusted texts
    score = ((F.col("sum") + weight * F.coalesce("mean", F.lit(mean))) / (F.col("n") + weight)).alias("score")
    smooth = lambda df: df.select("*", lang).join(means, "code", "left").select("doc_id", "lang", "code", "n", "sum", score)
    high, middle = (F.percentile_approx("score", q, 10_000) for q in (quantile, 0.5))
    top = (high + slack * (high - middle) / F.sqrt(1 + (1 - quantile) * F.count("score"))).alias("limit")
    limits = smooth(held).groupBy("code").agg(top)
    overall = smooth(held).agg(top).first()[0]
    overall = math.inf if overall is None else overall
    limit = F.coalesce("limit", F.lit(overall))
    return smooth(scored).join(F.broadcast(limits), "code", "left").select(
        "doc_id", "lang", F.col("n").alias("n_tokens"), "score",
        F.when(F.col("n") > 0, F.exp(F.col("sum") / F.col("n"))).alias("perplexity"),
        limit.alias("threshold"), (F.col("score") <= limit).alias("kept"),
    )
