"""The corpus queries of the entry point: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (
    decontaminate, exact_dedup, html_text, id_files, importance, line_dedup, near_dedup, phrase_fingerprint, piece_codec,
    quality, token_alignment, token_counts, url_templates,
)
from ledgerline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": corpus_pipeline.run}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return wrap


@query("op1_near_duplicates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("text_sha256"))


@query("op5_main_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op6_id_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, vocabulary=49_408
    )


@query("op7_exact_duplicates", r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    n AS (SELECT doc_id, length(text) AS size, sha256(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
                 regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS bare FROM t),
    g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY bare ORDER BY size DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY bare) AS group_size FROM n)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""".replace("\\", "\\"))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op8_decontamination", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
    b AS (SELECT DISTINCT item_id::VARCHAR AS item_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
    item_windows AS (
        SELECT DISTINCT item_id, n, array_to_string(words[s + 1 : s + n], ' ') AS win
        FROM (SELECT item_id, words, least(13, len(words)) AS n, unnest(range(len(words) - least(13, len(words)) + 1)) AS s FROM b WHERE len(words) > 0)),
    lengths AS (SELECT DISTINCT n FROM item_windows),
    doc_windows AS (
        SELECT doc_id, n, s, array_to_string(words[s + 1 : s + n], ' ') AS win
        FROM (SELECT doc_id, words, n, unnest(range(greatest(len(words) - n + 1, 0))) AS s FROM d, lengths)),
    found AS (SELECT * FROM doc_windows WHERE (n, win) IN (SELECT (n, win) FROM item_windows)),
    hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM found) GROUP BY doc_id),
    items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM found JOIN item_windows USING (n, win)) GROUP BY doc_id)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache_entries=300_000, digest=True
    )


@query("op10_url_templates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document it shows, whose number ends its path: bad if of low quality or toxic."""
    pages = table(spark, sf_dir, "pages")
    shown = F.regexp_extract(url_templates.path_of(F.col("url")), r"/(\d{1,18})(?:\.html)?/?$", 1)
    labels = (
        pages.select("page_id", F.when(shown != "", shown.cast("long")).alias("doc_id"))
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .select("page_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    )
    return url_templates.url_filter(pages, labels)


_STEPS = ", ".join(map(str, importance.crc_steps().tolist()))


@query("op11_importance", rf"""
    WITH texts AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
    rows AS (SELECT side, doc_id, row_number() OVER () AS r,
                    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
    runs AS (SELECT side, r, words, k, unnest(range(len(words) - k + 1)) AS i FROM rows, (SELECT unnest([1, 2, 3]) AS k) WHERE len(words) >= k),
    features AS MATERIALIZED (SELECT side, r, array_to_string(words[i + 1 : i + k], ' ') AS f FROM runs),
    bytes AS (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM features)),
    buckets AS MATERIALIZED (
        SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                                  lambda c, b: xor(c >> 8, ([{_STEPS}]::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes),
    counts AS (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM features JOIN buckets USING (f) GROUP BY bucket),
    gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts)::BIGINT + 10000)
                                             / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts)::BIGINT + 10000))))::BIGINT AS gain FROM counts),
    weights AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight
                FROM features JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
    scores AS (
        SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
               (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
        FROM rows LEFT JOIN weights USING (r) WHERE side = 0),
    able AS (SELECT *, n_words >= 20 AND doc_id IS NOT NULL AS able FROM scores),
    places AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM able)
    SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * n // 100 THEN place END AS rank FROM places
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )


@query("op13_fingerprints")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))
