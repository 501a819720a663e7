"""The registered corpus queries, and the pipeline stage by stage."""

import duckdb
import pytest
from conftest import SF_DIR

import corpus_pipeline
from ledgerline.llm.common import table
from ledgerline.llm.queries import ORACLE, QUERIES


def test_registered():
    import __spark_entry__

    numbers = {k.split("_")[0] for k in QUERIES}
    assert numbers == {"pipeline", *(f"op{n}" for n in range(1, 14))}
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    found = con.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    want = sorted(map(str, found.fetchall()))
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == want and len(df.columns) == len(columns)


@pytest.mark.parametrize("name,rows", [("op5_main_text", 50), ("op10_url_templates", 50), ("op3_quality", 200), ("op4_line_dedup", 200)])
def test_whole_table(spark, name, rows):
    assert QUERIES[name](spark, SF_DIR).count() == rows


def test_pipeline_stages(spark):
    """A stage only takes rows away, keeps the columns, and acts on what the stage before has kept."""
    from ledgerline.session import materialize

    docs = table(spark, SF_DIR, "documents")
    columns, sizes, last = docs.columns, [docs.count()], {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF_DIR), f"test-{name}")
        assert docs.columns == columns
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= last
        last = now
        sizes.append(len(now))
    assert sizes[-1] < sizes[1] < sizes[0]
    out = corpus_pipeline.run(spark, SF_DIR)
    assert {r["doc_id"] for r in out.collect()} == last and out.columns[0] == "doc_id"


def test_batches_are_bounded(spark):
    """What the JVM sends to a worker at once is bounded by bytes, not by 10,000 texts of any length."""
    from pyspark.sql import functions as F

    from ledgerline.llm.common import BATCH_BYTES, arrow_map

    texts = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("word "), 1000).alias("text"))
    read = arrow_map(texts, ["text"], "n long", lambda source: ({"n": [len(t) for t in batch["text"]]} for batch in source))

    def sizes(batches):
        import pyarrow as pa

        return (pa.RecordBatch.from_pydict({"size": [b.nbytes]}) for b in batches)

    assert read.groupBy("n").count().collect() == [(5000, 4000)]
    assert max(r["size"] for r in texts.mapInArrow(sizes, "size long").collect()) < 1.1 * BATCH_BYTES
