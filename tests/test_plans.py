"""What the physical plans must and must not contain."""

import contextlib
import io

import pytest
from conftest import SF_DIR

from ledgerline import filter_master
from ledgerline.plans.registry import QUERIES

RELATIONAL = sorted(n for n in QUERIES if n[0] in "mqkrid" and "anomal" not in n)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert word not in text, word


def test_filters_and_columns_reach_the_scan(star):
    df = filter_master(star.master, {"year": "1997", "region": "ASIA"}).groupBy("category").sum("net_revenue")
    text = plan(df)
    assert "PartitionFilters: [isnotnull(year" in text
    assert "EqualTo(region_name,ASIA)" in text
    read = next(line for line in text.splitlines() if line.startswith("ReadSchema"))
    assert "net_revenue" in read and "gross_profit" not in read and "customer_id" not in read


def test_wide_items_are_shuffled_once(star):
    """No exchange on the customer carries item rows: a hot customer cannot gather them."""
    from ledgerline.operators.master import build_master

    text = plan(build_master(star.tables))
    exchanges = [block for block in text.split("\n\n") if ") Exchange" in block.split("\n")[0]]
    with_items = [b for b in exchanges if "order_item_id" in b]
    assert len(with_items) == 1 and "hashpartitioning(order_id" in with_items[0]


def test_no_library_code_checkpoints_locally():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "ledgerline"
    for path in root.rglob("*.py"):
        assert "localCheckpoint" not in path.read_text(), path


@pytest.mark.parametrize("name", ["q1_top_customers", "q2_top_products", "m17_customer_order_rank", "f3_restrict_customers", "k12_top_customers_filtered"])
def test_building_a_plan_starts_no_job(spark, star, name):
    context = spark.sparkContext
    context.setJobGroup(f"plan-{name}", name)
    try:
        QUERIES[name](spark, SF_DIR)
        assert list(context.statusTracker().getJobIdsForGroup(f"plan-{name}")) == []
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
