"""Rules of the fact on hand-made rows."""

from decimal import Decimal

import pytest
from conftest import SF_DIR
from small import tables

from ledgerline.operators.master import build_master, fact_inputs, order_frame, with_date_parts, with_rules
from ledgerline.plans.registry import QUERIES
from ledgerline.schemas import LEAKAGE_CAUSES, MASTER, MASTER_COLUMNS
from ledgerline.sources import warehouse


@pytest.fixture(scope="module")
def fact(spark):
    df = build_master(tables(spark))
    assert df.columns == MASTER_COLUMNS and len(MASTER_COLUMNS) == 54
    assert [f.dataType for f in df.schema] == [f.dataType for f in MASTER]
    rows = df.collect()
    assert len(rows) == 8
    return {r.order_item_id: r for r in rows}


def test_discount_at_the_allowance_is_no_leakage(fact):
    assert fact["I1"].discount_percentage == Decimal("0.2") and fact["I1"].discount_leakage == 0
    assert fact["I3"].discount_leakage == Decimal("4.5")  # 90 * (0.25 - 0.20)


def test_delay_must_exceed_five_days(fact):
    assert fact["I3"].delay_leakage == 0 and fact["I3"].delay_days == 5
    assert fact["I4"].delay_leakage == Decimal("100")


def test_pricing_leakage_only_below_base_price(fact):
    assert fact["I1"].pricing_leakage == 0
    assert fact["I2"].pricing_leakage == Decimal("10")


def test_return_leakage_and_flags(fact):
    row = fact["I5"]
    assert row.return_leakage == row.net_revenue == Decimal("150")
    assert (row.is_returned, row.is_leakage, row.return_reason) == (1, 1, "Defective")


def test_amounts(fact):
    row = fact["I1"]
    assert (row.gross_revenue, row.discount_amount, row.net_revenue) == (200, 40, 160)
    assert (row.cost_amount, row.gross_profit) == (40, 120)
    assert row.profit_margin == 0.75
    assert fact["I2"].gross_profit == Decimal("-28")


def test_nothing_sold_has_zero_ratios(fact):
    assert (fact["I8"].profit_margin, fact["I8"].leakage_score) == (0.0, 0.0)


def test_leakage_is_the_sum_of_its_causes(fact):
    for row in fact.values():
        if row.net_revenue is not None and row.base_price is not None:
            assert row.leakage_amount == sum(row[c] for c in LEAKAGE_CAUSES)


def test_unknown_order_keeps_its_item(fact):
    row = fact["I6"]
    assert row.customer_id is None and row.order_date is None
    assert (row.discount_code, row.return_reason, row.season) == ("NONE", "N/A", "Autumn")
    assert (row.customer_order_rank, row.customer_ltv, row.high_risk_customer) == (None, None, None)
    assert row.repeat_customer_indicator == 0 and row.discount_percentage == 0


def test_unknown_product_and_region(fact):
    assert fact["I7"].category is None and fact["I7"].cost_amount is None
    assert fact["I5"].region_name is None and fact["I5"].region_id_rep == "REG02"


def test_dates_and_seasons(fact):
    assert (fact["I1"].quarter, fact["I1"].month, fact["I1"].season) == ("2024Q4", "2024-12", "Winter")
    assert fact["I5"].year == 2025 and fact["I5"].month_num == 2


def test_customer_features(fact):
    ranks = {r.order_id: (r.customer_order_rank, r.repeat_customer_indicator) for r in fact.values() if r.customer_id}
    assert ranks == {"O1": (1, 0), "O2": (2, 1), "O3": (1, 0), "O4": (3, 1)}
    c1 = [r for r in fact.values() if r.customer_id == "C1"]
    assert {r.customer_ltv for r in c1} == {sum(r.net_revenue for r in c1)}
    assert {r.high_risk_customer for r in c1} == {1}
    assert fact["I4"].high_risk_customer == 1  # score 1.0


@pytest.mark.parametrize("rows", [1, 3, 100])
def test_stored_in_slices(spark, fact, tmp_path, monkeypatch, rows):
    """Slices of any size give the same fact, items without an order and orders without items included."""
    monkeypatch.setattr(warehouse, "SLICE_ROWS", rows, raising=False)
    given = tables(spark)
    given["order_items"] = given["order_items"].unionByName(given["order_items"].limit(1).selectExpr(
        "'I9' AS order_item_id", "CAST(NULL AS STRING) AS order_id", "product_id", "quantity", "unit_price"
    ))
    warehouse.store_master(spark, given, str(tmp_path / "fact"))
    got = warehouse.read_master(spark, str(tmp_path / "fact")).collect()
    whole = build_master(given).collect()
    assert len(got) == 9 and sorted(map(repr, got)) == sorted(map(repr, whole))
    assert {r.order_item_id: r for r in got if r.order_item_id != "I9"} == fact


def test_slices_drop_their_shuffle_files(spark, star, tmp_path, monkeypatch):
    """Every step but the last leaves its shuffle files to be deleted before the next one begins."""
    monkeypatch.setattr(warehouse, "SLICE_ROWS", 2000)
    freed = []
    monkeypatch.setattr(warehouse, "release", lambda session: freed.append(session))
    warehouse.store_master(spark, star.tables, str(tmp_path / "fact"))
    slices = -(-star.tables["order_items"].count() // 2000)
    assert slices > 1 and len(freed) == 2 + slices + 1
    got = warehouse.read_master(spark, str(tmp_path / "fact"))
    assert got.exceptAll(star.master).count() == 0 and got.count() == star.master.count()


def test_wide_shuffle_has_no_derived_columns(spark, star, tmp_path):
    """Columns that follow from others are added behind the rebalance, not carried through it."""
    seen = []

    def finish(rows):
        seen.extend(rows.columns)
        return with_rules(rows)

    rows = with_date_parts(fact_inputs(star.tables["order_items"], star.tables["products"], order_frame(star.tables)))
    warehouse._write_by_month(rows, str(tmp_path / "fact"), finish)
    assert not {"net_revenue", "leakage_amount", "leakage_score", "season", "profit_margin"} & set(seen)
    assert warehouse.read_master(spark, str(tmp_path / "fact")).exceptAll(star.master).count() == 0


@pytest.mark.parametrize("name", ["m8_profit_margin", "s11_ad_hoc_sql", "s2_star_orders"])
def test_fact_is_built_when_asked_for(spark, monkeypatch, name):
    """Queries of the base tables build no fact."""
    def fail(*args):
        raise AssertionError("the fact was built")

    monkeypatch.setattr(warehouse, "_open", {})
    monkeypatch.setattr(warehouse, "store_master", fail, raising=False)
    monkeypatch.setattr(warehouse, "write_master", fail)
    assert QUERIES[name](spark, SF_DIR).count() > 0
