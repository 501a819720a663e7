"""Reading, checking, cleaning and storing the base tables."""

import csv

import pytest
from pyspark.sql import functions as F
from small import ROWS, facts, tables

from ledgerline import dedup, dedup_report, read_tables, run_etl, run_named, run_sql, standardise_dates, validate
from ledgerline.operators.kpi import forecast_total
from ledgerline.schemas import FILE_STEMS, TABLES
from ledgerline.sources.tables import MissingTables
from ledgerline.sources.warehouse import load_forecast, save_forecast


def write_csv(directory, skip=()):
    for name, rows in ROWS.items():
        if name not in skip:
            with open(directory / f"{FILE_STEMS.get(name, name)}.csv", "w", newline="") as out:
                writer = csv.writer(out)
                writer.writerow(TABLES[name].fieldNames())
                writer.writerows(rows)


def test_read_csv_by_header_name(spark, tmp_path):
    write_csv(tmp_path)
    got = read_tables(spark, str(tmp_path))
    assert set(got) == set(TABLES)
    for name, df in got.items():
        assert df.schema == TABLES[name], name
        assert sorted(map(str, df.collect())) == sorted(map(str, tables(spark)[name].collect()))


def test_all_missing_files_are_named(spark, tmp_path):
    write_csv(tmp_path, skip=("reps", "returns"))
    with pytest.raises(MissingTables) as error:
        read_tables(spark, str(tmp_path))
    assert "sales_representatives.csv" in str(error.value) and "returns.csv" in str(error.value)


def test_clean_tables_have_no_findings(spark):
    assert validate(tables(spark)).count() == 0


def test_every_finding_is_reported(spark):
    bad = tables(spark)
    bad["customers"] = bad["customers"].drop("created_date")
    bad["orders"] = bad["orders"].withColumn("delay_days", F.lit(1.5))
    bad["order_items"] = bad["order_items"].withColumn(
        "quantity", F.when(F.col("order_item_id") == "I1", "two").otherwise("2")
    )
    bad["discounts"] = bad["discounts"].union(
        spark.createDataFrame([("D9", "O1", ROWS["discounts"][0][2], "AGAIN")], TABLES["discounts"])
    )
    found = {tuple(r) for r in validate(bad).collect()}
    assert found == {
        ("customers", "created_date", "missing column"),
        ("orders", "delay_days", "expected int, got double"),
        ("order_items", "quantity", "expected int, got string"),
        ("order_items", "quantity", "1 values are not int"),
        ("discounts", "order_id", "1 keys repeat"),
    }


def test_dedup_drops_full_copies_only(spark):
    items = tables(spark)["order_items"]
    doubled = items.union(items.limit(3))
    assert dedup(doubled).count() == items.count()
    row = dedup_report({"order_items": doubled}).first()
    assert (row.before, row.after, row.removed) == (11, 8, 3)


def test_bad_dates_become_null(spark):
    t = {"returns": spark.createDataFrame([("R", "O", "2025-01-02", "x"), ("R", "O", "soon", "x")],
                                          "return_id string, order_id string, return_date string, return_reason string")}
    got = [str(r.return_date) for r in standardise_dates(t)["returns"].collect()]
    assert got == ["2025-01-02", "None"]


def test_etl_end_to_end(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    write_csv(raw)
    out = str(tmp_path / "out")
    warehouse = run_etl(spark, str(raw), out)
    assert warehouse.master.count() == 8
    assert spark.read.option("header", True).csv(f"{out}/master_csv").count() == 8
    folders = {p.name for p in (tmp_path / "out" / "master").iterdir() if p.is_dir()}
    assert {"year=2024", "year=2025"} <= folders
    warehouse.register()
    never_sold = [r for r in run_named(spark, "worst_products").collect() if r.product_id == "P3"]
    assert [(r.total_qty, r.profit_margin_pct, r.return_rate_pct) for r in never_sold] == [(0, 0.0, None)]
    # An item whose order is unknown belongs to a NULL month, which SQL keeps.
    assert run_sql(spark, "SELECT count(*) AS n FROM view_monthly_summary").first().n == 4
    by_region = {r.region_id: r for r in run_named(spark, "revenue_by_region").collect()}
    assert by_region["REG01"].marketing_roi > 0
    assert run_sql(spark, "SELECT order_id FROM orders WHERE delay_days > ? ORDER BY 1", [4]).count() == 2
    with pytest.raises(FileNotFoundError):
        run_named(spark, "no_such_query")


def test_etl_refuses_bad_tables(spark, tmp_path):
    write_csv(tmp_path)
    (tmp_path / "regions.csv").write_text("region_id,region_name\nREG01,North\n")
    with pytest.raises(ValueError, match="regions.country: missing column"):
        run_etl(spark, str(tmp_path), str(tmp_path / "out"))


def test_etl_refuses_values_that_are_not_numbers(spark, tmp_path):
    write_csv(tmp_path)
    items = (tmp_path / "order_items.csv").read_text().replace("I1,O1,P1,2,", "I1,O1,P1,two,").replace("I2,O1,P2,1,", "I2,O1,P2,1.5,")
    (tmp_path / "order_items.csv").write_text(items)
    with pytest.raises(ValueError, match="order_items.quantity: 2 values are not int"):
        run_etl(spark, str(tmp_path), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_forecast_table_and_fallback(spark, tmp_path):
    m = facts(spark, [{"net_revenue": 10}, {"net_revenue": 20}])
    assert load_forecast(spark, str(tmp_path)) is None
    assert forecast_total(m).first().forecast_6m == 90.0
    save_forecast(spark.createDataFrame([(1.5,), (2.5,)], "forecasted_revenue double"), str(tmp_path))
    assert forecast_total(m, load_forecast(spark, str(tmp_path))).first().forecast_6m == 4.0
