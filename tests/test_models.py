"""Models: quality and invariants, since random draws cannot be matched value by value."""

import itertools

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from small import facts

from ledgerline.ml import demand, explain, forecast, segments
from ledgerline.ml.anomaly import AnomalyDetector, expected_depth
from ledgerline.plans.registry import QUERIES


def test_personas_are_taken_in_order():
    centers = [
        {"is_returned": 0.9, "monetary": 100, "discount_percentage": 0.9},
        {"is_returned": 0.1, "monetary": 90, "discount_percentage": 0.8},
        {"is_returned": 0.2, "monetary": 10, "discount_percentage": 0.7},
        {"is_returned": 0.3, "monetary": 20, "discount_percentage": 0.1},
    ]
    assert segments.name_personas(centers) == {
        0: "High Return Risk", 1: "VIP High-Value", 2: "Discount Seekers", 3: "Standard Customers",
    }
    with pytest.raises(ValueError):
        segments.name_personas(centers[:3])


@pytest.fixture(scope="module")
def segmenter(star):
    return segments.Segmenter.train(star.master, restarts=3)


def test_segments_cover_all_customers(star, segmenter, spark, tmp_path):
    scored = segmenter.score(star.master)
    rows = {r.customer_id: (r.cluster, r.segment_name) for r in scored.collect()}
    assert len(rows) == star.master.select("customer_id").distinct().count()
    assert len({name for _, name in rows.values()}) == 4
    path = str(tmp_path / "segments")
    segmenter.save(path)
    again = segments.Segmenter.load_or_train(spark, path, star.master.limit(0))  # loads: nothing to train on
    assert {r.customer_id: (r.cluster, r.segment_name) for r in again.score(star.master).collect()} == rows


@pytest.fixture(scope="module")
def detector(star):
    return AnomalyDetector.train(star.master)


def test_anomaly_share_and_sign(star, detector, spark, tmp_path):
    scored = detector.score(star.master)
    row = scored.agg(
        F.avg("is_anomaly").alias("share"), F.count("*").alias("n"),
        F.sum(((F.col("anomaly_score") < 0).cast("int") != F.col("is_anomaly")).cast("int")).alias("wrong"),
    ).first()
    assert row.n == star.master.count() and row.wrong == 0
    assert row.share == pytest.approx(0.06, abs=0.01)
    path = str(tmp_path / "forest")
    detector.save(path)
    again = AnomalyDetector.load(spark, path).score(star.master)
    total = lambda df: df.agg(F.sum("anomaly_score")).first()[0]
    assert total(again) == pytest.approx(total(scored))


def test_forest_finds_planted_anomalies(spark):
    rows = [
        {"gross_revenue": 100 + i % 7, "discount_percentage": 0.1, "delay_days": 2 + i % 3, "profit_margin": 0.5, "is_returned": 0,
         "order_id": "normal"} for i in range(600)
    ] + [{"gross_revenue": 9000, "discount_percentage": 0.9, "delay_days": 60, "profit_margin": -3.0, "is_returned": 1, "order_id": "odd"}] * 6
    m = facts(spark, rows)
    scored = AnomalyDetector.train(m, contamination=0.01).score(m)
    worst = scored.orderBy("anomaly_score").limit(6).collect()
    assert {r.order_id for r in worst} == {"odd"}


def test_forest_shape(detector):
    sizes = detector.nodes.groupby("tree").size()
    assert len(sizes) == 100 and sizes.max() <= 511
    assert expected_depth(1) == 0.0 and expected_depth(2) == 1.0
    leaves = detector.nodes[detector.nodes.feature < 0]
    assert (leaves.left == -1).all() and leaves.depth.min() > 0


@pytest.fixture(scope="module")
def model(star):
    return demand.DemandModel.train(star.master, trees=20, depth=5)


def test_demand_beats_the_mean(star, model):
    spread = star.master.agg(F.stddev_pop("quantity")).first()[0]
    assert model.metrics["rmse"] < spread and model.metrics["r2"] > 0


def test_unknown_labels(spark):
    m = facts(spark, [{"category": "Hardware", "region_name": "Mars", "sales_channel": None}])
    row = demand.training_rows(m, demand.fixed_codes(spark)).first()
    assert (row.category, row.region_id, row.sales_channel) == (1.0, -1.0, -1.0)
    assert (row.unit_price, row.discount_percentage, row.month_num, row.label) == (0.0, 0.0, 1.0, 1.0)
    assert demand.encode(m, demand.fixed_codes(spark), unknown=0).first().region_id == 0.0


def test_scenario_scores_and_economics(spark, model, tmp_path):
    scenarios = spark.createDataFrame(
        [("Hardware", 10.0, 0.1, "ASIA", "Online", 3), ("?", 1e6, 0.0, "?", "?", 13)],
        "category string, unit_price double, discount_percentage double, region_name string, sales_channel string, month_num int",
    )
    rows = model.score(scenarios).collect()
    assert len(rows) == 2
    for r in rows:
        share = {"Hardware": 0.63}.get(r.category, 0.5)
        assert r.predicted_quantity >= 1.0
        assert r.net_profit == pytest.approx(r.predicted_quantity * r.unit_price * (1 - r.discount_percentage - share))
    path = str(tmp_path / "demand")
    model.save(path)
    again = demand.DemandModel.load(spark, path)
    assert sorted(again.codes.collect()) == sorted(model.codes.collect())
    assert again.score(scenarios).collect() == rows


def test_shapley_equals_all_orderings(star, model):
    features = demand.encode(star.master, model.codes)
    background = features.orderBy(*demand.FEATURES).limit(4)
    rows = features.orderBy(F.col("unit_price").desc(), *demand.FEATURES).limit(2)
    got = explain.explain(model, rows, background).collect()
    base = [[r[f] for f in demand.FEATURES] for r in background.collect()]
    spark = star.master.sparkSession

    def value(x, kept):
        mixed = [[x[i] if i in kept else b[i] for i in range(6)] for b in base]
        df = spark.createDataFrame([tuple(map(float, v)) for v in mixed], ", ".join(f"{f} double" for f in demand.FEATURES))
        return np.mean([r.prediction for r in model.predict(df).collect()])

    for r in got[:1]:
        x = [r[f] for f in demand.FEATURES]
        v = {s: value(x, s) for k in range(7) for s in map(frozenset, itertools.combinations(range(6), k))}
        phi = np.zeros(6)
        for order in itertools.permutations(range(6)):
            seen = frozenset()
            for i in order:
                phi[i] += v[seen | {i}] - v[seen]
                seen |= {i}
        phi /= 720
        assert [r[f"phi_{f}"] for f in demand.FEATURES] == pytest.approx(list(phi), abs=1e-9)
    for r in got:
        assert r.base_value + sum(r[f"phi_{f}"] for f in demand.FEATURES) == pytest.approx(r.prediction, abs=1e-9)


def test_whole_background(star, model):
    """The base is the mean prediction over all items; every distinct vector is explained and adds up."""
    features = demand.encode(star.master, model.codes)
    got = explain.explain(model, features, features)
    row = got.agg(
        F.count("*").alias("n"), F.min("base_value").alias("low"), F.max("base_value").alias("high"),
        F.max(F.abs(F.col("base_value") + sum(F.col(f"phi_{f}") for f in demand.FEATURES) - F.col("prediction"))).alias("gap"),
    ).first()
    assert row.n == features.distinct().count() and row.gap < 1e-9
    mean = model.predict(features).agg(F.avg("prediction")).first()[0]
    assert row.low == pytest.approx(mean, abs=1e-9) and row.high == pytest.approx(mean, abs=1e-9)
    off = got.join(model.predict(features.distinct()).withColumnRenamed("prediction", "p"), demand.FEATURES)
    assert off.agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0] < 1e-9


def test_grid_and_leaves_agree(star, model, monkeypatch):
    """A forest with a large grid is explained by its leaves: the same values, for rows with columns beside them."""
    rows = demand.encode(star.master, model.codes, keep=("order_item_id",))
    background = rows.where("pmod(hash(order_item_id), 3) = 0")
    odd = rows.limit(2).unionByName(rows.limit(1)).withColumns({"unit_price": F.lit(float("nan")), "category": F.lit(None).cast("double")})
    some = rows.limit(200).unionByName(odd)
    both = []
    for cells in (explain.GRID_CELLS, 0):
        monkeypatch.setattr(explain, "GRID_CELLS", cells)
        explainer = explain.Explainer(model, background)
        got = explainer.explain(some).toPandas()
        assert list(got.columns) == [*some.columns, "base_value", "prediction", *[f"phi_{f}" for f in demand.FEATURES]]
        assert explainer.explain(some.limit(0)).count() == 0
        empty = explain.Explainer(model, background.limit(0)).explain(some).toPandas()
        assert len(empty) == 203 and empty.drop(columns=some.columns).isna().all().all()
        both.append(got.sort_values([*demand.FEATURES, "order_item_id"]).drop(columns="order_item_id").to_numpy(float))
    assert both[0].shape == (203, 14)
    np.testing.assert_allclose(*both, rtol=1e-9, atol=1e-9)


def test_importance_and_beeswarm(star, model):
    features = demand.encode(star.master, model.codes)
    rows = explain.importance(model, features, features, n=20).collect()
    assert len(rows) == 6 and [r.importance for r in rows] == sorted(r.importance for r in rows)
    items = demand.encode(star.master, model.codes, keep=("order_item_id",))
    swarm = explain.beeswarm(model, items, features, n=10)
    assert swarm.count() == 60 and swarm.select("order_item_id").distinct().count() == 10
    assert explain.beeswarm(model, items, features).count() == 6 * star.master.count()


def history(n, start=2023):
    return [f"{start + i // 12}-{i % 12 + 1:02d}" for i in range(n)]


def test_forecast_recovers_a_line():
    revenue = [1000.0 + 50 * i for i in range(24)]
    out = forecast.forecast_series(history(24), revenue, 6)
    assert list(out.month)[0] == "2025-01" and list(out.step) == [1, 2, 3, 4, 5, 6]
    assert list(out.forecasted_revenue) == pytest.approx([1000 + 50 * i for i in range(24, 30)], rel=1e-6)
    assert (out.lower_ci <= out.forecasted_revenue + 1e-6).all() and (out.upper_ci >= out.forecasted_revenue - 1e-6).all()


def test_forecast_band_widens_and_is_clamped():
    rng = np.random.default_rng(1)
    out = forecast.forecast_series(history(30), list(rng.normal(0, 100, 30)), 6)
    width = out.upper_ci - out.forecasted_revenue
    assert (width.diff().dropna() > 0).all() and (out.lower_ci >= 0).all()


def test_short_histories(spark):
    m = facts(spark, [{"order_date": f"{month}-05", "net_revenue": 10 * (i + 1)} for i, month in enumerate(history(5))])
    rows = [tuple(r) for r in forecast.forecast(m, horizon=2).collect()]
    assert rows == [("Future Month 1", 1, 30.0, 27.0, 33.0), ("Future Month 2", 2, 30.0, 27.0, 33.0)]
    seven = forecast.forecast_series(history(7), [1.0, 5, 2, 8, 3, 9, 4], 3)
    assert seven.lower_ci.isna().all() and seven.forecasted_revenue.notna().all()


def test_grouped_forecast_equals_the_group_alone(star):
    keys = ["region_name"]
    grouped = {(r.region_name, r.step): r.forecasted_revenue for r in forecast.forecast(star.master, keys).collect()}
    alone = forecast.forecast(star.master.filter("region_name = 'ASIA'")).collect()
    assert {("ASIA", r.step): r.forecasted_revenue for r in alone} == pytest.approx(
        {k: v for k, v in grouped.items() if k[0] == "ASIA"}
    )


def test_registered_trained_models(spark):
    """Anomalies are 6 %, and the trained centers fit the data better than the given ones do."""
    run = lambda name: QUERIES[name](spark, SF_DIR)
    anomalies = run("a4_leakage_anomalies").agg(F.avg("is_anomaly").alias("share"), F.sum("is_anomaly").alias("n")).first()
    assert anomalies.share == pytest.approx(0.06, abs=0.01)
    assert run("k15_leakage_kpis_with_anomalies").first().anomalies == anomalies.n
    assert run("k19_anomaly_audit").count() == min(30, anomalies.n)

    def cost(name):
        p = run(name).toPandas()
        x = p[segments.FEATURES].astype(float)
        x = (x - x.mean()) / x.std().replace(0, 1)
        return sum(((x[p.cluster == c] - x[p.cluster == c].mean()) ** 2).to_numpy().sum() for c in p.cluster.unique())

    assert cost("a2_customer_segments") < cost("a2_customer_segments_given_model")
    personas = run("a3_personas").collect()
    assert len({r.segment_name for r in personas}) == 4
    assert sum(r.customers for r in personas) == run("a2_customer_segments").count()
