"""Demand per order item: encoded features, random forest, scenario scoring."""

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.exprs import uniform
from ledgerline.functions.ranking import running_number
from ledgerline.ml import forest as cells
from ledgerline.ml.saved import load_or_train
from ledgerline.schemas import DEMAND_FEATURES as FEATURES
from ledgerline.session import materialize

LABELLED = {"category": "category", "region_id": "region_name", "sales_channel": "sales_channel"}

# Label codes and the cost share of each category's price.
CODES = {
    "category": {"Software": 0, "Hardware": 1, "Consulting": 2, "Support": 3},
    "region_id": {"North America": 0, "Europe": 1, "Asia-Pacific": 2, "Latin America": 3},
    "sales_channel": {"Direct": 0, "Online": 1, "Partner": 2},
}
COST_SHARE = {"Software": 0.2, "Hardware": 0.63, "Consulting": 0.58, "Support": 0.45}
OTHER_COST_SHARE = 0.5

CODE_SCHEMA = "feature string, label string, code int"
#: More rows than these are counted by cell and label before trees are grown: MLlib keeps a weight for every row and tree.
MOST_ROWS = 2_000_000


def fixed_codes(spark: SparkSession) -> DataFrame:
    """The table of CODES."""
    rows = [(f, label, code) for f, labels in CODES.items() for label, code in labels.items()]
    return spark.createDataFrame(rows, CODE_SCHEMA)


def codes_from(m: DataFrame) -> DataFrame:
    """Codes 0, 1, ... of the sorted labels that occur, for data with its own labels; as many as there are."""
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(c).alias("label")) for f, c in LABELLED.items()])
    labels = m.select(F.inline(entries)).where("label IS NOT NULL").distinct().withColumn("all", F.lit(0))
    numbered = running_number(labels, "feature", "all", "label", "n")
    return materialize(numbered.select("feature", "label", (F.col("n") - 1).cast("int").alias("code")), "codes")


def encode(df: DataFrame, codes: DataFrame, unknown: int = -1, keep: tuple[str, ...] = ()) -> DataFrame:
    """The six model features as doubles, beside the columns in ``keep``; labels are joined with their codes."""
    for f, c in LABELLED.items():
        known = codes.where(F.col("feature") == f).select(F.col("label").alias(f"_label_{f}"), F.col("code").alias(f"_code_{f}"))
        df = df.join(known, F.col(c) == F.col(f"_label_{f}"), "left")
    coded = {f: F.coalesce(F.col(f"_code_{f}"), F.lit(unknown)).cast("double") for f in LABELLED}
    plain = {
        "unit_price": F.coalesce(F.col("unit_price").cast("double"), F.lit(0.0)),
        "discount_percentage": F.coalesce(F.col("discount_percentage").cast("double"), F.lit(0.0)),
        "month_num": F.coalesce(F.col("month_num").cast("double"), F.lit(1.0)),
    }
    both = coded | plain
    return df.select(*[F.col(c) for c in keep], *[both[f].alias(f) for f in FEATURES])


def training_rows(m: DataFrame, codes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    labelled = m.withColumn("label", F.coalesce(F.col("quantity").cast("double"), F.lit(1.0)))
    return encode(labelled, codes, keep=("label", *keep))


def scenario_economics(df: DataFrame, quantity: str = "quantity") -> DataFrame:
    """Sales after discount, estimated cost and what remains, for a quantity at a price."""
    q, price = F.col(quantity).cast("double"), F.col("unit_price").cast("double")
    share = F.coalesce(
        F.create_map(*[F.lit(x) for pair in COST_SHARE.items() for x in pair])[F.col("category")],
        F.lit(OTHER_COST_SHARE),
    )
    return df.withColumns(
        {
            "gross_sales": q * price * (1 - F.col("discount_percentage").cast("double")),
            "cost": q * price * share,
        }
    ).withColumn("net_profit", F.col("gross_sales") - F.col("cost"))


@dataclass
class DemandModel:
    forest: RandomForestRegressionModel
    codes: DataFrame
    metrics: dict[str, float] = field(default_factory=dict)

    @classmethod
    def train(
        cls, m: DataFrame, codes: DataFrame | None = None, trees: int = 100, depth: int = 8, seed: int = 42
    ) -> "DemandModel":
        """Fit on 80 percent drawn by a hash of the item, measure on the rest. Codes default to the labels found."""
        codes = codes_from(m) if codes is None else codes
        draw = uniform("order_item_id", seed=seed) < 0.8
        rows = training_rows(m.withColumn("fit", draw), codes, keep=("fit",))
        estimator = RandomForestRegressor(
            numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all", maxMemoryInMB=1024, cacheNodeIds=True
        )
        many = m.count()
        if many > MOST_ROWS:
            cuts = cells.find_cuts(rows.where("fit"), FEATURES, min(1.0, cells.CUT_ROWS / (0.8 * many)), seed)
            counts = cells.Counts.of(rows, FEATURES, cuts)
            if counts.cells() <= cells.CELLS:
                return cls._of_counts(counts, estimator, codes)
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        forest = estimator.fit(rows.where("fit").select("features", "label"))
        test = forest.transform(rows.where("NOT fit")).select("label", "prediction")
        error = F.col("label") - F.col("prediction")
        row = test.agg(
            F.sqrt(F.avg(error * error)).alias("rmse"),
            (1 - F.try_divide(F.sum(error * error), F.regr_syy("label", F.lit(1.0)))).alias("r2"),
            F.count("*").alias("test_rows"),
        ).first()
        return cls(forest, codes, {k: float(v) if v is not None else float("nan") for k, v in row.asDict().items()})

    @classmethod
    def _of_counts(cls, counts: cells.Counts, estimator: RandomForestRegressor, codes: DataFrame) -> "DemandModel":
        """The same from counts: a cell's rows have one prediction, so the measures come from sums of their labels."""
        model = cls(cells.grow(counts, estimator), codes)
        p, n, total, squares = (F.col(c) for c in ("prediction", "n", "total", "squares"))
        row = model.predict(counts.others()).agg(
            F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"),
            F.sum(squares - 2 * p * total + p * p * n).alias("error"),
        ).first()
        test_rows = float(row.n or 0)
        spread = row.squares - row.total**2 / test_rows if test_rows else 0.0
        model.metrics = {
            "rmse": (row.error / test_rows) ** 0.5 if test_rows else float("nan"),
            "r2": 1 - row.error / spread if spread else float("nan"),
            "test_rows": test_rows,
        }
        return model

    def predict(self, features: DataFrame) -> DataFrame:
        """Add ``prediction`` to encoded feature rows."""
        vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
        return self.forest.transform(vector.transform(features)).drop("features")

    def score(self, scenarios: DataFrame) -> DataFrame:
        """Predicted quantity (at least 1, two digits) and economics of each scenario.

        Scenarios have category, unit_price, discount_percentage, region_name,
        sales_channel and month_num; here an unknown label counts as code 0.
        """
        given = scenarios.select(F.struct("*").alias("given"), "*")
        predicted = self.predict(encode(given, self.codes, unknown=0, keep=("given",)))
        quantity = F.greatest(F.lit(1.0), F.round("prediction", 2))
        return scenario_economics(predicted.select("given.*", quantity.alias("predicted_quantity")), "predicted_quantity")

    def save(self, path: str) -> None:
        self.forest.write().overwrite().save(f"{path}/model")
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "DemandModel":
        codes = spark.read.schema(CODE_SCHEMA).parquet(f"{path}/codes")
        return cls(RandomForestRegressionModel.load(f"{path}/model"), codes)

    @classmethod
    def load_or_train(cls, spark: SparkSession, path: str, m: DataFrame) -> "DemandModel":
        return load_or_train(cls, spark, path, m)


def scenario_grid(m: DataFrame, discounts: list[float], price_factors: list[float], months: list[int]) -> DataFrame:
    """Scenarios around the mean price of each category, region and channel that occurs."""
    keys = ["category", "region_name", "sales_channel"]
    base = m.groupBy(*keys).agg((F.sum("unit_price") / F.count("unit_price")).cast("double").alias("mean_price"))
    each = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    return (
        base.withColumn("factor", each(price_factors))
        .withColumn("discount_percentage", each(discounts))
        .withColumn("month_num", each(months))
        .withColumn("unit_price", F.round(F.col("mean_price") * F.col("factor"), 2))
        .select(*keys, "unit_price", "discount_percentage", "month_num")
    )
