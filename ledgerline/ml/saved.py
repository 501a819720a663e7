"""Load a saved model, or train and save it when there is none."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def load_or_train(kind, spark: SparkSession, path: str, m: DataFrame):
    try:
        return kind.load(spark, path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    model = kind.train(m)
    model.save(path)
    return model
