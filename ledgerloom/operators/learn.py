"""Models over lagged trade features, with Spark ML, validated forward in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import features

#: Inputs of models: nothing of them is known only after the trade. (``change`` of the features is: with ``prev`` it gives the result.)
INPUTS = ["prev", "prev_change", "nth_today", "mean5", "hour_sin", "hour_cos"]


def table(trades: DataFrame, *keys: str) -> DataFrame:
    """Feature rows: results of earlier trades, place in the day, hour as an angle; rows without history are left out."""
    f = features(trades, *keys)
    angle = F.col("hour") * 2 * 3.141592653589793 / 24
    return f.withColumns({"hour_sin": F.sin(angle), "hour_cos": F.cos(angle), "gain": (F.col("profit_loss") > 0).cast("double")}).na.drop(subset=["prev", "prev_change", "mean5"])


def forward_test(rows: DataFrame, cut: str, kinds: tuple[str, ...] = ("linear", "forest", "boosted")) -> DataFrame:
    """Trains every kind of model on entries before ``cut``; one row each with its error and hit rate after it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    made = {
        "linear": lambda: LinearRegression(labelCol="profit_loss", regParam=0.1, elasticNetParam=0.5),
        "forest": lambda: RandomForestRegressor(labelCol="profit_loss", numTrees=20, maxDepth=5, seed=7),
        "boosted": lambda: GBTRegressor(labelCol="profit_loss", maxIter=10, maxDepth=3, seed=7),
    }
    at = F.lit(cut).cast("timestamp")
    entry = F.col("entry_time").cast("timestamp")
    train, test = rows.filter(entry < at), rows.filter(entry >= at)
    out = None
    for kind in kinds:
        model = Pipeline(stages=[VectorAssembler(inputCols=INPUTS, outputCol="features"), made[kind]()]).fit(train)
        hit = (F.signum("prediction") == F.signum("profit_loss")).cast("double")
        row = model.transform(test).agg(F.lit(kind).alias("model"), F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("profit_loss"), 2))).alias("rmse"), F.avg(hit).alias("hit_rate"))
        out = row if out is None else out.unionByName(row)
    return out
