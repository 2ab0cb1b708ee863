"""Stacked models validated forward in time, and permutation importance of their inputs."""

from __future__ import annotations

from pyspark.ml import Model, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.lineage import cut

from .learn import INPUTS
from .resample import permuted_place, shuffled

KINDS = ("linear", "forest")


def pipeline(kind: str, inputs: list[str], target: str) -> Pipeline:
    made = {
        "linear": lambda: LinearRegression(featuresCol="_features", labelCol=target, regParam=0.1),
        "forest": lambda: RandomForestRegressor(featuresCol="_features", labelCol=target, numTrees=10, maxDepth=4, seed=7),
    }
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="_features"), made[kind]()])


def in_blocks(rows: DataFrame, blocks: int, at: str = "entry_time") -> DataFrame:
    """Adds ``block``, 0 to ``blocks`` - 1: stretches of time that hold about equally many rows. Rows of one time are of one block."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    edges = rows.agg(F.percentile_approx(t, F.array(*[F.lit(k / blocks) for k in range(1, blocks)]), F.lit(10_000)).alias("e")).first()["e"] or []
    block = sum([(t > F.lit(e)).cast("int") for e in edges], F.lit(0))
    return rows.withColumn("block", block)


def forward_predictions(blocked: DataFrame, blocks: int, inputs: list[str] | None = None, target: str = "profit_loss", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Rows of the blocks from the second on with a column of predictions per kind of model. The model of a block is trained on the
    blocks before it, so no prediction knows its row's time or later."""
    inputs = inputs or INPUTS
    out = None
    for k in range(1, blocks):
        part = blocked.filter(F.col("block") == k)
        past = blocked.filter(F.col("block") < k)
        for kind in kinds:
            part = pipeline(kind, inputs, target).fit(past).transform(part).drop("_features").withColumnRenamed("prediction", kind)
        out = part if out is None else out.unionByName(part)
    return out


def stacked(predicted: DataFrame, blocks: int, target: str = "profit_loss", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The last block's rows with three mixtures of the kinds' predictions: their ``mean``, ``weighted`` by one over the squared error
    in the blocks between, and ``stack``, a linear model of those blocks' out-of-fold predictions."""
    between, last = predicted.filter(F.col("block") < blocks - 1), predicted.filter(F.col("block") == blocks - 1)
    errors = between.agg(*[F.avg(F.pow(F.col(k) - F.col(target), F.lit(2.0))).alias(k) for k in kinds]).first()
    weights = {k: 1.0 / max(errors[k] or 1.0, 1e-12) for k in kinds}
    mix = lambda w: sum([F.col(k) * (w[k] / sum(w.values())) for k in kinds], F.lit(0.0))
    meta = pipeline("linear", list(kinds), target).fit(between)
    return meta.transform(last.withColumns({"mean": mix(dict.fromkeys(kinds, 1.0)), "weighted": mix(weights)})).drop("_features").withColumnRenamed("prediction", "stack")


def compared(rows: DataFrame, models: list[str], target: str = "profit_loss") -> DataFrame:
    """One row a model: n, root of the mean squared error, mean absolute error, share of right signs."""
    long = rows.select(F.col(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("x")) for m in models])).alias("m")).select("y", "m.*")
    gap = F.col("x") - F.col("y")
    return long.groupBy("model").agg(F.count("*").alias("n"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"), F.avg((F.signum("x") == F.signum("y")).cast("double")).alias("hit_rate"))


def stacking_test(rows: DataFrame, blocks: int = 4, inputs: list[str] | None = None, target: str = "profit_loss", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Single models and their mixtures on the last of ``blocks`` stretches of time."""
    blocked = cut(in_blocks(rows, blocks))
    tested = stacked(cut(forward_predictions(blocked, blocks, inputs, target, kinds)), blocks, target, kinds)
    return compared(tested, [*kinds, "mean", "weighted", "stack"], target)


def permutation_importance(model: Model, rows: DataFrame, inputs: list[str], row_id: str, target: str = "profit_loss", repeats: int = 3, seed: int = 42) -> DataFrame:
    """By input: how much the mean squared error grows when the input's values are dealt anew among the rows, mean and sigma of
    ``repeats``.

    Every row takes the value of the row at the place that a keyed permutation gives, so all inputs and repeats are one join on
    (input, place), and one pass of the model.
    """
    placed = cut(shuffled(rows.select(row_id, target, *inputs).withColumn("_all", F.lit("all")), "_all", row_id, seed))
    values = placed.select(F.col("place").alias("to"), F.explode(F.array(*[F.struct(F.lit(c).alias("input"), F.col(c).cast("double").alias("other")) for c in inputs])).alias("x")).select("to", "x.*")
    asked = placed.withColumn("input", F.explode(F.array(*[F.lit(c) for c in inputs]))).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    asked = asked.withColumn("to", permuted_place(F.col("place"), F.col("size"), seed, F.col("repeat"), F.col("input")))
    dealt = asked.join(values, ["input", "to"]).withColumns({c: F.when(F.col("input") == c, F.col("other")).otherwise(F.col(c)) for c in inputs})
    error = lambda df, *by: model.transform(df).groupBy(*by).agg(F.avg(F.pow(F.col("prediction") - F.col(target), F.lit(2.0))).alias("mse"))
    base = error(placed).withColumnRenamed("mse", "base")
    grown = error(dealt, "input", "repeat").crossJoin(F.broadcast(base)).withColumn("growth", F.col("mse") - F.col("base"))
    return grown.groupBy("input").agg(F.avg("growth").alias("importance"), F.stddev_samp("growth").alias("sigma"))
