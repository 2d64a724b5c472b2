"""Random-forest importances for one target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebin.operators.common import attach
from tidebin.operators.ordering import with_random_index


def fit_forest(
    df: DataFrame, target: str, features: Sequence[str], *, trees: int = 100, depth: int = 30, bins: int = 128, seed: int = 0
) -> RandomForestRegressionModel:
    """Bootstrapped regression trees that may use every feature at every split."""
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(
        df.select(F.col(target).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in features])
    )
    forest = RandomForestRegressor(
        numTrees=trees, maxDepth=depth, maxBins=bins, featureSubsetStrategy="all", seed=seed, maxMemoryInMB=1024
    )
    return forest.fit(rows.select("features", "label"))


def impurity_importance(model: RandomForestRegressionModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    """One row per named feature, summing to 1."""
    values = [(name, float(v)) for name, v in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(values, "feature string, importance double")


def permutation_importance(
    model: RandomForestRegressionModel,
    df: DataFrame,
    target: str,
    features: Sequence[str],
    ids: Sequence[str],
    *,
    repeats: int = 5,
    seed: int = 0,
) -> DataFrame:
    """Mean drop in R² when one feature's values are shuffled over the rows.

    Each repeat pairs every row with a random partner by an equi-join on row numbers; the
    partner lends one feature at a time. All features and repeats are scored in one pass.
    """
    y = F.col(target).cast("double").alias("__y")
    base = df.select(*ids, y, F.array(*[F.col(c).cast("double") for c in features]).alias("__x"))
    rounds = F.explode(F.array(*[F.lit(i) for i in range(repeats)])).alias("repeat")
    numbered = with_random_index(base, ids, seed, out="__i").select("*", rounds)
    lenders = with_random_index(
        base.select("*", rounds), ids, F.lit(seed + 1) + F.col("repeat"), ["repeat"], "__i"
    ).select("repeat", "__i", F.col("__x").alias("__other"))
    paired = numbered.join(lenders, ["repeat", "__i"])
    # -1 swaps nothing and is scored once, for comparison
    swap = F.explode(F.sequence(F.when(F.col("repeat") == 0, -1).otherwise(0), F.lit(len(features) - 1)))
    mixed = F.transform(
        F.col("__x"), lambda v, i: F.when(i == F.col("__swap"), F.col("__other")[i]).otherwise(v)
    )
    variants = paired.withColumn("__swap", swap).withColumn("features", array_to_vector(mixed))
    scored = model.transform(variants.select("repeat", "__swap", "__y", "features"))
    e = F.col("__y") - F.col("prediction")
    r2 = scored.groupBy("repeat", "__swap").agg((1 - F.avg(e * e) / F.nullif(F.var_pop("__y"), F.lit(0.0))).alias("__r2"))
    # at most repeats * features + 1 rows from here on
    unshuffled = r2.filter(F.col("__swap") < 0).select(F.col("__r2").alias("__full"))
    names = F.array(*[F.lit(c) for c in features])
    return (
        attach(r2.filter(F.col("__swap") >= 0), unshuffled, [])
        .groupBy(names[F.col("__swap")].alias("feature"))
        .agg(F.avg(F.col("__full") - F.col("__r2")).alias("importance"), F.count(F.lit(1)).alias("repeats"))
    )
