"""Feature tables and a random-forest baseline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.scalars import ratio, round_even


def combine_features(parts: list[DataFrame], digits: int = 4) -> DataFrame:
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.select(*(round_even(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes))


def null_counts(rows: DataFrame) -> DataFrame:
    """(column, nulls), one row per column."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in rows.columns)))
    return rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns)).select(pairs.alias("p")).select("p.*")


def training_rows(features: DataFrame, targets: DataFrame, key: str, target: str) -> DataFrame:
    """Complete rows with their target; a null target raises."""
    checked = F.when(F.col(target).isNull(), F.raise_error(F.lit("target is missing")).cast("double")).otherwise(F.col(target))
    return features.join(targets.select(key, checked.alias(target)), key).dropna()


def forest(train: DataFrame, features: list[str], target: str, trees: int = 150, depth: int = 8, seed: int = 0):
    """Mean imputation, assembly and a random forest as one fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    filled = [f"{f}_filled" for f in features]
    stages = [
        Imputer(inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="features"),
        RandomForestRegressor(featuresCol="features", labelCol=target, predictionCol="prediction", numTrees=trees, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=stages).fit(train)


def regression_scores(rows: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    d = F.col(prediction) - F.col(target)
    out = rows.agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.sum(d * d).alias("res"), (F.var_pop(target) * F.count(target)).alias("tot"))
    return out.select("n", "mae", (1 - ratio("res", "tot")).alias("r2"))
