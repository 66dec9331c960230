"""Statistical downscaling baselines with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isopleth.functions.time import cyclic
from isopleth.grid import Grid
from isopleth.operators.conserve import block_mean, project_blocks

CYCLE = ("month_sin", "month_cos")


def feature_matrix(df: DataFrame, layers: Sequence[str], weight: str, valid: str, grid: Grid, coarse: bool) -> DataFrame:
    """Rows with all layers and two cyclic terms, on cells or pooled to blocks.

    Pooling treats invalid cells as absent.  The cycle uses month / 12.
    """
    sin, cos = cyclic("t", zero_based=False)
    ok = df.where(F.col(valid))
    rows = block_mean(ok, ["t"], layers, grid, weight) if coarse else ok
    return rows.withColumns({CYCLE[0]: sin, CYCLE[1]: cos}).dropna(subset=list(layers))


def fit(train: DataFrame, layers: Sequence[str], target: str, kind: str, trees: int = 200, seed: int = 42) -> PipelineModel:
    """Standardised linear regression or random forest."""
    assemble = VectorAssembler(inputCols=[*layers, *CYCLE], outputCol="_x")
    scale = StandardScaler(inputCol="_x", outputCol="features", withMean=True, withStd=True)
    if kind == "linear":
        model = LinearRegression(featuresCol="features", labelCol=target, predictionCol="raw")
    else:
        model = RandomForestRegressor(
            featuresCol="features",
            labelCol=target,
            predictionCol="raw",
            numTrees=trees,
            featureSubsetStrategy="sqrt",
            minInstancesPerNode=5,
            maxDepth=20,
            seed=seed,
        )
    return Pipeline(stages=[assemble, scale, model]).fit(train.dropna(subset=[target]))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).drop("_x", "features")


def close(predicted: DataFrame, target: DataFrame, target_col: str, grid: Grid, weight: str) -> DataFrame:
    """Add the whole block residual so block means equal the target."""
    return project_blocks(predicted, ["t"], "raw", target, target_col, grid, weight, passes=1)
