"""MLlib models behind point-in-time features and walk-forward validation."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import correlation_matrix, errors


def lagged(df: DataFrame, by: list[str], order: list[str], c: str, lags: tuple[int, ...]) -> DataFrame:
    """Earlier values of ``c`` as columns; rows read earlier rows alone."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"lag{k}": F.lag(c, k).over(w) for k in lags})


def prepared(features: list[str]) -> list:
    """Median imputation with an indicator for missing, and assembly, fitted on training rows alone."""
    filled = [f"_filled_{c}" for c in features]
    return [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled + [f"_no_{c}" for c in features], outputCol="_features")]


def walk_forward(df: DataFrame, features: list[str], target: str, period: str, folds: int, embargo: int = 1, rounds: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """Errors of boosted trees in each of the last ``folds`` periods, fitted on those before less the embargo."""
    rows = df.where(F.col(target).isNotNull()).select(*features, F.col(target).cast("double").alias(target), period, *(F.col(c).isNull().cast("double").alias(f"_no_{c}") for c in features))
    rows = rows.persist()  # every fold reads it
    last = [r[0] for r in rows.select(period).distinct().orderBy(F.desc(period)).limit(folds).collect()]
    out, found = [], df
    for at in sorted(last):
        train = rows.where(F.col(period) < at - embargo)
        tree = GBTRegressor(featuresCol="_features", labelCol=target, maxIter=rounds, maxDepth=depth, stepSize=0.1, maxBins=64, subsamplingRate=0.5, seed=seed)
        model = Pipeline(stages=[*prepared(features), tree]).fit(train)
        found = errors(model.transform(rows.where(F.col(period) == at)), "prediction", target).withColumn(period, F.lit(at))
        out += found.collect()  # one row a fold
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, found.schema) if out else df.sparkSession.createDataFrame([], f"{period} long")


def clusters(df: DataFrame, vector: str, k: int, seed: int = 7) -> DataFrame:
    """Add ``cluster`` by k-means over an array column; null vectors are left out."""
    rows = df.where(F.col(vector).isNotNull()).withColumn("_x", array_to_vector(vector))
    return KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(rows).transform(rows).drop("_x")


def components(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Principal components of the correlation matrix: share of variance and loadings, the largest positive."""
    r = np.eye(len(columns))
    for row in correlation_matrix(df, columns).collect():  # a square of the number of columns
        i, j = columns.index(row["a"]), columns.index(row["b"])
        r[i, j] = row["r"] if row["r"] is not None else float(i == j)
    values, vectors = np.linalg.eigh(r)
    out = []
    for n in range(k):
        v = vectors[:, -1 - n]
        v = v * np.sign(v[np.abs(v).argmax()])
        out.append((n, float(values[-1 - n] / len(columns)), [float(x) for x in v]))
    return df.sparkSession.createDataFrame(out, "component int, share double, loadings array<double>")


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    assembled = VectorAssembler(inputCols=columns, outputCol="_raw").transform(df.dropna(subset=columns))
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(assembled).transform(assembled).drop("_raw")
