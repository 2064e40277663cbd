"""Forecast models with ``pyspark.ml``.

Fits aggregate over partitions (tree aggregation); predictions and scores stay distributed.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.numeric import ratio
from ..schema import DAY, PRODUCTION, SITE, TS
from ..session import checkpoint_dir, work_path
from .regression import complete

#: Rows that are worth a task of their own while trees grow.
ROWS_PER_TASK = 50_000


def temporal_split(df: DataFrame, last_n=180) -> DataFrame:
    """Flag the last ``last_n`` rows of each site."""
    newest = F.row_number().over(Window.partitionBy(SITE).orderBy(F.col(DAY).desc()))
    return df.withColumn("is_test", (newest <= last_n).cast("int"))


def share_split(df: DataFrame, share=0.2) -> DataFrame:
    """Flag the latest ``ceil(share * n)`` rows of each site."""
    w = Window.partitionBy(SITE)
    newest = F.row_number().over(w.orderBy(F.col(DAY).desc()))
    size = F.ceil(F.count(F.lit(1)).over(w) * F.lit(share))
    return df.withColumn("is_test", (newest <= size).cast("int"))


def _assembler(features, output="features"):
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="keep")


def linear(features, target=PRODUCTION):
    return Pipeline(stages=[
        _assembler(features, "raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LinearRegression(labelCol=target, predictionCol="prediction")])


def forest(features, target=PRODUCTION, trees=100, depth=10, seed=42):
    return Pipeline(stages=[_assembler(features), RandomForestRegressor(
        labelCol=target, numTrees=trees, maxDepth=depth, seed=seed)])


def boosted(features, target=PRODUCTION, rounds=100, rate=0.1, depth=3, seed=42):
    """Every tenth round is checkpointed, so a lost executor does not replay all of them."""
    return Pipeline(stages=[_assembler(features), GBTRegressor(
        labelCol=target, maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed,
        checkpointInterval=10)])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder, for several fits and predictions."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fit(pipeline: Pipeline, train: DataFrame):
    """Fit on the complete rows, cached in as many partitions as rows and cores call for.

    Trees take a job for each level, and each of its tasks sends the sums of all nodes: a task
    per shuffle partition would cost more than the rows.
    """
    spark = train.sparkSession
    checkpoint_dir(spark)
    first, last = pipeline.getStages()[0], pipeline.getStages()[-1]
    names = list(dict.fromkeys([*first.getInputCols(), last.getLabelCol()]))
    rows = train.dropna(subset=names).select(*names).persist()
    try:
        most = 2 * spark.sparkContext.defaultParallelism
        cached = rows.repartition(max(1, min(-(-rows.count() // ROWS_PER_TASK), most))).persist()
        try:
            cached.count()
            rows.unpersist()
            return pipeline.fit(cached)
        finally:
            cached.unpersist()
    finally:
        rows.unpersist()


def predict(model, df: DataFrame) -> DataFrame:
    """``df`` with predictions; rows that lack a feature keep their place and have none."""
    whole = complete(model.stages[0].getInputCols())
    scored = model.transform(df)
    return scored.withColumn("prediction", F.when(whole, F.col("prediction")))


def regression_metrics(predictions: DataFrame, by=(), actual=PRODUCTION, predicted="prediction"):
    """MAE, MSE, RMSE and R2 from sums, for all rows or per key."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    rows = predictions.where(y.isNotNull() & F.col(predicted).isNotNull())
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.var_pop(y).alias("_spread"))
    return sums.withColumns({
        "rmse": F.sqrt("mse"), "r2": F.when(F.col("_spread") > 0, F.lit(1.0)
                                            - F.col("mse") / F.col("_spread"))}).drop("_spread")


def feature_importance(model, features, spark: SparkSession) -> DataFrame:
    """Importance per feature, highest first, from a fitted tree pipeline."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(features, values), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(i + 1, f, float(v)) for i, (f, v) in enumerate(rows)],
                                 "rank INT, feature STRING, importance DOUBLE")


def top_importances(importance: DataFrame, n=15) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def compare_models(split: DataFrame, features, target=PRODUCTION, trees=100, rounds=100):
    """``(metrics, models)`` for linear, forest and boosted models; the lowest RMSE is best."""
    split = stored(split, "split")
    train, test = (split.where(F.col("is_test") == flag) for flag in (0, 1))
    makers = {"Linear Regression": linear(features, target),
              "Random Forest": forest(features, target, trees),
              "Gradient Boosting": boosted(features, target, rounds)}
    models, frames = {}, []
    for name, pipeline in makers.items():
        models[name] = fit(pipeline, train)
        scored = regression_metrics(predict(models[name], test), actual=target)
        frames.append(scored.withColumn("model", F.lit(name)))
    out = frames[0].unionByName(frames[1]).unionByName(frames[2])
    # three rows: ranked over one array, not over an unpartitioned window
    best = F.min(F.struct("rmse", "model"))["model"]
    listed = out.groupBy().agg(best.alias("best"), F.collect_list(F.struct(*out.columns)).alias("r"))
    listed = listed.select("best", F.inline("r"))
    return listed.withColumn("is_best", (F.col("model") == F.col("best")).cast("int")).drop(
        "best"), models


def train_forecaster(features: DataFrame, columns, target=PRODUCTION, rounds=200, depth=3,
                     last_n=180):
    """Boosted forecaster tested on each site's last rows: ``(model, test predictions)``."""
    split = stored(temporal_split(features, last_n), "split")
    model = fit(boosted(columns, target, rounds, depth=depth), split.where("is_test = 0"))
    return model, predict(model, split.where("is_test = 1"))


def forecast_daily(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy(SITE, F.to_date(TS).alias(DAY)).agg(
        F.sum("predicted_production").alias("predicted_production"),
        F.avg("temperature").alias("temperature"), F.avg("cloud_cover").alias("cloud_cover"))


def seasonal_naive(daily: DataFrame, target=PRODUCTION, n=7) -> DataFrame:
    """Deterministic predictor: mean of the previous ``n`` rows."""
    past = Window.partitionBy(SITE).orderBy(DAY).rowsBetween(-n, -1)
    return daily.withColumn("prediction", F.avg(target).over(past))


def residuals(predictions: DataFrame, actual=PRODUCTION) -> DataFrame:
    return predictions.withColumn("residual", F.col(actual) - F.col("prediction"))


# name -> condition on daily weather
CONDITIONS = {"sunny": "sunshine_hours > 8", "cloudy": "sunshine_hours < 4",
              "dry": "precipitation_mm <= 1", "all": "true"}


def accuracy_by_condition(predictions: DataFrame, large=10.0, actual=PRODUCTION) -> DataFrame:
    """MAE, MSE and R2 per weather condition, and days with an error above ``large`` kWh."""
    y, e = F.col(actual), F.col(actual) - F.col("prediction")
    rows = predictions.where(e.isNotNull())

    def one(name, text):
        ok = F.expr(text)
        return F.struct(
            F.lit(name).alias("condition"), F.count_if(ok).alias("days"),
            F.avg(F.when(ok, F.abs(e))).alias("mae"), F.avg(F.when(ok, e * e)).alias("mse"),
            F.var_pop(F.when(ok, y)).alias("spread"),
            F.count_if(ok & (F.abs(e) > large)).alias("large_errors"))

    out = rows.groupBy(SITE).agg(F.array(*[one(n, t) for n, t in CONDITIONS.items()]).alias("c"))
    return out.select(SITE, F.inline("c")).withColumn("r2", F.when(
        F.col("spread") > 0, F.lit(1.0) - F.col("mse") / F.col("spread"))).drop("spread", "mse")


def underperformance(predictions: DataFrame, gap=8.0, actual=PRODUCTION) -> DataFrame:
    """Days that fell short of the prediction by more than ``gap`` kWh."""
    short = F.col("prediction") - F.col(actual)
    return predictions.where(short > gap).withColumns({
        "production_gap": short, "production_loss_pct": ratio(short, "prediction") * F.lit(100.0),
        "month": F.month(DAY), "day_of_week": F.weekday(DAY)})


def underperformance_patterns(predictions: DataFrame, gap=8.0, actual=PRODUCTION) -> DataFrame:
    """Counts of short days in winter, heavy rain and heat, and their share of all days."""
    rows = predictions.where((F.col("prediction") - F.col(actual)).isNotNull())
    short = F.col("prediction") - F.col(actual)
    bad = short > gap
    return rows.groupBy(SITE).agg(
        F.count(F.lit(1)).alias("days"), F.count_if(bad).alias("short_days"),
        F.avg(F.when(bad, short)).alias("avg_gap"),
        F.avg(F.when(bad, F.col("temp_mean_c"))).alias("avg_temperature"),
        F.avg(F.when(bad, F.col("precipitation_mm"))).alias("avg_precipitation"),
        F.count_if(bad & F.month(DAY).isin(12, 1, 2)).alias("winter_days"),
        F.count_if(bad & (F.col("precipitation_mm") > 5)).alias("rainy_days"),
        F.count_if(bad & (F.col("temp_mean_c") > 30)).alias("hot_days")).withColumn(
        "short_pct", ratio("short_days", "days") * F.lit(100.0))
