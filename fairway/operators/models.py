"""Travel-time, risk and passability models with pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = [
    "avg_reported_speed", "std_reported_speed", "speed_cv", "avg_bearing", "bearing_sin", "bearing_cos", "avg_course_change", "std_course_change", "course_change_x_narrow", "is_peak", "is_weekend",
    "narrow", "rep_hour", "hour_sin", "hour_cos", "degree_from", "degree_to", "betweenness", "sample_count", "log_count", "narrow_x_peak", "course_change_x_peak",
]


def split(rows: DataFrame, key: list[str], parts: int = 5) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the key: the same in every run."""
    mark = F.pmod(F.xxhash64(*key), F.lit(parts))
    return rows.where(mark != 0), rows.where(mark == 0)


def candidates() -> dict[str, object]:
    """Estimators of the time ratio. Gradient-boosted trees stand for both boosting libraries, a Tweedie linear model for the Tweedie trees."""
    c = {"featuresCol": "scaled", "labelCol": "time_ratio", "predictionCol": "ratio"}
    return {
        "gbt": GBTRegressor(maxIter=20, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, seed=42, **c),
        "random_forest": RandomForestRegressor(numTrees=30, maxDepth=8, seed=42, **c),
        "tweedie": GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, maxIter=25, regParam=0.01, **c),
    }


def fit(rows: DataFrame, estimator) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="skip"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True), estimator]).fit(rows)


def evaluate(model: PipelineModel, rows: DataFrame) -> dict[str, float]:
    """MAE, RMSE, R2 and MAPE of travel times in seconds."""
    t = model.transform(rows).withColumn("predicted", F.greatest(F.lit(0.1), F.least(F.lit(20.0), F.col("ratio"))) * F.col("theoretical_time"))
    get = lambda m: RegressionEvaluator(labelCol="travel_time", predictionCol="predicted", metricName=m).evaluate(t)
    mape = t.agg(F.avg(F.abs(F.col("predicted") - F.col("travel_time")) / F.greatest("travel_time", F.lit(1e-6)) * 100)).first()[0]
    return {"mae": get("mae"), "rmse": get("rmse"), "r2": get("r2"), "mape": mape if mape is not None else float("nan")}


def compare(rows: DataFrame) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """(model, mae, rmse, r2, mape, is_best) on held-out rows, and the fitted models."""
    train, test = split(rows.where("time_ratio > 0"), ["u", "v", "time_period"])
    train, test = train.cache(), test.cache()
    fitted = {k: fit(train, e) for k, e in candidates().items()}
    scores = {k: evaluate(m, test) for k, m in fitted.items()}
    best = max(scores, key=lambda k: scores[k]["r2"])
    table = rows.sparkSession.createDataFrame([(k, *(float(s[x]) for x in ("mae", "rmse", "r2", "mape")), k == best) for k, s in scores.items()], "model string, mae double, rmse double, r2 double, mape double, is_best boolean")
    train.unpersist()
    test.unpersist()
    return table, fitted


def predict_hours(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(u, v, hour, model_time): the edge's features of its first time of day with the hour put in."""
    base = rows.withColumn("__n", F.row_number().over(_first(rows))).where("__n = 1").drop("__n")
    peak = F.col("hour").isin(6, 7, 8, 9, 17, 18, 19).cast("int")
    t = base.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumns({
        "rep_hour": F.col("hour"), "is_peak": peak, "hour_sin": F.sin(F.radians(F.col("hour") * 15.0)), "hour_cos": F.cos(F.radians(F.col("hour") * 15.0)),
        "narrow_x_peak": F.col("narrow") * peak, "course_change_x_peak": F.col("avg_course_change") * peak,
    })
    p = model.transform(t)
    return p.select("u", "v", "hour", (F.greatest(F.lit(0.1), F.least(F.lit(20.0), F.col("ratio"))) * F.col("theoretical_time")).alias("model_time"))


def _first(rows: DataFrame):
    from pyspark.sql.window import Window

    return Window.partitionBy("u", "v").orderBy(F.desc("sample_count"), "time_period")


RISK_FEATURES = ["depth", "channel_width", "clearance", "segment_count", "avg_distance", "avg_actual_speed", "length", "width", "draft", "height", "tonnage", "max_speed"]


def risk_rows(limits: DataFrame, features: DataFrame, ships: DataFrame, risk: DataFrame, passable: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Edges x ship types with rule risk and passability, replaced by implicit labels where there are any."""
    t = limits.join(features.select("u", "v", "segment_count", "avg_distance", "avg_actual_speed"), ["u", "v"], "left").na.fill(0, ["segment_count", "avg_distance", "avg_actual_speed"])
    t = t.crossJoin(F.broadcast(ships)).join(risk, ["u", "v", "ship_type"]).join(passable.select("u", "v", "ship_type", F.col("passable").cast("double").alias("passable")), ["u", "v", "ship_type"])
    if labels is not None:
        l = labels.select(F.col("from_node").alias("u"), F.col("to_node").alias("v"), "ship_type", F.when(F.col("passable") >= 0, F.col("passable").cast("double")).alias("lp"), F.col("risk_score").alias("lr"))
        t = t.join(l, ["u", "v", "ship_type"], "left").withColumns({"risk": F.coalesce("lr", "risk"), "passable": F.coalesce("lp", "passable")}).drop("lp", "lr")
    return t


def fit_risk(rows: DataFrame) -> PipelineModel:
    a = VectorAssembler(inputCols=RISK_FEATURES, outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[a, GBTRegressor(featuresCol="features", labelCol="risk", predictionCol="model_risk", maxIter=30, maxDepth=5, stepSize=0.1, seed=42)]).fit(rows)


def fit_passability(rows: DataFrame) -> PipelineModel:
    a = VectorAssembler(inputCols=RISK_FEATURES, outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[a, GBTClassifier(featuresCol="features", labelCol="passable", predictionCol="model_passable", maxIter=20, maxDepth=4, seed=42)]).fit(rows)
