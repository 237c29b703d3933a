"""Learned checks: a fee model, a distance rule and their combined verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollmill.functions.cleaning import safe_float, safe_int, weight_kg
from tollmill.operators import forest
from tollmill.operators.profiling import exact_percentiles, unpivot
from tollmill.operators.quality import field
from tollmill.session import freeze

FEATURES = ["vehicle_type", "pay_fee", "fee_mileage", "total_weight", "axle_count", "fee_per_km", "weight_per_axle"]


def feature_columns(df: DataFrame) -> dict[str, Column]:
    kind = safe_int(field(df, "vehicle_type", "1"), 1).cast("double")
    fee, mileage = safe_float(field(df, "pay_fee", 0)), safe_float(field(df, "fee_mileage", "0"))
    weight, axles = weight_kg(field(df, "total_weight", "0")), safe_int(field(df, "axle_count", "2"), 2).cast("double")
    return {
        "vehicle_type": kind, "pay_fee": fee, "fee_mileage": mileage, "total_weight": weight, "axle_count": axles,
        "fee_per_km": fee / (mileage + 1), "weight_per_axle": weight / (axles + 1),
    }


def features(df: DataFrame, prefix: str = "f_") -> DataFrame:
    """Adds the seven features as double columns."""
    return df.withColumns({prefix + name: c for name, c in feature_columns(df).items()})


def feature_vector(df: DataFrame, out: str = "features", prefix: str = "f_") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=[prefix + f for f in FEATURES], outputCol=out).transform(features(df, prefix))


def _fee_inputs(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=["f_vehicle_type", "f_fee_mileage"], outputCol="_x").transform(df)


def fit_fee_model(ref: DataFrame, trees: int = 100, depth: int = 5, step: float = 0.1, seed: int = 42):
    """Gradient-boosted trees for the fee given vehicle type and mileage, from rows where both amounts are positive.

    Under squared error the mean fee of equal inputs, weighted by their number, gives the same
    trees as the single rows. So the rows are first reduced to one per vehicle type and mileage,
    and the training set no longer grows with the table.
    """
    from pyspark.ml.regression import GBTRegressor

    rows = features(ref).filter((F.col("f_fee_mileage") > 0) & (F.col("f_pay_fee") > 0))
    means = rows.groupBy("f_vehicle_type", "f_fee_mileage").agg(
        F.avg("f_pay_fee").alias("f_pay_fee"), F.count(F.lit(1)).cast("double").alias("_rows")
    )
    gbt = GBTRegressor(
        featuresCol="_x", labelCol="f_pay_fee", predictionCol="predicted_fee", weightCol="_rows", maxIter=trees,
        maxDepth=depth, stepSize=step, seed=seed,
    )
    return gbt.fit(freeze(_fee_inputs(means).select("_x", "f_pay_fee", "_rows")))


def predict_fee(model, df: DataFrame) -> DataFrame:
    """Adds the predicted fee, and whether the fee is missing or more than half off."""
    out = model.transform(_fee_inputs(features(df)))
    off = F.abs(F.col("f_pay_fee") - F.col("predicted_fee")) / F.nullif(F.col("predicted_fee"), F.lit(0.0))
    odd = F.coalesce((F.col("f_pay_fee") <= 0) | (off > 0.5), F.lit(True))
    return out.withColumn("fee_anomalous", odd).drop("_x", *[f"f_{f}" for f in FEATURES])


def feature_stats(ref: DataFrame) -> DataFrame:
    """Mean and deviation of every feature, as one struct."""
    rows = features(ref)
    figures = []
    for name in FEATURES:
        c = F.col(f"f_{name}")
        figures += [F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std")]
    return rows.agg(F.struct(*figures).alias("stats"))


def with_distance(df: DataFrame, stats: Column, name: str = "distance") -> DataFrame:
    """Adds the sum of squared standard scores of the features against reference figures."""
    rows = features(df).withColumn("_stats", stats)
    total = F.lit(0.0)
    for f in FEATURES:
        mean, std = F.col("_stats")[f"{f}_mean"], F.col("_stats")[f"{f}_std"]
        z = (F.col(f"f_{f}") - mean) / F.nullif(std, F.lit(0.0))
        total = total + F.coalesce(F.pow(z, F.lit(2.0)), F.lit(0.0))
    return rows.withColumn(name, total).drop("_stats", *[f"f_{f}" for f in FEATURES])


def distance_anomaly(df: DataFrame, ref: DataFrame, contamination: float = 0.1) -> DataFrame:
    """Marks rows farther from the reference than all but ``contamination`` of the reference itself, in standard scores."""
    stats = freeze(feature_stats(ref)).select("stats").scalar()
    distances = unpivot(with_distance(ref, stats), {"distance": F.col("distance")}, "double")
    limit = exact_percentiles(distances, [1.0 - contamination]).select("percentile").scalar()
    scored = with_distance(df, stats).withColumn("_limit", limit)
    confidence = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("distance") / F.col("_limit") - 1.0))
    return scored.withColumns({"distance_anomalous": F.col("distance") > F.col("_limit"), "confidence": confidence}).drop("_limit")


def isolation_anomaly(df: DataFrame, ref: DataFrame, contamination: float = 0.1, key: str = "gantry_transaction_id", way: str | None = None) -> DataFrame:
    """Marks rows that an isolation forest over the reference sets apart sooner than all but ``contamination`` of the reference."""
    return forest.isolation_anomaly(df, ref, feature_columns(ref), key, contamination, way=way)


def verify(df: DataFrame, ref: DataFrame, model=None, contamination: float = 0.1) -> DataFrame:
    """Combined verdict: anomalous if either check says so, confidence 0 for an odd fee, which is replaced."""
    model = fit_fee_model(ref) if model is None else model
    checked = distance_anomaly(predict_fee(model, df), ref, contamination)
    odd = F.col("fee_anomalous")
    guess = F.col("predicted_fee").try_cast("bigint")
    return checked.withColumns(
        {
            "_auxiliary_result": F.when(odd | F.col("distance_anomalous"), "anomalous").otherwise("reasonable"),
            "_auxiliary_confidence": F.when(odd, 0.0).otherwise(F.col("confidence")),
            "pay_fee": F.when(odd, guess.cast(df.schema["pay_fee"].dataType)).otherwise(F.col("pay_fee")),
            "_discriminative_corrected": F.when(odd, "pay_fee"),
        }
    ).drop("confidence")
