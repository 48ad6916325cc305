"""Learned predictions: daily series and short trajectories, with baselines and metrics."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import destination, haversine_km, signed_turn
from ..sources.shared import settled
from .windows import lags, time_split

DAILY = ["lag_1", "lag_2", "lag_3", "lag_7", "day_of_week"]
MOTION = ["latitude", "longitude", "velocity", "track_sin", "track_cos", "vertical_rate", "baro_altitude", "turn_rate", "acceleration", "climb_trend"]


def fit(train: DataFrame, features: list[str], label: str, trees: int = 20, seed: int = 42):
    rows = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(train)
    return GBTRegressor(labelCol=label, maxIter=trees, maxDepth=3, stepSize=0.1, seed=seed, maxBins=32).fit(rows)


def predict(model, rows: DataFrame, features: list[str], name: str) -> DataFrame:
    out = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows)
    return model.transform(out).withColumnRenamed("prediction", name).drop("features")


def metrics(rows: DataFrame, actual: str, predictions: list[str]) -> DataFrame:
    """method, mae, rmse, mape of each prediction."""
    a = F.col(actual)
    out = rows.agg(*[F.struct(F.avg(F.abs(a - F.col(p))).alias("mae"), F.sqrt(F.avg(F.pow(a - F.col(p), 2))).alias("rmse"), F.avg(F.abs(a - F.col(p)) / F.abs(F.nullif(a, F.lit(0)))).alias("mape")).alias(p) for p in predictions])
    return out.select(F.inline(F.array(*[F.struct(F.lit(p).alias("method"), F.col(f"{p}.mae").alias("mae"), F.col(f"{p}.rmse").alias("rmse"), F.col(f"{p}.mape").alias("mape")) for p in predictions])))


def forecast(daily: DataFrame, key: str, day: str, value: str, steps: int = 7, trees: int = 20) -> DataFrame:
    """key, day, predicted, low, high for the next days of every series, each step feeding the next; all series at once."""
    daily = settled(daily.select(key, F.col(day).alias("d"), F.col(value).cast("double").alias("v")))
    model = fit(lags(daily, [key], "d", "v"), DAILY, "v", trees)
    known = daily
    for _ in range(steps):
        w = Window.partitionBy(key).orderBy(F.desc("d"))
        last = known.withColumn("i", F.row_number().over(w)).filter("i <= 7").groupBy(key).agg(F.max("d").alias("last"), *[F.max(F.when(F.col("i") == n, F.col("v"))).alias(f"lag_{n}") for n in (1, 2, 3, 7)])
        nxt = last.dropna().withColumn("d", F.date_add("last", 1)).withColumn("day_of_week", F.weekday("d"))
        known = settled(known.unionByName(predict(model, nxt, DAILY, "v").select(key, "d", "v")))
    new = known.join(daily.select(F.col(key).alias("__k"), F.col("d").alias("__d")), (F.col(key) == F.col("__k")) & (F.col("d") == F.col("__d")), "left_anti")
    return new.select(key, "d", F.col("v").alias("predicted"), F.round(F.greatest(F.col("v") * 0.8, F.lit(0.0)), 1).alias("low"), F.round(F.col("v") * 1.2, 1).alias("high"))


def importance(models: list, features: list[str]) -> list[tuple[str, float]]:
    """Features with their mean importance over models, the greatest first."""
    mean = [sum(float(m.featureImportances[i]) for m in models) / len(models) for i in range(len(features))]
    return sorted(zip(features, mean), key=lambda x: (-x[1], x[0]))


def judged(rows: DataFrame, actual: str, model: str, baselines: list[str]) -> DataFrame:
    """metrics of a model and its baselines, with wins_all: whether the model's MAE and RMSE are below all of theirs."""
    table = metrics(rows, actual, [model, *baselines])
    best = table.filter(F.col("method") != model).agg(F.min("mae").alias("a"), F.min("rmse").alias("r"))
    own = table.filter(F.col("method") == model).select(F.col("mae").alias("m"), F.col("rmse").alias("s"))
    return table.join(own.join(best).select(F.coalesce((F.col("m") < F.col("a")) & (F.col("s") < F.col("r")), F.lit(False)).alias("wins_all")))  # one row


def daily_quality(daily: DataFrame, key: str, day: str, value: str, trees: int = 20) -> DataFrame:
    """The daily model against yesterday's and last week's value, on the last fifth of the days."""
    rows = lags(daily.select(key, F.col(day).alias("d"), F.col(value).cast("double").alias("v")), [key], "d", "v")
    rows = settled(time_split(rows, ["d", key]))
    model = fit(rows.filter("is_train"), DAILY, "v", trees)
    return judged(predict(model, rows.filter("not is_train"), DAILY, "model"), "v", "model", ["lag_1", "lag_7"])


def with_phase(rows: DataFrame) -> DataFrame:
    """eval_phase: turning where the track turns by over one degree a second, else the flight phase."""
    return rows.withColumn("eval_phase", F.when(F.abs("turn_rate") > 1, "turning").otherwise(F.col("flight_phase")))


def motion_models(pairs: DataFrame, trees: int) -> list:
    rows = pairs.withColumns({"dlat": F.col("future_latitude") - F.col("latitude"), "dlon": F.col("future_longitude") - F.col("longitude")})
    return [fit(rows, MOTION, name, trees) for name in ("dlat", "dlon")]


def next_positions(pairs: DataFrame, states: DataFrame, trees: int = 100) -> DataFrame:
    """icao24, last_contact, predicted_latitude and _longitude of each aircraft from its last two sightings.

    The model is fitted on pairs (as in trajectory). Null where there is no second sighting, the two have the same time,
    or a feature is missing.
    """
    w = Window.partitionBy("icao24").orderBy(F.desc("time_position"), F.desc("event_id"))
    rows = states.withColumn("n", F.row_number().over(w)).filter("n <= 2").withColumns({"track_sin": F.sin(F.radians("true_track")), "track_cos": F.cos(F.radians("true_track"))})
    pick = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    cols = ["last_contact", "time_position", "latitude", "longitude", "velocity", "track_sin", "track_cos", "vertical_rate", "baro_altitude"]
    two = rows.groupBy("icao24").agg(*[pick(1, c).alias(c) for c in cols], *[pick(2, c).alias(f"b_{c}") for c in cols])
    dt = F.when(F.col("time_position") > F.col("b_time_position"), F.col("time_position") - F.col("b_time_position"))
    two = two.withColumns({
        "turn_rate": signed_turn(F.col("track_sin"), F.col("track_cos"), F.col("b_track_sin"), F.col("b_track_cos")) / dt,
        "acceleration": (F.col("velocity") - F.col("b_velocity")) / dt, "climb_trend": (F.col("vertical_rate") - F.col("b_vertical_rate")) / dt,
    })
    whole = two.dropna(subset=MOTION)
    for model, name in zip(motion_models(pairs, trees), ("p_lat", "p_lon")):
        whole = predict(model, whole, MOTION, name)
    known = whole.select(F.col("icao24").alias("k"), (F.col("latitude") + F.col("p_lat")).alias("predicted_latitude"), (F.col("longitude") + F.col("p_lon")).alias("predicted_longitude"))
    return two.select("icao24", "last_contact").join(known, F.col("icao24") == F.col("k"), "left").drop("k")


def ghost_trail(judged_pairs: DataFrame) -> DataFrame:
    """Where held-out aircraft were, where the model put them, and how far apart that is."""
    c = F.col
    return judged_pairs.select("event_id", "icao24", c("future_latitude").alias("actual_latitude"), c("future_longitude").alias("actual_longitude"), (c("latitude") + c("p_dlat")).alias("predicted_latitude"), (c("longitude") + c("p_dlon")).alias("predicted_longitude"), c("model_km").alias("error_km"))


def trajectory(pairs: DataFrame, trees: int = 100, min_pairs: int = 2000) -> DataFrame | None:
    """Held-out pairs with the errors (km) of the learned position and of dead reckoning over the same time.

    pairs: MOTION, last_contact, event_id, seconds, future_latitude, future_longitude, eval_phase. None if there are too few.
    """
    rows = settled(pairs.withColumns({"dlat": F.col("future_latitude") - F.col("latitude"), "dlon": F.col("future_longitude") - F.col("longitude")}))
    if rows.count() < min_pairs:
        return None
    rows = settled(time_split(rows, ["last_contact", "event_id"]))
    train, test = rows.filter("is_train"), rows.filter("not is_train")
    for name in ("dlat", "dlon"):
        test = predict(fit(train, MOTION, name, trees), test, MOTION, f"p_{name}")
    lat, lon = destination(F.col("latitude"), F.col("longitude"), F.col("velocity"), F.col("true_track"), F.col("seconds"))
    to = (F.col("future_latitude"), F.col("future_longitude"))
    return test.withColumns({"model_km": haversine_km(F.col("latitude") + F.col("p_dlat"), F.col("longitude") + F.col("p_dlon"), *to), "baseline_km": haversine_km(lat, lon, *to)})


def promote(history: DataFrame, metric: str) -> DataFrame:
    """Runs in order with whether each is better than all before it."""
    w = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row per run
    before = F.min(metric).over(w)
    return history.withColumn("promoted", before.isNull() | (F.col(metric) < before))
