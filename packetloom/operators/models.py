"""Scaling, linear baselines, calibration, attribution and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.numeric import bind, clamp, finite_double, is_finite, log_clip, sigmoid
from packetloom.operators import newton
from packetloom.operators.isotonic import interpolate, isotonic_points
from packetloom.operators.newton import LinearModel
from packetloom.operators.ordered import beside, owned_rows, with_halo
from packetloom.session import cut_lineage

# Heavy-tailed features that are log-scaled.
HEAVY_TAILED = ("fwd_act_data_pkts__mean", "tot_fwd_pkts__mean", "subflow_fwd_pkts__mean", "fwd_header_len__mean")


def history_weights(labelled: DataFrame, keys: Sequence[str] = ("source_file",), history: int = 6) -> DataFrame:
    """How many training histories contain each window: their overlap, without building the histories."""
    used = (F.col("forecast_sample_eligible") & (F.col("split") == "train")).cast("int")
    spread, order = with_halo(labelled, keys, "window_index", 0, history - 1)
    return owned_rows(spread.withColumn("weight", F.sum(used).over(order.rowsBetween(0, history - 1))))


def fit_scaler(states: DataFrame, features: Sequence[str], weight: str | Column | None = None) -> DataFrame:
    """E1 + E44. One row (mean, scale): weighted mean and population deviation per feature, 0 read as 1.

    E1 weighs each state by :func:`history_weights`; E44 fits on training states once each. Two
    passes over the states, written once, keep the deviation exact for large means.
    """
    w = F.lit(1) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    rows = states.select(w.cast("double").alias("__w"), *[F.col(c).cast("double").alias(c) for c in features]).filter("__w > 0")
    rows = cut_lineage(rows)
    means = rows.agg(F.array(*[F.sum(F.col(c) * F.col("__w")) / F.sum("__w") for c in features]).alias("mean"))
    centred = beside(rows, means)
    spread = [F.sqrt(F.sum(F.col("__w") * F.pow(F.col(c) - F.get("mean", F.lit(i)), 2)) / F.sum("__w"))
              for i, c in enumerate(features)]
    scales = centred.agg(F.transform(F.array(*spread), lambda s: F.when(s == 0, 1.0).otherwise(s)).alias("scale"))
    return beside(means, scales)


def log_heavy_tails(states: DataFrame, heavy: Sequence[str] = HEAVY_TAILED) -> DataFrame:
    """E2. log1p of the clipped heavy-tailed features; fit and apply the scaler on the result."""
    return states.withColumns({c: log_clip(F.col(c).cast("double")) for c in heavy if c in states.columns})


def scale_states(states: DataFrame, features: Sequence[str], scaler: DataFrame) -> DataFrame:
    """Standardise wide feature columns with a fitted one-row scaler."""
    return beside(states, scaler.select("mean", "scale")).withColumns({
        c: (F.col(c) - F.get("mean", F.lit(i))) / F.get("scale", F.lit(i)) for i, c in enumerate(features)
    }).drop("mean", "scale")


def inverse_scale(states: DataFrame, features: Sequence[str], scaler: DataFrame) -> DataFrame:
    """E3."""
    return beside(states, scaler.select("mean", "scale")).withColumns({
        c: F.col(c) * F.get("scale", F.lit(i)) + F.get("mean", F.lit(i)) for i, c in enumerate(features)
    }).drop("mean", "scale")


def max_abs_scale(states: DataFrame, features: Sequence[str]) -> DataFrame:
    """F5. x / (1 + max|x|) per column, non-finite values as 0."""
    clean = {c: F.coalesce(finite_double(F.col(c)), F.lit(0.0)) for c in features}
    rows = states.withColumns(clean)
    peaks = rows.agg(*[F.max(F.abs(c)).alias(f"__m_{c}") for c in features])
    return beside(rows, peaks).withColumns({c: F.col(c) / (1 + F.col(f"__m_{c}")) for c in features}).drop(
        *[f"__m_{c}" for c in features])


def meets_contract(x: Column, history: int, features: int) -> Column:
    """E4. Whether a history has the right shape and only finite values."""
    shaped = (F.size(x) == history) & F.forall(x, lambda v: F.size(v) == features)
    return F.coalesce(shaped & F.forall(F.flatten(x), lambda v: F.coalesce(is_finite(v), F.lit(False))), F.lit(False))


def fit_logistic(samples: DataFrame, features: Column, label: str, balanced: bool = True, c: float = 1.0,
                 single_class: bool = False) -> LinearModel:
    """E5. L2 logistic regression, fitted by Newton rounds over the samples.

    ``features`` is an array column: a flattened history (E5) or the last state (E6). Samples of one
    class raise, or with ``single_class`` give the model that always predicts it.
    """
    return newton.fit(samples, features, label, balanced, c, single_class=single_class)


def logistic_scores(model: LinearModel, samples: DataFrame, features: Column, name: str = "score") -> DataFrame:
    """E5. The positive-class probability, as a plain column expression over the coefficients."""
    weights = F.array(*[F.lit(float(v)) for v in model.coefficients])
    margin = F.aggregate(F.zip_with(features, weights, lambda x, w: x * w), F.lit(float(model.intercept)), lambda a, v: a + v)
    return samples.withColumn(name, sigmoid(margin))


def last_state(x: str = "x") -> Column:
    """E6. The newest state of a history."""
    return F.element_at(x, -1)


def coefficient_importance(spark, model: LinearModel, names: Sequence[str]) -> DataFrame:
    """E7. Features by absolute coefficient."""
    rows = [(n, float(c), abs(float(c))) for n, c in zip(names, model.coefficients)]
    return spark.createDataFrame(rows, "feature string, coefficient double, importance double").orderBy(F.desc("importance"), "feature")


def score_with_model(rows: DataFrame, load: Callable, x: str, shape: Sequence[int], name: str = "score", batch_size: int = 512,
                     result: T.DataType | None = None) -> DataFrame:
    """E8. Score histories with a user model, loaded once per Python worker by ``load``.

    ``load`` returns a function from a numpy batch [n, *shape] to predictions [n] (or [n, k] with an
    array ``result``).
    """
    predict = predict_batch_udf(load, return_type=result or T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[list(shape)])
    return rows.withColumn(name, predict(F.flatten(x)))


def heuristic_risk(state: Column) -> Column:
    """E9. Sigmoid of the mean of the finite state values, the others read as 0."""
    clean = F.transform(state, lambda v: F.when(is_finite(v.cast("double")), v.cast("double")).otherwise(0.0))
    return sigmoid(F.aggregate(clean, F.lit(0.0), lambda a, v: a + v) / F.size(state))


def heuristic_forecast(states: DataFrame, state: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """E9. Forecast from the latest state of a stream: current and forecast risk, confidence."""
    latest = states.groupBy(*keys).agg(F.max_by(state, order).alias("__s"))
    risk = clamp(heuristic_risk(F.col("__s")))
    return latest.withColumn("__r", risk).select(
        *keys, F.round(F.col("__r") * 0.74, 2).alias("current_risk"), F.round("__r", 2).alias("forecasted_risk"),
        F.round(F.greatest(F.col("__r"), 1 - F.col("__r")), 2).alias("confidence"))


def feature_importance_rows(rows: DataFrame, keys: Sequence[str], values: Column, names: Sequence[str] | None = None) -> DataFrame:
    """One row per (keys, feature) from an array of importances."""
    named = F.posexplode(values).alias("feature_index", "importance")
    exploded = rows.select(*keys, named)
    if names is None:
        return exploded
    return exploded.withColumn("feature", F.get(F.array(*map(F.lit, names)), F.col("feature_index")))


def top_features(importances: DataFrame, keys: Sequence[str], k: int = 8) -> DataFrame:
    """T3 + T4. The k most important features per sample (or per sample and window), relative to the first.

    A key holds one row per feature, so its window is as short as the feature list.
    """
    ranked = Window.partitionBy(*keys).orderBy(F.desc("importance"), "feature_index")
    top = F.max("importance").over(Window.partitionBy(*keys))
    relative = F.col("importance") / F.when(top == 0, 1.0).otherwise(top)
    return importances.withColumns({"rank": F.row_number().over(ranked), "relative_importance": relative}).filter(
        F.col("rank") <= k).withColumn("percentage", F.round(F.col("relative_importance") * 100, 2))


def gradient_x_input(x: Column, weights: Column, intercept: float = 0.0) -> Column:
    """E37. |dp/dx * x| of a logistic scorer per cell: p(1-p)|w*x|, with x and weights as [window][feature] arrays."""
    def slope(products):
        p = sigmoid(F.aggregate(F.flatten(products), F.lit(float(intercept)), lambda a, v: a + v))
        return bind(p, lambda q: q * (1 - q))

    products = F.zip_with(x, weights, lambda row, ws: F.zip_with(row, ws, lambda v, w: v * w))
    return bind(products, lambda cells: bind(slope(cells), lambda k: F.transform(
        cells, lambda row: F.transform(row, lambda v: k * F.abs(v)))))


def mean_over_windows(attribution: Column) -> Column:
    """E37. Mean importance per feature over the history."""
    def mean(rows):
        rest = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
        total = F.aggregate(rest, F.get(rows, F.lit(0)), lambda a, row: F.zip_with(a, row, lambda p, q: p + q))
        return bind(F.size(rows), lambda n: F.transform(total, lambda v: v / n))

    return bind(attribution, mean)


def pick_samples(samples: DataFrame, negatives: int, positives: int, order: Sequence[str], label: str = "label") -> DataFrame:
    """T7. The first negatives and positives in key order: two ordered limits, no global window."""
    def first(value, n):
        return samples.filter(F.col(label) == value).orderBy(*order).limit(n)

    return first(0, negatives).unionByName(first(1, positives))


def fit_platt(validation: DataFrame, score: str = "score", label: str = "label") -> LinearModel:
    """E23. One-dimensional logistic regression on the validation scores."""
    return fit_logistic(validation, F.array(F.col(score).cast("double")), label, balanced=False)


def apply_platt(model: LinearModel, rows: DataFrame, score: str = "score", name: str = "calibrated") -> DataFrame:
    return logistic_scores(model, rows, F.array(F.col(score).cast("double")), name)


def fit_isotonic(validation: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """E24. Isotonic regression on validation scores, as the points of its steps."""
    return isotonic_points(validation, score, label)


def apply_isotonic(points: DataFrame, rows: DataFrame, score: str = "score", name: str = "calibrated") -> DataFrame:
    """E24. Interpolates between the fitted points and clips outside them."""
    return interpolate(points, rows, score, name)


def select_calibrator(validation: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """E25. Brier score and ranking check of both calibrators on validation, and the selected one.

    A calibrator that merges distinct scores is out; of the others the lower Brier score wins; with
    none left Platt is taken.
    """
    found = None
    fits = (("platt", apply_platt, fit_platt(validation, score, label)), ("isotonic", apply_isotonic, fit_isotonic(validation, score, label)))
    for name, apply, model in fits:
        mapped = apply(model, validation, score)
        gap = F.col("calibrated") - F.col(label)
        row = mapped.agg(F.lit(name).alias("method"), F.avg(gap * gap).alias("brier"),
                         (F.count_distinct("calibrated") >= F.count_distinct(score)).alias("preserves_ranking"))
        found = row if found is None else found.unionAll(row)
    best = found.agg(F.coalesce(F.min_by("method", F.when(F.col("preserves_ranking"), F.struct("brier", "method"))),
                                F.lit("platt")).alias("__best"))
    return beside(found, best).withColumn("selected", F.col("method") == F.col("__best")).drop("__best")


def logistic_operating_metrics(samples: DataFrame, features: Column, label: str, split: str = "split") -> DataFrame:
    """E5 end to end: fit on train, F1 threshold on validation, metrics and ranking on test.

    Training samples of one class give the constant model, as dense traffic has an attack in every horizon.
    """
    from packetloom.operators.scores import confusion, f1_threshold, ranking_metrics

    model = fit_logistic(samples.filter(F.col(split) == "train"), features, label, single_class=True)
    scored = cut_lineage(logistic_scores(model, samples, features).select(split, label, "score"))
    cut = f1_threshold(scored.filter(F.col(split) == "validation"), label=label).select("threshold")
    test = beside(scored.filter(F.col(split) == "test"), cut)
    at_cut = confusion(test, F.col("threshold"), label=label)
    return beside(beside(at_cut, cut), ranking_metrics(test, label=label))


def vector_column(column: str) -> Column:
    """An ML vector column as an array."""
    return vector_to_array(F.col(column))
