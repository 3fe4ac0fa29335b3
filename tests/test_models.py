"""Fitted models against direct optimisation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import models as md


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=300) > 0.8).astype(int)
    return x, y


@pytest.fixture(scope="module")
def samples(spark, data):
    x, y = data
    return spark.createDataFrame([(i, [float(v) for v in row], int(t)) for i, (row, t) in enumerate(zip(x, y))], "id long, x array<double>, label int")


def newton(x, y, weights):
    """Minimum of sum(w * loss) + |coef|^2 / 2, intercept unpenalised."""
    design = np.column_stack([x, np.ones(len(x))])
    beta, penalty = np.zeros(design.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (weights * (p - y)) + penalty @ beta
        beta = beta - np.linalg.solve(design.T @ (design * (weights * p * (1 - p))[:, None]) + penalty, gradient)
    return beta


def test_balanced_logistic(data, samples):
    x, y = data
    weights = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    model = md.fit_logistic(samples, F.col("x"), "label")
    beta = newton(x, y, weights)
    assert np.allclose([*model.coefficients, model.intercept], beta, atol=1e-8)
    scored = md.logistic_scores(model, samples, F.col("x")).orderBy("id").collect()
    want = 1 / (1 + np.exp(-(x @ beta[:3] + beta[3])))
    assert np.allclose([r["score"] for r in scored], want, atol=1e-8)


def test_platt(data, samples):
    x, y = data
    scored = samples.select("label", F.element_at("x", 2).alias("score"))
    model = md.fit_platt(scored)
    assert np.allclose([*model.coefficients, model.intercept], newton(x[:, 1:2], y, np.ones(len(y))), atol=1e-8)


def test_calibrator_selection_prefers_platt_when_isotonic_merges(samples):
    rows = samples.select("label", (F.lit(1) / (1 + F.exp(F.element_at("x", 2)))).alias("score"))
    got = {r["method"]: r for r in md.select_calibrator(rows).collect()}
    assert got["platt"]["selected"] and not got["isotonic"]["preserves_ranking"]


def test_scaler(spark):
    rows = spark.createDataFrame([(1e9 + 1, 5.0), (1e9 + 3, 5.0)], "a double, b double")
    row = md.fit_scaler(rows, ["a", "b"]).first()
    assert row["mean"] == [1e9 + 2, 5.0] and row["scale"] == [1.0, 1.0]
    scaled = md.scale_states(rows, ["a", "b"], md.fit_scaler(rows, ["a", "b"])).collect()
    assert [r["a"] for r in scaled] == [-1.0, 1.0] and [r["b"] for r in scaled] == [0.0, 0.0]


def test_input_contract(spark):
    rows = spark.createDataFrame([([[1.0, 2.0]],), ([[1.0]],), ([[float("inf"), 1.0]],), (None,)], "x array<array<double>>")
    assert [r["ok"] for r in rows.select(md.meets_contract(F.col("x"), 1, 2).alias("ok")).collect()] == [True, False, False, False]


def test_top_features_of_zero_importance(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0])], "id long, v array<double>")
    top = md.top_features(md.feature_importance_rows(rows, ["id"], F.col("v"), ["f", "g"]), ["id"], 1).first()
    assert (top["feature"], top["relative_importance"], top["percentage"]) == ("f", 0.0, 0.0)


def test_coefficient_importance(spark, samples):
    model = md.fit_logistic(samples, F.col("x"), "label")
    got = [r["feature"] for r in md.coefficient_importance(spark, model, ["a", "b", "c"]).collect()]
    assert got == ["b", "a", "c"]


def test_fit_survives_steps_that_overshoot(spark):
    rows = [(i, [float(v)], int(v > 0)) for i, v in enumerate([-400.0, -300.0, -2.0, 1.0, 350.0, 500.0] * 5)]
    model = md.fit_logistic(spark.createDataFrame(rows, "id long, x array<double>, label int"), F.col("x"), "label", c=1e4)
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    design = np.column_stack([x, np.ones(len(x))])
    beta = np.array([*model.coefficients, model.intercept])
    slope = design.T @ (1e4 * (1 / (1 + np.exp(-design @ beta)) - y)) + beta * [1, 0]
    assert np.abs(slope).max() < 1e-3


def test_fit_needs_two_classes(spark):
    with pytest.raises(ValueError):
        md.fit_logistic(spark.createDataFrame([([1.0], 1)], "x array<double>, label int"), F.col("x"), "label")


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_gives_the_constant_model_where_asked(spark, label):
    rows = spark.createDataFrame([([1.0, -3.0], label, split) for split in ("train", "validation", "test")], "x array<double>, label int, split string")
    model = md.fit_logistic(rows, F.col("x"), "label", single_class=True)
    assert model.coefficients == (0.0, 0.0) and model.intercept == (np.inf if label else -np.inf)
    assert {r["score"] for r in md.logistic_scores(model, rows, F.col("x")).collect()} == {float(label)}
    got = md.logistic_operating_metrics(rows, F.col("x"), "label").first()
    assert got["recall"] == label and got["f1"] == label and got["roc_auc"] is None
    with pytest.raises(ValueError):
        md.fit_logistic(rows.limit(0), F.col("x"), "label", single_class=True)
