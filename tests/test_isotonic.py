"""Isotonic fits cut by value, against the max-min formula."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import isotonic as iso

SCHEMA = "score double, label double"


def brute(rows):
    """Fit at each distinct score: the largest mean from a start of the least mean to an end."""
    scores = sorted({s for s, _ in rows})
    sums = np.array([sum(y for s, y in rows if s == x) for x in scores])
    counts = np.array([sum(1 for s, _ in rows if s == x) for x in scores])
    cs, cn = np.append(0, np.cumsum(sums)), np.append(0, np.cumsum(counts))
    n = len(scores)
    mean = [[(cs[j + 1] - cs[i]) / (cn[j + 1] - cn[i]) if j >= i else np.inf for j in range(n)] for i in range(n)]
    least = [[min(mean[i][j:]) for j in range(n)] for i in range(n)]
    return {scores[k]: max(least[i][k] for i in range(k + 1)) for k in range(n)}


def check(spark, rows, **how):
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    points = iso.isotonic_points(table, **how)
    got = {r["score"]: r["calibrated"] for r in iso.interpolate(points, table.select("score").distinct()).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s], abs=1e-12) for s in want)
    return points


def noisy(count, seed):
    rng = np.random.default_rng(seed)
    scores = rng.integers(0, 150, count) / 150
    return [(float(s), float(rng.random() < s)) for s in scores]


def test_one_piece(spark):
    check(spark, noisy(400, 1))


@pytest.mark.parametrize("steps", [2, 64])
def test_many_rounds_with_a_hot_score(spark, steps):
    rows = noisy(300, 2) + [(0.5, float(i % 3 == 0)) for i in range(300)]
    check(spark, rows, piece=7, steps=steps)


def test_falling_labels_are_one_pool(spark):
    rows = [(i / 60, float(i < 25)) for i in range(60)]
    points = check(spark, rows, piece=5)
    assert points.count() == 2


def test_rising_labels_stay(spark):
    check(spark, [(i / 40, i * i / 7) for i in range(40)], piece=4, steps=3)


def test_between_and_outside(spark):
    table = spark.createDataFrame([(0.2, 0.0), (0.4, 0.0), (0.6, 1.0)], SCHEMA)
    asked = spark.createDataFrame([(0.0,), (0.3,), (0.5,), (0.9,), (None,), (float("nan"),), (0.5,)], "score double")
    got = iso.interpolate(iso.isotonic_points(table), asked).collect()
    assert len(got) == 7
    values = {r["score"]: r["calibrated"] for r in got if r["score"] is not None and r["score"] == r["score"]}
    assert values == {0.0: 0.0, 0.3: 0.0, 0.5: pytest.approx(0.5), 0.9: 1.0}
    assert [r["calibrated"] for r in got if r["score"] is None or r["score"] != r["score"]] == [None, None]


def test_no_rows(spark):
    table = spark.createDataFrame([(None, 1.0), (0.5, None)], SCHEMA)
    points = iso.isotonic_points(table)
    assert points.count() == 0
    assert [r["calibrated"] for r in iso.interpolate(points, table).collect()] == [None, None]


def test_no_task_holds_all_scores(spark):
    """Pieces are bounded by the distinct scores in them, whatever the number of rows."""
    table = spark.range(20_000).select((F.col("id") % 5_000 / 5_000).alias("score"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    points = iso.isotonic_points(table, piece=500)
    fitted = iso.interpolate(points, table.select("score").distinct()).orderBy("score").collect()
    values = [r["calibrated"] for r in fitted]
    assert len(values) == 5_000 and all(a <= b + 1e-12 for a, b in zip(values, values[1:]))
