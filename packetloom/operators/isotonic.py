"""E24. Isotonic regression whose work is cut by value, so that no task holds all scores.

The fit over distinct scores in order is the least-squares non-decreasing step function.  For any
threshold t, the scores whose fit is at most t are those up to the position where the running sum
of ``weight * (label - t)`` is least.  One aggregation therefore cuts the order at many thresholds
at once, and the parts are independent: no pool reaches across such a cut.  Ranges that are still
larger than a piece are cut again at thresholds between their own bounds; a range that its own mean
does not cut is one pool.  What remains is pooled piece by piece.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.ordered import add_value_bucket, running_totals, value_buckets
from packetloom.session import cut_lineage

POSITION, START = "__at", "__start"
BROADCAST_RANGES = 20_000  # of at most 64 cuts each: 10 MB
POINTS = "score double, calibrated double"


def _pool(piece: pd.DataFrame) -> pd.DataFrame:
    """Pool adjacent violators over one piece; the first and last score of every pool."""
    piece = piece.sort_values(POSITION)
    scores, weights, sums = (piece[c].to_numpy(np.float64) for c in ("score", "weight", "label_sum"))
    first, weight, total = [], [], []
    for i in range(len(scores)):
        at, w, s = i, weights[i], sums[i]
        while first and total[-1] * w >= s * weight[-1]:
            at, w, s = first.pop(), w + weight.pop(), s + total.pop()
        first.append(at)
        weight.append(w)
        total.append(s)
    last = np.append(np.array(first[1:], dtype=np.int64) - 1, len(scores) - 1)
    ends = pd.DataFrame({"score": np.concatenate([scores[first], scores[last]]),
                         "calibrated": np.tile(np.array(total) / np.array(weight), 2)})
    return ends.drop_duplicates("score")


def _with_range_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Join one written row per range; a range may hold all rows, so few enough of them are broadcast."""
    return rows.join(F.broadcast(facts) if facts.count() <= BROADCAST_RANGES else facts, START)


def _cut_ranges(rows: DataFrame, steps: int) -> DataFrame:
    """Cut every range at thresholds between its least and largest mean label, and at its own mean.

    One row per range reaches the join: an open range holds more than a piece of rows, so their
    number is bounded by rows / piece, and a range of many rows sends one partial row per task.
    """
    mean = F.col("label_sum") / F.col("weight")
    bounds = cut_lineage(rows.groupBy(START).agg(
        F.min(mean).alias("__lo"), F.max(mean).alias("__hi"), (F.sum("label_sum") / F.sum("weight")).alias("__mean"),
        F.min(F.col("cum_sum") - F.col("label_sum")).alias("__s0"), F.min(F.col("cum_weight") - F.col("weight")).alias("__w0")))
    joined = _with_range_facts(rows, bounds)
    lo, hi = F.col("__lo"), F.col("__hi")
    thresholds = [F.col("__mean"), *[lo + (hi - lo) * (k / steps) for k in range(1, steps)]]
    sums, weights = F.col("cum_sum") - F.col("__s0"), F.col("cum_weight") - F.col("__w0")
    # The start of a range counts as a position of value 0: nothing of the range is at most t.
    found = joined.groupBy(START).agg(F.max(POSITION).alias("__end"), *[
        F.min(F.struct((sums - t * weights).alias("v"), (-F.col(POSITION)).alias("p"))).alias(f"__t{k}")
        for k, t in enumerate(thresholds)])
    inside = F.array(*[F.when(F.col(f"__t{k}.v") <= 0, -F.col(f"__t{k}.p")) for k in range(len(thresholds))])
    cuts = found.select(START, F.array_distinct(F.filter(
        F.array_compact(inside), lambda p: p < F.col("__end"))).alias("__cuts"))
    placed = _with_range_facts(rows, cut_lineage(cuts))
    below = F.array_max(F.filter("__cuts", lambda p: p < F.col(POSITION)))
    return placed.withColumn("__closed", F.size("__cuts") == 0).withColumn(START, F.coalesce(below + 1, F.col(START))).drop("__cuts")


def isotonic_points(samples: DataFrame, score: str = "score", label: str = "label", piece: int = 1_000_000,
                    steps: int = 64) -> DataFrame:
    """E24. The fitted function as points (score, calibrated): first and last score of every pool.

    Rows with a NULL or NaN score or a NULL label are left out; without any row there are no points.
    ``piece`` bounds the distinct scores that one task pools (twice that where a range begins late in
    its piece); larger single pools never reach a task, they are sums.
    """
    value, target = F.col(score).cast("double"), F.col(label).cast("double")
    pooled = cut_lineage(samples.select(value.alias("score"), target.alias("label")).filter(
        "score IS NOT NULL AND NOT isnan(score) AND label IS NOT NULL").groupBy("score").agg(
        F.sum("label").alias("label_sum"), F.count("*").cast("double").alias("weight")))
    bucketed = add_value_bucket(pooled, "score", buckets=value_buckets(pooled))
    rows = running_totals(bucketed, [], ["score"], F.col("__vb"), {
        "cum_sum": F.col("label_sum"), "cum_weight": F.col("weight"), POSITION: F.lit(1).cast("long")})
    open_rows = cut_lineage(rows.drop("__vb").withColumn(START, F.lit(1).cast("long")))
    done, size = [], open_rows.count()
    if size <= piece:
        done.append(open_rows)
    single = []
    while size > piece:
        cut = cut_lineage(_cut_ranges(open_rows, steps))
        single.append(cut.filter("__closed").groupBy(START).agg(
            F.array(F.min("score"), F.max("score")).alias("ends"), (F.sum("label_sum") / F.sum("weight")).alias("calibrated")))
        left = cut.filter("NOT __closed").drop("__closed")
        sizes = cut_lineage(left.groupBy(START).agg(F.count("*").alias("__n")))
        sized = _with_range_facts(left, sizes)
        done.append(sized.filter(F.col("__n") <= piece).drop("__n"))
        open_rows = sized.filter(F.col("__n") > piece).drop("__n")
        size = sizes.agg(F.coalesce(F.max("__n"), F.lit(0))).first()[0]
    points = None
    for part in done:
        grouped = part.withColumn("__piece", F.floor(F.col(START) / piece)).groupBy("__piece").applyInPandas(_pool, POINTS)
        points = grouped if points is None else points.unionByName(grouped)
    for part in single:
        points = points.unionByName(part.select(F.explode(F.array_distinct("ends")).alias("score"), "calibrated"))
    return cut_lineage(points)


def interpolate(points: DataFrame, rows: DataFrame, score: str = "score", name: str = "calibrated") -> DataFrame:
    """E24. The fitted value of every row: linear between the points next to its score, clipped outside.

    Points and distinct scores are ordered together in value buckets; a bucket passes on its last and
    first point only. Scores that are NULL or NaN, and all scores if there are no points, give NULL.
    """
    value = F.col(score).cast("double")
    asked = rows.select(value.alias("score")).filter("score IS NOT NULL AND NOT isnan(score)").distinct()
    point = F.struct(F.col("score").alias("x"), F.col("calibrated").alias("y"))
    both = cut_lineage(points.select("score", point.alias("point")).unionByName(
        asked.select("score", F.lit(None).cast("struct<x:double,y:double>").alias("point"))).groupBy("score").agg(
        F.max("point").alias("point")))
    placed = add_value_bucket(both, "score", "__vb", buckets=value_buckets(both))
    edges = placed.groupBy("__vb").agg(F.max("point").alias("__top"), F.min("point").alias("__low"))
    order = Window.orderBy("__vb")  # one row per value bucket
    carried = edges.select(
        "__vb", F.max("__top").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.min("__low").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    inside = Window.partitionBy("__vb").orderBy("score")
    under = F.coalesce(F.max("point").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("__before"))
    over = F.coalesce(F.min("point").over(inside.rowsBetween(0, Window.unboundedFollowing)), F.col("__after"))
    met = placed.join(carried, "__vb").select("score", under.alias("u"), over.alias("o"))
    run = F.col("o.x") - F.col("u.x")
    between = F.when(run > 0, F.col("u.y") + (F.col("o.y") - F.col("u.y")) * (F.col("score") - F.col("u.x")) / F.when(run > 0, run)
                     ).otherwise(F.col("u.y"))
    fitted = cut_lineage(met.select(F.col("score").alias("__score"), F.coalesce(between, F.col("u.y"), F.col("o.y")).alias(name)))
    return rows.drop(name).withColumn("__score", value).join(fitted, "__score", "left").drop("__score")
