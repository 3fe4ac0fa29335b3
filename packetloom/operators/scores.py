"""Scoring evaluation: thresholds, ranking metrics, calibration curves, comparisons.

Covers E11-E22, E26-E36, E42, E43, J7-J10, T6 and A32. Everything that needs scores in order works
on a *ladder*: one row per distinct score with cumulative counts, built bucket by bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.numeric import bind
from packetloom.operators.ordered import (
    add_key_value_bucket, add_value_bucket, beside, epoch_micros, group_key, grouped_percentiles, running_totals, value_buckets,
)
from packetloom.session import cut_lineage

DRAW_BITS = 52  # of a digest's leading hex digits, four each


def poisson_steps(rate: float = 1.0) -> list[float]:
    """Cumulative Poisson probabilities, as far as a draw of DRAW_BITS bits can tell them from 1."""
    chance = total = math.exp(-rate)
    steps = []
    while total < 1 - 2.0 ** -DRAW_BITS and (not steps or total > steps[-1]):
        steps.append(total)
        chance *= rate / len(steps)
        total += chance
    return steps


def _draw_steps() -> list[str]:
    """The Poisson steps as leading hex digits of a digest: text of one length compares as the number does."""
    digits = DRAW_BITS // 4
    steps = [f"{math.ceil(p * 2.0 ** DRAW_BITS):0{digits}x}" for p in poisson_steps()]
    return [s for s in steps if len(s) == digits]  # a longer one is above all draws


def _steps_reached(digest: Column, steps: Sequence[str]) -> Column:
    """How many of the ascending ``steps`` are not above the digest."""
    chain = F.when(digest < steps[0], 0)
    for k, step in enumerate(steps[1:], 1):
        chain = chain.when(digest < step, k)
    return chain.otherwise(len(steps)).cast("long")


def _ratio(numerator: Column, denominator: Column, otherwise: Column | None = None) -> Column:
    value = F.when(denominator != 0, numerator.cast("double") / F.when(denominator != 0, denominator))
    return value.otherwise(F.lit(0.0) if otherwise is None else otherwise)


def _one_row(df: DataFrame) -> DataFrame:
    """A row without columns, so that fixed grids exist for empty inputs too."""
    return df.sparkSession.range(1, numPartitions=1).select()


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """E15. Precision, recall, F1 and false-positive rate, 0 on an empty denominator."""
    return {
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn), "fpr": _ratio(fp, fp + tn),
    }


def score_ladder(rows: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label",
                 candidates: Sequence[float] = (), weight: str | None = None) -> DataFrame:
    """One row per distinct score (and extra candidate threshold) with, at ``score >= threshold``,
    tp and fp, and the class totals of its key. The counts per distinct score are written once."""
    keys = list(keys)
    unit = F.col(weight) if weight else F.lit(1)
    counts = rows.groupBy(*keys, F.col(score).cast("double").alias("threshold")).agg(
        F.sum(F.when(F.col(label) == 1, unit).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(unit)).alias("neg"))
    counts = cut_lineage(counts)
    if candidates:
        extra = counts.select(*keys).distinct() if keys else _one_row(counts)
        added = extra.select(*keys, F.explode(F.array(*[F.lit(float(c)) for c in candidates])).alias("threshold"),
                             F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
        counts = cut_lineage(counts.unionByName(added).groupBy(*keys, "threshold").agg(
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    bucketed = (add_key_value_bucket(counts, keys, "threshold") if keys
                else add_value_bucket(counts, "threshold", buckets=value_buckets(counts)))
    ladder = running_totals(
        bucketed, keys, [F.desc("threshold")], -F.col("__vb"),
        {"tp": F.col("pos"), "fp": F.col("neg")}).drop("__vb")
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    if not keys:
        return beside(ladder, totals)
    keyed = totals.withColumn("__k", group_key(keys)).drop(*keys)
    return ladder.withColumn("__k", group_key(keys)).join(keyed, "__k").drop("__k")


def with_rates(ladder: DataFrame) -> DataFrame:
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("positives") - tp, F.col("negatives") - fp
    return ladder.withColumns({"fn": fn, "tn": tn, **rates(tp, fp, fn, tn)})


def _pick(order: Column, *fields: str) -> list[Column]:
    best = F.max_by(F.struct(*fields), order)
    return [best[f].alias(f) for f in fields]


def f1_threshold(rows: DataFrame, keys: Sequence[str] = (), **columns) -> DataFrame:
    """E11. Threshold of largest F1 among the scores and 0.5; ties go to the lowest."""
    ladder = with_rates(score_ladder(rows, keys, candidates=[0.5], **columns))
    return ladder.groupBy(*keys).agg(*_pick(F.struct("f1", -F.col("threshold")), "threshold", "f1"))


def operating_points(rows: DataFrame, keys: Sequence[str] = (), **columns) -> DataFrame:
    """E12. One row per selection rule; ties go to the highest threshold."""
    ladder = with_rates(score_ladder(rows, keys, candidates=[0.5], **columns))
    p, r, t = F.col("precision"), F.col("recall"), F.col("threshold")
    ladder = ladder.withColumn("f2", _ratio(5 * p * r, 4 * p + r))
    fields = ["threshold", "precision", "recall", "f1", "f2", "fpr"]
    rules = {
        "max_f1": F.struct("f1", t), "max_f2": F.struct("f2", t),
        "recall_near_90": F.struct(-F.abs(r - 0.90), t), "recall_near_80": F.struct(-F.abs(r - 0.80), t),
        "min_fpr_recall_80": F.when(r >= 0.80, F.struct(-F.col("fpr"), t)),
    }
    picked = ladder.groupBy(*keys).agg(*[
        F.max_by(F.when(order.isNotNull(), F.struct(*fields)), order).alias(name) for name, order in rules.items()])
    return picked.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(name).alias("selection"), F.col(name).alias("at")) for name in rules])).alias("point")).select(
        *keys, "point.selection", *[F.col(f"point.at.{f}").alias(f) for f in fields])


def recall_at_fpr(rows: DataFrame, max_fpr: float = 0.05, keys: Sequence[str] = (), **columns) -> DataFrame:
    """E13. Largest recall with FPR within the limit, at its highest threshold; +inf if none qualifies."""
    ladder = with_rates(score_ladder(rows, keys, **columns))
    order = F.when(F.col("fpr") <= max_fpr, F.struct("tp", "threshold"))
    at = F.max_by(F.when(F.col("fpr") <= max_fpr, F.struct("threshold", "recall", "fpr")), order)
    return ladder.groupBy(*keys).agg(at.alias("at")).select(
        *keys, F.coalesce("at.threshold", F.lit(float("inf"))).alias("threshold"),
        F.coalesce("at.recall", F.lit(0.0)).alias("recall"), F.coalesce("at.fpr", F.lit(0.0)).alias("fpr"))


def f1_threshold_capped(rows: DataFrame, max_fpr: float | None = None, keys: Sequence[str] = (), **columns) -> DataFrame:
    """E14. Best (F1, recall, precision) among thresholds within the FPR cap; lowest on ties; 0.5 if none."""
    ladder = with_rates(score_ladder(rows, keys, candidates=[0.0, 0.5], **columns))
    allowed = F.lit(True) if max_fpr is None else F.col("fpr") <= max_fpr
    order = F.when(allowed, F.struct("f1", "recall", "precision", -F.col("threshold")))
    at = F.max_by(F.when(allowed, F.struct("threshold", "f1")), order)
    return ladder.groupBy(*keys).agg(at.alias("at")).select(
        *keys, F.coalesce("at.threshold", F.lit(0.5)).alias("threshold"), F.coalesce("at.f1", F.lit(-1.0)).alias("f1"))


def ranking_metrics(rows: DataFrame, keys: Sequence[str] = (), **columns) -> DataFrame:
    """E16 + E17. Average precision (step-wise) and tie-aware ROC-AUC; NULL when one class is absent."""
    ladder = score_ladder(rows, keys, **columns)
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    n_pos, n_neg = F.max("positives"), F.max("negatives")
    precision = F.sum(pos * _ratio(tp, tp + fp))
    pairs = F.sum(neg * (tp - pos / 2))
    return ladder.groupBy(*keys).agg(
        _ratio(precision, n_pos, F.lit(None)).alias("average_precision"),
        _ratio(pairs, n_pos * n_neg, F.lit(None)).alias("roc_auc"))


def confusion(rows: DataFrame, threshold: Column | float, keys: Sequence[str] = (), score: str = "score",
              label: str = "label") -> DataFrame:
    """E15 + E19. Confusion counts and rates at a threshold (a number or a column of each row)."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, true = F.col(score) >= cut, F.col(label) == 1
    counted = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"),
        F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))
    return counted.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def guarded_metrics(metrics: DataFrame) -> DataFrame:
    """E20. Rates that a single-class subset does not define become NULL; specificity is added."""
    pos, neg = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    both = (pos > 0) & (neg > 0)
    return metrics.withColumns({
        "specificity": _ratio(F.col("tn"), neg, F.lit(None)),
        "precision": F.when(both, F.col("precision")), "f1": F.when(both, F.col("f1")),
        "recall": F.when(pos > 0, F.col("recall")), "fpr": F.when(neg > 0, F.col("fpr")),
    })


def threshold_sweep(rows: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = (), score: str = "score",
                    label: str = "label") -> DataFrame:
    """E18. Metrics at fixed thresholds: rows are counted once by how many thresholds they pass."""
    grid = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    passed = rows.groupBy(*keys, bind(F.col(score), lambda v: F.size(F.filter(grid, lambda t: t <= v))).alias("passed")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    spread = passed.select(*keys, "passed", "pos", "neg", F.posexplode(grid).alias("i", "threshold"))
    above = F.col("i") < F.col("passed")
    counted = spread.groupBy(*keys, "threshold").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(above, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(above, 0).otherwise(F.col("neg"))).alias("tn"))
    return counted.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def score_distribution(rows: DataFrame, keys: Sequence[str] = ("label",), score: str = "score") -> DataFrame:
    """E21. Count, mean, population std, range and exact percentiles of the score per key."""
    moments = rows.groupBy(*keys).agg(
        F.count(score).alias("count"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
        F.min(score).alias("min"), F.max(score).alias("max"))
    points = grouped_percentiles(rows, keys, score, {"p1": .01, "p25": .25, "p50": .5, "p75": .75, "p99": .99})
    return moments.join(points, list(keys))


def brier(rows: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """E22."""
    gap = F.col(score) - F.col(label)
    return rows.groupBy(*keys).agg(F.avg(gap * gap).alias("brier"))


def reliability_bins(rows: DataFrame, keys: Sequence[str] = (), bins: int = 10, score: str = "score",
                     label: str = "label") -> DataFrame:
    """E22. Equal-width bins (the last one closed): count, mean score, positive rate, gap. Empty bins stay out."""
    step = 1.0 / bins
    inner = F.array(*[F.lit(i * step) for i in range(1, bins)])
    placed = rows.filter(F.col(score).between(0.0, 1.0)).withColumn(
        "bin", bind(F.col(score), lambda v: F.size(F.filter(inner, lambda e: e <= v))))
    return placed.groupBy(*keys, "bin").agg(
        F.count("*").alias("count"), F.avg(score).alias("mean_predicted"),
        F.avg(F.col(label).cast("double")).alias("observed_rate")
    ).withColumn("gap", F.abs(F.col("mean_predicted") - F.col("observed_rate")))


def calibration_error(rows: DataFrame, keys: Sequence[str] = (), bins: int = 10, **columns) -> DataFrame:
    """E22. Expected calibration error: gaps weighted by bin share."""
    table = reliability_bins(rows, keys, bins, **columns)
    return table.groupBy(*keys).agg((F.sum(F.col("count") * F.col("gap")) / F.sum("count")).alias("ece"))


def bootstrap_interval(rows: DataFrame, row_id: str, threshold: float, replicates: int = 200, seed: int = 42,
                       score: str = "score", label: str = "label") -> DataFrame:
    """E26. Mean and 95 % interval of ranking and threshold metrics over seeded Poisson resamples.

    A row's weight in a replicate comes from the leading bits of the md5 digest of "row id:replicate:seed",
    so recomputed tasks agree, and so does any other engine; single-class replicates are skipped and
    fewer than 50 valid ones give NULL. Draws are per row and replicate, so work is rows x replicates;
    counts per distinct score are added up before anything is shuffled.
    """
    digest = F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.col("replicate").cast("string"), F.lit(str(seed))))
    dealt = rows.select(row_id, score, label).repartition(row_id)  # a split by time lies in few of the input's files
    copies = dealt.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    steps = _draw_steps()
    drawn = copies.withColumn("__digest", digest).filter(F.col("__digest") >= steps[0]).withColumn(
        "weight", _steps_reached(F.col("__digest"), steps))
    counted = drawn.groupBy("replicate", score, label).agg(F.sum("weight").alias("weight"))
    ranked = ranking_metrics(counted, ["replicate"], score=score, label=label, weight="weight")
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    cut = counted.groupBy("replicate").agg(*[
        F.sum(F.when(c, F.col("weight")).otherwise(0)).alias(n)
        for n, c in (("tp", hit & true), ("fp", hit & ~true), ("fn", ~hit & true), ("tn", ~hit & ~true))])
    cut = cut.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))).select("replicate", "f1", "recall")
    valid = ranked.join(cut, "replicate").filter("roc_auc IS NOT NULL")
    names = ["average_precision", "roc_auc", "f1", "recall"]
    long = valid.unpivot(["replicate"], names, "metric", "value")
    enough = F.count("*") >= 50
    return long.groupBy("metric").agg(
        F.count("*").alias("valid_replicates"), F.when(enough, F.avg("value")).alias("mean"),
        F.when(enough, F.percentile("value", 0.025)).alias("low"),
        F.when(enough, F.percentile("value", 0.975)).alias("high"))


def class_weights(rows: DataFrame, label: str, classes: int) -> DataFrame:
    """A32. Balanced weights N / (classes * count)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # one row per class
    return counts.select(label, "count", (total / (F.lit(classes) * F.col("count"))).alias("weight"))


def stage_confusion(rows: DataFrame, keys: Sequence[str] = (), true: str = "true", predicted: str = "predicted") -> DataFrame:
    """E27. Rows per (true, predicted) class."""
    return rows.groupBy(*keys, true, predicted).agg(F.count("*").alias("n"))


def class_metrics(table: DataFrame, keys: Sequence[str] = (), true: str = "true", predicted: str = "predicted",
                  classes: int = 6) -> DataFrame:
    """E27. Precision, recall, F1 and support for every class 0..classes-1 from a confusion table."""
    base = table.select(*keys).distinct() if keys else _one_row(table)
    every = base.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("class"), F.lit(0).alias("n_true"),
                        F.lit(0).alias("n_pred"), F.lit(0).alias("hit"))
    as_true = table.select(*keys, F.col(true).alias("class"), F.col("n").alias("n_true"), F.lit(0).alias("n_pred"),
                           F.when(F.col(true) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"))
    as_pred = table.select(*keys, F.col(predicted), F.lit(0), F.col("n"), F.lit(0))
    totals = every.unionAll(as_true).unionAll(as_pred).groupBy(*keys, "class").agg(
        F.sum("n_true").alias("support"), F.sum("n_pred").alias("n_pred"), F.sum("hit").alias("hit"))
    hit, support, n_pred = F.col("hit"), F.col("support"), F.col("n_pred")
    return totals.select(*keys, "class", "support", _ratio(hit, n_pred).alias("precision"),
                         _ratio(hit, support).alias("recall"), _ratio(2 * hit, support + n_pred).alias("f1"))


def unsupported_to_null(metrics: DataFrame, flagged: Sequence[int]) -> DataFrame:
    """E27. A flagged class without examples reports NULL instead of a made-up zero."""
    empty = F.col("class").isin(*flagged) & (F.col("support") == 0)
    return metrics.withColumns({c: F.when(~empty, F.col(c)) for c in ("precision", "recall", "f1")})


def macro_scores(table: DataFrame, keys: Sequence[str] = (), classes: int = 6, true: str = "true",
                 predicted: str = "predicted") -> DataFrame:
    """E27. Accuracy and macro F1."""
    macro = class_metrics(table, keys, true, predicted, classes).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))
    right = table.groupBy(*keys).agg((F.sum(F.when(F.col(true) == F.col(predicted), F.col("n")).otherwise(0))
                                      / F.sum("n")).alias("accuracy"))
    return right.join(macro, list(keys)) if keys else beside(right, macro)


def per_step_evaluation(validation: DataFrame, test: DataFrame, step: str = "step") -> DataFrame:
    """E28. Per horizon step: F1 threshold from validation, metrics and ranking on test."""
    cuts = f1_threshold(validation, [step]).select(step, "threshold")
    at_cut = confusion(test.join(cuts, step), F.col("threshold"), [step]).join(cuts, step)
    return at_cut.join(ranking_metrics(test, [step]), step)


def horizon_means(per_step: DataFrame, step: str = "step") -> DataFrame:
    """E28. Means over the steps and whether average precision never rises (tolerance 1e-9)."""
    previous = F.lag("average_precision").over(Window.orderBy(step))
    means = [F.avg(c).alias(f"mean_{c}") for c in ("average_precision", "roc_auc", "precision", "recall", "f1", "fpr")]
    return per_step.withColumn("__drop", F.coalesce(previous >= F.col("average_precision") - 1e-9, F.lit(True))).agg(
        *means, F.bool_and("__drop").alias("monotonic_non_increasing"))


def baseline_scores(rows: DataFrame, current_attack: str, score: str, steps: int = 6) -> DataFrame:
    """E29. Persistence (current flag) and broadcast (one score) repeated over the horizon."""
    return rows.withColumns({
        "persistence": F.array_repeat(F.col(current_attack).cast("double"), steps),
        "broadcast": F.array_repeat(F.col(score).cast("double"), steps)})


def trajectory_diagnostics(rows: DataFrame, probabilities: str, targets: str, row_id: str) -> DataFrame:
    """E30. Mean step change, share of non-constant sequences, mean within-row correlation."""
    p = F.col(probabilities)
    changes = F.transform(F.slice(p, 2, F.size(p) - 1), lambda v, i: F.abs(v - F.get(p, i)))
    first = F.get(p, F.lit(0))
    moving = F.exists(p, lambda v: F.abs(v - first) > F.lit(1e-4) + F.lit(1e-5) * F.abs(first))
    shape = rows.agg(
        (F.sum(F.aggregate(changes, F.lit(0.0), lambda a, v: a + v)) / F.sum(F.size(changes))).alias("mean_abs_step_change"),
        F.avg(moving.cast("double")).alias("fraction_non_constant"))
    steps = rows.select(row_id, F.posexplode(F.arrays_zip(p.alias("p"), F.col(targets).alias("t"))).alias("step", "z"))
    each = steps.groupBy(row_id).agg(pearson(F.col("z.p"), F.col("z.t").cast("double")).alias("r"))
    agreed = each.agg(F.avg("r").alias("mean_correlation"), F.count("r").alias("defined_correlations"))
    return beside(shape, agreed)


def pearson(x: Column, y: Column) -> Column:
    """E42. Correlation; NULL for fewer than two pairs or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    varies = (F.count(F.when(both, 1)) >= 2) & (F.min(a) != F.max(a)) & (F.min(b) != F.max(b))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(varies, F.covar_pop(a, b) / F.when(spread != 0, spread))


def whole_horizon_consistency(rows: DataFrame, score: str, steps: str) -> DataFrame:
    """E31. 1 - prod(1 - p) against the single score: mean absolute error and correlation."""
    derived = 1 - F.aggregate(F.col(steps), F.lit(1.0), lambda a, p: a * (1 - p))
    return rows.select(derived.alias("derived"), F.col(score).alias("score")).agg(
        F.avg(F.abs(F.col("derived") - F.col("score"))).alias("mae"),
        pearson(F.col("derived"), F.col("score")).alias("pearson"))


def horizon_state_error(rows: DataFrame, predicted: str, actual: str, by_feature: bool = False) -> DataFrame:
    """E32. MSE and MAE per horizon step, or per feature with its share of the total MSE."""
    steps = rows.select(F.posexplode(F.arrays_zip(F.col(predicted).alias("p"), F.col(actual).alias("a"))).alias("i", "z"))
    cells = steps.select((F.col("i") + 1).alias("horizon_step"), F.posexplode(
        F.zip_with("z.p", "z.a", lambda p, a: p - a)).alias("feature", "d"))
    key = "feature" if by_feature else "horizon_step"
    errors = cells.groupBy(key).agg(F.avg(F.col("d") * F.col("d")).alias("mse"), F.avg(F.abs("d")).alias("mae"))
    if not by_feature:
        return errors
    total = F.sum("mse").over(Window.partitionBy())  # one row per feature
    return errors.withColumn("share_pct", F.col("mse") * 100 / F.when(total != 0, total))


def detection_by_first_step(rows: DataFrame, threshold: float, step: str = "future_attack_step", score: str = "score",
                            horizon: int = 6) -> DataFrame:
    """E33. Per first attack step 0..horizon: samples, mean score and positive rate (NULL when empty)."""
    found = rows.groupBy(step).agg(
        F.count("*").alias("samples"), F.avg(score).alias("mean_score"),
        F.avg((F.col(score) >= threshold).cast("double")).alias("positive_rate"))
    grid = _one_row(found).select(F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias(step))
    return grid.join(found.withColumn(step, F.col(step).cast("int")), step, "left").na.fill(0, ["samples"])


def onset_split(rows: DataFrame, threshold: float, keys: Sequence[str] = (), label: str = "label", score: str = "score",
                current: str = "current_attack") -> DataFrame:
    """E34 (after J8). Positives already under attack against true onsets, with recall of each."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    onset, ongoing = pos & (F.col(current) == 0), pos & (F.col(current) == 1)
    counted = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(pos).alias("positives"), F.count_if(onset).alias("onset_positives"),
        F.count_if(ongoing).alias("ongoing_positives"), F.count_if(hit & onset).alias("__ho"),
        F.count_if(hit & ongoing).alias("__hg"), F.count_if(hit & ~pos).alias("__fp"))
    return counted.withColumns({
        "onset_recall": _ratio(F.col("__ho"), F.col("onset_positives")),
        "ongoing_recall": _ratio(F.col("__hg"), F.col("ongoing_positives")),
        "false_positive_rate": _ratio(F.col("__fp"), F.col("n") - F.col("positives")),
    }).drop("__ho", "__hg", "__fp")


def alignment_check(left: DataFrame, right: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """J7. Whether two prediction tables cover the same keys with the same labels."""
    a = left.select(*keys, F.col(label).alias("__a"), F.lit(True).alias("__l"))
    b = right.select(*keys, F.col(label).alias("__b"), F.lit(True).alias("__r"))
    both = a.join(b, list(keys), "full")
    return both.agg(
        F.count_if(F.col("__r").isNull()).alias("only_left"), F.count_if(F.col("__l").isNull()).alias("only_right"),
        F.count_if(F.col("__l") & F.col("__r") & ~F.col("__a").eqNullSafe(F.col("__b"))).alias("label_mismatches"),
    ).withColumn("aligned", (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("label_mismatches") == 0))


def compare_models(rows: DataFrame, model: str = "model", split: str = "split", max_fpr: float = 0.05) -> DataFrame:
    """E35. Shared protocol: threshold by recall at a validation FPR limit, then test metrics, with leaders."""
    validation, test = rows.filter(F.col(split) == "validation"), rows.filter(F.col(split) == "test")
    cuts = recall_at_fpr(validation, max_fpr, [model]).select(
        model, "threshold", F.col("recall").alias("validation_recall"))
    at_cut = confusion(test.join(cuts, model), F.col("threshold"), [model]).join(cuts, model)
    table = at_cut.join(ranking_metrics(test, [model]), model)
    every = Window.partitionBy()  # one row per model
    leaders = {"best_average_precision": "average_precision", "best_roc_auc": "roc_auc",
               "best_validation_recall": "validation_recall", "best_f1": "f1"}
    return table.withColumns({
        **{name: F.max_by(model, metric).over(every) for name, metric in leaders.items()},
        "lowest_fpr": F.min_by(model, "fpr").over(every)})


def comparison_checks(rows: DataFrame, keys: Sequence[str], model: str = "model", split: str = "split",
                      label: str = "label") -> DataFrame:
    """E35. Per split, whether all models were judged on the same samples with the same labels.

    ``missing_samples`` counts keys that some model lacks, ``label_mismatches`` shared keys on whose label
    models differ (NULL is a label of its own). A split that a model lacks altogether fails too.
    """
    positive = F.col(label).eqNullSafe(F.lit(1))
    shown = F.coalesce(F.col(label).cast("string"), F.lit("\u0000"))
    per_model = rows.groupBy(split, model).agg(F.count("*").alias("n"), F.count_if(positive).alias("p"))
    sizes = cut_lineage(per_model.groupBy(split).agg(
        F.count("*").alias("models"), F.min("n").alias("least_samples"), F.max("n").alias("most_samples"),
        F.min("p").alias("least_positives"), F.max("p").alias("most_positives")))
    every = cut_lineage(rows.select(model).distinct().agg(F.count("*").alias("__all")))
    samples = rows.groupBy(split, *keys, model).agg(F.min(shown).alias("lo"), F.max(shown).alias("hi")).groupBy(split, *keys).agg(
        F.count("*").alias("held"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    counted = beside(samples, every)
    missing = F.col("held") < F.col("__all")
    found = counted.groupBy(split).agg(
        F.count_if(missing).alias("missing_samples"),
        F.count_if(~missing & (F.col("lo") != F.col("hi"))).alias("label_mismatches"), F.max("__all").alias("__all"))
    joined = found.withColumnRenamed(split, "__split").join(sizes, F.col("__split").eqNullSafe(F.col(split)))
    equal = F.col("least_positives") == F.col("most_positives")
    fair = equal & (F.col("missing_samples") == 0) & (F.col("label_mismatches") == 0) & (F.col("models") == F.col("__all"))
    return joined.select(split, "models", "least_samples", "most_samples", "least_positives", "most_positives",
                         equal.alias("prevalence_equal"), "missing_samples", "label_mismatches",
                         F.when(fair, "PASS").otherwise("FAIL").alias("status"))


def claim_verdict(table: DataFrame, candidate: str, rival: str, model: str = "model") -> DataFrame:
    """E35. PARTIALLY SUPPORTED when the candidate outranks the rival on both ranking metrics, else NOT SUPPORTED."""
    def of(name, column):
        return F.max(F.when(F.col(model) == name, F.col(column)))

    wins = (of(candidate, "average_precision") > of(rival, "average_precision")) & (
        of(candidate, "roc_auc") > of(rival, "roc_auc"))
    return table.agg(F.when(wins, "PARTIALLY SUPPORTED").otherwise("NOT SUPPORTED").alias("verdict"))


def family_holdout(rows: DataFrame, held_out: Sequence[str], source: str = "source_file", split: str = "split") -> DataFrame:
    """E36. Held-out sources leave training and validation; the test split stays whole."""
    return rows.filter((F.col(split) == "test") | ~F.col(source).isin(*held_out))


def holdout_metrics(test: DataFrame, held_out: Sequence[str], threshold: float, source: str = "source_file",
                    label: str = "label", score: str = "score") -> DataFrame:
    """E36. Metrics on unseen-family, seen-family and all positives, each against all negatives."""
    negative, outside = F.col(label) != 1, F.col(source).isin(*held_out)
    views = F.array_compact(F.array(F.lit("full"), F.when(negative | outside, "unseen"), F.when(negative | ~outside, "seen")))
    spread = test.select(score, label, F.explode(views).alias("subset"))
    at_cut = guarded_metrics(confusion(spread, threshold, ["subset"], score, label))
    return at_cut.join(ranking_metrics(spread, ["subset"], score=score, label=label), "subset")


def offset_correlations(left: DataFrame, right: DataFrame, offsets: Sequence[int] = tuple(range(9)),
                        ts: str = "window_start", value: str = "value", minimum: int = 10) -> DataFrame:
    """J9. Correlate two window series with the left one shifted by whole hours (NULL under ``minimum`` overlaps)."""
    shifted = left.select(F.col(value).alias("x"), F.col(ts).alias("__at"), F.explode(
        F.array(*[F.lit(h) for h in offsets])).alias("offset_hours")).withColumn(
        ts, F.col("__at") + F.make_dt_interval(hours=F.col("offset_hours")))
    pairs = shifted.join(right.select(ts, F.col(value).alias("y")), ts)
    return pairs.groupBy("offset_hours").agg(
        F.count("*").alias("overlap"),
        F.when(F.count("*") >= minimum, pearson(F.col("x").cast("double"), F.col("y").cast("double"))).alias("pearson"))


def alignment_decision(correlations: DataFrame, floor: float = 0.30, margin: float = 2.0) -> DataFrame:
    """E43. PROCEED if the best |r| reaches the floor and is ``margin`` times the runner-up."""
    strength = F.abs("pearson")
    ranked = correlations.filter("pearson IS NOT NULL").withColumn(
        "__rank", F.row_number().over(Window.orderBy(F.desc(strength), "offset_hours")))

    def of(rank, column):
        return F.max(F.when(F.col("__rank") == rank, column))

    best, runner = of(1, strength), F.coalesce(of(2, strength), F.lit(0.0))
    clear = F.when(runner > 1e-9, best / F.when(runner > 1e-9, runner) >= margin).otherwise(F.lit(True))
    return ranked.agg(
        of(1, F.col("offset_hours")).alias("best_offset_hours"), best.alias("best_abs_r"), runner.alias("runner_up_abs_r"),
        F.when((best >= floor) & clear, "PROCEED").otherwise("STOP").alias("decision"))


def clock_offset_votes(log_times: DataFrame, packet_times: DataFrame, ts: str = "timestamp",
                       offsets: Sequence[int] = tuple(range(13))) -> DataFrame:
    """J10. Log events per hour offset whose shifted second of day is a packet second; first maximum wins.

    Both sides shrink to at most 86,400 seconds of the day before they meet.
    """
    def second_of_day(c):
        return F.pmod(F.floor(epoch_micros(c) / 1_000_000), F.lit(86400))

    logs = log_times.groupBy(second_of_day(ts).alias("__s")).agg(F.count("*").alias("__n"))
    packets = packet_times.groupBy(second_of_day(ts).alias("__p")).agg(F.count("*").alias("__events"))
    shifted = logs.select("__n", "__s", F.explode(F.array(*[F.lit(h) for h in offsets])).alias("offset_hours")).withColumn(
        "__p", F.pmod(F.col("__s") + F.col("offset_hours") * 3600, F.lit(86400)))
    matched = shifted.join(packets.select("__p", F.lit(True).alias("__hit")), "__p", "left")
    votes = matched.groupBy("offset_hours").agg(
        F.sum(F.when(F.col("__hit"), F.col("__n")).otherwise(0)).alias("matches"))
    best = votes.agg(F.max_by("offset_hours", F.struct("matches", -F.col("offset_hours"))).alias("__best"),
                     F.max("matches").alias("__top"))
    total = packet_times.agg(F.count("*").alias("__packets"))
    return beside(beside(votes, best), total).select(
        "offset_hours", "matches", (F.col("offset_hours") == F.col("__best")).alias("is_best"),
        ((F.col("__packets") > 0) & (F.col("__top") == F.col("__packets"))).alias("established"))


def worst_samples(rows: DataFrame, sse: str = "sse", top: int = 25, tie_break: str = "sample_id") -> DataFrame:
    """T6. The samples of largest squared error with their share of the total."""
    return beside(rows, rows.agg(F.sum(sse).alias("__t"))).withColumn(
        "share_pct", F.col(sse) * 100 / F.col("__t")).drop("__t").orderBy(F.desc(sse), tie_break).limit(top)


def worst_share(rows: DataFrame, sse: str = "sse", percents: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """T6. Share of the total squared error held by the worst 1, 5 and 10 % of samples (at least one).

    Equal errors share a ladder step, of which exactly the missing number of samples is taken.
    """
    counts = cut_lineage(rows.groupBy(F.col(sse).alias("value")).agg(F.count("*").alias("n")))
    ladder = running_totals(add_value_bucket(counts, "value"), [], [F.desc("value")], -F.col("__vb"), {"upto": F.col("n")})
    whole = counts.agg(F.sum("n").alias("__n"), F.sum(F.col("n") * F.col("value")).alias("__t"))
    spread = beside(ladder, whole).withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    k = F.greatest(F.lit(1), F.ceil(F.col("__n") * F.col("percent") / 100))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), k - (F.col("upto") - F.col("n"))))
    return spread.groupBy("percent").agg(
        F.max(k).alias("samples"), (F.sum(taken * F.col("value")) * 100 / F.max("__t")).alias("share_pct"))
