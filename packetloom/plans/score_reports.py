"""Evaluation reports over the prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom import adapters
from packetloom.adapters import SCORES_SQL
from packetloom.operators import scores as sc
from packetloom.plans.registry import Reports, with_tables

REPORTS = Reports()
SCORES = adapters.scores


def validation(s, d):
    return SCORES(s, d).filter("split = 'validation'")


def ladder_sql(source: str = "scores", keys: str = "", extra: str = "", name: str = "ladder") -> str:
    """Cumulative counts per distinct score, in SQL."""
    k, part = (f"{keys}, ", f"PARTITION BY {keys} ") if keys else ("", "")
    added = f" UNION ALL SELECT DISTINCT {k}unnest([{extra}]) AS threshold, 0, 0 FROM {source}" if extra else ""
    return f"""
{name}_c AS (SELECT {k}threshold, sum(pos) AS pos, sum(neg) AS neg FROM (
  SELECT {k}score AS threshold, label AS pos, 1 - label AS neg FROM {source}{added}) GROUP BY ALL),
{name}_r AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER (PARTITION BY {keys or '1'}) AS positives,
  sum(neg) OVER (PARTITION BY {keys or '1'}) AS negatives FROM {name}_c WINDOW o AS ({part}ORDER BY threshold DESC)),
{name} AS (SELECT *, positives - tp AS fn, negatives - fp AS tn,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS "precision", CASE WHEN positives > 0 THEN tp / positives ELSE 0 END AS recall,
  CASE WHEN tp + positives + fp > 0 THEN 2 * tp / (tp + positives + fp) ELSE 0 END AS f1,
  CASE WHEN negatives > 0 THEN fp / negatives ELSE 0 END AS fpr FROM {name}_r)"""


RATES_SQL = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS "precision",
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
  CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr"""


def confusion_sql(source: str, cut: str, keys: str = "", name: str = "cm") -> str:
    k = f"{keys}, " if keys else ""
    return f"""
{name}_n AS (SELECT {k}count(*) AS n, count(*) FILTER (score >= {cut} AND label = 1) AS tp,
  count(*) FILTER (score >= {cut} AND label = 0) AS fp, count(*) FILTER (score < {cut} AND label = 1) AS fn,
  count(*) FILTER (score < {cut} AND label = 0) AS tn FROM {source} {'GROUP BY ' + keys if keys else ''}),
{name} AS (SELECT *, {RATES_SQL} FROM {name}_n)"""


VALIDATION_SQL = "validation AS (SELECT * FROM scores WHERE split = 'validation')"
TEST_SQL = "test AS (SELECT * FROM scores WHERE split = 'test')"
RATES = ["precision", "recall", "f1", "fpr"]
Q = ['"precision"', "recall", "f1", "fpr"]

REPORTS.add(
    "f1_threshold", lambda s, d: sc.f1_threshold(validation(s, d)),
    with_tables(SCORES_SQL, VALIDATION_SQL, ladder_sql("validation", extra="0.5"),
                select="SELECT threshold, f1 FROM ladder ORDER BY f1 DESC, threshold LIMIT 1"), doubles=["f1"],
)
POINTS = ["max_f1", "max_f2", "recall_near_90", "recall_near_80", "min_fpr_recall_80"]
ORDERS = ["f1 DESC, threshold DESC", "f2 DESC, threshold DESC", "abs(recall - 0.9::DOUBLE), threshold DESC",
          "abs(recall - 0.8::DOUBLE), threshold DESC", "fpr, threshold DESC"]
REPORTS.add(
    "operating_points", lambda s, d: sc.operating_points(validation(s, d)),
    with_tables(SCORES_SQL, VALIDATION_SQL, ladder_sql("validation", extra="0.5"), """
f AS (SELECT *, CASE WHEN 4 * "precision" + recall > 0 THEN 5 * "precision" * recall / (4 * "precision" + recall) ELSE 0 END AS f2
  FROM ladder)""", select=" UNION ALL ".join(
        f"""(SELECT '{p}' AS selection, threshold, "precision", recall, f1, f2, fpr FROM f
  {'WHERE recall >= 0.8' if p == 'min_fpr_recall_80' else ''} ORDER BY {o} LIMIT 1)""" for p, o in zip(POINTS, ORDERS))),
    doubles=["recall", "f1", "f2", "fpr"],
)
REPORTS.add(
    "recall_at_fpr", lambda s, d: sc.recall_at_fpr(validation(s, d), 0.05),
    with_tables(SCORES_SQL, VALIDATION_SQL, ladder_sql("validation"), select="""SELECT threshold, recall, fpr FROM ladder
  WHERE fpr <= 0.05 ORDER BY tp DESC, threshold DESC LIMIT 1"""), doubles=["recall", "fpr"],
)
REPORTS.add(
    "f1_threshold_capped", lambda s, d: sc.f1_threshold_capped(validation(s, d), 0.05),
    with_tables(SCORES_SQL, VALIDATION_SQL, ladder_sql("validation", extra="0.0, 0.5"), select="""SELECT threshold, f1
  FROM ladder WHERE fpr <= 0.05 ORDER BY f1 DESC, recall DESC, "precision" DESC, threshold LIMIT 1"""), doubles=["f1"],
)
REPORTS.add(
    "binary_metrics", lambda s, d: sc.confusion(SCORES(s, d), 0.6),
    with_tables(SCORES_SQL, confusion_sql("scores", "0.6"), select="SELECT * FROM cm"), doubles=["recall", "f1", "fpr"],
)
REPORTS.add(
    "average_precision", lambda s, d: sc.ranking_metrics(SCORES(s, d), ["split"]).drop("roc_auc"),
    with_tables(SCORES_SQL, ladder_sql(keys="split"), select="""SELECT split,
  sum(pos / positives * tp / (tp + fp)) AS average_precision FROM ladder GROUP BY split"""), doubles=["average_precision"],
)
REPORTS.add(
    "roc_auc", lambda s, d: sc.ranking_metrics(SCORES(s, d), ["split"]).drop("average_precision"),
    with_tables(SCORES_SQL, """
r AS (SELECT split, label, rank() OVER o + (count(*) OVER (PARTITION BY split, score) - 1) / 2 AS avg_rank FROM scores
  WINDOW o AS (PARTITION BY split ORDER BY score))""", select="""SELECT split,
  (sum(avg_rank) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS roc_auc
  FROM r GROUP BY split"""), doubles=["roc_auc"],
)
GRID = [i / 10 for i in range(1, 10)]
REPORTS.add(
    "threshold_sweep", lambda s, d: sc.threshold_sweep(SCORES(s, d), GRID),
    with_tables(SCORES_SQL, f"""
grid AS (SELECT unnest([{', '.join(map(str, GRID))}])::DOUBLE AS threshold),
c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp,
  count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn,
  count(*) FILTER (score < threshold AND label = 0) AS tn FROM scores, grid GROUP BY 1)""",
                select=f"SELECT *, {RATES_SQL} FROM c"), doubles=["recall", "f1", "fpr"],
)
REPORTS.add(
    "metrics_by_source", lambda s, d: sc.confusion(SCORES(s, d), 0.5, ["source_file"]),
    with_tables(SCORES_SQL, confusion_sql("scores", "0.5", "source_file"), select="SELECT * FROM cm"),
    doubles=["recall", "f1", "fpr"],
)


def with_single_class(s, d):
    """Every row, with the label of one site always 0 and of another always 1."""
    return SCORES(s, d).withColumn("label", F.when(F.col("source_file") == "site-1", 0).when(
        F.col("source_file") == "site-2", 1).otherwise(F.col("label")))


SINGLE_SQL = """
single AS (SELECT * REPLACE (CASE source_file WHEN 'site-1' THEN 0 WHEN 'site-2' THEN 1 ELSE label END AS label) FROM scores)"""
REPORTS.add(
    "single_class_guard",
    lambda s, d: sc.guarded_metrics(sc.confusion(with_single_class(s, d), 0.5, ["source_file"])),
    with_tables(SCORES_SQL, SINGLE_SQL, confusion_sql("single", "0.5", "source_file"), select="""SELECT source_file, n, tp,
  fp, fn, tn, CASE WHEN fp + tn > 0 THEN tn / (fp + tn) END AS specificity,
  CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN "precision" END AS "precision", CASE WHEN tp + fn > 0 THEN recall END AS recall,
  CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN f1 END AS f1, CASE WHEN fp + tn > 0 THEN fpr END AS fpr FROM cm"""),
    doubles=["recall", "f1", "fpr", "specificity"],
)
REPORTS.add(
    "score_percentiles", lambda s, d: sc.score_distribution(SCORES(s, d)),
    with_tables(SCORES_SQL, select="""SELECT label, count(score) AS "count", avg(score) AS mean, stddev_pop(score) AS std,
  min(score) AS "min", max(score) AS "max", """ + ", ".join(
        f"quantile_cont(score, {p / 100}) AS p{p}" for p in (1, 25, 50, 75, 99)) + " FROM scores GROUP BY 1"),
    doubles=["mean", "std", "p1", "p25", "p50", "p75", "p99"],
)
BINS_SQL = """
bins AS (SELECT len(list_filter([""" + ", ".join(f"{i}::DOUBLE * 0.1::DOUBLE" for i in range(1, 10)) + """],
    lambda e: e <= score)) AS bin, count(*) AS "count", avg(score) AS mean_predicted,
  avg(label) AS observed_rate FROM scores GROUP BY 1)"""
REPORTS.add(
    "reliability_bins", lambda s, d: sc.reliability_bins(SCORES(s, d)),
    with_tables(SCORES_SQL, BINS_SQL, select="SELECT *, abs(mean_predicted - observed_rate) AS gap FROM bins"),
    doubles=["mean_predicted", "observed_rate", "gap"],
)
REPORTS.add(
    "calibration_error", lambda s, d: sc.calibration_error(SCORES(s, d)),
    with_tables(SCORES_SQL, BINS_SQL, select="""SELECT sum("count" * abs(mean_predicted - observed_rate)) / sum("count") AS ece
  FROM bins"""), doubles=["ece"],
)
REPORTS.add(
    "brier", lambda s, d: sc.brier(SCORES(s, d), ["split"]),
    with_tables(SCORES_SQL, select="""SELECT split, avg((score - label) * (score - label)) AS brier FROM scores GROUP BY 1"""),
    doubles=["brier"],
)
METRICS = ["average_precision", "roc_auc", "f1", "recall"]
REPORTS.add(
    "bootstrap_interval", lambda s, d: sc.bootstrap_interval(SCORES(s, d).filter("split = 'test'"), "event_id", 0.5, replicates=100),
    with_tables(SCORES_SQL, f"""
drawn AS MATERIALIZED (SELECT r AS replicate, score, label, len(list_filter({sc.poisson_steps()}, lambda p: p <= u)) AS w FROM (
  SELECT *, ('0x' || md5(event_id || ':' || r || ':42')[1:13])::UBIGINT::DOUBLE / 2.0 ** 52 AS u
  FROM scores, range(1, 101) t(r) WHERE split = 'test'))""", """
steps AS (SELECT replicate, score, sum(w * label) AS pos, sum(w * (1 - label)) AS neg FROM drawn GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER (PARTITION BY replicate) AS p,
  sum(neg) OVER (PARTITION BY replicate) AS n FROM steps WINDOW o AS (PARTITION BY replicate ORDER BY score DESC)),
ranked AS (SELECT replicate, sum(CASE WHEN tp + fp > 0 THEN pos * tp / (tp + fp) ELSE 0 END) / max(p) AS average_precision,
  sum(neg * (tp - pos / 2)) / (max(p) * max(n)) AS roc_auc FROM cum WHERE p > 0 AND n > 0 GROUP BY 1),
cut AS (SELECT replicate, sum(w) FILTER (score >= 0.5 AND label = 1) AS tp, sum(w) FILTER (score >= 0.5 AND label = 0) AS fp,
  sum(w) FILTER (score < 0.5 AND label = 1) AS fn FROM drawn GROUP BY 1),
valid AS (SELECT average_precision, roc_auc, 2 * tp / (2 * tp + fp + fn) AS f1, tp / (tp + fn) AS recall FROM ranked JOIN cut USING (replicate))""",
                select=" UNION ALL ".join(f"""SELECT '{m}' AS metric, count(*) AS valid_replicates, avg({m}) AS mean,
  quantile_cont({m}, 0.025) AS low, quantile_cont({m}, 0.975) AS high FROM valid""" for m in METRICS)),
    doubles=["mean", "low", "high"],
)
REPORTS.add(
    "class_weights",
    lambda s, d: sc.class_weights(SCORES(s, d).filter("split = 'train'").withColumn("stage", F.col("event_id") % 7 % 3),
                                  "stage", 3),
    with_tables(SCORES_SQL, select="""SELECT event_id % 7 % 3 AS stage, count(*) AS "count",
  sum(count(*)) OVER () / (3 * count(*)) AS weight FROM scores WHERE split = 'train' GROUP BY 1"""), doubles=["weight"],
)


def stage_rows(s, d):
    """A true and a predicted class per event and horizon step."""
    base = SCORES(s, d).select("event_id", F.round(F.col("score") * 1000).cast("long").alias("m"),
                               F.explode(F.sequence(F.lit(1), F.lit(6))).alias("step"))
    true = (F.col("event_id") + F.col("step")) % 5
    return base.select("event_id", "step", true.cast("int").alias("true"),
                       F.when(F.col("m") % 3 == 0, F.col("m") % 6).otherwise(true).cast("int").alias("predicted"))


STAGE_SQL = """
stage_rows AS (SELECT event_id, step, (event_id + step) % 5 AS "true",
  CASE WHEN m % 3 = 0 THEN m % 6 ELSE (event_id + step) % 5 END AS predicted
  FROM (SELECT event_id, CAST(round(score * 1000) AS BIGINT) AS m, unnest([1,2,3,4,5,6]) AS step FROM scores)),
cls AS (SELECT step, unnest([0,1,2,3,4,5]) AS "class" FROM (SELECT unnest([1,2,3,4,5,6]) AS step)),
per_class AS (SELECT {keys}"class", count(*) FILTER ("true" = "class") AS support,
  count(*) FILTER (predicted = "class") AS n_pred, count(*) FILTER ("true" = "class" AND predicted = "class") AS hit
  FROM stage_rows JOIN cls USING (step) GROUP BY ALL),
per_class_rates AS (SELECT {keys}"class", support, CASE WHEN n_pred > 0 THEN hit / n_pred ELSE 0 END AS "precision",
  CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall,
  CASE WHEN support + n_pred > 0 THEN 2 * hit / (support + n_pred) ELSE 0 END AS f1 FROM per_class)"""
REPORTS.add("stage_confusion", lambda s, d: sc.stage_confusion(stage_rows(s, d)),
            with_tables(SCORES_SQL, STAGE_SQL.format(keys=""),
                        select='SELECT "true", predicted, count(*) AS n FROM stage_rows GROUP BY ALL'))
REPORTS.add(
    "stage_class_metrics",
    lambda s, d: sc.unsupported_to_null(sc.class_metrics(sc.stage_confusion(stage_rows(s, d))), [5]),
    with_tables(SCORES_SQL, STAGE_SQL.format(keys=""), select="""SELECT "class", support,
  CASE WHEN support > 0 OR "class" <> 5 THEN "precision" END AS "precision",
  CASE WHEN support > 0 OR "class" <> 5 THEN recall END AS recall,
  CASE WHEN support > 0 OR "class" <> 5 THEN f1 END AS f1 FROM per_class_rates"""), doubles=["recall", "f1"],
)
REPORTS.add(
    "stage_macro_by_step",
    lambda s, d: sc.macro_scores(sc.stage_confusion(stage_rows(s, d), ["step"]), ["step"]),
    with_tables(SCORES_SQL, STAGE_SQL.format(keys="step, "), select="""SELECT step, accuracy, macro_f1 FROM
  (SELECT step, avg(CASE WHEN "true" = predicted THEN 1.0 ELSE 0.0 END) AS accuracy FROM stage_rows GROUP BY 1) JOIN
  (SELECT step, avg(f1) AS macro_f1 FROM per_class_rates GROUP BY 1) USING (step)"""), doubles=["accuracy", "macro_f1"],
)


def trajectories(s, d):
    """Six step scores and targets per prediction."""
    m = F.round(F.col("score") * 1000).cast("long")
    return SCORES(s, d).withColumns({
        "steps": F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: (m + k * 37 * (F.col("event_id") % 4)) % 1000 / 1000),
        "targets": F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.when(
            (F.floor(F.col("event_id") / 10) + k * (F.col("event_id") % 3)) % 5 == 0, 1).otherwise(0)),
        "current_attack": F.when(F.col("event_id") % 3 == 0, 1).otherwise(0),
    })


def step_rows(s, d):
    return trajectories(s, d).select("event_id", "split", F.posexplode(F.arrays_zip("steps", "targets")).alias("i", "z")).select(
        "event_id", "split", (F.col("i") + 1).alias("step"), F.col("z.steps").alias("score"), F.col("z.targets").alias("label"))


STEPS_SQL = """
step_rows AS (SELECT event_id, split, step, (m + step * 37 * (event_id % 4)) % 1000 / 1000 AS score,
  CASE WHEN (event_id // 10 + step * (event_id % 3)) % 5 = 0 THEN 1 ELSE 0 END AS label, whole
  FROM (SELECT event_id, split, score AS whole, CAST(round(score * 1000) AS BIGINT) AS m, unnest([1,2,3,4,5,6]) AS step FROM scores)),
v AS (SELECT * FROM step_rows WHERE split = 'validation'), t AS (SELECT * FROM step_rows WHERE split = 'test')"""
PER_STEP_SQL = STEPS_SQL + "," + ladder_sql("v", "step", "0.5", "vl") + "," + ladder_sql("t", "step", name="tl") + """,
cut AS (SELECT step, arg_max(threshold, {'f': f1, 't': -threshold}) AS threshold FROM vl GROUP BY 1),
tc AS (SELECT * FROM t JOIN cut USING (step)),""" + confusion_sql("tc", "threshold", "step, threshold").replace("\n", "\n", 1) + """,
rk AS (SELECT step, sum(pos / positives * tp / (tp + fp)) AS average_precision,
  sum(neg * (tp - pos / 2)) / max(positives * negatives) AS roc_auc FROM tl GROUP BY 1),
per_step AS (SELECT * FROM cm JOIN rk USING (step))"""


def per_step(s, d):
    rows = step_rows(s, d)
    return sc.per_step_evaluation(rows.filter("split = 'validation'"), rows.filter("split = 'test'"))


REPORTS.add("per_step_metrics", per_step, with_tables(SCORES_SQL, PER_STEP_SQL, select="SELECT * FROM per_step"),
            doubles=["recall", "f1", "fpr", "average_precision", "roc_auc"])
REPORTS.add(
    "horizon_means", lambda s, d: sc.horizon_means(per_step(s, d)),
    with_tables(SCORES_SQL, PER_STEP_SQL, select="SELECT " + ", ".join(
        f"avg({q}) AS mean_{n}" for q, n in [("average_precision",) * 2, ("roc_auc",) * 2, *zip(Q, RATES)]) + """,
  bool_and(coalesce(prev >= average_precision - 1e-9, true)) AS monotonic_non_increasing
  FROM (SELECT *, lag(average_precision) OVER (ORDER BY step) AS prev FROM per_step)"""),
    doubles=[f"mean_{c}" for c in ("average_precision", "roc_auc", *RATES)],
)
REPORTS.add(
    "persistence_baseline",
    lambda s, d: sc.baseline_scores(trajectories(s, d), "current_attack", "score").select(
        "event_id", F.aggregate("persistence", F.lit(0.0), lambda a, v: a + v).alias("persistence_total"),
        F.size("broadcast").alias("steps"), F.col("broadcast")[5].alias("last_score")),
    with_tables(SCORES_SQL, select="""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 6::DOUBLE ELSE 0::DOUBLE END AS persistence_total,
  6 AS steps, score AS last_score FROM scores"""),
)
REPORTS.add(
    "trajectory_diagnostics", lambda s, d: sc.trajectory_diagnostics(trajectories(s, d), "steps", "targets", "event_id"),
    with_tables(SCORES_SQL, STEPS_SQL, """
ch AS (SELECT *, abs(score - lag(score) OVER w) AS delta, first_value(score) OVER w AS f FROM step_rows
  WINDOW w AS (PARTITION BY event_id ORDER BY step)),
e AS (SELECT event_id, max(abs(score - f)) > 1e-4 + 1e-5 * any_value(f) AS moving,
  CASE WHEN min(score) <> max(score) AND min(label) <> max(label) THEN corr(score, label) END AS r FROM ch GROUP BY 1)""",
                select="""SELECT (SELECT avg(delta) FROM ch) AS mean_abs_step_change,
  avg(CASE WHEN moving THEN 1.0 ELSE 0.0 END) AS fraction_non_constant, avg(r) AS mean_correlation,
  count(r) AS defined_correlations FROM e"""),
    doubles=["mean_abs_step_change", "fraction_non_constant", "mean_correlation"],
)
REPORTS.add(
    "whole_horizon_consistency", lambda s, d: sc.whole_horizon_consistency(trajectories(s, d), "score", "steps"),
    with_tables(SCORES_SQL, STEPS_SQL, """e AS (SELECT event_id, any_value(whole) AS w, 1 - product(1 - score) AS p
  FROM step_rows GROUP BY 1)""", select="SELECT avg(abs(p - w)) AS mae, corr(p, w) AS pearson FROM e"),
    doubles=["mae", "pearson"],
)


def state_pairs(s, d):
    """Predicted and actual [6][2] states."""
    m = F.round(F.col("score") * 1000).cast("long")
    steps = F.sequence(F.lit(1), F.lit(6))
    return SCORES(s, d).select(
        "event_id", F.transform(steps, lambda k: F.array((m + k) / 10.0, (m * k) % 17 / 1.0)).alias("predicted"),
        F.transform(steps, lambda k: F.array((m + k * k) / 10.0, (m * k) % 13 / 1.0)).alias("actual"))


CELLS_SQL = """
cells AS (SELECT event_id, step, f, CASE WHEN f = 0 THEN (step - step * step) / 10 ELSE (m * step) % 17 - (m * step) % 13 END AS d
  FROM (SELECT event_id, step, m, unnest([0, 1]) AS f FROM (SELECT event_id, CAST(round(score * 1000) AS BIGINT) AS m,
    unnest([1,2,3,4,5,6]) AS step FROM scores)))"""
REPORTS.add(
    "horizon_error", lambda s, d: sc.horizon_state_error(state_pairs(s, d), "predicted", "actual"),
    with_tables(SCORES_SQL, CELLS_SQL, select="""SELECT step AS horizon_step, avg(d * d) AS mse, avg(abs(d)) AS mae FROM cells
  GROUP BY 1"""), doubles=["mse", "mae"],
)
REPORTS.add(
    "feature_error", lambda s, d: sc.horizon_state_error(state_pairs(s, d), "predicted", "actual", by_feature=True),
    with_tables(SCORES_SQL, CELLS_SQL, "e AS (SELECT f, avg(d * d) AS mse, avg(abs(d)) AS mae FROM cells GROUP BY 1)",
                select="SELECT f AS feature, mse, mae, mse * 100 / sum(mse) OVER () AS share_pct FROM e"),
    doubles=["mse", "mae", "share_pct"],
)
REPORTS.add(
    "detection_by_first_step",
    lambda s, d: sc.detection_by_first_step(SCORES(s, d).withColumn(
        "future_attack_step", F.col("event_id") % 6), 0.5),
    with_tables(SCORES_SQL, """g AS (SELECT unnest([0,1,2,3,4,5,6]) AS step)""", select="""SELECT step AS future_attack_step,
  count(score) AS samples, avg(score) AS mean_score, avg(CASE WHEN score >= 0.5 THEN 1.0 WHEN score < 0.5 THEN 0.0 END)
  AS positive_rate FROM g LEFT JOIN scores ON event_id % 6 = step GROUP BY 1"""), doubles=["mean_score", "positive_rate"],
)
REPORTS.add(
    "onset_split",
    lambda s, d: sc.onset_split(SCORES(s, d).filter("split = 'test'").join(
        trajectories(s, d).select("event_id", "current_attack"), "event_id"), 0.5, ["source_file"]),
    with_tables(SCORES_SQL, TEST_SQL, select="""SELECT source_file, count(*) AS n, count(*) FILTER (label = 1) AS positives,
  count(*) FILTER (label = 1 AND event_id % 3 > 0) AS onset_positives,
  count(*) FILTER (label = 1 AND event_id % 3 = 0) AS ongoing_positives,
  count(*) FILTER (label = 1 AND event_id % 3 > 0 AND score >= 0.5) / count(*) FILTER (label = 1 AND event_id % 3 > 0) AS onset_recall,
  count(*) FILTER (label = 1 AND event_id % 3 = 0 AND score >= 0.5) / count(*) FILTER (label = 1 AND event_id % 3 = 0) AS ongoing_recall,
  count(*) FILTER (label = 0 AND score >= 0.5) / count(*) FILTER (label = 0) AS false_positive_rate FROM test GROUP BY 1"""),
    doubles=["onset_recall", "ongoing_recall", "false_positive_rate"],
)
REPORTS.add(
    "model_alignment",
    lambda s, d: sc.alignment_check(
        SCORES(s, d).withColumn("event_id", F.when(F.col("score") < 0.75, F.col("event_id")).otherwise(-1 - F.col("event_id"))),
        SCORES(s, d).withColumn("event_id", F.when(F.col("score") >= 0.02, F.col("event_id")).otherwise(
            F.col("event_id") + 10 ** 15)).withColumn("label", F.when(F.col("score").between(0.5, 0.51), 2).otherwise(
            F.col("label"))), ["source_file", "event_id"]),
    with_tables(SCORES_SQL, select="""SELECT count(*) FILTER (score < 0.02 OR score >= 0.75) AS only_left,
  count(*) FILTER (score < 0.02 OR score >= 0.75) AS only_right,
  count(*) FILTER (score BETWEEN 0.5 AND 0.51) AS label_mismatches, false AS aligned FROM scores"""),
)


def two_models(s, d):
    rows = SCORES(s, d).withColumn("model", F.lit("base"))
    other = rows.withColumns({"model": F.lit("steps"), "score": F.round(F.when(F.col("label") == 1, 0.3).otherwise(0.0)
                             + F.col("score") * 0.7, 4)})
    return rows.unionByName(other)


MODELS_SQL = """
models AS (SELECT 'base' AS model, * FROM scores UNION ALL
  SELECT 'steps' AS model, * REPLACE (round(CASE WHEN label = 1 THEN 0.3 ELSE 0.0 END + score * 0.7, 4) AS score) FROM scores),
mv AS (SELECT * FROM models WHERE split = 'validation'), mt AS (SELECT * FROM models WHERE split = 'test')"""
COMPARE_SQL = MODELS_SQL + "," + ladder_sql("mv", "model", name="vl") + "," + ladder_sql("mt", "model", name="tl") + """,
cut AS (SELECT model, arg_max(threshold, {'tp': tp, 't': threshold}) AS threshold, max(recall) AS validation_recall FROM vl
  WHERE fpr <= 0.05 GROUP BY 1),
mc AS (SELECT * FROM mt JOIN cut USING (model)),""" + confusion_sql("mc", "threshold", "model, threshold, validation_recall") + """,
rk AS (SELECT model, sum(pos / positives * tp / (tp + fp)) AS average_precision,
  sum(neg * (tp - pos / 2)) / max(positives * negatives) AS roc_auc FROM tl GROUP BY 1),
cmp AS (SELECT * FROM cm JOIN rk USING (model))"""
REPORTS.add(
    "model_comparison", lambda s, d: sc.compare_models(two_models(s, d)),
    with_tables(SCORES_SQL, COMPARE_SQL, select="""SELECT *, (SELECT arg_max(model, average_precision) FROM cmp) AS best_average_precision,
  (SELECT arg_max(model, roc_auc) FROM cmp) AS best_roc_auc, (SELECT arg_max(model, validation_recall) FROM cmp)
  AS best_validation_recall, (SELECT arg_max(model, f1) FROM cmp) AS best_f1, (SELECT arg_min(model, fpr) FROM cmp) AS lowest_fpr
  FROM cmp"""), doubles=["recall", "f1", "fpr", "validation_recall", "average_precision", "roc_auc"],
)


def uneven_models(s, d):
    """The second model lacks some test samples and has other labels on some validation ones."""
    i, other = F.col("event_id"), F.col("model") == "steps"
    return two_models(s, d).filter(~(other & (F.col("split") == "test") & (i % 97 == 0))).withColumn(
        "label", F.when(other & (F.col("split") == "validation") & (i % 89 == 0), 1 - F.col("label")).otherwise(F.col("label")))


REPORTS.add(
    "comparison_checks", lambda s, d: sc.comparison_checks(uneven_models(s, d), ["source_file", "event_id"]),
    with_tables(SCORES_SQL, """
two AS (SELECT 'base' AS model, split, source_file, event_id, label FROM scores UNION ALL
  SELECT 'steps', split, source_file, event_id, CASE WHEN split = 'validation' AND event_id % 89 = 0 THEN 1 - label ELSE label END
  FROM scores WHERE NOT (split = 'test' AND event_id % 97 = 0)),
pm AS (SELECT split, model, count(*) AS n, count(*) FILTER (label = 1) AS p FROM two GROUP BY ALL),
sz AS (SELECT split, count(*) AS models, min(n) AS least_samples, max(n) AS most_samples, min(p) AS least_positives,
  max(p) AS most_positives, min(p) = max(p) AS prevalence_equal FROM pm GROUP BY 1),
ks AS (SELECT split, source_file, event_id, count(*) AS held, min(label) <> max(label) AS odd FROM two GROUP BY ALL),
fd AS (SELECT split, count(*) FILTER (held < 2) AS missing_samples, count(*) FILTER (held = 2 AND odd) AS label_mismatches FROM ks GROUP BY 1)""",
                select="""SELECT *, CASE WHEN prevalence_equal AND missing_samples = 0 AND label_mismatches = 0 AND models = 2
  THEN 'PASS' ELSE 'FAIL' END AS status FROM sz JOIN fd USING (split)"""),
)
REPORTS.add(
    "claim_verdict", lambda s, d: sc.claim_verdict(sc.compare_models(two_models(s, d)), "steps", "base"),
    with_tables(SCORES_SQL, COMPARE_SQL, select="""SELECT CASE WHEN max(average_precision) FILTER (model = 'steps') >
  max(average_precision) FILTER (model = 'base') AND max(roc_auc) FILTER (model = 'steps') > max(roc_auc) FILTER (model = 'base')
  THEN 'PARTIALLY SUPPORTED' ELSE 'NOT SUPPORTED' END AS verdict FROM cmp"""),
)
REPORTS.add(
    "family_holdout",
    lambda s, d: sc.family_holdout(SCORES(s, d), ["site-1"]).groupBy("split", "source_file").agg(F.count("*").alias("n")),
    with_tables(SCORES_SQL, select="""SELECT split, source_file, count(*) AS n FROM scores
  WHERE split = 'test' OR source_file <> 'site-1' GROUP BY ALL"""),
)
SUBSETS_SQL = """
subsets AS (SELECT 'full' AS subset, * FROM test UNION ALL SELECT 'unseen', * FROM test WHERE label = 0 OR source_file = 'site-1'
  UNION ALL SELECT 'seen', * FROM test WHERE label = 0 OR source_file <> 'site-1')"""
REPORTS.add(
    "holdout_metrics", lambda s, d: sc.holdout_metrics(SCORES(s, d).filter("split = 'test'"), ["site-1"], 0.5),
    with_tables(SCORES_SQL, TEST_SQL, SUBSETS_SQL, confusion_sql("subsets", "0.5", "subset"),
                ladder_sql("subsets", "subset"), """
rk AS (SELECT subset, sum(pos / positives * tp / (tp + fp)) AS average_precision,
  sum(neg * (tp - pos / 2)) / max(positives * negatives) AS roc_auc FROM ladder GROUP BY 1)""",
                select="SELECT *, tn / (tn + fp) AS specificity FROM cm JOIN rk USING (subset)"),
    doubles=["recall", "f1", "fpr", "specificity", "average_precision", "roc_auc"],
)


def hourly(s, d, value):
    events = adapters.table(s, d, "events")
    return events.groupBy(F.window("ts", "1 hour").start.alias("window_start")).agg(value.alias("value"))


HOURLY_SQL = """
a AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS x FROM events GROUP BY 1),
b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 2 HOUR AS w, sum(user_id) AS y FROM events GROUP BY 1),
c AS (SELECT h AS offset_hours, count(*) AS overlap, corr(x, y) AS pearson FROM (SELECT unnest([0,1,2,3,4,5,6,7,8]) AS h) o,
  a JOIN b ON b.w = a.w + to_hours(h) GROUP BY 1)"""


def correlations(s, d):
    delayed = hourly(s, d, F.sum("user_id")).withColumn(
        "window_start", F.col("window_start") + F.expr("INTERVAL 2 HOURS"))
    return sc.offset_correlations(hourly(s, d, F.count("*")), delayed)


REPORTS.add("clock_offset_corr", correlations, with_tables(HOURLY_SQL, select="SELECT * FROM c"), doubles=["pearson"])
REPORTS.add(
    "alignment_decision", lambda s, d: sc.alignment_decision(correlations(s, d)),
    with_tables(HOURLY_SQL, "r AS (SELECT *, row_number() OVER (ORDER BY abs(pearson) DESC, offset_hours) AS k FROM c)",
                select="""SELECT max(offset_hours) FILTER (k = 1) AS best_offset_hours, max(abs(pearson)) FILTER (k = 1) AS best_abs_r,
  max(abs(pearson)) FILTER (k = 2) AS runner_up_abs_r, CASE WHEN max(abs(pearson)) FILTER (k = 1) >= 0.3 AND
  max(abs(pearson)) FILTER (k = 1) / max(abs(pearson)) FILTER (k = 2) >= 2 THEN 'PROCEED' ELSE 'STOP' END AS decision FROM r"""),
    doubles=["best_abs_r", "runner_up_abs_r"],
)


def clock_events(s, d):
    return adapters.table(s, d, "events").select(F.date_trunc("second", "ts").alias("timestamp"))


REPORTS.add(
    "clock_offset_vote",
    lambda s, d: sc.clock_offset_votes(
        clock_events(s, d).withColumn("timestamp", F.col("timestamp") - F.expr("INTERVAL 4 HOURS")), clock_events(s, d)),
    """WITH p AS (SELECT epoch(date_trunc('second', ts))::BIGINT % 86400 AS t FROM events),
l AS (SELECT (t - 14400 + 86400) % 86400 AS t FROM p),
v AS (SELECT h AS offset_hours, count(*) FILTER ((l.t + h * 3600) % 86400 IN (SELECT t FROM p)) AS matches
  FROM l, (SELECT unnest(generate_series(0, 12)) AS h) GROUP BY 1)
SELECT offset_hours, matches, row_number() OVER (ORDER BY matches DESC, offset_hours) = 1 AS is_best,
  max(matches) OVER () = (SELECT count(*) FROM p) AS established FROM v""",
)


def errors(s, d):
    m = F.round(F.col("score") * 1000).cast("long")
    return SCORES(s, d).select(F.col("event_id").alias("sample_id"), (m % 97 * (m % 97)).cast("double").alias("sse"))


ERRORS_SQL = """
err AS (SELECT event_id AS sample_id, CAST((m % 97) * (m % 97) AS DOUBLE) AS sse FROM
  (SELECT event_id, CAST(round(score * 1000) AS BIGINT) AS m FROM scores))"""
REPORTS.add(
    "worst_samples", lambda s, d: sc.worst_samples(errors(s, d)),
    with_tables(SCORES_SQL, ERRORS_SQL, select="""SELECT sample_id, sse, sse * 100 / (SELECT sum(sse) FROM err) AS share_pct
  FROM err ORDER BY sse DESC, sample_id LIMIT 25"""), doubles=["share_pct"],
)
REPORTS.add(
    "worst_share", lambda s, d: sc.worst_share(errors(s, d)),
    with_tables(SCORES_SQL, ERRORS_SQL, """
r AS (SELECT sse, row_number() OVER (ORDER BY sse DESC) AS k, count(*) OVER () AS n, sum(sse) OVER () AS t FROM err),
p AS (SELECT unnest([1, 5, 10]) AS percent)""", select="""SELECT percent, CAST(greatest(1, max(ceil(n * percent / 100))) AS BIGINT) AS samples,
  sum(CASE WHEN k <= greatest(1, ceil(n * percent / 100)) THEN sse ELSE 0 END) * 100 / max(t) AS share_pct FROM r, p GROUP BY 1"""),
    doubles=["share_pct"],
)
