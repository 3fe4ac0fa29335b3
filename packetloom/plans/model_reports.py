"""Scaling, baselines, calibration and attribution reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom import adapters
from packetloom.operators import models as md
from packetloom.plans import dataset_reports as dr
from packetloom.plans.newton_sql import fit_sql, margin_sql
from packetloom.plans.score_reports import confusion_sql, ladder_sql
from packetloom.plans.registry import Reports, with_tables

REPORTS = Reports()
STATE = ["flow_count", "packet_length__sum", "ttl__mean", "rate__sum"]


def scaler(s, d):
    return md.fit_scaler(md.history_weights(dr.labelled(s, d)), STATE, "weight")


WEIGHTS_SQL = """
weighted AS (SELECT *, sum(CASE WHEN eligible AND split = 'train' THEN 1 ELSE 0 END) OVER (PARTITION BY source_file ORDER BY window_start
  ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS w FROM labelled)"""


def _scaler_sql(source: str, columns: dict[str, str]) -> str:
    means = ", ".join(f"sum(w * {e}) / sum(w) AS m_{c}" for c, e in columns.items())
    scales = ", ".join(f"sqrt(sum(w * ({e} - m_{c}) ** 2) / sum(w)) AS s_{c}" for c, e in columns.items())
    return f"""
means AS (SELECT {means} FROM {source}), scales AS (SELECT {scales} FROM {source}, means)"""


PLAIN = {c: f"CAST({c} AS DOUBLE)" for c in STATE}
REPORTS.add(
    "train_scaler",
    lambda s, d: scaler(s, d).select(F.posexplode(F.arrays_zip("mean", "scale")).alias("i", "z")).select(
        F.get(F.array(*map(F.lit, STATE)), F.col("i")).alias("feature"), "z.mean", "z.scale"),
    with_tables(*dr.LABELLED, WEIGHTS_SQL, _scaler_sql("weighted", PLAIN), select=" UNION ALL ".join(
        f"SELECT '{c}' AS feature, m_{c} AS mean, s_{c} AS scale FROM means, scales" for c in STATE)), doubles=["mean", "scale"], digits=4,
)
REPORTS.add(
    "state_scaler",
    lambda s, d: md.fit_scaler(dr.labelled(s, d).filter("split = 'train'"), STATE).select(
        F.posexplode(F.arrays_zip("mean", "scale")).alias("i", "z")).select("i", "z.mean", "z.scale"),
    with_tables(*dr.LABELLED, "tr AS (SELECT *, 1 AS w FROM labelled WHERE split = 'train')", _scaler_sql("tr", PLAIN),
                select=" UNION ALL ".join(f"SELECT {i} AS i, m_{c} AS mean, s_{c} AS scale FROM means, scales"
                                          for i, c in enumerate(STATE))), doubles=["mean", "scale"], digits=4,
)
REPORTS.add(
    "scaled_states",
    lambda s, d: md.scale_states(dr.labelled(s, d), STATE, scaler(s, d)).select("source_file", "window_start", *STATE),
    with_tables(*dr.LABELLED, WEIGHTS_SQL, _scaler_sql("weighted", PLAIN), select="SELECT source_file, window_start, " + ", ".join(
        f"({c} - m_{c}) / s_{c} AS {c}" for c in STATE) + " FROM labelled, means, scales"), doubles=STATE,
)
REPORTS.add(
    "hybrid_scaled_states",
    lambda s, d: md.scale_states(
        md.log_heavy_tails(dr.labelled(s, d), ["rate__sum"]), STATE,
        md.fit_scaler(md.history_weights(md.log_heavy_tails(dr.labelled(s, d), ["rate__sum"])), STATE, "weight")).select(
        "source_file", "window_start", *STATE),
    with_tables(*dr.LABELLED, WEIGHTS_SQL, _scaler_sql("weighted", {**PLAIN, "rate__sum": "ln(1 + rate__sum)"}),
                select="SELECT source_file, window_start, " + ", ".join(
        f"({'ln(1 + rate__sum)' if c == 'rate__sum' else c} - m_{c}) / s_{c} AS {c}" for c in STATE)
        + " FROM labelled, means, scales"), doubles=STATE,
)
REPORTS.add(
    "inverse_scaled_states",
    lambda s, d: md.inverse_scale(md.scale_states(dr.labelled(s, d), STATE, scaler(s, d)), STATE, scaler(s, d)).select(
        "source_file", "window_start", *STATE),
    with_tables(*dr.LABELLED, select=f"SELECT source_file, window_start, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in STATE)} FROM labelled"),
    doubles=STATE, digits=4,
)
REPORTS.add(
    "max_abs_states",
    lambda s, d: md.max_abs_scale(dr.rows(s, d), ["rate", "ttl"]).select("event_id", "rate", "ttl"),
    with_tables(adapters.PACKETS_SQL, dr.ROWS_SQL, select="""SELECT event_id, coalesce(rate, 0) / (1 + (SELECT max(rate) FROM rows_in)) AS rate,
  ttl / (1 + (SELECT max(ttl) FROM rows_in)) AS ttl FROM rows_in"""), doubles=["rate", "ttl"],
)
REPORTS.add(
    "input_contract",
    lambda s, d: adapters.table(s, d, "events").select("event_id", md.meets_contract(
        F.array_repeat(F.array(F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")), F.lit(1.0)),
                       F.when(F.col("event_id") % 5 == 0, 5).otherwise(6)), 6, 2).alias("valid")),
    "SELECT event_id, event_id % 7 > 0 AND event_id % 5 > 0 AS valid FROM events",
)


def vectors(s, d):
    return adapters.table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("state"))


VECTORS_SQL = "vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS state FROM embeddings)"
REPORTS.add(
    "heuristic_risk", lambda s, d: vectors(s, d).select("vec_id", md.heuristic_risk(F.col("state")).alias("risk")),
    with_tables(VECTORS_SQL, select="SELECT vec_id, 1 / (1 + exp(-list_sum(state) / len(state))) AS risk FROM vectors"), doubles=["risk"],
)
REPORTS.add(
    "heuristic_forecast", lambda s, d: md.heuristic_forecast(vectors(s, d), "state", "vec_id", ["label"]),
    with_tables(VECTORS_SQL, """l AS (SELECT label, arg_max(1 / (1 + exp(-list_sum(state) / len(state))), vec_id) AS r FROM vectors GROUP BY 1)""",
                select="""SELECT label, round(r * 0.74, 2) AS current_risk, round(r, 2) AS forecasted_risk, round(greatest(r, 1 - r), 2)
  AS confidence FROM l"""),
)
REPORTS.add(
    "topk_features",
    lambda s, d: md.top_features(md.feature_importance_rows(vectors(s, d), ["vec_id"], F.transform("state", F.abs)), ["vec_id"], 8),
    with_tables(VECTORS_SQL, """
e AS (SELECT vec_id, i - 1 AS feature_index, abs(state[i]) AS importance FROM (SELECT vec_id, state,
  unnest(generate_series(1, len(state))) AS i FROM vectors)),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY importance DESC, feature_index) AS rank,
  importance / max(importance) OVER (PARTITION BY vec_id) AS relative_importance FROM e)""",
                select="SELECT *, round(relative_importance * 100, 2) AS percentage FROM r WHERE rank <= 8"),
    doubles=["importance", "relative_importance"],
)
WEIGHTS = [[((w * 4 + f) % 7 - 3) / 10 for f in range(4)] for w in range(16)]


def windows_of_vectors(s, d):
    """The 64 components of a vector, read as sixteen windows of four features."""
    return vectors(s, d).withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda w: F.slice("state", w * 4 + 1, 4)))


def attributed(s, d):
    weights = F.array(*[F.array(*map(F.lit, row)) for row in WEIGHTS])
    return windows_of_vectors(s, d).withColumn("a", md.gradient_x_input(F.col("x"), weights, 0.1))


CELLS_SQL = """
cells AS (SELECT vec_id, i // 4 AS w, i % 4 AS f, state[i + 1] * (((i // 4 * 4 + i % 4) % 7 - 3) / 10) AS v FROM (
  SELECT vec_id, state, unnest(generate_series(0, len(state) - 1)) AS i FROM vectors)),
margins AS (SELECT vec_id, 1 / (1 + exp(-(0.1 + sum(v)))) AS p FROM cells GROUP BY 1),
attr AS (SELECT vec_id, w, f, p * (1 - p) * abs(v) AS importance FROM cells JOIN margins USING (vec_id))"""
REPORTS.add(
    "gradient_x_input",
    lambda s, d: md.feature_importance_rows(attributed(s, d).withColumn("m", md.mean_over_windows(F.col("a"))), ["vec_id"], F.col("m")),
    with_tables(VECTORS_SQL, CELLS_SQL, select="SELECT vec_id, f AS feature_index, avg(importance) AS importance FROM attr GROUP BY 1, 2"),
    doubles=["importance"], digits=9,
)
REPORTS.add(
    "topk_per_window",
    lambda s, d: md.top_features(attributed(s, d).select("vec_id", F.posexplode("a").alias("w", "row")).select(
        "vec_id", "w", F.posexplode("row").alias("feature_index", "importance")), ["vec_id", "w"], 2).select(
        "vec_id", "w", "feature_index", "rank"),
    with_tables(VECTORS_SQL, CELLS_SQL, select="""SELECT vec_id, w, f AS feature_index, row_number() OVER (PARTITION BY vec_id, w
  ORDER BY importance DESC, f) AS rank FROM attr QUALIFY rank <= 2"""),
)
REPORTS.add(
    "sample_pick", lambda s, d: md.pick_samples(adapters.scores(s, d), 5, 3, ["event_id"]).select("event_id", "label"),
    with_tables(adapters.SCORES_SQL, select="""(SELECT event_id, label FROM scores WHERE label = 0 ORDER BY event_id LIMIT 5) UNION ALL
  (SELECT event_id, label FROM scores WHERE label = 1 ORDER BY event_id LIMIT 3)"""),
)


def state_sequences(s, d):
    from packetloom.operators.dataset import assemble_sequences

    scaled = md.scale_states(dr.labelled(s, d), STATE, scaler(s, d))
    return assemble_sequences(scaled, STATE)


TARGET = "future_attack_within_horizon"


def logistic(s, d):
    samples = state_sequences(s, d)
    model = md.fit_logistic(samples.filter("split = 'train'"), F.flatten("x"), TARGET, single_class=True)
    return md.logistic_scores(model, samples, F.flatten("x")).select("source_file", "window_start", "split", TARGET, "score")


SCALED_SQL = _scaler_sql("weighted", PLAIN) + f""",
scaled AS (SELECT source_file, window_start, split, eligible, {TARGET}, attack_list[1] AS next_attack,
  [{', '.join(f'({c} - m_{c}) / s_{c}' for c in STATE)}] AS v FROM labelled, means, scales),
histories AS (SELECT * FROM (SELECT *, flatten(list(v) OVER (PARTITION BY source_file ORDER BY window_start ROWS 5 PRECEDING)) AS h
  FROM scaled) WHERE eligible)"""
WIDTH = 6 * len(STATE)
LOGISTIC_SQL = (*dr.LABELLED, WEIGHTS_SQL, SCALED_SQL, f"train AS (SELECT list_append(h, 1.0) AS x, {TARGET} AS y FROM histories WHERE split = 'train')",
                *fit_sql("train", WIDTH, balanced=True), f"""
scored AS MATERIALIZED (SELECT source_file, window_start, split, {TARGET}, {TARGET} AS label,
  {margin_sql('list_append(h, 1.0)')} AS score FROM histories, train_fit)""")
REPORTS.add("logistic_scores", logistic, with_tables(
    *LOGISTIC_SQL, select=f"SELECT source_file, window_start, split, {TARGET}, score FROM scored"), doubles=["score"])
REPORTS.add(
    "logistic_metrics", lambda s, d: md.logistic_operating_metrics(state_sequences(s, d), F.flatten("x"), TARGET),
    with_tables(*LOGISTIC_SQL, "val AS (SELECT * FROM scored WHERE split = 'validation')", "tst AS (SELECT * FROM scored WHERE split = 'test')",
                ladder_sql("val", extra="0.5"), "cut AS MATERIALIZED (SELECT threshold FROM ladder ORDER BY f1 DESC, threshold LIMIT 1)",
                confusion_sql("tst", "(SELECT threshold FROM cut)"), ladder_sql("tst", name="lt"), select="""SELECT cm.*, threshold,
  (SELECT CASE WHEN max(positives) > 0 THEN sum(pos * tp / (tp + fp)) / max(positives) END FROM lt) AS average_precision,
  (SELECT CASE WHEN max(positives * negatives) > 0 THEN sum(neg * (tp - pos / 2)) / max(positives * negatives) END FROM lt) AS roc_auc
  FROM cm, cut"""),
    doubles=["precision", "recall", "f1", "fpr", "threshold", "average_precision", "roc_auc"],
)


def static_importance(s, d):
    samples = state_sequences(s, d).withColumn("next_attack", F.get("attack_steps", F.lit(0)))
    model = md.fit_logistic(samples.filter("split = 'train'"), md.last_state(), "next_attack", single_class=True)
    return md.coefficient_importance(s, model, STATE)


REPORTS.add(
    "static_logistic_importance", static_importance,
    with_tables(*dr.LABELLED, WEIGHTS_SQL, SCALED_SQL, "train AS (SELECT list_append(v, 1.0) AS x, next_attack AS y FROM histories WHERE split = 'train')",
                *fit_sql("train", len(STATE), balanced=True), select=" UNION ALL ".join(
        f"SELECT '{c}' AS feature, b[{i + 1}] AS coefficient, abs(b[{i + 1}]) AS importance FROM train_fit" for i, c in enumerate(STATE))),
    doubles=["coefficient", "importance"],
)


def linear_model():
    """A user model's loader: the mean of the newest state squashed to (0, 1)."""
    def load():
        import numpy as np

        def predict(batch):
            return 1 / (1 + np.exp(-batch[:, -1, :].mean(axis=1)))

        return predict

    return load


REPORTS.add(
    "batch_model_scores",
    lambda s, d: md.score_with_model(windows_of_vectors(s, d), linear_model(), "x", (16, 4)).select("vec_id", "score"),
    with_tables(VECTORS_SQL, select="SELECT vec_id, 1 / (1 + exp(-(state[61] + state[62] + state[63] + state[64]) / 4)) AS score FROM vectors"),
    doubles=["score"],
)


def validation(s, d):
    return adapters.scores(s, d).filter("split = 'validation'")


PLATT_SQL = (adapters.SCORES_SQL, "valid AS (SELECT *, [score::DOUBLE, 1.0] AS x, label AS y FROM scores WHERE split = 'validation')",
             *fit_sql("valid", 1, balanced=False))
REPORTS.add(
    "platt_calibration", lambda s, d: md.apply_platt(md.fit_platt(validation(s, d)), adapters.scores(s, d).filter(
        "split = 'test'")).select("event_id", "score", "calibrated"),
    with_tables(*PLATT_SQL, select=f"""SELECT event_id, score, {margin_sql('[score::DOUBLE, 1.0]')} AS calibrated
  FROM scores, valid_fit WHERE split = 'test'"""), doubles=["calibrated"],
)
ISOTONIC_SQL = """
pool AS (SELECT score, sum(label) AS y, count(*) AS n, row_number() OVER (ORDER BY score) AS r FROM scores WHERE split = 'validation' GROUP BY 1),
cum AS (SELECT *, sum(y) OVER (ORDER BY r) AS cy, sum(n) OVER (ORDER BY r) AS cn FROM pool),
spans AS (SELECT a.r AS i, b.r AS j, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS m FROM cum a JOIN cum b ON b.r >= a.r),
low AS (SELECT i, j, min(m) OVER (PARTITION BY i ORDER BY j DESC) AS m FROM spans),
fit AS (SELECT j AS r, max(m) AS calibrated FROM low GROUP BY 1)"""
REPORTS.add(
    "isotonic_calibration",
    lambda s, d: md.apply_isotonic(md.fit_isotonic(validation(s, d)), validation(s, d)).select("score", "calibrated").distinct(),
    with_tables(adapters.SCORES_SQL, ISOTONIC_SQL, select="SELECT score, calibrated FROM fit JOIN pool USING (r)"),
    doubles=["calibrated"],
)
REPORTS.add(
    "calibrator_selection", lambda s, d: md.select_calibrator(validation(s, d)),
    with_tables(*PLATT_SQL, ISOTONIC_SQL, f"""
mapped AS (SELECT 'platt' AS method, score, label, {margin_sql('x')} AS c FROM valid, valid_fit
  UNION ALL SELECT 'isotonic', score, label, round(calibrated, 12) FROM valid JOIN pool USING (score) JOIN fit USING (r)),
rated AS (SELECT method, avg((c - label) ** 2) AS brier, count(DISTINCT c) >= count(DISTINCT score) AS preserves_ranking FROM mapped GROUP BY 1),
best AS (SELECT coalesce((SELECT method FROM rated WHERE preserves_ranking ORDER BY brier, method LIMIT 1), 'platt') AS chosen)""",
                select="SELECT method, brier, preserves_ranking, method = chosen AS selected FROM rated, best"), doubles=["brier"],
)
