"""Labels, stages, risk, trajectories, logs and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.adapters import event_number, table
from packetloom.functions import labels as lb
from packetloom.functions import risk as rk
from packetloom.operators import alerts as al
from packetloom.plans.registry import Reports, with_tables

REPORTS = Reports()
# Labels that exercise every way of matching.
SAMPLE_LABELS = [
    "Benign", "Bot", "DDoS attack-HOIC", "DDoS attacks-LOIC-HTTP", "DDoS attack-LOIC-UDP", "DoS attacks-Hulk",
    "DoS attacks-SlowHTTPTest", "DoS attacks-GoldenEye", "DoS attacks-Slowloris", "FTP-BruteForce", "SSH-Bruteforce",
    "Brute Force -Web", "Brute Force -XSS", "SQL Injection", "Infilteration", "Infiltration", "XSS", "Port_Scan", "exfil",
    "something else", "", "  WEB ATTACK  ", "C2 beacon", "Lateral-Movement",
]


def sql_text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


LABELS_SQL = f"""
picked AS (SELECT event_id, user_id, ts, [{', '.join(map(sql_text, SAMPLE_LABELS))}][CAST(event_id % 24 + 1 AS INT)] AS label,
  [{', '.join(map(sql_text, SAMPLE_LABELS))}][CAST((event_id * 7 + user_id) % 24 + 1 AS INT)] AS other FROM events),
entries AS (SELECT * FROM (VALUES {', '.join(
    f"({i}, {sql_text(k)}, {lb.STAGE_NUMBER[s]}, {sql_text(s)}, {c}::DOUBLE, {sql_text(t)}, {sql_text(d)}, {sql_text(e)})"
    for i, (k, s, c, t, d, e) in enumerate(lb.LABEL_STAGES))})
  AS t(ord, key, stage, stage_name, confidence, technique, description, evidence_type)),
spellings AS (SELECT DISTINCT label, translate(lower(trim(label)), '_-', '  ') AS n FROM
  (SELECT label FROM picked UNION ALL SELECT other FROM picked)),
found AS (SELECT label, n, coalesce(arg_min(ord, ord) FILTER (key = n), arg_min(ord, ord) FILTER
  (contains(n, key) OR contains(key, n))) AS ord FROM spellings, entries GROUP BY 1, 2),
mapped AS (SELECT label, n, coalesce(stage, 0) AS stage, coalesce(stage_name, 'BENIGN') AS stage_name,
  coalesce(confidence, 0) AS confidence, technique, coalesce(description, 'Unknown attack type') AS description,
  coalesce(evidence_type, 'not_applicable') AS evidence_type FROM found LEFT JOIN entries USING (ord))"""


def picked(s, d):
    names = F.array(*map(F.lit, SAMPLE_LABELS))
    return table(s, d, "events").select(
        "event_id", "user_id", "ts", F.get(names, (F.col("event_id") % 24).cast("int")).alias("label"),
        F.get(names, ((F.col("event_id") * 7 + F.col("user_id")) % 24).cast("int")).alias("other"))


FIELDS = ["stage", "stage_name", "confidence", "technique", "description", "evidence_type"]
REPORTS.add(
    "label_map", lambda s, d: lb.attach_stage(picked(s, d)).select("event_id", "label", *FIELDS),
    with_tables(LABELS_SQL, select=f"SELECT event_id, label, {', '.join(FIELDS)} FROM picked JOIN mapped USING (label)"),
)
REPORTS.add(
    "label_set_stage",
    lambda s, d: picked(s, d).select("event_id", lb.map_label_set(lb.split_labels(F.concat_ws(";", "label", "other"))).alias("h")
                                     ).select("event_id", *[f"h.{f}" for f in FIELDS]),
    with_tables(LABELS_SQL, """
each AS (SELECT event_id, m.* FROM (SELECT event_id, label FROM picked UNION ALL SELECT event_id, other FROM picked) p
  JOIN mapped m USING (label) WHERE trim(label) <> ''),
best AS (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY stage DESC, n) = 1)""",
                select="""SELECT event_id, coalesce(stage, 0) AS stage, coalesce(stage_name, 'BENIGN') AS stage_name,
  coalesce(confidence, 0) AS confidence, technique, coalesce(description, 'No attack labels in horizon') AS description,
  coalesce(evidence_type, 'not_applicable') AS evidence_type FROM picked LEFT JOIN best USING (event_id)"""),
)
REPORTS.add(
    "label_normalised", lambda s, d: picked(s, d).select(
        "event_id", lb.normalized_label(F.col("label")).alias("spaced"), lb.canonical_label(F.col("label")).alias("canonical"),
        lb.coarse_stage(F.col("label")).alias("coarse")),
    with_tables(LABELS_SQL, "coarse AS (SELECT * FROM (VALUES " + ", ".join(
        f"({sql_text(k)}, {v})" for k, v in lb.COARSE_STAGE.items()) + ") AS t(canonical, coarse))", select="""
SELECT event_id, translate(lower(trim(label)), '_-', '  ') AS spaced, c AS canonical, coarse FROM
  (SELECT event_id, label, lower(regexp_replace(trim(label), '\\s+', ' ', 'g')) AS c FROM picked) LEFT JOIN coarse ON canonical = c"""),
)


def predictions(s, d):
    k = event_number()
    return table(s, d, "events").select(
        "user_id", "event_id", "ts", (k % 14).cast("int").alias("stage"), (k % 10 / 10).alias("confidence"))


PREDICTIONS_SQL = """
predictions AS (SELECT user_id, event_id, ts, k % 14 AS stage, k % 10 / 10 AS confidence
  FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events)),
fwd AS (SELECT *, max(stage) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top,
  lag(stage) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM predictions)"""
REPORTS.add(
    "attack_chain",
    lambda s, d: rk.attack_chain(predictions(s, d), ["user_id"], "ts", ["event_id"]).select(
        "user_id", "event_id", "stage", "risk_score"),
    with_tables(PREDICTIONS_SQL, select="""SELECT user_id, event_id, stage, least(1, 0.6 * confidence + 0.4 * stage / 13) AS risk_score
  FROM fwd WHERE top IS NULL OR stage > top"""), doubles=["risk_score"],
)
REPORTS.add(
    "attack_chain_backward",
    lambda s, d: rk.attack_chain(predictions(s, d), ["user_id"], "ts", ["event_id"], allow_backward=True).select(
        "user_id", "event_id", "stage"),
    with_tables(PREDICTIONS_SQL, select="SELECT user_id, event_id, stage FROM fwd WHERE before IS NULL OR stage <> before"),
)
STAGE_NAMES_SQL = "[" + ", ".join(sql_text(n) for n, _ in lb.STAGES) + "]"
REPORTS.add(
    "chain_summary",
    lambda s, d: rk.chain_summary(rk.attack_chain(predictions(s, d), ["user_id"], "ts", ["event_id"]), ["user_id"], ["ts"]
                                  ).withColumn("stages", F.array_join("stages", ">")),
    with_tables(PREDICTIONS_SQL, "c AS (SELECT * FROM fwd WHERE top IS NULL OR stage > top)", select=f"""SELECT user_id,
  round(least(1, 0.55 * arg_max(confidence, ts) + 0.45 * max(stage) / 13), 4) AS overall_risk, max(stage) <> 0 AS active,
  string_agg({STAGE_NAMES_SQL}[CAST(stage + 1 AS INT)], '>' ORDER BY ts) AS stages,
  {STAGE_NAMES_SQL}[CAST(max(stage) + 1 AS INT)] AS latest_stage,
  {STAGE_NAMES_SQL}[CAST(least(13, max(stage) + 1) + 1 AS INT)] AS predicted_next_stage FROM c GROUP BY 1"""),
)


def network_rows(s, d):
    k = event_number()
    return table(s, d, "events").select(
        "event_id", (F.col("value") / 500).alias("attack"), (k % 14).cast("int").alias("stage"), (k % 7 / 5).alias("confidence"),
        k.alias("unique_dst_ports"), (F.col("user_id") % 30).alias("new_hosts"),
        F.when(k % 3 == 0, k * 2).alias("failed_logins"), F.when(k % 5 > 0, k / 80).alias("anomaly_score"))


NETWORK_SQL = """
net AS (SELECT event_id, value / 500 AS attack, k % 14 AS stage, k % 7 / 5 AS confidence, list_filter([least(k / 100, 1),
    least(user_id % 30 / 20, 1), CASE WHEN k % 3 = 0 THEN least(k * 2 / 50, 1) END, CASE WHEN k % 5 > 0 THEN least(k / 80, 1) END],
    lambda x: x IS NOT NULL) AS signals
  FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events)),
inf AS (SELECT *, list_avg(signals) AS network, CASE stage WHEN 2 THEN 0.55 WHEN 7 THEN 0.7 WHEN 8 THEN 0.6 WHEN 9 THEN 1
  WHEN 11 THEN 0.9 WHEN 12 THEN 0.95 ELSE stage / 13 END AS stage_score FROM net),
scored AS (SELECT *, greatest(0, least(1, (0.5 * least(attack, 1) + 0.3 * stage_score + 0.2 * network)
  * (0.75 + 0.25 * least(confidence, 1)))) AS probability FROM inf)"""


def infiltration(s, d):
    rows = network_rows(s, d)
    rows = rows.withColumn("network", rk.network_score(rows.columns))
    return rows.withColumn("probability", rk.infiltration_probability(
        F.col("attack"), F.col("stage"), F.col("network"), F.col("confidence")))


REPORTS.add("infiltration_score", lambda s, d: infiltration(s, d).select("event_id", "network", "probability"),
            with_tables(NETWORK_SQL, select="SELECT event_id, network, probability FROM scored"),
            doubles=["network", "probability"], digits=9)
REPORTS.add(
    "risk_level",
    lambda s, d: infiltration(s, d).select("event_id", rk.risk_level(F.col("probability")).alias("level"), F.size(
        rk.infiltration_reasons(F.col("attack"), F.col("stage"), F.col("network"))).alias("reasons")),
    with_tables(NETWORK_SQL, select="""SELECT event_id, CASE WHEN probability >= 0.8 THEN 'CRITICAL' WHEN probability >= 0.65 THEN 'HIGH'
  WHEN probability >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level, greatest(1, CAST(attack >= 0.7 AS INT) +
  CAST(stage IN (2, 7, 8, 9, 11) AS INT) + CAST(network >= 0.6 AS INT)) AS reasons FROM scored"""),
)
REPORTS.add(
    "progression",
    lambda s, d: predictions(s, d).select(
        "event_id", lb.progression_score(F.col("stage")).alias("progression"),
        lb.is_progression(F.lit(5), F.col("stage")).alias("advances"), lb.stage_name(rk.next_stage(F.col("stage"))).alias("next"),
        rk.chain_risk(F.col("confidence"), F.col("stage")).alias("chain_risk")),
    with_tables(PREDICTIONS_SQL, select=f"""SELECT event_id, stage / 13 AS progression, stage >= 5 AS advances,
  {STAGE_NAMES_SQL}[CAST(least(13, stage + 1) + 1 AS INT)] AS "next", least(1, 0.55 * confidence + 0.45 * stage / 13) AS chain_risk
  FROM predictions"""), doubles=["progression", "chain_risk"],
)


def probabilities(s, d):
    """Six steps of four class probabilities per event, from its number and value."""
    k = event_number()
    m = F.round(F.col("value") * 100).cast("long")

    def step(i):
        a, b, c = (m + i * 13) % 50, (k * i + m) % 30, (k + i * 5) % 20
        return F.array((100 - a - b - c) / 100.0, a / 100.0, b / 100.0, c / 100.0)

    return table(s, d, "events").select(
        "event_id", (m % 100 / 100).alias("attack"), F.transform(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long")), step).alias("p"))


PROBABILITIES_SQL = """
cells AS (SELECT event_id, m % 100 / 100 AS attack, i AS step, (100 - a - b - c) / 100 AS p0, a / 100 AS p1, b / 100 AS p2, c / 100 AS p3
  FROM (SELECT *, (m + i * 13) % 50 AS a, (k * i + m) % 30 AS b, (k + i * 5) % 20 AS c FROM (
    SELECT event_id, CAST(round(value * 100) AS BIGINT) AS m, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k,
      unnest([1,2,3,4,5,6]) AS i FROM events))),
steps AS (SELECT *, greatest(p0, p1, p2, p3) AS confidence, CASE WHEN p0 >= greatest(p1, p2, p3) THEN 0 WHEN p1 >= greatest(p2, p3)
    THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END AS stage, list_sort([p0, p1, p2, p3]) AS s, 1 - p0 AS non_benign FROM cells),
tr AS (SELECT event_id, any_value(attack) AS attack, list(stage ORDER BY step) AS stages,
  max(struct_pack(stage := stage, confidence := confidence, "order" := -step)) AS w,
  max(non_benign) FILTER (step = 6) - max(non_benign) FILTER (step = 1) AS delta,
  coalesce(string_agg(step, ',' ORDER BY step) FILTER (stage <> 0 AND confidence >= 0.7), '') AS flagged FROM steps GROUP BY 1)"""


def trajectories(s, d):
    return probabilities(s, d).withColumn("steps", rk.trajectory_steps(F.col("p")))


REPORTS.add(
    "trajectory_steps",
    lambda s, d: trajectories(s, d).select("event_id", F.explode("steps").alias("s")).select(
        "event_id", "s.step", "s.stage", "s.confidence", "s.margin", "s.non_benign"),
    with_tables(PROBABILITIES_SQL, select="SELECT event_id, step, stage, confidence, s[4] - s[3] AS margin, non_benign FROM steps"),
    doubles=["margin", "non_benign"],
)
REPORTS.add(
    "trajectory_record",
    lambda s, d: trajectories(s, d).withColumn("w", rk.winning_step(F.col("steps"))).select(
        "event_id", F.col("w.stage").alias("stage"), F.col("w.confidence").alias("confidence"), F.col("w.step").alias("step"),
        rk.trend(F.col("steps")).alias("trend"), rk.never_steps_back(F.transform("steps", lambda x: x["stage"])).alias("consistent"),
        F.array_join(F.transform(rk.disagreement(F.col("attack"), F.col("steps")), lambda v: v.cast("string")), ",").alias("flagged")),
    with_tables(PROBABILITIES_SQL, select="""SELECT event_id, w.stage AS stage, w.confidence AS confidence, -w."order" AS step,
  CASE WHEN delta > 0.05 THEN 'increasing' WHEN delta < -0.05 THEN 'decreasing' ELSE 'roughly stable' END AS trend,
  list_sort(stages) = stages AS consistent, CASE WHEN attack <= 0.3 THEN flagged ELSE '' END AS flagged FROM tr"""),
)
REPORTS.add(
    "progression_consistency",
    lambda s, d: trajectories(s, d).agg(F.avg(rk.never_steps_back(F.transform("steps", lambda x: x["stage"])).cast("double")).alias(
        "fraction")),
    with_tables(PROBABILITIES_SQL, select="""SELECT avg(CASE WHEN list_sort(stages) = stages THEN 1.0 ELSE 0.0 END) AS fraction FROM tr"""),
    doubles=["fraction"],
)
REPORTS.add(
    "stage_from_probabilities",
    lambda s, d: probabilities(s, d).select("event_id", lb.stage_from_probabilities(F.get("p", F.lit(0))).alias("h")).select(
        "event_id", "h.*"),
    with_tables(PROBABILITIES_SQL, select=f"""SELECT event_id, stage, confidence,
  [{', '.join(sql_text(t) for _, t in lb.STAGES[:4])}][CAST(stage + 1 AS INT)] AS description FROM steps WHERE step = 1"""),
)
REPORTS.add(
    "overall_stage",
    lambda s, d: trajectories(s, d).select("event_id", rk.overall_stage(
        F.transform("steps", lambda x: x["stage"]), F.transform("steps", lambda x: lb.stage_name(x["stage"])),
        F.transform("steps", lambda x: x["confidence"])).alias("o")).select("event_id", "o.*"),
    with_tables(PROBABILITIES_SQL, select=f"""SELECT event_id, max(stage) AS stage, {STAGE_NAMES_SQL}[CAST(max(stage) + 1 AS INT)] AS "name",
  max(struct_pack(s := stage, c := confidence)).c AS confidence FROM steps GROUP BY 1"""),
)
FLAT = [f"step_{i}_{f}" for i in range(1, 7) for f in ("stage", "confidence")]
REPORTS.add(
    "trajectory_flat",
    lambda s, d: trajectories(s, d).select("event_id", *rk.flatten_trajectory(F.col("steps"))).select("event_id", *FLAT),
    with_tables(PROBABILITIES_SQL, select="SELECT event_id, " + ", ".join(
        f"max({f}) FILTER (step = {i}) AS step_{i}_{f}" for i in range(1, 7) for f in ("stage", "confidence"))
        + " FROM steps GROUP BY 1"),
)
REPORTS.add(
    "stage_narrative",
    lambda s, d: trajectories(s, d).select("event_id", lb.stage_narrative(F.transform("steps", lambda x: x["stage"])).alias("text"),
                                           lb.coarse_stage_info(F.get("steps", F.lit(0))["stage"])["action"].alias("action")),
    with_tables(PROBABILITIES_SQL, select=f"""SELECT event_id, CASE WHEN max(stage) = 0
  THEN 'All forecast windows project benign baseline network traffic.' ELSE string_agg(CASE WHEN stage > 0 THEN '- **T+' || step || '**: ' ||
    [{', '.join(sql_text(r[0]) for r in lb.COARSE_STAGES)}][CAST(stage + 1 AS INT)] || ' (' ||
    [{', '.join(sql_text(r[2]) for r in lb.COARSE_STAGES)}][CAST(stage + 1 AS INT)] || ') — *' ||
    [{', '.join(sql_text(r[3]) for r in lb.COARSE_STAGES)}][CAST(stage + 1 AS INT)] || '*' END, chr(10) ORDER BY step) END AS text,
  [{', '.join(sql_text(r[4]) for r in lb.COARSE_STAGES)}][CAST(max(stage) FILTER (step = 1) + 1 AS INT)] AS "action"
  FROM steps GROUP BY 1"""),
)
REPORTS.add(
    "trajectory_narrative",
    lambda s, d: trajectories(s, d).select("event_id", rk.trajectory_narrative(F.col("attack"), F.col("steps")).alias("text")),
    with_tables(PROBABILITIES_SQL, select=f"""SELECT event_id, printf('Attack probability over the horizon: %.4f.', attack) || ' ' ||
  CASE WHEN len(list_distinct(stages)) = 1 THEN 'All steps predict ' || {STAGE_NAMES_SQL}[CAST(stages[1] + 1 AS INT)] || '.'
  ELSE 'Stage trajectory: ' || array_to_string(list_transform(stages, lambda x: {STAGE_NAMES_SQL}[CAST(x + 1 AS INT)]), ' -> ') || '.' END
  || ' The non-benign signal is ' || CASE WHEN delta > 0.05 THEN 'increasing' WHEN delta < -0.05 THEN 'decreasing'
  ELSE 'roughly stable' END || '.' AS text FROM tr"""),
)
REPORTS.add(
    "trajectory_account",
    lambda s, d: trajectories(s, d).select("event_id", rk.trajectory_account(F.col("attack"), F.col("steps"), F.transform(
        "steps", lambda x: F.concat(F.lit("feature_"), ((F.col("event_id") + x["step"]) % 5).cast("string")))).alias("text")),
    with_tables(PROBABILITIES_SQL, f"""
named AS (SELECT *, {STAGE_NAMES_SQL}[CAST(stage + 1 AS INT)] AS sn FROM steps),
acc AS (SELECT event_id, any_value(attack) AS attack, list(sn ORDER BY step) AS sns, arg_max(sn, stage) AS top,
  max(struct_pack(s := stage, c := confidence)).c AS topc, max(non_benign) FILTER (step = 1) AS f, max(non_benign) FILTER (step = 6) AS l,
  max(struct_pack(c := confidence, o := -step)) AS best,
  string_agg(step || ' (' || sn || ')', ', ' ORDER BY step) FILTER (stage <> 0 AND confidence >= 0.7) AS flagged FROM named GROUP BY 1)""",
                select="""SELECT event_id, concat_ws(' ', printf('Attack probability over the horizon: %.4f.', attack),
  printf('Overall stage: %s (confidence %.4f).', top, topc),
  CASE WHEN len(list_distinct(sns)) = 1 THEN 'All steps predict ' || sns[1] || '.'
    ELSE 'Stage trajectory: ' || array_to_string(sns, ' -> ') || '.' END,
  printf('The non-benign signal is %s (first step %.4f, last step %.4f).', CASE WHEN l - f > 0.05 THEN 'increasing'
    WHEN l - f < -0.05 THEN 'decreasing' ELSE 'roughly stable' END, f, l),
  printf('Step %d (%s) is driven most by feature_%d.', -best.o, sns[-best.o], (event_id - best.o) % 5),
  CASE WHEN attack <= 0.3 THEN 'Warning: the attack probability is low, yet these steps are confident of an attack stage: ' || flagged || '.' END)
  AS text FROM acc"""),
)
REPORTS.add(
    "next_access_step",
    lambda s, d: probabilities(s, d).select("event_id", rk.verdict(F.col("attack"))["next_access_step"].alias("step")),
    with_tables(PROBABILITIES_SQL, select="""SELECT event_id, CASE WHEN attack >= 0.7 THEN 'Possible progression toward Discovery access.'
  ELSE 'No access attempt predicted within the current forecast horizon.' END AS step FROM steps WHERE step = 1"""),
)
REPORTS.add(
    "risk_verdict",
    lambda s, d: probabilities(s, d).withColumns(dict(rk.verdict(F.col("attack")))).select(
        "event_id", "attack_type", "estimated_time_seconds", F.get("precautions", F.lit(0)).alias("first_precaution")),
    with_tables(PROBABILITIES_SQL, select=f"""SELECT event_id, CASE WHEN attack >= 0.7 THEN 'Brute Force' ELSE 'Benign' END AS attack_type,
  CASE WHEN attack >= 0.7 THEN greatest(5, CAST(round_even(60 * (1 - attack), 0) AS INT)) END AS estimated_time_seconds,
  CASE WHEN attack >= 0.7 THEN {sql_text(rk.PRECAUTIONS['INITIAL_ACCESS'][0])} ELSE {sql_text(rk.PRECAUTIONS['BENIGN'][0])} END
  AS first_precaution FROM steps WHERE step = 1"""),
)
REPORTS.add(
    "forecast_timeline",
    lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("latest"), F.avg("value").alias("v")).select(
        "user_id", F.explode(rk.forecast_timeline(F.col("latest"), F.lit(0.5))).alias("t")).select("user_id", "t.at", "t.risk"),
    """SELECT user_id, latest + to_seconds(10 * k) AS "at", 0.5::DOUBLE AS risk FROM (SELECT user_id, max(ts) AS latest,
  unnest([1,2,3,4,5,6]) AS k FROM events GROUP BY 1)""",
)
REPORTS.add(
    "keyword_severity",
    lambda s, d: table(s, d, "documents").select("doc_id", rk.keyword_severity(F.col("text")).alias("severity")),
    """SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'attack|injection|unauthorized|brute|malware|scan') THEN 'HIGH' ELSE 'LOW' END
  AS severity FROM documents""",
)


def log_lines(s, d):
    """Every line of the conversation texts as a log line; the event type adds a keyword to some."""
    turns = table(s, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("n").cast("string")).alias("id"),
        F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit(" Brute force: "), F.col("line"))).otherwise(F.col("line")).alias("value"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(
            F.col("conv_id") * 60 + F.col("turn")).cast("decimal(18,6)"))).alias("ts"))


LOGS_SQL = """
raw_lines AS (SELECT conv_id, turn, n - 1 AS n, lines[n] AS line FROM (SELECT conv_id, turn, lines,
  unnest(generate_series(1, len(lines))) AS n FROM (SELECT *, string_split(text, chr(10)) AS lines FROM conversations))),
log_rows AS (SELECT conv_id || '-' || turn || '-' || n AS log_id, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn) AS "timestamp",
  trim(regexp_replace(CASE WHEN conv_id % 7 = 0 THEN ' Brute force: ' || line ELSE line END, '^\\s+|\\s+$', '', 'g')) AS raw_log FROM raw_lines),
logs AS (SELECT *, CASE WHEN regexp_matches(lower(raw_log), 'attack|injection|unauthorized|brute|malware|scan') THEN 'HIGH' ELSE 'LOW' END
  AS severity, 'IDS event' AS event_type, '127.0.0.1' AS src_ip, '127.0.0.1' AS dest_ip, substring(raw_log, 1, 500) AS message
  FROM log_rows WHERE raw_log <> '')"""


def logs(s, d):
    return al.log_entries(log_lines(s, d), "value", "id", "ts", message_length=500)


REPORTS.add("log_entries", logs, with_tables(LOGS_SQL, select="SELECT * FROM logs"))
REPORTS.add(
    "alerts", lambda s, d: al.alerts(logs(s, d).unionByName(logs(s, d))),
    with_tables(LOGS_SQL, select="""SELECT log_id, "timestamp", 'High severity IDS event: IDS event' AS rule_triggered, 'Active' AS status,
  severity, 1::DOUBLE AS anomaly_score FROM logs WHERE severity = 'HIGH'"""),
)
REPORTS.add(
    "log_page", lambda s, d: al.filter_logs(logs(s, d), severity="HIGH", page=2).select("log_id", "timestamp", "severity"),
    with_tables(LOGS_SQL, select="""SELECT log_id, "timestamp", severity FROM logs WHERE severity = 'HIGH'
  ORDER BY "timestamp" DESC, log_id DESC LIMIT 50 OFFSET 50"""),
)
REPORTS.add(
    "recent_logs", lambda s, d: al.recent(logs(s, d), 20).select("log_id", "severity"),
    with_tables(LOGS_SQL, select='SELECT log_id, severity FROM logs ORDER BY "timestamp" DESC, log_id DESC LIMIT 20'),
)
REPORTS.add(
    "dashboard_counts", lambda s, d: al.dashboard_counts(logs(s, d), al.alerts(logs(s, d))),
    with_tables(LOGS_SQL, select="""SELECT count(*) AS logs, count(*) FILTER (severity = 'HIGH') AS high_severity_logs,
  count(*) FILTER (severity = 'HIGH') AS alerts, count(*) FILTER (severity = 'HIGH') AS active_alerts FROM logs"""),
)


def guarded(s, d):
    logs(s, d).createOrReplaceTempView("logs_logentry")
    return al.guarded_sql(s, "SELECT severity, count(*) AS n FROM logs_logentry GROUP BY severity")


REPORTS.add("guarded_sql", guarded, with_tables(LOGS_SQL, select="SELECT severity, count(*) AS n FROM logs GROUP BY 1"))


def listing(s, d):
    """A file listing made of the page urls, with the html length as size."""
    kinds = F.array(F.lit("capture.pcap"), F.lit("flows.csv"), F.lit("logs.zip"), F.lit("data"), F.lit("next.pcapng"), F.lit(""))
    return table(s, d, "pages").select(
        F.concat(F.lit("Log/"), F.col("page_id").cast("string"), F.lit("/"), F.get(kinds, (F.col("page_id") % 6).cast("int"))).alias("filename"),
        F.length("html").cast("long").alias("compressed_size"))


LISTING_SQL = """
listing AS (SELECT 'Log/' || page_id || '/' || ['capture.pcap', 'flows.csv', 'logs.zip', 'data', 'next.pcapng', ''][CAST(page_id % 6 + 1 AS INT)]
  AS filename, length(html) AS compressed_size, page_id % 6 AS kind FROM pages)"""
REPORTS.add(
    "classify_objects",
    lambda s, d: listing(s, d).select("filename", rk.classify_object(F.col("filename")).alias("object_kind"),
                                      rk.classify_member(F.col("filename")).alias("member_kind")),
    with_tables(LISTING_SQL, select="""SELECT filename, ['raw_pcap_archive', 'processed_csv', 'log_archive', 'unknown', 'raw_pcap_archive',
  'folder_marker'][CAST(kind + 1 AS INT)] AS object_kind, ['pcap', 'unknown_extension', 'log', 'unknown_extension', 'pcapng',
  'folder_marker'][CAST(kind + 1 AS INT)] AS member_kind FROM listing"""),
)
REPORTS.add(
    "smallest_in_band", lambda s, d: rk.smallest_in_band(listing(s, d), 500, 50000, "Log/0/capture.pcap"),
    with_tables(LISTING_SQL, select="""SELECT filename, compressed_size FROM listing WHERE kind IN (0, 1, 3, 4) AND compressed_size
  BETWEEN 500 AND 50000 AND filename <> 'Log/0/capture.pcap' ORDER BY compressed_size, filename LIMIT 1"""),
)
REPORTS.add(
    "json_numbers",
    lambda s, d: table(s, d, "events").select("event_id", F.explode(rk.json_numbers(F.col("props"))).alias("key", "number")),
    """SELECT event_id, 'k' AS key, CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS number FROM events""",
)
