"""Dataset path: rows -> gap-filled states -> labelled, split samples -> sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom import adapters
from packetloom.adapters import PACKETS_SQL
from packetloom.functions import labels as lb
from packetloom.functions.numeric import finite
from packetloom.functions.timefmt import DAY_FIRST, MONTH_FIRST, parse_timestamp
from packetloom.operators import dataset as ds
from packetloom.plans.registry import Reports, with_tables

REPORTS = Reports()
HOUR = 3600
FEATURES = ["packet_length", "ttl", "tcp_window_size", "rate"]


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow rows with a feature that is sometimes infinite or NaN."""
    rate = (F.when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).when(F.col("event_id") % 11 == 0,
            F.lit(float("nan"))).otherwise(F.col("byte_count")))
    return adapters.packets(spark, sf_dir).withColumn("rate", rate)


ROWS_SQL = """
rows_in AS (SELECT *, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE byte_count END AS rate,
  time_bucket(INTERVAL 1 HOUR, "timestamp") AS window_start FROM packets)"""
STATES_SQL = """
states AS (SELECT source_file, window_start, count(*) AS flow_count, """ + ", ".join(
    f"coalesce(CAST(sum({c}) AS DOUBLE), 0) AS {c}__sum, coalesce(avg({c}), 0) AS {c}__mean" for c in FEATURES) + """,
  max(CASE WHEN label <> 'Benign' THEN 1 ELSE 0 END) AS current_attack,
  string_agg(DISTINCT label, ';' ORDER BY label) FILTER (label <> 'Benign') AS types FROM rows_in GROUP BY 1, 2)"""
TIMELINE_SQL = """
bounds AS (SELECT source_file, min(window_start) AS lo, max(window_start) AS hi FROM states GROUP BY 1),
grid AS (SELECT source_file, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS window_start FROM bounds),
timeline AS (SELECT g.source_file, g.window_start, coalesce(flow_count, 0) AS flow_count, """ + ", ".join(
    f"coalesce({c}__{k}, 0) AS {c}__{k}" for c in FEATURES for k in ("sum", "mean")) + """,
  coalesce(current_attack, 0) AS current_attack, coalesce(types, '') AS types,
  row_number() OVER (PARTITION BY g.source_file ORDER BY g.window_start) - 1 AS window_index,
  count(*) OVER (PARTITION BY g.source_file) AS window_count
  FROM grid g LEFT JOIN states s USING (source_file, window_start))"""
LABELLED_SQL = """
split_rows AS (SELECT *, CASE WHEN window_index * 100 < window_count * 70 THEN 'train'
    WHEN window_index * 100 < window_count * 85 THEN 'validation' ELSE 'test' END AS split FROM timeline),
labelled AS (SELECT *, coalesce(max(current_attack) OVER ahead, 0) AS future_attack_within_horizon,
    string_agg(nullif(types, ''), ';') OVER ahead AS future_raw,
    window_index >= 5 AS history_available, least(window_index + 1, 6) AS history_window_count,
    coalesce(window_index >= 5 AND window_index + 6 < window_count
      AND lag(split, 5) OVER o = lead(split, 6) OVER o, false) AS eligible,
    list(current_attack) OVER ahead AS attack_list, list(types) OVER ahead AS types_list
  FROM split_rows WINDOW o AS (PARTITION BY source_file ORDER BY window_start),
    ahead AS (PARTITION BY source_file ORDER BY window_start ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING))"""
BASE = (PACKETS_SQL, ROWS_SQL, STATES_SQL, TIMELINE_SQL)
LABELLED = (*BASE, LABELLED_SQL)


def states(spark, sf_dir):
    return ds.sum_mean_states(rows(spark, sf_dir), FEATURES, HOUR)


def timeline(spark, sf_dir):
    return ds.complete_timeline(states(spark, sf_dir), HOUR)


def labelled(spark, sf_dir):
    return ds.label_windows(timeline(spark, sf_dir))


def sequences(spark, sf_dir):
    return ds.assemble_sequences(labelled(spark, sf_dir), ["flow_count", "rate__sum"])


STATE_COLUMNS = ["flow_count", *[f"{c}__{k}" for c in FEATURES for k in ("sum", "mean")]]
MEANS = [f"{c}__mean" for c in FEATURES]
REPORTS.add(
    "state_sum_mean",
    lambda s, d: states(s, d).select("source_file", "window_start", *STATE_COLUMNS, "current_attack",
                                     F.array_join("current_attack_types", ";").alias("types")),
    with_tables(*BASE, select="SELECT * REPLACE (coalesce(types, '') AS types) FROM states"), doubles=MEANS,
)
REPORTS.add(
    "timeline_gapfill",
    lambda s, d: timeline(s, d).select("source_file", "window_start", "window_index", "window_count", *STATE_COLUMNS,
                                       "current_attack"),
    with_tables(*BASE, select=f"""SELECT source_file, window_start, window_index, window_count,
  {', '.join(STATE_COLUMNS)}, current_attack FROM timeline"""), doubles=MEANS,
)
REPORTS.add(
    "split_assign", lambda s, d: labelled(s, d).select("source_file", "window_start", "split"),
    with_tables(*LABELLED, select="SELECT source_file, window_start, split FROM labelled"),
)
REPORTS.add(
    "future_label",
    lambda s, d: labelled(s, d).select("source_file", "window_start", "current_attack", "future_attack_within_horizon"),
    with_tables(*LABELLED, select="""SELECT source_file, window_start, current_attack, future_attack_within_horizon
  FROM labelled"""),
)
REPORTS.add(
    "future_types",
    lambda s, d: labelled(s, d).select("source_file", "window_start",
                                       F.array_join("future_attack_types", ";").alias("future_types")),
    with_tables(*LABELLED, select="""SELECT source_file, window_start, coalesce(array_to_string(list_sort(
  list_distinct(string_split(future_raw, ';'))), ';'), '') AS future_types FROM labelled"""),
)
REPORTS.add(
    "history_flags",
    lambda s, d: labelled(s, d).select("source_file", "window_start", "history_available", "history_window_count"),
    with_tables(*LABELLED, select="""SELECT source_file, window_start, history_available, history_window_count
  FROM labelled"""),
)
REPORTS.add(
    "eligibility", lambda s, d: labelled(s, d).select("source_file", "window_start", "forecast_sample_eligible"),
    with_tables(*LABELLED, select="""SELECT source_file, window_start, eligible AS forecast_sample_eligible
  FROM labelled"""),
)
REPORTS.add(
    "first_attack_step",
    lambda s, d: labelled(s, d).select("source_file", "window_start", "future_attack_step"),
    with_tables(*LABELLED, select="""SELECT source_file, window_start,
  coalesce(list_position(attack_list, 1), 0) AS future_attack_step FROM labelled"""),
)
REPORTS.add(
    "sequence_xy",
    lambda s, d: sequences(s, d).select(
        "source_file", "window_start", "split", F.size("x").alias("x_rows"), F.size("y").alias("y_rows"),
        F.transform("x", lambda v: v[0])[0].alias("x_first_count"),
        F.aggregate("x", F.lit(0.0), lambda a, v: a + v[1]).alias("x_rate_sum"),
        F.aggregate("y", F.lit(0.0), lambda a, v: a + v[1]).alias("y_rate_sum"),
        F.col("span")[0].alias("span_first"), F.col("span")[11].alias("span_last")),
    with_tables(*LABELLED, select="""SELECT source_file, window_start, split, x_rows, y_rows, x_first_count,
  x_rate_sum, y_rate_sum, span_first, span_last FROM (SELECT *,
  count(*) OVER back AS x_rows, count(*) OVER ahead AS y_rows, CAST(lag(flow_count, 5) OVER o AS DOUBLE) AS x_first_count,
  sum(rate__sum) OVER back AS x_rate_sum, sum(rate__sum) OVER ahead AS y_rate_sum,
  lag(window_start, 5) OVER o AS span_first, lead(window_start, 6) OVER o AS span_last FROM labelled
  WINDOW o AS (PARTITION BY source_file ORDER BY window_start),
    back AS (PARTITION BY source_file ORDER BY window_start ROWS 5 PRECEDING),
    ahead AS (PARTITION BY source_file ORDER BY window_start ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)) WHERE eligible"""),
)
REPORTS.add(
    "per_step_targets",
    lambda s, d: sequences(s, d).select(
        "source_file", "window_start", "current_attack",
        F.array_join(F.transform("attack_steps", lambda v: v.cast("string")), ",").alias("attack_steps"),
        F.array_join(F.transform("infiltration_steps", lambda v: v.cast("string")), ",").alias("infiltration_steps")),
    with_tables(*LABELLED, select="""SELECT source_file, window_start, current_attack,
  array_to_string(attack_list, ',') AS attack_steps, array_to_string(list_transform(types_list,
    lambda t: CASE WHEN t LIKE '%Infiltration%' THEN 1 ELSE 0 END), ',') AS infiltration_steps
  FROM labelled WHERE eligible"""),
)
STAGE_CASE = """CASE WHEN {t} LIKE '%DoS attacks-Hulk%' THEN 13 WHEN {t} LIKE '%Infiltration%' THEN 9
  WHEN {t} LIKE '%Bot%' THEN 11 WHEN {t} LIKE '%FTP-BruteForce%' THEN 7 ELSE 0 END"""
REPORTS.add(
    "per_step_stages",
    lambda s, d: sequences(s, d).select(
        "source_file", "window_start", "aggregate_stage",
        F.array_join(F.transform("stage_steps", lambda v: v.cast("string")), ",").alias("stage_steps")),
    with_tables(*LABELLED, select=f"""SELECT source_file, window_start,
  list_max(list_transform(types_list, lambda t: {STAGE_CASE.format(t='t')})) AS aggregate_stage,
  array_to_string(list_transform(types_list, lambda t: {STAGE_CASE.format(t='t')}), ',') AS stage_steps
  FROM labelled WHERE eligible"""),
)
REPORTS.add(
    "walk_forward_check", lambda s, d: ds.walk_forward_check(labelled(s, d)),
    with_tables(*LABELLED, """e AS (SELECT source_file,
  max(window_start) FILTER (split = 'train') AS train_last, min(window_start) FILTER (split = 'validation') AS validation_first,
  max(window_start) FILTER (split = 'validation') AS validation_last, min(window_start) FILTER (split = 'test') AS test_first
  FROM labelled GROUP BY 1)""", select="""SELECT *, train_last < validation_first AND validation_last < test_first
  AS walk_forward FROM e"""),
)
REPORTS.add(
    "span_contiguity",
    lambda s, d: sequences(s, d).groupBy("source_file").agg(
        F.count("*").alias("samples"),
        F.count_if(~ds.span_is_contiguous(F.col("span"), F.col("window_start"), HOUR)).alias("broken"),
        F.count_if(F.size("span_splits") > 1).alias("crossing")),
    with_tables(*LABELLED, select="""SELECT source_file, count(*) AS samples, CAST(0 AS BIGINT) AS broken,
  CAST(0 AS BIGINT) AS crossing FROM labelled WHERE eligible GROUP BY 1"""),
)
REPORTS.add(
    "dataset_summary", lambda s, d: ds.build_summary(labelled(s, d)),
    with_tables(*LABELLED, select="""SELECT source_file, count(*) AS window_count,
  count(*) FILTER (current_attack = 0) AS benign_current_windows, count(*) FILTER (current_attack = 1) AS attack_current_windows,
  count(*) FILTER (future_attack_within_horizon = 1) AS future_attack_positive_windows,
  count(*) FILTER (future_attack_within_horizon = 0) AS future_attack_negative_windows,
  min(window_start) AS earliest_window, max(window_start) AS latest_window,
  count(*) FILTER (window_index + 6 >= window_count) AS incomplete_future_horizon_windows,
  count(*) FILTER (eligible) AS valid_forecasting_samples, count(*) FILTER (eligible AND split = 'train') AS train_windows,
  count(*) FILTER (eligible AND split = 'validation') AS validation_windows,
  count(*) FILTER (eligible AND split = 'test') AS test_windows FROM labelled GROUP BY ROLLUP (source_file)"""),
)


def raw_rows(spark, sf_dir):
    """Raw-looking text rows with the defects the cleaning step must catch."""
    i = F.col("event_id")
    return adapters.packets(spark, sf_dir).select(
        "source_file", i.alias("row_number"),
        F.when(i % 97 == 0, 79).otherwise(80).alias("width"),
        F.when(i % 89 == 0, "Label").otherwise(F.concat(F.lit(" "), F.col("label"), F.lit(" "))).alias("raw_label"),
        F.when(i % 83 == 0, "not a time").when(i % 79 == 0, "05/01/1970 10:00:00").otherwise(
            F.date_format("timestamp", DAY_FIRST)).alias("raw_timestamp"),
    )


def classified(spark, sf_dir):
    return raw_rows(spark, sf_dir).withColumn("reason", ds.reject_reason(
        F.col("width"), F.lit(80), F.col("raw_label"), parse_timestamp(F.col("raw_timestamp"))))


RAW_SQL = """
classified AS (SELECT source_file, event_id AS row_number,
  CASE WHEN event_id % 97 = 0 THEN 'malformed_width' WHEN event_id % 89 = 0 THEN 'repeated_header'
    WHEN event_id % 83 = 0 THEN 'invalid_timestamp' WHEN event_id % 79 = 0 THEN 'known_1970_timestamp' END AS reason
  FROM packets)"""
REPORTS.add(
    "reject_classify", lambda s, d: classified(s, d).select("source_file", "row_number", "reason"),
    with_tables(PACKETS_SQL, RAW_SQL, select="SELECT * FROM classified"),
)
REPORTS.add(
    "excluded_by_reason", lambda s, d: ds.excluded_summary(classified(s, d)),
    with_tables(PACKETS_SQL, RAW_SQL, select="""SELECT source_file, reason, count(*) AS excluded_rows
  FROM classified WHERE reason IS NOT NULL GROUP BY ALL"""),
)
REPORTS.add(
    "timestamp_formats",
    lambda s, d: adapters.packets(s, d).select(
        "event_id", parse_timestamp(F.when(F.col("event_id") % 2 == 0, F.date_format("timestamp", DAY_FIRST)).otherwise(
            F.date_format("timestamp", MONTH_FIRST)), (DAY_FIRST, MONTH_FIRST)).cast("timestamp_ntz").alias("parsed")),
    with_tables(PACKETS_SQL, select="""SELECT event_id, CASE WHEN event_id % 2 = 0 OR day("timestamp") > 12
  THEN date_trunc('second', "timestamp") ELSE coalesce(try_strptime(strftime("timestamp", '%m/%d/%Y %H:%M:%S'),
  '%d/%m/%Y %H:%M:%S'), date_trunc('second', "timestamp")) END AS parsed FROM packets"""),
)
REPORTS.add(
    "label_normalise",
    lambda s, d: adapters.packets(s, d).groupBy(lb.dataset_label(F.when(F.col("label") == "Infiltration",
        " Infilteration").otherwise(F.col("label"))).alias("label")).agg(
        F.count("*").alias("n"), F.max(lb.is_attack(F.col("label"))).alias("attack")),
    with_tables(PACKETS_SQL, select="""SELECT label, count(*) AS n, bool_or(label <> 'Benign') AS attack FROM packets
  GROUP BY label"""),
)
REPORTS.add(
    "finite_numbers",
    lambda s, d: rows(s, d).select("event_id", finite(F.when(F.col("event_id") % 5 == 0, F.lit(" ")).when(
        F.col("event_id") % 3 == 0, F.lit("abc")).otherwise(F.col("rate").cast("string"))).alias("number")),
    with_tables(PACKETS_SQL, ROWS_SQL, select="""SELECT event_id, CASE WHEN event_id % 5 > 0 AND event_id % 3 > 0
  THEN rate END AS number FROM rows_in"""),
)
REPORTS.add(
    "median_imputation",
    lambda s, d: ds.impute_medians(rows(s, d), ["rate", "tcp_window_size"]).select("event_id", "rate", "tcp_window_size"),
    with_tables(PACKETS_SQL, ROWS_SQL, """m AS (SELECT source_file, quantile_cont(rate, 0.5) AS mr,
  quantile_cont(tcp_window_size, 0.5) AS mw FROM rows_in GROUP BY 1)""",
                select="""SELECT event_id, coalesce(rate, mr) AS rate, coalesce(CAST(tcp_window_size AS DOUBLE), mw)
  AS tcp_window_size FROM rows_in JOIN m USING (source_file)"""),
)
REPORTS.add(
    "period_filter",
    lambda s, d: adapters.packets(s, d).filter(ds.in_period(F.col("timestamp"), 2024, "2024-01-05 00:00:00",
                                                            "2024-01-09 12:00:00")).groupBy("source_file").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")),
    with_tables(PACKETS_SQL, select="""SELECT source_file, count(*) AS n, min("timestamp") AS "first",
  max("timestamp") AS "last" FROM packets WHERE year("timestamp") = 2024 AND "timestamp" >= TIMESTAMP '2024-01-05'
  AND "timestamp" < TIMESTAMP '2024-01-09 12:00:00' GROUP BY 1"""),
)
D_STATS = [f"{c}__{k}" for c in ("packet_length", "rate") for k in ("mean", "std", "max", "min")]


def coarse_states(spark, sf_dir):
    return ds.mean_std_max_min_states(rows(spark, sf_dir), ["packet_length", "rate"], HOUR)


COARSE_SQL = """
coarse AS (SELECT source_file, window_start,
  avg(packet_length) AS packet_length__mean, stddev_pop(packet_length) AS packet_length__std,
  max(packet_length) AS packet_length__max, min(packet_length) AS packet_length__min,
  avg(coalesce(rate, 0)) AS rate__mean, stddev_pop(coalesce(rate, 0)) AS rate__std, max(coalesce(rate, 0)) AS rate__max,
  min(coalesce(rate, 0)) AS rate__min, CAST(count(*) AS DOUBLE) AS "count",
  CASE WHEN avg(CASE WHEN label <> 'Benign' THEN 1.0 ELSE 0.0 END) >= 0.1 THEN 1 ELSE 0 END AS attack,
  coalesce(mode(st) FILTER (st > 0), 0) AS stage
  FROM (SELECT *, CASE label WHEN 'Benign' THEN 0 WHEN 'FTP-BruteForce' THEN 2 WHEN 'DoS attacks-Hulk' THEN 3
        WHEN 'Infiltration' THEN 4 END AS st FROM rows_in) WHERE st IS NOT NULL GROUP BY 1, 2)"""
REPORTS.add(
    "state_mean_std_max_min",
    lambda s, d: coarse_states(s, d),
    with_tables(PACKETS_SQL, ROWS_SQL, COARSE_SQL, select="SELECT * FROM coarse"), doubles=D_STATS, digits=4,
)
COARSE_TIMELINE_SQL = """
cb AS (SELECT source_file, min(window_start) AS lo, max(window_start) AS hi FROM coarse GROUP BY 1),
cg AS (SELECT source_file, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS window_start FROM cb),
ct AS (SELECT g.source_file, g.window_start, coalesce(attack, 0) AS attack, coalesce(stage, 0) AS stage,
  coalesce("count", 0) AS n, row_number() OVER (PARTITION BY g.source_file ORDER BY g.window_start) - 1 AS window_index
  FROM cg g LEFT JOIN coarse USING (source_file, window_start)),
cs AS (SELECT source_file, window_start, window_index, sum(n) OVER (PARTITION BY source_file ORDER BY window_start
    ROWS 19 PRECEDING) AS history_count, list(attack) OVER a AS attacks, list(stage) OVER a AS stages FROM ct
  WINDOW a AS (PARTITION BY source_file ORDER BY window_start ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"""


def coarse_sequences(spark, sf_dir, stride=1):
    filled = ds.complete_timeline(coarse_states(spark, sf_dir), HOUR)
    return ds.forecast_sequences(filled, ["count"], ["source_file"], stride=stride).select(
        "source_file", "window_start", F.aggregate("x", F.lit(0.0), lambda a, v: a + v[0]).alias("history_count"),
        F.array_join(F.transform("attack_steps", lambda v: v.cast("string")), ",").alias("attack_steps"),
        F.array_join(F.transform("stage_steps", lambda v: v.cast("string")), ",").alias("stage_steps"))


COARSE_SELECT = """SELECT source_file, window_start, history_count, array_to_string(attacks, ',') AS attack_steps,
  array_to_string(stages, ',') AS stage_steps FROM cs WHERE window_index >= 19 AND len(attacks) = 5"""
REPORTS.add("segment_sequences", coarse_sequences,
            with_tables(PACKETS_SQL, ROWS_SQL, COARSE_SQL, COARSE_TIMELINE_SQL, select=COARSE_SELECT))
REPORTS.add("timeline_scan", lambda s, d: coarse_sequences(s, d, 5),
            with_tables(PACKETS_SQL, ROWS_SQL, COARSE_SQL, COARSE_TIMELINE_SQL,
                        select=COARSE_SELECT + " AND (window_index - 19) % 5 = 0"))
REPORTS.add(
    "merge_packet_states",
    lambda s, d: ds.merge_packet_states(
        states(s, d).groupBy(F.date_format("window_start", "yyyy-MM-dd HH").alias("window_id")).agg(
            F.sum("flow_count").alias("flow_count"), F.sum("rate__sum").alias("bytes")),
        rows(s, d).groupBy(F.concat(
            F.date_format("timestamp", "yyyy-MM-dd HH"), F.when(F.expr("protocol = 'UDP' AND ttl > 60"), "").otherwise(" other")).alias("window_id")).agg(
            F.count("*").alias("flow_count"), F.max("ttl").alias("max_ttl"))),
    with_tables(*BASE, select="""SELECT f.window_id, CASE WHEN p.window_id IS NOT NULL THEN p.n
  ELSE CAST(f.n AS BIGINT) END AS flow_count, f.bytes, p.max_ttl
  FROM (SELECT strftime(window_start, '%Y-%m-%d %H') AS window_id, sum(flow_count) AS n, sum(rate__sum) AS bytes
        FROM states GROUP BY 1) f
  LEFT JOIN (SELECT strftime("timestamp", '%Y-%m-%d %H') || CASE WHEN protocol = 'UDP' AND ttl > 60 THEN '' ELSE ' other' END AS window_id,
        count(*) AS n, max(ttl) AS max_ttl FROM rows_in GROUP BY 1) p USING (window_id)"""),
)
REPORTS.add(
    "canonical_index_check",
    lambda s, d: ds.missing_from_index(timeline(s, d), states(s, d), ["source_file", "window_start"]),
    with_tables(*BASE, select="""SELECT source_file, window_start FROM grid EXCEPT
  SELECT source_file, window_start FROM states"""),
)
REPORTS.add(
    "episode_split",
    lambda s, d: ds.time_range_episodes(
        adapters.packets(s, d), {"site-0/early": ("train", "01:00", "03:00"), "site-0/late": ("test", "10:00", "13:00")},
        "site-0").groupBy("segment", "episode_split").agg(F.count("*").alias("n")),
    with_tables(PACKETS_SQL, select="""SELECT segment, episode_split, count(*) AS n FROM (SELECT CASE
    WHEN source_file <> 'site-0' THEN source_file WHEN hour("timestamp") BETWEEN 1 AND 2 THEN 'site-0/early'
    WHEN hour("timestamp") BETWEEN 10 AND 12 THEN 'site-0/late' END AS segment,
    CASE WHEN source_file = 'site-0' AND hour("timestamp") >= 10 THEN 'test' ELSE 'train' END AS episode_split
  FROM packets) WHERE segment IS NOT NULL GROUP BY 1, 2"""),
)
