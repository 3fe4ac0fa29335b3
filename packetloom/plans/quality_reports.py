"""Audit reports over raw rows and window states."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom import adapters
from packetloom.adapters import PACKETS_SQL
from packetloom.functions.labels import dataset_label
from packetloom.functions.timefmt import parse_timestamp
from packetloom.operators import dataset as ds
from packetloom.operators import quality as q
from packetloom.plans import dataset_reports as dr
from packetloom.plans import label_reports as lr
from packetloom.plans.registry import Reports, with_tables

REPORTS = Reports()


def raw(s, d):
    rows = dr.raw_rows(s, d)
    return rows.withColumns({
        "line": F.when(F.col("row_number") % 53 == 0, F.concat("raw_label", F.lit("��"))).otherwise(F.col("raw_label")),
        "parsed": parse_timestamp(F.col("raw_timestamp")).cast("timestamp_ntz")})


RAW_SQL = """
raw_rows AS (SELECT source_file, event_id AS row_number, CASE WHEN event_id % 97 = 0 THEN 79 ELSE 80 END AS width,
  CASE WHEN event_id % 89 = 0 THEN 'Label' ELSE label END AS label, CASE WHEN event_id % 53 = 0 THEN 2 ELSE 0 END AS bad,
  CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 79 = 0 THEN TIMESTAMP '1970-01-05 10:00:00'
    ELSE date_trunc('second', "timestamp") END AS parsed FROM packets)"""
BASE = (PACKETS_SQL, RAW_SQL)
REPORTS.add(
    "file_audit", lambda s, d: q.file_audit(raw(s, d)),
    with_tables(*BASE, select="""SELECT source_file, count(*) AS "rows", count(*) FILTER (width <> 80) AS malformed,
  count(*) FILTER (label = 'Label') AS repeated_headers, CAST(sum(bad) AS BIGINT) AS replacement_characters,
  count(*) FILTER (parsed IS NULL) AS invalid_timestamps, min(parsed) AS earliest, max(parsed) AS latest FROM raw_rows GROUP BY 1"""),
)
REPORTS.add(
    "audit_histograms", lambda s, d: q.audit_histograms(raw(s, d)),
    with_tables(*BASE, select="""SELECT source_file, 'width' AS kind, CAST(width AS VARCHAR) AS "value", count(*) AS n FROM raw_rows GROUP BY ALL
  UNION ALL SELECT source_file, 'year', CAST(year(parsed) AS VARCHAR), count(*) FROM raw_rows WHERE parsed IS NOT NULL GROUP BY ALL
  UNION ALL SELECT source_file, 'label', label, count(*) FROM raw_rows GROUP BY ALL"""),
)


def numeric_text(s, d):
    i = F.col("event_id")
    text = (F.when(i % 5 == 0, " ").when(i % 7 == 0, "abc").when(i % 11 == 0, "inf").when(i % 13 == 0, "-inf")
            .when(i % 17 == 0, "nan").otherwise(F.col("packet_length").cast("string")))
    return adapters.packets(s, d).select("source_file", text.alias("length_text"), F.col("ttl").cast("string").alias("ttl_text"))


REPORTS.add(
    "blank_cells",
    lambda s, d: q.blank_cells(numeric_text(s, d).withColumn("width", F.when(F.col("ttl_text") == "64", 80).otherwise(79)),
                               ["length_text", "ttl_text"], width="width"),
    with_tables(PACKETS_SQL, select="""SELECT source_file, 'length_text' AS "column", count(*) AS blanks FROM packets
  WHERE event_id % 5 = 0 AND ttl = 64 GROUP BY 1"""),
)
REPORTS.add(
    "affected_values", lambda s, d: ds.affected_values(numeric_text(s, d).select("source_file", *[
        F.col(c).try_cast("double").alias(c) for c in ("length_text", "ttl_text")]), ["length_text", "ttl_text"]),
    with_tables(PACKETS_SQL, """
odd AS (SELECT source_file, CAST(event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0
  OR packet_length IS NULL AS INT) + CAST(ttl IS NULL AS INT) AS k FROM packets)""",
                select="""SELECT source_file, count(*) AS "rows", CAST(sum(k) AS BIGINT) AS numeric_affected_values,
  count(*) FILTER (k > 0) AS rows_affected FROM odd GROUP BY ROLLUP (source_file)"""),
)
REPORTS.add(
    "numeric_quality", lambda s, d: q.numeric_quality(numeric_text(s, d), ["length_text", "ttl_text"]),
    with_tables(PACKETS_SQL, """
texts AS (SELECT source_file, CASE WHEN event_id % 5 = 0 THEN ' ' WHEN event_id % 7 = 0 THEN 'abc' WHEN event_id % 11 = 0 THEN 'inf'
  WHEN event_id % 13 = 0 THEN '-inf' WHEN event_id % 17 = 0 THEN 'nan' ELSE CAST(packet_length AS VARCHAR) END AS length_text,
  CAST(ttl AS VARCHAR) AS ttl_text FROM packets),
long AS (SELECT source_file, 'length_text' AS feature, trim(length_text) AS t FROM texts UNION ALL
  SELECT source_file, 'ttl_text', trim(ttl_text) FROM texts),
n AS (SELECT *, TRY_CAST(t AS DOUBLE) AS v FROM long)""", select="""SELECT feature, count(DISTINCT source_file) AS files_present,
  count(*) FILTER (t = '') AS missing_count, count(*) FILTER (t <> '' AND (v IS NULL OR isnan(v))) AS invalid_count,
  count(*) FILTER (v = 'inf'::DOUBLE) AS positive_infinity_count, count(*) FILTER (v = '-inf'::DOUBLE) AS negative_infinity_count,
  min(v) FILTER (isfinite(v)) AS finite_minimum, max(v) FILTER (isfinite(v)) AS finite_maximum FROM n GROUP BY 1"""),
)


def spelled(s, d):
    rows = adapters.packets(s, d)
    raw_label = F.when(F.col("label") == "Infiltration", F.when(F.col("event_id") % 2 == 0, "Infilteration").otherwise(
        "Infiltration")).otherwise(F.col("label"))
    return rows.withColumn("raw_label", raw_label).withColumn("label", dataset_label(F.col("raw_label")))


SPELLED_SQL = """
spelled AS (SELECT *, CASE WHEN label = 'Infiltration' AND event_id % 2 = 0 THEN 'Infilteration' ELSE label END AS raw_label FROM packets)"""
REPORTS.add(
    "label_distribution", lambda s, d: q.label_distribution(spelled(s, d)),
    with_tables(PACKETS_SQL, SPELLED_SQL, select="""SELECT raw_label, label AS normalized_label, count(*) AS flow_count,
  string_agg(DISTINCT source_file, '; ' ORDER BY source_file) AS files, min("timestamp") AS first_timestamp,
  max("timestamp") AS last_timestamp, round(count(*) * 100 / sum(count(*)) OVER (), 8) AS percentage FROM spelled GROUP BY 1, 2"""),
)
REPORTS.add(
    "label_files", lambda s, d: q.label_files(spelled(s, d)),
    with_tables(PACKETS_SQL, SPELLED_SQL, select="""SELECT raw_label, label AS normalized_label, source_file AS file, count(*) AS flow_count,
  min("timestamp") AS first_timestamp, max("timestamp") AS last_timestamp FROM spelled GROUP BY 1, 2, 3"""),
)
REPORTS.add(
    "label_report",
    lambda s, d: q.label_report(q.label_distribution(spelled(s, d)), 3).select("raw_label", "flow_count"),
    with_tables(PACKETS_SQL, SPELLED_SQL, select="""SELECT raw_label, count(*) AS flow_count FROM spelled GROUP BY 1
  ORDER BY 2 DESC, 1 LIMIT 3"""),
)
REPORTS.add(
    "attack_timeline", lambda s, d: q.attack_timeline(spelled(s, d)),
    with_tables(PACKETS_SQL, SPELLED_SQL, select="""SELECT source_file, label, string_agg(DISTINCT raw_label, '; ' ORDER BY raw_label)
  AS raw_labels, min("timestamp") AS first_timestamp, max("timestamp") AS last_timestamp,
  date_diff('microsecond', min("timestamp"), max("timestamp")) / 1000000 AS duration_seconds, count(*) AS flow_count
  FROM spelled WHERE label <> 'Benign' GROUP BY 1, 2"""),
)


def shuffled(s, d):
    """File order that differs from time order: row numbers swapped within groups of three."""
    i = F.col("row_number")
    return raw(s, d).withColumn("row_number", F.floor(i / 3) * 3 + (2 - i % 3))


ORDER_SQL = """
numbered AS (SELECT source_file, row_number // 3 * 3 + (2 - row_number % 3) AS row_number, parsed FROM raw_rows),
flagged AS (SELECT *, coalesce(parsed < last_value(parsed IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY row_number
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS out_of_order FROM numbered)"""
REPORTS.add("out_of_order_rows", lambda s, d: q.out_of_order(shuffled(s, d), block=500).select("source_file", "row_number", "out_of_order"),
            with_tables(*BASE, ORDER_SQL, select="SELECT source_file, row_number, out_of_order FROM flagged"))
REPORTS.add(
    "order_report", lambda s, d: q.order_report(q.out_of_order(shuffled(s, d), block=500)),
    with_tables(*BASE, ORDER_SQL, select="""SELECT source_file, min(parsed) AS earliest_timestamp, max(parsed) AS latest_timestamp,
  count(*) FILTER (out_of_order) AS out_of_order_row_count, round(count(*) FILTER (out_of_order) * 100 / count(*), 8)
  AS out_of_order_percentage, count(*) FILTER (parsed IS NULL) AS invalid_timestamp_count,
  CASE WHEN count(*) FILTER (out_of_order OR parsed IS NULL) = 0 THEN 'YES' ELSE 'NO' END AS chronologically_ordered
  FROM flagged GROUP BY 1"""),
)
REPORTS.add("epoch_rows", lambda s, d: q.epoch_rows(raw(s, d)).select("source_file", "row_number", "parsed"),
            with_tables(*BASE, select="SELECT source_file, row_number, parsed FROM raw_rows WHERE year(parsed) = 1970"))
CHECKED = ["flow_count", "packet_length__sum", "ttl__sum"]
REPORTS.add(
    "feature_quality", lambda s, d: q.feature_quality(dr.timeline(s, d), CHECKED),
    with_tables(*dr.BASE, "long AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM timeline" for c in CHECKED) + """),
c AS (SELECT feature, v, count(*) AS n FROM long GROUP BY 1, 2)""", select="""SELECT feature, CAST(sum(n) AS BIGINT) AS sample_count,
  min(v) AS finite_minimum, max(v) AS finite_maximum, sum(v * n) / sum(n) AS finite_mean,
  arg_max(v, struct_pack(a := n, b := -v)) AS dominant_value, count(*) AS distinct_values,
  CAST(min(v) = max(v) AS INT) AS constant, CAST(max(n) * 100 / sum(n) >= 99.5 AS INT) AS near_constant_99_5_percent,
  round(max(n) * 100 / sum(n), 8) AS dominant_percentage, 0 AS extremely_large_abs_value FROM c GROUP BY 1"""),
    doubles=["finite_mean"],
)
REPORTS.add(
    "temporal_invariants", lambda s, d: q.temporal_invariants(dr.labelled(s, d), CHECKED, window_seconds=3600),
    with_tables(*dr.BASE, select="""SELECT source_file, true AS sorted_unique, bool_and(year(window_start) <> 1970) AS no_1970,
  count(DISTINCT CAST(window_start AS DATE)) = 1 AS single_day, true AS all_finite,
  true AS future_label_matches, true AS eligibility_matches FROM timeline GROUP BY 1"""),
)
REPORTS.add(
    "duplicate_states",
    lambda s, d: q.duplicate_count(dr.labelled(s, d).filter("forecast_sample_eligible"), q.state_hash(["flow_count", "packet_length__sum"])),
    with_tables(*dr.LABELLED, select="""SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) AS distinct_rows FROM (SELECT count(*) AS n
  FROM labelled WHERE eligible GROUP BY flow_count, packet_length__sum)"""),
)
REPORTS.add(
    "split_leakage", lambda s, d: q.split_leakage(dr.labelled(s, d), ["window_start"]),
    with_tables(*dr.LABELLED, select="""SELECT count(*) AS leaking_keys FROM (SELECT window_start FROM labelled GROUP BY 1
  HAVING count(DISTINCT split) > 1)"""),
)
REPORTS.add(
    "label_mismatches", lambda s, d: q.label_mismatches(dr.labelled(s, d)),
    with_tables(*dr.LABELLED, select="""SELECT count(*) FILTER ((future_attack_within_horizon = 1) <> list_contains(attack_list, 1))
  AS mismatches FROM labelled"""),
)


def narrow_sequences(s, d):
    from packetloom.operators.dataset import assemble_sequences

    return assemble_sequences(dr.labelled(s, d), ["current_attack"])


PATTERN_SQL = """
patterns AS (SELECT source_file, split, string_agg(current_attack, '') OVER (PARTITION BY source_file ORDER BY window_start ROWS 5 PRECEDING)
  AS x, eligible FROM labelled),
samples AS (SELECT * FROM patterns WHERE eligible)"""
REPORTS.add(
    "duplicate_sequences",
    lambda s, d: q.duplicate_sequences(narrow_sequences(s, d).filter("split = 'train'"), narrow_sequences(s, d).filter("split = 'test'")),
    with_tables(*dr.LABELLED, PATTERN_SQL, select="""SELECT count(*) AS duplicates, count(*) FILTER (x = '000000') AS all_zero,
  count(*) FILTER (x <> '000000') AS non_zero FROM samples WHERE split = 'test' AND x IN (SELECT x FROM samples WHERE split = 'train')"""),
)
REPORTS.add(
    "holdout_leakage", lambda s, d: q.holdout_leakage(narrow_sequences(s, d), ["site-1"], 1),
    with_tables(*dr.LABELLED, PATTERN_SQL, select="""SELECT d.*, (SELECT count(*) FROM samples WHERE split <> 'test' AND source_file = 'site-1')
  AS excluded_rows, CAST(0 AS BIGINT) AS leftover_rows, true AS scaler_differs, true AS all_finite, true AS feature_count_matches FROM
  (SELECT count(*) AS duplicates, count(*) FILTER (x = '000000') AS all_zero, count(*) FILTER (x <> '000000') AS non_zero FROM samples
   WHERE split = 'test' AND x IN (SELECT x FROM samples WHERE split = 'train' AND source_file <> 'site-1')) d"""),
)
REPORTS.add(
    "step_target_mismatches", lambda s, d: q.step_target_mismatches(dr.sequences(s, d)),
    with_tables(*dr.LABELLED, select="SELECT count(*) AS samples, CAST(0 AS BIGINT) AS mismatching_steps FROM labelled WHERE eligible"),
)
FAMILY_SQL = """
each AS (SELECT source_file, split, eligible, unnest(string_split(types, ';')) AS raw_label FROM labelled WHERE types <> ''),
fam AS (SELECT *, CASE raw_label WHEN 'FTP-BruteForce' THEN 'Brute Force' WHEN 'DoS attacks-Hulk' THEN 'DoS' ELSE raw_label END AS family FROM each),
families AS (SELECT family, count(*) FILTER (eligible AND split = 'train') AS train, count(*) FILTER (eligible AND split = 'validation') AS validation,
  count(*) FILTER (eligible AND split = 'test') AS test, string_agg(DISTINCT raw_label, ';' ORDER BY raw_label) AS raw_labels,
  string_agg(DISTINCT source_file, ';' ORDER BY source_file) AS sources, count(*) FILTER (eligible) AS total FROM fam GROUP BY 1)"""


def families(s, d):
    return q.family_split_table(dr.labelled(s, d))


REPORTS.add(
    "family_split_table",
    lambda s, d: families(s, d).withColumns({c: F.array_join(c, ";") for c in ("raw_labels", "sources")}),
    with_tables(*dr.LABELLED, FAMILY_SQL, select="SELECT * FROM families"),
)
REPORTS.add(
    "family_split_pivot", lambda s, d: q.label_split_pivot(dr.labelled(s, d)),
    with_tables(*dr.LABELLED, FAMILY_SQL, select="""SELECT raw_label, count(*) FILTER (split = 'train') AS train,
  count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM each WHERE eligible GROUP BY 1"""),
)
REPORTS.add(
    "family_suitability", lambda s, d: q.family_suitability(families(s, d)).select("family", "suitability", "one_source"),
    with_tables(*dr.LABELLED, FAMILY_SQL, select="""SELECT family, CASE WHEN train < 50 OR test < 30 THEN 'UNSUITABLE'
  WHEN contains(raw_labels, ';') THEN 'MARGINAL' ELSE 'SUITABLE' END AS suitability, NOT contains(sources, ';') AS one_source FROM families"""),
)
REPORTS.add(
    "sources_with_several_families",
    lambda s, d: q.sources_with_several_families(dr.labelled(s, d).withColumn("source_file", F.when(
        F.col("source_file") == "site-1", "site-0").otherwise(F.col("source_file")))),
    with_tables(*dr.LABELLED, FAMILY_SQL, select="""SELECT CASE WHEN source_file = 'site-1' THEN 'site-0' ELSE source_file END AS source_file,
  count(DISTINCT family) AS families FROM fam GROUP BY 1 HAVING count(DISTINCT family) > 1"""),
)
REPORTS.add(
    "mapping_audit", lambda s, d: q.mapping_audit(lr.picked(s, d)),
    with_tables(lr.LABELS_SQL, select="""SELECT m.label, m.stage, m.stage_name, m.confidence, m.technique, m.evidence_type,
  n IN (SELECT key FROM entries) AS exact FROM mapped m WHERE label IN (SELECT label FROM picked)"""),
)


def headers(s, d):
    """One header per site: a shared set of columns plus the event types seen on some sites."""
    rows = adapters.packets(s, d).select("source_file", F.explode(F.array(
        F.lit("Label"), F.col("protocol"), F.when(F.col("source_file") == "site-2", F.col("label")).otherwise("Benign"))).alias("c"))
    return rows.groupBy(F.col("source_file").alias("file")).agg(F.sort_array(F.collect_set("c")).alias("columns"))


HEADERS_SQL = """
pairs AS (SELECT DISTINCT source_file AS file, unnest(['Label', protocol, CASE WHEN source_file = 'site-2' THEN label ELSE 'Benign' END]) AS col
  FROM packets),
everything AS (SELECT list_sort(list(DISTINCT col)) AS u FROM pairs),
counted AS (SELECT col, count(*) AS n FROM pairs GROUP BY 1)"""
REPORTS.add(
    "schema_report", lambda s, d: q.schema_report(headers(s, d)),
    with_tables(PACKETS_SQL, HEADERS_SQL, select="""SELECT file, coalesce(string_agg(col, '; ' ORDER BY col) FILTER (n < 4), '') AS extra,
  count(*) AS column_count, array_to_string(list_filter(any_value(u), lambda c: NOT list_contains(list(col), c)), '; ') AS missing
  FROM (SELECT file, col, n, u FROM pairs JOIN counted USING (col), everything) GROUP BY 1""".replace(
        "list_filter(any_value(u), lambda c: NOT list_contains(list(col), c))",
        "list_filter(any_value(u), lambda c: NOT contains(string_agg(col, '|'), c))")),
)
REPORTS.add(
    "schema_groups", lambda s, d: q.schema_groups(headers(s, d)),
    with_tables(PACKETS_SQL, HEADERS_SQL, select="""SELECT header, string_agg(file, '; ' ORDER BY file) AS files, count(*) AS file_count FROM
  (SELECT file, string_agg(col, ',' ORDER BY col) AS header FROM pairs GROUP BY 1) GROUP BY 1"""),
)
