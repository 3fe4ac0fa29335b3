"""Log tables, alerts and dashboards."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.risk import keyword_severity

# Statements that may not touch a read-only log table.
FORBIDDEN_STATEMENTS = (r"UPDATE\s+{t}", r"DELETE\s+FROM\s+{t}", r"DROP\s+TABLE\s+{t}", r"TRUNCATE\s+(?:TABLE\s+)?{t}",
                        r"ALTER\s+TABLE\s+{t}")


def log_entries(lines: DataFrame, text: str = "value", log_id: str | None = None, ts: str | None = None,
                message_length: int | None = None) -> DataFrame:
    """S13. Non-blank trimmed lines as log rows; the message is the line, or its first ``message_length`` characters."""
    line = F.trim(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""))
    kept = [F.col(log_id).alias("log_id")] if log_id else []
    kept += [F.col(ts).alias("timestamp")] if ts else []
    return lines.select(*kept, line.alias("raw_log")).filter("raw_log <> ''").withColumns({
        "severity": keyword_severity(F.col("raw_log")), "event_type": F.lit("IDS event"),
        "src_ip": F.lit("127.0.0.1"), "dest_ip": F.lit("127.0.0.1"), "message": F.col("raw_log") if message_length is None else F.substring("raw_log", 1, message_length)})


def alerts(logs: DataFrame) -> DataFrame:
    """M7. One active alert per log entry of HIGH or CRITICAL severity.

    On a stream with a watermark the repeats of a log id are dropped within it.
    """
    raised = logs.filter(F.upper("severity").isin("HIGH", "CRITICAL"))
    once = raised.dropDuplicatesWithinWatermark(["log_id"]) if raised.isStreaming else raised.dropDuplicates(["log_id"])
    return once.select(
        "log_id", *[c for c in ("timestamp",) if c in logs.columns],
        F.concat(F.lit("High severity IDS event: "), F.col("event_type")).alias("rule_triggered"),
        F.lit("Active").alias("status"), "severity", F.lit(1.0).alias("anomaly_score"))


def filter_logs(logs: DataFrame, severity: str | None = None, src_ip: str | None = None, user: str | None = None,
                page: int = 1, page_size: int = 50, tie_break: str = "log_id") -> DataFrame:
    """P15. Newest first, filtered, one page."""
    for column, value in (("severity", severity), ("src_ip", src_ip), ("user", user)):
        if value is not None:
            logs = logs.filter(F.col(column) == value)
    return logs.orderBy(F.desc("timestamp"), F.desc(tie_break)).offset((page - 1) * page_size).limit(page_size)


def recent(rows: DataFrame, n: int, ts: str = "timestamp", tie_break: str = "log_id") -> DataFrame:
    """T5."""
    return rows.orderBy(F.desc(ts), F.desc(tie_break)).limit(n)


def dashboard_counts(logs: DataFrame, raised: DataFrame, active_status: str = "Active") -> DataFrame:
    """A31. Log, alert and active-alert counts."""
    from packetloom.operators.ordered import beside

    return beside(
        logs.agg(F.count("*").alias("logs"), F.count_if(F.col("severity") == "HIGH").alias("high_severity_logs")),
        raised.agg(F.count("*").alias("alerts"), F.count_if(F.col("status") == active_status).alias("active_alerts")))


def guarded_sql(spark: SparkSession, statement: str, log_table: str = "logs_logentry") -> DataFrame:
    """P16. Run a statement unless it would change the log table."""
    if not statement.strip():
        raise ValueError("empty query")
    for pattern in FORBIDDEN_STATEMENTS:
        if re.search(pattern.format(t=re.escape(log_table)), statement, re.IGNORECASE):
            raise PermissionError("the log table is read-only")
    return spark.sql(statement)
