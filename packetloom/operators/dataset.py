"""Forecasting dataset: cleaning, gap-filled window states, labels, splits and sequences.

Covers P4, P6-P14, J4-J6, A9, A10, A29, A30, W6-W17, W24-W26 and E44-E45.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.labels import coarse_stage, is_attack, map_label_set
from packetloom.functions.numeric import finite_double
from packetloom.operators.ordered import epoch_micros, explode_range, grouped_percentiles, owned_rows, with_halo
from packetloom.operators.windows import window_start
from packetloom.session import cut_lineage

HISTORY, HORIZON = 6, 6
SPLIT_TENTHS = (70, 85)  # percent of windows before validation and before test
METADATA = ("window_start", "source_file", "split", "current_attack", "current_attack_types",
            "future_attack_within_horizon", "future_attack_types", "history_available",
            "history_window_count", "forecast_sample_eligible")
IDENTIFIERS = ("Flow ID", "Src IP", "Dst IP", "Timestamp", "Label", "Src Port")
# Header spellings repaired on read.
COLUMN_ALIASES = {
    "FlowIAT Mean": "Flow IAT Mean",
    "Flow IATMean": "Flow IAT Mean",
    "FIN FlagCnt": "FIN Flag Cnt",
    "SYN FlagCnt": "SYN Flag Cnt",
    "ACK FlagCnt": "ACK Flag Cnt",
    "RST FlagCnt": "RST Flag Cnt",
    "PSH FlagCnt": "PSH Flag Cnt",
    "URG FlagCnt": "URG Flag Cnt",
}


def canonical_column(name: str) -> str:
    """P7. Header name with whitespace collapsed and known misspellings repaired."""
    collapsed = re.sub(r"\s+", " ", name.strip())
    return COLUMN_ALIASES.get(collapsed, collapsed)


def feature_name(column: str) -> str:
    """P13."""
    return column.strip().lower().replace("/", "_per_").replace(" ", "_")


def numeric_columns(header: Sequence[str]) -> list[str]:
    """P12. Columns usable as features: no identifiers, time or label."""
    return [c for c in header if c not in IDENTIFIERS]


def feature_columns(columns: Sequence[str]) -> list[str]:
    """P14. Everything but the metadata."""
    return [c for c in columns if c not in METADATA]


def reject_reason(width: Column, expected_width: Column, label: Column, timestamp: Column) -> Column:
    """P4. First reason to drop a raw row, NULL for a good one."""
    return (
        F.when(width != expected_width, "malformed_width")
        .when(F.trim(label) == "Label", "repeated_header")
        .when(timestamp.isNull(), "invalid_timestamp")
        .when(F.year(timestamp) == 1970, "known_1970_timestamp")
    )


def in_period(timestamp: Column, year: int = 2018, start: str | None = None, end: str | None = None) -> Column:
    """P9. Year match and half-open time range."""
    kept = F.year(timestamp) == year
    if start is not None:
        kept = kept & (timestamp >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        kept = kept & (timestamp < F.lit(end).cast("timestamp_ntz"))
    return kept


def impute_medians(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("source_file",)) -> DataFrame:
    """P10. Replace missing and non-finite values by the exact median of the file's finite values (0 if none)."""
    long = rows.select(*keys, *[finite_double(F.col(c)).alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "feature", "value")
    medians = grouped_percentiles(long, [*keys, "feature"], "value", {"median": 0.5})
    wide = medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"__med_{c}") for c in columns])
    return rows.join(wide, list(keys), "left").withColumns(
        {c: F.coalesce(finite_double(F.col(c)), F.col(f"__med_{c}"), F.lit(0.0)) for c in columns}
    ).drop(*[f"__med_{c}" for c in columns])


def sum_mean_states(rows: DataFrame, columns: Sequence[str], window_seconds: int = 10, ts: str = "timestamp",
                    label: str = "label", source: str = "source_file") -> DataFrame:
    """A9. Per source and window: flow count, sum and mean of finite values, attack flag and types."""
    def over_finite(fn, c):
        return F.coalesce(fn(finite_double(F.col(c))), F.lit(0.0))

    attack = is_attack(F.col(label))
    return rows.groupBy(source, window_start(ts, window_seconds).alias("window_start")).agg(
        F.count("*").alias("flow_count"),
        *[over_finite(fn, c).alias(f"{feature_name(c)}__{suffix}")
          for c in columns for suffix, fn in (("sum", F.sum), ("mean", F.avg))],
        F.max(attack.cast("int")).alias("current_attack"),
        F.sort_array(F.collect_set(F.when(attack, F.col(label)))).alias("current_attack_types"),
    )


def mean_std_max_min_states(rows: DataFrame, columns: Sequence[str], window_seconds: int = 10,
                            ts: str = "timestamp", label: str = "label",
                            keys: Sequence[str] = ("source_file",), attack_share: float = 0.10) -> DataFrame:
    """A10. 4 statistics per feature and a count; attack by share of attack rows; stage by majority.

    Rows with an unknown label are dropped. Ties of the majority stage go to the smallest.
    """
    labelled = rows.withColumn("__stage", coarse_stage(F.col(label))).filter(F.col("__stage").isNotNull())
    stats = (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max), ("min", F.min))
    # Dataset labels are few, so counting rows per (window, stage) first keeps the majority exact and small.
    window = window_start(ts, window_seconds).alias("window_start")
    states = labelled.groupBy(*keys, window).agg(
        *[F.coalesce(fn(F.coalesce(finite_double(F.col(c)), F.lit(0.0))), F.lit(0.0)).alias(f"{feature_name(c)}__{n}")
          for c in columns for n, fn in stats],
        F.count("*").cast("double").alias("count"),
        (F.avg((F.col("__stage") > 0).cast("double")) >= attack_share).cast("int").alias("attack"),
        *[F.count_if(F.col("__stage") == s).alias(f"__n{s}") for s in range(1, 5)],
    )
    most = F.greatest(*[F.col(f"__n{s}") for s in range(1, 5)])
    majority = F.coalesce(*[F.when((F.col(f"__n{s}") == most) & (most > 0), s) for s in range(1, 5)], F.lit(0))
    return states.withColumn("stage", majority).drop(*[f"__n{s}" for s in range(1, 5)])


def complete_timeline(states: DataFrame, window_seconds: int = 10, keys: Sequence[str] = ("source_file",)) -> DataFrame:
    """J4. Every window from first to last per source; empty ones hold zeros.

    ``window_index`` and ``window_count`` follow from arithmetic, so no ordering is needed, and a source
    whose events lie years apart has its windows made by many tasks. The states
    (one per non-empty window) are written once, so that bounds and join share one aggregation.
    """
    keys = list(keys)
    states = cut_lineage(states)
    micros = window_seconds * 1_000_000
    bounds = states.groupBy(*keys).agg(F.min("window_start").alias("__first"), F.max("window_start").alias("__last")).withColumn(
        "window_count", F.floor((epoch_micros("__last") - epoch_micros("__first")) / micros) + 1).drop("__last")
    after = F.make_dt_interval(secs=(F.col("window_index") * window_seconds).cast("decimal(18,6)"))
    timeline = explode_range(bounds, F.lit(0), F.col("window_count") - 1, "window_index").select(
        *keys, "window_count", (F.col("__first") + after).alias("window_start"), "window_index")
    filled = timeline.join(states, [*keys, "window_start"], "left")
    empty = F.array().cast("array<string>")
    zero = {}
    for name, dtype in states.dtypes:
        if name in keys or name == "window_start":
            continue
        zero[name] = F.coalesce(F.col(name), empty if dtype == "array<string>" else F.lit(0).cast(dtype))
    return filled.withColumns(zero)


def split_for(index: Column, count: Column) -> Column:
    """W6. Chronological split by position."""
    return (F.when(index * 100 < count * SPLIT_TENTHS[0], "train")
            .when(index * 100 < count * SPLIT_TENTHS[1], "validation").otherwise("test"))


def label_windows(timeline: DataFrame, keys: Sequence[str] = ("source_file",), history: int = HISTORY,
                  horizon: int = HORIZON) -> DataFrame:
    """W6-W10, W14. Split, future labels, history flags, eligibility and first attack step."""
    spread, order = with_halo(timeline, keys, "window_index", history - 1, horizon)
    ahead = order.rowsBetween(1, horizon)
    index, count = F.col("window_index"), F.col("window_count")
    labelled = spread.withColumns({
        "split": split_for(index, count),
        "future_attack_within_horizon": F.coalesce(F.max("current_attack").over(ahead), F.lit(0)),
        "future_attack_types": F.array_sort(F.array_distinct(F.flatten(
            F.collect_list("current_attack_types").over(ahead)))),
        "history_available": index >= history - 1,
        "history_window_count": F.least(index + 1, F.lit(history)),
        "forecast_sample_eligible": (index >= history - 1) & (index + horizon < count)
        & (split_for(index - (history - 1), count) == split_for(index + horizon, count)),
        "future_attack_step": F.array_position(F.collect_list("current_attack").over(ahead), F.lit(1)),
    })
    return owned_rows(labelled)


def assemble_sequences(labelled: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("source_file",),
                       history: int = HISTORY, horizon: int = HORIZON) -> DataFrame:
    """W11, W15, W16. X and Y arrays, span times, per-step attack, infiltration and stage targets."""
    state = F.array(*[F.col(c).cast("double") for c in columns])
    slim = labelled.select(
        *keys, "window_start", "window_index", "split", "forecast_sample_eligible",
        "future_attack_within_horizon", "future_attack_types", "future_attack_step", "current_attack",
        F.array_contains("current_attack_types", "Infiltration").cast("int").alias("__infiltration"),
        map_label_set(F.col("current_attack_types"))["stage"].alias("__stage"), state.alias("__state"),
    )
    spread, order = with_halo(slim, keys, "window_index", history - 1, horizon)
    back, ahead = order.rowsBetween(-(history - 1), 0), order.rowsBetween(1, horizon)
    built = spread.withColumns({
        "x": F.collect_list("__state").over(back),
        "y": F.collect_list("__state").over(ahead),
        "span": F.collect_list("window_start").over(order.rowsBetween(-(history - 1), horizon)),
        "span_splits": F.array_distinct(F.collect_list("split").over(order.rowsBetween(-(history - 1), horizon))),
        "attack_steps": F.collect_list("current_attack").over(ahead),
        "infiltration_steps": F.collect_list("__infiltration").over(ahead),
        "stage_steps": F.collect_list("__stage").over(ahead),
    })
    return owned_rows(built).filter("forecast_sample_eligible").withColumn(
        "aggregate_stage", map_label_set(F.col("future_attack_types"))["stage"]
    ).drop("__infiltration", "__stage", "__state")


def forecast_sequences(states: DataFrame, columns: Sequence[str], keys: Sequence[str], history: int = 20,
                       horizon: int = 5, stride: int = 1) -> DataFrame:
    """W13 and M8. Windows of history with the attack and stage of the next steps, per segment.

    ``stride`` keeps every n-th end position, as a sliding timeline scan does.
    """
    state = F.array(*[F.col(c).cast("double") for c in columns])
    slim = states.select(*keys, "window_start", "window_index", "attack", "stage", state.alias("__state"))
    spread, order = with_halo(slim, keys, "window_index", history - 1, horizon)
    back, ahead = order.rowsBetween(-(history - 1), 0), order.rowsBetween(1, horizon)
    built = owned_rows(spread.withColumns({
        "x": F.collect_list("__state").over(back),
        "y": F.collect_list("__state").over(ahead),
        "attack_steps": F.collect_list("attack").over(ahead),
        "stage_steps": F.collect_list("stage").over(ahead),
    }))
    return built.filter(
        (F.size("x") == history) & (F.size("y") == horizon)
        & ((F.col("window_index") - (history - 1)) % stride == 0)
    ).drop("__state")


def span_is_contiguous(span: Column, key: Column, window_seconds: int, history: int = HISTORY) -> Column:
    """W26. All span times one window apart, and the key is the last history slot."""
    steps = F.transform(F.sequence(F.lit(1), F.size(span) - 1), lambda i:
                        epoch_micros(F.get(span, i)) - epoch_micros(F.get(span, i - 1)))
    return F.forall(steps, lambda s: s == window_seconds * 1_000_000) & (F.get(span, F.lit(history - 1)) == key)


def walk_forward_check(labelled: DataFrame, source: str = "source_file") -> DataFrame:
    """W25. Within each source, every training window precedes validation, which precedes test."""
    def edge(fn, split):
        return fn(F.when(F.col("split") == split, F.col("window_start")))

    return labelled.groupBy(source).agg(
        edge(F.max, "train").alias("train_last"), edge(F.min, "validation").alias("validation_first"),
        edge(F.max, "validation").alias("validation_last"), edge(F.min, "test").alias("test_first"),
    ).withColumn("walk_forward", (F.col("train_last") < F.col("validation_first"))
                 & (F.col("validation_last") < F.col("test_first")))


def build_summary(labelled: DataFrame, source: str = "source_file", horizon: int = 6) -> DataFrame:
    """A29. Window and sample counts per source and, in the row with NULL source, overall."""
    eligible = F.col("forecast_sample_eligible")

    def count_of(condition):
        return F.count_if(condition)

    return labelled.rollup(source).agg(
        F.count("*").alias("window_count"),
        count_of(F.col("current_attack") == 0).alias("benign_current_windows"),
        count_of(F.col("current_attack") == 1).alias("attack_current_windows"),
        count_of(F.col("future_attack_within_horizon") == 1).alias("future_attack_positive_windows"),
        count_of(F.col("future_attack_within_horizon") == 0).alias("future_attack_negative_windows"),
        F.min("window_start").alias("earliest_window"), F.max("window_start").alias("latest_window"),
        count_of(F.col("window_index") + horizon >= F.col("window_count")).alias("incomplete_future_horizon_windows"),
        count_of(eligible).alias("valid_forecasting_samples"),
        *[count_of(eligible & (F.col("split") == s)).alias(f"{s}_windows") for s in ("train", "validation", "test")],
    )


def affected_values(rows: DataFrame, columns: Sequence[str], source: str = "source_file") -> DataFrame:
    """A29. Cells that imputation has to fill (no finite number), per source and, with NULL source, overall."""
    broken = [F.coalesce(finite_double(F.col(c)).isNull().cast("long"), F.lit(0)) for c in columns]
    total = broken[0]
    for cell in broken[1:]:
        total = total + cell
    return rows.withColumn("__affected", total).rollup(source).agg(
        F.count("*").alias("rows"), F.sum("__affected").alias("numeric_affected_values"),
        F.count_if(F.col("__affected") > 0).alias("rows_affected"))


def excluded_summary(classified: DataFrame, source: str = "source_file", reason: str = "reason") -> DataFrame:
    """A29. Rejected rows per source and reason."""
    return classified.filter(F.col(reason).isNotNull()).groupBy(source, reason).agg(F.count("*").alias("excluded_rows"))


def merge_packet_states(flow_states: DataFrame, packet_states: DataFrame, key: str = "window_id") -> DataFrame:
    """J5. Flow windows left-joined to packet windows; a matched packet value wins on shared names."""
    shared = [c for c in packet_states.columns if c != key and c in flow_states.columns]
    extra = [c for c in packet_states.columns if c != key and c not in flow_states.columns]
    right = packet_states.select(key, *[F.col(c).alias(f"__p_{c}") for c in [*shared, *extra]],
                                 F.lit(True).alias("__hit"))
    return flow_states.join(right, key, "left").select(
        *[F.when(F.col("__hit"), F.col(f"__p_{c}")).otherwise(F.col(c)).alias(c) if c in shared else F.col(c)
          for c in flow_states.columns],
        *[F.col(f"__p_{c}").alias(c) for c in extra],
    )


def missing_from_index(rows: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J6. Windows of ``rows`` that the canonical index does not list; must be empty."""
    return rows.select(*keys).distinct().join(index.select(*keys), list(keys), "left_anti")


def time_range_episodes(rows: DataFrame, episodes: Mapping[str, tuple[str, str, str]], source: str,
                        ts: str = "timestamp") -> DataFrame:
    """E45. Cut one source into named (split, start hour, end hour) episodes; other sources stay whole."""
    of_day = F.date_format(ts, "HH:mm")
    segment, split = F.col("source_file"), F.lit("train")
    chosen_segment = chosen_split = None
    for name, (part, start, end) in episodes.items():
        hit = (F.col("source_file") == source) & (of_day >= start) & (of_day < end)
        chosen_segment = F.when(hit, name) if chosen_segment is None else chosen_segment.when(hit, name)
        chosen_split = F.when(hit, part) if chosen_split is None else chosen_split.when(hit, part)
    other = F.col("source_file") != source
    return rows.withColumns({
        "segment": chosen_segment.when(other, segment), "episode_split": chosen_split.when(other, split),
    }).filter(F.col("segment").isNotNull())


