"""Risk, chain and trajectory expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.labels import LAST_STAGE, STAGE_NUMBER, progression_score, stage_name
from packetloom.functions.numeric import arg_max, clamp, top_two_margin
from packetloom.operators.ordered import previous_value

# Infiltration score of the stages that differ from plain progression.
INFILTRATION_STAGE = {
    "INITIAL_ACCESS": 0.55, "CREDENTIAL_ACCESS": 0.70, "DISCOVERY": 0.60, "LATERAL_MOVEMENT": 1.00,
    "COMMAND_AND_CONTROL": 0.90, "EXFILTRATION": 0.95,
}
# Network signal, accepted column names, value at which it saturates.
NETWORK_SIGNALS = [
    (("unique_destination_ports", "unique_dst_ports", "unique_ports"), 100.0),
    (("new_hosts", "new_nodes", "new_destination_hosts"), 20.0),
    (("failed_connections", "failed_logins", "failed_authentication"), 50.0),
    (("internal_connections", "east_west_connections"), 1000.0),
    (("anomaly_score",), 1.0),
]
# Infiltration reasons and the stages that count towards them.
REASON_PROBABILITY = "The world model predicts a high probability of malicious activity in the next network state."
REASON_STAGE = "The predicted MITRE stage is consistent with possible attack progression or internal compromise."
REASON_NETWORK = "Network-state indicators show elevated behavioural risk."
REASON_NONE = "No strong infiltration indicators were detected in the current forecast."
REASON_STAGES = ("INITIAL_ACCESS", "CREDENTIAL_ACCESS", "DISCOVERY", "LATERAL_MOVEMENT", "COMMAND_AND_CONTROL")
RISK_THRESHOLD = 0.70
# Advice by next stage; other stages read INITIAL_ACCESS.
PRECAUTIONS = {
    "BENIGN": [
        "Continue normal monitoring and keep endpoint protections enabled.",
        "Investigate any new high-severity events before treating traffic as malicious.",
    ],
    "RECONNAISSANCE": [
        "Rate-limit scanning sources and review unusual destination or port diversity.",
        "Restrict externally visible services and verify perimeter firewall rules.",
    ],
    "CREDENTIAL_ACCESS": [
        "Require MFA and temporarily rate-limit authentication attempts on the predicted target.",
        "Review failed-login events and rotate exposed credentials if compromise is suspected.",
    ],
    "INITIAL_ACCESS": [
        "Patch and isolate the exposed service on the predicted target.",
        "Restrict inbound access to trusted sources and review perimeter logs.",
    ],
}
# Texts of the next access step.
NEXT_STEP = "Possible progression toward %s access."
NO_NEXT_STEP = "No access attempt predicted within the current forecast horizon."
# Words of a severe message, and the limits of a head disagreement and of a trend.
HIGH_RISK_TERMS = ("attack", "injection", "unauthorized", "brute", "malware", "scan")
LOW_ATTACK_PROBABILITY, HIGH_STAGE_CONFIDENCE, TREND_EPSILON = 0.30, 0.70, 0.05


def next_stage(stage: Column) -> Column:
    """F14. The stage expected after the latest one."""
    return F.when(stage.isNotNull(), F.least(stage + 1, F.lit(LAST_STAGE)))


def chain_risk(confidence: Column, stage: Column) -> Column:
    """F15. Risk of a chain at its latest stage."""
    return clamp(0.55 * confidence + 0.45 * progression_score(stage))


def stage_risk(confidence: Column, stage: Column) -> Column:
    """F15. Risk of one stage within a chain."""
    return clamp(0.6 * confidence + 0.4 * progression_score(stage))


def attack_chain(predictions: DataFrame, keys: Sequence[str], ts: str, tie_break: Sequence[str] = (),
                 allow_backward: bool = False, bucket_seconds: float = 86400.0) -> DataFrame:
    """W23. Predictions that extend the chain of their key, with their risk.

    A repeat of the last accepted stage is dropped and so, unless allowed, is a step back. Without
    steps back a stage can only enter at its first occurrence, so one row per (key, stage) survives
    a partial aggregation and the running maximum looks at no more than 14 rows per key.
    """
    if allow_backward:
        placed = previous_value(predictions, keys, ts, tie_break, bucket_seconds, "stage", "__before")
        kept = placed.filter(F.col("__before").isNull() | (F.col("stage") != F.col("__before"))).drop("__before")
    else:
        others = [c for c in predictions.columns if c not in (*keys, "stage")]
        first = predictions.groupBy(*keys, "stage").agg(
            F.min_by(F.struct(*others), F.struct(ts, *tie_break)).alias("__row")).select(*keys, "stage", "__row.*")
        earlier = Window.partitionBy(*keys).orderBy(ts, *tie_break).rowsBetween(Window.unboundedPreceding, -1)
        top = F.max("stage").over(earlier)
        kept = first.withColumn("__top", top).filter(F.col("__top").isNull() | (F.col("stage") > F.col("__top"))).drop("__top")
    return kept.withColumn("risk_score", stage_risk(F.col("confidence"), F.col("stage")))


def chain_summary(chain: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """F14 + F15. Per forward chain (at most 14 rows): risk, activity, stage names, latest and next stage."""
    at = F.struct(*order)
    latest = chain.groupBy(*keys).agg(
        F.max_by("stage", at).alias("latest"), F.max_by("confidence", at).alias("confidence"),
        F.array_sort(F.collect_list(F.struct(*order, "stage"))).alias("steps"))
    return latest.select(
        *keys, F.round(chain_risk(F.col("confidence"), F.col("latest")), 4).alias("overall_risk"),
        (F.col("latest") != 0).alias("active"),
        F.transform("steps", lambda s: stage_name(s["stage"])).alias("stages"),
        stage_name(F.col("latest")).alias("latest_stage"), stage_name(next_stage(F.col("latest"))).alias("predicted_next_stage"))


def never_steps_back(stages: Column) -> Column:
    """W24. Whether a stage sequence never decreases."""
    later = F.slice(stages, 2, F.greatest(F.size(stages) - 1, F.lit(0)))
    return ~F.exists(F.transform(later, lambda s, i: s < F.get(stages, i)), lambda back: back)


def infiltration_stage_score(stage: Column) -> Column:
    """F16."""
    chain = None
    for name, value in INFILTRATION_STAGE.items():
        hit = stage == STAGE_NUMBER[name]
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.otherwise(progression_score(stage))


def network_score(columns: Sequence[str]) -> Column:
    """F16. Mean of the network signals present among ``columns``; NULL signals do not count."""
    parts = []
    for names, full in NETWORK_SIGNALS:
        present = [F.col(n) for n in names if n in columns]
        if present:
            value = F.coalesce(*present).cast("double") / full
            parts.append(clamp(value) if full == 1.0 else F.when(value > 1.0, 1.0).otherwise(value))
    if not parts:
        return F.lit(0.0)
    known = F.array_compact(F.array(*parts))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)).otherwise(0.0)


def infiltration_probability(attack: Column, stage: Column, network: Column, confidence: Column) -> Column:
    """F16."""
    blended = 0.50 * clamp(attack) + 0.30 * infiltration_stage_score(stage) + 0.20 * network
    return clamp(blended * (0.75 + 0.25 * clamp(confidence)))


def risk_level(probability: Column) -> Column:
    """F17."""
    return (F.when(probability >= 0.80, "CRITICAL").when(probability >= 0.65, "HIGH")
            .when(probability >= 0.40, "MEDIUM").otherwise("LOW"))


def infiltration_reasons(attack: Column, stage: Column, network: Column) -> Column:
    """F18."""
    given = F.array_compact(F.array(
        F.when(attack >= 0.70, REASON_PROBABILITY),
        F.when(stage.isin(*[STAGE_NUMBER[s] for s in REASON_STAGES]), REASON_STAGE),
        F.when(network >= 0.60, REASON_NETWORK)))
    return F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(REASON_NONE)))


def keyword_severity(message: Column) -> Column:
    """F21."""
    return F.when(F.lower(message).rlike("|".join(HIGH_RISK_TERMS)), "HIGH").otherwise("LOW")


def trajectory_steps(probabilities: Column, benign_class: int = 0) -> Column:
    """E38. Per step: class, confidence, margin over the runner-up, and 1 - P(benign)."""
    return F.transform(probabilities, lambda p, i: F.struct(
        (i + 1).alias("step"), arg_max(p).cast("int").alias("stage"), F.array_max(p).alias("confidence"),
        top_two_margin(p).alias("margin"), (1 - F.get(p, F.lit(benign_class))).alias("non_benign")))


def winning_step(steps: Column) -> Column:
    """E38. Highest stage, then confidence, then earliest step."""
    return F.array_max(F.transform(steps, lambda s: F.struct(
        s["stage"].alias("stage"), s["confidence"].alias("confidence"), (-s["step"]).alias("order"), s["step"].alias("step"))))


def overall_stage(stages: Column, names: Column, confidences: Column) -> Column:
    """E39. Highest stage (name order on ties) with the largest confidence it was given."""
    top = F.array_max(stages)
    zipped = F.arrays_zip(stages.alias("s"), names.alias("n"), confidences.alias("c"))
    at_top = F.filter(zipped, lambda z: z["s"] == top)
    name = F.array_min(F.transform(at_top, lambda z: z["n"]))
    return F.struct(top.alias("stage"), name.alias("name"), F.array_max(F.transform(F.filter(
        at_top, lambda z: z["n"] == name), lambda z: z["c"])).alias("confidence"))


def disagreement(attack: Column, steps: Column) -> Column:
    """E40. Steps called non-benign with high confidence although the overall score is low."""
    flagged = F.transform(F.filter(steps, lambda s: (s["stage"] != 0) & (s["confidence"] >= HIGH_STAGE_CONFIDENCE)),
                          lambda s: s["step"])
    return F.when(attack <= LOW_ATTACK_PROBABILITY, flagged).otherwise(F.array().cast("array<int>"))


def trend(steps: Column) -> Column:
    """F20. Direction of 1 - P(benign) from the first to the last step."""
    delta = F.element_at(steps, -1)["non_benign"] - F.get(steps, F.lit(0))["non_benign"]
    return F.when(delta > TREND_EPSILON, "increasing").when(delta < -TREND_EPSILON, "decreasing").otherwise("roughly stable")


def trajectory_narrative(attack: Column, steps: Column) -> Column:
    """F20. One-paragraph account of a trajectory."""
    names = F.transform(steps, lambda s: stage_name(s["stage"]))
    same = F.size(F.array_distinct(names)) == 1
    return F.concat_ws(
        " ", F.format_string("Attack probability over the horizon: %.4f.", attack),
        F.when(same, F.concat(F.lit("All steps predict "), F.get(names, F.lit(0)), F.lit("."))).otherwise(
            F.concat(F.lit("Stage trajectory: "), F.array_join(names, " -> "), F.lit("."))),
        F.format_string("The non-benign signal is %s.", trend(steps)))


def trajectory_account(attack: Column, steps: Column, features: Column | None = None) -> Column:
    """F20. The whole account: overall stage and confidence, steps, first and last signal, the feature that
    drives the most confident step, and a warning where the two heads disagree.

    ``features`` holds the strongest feature of each step; without it, or where it is NULL, that sentence is left out.
    """
    def stage_of(field):
        return F.transform(steps, lambda s: s[field])

    names = F.transform(steps, lambda s: stage_name(s["stage"]))
    overall = overall_stage(stage_of("stage"), names, stage_of("confidence"))
    same = F.size(F.array_distinct(names)) == 1
    first, last = F.get(steps, F.lit(0)), F.element_at(steps, -1)
    surest = F.array_position(stage_of("confidence"), F.array_max(stage_of("confidence"))).cast("int")
    flagged = disagreement(attack, steps)
    called = F.transform(flagged, lambda k: F.concat(k.cast("string"), F.lit(" ("), F.element_at(names, k), F.lit(")")))
    driver = F.lit(None).cast("string") if features is None else F.element_at(features, surest)
    return F.concat_ws(
        " ", F.format_string("Attack probability over the horizon: %.4f.", attack),
        F.format_string("Overall stage: %s (confidence %.4f).", overall["name"], overall["confidence"]),
        F.when(same, F.concat(F.lit("All steps predict "), F.get(names, F.lit(0)), F.lit("."))).otherwise(
            F.concat(F.lit("Stage trajectory: "), F.array_join(names, " -> "), F.lit("."))),
        F.format_string("The non-benign signal is %s (first step %.4f, last step %.4f).", trend(steps), first["non_benign"],
                        last["non_benign"]),
        F.when(driver.isNotNull(), F.format_string("Step %d (%s) is driven most by %s.", surest, F.element_at(names, surest), driver)),
        F.when(F.size(flagged) > 0, F.concat(
            F.lit("Warning: the attack probability is low, yet these steps are confident of an attack stage: "),
            F.array_join(called, ", "), F.lit("."))))


def flatten_trajectory(steps: Column, horizon: int = 6) -> list[Column]:
    """E41. Wide step_k columns."""
    return [F.get(steps, F.lit(k))[f].alias(f"step_{k + 1}_{f}") for k in range(horizon)
            for f in ("stage", "confidence", "margin", "non_benign")]


def verdict(risk: Column, horizon_seconds: int = 60) -> Mapping[str, Column]:
    """E10. Attack type, next access step, seconds to impact and precautions from the forecast risk."""
    high = risk >= RISK_THRESHOLD
    eta = F.greatest(F.lit(5), F.bround(F.lit(float(horizon_seconds)) * (1 - risk)).cast("int"))
    # A risk at the threshold reads as brute force, whose stage is followed by DISCOVERY, which has no own advice.
    following = F.initcap(F.replace(stage_name(next_stage(F.lit(STAGE_NUMBER["CREDENTIAL_ACCESS"]))), F.lit("_"), F.lit(" ")))
    return {
        "attack_type": F.when(high, "Brute Force").otherwise("Benign"),
        "next_access_step": F.when(high, F.format_string(NEXT_STEP, following)).otherwise(F.lit(NO_NEXT_STEP)),
        "estimated_time_seconds": F.when(high, eta),
        "precautions": F.when(high, F.array(*map(F.lit, PRECAUTIONS["INITIAL_ACCESS"]))).otherwise(
            F.array(*map(F.lit, PRECAUTIONS["BENIGN"]))),
    }


def forecast_timeline(latest: Column, risk: Column, horizon_seconds: int = 60, step_seconds: int = 10) -> Column:
    """E10. The forecast risk at each future step after the latest window."""
    marks = F.sequence(F.lit(1), F.lit(horizon_seconds // step_seconds))
    return F.transform(marks, lambda k: F.struct(
        (latest + F.make_dt_interval(secs=(k * step_seconds).cast("decimal(18,6)"))).alias("at"), risk.alias("risk")))


def classify_object(key: Column) -> Column:
    """F22. Kind of a listed object, from the last path part only."""
    base = F.lower(F.element_at(F.split(key, "/"), -1))
    return (F.when(key.endswith("/"), "folder_marker").when(base.endswith(".csv"), "processed_csv")
            .when(base.contains("pcap"), "raw_pcap_archive").when(base.contains("log"), "log_archive").otherwise("unknown"))


def classify_member(name: Column) -> Column:
    """F22. Kind of an archive member."""
    base = F.lower(F.element_at(F.split(name, "/"), -1))
    return (F.when(name.endswith("/"), "folder_marker").when(base.endswith(".pcap"), "pcap")
            .when(base.endswith(".pcapng"), "pcapng").when(base.contains("log"), "log").otherwise("unknown_extension"))


def smallest_in_band(listing: DataFrame, low: int, high: int, exclude: str, name: str = "filename",
                     size: str = "compressed_size") -> DataFrame:
    """T9. The smallest capture-like member within a size band."""
    kinds = classify_member(F.col(name)).isin("pcap", "pcapng", "unknown_extension")
    return listing.filter(kinds & (F.col(name) != exclude) & F.col(size).between(low, high)).orderBy(size, name).limit(1)


def json_numbers(payload: Column) -> Column:
    """F23. The numeric values of a flat JSON object, by key."""
    fields = F.from_json(payload, "map<string,string>")
    return F.map_filter(F.transform_values(fields, lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())
