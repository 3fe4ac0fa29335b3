"""Attack labels, kill-chain stages and families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.session import cut_lineage

# Kill-chain stages by number, with descriptions.
STAGES = [
    ("BENIGN", "Normal network behaviour"),
    ("RECONNAISSANCE", "Attacker is gathering information about the target network"),
    ("INITIAL_ACCESS", "Attacker is attempting to gain initial access"),
    ("EXECUTION", "Potential malicious execution activity"),
    ("PERSISTENCE", "Potential persistence establishment"),
    ("PRIVILEGE_ESCALATION", "Potential privilege escalation"),
    ("DEFENSE_EVASION", "Potential security control evasion"),
    ("CREDENTIAL_ACCESS", "Potential credential theft or brute-force activity"),
    ("DISCOVERY", "Network or system discovery activity"),
    ("LATERAL_MOVEMENT", "Potential movement between internal systems"),
    ("COLLECTION", "Potential collection of sensitive information"),
    ("COMMAND_AND_CONTROL", "Potential attacker command and control communication"),
    ("EXFILTRATION", "Potential extraction of data from the network"),
    ("IMPACT", "Potential impact on network availability or systems"),
]
LAST_STAGE = len(STAGES) - 1
STAGE_NUMBER = {name: i for i, (name, _) in enumerate(STAGES)}

# Label keyword, stage, confidence, technique, description, evidence, in lookup order.
LABEL_STAGES = [
    ("benign", "BENIGN", 1.0, None, "Normal network behaviour", "heuristic"),
    ("portscan", "RECONNAISSANCE", 0.90, "T1046", "Network Service Discovery", "heuristic"),
    ("scan", "RECONNAISSANCE", 0.85, "T1046", "Network Service Discovery", "heuristic"),
    ("reconnaissance", "RECONNAISSANCE", 0.90, None, "Reconnaissance activity", "heuristic"),
    ("bruteforce", "CREDENTIAL_ACCESS", 0.90, "T1110", "Brute Force", "heuristic"),
    ("brute force", "CREDENTIAL_ACCESS", 0.90, "T1110", "Brute Force", "heuristic"),
    ("credential attack", "CREDENTIAL_ACCESS", 0.85, None, "Credential access attempt", "heuristic"),
    ("web attack", "INITIAL_ACCESS", 0.80, None, "Possible exploitation of public-facing application", "heuristic"),
    ("infiltration", "LATERAL_MOVEMENT", 0.80, None, "Possible internal compromise or lateral movement",
     "heuristic_uncertain"),
    ("botnet", "COMMAND_AND_CONTROL", 0.85, None, "Possible command and control activity", "heuristic"),
    ("c2", "COMMAND_AND_CONTROL", 0.85, None, "Command and control activity", "heuristic"),
    ("ddos", "IMPACT", 0.95, None, "Distributed denial of service activity", "heuristic"),
    ("dos", "IMPACT", 0.90, None, "Denial of service activity", "heuristic"),
    ("exfiltration", "EXFILTRATION", 0.95, "T1041", "Exfiltration over C2 channel", "heuristic"),
    ("lateral movement", "LATERAL_MOVEMENT", 0.90, None, "Possible lateral movement", "heuristic"),
    ("ddos attack hoic", "IMPACT", 0.95, "T1498", "High Orbit Ion Cannon volumetric flood", "authoritative_generic"),
    ("ddos attacks loic http", "IMPACT", 0.95, "T1498", "Low Orbit Ion Cannon HTTP-flood mode",
     "authoritative_generic"),
    ("ddos attack loic udp", "IMPACT", 0.95, "T1498", "Low Orbit Ion Cannon UDP-flood mode", "authoritative_generic"),
    ("loic http", "IMPACT", 0.95, "T1498", "Low Orbit Ion Cannon HTTP-flood mode (shorthand alias)",
     "authoritative_generic"),
    ("loic udp", "IMPACT", 0.95, "T1498", "Low Orbit Ion Cannon UDP-flood mode (shorthand alias)",
     "authoritative_generic"),
    ("dos attacks hulk", "IMPACT", 0.90, "T1499", "HULK single-target HTTP application-layer DoS",
     "authoritative_generic"),
    ("dos attacks slowhttptest", "IMPACT", 0.90, "T1499", "SlowHTTPTest single-target application-layer DoS",
     "authoritative_generic"),
    ("dos attacks goldeneye", "IMPACT", 0.90, "T1499", "GoldenEye single-target application-layer DoS",
     "authoritative_generic"),
    ("dos attacks slowloris", "IMPACT", 0.90, "T1499", "Slowloris single-target application-layer DoS",
     "authoritative_generic"),
    ("sql injection", "INITIAL_ACCESS", 0.85, "T1190", "SQL injection against a public-facing web application",
     "authoritative_generic"),
    ("brute force  xss", "INITIAL_ACCESS", 0.70, "T1190",
     "Cross-Site Scripting against a public-facing web application", "heuristic_reasoned"),
    ("xss", "INITIAL_ACCESS", 0.70, "T1190",
     "Cross-Site Scripting against a public-facing web application (shorthand alias)", "heuristic_reasoned"),
    ("infilteration", "LATERAL_MOVEMENT", 0.80, None, "Possible internal compromise or lateral movement",
     "heuristic_uncertain"),
    ("web brute force", "CREDENTIAL_ACCESS", 0.90, "T1110", "Brute Force", "authoritative_generic"),
]
UNKNOWN_LABEL = ("BENIGN", 0.0, None, "Unknown attack type", "not_applicable")
NO_LABELS = ("BENIGN", 0.0, None, "No attack labels in horizon", "not_applicable")

# Dataset spelling corrections.
LABEL_SPELLING = {
    "Infilteration": "Infiltration",
    "DDOS attack-HOIC": "DDoS attack-HOIC",
    "DDOS attack-LOIC-UDP": "DDoS attack-LOIC-UDP",
}
# Attack family of each dataset label.
LABEL_FAMILY = {
    "FTP-BruteForce": "Brute Force",
    "SSH-Bruteforce": "Brute Force",
    "DoS attacks-GoldenEye": "DoS",
    "DoS attacks-Slowloris": "DoS",
    "DoS attacks-SlowHTTPTest": "DoS",
    "DoS attacks-Hulk": "DoS",
    "DDoS attacks-LOIC-HTTP": "DDoS",
    "DDoS attack-LOIC-UDP": "DDoS",
    "DDoS attack-HOIC": "DDoS",
    "Brute Force -Web": "Web Attack",
    "Brute Force -XSS": "Web Attack",
    "SQL Injection": "Web Attack",
    "Infiltration": "Infiltration",
    "Bot": "Bot",
}
# Stage of each lower-cased label in the 85-dimension state path.
COARSE_STAGE = {
    "benign": 0, "ftp-bruteforce": 2, "ssh-bruteforce": 2, "brute force -web": 2, "brute force -xss": 2,
    "sql injection": 2, "dos attacks-hulk": 3, "dos attacks-slowhttptest": 3, "dos attacks-goldeneye": 3,
    "dos attacks-slowloris": 3, "ddos attack-hoic": 3, "ddos attack-loic-udp": 3, "infilteration": 4,
    "infiltration": 4,
}
# Seven-stage view: name, severity, tactic, description, recommended action.
COARSE_STAGES = [
    ("Benign", 0, "N/A", "Normal network traffic with no detected malicious activity.",
     "Continue standard network monitoring."),
    ("Reconnaissance", 2, "TA0043", "Attacker gathering network topology and service profiles.",
     "Inspect source IP scan velocity. Enforce border rate-limiting."),
    ("Initial Access", 4, "TA0001", "Attempts to gain initial foothold via brute force or exposed services.",
     "Isolate targeted perimeter hosts. Throttle authentication endpoints."),
    ("Execution", 6, "TA0002", "Execution of adversary-controlled code and payloads.",
     "Quarantine affected host process space. Trigger memory snapshot."),
    ("Lateral Movement", 8, "TA0008", "Adversary extending access across internal subnets and credentials.",
     "Segment VLANs immediately. Revoke high-privilege session tokens."),
    ("Command & Control", 9, "TA0011", "Maintaining persistent communication channel to external infrastructure.",
     "Sinkhole identified C2 domains. Block outbound beaconing egress."),
    ("Exfiltration", 10, "TA0010", "Unauthorized data staging and exfiltration out of network perimeter.",
     "CRITICAL ALERT: Sever non-essential external bandwidth. Engage Incident Response."),
]
BENIGN_LABELS = ("", "Benign", "Label")


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def dataset_label(raw: Column) -> Column:
    """P5. Trimmed label with the known misspellings corrected."""
    trimmed = F.trim(raw)
    return F.coalesce(F.try_element_at(literal_map(LABEL_SPELLING), trimmed), trimmed)


def is_attack(label: Column) -> Column:
    """P11."""
    return F.coalesce(~label.isin(*BENIGN_LABELS), F.lit(False))


def attack_family(label: Column) -> Column:
    return F.try_element_at(literal_map(LABEL_FAMILY), label)


def canonical_label(raw: Column) -> Column:
    """P8. Trimmed, whitespace collapsed, lower case."""
    return F.lower(F.regexp_replace(F.trim(raw), r"\s+", " "))


def coarse_stage(raw: Column) -> Column:
    """P8. Stage 0-4, NULL for an unknown label (such rows are dropped)."""
    return F.try_element_at(literal_map(COARSE_STAGE), canonical_label(raw))


def normalized_label(raw: Column) -> Column:
    """F9. Trimmed, lower case, with ``_`` and ``-`` as spaces."""
    return F.translate(F.lower(F.trim(raw)), "_-", "  ")


def _entry(stage: str, confidence: float, technique: str | None, description: str, evidence: str,
           key: str = "") -> Column:
    return F.struct(
        F.lit(key).alias("key"), F.lit(STAGE_NUMBER[stage]).alias("stage"), F.lit(stage).alias("stage_name"),
        F.lit(confidence).alias("confidence"), F.lit(technique).cast("string").alias("technique"),
        F.lit(description).alias("description"), F.lit(evidence).alias("evidence_type"),
    )


def map_label(raw: Column) -> Column:
    """F10. Stage struct of a label: exact keyword, else the first keyword containing or contained."""
    entries = F.array(*[_entry(*rest, key=key) for key, *rest in LABEL_STAGES])
    label = normalized_label(raw)
    exact = F.filter(entries, lambda e: e["key"] == label)
    partial = F.filter(entries, lambda e: label.contains(e["key"]) | e["key"].contains(label))
    return F.coalesce(F.get(exact, F.lit(0)), F.get(partial, F.lit(0)), _entry(*UNKNOWN_LABEL))


def map_label_set(labels: Column) -> Column:
    """F12. Dominant stage of an array of labels: highest stage, then first normalised label."""
    present = F.filter(labels, lambda x: F.trim(x) != "")
    hits = F.transform(present, lambda x: F.struct(normalized_label(x).alias("label"), map_label(x).alias("hit")))
    ranked = F.transform(hits, lambda h: F.struct((-h["hit"]["stage"]).alias("rank"), h["label"], h["hit"]))
    return F.coalesce(F.array_min(ranked)["hit"], _entry(*NO_LABELS))


def split_labels(joined: Column) -> Column:
    return F.filter(F.transform(F.split(joined, ";"), F.trim), lambda x: x != "")


def attach_stage(rows: DataFrame, label: str = "label", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """J13. Resolve the distinct labels once, then join the stage columns back; a NULL label gets NULLs.

    The resolved labels are written and measured. Up to ``broadcast_bytes`` they go to every task, so that rows
    are not shuffled by label and a frequent label meets no single task; more of them are left to a shuffled join.
    """
    fields = ["stage", "stage_name", "confidence", "technique", "description", "evidence_type"]
    resolved = cut_lineage(rows.select(label).distinct().withColumn("__hit", map_label(F.col(label))).select(
        label, *[F.col(f"__hit.{f}").alias(f) for f in fields]))
    texts = sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in (label, "stage_name", "technique", "description", "evidence_type"))
    size = resolved.agg(F.sum(texts + 64)).first()[0] or 0
    return rows.join(F.broadcast(resolved) if size <= broadcast_bytes else resolved, label, "left")


def stage_name(stage: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n, _ in STAGES]), stage + 1)


def stage_from_probabilities(probabilities: Column) -> Column:
    """F11. Stage with the largest probability (first on ties), capped at the last stage."""
    best = F.least(F.array_position(probabilities, F.array_max(probabilities)) - 1, F.lit(LAST_STAGE)).cast("int")
    empty = F.coalesce(F.size(probabilities), F.lit(0)) <= 0
    return F.struct(
        F.when(empty, 0).otherwise(best).alias("stage"),
        F.when(empty, 0.0).otherwise(F.get(probabilities, best)).alias("confidence"),
        F.when(empty, "No prediction available").otherwise(
            F.try_element_at(F.array(*[F.lit(d) for _, d in STAGES]), best + 1)).alias("description"),
    )


def progression_score(stage: Column) -> Column:
    """F13."""
    return stage / F.lit(float(LAST_STAGE))


def is_progression(previous: Column, current: Column) -> Column:
    """F13."""
    return current >= previous


def coarse_stage_info(stage: Column) -> Column:
    """F19. Name, severity, tactic, description and action; unknown numbers read as stage 0."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), F.lit(t).alias("tactic"),
                              F.lit(d).alias("description"), F.lit(a).alias("action"))
                     for n, s, t, d, a in COARSE_STAGES])
    known = F.when(stage.between(0, len(COARSE_STAGES) - 1), stage).otherwise(0)
    return F.get(rows, known.cast("int"))


def stage_narrative(stages: Column) -> Column:
    """F19. One line per non-benign step of a stage sequence."""
    lines = F.transform(stages, lambda s, i: F.when(s > 0, F.format_string(
        "- **T+%d**: %s (%s) — *%s*", (i + 1), coarse_stage_info(s)["name"], coarse_stage_info(s)["tactic"],
        coarse_stage_info(s)["description"])))
    quiet = ~F.exists(stages, lambda s: s != 0)
    return F.when(quiet, "All forecast windows project benign baseline network traffic.").otherwise(
        F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"))
