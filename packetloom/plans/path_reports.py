"""Iterative graph reports over the peer graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom import adapters
from packetloom.adapters import PEER_EDGES_SQL
from packetloom.operators import paths as pt
from packetloom.plans import graph_reports as gr
from packetloom.plans import packet_reports as pr
from packetloom.plans.registry import Reports, with_tables

REPORTS = Reports()
EDGES = adapters.peer_edges
ATTACKERS, TARGET = [3, 14, 27], 42
DEPTH = 10


def risk(s, d):
    """Node risk: the share of error events per user."""
    events = adapters.table(s, d, "events")
    return events.groupBy(F.col("user_id").alias("node")).agg(
        (F.count_if(F.col("event_type") == "error") * 2.5 / F.count("*")).alias("risk"))


RISK_SQL = """
risk AS (SELECT user_id AS node, count(*) FILTER (event_type = 'error') * 2.5 / count(*) AS raw_risk,
  least(1, count(*) FILTER (event_type = 'error') * 2.5 / count(*)) AS risk FROM events GROUP BY 1)"""
NODES_SQL = "vertices AS (SELECT src AS node FROM peer_edges UNION SELECT dst FROM peer_edges)"
# Shortest distances and path counts from walk counts: the first length with a walk is the distance.
WALKS_SQL = "w0 AS (SELECT node AS s, node AS t, 1.0 AS n FROM vertices),\n" + ",\n".join(
    f"w{i} AS (SELECT s, dst AS t, sum(n) AS n FROM w{i - 1} JOIN peer_edges ON src = t GROUP BY 1, 2)"
    for i in range(1, DEPTH + 1)) + ",\nwalks AS (" + " UNION ALL ".join(
    f"SELECT {i} AS d, * FROM w{i}" for i in range(DEPTH + 1)) + """),
dist AS (SELECT s, t, min(d) AS d, arg_min(n, d) AS sigma FROM walks GROUP BY 1, 2)"""
BETWEEN_SQL = """
raw_between AS (SELECT a.t AS node, sum(a.sigma * b.sigma / c.sigma) AS b FROM dist a JOIN dist b ON b.s = a.t
  JOIN dist c ON c.s = a.s AND c.t = b.t AND c.d = a.d + b.d WHERE a.s <> a.t AND b.t <> a.t AND a.s <> b.t GROUP BY 1),
nn AS (SELECT count(*) AS n FROM vertices),
between_t AS (SELECT node, coalesce(b, 0) / ((n - 1) * (n - 2)) AS betweenness FROM vertices LEFT JOIN raw_between USING (node), nn)"""
CLOSE_SQL = """
close_t AS (SELECT v.node, CASE WHEN sum(d) > 0 THEN count(d) / sum(d) * count(d) / (max(n) - 1) ELSE 0 END AS closeness
  FROM vertices v LEFT JOIN (SELECT * FROM dist WHERE s <> t) x ON x.t = v.node, nn GROUP BY 1)"""
PAGERANK_SQL = """
outdeg AS (SELECT src, count(*) AS k FROM peer_edges GROUP BY 1),
r0 AS (SELECT node, 1.0::DOUBLE / (SELECT n FROM nn) AS rank FROM vertices),
""" + ",\n".join(f"""r{i} AS (SELECT v.node, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) +
  (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE node NOT IN (SELECT src FROM outdeg)) / n) AS rank
  FROM vertices v LEFT JOIN (SELECT dst, sum(rank / k) AS got FROM peer_edges JOIN outdeg USING (src)
    JOIN r{i - 1} ON r{i - 1}.node = src GROUP BY 1) g ON g.dst = v.node, nn)""" for i in range(1, 31))
BASE = (PEER_EDGES_SQL, NODES_SQL, WALKS_SQL)

REPORTS.add(
    "weak_components", lambda s, d: pt.weak_components(EDGES(s, d)),
    with_tables(PEER_EDGES_SQL, NODES_SQL, """
sym AS (SELECT src AS a, dst AS b FROM peer_edges UNION SELECT dst, src FROM peer_edges),
reach AS (SELECT node AS a, node AS b FROM vertices UNION SELECT r.a, s.b FROM reach r JOIN sym s ON s.a = r.b)""",
                select="SELECT a AS node, min(b) AS component FROM reach GROUP BY 1", recursive=True),
)


def window_links(s, d):
    return pr.short_capture(s, d).select("window_index", F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"))


REPORTS.add(
    "window_component_counts",
    lambda s, d: pt.component_counts(pt.weak_components(window_links(s, d), ["window_index"]), ["window_index"]),
    with_tables(*pr.BASE, pr.SHORT_SQL, f"""
links AS (SELECT DISTINCT window_index AS w, src_ip AS a, dst_ip AS b FROM {gr.SPARSE}),
sym AS (SELECT w, a, b FROM links UNION SELECT w, b, a FROM links),
reach AS (SELECT w, a, a AS b FROM sym UNION SELECT r.w, r.a, s.b FROM reach r JOIN sym s ON s.w = r.w AND s.a = r.b),
least_of AS (SELECT w, a, min(b) AS c FROM reach GROUP BY 1, 2)""",
                select="SELECT w AS window_index, count(DISTINCT c) AS component_count FROM least_of GROUP BY 1", recursive=True),
)
REPORTS.add(
    "pagerank", lambda s, d: pt.pagerank(EDGES(s, d), tolerance=1e-10, max_rounds=60),
    with_tables(PEER_EDGES_SQL, NODES_SQL, "nn AS (SELECT count(*) AS n FROM vertices)", PAGERANK_SQL,
                select="SELECT node, rank AS pagerank FROM r30"), doubles=["pagerank"],
)
REPORTS.add("betweenness", lambda s, d: pt.betweenness(EDGES(s, d)),
            with_tables(*BASE, BETWEEN_SQL, select="SELECT * FROM between_t"), doubles=["betweenness"])
REPORTS.add("closeness", lambda s, d: pt.closeness(EDGES(s, d)),
            with_tables(*BASE, "nn AS (SELECT count(*) AS n FROM vertices)", CLOSE_SQL, select="SELECT * FROM close_t"),
            doubles=["closeness"])
SAMPLED_SQL = """
sample AS (SELECT node FROM vertices ORDER BY md5('7:' || node), node LIMIT 64),
raw_between AS (SELECT a.t AS node, sum(a.sigma * b.sigma / c.sigma) AS b FROM dist a JOIN dist b ON b.s = a.t
  JOIN dist c ON c.s = a.s AND c.t = b.t AND c.d = a.d + b.d WHERE a.s IN (SELECT node FROM sample) AND a.s <> a.t AND b.t <> a.t
  AND a.s <> b.t GROUP BY 1),
met AS (SELECT t AS node, count(*) AS r, sum(d) AS h FROM dist WHERE s IN (SELECT node FROM sample) AND s <> t GROUP BY 1),
nn AS (SELECT count(*) AS n, least(64, count(*)) AS k FROM vertices)"""
REPORTS.add(
    "sampled_centralities", lambda s, d: pt.sampled_centralities(EDGES(s, d), sample=64),
    with_tables(*BASE, SAMPLED_SQL, select="""SELECT node, coalesce(b, 0) * n / k / ((n - 1) * (n - 2)) AS betweenness,
  coalesce(r / h * (r * n / k / (n - 1)), 0) AS closeness,
  CASE WHEN k < n THEN n / (n - 1) * sqrt(ln(2 * n / 0.05) / (2 * k)) ELSE 0 END AS error_bound
  FROM vertices LEFT JOIN raw_between USING (node) LEFT JOIN met USING (node), nn"""),
    doubles=["betweenness", "closeness", "error_bound"],
)
PATHS_SQL = "p0 AS (SELECT s AS attacker, s AS node, [s] AS path FROM dist WHERE s = t AND s IN (3, 14, 27)),\n" + ",\n".join(
    f"""p{i} AS (SELECT attacker, dst AS node, list_append(min(path), dst) AS path FROM p{i - 1} JOIN peer_edges ON src = node
  JOIN dist ON s = attacker AND t = dst AND d = {i} GROUP BY attacker, dst)""" for i in range(1, DEPTH + 1)) + ",\npaths AS (" + " UNION ALL ".join(
    f"SELECT * FROM p{i}" for i in range(DEPTH + 1)) + ")"
REPORTS.add(
    "shortest_paths",
    lambda s, d: pt.shortest_paths(EDGES(s, d), ATTACKERS, TARGET).withColumn(
        "path", F.array_join(F.transform("path", lambda v: v.cast("string")), ">")),
    with_tables(*BASE, PATHS_SQL, select="""SELECT attacker, array_to_string(path, '>') AS path, len(path) - 1 AS hops FROM paths
  WHERE node = 42"""),
)
CONTACT_SQL = """
contact AS (SELECT dst AS node, count(DISTINCT src) / 3 AS attacker_connectivity FROM peer_edges WHERE src IN (3, 14, 27) GROUP BY 1)"""
REPORTS.add("attacker_connectivity", lambda s, d: pt.attacker_connectivity(EDGES(s, d), ATTACKERS),
            with_tables(PEER_EDGES_SQL, CONTACT_SQL, select="SELECT * FROM contact"), doubles=["attacker_connectivity"])
VICTIMS_SQL = """
scored AS (SELECT node, degree_centrality, betweenness, coalesce(risk, 0) AS risk, coalesce(attacker_connectivity, 0) AS contact,
  0.35 * degree_centrality + 0.25 * betweenness + 0.25 * coalesce(risk, 0) + 0.15 * coalesce(attacker_connectivity, 0) AS score
  FROM (SELECT node, total_degree / ((SELECT n FROM nn) - 1) AS degree_centrality FROM degree) JOIN between_t USING (node)
  LEFT JOIN risk USING (node) LEFT JOIN contact USING (node) WHERE node NOT IN (3, 14, 27))"""
VICTIM_TEXT = "CASE WHEN {c} THEN '{t};' ELSE '' END"
VICTIM_REASON_SQL = " || ".join(VICTIM_TEXT.format(c=f"{c} >= {v}", t=t) for c, v, t in pt.VICTIM_REASONS) + " || " + (
    VICTIM_TEXT.format(c="contact > 0", t=pt.VICTIM_CONTACT))


def victims(s, d):
    return pt.rank_victims(EDGES(s, d), ATTACKERS, risk(s, d))


REPORTS.add(
    "victim_ranking", lambda s, d: victims(s, d).withColumn("reasons", F.array_join("reasons", ";")),
    with_tables(*BASE, BETWEEN_SQL, RISK_SQL, CONTACT_SQL, gr.DEGREE_SQL, VICTIMS_SQL, select=f"""SELECT node, round(score, 4)
  AS risk_score, round(score / (SELECT max(score) FROM scored), 4) AS probability, round(degree_centrality, 4) AS degree_centrality,
  round(betweenness, 4) AS betweenness_centrality, CASE WHEN r = '' THEN '{pt.VICTIM_DEFAULT}' ELSE rtrim(r, ';') END AS reasons
  FROM (SELECT *, {VICTIM_REASON_SQL} AS r FROM scored) ORDER BY score DESC, node LIMIT 5"""),
)
REPORTS.add(
    "victim_outcome",
    lambda s, d: pt.victim_outcome(EDGES(s, d), victims(s, d)).drop("reasons"),
    with_tables(*BASE, BETWEEN_SQL, RISK_SQL, CONTACT_SQL, gr.DEGREE_SQL, VICTIMS_SQL,
                select="SELECT node AS victim, 1::DOUBLE AS probability FROM scored ORDER BY score DESC, node LIMIT 1"),
)
IMPORTANCE_SQL = """
imp AS (SELECT node, 0.25 * degree_centrality + 0.25 * betweenness + 0.15 * closeness + 0.15 * rank + 0.15 * coalesce(risk, 0)
    + 0.05 * coalesce(attacker_connectivity, 0) AS importance
  FROM (SELECT node, total_degree / ((SELECT n FROM nn) - 1) AS degree_centrality FROM degree) JOIN between_t USING (node)
  JOIN close_t USING (node) JOIN r30 USING (node) LEFT JOIN risk USING (node) LEFT JOIN contact USING (node))"""


def measured(s, d):
    ranks = pt.pagerank(EDGES(s, d), tolerance=1e-10, max_rounds=60)
    return pt.node_metrics(EDGES(s, d), ATTACKERS, risk(s, d), ranks)


REPORTS.add(
    "node_importance",
    lambda s, d: pt.rank_nodes(measured(s, d), ATTACKERS, TARGET).select(
        "node", "importance", "relative_importance", "is_attacker", "is_target"),
    with_tables(*BASE, BETWEEN_SQL, CLOSE_SQL, PAGERANK_SQL, RISK_SQL, CONTACT_SQL, gr.DEGREE_SQL, IMPORTANCE_SQL,
                select="""SELECT node, importance, importance / (SELECT max(importance) FROM imp) AS relative_importance,
  node IN (3, 14, 27) AS is_attacker, node = 42 AS is_target FROM imp ORDER BY importance DESC, node LIMIT 10"""),
    doubles=["importance", "relative_importance"],
)
REPORTS.add(
    "edge_importance", lambda s, d: pt.rank_edges(EDGES(s, d), ATTACKERS, risk(s, d), TARGET),
    with_tables(PEER_EDGES_SQL, RISK_SQL, """
graded AS (SELECT src, dst, CAST(weight AS DOUBLE) AS weight, (coalesce(a.risk, 0) + coalesce(b.risk, 0)) / 2 AS risk,
  src IN (3, 14, 27) OR dst IN (3, 14, 27) AS connected_to_attacker, src = 42 OR dst = 42 AS connected_to_target
  FROM peer_edges LEFT JOIN risk a ON a.node = src LEFT JOIN risk b ON b.node = dst)""", select="""SELECT *,
  0.4 * weight / (weight + 1) + 0.3 * risk + CASE WHEN connected_to_attacker THEN 0.2 ELSE 0 END
  + CASE WHEN connected_to_target THEN 0.1 ELSE 0 END AS importance FROM graded ORDER BY importance DESC, src, dst LIMIT 10"""),
    doubles=["risk", "importance"],
)
REPORTS.add(
    "target_reasons",
    lambda s, d: pt.target_reasons(measured(s, d), TARGET, pt.shortest_paths(EDGES(s, d), ATTACKERS, TARGET)).select(
        F.size("reasons").alias("reasons"), F.array_contains("reasons", pt.TARGET_PATH).alias("has_path")),
    with_tables(*BASE, BETWEEN_SQL, CLOSE_SQL, RISK_SQL, CONTACT_SQL, gr.DEGREE_SQL, """
t AS (SELECT CAST(total_degree / ((SELECT n FROM nn) - 1) >= 0.3 AS INT) + CAST(betweenness >= 0.1 AS INT)
  + CAST(closeness >= 0.3 AS INT) + CAST(coalesce(risk, 0) >= 0.5 AS INT) + CAST(coalesce(attacker_connectivity, 0) > 0 AS INT) AS k
  FROM degree JOIN between_t USING (node) JOIN close_t USING (node) LEFT JOIN risk USING (node) LEFT JOIN contact USING (node)
  WHERE node = 42),
has AS (SELECT count(*) > 0 AS p FROM dist WHERE s IN (3, 14, 27) AND t = 42)""",
                select="SELECT greatest(1, k + CAST(p AS INT)) AS reasons, p AS has_path FROM t, has"),
)
REPORTS.add(
    "graph_summary",
    lambda s, d: pt.graph_summary(EDGES(s, d), risk(s, d)),
    with_tables(PEER_EDGES_SQL, NODES_SQL, RISK_SQL, """
sym AS (SELECT src AS a, dst AS b FROM peer_edges UNION SELECT dst, src FROM peer_edges),
reach AS (SELECT node AS a, node AS b FROM vertices UNION SELECT r.a, s.b FROM reach r JOIN sym s ON s.a = r.b),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)""", select="""SELECT (SELECT count(*) FROM peer_edges) AS edges,
  count(*) AS nodes, count(DISTINCT m) AS connected_components,
  (SELECT count(*) FROM peer_edges) / (count(*) * (count(*) - 1)) AS density,
  (SELECT count(*) FROM risk WHERE raw_risk >= 0.5) AS high_risk_nodes FROM c""", recursive=True), doubles=["density"],
)
