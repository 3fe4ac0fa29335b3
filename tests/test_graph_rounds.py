"""Hub-safe rounds, folded leaves and sampled centralities against brute force."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import layout
from packetloom.operators import paths as pt


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def hub_graph(seed=5):
    """A hub with a third of all edges, leaves of every kind, chains, pairs that only have each other, and a self loop."""
    rng = random.Random(seed)
    pairs = {(0, j) for j in range(1, 40)} | {(j, 0) for j in range(30, 60)}
    pairs |= {(a, b) for a, b in ((rng.randrange(1, 20), rng.randrange(1, 20)) for _ in range(40)) if a != b}
    pairs |= {(100 + j, 3) for j in range(6)} | {(3, 100), (3, 101)} | {(110 + j, 111 + j) for j in range(2)} | {(112, 0)}
    pairs |= {(200, 201), (201, 200), (210, 211), (220, 220), (7, 7), (230, 231), (232, 231)}
    return sorted(pairs)


def brute(pairs):
    nodes = sorted({n for p in pairs for n in p})
    out = collections.defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    table = {}
    for s in nodes:
        dist, sigma, order = {s: 0}, {s: 1}, [s]
        for u in order:
            for v in out[u]:
                if v not in dist:
                    dist[v], sigma[v] = dist[u] + 1, 0
                    order.append(v)
                if dist[v] == dist[u] + 1:
                    sigma[v] += sigma[u]
        table[s] = (dist, sigma)
    return nodes, table


def wanted(nodes, table, sources):
    n, between, close = len(nodes), dict.fromkeys(nodes, 0.0), {}
    for s in sources:
        dist, sigma = table[s]
        for v in dist:
            for t, far in table[v][0].items():
                if len({s, v, t}) == 3 and dist[t] == dist[v] + far:
                    between[v] += sigma[v] * table[v][1][t] / sigma[t]
    for v in nodes:
        inward = [table[s][0][v] for s in sources if s != v and v in table[s][0]]
        close[v] = len(inward) / sum(inward) * (len(inward) * n / len(sources)) / (n - 1) if inward else 0.0
    return {v: b * n / len(sources) / ((n - 1) * (n - 2)) for v, b in between.items()}, close


def test_centralities_with_leaves_and_hubs(spark):
    pairs = hub_graph()
    nodes, table = brute(pairs)
    between, close = wanted(nodes, table, nodes)
    got = pt.path_centralities(edges_of(spark, pairs), batches=2, piece=10).collect()
    assert sorted(r["node"] for r in got) == nodes
    for r in got:
        assert r["betweenness"] == pytest.approx(between[r["node"]])
        assert r["closeness"] == pytest.approx(close[r["node"]])


def test_leaves_are_no_sources(spark):
    links = pt._simple(edges_of(spark, hub_graph()))
    sources, leaves = pt.folded_leaves(links)
    folded = {r["node"]: (r["neighbour"], r["back"]) for r in leaves.collect()}
    assert folded[100] == (3, 1) and folded[105] == (3, 0) and folded[50] == (0, 0) and folded[110] == (111, 0)
    assert not {200, 201, 0, 3} & folded.keys()
    held = {r["source"]: (r["leaves"], r["back"]) for r in sources.collect()}
    assert held[3] == (6, 2) and held[231] == (2, 0) and not folded.keys() & held.keys() and 211 not in held


def test_sampled_centralities(spark):
    pairs = hub_graph(9)
    nodes, table = brute(pairs)
    edges = edges_of(spark, pairs)
    drawn = [r["source"] for r in pt.sample_sources(edges, 25).collect()]
    assert len(set(drawn)) == 25 and drawn == [r["source"] for r in pt.sample_sources(edges.repartition(7), 25).collect()]
    exact, _ = wanted(nodes, table, nodes)
    between, close = wanted(nodes, table, drawn)
    n = len(nodes)
    for r in pt.sampled_centralities(edges, 25).collect():
        assert r["betweenness"] == pytest.approx(between[r["node"]]) and r["closeness"] == pytest.approx(close[r["node"]])
        assert r["error_bound"] == pytest.approx(n / (n - 1) * math.sqrt(math.log(2 * n / 0.05) / 50))
        assert abs(r["betweenness"] - exact[r["node"]]) <= r["error_bound"]


def test_hub_edges_are_dealt_over_tasks(spark):
    hub = spark.range(1, 20_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    rest = spark.range(40_000).select((F.col("id") % 5_000 + 1).alias("src"), (F.col("id") * 7 % 20_001).alias("dst"))
    links = hub.unionByName(rest).distinct()
    table, hubs = layout.dealt_links(links, "src", "dst", 200)
    sizes = [r["count"] for r in table.rows().groupBy(F.input_file_name().alias("f")).count().collect()]
    assert sum(sizes) == links.count() and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
    copies = hubs.copy(spark.range(3).withColumnRenamed("id", "src"), "src").groupBy("src").count().collect()
    assert {r["src"]: r["count"] for r in copies} == {0: 100, 1: 1, 2: 1}
    table.drop()


def test_rounds_with_a_hub_agree_with_plain_ones(spark):
    pairs = hub_graph(3) + [(500, k) for k in range(600, 700)]
    edges = edges_of(spark, pairs)
    for run, column in ((pt.pagerank, "pagerank"), (pt.weak_components, "component")):
        plain = {r["node"]: r[column] for r in run(edges).collect()}
        dealt = {r["node"]: r[column] for r in run(edges, piece=4).collect()}
        assert dealt == pytest.approx(plain, abs=1e-9)
    routes = [{r["attacker"]: r["path"] for r in pt.shortest_paths(edges, [12, 111, 600], 39, piece).collect()} for piece in (3, layout.PIECE)]
    assert routes[0] == routes[1] and routes[0][111] == [111, 112, 0, 39] and 600 not in routes[0]


def test_tables_of_rounds_are_removed_and_a_whole_sample_is_exact(spark):
    before = set(spark.catalog.listTables())
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4)]
    nodes, table = brute(pairs)
    exact, _ = wanted(nodes, table, nodes)
    for r in pt.sampled_centralities(edges_of(spark, pairs), 10).collect():
        assert r["betweenness"] == pytest.approx(exact[r["node"]]) and r["error_bound"] == 0.0
    assert set(spark.catalog.listTables()) == before


def test_empty_graph(spark):
    none = edges_of(spark, [])
    assert pt.path_centralities(none).collect() == [] == pt.sampled_centralities(none).collect()
    assert pt.pagerank(none).collect() == [] == pt.weak_components(none).collect()


def estimated(rows):
    return int(str(rows._jdf.queryExecution().analyzed().stats().sizeInBytes()))


def test_estimates_of_rounds_do_not_multiply(spark, monkeypatch):
    seen = []
    keep = pt.Rounds.keep
    monkeypatch.setattr(pt.Rounds, "keep", lambda self, rows: seen.append(keep(self, rows)) or seen[-1])
    chain = spark.range(12).selectExpr("id % 3 AS w", "id AS src", "id + 3 AS dst")
    parts = pt.component_counts(pt.weak_components(chain, ["w"]), ["w"])
    assert {r["w"]: r["component_count"] for r in parts.collect()} == {0: 1, 1: 1, 2: 1}
    assert len(seen) > 2 and estimated(seen[-1]) < 1e6
    rounds = len(seen)
    assert pt.pagerank(edges_of(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])).count() == 4
    assert len(seen) > rounds + 3 and estimated(seen[-1]) < 1e6


def test_estimates_of_near_copy_rounds_do_not_multiply(spark, monkeypatch):
    common = pytest.importorskip("packetloom.llm.common")
    seen = []
    keep = common.Rounds.keep
    monkeypatch.setattr(common.Rounds, "keep", lambda self, rows: seen.append(keep(self, rows)) or seen[-1])
    got = common.components(spark.range(8).selectExpr("id AS src", "id + 1 AS dst")).collect()
    assert {r["node"]: r["component"] for r in got} == dict.fromkeys(range(9), 0) and len(got) == 9
    assert len(seen) > 2 and estimated(seen[-1]) < 1e6
