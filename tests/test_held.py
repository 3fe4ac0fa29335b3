"""Searches by tasks that hold the whole graph, against brute force and against tiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_graph_rounds import brute, edges_of, hub_graph, wanted

from packetloom.operators import held
from packetloom.operators import paths as pt


def graphs():
    rng = random.Random(3)
    hub = [(0, j) for j in range(1, 90)] + [(j, 0) for j in range(60, 150)]
    dense = [(a, b) for a in range(300, 380) for b in range(300, 380) if a != b]
    loose = sorted({(rng.randrange(200), rng.randrange(200)) for _ in range(700)})
    return {"hubs": hub_graph(), "hub and dense part": hub + dense + loose + [(310, 5), (7, 320)], "chain": [(k, k + 1) for k in range(200)]}


@pytest.mark.parametrize("name", graphs())
@pytest.mark.parametrize("sparse", [0, 3, 10 ** 9])
def test_searches_of_a_held_graph(name, sparse, monkeypatch):
    monkeypatch.setattr(held, "_SPARSE", sparse)
    monkeypatch.setattr(held, "_GATHERED", 50)
    monkeypatch.setattr(held, "BATCH", 2)
    pairs = sorted({p for p in graphs()[name] if p[0] != p[1]})
    nodes, table = brute(pairs)
    at = {v: k for k, v in enumerate(nodes)}
    src, dst = (np.array([at[p[k]] for p in pairs], np.int64) for k in (0, 1))
    begin = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(nodes)))])
    leaves = np.arange(len(nodes)) % 3
    for kind in (held.Paths, held.Distances):
        search = kind(begin, dst.astype(np.int32))
        for first in range(0, len(nodes), 60):
            some = np.arange(first, min(len(nodes), first + 60))
            search.search(some, leaves[some])
        reach = {v: sum((s != v) + leaves[at[s]] for s in nodes if v in table[s][0]) for v in nodes}
        hops = {v: sum(table[s][0][v] + leaves[at[s]] * (table[s][0][v] + 1) for s in nodes if v in table[s][0]) for v in nodes}
        assert search.reach.tolist() == [reach[v] for v in nodes] and search.hops.tolist() == [hops[v] for v in nodes]
    search = held.Paths(begin, dst.astype(np.int32))
    for first in range(0, len(nodes), 60):
        search.search(np.arange(first, min(len(nodes), first + 60)), np.zeros(min(60, len(nodes) - first), np.int64))
    n = len(nodes)
    between, _ = wanted(nodes, table, nodes)
    assert search.delta / ((n - 1) * (n - 2)) == pytest.approx([between[v] for v in nodes])
    assert search.reached.tolist() == [len(table[v][0]) - 1 for v in nodes]


def test_a_held_graph_tells_what_tiles_tell(spark, monkeypatch):
    pairs = hub_graph(4) + [(None, 3), (4, None)]
    tiled = {r["node"]: r for r in pt.path_centralities(edges_of(spark, pairs), batches=1).collect()}

    def refused(*_):
        raise AssertionError("a graph of this size needs no tiles")

    monkeypatch.setattr(pt, "_search", refused)
    rows = pt.path_centralities(edges_of(spark, pairs)).collect()
    close = {r["node"]: r["closeness"] for r in pt.closeness(edges_of(spark, pairs)).collect()}
    assert {r["node"] for r in rows} == tiled.keys() == close.keys()
    for r in rows:
        assert r["betweenness"] == pytest.approx(tiled[r["node"]]["betweenness"])
        assert r["closeness"] == pytest.approx(tiled[r["node"]]["closeness"]) == pytest.approx(close[r["node"]])


def test_names_may_be_texts_and_larger_graphs_take_tiles(spark, monkeypatch):
    pairs = hub_graph(6)
    edges = edges_of(spark, pairs).select(*[F.concat(F.lit("h"), F.col(c).cast("string")).alias(c) for c in ("src", "dst")])
    held_rows = {r["node"]: r["betweenness"] for r in pt.betweenness(edges).collect()}
    monkeypatch.setattr(held, "HELD_LINKS", len(pairs) // 2)
    monkeypatch.setattr(held, "accumulated", None)
    assert {r["node"]: r["betweenness"] for r in pt.betweenness(edges).collect()} == pytest.approx(held_rows)


def test_closeness_counts_no_paths(spark, monkeypatch):
    monkeypatch.setattr(held, "Paths", None)
    edges = edges_of(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    assert {r["node"]: r["closeness"] for r in pt.closeness(edges).collect()} == pytest.approx({1: 4 / 9, 2: 4 / 9, 3: 4 / 9, 4: 0.5})
