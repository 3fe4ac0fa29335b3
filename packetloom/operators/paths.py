"""Iterative graph analytics as joins over edge tables.

Each round is a join with links that lie bucketed in the shared folder, plus a partial aggregation;
rounds end in a written table, so a lost executor costs one round and the plan stays short. Hubs are
dealt over salts (see ``layout``). No graph or neighbour list is ever gathered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.numeric import clamp
from packetloom.operators import held
from packetloom.operators.graph import degree_centrality
from packetloom.operators.layout import PIECE, SALT, Bucketed, Hubs, dealt_links, piece_size
from packetloom.operators.ordered import beside
from packetloom.operators.tiles import TILE, WIDE, carried_back, first_states, link_tiles, met, node_sums, opened, sent
from packetloom.session import Rounds, cut_lineage


def graph_nodes(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All endpoints, once each."""
    return edges.select(*keys, F.explode(F.array("src", "dst")).alias("node")).distinct()


def weak_components(edges: DataFrame, keys: Sequence[str] = (), piece: int = PIECE) -> DataFrame:
    """G7. (keys, node, component): the smallest node reachable when direction is ignored.

    Alternating large-star and small-star rounds: every node links its larger neighbours, then its
    smaller ones, to the least of them, which takes logarithmically many rounds instead of one per
    hop. Stops when a round changes nothing. A node with more than ``piece`` links has them dealt over
    salts in each round, with its least neighbour copied to those.
    """
    keys = list(keys)

    def linked_to_least(links, keep):
        """Links (u, v) that ``keep`` holds for, with the least neighbour m of u over all links."""
        counted = cut_lineage(links.groupBy(*keys, "u").agg(F.min("v").alias("m"), F.count("*").alias("n"))).withColumn(
            "m", F.least("u", "m")).withColumn("__u", F.struct(*keys, "u"))
        hubs = Hubs(counted, "__u", piece)
        many = hubs.deal(links.filter(keep).withColumn("__u", F.struct(*keys, "u")), F.col("v"))
        return many.join(hubs.copy(counted, "__u").select("__u", SALT, "m"), ["__u", SALT]).drop("__u", SALT), counted

    links = edges.filter(F.col("src") != F.col("dst")).select(
        *keys, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    rounds, mark = Rounds(edges.sparkSession), None
    links = rounds.keep(links)
    piece = piece_size(2 * links.count(), piece)
    while True:
        both = links.unionByName(links.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut_lineage(linked_to_least(both, F.col("v") > F.col("u"))[0].select(
            *keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        met, least = linked_to_least(large, F.lit(True))
        small = met.filter(F.col("v") != F.col("m")).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        links = rounds.keep(small.unionByName(least.select(*keys, "u", F.col("m").alias("v"))).distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    nodes = graph_nodes(edges, keys)
    labels = links.select(*keys, F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(labels, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def component_counts(components: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return components.groupBy(*keys).agg(F.count_distinct("component").alias("component_count"))


def pagerank(edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, max_rounds: int = 100, piece: int = PIECE) -> DataFrame:
    """G5. Rank with dangling mass spread evenly; stops when the total change is below n * tolerance and raises if ``max_rounds`` do not reach it.

    The edges are bucketed by source and salt once and read in place in all rounds: a hub's edges lie in
    several buckets, to which only the hub's rank is copied. A round hands three sums to the driver:
    total change, dangling mass and node count.
    """
    links = cut_lineage(edges.select("src", "dst").distinct())
    table, hubs = dealt_links(links, "src", "dst", piece_size(links.count(), piece))
    out = links.groupBy("src").agg(F.count("*").alias("out_degree"))
    nodes = cut_lineage(graph_nodes(links).join(out.withColumnRenamed("src", "node"), "node", "left"))
    n = nodes.count()
    rounds, ranks = Rounds(edges.sparkSession), nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    dangling = F.sum(F.when(F.col("out_degree").isNull(), F.col("rank")).otherwise(0.0))
    lost = ranks.agg(dangling).first()[0] or 0.0
    for _ in range(max_rounds if n else 0):
        given = hubs.copy(ranks.filter("out_degree > 0").select(F.col("node").alias("src"), (F.col("rank") / F.col("out_degree")).alias("given")), "src")
        received = table.rows().join(given, ["src", SALT]).groupBy(F.col("dst").alias("node")).agg(F.sum("given").alias("received"))
        base = (1 - alpha) / n + alpha * lost / n
        settled = rounds.keep(ranks.withColumnRenamed("rank", "before").join(received, "node", "left").select(
            "node", "out_degree", "before", (F.lit(base) + alpha * F.coalesce("received", F.lit(0.0))).alias("rank")))
        change, lost = settled.agg(F.sum(F.abs(F.col("rank") - F.col("before"))), dangling).first()
        ranks = settled.drop("before")
        if change < n * tolerance:
            break
    else:
        if n:
            raise ValueError(f"the ranks have not settled in {max_rounds} rounds")
    table.drop()
    return ranks.select("node", F.col("rank").alias("pagerank"))


STATE_CELLS = 1_000_000_000


def folded_leaves(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources whose searches tell all, and the leaves folded onto them.

    A leaf has one neighbour and an edge to it. Its paths are those of the neighbour with one hop
    more, so the neighbour's search counts for it too. First table: (source, leaves, back), back
    the leaves with an edge from the neighbour as well; nodes without out-edges only serve as
    neighbours. Second: (node, neighbour, back). Of two nodes that only have each other none is folded.
    """
    ends = links.select(F.col("src").alias("node"), F.col("dst").alias("peer"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        links.select(F.col("dst").alias("node"), F.col("src").alias("peer"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = cut_lineage(ends.groupBy("node").agg(F.min("peer").alias("low"), F.max("peer").alias("high"), F.max("out").alias("out"),
                                                F.max("into").alias("into")))
    single = seen.filter(F.col("low") == F.col("high"))
    leaves = cut_lineage(single.filter("out = 1").join(single.select(F.col("node").alias("low")), "low", "left_anti").select(
        "node", F.col("low").alias("neighbour"), F.col("into").alias("back")))
    held = leaves.groupBy(F.col("neighbour").alias("source")).agg(F.count("*").alias("leaves"), F.sum("back").alias("back"))
    rest = seen.join(leaves.select("node"), "node", "left_anti").select(F.col("node").alias("source"), "out")
    sources = rest.join(held, "source", "left").na.fill(0, ["leaves", "back"]).filter("out = 1 or leaves > 0").drop("out")
    return sources, leaves


def _in_blocks(rows: DataFrame, key: str, count: int, width: int, block: str, place: str) -> DataFrame:
    """Rows with a block of at most ``width`` and a place within it; numbered in groups of about 16 blocks."""
    groups = max(1, -(-count // (16 * width)))
    place_in_group = F.row_number().over(Window.partitionBy("__group").orderBy(key)) - 1
    return cut_lineage(rows.withColumn("__group", F.pmod(F.xxhash64(key), F.lit(groups)).cast("long")).withColumn("__at", place_in_group).select(
        *rows.columns, (F.col("__group") * (1 << 20) + F.floor(F.col("__at") / width)).alias(block),
        (F.col("__at") % width).cast("int").alias(place)))


def _search(tiles: DataFrame, placed: DataFrame, parts: DataFrame) -> tuple[Bucketed, int]:
    """Levels of breadth-first searches, and the last level's number.

    A row holds, for one block of sources and one part of the nodes, how many shortest paths lead to each
    node from each source that first reaches it in this round. All rounds are one table bucketed by
    block and part: looking up what was reached before moves no visited row. Nothing is sent to
    parts that all sources of the block have reached whole.
    """
    found = Bucketed(placed.sparkSession, ["block", "part"])
    found.append(first_states(placed))
    slots = placed.groupBy("block").agg(F.count("*").alias("slots"))
    ways = tiles.drop("codes")
    for depth in count(1):
        frontier = found.rows(depth - 1)
        whole = found.rows().groupBy("block", "part").agg(F.sum("cells").alias("cells")).join(slots, "block").join(parts, "part").filter(
            F.col("cells") == F.col("slots") * F.col("size")).select("block", F.col("part").alias("into"))
        routes = cut_lineage(frontier.select("block", "part").join(ways, "part").join(whole, ["block", "into"], "left_anti"))
        received = sent(frontier.drop("cells", "nodes"), tiles, routes, lambda row: opened(row["mask"], row["value"]))
        found.append(met(received, found.rows()), depth, dealt=True)
        if found.rows(depth).isEmpty():
            return found, depth - 1


def _dependencies(tiles: DataFrame, found: Bucketed, last: int, nodes: DataFrame) -> DataFrame:
    """(node, delta, reach, hops) over all sources of a search; ``nodes`` (node, part, at) tells where a node's sums lie."""

    def share(row: dict) -> np.ndarray:
        tile = opened(row["mask"], row["value"])
        gain = 1.0 + opened(row["back_mask"], row["back"]) if row["back_mask"] is not None else 1.0
        return np.divide(gain, tile, out=np.zeros_like(tile), where=tile != 0)

    spark, ways = found.spark, tiles.drop("codes")
    carried = Bucketed(spark, ["block", "part"])
    carried.append(spark.createDataFrame([], "block long, part long, back_mask binary, back binary"))
    for depth in range(last, 1, -1):
        here = found.rows(depth).drop("cells", "nodes").join(carried.rows(depth), ["block", "part"], "left")
        level = found.rows(depth - 1)
        routes = cut_lineage(found.rows(depth).select("block", "part").join(ways, "part").join(
            level.select("block", F.col("part").alias("into")), ["block", "into"], "left_semi"))
        carried.append(carried_back(sent(here, tiles, routes, share), level), depth - 1, dealt=True)
    sums = node_sums(found.numbered(), carried.rows()).groupBy("part", "at").agg(*[F.sum(c).alias(c) for c in ("delta", "reach", "hops")])
    total = cut_lineage(sums.join(nodes, ["part", "at"]).select("node", "delta", "reach", "hops"))
    carried.drop()
    return total


def _summed(parts: list[DataFrame]) -> DataFrame:
    return cut_lineage(reduce(DataFrame.unionByName, parts).groupBy("node").agg(*[F.sum(c).alias(c) for c in ("delta", "reach", "hops")]))


def _accumulated(links: DataFrame, sources: DataFrame, batches: int | None, paths: bool = True) -> tuple[DataFrame, DataFrame]:
    """Sums (node, delta, reach, hops) over all sources, and (source, leaves, back, reached); delta and reached only with ``paths``.

    A graph that a task can hold is searched by tasks for themselves (see ``held``). In a larger one the sources are cut into
    as many runs as keep sources x nodes below STATE_CELLS, or into ``batches``, which takes this way for any graph.
    """
    ends = cut_lineage(graph_nodes(links))
    n = ends.count()
    if batches is None and n <= held.HELD_NODES and links.count() <= held.HELD_LINKS:
        return held.accumulated(links, sources, ends, paths)
    nodes = _in_blocks(ends, "node", n, TILE, "part", "at")
    sizes = cut_lineage(nodes.groupBy("part").agg(F.count("*").alias("size")))
    lying = links
    for end in ("src", "dst"):
        lying = lying.join(nodes.select(F.col("node").alias(end), F.col("part").alias(f"{end}_part"), F.col("at").alias(f"{end}_at")), end)
    lying, parts = cut_lineage(lying.drop("src", "dst")), sizes.count()
    onward, inward = (link_tiles(lying, *way, parts) for way in (("src", "dst"), ("dst", "src")))
    sources = cut_lineage(sources.join(nodes.withColumnRenamed("node", "source"), "source"))
    size = sources.count()
    if batches is None:
        batches = max(1, -(-size * n // STATE_CELLS))
    placed = _in_blocks(sources, "source", size, WIDE, "block", "slot")
    leaves = placed.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("slot", "leaves"))).alias("m")).select(
        "block", F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0))).alias("held"))
    placed = cut_lineage(placed.join(leaves, "block"))
    sums, reached = [], []
    for run in range(batches):
        some = placed if batches == 1 else placed.filter(F.pmod(F.xxhash64("block"), F.lit(batches)) == run)
        found, last = _search(onward, some, sizes)
        sums.append(_dependencies(inward, found, last, nodes))
        totals = found.numbered().filter("__round > 0").select("block", F.posexplode("nodes").alias("slot", "n")).groupBy("block", "slot").agg(
            F.sum("n").alias("reached"))
        reached.append(cut_lineage(some.join(totals, ["block", "slot"], "left").select(
            "source", "leaves", "back", F.coalesce("reached", F.lit(0)).alias("reached"))))
        found.drop()
    return _summed(sums), reduce(DataFrame.unionByName, reached)


def _simple(edges: DataFrame) -> DataFrame:
    return cut_lineage(edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct())


def _closeness(reach: Column, hops: Column, reaching: Column, n: int) -> Column:
    """Mean nearness of the sources that reach a node, scaled by their share of all others."""
    return F.coalesce(reach / F.when(hops > 0, hops) * (reaching / F.lit(max(n - 1, 1))), F.lit(0.0))


def path_centralities(edges: DataFrame, batches: int | None = None, piece: int = PIECE, paths: bool = True) -> DataFrame:
    """G3 + G4. Exact normalised betweenness and inward closeness of every node, from one search.

    WIDE sources are searched side by side; leaves are folded onto their neighbour. Tasks hold a graph of up to
    ``held.HELD_LINKS`` links and move nothing but sums (see ``held``). A larger one lies in tiles of nodes and links
    (see ``tiles``), so a hop moves one tile per block and part, not a row per link. A hub's links lie in
    many tiles, so ``piece`` changes nothing here. Dependencies flow back level by level. Closeness is scaled by the
    share of nodes that reach the node. The work grows with sources x edges: on large graphs take
    :func:`sampled_centralities`. ``batches`` takes tiles and fixes the number of runs over the sources, which
    otherwise follows from sources x nodes. Without ``paths`` only closeness is told, which takes distances alone.
    """
    nodes, links = cut_lineage(graph_nodes(edges)), _simple(edges)
    n = nodes.count()
    sources, leaves = folded_leaves(links)
    total, reached = _accumulated(links, sources, batches, paths)
    folded = reached.filter("leaves > 0").select(F.col("source").alias("node"), (F.col("leaves") * F.col("reached") - F.col("back")).cast(
        "double").alias("delta"), F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("hops"))
    own = leaves.filter("back = 1").select("node", F.lit(0.0).alias("delta"), F.lit(-1).cast("long").alias("reach"), F.lit(-2).cast("long").alias("hops"))
    rows = nodes.join(_summed([total, folded, own]), "node", "left")
    share = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    close = _closeness(F.col("reach"), F.col("hops"), F.col("reach"), n).alias("closeness")
    return rows.select("node", (F.coalesce("delta", F.lit(0.0)) * F.lit(share)).alias("betweenness"), close) if paths else rows.select("node", close)


def sample_sources(edges: DataFrame, sample: int, seed: int = 7) -> DataFrame:
    """(source): the ``sample`` nodes with the least digests of seed and node, a draw without replacement that every engine repeats."""
    nodes = graph_nodes(edges).select(F.col("node").alias("source"))
    return nodes.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("source").cast("string"))), "source").limit(sample)


def sampled_centralities(edges: DataFrame, sample: int = 1024, seed: int = 7, chance: float = 0.05, batches: int | None = None,
                         piece: int = PIECE) -> DataFrame:
    """G3 + G4 on large graphs: (node, betweenness, closeness, error_bound) estimated from the searches of sampled sources.

    Betweenness is the mean dependency over the sample. A dependency lies between 0 and n - 2, so by
    Hoeffding's inequality, which holds for draws without replacement, with probability 1 - ``chance``
    no estimate of any node is off by more than ``error_bound`` = n / (n - 1) * sqrt(ln(2 n / chance) / (2 sample)).
    Closeness takes the sampled share of reaching nodes for that of all. A sample of all nodes is exact.
    """
    nodes, links = cut_lineage(graph_nodes(edges)), _simple(edges)
    n = nodes.count()
    drawn = cut_lineage(sample_sources(edges, sample, seed)).withColumns({"leaves": F.lit(0).cast("long"), "back": F.lit(0).cast("long")})
    k = min(sample, n)
    total, _ = _accumulated(links, drawn, batches)
    rows = nodes.join(total, "node", "left")
    share = n / k / ((n - 1) * (n - 2)) if n > 2 else 0.0
    bound = n / (n - 1) * math.sqrt(math.log(2 * n / chance) / (2 * k)) if 1 < k < n else 0.0 if k == n else None
    return rows.select("node", (F.coalesce("delta", F.lit(0.0)) * F.lit(share)).alias("betweenness"),
                       _closeness(F.col("reach"), F.col("hops"), F.col("reach") * F.lit(n / max(k, 1)), n).alias("closeness"),
                       F.lit(bound).cast("double").alias("error_bound"))


def betweenness(edges: DataFrame, batches: int | None = None) -> DataFrame:
    """G3. Exact normalised directed betweenness (unweighted)."""
    return path_centralities(edges, batches).select("node", "betweenness")


def closeness(edges: DataFrame, batches: int | None = None) -> DataFrame:
    """G4. Inward closeness with reachability scaling."""
    return path_centralities(edges, batches, paths=False).select("node", "closeness")


def shortest_paths(edges: DataFrame, attackers: Sequence, target, piece: int = PIECE) -> DataFrame:
    """G10. One shortest path per attacker that reaches the target; ties go to the least node sequence.

    Links of hubs are dealt over salts; the nodes visited are one table bucketed by attacker and node.
    """
    goal = F.lit(target).cast(dict(edges.dtypes)["src"])
    links = cut_lineage(edges.select("src", "dst").distinct())
    table, hubs = dealt_links(links, "src", "dst", piece_size(links.count(), piece))
    visited = Bucketed(edges.sparkSession, ["attacker", "node"])
    level = cut_lineage(graph_nodes(links).filter(F.col("node").isin(*attackers)).select(
        F.col("node").alias("attacker"), "node", F.array("node").alias("path")))
    found = []
    for depth in count():
        visited.append(level.select("attacker", "node"), depth)
        found.append(level.filter(F.col("node") == goal))
        finished = reduce(DataFrame.unionByName, found).select("attacker")
        open_ends = hubs.copy(level.join(finished, "attacker", "left_anti").withColumnRenamed("node", "src"), "src")
        step = open_ends.join(table.rows(), ["src", SALT]).groupBy("attacker", F.col("dst").alias("node")).agg(
            F.min("path").alias("path")).withColumn("path", F.concat("path", F.array("node")))
        level = cut_lineage(step.join(visited.rows(), ["attacker", "node"], "left_anti"))
        if level.isEmpty():
            break
    table.drop()
    visited.drop()
    return reduce(DataFrame.unionByName, found).select("attacker", "path", (F.size("path") - 1).alias("hops"))


def attacker_connectivity(edges: DataFrame, attackers: Sequence) -> DataFrame:
    """G11. Share of the attackers with an edge to the node, for nodes that have one."""
    hits = edges.filter(F.col("src").isin(*attackers)).groupBy(F.col("dst").alias("node")).agg(
        F.count_distinct("src").alias("n"))
    return hits.select("node", F.least(F.col("n") / F.lit(max(len(attackers), 1)), F.lit(1.0)).alias("attacker_connectivity"))


def _risk(risk: DataFrame | None, nodes: DataFrame) -> DataFrame:
    if risk is None:
        return nodes.withColumn("risk", F.lit(0.0))
    return nodes.join(risk.select("node", clamp(F.col("risk")).alias("risk")), "node", "left").na.fill(0.0, ["risk"])


def rank_victims(edges: DataFrame, attackers: Sequence = (), risk: DataFrame | None = None,
                 centrality: DataFrame | None = None, top_k: int = 5) -> DataFrame:
    """G12. Likely next targets by degree, betweenness, risk and attacker contact; attackers excluded.

    ``centrality`` may hold a computed betweenness (node, betweenness).
    """
    between = betweenness(edges) if centrality is None else centrality
    rows = _risk(risk, degree_centrality(edges)).join(between, "node", "left").join(
        attacker_connectivity(edges, attackers), "node", "left").na.fill(0.0, ["betweenness", "attacker_connectivity"])
    if attackers:
        rows = rows.filter(~F.col("node").isin(*attackers))
    scored = rows.withColumn("score", 0.35 * F.col("degree_centrality") + 0.25 * F.col("betweenness")
                             + 0.25 * F.col("risk") + 0.15 * F.col("attacker_connectivity"))
    top = F.col("__top")
    ranked = beside(scored, scored.agg(F.max("score").alias("__top"))).orderBy(F.desc("score"), "node").limit(top_k)
    return ranked.select(
        "node", F.round("score", 4).alias("risk_score"),
        F.round(F.when(top > 0, F.col("score") / F.when(top > 0, top)).otherwise(0.0), 4).alias("probability"),
        F.round("degree_centrality", 4).alias("degree_centrality"),
        F.round("betweenness", 4).alias("betweenness_centrality"), victim_reasons().alias("reasons"))


# Reason texts and their thresholds.
VICTIM_REASONS = [
    ("degree_centrality", 0.30, "The target has high network connectivity."),
    ("betweenness", 0.10, "The target occupies an important network communication position."),
    ("risk", 0.50, "The target already has elevated anomaly or attack risk."),
]
VICTIM_CONTACT = "The target has direct communication with a suspected attacker node."
VICTIM_DEFAULT = "The target was ranked highest based on its network topology."
NO_NODES = "The network graph contains no nodes."
NO_CANDIDATES = "No valid victim candidates found."
TARGET_REASONS = [
    ("degree_centrality", 0.30,
     "The predicted target has high network connectivity, making it an important communication node."),
    ("betweenness", 0.10, "The predicted target acts as a bridge between multiple parts of the network."),
    ("closeness", 0.30, "The predicted target can communicate efficiently with many network nodes."),
    ("risk", 0.50, "The predicted target already has an elevated anomaly or attack-risk score."),
]
TARGET_CONTACT = "The predicted target has direct communication with a suspected attacker."
TARGET_PATH = "A communication path exists between suspected attacker nodes and the predicted target."
TARGET_DEFAULT = "The target was selected primarily because of its relative structural importance in the network graph."
TARGET_ABSENT = "The explanation is based on global network topology because no target node was specified."


def _reasons(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    given = F.array_compact(F.array(*[F.when(condition, F.lit(text)) for condition, text in rules]))
    return F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(default)))


def victim_reasons() -> Column:
    """F18. Why a node is a likely victim."""
    rules = [(F.col(c) >= limit, text) for c, limit, text in VICTIM_REASONS]
    return _reasons([*rules, (F.col("attacker_connectivity") > 0, VICTIM_CONTACT)], VICTIM_DEFAULT)


def victim_outcome(edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """G12. The single best victim, or the reason why there is none."""
    best = ranked.agg(F.max_by(F.struct("node", "probability", "reasons"), F.struct("risk_score", "probability")).alias("b"))
    counted = beside(best, edges.agg(F.count("*").alias("edges")))
    nothing = F.when(F.col("edges") == 0, NO_NODES).otherwise(NO_CANDIDATES)
    return counted.select(F.col("b.node").alias("victim"), F.coalesce("b.probability", F.lit(0.0)).alias("probability"),
                          F.coalesce("b.reasons", F.array(nothing)).alias("reasons"))


def node_metrics(edges: DataFrame, attackers: Sequence = (), risk: DataFrame | None = None,
                 ranks: DataFrame | None = None) -> DataFrame:
    """G13. Every node with its four centralities, risk and attacker contact."""
    rows = _risk(risk, degree_centrality(edges)).join(path_centralities(edges), "node", "left")
    rows = rows.join(pagerank(edges) if ranks is None else ranks, "node", "left")
    return rows.join(attacker_connectivity(edges, attackers), "node", "left").na.fill(0.0)


def rank_nodes(metrics: DataFrame, attackers: Sequence = (), target=None, top_k: int = 10) -> DataFrame:
    """G13. Nodes by weighted importance, relative to the top one."""
    weights = {"degree_centrality": .25, "betweenness": .25, "closeness": .15, "pagerank": .15, "risk": .15,
               "attacker_connectivity": .05}
    score = reduce(Column.__add__, [F.lit(w) * F.col(c) for c, w in weights.items()])
    scored = metrics.withColumn("importance", score)
    top = F.when(F.col("__top") > 0, F.col("__top")).otherwise(1.0)
    ranked = beside(scored, scored.agg(F.max("importance").alias("__top"))).orderBy(F.desc("importance"), "node").limit(top_k)
    relative = F.col("importance") / top
    return ranked.withColumns({
        "relative_importance": relative, "percentage": F.round(relative * 100, 2),
        "is_attacker": F.col("node").isin(*attackers) if attackers else F.lit(False),
        "is_target": F.lit(False) if target is None else F.col("node") == F.lit(target),
    }).drop("__top")


def rank_edges(edges: DataFrame, attackers: Sequence = (), risk: DataFrame | None = None, target=None,
               weight: str | None = "weight", top_k: int = 10) -> DataFrame:
    """G14. Edges by weight, endpoint risk, attacker and target contact."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rows = edges.select("src", "dst", w.alias("weight"))
    ends = graph_nodes(edges) if risk is None else risk.select("node", "risk")
    graded = ends.withColumn("risk", F.lit(0.0)) if risk is None else ends.withColumn("risk", clamp(F.col("risk")))
    for end in ("src", "dst"):
        rows = rows.join(graded.select(F.col("node").alias(end), F.col("risk").alias(f"__{end}")), end, "left")
    touches = (F.col("src").isin(*attackers) | F.col("dst").isin(*attackers)) if attackers else F.lit(False)
    meets = F.lit(False) if target is None else (F.col("src") == F.lit(target)) | (F.col("dst") == F.lit(target))
    pulled = F.when(F.col("weight") > 0, F.col("weight") / F.when(F.col("weight") > 0, F.col("weight") + 1)).otherwise(0.0)
    risk_mean = (F.coalesce("__src", F.lit(0.0)) + F.coalesce("__dst", F.lit(0.0))) / 2
    return rows.select(
        "src", "dst", "weight", risk_mean.alias("risk"), touches.alias("connected_to_attacker"),
        meets.alias("connected_to_target"),
        (0.40 * pulled + 0.30 * risk_mean + 0.20 * touches.cast("int") + 0.10 * meets.cast("int")).alias("importance"),
    ).orderBy(F.desc("importance"), "src", "dst").limit(top_k)


def target_reasons(metrics: DataFrame, target, paths: DataFrame | None = None) -> DataFrame:
    """G15. Why the target matters, from its metrics and the attacker paths to it."""
    row = metrics.filter(F.col("node") == F.lit(target)).agg(
        *[F.max(c).alias(c) for c in ("degree_centrality", "betweenness", "closeness", "risk", "attacker_connectivity")],
        F.count("*").alias("present"))
    has_path = F.lit(0) if paths is None else paths.agg(F.count("*")).scalar()
    rules = [(F.col(c) >= limit, text) for c, limit, text in TARGET_REASONS]
    rules += [(F.col("attacker_connectivity") > 0, TARGET_CONTACT), (F.col("__paths") > 0, TARGET_PATH)]
    return row.withColumn("__paths", has_path).select(F.when(F.col("present") == 0, F.array(F.lit(TARGET_ABSENT))).otherwise(
        _reasons(rules, TARGET_DEFAULT)).alias("reasons"))


def graph_summary(edges: DataFrame, risk: DataFrame | None = None, components: DataFrame | None = None) -> DataFrame:
    """G15. Nodes, edges, density, weak components and nodes of risk 0.5 or more."""
    comps = weak_components(edges) if components is None else components
    counted = beside(edges.select("src", "dst").distinct().agg(F.count("*").alias("edges")),
                     comps.agg(F.count("*").alias("nodes"), F.count_distinct("component").alias("connected_components")))
    high = F.lit(0).cast("long") if risk is None else risk.filter("risk >= 0.5").agg(F.count("*")).scalar()
    n = F.col("nodes")
    return counted.withColumns({
        "density": F.when(n > 1, F.col("edges") / F.when(n > 1, n * (n - 1))).otherwise(0.0), "high_risk_nodes": high})
