"""Sparse products of state tiles and link tiles, the inner step of searches from many sources.

A state tile holds TILE nodes x WIDE sources as a mask of bits and the values under it. A link tile holds
links between two parts of nodes. Both are bounded, whatever the graph: a hub's links lie in many
tiles, and no task sees more than one state tile and one chunk of link tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.session import cut_lineage

WIDE = 64  # sources searched side by side
TILE = 4096  # nodes of a part
CHUNK = 8  # link tiles that one task multiplies with a state tile, fewer where they are dense
LINKS = 1_000_000  # links of one row
_GATHERED = 8192  # links multiplied at once
STATE = "block long, part long, mask binary, value binary, leaves array<long>"


def opened(mask: bytes, value: bytes) -> np.ndarray:
    tile = np.zeros(TILE * WIDE)
    tile[held(mask)] = np.frombuffer(value)
    return tile.reshape(TILE, WIDE)


def held(mask: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(mask, np.uint8)).view(bool)


def packed(tile: np.ndarray) -> tuple[bytes, bytes]:
    mask = (tile != 0).ravel()
    return np.packbits(mask).tobytes(), tile.ravel()[mask].tobytes()


def state_table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def add_links(total: np.ndarray, tile: np.ndarray, codes: np.ndarray) -> None:
    """Adds to each target's row of ``total`` the rows of ``tile`` that link to it; ``codes`` are target * TILE + origin, ascending."""
    codes = codes[tile.any(axis=1)[codes % TILE]]
    for begin in range(0, len(codes), _GATHERED):
        target, origin = np.divmod(codes[begin:begin + _GATHERED], TILE)
        starts = np.flatnonzero(np.diff(target, prepend=-1))
        total[target[starts]] += np.add.reduceat(tile[origin], starts, axis=0)


def link_tiles(links: DataFrame, origin: str, target: str, parts: int) -> DataFrame:
    """(part, chunk, into, piece, codes) of links with the part and place of both ends; one row holds about LINKS links at most."""
    ends = links.select(F.col(f"{origin}_part").alias("part"), F.col(f"{target}_part").alias("into"), F.col(f"{origin}_at").alias("origin"),
                        F.col(f"{target}_at").alias("target"))
    densest = ends.groupBy("part", "into").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    chunks = -(-parts // max(1, min(CHUNK, 4 * LINKS // densest)))
    pieces = -(-densest // LINKS)
    return cut_lineage(ends.groupBy("part", F.pmod(F.xxhash64("into"), F.lit(chunks)).alias("chunk"), "into", (F.col("target") % pieces).alias(
        "piece")).agg(F.sort_array(F.collect_list((F.col("target") * TILE + F.col("origin")).cast("int"))).alias("codes")))


def sent(states: DataFrame, tiles: DataFrame, routes: DataFrame, value) -> DataFrame:
    """Products of states with the link tiles that ``routes`` (block, part, chunk, into, piece) names: STATE rows of the parts linked to.

    ``value`` makes the tile that is sent from a row of ``states`` (block, part, leaves, ...).
    """

    def multiply(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return state_table(STATE, [])
        row = left.to_pylist()[0]
        tile, totals = value(row), {}
        for into, codes in zip(right["into"].to_pylist(), right["codes"], strict=True):
            add_links(totals.setdefault(into, np.zeros((TILE, WIDE))), tile, codes.values.to_numpy())
        return state_table(STATE, [(row["block"], into, *packed(t), row["leaves"]) for into, t in totals.items() if t.any()])

    keys = ["block", "part", "chunk"]
    copies = states.join(routes.select(*keys).distinct(), ["block", "part"])
    return copies.groupBy(*keys).cogroup(routes.join(tiles, ["part", "chunk", "into", "piece"]).groupBy(*keys)).applyInArrow(multiply, STATE)


def met(received: DataFrame, found: DataFrame) -> DataFrame:
    """What of ``received`` is new, given the masks of ``found``: STATE rows with the number of cells and, per source, of nodes."""
    schema = f"{STATE}, cells long, nodes array<long>"

    def fresh(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return state_table(schema, [])
        total = _added(left)
        for mask in right["mask"].to_pylist():
            total.reshape(-1)[held(mask)] = 0
        if not total.any():
            return state_table(schema, [])
        nodes = (total != 0).sum(axis=0)
        return state_table(schema, [(key[0].as_py(), key[1].as_py(), *packed(total), left["leaves"][0].as_py(), int(nodes.sum()), nodes.tolist())])

    keys = ["block", "part"]
    return received.groupBy(*keys).cogroup(found.select(*keys, "mask").groupBy(*keys)).applyInArrow(fresh, schema)


def carried_back(received: DataFrame, level: DataFrame) -> DataFrame:
    """Dependencies (block, part, back_mask, back) of a level's nodes: path counts times the shares received."""
    schema = "block long, part long, back_mask binary, back binary"

    def scaled(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return state_table(schema, [])
        row = right.to_pylist()[0]
        return state_table(schema, [(row["block"], row["part"], *packed(_added(left) * opened(row["mask"], row["value"])))])

    keys = ["block", "part"]
    return received.groupBy(*keys).cogroup(level.select(*keys, "mask", "value").groupBy(*keys)).applyInArrow(scaled, schema)


def node_sums(found: DataFrame, carried: DataFrame) -> DataFrame:
    """(part, at, delta, reach, hops) of each part and block: what a search tells counts once for its source and once more for each leaf."""
    schema = "part long, at int, delta double, reach long, hops long"

    def summed(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return state_table(schema, [])
        leaves = np.array(left["leaves"][0].as_py(), np.int64)
        delta, reach, hops = np.zeros(TILE), np.zeros(TILE, np.int64), np.zeros(TILE, np.int64)
        for mask, depth in zip(left["mask"].to_pylist(), left["__round"].to_pylist(), strict=True):
            cells = held(mask).reshape(TILE, WIDE)
            own, more = cells.sum(axis=1) * (depth > 0), cells @ leaves
            reach += own + more
            hops += own * depth + more * (depth + 1)
        for mask, back in zip(right["back_mask"].to_pylist(), right["back"].to_pylist(), strict=True):
            delta += opened(mask, back) @ (1.0 + leaves)
        at = np.flatnonzero((reach > 0) | (delta > 0))
        return pa.table([pa.array(np.full(len(at), key[1].as_py(), np.int64)), pa.array(at.astype(np.int32)), pa.array(delta[at]),
                         pa.array(reach[at]), pa.array(hops[at])], names=["part", "at", "delta", "reach", "hops"])

    keys = ["block", "part"]
    return found.select(*keys, "mask", "leaves", "__round").groupBy(*keys).cogroup(carried.select(*keys, "back_mask", "back").groupBy(
        *keys)).applyInArrow(summed, schema)


def _added(rows: pa.Table) -> np.ndarray:
    total = np.zeros((TILE, WIDE))
    for mask, value in zip(rows["mask"].to_pylist(), rows["value"].to_pylist(), strict=True):
        total += opened(mask, value)
    return total


def first_states(placed: DataFrame) -> DataFrame:
    """Round 0: every source's own cell, from (block, slot, leaves, part, at)."""
    schema = f"{STATE}, cells long, nodes array<long>"

    def own(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total = np.zeros((TILE, WIDE))
        total[rows["at"].to_numpy(), rows["slot"].to_numpy()] = 1
        nodes = total.sum(axis=0).astype(int)
        return state_table(schema, [(key[0].as_py(), key[1].as_py(), *packed(total), rows["held"][0].as_py(), int(nodes.sum()), nodes.tolist())])

    return placed.groupBy("block", "part").applyInArrow(own, schema)
