"""Searches from many sources by tasks that each hold the links of a graph, for graphs small enough for that.

A search of such a graph moves nothing between tasks: a task takes blocks of sources, walks their levels
in numpy side by side and returns sums per node. Links lie by node in both directions. A level follows
the links of the nodes it starts from or of those it may reach, whichever are fewer; a level of many
links goes over windows of neighbouring nodes, whose links are padded to one length and summed at once.
The memory of a task is bounded by HELD_LINKS and CELLS, whatever the number of levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.session import cut_lineage

HELD_LINKS = 12_000_000  # links that a task holds at most
HELD_NODES = 1_000_000
WIDE = 64  # sources searched side by side, fewer where nodes are many
WORDS = 8  # words of 64 sources, where only distances are wanted
CELLS = 6_000_000  # nodes times sources of one block
ROWS = 32  # nodes of a window
BATCH = 64  # windows settled at once
_GATHERED = 4096  # links of a sparse level multiplied at once
_SPARSE = 8  # a window sums a link about so many times faster than a sparse level does
_SUMS = "at int, delta double, reach long, hops long, reached long"


def _folded(values: np.ndarray, target: np.ndarray, origin: np.ndarray, total: np.ndarray, add: np.ufunc) -> None:
    """Adds to each target's row of ``total`` the rows of ``values`` of its origins; targets ascend."""
    for begin in range(0, len(target), _GATHERED):
        at = target[begin:begin + _GATHERED]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        rows = at[starts]
        total[rows] = add(total[rows], add.reduceat(values[origin[begin:begin + _GATHERED]], starts, axis=0))


class _Way:
    """Links of one direction: those of node i end at ``ends[begin[i]:begin[i + 1]]``."""

    def __init__(self, begin: np.ndarray, ends: np.ndarray):
        self.begin, self.ends, self.size, self._windows = begin, ends, np.diff(begin), None

    def turned(self) -> _Way:
        origin = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        order = np.argsort(self.ends, kind="stable")
        counts = np.bincount(self.ends, minlength=len(self.size))
        return _Way(np.concatenate([[0], np.cumsum(counts)]), origin[order])

    def of(self, rows: np.ndarray, skip: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``rows`` and the ends of their links, but for the first ``skip`` of each."""
        size = self.size[rows] - skip
        shift = np.repeat(self.begin[rows] + skip - (np.cumsum(size) - size), size)
        return np.repeat(np.arange(len(rows)), size), self.ends[shift + np.arange(len(shift))]

    def windows(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(links of a node, their ends with a missing one as node n, nodes with more links) per window of ROWS nodes.

        A window takes at most twice the mean number of links, so that a hub does not pad its neighbours.
        """
        if self._windows is None:
            n, self._windows = len(self.size), []
            for first in range(0, n, ROWS):
                size = self.size[first:first + ROWS]
                width = min(int(size.max()), 2 * -(-int(size.sum()) // len(size)))
                place = np.arange(width)[:, None]
                kept = place < size
                ends = np.full(kept.shape, n, np.int32)
                ends[kept] = self.ends[(self.begin[first:first + len(size)] + place)[kept]]
                self._windows.append((width, ends.ravel(), first + np.flatnonzero(size > width)))
        return self._windows

    def summed(self, values: np.ndarray, origins: np.ndarray, wanted: np.ndarray, add: np.ufunc) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, sums over their links) of all batches of windows with a wanted node and a link to ``origins``; other rows of ``values`` are zero."""
        n, windows = len(self.size), self.windows()
        live = np.zeros(n + 1, bool)
        live[origins] = True
        buffer = np.empty((max((len(ends) for _, ends, _ in windows), default=0), values.shape[1]), values.dtype)
        for first in range(0, n, ROWS * BATCH):
            if not wanted[first:first + ROWS * BATCH].any():
                continue
            total = np.zeros((min(n - first, ROWS * BATCH), values.shape[1]), values.dtype)
            for at in range(first, min(n, first + ROWS * BATCH), ROWS):
                width, ends, more = windows[at // ROWS]
                if not width or not wanted[at:at + ROWS].any():
                    continue
                if live[ends].any():
                    rows = buffer[:len(ends)]
                    np.take(values, ends, axis=0, out=rows, mode="clip")
                    part = total[at - first:at - first + ROWS]
                    add.reduce(rows.reshape(width, -1), axis=0, out=part.reshape(-1))
                if len(more):
                    place, rest = self.of(more, width)
                    _folded(values, more[place] - first, rest, total, add)
            yield np.arange(first, first + len(total)), total


def _products(push: _Way, pull: _Way, values: np.ndarray, origins: np.ndarray, wanted: np.ndarray, add: np.ufunc,
              targets: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(nodes, sums of ``values`` over the links from ``origins``), each node once; nodes that are not wanted may be among them."""
    given = int(push.size[origins].sum())
    taken = given if targets is None else int(pull.size[targets].sum())
    if min(given, taken) * _SPARSE >= len(pull.ends):
        yield from pull.summed(values, origins, wanted, add)
    elif taken < given:
        place, ends = pull.of(targets)
        total = np.zeros((len(targets), values.shape[1]), values.dtype)
        _folded(values, place, ends, total, add)
        yield targets, total
    else:
        place, ends = push.of(origins)
        order = np.argsort(ends, kind="stable")
        nodes, place_of = np.unique(ends[order], return_inverse=True)
        total = np.zeros((len(nodes), values.shape[1]), values.dtype)
        _folded(values, place_of, origins[place[order]], total, add)
        yield nodes, total


def _in_pieces(rows: np.ndarray) -> Iterator[np.ndarray]:
    for begin in range(0, len(rows), ROWS * BATCH):
        yield rows[begin:begin + ROWS * BATCH]


def _width(n: int) -> int:
    return max(1, min(WIDE, CELLS // max(n, 1)))


class Paths:
    """Path counts, dependencies and distances from blocks of sources."""

    def __init__(self, begin: np.ndarray, ends: np.ndarray):
        self.n = len(begin) - 1
        self.out = _Way(begin, ends)
        self.into = self.out.turned()
        self.wide = _width(self.n)
        self.delta, self.reach, self.hops, self.reached = (np.zeros(self.n, t) for t in (float, np.int64, np.int64, np.int64))
        cells = (self.n, self.wide)
        self.ways, self.carried, self.depth = np.empty(cells), np.empty(cells), np.empty(cells, np.int32)
        self.values = np.zeros((self.n + 1, self.wide))

    def search(self, sources: np.ndarray, leaves: np.ndarray) -> None:
        """Add what the searches of at most ``wide`` sources tell; each counts once and once more for each of its leaves."""
        slots = np.arange(len(sources))
        held, more = np.flatnonzero(leaves), leaves[leaves > 0].astype(float)
        ways, depth, values = self.ways, self.depth, self.values
        for table, start in ((ways, 0), (self.carried, 0), (depth, -1)):
            table.fill(start)
        ways[sources, slots], depth[sources, slots] = 1, 0
        met = np.zeros(self.n, np.int64)
        met[sources] = 1
        for k, count in zip(sources[held], leaves[held], strict=True):  # a leaf is one hop from its neighbour
            self.reach[k] += count
            self.hops[k] += count
        levels = [np.unique(sources)]
        while len(levels[-1]):
            last, found = len(levels) - 1, []
            for rows in _in_pieces(levels[-1]):
                values[rows] = np.where(depth[rows] == last, ways[rows], 0)
            for rows, sums in _products(self.out, self.into, values, levels[-1], met < len(sources), np.add):
                far = depth[rows]
                new = (sums != 0) & (far < 0)
                own = np.count_nonzero(new, axis=1)
                some = np.flatnonzero(own)
                if not len(some):
                    continue
                if len(some) < len(rows):
                    rows, sums, far, new, own = rows[some], sums[some], far[some], new[some], own[some]
                far[new] = last + 1
                depth[rows] = far
                ways[rows] += np.where(new, sums, 0)
                again = (new[:, held].astype(float) @ more).astype(np.int64) if len(held) else 0
                self.reach[rows] += own + again
                self.hops[rows] += own * (last + 1) + again * (last + 2)
                met[rows] += own
                self.reached[sources] += np.count_nonzero(new, axis=0)[:len(sources)]
                found.append(rows)
            values[levels[-1]] = 0
            levels.append(np.concatenate(found) if found else np.zeros(0, np.int64))
        self._back(levels[:-1])
        self.delta += self.carried[:, :len(sources)] @ (1.0 + leaves)

    def _back(self, levels: list[np.ndarray]) -> None:
        """Dependencies of all nodes but the sources, from the last level to the first."""
        ways, carried, depth, values = self.ways, self.carried, self.depth, self.values
        for last in range(len(levels) - 1, 1, -1):
            for rows in _in_pieces(levels[last]):
                here = depth[rows] == last
                values[rows] = np.divide(1.0 + carried[rows], ways[rows], out=np.zeros(here.shape), where=here)
            wanted = np.zeros(self.n, bool)
            wanted[levels[last - 1]] = True
            for rows, sums in _products(self.into, self.out, values, levels[last], wanted, np.add, levels[last - 1]):
                carried[rows] += np.where(depth[rows] == last - 1, ways[rows] * sums, 0)
            values[levels[last]] = 0


class Distances:
    """Reach and distances alone: a bit for each of WORDS * 64 sources."""

    def __init__(self, begin: np.ndarray, ends: np.ndarray):
        self.n = len(begin) - 1
        self.out = _Way(begin, ends)
        self.into = self.out.turned()
        self.words = max(1, min(WORDS, CELLS // max(self.n, 1)))
        self.wide = 64 * self.words
        self.delta, self.reach, self.hops, self.reached = (np.zeros(self.n, t) for t in (float, np.int64, np.int64, np.int64))
        self.values = np.zeros((self.n + 1, self.words), np.uint64)

    def _bits(self, slots: np.ndarray) -> np.ndarray:
        row = np.zeros(self.words, np.uint64)
        np.bitwise_or.at(row, slots // 64, np.uint64(1) << (slots % 64).astype(np.uint64))
        return row

    def search(self, sources: np.ndarray, leaves: np.ndarray) -> None:
        slots, values = np.arange(len(sources)), self.values
        everyone = self._bits(slots)
        planes = [(1 << b, self._bits(slots[(leaves >> b) & 1 > 0])) for b in range(int(leaves.max(initial=0)).bit_length())]
        seen = np.zeros((self.n, self.words), np.uint64)
        np.bitwise_or.at(seen, (sources, slots // 64), np.uint64(1) << (slots % 64).astype(np.uint64))
        np.add.at(self.reach, sources, leaves)
        np.add.at(self.hops, sources, leaves)
        rows, last = np.unique(sources), 0
        values[rows] = seen[rows]
        while len(rows):
            last, found, told = last + 1, [], []
            for at, sums in _products(self.out, self.into, values, rows, (seen != everyone).any(axis=1), np.bitwise_or):
                new = sums & ~seen[at]
                some = np.flatnonzero(new.any(axis=1))
                at, new = at[some], new[some]
                seen[at] |= new
                own = np.bitwise_count(new).sum(axis=1, dtype=np.int64)
                again = sum((count * np.bitwise_count(new & plane).sum(axis=1, dtype=np.int64) for count, plane in planes), np.zeros(len(at), np.int64))
                self.reach[at] += own + again
                self.hops[at] += own * last + again * (last + 1)
                found.append(at)
                told.append(new)
            values[rows] = 0
            rows = np.concatenate(found) if found else np.zeros(0, np.int64)
            for at, new in zip(found, told, strict=True):
                values[at] = new


def accumulated(links: DataFrame, sources: DataFrame, ends: DataFrame, paths: bool) -> tuple[DataFrame, DataFrame]:
    """Sums (node, delta, reach, hops) over all sources, and (source, leaves, back, reached); without ``paths`` delta and reached are 0.

    The nodes are numbered in their order, so that what is near by number is read together. Links and sources are sent to all tasks.
    """
    spark = links.sparkSession
    names = ends.orderBy("node").toArrow()
    numbered = cut_lineage(spark.createDataFrame(names.append_column("at", pa.array(np.arange(len(names), dtype=np.int32)))))
    lying = links
    for end in ("src", "dst"):
        lying = lying.join(numbered.select(F.col("node").alias(end), F.col("at").alias(f"{end}_at")), end)
    lying = lying.select("src_at", "dst_at").toArrow()
    src, dst = (lying[c].to_numpy().astype(np.int32) for c in ("src_at", "dst_at"))
    order = np.lexsort((dst, src))
    begin = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(names)))]).astype(np.int64)
    told = sources.join(numbered.withColumnRenamed("node", "source"), "source").select("at", "leaves").toArrow()
    origin, leaves = (told[c].to_numpy().astype(np.int64) for c in ("at", "leaves"))
    by_place = np.argsort(origin, kind="stable")
    shared = spark.sparkContext.broadcast((begin, dst[order], origin[by_place], leaves[by_place]))
    kind = Paths if paths else Distances
    wide = _width(len(names)) if paths else 64 * WORDS
    tasks = max(1, min(-(-len(origin) // wide), 4 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [t for batch in batches for t in batch.column(0).to_pylist()]
        if not own:
            return
        begin, ends, origin, leaves = shared.value
        search = kind(begin, ends)
        blocks = -(-len(origin) // search.wide)
        for t in own:
            for block in range(t, blocks, tasks):
                part = slice(block * search.wide, (block + 1) * search.wide)
                search.search(origin[part], leaves[part])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(search.n, dtype=np.int32)), *map(pa.array, (
            search.delta, search.reach, search.hops, search.reached))], names=[c.split()[0] for c in _SUMS.split(", ")])

    sums = spark.range(0, tasks, 1, tasks).mapInArrow(run, _SUMS).groupBy("at").agg(*[F.sum(c).alias(c) for c in ("delta", "reach", "hops", "reached")])
    whole = cut_lineage(numbered.join(sums, "at").drop("at"))
    shared.destroy()
    reached = sources.join(whole.select(F.col("node").alias("source"), "reached"), "source").select("source", "leaves", "back", "reached")
    return whole.drop("reached"), reached
