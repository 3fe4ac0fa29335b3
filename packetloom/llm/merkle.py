"""Merkle dataset manifest: a tree whose parents keep the hash state before each child slot."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import fold, stored, table

FANOUT = 16
LEVELS = 3
SPAN = FANOUT ** LEVELS  # nodes that one task turns into one node of the next round
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = "name string, pos bigint, total bigint, digest binary"
PATH = "name string, pos bigint, root binary, subroot binary, path array<struct<left:binary,right:binary>>"


class Parent:
    """One inner node: the digest of its children's hex digests, with a copy of the state before each of them."""

    def __init__(self, children: list[bytes]):
        self.children = [c.hex().encode() for c in children]
        self.before = []
        state = hashlib.sha256()
        for child in self.children:
            self.before.append(state.copy())
            state.update(child)
        self.digest = state.digest()

    def folded(self, slot: int, replacement: bytes) -> bytes:
        """The digest with another child at ``slot``: only that child and its right siblings are hashed."""
        state = self.before[slot].copy()
        state.update(replacement.hex().encode())
        for child in self.children[slot + 1:]:
            state.update(child)
        return state.digest()

    def siblings(self, slot: int) -> tuple[bytes, bytes]:
        """Hex digests left and right of ``slot``, run together."""
        return b"".join(self.children[:slot]), b"".join(self.children[slot + 1:])


@dataclass
class Step:
    """A level above a subtree: the state before its slot, and the siblings on both sides."""

    left: bytes
    right: bytes
    state: object = field(init=False)

    def __post_init__(self):
        self.state = hashlib.sha256(self.left)

    def folded(self, replacement: bytes) -> bytes:
        state = self.state.copy()
        state.update(replacement.hex().encode())
        state.update(self.right)
        return state.digest()


class Subtree:
    """The levels over at most SPAN consecutive nodes of a tree of ``total`` nodes on this level."""

    def __init__(self, nodes: list[bytes], total: int):
        self.nodes = nodes
        self.levels: list[list[Parent]] = []
        row = nodes
        while len(self.levels) < LEVELS if total > SPAN else len(row) > 1:
            self.levels.append([Parent(row[k:k + FANOUT]) for k in range(0, len(row), FANOUT)])
            row = [p.digest for p in self.levels[-1]]
        self.digest = row[0]

    def path(self, k: int) -> list[tuple[bytes, bytes]]:
        """Siblings of node ``k``, level by level."""
        found = []
        for level in self.levels:
            found.append(level[k // FANOUT].siblings(k % FANOUT))
            k //= FANOUT
        return found

    def folded(self, k: int, replacement: bytes, known: dict) -> bytes:
        """The subtree's digest with another node ``k``; ``known`` keeps folds that several nodes share."""
        for depth, level in enumerate(self.levels):
            key = (depth, k, replacement)
            if key not in known:
                known[key] = level[k // FANOUT].folded(k % FANOUT, replacement)
            replacement = known[key]
            k //= FANOUT
        return replacement


def leaf(text: Column, columns: dict[str, str] | None = None) -> Column:
    """Hex digest of a row's fields with ``text`` in the place of its text."""
    names = columns or {}

    def sized(name: str) -> Column:
        value = (text if name == "text" else F.col(names.get(name, name))).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[sized(name) for name in FIELDS]), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with ``pos``, the 0-based place in their group, and ``total``, the group's size.

    Rows are dealt by range and written with their place in their task, so a group of any size lies
    in many tasks; only one count per task and group is summed up.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    written = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    written = written.withColumn("__part", F.shiftright("__at", 33))
    parts = written.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(group)
    before = F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = stored(parts.select(group, "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"),
                                F.sum("__n").over(whole).alias("total")))
    return written.join(parts, [group, "__part"]).withColumn("pos", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def _sorted(nodes: pa.Table) -> pa.Table:
    return nodes.sort_by("pos")


def _rows(columns: dict, schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(),
             "array<struct<left:binary,right:binary>>": pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))}
    types = {part.split(" ")[0]: kinds[part.split(" ")[1]] for part in schema.split(", ")}
    return pa.table({name: pa.array(columns[name], types[name]) for name in types})


def _chunk() -> Column:
    return F.floor(F.col("pos") / SPAN).alias("chunk")


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes (name, pos, total, digest) and those of each round above, until every tree has one."""

    def up(part: pa.Table) -> pa.Table:
        part = _sorted(part)
        first = part.slice(0, 1).to_pylist()[0]
        tree = Subtree(part["digest"].to_pylist(), first["total"])
        return _rows({"name": [first["name"]], "pos": [first["pos"] // SPAN], "total": [-(-first["total"] // SPAN)],
                      "digest": [tree.digest]}, NODE)

    most = nodes.agg(F.max("total")).first()[0] or 0
    found = [nodes]
    while most > 1:
        found.append(stored(found[-1].select("name", "pos", "total", "digest").groupBy("name", _chunk()).applyInArrow(up, NODE)))
        most = -(-most // SPAN)
    return found


def _down(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of the nodes of one round from those of the round above."""

    def extend(part: pa.Table, above: pa.Table) -> pa.Table:
        part = _sorted(part)
        tree = Subtree(part["digest"].to_pylist(), part["total"][0].as_py())
        up = above.to_pylist()[0]
        local = [[{"left": a, "right": b} for a, b in tree.path(k)] for k in range(len(part))]
        return _rows({"name": part["name"], "pos": part["pos"], "root": [up["root"]] * len(part),
                      "subroot": [up["subroot"]] * len(part), "path": [steps + up["path"] for steps in local]}, PATH)

    below = nodes.select("name", "pos", "total", "digest").groupBy("name", _chunk())
    return below.cogroup(paths.groupBy("name", F.col("pos").alias("chunk"))).applyInArrow(extend, PATH)


def manifest(docs: DataFrame, id_col: str = "doc_id", tampered: Column | None = None, tampered_text: Column | None = None,
             columns: dict[str, str] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, digests as lowercase hex.

    Trees: one per source over its rows by ascending id, one over the subroots by source (NULL
    first). ``tampered`` marks the rows whose fold starts from a leaf with ``tampered_text``; without
    it no row is changed. ``columns`` renames the fields hashed. A NULL id comes first. Rows that share source and id are
    ordered by leaf, so repeated rows get proofs of their own and reruns agree on the multiset of
    rows. NULL and empty texts differ. A source of one row has its leaf as subroot; an empty table
    gives no rows. Further columns are not read.

    A task builds three levels over 4,096 neighbours, whatever the source's size, and gets the
    levels above as one path of its subtree, so no task holds a source and no fold leaves its task.
    """
    names = columns or {}
    text = F.col(names.get("text", "text"))
    other = F.when(F.coalesce(tampered, F.lit(False)), leaf(tampered_text, names)) if tampered is not None else F.lit(None).cast("string")
    source = F.col(names.get("source", "source"))
    leaves = stored(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("name"),
        F.unhex(leaf(text, names)).alias("digest"), F.unhex(other).alias("tampered"), F.monotonically_increasing_id().alias("row")))
    placed = numbered(leaves, "name", ["id", "digest", "row"])
    trees = rounds(placed)
    subroots = trees[-1].filter("pos = 0").select("name", "digest")
    tops = stored(numbered(subroots.select(F.lit("").alias("name"), F.col("name").alias("source"), "digest"), "name", ["source"]))
    above = rounds(tops)
    paths = above[-1].select("name", "pos", F.col("digest").alias("root"), F.lit(None).cast("binary").alias("subroot"),
                             F.array().cast("array<struct<left:binary,right:binary>>").alias("path"))
    for nodes in reversed(above[:-1]):
        paths = _down(nodes, paths)
    paths = stored(tops.select("pos", F.col("source").alias("name"), F.col("digest").alias("subroot")).join(
        paths.select("pos", "root", "path"), "pos").select("name", F.lit(0).cast("bigint").alias("pos"), "root", "subroot", "path"))
    for nodes in reversed(trees[1:-1]):
        paths = _down(nodes, paths)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"

    def prove(part: pa.Table, up: pa.Table) -> pa.Table:
        part = _sorted(part)
        digests = part["digest"].to_pylist()
        tree = Subtree(digests, part["total"][0].as_py())
        top = up.to_pylist()[0]
        steps = [Step(s["left"], s["right"]) for s in top["path"]]
        upper = b"".join(s.left + s.right for s in steps)
        proofs, roots, known, at_top = [], [], {}, {}
        for k, changed in enumerate(part["tampered"].to_pylist()):
            state = hashlib.sha256()
            for left, right in tree.path(k):
                state.update(left)
                state.update(right)
            state.update(upper)
            proofs.append(state.hexdigest())
            node = tree.folded(k, changed or digests[k], known)
            if node not in at_top:
                value = node
                for step in steps:
                    value = step.folded(value)
                at_top[node] = value.hex()
            roots.append(at_top[node])
        n = len(part)
        return pa.table({"id": part["id"], "leaf": pa.array([d.hex() for d in digests], pa.string()),
                         "subroot": pa.array([top["subroot"].hex()] * n, pa.string()), "root": pa.array([top["root"].hex()] * n, pa.string()),
                         "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(roots, pa.string())})

    if len(trees) == 1:  # every source has one row: its path is the subroot's
        chunks = placed.groupBy("name", _chunk())
    else:
        chunks = placed.select("name", "pos", "total", "digest", "id", "tampered").groupBy("name", _chunk())
    proven = chunks.cogroup(paths.groupBy("name", F.col("pos").alias("chunk"))).applyInArrow(prove, schema)
    return proven.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"), tampered=fold("doc_id", 5) == 0,
                    tampered_text=F.translate(F.col("text"), UPPER, LOWER))


def _sql(levels: int = 8) -> str:
    """Trees of up to 16^``levels`` leaves, a level at a time."""

    def sized(name: str) -> str:
        return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"

    def hashed(text: str) -> str:
        return "sha256(" + " || ".join(sized(c) for c in FIELDS[:-1]) + f" || coalesce(strlen({text})::VARCHAR || ':' || {text}, '-'))"

    byte = "xor(c, b)"
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), "
           "lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(" + byte +
           ", range(8)), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::BIGINT) ELSE r // 2 END)), 4294967295::BIGINT)")
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [f"""leaves AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS name,
    {hashed('text')} AS leaf, CASE WHEN ({crc}) % 5 = 0 THEN {hashed(lower)} ELSE {hashed('text')} END AS changed FROM documents)""",
             "placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos FROM leaves)",
             "n0 AS (SELECT name, pos, leaf AS digest FROM placed)",
             "f0 AS (SELECT rid, name, pos, changed AS folded, '' AS proof FROM placed)"]

    def climb(n: str, f: str, start: int, end: int) -> None:
        for k in range(start, end):
            parts.append(f"""{n}r{k} AS (SELECT name, pos // 16 AS run, list(digest ORDER BY pos) AS ds,
    max(nodes) AS nodes FROM (SELECT *, count(*) OVER (PARTITION BY name) AS nodes FROM {n}{k}) GROUP BY name, pos // 16)""")
            parts.append(f"""{n}{k + 1} AS (SELECT name, run AS pos,
    CASE WHEN nodes = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS digest FROM {n}r{k})""")
            parts.append(f"""{f}{k + 1} AS (SELECT rid, f.name, pos // 16 AS pos, CASE WHEN nodes = 1 THEN folded ELSE sha256(
    array_to_string(ds[1:pos % 16], '') || folded || array_to_string(ds[pos % 16 + 2:], '')) END AS folded, CASE WHEN nodes = 1
    THEN proof ELSE proof || array_to_string(ds[1:pos % 16], '') || array_to_string(ds[pos % 16 + 2:], '') END AS proof
    FROM {f}{k} f JOIN {n}r{k} r ON f.name = r.name AND pos // 16 = run)""")

    climb("n", "f", 0, levels)
    parts.append(f"tops AS (SELECT name AS source, digest, row_number() OVER (ORDER BY name) - 1 AS pos FROM n{levels})")
    parts.append("m0 AS (SELECT '' AS name, pos, digest FROM tops)")
    parts.append(f"g0 AS (SELECT rid, '' AS name, t.pos AS pos, folded, proof FROM f{levels} f JOIN tops t ON f.name = t.source)")
    climb("m", "g", 0, levels)
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, t.digest AS subroot, m.digest AS root, sha256(g.proof) AS proof_sha256, g.folded AS folded_root,
    g.folded = m.digest AS verified
FROM placed p JOIN tops t ON p.name = t.source JOIN g{levels} g USING (rid) CROSS JOIN m{levels} m"""


OP13_SQL = _sql()
