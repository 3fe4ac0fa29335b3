"""Embedding near-dedup: an exact metric range join over pivot cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import batches_of_groups, components, local_roots, short_batches, stored, table

PIVOTS = 64
BLOCK = 640
BLOCKS = 8
SHARES = 128
BLOCK_BYTES = 4 << 20
SLACK = 1e-7


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _distances(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances on the unit sphere; they grow as the cosine falls."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (unit @ pivots.T)))


def _matrix(raw: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(v, np.float64) for v in raw.to_pylist()])


def _opened(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors from components of type ``kind``, scaled as :func:`_packed` scales them."""
    values = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return _unit(values / np.abs(values).max(axis=1, keepdims=True))


def pivots(usable: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """At most ``count`` vectors, those of least hash: a bounded set that guides the layout but never the result.

    The hashes are drawn first, so that only the vectors drawn are shuffled.
    """
    digest = F.xxhash64("raw")
    drawn = usable.select(digest.alias("h")).distinct().orderBy("h").limit(count).agg(F.max("h")).first()[0]
    rows = usable.filter(digest <= F.lit(drawn)).select("raw").distinct().orderBy(digest, "raw").limit(count).collect() if drawn is not None else []
    return _unit(np.array([np.frombuffer(r["raw"], np.float64) for r in rows])) if rows else np.zeros((0, 1))


def _packed(vectors: DataFrame, id_col: str, vector_col: str, single: bool = False) -> DataFrame:
    """(id, raw): components as doubles; raw is NULL for vectors that link with nothing. With ``single`` also as they are, in half the space."""

    @F.arrow_udf("binary")
    def pack(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            x = np.array([np.nan if y is None else y for y in v], np.float64) if v else np.zeros(0)
            with np.errstate(over="ignore", invalid="ignore"):
                scale = np.abs(x).max(initial=0.0)
                usable = len(x) > 0 and np.isfinite(scale) and scale > 0
            out.append((x / scale).tobytes() if usable else None)  # scaling keeps the norm within range
        return pa.array(out, pa.binary())

    @F.arrow_udf("binary")
    def as_singles(values: pa.Array) -> pa.Array:
        return pa.array([np.array(v, np.float32).tobytes() if v and None not in v else None for v in values.to_pylist()], pa.binary())

    more = [as_singles(F.col(vector_col)).alias("short")] if single else []
    return vectors.select(F.col(id_col).cast("long").alias("id"), pack(F.col(vector_col)).alias("raw"), *more)


def _blocks(shared, kind: str):
    """Rows (block, lo, hi, ids, vectors) of whole blocks, in order of id; lo and hi bound the distances to every pivot."""
    schema = pa.schema([("block", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in batches_of_groups(batches, ["home"]):
            ids = group.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            values = group.column("raw").take(pa.array(order)).to_pylist()
            far = _distances(_opened(values, kind), shared.value)
            row = (group.column("home")[0].as_py(), far.min(axis=0), far.max(axis=0), ids[order].tobytes(), b"".join(values))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return run


def _linked(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, ...]:
    """(ids, links, roots) of the rows of a symmetric matrix that have links; ids ascend."""
    seen = np.flatnonzero(linked.any(axis=1))
    linked, ids = linked[np.ix_(seen, seen)], ids[seen]
    return ids, linked.sum(axis=1), ids[local_roots(linked)]


def _met(first: tuple, second: tuple, threshold: float, tile: int) -> Iterator[tuple[np.ndarray, ...]]:
    """What each tile of two blocks (ids, units) links; of a block with itself each pair once.

    Tiles are multiplied in single precision, which is off by less than the margin, and those with a product near the threshold again in double.
    """
    (ids, unit), (others, other) = first, second
    rough, rougher = unit.astype(np.float32), other.astype(np.float32)
    least = threshold - (unit.shape[1] + 8) * 2.0 ** -22
    for i in range(0, len(ids), tile):
        for j in range(i if first is second else 0, len(others), tile):
            if not (rough[i:i + tile] @ rougher[j:j + tile].T).max() >= least:
                continue
            across = unit[i:i + tile] @ other[j:j + tile].T >= threshold
            if first is second and i == j:
                np.fill_diagonal(across, False)
                if across.any():
                    yield _linked(ids[i:i + tile], across)
                continue
            a, b = np.flatnonzero(across.any(axis=1)), np.flatnonzero(across.any(axis=0))
            if len(a) == 0:
                continue
            both = np.concatenate([ids[i + a], others[j + b]])
            order = np.argsort(both, kind="stable")
            linked = np.zeros((len(both), len(both)), bool)
            linked[:len(a), len(a):] = across[np.ix_(a, b)]
            linked |= linked.T
            yield _linked(both[order], linked[np.ix_(order, order)])


def _join(shared, threshold: float, radius: float, tile: int, kind: str):
    """Links of pairs of blocks; a vector takes part if its distances to all pivots are near enough those of the other block."""
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def opened(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
        ids, values = np.frombuffer(row[f"{side}_ids"], np.int64), row[f"{side}_vectors"]
        size = len(values) // len(ids)
        return ids, _opened([values[k:k + size] for k in range(0, len(values), size)], kind)

    def near(block: tuple, row: dict, other: str) -> tuple[np.ndarray, np.ndarray]:
        far = _distances(block[1], shared.value)
        kept = ((far >= np.array(row[f"{other}_lo"]) - radius) & (far <= np.array(row[f"{other}_hi"]) + radius)).all(axis=1)
        return block[0][kept], block[1][kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                first = opened(row, "first")
                if row["first_block"] == row["second_block"]:
                    second = first
                else:
                    first, second = near(first, row, "second"), near(opened(row, "second"), row, "first")
                found = list(_met(first, second, threshold, tile))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], schema=schema)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9,
                 n_pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector.

    Every vector belongs to the cell of its nearest pivot; a cell of many vectors is split into
    blocks, each a row of one table. Vectors of cosine >= threshold lie at most r apart, so by the triangle
    inequality two blocks, or a vector and a block, can link only if their distances to each pivot are
    at most r apart. The table is joined with itself where it lies: a task reads some of its files twice
    and multiplies each pair of blocks in tiles of ``block`` vectors, returning counts and spanning
    links instead of pairs. So the work may be quadratic, but what is written is not.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components, those of another
    length than the block they meet, and those with a NULL id link with nothing. Rows that repeat id
    and vector are one vector. Rows with one id and different vectors share its result, their links added. A NULL id
    has a NULL component_id and is kept. Further columns are not read.
    """
    spark = vectors.sparkSession
    repeated = not vectors.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    single = not repeated and vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    whole = stored(_packed(vectors, id_col, vector_col).distinct()) if repeated else _packed(vectors, id_col, vector_col, single)
    usable = whole.filter(F.col("raw").isNotNull() & F.col("id").isNotNull())
    radius = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold))) + SLACK
    lengths = [r[0] for r in usable.select(F.length("raw")).distinct().limit(257).collect()]
    if len(lengths) > 256:
        raise ValueError("vectors of more than 256 different lengths")
    links = None
    for length in lengths or [0]:
        part = _links_of_length(spark, usable.filter(F.length("raw") == length), length, threshold, radius, n_pivots, block)
        links = part if links is None else links.unionByName(part)
    with short_batches(spark, 4):
        links = stored(links)
    found = components(links.filter("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst")))
    return (whole.select("id").join(links.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
            .join(found.withColumnRenamed("node", "id"), "id", "left")
            .select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "id").alias("component_id"),
                    F.col("id").eqNullSafe(F.coalesce("component", "id")).alias("kept")))


def _links_of_length(spark, usable: DataFrame, length: int, threshold: float, radius: float, n_pivots: int, block: int) -> DataFrame:
    """(id, links, root) of the vectors of one length, one row for each pair of tiles that links them."""
    shared = spark.sparkContext.broadcast(pivots(usable, n_pivots))
    single = "short" in usable.columns
    kind = "f4" if single else "f8"

    @F.arrow_udf("int")
    def nearest(raw: pa.Array) -> pa.Array:
        return pa.array(_distances(_unit(_matrix(raw)), shared.value).argmin(axis=1) if len(raw) else [], pa.int32())

    # One row for each pivot reaches the driver. A row of the table of blocks holds BLOCKS tiles, fewer where that is more than a share of all.
    cells = {r["cell"]: r["n"] for r in usable.groupBy(nearest("raw").alias("cell")).agg(F.count("*").alias("n")).collect()}
    rows = max(block, min(BLOCKS * block, -(-sum(cells.values()) // SHARES)))
    rows = max(1, min(rows, BLOCK_BYTES // max(length, 1)))
    layout, total = {}, 0
    for cell, n in sorted(cells.items()):
        layout[cell] = (total, -(-n // rows))
        total += layout[cell][1]

    @F.arrow_udf("long")
    def home(cell: pa.Array, draw: pa.Array) -> pa.Array:
        return pa.array([layout[c][0] + d % layout[c][1] for c, d in zip(cell.to_pylist(), draw.to_pylist(), strict=True)], pa.int64())

    dealt = usable.withColumn("home", home(nearest("raw"), F.pmod(F.xxhash64("id", "raw"), F.lit(1 << 40))))
    dealt = dealt.select("id", F.col("short" if single else "raw").alias("raw"), "home").repartition("home").sortWithinPartitions("home")
    blocks = stored(dealt.mapInArrow(_blocks(shared, kind), "block long, lo array<double>, hi array<double>, ids binary, vectors binary"))
    first, second = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in ("first", "second"))
    apart = F.exists(F.arrays_zip("first_lo", "first_hi", "second_lo", "second_hi"), lambda p: (
        p["first_lo"] > p["second_hi"] + radius) | (p["second_lo"] > p["first_hi"] + radius))
    pairs = first.join(second.hint("shuffle_replicate_nl"), (F.col("first_block") <= F.col("second_block")) & ~apart)
    return pairs.mapInArrow(_join(shared, threshold, radius, block, kind), "id long, links long, root long")


def op10_embedding_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
