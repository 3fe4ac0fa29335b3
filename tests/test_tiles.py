"""Products of state tiles and link tiles, and searches that send nothing to parts reached whole."""

import numpy as np
from pyspark.sql import functions as F

from packetloom.operators import paths as pt
from packetloom.operators import tiles


def test_product_of_a_tile_and_links():
    rng = np.random.default_rng(2)
    tile = np.zeros((tiles.TILE, tiles.WIDE))
    tile[rng.integers(0, 300, 80)] = rng.random(tiles.WIDE)
    codes = np.unique(rng.integers(0, 200, 30_000) * tiles.TILE + rng.integers(0, 300, 30_000)).astype(np.int32)
    links = np.zeros((200, tiles.TILE))
    links[codes // tiles.TILE, codes % tiles.TILE] = 1
    total = np.zeros_like(tile)
    tiles.add_links(total, tile, codes)
    assert np.allclose(total[:200], links @ tile) and not total[200:].any()
    assert np.array_equal(tiles.opened(*tiles.packed(tile)), tile)


def test_a_search_moves_tiles_and_not_a_row_per_link(spark):
    nodes = spark.range(80)
    edges = nodes.select(F.col("id").alias("src")).crossJoin(nodes.select(F.col("id").alias("dst"))).filter("src <> dst")
    placed = pt._in_blocks(nodes.select(F.col("id").alias("node")), "node", 80, tiles.TILE, "part", "at")
    lying = edges
    for end in ("src", "dst"):
        lying = lying.join(placed.select(F.col("node").alias(end), F.col("part").alias(f"{end}_part"), F.col("at").alias(f"{end}_at")), end)
    onward = tiles.link_tiles(lying, "src", "dst", 1)
    assert onward.select(F.size("codes")).collect() == [(80 * 79,)]
    sources = pt._in_blocks(placed.select(F.col("node").alias("source"), "part", "at"), "source", 80, tiles.WIDE, "block", "slot").withColumn(
        "leaves", F.lit(0).cast("long")).withColumn("held", F.array_repeat(F.lit(0).cast("long"), tiles.WIDE))
    found, last = pt._search(onward, sources, placed.groupBy("part").agg(F.count("*").alias("size")))
    assert last == 1 and {r["cells"] for r in found.rows(1).collect()} == {64 * 79, 16 * 79}
    found.drop()


def test_all_pairs_of_a_dense_graph(spark):
    nodes = spark.range(70)
    edges = nodes.select(F.col("id").alias("src")).crossJoin(nodes.select(F.col("id").alias("dst"))).filter("src <> dst")
    rows = pt.path_centralities(edges).collect()
    assert len(rows) == 70 and all(r["betweenness"] == 0 and abs(r["closeness"] - 1) < 1e-12 for r in rows)
