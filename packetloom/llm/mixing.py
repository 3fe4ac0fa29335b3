"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, in native columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import WORDS, stored, table

PROBES = 32


def numbered_sources(sources: DataFrame) -> DataFrame:
    """Adds ``place``: 0, 1, 2 ... by code point of ``source``, NULL last.

    Ranges are numbered one by one and offset by the ranges before them, so no task sees all sources.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranged = stored(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return ranged.withColumn("inside", inside).join(before, "part").withColumn(
        "place", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """Adds ``target`` to (source, source_size).

    Sources weigh ``weights`` in turn and divide ``share`` of all words; one that would exceed
    ``ceiling`` times its size stops there and the excess goes to the others by weight, again until
    none is above. Only three sums a round reach the driver.
    """
    rows = numbered_sources(sizes)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = stored(rows.withColumn("weight", F.element_at(turn, (F.col("place") % len(weights) + 1).cast("int")))
                  .withColumn("most", ceiling * F.col("source_size")).drop("place"))
    whole = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        above = F.col("most") < level * F.col("weight")
        n, fixed, open_weight = rows.agg(F.count_if(above), F.sum(F.when(above, F.col("most"))),
                                         F.sum(F.when(~above, F.col("weight")))).first()
        if n == stopped or not open_weight:
            break
        stopped, level = n, (whole - (fixed or 0.0)) / open_weight
    return rows.withColumn("target", F.least(F.col("most"), level * F.col("weight"))).drop("most", "weight")


def _seats(votes: Column | str, divisor: Column | float) -> Column:
    """One seat for each k with votes / (2 k + 1) >= divisor / 2."""
    return F.floor(F.col(votes) / divisor + 0.5).cast("long")


def apportion(cells: DataFrame, blocks: int, votes: str = "votes", order: Sequence[str] = ()) -> DataFrame:
    """Adds ``quota``: how many of ``blocks`` go to each row when each goes to the highest quotient votes / (2 k + 1).

    The divisor between the last quotient that wins and the first that loses is bracketed by
    PROBES sums at a time; the quotients left within the bracket are ranked, ties by ``order``.
    """
    total = cells.agg(F.sum(votes)).first()[0] or 0.0
    if not blocks or not total:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    low, high = total / blocks / 4, 4.0 * total / blocks  # seats fall as the divisor grows
    given = None
    for _ in range(12):
        grid = [low * (high / low) ** (k / (PROBES + 1)) for k in range(PROBES + 2)]
        counts = cells.agg(*[F.sum(_seats(votes, g)).alias(f"s{k}") for k, g in enumerate(grid)]).first()
        if counts[0] < blocks:
            low = low / 16
            continue
        if counts[-1] > blocks:
            high = high * 16
            continue
        at = next(k for k in range(PROBES + 2) if counts[k] <= blocks)
        high, given = grid[at], counts[at]
        if given == blocks or at == 0 or high / grid[at - 1] < 1 + 1e-13:
            break
        low = grid[at - 1]
    rows = cells.withColumn("quota", _seats(votes, high))
    if given == blocks:
        return rows
    quotient = F.col(votes) / (2 * F.col("quota") + 1)
    more = rows.filter(F.col(votes) > 0).select(*order, quotient.alias("quotient")).orderBy(
        F.desc("quotient"), *order).limit(blocks - given).select(*[F.col(c).alias(f"more_{c}") for c in order], F.lit(1).alias("more"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"more_{c}")) for c in order])
    return rows.join(more, same, "left").withColumn("quota", F.col("quota") + F.coalesce("more", F.lit(0))).drop(*more.columns)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, block: int = 16,
        shard_rows: int = 512, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        carry: Sequence[str] = ()) -> DataFrame:
    """(id, size, source_size, target, taken) of every row; ``carry`` names columns to keep beside them.

    Documents of a source fall into shards of about ``shard_rows`` by seeded hash of id and text
    and lie there in seeded order as one stream of blocks of ``block`` words. Sainte-Lague gives every
    shard its quota of blocks for the target of its source; a quota beyond the stream takes all of
    it once (or twice) and the rest is a run of blocks from a seeded start, going round at the end.
    ``taken`` counts the words a document has in the blocks taken.

    NULL and empty texts have size 0 and are never taken; rows without a source form a source of
    their own, last in order. Repeated rows are mixed as separate documents. A table without words
    gives targets of 0. Columns beyond id, text, source and ``carry`` are not read.
    """
    columns = [F.col(c) for c in carry]
    sized = docs.select(*_sized(id_col, text_col, source_col, seed), *[c.alias(f"carry_{k}") for k, c in enumerate(columns)])
    both = _streams(stored(sized), weights, share, ceiling, block, shard_rows, seed)
    return both.select(F.col("id").alias(id_col), *[F.col(f"carry_{k}").alias(c) for k, c in enumerate(carry)], "size",
                       "source_size", F.col("target").cast("double").alias("target"), "taken")


def _sized(id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    return [F.col(id_col).alias("id"), F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw")]


def _streams(sized: DataFrame, weights: Sequence[float], share: float, ceiling: float, block: int, shard_rows: int, seed: int) -> DataFrame:
    """Adds source_size, target, taken, and ``place``: how far the document begins behind the start of its shard's run, from 0 to 1."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    targets = stored(source_targets(sources, weights, share, ceiling).withColumn(
        "shards", F.ceil(F.col("n_rows") / shard_rows).cast("long")).drop("n_rows"))
    placed = sized.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn(
        "shard", F.pmod("draw", "shards"))
    keys = ["source", "shard"]
    cells = stored(placed.groupBy(*keys, "source_size", "target").agg(F.sum("size").alias("words")).withColumn(
        "votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("words") / F.col("source_size")).otherwise(0.0)))
    whole = cells.agg(F.sum("votes")).first()[0] or 0.0
    quotas = apportion(cells, round(whole / block), order=keys).select(
        *keys, "words", F.ceil(F.col("words") / block).cast("long").alias("blocks"), "quota")
    quotas = quotas.withColumn("quota", F.least("quota", 2 * F.col("blocks"))).withColumn(
        "rounds", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("long"))
    first = F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed), *keys), F.col("blocks"))).otherwise(0)
    quotas = quotas.withColumn("from", first * block).withColumn(
        "until", F.col("from") + (F.col("quota") - F.col("rounds") * F.col("blocks")) * block)
    # A run that passes the end goes on at the start of the stream; the last block may be short.
    over = F.greatest(F.lit(0), F.col("until") - F.col("blocks") * block)
    quotas = quotas.select(F.col("source").alias("of"), F.col("shard").alias("cut"), "rounds", "from", "words",
                           F.least("until", "words").alias("until"), over.alias("again"))
    stream = Window.partitionBy(*keys).orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("end", F.sum("size").over(stream)).withColumn("begin", F.col("end") - F.col("size"))
    both = laid.join(quotas, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("cut")))

    def overlap(lo: Column | str, hi: Column | str) -> Column:
        return F.greatest(F.lit(0), F.least("end", hi) - F.greatest("begin", lo))

    taken = F.col("rounds") * F.col("size") + overlap(F.col("from"), F.col("until")) + overlap(F.lit(0), F.col("again"))
    place = F.when(F.col("words") > 0, F.pmod(F.col("begin") - F.col("from"), F.col("words")) / F.col("words")).otherwise(0.0)
    return both.withColumn("taken", taken.cast("long")).withColumn("place", place)


def _running(rows: DataFrame, bucket: Column, order: Sequence[Column]) -> DataFrame:
    """Adds ``ahead``: words of the rows before each in its source; one row per bucket carries the sum across borders."""
    rows = rows.withColumn("b", bucket)
    sums = rows.groupBy("source", "b").agg(F.sum("size").alias("words"))
    carried = sums.withColumn("carried", F.sum("words").over(Window.partitionBy("source").orderBy("b")) - F.col("words")).select(
        F.col("source").alias("of"), F.col("b").alias("at"), "carried")
    inside = F.sum("size").over(Window.partitionBy("source", "b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("inside", inside).join(carried, F.col("source").eqNullSafe(F.col("of")) & (F.col("b") == F.col("at"))).withColumn(
        "ahead", F.col("carried") + F.col("inside") - F.col("size")).drop("of", "at", "b", "carried", "inside")


def whole_copies(streams: DataFrame, bucket_rows: int = 512) -> DataFrame:
    """(n, copies) of documents with words: 0 to 2 whole copies, so that each source keeps the words that its blocks have.

    All documents of a source get the whole number of rounds. The words left go to documents by ``place``, that
    is to those that begin in the runs of blocks, whatever their length; the one at the end of the words is taken
    if that comes nearer. What is then missing (or too much) goes to the next documents after (or before) that
    end which bring the sum nearer, again until none does.
    """
    rows = streams.filter("size > 0").select("n", "source", "size", "taken", "place", "draw")
    sums = rows.groupBy("source").agg(F.sum("taken").alias("goal"), F.sum("size").alias("all"), F.count("*").alias("n_rows"))
    sums = sums.select(F.col("source").alias("of"), F.floor(F.col("goal") / F.col("all")).alias("base"), F.pmod("goal", "all").alias("extra"),
                       F.ceil(F.col("n_rows") / bucket_rows).alias("buckets"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("of"))).drop("of", "taken")
    laid = _running(rows.withColumn("bucket", F.floor(F.col("place") * F.col("buckets"))), F.col("bucket"), [F.col("place"), F.col("draw"), F.col("n")])
    laid = stored(laid.withColumn("chosen", F.col("ahead") + F.col("size") / 2 <= F.col("extra")).withColumnRenamed("ahead", "at_word").drop("place", "draw"))
    while True:
        left = laid.groupBy("source").agg((F.first("extra") - F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0))).alias("left"))
        near = laid.join(left.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").filter(
            (F.col("chosen") == (F.col("left") < 0)) & (F.col("size") < 2 * F.abs("left")))
        sign = F.signum("left")
        order = F.col("at_word") * sign
        moved = stored(_running(near, F.col("bucket") * sign, [order, F.col("n") * sign]).filter(
            F.col("ahead") + F.col("size") / 2 <= F.abs("left")).select("n", F.lit(True).alias("moved")))
        if moved.isEmpty():
            return laid.select("n", (F.col("base") + F.col("chosen").cast("long")).cast("int").alias("copies"))
        laid = stored(laid.join(moved, "n", "left").withColumn("chosen", F.col("chosen") != F.col("moved").isNotNull()).drop("moved"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, block: int = 16,
                    shard_rows: int = 512, seed: int = 17) -> DataFrame:
    """The documents of the mix with all their columns, each in 0, 1 or 2 whole copies by ``whole_copies``.

    A source ends nearer to its target than half of any document that could still be added to it or left out of it.
    Documents without words go.
    """
    names = docs.columns
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(source_col).alias("s"))
    rows = stored(rows.select(*_sized("i", "t", "s", seed), "row", F.monotonically_increasing_id().alias("n")))
    streams = stored(_streams(rows.drop("row"), weights, share, ceiling, block, shard_rows, seed).select(
        "n", "source", "size", "taken", "place", "draw"))
    copies = whole_copies(streams).filter("copies > 0")
    return rows.select("n", "row").join(copies, "n").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def op7_mixing_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
