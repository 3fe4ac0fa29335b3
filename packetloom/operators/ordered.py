"""Ordered computations that never gather one key, source or timeline into a single task.

A plain ``Window.partitionBy(key)`` puts every row of a hot key into one task.  The operators
here cut the order into buckets, compute inside (key, bucket), and carry only one summary row
per bucket across bucket borders.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.session import cut_lineage

KEY, BUCKET, BLOCK, OWNED = "__key", "__bucket", "__block", "__owned"
SPANS_PER_TASK, MOST_SPAN_TASKS = 16, 10_000
SKETCH_SIZE, MOST_RANKS = 4096, 1024  # ranks off by about a thousandth, so finer cut points would not be even


def group_key(columns: Sequence[str | Column]) -> Column:
    """One never-NULL string per key combination, so NULL keys group and join like values."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])


def epoch_micros(ts: str | Column) -> Column:
    """Microseconds since the epoch, for TIMESTAMP and TIMESTAMP_NTZ alike."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def time_bucket(ts: str | Column, seconds: float) -> Column:
    return F.floor(epoch_micros(ts) / F.lit(int(seconds * 1_000_000)))


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row, as a scalar subquery."""
    row = right.select(F.struct(*right.columns).alias("row")).scalar()
    return left.withColumn("__row", row).select(*left.columns, "__row.*")


def running_totals(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    totals: Mapping[str, Column],
) -> DataFrame:
    """Add inclusive running sums per key; ``bucket`` must not decrease along ``order``."""
    inputs = {f"__in_{name}": value for name, value in totals.items()}
    tagged = rows.withColumns({KEY: group_key(keys), BUCKET: bucket, **inputs})
    per_bucket = tagged.groupBy(KEY, BUCKET).agg(
        *[F.sum(f"__in_{name}").alias(f"__sum_{name}") for name in totals]
    )
    earlier = Window.partitionBy(KEY).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        KEY,
        BUCKET,
        *[F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__off_{n}") for n in totals],
    )
    inside = Window.partitionBy(KEY, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = tagged.join(offsets, [KEY, BUCKET])
    result = joined.withColumns(
        {name: F.sum(f"__in_{name}").over(inside) + F.col(f"__off_{name}") for name in totals}
    )
    return result.drop(KEY, BUCKET, *inputs, *[f"__off_{n}" for n in totals])


def row_index(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column,
              name: str = "row_index") -> DataFrame:
    """Dense 0-based position of each row within its key."""
    counted = running_totals(rows, keys, order, bucket, {name: F.lit(1)})
    return counted.withColumn(name, F.col(name) - 1)


def previous_value(
    rows: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie_break: Sequence[str],
    bucket_seconds: float,
    value: str | None = None,
    name: str = "previous",
    rows_per_bucket: int = 2_000_000,
) -> DataFrame:
    """``lag(value)`` in time order per key, carried across time buckets; bursts within one are cut."""
    value = value or ts
    order = [F.col(ts), *[F.col(c) for c in tie_break]]
    tagged = add_time_bucket(rows, keys, ts, bucket_seconds, rows_per_bucket).withColumn(KEY, group_key(keys))
    last = tagged.groupBy(KEY, BUCKET).agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__last")
    )
    carried = last.select(
        KEY, BUCKET, F.lag("__last").over(Window.partitionBy(KEY).orderBy(BUCKET)).alias("__carry")
    )
    inside = Window.partitionBy(KEY, BUCKET).orderBy(*order)
    first = F.row_number().over(inside) == 1
    return (
        tagged.join(carried, [KEY, BUCKET])
        .withColumn(name, F.when(first, F.col("__carry.v")).otherwise(F.lag(value).over(inside)))
        .drop(KEY, BUCKET, "__carry")
    )


def with_halo(rows: DataFrame, keys: Sequence[str], index: str, before: int, after: int,
              block: int = 4096) -> tuple[DataFrame, Window]:
    """Split an indexed timeline into blocks, each with the neighbour rows its frames read.

    Returns the rows (block copies flagged by ``__owned``) and the ordered window over one block.
    Frames reaching at most ``before`` rows back and ``after`` rows ahead are exact for owned rows;
    call :func:`owned_rows` afterwards.
    """
    if max(before, after) > block:
        raise ValueError("block must be at least as long as the frame")
    own = F.floor(F.col(index) / block)
    targets = F.array_distinct(
        F.array(
            F.floor((F.col(index) - after) / block), own, F.floor((F.col(index) + before) / block)
        )
    )
    spread = rows.withColumn(BLOCK, F.explode(targets)).withColumn(OWNED, F.col(BLOCK) == own)
    return spread, Window.partitionBy(*keys, BLOCK).orderBy(index)


def owned_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(OWNED).drop(BLOCK, OWNED)


def value_buckets(written: DataFrame, rows_per_bucket: int = 2_000_000, least: int = 64) -> int:
    """Buckets for a written table, so that one holds about ``rows_per_bucket`` rows however many there are."""
    return max(least, -(-written.count() // rows_per_bucket))


def add_value_bucket(values: DataFrame, column: str, name: str = "__vb", buckets: int = 64,
                     sample_per_bucket: int = 128) -> DataFrame:
    """Add an order-preserving bucket number with roughly equal distinct values per bucket.

    The cut points are quantiles of the values with the smallest hashes: a bounded sample that is
    the same in every evaluation, so recomputed tasks agree. Only the cut points come from it; every
    row keeps its exact place.
    """
    picked = (
        values.select(F.col(column).cast("double").alias("v"))
        .distinct()
        .orderBy(F.xxhash64("v"), "v")
        .limit(sample_per_bucket * buckets)
    )
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = picked.agg(F.coalesce(F.percentile("v", steps), F.array().cast("array<double>"))).scalar()
    below = F.size(F.filter("__cuts", lambda cut: cut < F.col(column).cast("double")))
    return values.withColumn("__cuts", cuts).withColumn(name, below).drop("__cuts")


def add_key_value_bucket(counts: DataFrame, keys: Sequence[str], column: str, name: str = "__vb",
                         rows_per_bucket: int = 2_000_000) -> DataFrame:
    """Add an order-preserving bucket number whose cut points belong to the key of a row.

    A key of at most ``rows_per_bucket`` rows is one bucket. A hot key gets cut points from a quantile
    sketch of its own values, so that it is split evenly however narrow its range is. The sketches
    only balance work; their cut points are written once, since a sketch is not the same in every run.
    ``counts`` should be a written table: it is read up to three times.
    """
    tagged = counts.withColumn(KEY, group_key(keys))
    hot = cut_lineage(tagged.groupBy(KEY).agg(F.count("*").alias("__rows")).filter(F.col("__rows") > rows_per_bucket))
    largest = hot.agg(F.max("__rows")).first()[0]
    if largest is None:
        return counts.withColumn(name, F.lit(0))
    value = F.col(column).cast("double")
    # Hot keys, and all cut points they use, are fewer than rows / rows_per_bucket each.
    ranks = min(-(-largest // rows_per_bucket), MOST_RANKS)
    every = F.kll_sketch_get_quantile_double("__sketch", F.array(*[F.lit(i / ranks) for i in range(1, ranks)]))
    own = F.least(F.ceil(F.col("__rows") / rows_per_bucket), F.lit(ranks))
    sketched = tagged.join(F.broadcast(hot), KEY).filter(~F.isnan(value)).groupBy(KEY).agg(
        F.kll_sketch_agg_double(value, F.lit(SKETCH_SIZE)).alias("__sketch"), F.max("__rows").alias("__rows"))
    used = F.transform(F.sequence(F.lit(1).cast("long"), own - 1), lambda i: F.element_at("__every", F.floor(
        i * ranks / own).cast("int")))
    cuts = cut_lineage(sketched.select(KEY, "__rows", every.alias("__every")).select(
        KEY, F.array_distinct(used).alias("__cuts")))
    below = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda cut: cut < value))
    return tagged.join(F.broadcast(cuts), KEY, "left").withColumn(name, below).drop("__cuts", KEY)


def add_time_bucket(rows: DataFrame, keys: Sequence[str], ts: str, seconds: float, rows_per_bucket: int = 2_000_000) -> DataFrame:
    """Add ``BUCKET``, which never decreases along the time of a key: a time slice, and within a slice
    that holds a burst of more than ``rows_per_bucket`` rows of one key, a part between cut points of
    that burst's own times. Rows of one microsecond stay together. One pass counts the slices.
    """
    sliced = rows.withColumns({"__slice": time_bucket(ts, seconds), "__us": epoch_micros(ts)})
    parted = add_key_value_bucket(sliced, [*keys, "__slice"], "__us", "__part", rows_per_bucket)
    return parted.withColumn(BUCKET, F.struct("__slice", "__part")).drop("__slice", "__us", "__part")


def explode_range(rows: DataFrame, first: Column, last: Column, name: str, span: int = 65_536) -> DataFrame:
    """One row per integer from ``first`` to ``last``, none if ``last`` is smaller or a bound is NULL.

    Ranges are cut into spans, the spans dealt over tasks, and only then expanded, so that no row
    holds an array longer than a span (or than the number of spans) and a long range is no single task.
    """
    bounds = cut_lineage(rows.withColumns({"__from": first.cast("long"), "__to": last.cast("long")}).filter(
        "__to >= __from"))
    spans = F.floor((F.col("__to") - F.col("__from")) / span)
    total = bounds.agg(F.coalesce(F.sum(spans + 1), F.lit(0))).first()[0]
    cut = bounds.withColumn("__span", F.explode(F.sequence(F.lit(0).cast("long"), spans)))
    if total > SPANS_PER_TASK:
        cut = cut.repartition(min(-(-total // SPANS_PER_TASK), MOST_SPAN_TASKS), *rows.columns, "__span")
    begin = F.col("__from") + F.col("__span") * span
    return cut.withColumn(name, F.explode(F.sequence(begin, F.least(F.col("__to"), begin + (span - 1))))).drop(
        "__from", "__to", "__span")


def grouped_percentiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    rows_per_bucket: int = 2_000_000,
) -> DataFrame:
    """F3. Exact linear-interpolated percentiles per key without buffering a group in one task.

    The counts per distinct value are written once, since ranks, sizes and cut points all read them;
    so are the sizes, which lets the adaptive join split a hot key.
    """
    counts = cut_lineage(rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n")))
    ranked = running_totals(
        add_key_value_bucket(counts, keys, value, rows_per_bucket=rows_per_bucket), keys, [F.col(value)], F.col("__vb"),
        {"__cum": F.col("__n")}
    ).withColumn(KEY, group_key(keys))
    sizes = cut_lineage(counts.groupBy(group_key(keys).alias(KEY)).agg(F.sum("__n").alias("__size")))
    placed = ranked.join(sizes, KEY)

    def at(position: Column) -> Column:
        hit = (F.col("__cum") > position) & (F.col("__cum") - F.col("__n") <= position)
        return F.max(F.when(hit, F.col(value).cast("double")))

    picks = []
    for name, p in probabilities.items():
        place = (F.col("__size") - 1) * F.lit(float(p))
        picks += [
            at(F.floor(place)).alias(f"__lo_{name}"),
            at(F.ceil(place)).alias(f"__hi_{name}"),
            F.max(place - F.floor(place)).alias(f"__w_{name}"),
        ]
    found = placed.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__w_{n}")).alias(n)
            for n in probabilities
        ],
    )
