"""Data-quality audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.labels import LABEL_FAMILY, LABEL_STAGES, attack_family, map_label
from packetloom.functions.numeric import is_finite
from packetloom.operators.ordered import BUCKET, beside

MIN_TRAIN_ROWS, MIN_TEST_ROWS = 50, 30


def file_audit(rows: DataFrame, file: str = "source_file", text: str = "line", width: str = "width", label: str = "raw_label",
               parsed: str = "parsed", expected_width: int = 80) -> DataFrame:
    """Q1. Row, defect and timestamp counts per file."""
    return rows.groupBy(file).agg(
        F.count("*").alias("rows"), F.count_if(F.col(width) != expected_width).alias("malformed"),
        F.count_if(F.trim(label) == "Label").alias("repeated_headers"),
        F.sum(F.length(text) - F.length(F.regexp_replace(text, "�", ""))).alias("replacement_characters"),
        F.count_if(F.col(parsed).isNull()).alias("invalid_timestamps"),
        F.min(parsed).alias("earliest"), F.max(parsed).alias("latest"))


def blank_cells(rows: DataFrame, columns: Sequence[str], file: str = "source_file", width: str | None = None,
                expected_width: int = 80) -> DataFrame:
    """Q1. Blank cells (NULL, empty or white space only) as rows (file, column, blanks), without zeros.

    With ``width``, rows of another width than expected are left out: their cells have no sure column.
    """
    sound = rows if width is None else rows.filter(F.col(width) == expected_width)
    blank = {c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")).rlike(r"^\s*$")).alias(c) for c in columns}
    return sound.groupBy(file).agg(*blank.values()).unpivot([file], list(columns), "column", "blanks").filter("blanks > 0")


def audit_histograms(rows: DataFrame, file: str = "source_file", width: str = "width", label: str = "raw_label",
                     parsed: str = "parsed") -> DataFrame:
    """Q1. Width, year and label histograms per file, as (file, kind, value, n)."""
    facts = F.array(
        F.struct(F.lit("width").alias("kind"), F.col(width).cast("string").alias("value")),
        F.struct(F.lit("year").alias("kind"), F.year(parsed).cast("string").alias("value")),
        F.struct(F.lit("label").alias("kind"), F.trim(label).alias("value")))
    return rows.select(file, F.explode(facts).alias("f")).filter("f.value IS NOT NULL").groupBy(
        file, F.col("f.kind").alias("kind"), F.col("f.value").alias("value")).agg(F.count("*").alias("n"))


def numeric_quality(rows: DataFrame, columns: Sequence[str], file: str = "source_file") -> DataFrame:
    """Q2 + Q3. Missing, invalid, infinite and finite range per text column, and the files that have it."""
    long = rows.select(file, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [file], list(columns), "feature", "raw")
    text = F.trim("raw")
    missing = text.isNull() | (text == "")
    number = text.try_cast("double")
    parsed = long.withColumns({"__missing": missing, "__n": number})
    n, bad = F.col("__n"), ~F.col("__missing") & (F.col("__n").isNull() | F.isnan("__n"))
    infinity = F.lit(float("inf"))
    per_file = parsed.groupBy("feature", file).agg(
        F.count_if("__missing").alias("missing_count"), F.count_if(bad).alias("invalid_count"),
        F.count_if(n == infinity).alias("positive_infinity_count"), F.count_if(n == -infinity).alias("negative_infinity_count"),
        F.min(F.when(is_finite(n), n)).alias("finite_minimum"), F.max(F.when(is_finite(n), n)).alias("finite_maximum"))
    counts = [c for c in per_file.columns if c.endswith("_count")]
    return per_file.groupBy("feature").agg(
        F.count("*").alias("files_present"), *[F.sum(c).alias(c) for c in counts],
        F.min("finite_minimum").alias("finite_minimum"), F.max("finite_maximum").alias("finite_maximum"))


def label_distribution(rows: DataFrame, raw: str = "raw_label", normal: str = "label", file: str = "source_file",
                       ts: str = "timestamp") -> DataFrame:
    """Q4. Count, share of all rows, files and time range per label spelling."""
    counts = rows.groupBy(F.col(raw).alias("raw_label"), F.col(normal).alias("normalized_label")).agg(
        F.count("*").alias("flow_count"), F.array_join(F.sort_array(F.collect_set(file)), "; ").alias("files"),
        F.min(ts).alias("first_timestamp"), F.max(ts).alias("last_timestamp"))
    total = F.sum("flow_count").over(Window.partitionBy())  # one row per label spelling
    return counts.withColumn("percentage", F.round(F.col("flow_count") * 100 / total, 8))


def label_files(rows: DataFrame, raw: str = "raw_label", normal: str = "label", file: str = "source_file",
                ts: str = "timestamp") -> DataFrame:
    """Q4. One row per label spelling and file, so that no cell grows with the number of files."""
    return rows.groupBy(F.col(raw).alias("raw_label"), F.col(normal).alias("normalized_label"), F.col(file).alias("file")).agg(
        F.count("*").alias("flow_count"), F.min(ts).alias("first_timestamp"), F.max(ts).alias("last_timestamp"))


def label_report(distribution: DataFrame, n: int | None = None) -> DataFrame:
    """T8. Most frequent label first, ties by name."""
    ordered = distribution.orderBy(F.desc("flow_count"), "raw_label")
    return ordered if n is None else ordered.limit(n)


def attack_timeline(rows: DataFrame, label: str = "label", raw: str = "raw_label", file: str = "source_file",
                    ts: str = "timestamp") -> DataFrame:
    """Q5. First, last, duration and count of each attack per file."""
    seconds = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1_000_000
    return rows.filter(~F.col(label).isin("", "Benign", "Label")).groupBy(file, label).agg(
        F.array_join(F.sort_array(F.collect_set(raw)), "; ").alias("raw_labels"), F.min(ts).alias("first_timestamp"),
        F.max(ts).alias("last_timestamp"), seconds.alias("duration_seconds"), F.count("*").alias("flow_count"))


def out_of_order(rows: DataFrame, file: str = "source_file", row_number: str = "row_number", ts: str = "parsed",
                 block: int = 100_000) -> DataFrame:
    """W17. Flag rows whose time lies before the last valid one in file order.

    Rows are compared inside blocks of row numbers; only each block's last valid time crosses over.
    """
    tagged = rows.withColumn(BUCKET, F.floor(F.col(row_number) / block))
    at = F.when(F.col(ts).isNotNull(), F.struct(row_number))
    ends = tagged.groupBy(file, BUCKET).agg(F.max_by(ts, at).alias("__end"))
    before = Window.partitionBy(file).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(file, BUCKET, F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    inside = Window.partitionBy(file, BUCKET).orderBy(row_number).rowsBetween(Window.unboundedPreceding, -1)
    previous = F.coalesce(F.last(ts, ignorenulls=True).over(inside), F.col("__carry"))
    return tagged.join(carried, [file, BUCKET]).withColumn(
        "out_of_order", F.coalesce(F.col(ts) < previous, F.lit(False))).drop(BUCKET, "__carry")


def order_report(flagged: DataFrame, file: str = "source_file", ts: str = "parsed") -> DataFrame:
    """Q6. Time range, disorder and validity per file."""
    report = flagged.groupBy(file).agg(
        F.min(ts).alias("earliest_timestamp"), F.max(ts).alias("latest_timestamp"),
        F.count_if("out_of_order").alias("out_of_order_row_count"),
        F.round(F.count_if("out_of_order") * 100 / F.count("*"), 8).alias("out_of_order_percentage"),
        F.count_if(F.col(ts).isNull()).alias("invalid_timestamp_count"))
    clean = (F.col("out_of_order_row_count") == 0) & (F.col("invalid_timestamp_count") == 0)
    return report.withColumn("chronologically_ordered", F.when(clean, "YES").otherwise("NO"))


def epoch_rows(rows: DataFrame, ts: str = "parsed") -> DataFrame:
    """Q7. Rows dated 1970."""
    return rows.filter(F.year(ts) == 1970)


def feature_quality(states: DataFrame, features: Sequence[str]) -> DataFrame:
    """Q8. Range, mean, dominant value and distinct count per feature; the smallest value wins ties.

    Values are counted per (feature, value) before anything is compared, so a constant feature
    shrinks to one row map-side.
    """
    long = states.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot([], list(features), "feature", "value")
    counts = long.filter(is_finite(F.col("value"))).groupBy("feature", "value").agg(F.count("*").alias("n"))
    top = F.struct("n", -F.col("value"))
    stats = counts.groupBy("feature").agg(
        F.sum("n").alias("sample_count"), F.min("value").alias("finite_minimum"), F.max("value").alias("finite_maximum"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("finite_mean"), F.max_by("value", top).alias("dominant_value"),
        F.max("n").alias("__top"), F.count("*").alias("distinct_values"))
    share = F.col("__top") * 100 / F.col("sample_count")
    return stats.withColumns({
        "constant": (F.col("finite_minimum") == F.col("finite_maximum")).cast("int"),
        "near_constant_99_5_percent": (share >= 99.5).cast("int"), "dominant_percentage": F.round(share, 8),
        "extremely_large_abs_value": (F.greatest(F.abs("finite_minimum"), F.abs("finite_maximum")) >= 1e12).cast("int"),
    }).drop("__top")


def temporal_invariants(labelled: DataFrame, features: Sequence[str], source: str = "source_file", window_seconds: int = 10,
                        history: int = 6, horizon: int = 6) -> DataFrame:
    """Q9. Per source: unique contiguous windows, no 1970, one day, finite features, labels and eligibility recomputed."""
    from packetloom.operators.dataset import split_for
    from packetloom.operators.ordered import epoch_micros, owned_rows, with_halo

    spread, order = with_halo(labelled, [source], "window_index", 1, horizon)
    step = epoch_micros("window_start") - epoch_micros(F.lag("window_start").over(order))
    checked = owned_rows(spread.withColumns({
        "__step": step,
        "__future": F.coalesce(F.max("current_attack").over(order.rowsBetween(1, horizon)), F.lit(0))}))
    index, count = F.col("window_index"), F.col("window_count")
    eligible = (index >= history - 1) & (index + horizon < count) & (
        split_for(index - (history - 1), count) == split_for(index + horizon, count))
    finite = F.forall(F.array(*[F.col(c).cast("double") for c in features]), lambda v: is_finite(v))
    return checked.groupBy(source).agg(
        F.bool_and(F.coalesce(F.col("__step") == window_seconds * 1_000_000, F.lit(True))).alias("sorted_unique"),
        F.bool_and(F.year("window_start") != 1970).alias("no_1970"),
        (F.min(F.to_date("window_start")) == F.max(F.to_date("window_start"))).alias("single_day"),
        F.bool_and(finite).alias("all_finite"),
        F.bool_and(F.col("__future") == F.col("future_attack_within_horizon")).alias("future_label_matches"),
        F.bool_and(eligible == F.col("forecast_sample_eligible")).alias("eligibility_matches"))


def state_hash(features: Sequence[str]) -> Column:
    """Q10. SHA-256 of the joined feature values."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in features]), 256)


def duplicate_count(rows: DataFrame, digest: Column) -> DataFrame:
    """Q10. Rows beyond the first of each digest."""
    return rows.groupBy(digest.alias("digest")).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count("*").alias("distinct_rows"))


def split_leakage(samples: DataFrame, keys: Sequence[str], split: str = "split") -> DataFrame:
    """Q11. Number of keys found in more than one split."""
    return samples.groupBy(*keys).agg(F.count_distinct(split).alias("n")).agg(F.count_if(F.col("n") > 1).alias("leaking_keys"))


def label_mismatches(samples: DataFrame, label: str = "future_attack_within_horizon", step: str = "future_attack_step") -> DataFrame:
    """Q12. Samples whose label contradicts the first attack step."""
    return samples.agg(F.count_if((F.col(label) == 1) != (F.col(step) > 0)).alias("mismatches"))


def duplicate_sequences(train: DataFrame, test: DataFrame, sequence: str = "x") -> DataFrame:
    """J12. Test sequences also seen in training, split into all-zero idle ones and others."""
    digest = F.sha2(F.to_json(F.col(sequence)), 256)
    seen = train.select(digest.alias("__d")).distinct()
    zero = ~F.exists(F.flatten(F.col(sequence)), lambda v: v != 0)
    shared = test.select(digest.alias("__d"), zero.alias("__zero")).join(seen, "__d", "left_semi")
    return shared.agg(F.count("*").alias("duplicates"), F.count_if("__zero").alias("all_zero"),
                      F.count_if(~F.col("__zero")).alias("non_zero"))


def holdout_leakage(sequences: DataFrame, held_out: Sequence[str], features: int, source: str = "source_file",
                    split: str = "split") -> DataFrame:
    """Q15. Exclusion, changed scaling, duplicates, finiteness and feature count of a held-out family split."""
    from packetloom.operators.scores import family_holdout

    kept = family_holdout(sequences, held_out, source, split)
    train = kept.filter(F.col(split) == "train")
    everything = sequences.filter(F.col(split) == "train")

    def moments(rows, name):
        return rows.select(F.explode("x").alias("v")).select(F.posexplode("v").alias("f", "v")).groupBy("f").agg(
            F.avg("v").alias(name))

    moved = moments(train, "a").join(moments(everything, "b"), "f").agg(
        F.bool_or(F.abs(F.col("a") - F.col("b")) > 1e-9).alias("scaler_differs"))
    excluded = sequences.filter((F.col(split) != "test") & F.col(source).isin(*held_out)).agg(
        F.count("*").alias("excluded_rows"))
    leftover = kept.filter((F.col(split) != "test") & F.col(source).isin(*held_out)).agg(F.count("*").alias("leftover_rows"))
    shape = kept.agg(
        F.bool_and(F.forall(F.flatten("x"), lambda v: is_finite(v))).alias("all_finite"),
        F.bool_and(F.size(F.get("x", F.lit(0))) == features).alias("feature_count_matches"))
    result = duplicate_sequences(train, kept.filter(F.col(split) == "test"))
    for other in (excluded, leftover, moved, shape):
        result = beside(result, other)
    return result


def step_target_mismatches(sequences: DataFrame) -> DataFrame:
    """Q16. Steps where the attack target and a non-benign stage disagree."""
    steps = F.arrays_zip(F.col("attack_steps").alias("a"), F.col("stage_steps").alias("s"))
    wrong = F.size(F.filter(steps, lambda z: (z["a"] == 1) != (z["s"] != 0)))
    return sequences.agg(F.count("*").alias("samples"), F.coalesce(F.sum(wrong), F.lit(0)).alias("mismatching_steps"))


def family_split_table(labelled: DataFrame, types: str = "current_attack_types", source: str = "source_file") -> DataFrame:
    """A30. Eligible windows per family and split, with the raw labels and sources of the family.

    Labels and sources number in the dozens, so the sets stay small.
    """
    each = labelled.select(source, "split", "forecast_sample_eligible", F.explode(types).alias("raw_label")).withColumn(
        "family", F.coalesce(attack_family(F.col("raw_label")), F.lit("UNMAPPED")))
    eligible = F.col("forecast_sample_eligible")
    return each.groupBy("family").agg(
        *[F.count_if(eligible & (F.col("split") == s)).alias(s) for s in ("train", "validation", "test")],
        F.sort_array(F.collect_set(F.when(eligible, F.col("raw_label")))).alias("raw_labels"),
        F.sort_array(F.collect_set(source)).alias("sources")).withColumn(
        "total", F.col("train") + F.col("validation") + F.col("test"))


def label_split_pivot(labelled: DataFrame, types: str = "current_attack_types") -> DataFrame:
    """A30. Eligible windows per raw label, one column per split."""
    return labelled.filter("forecast_sample_eligible").select("split", F.explode(types).alias("raw_label")).groupBy(
        "raw_label").pivot("split", ["train", "validation", "test"]).count().na.fill(0)


def family_suitability(families: DataFrame) -> DataFrame:
    """Q13. Whether a family can be held out."""
    several = F.size("raw_labels") > 1
    return families.withColumns({
        "suitability": F.when(F.col("train") < MIN_TRAIN_ROWS, "UNSUITABLE").when(F.col("test") < MIN_TEST_ROWS, "UNSUITABLE")
        .when(several, "MARGINAL").otherwise("SUITABLE"),
        "one_source": F.size("sources") == 1})


def sources_with_several_families(labelled: DataFrame, types: str = "current_attack_types", source: str = "source_file") -> DataFrame:
    """Q13. Sources that break the one-family-per-source rule."""
    each = labelled.select(source, F.explode(types).alias("t")).select(
        source, F.coalesce(attack_family(F.col("t")), F.concat(F.lit("UNMAPPED:"), F.col("t"))).alias("family"))
    return each.groupBy(source).agg(F.count_distinct("family").alias("families")).filter("families > 1")


def mapping_audit(labels: DataFrame, label: str = "label") -> DataFrame:
    """Q14. The stage mapping of every distinct label, and whether it is an exact entry."""
    from packetloom.functions.labels import normalized_label

    hit = map_label(F.col(label))
    known = normalized_label(F.col(label)).isin([key for key, *_ in LABEL_STAGES])
    return labels.select(label).distinct().withColumn("__h", hit).select(
        label, "__h.stage", "__h.stage_name", "__h.confidence", "__h.technique", "__h.evidence_type", known.alias("exact"))


def schema_report(headers: DataFrame, file: str = "file", columns: str = "columns") -> DataFrame:
    """U5. Per file: columns beyond those common to all files, and columns of the union it lacks."""
    pairs = headers.select(file, F.explode(columns).alias("column")).distinct()
    files = headers.select(file).distinct()
    spread = pairs.groupBy("column").agg(F.count("*").alias("n"))
    extra = beside(pairs.join(spread, "column"), files.agg(F.count("*").alias("__files"))).groupBy(file).agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("n") < F.col("__files"), F.col("column")))), "; ").alias("extra"),
        F.count("*").alias("column_count"))
    # Headers hold some hundred column names, so the union travels as one array.
    union = spread.agg(F.sort_array(F.collect_list("column")).alias("__union"))
    own = headers.select(file, F.col(columns).alias("__own"))
    missing = beside(own, union).select(file, F.array_join(F.array_except("__union", "__own"), "; ").alias("missing"))
    return extra.join(missing, file)


def schema_groups(headers: DataFrame, file: str = "file", columns: str = "columns") -> DataFrame:
    """U6. Files sharing an identical header."""
    return headers.groupBy(F.array_join(columns, ",").alias("header")).agg(
        F.array_join(F.sort_array(F.collect_list(file)), "; ").alias("files"), F.count("*").alias("file_count"))
