"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import as_bytes, fold, table
from packetloom.llm.wordbytes import blank_mask, hash_words, pieces, word_spans

WORD_BUCKETS = 4096
BINS = 24
STRUCTURE = ("words", "word_length", "upper", "symbols", "digits", "repeats", "distinct", "line_length", "bars", "top_word",
             "ends_in_symbol", "high_bytes", "n_chars")
SIZE = WORD_BUCKETS + BINS * len(STRUCTURE)
FEATURES = "struct<at:array<int>,value:array<float>>"


def _log_bin(x: float) -> int:
    return int(min(BINS - 1, np.log2(1.0 + max(0.0, x))))


def _share_bin(part: float, whole: float) -> int:
    """Shares up to 1 on a root scale, so that small ones are told apart."""
    return int(min(BINS - 1, np.sqrt(part / whole) * (BINS - 1))) if whole else 0


def features(data: bytes | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of one text's sparse vector; every byte of the text is read.

    Words: log-damped counts by bucket, scaled to unit length. Structure and the ``n_chars``
    column: one position of value 1 for the bin of each statistic (bin 0 where it is NULL).
    """
    data = data or b""
    upper = symbols = digits = bars = high = lines = ends_odd = 0
    hashes = []
    for piece in pieces(data):
        raw = np.frombuffer(piece, np.uint8)
        starts, ends = word_spans(raw)
        hashes.append(hash_words(raw, starts, ends))
        count = np.bincount(raw, minlength=256)
        upper += count[65:91].sum()
        digits += count[48:58].sum()
        high += count[128:].sum()
        bars += count[124]
        lines += count[10]
        symbols += count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
        last = raw[ends - 1]
        ends_odd += int(((last == 33) | (last >= 35) & (last <= 38) | (last == 42) | (last == 124)).sum())
    words = np.concatenate(hashes)
    n = len(words)
    kinds, counts = np.unique(words, return_counts=True)
    repeats = int((words[1:] == words[:-1]).sum())
    size = len(data)
    bins = (_log_bin(n), _log_bin(size / n if n else 0), _share_bin(upper, size), _share_bin(symbols, size),
            _share_bin(digits, size), _share_bin(repeats, n), _share_bin(len(kinds), n), _log_bin(n / (lines + 1)),
            _share_bin(bars, size), _share_bin(counts.max() if n else 0, n), _share_bin(ends_odd, n), _share_bin(high, size),
            0 if n_chars is None else 1 + min(BINS - 2, _log_bin(n_chars)))
    total = np.bincount((kinds & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), weights=counts, minlength=WORD_BUCKETS)
    at = np.flatnonzero(total)
    value = np.log1p(total[at])
    value /= np.linalg.norm(value) if n else 1.0
    extra = WORD_BUCKETS + BINS * np.arange(len(bins)) + np.array(bins)
    return np.concatenate([at, extra]), np.concatenate([value, np.ones(len(bins))]).astype(np.float32)


@dataclass
class FactorisationMachine:
    """score = sigmoid(b + sum w x + (sum_f (sum_i v x)^2 - sum_i (v x)^2) / 2)."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, at: np.ndarray, value: np.ndarray) -> float:
        scaled = self.factors[at] * value[:, None]
        total = scaled.sum(axis=0)
        return float(self.bias + self.weights[at] @ value + 0.5 * (total @ total - (scaled * scaled).sum()))

    def score(self, data: bytes | None, n_chars: int | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.margin(*features(data, n_chars)), -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], rank: int = 8, epochs: int = 8, rate: float = 0.1,
          penalty: float = 1e-5, seed: int = 11) -> FactorisationMachine:
    """Adaptive gradient descent on the log loss, both classes of equal total weight.

    Without rows, or with one class only, the weights stay near 0 and scores near 0.5.
    """
    rng = np.random.default_rng(seed)
    model = FactorisationMachine(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, rank)))
    ones = sum(y for _, _, y in rows)
    if not rows or ones in (0, len(rows)):
        return model
    weight = {1: len(rows) / (2 * ones), 0: len(rows) / (2 * (len(rows) - ones))}
    seen_b, seen_w, seen_v = 1e-6, np.full(SIZE, 1e-6), np.full((SIZE, rank), 1e-6)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            scaled = model.factors[at] * x[:, None]
            total = scaled.sum(axis=0)
            margin = model.bias + model.weights[at] @ x + 0.5 * (total @ total - (scaled * scaled).sum())
            slope = weight[y] * (1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - y)
            seen_b += slope * slope
            model.bias -= rate * slope / np.sqrt(seen_b)
            grad = slope * x + penalty * model.weights[at]
            seen_w[at] += grad * grad
            model.weights[at] -= rate * grad / np.sqrt(seen_w[at])
            grad = slope * x[:, None] * (total[None, :] - scaled) + penalty * model.factors[at]
            seen_v[at] += grad * grad
            model.factors[at] -= 0.5 * rate * grad / np.sqrt(seen_v[at])
    return model


def labelled_sample(labels: DataFrame, per_class: int = 2500, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, label) of at most ``per_class`` rows of each class, chosen by hash of the id.

    Ids with two different labels, NULL ids and labels other than 0 and 1 teach nothing.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(
        F.col("id").isNotNull() & F.col("label").isin(0, 1)).groupBy("id").agg(
        F.min("label").alias("label"), F.max("label").alias("other")).filter(F.col("label") == F.col("other")).drop("other")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30))
    parts = [known.filter((F.col("label") == y) & (place < int((1 << 30) * min(1.0, 1.5 * per_class / max(1, counts.get(y, 0))))))
             .orderBy(place, "id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500, id_col: str = "doc_id", text_col: str = "text",
        chars_col: str = "n_chars") -> FactorisationMachine:
    """Train on a bounded sample of labelled rows: at most ``per_class`` documents of each class.

    The sample (id, label) is bounded and so may be broadcast; the tasks send sparse vectors of at
    most SIZE positions, never texts.
    """

    @F.arrow_udf(FEATURES)
    def vectors(text: pa.Array, n_chars: pa.Array) -> pa.Array:
        found = [features(t, n) for t, n in zip(as_bytes(text), n_chars.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.list_(pa.int32())),
                                           pa.array([f[1] for f in found], pa.list_(pa.float32()))], ["at", "value"])

    chars = F.col(chars_col).cast("long") if chars_col in docs.columns else F.lit(None).cast("long")
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), chars.alias("n"))
            .join(F.broadcast(labelled_sample(labels, per_class, id_col)), "id")
            .select("id", "label", vectors("text", "n").alias("f")).limit(4 * per_class).collect())
    rows = sorted(rows, key=lambda r: (r["id"], r["label"], r["f"]["at"]))
    return train([(np.array(r["f"]["at"]), np.array(r["f"]["value"], np.float32), r["label"]) for r in rows])


def scorer(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", chars_col: str = "n_chars") -> Column:
    """Score column: 0 to 1, higher where label 1 is likelier. NULL and empty texts are scored like any other."""
    model = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array, n_chars: pa.Array) -> pa.Array:
        fm = model.value
        return pa.array([fm.score(t, n) for t, n in zip(as_bytes(text), n_chars.to_pylist(), strict=True)], pa.float64())

    chars = F.col(chars_col).cast("long") if chars_col in docs.columns else F.lit(None).cast("long")
    return score(F.col(text_col), chars)


def quality(docs: DataFrame, labels: DataFrame, parts: int = 5, id_col: str = "doc_id", text_col: str = "text",
            cut: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    Labels of ids with crc32 modulo ``parts`` equal to 0 are held out of the training. A NULL id is
    not held out; repeated rows get equal scores; further columns are not read.
    """
    model = fit(docs, labels.filter(fold(id_col, parts) != 0), id_col=id_col, text_col=text_col)
    return docs.select(F.col(id_col), F.coalesce(fold(id_col, parts) == 0, F.lit(False)).alias("held_out"),
                       scorer(docs, model, text_col).alias("score")).withColumn(
        "predicted", (F.col("score") >= cut).cast("int"))


def op9_quality_classifier(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
