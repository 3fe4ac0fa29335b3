"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import as_bytes, fold, table

BUCKETS = 8192
GRAMS = (2, 3, 4)
_STRIP = 1 << 18
UNKNOWN = "und"
# Bytes of letters stay; all others are one blank. Bytes above 127 belong to letters of other scripts.
_LETTERS = np.full(256, 32, np.uint32)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def subword_counts(lowered: bytes) -> np.ndarray:
    """How often each bucket is hit by the byte n-grams of the words, with their borders, of a whole text."""
    counts = np.zeros(BUCKETS, np.int64)
    raw = np.frombuffer(lowered, np.uint8)
    reach = max(GRAMS) - 1
    for begin in range(0, len(raw), _STRIP):
        back = min(begin, reach)  # grams that end in this strip may start before it
        part = _LETTERS[raw[begin - back:begin + _STRIP]]
        blank = part == 32
        for n in GRAMS:
            lead = max(0, back - n + 1)
            size = len(part) - lead - n + 1
            if size <= 0:
                continue
            code = np.full(size, n, np.uint32)
            inner = np.zeros(size, bool)
            for k in range(n):
                code = code * np.uint32(0x01000193) ^ part[lead + k:lead + k + size]
                if 0 < k < n - 1:
                    inner |= blank[lead + k:lead + k + size]
            if n == 2:
                inner = blank[lead:lead + size] & blank[lead + 1:lead + 1 + size]
            code ^= code >> np.uint32(15)
            code *= np.uint32(0x2C1B3C6D)
            counts += np.bincount((code[~inner] >> np.uint32(19)).astype(np.int64), minlength=BUCKETS)
    return counts


@dataclass
class LanguageModel:
    """Softmax of (mean embedding of the subwords) x weights + bias, at a calibrated temperature."""

    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0

    def chances(self, counts: np.ndarray) -> np.ndarray:
        """Rows of counts to rows of probabilities."""
        mean = counts @ self.embeddings / np.maximum(1, counts.sum(axis=1, keepdims=True))
        logits = (mean @ self.weights + self.bias) / self.temperature
        shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
        return shifted / shifted.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], dim: int = 16, steps: int = 1500, batch: int = 16, rate: float = 2.0,
          rejected: float = 0.01, seed: int = 5) -> LanguageModel:
    """Stochastic gradient descent over (bucket, count, language) rows, then calibration on every fifth row.

    The temperature minimises the log loss of the held-back rows; the score below which a
    prediction is rejected loses the share ``rejected`` of their right predictions.
    """
    languages = sorted({lang for _, _, lang in rows}) or [UNKNOWN]
    place = {lang: k for k, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    model = LanguageModel(languages, rng.normal(0, 0.1, (BUCKETS, dim)), rng.normal(0, 0.1, (dim, len(languages))),
                          np.zeros(len(languages)))
    if not rows:
        return model
    held = [k for k in range(len(rows)) if k % 5 == 4] or list(range(len(rows)))
    fitted = [k for k in range(len(rows)) if k % 5 != 4]

    def dense(some) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(some), BUCKETS))
        for k, at in enumerate(some):
            x[k, rows[at][0]] = rows[at][1]
        return x / np.maximum(1, x.sum(axis=1, keepdims=True)), np.array([place[rows[at][2]] for at in some])

    epochs = max(1, math.ceil(steps * batch / max(1, len(fitted))))  # as many steps whatever the number of rows
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(fitted)
        for begin in range(0, len(order), batch):
            x, y = dense(order[begin:begin + batch])
            slope = model.chances(x)
            slope[np.arange(len(y)), y] -= 1
            slope /= len(y)
            mean = x @ model.embeddings
            back = slope @ model.weights.T
            model.weights -= step * mean.T @ slope
            model.bias -= step * slope.sum(axis=0)
            model.embeddings -= 20 * step * x.T @ back
    parts = [dense(held[k:k + 256]) for k in range(0, len(held), 256)]
    truth = np.concatenate([y for _, y in parts])

    def held_back() -> np.ndarray:
        return np.concatenate([model.chances(x) for x, _ in parts])

    losses = []
    for t in np.geomspace(0.1, 10, 41):
        model.temperature = t
        losses.append((-np.log(np.maximum(1e-12, held_back()[np.arange(len(truth)), truth])).mean(), t))
    model.temperature = min(losses)[1]
    chance = held_back()
    right = chance.argmax(axis=1) == truth
    model.least_score = float(np.quantile(chance.max(axis=1)[right], rejected)) if right.any() else 0.0
    return model


def fit(docs: DataFrame, per_language: int = 600, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> LanguageModel:
    """Train on a bounded sample: about ``per_language`` rows (at most twice that) of each language, by hash of the id.

    The tasks send sparse counts of at most BUCKETS positions, never texts. Rows without
    language or text teach nothing.
    """

    @F.arrow_udf("struct<at:array<int>,n:array<int>>")
    def counted(text: pa.Array) -> pa.Array:
        found = [subword_counts(t) for t in as_bytes(pc.utf8_lower(text))]
        at = [np.flatnonzero(c) for c in found]
        return pa.StructArray.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(
            [c[a] for c, a in zip(found, at, strict=True)], pa.list_(pa.int32()))], ["at", "n"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return train([])
    scale = 1 << 30
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(scale * min(1.0, per_language / n)))])
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(scale)) < rate[F.col("lang")])
    taken = drawn.select("id", "lang", counted("text").alias("c")).limit(2 * per_language * len(counts)).collect()
    taken = sorted(taken, key=lambda r: (str(r["id"]), r["lang"], r["c"]["at"]))
    return train([(np.array(r["c"]["at"], np.int64), np.array(r["c"]["n"]), r["lang"]) for r in taken])


def predictor(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> Column:
    """struct(lang, score, rejected) from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def predict(text: pa.Array) -> pa.Array:
        known = shared.value
        best, scores = [], []
        for data in as_bytes(pc.utf8_lower(text)):
            chance = known.chances(subword_counts(data or b"")[None, :])[0]
            k = int(chance.argmax())
            best.append(known.languages[k])
            scores.append(float(chance[k]))
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(scores, pa.float64()), pa.array(
            [s < known.least_score for s in scores], pa.bool_())], ["lang", "score", "rejected"])

    return predict(F.col(text_col))


def language_id(docs: DataFrame, parts: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) of every row; ids with crc32 modulo ``parts`` equal to ``held`` teach nothing.

    Texts that are NULL, empty or hold no letter are ``und`` with score 0 and rejected. With no
    labelled row at all every text is ``und``. A NULL id is not held out and teaches nothing;
    repeated rows get equal results; further columns are not read.
    """
    model = fit(docs.filter(fold(id_col, parts) != held), id_col=id_col, text_col=text_col, lang_col=lang_col)
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col), F.coalesce(fold(id_col, parts) == held, F.lit(False)).alias("held_out"),
                       lettered.alias("lettered"), predictor(docs, model, text_col).alias("p"))
    return rows.select(id_col, "held_out", F.when(F.col("lettered"), F.col("p.lang")).otherwise(UNKNOWN).alias("lang_pred"),
                       F.when(F.col("lettered"), F.col("p.score")).otherwise(0.0).alias("score"),
                       (~F.col("lettered") | F.col("p.rejected")).alias("rejected"))


def op1_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))
