"""N-gram Jaccard self-join: a MinHash LSH forest, then exact verification in bounded blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import as_bytes, batches_of_groups, components, local_roots, stored, table
from packetloom.llm.wordbytes import shingle_set, word_hashes

WIDTH, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 32, 8, 0.999
BLOCK = 128
_ROWS = 1 << 12
_STRIP = 1 << 9


def matched_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """Prefix length of the forest's tries: from the longest, shortened until the target recall.

    Two sets of similarity s share a prefix of d values in at least one of ``trees`` tries with
    probability 1 - (1 - s^d)^trees, which is least at the threshold.
    """
    for d in range(depth, 0, -1):
        if 1.0 - (1.0 - threshold ** d) ** trees >= recall:
            return d
    raise ValueError("no prefix reaches the target recall; use more trees")


@lru_cache(maxsize=4)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    factor = rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
    return factor[:, None], rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]


def labels(shingles: np.ndarray, trees: int, depth: int) -> bytes:
    """The forest labels of a set: ``trees`` labels of ``depth`` MinHash values of 16 bits each.

    A label is big-endian, so the prefix of d values is its first 2 d bytes and labels sort as in a trie.
    """
    factor, shift = _permutations(trees * depth)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(trees * depth, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(low), _STRIP):
        np.minimum(least, (low[None, begin:begin + _STRIP] * factor + shift).min(axis=1), out=least)
    scrambled = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return scrambled.astype(">u2").tobytes()


def content_key(data: bytes) -> bytes:
    """128-bit digest of the word sequence; blanks between words do not count."""
    return hashlib.blake2b(b" ".join(data.split()), digest_size=16).digest()


def _keyed(docs: DataFrame, id_col: str, text_col: str, trees: int, depth: int, width: int) -> DataFrame:
    """(id, h, key, label) of every row, h being a hash of the raw text; key and label are NULL where the text has no word."""

    @F.arrow_udf("struct<key:binary,label:binary>")
    def signature(text: pa.Array) -> pa.Array:
        keys, found, known = [], [], {}
        for data in as_bytes(text):
            words = word_hashes(data) if data else ()
            if len(words) == 0:
                keys.append(None)
                found.append(None)
                continue
            key = content_key(data)
            if key not in known:  # copies within a batch are hashed once
                known[key] = labels(shingle_set(words, width), trees, depth)
            keys.append(key)
            found.append(known[key])
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["key", "label"])

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), signature(F.col(text_col)).alias("s")).select("id", "h", "s.key", "s.label")


def _candidates(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(handle, component) of the classes that share a trie prefix with another, directly or by way of others.

    A handle is a 64-bit hash of a key; two classes with one handle are proposed together. Each trie is cut at ``depth``; nodes with one class go,
    the members of the others are tied to the node's least handle, never paired with each other.
    """
    size = 2 * depth
    at = classes.select("handle", F.explode(F.expr(
        f"transform(sequence(0, {trees - 1}), t -> xxhash64(t, substring(label, t * {size} + 1, {size})))")).alias("node"))
    shared = at.groupBy("node").agg(F.min("handle").alias("least"), F.max("handle").alias("most")).filter("least < most")
    ties = at.join(shared, "node").select(F.col("handle").alias("src"), F.col("least").alias("dst")).distinct()
    return components(ties).withColumnRenamed("node", "handle")


def _similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of exact Jaccard similarity of at least ``threshold``."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    kinds, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    common = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for begin in range(0, int((count > 1).sum()), _ROWS):  # a bounded slice of the vocabulary at a time
        lo, hi = np.searchsorted(column, [begin, begin + _ROWS])
        dense = np.zeros((len(sets), _ROWS), np.float32)
        dense[owner[lo:hi], column[lo:hi] - begin] = 1
        common += dense @ dense.T
    union = sizes[:, None] + sizes[None, :] - common
    return common >= threshold * union - 1e-9


def _verify(width: int, threshold: float):
    schema = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in batches_of_groups(batches, ["component", "first", "second"]):
            keys = group.column("key").to_pylist()
            order = sorted(range(len(keys)), key=keys.__getitem__)
            keys = [keys[k] for k in order]
            texts = group.column("text").cast(pa.binary()).to_pylist()
            weight = group.column("size").to_numpy()[order]
            block = group.column("block").to_numpy()[order]
            linked = _similar([shingle_set(word_hashes(texts[k]), width) for k in order], threshold)
            np.fill_diagonal(linked, False)
            first, second = group.column("first")[0].as_py(), group.column("second")[0].as_py()
            if first != second:  # pairs within one block belong to the task that holds that block alone
                linked &= block[:, None] != block[None, :]
            if not linked.any():
                continue
            root = local_roots(linked)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(linked @ weight, pa.int64()),
                                              pa.array([keys[r] for r in root], pa.binary())], schema=schema)

    return run


def _decisions(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float, trees: int, depth: int, recall: float,
               block: int) -> DataFrame:
    """(id, h, class_id, n_links, group_size, kept) of every row."""
    used = matched_depth(threshold, trees, depth, recall)
    rows = stored(_keyed(docs, id_col, text_col, trees, used, width))
    classes = stored(rows.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("id").alias("least"), F.count("*").alias("size"), F.first("label").alias("label"))
        .withColumn("handle", F.xxhash64("key")))
    tied = _candidates(classes, trees, used)
    members = stored(classes.select("key", "least", "size", "handle").join(tied, "handle").drop("handle"))
    totals = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # The text of each class comes from its row of least id; repeats of that row are removed below.
    chosen = members.join(totals, "component").withColumn("id", F.coalesce(F.col("least").cast("string"), F.lit("")))
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(chosen.select("id").distinct(), "id", "left_semi")
    key_of = F.arrow_udf(lambda text: pa.array([content_key(t) if t else None for t in as_bytes(text)], pa.binary()), "binary")
    found = found.withColumn("key", key_of("text")).groupBy("id", "key").agg(F.first("text").alias("text"))
    parts = (chosen.join(found, ["id", "key"])
             .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("component", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
                     "block", "key", "size", "text"))
    on = ["component", "first", "second"]
    links = stored(parts.repartition(*on).sortWithinPartitions(*on).mapInArrow(
        _verify(width, threshold), "key binary, links long, root binary"))
    roots = components(links.filter(F.col("key") != F.col("root")).select(F.col("key").alias("src"), F.col("root").alias("dst")))
    named = (classes.select("key", "least", "size")
             .join(links.groupBy("key").agg(F.sum("links").alias("links")), "key", "left")
             .join(roots.withColumnRenamed("node", "key"), "key", "left")
             .withColumn("component", F.coalesce("component", "key")))
    groups = named.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("size").alias("group_size"))
    result = named.join(groups, "component").select(
        "key", "class_id", "group_size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    joined = rows.select("id", "h", "key").join(result, "key", "left")
    lone = F.col("key").isNull()
    return joined.select(
        "id", "h", F.when(lone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (lone | F.col("id").eqNullSafe(F.col("class_id"))).alias("kept"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                 threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL,
                 block: int = BLOCK) -> DataFrame:
    """(id, class_id, n_links, group_size, kept) of every row.

    Texts of the same words are one class from the start. Classes whose sets of ``width``-word
    shingles have a Jaccard similarity of at least ``threshold`` are linked; n_links counts the
    linked documents with their copies, class_id is the least id reachable by links and
    ``group_size`` the documents reached, itself included. ``kept`` marks the row whose id is class_id.
    NULL texts and texts without a word link with nothing: class_id is their own id. A NULL id
    never becomes a class_id unless the whole group has no other. Rows that repeat id and text count as
    documents and share one result; further columns are not read.

    The forest only proposes: classes tied by a shared prefix are compared exactly, in tasks of at
    most two blocks of about ``block`` classes, which return counts and spanning links instead of pairs.
    """
    return _decisions(docs, id_col, text_col, width, threshold, trees, depth, recall, block).drop("h").withColumnRenamed("id", id_col)


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``jaccard_join`` keeps, with all their columns; a repeated row stays once.

    Rows without a word all stay.
    """
    on = ["name", "h"]
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("name")
    decided = _decisions(docs, id_col, text_col, WIDTH, THRESHOLD, TREES, DEPTH, RECALL, BLOCK)
    gone = decided.filter(~F.col("kept")).select(name("id"), "h").distinct()
    keyed = docs.select(F.struct("*").alias("row"), name(id_col), F.xxhash64(text_col).alias("h"))
    return keyed.groupBy(*on).agg(F.first("row").alias("row")).join(gone, on, "left_anti").select("row.*")


def op4_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))
