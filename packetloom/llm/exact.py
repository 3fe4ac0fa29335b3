"""Exact dedup: local combining, salted digest groups, then salt winners combined globally."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import BLANKS, stored, table


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.char_length(text).alias("length"),
                       F.regexp_replace(text, BLANKS, "").alias("content")).withColumn("digest", digest(F.col("content")))


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64,
            digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(digest, content, keep, size) of every distinct content.

    Each map task first combines its own copies; its one row per content goes to a salt chosen by
    the task, so a content that holds a third of all rows is merged by ``salts`` tasks and the salt
    winners by one more. Every grouping compares the content itself, not only its digest.
    """
    rank = F.struct("length", F.bitwise_not("id").alias("late"))  # longest, then least id; a NULL id comes last
    local = _rows(docs, id_col, text_col, digest).select(
        "digest", "content", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"), rank.alias("rank"))
    salted = local.groupBy("digest", "content", "salt").agg(F.max("rank").alias("rank"), F.count("*").alias("size"))
    return salted.groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("size").alias("size")).select(
        "digest", "content", F.bitwise_not(F.col("rank.late")).alias("keep"), "size")


def _decided(docs, id_col, text_col, salts, digest) -> tuple[DataFrame, bool]:
    """Winners without their contents, and whether any digest stands for two contents."""
    best = winners(docs, id_col, text_col, salts, digest)
    slim = stored(best.select("digest", "keep", "size"))
    per_digest = slim.groupBy("digest").agg(F.count("*").alias("contents"))
    return slim, not per_digest.filter("contents > 1").isEmpty()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64,
                digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row, dropped ones too.

    Texts are equal when identical without blanks; NULL counts as empty. Of equal texts the one
    with the most code points stays, then the least id; a NULL id loses to any other. Rows that
    repeat both id and text count in ``group_size`` and are all marked kept (``survivors`` returns one).
    Further columns are not read. If two contents share a digest, rows are matched by content as well.
    """
    slim, collided = _decided(docs, id_col, text_col, salts, digest)
    rows = _rows(docs, id_col, text_col, digest).withColumn("text_sha256", F.sha2("content", 256))
    if collided:
        matched = rows.join(winners(docs, id_col, text_col, salts, digest), ["digest", "content"])
    else:
        matched = rows.select("id", "digest", "text_sha256").join(slim, "digest")
    return matched.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
                          F.col("id").eqNullSafe(F.col("keep")).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """The rows that stay, one for each distinct text, with all their columns."""
    slim, collided = _decided(docs, id_col, text_col, salts, sha256)
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.regexp_replace(text, BLANKS, "")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), sha256(content).alias("digest"), name(id_col).alias("name"),
                        F.char_length(text).alias("length"))
    on = ["digest", "name"]
    if collided:
        keyed, best = keyed.withColumn("content", content), winners(docs, id_col, text_col, salts)
        on.append("content")
    else:
        best = slim
    once = keyed.groupBy(*on).agg(F.max_by("row", "length").alias("row"))
    return once.join(best.withColumn("name", name("keep")).select(*on), on, "left_semi").select("row.*")


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c FROM documents),
w AS (SELECT c, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY c)
SELECT t.doc_id, w.keep_id, w.group_size, t.doc_id IS NOT DISTINCT FROM w.keep_id AS kept, sha256(t.c) AS text_sha256
FROM t JOIN w ON t.c = w.c"""
