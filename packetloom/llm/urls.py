"""URL filter: rules, and beyond them a ratio of two character language models, in native columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import stored, table

# Fixed values: (verdict, host and path) of the query's rules.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 4
ALPHABET = 256
START, END = "\u0001", "\u0002"
BIN = 0.02
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Both empty where the url is NULL or has no ``://``; only A-Z are lower-cased in the host."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits the columns host and path, else NULL."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, path = rule.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(f"/{path}")
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """One row for each character of ``url`` and its end: the character after its ``order`` predecessors."""
    padded = F.concat(F.lit(START * order), "url", F.lit(END))
    return urls.withColumn("gram", F.explode(F.transform(
        F.sequence(F.lit(1), F.char_length("url") + 1), lambda k: F.substring(padded, k, F.lit(order + 1)))))


def model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio): log of the chance in the accepted model less that in the rejected, for (gram, good, bad) counts.

    Chances are Witten-Bell interpolations of the orders 0 to ``order``, each context falling back on
    its shorter one by how many characters have followed it, down to an even spread over ``ALPHABET``.
    """
    sides = ("good", "bad")
    shorter = None
    for k in range(order + 1):
        tail = F.substring("gram", order + 1 - k, k + 1)
        seen = counts.groupBy(tail.alias("gram")).agg(*[F.sum(c).alias(c) for c in sides]).withColumn(
            "context", F.substring("gram", 1, k))
        around = seen.groupBy("context").agg(*[F.sum(c).alias(f"n_{c}") for c in sides], *[
            F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in sides])
        level = seen.join(around, "context")
        if shorter is None:
            level = level.withColumns({f"below_{c}": F.lit(1.0 / ALPHABET) for c in sides})
        else:
            level = level.withColumn("end", F.substring("gram", 2, k)).join(
                shorter.select(F.col("gram").alias("end"), *[F.col(f"p_{c}").alias(f"below_{c}") for c in sides]), "end")
        chance = {f"p_{c}": F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"below_{c}"))
                                   / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"below_{c}")) for c in sides}
        shorter = level.withColumns(chance).select("gram", *chance)
    return shorter.select("gram", (F.log("p_good") - F.log("p_bad")).alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """The score that splits (score, good) rows with the least sum of both error rates, the nearest to 0 of equal ones.

    Works on counts in bins of width BIN within -10 to 10; 0 where a side is missing.
    """
    place = F.floor(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("score"))) / BIN).cast("int")
    bins = scored.groupBy(place.alias("bin")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    before, whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    errors = bins.select("bin", (F.coalesce(F.sum("good").over(before), F.lit(0)) / F.sum("good").over(whole)
                                 + 1 - F.coalesce(F.sum("bad").over(before), F.lit(0)) / F.sum("bad").over(whole)).alias("error"))
    best = errors.filter(F.col("error").isNotNull() & (F.col("error") < 1)).orderBy(
        F.round("error", 9), F.abs("bin"), "bin").first()
    return best["bin"] * BIN if best else 0.0


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER, id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row.

    A rule (host and path) fits its host and all subdomains if the path starts with its own; the longest wins. The urls
    that rules decide train the two models: allowed ones the accepted, blocked ones the rejected. Every
    url is scored by the difference of its log-likelihoods divided by its characters, end included, and where
    no rule fits it is allowed at or above a threshold fixed on a fifth of the decided urls that trained nothing.

    NULL urls count as empty, whose only character is the end. Equal urls are counted once for each
    row. Without decided urls all scores are 0 and verdicts allow. Further columns are not read.
    """
    host, path = host_and_path(url_col)
    rows = pages.select(F.col(id_col), F.coalesce(F.col(url_col), F.lit("")).alias("url"), host.alias("host"), path.alias("path")).withColumn(
        "hit", longest_rule(rules))
    urls = stored(rows.groupBy("url").agg(F.count("*").alias("n"), F.max("hit.verdict").alias("decided")))
    held = F.pmod(F.crc32("url"), F.lit(5)) == 0
    grams = _grams(urls.select("url", "n", "decided", held.alias("held")), order)

    def learned(verdict: str) -> Column:
        return F.sum(F.when((F.col("decided") == verdict) & ~F.col("held"), F.col("n")).otherwise(0))

    counts = stored(grams.groupBy("gram").agg(learned("allow").alias("good"), learned("block").alias("bad")))
    ratios = stored(model(counts, order))
    scores = stored(_grams(urls, order).join(ratios, "gram").groupBy("url", "decided").agg(F.avg("ratio").alias("score")))
    cut = threshold(scores.filter(held & F.col("decided").isNotNull()).select("score", (F.col("decided") == "allow").alias("good")))
    judged = scores.select("url", F.col("score"))
    return rows.join(judged, "url").select(
        id_col, "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"), "score")


def op2_url_filter(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"))
