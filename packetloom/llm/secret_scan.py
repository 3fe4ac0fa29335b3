"""Secret scan: candidates judged by a random forest trained on labelled findings, in native columns."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import BLANKS, stored, table

LEAST = 16
CANDIDATE = r"[A-Za-z0-9_/+=.~-]{16,}"
# Names before an assigned secret, and words that mark a value as a stand-in.
NAMES = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api_?key|access_?key|auth|credential|private_?key)"
STAND_INS = r"(?i)(example|sample|dummy|changeme|placeholder|xxxx|your_|test_?key)"
# Values that a telling name is assigned: a quoted one up to a quote, another up to a separator, with all symbols between.
SHORTEST = 6
_QUOTES = "\"'`"
_NAMED = rf"{NAMES}[\w.-]*[{_QUOTES}\]]*"
_EQUALS = r"(?:=>|:=|[=:])+"
_VALUE = (rf"((?<=[{_QUOTES}])[^{_QUOTES}\s]{{{SHORTEST},}}"
          rf"|(?<![{_QUOTES}])[^{_QUOTES}\s&,;]{{{SHORTEST - 1},}}[^{_QUOTES}\s&,;)\]}}>])")
FEATURES = ("length", "digit_share", "upper_share", "transitions", "distinct_share", "coverage", "slashes", "suffix",
            "before_name", "before_equals", "quoted", "before_length", "after_length")
GRAM = 4
COMMON = 20


def _assigned(word: Column, near: Column) -> Column:
    """Values that a telling name is assigned, in ``word`` itself or by the words ``near`` before it."""
    inside = F.regexp_extract_all(word, F.lit(f"{_NAMED}{_EQUALS}[{_QUOTES}]?{_VALUE}"), F.lit(1))
    led = F.concat(near, F.lit(" "), F.regexp_extract(word, f"^{_EQUALS}", 0)).rlike(rf"{_NAMED}\s*{_EQUALS}[{_QUOTES}]?\s*$")
    after = F.regexp_extract(word, f"^(?:{_EQUALS})?[{_QUOTES}(]*{_VALUE}", 1)
    return F.when(F.size(inside) > 0, inside).when(led & (after != ""), F.array(after)).otherwise(F.array().cast("array<string>"))


def _runs(word: Column) -> Column:
    """Runs of secret-like characters, each cut at = into its parts of LEAST characters; whole where it has none."""
    parts = lambda run: F.filter(F.split(run, "=+(?=[^=])"), lambda x: F.char_length(x) >= LEAST)
    return F.flatten(F.transform(F.regexp_extract_all(word, F.lit(f"({CANDIDATE})"), F.lit(1)), lambda run: F.when(
        F.size(parts(run)) > 0, parts(run)).otherwise(F.array(run))))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, position, value, quoted, before, before2, after) by word number from 0.

    Values are what a telling name is assigned, from SHORTEST characters, and every other run of LEAST
    secret-like characters. ``before`` is the name and sign in the same word, if there is one, else the word before.
    """
    words = F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), BLANKS, " ")), " ")
    near = docs.select(F.col(id_col).alias("id"), words.alias("words"))

    def at(k: Column, step: int) -> Column:
        return F.coalesce(F.try_element_at("words", F.when(k + step >= 0, k + 1 + step).otherwise(F.size("words") + 1).cast("int")), F.lit(""))

    def sign(w: Column) -> Column:
        return w.contains("=") | w.contains(":")

    def look(w: Column, k: Column) -> Column:
        may = (F.char_length(w) >= LEAST) | (F.char_length(w) >= SHORTEST) & (sign(w) | sign(at(k, -1)))
        return F.when(may, F.struct(k.alias("position"), w.alias("word"), at(k, -1).alias("before"), at(k, -2).alias("before2"), at(k, 1).alias("after")))

    hit = F.filter(F.transform("words", look), lambda x: x.isNotNull())
    rows = near.select("id", F.explode(hit).alias("c")).select("id", "c.*").withColumn(
        "assigned", _assigned(F.col("word"), F.concat_ws(" ", "before2", "before")))
    free = F.filter(_runs(F.col("word")), lambda run: ~F.exists("assigned", lambda value: value.contains(run)))
    rows = rows.select("id", "position", "before", "before2", "after", "word", F.explode(F.concat("assigned", free)).alias("value"))
    lead = F.expr("substring(word, 1, instr(word, value) - 1)")
    own = F.regexp_extract(lead, r"[A-Za-z0-9_.-]+[^A-Za-z0-9_.-]*$", 0)
    opening = F.regexp_extract(lead, r"^[=:>]+", 0)
    return rows.select("id", "position", F.when(own != "", "").otherwise(F.col("before2")).alias("before2"), F.when(own != "", own).otherwise(
        F.concat("before", opening)).alias("before"), "after", "value", F.col("word").rlike(r"[\"'`]").alias("quoted"))


def dictionary(docs: DataFrame, text_col: str = "text", common: int = COMMON) -> DataFrame:
    """Letter runs of GRAM characters in the words that the whole corpus holds at least ``common`` times."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+")).alias("word")).filter(
        F.char_length("word") >= GRAM).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= common)
    return words.select(F.explode(_grams(F.col("word"))).alias("gram")).distinct()


def _grams(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(word) - GRAM + 1)), lambda k: F.substring(word, k, F.lit(GRAM)))


def with_features(found: DataFrame, known: DataFrame) -> DataFrame:
    """Adds FEATURES to candidates: length, character transitions, dictionary coverage, path and neighbouring words."""
    values = found.select("value").distinct()
    grams = values.select("value", F.explode(_grams(F.lower("value"))).alias("gram"))
    covered = grams.join(known.withColumn("known", F.lit(1.0)), "gram", "left").groupBy("value").agg(
        F.avg(F.coalesce("known", F.lit(0.0))).alias("coverage"))
    n = F.char_length("value")
    value = F.col("value")

    def share(pattern: str) -> Column:
        return F.char_length(F.regexp_replace(value, pattern, "")) / n

    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    runs = F.regexp_replace(shape, r"(.)\1+", "$1")
    before = F.concat_ws(" ", "before2", "before")
    return found.join(covered, "value").withColumns({
        "length": n.cast("double"), "digit_share": share("[^0-9]"), "upper_share": share("[^A-Z]"),
        "transitions": F.char_length(runs) / n, "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / n,
        "slashes": share("[^/]"), "suffix": value.rlike(r"\.[A-Za-z]{2,4}$").cast("double"),
        "before_name": before.rlike(NAMES).cast("double"), "before_equals": before.rlike(rf"[=:]>?\s*[{_QUOTES}]*$").cast("double"),
        "quoted": F.col("quoted").cast("double"), "before_length": F.char_length("before").cast("double"),
        "after_length": F.char_length("after").cast("double")})


def rule_findings(featured: DataFrame) -> DataFrame:
    """Adds ``label`` by rules where they are sure, else NULL: what stands in for findings that reviewers have labelled.

    True: a value with digits, not covered by the dictionary, assigned to a telling name. False: a
    stand-in, a path or file name, and values of letters or of digits alone.
    """
    value = F.col("value")
    plain = value.rlike(r"^[A-Za-z_.~=+-]+$") | value.rlike(r"^[0-9_.~=+-]+$") | value.rlike(STAND_INS) | (F.col("suffix") == 1) | (
        F.col("slashes") > 0.02) & (F.col("coverage") > 0.3)
    secret = (F.col("before_name") == 1) & (F.col("before_equals") == 1) & (F.col("digit_share") > 0.1) & (F.col("coverage") < 0.3)
    return featured.withColumn("label", F.when(plain, 0.0).when(secret, 1.0))


def train(labelled: DataFrame, per_class: int = 3000, trees: int = 20, depth: int = 6, seed: int = 9) -> RandomForestClassificationModel | None:
    """Random forest on at most ``per_class`` different values of each label, by hash; None unless both labels occur."""
    counts = {r["label"]: r["n"] for r in labelled.filter("label is not null").groupBy("label").agg(
        F.count_distinct("value").alias("n")).collect()}
    if len(counts) < 2:
        return None
    draw = F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(1 << 30))
    parts = [labelled.filter((F.col("label") == y) & (draw < int((1 << 30) * min(1.0, 1.5 * per_class / counts[y])))).groupBy("value").agg(
        *[F.min(c).alias(c) for c in ("label", *FEATURES)]).orderBy(F.xxhash64("value"), "value").limit(per_class) for y in (0.0, 1.0)]
    sample = parts[0].unionByName(parts[1])
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.select("label", *FEATURES))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7).fit(stored(vectors.select("label", "features")))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """(id, position, value_sha256, length, score, secret) of every candidate in every text; values themselves are not shown.

    The forest learns from ``rule_findings``; where these hold one label only, score is 0 and nothing is
    a secret. NULL and empty texts have no candidates. Repeated rows repeat their findings, NULL ids
    are kept; further columns are not read.
    """
    found = stored(candidates(docs, id_col, text_col))
    featured = stored(with_features(found, dictionary(docs, text_col)))
    forest = train(rule_findings(featured))
    if forest is None:
        scored = featured.withColumn("score", F.lit(0.0))
    else:
        scored = forest.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured)).withColumn(
            "score", vector_to_array("probability")[1])
    return scored.select(F.col("id").alias(id_col), "position", F.sha2("value", 256).alias("value_sha256"),
                         F.col("length").cast("int").alias("length"), "score", (F.col("score") >= cut).alias("secret"))


def op8_secret_scan(spark, sf_dir):
    return secret_scan(table(spark, sf_dir, "documents"))
