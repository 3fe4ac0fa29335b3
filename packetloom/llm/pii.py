"""Personal data: keyed surrogates of the same type, script and format, in native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import stored, table

KEY = "corpus-surrogates"
_GAP = r"[^\p{L}\d\n]{0,6}"  # what may stand between the groups of a number, decoration included
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])"
PHONE = rf"(?<![\d+])\+\d{{1,3}}{_GAP}\d{{3}}{_GAP}\d{{3}}{_GAP}\d{{4}}(?!\d)"
ABROAD = r"(?<![\d+])\+\d{1,3}(?:[ ./()-]{0,3}\d){6,12}(?!\d)"
# Without a country code: an area code in brackets, one with a leading 0, or groups of 3, 3 and 4.
NATIONAL = (r"(?:(?<![\p{L}\d])\(\d{2,5}\)[ -]?\d{3,4}[ .-]?\d{3,4}|(?<![\p{L}\d+.,/:-])0\d{1,4}[ /-]\d{3,4}[ -]?\d{3,4}"
            r"|(?<![\p{L}\d+.,/:-])\d{3}(?:-\d{3}-|\.\d{3}\.| \d{3} )\d{4})(?![\d-])")
SOCIAL = r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\p{L}\d-])"
CARD16 = r"(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?!\d)"
# Other lengths only with a right check digit: ``checked`` decides, as a pattern cannot.
CARD = (rf"(?:{CARD16}|(?<![\p{{L}}\d.,])(?:3[47]\d{{2}}[ -]\d{{6}}[ -]\d{{5}}|\d{{4}}(?:[ -]\d{{4}}){{3}}[ -]\d{{3}}"
        r"|\d{13,15}|\d{17,19})(?![\p{L}\d]))")
ACCOUNT = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}[A-Z0-9]{0,19}(?![\p{L}\p{N}])"
_HEX = "[0-9A-Fa-f]{1,4}"
ADDRESS6 = rf"(?<![\p{{L}}\d:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\p{{L}}\d:])"
ADDRESS = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
# Titles by the gender that they tell.
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mademoiselle|Señora|Señorita|Госпожа"
MALE = "Mr|Sir|Herr|Monsieur|Señor|Господин"
NAME = rf"(?<!\p{{L}})(?:{FEMALE}|{MALE})\.? \p{{Lu}}\p{{Ll}}{{1,24}}(?: \p{{Lu}}\p{{Ll}}{{1,24}})?(?!\p{{L}})"
ANY = "|".join((EMAIL, PHONE, ABROAD, ADDRESS, ADDRESS6, ACCOUNT, CARD, SOCIAL, NATIONAL, NAME))


def kind_of(raw: Column) -> Column:
    return (F.when(raw.contains("@"), "email").when(raw.startswith("+"), "phone").when(raw.rlike(rf"^{ADDRESS}$"), "address")
            .when(raw.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "address6").when(raw.rlike(r"^[A-Z]{2}\d{2}"), "account")
            .when(raw.rlike(rf"^{SOCIAL}$"), "social").when(raw.rlike(rf"^{NATIONAL}$"), "phone")
            .when(raw.rlike(r"^\d"), "card").otherwise(F.when(raw.rlike(rf"^(?:{FEMALE})\b"), "female").otherwise("male")))


def _let(use, **values: Column) -> Column:
    """``use`` of a struct of ``values``, each computed once rather than wherever it stands."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), use), 1)


def checked(raw: Column, kind: Column) -> Column:
    """Whether a mention counts: card numbers of other than 16 digits need a right check digit, accounts the remainder 1 by 97."""
    def digits(c: Column, k: Column) -> Column:
        x = c.try_cast("int") * (k % 2 + 1)
        return x - F.when(x > 9, 9).otherwise(0)

    def remainder(so_far: Column, c: Column) -> Column:
        value = F.coalesce(c.try_cast("int"), F.ascii(c) - 55)
        return (so_far * F.when(value > 9, 100).otherwise(10) + value) % 97

    plain = F.regexp_replace(raw, r"\D", "")
    luhn = F.aggregate(F.transform(F.split(F.reverse(plain), ""), digits), F.lit(0), lambda a, x: a + x) % 10 == 0
    code = F.regexp_replace(raw, " ", "")
    moved = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))
    whole = F.aggregate(F.split(moved, ""), F.lit(0), remainder) == 1
    return F.when(kind == "card", raw.rlike(rf"^{CARD16}$") | luhn).when(kind == "account", whole).otherwise(F.lit(True))


def canonical(raw: Column, kind: Column) -> Column:
    """The entity behind a mention: digits of numbers, lower case of addresses, names without title.

    A surname names its bearer: full name and surname after a title of one gender share the surname's surrogate.
    """
    name = F.element_at(F.split(raw, " "), -1)
    return (F.when(kind.isin("phone", "card", "social"), F.regexp_replace(raw, r"\D", ""))
            .when(kind == "account", F.regexp_replace(raw, " ", ""))
            .when(kind.isin("female", "male"), name).otherwise(F.lower(raw)))


def entities_of(raw: Column, kind: Column) -> Column:
    """(kind, entity) of a mention: itself, and for full names the given name as an entity of its own kind."""
    words = F.split(raw, " ")
    own = F.struct(kind.alias("kind"), canonical(raw, kind).alias("entity"))
    given = F.struct(_given(kind).alias("kind"), F.try_element_at(words, F.lit(2)).alias("entity"))
    return F.when(kind.isin("female", "male") & (F.size(words) > 2), F.array(own, given)).otherwise(F.array(own))


def _given(kind: Column) -> Column:
    return F.concat(kind, F.lit("_given"))


def _named(kind: Column) -> Column:
    return kind.isin("female", "male", "female_given", "male_given")


def _drawn(digest: Column, place: Column, choices: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, F.pmod(place * 3, F.lit(61)) + 1, F.lit(4)), 16, 10).cast("long") + place, F.lit(choices))


def _growth(kind: Column, entity: Column, attempt: Column) -> Column:
    """Characters to add at an attempt: one more each time that as many draws as the space of the present length has bits are used up.

    A digit counts 3 bits, a letter 4, the last letter of a name and what a surrogate keeps none.
    """
    drawn = F.when(kind == "email", F.regexp_replace(entity, r"\.\p{L}+$", "")).otherwise(entity)
    letters = F.char_length(F.regexp_replace(drawn, r"\P{L}", "")) - F.when(_named(kind), 1).otherwise(0)
    bits = F.when(kind == "address", 32).otherwise(4 * letters + 3 * F.char_length(F.regexp_replace(drawn, r"\D", "")))
    return F.floor(attempt / F.greatest(F.lit(2), bits)).cast("int")


def surrogate(kind: Column, entity: Column, attempt: Column, key: str = KEY) -> Column:
    """Same length and character classes as ``entity``, drawn from a digest of key, type, attempt and entity.

    Digits stay digits, letters stay letters of their case and script (Latin, Cyrillic, Greek; others become Latin). A phone
    keeps its country code, an e-mail its last label, an internet address gets octets of 1 to 254,
    a card its first digit, and names of women end in a, those of men in a consonant. Once the draws of
    a length are used up (``_growth``), surrogates are longer: by letters, digits or octets.
    """
    return _let(lambda x: _surrogate(x["kind"], x["entity"], x["digest"], x["more"]), kind=kind, entity=entity, more=_growth(
        kind, entity, attempt), digest=F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), entity), 256))


def _surrogate(kind: Column, entity: Column, digest: Column, more: Column) -> Column:
    entity = F.when(more == 0, entity).when(kind == "email", F.concat(F.repeat(F.lit("a"), more), entity)).when(
        _named(kind), F.concat(entity, F.repeat(F.substring(entity, -1, 1), more))).otherwise(F.concat(entity, F.repeat(F.lit("0"), more)))
    return _let(lambda x: _letters(*[x[c] for c in ("kind", "entity", "digest", "more", "n", "head", "tail")]), kind=kind, entity=entity,
                digest=digest, more=more, n=F.char_length(entity), head=F.when(kind == "phone", F.least(F.char_length(entity) - more - 10, F.lit(3))).when(
                    kind == "card", F.lit(1)).when(kind == "account", F.lit(2)).otherwise(F.lit(0)), tail=F.when(
                    kind == "email", F.char_length(F.regexp_extract(entity, r"\.\p{L}+$", 0))).otherwise(F.lit(0)))


def _letters(kind: Column, entity: Column, digest: Column, more: Column, n: Column, fixed_head: Column, fixed_tail: Column) -> Column:
    def letter(c: Column, k: Column) -> Column:
        def pick(alphabet: str) -> Column:
            return F.substring(F.lit(alphabet), (_drawn(digest, k, len(alphabet)) + 1).cast("int"), F.lit(1))

        female = kind.startswith("female")
        last = _named(kind) & (k == n - 1)
        lower_cyrillic, lower_greek = "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
        latin = F.when(last & female, "a").when(last, pick("bdklmnrst")).otherwise(pick("abcdefghijklmnopqrstuvwxyz"))
        return (F.when(c.rlike(r"\d"), pick("0123456789"))
                .when(kind == "address6", F.when(c == ":", c).otherwise(pick("abcdef")))
                .when(c.rlike(r"\p{IsCyrillic}"), F.when(last & female, "а").otherwise(F.when(
                    c.rlike(r"\p{Lu}"), F.upper(pick(lower_cyrillic))).otherwise(pick(lower_cyrillic))))
                .when(c.rlike(r"\p{IsGreek}"), F.when(c.rlike(r"\p{Lu}"), F.upper(pick(lower_greek))).otherwise(pick(lower_greek)))
                .when(c.rlike(r"\p{Lu}"), F.upper(latin)).when(c.rlike(r"\p{L}"), latin).otherwise(c))

    drawn = F.array_join(F.transform(F.split(entity, ""), lambda c, k: F.when(
        (k < fixed_head) | (k >= n - fixed_tail), c).otherwise(letter(c, k))), "")
    octets = F.array_join(F.transform(F.sequence(F.lit(0), more + 3), lambda k: (
        _drawn(digest, k * 5, 254) + 1).cast("string")), ".")
    return F.when(kind == "address", octets).otherwise(drawn)


def rendered(raw: Column, kind: Column, replacement: Column, given: Column) -> Column:
    """The surrogate in the mention's own format: separators of numbers, case of addresses, title and given name."""

    def digit(c: Column, k: Column) -> Column:
        at = F.char_length(F.regexp_replace(F.substring(raw, F.lit(1), k + 1), r"[^\dA-Z]", ""))
        return F.when(c.rlike(r"[\dA-Z]"), F.substring(replacement, at, F.lit(1))).otherwise(c)

    grown = F.substring(
        replacement, F.char_length(F.regexp_replace(raw, r"[^\dA-Z]", "")) + 1, F.char_length(replacement))
    numbers = F.concat(F.array_join(F.transform(F.split(raw, ""), digit), ""), grown)
    words = F.split(raw, " ")
    name = F.concat_ws(" ", F.element_at(words, 1), F.when(F.size(words) > 2, given), replacement)
    shouted = (raw == F.upper(raw)) & (raw != F.lower(raw))
    return (F.when(kind.isin("phone", "card", "social", "account"), numbers).when(kind.isin("female", "male"), name)
            .when((kind == "email") & shouted, F.upper(replacement)).otherwise(replacement))


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))


def entity_attempts(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, entity, attempt): which draw gives every entity a surrogate of its own.

    A surrogate that another entity has too, or that is itself an entity of the corpus (of names: any name), is drawn
    again by all but the one of least digest; rounds go on until no collision is left.
    """
    sort = F.when(_named(F.col("kind")), "name").otherwise(F.col("kind"))
    real = entities.select(sort.alias("sort"), F.col("entity").alias("drawn"), F.lit(True).alias("real")).distinct()
    settled, waiting = None, entities.withColumn("attempt", F.lit(0))
    while True:
        drawn = waiting.withColumn("drawn", surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key))
        first = F.row_number().over(Window.partitionBy("kind", "drawn").orderBy(F.xxhash64("entity"), "entity")) == 1
        tried = drawn.withColumn("first", first).withColumn("sort", sort).join(real, ["sort", "drawn"], "left").withColumn(
            "good", F.col("first") & F.col("real").isNull())
        if settled is not None:
            tried = tried.join(settled.select("kind", "drawn", F.lit(True).alias("given_out")), ["kind", "drawn"], "left").withColumn(
                "good", F.col("good") & F.col("given_out").isNull())
        tried = stored(tried)
        done = tried.filter("good").select("kind", "entity", "attempt", "drawn")
        settled = done if settled is None else settled.unionByName(done)
        waiting = tried.filter("not good").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        if waiting.isEmpty():
            return settled


def surrogates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """(id, text, n_entities, kinds) of every row: the text with each mention replaced, how many, and their types in order.

    Equal entities get equal surrogates in all texts and formats; different ones of a type never
    share one, and no surrogate is an entity that the corpus holds. NULL texts stay NULL with 0 entities,
    texts without mentions stay as they are. Rows are independent, so repeats and NULL ids need no
    rule; further columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.explode(F.array_distinct(mentions(text))).alias("raw")).withColumn("kind", kind_of(F.col("raw"))).filter(
        checked(F.col("raw"), F.col("kind"))).select(F.inline(entities_of(F.col("raw"), F.col("kind"))))
    attempts = entity_attempts(stored(found.distinct()), key)
    again = stored(attempts.filter("attempt > 0").select("kind", "entity", "attempt"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), mentions(text).alias("raw"))
    if again.isEmpty():
        return _replaced(rows, lambda kind, entity: F.lit(0), key).withColumnRenamed("id", id_col)
    # Entities beyond the first draw are looked up by text, so copies of a text share one row.
    rows = rows.withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    wanted = rows.filter(F.size("raw") > 0).groupBy("h").agg(F.first("raw").alias("raw")).select("h", F.explode("raw").alias("raw")).withColumn("kind", kind_of(F.col("raw"))).filter(
        checked(F.col("raw"), F.col("kind"))).select("h", F.inline(entities_of(F.col("raw"), F.col("kind")))).distinct()
    drawn = wanted.join(again, ["kind", "entity"]).groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws("|", "kind", "entity"), "attempt"))).alias("attempts"))
    rows = rows.join(drawn, "h", "left")
    return _replaced(rows, lambda kind, entity: F.coalesce(F.element_at(
        "attempts", F.concat_ws("|", kind, entity)), F.lit(0)), key).withColumnRenamed("id", id_col)


def _replaced(rows: DataFrame, attempt, key: str) -> DataFrame:
    def told(x: Column) -> Column:
        first = F.coalesce(F.try_element_at(F.split(x["raw"], " "), F.lit(2)), F.lit(""))
        return F.struct(x["raw"].alias("raw"), x["kind"].alias("kind"), canonical(x["raw"], x["kind"]).alias("entity"),
                        checked(x["raw"], x["kind"]).alias("counts"), first.alias("first"), _given(x["kind"]).alias("given"))

    def drawn(x: Column) -> Column:
        given = F.when(x["kind"].isin("female", "male"), surrogate(x["given"], x["first"], attempt(x["given"], x["first"]), key))
        return _let(lambda y: rendered(y["raw"], y["kind"], y["new"], y["given"]), raw=x["raw"], kind=x["kind"], given=given,
                    new=surrogate(x["kind"], x["entity"], attempt(x["kind"], x["entity"]), key))

    named = F.transform("raw", lambda raw: F.struct(raw.alias("raw"), kind_of(raw).alias("kind")))
    rows = rows.withColumn("found", F.transform(named, told))
    new = F.transform("found", lambda x: F.when(x["counts"], drawn(x)).otherwise(x["raw"]))
    counted = F.filter("found", lambda x: x["counts"])
    pieces = F.zip_with(F.split("text", ANY, -1), new, lambda gap, put: F.concat(gap, F.coalesce(put, F.lit(""))))
    return rows.select("id", F.when(F.size("raw") == 0, F.col("text")).otherwise(F.array_join(pieces, "")).alias("text"),
                       F.size(counted).alias("n_entities"), F.transform(counted, lambda x: x["kind"]).alias("kinds"))


def op3_pii_surrogates(spark, sf_dir):
    return surrogates(table(spark, sf_dir, "documents"))
