"""Case forms of Russian names: one token per case, and per single word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import fakes
from veilframe.functions.text import titlecase_like

# --- Fixed values: the six cases, and endings of regular masculine names ------
CASES = ["nomn", "gent", "datv", "accs", "ablt", "loct"]
SURNAME_ENDINGS = ["", "а", "у", "а", "ым", "е"]
NAME_ENDINGS = ["", "а", "у", "а", "ом", "е"]
PATRONYMIC_ENDINGS = ["", "а", "у", "а", "ем", "е"]
# -----------------------------------------------------------------------------
LONG_WORD = 3


def pool_forms(spark: SparkSession) -> DataFrame:
    """``name_forms`` of the stand-in names: (lemma, case, form) in lower case."""
    groups = [
        (fakes.SURNAMES, SURNAME_ENDINGS),
        (fakes.FIRST_NAMES, NAME_ENDINGS),
        (fakes.PATRONYMICS, PATRONYMIC_ENDINGS),
    ]
    rows = [
        (word.lower(), case, word.lower() + ending)
        for words, endings in groups
        for word in words
        for case, ending in zip(CASES, endings)
    ]
    return spark.createDataFrame(rows, "lemma string, case string, form string")


def _words(people: DataFrame, column: str, name: str) -> DataFrame:
    return people.select(
        "group_id", "norm", F.posexplode(F.split(column, r"\s+")).alias("at", name)
    )


def _inflected(words: DataFrame, name: str, forms: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Each word in all six cases; a word the table does not know stays as it is."""
    cases = F.explode(F.array(*[F.lit(c) for c in CASES])).alias("case")
    lowered = words.withColumn("_form", F.lower(name)).join(
        lemmas.withColumnRenamed("form", "_form"), "_form", "left"
    )
    keyed = lowered.withColumn("lemma", F.coalesce("lemma", "_form")).drop("_form")
    return (
        keyed.select("*", cases)
        .join(forms, ["lemma", "case"], "left")
        .withColumn(f"{name}_form", titlecase_like(F.col(name), F.coalesce("form", F.lower(name))))
        .withColumn(
            f"{name}_form", F.when(F.col("form").isNull(), F.col(name)).otherwise(F.col(f"{name}_form"))
        )
        .drop("lemma", "form")
    )


def case_forms(people: DataFrame, name_forms: DataFrame) -> DataFrame:
    """Token map rows for every case: (group_id, norm, case, token, original, words).

    ``people`` has group_id, norm, original and token (the stand-in in its base
    form). ``name_forms`` covers original and stand-in words. Rows with ``words``
    true map single words, given only where both names have equally many.
    """
    forms = name_forms.select("lemma", "case", "form").distinct()
    # A form of several lemmas counts for the first of them.
    lemmas = forms.groupBy("form").agg(F.min("lemma").alias("lemma"))
    original = _inflected(_words(people, "original", "ow"), "ow", forms, lemmas)
    token = _inflected(_words(people, "token", "fw"), "fw", forms, lemmas)
    key = ["group_id", "norm", "case"]

    def whole(words: DataFrame, name: str, out: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("at", f"{name}_form")))
        return words.groupBy(*key).agg(
            F.array_join(F.transform(ordered, lambda s: s[f"{name}_form"]), " ").alias(out),
            F.count(F.lit(1)).alias(f"n_{name}"),
        )

    full = whole(original, "ow", "original").join(whole(token, "fw", "token"), key)
    same = full.where(F.col("n_ow") == F.col("n_fw")).select(*key)
    single = (
        token.join(original, [*key, "at"])
        .where(F.length("fw_form") > LONG_WORD)
        .join(same, key, "left_semi")
        .select(*key, F.col("fw_form").alias("token"), F.col("ow_form").alias("original"))
    )
    return full.select(*key, "token", "original", F.lit(False).alias("words")).unionByName(
        single.withColumn("words", F.lit(True))
    )


def token_in_case(people: DataFrame, forms: DataFrame) -> DataFrame:
    """The stand-in in the case the original was written in; its base form otherwise."""
    same = (
        forms.where(~F.col("words") & (F.lower("original") == F.col("norm")))
        .groupBy("group_id", "norm")
        .agg(F.max_by("token", _case_order()).alias("_cased"))
    )
    return (
        people.join(same, ["group_id", "norm"], "left")
        .withColumn("token", F.coalesce("_cased", "token"))
        .drop("_cased")
    )


def _case_order():
    order = F.create_map(*[x for i, c in enumerate(CASES) for x in (F.lit(c), F.lit(i))])
    return F.element_at(order, F.col("case"))
