"""Rules over RESX entries, and the link from a locale's file to its base file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions import paths as P
from changeloom.functions import text as X
from changeloom.operators.scope import finding, none, one

PAIRS = (("color", "colour"), ("behavior", "behaviour"), ("analyze", "analyse"), ("normalize", "normalise"), ("organize", "organise"), ("favorites", "favourites"), ("center", "centre"))
_CULTURE = r"^(.+)\.([A-Za-z]{2,3}(?:-[A-Za-z]{4})?(?:-(?:[A-Za-z]{2}|\d{3}))?)\.(?i:resx)$"


def locale(path: Column) -> Column:
    """Culture of a RESX path ("" for a neutral one): a language, with a script and a region if there are."""
    return F.regexp_extract(P.name(path), _CULTURE, 2)


def base_path(path: Column) -> Column:
    """Path of the neutral file that a locale's file translates."""
    return F.regexp_replace(P.normal(path), r"\.[A-Za-z0-9-]+(\.(?i:resx))$", "$1")


def _entries() -> Column:
    return F.coalesce(F.col("entries"), F.array())


def _new(e: Column) -> Column:
    return F.col("is_added") | F.array_contains("scope_lines", e["line"])


def empty_values() -> Column:
    hit = F.filter(_entries(), lambda e: X.is_blank(e["value"]) & _new(e))
    found = F.transform(hit, lambda e: finding("resx-empty-translation-values", "Suggestion", e["line"], F.concat(F.lit("Translation of '"), e["key"], F.lit("' is empty."))))
    return F.when(locale(F.col("path")) != "", found).otherwise(none())


def boundary_whitespace() -> Column:
    hit = F.filter(_entries(), lambda e: ~X.is_blank(e["value"]) & e["value"].rlike(r"(?U)^\s|\s\z") & _new(e))
    return F.transform(hit, lambda e: finding("resx-value-boundary-whitespace", "Suggestion", e["line"], F.concat(F.lit("Value of '"), e["key"], F.lit("' starts or ends with white space."))))


def _matches(words: tuple[str, ...]) -> Column:
    """(word, line) of each occurrence of the words, by entry."""
    def of(e: Column) -> Column:
        per = [F.transform(F.regexp_extract_all(e["value"], F.lit(rf"(?iu)(?<!\p{{L}}){w}(?!\p{{L}})"), F.lit(0)), lambda _: F.struct(F.lit(w).alias("word"), e["line"].alias("line"))) for w in words]  # noqa: B023
        return F.flatten(F.array(*per))

    return F.flatten(F.transform(_entries(), of))


def _words(m: Column) -> Column:
    return F.array_join(F.slice(F.array_distinct(F.transform(m, lambda x: x["word"])), 1, 4), ", ")


def prepared() -> dict[str, Column]:
    """Columns that the dialect rules read several times each."""
    return {"american": _matches(tuple(a for a, _ in PAIRS)), "british": _matches(tuple(b for _, b in PAIRS)), "culture": F.lower(locale(F.col("path")))}


def dialects() -> Column:
    american, british = F.col("american"), F.col("british")
    place = lambda m: F.array_min(F.transform(m, lambda x: x["line"]))
    path = F.col("path")
    culture = F.col("culture")
    both = F.concat(american, british)
    mixed = one(P.is_resx(path) & (culture == "") & (F.size(american) >= 2) & (F.size(british) >= 2), finding("resx-mixed-english-dialect", "Suggestion", place(both), F.concat(F.lit("Mixed American and British English: "), _words(both), F.lit("."))))
    gb = one((culture == "en-gb") & (F.size(american) >= 2), finding("resx-american-english-in-british-locale", "Suggestion", place(american), F.concat(F.lit("American English in a British locale: "), _words(american), F.lit("."))))
    us = one((culture == "en-us") & (F.size(british) >= 2), finding("resx-british-english-in-american-locale", "Suggestion", place(british), F.concat(F.lit("British English in an American locale: "), _words(british), F.lit("."))))
    return F.when(F.size(both) >= 2, F.concat(mixed, gb, us)).otherwise(none())


PER_FILE = (empty_values, boundary_whitespace, dialects)


def key_differences(files: DataFrame, repository: DataFrame | None) -> DataFrame:
    """Keys that an added locale file lacks, and those that it alone has. The base file is the change set's, else the repository's.

    Both sides carry their key arrays, so the difference is an array expression after one join on the base path.
    """
    keys = F.transform(_entries(), lambda e: e["key"])
    resx = files.where(P.is_resx(F.col("path")) & F.col("entries").isNotNull())
    mine = resx.where(F.col("is_added") & (locale(F.col("path")) != "")).select("repo_id", "path", P.key(base_path(F.col("path"))).alias("base"), keys.alias("mine"))
    base = resx.select("repo_id", P.key(F.col("path")).alias("base"), keys.alias("theirs"), F.lit(0).alias("rank"))
    if repository is not None:
        base = base.unionByName(repository.where(P.is_resx(F.col("path")) & F.col("entries").isNotNull()).select("repo_id", P.key(F.col("path")).alias("base"), keys.alias("theirs"), F.lit(1).alias("rank")))
    base = base.groupBy("repo_id", "base").agg(F.min_by("theirs", "rank").alias("theirs"))
    both = mine.join(base, ["repo_id", "base"])
    shown = lambda a: F.concat(F.array_join(F.slice(a, 1, 5), ", "), F.when(F.size(a) > 5, " ...").otherwise(""))
    lacks, extra = F.sort_array(F.array_except("theirs", "mine")), F.sort_array(F.array_except("mine", "theirs"))
    a = one(F.size(lacks) > 0, finding("resx-missing-locale-keys", "Suggestion", F.lit(1), F.concat(F.lit("Locale file misses "), F.size(lacks).cast("string"), F.lit(" key(s) of its base: "), shown(lacks))))
    b = one(F.size(extra) > 0, finding("resx-unexpected-extra-keys", "Hint", F.lit(1), F.concat(F.lit("Locale file has "), F.size(extra).cast("string"), F.lit(" key(s) that its base lacks: "), shown(extra))))
    return both.select("repo_id", "path", F.explode(F.concat(a, b)).alias("f"))
