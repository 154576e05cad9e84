"""Diff output as DataFrame columns: name-status lists and unified diffs without context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions import paths as P

_HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def name_status(raw: Column) -> Column:
    """(status, path) of each entry of `git diff --name-status`. A rename or copy has its new path; blank and short lines are left out."""
    parts = F.transform(F.split(raw, r"\r?\n"), lambda s: F.split(s, "\t"))
    some = F.filter(parts, lambda x: (F.size(x) >= 2) & (F.trim(x[0]) != ""))

    def entry(x: Column) -> Column:
        status = F.substring(F.upper(F.trim(x[0])), 1, 1)
        path = F.when(status.isin("R", "C") & (F.size(x) >= 3), F.get(x, F.lit(2))).otherwise(x[1])
        return F.struct(status.alias("status"), P.normal(path).alias("path"))

    return F.filter(F.transform(some, entry), lambda e: e["path"] != "")


def added_lines(raw: Column, compat: bool = False) -> Column:
    """New-file numbers of the added lines of one file's `git diff --unified=0` (or with context), sorted.

    A hunk's lines are taken by its declared length, so content that starts with ++ or -- counts. compat=True takes every line that
    starts with +++ for a header, as tools do that look at prefixes only: it is neither recorded nor counted.
    """
    lines = F.filter(F.split(raw, r"\r?\n"), lambda s: ~s.startswith("\\"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("left"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        at, count = F.regexp_extract(s, _HUNK, 1).try_cast("int"), F.regexp_extract(s, _HUNK, 2)
        head = s.rlike(_HUNK) & (F.lit(compat) | (acc["left"] <= 0))
        plus = s.startswith("+") & (~s.startswith("+++") if compat else F.lit(True)) & (acc["n"] > 0)
        context = s.startswith(" ") & (acc["n"] > 0)
        inside = F.lit(compat) | (acc["left"] > 0)
        n = F.when(head, at).when(inside & (plus | context), acc["n"] + 1).otherwise(acc["n"])
        left = F.when(head, F.when(count == "", 1).otherwise(count.try_cast("int"))).when(inside & (plus | context), acc["left"] - 1).otherwise(acc["left"])
        out = F.when(~head & inside & plus, F.concat(acc["out"], F.array(acc["n"]))).otherwise(acc["out"])
        return F.struct(n.alias("n"), left.alias("left"), out.alias("out"))

    return F.aggregate(lines, start, step, lambda a: F.array_sort(F.array_distinct(a["out"])))


def split_by_file(raw: Column) -> Column:
    """(path, diff) of each file of a diff over many: one process for a range, not one for each file. Deleted files are left out."""
    parts = F.split(raw, r"(?m)^(?=diff --git )")
    one = F.transform(parts, lambda d: F.struct(F.regexp_extract(d, r"(?m)^\+\+\+ b/([^\t\r\n]+)", 1).alias("path"), d.alias("diff")))
    return F.filter(one, lambda x: x["path"] != "")


def merge(base: DataFrame, more: DataFrame) -> DataFrame:
    """Entries of both (repo_id, path, ...); the base's entry wins where paths are equal in any case."""
    key = P.key(F.col("path"))
    a, b = base.withColumn("_key", key), more.withColumn("_key", key)
    return a.unionByName(b.join(a.select("repo_id", "_key").distinct(), ["repo_id", "_key"], "left_anti")).drop("_key")


def first_by_path(files: DataFrame, order: str) -> DataFrame:
    """One row for each path in any case: the first by `order`."""
    w = Window.partitionBy("repo_id", P.key(F.col("path"))).orderBy(order)
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
