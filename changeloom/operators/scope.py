"""Scope views of changed files, and findings as arrays on a file's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions import text as X


def prepare(files: DataFrame) -> DataFrame:
    """Changed files with nulls filled: text "", no added lines, status ""; lines from the text, where they are missing.

    repo_id defaults to "" (one repository), full_path to the path. is_added ignores the status's case.
    """
    has = {c.lower() for c in files.columns}
    col = lambda name, kind: F.col(name).cast(kind) if name in has else F.lit(None).cast(kind)
    text = F.coalesce(col("text", "string"), F.lit(""))
    return files.select(
        F.coalesce(col("repo_id", "string"), F.lit("")).alias("repo_id"),
        F.coalesce(col("status", "string"), F.lit("")).alias("status"),
        F.coalesce(col("path", "string"), F.lit("")).alias("path"),
        F.coalesce(col("full_path", "string"), col("path", "string"), F.lit("")).alias("full_path"),
        text.alias("text"),
        F.coalesce(col("lines", "array<string>"), X.lines(text)).alias("lines"),
        F.array_sort(F.array_distinct(F.coalesce(col("added_lines", "array<int>"), F.lit(None).cast("array<int>"), F.array().cast("array<int>")))).alias("added_lines"),
        F.coalesce(F.upper(col("status", "string")) == "A", F.lit(False)).alias("is_added"),
    )


def with_scope(files: DataFrame, whole_files: bool) -> DataFrame:
    """Adds all_lines (every line counts as added; the status stays) and scope_lines (those that added-lines rules see)."""
    every = F.sequence(F.lit(1), F.greatest(F.size("lines"), F.lit(1)))
    return files.withColumn("all_lines", every).withColumn("scope_lines", F.col("all_lines") if whole_files else F.col("added_lines"))


def is_new(line: Column) -> Column:
    return F.col("is_added") | F.array_contains("scope_lines", line)


def touches(first: Column, last: Column) -> Column:
    return F.col("is_added") | F.exists("scope_lines", lambda x: x.between(first, last))


def finding(rule: str, severity: Column | str, line: Column, message: Column | str) -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    msg = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(rule).alias("rule_id"), sev.alias("severity"), line.cast("int").alias("line_number"), msg.alias("message"))


def none() -> Column:
    return F.array().cast("array<struct<rule_id:string,severity:string,line_number:int,message:string>>")


def one(cond: Column, f: Column) -> Column:
    """[f] if cond, else nothing."""
    return F.when(cond, F.array(f)).otherwise(none())
