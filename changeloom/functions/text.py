"""Text functions as Column expressions. Spark's defaults differ from what the rules mean in trimming, in \\s and \\w, and in line ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """Lines with CR LF and CR as line ends; a last empty line is kept, an empty text is one empty line."""
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)


def trim(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def is_blank(x: Column) -> Column:
    return ~x.rlike(r"(?U)\S")


def collapse(x: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def strip_comments(code: Column) -> Column:
    """Code without block comments, then without line comments. Strings aren't recognised."""
    return F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", ""), r"(?dm)//.*?$", "")


def quote_names(message: Column) -> Column:
    """'x' becomes `x`, if x holds no quote or line end."""
    return F.regexp_replace(message, r"'([^'\r\n]+)'", "`$1`")


def word_count(text: Column, word: str) -> Column:
    """Occurrences of a word between non-letters, in any case."""
    return F.size(F.regexp_extract_all(text, F.lit(rf"(?iu)(?<!\p{{L}}){word}(?!\p{{L}})"), F.lit(0)))


def branch_name(ref: Column) -> Column:
    """A branch's short name: known prefixes are taken off again and again; HEAD, origin and blanks are null."""
    short = F.regexp_replace(trim(ref), "^(refs/heads/|refs/remotes/|heads/|remotes/|origin/)+", "")
    return F.when(short.isin("HEAD", "origin", "") | short.isNull(), None).otherwise(short)


def log_location(line: Column) -> Column:
    """(path, line) from the first [path:line] of a log line; nulls where there is none."""
    found = r"\[([^\[\]:]+(?::[\\/][^\[\]:]*)?):(\d+)\]"
    return F.struct(F.nullif(F.regexp_extract(line, found, 1), F.lit("")).alias("path"), F.regexp_extract(line, found, 2).try_cast("int").alias("line"))
