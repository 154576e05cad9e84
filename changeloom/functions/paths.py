"""What a path says about its file, as boolean Columns. A null or blank path is none of these."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE = "cs c cc cpp cxx h hh hpp hxx js jsx mjs cjs ts tsx java kt kts go rs swift py rb php".split()
IGNORED = (r"\.git", r"\.vs", r"\.idea", "bin", "obj", "dist", "node_modules")


def normal(path: Column) -> Column:
    return F.trim(F.translate(path, "\\", "/"))


def key(path: Column) -> Column:
    """For comparing paths in any case."""
    return F.lower(normal(path))


def name(path: Column) -> Column:
    return F.substring_index(normal(path), "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(normal(path), "/?[^/]*$", "")


def _is(path: Column, pattern: str) -> Column:
    return F.coalesce(path.rlike(f"(?i){pattern}"), F.lit(False))


def is_generated(path: Column) -> Column:
    return _is(path, r"\.(g|g\.i|designer|generated)\.cs$")


def is_ignored(path: Column) -> Column:
    return is_generated(path) | _is(F.concat(F.lit("/"), normal(path), F.lit("/")), f"/({'|'.join(IGNORED)})/")


def is_code(path: Column) -> Column:
    return _is(path, r"\.(cs|csproj|axaml|xaml)$") & ~is_ignored(path)


def is_resx(path: Column) -> Column:
    return _is(path, r"\.resx$") & ~is_ignored(path)


def is_duplicate_checked(path: Column) -> Column:
    return _is(path, r"\.(cs|axaml|xaml)$") & ~is_ignored(path)


def is_analyzable(path: Column) -> Column:
    return is_code(path) | is_resx(path)


def is_test(path: Column) -> Column:
    return _is(path, r"Tests\.cs$|[/\\](Unit)?Tests[/\\]")


def is_source(path: Column) -> Column:
    return _is(path, rf"\.({'|'.join(SOURCE)})$") & ~is_ignored(path)


def is_code_behind(path: Column) -> Column:
    return _is(path, r"\.a?xaml\.cs$")


def is_markup(path: Column) -> Column:
    return _is(path, r"\.a?xaml$")


def is_interface(path: Column) -> Column:
    return F.coalesce(name(path).rlike(r"^I\p{Lu}.*\.(?i:cs)$"), F.lit(False))


_WINDOWS = "Controls|Data|Documents|Input|Interop|Markup|Media|Navigation|Shapes"


def is_ui_text(text: Column) -> Column:
    spaces = rf"Avalonia\.(Controls|VisualTree)|System\.Windows(\.({_WINDOWS}|Forms|Threading))?|Windows\.UI\.Xaml(\.({_WINDOWS.replace('|Markup', '')}))?"
    return F.coalesce(text.rlike(rf"(?m)(?U)^\s*using\s+({spaces})\s*;"), F.lit(False))


def is_test_text(text: Column) -> Column:
    attributes = "TestFixture|TextFixture|TestCaseSource|TestCase|TestClass|TestMethod|Test|Theory|Fact|DataTestMethod"
    return F.coalesce(text.rlike(rf"(?U)\[\s*(\w+\.)*({attributes})\b"), F.lit(False))


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first, the root ("") last."""
    parts = F.split(normal(path), "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
