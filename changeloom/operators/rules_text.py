"""Rules over text, lines and catch blocks of one file, as array expressions; and text rules that look at several files, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions import paths as P
from changeloom.functions import text as X
from changeloom.operators.scope import finding, none, one

_FAIL = r"(?i)\b\w*(error|fail|fault|invalid)\w*\s*=\s*true\s*;"
_LOG = r"(?i)(?<!\w)(Log|Logger|AppendLog|Trace|Debug|Warn|Warning|Error|Fatal|Console\.Write(Line)?)\w*(<[^>]+>)?\s*\("
_CLEAN = r"(?i)\b(Cleanup|Dispose|Close|Release|Rollback)\w*\s*\("


def _catches() -> Column:
    """Catch blocks that a change touches, without those for cancellation."""
    cancel = r"(^|\.)(OperationCanceledException|TaskCanceledException)$"
    seen = lambda c: F.exists("scope_lines", lambda x: x.between(c["start_line"], c["end_line"])) & ~F.coalesce(F.regexp_replace(c["type"], "global::", "").rlike(cancel), F.lit(False))
    return F.filter(F.coalesce(F.col("catches"), F.array()), seen)


def empty_catch() -> Column:
    blank = F.filter("touched_catches", lambda c: X.is_blank(c["body"]))
    return F.transform(blank, lambda c: finding("empty-catch", F.when(c["has_comments"], "Suggestion").otherwise("Important"), c["start_line"], "Empty catch block."))


def swallowing_catch() -> Column:
    def swallows(c: Column) -> Column:
        name = F.concat(F.lit("(?<![A-Za-z0-9_])"), F.regexp_replace(c["variable"], "@", ""), F.lit("(?![A-Za-z0-9_])"))
        used = F.coalesce(F.regexp_like(c["body"], name), F.lit(False))
        return ~X.is_blank(c["body"]) & ~c["body"].contains("throw;") & ~c["body"].rlike(r"\bthrow\s+[A-Za-z_]") & ~used

    def classify(c: Column) -> Column:
        b = c["body"]
        cases = (
            (b.rlike(r"(?i)\breturn\s+true\s*;"), "Important", "Catch block returns success after an exception."),
            (b.rlike(r"(?i)\breturn\s+(false|null|default)\s*;"), "Hint", "Catch block converts an exception into a return value."),
            (b.rlike(_FAIL), "Suggestion", "Catch block sets an error flag and goes on."),
            (b.rlike(_LOG), "Suggestion", "Catch block logs an exception and goes on."),
            (b.rlike(_CLEAN), "Suggestion", "Catch block performs cleanup and appears to swallow the exception."),
        )
        severity, message = F.lit("Important"), F.lit("Catch block appears to swallow exceptions.")
        for cond, s, m in reversed(cases):
            severity, message = F.when(cond, s).otherwise(severity), F.when(cond, m).otherwise(message)
        return finding("swallowing-catch", severity, c["start_line"], message)

    return F.transform(F.filter("touched_catches", swallows), classify)


def _in_scope_lines() -> Column:
    """(number, text) of the lines in scope that the file has."""
    at = F.filter("scope_lines", lambda n: n.between(1, F.size("lines")))
    return F.transform(at, lambda n: F.struct(n.alias("n"), F.element_at("lines", n).alias("s")))


def lock_target() -> Column:
    target = r"(?i)\block\s*\(\s*(this|[A-Za-z_][A-Za-z0-9_]*)\s*\)"
    each = F.flatten(F.transform(_in_scope_lines(), lambda x: F.transform(F.regexp_extract_all(x["s"], F.lit(target), F.lit(1)), lambda t: F.struct(x["n"].alias("n"), t.alias("t")))))

    def public(t: Column) -> Column:
        kind = r"(?:object|System\.Object)\s+"
        one_of = F.concat(F.lit(r"(?im)\bpublic\s+(?:(?:static\s+)?(?:readonly\s+)?" + kind), t, F.lit(r"\b|" + kind), t, F.lit(r"\s*\{)"))
        return F.exists("lines", lambda s: F.regexp_like(s, one_of))

    hits = F.filter(each, lambda h: (F.lower(h["t"]) == "this") | public(h["t"]))
    message = lambda h: F.when(F.lower(h["t"]) == "this", F.lit("lock(this) detected.")).otherwise(F.concat(F.lit("Possible lock on public object '"), h["t"], F.lit("'.")))
    return F.transform(hits, lambda h: finding("lock-this-or-public", "Important", h["n"], message(h)))


def blank_between_braces() -> Column:
    """Pairs of neighbouring non-blank lines that are the same lone brace, with blank lines between them."""
    solid = F.col("solid_lines")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(solid) - 1, F.lit(1))), lambda i: F.struct(F.get(solid, i - 1).alias("a"), F.get(solid, i).alias("b")))
    gap = F.filter(pairs, lambda p: p["b"].isNotNull() & (p["a"]["s"] == p["b"]["s"]) & p["a"]["s"].isin("{", "}") & (p["b"]["n"] - p["a"]["n"] > 1) & (F.col("is_added") | F.exists("scope_lines", lambda x: x.between(p["a"]["n"] + 1, p["b"]["n"]))))
    said = lambda p: F.concat(F.lit("Blank line between consecutive "), F.when(p["b"]["s"] == "{", "opening").otherwise("closing"), F.lit(" braces."))
    return F.transform(gap, lambda p: finding("blank-line-between-brace-pairs", "Hint", p["b"]["n"], said(p)))


_TYPE = r"(?m)^\s*((?:(?:public|internal|sealed|abstract|partial|static)\s+)+)\b(?:class|interface|record|struct)\s+([A-Za-z_][A-Za-z0-9_]*)"


def _declared(text: Column) -> tuple[Column, Column, Column]:
    """Modifiers, name and line of the first type declaration with a modifier; the name is "" where there is none."""
    whole = F.regexp_extract(text, _TYPE, 0)
    before = F.left(text, F.instr(text, whole) - 1)
    at = F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1
    return F.regexp_extract(text, _TYPE, 1), F.regexp_extract(text, _TYPE, 2), at.cast("int")


def prepared() -> dict[str, Column]:
    """Columns that several rules, or one rule several times, read."""
    mods, name, at = _declared(F.col("text"))
    return {"type_mods": mods, "type_name": name, "type_line": at, "solid_lines": _solid_lines(), "touched_catches": _catches()}


def _solid_lines() -> Column:
    numbered = F.transform("lines", lambda s, i: F.struct((i + 1).alias("n"), X.trim(s).alias("s")))
    return F.filter(numbered, lambda x: x["s"] != "")


def missing_xml_docs() -> Column:
    mods, name, at = F.col("type_mods"), F.col("type_name"), F.col("type_line")
    above = F.reverse(F.transform(F.slice("lines", 1, F.greatest(at - 1, F.lit(0))), X.trim))
    # The nearest line above that is neither blank nor an attribute has to be documentation.
    first = F.get(F.filter(above, lambda s: (s != "") & ~s.startswith("[")), F.lit(0))
    cond = F.col("is_added") & ~P.is_test(F.col("path")) & ~P.is_test_text(F.col("text")) & (name != "") & mods.rlike(r"\b(public|internal)\b") & ~F.coalesce(first.startswith("///"), F.lit(False))
    return one(cond, finding("missing-xml-docs", "Hint", at, "Missing XML docs on new public/internal type."))


def untyped_bindings() -> Column:
    hit = F.filter(F.coalesce(F.col("bindings"), F.array()), lambda b: F.exists("scope_lines", lambda x: x.between(b["first"], b["last"])) | F.col("is_added"))
    touched = F.array_min(F.filter("scope_lines", lambda x: x.between(1, F.size("lines")) & F.exists(hit, lambda b: x.between(b["first"], b["last"]))))
    at = F.when(F.col("is_added"), F.array_min(F.transform(hit, lambda b: b["first"]))).otherwise(touched)
    return F.when(F.size(hit) > 0, F.array(finding("missing-typed-binding-context", "Hint", at, "Markup binding without a typed data context hint, such as `x:DataType` or `d:DataContext`."))).otherwise(none())


def argument_guards() -> Column:
    """Public methods that start on a line in scope and dereference an argument that they don't check."""
    hit = F.filter(F.coalesce(F.col("guards"), F.array()), lambda g: F.array_contains("scope_lines", g["line"]))
    found = F.transform(hit, lambda g: finding("public-method-argument-guards", "Hint", g["line"], F.concat(F.lit("Public method '"), g["method"], F.lit("' dereferences '"), g["parameter"], F.lit("' without a guard."))))
    return F.when(~P.is_test(F.col("path")), found).otherwise(none())


PER_FILE = (empty_catch, swallowing_catch, lock_target, blank_between_braces, missing_xml_docs, untyped_bindings, argument_guards)

_HEADER = r"(?i)Code authored by|copyright|all rights reserved|licensed under|SPDX-License-Identifier|permission is hereby granted|THE SOFTWARE IS PROVIDED"


def _row(df: DataFrame, rule: str, severity: Column | str, line: Column, message: Column | str) -> DataFrame:
    return df.select("repo_id", "path", finding(rule, severity, line, message).alias("f"))


def missing_disclaimer(files: DataFrame) -> DataFrame:
    """Added source files without a header, in repositories where a file that isn't added has one."""
    src = files.where(P.is_source(F.col("path"))).select("repo_id", "path", "is_added", F.exists(F.slice("lines", 1, 30), lambda s: s.rlike(_HEADER)).alias("has"))
    habit = src.where("has and not is_added").select("repo_id").distinct()
    return _row(src.where("is_added and not has").join(habit, "repo_id", "left_semi"), "missing-disclaimer-for-new-source-file", "Hint", F.lit(1), "New source file might be missing a disclaimer/header comment.")


def missing_tests(files: DataFrame) -> DataFrame:
    """Added types without an added test file of the expected name."""
    path = F.col("path")
    added = files.where("is_added")
    tests = added.where(P.is_test(path)).select("repo_id", F.lower(P.name(path)).alias("file")).distinct()
    mods, name, at = _declared(F.col("text"))
    cs = added.where(path.rlike(r"(?i)\.cs$") & ~P.is_test(path) & ~P.is_test_text(F.col("text")) & ~P.is_interface(path) & ~P.is_code_behind(path) & ~P.is_ui_text(F.col("text")))
    types = cs.select("repo_id", "path", mods.alias("mods"), name.alias("name"), at.alias("at")).where(r"name != '' and mods rlike '\\bpublic\\b'").withColumn("file", F.lower(F.concat("name", F.lit("Tests.cs"))))
    open_ = types.join(tests, ["repo_id", "file"], "left_anti").join(tests.select("repo_id").distinct().withColumn("some", F.lit(True)), "repo_id", "left")
    some = F.coalesce(F.col("some"), F.lit(False))
    message = F.concat(F.when(some, "No matching test file found for new type '").otherwise("No new unit test(s) added for new type '"), F.col("name"), F.lit("'."))
    return _row(open_, "missing-tests", F.when(some, "Hint").otherwise("Suggestion"), F.col("at"), message)


def missing_readme(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Added project files whose folder has no README.md among the paths (repo_id, path) of the change set and the repository."""
    readme = paths.where(F.lower(P.name(F.col("path"))) == "readme.md").select("repo_id", F.lower(P.directory(F.col("path"))).alias("dir")).distinct()
    projects = files.where(F.col("is_added") & F.col("path").rlike(r"(?i)\.csproj$")).withColumn("dir", F.lower(P.directory(F.col("path"))))
    message = F.concat(F.lit("New project file '"), P.name(F.col("path")), F.lit("' has no 'README.md' beside it."))
    return _row(projects.join(readme, ["repo_id", "dir"], "left_anti"), "missing-readme-for-new-project", "Hint", F.coalesce(F.array_min("added_lines"), F.lit(1)), message)


def missing_method_tests(files: DataFrame) -> DataFrame:
    """New public methods of types for which no changed test file has the type's name in its own."""
    path = F.col("path")
    test = files.where(P.is_test(path) | P.is_test_text(F.col("text"))).select("repo_id", F.lower(P.name(path)).alias("file")).distinct()
    cands = F.filter(F.coalesce(F.col("candidates"), F.array()), lambda c: (c["rule_id"] == "missing-tests-public-methods") & (F.col("is_added") | F.array_contains("scope_lines", c["first"])))
    src = files.where(~P.is_test(path) & ~P.is_generated(path) & ~P.is_code_behind(path) & ~P.is_ui_text(F.col("text")))
    new = src.select("repo_id", "path", F.explode(cands).alias("c")).withColumn("type", F.lower("c.extra"))
    # A repository's changed test files are few: they are gathered on its row, so containment is tested without a theta join.
    named = new.join(test.groupBy("repo_id").agg(F.collect_set("file").alias("files")), "repo_id", "left").withColumn("files", F.coalesce("files", F.array()))
    likely = F.exists("files", lambda f: f.contains("test") & f.contains(F.col("type")))
    some = F.size("files") > 0
    message = F.concat(F.when(some, "New public method '").otherwise("Public method '"), F.col("c.message"), F.when(some, "' has no likely matching unit tests.").otherwise("' has no unit test changes."))
    return _row(named.where(~likely), "missing-tests-public-methods", F.when(F.size("files") > 0, "Hint").otherwise("Suggestion"), F.col("c.line"), message)
