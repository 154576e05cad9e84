"""A review: changed files in, findings out.

One pass parses each file; all single-file rules are then one array expression on the file's row, so they cost one scan together. Rules that
look at several files are joins on small keys. A rule whose plan can't be built is reported and left out; the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom import model, ship
from changeloom.functions import paths as P
from changeloom.functions import text as X
from changeloom.operators import duplicates, facts, rules_markup, rules_resx, rules_text, scope
from changeloom.shared import written

def prepared() -> dict[str, Column]:
    """The parser's candidates whose lines the scope touches: a column of its own, since several places read it."""
    cands = F.filter(F.coalesce(F.col("candidates"), F.array()), lambda c: c["rule_id"] != "missing-tests-public-methods")
    always = F.array(*(F.lit(r) for r in sorted(model.WHOLE_SET)))
    touched = F.filter(cands, lambda c: F.col("is_added") | F.array_contains(always, c["rule_id"]) | F.exists("scope_lines", lambda x: x.between(c["first"], c["last"])))
    # A call that is parsed twice (nested names) gives its candidate twice.
    return {"touched_candidates": F.array_distinct(touched)}


def csharp_findings() -> Column:
    """The touched candidates; of those that count once a file, and of a call's runs of literals, the first."""

    def first(c: Column, i: Column) -> Column:
        alone = (c["extra"] == "once") | c["extra"].startswith("call ")
        return ~F.coalesce(alone, F.lit(False)) | ~F.exists(F.slice("touched_candidates", 1, i), lambda b: (b["rule_id"] == c["rule_id"]) & (b["extra"] == c["extra"]))

    return F.filter(F.transform(F.transform(F.filter("touched_candidates", first), _parts), _placed), lambda c: c["line_number"].isNotNull())


def _parts(c: Column) -> Column:
    """A candidate with those of its parts that the scope touches, as lines, how many have to be, and which of them is reported; nulls where it has no parts."""
    words = F.when(c["extra"].startswith("parts "), F.split(c["extra"], " "))
    spans = F.transform(F.slice(words, 4, 1 << 20), lambda s: F.struct(F.split_part(s, F.lit("-"), F.lit(1)).cast("int").alias("a"), F.split_part(s, F.lit("-"), F.lit(2)).cast("int").alias("b")))
    seen = F.filter(spans, lambda s: F.col("is_added") | F.exists("scope_lines", lambda x: x.between(s["a"], s["b"])))
    return F.struct(c["rule_id"], c["severity"], c["line"], c["message"], seen["a"].alias("lines"), F.get(words, F.lit(1)).cast("int").alias("least"), F.get(words, F.lit(2)).cast("int").alias("nth"))


def _placed(c: Column) -> Column:
    """The finding of a candidate; its line is null if too few of its parts are touched."""
    at = F.when(c["least"].isNull(), c["line"]).when(F.size(c["lines"]) >= c["least"], F.when(c["nth"] == 0, c["line"]).otherwise(F.get(c["lines"], c["nth"] - 1)))
    said = F.when(c["least"].isNull(), c["message"]).otherwise(F.replace(c["message"], F.lit("%d"), F.size(c["lines"]).cast("string")))
    return F.struct(c["rule_id"], c["severity"], at.alias("line_number"), said.alias("message"))


#: The rules over one file, and over several.
PER_FILE = (*rules_text.PER_FILE, *rules_resx.PER_FILE, *rules_markup.PER_FILE, csharp_findings)


@dataclass
class ChangeSet:
    """What a rule over several files sees: the changed files with their facts, and the repository's other files, if they are known."""

    files: DataFrame
    repository: DataFrame | None
    paths: DataFrame  # (repo_id, path) of all changed files, those that aren't analysed too


def key_differences(c: ChangeSet) -> DataFrame:
    base = None if c.repository is None else facts.with_facts(c.repository.where(P.is_resx(F.col("path"))))
    return rules_resx.key_differences(c.files, base)


def missing_disclaimer(c: ChangeSet) -> DataFrame:
    return rules_text.missing_disclaimer(c.files)


def missing_tests(c: ChangeSet) -> DataFrame:
    return rules_text.missing_tests(c.files)


def missing_readme(c: ChangeSet) -> DataFrame:
    return rules_text.missing_readme(c.files, c.paths if c.repository is None else c.paths.unionByName(c.repository.select("repo_id", "path")))


def missing_method_tests(c: ChangeSet) -> DataFrame:
    return rules_text.missing_method_tests(c.files)


def duplicate_blocks(c: ChangeSet) -> DataFrame:
    return duplicates.duplicate_blocks(c.files, c.repository)


SEVERAL_FILES = (missing_disclaimer, missing_tests, missing_readme, missing_method_tests, key_differences, duplicate_blocks)


@dataclass
class Review:
    findings: DataFrame
    info: DataFrame
    facts: DataFrame


def review(
    files: DataFrame, repository: DataFrame | None = None, *, include_full_modified_files: bool = False, is_entire_repository_scan: bool = False, approximate: bool = True,
    per_file: Sequence[Callable[[], Column]] = PER_FILE, several_files: Sequence[Callable[[ChangeSet], DataFrame]] = SEVERAL_FILES,
    progress: Callable[[int, int, str], bool | None] | None = None,
) -> Review:
    """Findings of all rules, as a multiset.

    files: changed files (model.CHANGED_FILES; missing columns are filled). repository: other files of the same repositories, for duplicates, base RESX files and
    READMEs. Ignored paths are left out. approximate=False drops the rules that judge without a compiler.

    The rules are passed in. One of per_file gives the array of a file's findings, from the file's columns; one of several_files gives rows (repo_id, path, f).
    progress is called before each rule with its number, their count and its name; if it returns False, that rule and the later ones are left out.
    The files are read and parsed once, when this is called; the facts are a table in the shared folder.
    """
    ship(files.sparkSession)
    keep = P.is_analyzable(F.col("path")) | P.is_source(F.col("path"))
    every = scope.prepare(files)
    src = scope.with_scope(every.where(keep), include_full_modified_files)
    parsed = written(facts.with_facts(src), "facts")
    repo = None
    if repository is not None:
        repo = scope.with_scope(scope.prepare(repository), False).withColumn("scope_lines", F.array().cast("array<int>"))
    errors: list[tuple[str, str]] = []
    exprs: list[Column] = []
    rules = [*per_file, *(r for r in several_files if not (is_entire_repository_scan and r is duplicate_blocks))]
    if progress is not None:
        for n, rule in enumerate(rules):
            if progress(n + 1, len(rules), rule.__name__) is False:
                rules = rules[:n]
                break
    for rule in (r for r in rules if r in per_file):
        try:
            exprs.append(rule())
        except Exception as e:
            errors.append((rule.__name__, str(e)))
    code = F.when(P.is_analyzable(F.col("path")), F.flatten(F.array(scope.none(), *exprs))).otherwise(scope.none())
    # What rules read more than once is computed once, below a projection of its own.
    ready = parsed.withColumns(rules_text.prepared() | rules_resx.prepared() | prepared())
    rows = ready.select("repo_id", "path", F.explode(code).alias("f"))
    change = ChangeSet(parsed, repo, every.select("repo_id", "path"))
    for build in (r for r in rules if r in several_files):
        try:
            rows = rows.unionByName(build(change))
        except Exception as e:
            errors.append((build.__name__, str(e)))
    found = rows.select(
        "repo_id", F.col("f.severity").alias("severity"), model.severity_rank(F.col("f.severity")).alias("severity_rank"), F.col("f.rule_id").alias("rule_id"), F.col("path").alias("file_path"), F.col("f.line_number").alias("line_number"),
        X.quote_names(X.quote_names(F.col("f.message"))).alias("message"),
    )
    if not approximate:
        found = found.where(~F.col("rule_id").isin(*sorted(model.APPROXIMATE | model.WEAK)))
    broken = parsed.where("error is not null").select("repo_id", F.concat(F.lit("CHECK ERROR: ["), F.col("path"), F.lit("] parser failed. "), F.col("error")).alias("message"))
    info = broken.unionByName(files.sparkSession.createDataFrame([("", f"CHECK ERROR: [{n}] failed. {m}") for n, m in errors], "repo_id string, message string"))
    return Review(found, info, parsed)


def rescan(before: DataFrame, files: DataFrame, paths: DataFrame, **options: object) -> DataFrame:
    """Findings after some files changed again: those of the paths (repo_id, path) are replaced by a review of the new files."""
    keys = paths.select("repo_id", F.col("path").alias("file_path"))
    fresh = review(files.join(paths, ["repo_id", "path"], "left_semi"), **options).findings
    return before.join(keys, ["repo_id", "file_path"], "left_anti").unionByName(fresh)
