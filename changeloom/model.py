"""Schemas, severities, and the catalogue of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGED_FILES = "repo_id string, status string, path string, full_path string, text string, lines array<string>, added_lines array<int>"
FINDING = "struct<rule_id:string,severity:string,line_number:int,message:string>"
FINDINGS = "repo_id string, severity string, severity_rank int, rule_id string, file_path string, line_number int, message string"
SEVERITIES = ("Ok", "Hint", "Suggestion", "Important")
CATEGORIES = ("Correctness", "Threading", "Performance", "Resources", "API/Design", "Readability", "Maintainability", "Testing", "Documentation", "UI", "Repo Hygiene")
COLOURS = ("#D64545", "#C76B29", "#B58B00", "#3E8E5A", "#3A7CA5", "#5B6BBF", "#8457A8", "#2F9C95", "#7A8B99", "#B0568C", "#6E6259")

_TEXT = {
    "Correctness": "empty-catch swallowing-catch throw-ex-in-catch public-method-argument-guards constructor-event-subscription-lifecycle numeric-string-culture-for-file-write",
    "Threading": "async-void lock-this-or-public task-run-async thread-sleep unobserved-task-result",
    "Performance": "string-concat-same-target multiple-enumeration",
    "Resources": "disposable-not-disposed dispose-without-idisposable resx-missing-locale-keys resx-unexpected-extra-keys resx-empty-translation-values resx-value-boundary-whitespace resx-mixed-english-dialect resx-american-english-in-british-locale resx-british-english-in-american-locale",
    "API/Design": "property-can-be-auto-property private-get-only-auto-property-should-be-field private-property-should-be-field private-field-can-be-readonly method-parameter-count generic-type-name-suffix method-can-be-static public-mutable-static-state multiple-classes-per-file",
    "Readability": "async-method-name-suffix missing-blank-line-between-methods blank-line-between-brace-pairs if-else-brace-consistency if-else-unnecessary-braces boolean-literal-comparison unnecessary-cast unnecessary-enum-member-value unnecessary-verbatim-string-prefix redundant-self-lookup lambda-can-be-method-group consecutive-boolean-arguments consecutive-null-arguments local-variable-prefix",
    "Maintainability": "constructor-too-long local-variable-can-be-const duplicate-code-block private-field-used-in-single-method unused-local-variable unused-private-member",
    "Testing": "missing-tests missing-tests-public-methods",
    "Documentation": "missing-xml-docs empty-xml-doc-content missing-readme-for-new-project",
    "UI": "missing-typed-binding-context fixed-size-layout-container single-child-wrapper-container nested-same-panel-wrapper empty-container",
    "Repo Hygiene": "warning-suppression unused-usings-roslyn missing-disclaimer-for-new-source-file",
}
CATEGORY = {rule: c for c, rules in _TEXT.items() for rule in rules.split()}
#: Rules that always see whole files; the others see added lines unless a scan asks for whole modified files.
WHOLE_SET = frozenset("missing-disclaimer-for-new-source-file resx-missing-locale-keys resx-unexpected-extra-keys resx-mixed-english-dialect resx-american-english-in-british-locale resx-british-english-in-american-locale unused-usings-roslyn".split())
FIXABLE = frozenset("blank-line-between-brace-pairs missing-blank-line-between-methods unused-usings-roslyn warning-suppression throw-ex-in-catch unnecessary-verbatim-string-prefix unnecessary-enum-member-value redundant-self-lookup method-can-be-static local-variable-can-be-const lambda-can-be-method-group unused-private-member if-else-brace-consistency if-else-unnecessary-braces".split())
#: How sure a finding is: rules without a compiler's types or bindings are "approximate" or "weak".
APPROXIMATE = frozenset("unnecessary-enum-member-value redundant-self-lookup unused-private-member unused-local-variable local-variable-can-be-const string-concat-same-target private-field-can-be-readonly private-field-used-in-single-method method-can-be-static task-run-async".split())
WEAK = frozenset("constructor-event-subscription-lifecycle disposable-not-disposed dispose-without-idisposable boolean-literal-comparison unnecessary-cast unobserved-task-result multiple-enumeration numeric-string-culture-for-file-write lambda-can-be-method-group unused-usings-roslyn".split())


def confidence(rule: str) -> str:
    return "approximate" if rule in APPROXIMATE else "weak" if rule in WEAK else "exact"


def category(rule_id: Column) -> Column:
    """Category of a rule; unknown, blank and null rules are Maintainability."""
    m = F.create_map(*(F.lit(x) for kv in CATEGORY.items() for x in kv))
    return F.coalesce(F.try_element_at(m, rule_id), F.lit("Maintainability"))


def category_rank(name: Column) -> Column:
    m = F.create_map(*(F.lit(x) for kv in zip(CATEGORIES, range(11), strict=True) for x in kv))
    return F.coalesce(F.try_element_at(m, name), F.lit(11))


def category_colour(name: Column) -> Column:
    m = F.create_map(*(F.lit(x) for kv in zip(CATEGORIES, COLOURS, strict=True) for x in kv))
    return F.coalesce(F.try_element_at(m, name), F.lit("#888888"))


def severity_rank(severity: Column) -> Column:
    m = F.create_map(*(F.lit(x) for kv in zip(SEVERITIES, range(4), strict=True) for x in kv))
    return F.try_element_at(m, severity)


def rule_catalog(spark: SparkSession) -> DataFrame:
    """(rule_id, category, scope, fixable, confidence) of every rule."""
    rows = [(r, c, "ChangedFileSet" if r in WHOLE_SET else "AddedLinesOnly", r in FIXABLE, confidence(r)) for r, c in CATEGORY.items()]
    return spark.createDataFrame(rows, "rule_id string, category string, scope string, fixable boolean, confidence string")


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
