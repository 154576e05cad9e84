"""Rules over the containers of a markup file. Elements are an array on the file's row, a child is found by its position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changeloom.operators.scope import finding


def _containers() -> Column:
    return F.filter(F.coalesce(F.col("elements"), F.array()), lambda e: e["name"].isin("Grid", "StackPanel") & ~e["hook"])


def _relevant(e: Column) -> Column:
    return F.col("is_added") | F.array_contains("scope_lines", e["line"])


def _child(e: Column) -> Column:
    return F.get(F.col("elements"), e["only_child"])


def _nested(e: Column) -> Column:
    """A lone child of the same panel type, in a wrapper that has no effect of its own."""
    c = _child(e)
    return F.coalesce((e["children"] == 1) & (c["name"] == e["name"]) & e["bare"] & ((e["name"] != "StackPanel") | (F.lower(c["orientation"]) == F.lower(e["orientation"]))), F.lit(False))


def _say(rule: str, severity: str, text: str) -> callable:
    return lambda e: finding(rule, severity, e["line"], F.concat(F.lit("`"), e["name"], F.lit(f"` {text}")))


def empty_container() -> Column:
    return F.transform(F.filter(_containers(), lambda e: _relevant(e) & (e["children"] == 0)), _say("empty-container", "Hint", "has no child elements."))


def fixed_size() -> Column:
    hit = F.filter(_containers(), lambda e: (e["sizes"] != "") & (_relevant(e) | F.arrays_overlap(e["attribute_lines"], F.col("scope_lines"))))
    return F.transform(hit, lambda e: finding("fixed-size-layout-container", "Suggestion", e["line"], F.concat(F.lit("`"), e["name"], F.lit("` sets fixed `"), e["sizes"], F.lit("`. Consider flexible layout sizing."))))


def single_child() -> Column:
    hit = F.filter(_containers(), lambda e: _relevant(e) & (e["children"] == 1) & ~_nested(e))
    return F.transform(hit, _say("single-child-wrapper-container", "Hint", "contains only one child. Consider removing it."))


def nested_same_panel() -> Column:
    hit = F.filter(_containers(), lambda e: _nested(e) & ~F.coalesce(_child(e)["hook"], F.lit(True)) & (_relevant(e) | _relevant(_child(e))))
    return F.transform(hit, _say("nested-same-panel-wrapper", "Hint", "wraps another of its kind without effect."))


PER_FILE = (empty_container, fixed_size, single_child, nested_same_panel)
