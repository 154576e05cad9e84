"""What is done with findings: categories, order, filters, counts, previews, numbered export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preview(lines: Column, at: Column, around: int) -> Column:
    """Lines around line `at` (1-based), numbered to equal width, the line itself marked with >."""
    lo = F.greatest(at - around, F.lit(1))
    hi = F.least(at + around, F.size(lines))
    width = F.length(hi.cast("string"))
    one = lambda i: F.concat(F.when(i == at, "> ").otherwise("  "), F.lpad(i.cast("string"), width, F.lit(" ")), F.lit(" | "), F.element_at(lines, i))
    return F.when(hi >= lo, F.concat_ws("\n", F.transform(F.sequence(lo, hi), one)))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows with their position in a total order, without a window over one partition.

    Rows are range-partitioned, sorted and written once, each with its range and its place in it: sampled and coalesced anew, the ranges would be others.
    A range's first position is the size of all ranges before it, one small row each. Rows that tie in the order get distinct positions. No row: none.
    """
    from pyspark.sql import Window

    from changeloom.shared import written

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    ranged = ranged.withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.col("_range").cast("long"), 33))
    ranged = written(ranged, "numbered")
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = before.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_local") + 1).drop("_range", "_local", "_before")


def categorised(findings: DataFrame) -> DataFrame:
    """Findings but for those of severity Ok, with category, category_rank, location and include flag."""
    from changeloom import model

    name = model.category(F.col("rule_id"))
    place = F.when(F.trim(F.coalesce("file_path", F.lit(""))) == "", "(no file)").when(F.col("line_number") > 0, F.concat("file_path", F.lit(":"), F.col("line_number").cast("string"))).otherwise(F.col("file_path"))
    df = findings.where("severity is not null and severity != 'Ok'").withColumns({"category": name, "category_rank": model.category_rank(name), "location": place})
    return df if "is_included" in df.columns else df.withColumn("is_included", F.lit(True))


def ordered(rows: DataFrame) -> DataFrame:
    """Report order: category, rule, path in any case, line; a missing line comes last."""
    return rows.orderBy("category_rank", F.upper("rule_id"), F.upper("file_path"), F.col("line_number").asc_nulls_last(), "message")


def visible(rows: DataFrame, categories: list[str]) -> DataFrame:
    return rows.where(F.lower("category").isin(*(c.lower() for c in categories)))


def category_counts(rows: DataFrame) -> DataFrame:
    """(category, n, share, colour), the largest first; share in degrees of a circle."""
    from pyspark.sql import Window

    from changeloom import model

    g = rows.groupBy("category", "category_rank").agg(F.count("*").alias("n"))
    share = F.col("n") * 360.0 / F.sum("n").over(Window.partitionBy())
    return g.select("category", "n", share.alias("share"), model.category_colour(F.col("category")).alias("colour"), "category_rank").orderBy(F.desc("n"), "category_rank", "category").drop("category_rank")


def rule_counts(findings: DataFrame, catalog: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(rule_id, n) of every rule of the catalogue, 0 for those without a finding; rules that failed (rule_id) are left out."""
    n = findings.groupBy("rule_id").agg(F.count("*").alias("n"))
    out = catalog.select("rule_id").join(n, "rule_id", "left").select("rule_id", F.coalesce("n", F.lit(0)).alias("n"))
    return out if failed is None else out.join(failed, "rule_id", "left_anti")


def summary(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """One row: n_rows, n_files (in any case, blanks not counted), hidden, any_included."""
    files = F.count_distinct(F.when(F.trim("file_path") != "", F.upper("file_path")))
    a = shown.agg(F.count("*").alias("n_rows"), files.alias("n_files"), F.coalesce(F.bool_or("is_included"), F.lit(False)).alias("any_included"))
    return a.crossJoin(rows.agg(F.count("*").alias("total"))).select("n_rows", "n_files", (F.col("total") - F.col("n_rows")).alias("hidden"), "any_included")


def include_rule(rows: DataFrame, rule_id: str, include: bool) -> DataFrame:
    return rows.withColumn("is_included", F.when(F.lower("rule_id") == rule_id.lower(), F.lit(include)).otherwise(F.col("is_included")))


def toggle_all(rows: DataFrame) -> DataFrame:
    """All rows take the flag that at most half of them have now."""
    flag = rows.agg((F.count_if("is_included") <= F.count_if(~F.col("is_included"))).alias("_flag"))
    return rows.drop("is_included").crossJoin(F.broadcast(flag)).withColumnRenamed("_flag", "is_included")


def nearest(rows: DataFrame, path: str, line: int) -> DataFrame:
    """The row of a file whose line is nearest: where a selection goes after a new scan."""
    return rows.where(F.upper("file_path") == path.upper()).orderBy(F.abs(F.col("line_number") - line).asc_nulls_last(), "line_number").limit(1)


def export(rows: DataFrame) -> DataFrame:
    """(position, line): the text export of the included rows, one entry for each, after a heading at position 0."""
    kept = rows.where("is_included").withColumns({"_r": F.upper("rule_id"), "_p": F.upper("file_path"), "_l": F.coalesce("line_number", F.lit(2**31 - 1))})
    n = numbered(kept, ["category_rank", "_r", "_p", "_l", "message"], "position")
    body = n.select("position", F.concat(F.col("position").cast("string"), F.lit(". ["), "category", F.lit("] "), "location", F.lit("\n   "), F.trim(F.coalesce("message", F.lit(""))), F.lit("\n")).alias("line"))
    head = kept.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(0).cast("long").alias("position"), F.concat(F.lit("Findings\nScope: included\nCount: "), F.col("n").cast("string"), F.lit("\n")).alias("line"))
    return head.unionByName(body)


def with_preview(rows: DataFrame, files: DataFrame, around: int = 3) -> DataFrame:
    """Adds the lines around each finding, marked and numbered."""
    src = files.select("repo_id", F.col("path").alias("file_path"), F.col("lines").alias("_lines"))
    return rows.join(src, ["repo_id", "file_path"], "left").withColumn("preview", preview(F.col("_lines"), F.col("line_number"), around)).drop("_lines")


def fix_prompt(rows: DataFrame) -> DataFrame:
    """Adds `prompt`: what a person or a tool is asked to mend, with the lines around it (after with_preview)."""
    return rows.withColumn("prompt", F.concat_ws("\n", F.concat(F.lit("Please fix this finding in "), "location", F.lit(":")), "message", F.lit(""), F.col("preview")))


def log_colour(message: Column) -> Column:
    """Severity of a log line by its first marker in order of weight."""
    up = F.upper(message)
    return F.when(up.contains("ERROR"), "error").when(up.contains("PASS"), "pass").when(up.contains("WARNING"), "warning").when(up.contains("HINT"), "hint").otherwise("info")


#: What a comment on a change says, by rule; the other rules' comments are their messages.
COMMENTS = {
    "method-can-be-static": "Nothing of the instance is used here, so the method could be static.",
    "consecutive-boolean-arguments": "Two flags in a row are hard to tell apart at the call. Could they be named?",
    "consecutive-null-arguments": "Several nulls in a row are hard to tell apart at the call. Could they be named?",
    "lambda-can-be-method-group": "The lambda only passes its arguments on; the method's name would do.",
    "local-variable-prefix": "The prefix makes this local look like a field.",
    "public-method-argument-guards": "A caller could pass null here. Would an early check of the arguments help?",
    "numeric-string-culture-for-file-write": "The number's text depends on the machine's culture. The invariant one keeps the file readable everywhere.",
    "duplicate-code-block": "Much the same code is elsewhere in the repository already. Could it be shared?",
    "blank-line-between-brace-pairs": "The blank line between these two braces can go.",
    "private-field-can-be-readonly": "The field is only set while the object is made, so it could be readonly.",
    "private-field-used-in-single-method": "Only one method uses this field. Would a local variable do?",
    "unused-local-variable": "The local isn't read anywhere, so it can probably go.",
    "unused-private-member": "No code seems to use this private member, so it can probably go.",
    "unused-usings-roslyn": "This using isn't needed any more.",
    "property-can-be-auto-property": "An auto-property would say the same in one line.",
    "private-property-should-be-field": "A private property like this could be a plain field.",
    "private-get-only-auto-property-should-be-field": "A private property that is only read could be a readonly field.",
    "missing-blank-line-between-methods": "A blank line between the two methods would help the reader.",
    "if-else-unnecessary-braces": "Both branches are one statement, so the braces can go.",
    "if-else-brace-consistency": "One branch has braces and the other hasn't. The same for both reads better.",
    "unnecessary-enum-member-value": "The member would get this value anyway.",
    "boolean-literal-comparison": "A truth value needn't be compared with a literal.",
    "unnecessary-cast": "The expression has this type already, so the cast can go.",
    "redundant-self-lookup": "This looks up the object that it is called on; `this` is enough.",
    "unnecessary-verbatim-string-prefix": "Nothing in this string needs the verbatim prefix.",
}


def comment_text(rule_id: Column, message: Column) -> Column:
    """What is posted for a finding: its rule's sentence, else its message, "" for none."""
    m = F.create_map(*(F.lit(x) for kv in COMMENTS.items() for x in kv))
    return F.coalesce(F.try_element_at(m, rule_id), message, F.lit(""))


_FLAGS = ("can_open", "can_comment", "can_fix", "can_prompt", "is_posting", "has_posted", "is_fixing", "has_been_fixed")


def row_actions(rows: DataFrame) -> DataFrame:
    """Adds which actions a row offers now: open, comment, fix and prompt, of those that it can do (can_*). A flag that is missing or null is false.

    Only an included row offers any. One whose comment is being or has been posted offers no comment, one that is being or has been fixed no fix.
    """
    flag = {n: F.coalesce(F.col(n), F.lit(False)) if n in rows.columns else F.lit(False) for n in _FLAGS}
    on = F.coalesce(F.col("is_included"), F.lit(False))
    return rows.withColumns(
        {
            "open_active": flag["can_open"] & on,
            "comment_active": flag["can_comment"] & on & ~flag["is_posting"] & ~flag["has_posted"],
            "fix_active": flag["can_fix"] & on & ~flag["is_fixing"] & ~flag["has_been_fixed"],
            "prompt_active": flag["can_prompt"] & on,
        }
    )


def batch_state(rows: DataFrame, posting: bool = False, can_comment: bool = True) -> DataFrame:
    """One row: can_toggle, can_export, can_comment, of all rows together (after row_actions)."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return rows.agg((F.count("*") > 0).alias("can_toggle"), some("is_included").alias("can_export"), (some("comment_active") & F.lit(can_comment and not posting)).alias("can_comment"))


def summary_text(summary: DataFrame) -> DataFrame:
    """Adds the sentence over the list: findings, files, and how many are hidden, if any are."""
    n = lambda c: F.col(c).cast("string")
    return summary.withColumn("text", F.concat(n("n_rows"), F.lit(" finding(s) across "), n("n_files"), F.lit(" file(s)"), F.when(F.col("hidden") > 0, F.concat(F.lit(" ("), n("hidden"), F.lit(" hidden)"))).otherwise("")))
