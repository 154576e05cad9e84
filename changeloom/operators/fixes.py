"""Fixes: a finding and its file's text become a new text. One fix for each file and pass; a scan after it sees what is left."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom import model, ship
from changeloom.operators import csharp
from changeloom.operators.csharp import Parser

Fix = Callable[[str, int, str], str | None]
FIXERS: dict[str, Fix] = {}


def fixer(rule: str) -> Callable[[Fix], Fix]:
    def add(f: Fix) -> Fix:
        FIXERS[rule] = f
        return f

    return add


def _parse(text: str) -> Parser | None:
    p = Parser(csharp.lex(text))
    return None if p.s.broken else p


def _cut(text: str, a: int, b: int, new: str = "") -> str:
    return text[:a] + new + text[b:]


def _drop_lines(text: str, first: int, last: int) -> str:
    rows = text.splitlines(keepends=True) if not text else re.findall(r"[^\n]*\n|[^\n]+$", text)
    return "".join(rows[: first - 1] + rows[last:])


def _ends(text: str) -> str:
    return "\r\n" if "\r\n" in text else "\n"


@fixer("blank-line-between-brace-pairs")
def _brace_gap(text: str, line: int, _: str) -> str | None:
    rows = re.findall(r"[^\n]*\n|[^\n]+$", text)
    a = min(line, len(rows)) - 1
    if a < 0 or rows[a].strip() not in ("{", "}"):
        return None
    b = a  # the second brace; the blank lines above it go
    while a > 0 and not rows[a - 1].strip():
        a -= 1
    if a in (0, b) or rows[a - 1].strip() != rows[b].strip():
        return None
    return "".join(rows[:a] + rows[b:])


@fixer("missing-blank-line-between-methods")
def _blank_line(text: str, line: int, _: str) -> str | None:
    rows = re.findall(r"[^\n]*\n|[^\n]+$", text)
    if not 1 < line <= len(rows) or not rows[line - 2].strip():
        return None
    return "".join([*rows[: line - 1], _ends(text), *rows[line - 1 :]])


@fixer("unused-usings-roslyn")
def _using(text: str, line: int, _: str) -> str | None:
    rows = re.findall(r"[^\n]*\n|[^\n]+$", text)
    if line > len(rows) or not re.match(r"\s*using\b[^(]*;\s*(//.*)?$", rows[line - 1].rstrip()):
        return None
    return _drop_lines(text, line, line)


@fixer("warning-suppression")
def _suppression(text: str, line: int, _: str) -> str | None:
    rows = re.findall(r"[^\n]*\n|[^\n]+$", text)
    row = rows[line - 1] if line <= len(rows) else ""
    if re.match(r"\s*#\s*pragma\s+warning\s+disable\b", row) or re.match(r"\s*\[\s*(\w+:\s*)?[\w.]*SuppressMessage(Attribute)?\s*(\(.*\))?\s*\]\s*$", row):
        return _drop_lines(text, line, line)
    m = re.search(r"\[\s*(\w+:\s*)?[\w.]*SuppressMessage(Attribute)?\s*\([^)\n]*\)\s*\]\s?", row)
    if not m:
        return None
    rows[line - 1] = row[: m.start()] + row[m.end() :]
    return "".join(rows)


@fixer("throw-ex-in-catch")
def _throw(text: str, line: int, _: str) -> str | None:
    return _in_line(text, line, r"\bthrow\s+@?\w+\s*;", "throw;")


def _in_line(text: str, line: int, pattern: str, new: str) -> str | None:
    rows = re.findall(r"[^\n]*\n|[^\n]+$", text)
    if line > len(rows):
        return None
    out, n = re.subn(pattern, new, rows[line - 1], count=1)
    rows[line - 1] = out
    return "".join(rows) if n else None


@fixer("unnecessary-verbatim-string-prefix")
def _verbatim(text: str, line: int, _: str) -> str | None:
    src = csharp.lex(text)
    for t in src.toks:
        if t.kind == "str" and t.line == line and re.match(r'@"|\$@"|@\$"', t.text) and not re.search(r'[\\\n]|""', t.text[t.text.index('"') + 1 : -1]):
            return _cut(text, t.at, t.at + len(t.text), t.text.replace("@", "", 1))
    return None


@fixer("unnecessary-enum-member-value")
def _enum_value(text: str, line: int, _: str) -> str | None:
    p = _parse(text)
    for d in p.types if p else ():
        for m in d.members:
            if m.kind == "enum_member" and m.init and p.t[m.name_at].line == line:
                a, last = p.t[m.name_at], p.t[m.init[1] - 1]
                return _cut(text, a.at + len(a.text), last.at + len(last.text))
    return None


@fixer("redundant-self-lookup")
def _self(text: str, line: int, _: str) -> str | None:
    return _in_line(text, line, r"\b([A-Za-z_]\w*)\.Get\1\s*\(\s*this\s*\)", "this")


@fixer("method-can-be-static")
def _static(text: str, line: int, _: str) -> str | None:
    p = _parse(text)
    for d in p.types if p else ():
        for m in d.members:
            if m.kind == "method" and p.t[m.first].line <= line <= p.t[m.name_at].line and "static" not in m.mods:
                k = m.first
                k, _n = p.attributes(k)
                if p.x(k) in ("private", "internal", "protected", "public"):
                    at = p.t[k].at + len(p.x(k))
                    return _cut(text, at, at, " static")
                return _cut(text, p.t[k].at, p.t[k].at, "static ")
    return None


@fixer("local-variable-can-be-const")
def _const(text: str, line: int, message: str) -> str | None:
    p = _parse(text)
    for d in p.types if p else ():
        for m in d.members:
            for kind, name, at, init, stop in p.locals(m.body[0] + 1, m.body[1]) if m.body else ():
                if p.t[at].line != line or init < 0 or f"'{name}'" not in message and f"`{name}`" not in message:
                    continue
                first = at - 1
                while first > 0 and not p.at_start(first):
                    first -= 1
                value = p.x(stop - 1)
                literal = "string" if p.kind(stop - 1) == "str" else "char" if p.kind(stop - 1) == "chr" else "bool" if value in ("true", "false") else _number(value)
                start = p.t[first]
                return _cut(text, start.at, start.at + (len("var") if kind == "var" else 0), f"const {literal if kind == 'var' else ''}")
    return None


def _number(value: str) -> str:
    v = value.lower()
    if v.startswith("0x"):
        return "int"
    if v.endswith("m"):
        return "decimal"
    if v.endswith("f"):
        return "float"
    if v.endswith("d") or "." in v or "e" in v:
        return "double"
    return {"u": "uint", "l": "long", "ul": "ulong", "lu": "ulong"}.get(re.sub(r"[\d_]", "", v), "int")


@fixer("lambda-can-be-method-group")
def _lambda(text: str, line: int, message: str) -> str | None:
    m = re.search(r"['`]([\w.]+)['`]", message)
    if not m:
        return None
    return _in_line(text, line, rf"(\([^()]*\)|@?\w+)\s*=>\s*{re.escape(m[1])}\s*\([^()]*\)", m[1])


@fixer("unused-private-member")
def _unused(text: str, line: int, message: str) -> str | None:
    if not re.match(r"Private method\b", message):
        return None
    p = _parse(text)
    for d in p.types if p else ():
        for m in d.members:
            if m.kind == "method" and p.t[m.first].line <= line <= p.t[m.name_at].line:
                first, last = p.t[m.first].line, p.t[m.last].line
                docs = [n for n, _ in p.s.docs]
                while first - 1 in docs:
                    first -= 1
                return _drop_lines(text, first, last)
    return None


def _branches(p: Parser, line: int) -> tuple[int, int, int, int] | None:
    for k, t in enumerate(p.t):
        if t.text == "if" and t.kind == "id" and t.line == line and p.x(k + 1) == "(":
            a = p.pair[k + 1] + 1
            ae = p.statement(a, len(p.t))
            if p.x(ae) == "else" and p.x(ae + 1) != "if":
                return a, ae, ae + 1, p.statement(ae + 1, len(p.t))
    return None


def _span(p: Parser, a: int, e: int) -> tuple[int, int]:
    last = p.t[e - 1]
    return p.t[a].at, last.at + len(last.text)


def _inner(p: Parser, a: int, e: int) -> str:
    x, y = p.t[a + 1], p.t[e - 2]
    return p.s.text[x.at : y.at + len(y.text)]


def _indent(text: str, at: int) -> str:
    start = text.rfind("\n", 0, at) + 1
    return re.match(r"[ \t]*", text[start:])[0]


@fixer("if-else-unnecessary-braces")
def _unwrap(text: str, line: int, _: str) -> str | None:
    from changeloom.operators.csharp_rules import _simple_block

    p = _parse(text)
    at = _branches(p, line) if p else None
    if not at or p.x(at[0]) != "{" or p.x(at[2]) != "{" or not (_simple_block(p, at[0], at[1]) and _simple_block(p, at[2], at[3])):
        return None
    for a, e in ((at[2], at[3]), (at[0], at[1])):
        x, y = _span(p, a, e)
        head = text[:x].rstrip()
        step = "    " if "\t" not in _indent(text, x) else "\t"
        text = head + _ends(text) + _indent(text, p.t[at[0]].at if a == at[0] else p.t[at[1]].at) + step + _inner(p, a, e) + text[y:]
    return text


@fixer("if-else-brace-consistency")
def _same_braces(text: str, line: int, _: str) -> str | None:
    """Unwraps the block if it holds one simple statement, else gives the other branch braces."""
    from changeloom.operators.csharp_rules import _simple_block

    p = _parse(text)
    at = _branches(p, line) if p else None
    if not at or (p.x(at[0]) == "{") == (p.x(at[2]) == "{"):
        return None
    block, bare = ((at[0], at[1]), (at[2], at[3])) if p.x(at[0]) == "{" else ((at[2], at[3]), (at[0], at[1]))
    nl = _ends(text)
    if _simple_block(p, *block):
        x, y = _span(p, *block)
        pad = _indent(text, p.t[block[0] - 1].at)
        return text[:x].rstrip() + nl + pad + ("\t" if "\t" in pad else "    ") + _inner(p, *block) + text[y:]
    x, y = _span(p, *bare)
    pad = _indent(text, p.t[bare[0] - 1].at)
    step = "\t" if "\t" in pad else "    "
    return text[:x].rstrip() + nl + pad + "{" + nl + pad + step + text[x:y] + nl + pad + "}" + text[y:]


def collapse_blank_runs(text: str, line: int, around: int = 4) -> str:
    """Runs of blank lines within some lines of a place become one blank line."""
    rows = re.findall(r"[^\n]*\n|[^\n]+$", text)
    out = []
    for i, r in enumerate(rows):
        near = abs(i + 1 - line) <= around
        if near and not r.strip() and out and not out[-1].strip():
            continue
        out.append(r)
    return "".join(out)


def fix_text(rule: str, text: str, line: int, message: str) -> tuple[str | None, str]:
    """(new text, what happened); the text is None if nothing was changed."""
    if rule not in FIXERS:
        return None, "This finding can't be fixed automatically."
    if text is None:
        return None, "The file isn't there."
    if not 1 <= line <= text.count("\n") + 1:
        return None, "The line is out of range."
    try:
        new = FIXERS[rule](text, line, message or "")
    except Exception as e:
        return None, f"The fix failed: {e}"
    if new is None or new == text:
        return None, "Nothing to fix was found at the line."
    return (collapse_blank_runs(new, line) if rule in ("unused-private-member", "warning-suppression", "unused-usings-roslyn") else new), "Fixed."


def fixed_files(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, path, rule_id, line_number, new_text, fixed, result): the first fixable finding of each file, applied to its text.

    First is the one furthest down: fixing from the end keeps the lines of the others right. A finding whose file is missing is reported.
    """
    ship(files.sparkSession)
    w = Window.partitionBy("repo_id", "file_path").orderBy(F.desc("line_number"), "rule_id", "message")
    pick = findings.where(F.col("rule_id").isin(*sorted(model.FIXABLE))).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    both = pick.select("repo_id", F.col("file_path").alias("path"), "rule_id", "line_number", "message").join(files.select("repo_id", "path", "text"), ["repo_id", "path"], "left")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = [fix_text(*x) for x in zip(pdf["rule_id"], pdf["text"], pdf["line_number"], pdf["message"], strict=True)]
            yield pdf[["repo_id", "path", "rule_id", "line_number"]].assign(new_text=[g[0] for g in got], fixed=[g[0] is not None for g in got], result=[g[1] for g in got])

    return both.mapInPandas(run, "repo_id string, path string, rule_id string, line_number int, new_text string, fixed boolean, result string")
