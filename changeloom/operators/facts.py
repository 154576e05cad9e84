"""One pass over the files that parses what column expressions can't: catch blocks, RESX entries, markup elements, C# candidates.

The pass is a map: a file's facts are arrays on the file's row, so all the rules that look at one file read them without a join. A parser
never raises; what went wrong is the row's `error`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.functions import paths as P
from changeloom.operators import csharp, guards

CATCH = "array<struct<start_line:int,end_line:int,body:string,has_comments:boolean,variable:string,type:string>>"
ENTRY = "array<struct<key:string,value:string,line:int>>"
ELEMENT = "array<struct<id:int,parent:int,name:string,line:int,hook:boolean,bare:boolean,property:boolean,orientation:string,sizes:string,attribute_lines:array<int>,children:int,only_child:int>>"
CANDIDATE = "array<struct<rule_id:string,severity:string,line:int,message:string,first:int,last:int,extra:string>>"

_OPEN = re.compile(r"\bcatch\b\s*(?:\([^)]*\))?\s*\{", re.I)
_IDENT = re.compile(r"@?[A-Za-z_][A-Za-z0-9_]*")


def catch_blocks(text: str) -> list[dict]:
    """Catch blocks by pattern and brace depth; strings and comments aren't recognised."""
    out = []
    for m in _OPEN.finditer(text):
        a = m.end() - 1
        depth, b = 0, -1
        for x in re.finditer("[{}]", text[a:]):
            depth += 1 if x[0] == "{" else -1
            if not depth:
                b = a + x.start()
                break
        if b < 0:
            continue
        body = text[a + 1 : b]
        bare = re.sub(r"//.*?$", "", re.sub(r"/\*.*?\*/", "", body, flags=re.S), flags=re.M).strip()
        variable = kind = None
        head = m[0]
        if "(" in head and head.rfind(")") > head.find("("):
            inside = head[head.find("(") + 1 : head.rfind(")")]
            if found := list(_IDENT.finditer(inside)):
                last = found[-1]
                if last.start() and inside[last.start() - 1].isspace() and inside[: last.start()].strip():
                    variable = last[0]
            kind = inside.strip().split(" when ")[0].rstrip() or None
            if kind and (parts := re.match(r"(?s)(.*\S)\s+(@?[A-Za-z_][A-Za-z0-9_]*)$", kind)):
                kind = parts[1]
        out.append({"start_line": text.count("\n", 0, m.start()) + 1, "end_line": text.count("\n", 0, b) + 1, "body": bare, "has_comments": bool(re.search(r"//|/\*", body)), "variable": variable, "type": kind})
    return out


class _Tree(Exception):
    pass


def _parser() -> expat.XMLParserType:
    p = expat.ParserCreate(namespace_separator="\x01")

    def no_dtd(*_: object) -> None:
        raise _Tree("a document type isn't allowed")

    p.StartDoctypeDeclHandler = no_dtd
    p.buffer_text = True
    return p


def resx_entries(text: str) -> list[dict] | None:
    """Entries by key, the last of a key counts; None if the text isn't XML. The line is the value's, else the entry's."""
    p, found, stack = _parser(), {}, []
    order: list[str] = []

    def start(name: str, attrs: dict) -> None:
        local = name.split("\x01")[-1]
        top = next((s for s in reversed(stack) if s), None)
        if local == "data":
            stack.append({"name": attrs.get("name"), "line": p.CurrentLineNumber, "value": None, "depth": len(stack), "open": False})
        else:
            if local == "value" and top and top["value"] is None and len(stack) == top["depth"] + 1:
                top |= {"value": "", "line": p.CurrentLineNumber, "open": len(stack)}
            stack.append(None)

    def text_(s: str) -> None:
        for d in stack:
            if d and d["open"] is not False:
                d["value"] += s

    def end(_: str) -> None:
        d = stack.pop()
        if d is None:
            for x in stack:
                if x and x["open"] is not False and x["open"] == len(stack):
                    x["open"] = False
        elif d["name"] and d["name"].strip():
            if d["name"] not in found:
                order.append(d["name"])
            found[d["name"]] = {"key": d["name"], "value": d["value"] or "", "line": d["line"]}

    p.StartElementHandler, p.CharacterDataHandler, p.EndElementHandler = start, text_, end
    try:
        p.Parse(text.lstrip("﻿").encode(), True)
    except (expat.ExpatError, _Tree):
        return None
    return [found[k] for k in order]


_EVENTS = set("Loaded Unloaded Initialized AttachedToVisualTree DetachedFromVisualTree Click Tapped DoubleTapped PointerPressed PointerReleased PointerMoved PointerEntered PointerExited KeyDown KeyUp TextChanged SelectionChanged ValueChanged Checked Unchecked".split())
_XAML = "http://schemas.microsoft.com/winfx/2006/xaml"


def markup_elements(text: str) -> list[dict] | None:
    """Elements with what the container rules ask of them; None if the text isn't XML."""
    raw = text.lstrip("﻿").encode()
    p, out, stack = _parser(), [], []
    p.ordered_attributes = True

    def start(name: str, attrs: list) -> None:
        space, _, local = name.rpartition("\x01")
        at, line = p.CurrentByteIndex, p.CurrentLineNumber
        pairs = [(*n.rpartition("\x01")[::2], v) for n, v in zip(attrs[::2], attrs[1::2], strict=True)]
        end = raw.find(b">", at)
        source = raw[at : end + 1].decode(errors="replace")
        lines = [line + source.count("\n", 0, m.start(1)) for m in re.finditer(r"\s((?:Width|Height))\s*=", source)]
        values = {n: v for s, n, v in pairs if not s}
        hook = any((n == "Name" and s in ("", _XAML)) or (not s and (n in _EVENTS or n.endswith("Changed"))) for s, n, _ in pairs)
        sizes = "/".join(n for n in ("Width", "Height") if any(x == n and v.strip() for _, x, v in pairs))
        bare = not any(not (local == "StackPanel" and n == "Orientation") for _, n, _ in pairs)
        me = {"id": len(out), "parent": stack[-1] if stack else -1, "name": local, "line": line, "hook": hook, "bare": bare, "property": "." in local, "orientation": (values.get("Orientation") or "").strip() or "Vertical", "sizes": sizes, "attribute_lines": lines, "children": 0, "only_child": -1}
        if stack:
            up = out[stack[-1]]
            if me["property"]:
                up["bare"] = False
            else:
                up["children"] += 1
                up["only_child"] = me["id"]
        stack.append(me["id"])
        out.append(me)

    p.StartElementHandler, p.EndElementHandler = start, lambda _: stack.pop()
    try:
        p.Parse(raw, True)
    except (expat.ExpatError, _Tree):
        return None
    return out


_HINT = re.compile(r"\b(?:(?:x:)?DataType|d:DataContext)\s*=|\bd:Design(?:Instance|Data)\b|<\s*Design\.DataContext\b", re.I)
_SOURCE = re.compile(r"\b(?:ElementName|(?:Relative)?Source)\s*=|\bx:Reference\b|\$(?:parent|self|this)\b", re.I)


def untyped_bindings(text: str) -> list[dict] | None:
    """Bindings that depend on an inherited data context, as line ranges, where the document gives no type for it."""
    if _HINT.search(text):
        return []
    out = []
    for m in re.finditer(r"\{\s*(?:Compiled|Reflection)?Binding\b", text):
        depth, e = 0, len(text)
        for x in re.finditer(r"[{}]", text[m.start() :]):
            depth += 1 if x[0] == "{" else -1
            if not depth:
                e = m.start() + x.start()
                break
        if not _SOURCE.search(text[m.end() : e]):
            out.append({"first": text.count("\n", 0, m.start()) + 1, "last": text.count("\n", 0, e) + 1})
    return out


SPANS = "array<struct<first:int,last:int>>"
GUARDS = "array<struct<line:int,method:string,parameter:string>>"


def with_facts(files: DataFrame) -> DataFrame:
    """files with catches, entries, elements, bindings, guards, candidates (null where they don't apply or don't parse) and error.

    Names that files has already are taken as new ones: the facts replace them.
    """
    names = ("catches", "entries", "elements", "bindings", "guards", "candidates", "error")
    src = files.drop(*names)
    kinds = src.withColumns({"_markup": P.is_markup(F.col("path")), "_resx": P.is_resx(F.col("path")), "_cs": F.col("path").rlike(r"(?i)\.cs$")})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for text, markup, resx, cs in zip(pdf["text"], pdf["_markup"], pdf["_resx"], pdf["_cs"], strict=True):
                text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
                row = dict.fromkeys(names)
                try:
                    row["catches"] = catch_blocks(text)
                    if resx:
                        row["entries"] = resx_entries(text)
                    if markup:
                        row["elements"], row["bindings"] = markup_elements(text), untyped_bindings(text)
                    if cs:
                        row["guards"] = guards.unguarded(text.split("\n"))
                        row["candidates"] = csharp.candidates(text)
                except Exception as e:  # one file must not fail the scan
                    row["error"] = f"{type(e).__name__}: {e}"[:300]
                rows.append(row)
            yield pdf.drop(columns=["_markup", "_resx", "_cs"]).assign(**{n: [r[n] for r in rows] for n in names})

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    return kinds.mapInPandas(run, f"{ddl}, catches {CATCH}, entries {ENTRY}, elements {ELEMENT}, bindings {SPANS}, guards {GUARDS}, candidates {CANDIDATE}, error string")
