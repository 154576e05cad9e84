"""Public methods whose reference arguments are dereferenced without a guard, line by line as they are written."""

from __future__ import annotations

import re

SIGNATURE_LINES, GUARD_LINES = 16, 24
_VALUES = frozenset("bool byte sbyte short ushort int uint long ulong nint nuint char float double decimal datetime datetimeoffset timespan guid intptr uintptr cancellationtoken dateonly timeonly".split())
_MODS = r"(?:(?:static|virtual|override|sealed|abstract|unsafe|new|partial|extern|async)\s+)*"
_HEAD = re.compile(rf"(?i)\s*public\s+{_MODS}[A-Za-z_][\w<>,.\[\]?\s:]*\s+([A-Za-z_]\w*)\s*\((.*)\)\s*(?:where\s+.+)?$")


def _split(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth = max(0, depth + (c in "<([") - (c in ">)]"))
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]] if text[start:].strip() else out


def _guarded_parameters(params: str) -> list[str]:
    names = []
    for raw in _split(params):
        raw = re.sub(r"^(\s*\[[^\]]+\]\s*)+", "", raw).strip()
        if re.match(r"(?i)(scoped\s+)?(this|out)\b", raw) or "=" in raw:
            continue
        parts = [w for w in raw.split() if w.lower() not in ("ref", "in", "params", "scoped")]
        if len(parts) < 2:
            continue
        kind = " ".join(parts[:-1])
        if kind.endswith("?") or re.match(r"(System\.)?Nullable<", kind) or not (kind.startswith("(") or kind.lower().removeprefix("system.") in _VALUES):
            names.append(parts[-1].lstrip("@"))
    return names


def _dereferenced(body: str, name: str) -> bool:
    n = re.escape(name)
    return any(re.search(x, body) for x in (rf"(?<![\w.])@?{n}\s*\.(?!\.)", rf"(?<![\w.])@?{n}\s*\[", rf"\bin\s+@?{n}\s*\)", rf"(?<![\w.])@?{n}!\s*[.\[]"))


def _has_guard(window: str, name: str) -> bool:
    n = re.escape(name)
    return any(
        re.search(x, window)
        for x in (rf"Throw\w*\s*\(\s*@?{n}\b", rf"@?\b{n}\s*(==|!=|is|is\s+not)\s*null", rf"null\s*(==|!=)\s*@?{n}\b", rf"IsNullOr\w+\s*\(\s*@?{n}\b", rf"@?\b{n}\s*\?\?", rf"nameof\s*\(\s*@?{n}\s*\)")
    )


def unguarded(lines: list[str]) -> list[dict]:
    """(line, method, parameters) of each line that starts such a method with a block body."""
    out = []
    for i, first in enumerate(lines):
        if "public" not in first or "(" not in first:
            continue
        head, balance, seen, open_ = "", 0, False, -1
        for j in range(i, min(len(lines), i + SIGNATURE_LINES)):
            head += " " + lines[j].strip()
            balance += lines[j].count("(") - lines[j].count(")")
            seen |= "(" in lines[j]
            if not seen or balance > 0:
                continue
            at = j if "{" in lines[j] else j + 1 if j + 1 < len(lines) and "{" in lines[j + 1] else -1
            open_ = at
            break
        if open_ < 0:
            continue
        text = " ".join(head.split("{")[0].split())
        m = _HEAD.match(text)
        if not m or "=>" in text:
            continue
        depth, close = 0, -1
        for j in range(open_, len(lines)):
            depth += lines[j].count("{") - lines[j].count("}")
            if depth <= 0:
                close = j
                break
        if close <= open_:
            continue
        if m[1] == "Main" and re.search(r"\bstatic\b", text) and re.sub(r"\s+", "", m[2]) in ("", "string[]args", "string[]@args"):
            continue
        body = lines[open_ + 1 : close]
        window = "\n".join([x for x in body if x.strip()][:GUARD_LINES])
        bad = [p for p in _guarded_parameters(m[2]) if _dereferenced("\n".join(body), p) and not _has_guard(window, p)]
        if bad:
            out.append({"line": i + 1, "method": m[1], "parameter": ", ".join(bad)})
    return out
