"""A C# lexer, a declaration parser, and the candidates of the rules that look at one C# file.

There is no compiler: types and bindings are judged by the names and declared types in the file itself (see model.confidence). A candidate has the
lines that a change must touch for it to count (first to last), so that one parse serves both scope views.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

MODIFIERS = frozenset("public private protected internal static readonly const abstract sealed virtual override async partial new extern unsafe volatile required file ref".split())
VALUE_TYPES = frozenset("bool byte sbyte short ushort int uint long ulong char float double decimal nint nuint DateTime DateTimeOffset TimeSpan Guid DateOnly TimeOnly".split())
KEYWORDS = frozenset("if else for foreach while do switch case default return throw try catch finally using lock fixed checked unchecked unsafe break continue goto yield await new typeof sizeof nameof is as in out ref this base null true false var get set init add remove when where stackalloc".split())
CONST_TYPES = frozenset("bool byte sbyte short ushort int uint long ulong char float double decimal string var".split())
TERMINALS = frozenset("Aggregate All Any Average Contains Count ElementAt First FirstOrDefault Last LastOrDefault LongCount Max Min Single SingleOrDefault Sum ToArray ToDictionary ToList ToHashSet".split())
DISPOSABLES = frozenset("FileStream MemoryStream StreamReader StreamWriter BinaryReader BinaryWriter HttpClient HttpResponseMessage SqlConnection SqlCommand Process Timer CancellationTokenSource SemaphoreSlim Mutex TcpClient UdpClient Socket NetworkStream GZipStream ZipArchive XmlReader XmlWriter StringReader StringWriter Bitmap Graphics WebClient FileSystemWatcher".split())
WRITERS = frozenset("WriteAllText WriteAllLines AppendAllText AppendAllLines WriteAllTextAsync WriteAllLinesAsync AppendAllTextAsync AppendAllLinesAsync".split())


@dataclass(slots=True)
class Tok:
    kind: str  # id num str chr op dir
    text: str
    at: int
    line: int


@dataclass
class Source:
    text: str
    toks: list[Tok]
    docs: list[tuple[int, str]]  # line and text of /// comments
    comments: list[tuple[int, int]]  # spans
    pair: list[int] = field(default_factory=list)
    broken: bool = False
    starts: list[int] = field(default_factory=list)

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)


_WORD = re.compile(r"@?[^\W\d]\w*")
_NUM = re.compile(r"0[xXbB][\da-fA-F_]+[uUlL]*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[fFdDmMuUlL]*|\.\d[\d_]*(?:[eE][+-]?\d+)?[fFdDmM]?")
_OPS = ("??=", "<<=", "...", "=>", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "&&", "||", "??", "?.", "++", "--", "<<", "->", "::", "..")
_QUOTE = re.compile(r'(\$*)("{3,})|(?:\$@|@\$|\$|@)?"')


def _string_end(s: str, i: int) -> int:
    """End of the string literal that starts at i."""
    m = _QUOTE.match(s, i)
    if m[2]:
        e = s.find(m[2], m.end())
        if e < 0:
            return -1
        e += len(m[2])
        while e < len(s) and s[e] == '"':
            e += 1
        return e
    head, j, n, depth = m[0], m.end(), len(s), 0
    verbatim, inter = "@" in head, "$" in head
    while j < n:
        c = s[j]
        if inter and depth:
            if c in "\"@$" and (q := _QUOTE.match(s, j)) and q[0]:
                j = _string_end(s, j)
                if j < 0:
                    return -1
                continue
            depth += (c == "{") - (c == "}")
            j += 1
        elif c == '"':
            if verbatim and s[j + 1 : j + 2] == '"':
                j += 2
                continue
            return j + 1
        elif c == "\\" and not verbatim:
            j += 2
        elif c == "\n" and not verbatim:
            return -1
        elif inter and c == "{":
            if s[j + 1 : j + 2] == "{":
                j += 2
            else:
                depth = 1
                j += 1
        else:
            j += 1
    return -1


def lex(text: str) -> Source:
    src = Source(text, [], [], [])
    src.starts = [0, *(m.end() for m in re.finditer("\n", text))]
    i, n, fresh = 0, len(text), True
    add = src.toks.append
    while i < n:
        c = text[i]
        if c == "\n":
            fresh = True
            i += 1
        elif c.isspace() or c == "﻿":
            i += 1
        elif text.startswith("//", i):
            e = text.find("\n", i)
            e = n if e < 0 else e
            if text.startswith("///", i) and not text.startswith("////", i):
                src.docs.append((src.line(i), text[i + 3 : e]))
            src.comments.append((i, e))
            i = e
        elif text.startswith("/*", i):
            e = text.find("*/", i + 2)
            if e < 0:
                src.broken = True
                break
            src.comments.append((i, e + 2))
            i = e + 2
        elif c == "#" and fresh:
            e = text.find("\n", i)
            e = n if e < 0 else e
            add(Tok("dir", text[i:e], i, src.line(i)))
            i = e
        elif (c in '"$' or c == "@") and (q := _QUOTE.match(text, i)):
            e = _string_end(text, i)
            if e < 0:
                src.broken = True
                break
            add(Tok("str", text[i:e], i, src.line(i)))
            fresh, i = False, e
        elif c == "'":
            m = re.compile(r"'(?:\\.[^']*|[^'\\\n])'").match(text, i)
            if not m:
                src.broken = True
                break
            add(Tok("chr", m[0], i, src.line(i)))
            fresh, i = False, m.end()
        elif m := _WORD.match(text, i):
            add(Tok("id", m[0], i, src.line(i)))
            fresh, i = False, m.end()
        elif c.isdigit() or (c == "." and text[i + 1 : i + 2].isdigit()):
            m = _NUM.match(text, i)
            add(Tok("num", m[0], i, src.line(i)))
            fresh, i = False, m.end()
        else:
            op = next((o for o in _OPS if text.startswith(o, i)), c)
            add(Tok("op", op, i, src.line(i)))
            fresh, i = False, i + len(op)
    stack: list[int] = []
    src.pair = [-1] * len(src.toks)
    close = {")": "(", "]": "[", "}": "{"}
    for k, t in enumerate(src.toks):
        if t.kind == "op":
            if t.text in "([{" and t.text:
                stack.append(k)
            elif t.text in close:
                if not stack or src.toks[stack[-1]].text != close[t.text]:
                    src.broken = True
                    break
                j = stack.pop()
                src.pair[j], src.pair[k] = k, j
    src.broken |= bool(stack)
    return src


@dataclass
class Member:
    kind: str  # method ctor property field enum_member event indexer
    name: str
    mods: frozenset[str]
    attrs: list[str]
    type: str
    params: list[tuple[str, str, str]]  # type, name, rest
    first: int  # token indices
    last: int
    name_at: int
    body: tuple[int, int] | None = None  # braces or expression
    arrow: bool = False
    init: tuple[int, int] | None = None
    explicit: bool = False
    generic: bool = False


@dataclass
class TypeDecl:
    kind: str
    name: str
    mods: frozenset[str]
    attrs: list[str]
    bases: list[str]
    first: int
    name_at: int
    open: int
    close: int
    members: list[Member] = field(default_factory=list)
    outer: TypeDecl | None = None


class Parser:
    def __init__(self, src: Source) -> None:
        self.s, self.t, self.pair = src, src.toks, src.pair
        self.types: list[TypeDecl] = []
        self.usings: list[tuple[int, int, str, bool]] = []
        if not src.broken:
            self.space(0, len(self.t))

    def x(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def kind(self, i: int) -> str:
        return self.t[i].kind if 0 <= i < len(self.t) else ""

    def joined(self, a: int, b: int) -> str:
        return "".join(self.t[k].text for k in range(a, b))

    def angle(self, i: int) -> int:
        """Index after the > that closes the < at i, or i if it isn't a type argument list."""
        depth, k = 0, i
        while k < len(self.t):
            x = self.x(k)
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif x in ("(", "["):
                k = self.pair[k]
            elif not (self.kind(k) == "id" or x in (",", ".", "?", "::", "*")):
                return i
            k += 1
        return i

    def type_end(self, i: int) -> int:
        """Index after the type that starts at i, or i."""
        k = i
        if self.x(k) == "ref":
            k += 1
        if self.x(k) == "(" and self.pair[k] > 0:
            k = self.pair[k] + 1
        elif self.kind(k) == "id" and (self.x(k) not in KEYWORDS or self.x(k) == "var"):
            k += 1
            while True:
                if self.x(k) == "<" and (e := self.angle(k)) > k:
                    k = e
                elif self.x(k) in (".", "::") and self.kind(k + 1) == "id":
                    k += 2
                else:
                    break
        else:
            return i
        while self.x(k) == "?" or (self.x(k) == "[" and all(self.x(j) == "," for j in range(k + 1, self.pair[k]))) or self.x(k) == "*":
            k = k + 1 if self.x(k) in "?*" else self.pair[k] + 1
        return k

    def attributes(self, i: int) -> tuple[int, list[str]]:
        names = []
        while self.x(i) == "[":
            e = self.pair[i]
            k = i + 1
            if self.x(k + 1) == ":":
                k += 2
            while k < e:
                if self.kind(k) == "id":
                    n = k
                    while self.x(n + 1) == "." and self.kind(n + 2) == "id":
                        n += 2
                    names.append(self.x(n).removesuffix("Attribute"))
                    k = n + 1
                while k < e and self.x(k) != ",":
                    k = self.pair[k] + 1 if self.x(k) in ("(", "[", "{") else k + 1
                k += 1
            i = e + 1
        return i, names

    def space(self, i: int, end: int) -> None:
        """Declarations of a namespace or a file."""
        while i < end:
            if self.kind(i) == "dir" or self.x(i) == ";":
                i += 1
            elif self.x(i) in ("using", "global") or (self.x(i) == "extern" and self.x(i + 1) == "alias"):
                k = i
                while k < end and self.x(k) != ";":
                    if self.x(k) in ("(", "{"):
                        break
                    k += 1
                if self.x(k) != ";":
                    i = self.statement(i, end)
                    continue
                self.usings.append((i, k, self.joined(i, k), self.x(i) == "global"))
                i = k + 1
            elif self.x(i) == "namespace":
                k = i
                while k < end and self.x(k) not in ("{", ";"):
                    k += 1
                if self.x(k) == "{":
                    self.space(k + 1, self.pair[k])
                    i = self.pair[k] + 1
                else:
                    i = k + 1
            else:
                i = self.declaration(i, end, None)

    def declaration(self, i: int, end: int, outer: TypeDecl | None) -> int:
        first = i
        i, attrs = self.attributes(i)
        mods = set()
        while self.x(i) in MODIFIERS and not (self.x(i) == "new" and self.x(i + 1) == "("):
            mods.add(self.x(i))
            i += 1
        x = self.x(i)
        if x in ("class", "struct", "interface", "enum") or (x == "record" and self.kind(i + 1) == "id"):
            kind = x
            i += 1
            if kind == "record" and self.x(i) in ("class", "struct"):
                i += 1
            name_at = i
            i += 1
            if self.x(i) == "<":
                i = self.angle(i)
            params = []
            if self.x(i) == "(":
                params = self.params(i)
                i = self.pair[i] + 1
            bases = []
            if self.x(i) == ":":
                i += 1
                while i < end and self.x(i) not in ("{", ";", "where"):
                    k = self.type_end(i)
                    if k > i:
                        bases.append(self.joined(i, k))
                        i = k
                    elif self.x(i) == "(":
                        i = self.pair[i] + 1
                    else:
                        i += 1
            while i < end and self.x(i) not in ("{", ";"):
                i += 1
            close = self.pair[i] if self.x(i) == "{" else i
            d = TypeDecl(kind, self.x(name_at), frozenset(mods), attrs, bases, first, name_at, i, close, [], outer)
            self.types.append(d)
            if self.x(i) == "{":
                if kind == "enum":
                    self.enum(d)
                else:
                    k = i + 1
                    while k < close:
                        if self.kind(k) == "dir" or self.x(k) == ";":
                            k += 1
                            continue
                        k = max(k + 1, self.declaration(k, close, d))
            return close + 1
        if x == "delegate":
            while i < end and self.x(i) != ";":
                i += 1
            return i + 1
        if outer is None:
            return self.statement(first, end)
        return self.member(first, i, end, frozenset(mods), attrs, outer)

    def enum(self, d: TypeDecl) -> None:
        i = d.open + 1
        while i < d.close:
            first = i
            i, attrs = self.attributes(i)
            if self.kind(i) != "id":
                i += 1
                continue
            name_at = i
            k = i + 1
            init = None
            if self.x(k) == "=":
                e = k + 1
                while e < d.close and self.x(e) != ",":
                    e = self.pair[e] + 1 if self.x(e) == "(" else e + 1
                init = (k + 1, e)
                k = e
            d.members.append(Member("enum_member", self.x(name_at), frozenset(), attrs, d.name, [], first, k - 1, name_at, init=init))
            i = k + 1

    def params(self, open_: int) -> list[tuple[str, str, str]]:
        out, k, end = [], open_ + 1, self.pair[open_]
        while k < end:
            k, _ = self.attributes(k)
            rest = []
            while self.x(k) in ("this", "out", "ref", "in", "params", "scoped", "readonly"):
                rest.append(self.x(k))
                k += 1
            e = self.type_end(k)
            if e == k:
                break
            kind, name = self.joined(k, e), self.x(e)
            k = e + 1
            if self.x(k) == "=":
                rest.append("=")
            while k < end and self.x(k) != ",":
                k = self.pair[k] + 1 if self.x(k) in ("(", "[", "{") else k + 1
            out.append((kind, name, " ".join(rest)))
            k += 1
        return out

    def until(self, i: int, end: int, stop: tuple[str, ...]) -> int:
        while i < end and self.x(i) not in stop:
            i = self.pair[i] + 1 if self.x(i) in ("(", "[", "{") and self.pair[i] > i else i + 1
        return i

    def member(self, first: int, i: int, end: int, mods: frozenset[str], attrs: list[str], d: TypeDecl) -> int:
        event = self.x(i) == "event"
        i += event
        if self.x(i) == "~":
            k = self.until(i + 1, end, ("{", ";", "=>"))
            return self.pair[k] + 1 if self.x(k) == "{" else self.until(k, end, (";",)) + 1
        start, e = i, self.type_end(i)
        if self.x(i) in ("implicit", "explicit"):
            e = i + 1
        if self.x(i) == d.name.lstrip("@") and self.x(i + 1) == "(":
            kind, name_at, k, type_ = "ctor", i, i + 1, ""
        elif e > i and self.x(e) in ("operator", "this") or self.x(i) in ("implicit", "explicit"):
            kind, name_at, type_ = ("indexer" if self.x(e) == "this" else "operator"), e, self.joined(i, e)
            k = self.until(e, end, ("{", "=>", ";")) if kind == "indexer" else e
            while kind == "operator" and k < end and self.x(k) != "(":
                k += 1
        elif e > i and self.kind(e) == "id":
            type_, name_at = self.joined(i, e), e
            k = e + 1
            explicit = False
            while True:
                if self.x(k) == "<" and (g := self.angle(k)) > k:
                    k = g
                elif self.x(k) == "." and self.kind(k + 1) == "id":
                    explicit, name_at, k = True, k + 1, k + 2
                elif self.x(k) == "." and self.x(k + 1) == "this":
                    explicit, k = True, self.pair[k + 2] + 1
                else:
                    break
            kind = "method" if self.x(k) == "(" else "property" if self.x(k) in ("{", "=>") else "field"
            m_explicit = explicit
        else:
            return self.until(i, end, (";", "{")) + 1 if self.x(i) != "{" else self.pair[i] + 1
        m = Member("event" if event else kind, self.x(name_at), mods, attrs, type_, [], first, k, name_at)
        m.explicit = kind in ("method", "property") and locals().get("m_explicit", False)
        if kind in ("method", "ctor", "operator"):
            m.params = self.params(k)
            m.generic = self.x(name_at + 1) == "<"
            k = self.until(self.pair[k] + 1, end, ("{", "=>", ";"))
        if kind == "field":
            k = name_at
            while True:
                one = Member(m.kind, self.x(k), mods, attrs, type_, [], first, k, k)
                e = self.until(k, end, (",", ";"))
                if self.x(k + 1) == "=":
                    one.init = (k + 2, e)
                one.last = e
                d.members.append(one)
                if self.x(e) != ",":
                    return e + 1
                k = e + 1
        if self.x(k) == "{":
            m.body, last = (k, self.pair[k]), self.pair[k]
            if kind in ("property", "indexer") and self.x(last + 1) == "=":
                e = self.until(last + 2, end, (";",))
                m.init, last = (last + 2, e), e
        elif self.x(k) == "=>":
            e = self.until(k, end, (";",))
            m.body, m.arrow, last = (k, e), True, e
        else:
            last = k
        m.last = last
        d.members.append(m)
        return last + 1

    def statement(self, i: int, end: int) -> int:
        """Index after the statement at i."""
        x = self.x(i)
        if i >= end:
            return end
        if x == "{":
            return self.pair[i] + 1
        if x in ("if", "while", "for", "foreach", "using", "lock", "fixed", "switch") or (x == "await" and self.x(i + 1) in ("foreach", "using")):
            k = i + 1 + (x == "await")
            if self.x(k) == "(":
                e = self.statement(self.pair[k] + 1, end)
                if x == "if" and self.x(e) == "else":
                    e = self.statement(e + 1, end)
                return e
        if x == "else":
            return self.statement(i + 1, end)
        if x == "do":
            return self.until(self.statement(i + 1, end), end, (";",)) + 1
        if x in ("try", "finally", "unsafe", "checked", "unchecked") and self.x(i + 1) == "{":
            e = self.pair[i + 1] + 1
            while self.x(e) in ("catch", "finally"):
                e = self.pair[self.until(e + 1, end, ("{",))] + 1
            return e
        return self.until(i, end, (";",)) + 1

    def at_start(self, k: int) -> bool:
        """Whether a statement can start at k."""
        p = self.x(k - 1)
        if p in (";", "{", "}", "else", "do", ":") or self.kind(k - 1) == "dir":
            return True
        return p == ")" and self.x(self.pair[k - 1] - 1) in ("if", "while", "for", "foreach", "using", "lock", "fixed")

    def locals(self, a: int, b: int) -> list[tuple[str, str, int, int, int]]:
        """(type, name, name index, initialiser start or -1, statement end) of local variables in a body."""
        out = []
        for k in range(a, b):
            if self.at_start(k) or (self.x(k - 1) == "(" and self.x(k - 2) in ("for", "using")) or (self.x(k - 1) in ("const", "using") and self.at_start(k - 1)):
                e = self.type_end(k)
                if e > k and self.kind(e) == "id" and self.x(e) not in KEYWORDS and self.x(k) not in ("return", "throw", "yield", "await", "goto") and self.x(e + 1) in ("=", ";", ",", ):
                    kind, n = self.joined(k, e), e
                    while True:
                        stop = self.until(n, b, (",", ";"))
                        out.append((kind, self.x(n), n, n + 2 if self.x(n + 1) == "=" else -1, stop))
                        if self.x(stop) != "," or self.kind(stop + 1) != "id":
                            break
                        n = stop + 1
        return out

    def args(self, open_: int) -> list[tuple[int, int]]:
        out, k, end = [], open_ + 1, self.pair[open_]
        while k < end:
            e = self.until(k, end, (",",))
            out.append((k, e))
            k = e + 1
        return out


def _trivial_get(p: Parser, m: Member) -> str | None:
    """Name of the field that the getter just returns."""
    if m.arrow:
        return p.x(m.body[0] + 1) if m.body[1] == m.body[0] + 2 and p.kind(m.body[0] + 1) == "id" else None
    acc = accessors(p, m)
    if "get" not in acc:
        return None
    k, e = acc["get"]
    body = [p.x(j) for j in range(k, e)]
    if len(body) == 3 and body[0] == "=>" and body[2] == ";":
        return body[1]
    return body[2] if len(body) == 5 and body[:2] == ["{", "return"] and body[3:] == [";", "}"] else None


def accessors(p: Parser, m: Member) -> dict[str, tuple[int, int]]:
    """Token ranges of the accessors' bodies ((k, k + 1) at a semicolon), by name; "private set" has its modifiers in front."""
    out: dict[str, tuple[int, int]] = {}
    if not m.body or m.arrow:
        return out
    k, end = m.body[0] + 1, m.body[1]
    while k < end:
        k, _ = p.attributes(k)
        mods = []
        while p.x(k) in MODIFIERS:
            mods.append(p.x(k))
            k += 1
        name = " ".join([*mods, p.x(k)])
        k += 1
        e = p.pair[k] + 1 if p.x(k) == "{" else p.until(k, end, (";",)) + 1
        out[name] = (k, e)
        k = e
    return out


def candidates(text: str) -> list[dict]:
    """Findings of all single-file C# rules, before the scope is applied. A file that doesn't parse has only those of the lexer."""
    src = lex(text)
    p = Parser(src)
    out: list[dict] = []

    def add(rule: str, severity: str, line: int, message: str, first: int | None = None, last: int | None = None, extra: str | None = None) -> None:
        out.append({"rule_id": rule, "severity": severity, "line": line, "message": message, "first": first or line, "last": last or first or line, "extra": extra})

    from changeloom.operators import csharp_rules

    csharp_rules.run(p, add)
    return out
