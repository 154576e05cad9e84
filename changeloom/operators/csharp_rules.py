"""The rules over one parsed C# file. Each takes the parser and a function that adds a candidate."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import pairwise

from changeloom.operators.csharp import CONST_TYPES, DISPOSABLES, KEYWORDS, TERMINALS, VALUE_TYPES, WRITERS, Member, Parser, TypeDecl, _trivial_get, accessors

Add = Callable[..., None]
RULES: list[Callable[[Parser, Add], None]] = []


def rule(f: Callable[[Parser, Add], None]) -> Callable[[Parser, Add], None]:
    RULES.append(f)
    return f


def run(p: Parser, add: Add) -> None:
    # A file that doesn't parse has only the findings that need no parse.
    for f in (suppressions, doc_tags) if p.s.broken else RULES:
        f(p, add)


def line(p: Parser, k: int) -> int:
    return p.t[min(k, len(p.t) - 1)].line


def end_line(p: Parser, k: int) -> int:
    t = p.t[min(k, len(p.t) - 1)]
    return t.line + t.text.count("\n")


def methods(p: Parser, *kinds: str) -> list[tuple[TypeDecl, Member]]:
    return [(d, m) for d in p.types for m in d.members if m.kind in (kinds or ("method",))]


def private(d: TypeDecl, m: Member) -> bool:
    return "private" in m.mods and "protected" not in m.mods or (not m.mods & {"public", "protected", "internal", "private"} and d.kind != "interface" and not m.explicit)


def uses(p: Parser, name: str, a: int, b: int) -> list[int]:
    """Places of the name that aren't a member of something else (this.name counts)."""
    return [k for k in range(a, b) if p.t[k].text == name and p.t[k].kind == "id" and not (p.x(k - 1) in (".", "?.") and p.x(k - 2) != "this") and not (p.x(k + 1) == ":" and p.x(k - 1) in ("(", ","))]


def in_strings(p: Parser, name: str, a: int, b: int) -> bool:
    """Whether an interpolated string between a and b holds the name in a hole."""
    return any(p.t[k].kind == "str" and "$" in p.t[k].text[:2] and re.search(rf"\{{[^{{}}]*\b{re.escape(name)}\b", p.t[k].text) for k in range(a, b))


def written(p: Parser, k: int) -> bool:
    """Whether the name at k is assigned, counted up or down, or passed by reference."""
    after, before = p.x(k + 1), p.x(k - 1)
    if before == "." and p.x(k - 2) == "this":
        before = p.x(k - 3)
    return after in ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "??=", "<<=", "++", "--") or before in ("++", "--", "ref", "out")


@rule
def async_methods(p: Parser, add: Add) -> None:
    for _, m in methods(p):
        if "async" not in m.mods:
            continue
        at = first = line(p, m.first)
        handler = len(m.params) == 2 and m.params[0][0].rstrip("?") in ("object", "Object", "System.Object") and m.params[1][0].rstrip("?").endswith("EventArgs")
        command = "override" in m.mods and m.name == "Execute" and len(m.params) == 1 and m.params[0][0].rstrip("?") == "object"
        if m.type == "void" and not handler and not command:
            add("async-void", "Important", at, f"Suspicious 'async void' method '{m.name}': its exceptions can't be awaited. Return a Task.", first)
        tested = {"Test", "TestCase", "TestCaseSource", "Fact", "Theory", "TestMethod", "DataTestMethod", "SetUp", "TearDown", "OneTimeSetUp", "OneTimeTearDown"} & set(m.attrs)
        if m.mods & {"public", "private", "internal"} and not m.name.endswith("Async") and "override" not in m.mods and not m.explicit and not tested:
            add("async-method-name-suffix", "Hint", at, f"Async method '{m.name}' lacks the suffix 'Async'.", first)


@rule
def properties(p: Parser, add: Add) -> None:
    for d, m in methods(p, "property"):
        if d.kind == "interface" or not m.body:
            continue
        first = line(p, m.first)
        acc = accessors(p, m)
        names = {n.split()[-1]: v for n, v in acc.items()}
        auto = bool(acc) and all(p.x(k) == ";" for k, _ in acc.values())
        got = _trivial_get(p, m)
        wraps = False
        fields = {f.name for f in d.members if f.kind == "field"}
        if got in fields and "set" in names:
            k, e = names["set"]
            body = [p.x(j) for j in range(k, e)]
            wraps = body in (["=>", got, "=", "value", ";"], ["{", got, "=", "value", ";", "}"])
        if wraps and not private(d, m):
            add("property-can-be-auto-property", "Hint", first, f"Property '{m.name}' only wraps field `{got}` and can be an auto-property.", first)
        if private(d, m):
            if auto and list(names) == ["get"]:
                add("private-get-only-auto-property-should-be-field", "Hint", first, f"Private get-only auto property `{m.name}` can be a field.", first)
            elif (auto and {"get", "set"} <= set(names)) or wraps:
                add("private-property-should-be-field", "Hint", first, f"Private property '{m.name}' looks like a field and can be one.", first)


@rule
def method_spacing(p: Parser, add: Add) -> None:
    for d in p.types:
        for a, b in pairwise([m for m in d.members if m.kind == "method" and m.body and not m.arrow]):
            if line(p, b.first) <= end_line(p, a.last) + 1:  # either method's lines count
                add("missing-blank-line-between-methods", "Hint", line(p, b.first), f"No blank line between methods `{a.name}` and `{b.name}`.", line(p, a.first), end_line(p, b.last))


@rule
def shapes(p: Parser, add: Add) -> None:
    for d, m in methods(p, "method", "ctor"):
        if len(m.params) >= 8:
            add("method-parameter-count", "Hint", line(p, m.first), f"{'Constructor' if m.kind == 'ctor' else 'Method'} '{m.name}' has {len(m.params)} parameters. Consider a parameter object.", line(p, m.first))
        if m.kind == "ctor" and m.body and not m.arrow:
            rows = p.s.text[p.t[m.body[0]].at + 1 : p.t[m.body[1]].at].split("\n")
            n = sum(1 for r in rows if r.strip() and not r.strip().startswith("//"))
            if n >= 20:
                add("constructor-too-long", "Suggestion", line(p, m.first), f"Constructor '{d.name}' has {n} code lines. Consider moving work out of it.", line(p, m.first), end_line(p, m.last))
    for d in p.types:
        if d.kind == "class" and re.search(r"(Utils|Helper|Manager|Utilities)$", d.name):
            suffix = re.search(r"(Utils|Helper|Manager|Utilities)$", d.name)[1]
            add("generic-type-name-suffix", "Hint", line(p, d.first), f"Class name '{d.name}' has the generic suffix '{suffix}'. Consider a more specific name.")
    top = [d for d in p.types if d.kind == "class" and d.outer is None]
    if len(top) > 1:
        # The second class triggers; where it isn't new, the first later one that is.
        for d in top[1:]:
            add("multiple-classes-per-file", "Hint", line(p, d.first), f"File defines {len(top)} classes at its top level.", line(p, d.first), end_line(p, d.close), extra="once")


@rule
def conditionals(p: Parser, add: Add) -> None:
    for k, t in enumerate(p.t):
        if t.text != "if" or p.x(k + 1) != "(" or t.kind != "id":
            continue
        a = p.pair[k + 1] + 1
        ae = p.statement(a, len(p.t))
        if p.x(ae) != "else" or p.x(ae + 1) == "if" or p.x(k - 1) == "else":
            continue
        b = ae + 1
        be = p.statement(b, len(p.t))
        first, last = t.line, end_line(p, be - 1)
        one, two = p.x(a) == "{", p.x(b) == "{"
        if one != two:
            add("if-else-brace-consistency", "Suggestion", first, "Only one branch of this if/else has braces.", first, last)
        elif one and all(_simple_block(p, s, e) for s, e in ((a, ae), (b, be))):
            add("if-else-unnecessary-braces", "Hint", first, "Both branches of this if/else are single statements; the braces aren't needed.", first, last)


def _simple_block(p: Parser, a: int, e: int) -> bool:
    """A block with one simple statement on one line and no comment."""
    close = e - 1
    inner = a + 1
    if close <= inner or p.statement(inner, close) != close or p.x(close - 1) != ";":
        return False
    if p.x(inner) in ("if", "for", "foreach", "while", "do", "switch", "try", "using", "lock", "fixed", "var", "const") or p.kind(inner) == "dir" or p.type_end(inner) > inner and p.kind(p.type_end(inner)) == "id" and p.x(inner) not in ("return", "throw", "await", "yield"):
        return False
    span = (p.t[a].at, p.t[close].at)
    return line(p, inner) == end_line(p, close - 1) and not any(span[0] < c < span[1] for c, _ in p.s.comments)


@rule
def calls(p: Parser, add: Add) -> None:
    static_thread = any(re.fullmatch(r"(global)?usingstaticSystem\.Threading\.Thread", u) for *_, u, _ in p.usings)
    for k, t in enumerate(p.t):
        if t.kind != "id" or p.x(k + 1) != "(":
            continue
        if t.text == "Sleep" and ((p.x(k - 1) == "." and p.x(k - 2) == "Thread") or (static_thread and p.x(k - 1) != ".")):
            add("thread-sleep", "Suggestion", t.line, "Thread.Sleep blocks the thread. Consider an awaited delay or a wait with a signal.")
        if t.text == "Run" and p.x(k - 1) == "." and p.x(k - 2) == "Task" and p.x(k + 2) == "async":
            add("task-run-async", "Suggestion", t.line, "Task.Run with an async lambda. Consider calling the async method directly.", t.line)
        if t.text in KEYWORDS or p.pair[k + 1] < 0 or _made(p, k):
            continue
        for rule_id, words, what in (("consecutive-boolean-arguments", ("true", "false"), "boolean"), ("consecutive-null-arguments", ("null",), "null")):
            run_: list[int] = []
            for a, e in [*p.args(k + 1), (0, 0)]:
                if e == a + 1 and p.x(a) in words:
                    run_.append(a)
                    continue
                if len(run_) >= 2:  # of a call's runs the first that the scope touches counts
                    add(rule_id, "Hint", line(p, run_[0]), f"Consecutive {what} literal arguments of '{t.text}'. Consider named arguments.", line(p, run_[0]), line(p, run_[-1]), extra=f"call {k}")
                run_ = []


def _made(p: Parser, k: int) -> bool:
    """Whether the name at k is that of a created object or of an attribute, not of something called."""
    while p.x(k - 1) in (".", "::") and p.kind(k - 2) == "id":
        k -= 2
    return p.x(k - 1) == "new" or _is_attribute(p, k)


@rule
def throws(p: Parser, add: Add) -> None:
    for k, t in enumerate(p.t):
        if t.text != "catch" or p.x(k + 1) != "(":
            continue
        close = p.pair[k + 1]
        name = p.x(close - 1) if p.kind(close - 1) == "id" and close - 1 > p.type_end(k + 2) - 1 else ""
        body = p.until(close + 1, len(p.t), ("{",))
        if not name or body >= len(p.t):
            continue
        j = body + 1
        while j < p.pair[body]:
            if p.x(j) == "catch" and p.x(j + 1) == "(":  # a nearer catch has its own variable
                inner = p.until(p.pair[j + 1] + 1, len(p.t), ("{",))
                j = p.pair[inner] + 1
                continue
            if p.x(j) == "throw" and p.x(j + 1) == name and p.x(j + 2) == ";":
                add("throw-ex-in-catch", "Important", line(p, j), f"`throw {name};` loses the stack trace. Use `throw;`.", line(p, j))
            j += 1


@rule
def statics(p: Parser, add: Add) -> None:
    for _, m in methods(p, "field", "property"):
        if not {"public", "static"} <= m.mods:
            continue
        if m.kind == "field" and not m.mods & {"readonly", "const"}:
            add("public-mutable-static-state", "Important", line(p, m.name_at), f"Public static field `{m.name}` is mutable global state.", line(p, m.name_at), end_line(p, m.init[1] - 1) if m.init else line(p, m.name_at))
        elif m.kind == "property" and "set" in accessors(p, m):
            add("public-mutable-static-state", "Important", line(p, m.first), f"Public static property `{m.name}` is mutable global state.", line(p, m.first), end_line(p, m.last))


@rule
def doc_tags(p: Parser, add: Add) -> None:
    block: list[tuple[int, str]] = []
    groups = []
    for n, s in p.s.docs:
        if block and n != block[-1][0] + 1:
            groups.append(block)
            block = []
        block.append((n, s))
    for g in [*groups, block]:
        joined, marks, at = "", [], 0
        for n, s in g:
            marks.append((at, n))
            joined += s + "\n"
            at = len(joined)
        where = lambda o: [n for a, n in marks if a <= o][-1]  # noqa: E731, B023
        for m in re.finditer(r"<(summary|param|returns)\b([^>]*?)(/>|>(.*?)</\1\s*>)", joined, re.S):
            if m[3] == "/>" or not m[4].strip():
                a, e = where(m.start()), where(m.end() - 1)
                add("empty-xml-doc-content", "Hint", a, f"XML doc tag `{m[1]}` is empty.", a, e)


@rule
def public_methods(p: Parser, add: Add) -> None:
    for d, m in methods(p):
        fixture = {a.split(".")[-1].lower() for a in d.attrs} & {"testfixture", "textfixture"}
        disposes = m.name in ("Dispose", "DisposeAsync") and not m.params
        if d.kind != "interface" and "public" in m.mods and not m.mods & {"override", "abstract", "extern"} and not fixture and not disposes and m.body:
            add("missing-tests-public-methods", "Suggestion", line(p, m.first), m.name, line(p, m.first), extra=d.name)


@rule
def suppressions(p: Parser, add: Add) -> None:
    for k, t in enumerate(p.t):
        if t.kind == "dir" and re.match(r"#\s*pragma\s+warning\s+disable\b", t.text):
            add("warning-suppression", "Important", t.line, "Warning suppression by `#pragma warning disable`.")
        elif t.text in ("SuppressMessage", "SuppressMessageAttribute") and _is_attribute(p, k):
            add("warning-suppression", "Important", t.line, "Warning suppression by `[SuppressMessage]`.")


def _is_attribute(p: Parser, k: int) -> bool:
    j = k - 1
    while p.x(j) == "." and p.kind(j - 1) == "id":
        j -= 2
    return p.x(j) == "[" or (p.x(j) == ":" and p.x(j - 2) == "[") or (p.x(j) == "," and _in_attribute_list(p, j))


def _in_attribute_list(p: Parser, j: int) -> bool:
    """Whether the comma at j parts two attributes of a list: going back over whole brackets, a [ comes before a statement's end."""
    while j > 0 and p.x(j) not in (";", "{", "}", "(", "["):
        j = p.pair[j] - 1 if p.x(j) in (")", "]") and p.pair[j] >= 0 else j - 1
    return p.x(j) == "["


@rule
def verbatim(p: Parser, add: Add) -> None:
    for t in p.t:
        if t.kind == "str" and re.match(r'@"|\$@"|@\$"', t.text) and not re.search(r'[\\\n]|""', t.text[t.text.index('"') + 1 : -1]):
            add("unnecessary-verbatim-string-prefix", "Hint", t.line, "Verbatim prefix `@` isn't needed for this string.", t.line, t.line + t.text.count("\n"))


def _bodies(p: Parser) -> list[tuple[TypeDecl, Member]]:
    return [(d, m) for d in p.types for m in d.members if m.body and m.kind in ("method", "ctor", "property", "operator", "indexer", "event")]


@rule
def local_variables(p: Parser, add: Add) -> None:
    for _, m in _bodies(p):
        a, b = m.body
        for kind, name, at, init, stop in p.locals(a + 1, b):
            n = line(p, at)
            if re.match(r"m_|_.", name):
                add("local-variable-prefix", "Hint", n, f"Local variable `{name}` has a prefix like a field.", n)
            refs = [k for k in uses(p, name, a, b) if k != at]
            stored = in_strings(p, name, a, b)
            const = p.x(at - 2) == "const" or any(p.x(j) == "const" for j in range(max(a, at - 4), at) if p.at_start(j))
            using = any(p.x(j) == "using" for j in range(max(a, at - 5), at))
            if not using and not stored and all(p.x(k + 1) == "=" and p.at_start(k) for k in refs):
                add("unused-local-variable", "Hint", n, f"Local variable `{name}` is never read.", n)
            lit = init >= 0 and (stop == init + 1 or (stop == init + 2 and p.x(init) == "-")) and (p.kind(stop - 1) in ("num", "str", "chr") or p.x(stop - 1) in ("true", "false")) and "$" not in p.x(init)[:2]
            if lit and not const and kind in CONST_TYPES and (refs or stored) and p.x(stop) == ";" and p.x(at - 2) != "(" and not any(written(p, k) for k in refs) and p.x(at - 1) != ",":
                add("local-variable-can-be-const", "Hint", n, f"Local variable `{name}` can be `const`.", n)


@rule
def enums(p: Parser, add: Add) -> None:
    for d in p.types:
        if d.kind != "enum":
            continue
        before: int | None = -1
        for m in d.members:
            if m.init is None:
                before = None if before is None else before + 1
                continue
            text = p.joined(*m.init)
            value = _integer(text)
            if value is not None and before is not None and value == before + 1 and "<<" not in text:
                n = line(p, m.name_at)
                add("unnecessary-enum-member-value", "Hint", n, f"Enum member `{m.name}` has the explicit value `{text}` that it would get anyway.", n, end_line(p, m.init[1] - 1))
            before = value


def _integer(text: str) -> int | None:
    m = re.fullmatch(r"([+-]?)(0[xX][\da-fA-F_]+|0[bB][01_]+|\d[\d_]*)[uUlL]*", text)
    return None if not m else (-1 if m[1] == "-" else 1) * int(m[2].replace("_", ""), 0 if m[2][:2].lower() in ("0x", "0b") else 10)


@rule
def self_lookup(p: Parser, add: Add) -> None:
    for d, m in _bodies(p):
        own = {d.name, *(b.split("<")[0].split(".")[-1] for b in d.bases)}
        for k in range(*m.body):
            if p.x(k) in own and p.x(k + 1) == "." and p.x(k + 2) == f"Get{p.x(k)}" and p.x(k + 3) == "(" and p.x(k + 4) == "this" and p.x(k + 5) == ")":
                add("redundant-self-lookup", "Hint", line(p, k), f"Redundant self lookup `{p.x(k)}.Get{p.x(k)}(this)`. Use `this`.", line(p, k))


@rule
def unused_members(p: Parser, add: Add) -> None:
    for d in p.types:
        if "partial" in d.mods or d.kind == "interface":
            continue
        for m in d.members:
            if m.kind not in ("field", "method", "property") or not private(d, m) or m.explicit or m.mods & {"override", "abstract"} or (m.kind == "method" and m.name == "Main"):
                continue
            if m.kind == "field" and ("private" not in m.mods or "const" in m.mods):
                continue
            seen = any(p.t[k].text == m.name and p.t[k].kind == "id" and k != m.name_at for k in range(len(p.t)))
            if not seen and not in_strings(p, m.name, 0, len(p.t)):
                at, stop = (m.name_at, m.init[1] - 1 if m.init else m.name_at) if m.kind == "field" else (m.first, m.last)
                add("unused-private-member", "Hint", line(p, at), f"Private {m.kind} `{m.name}` appears to be unused.", line(p, at), end_line(p, stop))


def _fields(d: TypeDecl) -> list[Member]:
    return [f for f in d.members if f.kind == "field" and private(d, f) and "const" not in f.mods]


@rule
def field_writes(p: Parser, add: Add) -> None:
    for d in p.types:
        if "partial" in d.mods or d.kind not in ("class", "struct"):
            continue
        places = [(m, *m.body) for m in d.members if m.body]
        for f in _fields(d):
            refs = [(m, k) for m, a, b in places for k in uses(p, f.name, a, b)]
            static = "static" in f.mods
            writes = [(m, k) for m, k in refs if written(p, k)]
            nested = any(t.outer is d for t in p.types)
            if "readonly" not in f.mods and "volatile" not in f.mods and (writes or f.init) and not nested and f.type.rstrip("?") not in ("SpinLock",):
                if all(m.kind == "ctor" and ("static" in m.mods) == static and "=>" not in [p.x(j) for j in range(m.body[0] + 1, k)] for m, k in writes):
                    add("private-field-can-be-readonly", "Hint", line(p, f.name_at), f"Private field `{f.name}` can be `readonly`.", line(p, f.name_at), end_line(p, f.init[1] - 1) if f.init else line(p, f.name_at))
            users = {id(m): m for m, _ in refs}
            if "readonly" in f.mods and len(users) == 1 and not f.init and not static:
                m = next(iter(users.values()))
                if m.kind == "ctor" and len(writes) == 1 and p.x(writes[0][1] + 1) == "=" and writes[0][1] == refs[0][1]:
                    add("private-field-used-in-single-method", "Hint", line(p, f.name_at), f"Private readonly field `{f.name}` is only used in the constructor. Consider a local variable.", line(p, f.name_at))


@rule
def static_methods(p: Parser, add: Add) -> None:
    for d, m in methods(p):
        if not private(d, m) or not m.body or m.mods & {"static", "virtual", "override", "abstract", "partial"} or m.explicit or "partial" in d.mods or d.kind == "interface" or m.attrs:
            continue
        mine = {x.name for x in d.members if x.kind != "enum_member" and not x.mods & {"static", "const"} and x is not m}
        known = {x.name for t in p.types for x in t.members} | {t.name for t in p.types} | {x for _, x, _ in m.params} | {n for _, n, *_ in p.locals(*m.body)}
        inherits = any(not re.match(r"I[A-Z]", b) for b in d.bases)
        ok = True
        for k in range(m.body[0], m.body[1]):
            t = p.t[k]
            if t.kind == "str" and "$" in t.text[:2] and any(re.search(rf"\b{re.escape(n)}\b|\bthis\b", t.text) for n in mine):
                ok = False
            if t.kind != "id" or p.x(k - 1) in (".", "?."):
                continue
            if t.text in ("this", "base") or t.text in mine:
                ok = False
            # with a base class, an unknown name that is called could be an inherited member
            if inherits and t.text not in known and t.text not in KEYWORDS and p.x(k + 1) == "(" and p.x(k - 1) != "new":
                ok = False
        if ok:
            add("method-can-be-static", "Hint", line(p, m.first), f"Method `{m.name}` uses no instance state and can likely be made static.")


def _parts(least: int, nth: int, spans: list[tuple[int, int]]) -> str:
    """What the scope is asked: at least so many of the spans have to be touched; the line is the nth touched one's, or the candidate's own for 0."""
    return f"parts {least} {nth} " + " ".join(f"{a}-{b}" for a, b in spans)


@rule
def concatenations(p: Parser, add: Add) -> None:
    for d, m in _bodies(p):
        strings = {f.name for f in d.members if f.kind in ("field", "property") and f.type in ("string", "String")} | {n for t, n, _ in m.params if t in ("string", "String")}
        for kind, name, _, init, _ in p.locals(*m.body):
            if kind in ("string", "String") or (kind == "var" and init >= 0 and p.kind(init) == "str"):
                strings.add(name)
        found: dict[tuple[int, str], list[int]] = {}
        depth = []
        for k in range(m.body[0], m.body[1]):
            if p.x(k) == "{":
                depth.append(k)
            elif p.x(k) == "}" and depth:
                depth.pop()
            elif p.at_start(k) and p.x(k) in strings and (p.x(k + 1) == "+=" or (p.x(k + 1) == "=" and p.x(k + 2) == p.x(k) and p.x(k + 3) == "+")):
                found.setdefault((depth[-1] if depth else -1, p.x(k)), []).append(k)
        for (_, name), at in found.items():
            if len(at) >= 4:
                add("string-concat-same-target", "Suggestion", line(p, at[0]), f"String target `{name}` is concatenated %d times in one block. Consider a `StringBuilder`.", line(p, at[0]), end_line(p, p.until(at[-1], m.body[1], (";",))), _parts(4, 1, [(line(p, k), end_line(p, p.until(k, m.body[1], (";",)) - 1)) for k in at]))


@rule
def events(p: Parser, add: Add) -> None:
    for d in p.types:
        text = {b.split("<")[0].split(".")[-1] for b in d.bases}
        for m in d.members:
            if m.kind != "ctor" or not m.body or "static" in m.mods:
                continue
            subs = []
            for k in range(*m.body):
                if p.x(k) == "+=" and p.kind(k - 1) == "id" and p.x(k - 1)[:1].isupper() and not (p.kind(k + 1) in ("num", "str")) and (p.x(k + 2) in (";", "=>") or p.x(k + 1) in ("(", "delegate", "async", "new")):
                    subs.append(k)
            if not subs:
                continue
            off = {p.x(k - 1) for k in range(d.open, d.close) if p.x(k) == "-="}
            missing = [k for k in subs if p.x(k - 1) not in off]
            if missing or "IDisposable" not in text:
                what = " and ".join(w for w in ("never unsubscribes" if missing else "", "isn't IDisposable" if "IDisposable" not in text else "") if w)
                k = (missing or subs)[0]
                spans = _parts(1, 0, [(line(p, k), end_line(p, p.until(k, m.body[1], (";",)))) for k in missing or subs])
                add("constructor-event-subscription-lifecycle", "Important", line(p, m.first), f"Constructor `{d.name}` subscribes to event `{p.x(k - 1)}`, but the type {what}.", line(p, m.first), end_line(p, m.last), spans)


@rule
def disposables(p: Parser, add: Add) -> None:
    for _, m in _bodies(p):
        a, b = m.body
        for _, name, at, init, stop in p.locals(a + 1, b):
            if init < 0 or p.x(init) != "new" or any(p.x(j) == "using" for j in range(max(a, at - 6), at)):
                continue
            kind = p.joined(init + 1, p.type_end(init + 1)).split("<")[0].split(".")[-1]
            if kind not in DISPOSABLES:
                continue
            handled = False
            for k in uses(p, name, stop, b):
                after = p.x(k + 1)
                if (after in (".", "?.") and p.x(k + 2) in ("Dispose", "DisposeAsync", "Close")) or p.x(k - 1) in ("return", "(", ",", "=", "=>", "using", "??"):
                    handled = True
            if not handled:
                add("disposable-not-disposed", "Suggestion", line(p, at), f"Disposable `{kind}` in `{name}` is created but never disposed.", line(p, at))
    for d in p.types:
        names = {b.split("<")[0].split(".")[-1] for b in d.bases}
        for m in d.members:
            if m.kind == "method" and m.name == "Dispose" and not m.params and m.type == "void" and not m.mods & {"override", "static"} and not m.explicit and "partial" not in d.mods and d.kind in ("class", "struct", "record") and not names & {"IDisposable", "IAsyncDisposable", "IEnumerator"} and not d.bases:
                add("dispose-without-idisposable", "Suggestion", line(p, m.first), f"Type `{d.name}` defines `Dispose()` but isn't `IDisposable`.", line(p, m.first), end_line(p, m.last))


def _declared(p: Parser, d: TypeDecl, m: Member) -> dict[str, str]:
    """Declared types of the names that a body sees."""
    types = {f.name: f.type for f in d.members if f.kind in ("field", "property")}
    types |= {n: t for t, n, _ in m.params}
    for kind, name, _, init, _ in p.locals(*m.body):
        types[name] = kind if kind != "var" else ("string" if init >= 0 and p.kind(init) == "str" else "bool" if init >= 0 and p.x(init) in ("true", "false") else "var")
    return types


@rule
def comparisons(p: Parser, add: Add) -> None:
    for d, m in _bodies(p):
        types = _declared(p, d, m)
        returns = {x.name: x.type for x in d.members if x.kind == "method"}
        for k in range(*m.body):
            if p.x(k) not in ("==", "!="):
                continue
            for literal, other, step in ((k + 1, k - 1, -1), (k - 1, k + 1, 1)):
                if p.x(literal) not in ("true", "false"):
                    continue
                kind = ""
                if p.kind(other) == "id" and p.x(other + step) not in (".", "?."):
                    kind = types.get(p.x(other), "")
                elif step < 0 and p.x(other) == ")" and p.x(p.pair[other] - 2) not in (".", "?."):
                    kind = returns.get(p.x(p.pair[other] - 1), "")
                if kind in ("bool", "Boolean"):
                    add("boolean-literal-comparison", "Hint", line(p, k), f"Boolean comparison with `{p.x(literal)}` isn't needed.", line(p, k))


@rule
def casts(p: Parser, add: Add) -> None:
    for d, m in _bodies(p):
        types = _declared(p, d, m)
        for k in range(*m.body):
            if p.x(k) != "(" or p.pair[k] < 0 or p.kind(k - 1) == "id" and p.x(k - 1) not in ("return", "in", "await", "case", "throw"):
                continue
            e = p.pair[k]
            if p.type_end(k + 1) == e and p.kind(e + 1) == "id" and p.x(e + 2) not in (".", "?.", "(", "[") and types.get(p.x(e + 1)) == p.joined(k + 1, e) != "var":
                add("unnecessary-cast", "Hint", line(p, k), f"Unnecessary cast of `{p.x(e + 1)}`: it is already `{p.joined(k + 1, e)}`.", line(p, k))


@rule
def tasks(p: Parser, add: Add) -> None:
    for d, m in _bodies(p):
        returns = {x.name: x.type for x in d.members if x.kind == "method"}
        for k in range(m.body[0] + 1, m.body[1]):
            if not p.at_start(k) or p.kind(k) != "id" or p.x(k) in KEYWORDS - {"this", "base"}:
                continue
            e = p.until(k, m.body[1], (";",))
            if p.x(e - 1) != ")" or any(p.x(j) in ("=", "+=", "-=") for j in range(k, p.pair[e - 1])):
                continue
            name_at = p.pair[e - 1] - 1
            own = name_at == k or (name_at == k + 2 and p.x(k) == "this")
            kind = returns.get(p.x(name_at), "") if own else ""
            if re.match(r"(Value)?Task\b", kind) or (not own and p.x(name_at).endswith("Async") and p.x(name_at) != "Async" and p.x(name_at - 1) in (".", "?.")):
                add("unobserved-task-result", "Suggestion", line(p, k), f"The `Task` of `{p.x(name_at)}` isn't awaited or kept.", line(p, k), end_line(p, e))


@rule
def enumerations(p: Parser, add: Add) -> None:
    for _, m in methods(p):
        if not m.body:
            continue
        names = {n for t, n, _ in m.params if re.match(r"(System\.Collections\.Generic\.)?IEnumerable<", t)}
        names |= {n for t, n, *_ in p.locals(*m.body) if re.match(r"IEnumerable<", t)}
        lazy = re.compile(r"Select|Where|OfType|Cast|SelectMany|Skip|Take|Concat|Reverse|OrderBy|Distinct")
        for kind, name, _, init, stop in p.locals(*m.body):
            if kind == "var" and init >= 0 and p.x(stop - 1) == ")" and lazy.fullmatch(p.x(p.pair[stop - 1] - 1)) and p.x(p.pair[stop - 1] - 2) == ".":
                names.add(name)
        for name in sorted(names):
            at = []
            for k in uses(p, name, *m.body):
                if p.x(k - 1) == "in" and p.x(k + 1) == ")":
                    at.append(k)
                elif p.x(k + 1) == ".":
                    j = k + 1
                    while p.x(j) == "." and p.kind(j + 1) == "id":
                        call = j + 2 if p.x(j + 2) != "<" else p.angle(j + 2)
                        if p.x(call) != "(":
                            break
                        if p.x(j + 1) in TERMINALS:
                            at.append(k)
                            break
                        j = p.pair[call] + 1
            if len(at) >= 2:
                add("multiple-enumeration", "Suggestion", line(p, at[1]), f"Sequence `{name}` is enumerated %d times in `{m.name}`. Consider materializing it once.", line(p, at[0]), line(p, at[-1]), _parts(2, 2, [(line(p, k),) * 2 for k in at]))


@rule
def cultures(p: Parser, add: Add) -> None:
    for d, m in _bodies(p):
        types = _declared(p, d, m)
        real = {n for n, t in types.items() if t.rstrip("?") in ("float", "double", "decimal", "Single", "Double", "Decimal")}
        if not real:
            continue
        for k in range(*m.body):
            if p.x(k) not in WRITERS and not (p.x(k) in ("Write", "WriteLine", "WriteAsync", "WriteLineAsync") and types.get(p.x(k - 2), "") in ("StreamWriter", "TextWriter")) or p.x(k + 1) != "(":
                continue
            a, e = k + 2, p.pair[k + 1]
            inside = [p.x(j) for j in range(a, e)]
            if "InvariantCulture" in inside:
                continue
            for n in sorted(real):
                plain = any(p.x(j + 1) == "." and p.x(j + 2) == "ToString" or p.x(j - 1) == "+" or p.x(j + 1) == "+" for j in uses(p, n, a, e))
                if plain or in_strings(p, n, a, e):
                    add("numeric-string-culture-for-file-write", "Important", line(p, k), f"Numeric value `{n}` is written to a file in the current culture. Use `CultureInfo.InvariantCulture`.", line(p, k), end_line(p, e))
                    break


@rule
def lambdas(p: Parser, add: Add) -> None:
    for k, t in enumerate(p.t):
        if t.text != "=>" or p.x(k - 1) not in (")",) and p.kind(k - 1) != "id":
            continue
        if p.x(k - 1) == ")":
            a = p.pair[k - 1]
            names = [p.x(j) for j in range(a + 1, k - 1) if p.x(j) != ","]
            simple = all(p.kind(j) == "id" for j in range(a + 1, k - 1) if p.x(j) != ",") and p.x(a - 1) in ("(", ",", "=", "return", "+=") and (k - 1 - a - 1) == max(0, 2 * len(names) - 1)
        else:
            names, a = [p.x(k - 1)], k - 1
            simple = p.x(a - 1) in ("(", ",", "=", "return", "+=")
        if not simple or "async" in names or not names:
            continue
        j = k + 1
        while p.kind(j) == "id" and p.x(j + 1) == ".":
            j += 2
        if p.kind(j) != "id" or p.x(j) in KEYWORDS or p.x(j + 1) != "(":
            continue
        e = p.pair[j + 1]
        passed = [p.joined(x, y) for x, y in p.args(j + 1)]
        if passed == names and p.x(e + 1) in (")", ",", ";") and p.x(k + 1) not in names:
            add("lambda-can-be-method-group", "Hint", t.line, f"Lambda expression can be the method group `{p.joined(k + 1, j + 1)}`.", line(p, a), line(p, e))


@rule
def duplicate_usings(p: Parser, add: Add) -> None:
    seen: set[str] = set()
    for a, _, text, global_ in p.usings:
        name = text.removeprefix("global")
        if name in seen:
            n = line(p, a)
            add("unused-usings-roslyn", "Hint", n, f"Using `{name.removeprefix('using')}` is there twice.", n, extra="global" if global_ else None)
        seen.add(name)
