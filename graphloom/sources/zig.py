"""Declarations, calls, bindings and identifiers of Zig source text, as rows.

A tokenizer and a declaration parser of our own: bodies are not parsed into trees, only searched for calls,
variables and captures.  Any text gives a result; what can't be read as a declaration is skipped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<doc>//!.*|///(?!/).*)|(?P<comment>//.*)|(?P<multi>\\\\.*)|(?P<string>"(?:[^"\\\n]|\\.)*"?)|(?P<char>'(?:[^'\\\n]|\\.)*'?)
    |(?P<quoted>@"(?:[^"\\\n]|\\.)*")|(?P<builtin>@[A-Za-z_]\w*)|(?P<ident>[A-Za-z_]\w*)|(?P<number>\d[\w.]*?(?=\.\.|[^\w.]|\.(?!\d)|$)|\d\w*)
    |(?P<op>\.\.\.|\.\.|\.\*|\.\?|=>|==|!=|<=|>=|\|\||->|\+\+|\*\*|[^\s\w])|(?P<other>\w)""",
    re.X | re.A,
)
KEYWORDS = frozenset("addrspace align allowzero and anyframe anytype asm async await break callconv catch comptime const continue defer else enum errdefer error export extern fn for if inline linksection noalias noinline nosuspend opaque or orelse packed pub resume return struct suspend switch test threadlocal try union unreachable usingnamespace var volatile while".split())
CONTAINERS = {"struct": "type_def", "opaque": "type_def", "union": "union_def", "enum": "enum_def"}
BRANCH = re.compile(r"(?<![A-Za-z0-9_])(?:if|for|while|switch|catch)(?![A-Za-z0-9_])")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass
class Tok:
    kind: str
    text: str
    at: int
    end: int
    line: int


@dataclass
class Decl:
    local: int
    parent: int | None
    name: str
    kind: str
    line_start: int
    line_end: int
    public: bool = False
    doc: str | None = None
    signature: str | None = None
    flags: dict = field(default_factory=dict)
    convention: str | None = None
    chain: list = field(default_factory=list)
    complexity: int | None = None


def tokens(text: str) -> list[Tok]:
    out, line, at = [], 1, 0
    for m in TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        kind = m.lastgroup
        if kind != "comment":
            out.append(Tok("ident" if kind == "quoted" else kind, m[0][2:-1] if kind == "quoted" else m[0], m.start(), m.end(), line))
    return out


class Parser:
    def __init__(self, text: str, path: str):
        self.text, self.path = text, path
        every = tokens(text)
        self.docs = [t for t in every if t.kind == "doc"]
        self.t = [t for t in every if t.kind != "doc"]
        self.match = self._pairs()
        self.nodes: list[Decl] = []
        self.events: list[tuple] = []
        self.siblings: dict[int, set] = {}
        self.doc_at = {t.line: t for t in self.docs if t.text.startswith("///") and not text[text.rfind("\n", 0, t.at) + 1 : t.at].strip()}

    def _pairs(self) -> dict[int, int]:
        """Index of the closing token of every opening one; an unclosed one reaches to the end."""
        out, stack = {}, []
        for i, t in enumerate(self.t):
            if t.kind == "op" and t.text in OPEN:
                stack.append(i)
            elif t.kind == "op" and t.text in CLOSE:
                while stack:
                    k = stack.pop()
                    out[k] = i
                    if OPEN[self.t[k].text] == t.text:
                        break
        for k in stack:
            out[k] = len(self.t) - 1
        return out

    # helpers

    def is_(self, i: int, *texts: str) -> bool:
        return i < len(self.t) and self.t[i].text in texts and self.t[i].kind not in ("string", "char", "multi")

    def ident(self, i: int) -> bool:
        return i < len(self.t) and self.t[i].kind == "ident" and (self.t[i].text not in KEYWORDS or self.text[self.t[i].at] == "@")

    def until(self, i: int, end: int, *stops: str) -> int:
        """The first of the stops outside brackets at or after i."""
        while i < end:
            if self.is_(i, *stops):
                return i
            i = self.match.get(i, i) + 1
        return end

    def doc_above(self, line: int) -> str | None:
        lines = []
        line -= 1
        while line in self.doc_at:
            lines.append(self.doc_at[line].text)
            line -= 1
        return "\n".join(reversed(lines)) or None

    def add(self, parent, name, kind, first, last, **more) -> Decl:
        d = Decl(len(self.nodes), parent, name, kind, self.t[first].line, self.t[min(last, len(self.t) - 1)].line + self.t[min(last, len(self.t) - 1)].text.count("\n"), doc=self.doc_above(self.t[first].line), **more)
        self.nodes.append(d)
        return d

    # declarations

    def parse(self) -> Parser:
        n = self.text.count("\n") + (0 if self.text.endswith("\n") or not self.text else 1)
        head, line = [], 1
        for t in self.docs:
            if not t.text.startswith("//!") or t.line != line:
                break
            head.append(t.text)
            line += 1
        self.nodes.append(Decl(0, None, self.path.rsplit("/", 1)[-1], "file", 1, n or None, doc="\n".join(head) or None))
        self.container(0, len(self.t), 0)
        return self

    def container(self, i: int, end: int, parent: int) -> None:
        while i < end:
            i = self.declaration(i, end, parent)

    def declaration(self, i: int, end: int, parent: int) -> int:
        first, mods, convention, public = i, set(), None, False
        while self.is_(i, "pub", "export", "extern", "inline", "noinline", "threadlocal", "comptime") and i < end:
            word = self.t[i].text
            if word == "comptime" and self.is_(i + 1, "{"):
                close = self.match[i + 1]
                self.body(i + 2, close, parent, None)
                return close + 1
            public |= word == "pub"
            mods.add(word)
            i += 1
            if word == "extern" and i < end and self.t[i].kind == "string":
                convention = self.t[i].text.strip('"')
                i += 1
        if self.is_(i, "const", "var"):
            return self.variable(first, i, end, parent, public, mods)
        if self.is_(i, "fn"):
            return self.function(first, i, end, parent, public, mods, convention)
        if self.is_(i, "test"):
            return self.test(i, end, parent)
        if self.is_(i, "usingnamespace"):
            return self.until(i, end, ";") + 1
        stop = self.until(i, end, ",", ";")
        if self.ident(i) and (self.is_(i + 1, ":", "=", ",") or i + 1 >= min(stop, end)):
            self.add(parent, self.t[i].text, "field", first, max(i, stop - 1))
        return stop + 1

    def classify(self, i: int, stop: int) -> tuple[str, int | None]:
        """(kind, index of what makes it so) of a value."""
        if self.is_(i, "if", "switch"):
            return "conditional", None
        k, depth = i, 0
        while k < stop:
            if self.is_(k, *CONTAINERS) and self.t[k].kind == "ident":
                return CONTAINERS[self.t[k].text], k
            if self.is_(k, "error") and self.is_(k + 1, "{"):
                return "error_def", k
            if self.t[k].kind == "builtin" and self.t[k].text == "@import":
                return "import_decl", k
            if self.is_(k, "if", "switch"):
                return "constant", None
            if self.is_(k, "{"):
                k = self.match.get(k, stop)
            depth += 1
            k += 1
        return "constant", None

    def variable(self, first: int, i: int, end: int, parent: int, public: bool, mods: set, types_only: bool = False) -> int:
        mutable = self.is_(i, "var")
        stop = self.until(i, end, ";")
        if not self.ident(i + 1):
            return stop + 1
        name = self.t[i + 1].text
        eq = self.until(i + 2, stop, "=")
        annotated = self.is_(i + 2, ":")
        kind, at = self.classify(eq + 1, stop) if eq < stop else ("constant", None)
        if types_only and kind not in CONTAINERS.values():
            return stop + 1
        chain = self.plain_chain(eq + 1, stop)
        if kind == "constant":
            if any(t.text == "@This" for t in self.t[eq + 1 : stop]):
                return stop + 1
            if not public and chain and len(chain) > 1 and chain[-1] == name and chain[0] in self.siblings.get(parent, ()):
                return stop + 1
        flags = {"is_mutable": mutable, "is_extern": "extern" in mods or any(self.is_(k, "extern") for k in range(eq + 1, at or eq + 1)), "is_packed": any(self.is_(k, "packed") for k in range(eq + 1, at or eq + 1)), "comptime_conditional": kind == "conditional", "is_comptime": kind in ("constant", "conditional") and annotated and not mutable}
        d = self.add(parent, name, "constant" if kind == "conditional" else kind, first, stop, public=public, flags=flags)
        if kind == "import_decl":
            self.siblings.setdefault(parent, set()).add(name)
            if self.is_(at + 1, "(") and self.t[at + 2].kind == "string":
                d.signature = self.t[at + 2].text.strip('"')
                k = self.match[at + 1] + 1
                while self.is_(k, ".") and self.ident(k + 1):
                    d.chain.append(self.t[k + 1].text)
                    k += 2
        elif kind == "error_def":
            close = self.match.get(at + 1, stop)
            d.signature = self.text[self.t[at].at : self.t[min(close, len(self.t) - 1)].end]
        elif kind in CONTAINERS.values():
            brace = self.until(at + 1, stop, "{")
            while brace < stop and not self.is_(brace, "{"):
                brace += 1
            if brace < stop:
                self.container(brace + 1, self.match[brace], d.local)
        return stop + 1

    def plain_chain(self, i: int, stop: int) -> list[str] | None:
        """a.b.c if the value is nothing else."""
        out = []
        while self.ident(i):
            out.append(self.t[i].text)
            i += 1
            if i >= stop:
                return out
            if not self.is_(i, "."):
                return None
            i += 1
        return None

    def function(self, first: int, i: int, end: int, parent: int, public: bool, mods: set, convention: str | None) -> int:
        if not self.ident(i + 1) or not self.is_(i + 2, "("):
            return self.until(i, end, ";", "{") + 1
        name, close = self.t[i + 1].text, self.match[i + 2]
        k = close + 1
        while k < end and not self.is_(k, ";") and not (self.is_(k, "{") and not self.is_(k - 1, "error")):
            k = self.match.get(k, k) + 1
        brace = k if self.is_(k, "{") and k < end else None
        last = self.match[brace] if brace is not None else min(k, end - 1)
        head = self.text[self.t[first].at : self.t[brace].at if brace is not None else (self.t[k].at if k < len(self.t) else len(self.text))].rstrip().rstrip(";")
        flags = {"is_inline": "inline" in mods, "is_extern": "extern" in mods}
        returned = None
        if brace is not None and brace - close == 2 and self.is_(close + 1, "type"):
            returned = self.returned(brace + 1, last)
        if returned is not None:
            kind, at = returned
            d = self.add(parent, name, kind, first, last, public=public, flags=flags, signature=head, convention=convention)
            b = self.until(at + 1, last, "{")
            while b < last and not self.is_(b, "{"):
                b += 1
            if b < last:
                self.container(b + 1, self.match[b], d.local)
        else:
            d = self.add(parent, name, "function", first, last, public=public, flags=flags, signature=head, convention=convention)
            lines = self.text.split("\n")[d.line_start - 1 : d.line_end]
            d.complexity = 1 + len(BRANCH.findall("\n".join(lines)))
            if brace is not None:
                self.body(brace + 1, last, d.local, d.local)
        self.params(i + 3, close, d.local)
        if brace is not None:
            self.scan(i + 2, last, d.local, brace)
        else:
            self.scan(i + 2, last, d.local, None)
        return last + 1

    def returned(self, i: int, end: int) -> tuple[str, int] | None:
        while i < end:
            if self.is_(i, "return"):
                k = i + 1
                while self.is_(k, "extern", "packed"):
                    k += 1
                return (CONTAINERS[self.t[k].text], k) if self.is_(k, *CONTAINERS) else None
            i = self.until(i, end, ";", "{") if not self.is_(i, "{") else i
            i = (self.match.get(i, i) if self.is_(i, "{") else i) + 1
        return None

    def test(self, i: int, end: int, parent: int) -> int:
        name, k = "test", i + 1
        if k < end and self.t[k].kind == "string":
            name, k = self.t[k].text[1:-1], k + 1
        elif self.ident(k):
            name, k = self.t[k].text, k + 1
        if not self.is_(k, "{"):
            return k + 1
        last = self.match[k]
        d = self.add(parent, name, "test_def", i, last)
        same = next(n for n in self.nodes if n.kind == "test_def" and n.name == name)
        self.body(k + 1, last, d.local, d.local)
        self.scan(k, last, same.local, k)
        return last + 1

    def body(self, i: int, end: int, parent: int, owner: int | None) -> None:
        """Types declared inside a body, and the functions in them."""
        while i < end:
            if self.is_(i, "const", "var") and self.ident(i + 1):
                stop = self.until(i, end, ";")
                eq = self.until(i + 2, stop, "=")
                kind, _ = self.classify(eq + 1, stop) if eq < stop else ("constant", None)
                if kind in CONTAINERS.values():
                    i = self.variable(i, i, end, parent, False, set(), types_only=True)
                    continue
            i += 1

    # events

    def emit(self, caller: int, kind: str, name: str, chain: list[str] | None = None, line: int = 0) -> None:
        self.events.append((caller, kind, len(self.events), name, chain or [], line))

    def params(self, i: int, end: int, caller: int) -> None:
        while i < end:
            stop = self.until(i, end, ",")
            while self.is_(i, "comptime", "noalias"):
                i += 1
            if self.ident(i) and self.is_(i + 1, ":") and self.t[i].text != "self":
                k = i + 2
                while k < stop and (self.is_(k, "*", "?", "const", "volatile", "**")):
                    k += 1
                chain = self.plain_chain(k, stop)
                if chain and len(chain) > 1:
                    self.emit(caller, "param", self.t[i].text, chain)
                elif chain and k == i + 2:
                    self.emit(caller, "ptype", self.t[i].text, chain)
            i = stop + 1

    def scan(self, i: int, end: int, caller: int, brace: int | None) -> None:
        """Calls, identifiers and bindings between two tokens, without nested functions and tests."""
        chain: list[str] | None = None  # of the expression that ends here; None: no expression, []: one without a root
        stack: list = []
        while i <= end and i < len(self.t):
            t = self.t[i]
            if self.is_(i, "fn") and self.ident(i + 1) and self.is_(i + 2, "("):
                i = self.skip_function(i, end)
                chain = None
                continue
            if self.is_(i, "test") and brace is not None and i > brace and (self.t[min(i + 1, end)].kind == "string" or self.is_(i + 1, "{")):
                k = self.until(i, end + 1, "{")
                i = self.match.get(k, k) + 1
                chain = None
                continue
            if brace is not None and i > brace and self.is_(i, "const", "var") and self.ident(i + 1):
                self.binding(i, end, caller)
            if brace is not None and i > brace and self.is_(i, "if") and self.is_(i + 1, "("):
                close = self.match[i + 1]
                if close == i + 3 and self.ident(i + 2) and self.is_(close + 1, "|"):
                    k = close + 2 + self.is_(close + 2, "*")
                    if self.ident(k):
                        self.emit(caller, "capture", self.t[k].text, [self.t[i + 2].text])
            if self.ident(i):
                self.emit(caller, "ident", t.text)
                if self.is_(i - 1, "."):
                    if chain is None:
                        chain = None  # an enum literal
                    else:
                        chain = chain + [t.text]
                else:
                    chain = [t.text]
            elif t.kind == "builtin":
                chain = None
            elif t.kind == "op" and t.text == "(":
                called = chain
                if called:
                    direct = len(called) == 1 and not self.is_(i - 2, ".")
                    self.emit(caller, "call", called[-1] if direct else "", called, int(direct))
                stack.append(("(", called if called is not None else ([] if i and (self.ident(i - 1) or self.t[i - 1].kind == "builtin" or self.is_(i - 1, ")", "]")) else [])))
                chain = None
            elif t.kind == "op" and t.text in ("[", "{"):
                stack.append((t.text, [] if chain is not None else None))
                chain = None
            elif t.kind == "op" and t.text in CLOSE:
                chain = stack.pop()[1] if stack else None
                if t.text == "}" and chain is None:
                    chain = None
            elif t.kind == "op" and t.text in (".*", ".?"):
                chain = [] if chain is not None else None
            elif t.kind == "op" and t.text == ".":
                pass
            else:
                chain = None
            i += 1

    def skip_function(self, i: int, end: int) -> int:
        k = self.match[i + 2] + 1
        while k < end and not self.is_(k, ";", "{"):
            k = self.match.get(k, k) + 1
        return (self.match.get(k, k) if self.is_(k, "{") else k) + 1

    def binding(self, i: int, end: int, caller: int) -> None:
        stop = self.until(i, end, ";")
        eq = self.until(i + 2, stop, "=")
        if eq >= stop:
            return
        name, k = self.t[i + 1].text, eq + 1
        while self.is_(k, "try"):
            k += 1
        if self.ident(k):
            chain, m = [self.t[k].text], k + 1
            while m < stop and (self.is_(m, ".", "(")):
                if self.is_(m, "("):
                    m = self.match[m] + 1
                elif self.ident(m + 1):
                    chain.append(self.t[m + 1].text)
                    m += 2
                else:
                    break
            if m > k + 1:
                self.emit(caller, "var", name, chain)
            if self.t[k].text[:1].isupper() and self.t[k].text[:1].isascii() and (self.is_(k + 1, "{", ".")):
                self.emit(caller, "local", name, [self.t[k].text])

    def std_chains(self) -> list[tuple[str, list[str], int]]:
        """(alias, chain, line) of every dotted name below the first top-level import of std, outside line comments."""
        alias = next((n.name for n in self.nodes if n.kind == "import_decl" and n.parent == 0 and n.signature == "std"), None)
        if alias is None:
            return []
        out = []
        for m in re.finditer(rf"(?<![A-Za-z0-9_]){re.escape(alias)}\.([A-Za-z0-9_.]+)", self.text):
            before = self.text[self.text.rfind("\n", 0, m.start()) + 1 : m.start()]
            parts = [p for p in m[1].rstrip(".").split(".") if p]
            if "//" not in before and parts:
                out.append((alias, parts, self.text.count("\n", 0, m.start()) + 1))
        return out


def dependencies(text: str) -> list[str]:
    """Names in the .dependencies of a build manifest."""
    m = re.search(r"\.dependencies\s*=\s*\.\{", text)
    if not m:
        return []
    out, depth = [], 1
    for t in re.finditer(r'//.*|"(?:[^"\\]|\\.)*"|[{}]|\.(?:@"((?:[^"\\]|\\.)*)"|([A-Za-z_]\w*))\s*=', text[m.end() :]):
        if t[0] == "{":
            depth += 1
        elif t[0] == "}":
            depth -= 1
            if depth == 0:
                break
        elif depth == 1 and t[0][0] == ".":
            out.append(t[1] or t[2])
    return out
