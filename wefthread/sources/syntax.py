"""Tokens and bracket structure of source text, shared by the language readers.

A text becomes a flat list of tokens; strings are one token that remembers the
spans of its interpolated expressions, comments are dropped. Scopes and
expressions are spans over that list, so no tree is built and a malformed text
yields what can be read of it.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # id, const (Ruby), label (Ruby), num, str, symbol (Ruby), regex, op
    text: str
    start: int
    end: int
    parts: tuple[tuple[int, int], ...] = ()


@dataclass
class Scope:
    """A span of characters that belongs to a function or to a class."""

    kind: str
    name: str | None
    start: int
    end: int
    line: int


@dataclass
class Records:
    """What one file says, in the order of its text."""

    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    flows: list[dict] = field(default_factory=list)


OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
DOTS = {".", "?.", "&.", "::"}
#: Operators after which, or before which, an expression goes on to the next line.
GOES_ON = {"+", "-", "*", "/", "%", "&&", "||", "??", "?", ":", "=", ".", "?.", "&.", "::", ",", "=>", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "&", "|", "^", "!", "<<", ":=", "+=", "-=", "||="}
LEADS_ON = {".", "?.", "&.", "&&", "||", "??", "?", ":", "+", "*", "/", "%", "==", "===", "!=", "!==", "|", "=", "=>"}


class Tokens(list):
    """Tokens of a text; a place past its end is an empty token, so that cut-off text needs no checks."""

    def __getitem__(self, i):
        if isinstance(i, int) and i >= len(self):
            end = super().__getitem__(-1).end if self else 0
            return Token("op", "", end, end)
        return super().__getitem__(i)


class Stream:
    """Tokens with the partner of every bracket and the innermost bracket around every token."""

    def __init__(self, text: str, tokens: list[Token]):
        self.text, self.t = text, Tokens(tokens)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.pair: dict[int, int] = {}
        self.around: list[int] = []
        stack: list[int] = []
        for i, tok in enumerate(tokens):
            if tok.kind == "op" and tok.text in CLOSE:
                while stack and OPEN[tokens[stack[-1]].text] != tok.text:
                    stack.pop()
                if stack:
                    j = stack.pop()
                    self.pair[i], self.pair[j] = j, i
            self.around.append(stack[-1] if stack else -1)
            if tok.kind == "op" and tok.text in OPEN:
                stack.append(i)

    def __len__(self) -> int:
        return len(self.t)

    def line(self, offset: int) -> int:
        return bisect.bisect_left(self.breaks, offset) + 1

    def at(self, i: int) -> str:
        """A token's text; nothing outside the list, and a string never looks like an operator."""
        if not 0 <= i < len(self.t):
            return ""
        return self.t[i].text if self.t[i].kind not in ("str", "regex") else "\0"

    def kind(self, i: int) -> str:
        return self.t[i].kind if 0 <= i < len(self.t) else ""

    def fresh(self, i: int) -> bool:
        """Whether the token is the first of its line."""
        return i <= 0 or self.text.find("\n", self.t[i - 1].end, self.t[i].start) >= 0

    def span(self, i: int, j: int) -> str:
        return self.text[self.t[i].start : self.t[j].end]

    def close(self, i: int) -> int:
        """The partner of an opening bracket, or the last token where it is missing."""
        return self.pair.get(i, len(self.t) - 1)

    def after_angle(self, i: int) -> int:
        """The token after ``<...>`` that opens at i, or i where it isn't a list of types."""
        depth, k = 0, i
        while k < len(self.t) and self.at(i) == "<":
            s = self.at(k)
            depth += (s == "<") - (s == ">")
            if depth == 0:
                return k + 1
            if s in (";", ")", "]", "}", "&&", "||"):
                break
            k = self.close(k) + 1 if s in OPEN else k + 1
        return i

    def chain_start(self, i: int, words: frozenset[str]) -> int:
        """The first token of the chain of names, calls and indexes that ends at i."""
        while True:
            if self.at(i) in CLOSE and i in self.pair:
                j = self.pair[i]
                joined = j > 0 and not self.fresh(j) and (self.at(j - 1) in CLOSE or (self.kind(j - 1) in ("id", "const") and self.at(j - 1) not in words))
                if joined:
                    i = j - 1
                    continue
                i = j
            if i > 1 and self.at(i - 1) in DOTS:
                i -= 2
                continue
            return max(i, 0)

    def items(self, i: int) -> list[tuple[int, int]]:
        """(first, last) token of each part between commas in the bracket that opens at i."""
        out, first, k, last = [], i + 1, i + 1, self.close(i)
        while k < last:
            if self.at(k) == ",":
                if k > first:
                    out.append((first, k - 1))
                first = k + 1
            k = self.close(k) + 1 if self.at(k) in OPEN and self.kind(k) == "op" else k + 1
        if first < last:
            out.append((first, last - 1))
        return out

    def expression_end(self, i: int, block_ends: bool = False, stops: frozenset[str] = frozenset(), commas: bool = False) -> int:
        """The last token of the expression that starts at i.

        It ends before a semicolon, a closing bracket, a comma (unless ``commas``), a word
        of ``stops``, a brace where ``block_ends``, and at a line's end that no operator
        carries over.
        """
        k, last = i, i
        while k < len(self.t):
            s = self.at(k)
            if s == ";" or s in CLOSE or (s == "," and not commas):
                break
            if k > i:
                if self.kind(k) == "id" and s in stops:
                    break
                if self.fresh(k) and self.at(k - 1) not in GOES_ON and s not in LEADS_ON:
                    break
            if s == "{" and block_ends:
                break
            last = self.close(k) if s in OPEN and self.kind(k) == "op" else k
            k = last + 1
        return last


def enclosing(scopes: list[Scope], offset: int) -> tuple[str | None, str | None, int]:
    """The innermost named function and class around an offset, and the function's line (0 without one)."""
    function = owner = None
    line = 0
    for s in sorted((s for s in scopes if s.start < offset < s.end and s.name), key=lambda s: -s.start):
        if s.kind == "function" and function is None:
            function, line = s.name, s.line
        elif s.kind == "class" and owner is None:
            owner = s.name
    return function, owner, line


class Reader:
    """Gathers records; languages add how they see symbols, imports, calls and flows."""

    words: frozenset[str] = frozenset()

    def __init__(self, text: str):
        self.text = text
        self.records = Records()
        self.scopes: list[Scope] = []
        self.s = Stream(text, self.tokens(text, 0, len(text)))

    def tokens(self, text: str, start: int, end: int) -> list[Token]:
        raise NotImplementedError

    def structure(self) -> None:
        raise NotImplementedError

    def uses(self, s: Stream) -> None:
        raise NotImplementedError

    def read(self) -> Records:
        self.structure()
        self._uses(self.s)
        r = self.records
        for rows in (r.symbols, r.imports, r.calls, r.flows):
            rows.sort(key=lambda x: x.pop("__at"))
        return r

    def _uses(self, s: Stream) -> None:
        self.uses(s)
        for tok in s.t:
            for a, b in tok.parts:
                inner = Stream(self.text, self.tokens(self.text, a, b))
                if inner.t:
                    self.flow(inner, (0, len(inner) - 1), "string_interpolation", "StringInterp", tok.start)
                    self._uses(inner)

    def symbol(self, name: str, kind: str, start: int, end: int, exported: bool, parent: str | None = None, **more) -> dict:
        row = {"name": name, "kind": kind, "start_line": self.s.line(start), "end_line": self.s.line(max(start, end - 1)), "is_exported": exported, "parent_name": parent}
        row |= {"superclass": None, "interfaces": [], "type_annotation": None, "param_count": None, "__at": (start, len(self.records.symbols))} | more
        self.records.symbols.append(row)
        return row

    def load(self, source: str, names: list[str], at: int) -> None:
        self.records.imports.append({"source_path": source, "imported_names": names, "line": self.s.line(at), "__at": (at, len(self.records.imports))})

    def call(self, callee: str, receiver: str | None, at: int) -> None:
        name, parent, _ = enclosing(self.scopes, at)
        self.records.calls.append({"callee_name": callee, "receiver": receiver, "caller_name": name, "caller_parent": parent, "line": self.s.line(at), "__at": (at, len(self.records.calls))})

    def flow(self, s: Stream, source: tuple[int, int] | tuple[str, int], sink: str, kind: str, at: int) -> None:
        if isinstance(source[0], str):
            text, where = source
        else:
            text, where = s.span(*source), s.t[source[0]].start
        name, parent, line = enclosing(self.scopes, at)
        self.records.flows.append(
            {"source_expr": text, "sink_expr": sink, "flow_kind": kind, "enclosing_function": name, "enclosing_parent": parent, "enclosing_start_line": line,
             "source_line": self.s.line(where), "sink_line": self.s.line(at), "__at": (at, len(self.records.flows))}
        )


_C_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<str>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)
    |(?P<num>\d[\w.]*)
    |(?P<id>[#@]?[^\W\d][\w$]*|\$[\w$]*)
    |(?P<op>===|!==|\.\.\.|&&=|\|\|=|\?\?=|=>|\?\.(?!\d)|:=|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|<-|->|[-+*/%&|^]=|.)""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_BEFORE_REGEX = {"", "(", ",", "=", ":", "[", "!", "&&", "||", "??", "?", "{", "}", ";", "=>", "return", "typeof", "case", "+"}


def template_end(text: str, at: int, end: int) -> tuple[int, list[tuple[int, int]]]:
    """Where the template that opens at ``at`` ends, and the spans of its expressions."""
    parts, k = [], at + 1
    while k < end:
        if text[k] == "\\":
            k += 2
        elif text[k] == "`":
            return k + 1, parts
        elif text.startswith("${", k):
            stop = brace_end(text, k + 2, end)
            parts.append((k + 2, stop))
            k = stop + 1
        else:
            k += 1
    return end, parts


def brace_end(text: str, k: int, end: int) -> int:
    """The offset of the brace that closes an interpolation begun before ``k``."""
    depth = 0
    while k < end:
        c = text[k]
        if c in "\"'":
            k += 1
            while k < end and text[k] != c and text[k] != "\n":
                k += 2 if text[k] == "\\" else 1
        elif c == "`":
            k = template_end(text, k, end)[0] - 1
        elif c == "{":
            depth += 1
        elif c == "}":
            if depth == 0:
                return k
            depth -= 1
        k += 1
    return end


def c_tokens(text: str, start: int, end: int, templates: bool) -> list[Token]:
    """Tokens of the brace languages; a backtick opens a template or, without ``templates``, a raw string."""
    out: list[Token] = []
    k = start
    while k < end:
        if text[k] == "`":
            if templates:
                stop, parts = template_end(text, k, end)
            else:
                stop, parts = text.find("`", k + 1, end) + 1 or end, []
            out.append(Token("str", text[k:stop], k, stop, tuple(parts)))
            k = stop
            continue
        if templates and text[k] == "/" and (out[-1].text if out else "") in _BEFORE_REGEX and (m := _REGEX.match(text, k, end)) and not text.startswith(("//", "/*"), k):
            out.append(Token("regex", m.group(), k, m.end()))
            k = m.end()
            continue
        m = _C_TOKEN.match(text, k, end)
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m.group(), k, m.end()))
        k = m.end()
    return out
