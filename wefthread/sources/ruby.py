"""Reader of Ruby."""

from __future__ import annotations

import re

from wefthread.sources.syntax import Reader, Scope, Stream, Token, brace_end

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*|\\\n)
    |(?P<num>\d[\w.]*(?<!\.))
    |(?P<symbol>:(?:[^\W\d]\w*[?!=]?(?![=~>])|[^\W\d]\w*|"(?:\\.|[^"\\])*"))
    |(?P<label>[^\W\d]\w*[?!]?:(?!:))
    |(?P<const>[A-Z]\w*)
    |(?P<id>@{0,2}[^\W\d]\w*(?:[?!](?!=))?|\$\w+)
    |(?P<op>\*\*|===|<=>|=~|\|\|=|&&=|&\.|::|=>|->|==|!=|<=|>=|&&|\|\||<<|>>|\.\.\.?|[-+*/]=|.)""",
    re.X | re.S,
)
_HEREDOC = re.compile(r"<<[~-]?(['\"]?)([A-Z_]\w*)\1")
_WORDS = re.compile(r"%[wWiIqQ]?([\[({<|])")
_REGEX = re.compile(r"/(?:\\.|[^/\\\n])+/[a-z]*")
_BLOCKS = {"class", "module", "def", "begin", "case", "do", "if", "unless", "while", "until", "for"}
#: After these an ``if`` or ``while`` opens a block; after a value it is a modifier.
_OPENS_AFTER = {"=", "(", "[", "{", ",", "||", "&&", "=>", "->", "then", "else", "do", "||=", "+", "<<", "!", "not", "and", "or", "|", "?", ":"}


class Ruby(Reader):
    """Classes, modules, methods, attributes, mixins, constants, requires, calls and flows; all is exported.

    Names without a receiver, arguments or brackets are not calls.
    """

    words = frozenset(
        "if unless while until case when then else elsif end def class module return do begin rescue ensure yield and or not in for self nil true false super next break defined? alias undef".split()
    )
    modifiers = frozenset("if unless while until rescue and or then do".split())

    def tokens(self, text: str, start: int, end: int) -> list[Token]:
        out: list[Token] = []
        k, pending = start, None
        while k < end:
            c = text[k]
            if c == "\n" and pending:
                body = re.compile(rf"^[ \t]*{pending}[ \t]*$", re.M).search(text, k + 1, end)
                k, pending = (body.end() if body else end), None
                continue
            if text.startswith("=begin", k) and (k == 0 or text[k - 1] == "\n"):
                stop = text.find("\n=end", k, end)
                k = stop + 5 if stop >= 0 else end
                continue
            before = out[-1] if out else None
            value = before is not None and (before.kind in ("const", "num", "str", "symbol") or before.text in (")", "]", "}") or (before.kind == "id" and before.text not in self.words))
            if c == '"' or c == "`":
                stop, parts = self._string(text, k, end, c)
                out.append(Token("str", text[k:stop], k, stop, tuple(parts)))
                k = stop
                continue
            if c == "'":
                m = re.compile(r"'(?:\\.|[^'\\])*'?", re.S).match(text, k, end)
            elif c == "/" and (not value or (before.kind == "id" and text[k - 1] in " \t" and text[k + 1 : k + 2] not in " \t=")):
                m = _REGEX.match(text, k, end)
            elif c == "%" and not value and (m := _WORDS.match(text, k, end)):
                closing = {"[": "]", "(": ")", "{": "}", "<": ">", "|": "|"}[m.group(1)]
                stop = text.find(closing, m.end(), end) + 1 or end
                out.append(Token("str", text[k:stop], k, stop))
                k = stop
                continue
            elif c == "<" and (m := _HEREDOC.match(text, k, end)) and not (before and before.text == "class"):
                pending = m.group(2)
            else:
                m = None
            if m:
                out.append(Token("str" if c != "/" else "regex", m.group(), k, m.end()))
                k = m.end()
                continue
            m = _TOKEN.match(text, k, end)
            if m.lastgroup == "label" and before is not None and before.text == "?":  # a ? b : c
                m = re.compile(r"(?P<id>\w+[?!]?)").match(text, k, end)
            if m.lastgroup == "skip" and pending and "\n" in m.group():
                k += m.group().index("\n")
                continue
            if m.lastgroup != "skip":
                out.append(Token(m.lastgroup, m.group(), k, m.end()))
            k = m.end()
        return out

    def _string(self, text: str, at: int, end: int, quote: str) -> tuple[int, list[tuple[int, int]]]:
        parts, k = [], at + 1
        while k < end and text[k] != quote:
            if text[k] == "\\":
                k += 2
            elif text.startswith("#{", k):
                stop = brace_end(text, k + 2, end)
                parts.append((k + 2, stop))
                k = stop + 1
            else:
                k += 1
        return min(k + 1, end), parts

    def _blocks(self) -> dict[int, int]:
        """The ``end`` of every word that opens a block."""
        s, stack, ends = self.s, [], {}
        for i in range(len(s)):
            word = s.at(i)
            if s.kind(i) != "id" or s.at(i - 1) in (".", "&."):
                continue
            if word == "end" and stack:
                ends[stack.pop()] = i
            elif word in _BLOCKS:
                if word in ("if", "unless", "while", "until") and not (s.fresh(i) or s.at(i - 1) in _OPENS_AFTER):
                    continue
                if word == "do" and stack and s.at(stack[-1]) in ("while", "until", "for") and s.line(s.t[stack[-1]].start) == s.line(s.t[i].start):
                    continue
                if word == "def" and self._endless(i):
                    continue
                stack.append(i)
        for i in stack:
            ends[i] = len(s) - 1
        return ends

    def _endless(self, i: int) -> bool:
        s = self.s
        k = i + 2 + 2 * (s.at(i + 2) == ".")
        if s.at(k) == "(":
            k = s.close(k) + 1
        return s.at(k) == "=" and not s.fresh(k)

    def structure(self) -> None:
        s = self.s
        ends = self._blocks()
        bodies: list[tuple[int, int]] = []  # methods
        owners: list[tuple[int, str, dict]] = []  # (end, name, row)
        self.names: set[int] = set()
        i = 0
        while i < len(s):
            word = s.at(i)
            while owners and owners[-1][0] < i:
                owners.pop()
            owner = owners[-1][1] if owners else None
            inside = any(a < i <= b for a, b in bodies[-1:])
            if s.kind(i) == "id" and s.at(i - 1) not in (".", "&."):
                if word in ("class", "module") and s.kind(i + 1) == "const":
                    k = i + 1
                    while s.at(k + 1) == "::":
                        k += 2
                    name, superclass, last = s.span(i + 1, k), None, k
                    if word == "class" and s.at(k + 1) == "<":
                        last = k + 2
                        while s.at(last + 1) == "::":
                            last += 2
                        superclass = s.span(k + 2, last)
                    end = ends.get(i, len(s) - 1)
                    row = self.symbol(name, word.capitalize(), s.t[i].start, s.t[end].end, True, owner, superclass=superclass)
                    self.scopes.append(Scope("class", name, s.t[i].start, s.t[end].end, s.line(s.t[i].start)))
                    owners.append((end, name, row))
                    i = last + 1
                    continue
                if word == "def":
                    k = i + 1 + 2 * (s.at(i + 2) == ".")
                    self.names |= {i + 1, k}
                    joined = k + 1 < len(s) and s.at(k + 1) == "=" and s.t[k + 1].start == s.t[k].end and not self._endless(i)
                    name = s.t[k].text.rstrip(":") + ("=" if joined else "") if k < len(s) else ""
                    if i in ends:
                        end = ends[i]
                    else:
                        end = s.expression_end(min(k + 1, len(s) - 1))
                    kind = "Constructor" if name == "initialize" else "Method" if owner else "Function"
                    if not inside and name:
                        self.symbol(name, kind, s.t[i].start, s.t[end].end, True, owner)
                    self.scopes.append(Scope("function", name, s.t[i].start, s.t[end].end, s.line(s.t[i].start)))
                    if s.at(k + 1 + joined) == "(":
                        self.names.add(k + 1 + joined)
                    bodies.append((i, end))
                elif word in ("attr_accessor", "attr_reader", "attr_writer") and owner and not inside:
                    for a, _ in self._arguments(s, i):
                        if s.kind(a) == "symbol":
                            self.symbol(s.at(a)[1:], "Property", s.t[a].start, s.t[a].end, True, owner)
                elif word in ("include", "extend", "prepend") and owner and not inside:
                    for a, b in self._arguments(s, i):
                        if s.kind(a) == "const":
                            owners[-1][2]["interfaces"].append(s.span(a, b))
                elif word in ("require", "require_relative"):
                    for a, _ in self._arguments(s, i):
                        if s.kind(a) == "str":
                            self.load(s.t[a].text[1:-1], [], s.t[i].start)
            elif s.kind(i) == "const" and not inside and s.at(i - 1) != ".":
                k = i
                while s.at(k + 1) == "::" and s.kind(k + 2) == "const":
                    k += 2
                self.symbol(s.span(i, k), "Constant", s.t[i].start, s.t[k].end, True, owner)
                i = k
            i += 1

    def _arguments(self, s: Stream, i: int) -> list[tuple[int, int]]:
        """The arguments of the call named at i, in brackets or after a space."""
        if s.at(i + 1) == "(" and s.t[i + 1].start == s.t[i].end:
            return s.items(i + 1)
        if not self._bare(s, i):
            return []
        out, k = [], i + 1
        while True:
            last = s.expression_end(k, stops=self.modifiers)
            out.append((k, last))
            if s.at(last + 1) != ",":
                return out
            k = last + 2
            if k >= len(s):
                return out

    def _bare(self, s: Stream, i: int) -> bool:
        """Whether arguments without brackets follow the name at i."""
        if i + 1 >= len(s) or s.fresh(i + 1) or s.t[i + 1].start == s.t[i].end:
            return False
        k, following = s.kind(i + 1), s.at(i + 1)
        if k in ("const", "num", "str", "symbol", "label", "regex"):
            return True
        if k == "id":
            return following not in self.words or following in ("self", "nil", "true", "false", "not", "defined?")
        close = i + 2 < len(s) and s.t[i + 2].start == s.t[i + 1].end
        return following in ("->", "[", "!") or (following in ("*", "&", ":", "-", "::", "**") and close)

    def uses(self, s: Stream) -> None:
        own = s is self.s
        for i in range(len(s)):
            word, kind = s.at(i), s.kind(i)
            if kind in ("id", "const") and not (own and i in self.names):
                self._call(s, i)
            if kind == "id" and word == "return" and i + 1 < len(s) and not s.fresh(i + 1) and s.at(i + 1) not in self.modifiers and s.at(i + 1) not in ("}", "end"):
                self.flow(s, (i + 1, s.expression_end(i + 1, stops=self.modifiers, commas=True)), "return", "Return", s.t[i].start)
            if kind == "op" and word == "=" and i > 0 and i + 1 < len(s) and not (own and (i - 1 in self.names or s.around[i] in self.names)):
                self._assign(s, i)

    def _assign(self, s: Stream, i: int) -> None:
        a = s.chain_start(i - 1, self.words)
        while a > 1 and s.at(a - 1) == "," and not s.fresh(a):  # a, b = ...
            a = s.chain_start(a - 2, self.words)
        if s.around[a] >= 0 and s.at(s.around[a]) == "|" or s.kind(a) not in ("id", "const"):
            return
        first, last = i + 1, self._value_end(s, i + 1)
        at = s.t[a].start
        self.flow(s, (first, last), s.span(a, i - 1), "Assignment", at)
        name = self._last_call(s, first, last)
        if name > first and s.at(name - 1) in (".", "&."):
            self.flow(s, (first, name - 2), s.span(first, last), "FieldAccess", at)
        if s.kind(a) == "const" and a == i - 1 and s.at(first) == "[":
            for x, y in s.items(first):
                if s.kind(x) == "const" and all(s.kind(k) == "const" or s.at(k) == "::" for k in range(x, y + 1)):
                    space, _, short = s.span(x, y).rpartition("::")
                    self.call(short, space or None, s.t[x].start)

    def _value_end(self, s: Stream, first: int) -> int:
        if s is self.s and s.at(first) in ("if", "unless", "case", "begin", "while"):
            depth, k = 0, first
            while k < len(s):
                if s.kind(k) == "id" and s.at(k) in _BLOCKS and (k == first or s.fresh(k) or s.at(k) in ("do", "case", "begin")):
                    depth += 1
                elif s.kind(k) == "id" and s.at(k) == "end":
                    depth -= 1
                    if depth == 0:
                        return k
                k += 1
        return s.expression_end(first, stops=self.modifiers, commas=False)

    def _last_call(self, s: Stream, first: int, last: int) -> int:
        """The name of the call that a whole value is; -1 where it is none."""
        k = last
        while s.at(k) in (")", "}") and k in s.pair and s.pair[k] > first:
            k = s.pair[k] - 1
        return k if s.kind(k) in ("id", "const") and s.chain_start(k, self.words) == first else -1

    def _call(self, s: Stream, i: int) -> None:
        word = s.at(i)
        if s.at(i - 1) == "::" and s.kind(i) == "const" or s.at(i - 1) in ("def", "class", "module", "alias"):
            return
        dotted = s.at(i - 1) in (".", "&.")
        bracket = i + 1 < len(s) and s.at(i + 1) == "(" and s.t[i + 1].start == s.t[i].end
        if not dotted and (word in self.words or (s.kind(i) == "const" and not bracket) or word.startswith(("@", "$"))):
            return
        arguments = self._arguments(s, i) if bracket or (self._bare(s, i) and s.kind(i) == "id") else []
        block = i + 1 < len(s) and s.at(i + 1) in ("{", "do") and not s.fresh(i + 1)
        if not (dotted or bracket or arguments or block):
            return
        if not dotted and not bracket and s.at(i + 1) in ("[", "-", "*", "&", ":") and self._assigned(s, i):
            return
        a = s.chain_start(i, self.words) if dotted else i
        receiver = s.span(a, i - 2) if dotted else None
        whole = f"{receiver}.{word}" if dotted else word
        if receiver is not None and ("\n" in receiver or len(receiver.encode()) > 80):
            receiver = None
        at = s.t[a].start
        if word in ("send", "public_send", "__send__"):
            if arguments:
                k = arguments[0][0]
                target = s.t[k].text.lstrip(":").strip("\"'") if s.kind(k) in ("symbol", "str") and not s.t[k].parts else None
                if target:
                    self.call(target, receiver, at)
        else:
            self.call(word, receiver, at)
        for place, (x, y) in enumerate(arguments):
            self.flow(s, (x, y), f"{whole}[arg{place}]", "Argument", at)

    def _assigned(self, s: Stream, i: int) -> bool:
        """Whether the name at i was given a value earlier in this text, so that an operator follows it."""
        return any(s.kind(k) == "id" and s.at(k) == s.at(i) and s.at(k + 1) in ("=", ",", "|", ")") for k in range(i))
