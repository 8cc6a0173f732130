"""Readers of TypeScript (and JavaScript) and Go."""

from __future__ import annotations

from wefthread.sources.syntax import OPEN, Reader, Scope, Stream, Token, c_tokens


class TypeScript(Reader):
    """Classes, interfaces, enums, types, functions, imports, calls and flows.

    An abstract class gives no symbol and owns nothing. Members are never exported.
    The number in ``callee[argN]`` counts brackets and commas too.
    """

    words = frozenset("if for while switch catch return function new typeof await throw else case in of delete void yield import export do with super instanceof".split())
    modifiers = frozenset("public private protected readonly static override declare async get set abstract".split())

    def tokens(self, text: str, start: int, end: int) -> list[Token]:
        return c_tokens(text, start, end, templates=True)

    def structure(self) -> None:
        s, self.members, self.parameters = self.s, set(), set()
        for i in range(len(s)):
            word = s.at(i)
            if s.kind(i) != "id" or s.at(i - 1) in (".", "?."):
                continue
            exported = self._exported(i)
            if word == "class" and s.kind(i + 1) == "id" and s.at(i + 1) not in ("extends", "implements"):
                self._class(i, exported)
            elif word == "interface" and s.kind(i + 1) == "id":
                self._interface(i, exported)
            elif word == "enum" and s.kind(i + 1) == "id" and s.at(i + 2) == "{":
                self.symbol(s.at(i + 1), "Enum", s.t[i].start, s.t[s.close(i + 2)].end, exported)
            elif word == "type" and s.kind(i + 1) == "id" and s.at(s.after_angle(i + 2)) == "=":
                self.symbol(s.at(i + 1), "Type", s.t[i].start, s.t[s.expression_end(s.after_angle(i + 2) + 1)].end, exported)
            elif word == "function":
                self._function(i, exported)
            elif word in ("const", "let", "var") and s.around[i] not in self.members:
                self._declared(i, exported)
            elif word == "import" and s.around[i] == -1:
                self._import(i)

    def _exported(self, i: int) -> bool:
        while self.s.at(i - 1) in ("async", "default", "declare", "abstract"):
            i -= 1
        return self.s.at(i - 1) == "export"

    def _body(self, i: int) -> int:
        """The brace that opens the body of a function whose parameters open at i; -1 without one."""
        s = self.s
        self.parameters.add(i)
        k = s.close(i) + 1
        if s.at(k) == ":":
            k += 1
            while k < len(s) and s.at(k) not in ("=>", ";", "}", ")", ","):
                if s.at(k) == "{" and s.at(k - 1) not in (":", "|", "&", "<"):
                    break
                if s.at(k) != "{" and s.fresh(k) and s.at(k - 1) not in ("|", "&", ":") and s.at(k) not in ("|", "&"):
                    return -1
                k = s.close(k) + 1 if s.at(k) in OPEN else k + 1
        return k if s.at(k) == "{" else -1

    def _function(self, i: int, exported: bool) -> None:
        s = self.s
        k = i + 1 + (s.at(i + 1) == "*")
        named = s.kind(k) == "id"
        opens = s.after_angle(k + named)
        if s.at(opens) != "(":
            return
        body = self._body(opens)
        if named and body >= 0 and s.at(i - 1) not in ("=", "(", ",", ":", "return"):
            start = i - (s.at(i - 1) == "async")
            self.symbol(s.at(k), "Function", s.t[start].start, s.t[s.close(body)].end, exported)
            self.scopes.append(Scope("function", s.at(k), s.t[i].start, s.t[s.close(body)].end, s.line(s.t[start].start)))

    def _declared(self, i: int, exported: bool) -> None:
        """Variables that hold functions, and the flows into variables."""
        s, k = self.s, i + 1
        while s.kind(k) == "id" or s.at(k) in ("{", "["):
            name_at, name_end = k, s.close(k) if s.at(k) in OPEN else k
            k = name_end + 1
            if s.at(k) == ":":
                while k < len(s) and s.at(k) not in ("=", ";", ")") and not (s.fresh(k) and s.at(k - 1) not in (":", "|", "&")):
                    k = s.close(k) + 1 if s.at(k) in OPEN else k + 1
            if s.at(k) != "=":
                return
            first = k + 1
            last = s.expression_end(first)
            k = first + (s.at(first) == "async")
            arrow = None
            if s.at(k) == "function":
                arrow = "expression"
            else:
                opens = s.after_angle(k)
                if s.at(opens) == "(":
                    head = s.close(opens) + 1
                    while s.at(head) != "=>" and s.at(s.close(opens) + 1) == ":" and head < last:
                        head += 1
                    arrow = "arrow" if s.at(head) == "=>" else None
                    if arrow:
                        self.parameters.add(opens)
                elif s.kind(k) == "id" and s.at(k + 1) == "=>":
                    arrow = "arrow"
            end = s.t[last].end
            if arrow and name_at == name_end:
                self.symbol(s.at(name_at), "Function", s.t[name_at].start, end, exported)
            if arrow == "arrow" and name_at == name_end:
                self.scopes.append(Scope("function", s.at(name_at), s.t[first].start - 1, end, s.line(s.t[first].start)))
            if s.at(first) == "require" and s.at(first + 1) == "(" and s.kind(first + 2) == "str" and s.around[i] == -1:
                names = [s.at(name_at)] if name_at == name_end else [s.at(b) for _, b in s.items(name_at)]
                self.load(s.t[first + 2].text[1:-1], names, s.t[i].start)
            self.flow(s, (first, last), s.span(name_at, name_end), "Assignment", s.t[name_at].start)
            self._field(s, first, last, s.t[name_at].start)
            k = last + 1
            if s.at(k) != ",":
                return
            k += 1

    def _field(self, s: Stream, first: int, last: int, at: int) -> None:
        """A value that is a member access: its first name flows into the whole."""
        ends = s.kind(last) == "id" and s.at(last - 1) in (".", "?.")
        if ends and s.chain_start(last, self.words) == first and s.at(first) not in ("new", "await", "!"):
            whole = s.span(first, last)
            if "." in whole:
                self.flow(s, (whole.split(".", 1)[0], s.t[first].start), whole, "FieldAccess", at)

    def _heritage(self, i: int, stop: int) -> tuple[str | None, list[str]]:
        s, superclass, interfaces, mode = self.s, None, [], None
        k = i
        while k < stop:
            if s.at(k) in ("extends", "implements"):
                mode = s.at(k)
            elif mode and s.kind(k) == "id" and s.at(k - 1) in (mode, ","):
                if mode == "implements":
                    interfaces.append(s.at(k))
                elif s.at(k + 1) != ".":
                    superclass = s.at(k)
                following = s.after_angle(k + 1)
                k = following - 1 if following > k + 1 else k
            k += 1
        return superclass, interfaces

    def _brace(self, i: int) -> int:
        k = i
        while k < len(self.s) and self.s.at(k) not in ("{", ";"):
            k += 1
        return k if self.s.at(k) == "{" else -1

    def _class(self, i: int, exported: bool) -> None:
        s = self.s
        opens = self._brace(i)
        if opens < 0:
            return
        end, name = s.close(opens), s.at(i + 1)
        if s.at(i - 1) == "abstract":
            name = None
        else:
            superclass, interfaces = self._heritage(i + 2, opens)
            self.symbol(name, "Class", s.t[i].start, s.t[end].end, exported, superclass=superclass, interfaces=interfaces)
            self.scopes.append(Scope("class", name, s.t[i].start, s.t[end].end, s.line(s.t[i].start)))
        self.members.add(opens)
        k = opens + 1
        while k < end:
            k = self._member(k, end, name)

    def _member(self, k: int, end: int, owner: str | None) -> int:
        s, first = self.s, k
        while s.at(k).startswith("@"):  # decorators
            k += 1
            while s.at(k) == ".":
                k += 2
            if s.at(k) == "(":
                k = s.close(k) + 1
            first = k
        while s.at(k) == "*" or (s.at(k) in self.modifiers and (s.kind(k + 1) in ("id", "str") or s.at(k + 1) in ("*", "[")) and not (s.fresh(k + 1) and s.at(k) in ("get", "set"))):
            k += 1
        if s.at(k) in OPEN or s.kind(k) not in ("id", "str"):
            return s.close(k) + 1 if s.at(k) in OPEN else k + 1
        name_at = k
        name = s.t[k].text.strip("\"'`")
        k += 1
        k += s.at(k) in ("?", "!")
        opens = s.after_angle(k)
        if s.at(opens) == "(":
            body = self._body(opens)
            last = s.close(body) if body >= 0 else s.close(opens)
            if body >= 0:
                self.symbol(name, "Constructor" if name == "constructor" else "Method", s.t[first].start, s.t[last].end, False, owner)
                self.scopes.append(Scope("function", name, s.t[name_at].start, s.t[last].end, s.line(s.t[first].start)))
            if name == "constructor":
                self._held(opens, owner)
            return last + 1
        kind = None
        value = k
        if s.at(k) == ":":
            kind = s.at(k + 1) if self._plain(k + 1) else None
            value = k + 1
            while value < end and s.at(value) not in ("=", ";") and not (s.fresh(value) and s.at(value - 1) not in ("|", "&", ":") and s.at(value) not in ("|", "&")):
                value = s.close(value) + 1 if s.at(value) in OPEN else value + 1
        last = value - 1
        if s.at(value) == "=":
            last = s.expression_end(value + 1)
        self.symbol(name, "Property", s.t[first].start, s.t[last].end, False, owner, type_annotation=kind)
        return last + 1 + (s.at(last + 1) == ";")

    def _plain(self, k: int) -> bool:
        """Whether a type is one name and not a primitive."""
        s = self.s
        primitive = {"string", "number", "boolean", "any", "void", "unknown", "never", "object", "symbol", "null", "undefined"}
        return s.kind(k) == "id" and s.at(k) not in primitive and (s.at(k + 1) in ("=", ";", ",", ")", "}", "") or s.fresh(k + 1))

    def _held(self, opens: int, owner: str | None) -> None:
        """Constructor parameters with a modifier are properties."""
        s = self.s
        for a, b in s.items(opens):
            k = a
            while s.at(k).startswith("@"):
                k = s.close(k + 1) + 1 if s.at(k + 1) == "(" else k + 1
            name = k
            while s.at(name) in ("public", "private", "protected", "readonly", "override") and name < b:
                name += 1
            if name > k and s.kind(name) == "id":
                colon = name + 1 + (s.at(name + 1) == "?")
                kind = s.at(colon + 1) if s.at(colon) == ":" and self._plain(colon + 1) else None
                self.symbol(s.at(name), "Property", s.t[a].start, s.t[b].end, False, owner, type_annotation=kind)

    def _interface(self, i: int, exported: bool) -> None:
        s = self.s
        opens = self._brace(i)
        if opens < 0:
            return
        end, name = s.close(opens), s.at(i + 1)
        self.members.add(opens)
        bases, k = [], i + 2
        while k < opens:
            if s.kind(k) == "id" and s.at(k) != "extends" and s.at(k - 1) in ("extends", ",") and s.at(k + 1) != "<":
                bases.append(s.at(k))
            k = max(k + 1, s.after_angle(k))
        self.symbol(name, "Interface", s.t[i].start, s.t[end].end, exported, interfaces=bases)
        k = opens + 1
        while k < end:
            k += s.at(k) == "readonly" and s.kind(k + 1) == "id"
            if s.kind(k) not in ("id", "str"):
                k = s.close(k) + 1 if s.at(k) in OPEN else k + 1
                continue
            member, first = s.t[k].text.strip("\"'"), k
            k += 1
            k += s.at(k) == "?"
            opened = s.after_angle(k)
            method = s.at(opened) == "("
            colon = k if s.at(k) == ":" else -1
            last = k
            while last < end and s.at(last) not in (";", ",") and not (last > k and s.fresh(last) and s.at(last - 1) not in (":", "|", "&", "=>") and s.at(last) not in ("|", "&")):
                last = s.close(last) + 1 if s.at(last) in OPEN else last + 1
            kind = s.at(colon + 1) if colon >= 0 and self._plain(colon + 1) else None
            if method or colon >= 0:
                self.symbol(member, "Method" if method else "Property", s.t[first].start, s.t[last - 1].end, False, name, **({} if method else {"type_annotation": kind}))
            k = max(last + (s.at(last) in (";", ",")), k)

    def _import(self, i: int) -> None:
        s, k, names = self.s, i + 1, []
        if s.at(k) in ("(", "."):
            return
        while k < len(s) and s.kind(k) != "str" and not (s.fresh(k) and s.around[k] == -1 and s.at(k) != "from"):
            if s.at(k) == "{":
                names += [s.at(b) for _, b in s.items(k)]
                k = s.close(k)
            elif s.kind(k) == "id" and s.at(k) not in ("from", "type", "as"):
                names.append(s.at(k))
            k += 1
        if s.kind(k) == "str":
            self.load(s.t[k].text[1:-1], names, s.t[i].start)

    def uses(self, s: Stream) -> None:
        own = s is self.s
        for i in range(len(s)):
            word = s.at(i)
            if word == "(" and not (own and i in self.parameters) and s.at(s.close(i) + 1) != "=>":
                self._call(s, i)
            elif word == "return" and s.kind(i) == "id" and s.at(i - 1) != "." and i + 1 < len(s) and not s.fresh(i + 1) and s.at(i + 1) not in (";", "}"):
                self.flow(s, (i + 1, s.expression_end(i + 1)), "return", "Return", s.t[i].start)
            elif word == "=" and s.kind(i) == "op" and i > 0 and not (own and (s.around[i] in self.members or s.around[i] in self.parameters)):
                self._assign(s, i)

    def _assign(self, s: Stream, i: int) -> None:
        if s.kind(i - 1) != "id" and s.at(i - 1) not in ("]", "}"):
            return
        a = s.chain_start(i - 1, self.words)
        if s.kind(a) == "id" and s.at(a - 1) in ("const", "let", "var", "type", ":", ",", "|", "&", "<") or s.at(a) in ("{", "["):
            return
        self.flow(s, (i + 1, s.expression_end(i + 1)), s.span(a, i - 1), "Assignment", s.t[a].start)

    def _callee(self, s: Stream, i: int) -> int:
        """The last token of what is called by the bracket at i; -1 where nothing is."""
        k = i - 1
        if s.at(k) == ">":
            j = k
            while j > 0 and (s.kind(j) == "id" or s.at(j) in (">", ",", ".", "[", "]", "|")):
                j -= 1
            if s.at(j) != "<" or s.kind(j - 1) != "id" or s.t[j - 1].end != s.t[j].start:
                return -1
            k = j - 1
        return k if s.kind(k) == "id" and s.at(k) not in self.words else -1

    def _call(self, s: Stream, i: int) -> None:
        k = self._callee(s, i)
        if k < 0 or s.at(k - 1) == "function":
            return
        a = s.chain_start(k, self.words)
        made = s.at(a - 1) == "new"
        at = s.t[a - 1].start if made else s.t[a].start
        receiver = None
        if k > a:
            receiver = s.span(a, k - 2)
            if receiver.startswith("this.") and receiver.count(".") == 1:
                receiver = receiver[5:]
        if not (s.at(k) == "require" and k == a):
            self.call(s.at(k), receiver, at)
        if not made:
            callee, place = s.span(a, k), 1
            for x, y in s.items(i):
                self.flow(s, (x, y), f"{callee}[arg{place}]", "Argument", at)
                place += 2


class Go(Reader):
    """Functions, methods, types, fields, imports, calls and flows. A name in capitals is exported."""

    words = frozenset("if for switch select return func go defer range case else var const type map chan struct interface package import break continue fallthrough".split())

    def tokens(self, text: str, start: int, end: int) -> list[Token]:
        return c_tokens(text, start, end, templates=False)

    def structure(self) -> None:
        s, self.parameters = self.s, set()
        for i in range(len(s)):
            word = s.at(i)
            if s.kind(i) != "id" or not s.fresh(i) or s.around[i] != -1:
                continue
            if word == "func":
                self._func(i)
            elif word == "type":
                if s.at(i + 1) == "(":
                    k = i + 2
                    while k < s.close(i + 1):
                        k = self._type(k) if s.kind(k) == "id" else k + 1
                else:
                    self._type(i + 1)
            elif word == "import":
                self._import(i + 1)

    def _exported(self, name: str) -> bool:
        return name[:1].isupper()

    def _func(self, i: int) -> None:
        s, k, owner = self.s, i + 1, None
        if s.at(k) == "(":
            self.parameters.add(k)
            inside = [s.at(x) for x in range(k + 1, s.close(k)) if s.kind(x) == "id"]
            square = next((x for x in range(k + 1, s.close(k)) if s.at(x) == "["), None)
            owner = s.at(square - 1) if square else (inside[-1] if inside else None)
            k = s.close(k) + 1
        if s.kind(k) != "id":
            return
        name, opens = s.at(k), k + 1
        if s.at(opens) == "[":
            opens = s.close(opens) + 1
        if s.at(opens) != "(":
            return
        self.parameters.add(opens)
        body = s.close(opens) + 1
        if s.at(body) == "(":
            self.parameters.add(body)
        while body < len(s) and not (s.at(body) == "{" and s.at(body - 1) not in ("struct", "interface")):
            if s.fresh(body):
                return
            body = s.close(body) + 1 if s.at(body) in OPEN else body + 1
        if body >= len(s):
            return
        end = s.t[s.close(body)].end
        self.symbol(name, "Method" if owner else "Function", s.t[i].start, end, self._exported(name), owner, param_count=len(s.items(opens)))
        self.scopes.append(Scope("function", name, s.t[i].start, end, s.line(s.t[i].start)))

    def _type(self, i: int) -> int:
        s, name, k = self.s, self.s.at(i), i + 1
        if s.at(k) == "[" and s.kind(k + 1) == "id" and s.kind(k + 2) == "id":
            k = s.close(k) + 1
        k += s.at(k) == "="
        what = s.at(k)
        if what in ("struct", "interface") and s.at(k + 1) == "{":
            end = s.close(k + 1)
            self.symbol(name, "Struct" if what == "struct" else "Interface", s.t[i].start, s.t[end].end, self._exported(name))
            (self._fields if what == "struct" else self._signatures)(k + 2, end, name)
            return end + 1
        end = s.expression_end(k)
        self.symbol(name, "Type", s.t[i].start, s.t[end].end, self._exported(name))
        return end + 1

    def _lines(self, k: int, end: int):
        """(first, last) token of every line at the depth of a body."""
        s, first = self.s, k
        while k < end:
            following = s.close(k) + 1 if s.at(k) in OPEN else k + 1
            if following >= end or s.fresh(following) or s.at(following) == ";":
                yield first, following - 1
                first = following + (s.at(following) == ";")
                following = first
            k = following

    def _fields(self, k: int, end: int, owner: str) -> None:
        s = self.s
        for a, b in self._lines(k, end):
            names, x = [], a
            while s.kind(x) == "id" and s.at(x + 1) == ",":
                names.append(x)
                x += 2
            if s.kind(x) == "id" and x < b and s.at(x + 1) != "." and s.kind(x + 1) != "str":
                for n in [*names, x]:
                    kind = s.at(x + 1 + (s.at(x + 1) == "*")) or None
                    plain = s.kind(x + 1 + (s.at(x + 1) == "*")) == "id"
                    self.symbol(s.at(n), "Property", s.t[n].start, s.t[b].end, self._exported(s.at(n)), owner, type_annotation=kind if plain else None)

    def _signatures(self, k: int, end: int, owner: str) -> None:
        s = self.s
        for a, b in self._lines(k, end):
            if s.kind(a) == "id" and s.at(a + 1) == "(":
                self.symbol(s.at(a), "Method", s.t[a].start, s.t[b].end, self._exported(s.at(a)), owner, param_count=len(s.items(a + 1)))
                self.parameters |= {x for x in range(a, b) if s.at(x) == "("}

    def _import(self, i: int) -> None:
        s = self.s
        last = s.close(i) if s.at(i) == "(" else i + 1
        for k in range(i, min(last + 1, len(s))):
            if s.kind(k) == "str":
                alias = s.at(k - 1) if s.kind(k - 1) == "id" and not s.fresh(k) and s.at(k - 1) != "import" else None
                alias = "." if s.at(k - 1) == "." and not s.fresh(k) else alias
                self.load(s.t[k].text[1:-1], [alias] if alias else [], s.t[k].start)
                if s.at(i) != "(":
                    break

    def _statement(self, s: Stream, i: int) -> int:
        """The first token of the statement around i."""
        k = i
        while k > 0:
            if s.at(k - 1) in (";", "{", ":") or (s.fresh(k) and s.at(k - 1) not in (",", "(", "[")):
                break
            k = s.pair.get(k - 1, k - 1) if s.at(k - 1) in (")", "]", "}") else k - 1
            if s.at(k) in ("(", "[") and s.close(k) > i:
                return k + 1
        return k

    def uses(self, s: Stream) -> None:
        for i in range(len(s)):
            word = s.at(i)
            if word == "(" and not (s is self.s and i in self.parameters) and s.kind(i - 1) == "id" and s.at(i - 1) not in self.words and not s.fresh(i):
                self._call(s, i)
            elif word == "return" and s.kind(i) == "id" and i + 1 < len(s) and not s.fresh(i + 1) and s.at(i + 1) not in ("}", ";"):
                self.flow(s, (i + 1, s.expression_end(i + 1, commas=True)), "return", "Return", s.t[i].start)
            elif word in (":=", "=") and s.kind(i) == "op" and i + 1 < len(s):
                self._assign(s, i)

    def _assign(self, s: Stream, i: int) -> None:
        a = self._statement(s, i)
        lead = s.at(a) if s.kind(a) == "id" else ""
        if lead in ("var", "const", "type", "import") or a >= i:
            return
        header = lead in ("if", "for", "switch", "case", "select", "else")
        while s.at(a) in ("if", "for", "switch", "case", "else"):
            a += 1
        first = i + 1
        if s.at(first) == "range" or a >= i:
            return
        last = s.expression_end(first, block_ends=header, commas=True)
        at = s.t[a].start
        self.flow(s, (first, last), s.span(a, i - 1), "Assignment", at)
        if s.kind(last) == "id" and s.at(last - 1) == "." and s.chain_start(last, self.words) == first:
            k = last
            while k - 2 >= first and s.at(k - 1) == ".":
                self.flow(s, (first, k - 2), s.span(first, k), "FieldAccess", at)
                k -= 2
                if s.at(k) in (")", "]"):
                    break

    def _call(self, s: Stream, i: int) -> None:
        k = i - 1
        a = s.chain_start(k, self.words)
        if s.at(k - 1) == "func" or (s is self.s and s.at(a - 1) == "func"):
            return
        at = s.t[a].start
        self.call(s.at(k), s.span(a, k - 2) if k > a else None, at)
        for place, (x, y) in enumerate(s.items(i)):
            self.flow(s, (x, y), f"{s.span(a, k)}[arg{place}]", "Argument", at)
