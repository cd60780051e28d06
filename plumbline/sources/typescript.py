"""Declarations, imports, exports and citations of a TypeScript file.

A tokenizer and a reader of declarations, no type checker. Bodies of functions,
initialisers and types are skipped by their brackets; what is read is what can
be exported: interfaces, aliases, functions, variables, classes, enums and
namespaces, import and export lists.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from dataclasses import dataclass, field

from plumbline.model import TAGS
from plumbline.sources.tags import tags

_ID = re.compile(r"[#A-Za-z_$\u0080-￿][\w$\u0080-￿]*")
_NUM = re.compile(r"0[xXoObB][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_PUNCT = re.compile(r"\.\.\.|=>|===|!==|==|!=|\*\*=|\+\+|--|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|[-+*/%&|^<]=|.", re.DOTALL)
_OPERATORS = {"typeof", "instanceof", "in", "of", "new", "delete", "void", "return", "throw", "case", "do", "else", "yield", "await", "as", "satisfies", "extends", "keyof", "is", "infer"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_MODIFIERS = {"export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "override", "readonly", "accessor"}


@dataclass
class Token:
    kind: str  # id, str, num, tpl, re, p
    text: str
    start: int
    end: int
    fresh: bool  # first on its line
    docs: list[tuple[int, int]] = field(default_factory=list)


def _template_end(s: str, at: int) -> int:
    """End of the template whose back-tick is at at."""
    i = at + 1
    while i < len(s):
        if s[i] == "\\":
            i += 2
        elif s[i] == "`":
            return i + 1
        elif s.startswith("${", i):
            i = _hole_end(s, i + 2)
        else:
            i += 1
    return len(s)


def _hole_end(s: str, i: int) -> int:
    depth = 1
    while i < len(s) and depth:
        c = s[i]
        if c == "`":
            i = _template_end(s, i)
            continue
        if c in "'\"":
            m = re.compile(rf"{c}(?:\\.|[^{c}\\\n])*{c}?", re.DOTALL).match(s, i)
            i = m.end()
            continue
        if s.startswith("/*", i):
            end = s.find("*/", i + 2)
            i = len(s) if end < 0 else end + 2
            continue
        if s.startswith("//", i):
            end = s.find("\n", i)
            i = len(s) if end < 0 else end
            continue
        depth += (c == "{") - (c == "}")
        i += 1
    return i


def tokenize(s: str) -> list[Token]:
    out: list[Token] = []
    i, fresh, docs = (1 if s.startswith("﻿") else 0), True, []
    if s.startswith("#!"):
        i = s.find("\n") if "\n" in s else len(s)
    n = len(s)
    while i < n:
        c = s[i]
        if c.isspace():
            fresh |= c == "\n"
            i += 1
            continue
        if s.startswith("//", i):
            end = s.find("\n", i)
            i = n if end < 0 else end
            continue
        if s.startswith("/*", i):
            end = s.find("*/", i + 2)
            end = n if end < 0 else end + 2
            if s.startswith("/**", i) and end - i > 4 and s[i + 3] != "/":
                docs.append((i, end))
            fresh |= "\n" in s[i:end]
            i = end
            continue
        kind, end = "p", i + 1
        if c in "'\"":
            m = re.compile(rf"{c}(?:\\.|[^{c}\\\n])*{c}", re.DOTALL).match(s, i)
            if m:
                kind, end = "str", m.end()
        elif c == "`":
            kind, end = "tpl", _template_end(s, i)
        elif m := _ID.match(s, i):
            kind, end = "id", m.end()
        elif c.isdigit() or (c == "." and s[i + 1 : i + 2].isdigit()):
            kind, end = "num", _NUM.match(s, i).end()
        elif c == "/" and _regex_here(out):
            m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*").match(s, i)
            if m:
                kind, end = "re", m.end()
        if kind == "p":
            end = _PUNCT.match(s, i).end()
        out.append(Token(kind, s[i:end], i, end, fresh, docs))
        i, fresh, docs = end, False, []
    out.append(Token("end", "", n, n, True, docs))
    return out


def _regex_here(before: list[Token]) -> bool:
    if not before:
        return True
    last = before[-1]
    if last.kind == "id":
        return last.text in _OPERATORS
    return last.kind == "p" and last.text not in (")", "]", "}", "++", "--")


def identity_id(path: str, symbol: str, identity: list[str]) -> str:
    return f"typescript:{path}:{symbol}:" + "".join(f"{len(x.encode())}:{x};" for x in identity)


@dataclass
class Statement:
    kind: str  # interface, type, function, variable, class, enum, module, import, export, assignment, other
    start: int  # token numbers
    modifiers: set[str]
    name: int | None = None
    body: list = field(default_factory=list)
    members: list = field(default_factory=list)
    extra: dict = field(default_factory=dict)


class _Reader:
    """Statements out of tokens."""

    def __init__(self, tokens: list[Token]) -> None:
        # what is open at the end may step beyond it, a few tokens for each that opened it
        self.t, self.i = tokens + [tokens[-1]] * (4 * len(tokens) + 16), 0
        #: the bracket that closes each bracket, the last token where none does
        self.close: dict[int, int] = {}
        open_: list[int] = []
        for k, t in enumerate(tokens):
            if t.kind == "p" and t.text in _OPEN:
                open_.append(k)
            elif t.kind == "p" and t.text in _CLOSE and open_:
                self.close[open_.pop()] = k
        self.close |= dict.fromkeys(open_, len(tokens) - 1)

    def at(self, *texts: str, ahead: int = 0) -> bool:
        t = self.t[min(self.i + ahead, len(self.t) - 1)]
        return t.kind in ("id", "p") and t.text in texts

    @property
    def now(self) -> Token:
        return self.t[self.i]

    def name_text(self, k: int | None) -> str:
        """A legal name: an identifier, string or number without blanks."""
        if k is None or self.t[k].kind not in ("id", "str", "num"):
            return ""
        t = self.t[k]
        text = re.sub(r"\\(.)", r"\1", t.text[1:-1]) if t.kind == "str" else t.text
        return "" if re.search(r"\s", text) or text.startswith("#") else text

    def skip_group(self) -> None:
        """Over a bracketed group that starts here, or one token."""
        if self.now.kind != "end":
            self.i = self.close.get(self.i, self.i)
            if self.now.kind != "end":
                self.i += 1

    def skip_angles(self) -> None:
        """Over <...> that starts here."""
        depth = 0
        while self.now.kind != "end":
            if self.at("<"):
                depth += 1
            elif self.at(">"):
                depth -= 1
            elif self.at("(", "[", "{"):
                self.skip_group()
                continue
            elif self.at(")", "]", "}"):
                return
            self.i += 1
            if depth <= 0:
                return

    def skip_value(self, stops: tuple[str, ...], types: bool) -> int:
        """Over an expression or type up to a stop or the end of its line; the token number of its end."""
        angles, start = 0, self.i
        while self.now.kind != "end":
            t = self.now
            if t.kind == "p" and t.text in _CLOSE:
                break
            if angles <= 0 and t.kind == "p" and t.text in stops:
                break
            if self.i > start and angles <= 0 and t.fresh and self._ends(self.t[self.i - 1], t, types):
                break
            if t.kind == "p" and t.text in _OPEN:
                self.skip_group()
                continue
            if types and t.kind == "p":
                angles += (t.text == "<") - (t.text == ">")
            self.i += 1
        return self.i

    @staticmethod
    def _ends(last: Token, new: Token, types: bool) -> bool:
        if last.kind == "p" and last.text not in (")", "]", "}", "++", "--", ">") or last.kind == "id" and last.text in _OPERATORS:
            return False
        if new.kind == "p":
            return new.text in ("@", "#") or types and new.text in ("[", "(", "<", "{", "*", "+", "-")
        return not (new.kind == "id" and new.text in ("instanceof", "in", "as", "satisfies", "extends", "is"))

    def statements(self) -> list[Statement]:
        out = []
        while self.now.kind != "end" and not self.at("}"):
            before = self.i
            s = self.statement()
            if s:
                out.append(s)
            if self.i == before:
                self.i += 1
        return out

    def decorators(self) -> None:
        while self.at("@"):
            self.i += 1
            while self.now.kind == "id":
                self.i += 1
                if self.at("<"):
                    self.skip_angles()
                if self.at("("):
                    self.skip_group()
                if not self.at("."):
                    break
                self.i += 1

    def statement(self) -> Statement | None:
        start = self.i
        if self.at(";"):
            self.i += 1
            return None
        self.decorators()
        modifiers: set[str] = set()
        while self.now.kind == "id" and self.now.text in _MODIFIERS and (self.t[self.i + 1].kind in ("id", "str") or self.now.text in ("export", "default")):
            if self.now.text != "export" and self.now.text != "default" and self.t[self.i + 1].fresh:
                break
            modifiers.add(self.now.text)
            self.i += 1
            self.decorators()
        t, nxt = self.now, self.t[min(self.i + 1, len(self.t) - 1)]
        word = t.text if t.kind == "id" else ""
        if word == "interface" and nxt.kind == "id":
            return self.interface(start, modifiers)
        if word == "type" and nxt.kind == "id" and (self.at("=", "<", ahead=2)) and "default" not in modifiers:
            return self.alias(start, modifiers)
        if word == "function":
            return self.function(start, modifiers)
        if word == "class":
            return self.klass(start, modifiers)
        if word == "enum" or word == "const" and nxt.text == "enum":
            self.i += 1 + (word == "const")
            s = Statement("enum", start, modifiers, self.i)
            self.i += 1
            self.skip_group()
            return s
        if word in ("namespace", "module", "global") and (nxt.kind in ("id", "str") and not nxt.fresh or word == "global" and nxt.text == "{"):
            return self.module(start, modifiers, word)
        if word in ("const", "let", "var") or word == "using" and nxt.kind == "id":
            return self.variables(start, modifiers)
        if word == "import" and nxt.text not in ("(", "."):
            return self.imports(start, modifiers)
        if "export" in modifiers:
            return self.exports(start, modifiers)
        if self.at("{"):
            self.skip_group()
            return None
        if word in ("if", "for", "while", "switch", "with", "catch") and nxt.text in ("(", "await"):
            self.i += 1 + (nxt.text == "await")
            self.skip_group()
            return None
        if word in ("try", "do", "else", "finally", "catch") and nxt.text in ("{", "if"):
            self.i += 1
            return None
        self.skip_value((";",), False)
        if self.at(";"):
            self.i += 1
        return None

    def heritage(self) -> None:
        """Up to the brace that opens a body."""
        while self.now.kind != "end" and not self.at("{"):
            if self.at("<"):
                self.skip_angles()
            elif self.at("(", "["):
                self.skip_group()
            elif self.at("}", ";"):
                return
            else:
                self.i += 1

    def interface(self, start: int, modifiers: set[str]) -> Statement:
        s = Statement("interface", start, modifiers, self.i + 1)
        self.i += 2
        self.heritage()
        s.members = self.signatures()
        return s

    def signatures(self) -> list[tuple[int, int]]:
        """(first token, name token) of the property signatures between braces."""
        out = []
        if not self.at("{"):
            return out
        self.i += 1
        while self.now.kind != "end" and not self.at("}"):
            first = self.i
            if self.at(";", ","):
                self.i += 1
                continue
            accessor = False
            while self.now.kind == "id" and self.now.text in ("readonly", "get", "set", "static", "public") and not self.at(":", "?", "(", "<", ";", ",", "}", ahead=1):
                accessor |= self.now.text in ("get", "set")
                self.i += 1
            name = None
            if self.at("["):
                self.skip_group()
            elif self.at("(", "<"):
                pass
            elif self.at("-", "+"):
                self.i += 1
                continue
            else:
                name = self.i
                self.i += 1
            if self.at("?"):
                self.i += 1
            call = self.at("(", "<")
            if name is not None and self.t[name].kind == "id" and self.t[name].text == "new" and call:
                name = None
            if not call and not accessor and name is not None:
                out.append((first, name))
            before = self.i
            self.skip_value((";", ","), True)
            if self.i == before and not self.at(";", ",", "}") and name is None and not call:
                self.i += 1
        self.i += 1
        return out

    def alias(self, start: int, modifiers: set[str]) -> Statement:
        s = Statement("type", start, modifiers, self.i + 1)
        self.i += 2
        if self.at("<"):
            self.skip_angles()
        if self.at("="):
            self.i += 1
            if self.at("{"):
                mark = self.i
                self.skip_group()
                end = self.i
                whole = self.at(";", "}") or self.now.kind == "end" or self.now.fresh and not self.at("|", "&", "[", "extends")
                if whole and not self._mapped(mark):
                    self.i = mark
                    s.members = self.signatures()
                self.i = max(self.i, end)
                if not whole:
                    self.skip_value((";",), True)
            else:
                self.skip_value((";",), True)
        if self.at(";"):
            self.i += 1
        return s

    def _mapped(self, brace: int) -> bool:
        """Whether a type in braces is a mapped type."""
        k = brace + 1
        while self.t[k].text in ("readonly", "+", "-"):
            k += 1
        return self.t[k].text == "[" and self.t[k + 1].kind == "id" and self.t[k + 2].text == "in"

    def function(self, start: int, modifiers: set[str]) -> Statement:
        self.i += 1
        if self.at("*"):
            self.i += 1
        s = Statement("function", start, modifiers, self.i if self.now.kind == "id" else None)
        if s.name is not None:
            self.i += 1
        self.signature_and_body()
        return s

    def signature_and_body(self) -> None:
        """Over type parameters, parameters, return type and body, if any."""
        if self.at("<"):
            self.skip_angles()
        if self.at("("):
            self.skip_group()
        if self.at(":"):
            self.i += 1
            self.return_type()
        if self.at("{"):
            self.skip_group()
        elif self.at(";"):
            self.i += 1

    def return_type(self) -> None:
        """A type that a body may follow."""
        angles, first = 0, True
        while self.now.kind != "end":
            t, last = self.now, self.t[self.i - 1]
            if t.kind == "p" and t.text in _CLOSE or self.at(";", ",", "=") and angles <= 0:
                return
            if self.at("{") and not first and angles <= 0 and not (last.kind == "p" and last.text in ("|", "&", "=>", "?", ":", "<", ",") or last.kind == "id" and last.text in ("is", "extends", "keyof", "readonly")):
                return
            if not first and t.fresh and angles <= 0 and self._ends(last, t, True):
                return
            first = False
            if t.kind == "p" and t.text in _OPEN:
                self.skip_group()
                continue
            angles += self.at("<") - self.at(">")
            self.i += 1

    def klass(self, start: int, modifiers: set[str]) -> Statement:
        self.i += 1
        named = self.now.kind == "id" and not self.at("extends", "implements")
        s = Statement("class", start, modifiers, self.i if named else None)
        self.i += named
        self.heritage()
        if self.at("{"):
            self.i += 1
            while self.now.kind != "end" and not self.at("}"):
                before = self.i
                if m := self.member():
                    s.members.append(m)
                if self.i == before:
                    self.i += 1
            self.i += 1
        return s

    def member(self) -> dict | None:
        """A callable public member of a class: its first token, name token and whether it is static."""
        if self.at(";"):
            self.i += 1
            return None
        first = self.i
        self.decorators()
        modifiers: set[str] = set()
        while self.now.kind == "id" and self.now.text in _MODIFIERS | {"get", "set"} and not self.at("(", "<", "=", ":", ";", "?", "!", "}", ahead=1):
            if self.at("static") and self.at("{", ahead=1):
                self.i += 1
                self.skip_group()
                return None
            if self.t[self.i + 1].fresh and self.now.text in ("get", "set", "async", "accessor"):
                break
            modifiers.add(self.now.text)
            self.i += 1
        if self.at("*"):
            self.i += 1
        name = None
        if self.at("["):
            self.skip_group()
        elif self.now.kind in ("id", "str", "num"):
            name = self.i
            self.i += 1
        else:
            self.i += 1
            return None
        if self.at("?", "!"):
            self.i += 1
        callable_ = False
        if self.at("(", "<"):
            own = self.t[name].text if name is not None else ""
            callable_ = own != "constructor" and not modifiers & {"get", "set"}
            self.signature_and_body()
        else:
            if self.at(":"):
                self.i += 1
                a = self.i
                callable_ |= self.is_function_type(a, self.skip_value((";", "="), True))
            if self.at("="):
                self.i += 1
                a = self.i
                callable_ |= self.is_function_value(a, self.skip_value((";",), False))
            if self.at(";"):
                self.i += 1
            callable_ &= "accessor" not in modifiers
        if name is None or not callable_ or modifiers & {"private", "protected"}:
            return None
        return {"first": first, "name": name, "static": "static" in modifiers}

    def _match(self, k: int, end: int) -> int:
        """Number of the token that closes the bracket at k, or end."""
        return min(self.close.get(k, k), end)

    def _past_angles(self, k: int, end: int) -> int:
        depth = 0
        while k < end:
            if self.t[k].kind == "p":
                if self.t[k].text in _OPEN:
                    k = self._match(k, end) + 1
                    continue
                depth += (self.t[k].text == "<") - (self.t[k].text == ">")
            k += 1
            if depth <= 0:
                break
        return k

    def is_function_type(self, a: int, z: int) -> bool:
        while a < z and self.t[a].text == "(" and self._match(a, z) == z - 1:
            a, z = a + 1, z - 1
        if a < z and self.t[a].text == "<":
            a = self._past_angles(a, z)
        if a < z and self.t[a].text == "(":
            close = self._match(a, z)
            return close + 1 < z and self.t[close + 1].text == "=>"
        return False

    def is_function_value(self, a: int, z: int) -> bool:
        """Whether tokens a to z are an arrow or function expression, perhaps within parentheses and assertions."""
        if a >= z:
            return False
        t = self.t
        if t[a].text == "async" and t[a].kind == "id" and a + 1 < z and not t[a + 1].fresh and (t[a + 1].text in ("function", "(", "<") or t[a + 1].kind == "id"):
            a += 1
        if t[a].kind == "id" and t[a].text == "function":
            return self._only_assertions(self._function_end(a, z), z)
        if t[a].kind == "id":
            return a + 1 < z and t[a + 1].text == "=>"
        if t[a].text == "<":
            b = self._past_angles(a, z)
            if b < z and t[b].text == "(":
                close = self._match(b, z)
                if close + 1 < z and t[close + 1].text in ("=>", ":"):
                    return True
            return self.is_function_value(b, z)
        if t[a].text == "(":
            close = self._match(a, z)
            if close + 1 < z and t[close + 1].text in ("=>", ":"):
                return True
            return self.is_function_value(a + 1, close) and self._only_assertions(close + 1, z)
        return False

    def _function_end(self, a: int, z: int) -> int:
        held, self.i = self.i, a + 1
        if self.at("*"):
            self.i += 1
        if self.now.kind == "id":
            self.i += 1
        self.signature_and_body()
        end, self.i = self.i, held
        return min(end, z)

    def _only_assertions(self, k: int, z: int) -> bool:
        while k < z and self.t[k].text == "!":
            k += 1
        return k >= z or self.t[k].kind == "id" and self.t[k].text in ("as", "satisfies")

    def module(self, start: int, modifiers: set[str], word: str) -> Statement:
        self.i += 1
        if word == "global":
            s = Statement("module", start, modifiers, None, extra={"names": [], "global": True})
        else:
            names = [self.i]
            self.i += 1
            while self.at("."):
                names.append(self.i + 1)
                self.i += 2
            s = Statement("module", start, modifiers, names[0], extra={"names": names, "global": False})
        if self.at("{"):
            self.i += 1
            s.body = self.statements()
            self.i += 1
        elif self.at(";"):
            self.i += 1
        return s

    def variables(self, start: int, modifiers: set[str]) -> Statement:
        const = self.at("const")
        self.i += 1
        s = Statement("variable", start, modifiers)
        while self.now.kind != "end":
            first, pattern, names = self.i, self.at("{", "["), []
            if pattern:
                names = self.bindings()
            elif self.now.kind == "id":
                names = [self.i]
                self.i += 1
            else:
                break
            if self.at("!"):
                self.i += 1
            if self.at(":"):
                self.i += 1
                self.skip_value((";", ",", "="), True)
            function = False
            if self.at("="):
                self.i += 1
                a = self.i
                z = self.skip_initialiser()
                function = const and not pattern and self.is_function_value(a, z)
            s.members.append({"first": first, "names": names, "function": function})
            if not self.at(","):
                break
            self.i += 1
        if self.at(";"):
            self.i += 1
        return s

    def skip_initialiser(self) -> int:
        """Over a value that a comma ends, generic calls and arrows with return types included."""
        start = self.i
        while self.now.kind != "end":
            t = self.now
            if t.kind == "p" and (t.text in _CLOSE or t.text in (",", ";")):
                break
            if self.i > start and t.fresh and self._ends(self.t[self.i - 1], t, False):
                break
            if self.at("<") and (generic := self._generic_end()):
                self.i = generic
                continue
            if self.at("as", "satisfies") and self.i > start:
                self.i += 1
                self.skip_value((";", ",", ")"), True)
                continue
            if t.kind == "p" and t.text in _OPEN:
                self.skip_group()
                if t.text == "(" and self.at(":") and self._arrow_after():
                    self.i += 1
                    self.return_type()
                continue
            self.i += 1
        return self.i

    def _generic_end(self) -> int | None:
        """Token number after <...> if a call, template or arrow follows."""
        held = self.i
        self.skip_angles()
        end, self.i = self.i, held
        return end if self.t[end - 1].text == ">" and self.t[end].text in ("(", "`") or self.t[end].kind == "tpl" else None

    def _arrow_after(self) -> bool:
        held = self.i
        self.i += 1
        angles, first = 0, True
        found = False
        while self.now.kind != "end":
            if self.at("=>"):
                found = True
                break
            if self.at(")", "]", "}", ";", ",") and angles <= 0 or self.at("{") and not first and angles <= 0 and self.t[self.i - 1].text not in ("|", "&", "<", ","):
                break
            first = False
            if self.at("(", "[", "{"):
                self.skip_group()
                continue
            angles += self.at("<") - self.at(">")
            self.i += 1
        self.i = held
        return found

    def bindings(self) -> list[int]:
        """Name tokens bound by a pattern that starts here."""
        out, close = [], _OPEN[self.now.text]
        braces = close == "}"
        self.i += 1
        while self.now.kind != "end" and not self.at(close):
            if self.at(","):
                self.i += 1
                continue
            if self.at("..."):
                self.i += 1
            if braces and not self.at("{", "["):
                if self.at("["):
                    self.skip_group()
                key = self.i
                self.i += 1
                if self.at(":"):
                    self.i += 1
                    key = None
                if key is not None:
                    out.append(key)
                elif self.at("{", "["):
                    out += self.bindings()
                else:
                    out.append(self.i)
                    self.i += 1
            elif self.at("{", "["):
                if braces:  # a computed key
                    self.skip_group()
                    if self.at(":"):
                        self.i += 1
                        if self.at("{", "["):
                            out += self.bindings()
                        else:
                            out.append(self.i)
                            self.i += 1
                else:
                    out += self.bindings()
            else:
                out.append(self.i)
                self.i += 1
            if self.at("="):
                self.i += 1
                self.skip_value((",",), False)
        self.i += 1
        return out

    def named_list(self) -> list[tuple[int, int, bool]]:
        """(outer name, inner name, whether type only) of a braced list; inner is before 'as'."""
        out = []
        self.i += 1
        while self.now.kind != "end" and not self.at("}"):
            if self.at(","):
                self.i += 1
                continue
            only = self.at("type") and not self.at(",", "}", ahead=1) and not (self.at("as", ahead=1) and not self.at("as", ahead=2) and not self.at(",", "}", ahead=2))
            self.i += only
            inner = outer = self.i
            self.i += 1
            if self.at("as"):
                outer = self.i + 1
                self.i += 2
            out.append((outer, inner, only))
        self.i += 1
        return out

    def specifier(self) -> str | None:
        if self.at("from"):
            self.i += 1
        text = None
        if self.now.kind == "str":
            text = self.now.text[1:-1]
            self.i += 1
            if self.at("with", "assert") and self.at("{", ahead=1):
                self.i += 1
                self.skip_group()
        if self.at(";"):
            self.i += 1
        return text

    def imports(self, start: int, modifiers: set[str]) -> Statement:
        s = Statement("import", start, modifiers, extra={"bindings": [], "from": None})
        self.i += 1
        if self.now.kind == "str":
            self.specifier()
            return s
        if self.at("type", "defer") and not self.at("from", ",", "=", ahead=1):
            self.i += 1
        bindings = s.extra["bindings"]
        if self.now.kind == "id" and not self.at("from"):
            if self.at("=", ahead=1):
                self.skip_value((";",), False)
                return s
            bindings.append((self.now.text, "default", False))
            self.i += 1
            if self.at(","):
                self.i += 1
        elif self.at("from") and self.at("from", ahead=1):
            bindings.append(("from", "default", False))
            self.i += 1
        if self.at("*"):
            bindings.append((self.t[self.i + 2].text, None, True))
            self.i += 3
        elif self.at("{"):
            bindings += [(self.name_text(o), self.name_text(i), False) for o, i, _ in self.named_list()]
        s.extra["from"] = self.specifier()
        return s

    def exports(self, start: int, modifiers: set[str]) -> Statement:
        if self.at("type") and self.at("{", "*", ahead=1):
            self.i += 1
            only = True
        else:
            only = False
        if self.at("{"):
            names = self.named_list()
            here = self.at("from")
            source = self.specifier() if here else None
            if not here and self.at(";"):
                self.i += 1
            return Statement("export", start, modifiers, extra={"names": names, "type_only": only, "from": source})
        if self.at("*"):
            self.i += 1
            name = None
            if self.at("as"):
                name = self.i + 1
                self.i += 2
            return Statement("export", start, modifiers, name, extra={"star": True, "from": self.specifier()})
        if self.at("as") and self.at("namespace", ahead=1):
            self.i += 3
            return None
        if "default" in modifiers or self.at("="):
            self.i += self.at("=")
            a = self.i
            z = self.skip_value((";",), False)
            if self.at(";"):
                self.i += 1
            local = a if z == a + 1 and self.t[a].kind == "id" else None
            return Statement("assignment", start, modifiers, local)
        self.skip_value((";",), False)
        return None


class _Collector:
    """Units, hosts, imports and exports out of statements."""

    def __init__(self, path: str, text: str, words: tuple[str, str] = TAGS) -> None:
        self.path, self.text, self.words = path, text, words
        self.lines = [m.start() for m in re.finditer("\n", text)]
        own = tokenize(text)
        self.reader = _Reader(own)
        self.tokens, self.count = self.reader.t, len(own)
        self.statements = self.reader.statements()
        self.units: list[dict] = []
        self.by_id: dict[str, dict] = {}
        self.nodes: dict[str, list[tuple[int, bool]]] = {}
        self.hosts: dict[int, set[str]] = {}
        self.name = self.reader.name_text
        self.collect(self.statements, [], None, path.endswith(tuple(f".d.{x}ts" for x in ("", "m", "c"))), False, False)

    def line(self, k: int) -> int:
        return self.line_of(self.tokens[k].start)

    def line_of(self, at: int) -> int:
        return bisect_left(self.lines, at) + 1

    def unit(self, at: int, symbol: str, identity: list[str], parent: str | None, host: int, variable: bool = False) -> str:
        name = identity_id(self.path, symbol, identity)
        self.nodes.setdefault(name, []).append((host, variable))
        if name not in self.by_id:
            target = ".".join(identity)
            self.by_id[name] = {"id": name, "parent_id": parent, "target": target, "identity": identity, "aliases": [], "artifact": "typescript", "symbol": symbol, "path": self.path, "line": self.line(at), "readable": f"TypeScript {symbol} '{target}'"}
            self.units.append(self.by_id[name])
        return name

    def host(self, token: int, symbol: str) -> None:
        self.hosts.setdefault(token, set()).add(symbol)

    def aliases(self, statements: list[Statement]) -> dict[str, list[tuple[str, bool]]]:
        out: dict[str, list[tuple[str, bool]]] = {}
        for s in statements:
            if s.kind == "export" and "names" in s.extra and s.extra["from"] is None:
                for outer, inner, only in s.extra["names"]:
                    local, public = self.name(inner), self.name(outer)
                    if local and public and public != "default":
                        out.setdefault(local, []).append((public, only or s.extra["type_only"]))
        return out

    def public(self, s: Statement, local: str, aliases: dict, types: bool, implied: bool) -> list[tuple[str, bool]]:
        """Sorted (public name, whether as a type only) of a declaration."""
        if not local:
            return []
        found: dict[str, bool] = {}
        if implied or "export" in s.modifiers:
            found[local] = False
        for name, only in aliases.get(local, []):
            if only and not types:
                continue
            found[name] = found.get(name, True) and only
        return sorted(found.items())

    def collect(self, statements: list[Statement], prefix: list[str], parent: str | None, ambient: bool, implied: bool, types_only: bool) -> None:
        aliases = self.aliases(statements)
        for s in statements:
            if types_only and s.kind in ("function", "variable", "class"):
                continue
            if s.kind in ("interface", "type"):
                for name, _ in self.public(s, self.name(s.name), aliases, True, implied):
                    self.host(s.start, "type")
                    identity = [*prefix, name]
                    owner = self.unit(s.name, "type", identity, parent, s.start)
                    for first, at in s.members:
                        if own := self.name(at):
                            self.unit(at, "property", [*identity, own], owner, first)
                            self.host(first, "property")
            elif s.kind == "function":
                for name, _ in self.public(s, self.name(s.name), aliases, False, implied):
                    self.host(s.start, "function")
                    self.unit(s.name, "function", [*prefix, name], parent, s.start)
            elif s.kind == "variable":
                for d in s.members:
                    symbol = "function" if d["function"] else "property"
                    for at in d["names"]:
                        for name, _ in self.public(s, self.name(at), aliases, False, implied):
                            self.host(d["first"], symbol)
                            self.host(s.start, symbol)
                            self.unit(at, symbol, [*prefix, name], parent, s.start, True)
            elif s.kind == "class":
                for name, _ in self.public(s, self.name(s.name), aliases, False, implied):
                    for m in s.members:
                        if own := self.name(m["name"]):
                            identity = [*prefix, name, own] if m["static"] else [*prefix, name, "prototype", own]
                            self.unit(m["name"], "function", identity, parent, m["first"])
                            self.host(m["first"], "function")
            elif s.kind == "module" and s.name is not None:
                inside = ambient or "declare" in s.modifiers
                for name, only in self.public(s, self.name(s.name), aliases, True, implied):
                    self.host(s.start, "type")
                    identity = [*prefix, name]
                    owner = self.unit(s.name, "type", identity, parent, s.start)
                    good = True
                    for k in s.extra["names"][1:]:
                        own = self.name(k)
                        good &= bool(own)
                        if not good:
                            break
                        identity = [*identity, own]
                        self.host(k, "type")
                        owner = self.unit(k, "type", identity, owner, k)
                    if good:
                        self.collect(s.body, identity, owner, inside, inside, types_only or only)

    def declared(self, s: Statement) -> list[tuple[str, int]]:
        """(name, token) that a statement declares at the top of a file."""
        if s.kind == "variable":
            return [(n, k) for d in s.members for k in d["names"] if (n := self.name(k))]
        if s.kind in ("interface", "type", "function", "class", "enum", "module") and s.name is not None and self.tokens[s.name].kind == "id":
            return [(n, s.name)] if (n := self.name(s.name)) else []
        return []

    def imports(self) -> list[dict]:
        out: dict[str, dict] = {}
        for s in self.statements:
            if s.kind == "import" and s.extra["from"]:
                for local, imported, whole in s.extra["bindings"]:
                    if local and (imported or whole):
                        out[local] = {"local": local, "specifier": s.extra["from"], "imported": imported, "is_namespace": whole}
        return list(out.values())

    def exports(self) -> list[dict]:
        rows: list[tuple] = []
        aliases = self.aliases(self.statements)
        for s in self.statements:
            if s.kind == "export":
                source = s.extra["from"]
                if source is None:
                    continue
                if s.extra.get("star"):
                    name = self.name(s.name) if s.name is not None else None
                    if name != "":
                        rows.append((name, None, source, None, name is not None))
                else:
                    rows += [(self.name(o), None, source, self.name(i), False) for o, i, _ in s.extra["names"] if self.name(o) and self.name(i)]
            elif "export" in s.modifiers:
                for name, _ in self.declared(s):
                    rows.append((name, name, None, None, False))
                    rows += [(p, name, None, None, False) for p, _ in aliases.get(name, [])]
        rows += [(p, local, None, None, False) for local, names in aliases.items() for p, _ in names]
        unique = sorted(dict.fromkeys(rows), key=lambda r: r[0] or "")
        return [{"public": p, "local": local, "specifier": source, "imported": imported, "is_namespace": whole, "ord": k} for k, (p, local, source, imported, whole) in enumerate(unique)]

    def surface(self) -> tuple[list[dict], int | None]:
        """Public identities in order, and the line of an anonymous default export."""
        nodes: dict[str, int] = {}
        for s in self.statements:
            for name, k in self.declared(s):
                nodes.setdefault(name, k)
        public: dict[str, set[str]] = {}
        anonymous = None
        for s in self.statements:
            if s.kind == "export" and "names" in s.extra and s.extra["from"] is None:
                for outer, inner, _ in s.extra["names"]:
                    local, name = self.name(inner), self.name(outer)
                    if local in nodes and name:
                        public.setdefault(local, set()).update({name} - {"default"})
            elif s.kind == "assignment":
                local = self.name(s.name)
                if not local:
                    anonymous = self.line(s.start)
                elif local in nodes:
                    public.setdefault(local, set())
            elif "export" in s.modifiers:
                names = self.declared(s)
                for name, _ in names:
                    public.setdefault(name, set()).add(name)
                if not names and "default" in s.modifiers:
                    anonymous = self.line(s.start)
        owned = [n for n in nodes if n in public]
        return [{"local": n, "addresses": sorted(public[n]), "line": self.line(nodes[n]), "ord": k} for k, n in enumerate(owned)], anonymous

    def doc_hosts(self) -> list[dict]:
        """What must be documented, variables of one statement and kind together, in order."""
        found = []
        for u in self.units:
            nodes = [(k, v) for k, v in self.nodes[u["id"]] if u["symbol"] in self.hosts.get(k, ())]
            if nodes:
                found.append((nodes[0][0], min(k for k, _ in nodes), any(v for _, v in nodes), u))
        found.sort(key=lambda x: x[0])
        merged: list[dict] = []
        by_statement: dict[int, int] = {}
        for node, first, variable, u in found:
            if variable:
                k = by_statement.get(node)
                if k is not None and merged[k]["symbol"] == u["symbol"]:
                    merged[k]["targets"].append(u["target"])
                    continue
                by_statement[node] = len(merged)
            texts = [self.text[a:z] for a, z in self.tokens[first].docs]
            says = [bool(re.sub(r"[\s*]+", "", re.sub(r"^/\*\*?|\*/$", "", x))) for x in texts]
            merged.append({"symbol": u["symbol"], "targets": [u["target"]], "pos": self.tokens[first].start, "line": self.line(first), "has_content": any(says), "has_empty": not all(says)})
        return merged

    def declarations(self) -> list[dict]:
        out = []
        for k, t in enumerate(self.tokens[: self.count]):
            for a, z in t.docs:
                base = self.line_of(a)
                for tag in tags(self.text[a:z], self.words):
                    seq = len(out) + 1
                    line = base + tag.offset
                    out.append({"id": f"typescript:{self.path}:{line}:{seq}", "artifact": "typescript", "tag": tag.tag, "target": tag.target, "is_link": tag.is_link, "reason": tag.reason, "hosts": sorted(self.hosts.get(k, ())), "path": self.path, "line": line, "seq": seq})
        return out


#: The arrays of a scan row that a module has.
PARTS = ("units", "declarations", "imports", "exports", "identities", "doc_hosts")


def scan(path: str, text: str, words: tuple[str, str] = TAGS, parts: tuple[str, ...] = PARTS) -> dict:
    """The scan row of one file, with the arrays in parts."""
    # nested declarations are read by recursion, of Python frames only: as deep as the text nests
    held = sys.getrecursionlimit()
    sys.setrecursionlimit(max(held, 4 * len(text) + 1000))
    try:
        return _row(_Collector(path, text, words), parts)
    finally:
        sys.setrecursionlimit(held)


def _row(c: _Collector, parts: tuple[str, ...]) -> dict:
    row = {"path": c.path, "artifact": "typescript", "problems": []}
    if "identities" in parts:
        row["identities"], row["anonymous_line"] = c.surface()
    if "units" in parts:
        row["units"] = c.units
    made = {"declarations": c.declarations, "imports": c.imports, "exports": c.exports, "doc_hosts": c.doc_hosts}
    return row | {name: make() for name, make in made.items() if name in parts}
