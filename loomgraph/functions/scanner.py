"""A scanner for top-level declarations of TypeScript and JavaScript source text.

It cuts the text to tokens, matches brackets, and walks the statements at the top: functions, classes,
interfaces, type aliases and enums give one symbol each, const/let/var statements one for every
declarator in them at any depth. Rows and columns start at 0, columns count UTF-16 units, ends are
exclusive. The scanner never fails on a text: what it can't read it skips to the next statement.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>[\s﻿]+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\A\#![^\n]*)
      |(?P<name>[\w$\#‌‍][\w$‌‍]*)
      |(?P<string>"(?:[^"\\\n]|\\[\s\S])*"?|'(?:[^'\\\n]|\\[\s\S])*'?)
      |(?P<punct>\.\.\.|=>|\?\.(?!\d)|\?\?=?|\*\*=?|&&=?|\|\|=?|[=!]==?|\+\+|--|<=|[-+*%&|^]=|[\s\S])""",
    re.VERBOSE,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_CHUNK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")

#: Words after which an expression goes on (so `/` begins a regular expression, and a line break ends nothing).
OPERATOR_WORDS = frozenset("return typeof instanceof in of new delete void throw case do else yield await extends as satisfies keyof readonly is default".split())
#: Marks that carry a statement on to the next line when they begin it.
CARRY_ON = frozenset(". , ; ) ] } ? : = + - * / % & | ^ < > ( [ => ?. ?? && || == === != !== <= += -= *= %= &= |= ^= ** **= ??= &&= ||=".split())
#: Marks that may end a statement.
MAY_END = frozenset(") ] } ++ --".split())
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")", "]", "}"}
TYPE_PREFIXES = frozenset("keyof typeof readonly unique infer asserts new abstract".split())


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    fresh: bool  # first on its line


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str
    start: int
    end: int


def tokenize(source: str) -> list[Token]:
    out: list[Token] = []
    at, fresh, n = 0, True, len(source)
    templates: list[int] = []  # bracket depth at which each open template substitution ends
    depth = 0

    def template(begin: int) -> int:
        """Reads template characters up to a substitution or the closing backquote."""
        nonlocal depth
        stop = _CHUNK.match(source, begin).end()
        out.append(Token("template", source[begin:stop], begin, stop, False))
        if source.startswith("${", stop):
            out.append(Token("punct", "${", stop, stop + 2, False))
            templates.append(depth)
            depth += 1
            return stop + 2
        return min(n, stop + 1)

    while at < n:
        if source[at] == "`":
            out.append(Token("template", "`", at, at + 1, fresh))
            at, fresh = template(at + 1), False
            continue
        if source[at] == "/" and _regex_may_start(out):
            m = _REGEX.match(source, at)
            if m:
                out.append(Token("regex", m[0], at, m.end(), fresh))
                at, fresh = m.end(), False
                continue
        m = _TOKEN.match(source, at)
        at = m.end()
        if m.lastgroup == "space":
            fresh = fresh or "\n" in m[0]
            continue
        text = m[0]
        out.append(Token(m.lastgroup, text, m.start(), at, fresh))
        fresh = False
        if text in ("(", "[", "{"):
            depth += 1
        elif m.lastgroup == "punct" and text in CLOSE:
            depth = max(0, depth - 1)
            if templates and text == "}" and depth == templates[-1]:
                templates.pop()
                at = template(at)
    return out


def _regex_may_start(before: list[Token]) -> bool:
    if not before:
        return True
    last = before[-1]
    if last.kind == "name":
        return last.text in OPERATOR_WORDS
    return last.kind == "punct" and last.text not in (")", "]")


class Scanner:
    def __init__(self, source: str) -> None:
        self.source, self.tokens = source, tokenize(source)
        self.match = self._brackets()
        self.found: list[Symbol] = []

    def _brackets(self) -> dict[int, int]:
        """Index of the partner of every bracket; brackets left open reach to the end."""
        open_, match = [], {}
        for i, t in enumerate(self.tokens):
            if t.kind != "punct":
                continue
            if t.text in OPEN:
                open_.append(i)
            elif t.text in CLOSE:
                for k in range(len(open_) - 1, -1, -1):
                    if OPEN[self.tokens[open_[k]].text] == t.text:
                        match[open_[k]], match[i] = i, open_[k]
                        del open_[k:]
                        break
        for i in open_:
            match.setdefault(i, len(self.tokens) - 1)
        return match

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name" and not self.tokens[i].text[0].isdigit()

    def close(self, i: int) -> int:
        """Index after the partner of the bracket at i."""
        return self.match.get(i, i) + 1

    def ends_before(self, i: int) -> bool:
        """Whether a statement ends between tokens i - 1 and i by a line break."""
        t, last = self.tokens[i], self.tokens[i - 1]
        if not t.fresh or t.kind == "punct" and t.text in CARRY_ON or t.kind == "name" and t.text in ("instanceof", "in", "of", "as", "satisfies"):
            return False
        if t.kind == "template":
            return False
        if last.kind == "punct":
            return last.text in MAY_END
        return not (last.kind == "name" and last.text in OPERATOR_WORDS)

    # ------------------------------------------------------------ types

    def skip_angles(self, i: int) -> int | None:
        """Index after the `>` that closes the `<` at i, if what is between can be types."""
        depth, k = 0, i
        while k < len(self.tokens):
            t = self.text(k)
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif t in OPEN:
                k = self.close(k)
                continue
            elif self.tokens[k].kind == "punct" and t not in (",", ".", "|", "&", "=>", "?", ":", "=", "...", "-", "["):
                return None
            k += 1
        return None

    def skip_type(self, i: int, conditional: bool = True) -> int:
        """Index after the type that begins at i."""
        n = len(self.tokens)
        while i < n and self.text(i) in ("|", "&"):
            i += 1
        while i < n:
            while self.is_name(i) and self.text(i) in TYPE_PREFIXES and i + 1 < n and (self.is_name(i + 1) or self.tokens[i + 1].kind in ("string", "template") or self.text(i + 1) in ("(", "{", "[", "<")):
                i += 1
            t = self.text(i)
            if t == "<":
                i = self.skip_angles(i) or i + 1
                continue
            if t == "(":
                i = self.close(i)
                if self.text(i) == "=>":
                    i += 1
                    continue
            elif t in ("{", "["):
                i = self.close(i)
            elif t == "-":
                i += 2
            elif self.tokens[i].kind == "template":
                i += 1
                while i < n and (self.tokens[i].kind == "template" or self.text(i) == "${"):
                    i = self.close(i) if self.text(i) == "${" else i + 1
            elif self.tokens[i].kind in ("name", "string"):
                i += 1
                while self.text(i) in (".", "?.") and self.is_name(i + 1):
                    i += 2
                if self.text(i) == "<" and not self.tokens[i].fresh:
                    i = self.skip_angles(i) or i
                if self.text(i) == "(" and self.text(i - 1) == "import":
                    i = self.close(i)
            else:
                return i
            while i < n and self.text(i) == "[" and not self.tokens[i].fresh:
                i = self.close(i)
            t = self.text(i)
            if t in ("|", "&") or t == "is" and not self.tokens[i].fresh:
                i += 1
            elif conditional and t == "extends":
                i = self.skip_type(i + 1, False)
                if self.text(i) != "?":
                    return i
                i = self.skip_type(i + 1)
                if self.text(i) != ":":
                    return i
                i += 1
            else:
                return i
        return i

    # ------------------------------------------------------------ statements

    def scan(self) -> list[Symbol]:
        i = 0
        while i < len(self.tokens):
            after = self.statement(i)
            i = max(after, i + 1)
        return self.found

    def statement(self, i: int) -> int:
        start = i
        exported = self.text(i) == "export"
        if exported:
            i += 1
            if self.text(i) == "default":
                i += 1
        decorated = i
        while self.text(i) == "@":
            i += 1
            while self.is_name(i) or self.text(i) == ".":
                i += 1
                if self.text(i) not in (".",):
                    break
            while self.text(i) == "." and self.is_name(i + 1):
                i += 2
            if self.text(i) == "(":
                i = self.close(i)
        if not exported and self.text(i) == "export":
            i += 1
            decorated = i = i + 1 if self.text(i) == "default" else i
        word, following = self.text(i), self.text(i + 1)
        if not self.is_name(i):
            return self.skip(start)
        if word in ("function", "async") and (word == "function" or following == "function" and not self.tokens[i + 1].fresh):
            return self.function(i, start)
        if word == "class" and self.is_name(i + 1) and following != "extends":
            return self.bodied(i + 1, "class", decorated, start)
        if word == "interface" and self.is_name(i + 1) and not self.tokens[i + 1].fresh:
            return self.bodied(i + 1, "interface", i, start)
        if word == "enum" and self.is_name(i + 1):
            return self.bodied(i + 1, "enum", i, start)
        if word == "const" and following == "enum" and self.is_name(i + 2):
            return self.bodied(i + 2, "enum", i, start)
        if word == "type" and self.is_name(i + 1) and not self.tokens[i + 1].fresh and self.text(i + 2) in ("=", "<"):
            return self.alias(i, start)
        if self.declares(i, len(self.tokens)):
            return self.variables(i, len(self.tokens))
        if exported and word in ("abstract", "declare", "namespace", "module"):
            return self.skip(i)
        return self.skip(start)

    def add(self, name: int, kind: str, first: int, last: int) -> None:
        self.found.append(Symbol(self.text(name), kind, self.tokens[first].start, self.tokens[min(last, len(self.tokens) - 1)].end))

    def function(self, i: int, start: int) -> int:
        name = i + (2 if self.text(i) == "async" else 1)
        if not self.is_name(name):  # a generator, or a function without name
            return self.skip(start)
        k = name + 1
        if self.text(k) == "<":
            k = self.skip_angles(k) or k
        if self.text(k) != "(":
            return self.skip(start)
        k = self.close(k)
        if self.text(k) == ":":
            k = self.skip_type(k + 1)
        if self.text(k) != "{":  # a signature without body
            return self.skip(start)
        self.add(name, "function", i, self.match[k])
        return self.close(k)

    def bodied(self, name: int, kind: str, first: int, start: int) -> int:
        k = name + 1
        while k < len(self.tokens) and self.text(k) != "{":
            if self.text(k) == ";":
                return self.skip(start)
            if self.text(k) == "<":
                k = self.skip_angles(k) or k + 1
            elif self.text(k) in OPEN:
                k = self.close(k)
            else:
                k += 1
        if k >= len(self.tokens):
            return self.skip(start)
        self.add(name, kind, first, self.match[k])
        return self.close(k)

    def alias(self, i: int, start: int) -> int:
        k = i + 2
        if self.text(k) == "<":
            k = self.skip_angles(k) or k
        if self.text(k) != "=":
            return self.skip(start)
        k = self.skip_type(k + 1)
        if self.text(k) == ";":
            k += 1
        self.add(i + 1, "type", i, k - 1)
        return k

    def skip(self, i: int) -> int:
        """Index after the statement at i: its semicolon, its closing brace, or a line break that ends it."""
        k = i
        while k < len(self.tokens):
            t = self.text(k)
            if k > i and self.ends_before(k):
                return k
            if t == ";":
                return k + 1
            if t in OPEN:
                k = self.close(k)
                if t == "{" and self.text(k) not in CARRY_ON | {"from", "else", "catch", "finally", "while"}:
                    return k
                continue
            k += 1
        return k

    # ------------------------------------------------------------ variables

    def declares(self, i: int, end: int) -> bool:
        """Whether a const/let/var declaration begins at i."""
        if self.text(i) not in ("const", "let", "var") or self.tokens[i].kind != "name" or i + 1 >= end:
            return False
        if i and self.text(i - 1) in (".", "?.", "as", "<"):
            return False
        if self.text(i) == "const" and self.text(i + 1) == "enum":
            return False
        return self.is_name(i + 1) and self.text(i + 1) not in ("in", "of", "instanceof") or self.text(i + 1) in ("{", "[")

    def variables(self, i: int, end: int) -> int:
        """Emits the declarators of the declaration at i, and those nested in them; index after it."""
        looping = self.text(i - 1) == "(" and (self.text(i - 2) == "for" or self.text(i - 2) == "await")
        k = i + 1
        while k < end:
            first = k
            k = self.close(k) if self.text(k) in OPEN else k + 1
            name = self.source[self.tokens[first].start : self.tokens[k - 1].end]
            head = k
            if self.text(k) == "!":
                k += 1
            if self.text(k) == ":":
                k = self.skip_type(k + 1)
            if looping and self.text(k) in ("of", "in"):
                return k  # a loop's binding is no declarator
            if self.text(k) == "=":
                k = self.expression(k + 1, end)
            self.found.append(Symbol(name, "variable", self.tokens[first].start, self.tokens[k - 1].end))
            self.nested(first, head)
            self.nested(head, k)
            if self.text(k) != ",":
                return k + 1 if self.text(k) == ";" else k
            k += 1
        return k

    def nested(self, i: int, end: int) -> None:
        while i < end:
            i = self.variables(i, end) if self.declares(i, end) else i + 1

    def expression(self, i: int, end: int) -> int:
        """Index after the initialiser that begins at i."""
        k = i
        while k < end:
            t = self.text(k)
            if self.tokens[k].kind == "punct":
                if t in (",", ";") or t in CLOSE:
                    return k
                if t == "<":
                    after = self.skip_angles(k) if k == i or self.is_name(k - 1) else None
                    if after is not None and self.text(after) in ("(", ")", "`", "=>", "{", ",", ";", "."):
                        k = after
                        continue
            if k > i and self.ends_before(k):
                return k
            k = self.close(k) if t in OPEN and self.tokens[k].kind == "punct" else k + 1
        return min(k, end)


def positions(source: str, offsets: list[int]) -> list[tuple[int, int]]:
    """(row, column in UTF-16 units) of character offsets."""
    lines = [0, *(m.end() for m in re.finditer("\n", source))]
    out = []
    for offset in offsets:
        row = bisect_right(lines, offset) - 1
        before = source[lines[row] : offset]
        out.append((row, len(before) if before.isascii() else len(before.encode("utf-16-le", "surrogatepass")) // 2))
    return out


def extract(source: str) -> list[tuple[str, str, int, int, int, int]]:
    """(name, kind, start_line, start_col, end_line, end_col) of the text's symbols, in document order."""
    found = Scanner(source).scan()
    places = positions(source, [p for s in found for p in (s.start, s.end)])
    return [(s.name, s.kind, *places[2 * i], *places[2 * i + 1]) for i, s in enumerate(found)]
