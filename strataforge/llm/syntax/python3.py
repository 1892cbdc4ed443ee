"""Python 3: indentation-aware lexer, recursive-descent statements, precedence-climbing expressions."""

from __future__ import annotations

import re

from strataforge.llm.syntax.base import Parser, Problem, Reject, Token

# Keywords and operators of the language.
KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
OPERATORS = "**= //= >>= <<= ... != -> := += -= *= /= %= &= |= ^= @= ** // << >> <= >= == ( ) [ ] { } , : . ; @ = + - * / % & | ^ ~ < >".split()
BINARY = {"or": 1, "and": 2, "in": 4, "not": 4, "is": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "==": 4, "!=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10}
ASSIGN = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())

_LEX = re.compile(
    r"(?P<space>[ \t\f]+|\\\r?\n)|(?P<line>\r?\n|\r)|(?P<comment>#[^\n\r]*)"
    r"|(?P<str>(?i:rb|br|[rbuf]|fr|rf)?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?!\"\")(?:[^\"\\\n]|\\(?:\r\n|.))*\"|'(?!'')(?:[^'\\\n]|\\(?:\r\n|.))*'))"
    r"|(?P<num>0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
    r"|(?P<name>[^\W\d]\w*)|(?P<op>" + "|".join(map(re.escape, OPERATORS)) + ")",
    re.S,
)


def tokenize(text: str, problems: list[Problem]) -> list[Token]:
    out: list[Token] = []
    at, line, depth, fresh = 0, 1, 0, True
    indents = [0]
    end = len(text)
    brackets: list[tuple[str, int]] = []
    if text.startswith("\ufeff"):
        at = 1
    while at < end:
        if fresh and not depth:
            m = re.compile(r"[ \t\f]*").match(text, at)
            rest = text[m.end() : m.end() + 1]
            if rest not in ("\n", "\r", "#", ""):
                column = 0
                for char in m[0]:
                    column = 0 if char == "\f" else column // 8 * 8 + 8 if char == "\t" else column + 1
                if column > indents[-1]:
                    indents.append(column)
                    out.append(Token("indent", "", at, line, True))
                else:
                    while column < indents[-1]:
                        indents.pop()
                        out.append(Token("dedent", "", at, line, True))
                    if column != indents[-1]:
                        problems.append(Problem("inconsistent dedent", line, "indentation"))
                        indents.append(column)
            at, fresh = m.end(), False
            continue
        m = _LEX.match(text, at)
        if m is None:
            char = text[at]
            unterminated = char in "\"'"
            problems.append(Problem("unterminated string" if unterminated else f"invalid character {char!r}", line, "unterminated" if unterminated else "character"))
            if unterminated:
                stop = end if text.startswith(char * 3, at) else text.find("\n", at)
                out.append(Token("str", "", at, line, False))
                at = end if stop < 0 else stop
            else:
                at += 1
            continue
        kind, value = m.lastgroup, m[0]
        lines = value.count("\n")
        if kind == "line":
            if not depth:
                if out and out[-1].kind not in ("newline", "indent", "dedent"):
                    out.append(Token("newline", "", at, line, False))
                fresh = True
            line += 1
        elif kind == "op":
            if value in "([{" and len(value) == 1:
                depth += 1
                brackets.append((value, line))
            elif value in ")]}":
                if not brackets or brackets[-1][0] + value not in ("()", "[]", "{}"):
                    problems.append(Problem(f"unmatched '{value}'", line, "bracket"))
                if brackets:
                    brackets.pop()
                depth = len(brackets)
            out.append(Token("op", value, at, line, False))
        elif kind == "num":
            follow = text[m.end() : m.end() + 1]
            if (follow.isalnum() or follow == "_") and not re.match(r"(?:and|as|else|for|if|in|is|or|not)\b", text[m.end() : m.end() + 5]) or re.fullmatch(r"0\d*[1-9]\d*", value.replace("_", "")):
                problems.append(Problem("invalid number", line, "number"))
            out.append(Token("num", value, at, line, False))
        elif kind in ("str", "name"):
            out.append(Token(kind, value, at, line, False))
            line += lines
        else:
            line += lines
        at = m.end()
    for opened, where in brackets:
        problems.append(Problem(f"'{opened}' was never closed", where, "truncated"))
    if out and out[-1].kind not in ("newline", "dedent"):
        out.append(Token("newline", "", end, line, False))
    out += [Token("dedent", "", end, line, True) for _ in indents[1:]]
    out.append(Token("end", "", end, line, True))
    return out


class Module(Parser):
    keywords = KEYWORDS

    def __init__(self, tokens: list[Token], problems: list[Problem]) -> None:
        super().__init__(tokens, problems)
        self.functions = self.loops = 0

    def program(self) -> None:
        while self.now.kind != "end":
            self.guarded()

    def guarded(self) -> None:
        start = self.at
        try:
            self.statement()
        except Reject as error:
            self.record(error)
            self.at = max(start, error.at)
            depth = 0  # panic mode: to behind this logical line and the block it may have opened
            while self.now.kind != "end":
                kind = self.now.kind
                if kind == "dedent":
                    if not depth:
                        break
                    depth -= 1
                    self.at += 1
                    if not depth:
                        break
                    continue
                if kind == "indent":
                    depth += 1
                self.at += 1
                if kind == "newline" and not depth and self.now.kind != "indent":
                    break
            if self.at <= start:
                self.at = start + 1

    def statement(self) -> None:
        token = self.now
        if token.kind == "indent":
            self.reject("unexpected indent")
        if token.kind == "dedent":
            self.reject("unexpected dedent")
        if token.kind == "name":
            rule = _COMPOUND.get(token.text)
            if rule:
                return rule(self)
            if token.text == "match" and self.attempt(self.match):
                return None
        elif token.kind == "op" and token.text == "@":
            while self.take_op("@"):
                self.named()
                self.line_end()
            if not (self.is_word("def") or self.is_word("class") or self.is_word("async")):
                self.reject("expected a definition")
            return self.statement()
        self.simple_line()
        return None

    def line_end(self) -> None:
        if self.now.kind != "newline":
            self.reject("expected a new line")
        self.at += 1

    def simple_line(self) -> None:
        while True:
            self.simple()
            if not self.take_op(";"):
                break
            if self.now.kind == "newline":
                break
        self.line_end()

    def simple(self) -> None:
        token = self.now
        text = token.text
        if token.kind == "name" and text in KEYWORDS:
            if text == "pass":
                self.at += 1
                return
            if text in ("break", "continue"):
                if not self.loops:
                    self.reject(f"{text} outside a loop")
                self.at += 1
                return
            if text == "return":
                if not self.functions:
                    self.reject("return outside a function")
                self.at += 1
                if not self.ends():
                    self.star_expressions()
                return
            if text == "raise":
                self.at += 1
                if not self.ends():
                    self.test()
                    if self.take_word("from"):
                        self.test()
                return
            if text in ("global", "nonlocal"):
                self.at += 1
                self.need_name()
                while self.take_op(","):
                    self.need_name()
                return
            if text == "del":
                self.at += 1
                self.star_expressions()
                return
            if text == "assert":
                self.at += 1
                self.test()
                if self.take_op(","):
                    self.test()
                return
            if text == "import":
                self.at += 1
                while True:
                    self.dotted()
                    if self.take_word("as"):
                        self.need_name()
                    if not self.take_op(","):
                        return
            if text == "from":
                return self.from_()
        elif token.kind == "name" and text == "type" and self.peek().kind == "name" and self.peek().text not in KEYWORDS and self.peek(2).text in ("=", "["):
            self.at += 2
            self.type_parameters()
            self.need_op("=")
            self.test()
            return
        kind = self.star_expressions()
        if self.take_op(":"):
            if kind not in ("target", "call"):
                self.reject("illegal annotation")
            self.test()
            if self.take_op("="):
                self.value()
            return
        if self.now.kind == "op" and self.now.text in ASSIGN:
            if kind != "target":
                self.reject("illegal assignment target")
            self.at += 1
            self.value()
            return
        while self.is_op("="):
            if kind not in ("target", "targets"):
                self.reject("illegal assignment target")
            self.at += 1
            kind = self.value()

    def value(self) -> str:
        if self.is_word("yield"):
            self.yield_()
            return "other"
        return self.star_expressions()

    def ends(self) -> bool:
        return self.now.kind in ("newline", "end") or self.is_op(";")

    def dotted(self) -> None:
        self.need_name()
        while self.take_op("."):
            self.need_name()

    def from_(self) -> None:
        self.at += 1
        dots = False
        while self.is_op(".") or self.is_op("..."):
            self.at += 1
            dots = True
        if not (dots and self.is_word("import")):
            self.dotted()
        self.need_word("import")
        if self.take_op("*"):
            return
        bracket = self.take_op("(")
        while True:
            self.need_name()
            if self.take_word("as"):
                self.need_name()
            if not self.take_op(","):
                break
            if bracket and self.is_op(")"):
                break
        if bracket:
            self.need_op(")")

    def suite(self) -> None:
        self.need_op(":")
        if self.now.kind != "newline":
            return self.simple_line()
        self.at += 1
        if self.now.kind != "indent":
            self.reject("expected an indented block")
        self.at += 1
        while self.now.kind not in ("dedent", "end"):
            self.guarded()
        if self.now.kind == "dedent":
            self.at += 1
        return None

    def if_(self) -> None:
        self.at += 1
        self.named()
        self.suite()
        while self.take_word("elif"):
            self.named()
            self.suite()
        if self.take_word("else"):
            self.suite()

    def loop(self, rule) -> None:  # noqa: ANN001
        self.loops += 1
        try:
            rule()
        finally:
            self.loops -= 1
        if self.take_word("else"):
            self.suite()

    def while_(self) -> None:
        self.at += 1
        self.named()
        self.loop(self.suite)

    def for_(self) -> None:
        self.at += 1
        self.target_list()
        self.need_word("in")
        self.star_expressions()
        self.loop(self.suite)

    def target_list(self) -> None:
        while True:
            self.take_op("*")
            if self.binary(5) not in ("target", "targets"):
                self.reject("illegal target")
            if not self.take_op(",") or self.is_word("in"):
                return

    def try_(self) -> None:
        self.at += 1
        self.suite()
        handled = False
        while self.is_word("except"):
            self.at += 1
            handled = True
            self.take_op("*")
            if not self.is_op(":"):
                self.test()
                if self.take_word("as"):
                    self.need_name()
            self.suite()
        if handled and self.take_word("else"):
            self.suite()
        if self.take_word("finally"):
            handled = True
            self.suite()
        if not handled:
            self.reject("expected 'except' or 'finally'")

    def with_(self) -> None:
        self.at += 1
        start = self.at
        if self.is_op("(") and self.attempt(self.with_brackets) and self.is_op(":"):
            return self.suite()
        self.at = start
        while True:
            self.test()
            if self.take_word("as"):
                self.binary(5)
            if not self.take_op(","):
                break
        return self.suite()

    def with_brackets(self) -> None:
        self.need_op("(")
        while True:
            self.test()
            if self.take_word("as"):
                self.binary(5)
            if not self.take_op(",") or self.is_op(")"):
                break
        self.need_op(")")

    def in_function(self, rule) -> None:  # noqa: ANN001
        saved = self.loops
        self.loops = 0
        self.functions += 1
        try:
            rule()
        finally:
            self.functions -= 1
            self.loops = saved

    def def_(self) -> None:
        self.at += 1
        self.need_name()
        self.type_parameters()
        self.need_op("(")
        self.parameters(")", True)
        self.need_op(")")
        if self.take_op("->"):
            self.test()
        self.in_function(self.suite)

    def type_parameters(self) -> None:
        if self.take_op("["):
            while not self.take_op("]"):
                self.take_op("*") or self.take_op("**")
                self.need_name()
                if self.take_op(":"):
                    self.test()
                if self.take_op("="):
                    self.test()
                if not self.is_op("]"):
                    self.need_op(",")

    def parameters(self, stop: str, typed: bool) -> None:
        default = star = slash = False
        first = True
        while not self.is_op(stop):
            if self.take_op("**"):
                self.need_name()
                if typed and self.take_op(":"):
                    self.test()
                self.take_op(",")
                if not self.is_op(stop):
                    self.reject("parameters after **")
                return
            if self.take_op("*"):
                if star:
                    self.reject("a second *")
                star = True
                if not self.is_op(","):
                    self.need_name()
                    if typed and self.take_op(":"):
                        self.take_op("*")
                        self.test()
                elif self.peek().text == stop:
                    self.reject("expected a name after *")
            elif self.is_op("/"):
                if slash or star or first:
                    self.reject("misplaced /")
                slash = True
                self.at += 1
            else:
                self.need_name()
                if typed and self.take_op(":"):
                    self.test()
                if self.take_op("="):
                    default = True
                    self.test()
                elif default and not star:
                    self.reject("a parameter without default after one with")
            first = False
            if not self.take_op(","):
                return

    def class_(self) -> None:
        self.at += 1
        self.need_name()
        self.type_parameters()
        if self.is_op("("):
            self.call()
        saved, self.loops = (self.functions, self.loops), 0
        self.functions = 0
        try:
            self.suite()
        finally:
            self.functions, self.loops = saved

    def async_(self) -> None:
        self.at += 1
        if not (self.is_word("def") or self.is_word("for") or self.is_word("with")):
            self.reject("expected 'def'")
        return self.statement()

    def stray(self) -> None:
        self.reject("unexpected " + self.now.text)

    def match(self) -> None:
        self.at += 1
        self.star_expressions()
        self.need_op(":")
        self.line_end()
        if self.now.kind != "indent":
            self.reject("expected an indented block")
        self.at += 1
        while self.take_word("case"):
            while True:
                self.pattern()
                if not self.take_op(",") or self.is_op(":"):
                    break
            if self.take_word("if"):
                self.named()
            self.suite()
        if self.now.kind != "dedent":
            self.reject("expected 'case'")
        self.at += 1

    def pattern(self) -> None:
        self.take_op("*")
        while True:
            if self.is_op("[") or self.is_op("(") or self.is_op("{"):
                closes = {"[": "]", "(": ")", "{": "}"}[self.next().text]
                while not self.take_op(closes):
                    if not self.take_op("**"):
                        self.pattern()
                        if self.take_op(":"):
                            self.pattern()
                    else:
                        self.need_name()
                    if not self.is_op(closes):
                        self.need_op(",")
            else:
                self.take_op("-")
                token = self.next()
                if token.kind == "name" and (token.text not in KEYWORDS or token.text in ("None", "True", "False")):
                    while self.take_op("."):
                        self.need_name()
                    if self.take_op("("):
                        while not self.take_op(")"):
                            if self.now.kind == "name" and self.peek().text == "=":
                                self.at += 2
                            self.pattern()
                            if not self.is_op(")"):
                                self.need_op(",")
                elif token.kind in ("num", "str"):
                    while self.now.kind == "str":
                        self.at += 1
                    if self.now.text in ("+", "-"):
                        self.at += 2
                else:
                    self.at -= 1
                    self.reject("expected a pattern")
            if not self.take_op("|"):
                break
        if self.take_word("as"):
            self.need_name()

    # Expressions

    def yield_(self) -> None:
        self.at += 1
        if self.take_word("from"):
            self.test()
        elif not (self.ends() or self.is_op(")") or self.is_op("=") or self.is_op("]")):
            self.star_expressions()

    def star_expressions(self) -> str:
        kind, many = self.star_item(), False
        while self.take_op(","):
            many = True
            if self.now.kind in ("newline", "end") or self.now.kind == "op" and self.now.text in (")", "]", "}", "=", ";", ":") or self.is_word("in"):
                break
            if self.star_item() == "other":
                kind = "other"
        return "targets" if many and kind in ("target", "targets") else "other" if many else kind

    def star_item(self) -> str:
        if self.take_op("*"):
            return self.binary(5)
        if self.is_word("yield"):
            self.yield_()
            return "other"
        return self.named()

    def named(self) -> str:
        if self.now.kind == "name" and self.peek().text == ":=" and self.now.text not in KEYWORDS:
            self.at += 2
            self.test()
            return "other"
        return self.test()

    def test(self) -> str:
        if self.is_word("lambda"):
            self.at += 1
            self.parameters(":", False)
            self.need_op(":")
            self.in_function(self.test)
            return "other"
        kind = self.binary(0)
        if self.is_word("if"):
            self.at += 1
            self.binary(0)
            self.need_word("else")
            self.test()
            return "other"
        return kind

    def binary(self, least: int) -> str:
        if self.is_word("not") and least <= 3:
            self.at += 1
            self.binary(3)
            kind = "other"
        else:
            kind = self.unary()
        while True:
            token = self.now
            rank = BINARY.get(token.text) if token.kind in ("op", "name") else None
            if rank is None or rank < least:
                return kind
            if token.text == "not":
                if self.peek().text != "in":
                    return kind
                self.at += 1
            self.at += 1
            if token.text == "is":
                self.take_word("not")
            self.binary(rank + 1)
            kind = "other"

    def unary(self) -> str:
        if self.now.kind == "op" and self.now.text in ("+", "-", "~"):
            self.at += 1
            self.unary()
            return "other"
        waits = self.take_word("await")
        kind = self.postfix()
        if self.take_op("**"):
            self.unary()
            return "other"
        return "other" if waits else kind

    def postfix(self) -> str:
        kind = self.atom()
        while True:
            if self.take_op("."):
                self.need_name()
                kind = "target"
            elif self.is_op("("):
                self.call()
                kind = "call"
            elif self.take_op("["):
                if self.is_op("]"):
                    self.reject("expected an index")
                while not self.take_op("]"):
                    self.slice()
                    if not self.is_op("]"):
                        self.need_op(",")
                kind = "target"
            else:
                return kind

    def slice(self) -> None:
        if self.take_op("*"):
            self.binary(5)
            return
        if not self.is_op(":"):
            self.named()
        for _ in range(2):
            if self.take_op(":") and not (self.is_op(":") or self.is_op(",") or self.is_op("]")):
                self.test()

    def call(self) -> None:
        self.need_op("(")
        keyword = False
        while not self.take_op(")"):
            if self.take_op("**"):
                self.test()
                keyword = True
            elif self.take_op("*"):
                self.test()
            elif self.now.kind == "name" and self.peek().text == "=":
                self.need_name()
                self.at += 1
                self.test()
                keyword = True
            else:
                self.named()
                if self.is_word("for") or self.is_word("async"):
                    self.comprehension()
                elif keyword:
                    self.reject("positional argument after keyword argument")
            if not self.is_op(")"):
                self.need_op(",")

    def comprehension(self) -> None:
        while True:
            self.take_word("async")
            if not self.take_word("for"):
                return
            self.target_list()
            self.need_word("in")
            self.binary(0)
            while self.take_word("if"):
                if self.is_word("lambda"):
                    self.test()
                else:
                    self.named() if self.peek().text == ":=" else self.binary(0)
            if not (self.is_word("for") or self.is_word("async")):
                return

    def atom(self) -> str:
        token = self.now
        kind, text = token.kind, token.text
        if kind == "name":
            if text in ("None", "True", "False"):
                self.at += 1
                return "other"
            if text in KEYWORDS:
                self.reject("unexpected keyword")
            self.at += 1
            return "target"
        if kind == "num":
            self.at += 1
            return "other"
        if kind == "str":
            while self.now.kind == "str":
                self.at += 1
            return "other"
        if kind == "op":
            if text == "...":
                self.at += 1
                return "other"
            if text == "(":
                self.at += 1
                if self.take_op(")"):
                    return "targets"
                inner = self.star_expressions()
                if self.is_word("for") or self.is_word("async"):
                    self.comprehension()
                    inner = "other"
                self.need_op(")")
                return inner
            if text == "[":
                self.at += 1
                if self.take_op("]"):
                    return "targets"
                inner = self.star_expressions()
                if self.is_word("for") or self.is_word("async"):
                    self.comprehension()
                    inner = "other"
                self.need_op("]")
                return "targets" if inner in ("target", "targets") else "other"
            if text == "{":
                self.at += 1
                first = True
                while not self.take_op("}"):
                    if self.take_op("**"):
                        self.binary(5)
                    elif self.take_op("*"):
                        self.binary(5)
                    else:
                        self.named()
                        if self.take_op(":"):
                            self.test()
                    if first and (self.is_word("for") or self.is_word("async")):
                        self.comprehension()
                    first = False
                    if not self.is_op("}"):
                        self.need_op(",")
                return "other"
        return self.reject("expected an expression")


_COMPOUND = {
    "if": Module.if_,
    "while": Module.while_,
    "for": Module.for_,
    "try": Module.try_,
    "with": Module.with_,
    "def": Module.def_,
    "class": Module.class_,
    "async": Module.async_,
    "elif": Module.stray,
    "else": Module.stray,
    "except": Module.stray,
    "finally": Module.stray,
}


def check_python(text: str) -> list[Problem]:
    problems: list[Problem] = []
    if "\x00" in text:
        problems.append(Problem("source contains a null character", 1, "character"))
    Module(tokenize(text, problems), problems).program()
    return sorted(problems, key=lambda p: p.line)
