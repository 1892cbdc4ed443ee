"""JavaScript (script or module) and TypeScript without JSX."""

from __future__ import annotations

import re

from strataforge.llm.syntax.base import Parser, Problem, Reject, Token

# Reserved words and operators of the language.
RESERVED = frozenset(
    """break case catch class const continue debugger default delete do else enum export extends false finally for function if import in
    instanceof new null return super switch this throw true try typeof var void while with""".split()
)
OPERATORS = """>>>= ... === !== **= <<= >>= &&= ||= ??= => == != <= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= ** << { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ #""".split()
BINARY = {"??": 1, "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "in": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
# Words after which a slash begins a regular expression.
BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())
MODIFIERS = frozenset("public private protected readonly static abstract override declare async accessor".split())

_LEX = re.compile(
    r"(?P<space>[ \t\v\f\u00a0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+)|(?P<line>\r\n|[\n\r\u2028\u2029])|(?P<comment>//[^\n\r\u2028\u2029]*|/\*.*?\*/)"
    r"|(?P<num>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?)"
    r"|(?P<name>#?(?:[^\W\d]|[$]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})(?:[\w$‌‍]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})*)"
    r"|(?P<str>\"(?:[^\"\\\n\r]|\\(?:\r\n|.))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*')"
    r"|(?P<op>" + "|".join(map(re.escape, OPERATORS)) + r")|(?P<tick>`)",
    re.S,
)
_CHUNK = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")


def tokenize(text: str, problems: list[Problem]) -> list[Token]:
    out: list[Token] = []
    at, line, newline, end = 0, 1, False, len(text)
    templates: list[int] = []
    depth = 0
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else end
    match = _LEX.match

    def template(start: int, first: bool) -> int:
        nonlocal line
        m = _CHUNK.match(text, start)
        if not m:
            problems.append(Problem("unterminated template", line, "unterminated"))
            return end
        whole, stop = (first, m[1] == "`")
        out.append(Token("tmpl", "whole" if whole and stop else "head" if whole else "tail" if stop else "middle", start, line, newline))
        line += m[0].count("\n")
        if not stop:
            templates.append(depth)
        return m.end()

    while at < end:
        m = match(text, at)
        char = text[at]
        if m is None:
            if char in "\"'":
                problems.append(Problem("unterminated string", line, "unterminated"))
                stop = text.find("\n", at)
                out.append(Token("str", '""', at, line, newline))
                at, newline = end if stop < 0 else stop, False
            else:
                problems.append(Problem(f"invalid character {char!r}", line, "character"))
                at += 1
            continue
        kind = m.lastgroup
        if kind == "space":
            at = m.end()
            continue
        if kind == "line":
            line, newline, at = line + 1, True, m.end()
            continue
        if kind == "comment":
            lines = m[0].count("\n")
            line, newline, at = line + lines, newline or lines > 0, m.end()
            continue
        value = m[0]
        if kind == "tick":
            at = template(m.end(), True)
            newline = False
            continue
        if kind == "op":
            if text.startswith("/*", at):
                problems.append(Problem("unterminated comment", line, "unterminated"))
                break
            if char == "/" and _slash_is_regex(out):
                r = _REGEX.match(text, at)
                if r:
                    out.append(Token("regex", r[0], at, line, newline))
                    at, newline = r.end(), False
                    continue
            if value == "?." and text[at + 2 : at + 3].isdigit():
                value = "?"
            if value in (">>>=", ">>="):
                value = ">"  # closing angles of type arguments; joined again in expressions
            if value == "{":
                depth += 1
            elif value == "}":
                if templates and templates[-1] == depth:
                    templates.pop()
                    at = template(m.start() + 1, False)
                    newline = False
                    continue
                depth -= 1
        elif kind == "num":
            follow = text[m.end() : m.end() + 1]
            if follow and (follow.isalnum() or follow in "_$"):
                problems.append(Problem("invalid number", line, "number"))
            if value.rstrip("n").endswith("_") or "__" in value:
                problems.append(Problem("invalid number", line, "number"))
        out.append(Token(kind, value, at, line, newline))
        if kind == "str":
            line += value.count("\n")
        at, newline = at + len(value), False
    if templates:
        problems.append(Problem("unterminated template", line, "unterminated"))
    out.append(Token("end", "", end, line, True))
    return out


def _slash_is_regex(out: list[Token]) -> bool:
    if not out:
        return True
    last = out[-1]
    if last.kind == "op":
        return last.text not in (")", "]", "}") and last.text not in ("++", "--")
    if last.kind == "name":
        return last.text in BEFORE_REGEX
    return last.kind == "tmpl" and last.text in ("head", "middle")


class Script(Parser):
    keywords = RESERVED

    def __init__(self, tokens: list[Token], problems: list[Problem], typed: bool) -> None:
        super().__init__(tokens, problems)
        self.typed = typed
        self.is_async = self.is_generator = False
        self.functions = self.loops = self.switches = 0
        self.ambient = False
        self.no_in = False
        self.no_arrow_type = False

    # Tokens

    def operator(self) -> str:
        """The operator here, with adjoining '>' joined."""
        token = self.now
        if token.kind != "op" or token.text != ">":
            return token.text
        text, k = ">", 1
        while k < 4:
            t = self.peek(k)
            if t.kind == "op" and t.start == token.start + k and t.text in (">", "=", ">=", "==", "=>") and (t.text == ">" or k):
                text += t.text[0] if t.text != "=" else "="
                if t.text != ">":
                    break
                k += 1
            else:
                break
        return text if text in (">", ">>", ">>>", ">=", ">>=", ">>>=") else ">"

    def take_operator(self, text: str) -> None:
        if text[0] == ">":
            self.at += text.count(">") + ("=" in text)
        else:
            self.at += 1

    def end_statement(self) -> None:
        if self.take_op(";") or self.is_op("}") or self.now.kind == "end" or self.now.newline:
            return
        self.reject("expected ';'")

    def identifier(self) -> Token:
        token = self.now
        if token.kind != "name" or token.text in RESERVED or token.text[0] == "#" or (token.text == "yield" and self.is_generator) or (token.text == "await" and self.is_async):
            self.reject("expected a name")
        self.at += 1
        return token

    # Statements

    def program(self) -> None:
        while self.now.kind != "end":
            start = self.at
            try:
                self.statement(True)
            except Reject as error:
                self.record(error)
                self.at = max(start, error.at)
                self.recover(start + 1 if self.at == start else start)
                if self.at <= start:
                    self.at = start + 1

    def block(self) -> None:
        self.need_op("{")
        while not self.is_op("}"):
            if self.now.kind == "end":
                self.reject("expected '}'")
            start = self.at
            try:
                self.statement(False)
            except Reject as error:
                if self.now.kind == "end" or error.cause == "truncated":
                    raise
                self.record(error)
                self.at = max(start, error.at)
                self.recover(start)
                if self.at <= start:
                    self.at = start + 1
        self.next()

    def statement(self, top: bool = False, single: bool = False) -> None:
        token = self.now
        text = token.text
        if token.kind == "op":
            if text == "{":
                return self.block()
            if text == ";":
                self.at += 1
                return None
            if text == "@":
                self.decorators()
                return self.statement(top)
        elif token.kind == "name":
            rule = _STATEMENTS.get(text)
            if rule and not (text == "import" and self.peek().text in ("(", ".")):
                if text in ("import", "export") and not top:
                    self.reject("misplaced " + text)
                if single and text in ("const", "class"):
                    self.reject("a declaration needs a block")
                return rule(self)
            follow = self.peek()
            if text == "let" and (follow.kind == "name" and (follow.text not in RESERVED) and follow.text not in ("in", "of", "instanceof") or follow.text in ("[", "{")) and follow.kind in ("name", "op"):
                if single:
                    self.reject("a declaration needs a block")
                self.at += 1
                self.bindings(False)
                return self.end_statement()
            if text == "async" and follow.text == "function" and not follow.newline:
                self.at += 1
                return self.function(True)
            if follow.kind == "op" and follow.text == ":" and text not in RESERVED:
                self.at += 2
                return self.statement(False, True)
            if self.typed and self._typed_statement(text, follow, top):
                return None
        self.expression()
        self.end_statement()
        return None

    def _typed_statement(self, text: str, follow: Token, top: bool) -> bool:
        if follow.newline and text not in ("abstract",):
            return False
        if text == "interface" and follow.kind == "name":
            self.at += 1
            self.identifier()
            self.type_parameters()
            if self.take_word("extends"):
                self.heritage()
            self.object_type()
            return True
        if text == "type" and follow.kind == "name":
            self.at += 1
            self.identifier()
            self.type_parameters()
            self.need_op("=")
            self.type()
            self.end_statement()
            return True
        if text in ("namespace", "module", "global") and (follow.kind in ("name", "str") or text == "global" and follow.text == "{"):
            self.at += 1
            if text != "global":
                if not (text == "module" and self.now.kind == "str"):
                    self.identifier()
                    while self.take_op("."):
                        self.identifier()
                else:
                    self.at += 1
            if self.is_op("{"):
                self.module_block()
            else:
                self.end_statement()
            return True
        if text == "declare" and follow.kind == "name":
            self.at += 1
            before, self.ambient = self.ambient, True
            try:
                self.statement(top)
            finally:
                self.ambient = before
            return True
        if text == "abstract" and follow.text == "class":
            self.at += 1
            self.class_(True)
            return True
        return False

    def module_block(self) -> None:
        self.need_op("{")
        while not self.take_op("}"):
            if self.now.kind == "end":
                self.reject("expected '}'")
            self.statement(True)

    def variables(self) -> None:
        constant = self.next().text == "const"
        if constant and self.typed and self.is_word("enum"):
            return self.enum()
        self.bindings(constant)
        return self.end_statement()

    def bindings(self, constant: bool, loop: bool = False) -> None:
        while True:
            pattern = self.now.text in ("{", "[")
            self.binding()
            if self.typed:
                self.take_op("!")
                if self.take_op(":"):
                    self.type()
            if self.take_op("="):
                self.assignment()
            elif (constant or pattern) and not loop and not self.ambient:
                self.reject("expected an initial value")
            if not self.take_op(","):
                return

    def binding(self) -> None:
        if self.take_op("["):
            while not self.take_op("]"):
                if self.take_op(","):
                    continue
                self.take_op("...")
                self.binding()
                if self.take_op("="):
                    self.assignment()
                if not self.is_op("]"):
                    self.need_op(",")
        elif self.take_op("{"):
            while not self.take_op("}"):
                if self.take_op("..."):
                    self.binding()
                else:
                    name = self.now
                    self.property_name()
                    if self.take_op(":"):
                        self.binding()
                    elif name.kind != "name" or name.text in RESERVED:
                        self.reject("expected ':'")
                    if self.take_op("="):
                        self.assignment()
                if not self.is_op("}"):
                    self.need_op(",")
        else:
            self.identifier()

    def if_(self) -> None:
        self.at += 1
        self.group()
        self.statement(False, True)
        if self.take_word("else"):
            self.statement(False, True)

    def group(self) -> None:
        self.need_op("(")
        self.expression()
        self.need_op(")")

    def body(self) -> None:
        self.loops += 1
        try:
            self.statement(False, True)
        finally:
            self.loops -= 1

    def while_(self) -> None:
        self.at += 1
        self.group()
        self.body()

    def do(self) -> None:
        self.at += 1
        self.body()
        self.need_word("while")
        self.group()
        self.take_op(";")

    def for_(self) -> None:
        self.at += 1
        waiting = self.take_word("await")
        if waiting and not (self.is_async or not self.functions):
            self.reject("await outside an async function")
        self.need_op("(")
        self.no_in = True
        try:
            if self.is_op(";"):
                pass
            elif self.now.text in ("var", "const") or self.now.text == "let" and (self.peek().kind == "name" or self.peek().text in "[{"):
                self.at += 1
                self.bindings(False, True)
            else:
                self.expression()
        finally:
            self.no_in = False
        if self.take_word("of"):
            self.assignment()
        elif self.take_word("in"):
            self.expression()
        else:
            if waiting:
                self.reject("expected 'of'")
            self.need_op(";")
            if not self.is_op(";"):
                self.expression()
            self.need_op(";")
            if not self.is_op(")"):
                self.expression()
        self.need_op(")")
        self.body()

    def switch(self) -> None:
        self.at += 1
        self.group()
        self.need_op("{")
        self.switches += 1
        try:
            while not self.take_op("}"):
                if self.take_word("case"):
                    self.expression()
                else:
                    self.need_word("default")
                self.need_op(":")
                while not (self.is_op("}") or self.is_word("case") or self.is_word("default")):
                    if self.now.kind == "end":
                        self.reject("expected '}'")
                    self.statement()
        finally:
            self.switches -= 1

    def try_(self) -> None:
        self.at += 1
        self.block()
        handled = False
        if self.take_word("catch"):
            handled = True
            if self.take_op("("):
                self.binding()
                if self.typed and self.take_op(":"):
                    self.type()
                self.need_op(")")
            self.block()
        if self.take_word("finally"):
            handled = True
            self.block()
        if not handled:
            self.reject("expected 'catch'")

    def jump(self) -> None:
        token = self.next()
        label = self.now.kind == "name" and not self.now.newline and self.now.text not in RESERVED
        if label:
            self.at += 1
        elif not self.loops and not (token.text == "break" and self.switches):
            self.at -= 1
            self.reject(f"{token.text} outside a loop")
        self.end_statement()

    def return_(self) -> None:
        if not self.functions:
            self.reject("return outside a function")
        self.at += 1
        if not (self.is_op(";") or self.is_op("}") or self.now.kind == "end" or self.now.newline):
            self.expression()
        self.end_statement()

    def throw(self) -> None:
        self.at += 1
        if self.now.newline:
            self.reject("expected an expression")
        self.expression()
        self.end_statement()

    def debugger(self) -> None:
        self.at += 1
        self.end_statement()

    def with_(self) -> None:
        if self.typed:
            self.reject("with")
        self.at += 1
        self.group()
        self.statement(False, True)

    def function_statement(self) -> None:
        self.function(False)

    def class_statement(self) -> None:
        self.class_(True)

    def enum(self) -> None:
        if not self.typed:
            self.reject("unexpected enum")
        self.need_word("enum")
        self.identifier()
        self.need_op("{")
        while not self.take_op("}"):
            self.property_name()
            if self.take_op("="):
                self.assignment()
            if not self.is_op("}"):
                self.need_op(",")

    def import_(self) -> None:
        self.at += 1
        if self.now.kind == "str":
            self.at += 1
            self.import_attributes()
            return self.end_statement()
        if self.typed and self.is_word("type") and (self.peek().text in ("{", "*") or self.peek().kind == "name" and (self.peek().text != "from" or self.peek(2).text == "from")):
            self.at += 1
        if self.now.kind == "name":
            self.identifier()
            if self.typed and self.take_op("="):
                if self.is_word("require"):
                    self.at += 1
                    self.need_op("(")
                    self.at += 1
                    self.need_op(")")
                else:
                    self.identifier()
                    while self.take_op("."):
                        self.identifier()
                return self.end_statement()
            if self.is_word("from"):
                return self.from_()
            self.need_op(",")
        if self.take_op("*"):
            self.need_word("as")
            self.identifier()
        else:
            self.specifiers(True)
        return self.from_()

    def specifiers(self, importing: bool) -> None:
        self.need_op("{")
        while not self.take_op("}"):
            if self.typed and self.is_word("type") and self.peek().kind in ("name", "str") and self.peek().text != "as":
                self.at += 1
            first = self.now
            if first.kind not in ("name", "str"):
                self.reject("expected a name")
            self.at += 1
            if self.take_word("as"):
                if importing:
                    self.identifier()
                elif self.next().kind not in ("name", "str"):
                    self.reject("expected a name")
            elif importing and (first.kind == "str" or first.text in RESERVED):
                self.reject("expected 'as'")
            if not self.is_op("}"):
                self.need_op(",")

    def from_(self) -> None:
        self.need_word("from")
        if self.now.kind != "str":
            self.reject("expected a module name")
        self.at += 1
        self.import_attributes()
        self.end_statement()

    def import_attributes(self) -> None:
        if (self.is_word("with") or self.is_word("assert") and not self.now.newline) and self.peek().text == "{":
            self.at += 1
            self.object_literal()

    def export(self) -> None:
        self.at += 1
        if self.take_word("default"):
            if self.is_word("function") or self.is_word("async") and self.peek().text == "function" and not self.peek().newline:
                if self.take_word("async"):
                    pass
                    return self.function(True, False)
                return self.function(False, False)
            if self.is_word("class") or self.is_op("@"):
                self.decorators()
                return self.class_(False)
            if self.typed and self.is_word("abstract") and self.peek().text == "class":
                self.at += 1
                return self.class_(False)
            if self.typed and self.is_word("interface"):
                return self.statement(True)
            self.assignment()
            return self.end_statement()
        if self.typed and self.take_op("="):
            self.expression()
            return self.end_statement()
        if self.typed and self.is_word("as") and self.peek().text == "namespace":
            self.at += 2
            self.identifier()
            return self.end_statement()
        if self.typed and self.is_word("type") and self.peek().text in ("{", "*"):
            self.at += 1
        if self.take_op("*"):
            if self.take_word("as"):
                self.at += 1
            return self.from_()
        if self.is_op("{"):
            self.specifiers(False)
            if self.is_word("from"):
                return self.from_()
            return self.end_statement()
        if self.typed and self.is_word("import"):
            return self.import_()
        token = self.now
        if token.text in ("var", "let", "const", "function", "class", "@") or token.text == "async" or self.typed and token.text in ("interface", "type", "enum", "namespace", "module", "declare", "abstract"):
            return self.statement(True)
        return self.reject("expected a declaration")

    # Functions and classes

    def in_function(self, asynchronous: bool, generator: bool, rule) -> None:  # noqa: ANN001
        saved = self.is_async, self.is_generator, self.loops, self.switches, self.no_in
        self.is_async, self.is_generator, self.loops, self.switches, self.no_in = asynchronous, generator, 0, 0, False
        self.functions += 1
        try:
            rule()
        finally:
            self.functions -= 1
            self.is_async, self.is_generator, self.loops, self.switches, self.no_in = saved

    def function(self, asynchronous: bool, named: bool = True) -> None:
        self.need_word("function")
        generator = self.take_op("*")
        if named or self.now.kind == "name" and not self.is_op("("):
            token = self.now
            if token.kind != "name" or token.text in RESERVED:
                self.reject("expected a name")
            self.at += 1
        self.signature(asynchronous, generator, True)

    def signature(self, asynchronous: bool, generator: bool, bodyless: bool) -> None:
        def rule() -> None:
            self.type_parameters()
            self.parameters()
            if self.typed and self.take_op(":"):
                self.return_type()
            if self.is_op("{"):
                self.block()
            elif bodyless and self.typed:
                self.end_statement()
            else:
                self.reject("expected '{'")

        self.in_function(asynchronous, generator, rule)

    def parameters(self) -> None:
        self.need_op("(")
        while not self.take_op(")"):
            self.decorators()
            rest = self.take_op("...")
            if self.typed:
                while self.now.text in ("public", "private", "protected", "readonly", "override") and (self.peek().kind == "name" or self.peek().text in ("{", "[")):
                    self.at += 1
                if self.is_word("this"):
                    self.at += 1
                    self.need_op(":")
                    self.type()
                    if not self.is_op(")"):
                        self.need_op(",")
                    continue
            self.binding()
            if self.typed:
                self.take_op("?")
                if self.take_op(":"):
                    self.type()
            if self.take_op("="):
                self.assignment()
            if rest and not self.is_op(")"):
                self.reject("a rest parameter comes last")
            if not self.is_op(")"):
                self.need_op(",")

    def decorators(self) -> None:
        while self.take_op("@"):
            if self.is_op("("):
                self.group()
            else:
                self.identifier()
                while self.take_op("."):
                    self.next()
                if self.is_op("("):
                    self.arguments()

    def class_(self, named: bool) -> None:
        self.need_word("class")
        if self.now.kind == "name" and self.now.text not in ("extends", "implements") or named:
            self.identifier()
        self.type_parameters()
        if self.take_word("extends"):
            self.left_hand()
            if self.typed and self.is_op("<"):
                self.type_arguments()
        if self.typed and self.take_word("implements"):
            self.heritage()
        self.need_op("{")
        while not self.take_op("}"):
            if self.take_op(";"):
                continue
            if self.now.kind == "end":
                self.reject("expected '}'")
            self.member()

    def heritage(self) -> None:
        while True:
            self.identifier()
            while self.take_op("."):
                self.next()
            if self.is_op("<"):
                self.type_arguments()
            if not self.take_op(","):
                return

    def member(self) -> None:
        self.decorators()
        asynchronous = generator = False
        words = MODIFIERS if self.typed else frozenset(("static", "async", "accessor"))
        accessor = False
        while self.now.kind == "name" and (self.now.text in words or self.now.text in ("get", "set")):
            follow = self.peek()
            if follow.kind == "op" and follow.text in ("(", "=", ";", "}", ":", "?", "!", "<", ",") or follow.kind == "end":
                break
            if follow.newline and self.now.text in ("async", "get", "set", "accessor", "declare"):
                break
            if self.now.text == "static" and follow.text == "{":
                self.at += 1
                self.in_function(False, False, self.block)
                return
            asynchronous |= self.now.text == "async"
            accessor |= self.now.text in ("get", "set")
            self.at += 1
        generator = self.take_op("*")
        if self.typed and self.is_op("[") and self.index_signature():
            self.end_member()
            return
        self.property_name()
        if self.typed:
            self.take_op("?") or self.take_op("!")
        if self.is_op("(") or self.typed and self.is_op("<"):
            self.signature(asynchronous, generator, True)
            return
        if accessor or generator or asynchronous:
            self.reject("expected '('")
        if self.typed and self.take_op(":"):
            self.type()
        if self.take_op("="):
            self.in_function(False, False, self.assignment)
        self.end_member()

    def end_member(self) -> None:
        if self.take_op(";") or self.is_op("}") or self.now.newline:
            return
        self.reject("expected ';'")

    def index_signature(self) -> bool:
        if self.peek().kind == "name" and self.peek(2).text == ":":
            self.at += 3
            self.type()
            self.need_op("]")
            if self.take_op(":"):
                self.type()
            return True
        return False

    def property_name(self) -> None:
        token = self.now
        if token.kind in ("name", "str", "num"):
            self.at += 1
        elif self.take_op("["):
            before, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = before
            self.need_op("]")
        else:
            self.reject("expected a property name")

    # Expressions

    def expression(self) -> str:
        kind = self.assignment()
        while self.take_op(","):
            self.assignment()
            kind = "other"
        return kind

    def assignment(self) -> str:
        token = self.now
        if token.kind == "name":
            if token.text == "yield" and self.is_generator:
                self.at += 1
                if not self.now.newline:
                    if self.take_op("*"):
                        self.assignment()
                    elif not (self.now.kind == "end" or self.now.kind == "op" and self.now.text in (")", "]", "}", ",", ";", ":")):
                        self.assignment()
                return "other"
            follow = self.peek()
            if follow.text == "=>" and follow.kind == "op" and token.text not in RESERVED and not follow.newline:
                self.at += 2
                self.arrow_body(False)
                return "arrow"
            if token.text == "async" and not follow.newline:
                if follow.kind == "name" and follow.text not in RESERVED and self.peek(2).text == "=>":
                    self.at += 3
                    self.arrow_body(True)
                    return "arrow"
                if (follow.text == "(" or self.typed and follow.text == "<") and follow.kind == "op":
                    start = self.at
                    self.at += 1
                    if self.attempt(self.arrow_head):
                        self.arrow_body(True)
                        return "arrow"
                    self.at = start
        elif token.kind == "op" and (token.text == "(" or self.typed and token.text == "<") and self.attempt(self.arrow_head):
            self.arrow_body(False)
            return "arrow"
        start = self.at
        kind = self.conditional()
        op = self.operator()
        if self.now.kind == "op" and op in ASSIGN:
            if kind not in ("id", "member", "paren", "literal") or kind == "literal" and op != "=":
                self.reject("invalid assignment target")
            if kind == "literal" and self.tokens[start].text not in ("{", "["):
                self.reject("invalid assignment target")
            self.take_operator(op)
            self.assignment()
            return "other"
        return kind

    def arrow_head(self) -> None:
        self.type_parameters()
        self.parameters()
        if self.typed and self.is_op(":"):
            self.at += 1
            self.return_type()
        if not self.is_op("=>") or self.now.newline:
            self.reject("expected '=>'")
        self.at += 1

    def arrow_body(self, asynchronous: bool) -> None:
        no_in = self.no_in
        if self.is_op("{"):
            self.in_function(asynchronous, False, self.block)
        else:

            def rule() -> None:
                self.no_in = no_in
                self.assignment()

            self.in_function(asynchronous, False, rule)

    def conditional(self) -> str:
        kind = self.binary(0)
        if self.is_op("?"):
            self.at += 1
            before, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = before
            self.need_op(":")
            self.assignment()
            return "other"
        return kind

    def binary(self, least: int) -> str:
        kind = self.unary()
        while True:
            token = self.now
            if token.kind not in ("op", "name"):
                return kind
            op = self.operator() if token.kind == "op" else token.text
            if self.typed and token.kind == "name" and op in ("as", "satisfies") and not token.newline and least <= 7:
                self.at += 1
                if not self.take_word("const"):
                    self.type()
                kind = "member" if kind in ("id", "member") else "other"
                continue
            rank = BINARY.get(op)
            if rank is None or rank < least or op == "in" and self.no_in or token.kind == "name" and op not in ("in", "instanceof"):
                return kind
            if op == "**" and kind == "unary":
                self.reject("a unary operand of ** needs brackets")
            self.take_operator(op)
            self.binary(rank if op == "**" else rank + 1)
            kind = "other"

    def unary(self) -> str:
        token = self.now
        text = token.text
        if token.kind == "op":
            if text in ("+", "-", "!", "~"):
                self.at += 1
                self.unary()
                return "unary"
            if text in ("++", "--"):
                self.at += 1
                if self.unary() not in ("id", "member", "paren"):
                    self.reject("invalid operand")
                return "other"
            if text == "<" and self.typed:
                self.at += 1
                if not self.take_word("const"):
                    self.type()
                self.need_op(">")
                self.unary()
                return "other"
        elif token.kind == "name":
            if text in ("typeof", "void", "delete"):
                self.at += 1
                self.unary()
                return "unary"
            if text == "await" and (self.is_async or not self.functions and self.peek().kind in ("name", "num", "str", "tmpl", "op") and not self.peek().newline and self.peek().text not in (")", ";", ",", "=", ".", "]", "}", ":", "?")):
                self.at += 1
                self.unary()
                return "unary"
        kind = self.left_hand()
        if self.now.kind == "op" and self.now.text in ("++", "--") and not self.now.newline:
            if kind not in ("id", "member", "paren"):
                self.reject("invalid operand")
            self.at += 1
            return "other"
        return kind

    def left_hand(self) -> str:
        if self.is_word("new"):
            kind = self.new()
        else:
            kind = self.primary()
        return self.trailers(kind, True)

    def new(self) -> str:
        self.at += 1
        if self.take_op("."):
            self.need_word("target")
            return "other"
        if self.is_word("new"):
            self.new()
        else:
            self.trailers(self.primary(), False)
        if self.typed and self.is_op("<"):
            self.attempt(self.type_arguments)
        if self.is_op("("):
            self.arguments()
        return "other"

    def trailers(self, kind: str, calls: bool) -> str:
        while True:
            token = self.now
            if token.kind == "tmpl" and token.text in ("whole", "head"):
                self.template()
                kind = "other"
                continue
            if token.kind != "op":
                return kind
            text = token.text
            if text == ".":
                self.at += 1
                if self.now.kind != "name":
                    self.reject("expected a name")
                self.at += 1
                kind = "member"
            elif text == "?.":
                self.at += 1
                if self.is_op("("):
                    self.arguments()
                elif self.is_op("["):
                    self.index()
                elif self.now.kind == "name":
                    self.at += 1
                elif not (self.typed and self.is_op("<")):
                    self.reject("expected a name")
                kind = "other"
            elif text == "[":
                self.index()
                kind = "member"
            elif text == "(" and calls:
                self.arguments()
                kind = "call"
            elif text == "!" and self.typed and not token.newline:
                self.at += 1
            elif text == "<" and self.typed and kind != "other":
                start = self.at
                if self.attempt(self.type_arguments) and (self.now.kind == "op" and self.now.text in ("(", ")", "]", ":", ";", ",", "}", ".", "?.", "=", "==", "===", "!=", "!==", "&&", "||", "??", "|", "&") or self.now.kind in ("tmpl", "end") or self.now.newline):
                    if self.is_op("(") and not calls:
                        self.at = start
                        return kind
                    continue
                self.at = start
                return kind
            else:
                return kind

    def index(self) -> None:
        self.need_op("[")
        before, self.no_in = self.no_in, False
        self.expression()
        self.no_in = before
        self.need_op("]")

    def arguments(self) -> None:
        self.need_op("(")
        before, self.no_in = self.no_in, False
        while not self.take_op(")"):
            self.take_op("...")
            self.assignment()
            if not self.is_op(")"):
                self.need_op(",")
        self.no_in = before

    def template(self) -> None:
        if self.next().text == "whole":
            return
        while True:
            before, self.no_in = self.no_in, False
            self.expression()
            self.no_in = before
            part = self.now
            if part.kind != "tmpl" or part.text not in ("middle", "tail"):
                self.reject("expected '}'")
            self.at += 1
            if part.text == "tail":
                return

    def primary(self) -> str:
        token = self.now
        kind, text = token.kind, token.text
        if kind == "name":
            if text == "function":
                self.function(False, False)
                return "other"
            if text == "class":
                self.class_(False)
                return "other"
            if text == "async" and self.peek().text == "function" and not self.peek().newline:
                self.at += 1
                self.function(True, False)
                return "other"
            if text in ("this", "null", "true", "false"):
                self.at += 1
                return "value"
            if text == "super":
                self.at += 1
                if self.now.text not in (".", "(", "["):
                    self.reject("unexpected super")
                return "value"
            if text == "import":
                self.at += 1
                if self.take_op("."):
                    self.at += 1
                    return "value"
                if not self.is_op("("):
                    self.reject("expected '('")
                return "value"
            if text[0] == "#":
                self.at += 1
                if not self.is_word("in"):
                    self.reject("expected 'in'")
                return "other"
            self.identifier()
            return "id"
        if kind in ("num", "str", "regex"):
            self.at += 1
            return "value"
        if kind == "tmpl" and text in ("whole", "head"):
            self.template()
            return "value"
        if kind == "op":
            if text == "(":
                self.at += 1
                before, self.no_in = self.no_in, False
                inner = self.expression()
                self.no_in = before
                self.need_op(")")
                return "paren" if inner in ("id", "member", "paren") else "value"
            if text == "[":
                self.at += 1
                before, self.no_in = self.no_in, False
                while not self.take_op("]"):
                    if self.take_op(","):
                        continue
                    self.take_op("...")
                    self.assignment()
                    if not self.is_op("]"):
                        self.need_op(",")
                self.no_in = before
                return "literal"
            if text == "{":
                self.object_literal()
                return "literal"
            if text == "@":
                self.decorators()
                self.class_(False)
                return "other"
        return self.reject("expected an expression")

    def object_literal(self) -> None:
        self.need_op("{")
        before, self.no_in = self.no_in, False
        while not self.take_op("}"):
            if self.take_op("..."):
                self.assignment()
            else:
                self.object_member()
            if not self.is_op("}"):
                self.need_op(",")
        self.no_in = before

    def object_member(self) -> None:
        asynchronous = accessor = False
        while self.now.kind == "name" and self.now.text in ("async", "get", "set"):
            follow = self.peek()
            if follow.kind == "op" and follow.text not in ("[", "*"):
                break
            asynchronous |= self.now.text == "async"
            accessor |= self.now.text != "async"
            self.at += 1
        generator = self.take_op("*")
        name = self.now
        self.property_name()
        if self.is_op("(") or self.typed and self.is_op("<"):
            self.signature(asynchronous, generator, False)
        elif asynchronous or accessor or generator:
            self.reject("expected '('")
        elif self.take_op(":"):
            self.assignment()
        elif name.kind != "name" or name.text in RESERVED or name.text[0] == "#":
            self.reject("expected ':'")
        elif self.take_op("="):
            self.assignment()

    # Types

    def type_parameters(self) -> None:
        if not self.typed or not self.take_op("<"):
            return
        while not self.take_op(">"):
            while self.now.text in ("const", "in", "out") and self.peek().kind == "name" and self.peek().text not in ("extends",):
                self.at += 1
            self.identifier()
            if self.take_word("extends"):
                self.type()
            if self.take_op("="):
                self.type()
            if not self.is_op(">"):
                self.need_op(",")

    def type_arguments(self) -> None:
        self.need_op("<")
        while True:
            self.type()
            if self.take_op(">"):
                return
            self.need_op(",")

    def return_type(self) -> None:
        if self.is_word("asserts") and self.peek().kind == "name" and not self.peek().newline:
            self.at += 2
            if self.take_word("is"):
                self.type()
            return
        if self.now.kind == "name" and self.peek().text == "is" and not self.peek().newline:
            self.at += 2
        self.type()

    def type(self) -> None:
        self.union_type()
        if self.is_word("extends") and not self.now.newline and not getattr(self, "no_conditional", False):
            self.at += 1
            self.union_type()
            if self.take_op("?"):
                self.type()
                self.need_op(":")
                self.type()

    def union_type(self) -> None:
        if self.now.text in ("|", "&") and self.now.kind == "op":
            self.at += 1
        self.unary_type()
        while self.now.kind == "op" and self.now.text in ("|", "&"):
            self.at += 1
            self.unary_type()

    def unary_type(self) -> None:
        while self.now.kind == "name" and self.now.text in ("keyof", "unique", "readonly", "infer") and (self.peek().kind in ("name", "str") or self.peek().text in ("(", "[", "{")) and not (self.peek().text in ("extends", "is") and self.now.text != "infer"):
            infer = self.now.text == "infer"
            self.at += 1
            if infer:
                self.identifier()
                start = self.at
                if self.take_word("extends"):
                    self.union_type()
                    if self.is_op("?"):
                        self.at = start
                return
        self.primary_type()
        while True:
            if self.is_op("[") and not self.now.newline:
                self.at += 1
                if not self.take_op("]"):
                    self.type()
                    self.need_op("]")
            elif self.is_op("!") or self.is_op("?") and self.peek().text in (",", "]", ")") and False:
                self.at += 1
            else:
                return

    def primary_type(self) -> None:
        token = self.now
        kind, text = token.kind, token.text
        if kind == "name":
            if text == "new" or text == "abstract" and self.peek().text == "new":
                self.at += 1 + (text == "abstract")
                return self.function_type()
            if text == "typeof":
                self.at += 1
                if self.is_word("import"):
                    return self.primary_type()
                self.next()
                while self.take_op("."):
                    self.next()
                if self.is_op("<") and not self.now.newline:
                    self.type_arguments()
                return None
            if text == "import":
                self.at += 1
                self.need_op("(")
                self.next()
                self.need_op(")")
                while self.take_op("."):
                    self.next()
                if self.is_op("<"):
                    self.type_arguments()
                return None
            if text in RESERVED and text not in ("void", "null", "true", "false", "this"):
                self.reject("expected a type")
            self.at += 1
            while self.is_op(".") and self.peek().kind == "name":
                self.at += 2
            if self.is_op("<") and not self.now.newline:
                self.type_arguments()
            return None
        if kind in ("str", "num"):
            self.at += 1
            return None
        if kind == "tmpl" and text in ("whole", "head"):
            self.at += 1
            if text == "head":
                while True:
                    self.type()
                    part = self.next()
                    if part.kind != "tmpl":
                        self.reject("expected '}'")
                    if part.text == "tail":
                        break
            return None
        if kind == "op":
            if text == "-" and self.peek().kind == "num":
                self.at += 2
                return None
            if text == "{":
                return self.object_type()
            if text == "[":
                self.at += 1
                while not self.take_op("]"):
                    self.take_op("...")
                    if self.now.kind == "name" and (self.peek().text == ":" or self.peek().text == "?" and self.peek(2).text == ":"):
                        self.at += 1
                        self.take_op("?")
                        self.need_op(":")
                    self.type()
                    self.take_op("?")
                    if not self.is_op("]"):
                        self.need_op(",")
                return None
            if text == "<":
                return self.function_type()
            if text == "(":
                if self.attempt(self.function_type):
                    return None
                self.at += 1
                self.type()
                self.need_op(")")
                return None
        return self.reject("expected a type")

    def function_type(self) -> None:
        self.type_parameters()
        self.parameters()
        self.need_op("=>")
        self.return_type()

    def object_type(self) -> None:
        self.need_op("{")
        while not self.take_op("}"):
            if self.take_op(";") or self.take_op(","):
                continue
            if self.now.kind == "end":
                self.reject("expected '}'")
            self.type_member()
            if not (self.is_op("}") or self.take_op(";") or self.take_op(",") or self.now.newline):
                self.reject("expected ';'")

    def type_member(self) -> None:
        if self.now.text in ("+", "-") and self.peek().text == "readonly":
            self.at += 1
        if self.is_word("new") and self.peek().text in ("(", "<"):
            self.at += 1
        if self.is_op("(") or self.is_op("<"):
            self.type_parameters()
            self.parameters()
            if self.take_op(":"):
                self.return_type()
            return
        while self.now.kind == "name" and self.now.text in ("readonly", "get", "set") and (self.peek().kind in ("name", "str", "num") or self.peek().text == "["):
            self.at += 1
        if self.is_op("[") and self.peek().kind == "name" and self.peek(2).text in (":", "in"):
            mapped = self.peek(2).text == "in"
            self.at += 3
            self.type()
            if mapped and self.take_word("as"):
                self.type()
            self.need_op("]")
            if self.now.text in ("+", "-"):
                self.at += 1
            self.take_op("?")
            if self.take_op(":"):
                self.type()
            return
        self.property_name()
        self.take_op("?")
        if self.is_op("(") or self.is_op("<"):
            self.type_parameters()
            self.parameters()
            if self.take_op(":"):
                self.return_type()
        elif self.take_op(":"):
            self.type()


_STATEMENTS = {
    "var": Script.variables,
    "const": Script.variables,
    "function": Script.function_statement,
    "class": Script.class_statement,
    "enum": Script.enum,
    "if": Script.if_,
    "for": Script.for_,
    "while": Script.while_,
    "do": Script.do,
    "switch": Script.switch,
    "try": Script.try_,
    "break": Script.jump,
    "continue": Script.jump,
    "return": Script.return_,
    "throw": Script.throw,
    "debugger": Script.debugger,
    "with": Script.with_,
    "import": Script.import_,
    "export": Script.export,
}


def _check(text: str, typed: bool) -> list[Problem]:
    problems: list[Problem] = []
    Script(tokenize(text, problems), problems, typed).program()
    return sorted(problems, key=lambda p: p.line)


def check_javascript(text: str) -> list[Problem]:
    return _check(text, False)


def check_typescript(text: str) -> list[Problem]:
    return _check(text, True)
