"""C11 and C++17, after a preprocessor that only removes directives and untaken branches."""

from __future__ import annotations

import re

from strataforge.llm.syntax.base import Parser, Problem, Reject, Token

# Directives, keywords and operators of the two languages.
DIRECTIVES = frozenset("define undef include include_next import if ifdef ifndef elif elifdef elifndef else endif error warning pragma line ident".split())
C_WORDS = frozenset(
    """auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short
    signed sizeof static struct switch typedef union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex _Generic _Imaginary
    _Noreturn _Static_assert _Thread_local""".split()
)
CPP_WORDS = frozenset(
    """alignas alignof and and_eq asm auto bitand bitor bool break case catch char char16_t char32_t class compl const constexpr const_cast continue
    decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable
    namespace new noexcept not not_eq nullptr operator or or_eq private protected public register reinterpret_cast return short signed sizeof
    static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual
    void volatile wchar_t while xor xor_eq""".split()
)
BUILTIN = frozenset("void char short int long float double signed unsigned bool _Bool _Complex _Imaginary wchar_t char16_t char32_t auto".split())
STORAGE = frozenset("typedef extern static register inline const volatile restrict _Atomic _Noreturn _Thread_local thread_local constexpr virtual explicit friend mutable __inline __inline__ __restrict __restrict__ __extension__ __const __volatile__".split())
OPERATORS = "<<= >>= ... ->* <=> :: .* -> ++ -- << >> <= >= == != && || += -= *= /= %= &= |= ^= ## <: :> <% %> { } ( ) [ ] ; , . < > + - * / % & | ^ ! ~ ? : = #".split()
BINARY = {"||": 1, "or": 1, "&&": 2, "and": 2, "|": 3, "bitor": 3, "^": 4, "xor": 4, "&": 5, "bitand": 5, "==": 6, "!=": 6, "not_eq": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, ".*": 11, "->*": 11}
ASSIGN = frozenset("= += -= *= /= %= <<= >>= &= |= ^= and_eq or_eq xor_eq".split())
DIGRAPHS = {"<:": "[", ":>": "]", "<%": "{", "%>": "}"}
CASTS = frozenset("static_cast dynamic_cast const_cast reinterpret_cast".split())

_LEX = re.compile(
    r"(?P<space>(?:[ \t\v\f]|\\\r?\n)+)|(?P<line>\r?\n|\r)|(?P<comment>//(?:[^\n\\]|\\.|\\\n)*|/\*.*?\*/)"
    r"|(?P<raw>(?:u8|u|U|L)?R\"(?P<mark>[^()\\\s]{0,16})\(.*?\)(?P=mark)\"\w*)"
    r"|(?P<str>(?:u8|u|U|L)?\"(?:[^\"\\\n]|\\.)*\"(?:_\w+|s\b|sv\b)?|(?:u8|u|U|L)?'(?:[^'\\\n]|\\.)+')"
    r"|(?P<num>\.?\d(?:[eEpP][+-]|'(?=\w)|[\w.])*)|(?P<name>(?:[^\W\d]|\$)[\w$]*)|(?P<op>" + "|".join(map(re.escape, OPERATORS)) + ")",
    re.S,
)
_NUMBER = re.compile(r"(?:0[xX][\da-fA-F']+(?:\.[\da-fA-F']*)?(?:[pP][+-]?\d+)?|0[bB][01']+|(?:[\d']+\.?[\d']*|\.[\d']+)(?:[eE][+-]?\d+)?)(?:[uUlLfFzZ]{0,4}|_\w+|(?:h|min|s|ms|us|ns|i|if|il)(?!\w))$")


def preprocess(text: str, problems: list[Problem]) -> tuple[str, set[str]]:
    """The text with directives and untaken branches blanked out (lines stay), and the names it defines."""
    lines = text.split("\n")
    macros: set[str] = set()
    stack: list[list] = []  # [taken now, a branch was taken, line, else seen]
    out: list[str] = []
    i, inside = 0, False
    while i < len(lines):
        line = lines[i]
        bare = line.lstrip()
        if not inside and (bare.startswith("#") or bare.startswith("%:")):
            whole = line
            count = 1
            while (whole.rstrip("\r").endswith("\\") or whole.count("/*") > whole.count("*/")) and i + count < len(lines) and count < 2000:
                whole += "\n" + lines[i + count]
                count += 1
            m = re.match(r"\s*(?:#|%:)\s*(\w*)\s*(.*)", whole, re.S)
            word, rest = m[1], m[2]
            live = all(s[0] for s in stack)
            if word in ("if", "ifdef", "ifndef"):
                taken = not re.match(r"0\s*(?:$|//|/\*)", rest) if word == "if" else True
                stack.append([taken, taken, i + 1, False])
            elif word in ("elif", "elifdef", "elifndef", "else", "endif"):
                if not stack:
                    problems.append(Problem(f"#{word} without #if", i + 1, "directive"))
                elif word == "endif":
                    stack.pop()
                else:
                    top = stack[-1]
                    if top[3]:
                        problems.append(Problem(f"#{word} after #else", i + 1, "directive"))
                    top[0] = not top[1]
                    top[1], top[3] = True, word == "else"
            elif live:
                if word == "define":
                    if name := re.match(r"\w+", rest):
                        macros.add(name[0])
                    else:
                        problems.append(Problem("#define without a name", i + 1, "directive"))
                elif word == "include" and not re.match(r"\s*(?:<[^>\n]+>|\"[^\"\n]+\"|\w+)", rest):
                    problems.append(Problem("#include without a file", i + 1, "directive"))
                elif word and word not in DIRECTIVES and not word.isdigit():
                    problems.append(Problem(f"unknown directive #{word}", i + 1, "directive"))
                elif not word and rest.strip() and not rest.startswith(("//", "/*")):
                    problems.append(Problem("unknown directive", i + 1, "directive"))
            out += [""] * count
            i += count
            continue
        live = all(s[0] for s in stack)
        out.append(line if live else "")
        if live:  # a block comment may hold lines that look like directives
            rest = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", "", line) if not inside else line
            while rest:
                if inside:
                    at = rest.find("*/")
                    inside, rest = at < 0, rest[at + 2 :] if at >= 0 else ""
                else:
                    a, b = rest.find("/*"), rest.find("//")
                    if a < 0 or 0 <= b < a:
                        break
                    inside, rest = True, rest[a + 2 :]
        i += 1
    problems.extend(Problem("unterminated #if", s[2], "directive") for s in stack)
    return "\n".join(out), macros


def tokenize(text: str, problems: list[Problem], cpp: bool) -> list[Token]:
    out: list[Token] = []
    at, line, newline = (1 if text.startswith("\ufeff") else 0), 1, False
    end, match = len(text), _LEX.match
    while at < end:
        m = match(text, at)
        if m is None:
            char = text[at]
            unterminated = char in "\"'"
            problems.append(Problem("unterminated string" if unterminated else f"invalid character {char!r}", line, "unterminated" if unterminated else "character"))
            if unterminated:
                stop = text.find("\n", at)
                out.append(Token("str", '""', at, line, newline))
                at, newline = end if stop < 0 else stop, False
            else:
                at += 1
            continue
        kind, value = m.lastgroup, m[0]
        kind = "raw" if m["raw"] is not None else kind
        lines = value.count("\n")
        if kind == "line":
            line, newline, at = line + 1, True, m.end()
            continue
        if kind in ("space", "comment"):
            line, newline, at = line + lines, newline or lines > 0, m.end()
            continue
        if kind == "op" and text.startswith("/*", at):
            problems.append(Problem("unterminated comment", line, "unterminated"))
            break
        if kind == "raw" and not cpp:
            kind, value = "name", "R"
            at = m.start() + 1
            out.append(Token(kind, value, m.start(), line, newline))
            newline = False
            continue
        if kind == "num" and not _NUMBER.match(value):
            problems.append(Problem(f"invalid number {value!r}", line, "number"))
        if kind == "op":
            value = DIGRAPHS.get(value, value)
            if value in (">>", ">>=", ">=") and cpp:
                out.append(Token("op", ">", at, line, newline))
                newline, at = False, at + 1
                continue
        elif not value.isascii() and kind == "name" and not value.isidentifier():
            problems.append(Problem(f"invalid character in {value!r}", line, "character"))
        out.append(Token("str" if kind == "raw" else kind, value, at, line, newline))
        line, newline, at = line + lines, False, m.end()
    out.append(Token("end", "", end, line, True))
    return out


class Unit(Parser):
    def __init__(self, tokens: list[Token], problems: list[Problem], cpp: bool, macros: set[str]) -> None:
        super().__init__(tokens, problems)
        self.cpp, self.macros = cpp, macros
        self.keywords = CPP_WORDS if cpp else C_WORDS
        self.types: set[str] = set()
        self.loops = self.switches = 0
        self.class_name = ""
        self.angle = 0

    # Tokens

    def operator(self) -> str:
        token = self.now
        if token.text != ">" or not self.cpp or token.kind != "op":
            return token.text
        text, k = ">", 1
        while k < 3:
            t = self.peek(k)
            if t.kind != "op" or t.start != token.start + len(text) or t.text not in (">", "=", "=="):
                break
            if t.text == "==":
                break
            text += t.text
            if t.text == "=":
                break
            k += 1
        return text if text in (">", ">>", ">=", ">>=") else ">"

    def take_operator(self, text: str) -> None:
        self.at += len(text) if self.cpp and text[0] == ">" else 1

    def is_name(self, token: Token) -> bool:
        return token.kind == "name" and token.text not in self.keywords

    # Declarations

    def unit(self) -> None:
        while self.now.kind != "end":
            start = self.at
            try:
                self.external()
            except Reject as error:
                self.record(error)
                self.at = max(start, error.at)
                self.recover(start)
                if self.at <= start:
                    self.at = start + 1

    def attributes(self) -> None:
        while True:
            if self.is_op("[") and self.peek().text == "[" and self.peek().start == self.now.start + 1:
                self.balanced("[", "]")
            elif self.now.kind == "name" and self.now.text in ("__attribute__", "__declspec", "alignas", "_Alignas", "__asm__", "asm", "__asm") and self.peek().text == "(":
                self.at += 1
                self.balanced("(", ")")
            else:
                return

    def balanced(self, opens: str, closes: str) -> None:
        """Skip a bracketed stretch whose content is not judged beyond its brackets."""
        pairs = {"(": ")", "[": "]", "{": "}"}
        self.need_op(opens)
        stack = [closes]
        while stack:
            token = self.next()
            if token.kind == "end":
                self.reject(f"expected '{stack[-1]}'")
            if token.kind == "op":
                if token.text in pairs:
                    stack.append(pairs[token.text])
                elif token.text in ")]}":
                    if token.text != stack.pop():
                        self.at -= 1
                        self.reject("unbalanced bracket")

    def external(self) -> None:
        token = self.now
        text = token.text
        if self.take_op(";"):
            return None
        if token.kind == "name":
            if text == "extern" and self.peek().kind == "str" and self.cpp:
                self.at += 2
                if self.is_op("{"):
                    return self.braced(self.external)
                return self.external()
            if text in ("_Static_assert", "static_assert"):
                return self.static_assertion()
            if text in ("asm", "__asm__", "__asm"):
                self.at += 1
                self.take_word("volatile") or self.take_word("__volatile__")
                self.balanced("(", ")")
                self.need_op(";")
                return None
            if text in self.macros and self.peek().text == "(" and self.is_name(token):
                start = self.at
                self.at += 1
                self.balanced("(", ")")
                if self.take_op(";") or self.now.newline and not self.is_op("{"):
                    return None
                self.at = start
            if self.cpp:
                if text == "namespace" or text == "inline" and self.peek().text == "namespace":
                    return self.namespace()
                if text == "using":
                    return self.using()
                if text == "template":
                    return self.template()
                if text == "export" and self.peek().text == "template":
                    self.at += 1
                    return self.template()
        return self.declaration(True)

    def braced(self, rule) -> None:  # noqa: ANN001
        self.need_op("{")
        while not self.take_op("}"):
            if self.now.kind == "end":
                self.reject("expected '}'")
            start = self.at
            try:
                rule()
            except Reject as error:
                if self.now.kind == "end" or error.cause == "truncated":
                    raise
                self.record(error)
                self.at = max(start, error.at)
                self.recover(start)
                if self.at <= start:
                    self.at = start + 1

    def static_assertion(self) -> None:
        self.at += 1
        self.need_op("(")
        self.conditional()
        if self.take_op(","):
            if self.now.kind != "str":
                self.reject("expected a message")
            while self.now.kind == "str":
                self.at += 1
        elif not self.cpp:
            self.reject("expected a message")
        self.need_op(")")
        self.need_op(";")

    def namespace(self) -> None:
        self.take_word("inline")
        self.at += 1
        self.attributes()
        if self.is_name(self.now):
            self.at += 1
            if self.take_op("="):
                self.qualified()
                self.need_op(";")
                return
            while self.take_op("::"):
                self.take_word("inline")
                self.need_name()
        self.attributes()
        self.braced(self.external)

    def using(self) -> None:
        self.at += 1
        if self.take_word("namespace"):
            self.qualified()
        elif self.is_name(self.now) and (self.peek().text == "=" or self.peek().text == "["):
            self.types.add(self.next().text)
            self.attributes()
            self.need_op("=")
            self.type_id()
        else:
            while True:
                self.take_word("typename")
                self.qualified()
                self.take_op("...")
                if not self.take_op(","):
                    break
        self.need_op(";")

    def template(self) -> None:
        self.need_word("template")
        if self.take_op("<"):
            while not self.take_op(">"):
                self.template_parameter()
                if not self.is_op(">"):
                    self.need_op(",")
        if self.is_word("template"):
            return self.template()
        if self.is_word("using"):
            return self.using()
        return self.declaration(True)

    def template_parameter(self) -> None:
        if self.is_word("template"):
            self.at += 1
            self.need_op("<")
            while not self.take_op(">"):
                self.template_parameter()
                if not self.is_op(">"):
                    self.need_op(",")
        if (self.is_word("typename") or self.is_word("class")) and (self.is_name(self.peek()) and self.peek(2).text in (",", ">", "=") or self.peek().text in (",", ">", "=", "...")):
            self.at += 1
            self.take_op("...")
            if self.is_name(self.now):
                self.types.add(self.next().text)
            if self.take_op("="):
                self.type_id()
            return
        self.specifiers()
        self.declarator(True)
        if self.take_op("="):
            self.angle += 1
            try:
                self.conditional()
            finally:
                self.angle -= 1

    def specifiers(self) -> dict[str, bool]:
        """Declaration specifiers: which of type, typedef, body were seen. Rejects when there are none."""
        seen = {"type": False, "typedef": False, "body": False, "any": False}
        while True:
            self.attributes()
            token = self.now
            text = token.text
            if token.kind != "name":
                if token.text == "::" and self.cpp and not seen["type"]:
                    self.qualified()
                    seen["type"] = seen["any"] = True
                    continue
                break
            if text in STORAGE and (text in self.keywords or text.startswith("__")):
                seen["typedef"] |= text == "typedef"
                seen["any"] = True
                self.at += 1
                if text in ("_Atomic", "explicit") and self.is_op("(") and text == "_Atomic":
                    self.balanced("(", ")")
                    seen["type"] = True
                continue
            if text in BUILTIN and (text in self.keywords):
                self.at += 1
                seen["type"] = seen["any"] = True
                continue
            if text in ("struct", "union") or self.cpp and text == "class":
                self.record_type()
                seen["body"] = seen["type"] = seen["any"] = True
                continue
            if text == "enum":
                self.enum()
                seen["body"] = seen["type"] = seen["any"] = True
                continue
            if self.cpp and text == "typename" or text in ("typeof", "__typeof__"):
                self.at += 1
                if text == "typename":
                    self.qualified()
                else:
                    self.balanced("(", ")")
                seen["type"] = seen["any"] = True
                continue
            if self.cpp and text == "decltype":
                self.at += 1
                self.balanced("(", ")")
                if self.is_op("::"):
                    self.at += 1
                    self.qualified()
                seen["type"] = seen["any"] = True
                continue
            if text in self.keywords or seen["type"]:
                break
            if text in self.macros or text.isupper() and len(text) > 1:
                follow = self.peek()
                if follow.kind == "name" and (follow.text in self.keywords or self.peek(2).kind == "name" or self.peek(2).text in ("*", "&")) and not (text not in self.macros and follow.text not in self.keywords):
                    self.at += 1
                    seen["any"] = True
                    continue
            # A name is the type if what follows can still be declared.
            start = self.at
            if self.cpp:
                self.qualified()
            else:
                self.at += 1
            follow = self.now
            if seen["any"] and follow.kind == "op" and follow.text in ("(", ";", "=", ",", "[", ":", ")") and not self.cpp and follow.text != ")":
                self.at = start
                break
            if self.cpp and follow.text == "(" and self._is_special(start):
                self.at = start
                break
            seen["type"] = seen["any"] = True
        if not seen["any"]:
            self.reject("expected a declaration")
        return seen

    def _is_special(self, start: int) -> bool:
        """Whether the name at ``start`` is a constructor's, destructor's or conversion's, not a type."""
        names = [t.text for t in self.tokens[start : self.at] if t.kind == "name"]
        if names and (names[-1] == self.class_name or "operator" in names or len(names) > 1 and names[-1] in (names[-2],)):
            return True
        return "~" in [t.text for t in self.tokens[start : self.at]] or len(names) == 2 and names[0] == names[1]

    def record_type(self) -> None:
        self.at += 1
        self.attributes()
        name = ""
        while self.is_name(self.now) and self.now.text in self.macros and self.is_name(self.peek()):
            self.at += 1
        if self.is_name(self.now) or self.is_op("::"):
            token = self.now
            if self.cpp:
                self.qualified()
            else:
                self.at += 1
            name = self.tokens[self.at - 1].text if self.tokens[self.at - 1].kind == "name" else token.text
            self.types.add(token.text)
        if self.cpp:
            self.take_word("final")
            if self.is_op(":"):
                self.at += 1
                while True:
                    self.attributes()
                    while self.now.text in ("virtual", "public", "private", "protected"):
                        self.at += 1
                    self.qualified()
                    self.take_op("...")
                    if not self.take_op(","):
                        break
                if not self.is_op("{"):
                    self.reject("expected '{'")
        if self.is_op("{"):
            before, self.class_name = self.class_name, name
            saved = self.loops, self.switches
            try:
                self.braced(self.member)
            finally:
                self.class_name = before
                self.loops, self.switches = saved
        elif not name:
            self.reject("expected a name")

    def enum(self) -> None:
        self.at += 1
        if self.cpp:
            self.take_word("class") or self.take_word("struct")
        self.attributes()
        named = self.is_name(self.now)
        if named:
            self.types.add(self.now.text)
            self.qualified() if self.cpp else self.next()
        if self.cpp and self.is_op(":"):
            self.at += 1
            self.specifiers()
        if self.take_op("{"):
            if self.is_op("}") and not self.cpp:
                self.reject("expected a name")
            while not self.take_op("}"):
                self.need_name()
                self.attributes()
                if self.take_op("="):
                    self.conditional()
                if not self.is_op("}"):
                    self.need_op(",")
        elif not named:
            self.reject("expected a name")

    def member(self) -> None:
        if self.take_op(";"):
            return
        if self.cpp:
            if self.now.text in ("public", "private", "protected") and self.peek().text == ":":
                self.at += 2
                return
            if self.is_word("using"):
                return self.using()
            if self.is_word("template"):
                return self.template()
            if self.is_word("static_assert"):
                return self.static_assertion()
            if self.is_word("friend") and self.peek().text in ("class", "struct") and self.peek(3).text == ";":
                self.at += 4
                return
            if self.is_name(self.now) and self.now.text in self.macros and self.peek().text == "(":
                start = self.at
                self.at += 1
                self.balanced("(", ")")
                if self.take_op(";") or self.now.newline:
                    return
                self.at = start
            self.declaration(True, True)
            return
        if self.is_word("_Static_assert"):
            return self.static_assertion()
        self.specifiers()
        if self.take_op(";"):
            return
        while True:
            if not self.is_op(":"):
                self.declarator(False)
            if self.take_op(":"):
                self.conditional()
            self.attributes()
            if not self.take_op(","):
                break
        self.need_op(";")

    def declaration(self, body: bool, member: bool = False) -> None:
        """A simple declaration or, with ``body``, a function definition."""
        start = self.at
        special = self.cpp and self._special_start()
        seen = {"type": False, "typedef": False, "body": False}
        if special:
            while self.now.text in STORAGE or self.is_op("["):
                self.at += 1 if self.now.text in STORAGE else 0
                self.attributes()
        else:
            seen = self.specifiers()
        if self.take_op(";"):
            if not (seen["body"] or seen["type"]):
                self.at -= 1
                self.reject("expected a declarator")
            return
        if self.cpp and seen["type"] and self.is_op("["):  # structured binding
            self.at += 1
            self.need_name()
            while self.take_op(","):
                self.need_name()
            self.need_op("]")
            self.initializer()
            self.need_op(";")
            return
        first = True
        while True:
            name_at = self.at
            if not (self.is_op(":") and member):
                function = self.declarator(False)
            else:
                function = False
            if seen["typedef"]:
                self.types.update(t.text for t in self.tokens[name_at : self.at] if self.is_name(t))
            self.attributes()
            if member and self.take_op(":"):
                self.conditional()
            if function and first and body and not seen["typedef"]:
                if self.cpp and self.is_word("try"):
                    self.at += 1
                if self.cpp and self.is_op(":"):
                    self.constructor_list()
                if self.is_op("{"):
                    if not (seen["type"] or special) and self.cpp:
                        self.at = start
                        self.reject("expected a type")
                    self.function_body()
                    while self.cpp and self.is_word("catch"):
                        self.catch()
                    return
                if not self.cpp and self.now.kind == "name" and not self.is_op(";"):  # declarations of an old-style definition
                    while not self.is_op("{"):
                        self.specifiers()
                        self.declarator(False)
                        while self.take_op(","):
                            self.declarator(False)
                        self.need_op(";")
                    self.function_body()
                    return
                if self.cpp and self.is_op("=") and self.peek().text in ("default", "delete", "0"):
                    self.at += 2
                    self.need_op(";")
                    return
            if not (seen["type"] or special):
                if self.cpp or not function and not seen["any"]:
                    self.at = name_at
                    self.reject("expected a type")
            self.initializer()
            first = False
            if not self.take_op(","):
                break
        self.need_op(";")

    def _special_start(self) -> bool:
        """A constructor, destructor or conversion function begins here: it has no type."""
        k = self.at
        tokens = self.tokens
        while tokens[k].kind == "name" and tokens[k].text in STORAGE:
            k += 1
        if tokens[k].text == "explicit":
            k += 1
        token = tokens[k]
        if token.text == "~" or token.text == "operator":
            return True
        if not self.is_name(token):
            return False
        if token.text == self.class_name and tokens[k + 1].text == "(":
            return True
        # Name::Name( and Name::~Name( and Name::operator
        while self.is_name(tokens[k]) and tokens[k + 1].text in ("::", "<"):
            if tokens[k + 1].text == "<":
                depth, j = 0, k + 1
                while j < len(tokens) - 1:
                    depth += (tokens[j].text == "<") - (tokens[j].text == ">")
                    j += 1
                    if not depth:
                        break
                if tokens[j].text != "::":
                    return False
                after = j + 1
            else:
                after = k + 2
            if tokens[after].text in ("~", "operator"):
                return True
            if tokens[after].text == tokens[k].text and tokens[after + 1].text == "(":
                return True
            k = after
        return False

    def initializer(self) -> None:
        if self.take_op("="):
            self.init_value()
        elif self.cpp and self.is_op("{"):
            self.brace_list()

    def init_value(self) -> None:
        if self.is_op("{"):
            self.brace_list()
        else:
            self.assignment()

    def brace_list(self) -> None:
        self.need_op("{")
        if self.is_op("}") and not self.cpp:
            self.at += 1  # empty braces are a common extension of C11 and C23
            return
        saved, self.angle = self.angle, 0
        while not self.take_op("}"):
            if self.is_op(".") and self.peek().kind == "name" or not self.cpp and self.is_op("["):
                while not self.is_op("="):
                    if self.take_op("."):
                        self.need_name()
                    else:
                        self.need_op("[")
                        self.conditional()
                        if self.take_op("..."):
                            self.conditional()
                        self.need_op("]")
                self.at += 1
            self.init_value()
            self.take_op("...")
            if not self.is_op("}"):
                self.need_op(",")
        self.angle = saved

    def constructor_list(self) -> None:
        self.need_op(":")
        while True:
            self.qualified()
            if self.is_op("("):
                self.call_arguments()
            elif self.is_op("{"):
                self.brace_list()
            else:
                self.reject("expected '('")
            self.take_op("...")
            if not self.take_op(","):
                return

    def function_body(self) -> None:
        saved = self.loops, self.switches, self.class_name
        self.loops = self.switches = 0
        try:
            self.block()
        finally:
            self.loops, self.switches, self.class_name = saved

    def declarator(self, abstract: bool) -> bool:
        """A declarator; whether it declares a function. With ``abstract`` the name may be missing."""
        while True:
            self.attributes()
            token = self.now
            if token.kind == "op" and (token.text == "*" or self.cpp and token.text in ("&", "&&", "...")):
                self.at += 1
                continue
            if token.kind == "name" and token.text in ("const", "volatile", "restrict", "__restrict", "__restrict__", "_Atomic", "__const") and (token.text in self.keywords or token.text.startswith("__")):
                self.at += 1
                continue
            if self.cpp and self.is_name(token) and self.peek().text == "::" and self._pointer_to_member():
                continue
            break
        function = False
        if self.is_op("("):
            if abstract and (self.peek().text == ")" or self._starts_type(self.peek())) and not (self.peek().kind == "op" and self.peek().text in ("*", "&", "^")):
                pass
            else:
                self.at += 1
                self.declarator(abstract)
                self.need_op(")")
        elif self.cpp and (self.is_op("~") or self.is_word("operator") or self.is_op("::")):
            self.qualified()
        elif self.is_name(self.now):
            if self.cpp:
                self.qualified()
            else:
                self.at += 1
        elif not abstract:
            self.reject("expected a name")
        while True:
            self.attributes()
            if self.is_op("["):
                self.at += 1
                while self.now.kind == "name" and self.now.text in ("static", "const", "volatile", "restrict"):
                    self.at += 1
                if not self.take_op("]"):
                    if self.is_op("*") and self.peek().text == "]":
                        self.at += 1
                    else:
                        self.assignment()
                    self.need_op("]")
            elif self.is_op("("):
                start = self.at
                if self.cpp and not abstract and not function and not self.attempt(self.parameter_list):
                    self.at = start
                    self.call_arguments()
                    return False
                if self.at == start:
                    self.parameter_list()
                function = True
                if self.cpp:
                    self.function_suffix()
            else:
                return function

    def _pointer_to_member(self) -> bool:
        k = self.at
        while self.tokens[k].kind == "name" and self.tokens[k + 1].text == "::":
            k += 2
        if self.tokens[k].text == "*":
            self.at = k + 1
            return True
        return False

    def function_suffix(self) -> None:
        while True:
            self.attributes()
            if self.now.kind == "name" and self.now.text in ("const", "volatile", "override", "final", "mutable", "constexpr"):
                self.at += 1
            elif self.is_op("&") or self.is_op("&&"):
                self.at += 1
            elif self.is_word("noexcept") or self.is_word("throw"):
                self.at += 1
                if self.is_op("("):
                    self.balanced("(", ")")
            elif self.take_op("->"):
                self.type_id()
            else:
                return

    def parameter_list(self) -> None:
        self.need_op("(")
        saved, self.angle = self.angle, 0
        if self.take_op(")"):
            self.angle = saved
            return
        while True:
            if self.take_op("..."):
                break
            if not self.cpp and self.is_name(self.now) and self.peek().text in (",", ")") and self.now.text not in self.types:
                self.at += 1  # an old-style list of names, or an unnamed parameter
            else:
                self.specifiers()
                self.declarator(True)
                if self.cpp and self.take_op("="):
                    self.init_value()
            if not self.take_op(","):
                if self.cpp:
                    self.take_op("...")
                break
        self.angle = saved
        self.need_op(")")

    def type_id(self) -> None:
        self.specifiers()
        self.declarator(True)

    def _starts_type(self, token: Token) -> bool:
        return token.kind == "name" and (token.text in BUILTIN or token.text in ("struct", "union", "enum", "const", "volatile", "typename", "class", "decltype", "register", "restrict") or self.is_name(token))

    def qualified(self) -> None:
        """A possibly qualified name with template arguments, an operator's or a destructor's name."""
        self.take_op("::")
        while True:
            if self.take_op("~"):
                self.need_name()
                return
            self.take_word("template")
            if self.take_word("operator"):
                token = self.now
                if token.text in ("new", "delete"):
                    self.at += 1
                    if self.take_op("["):
                        self.need_op("]")
                elif token.text == "(" or token.text == "[":
                    self.at += 1
                    self.need_op(")" if token.text == "(" else "]")
                elif token.kind == "str":
                    self.at += 1
                    if token.text == '""':
                        self.need_name()
                elif token.kind == "op":
                    self.take_operator(self.operator())
                else:
                    self.specifiers()
                    while self.now.text in ("*", "&"):
                        self.at += 1
                return
            if self.is_word("decltype"):
                self.at += 1
                self.balanced("(", ")")
            else:
                self.need_name()
            if self.is_op("<"):
                self.attempt(self.template_arguments)
            if self.is_op("::") and (self.peek().kind == "name" or self.peek().text == "~"):
                self.at += 1
                continue
            return

    def template_arguments(self) -> None:
        self.need_op("<")
        self.angle += 1
        try:
            while not self.is_op(">"):
                start = self.at
                if not (self.attempt(self.type_id) and self._argument_end()):
                    self.at = start
                    self.conditional()
                    if not self._argument_end():
                        self.reject("expected '>'")
                self.take_op("...")
                if not self.is_op(">"):
                    self.need_op(",")
            self.at += 1
        finally:
            self.angle -= 1

    def _argument_end(self) -> bool:
        return self.now.kind == "op" and self.now.text in (",", ">", "...")

    # Statements

    def block(self) -> None:
        self.braced(self.statement)

    def statement(self) -> None:
        self.attributes()
        token = self.now
        text = token.text
        if token.kind == "op":
            if text == "{":
                return self.block()
            if text == ";":
                self.at += 1
                return None
        elif token.kind == "name":
            rule = _STATEMENTS.get(text)
            if rule and text in self.keywords | {"asm", "__asm__"}:
                return rule(self)
            if self.peek().text == ":" and self.peek().kind == "op" and self.is_name(token):
                self.at += 2
                if self.is_op("}"):
                    self.reject("expected a statement")
                return self.statement()
            if text in self.macros and self.peek().text in ("(", ";") and self.is_name(token):
                start = self.at
                self.at += 1
                if self.is_op("("):
                    self.balanced("(", ")")
                if self.take_op(";") or self.is_op("}") or self.now.newline and self.now.kind == "name":
                    return None
                self.at = start
            if self.cpp and text == "using":
                return self.using()
            if self.cpp and text == "namespace":
                return self.namespace()
            if text in ("_Static_assert", "static_assert"):
                return self.static_assertion()
            if self.is_declaration():
                return self.declaration(False)
        self.expression()
        self.need_op(";")
        return None

    def is_declaration(self) -> bool:
        token = self.now
        text = token.text
        if text in self.keywords:
            if self.cpp and text in BUILTIN and self.peek().text in ("(", "{"):
                return False
            return text in BUILTIN or text in STORAGE or text in ("struct", "union", "enum", "class", "typename", "decltype", "template", "_Alignas", "alignas") and not (text == "decltype" and False)
        if not self.is_name(token) and text != "::":
            return False
        start = self.at
        try:
            if self.cpp:
                self.qualified()
            else:
                self.at += 1
            while self.now.kind == "op" and (self.now.text == "*" or self.cpp and self.now.text in ("&", "&&")) or self.now.kind == "name" and self.now.text in ("const", "volatile"):
                stars = self.at
                self.at += 1
                if self.at - stars > 8:
                    return False
            pointer = self.tokens[self.at - 1].text in ("*", "&", "&&")
            if self.cpp and self.is_op("[") and self.tokens[self.at - 1].text in ("auto", "&"):
                return True
            if not self.is_name(self.now):
                return False
            follow = self.peek()
            if follow.kind != "op":
                return not pointer and follow.kind == "name" and follow.text in ("__attribute__",)
            if pointer:
                return follow.text in ("=", ";", ",", "[", ")") or follow.text == "{" and self.cpp or follow.text == ":" and self.cpp
            return follow.text in ("=", ";", ",", "[", "(", "{", ":")
        except Reject:
            return False
        finally:
            self.at = start

    def condition(self) -> None:
        self.need_op("(")
        if self.cpp:
            start = self.at
            if self.is_declaration() and self.attempt(self.condition_declaration):
                return
            self.at = start
        self.expression()
        if self.cpp and self.take_op(";"):
            self.expression()
        self.need_op(")")

    def condition_declaration(self) -> None:
        self.specifiers()
        self.declarator(False)
        self.initializer()
        while self.take_op(","):
            self.declarator(False)
            self.initializer()
        if self.take_op(";"):
            self.expression()
        self.need_op(")")

    def if_(self) -> None:
        self.at += 1
        if self.cpp:
            self.take_word("constexpr")
        self.condition()
        self.statement()
        if self.take_word("else"):
            self.statement()

    def body(self) -> None:
        self.loops += 1
        try:
            self.statement()
        finally:
            self.loops -= 1

    def while_(self) -> None:
        self.at += 1
        self.condition()
        self.body()

    def do(self) -> None:
        self.at += 1
        self.body()
        self.need_word("while")
        self.need_op("(")
        self.expression()
        self.need_op(")")
        self.need_op(";")

    def for_(self) -> None:
        self.at += 1
        self.need_op("(")
        if self.cpp and self.attempt(self.range_head):
            self.init_value()
            self.need_op(")")
            return self.body()
        if not self.take_op(";"):
            if self.is_declaration():
                self.declaration(False)
            else:
                self.expression()
                self.need_op(";")
        if not self.is_op(";"):
            self.expression()
        self.need_op(";")
        if not self.is_op(")"):
            self.expression()
        self.need_op(")")
        return self.body()

    def range_head(self) -> None:
        self.specifiers()
        if self.now.text in ("&", "&&") and self.peek().text == "[":
            self.at += 1
        if self.take_op("["):
            self.need_name()
            while self.take_op(","):
                self.need_name()
            self.need_op("]")
        else:
            self.declarator(False)
        self.need_op(":")

    def switch(self) -> None:
        self.at += 1
        self.condition()
        self.switches += 1
        try:
            self.statement()
        finally:
            self.switches -= 1

    def case(self) -> None:
        if not self.switches:
            self.reject("case outside a switch")
        if self.next().text == "case":
            self.conditional()
            if self.take_op("..."):
                self.conditional()
        self.need_op(":")
        if self.is_op("}"):
            if self.cpp:
                self.reject("expected a statement")
            self.reject("expected a statement")
        if not self.cpp and self.is_declaration():
            self.reject("a label needs a statement")
        self.statement()

    def jump(self) -> None:
        token = self.now
        if not self.loops and not (token.text == "break" and self.switches):
            self.reject(f"{token.text} outside a loop")
        self.at += 1
        self.need_op(";")

    def goto(self) -> None:
        self.at += 1
        if self.is_op("*"):
            self.expression()
        else:
            self.need_name()
        self.need_op(";")

    def return_(self) -> None:
        self.at += 1
        if not self.is_op(";"):
            if self.cpp and self.is_op("{"):
                self.brace_list()
            else:
                self.expression()
        self.need_op(";")

    def try_(self) -> None:
        self.at += 1
        self.block()
        if not self.is_word("catch"):
            self.reject("expected 'catch'")
        while self.is_word("catch"):
            self.catch()

    def catch(self) -> None:
        self.at += 1
        self.need_op("(")
        if not self.take_op("..."):
            self.type_id()
        self.need_op(")")
        self.block()

    def asm(self) -> None:
        self.at += 1
        self.take_word("volatile") or self.take_word("__volatile__")
        self.balanced("(", ")")
        self.need_op(";")

    def stray_else(self) -> None:
        self.reject("unexpected else")

    # Expressions

    def expression(self) -> None:
        saved, self.angle = self.angle, 0
        self.assignment()
        while self.take_op(","):
            self.assignment()
        self.angle = saved

    def assignment(self) -> None:
        if self.cpp and self.is_word("throw"):
            self.at += 1
            if not (self.now.kind == "op" and self.now.text in (";", ")", ":", ",")):
                self.assignment()
            return
        kind = self.conditional()
        op = self.operator()
        if op in ASSIGN and self.now.kind in ("op", "name"):
            if kind == "literal":
                self.reject("invalid assignment target")
            self.take_operator(op)
            self.init_value()

    def conditional(self) -> str:
        kind = self.binary(0)
        if self.take_op("?"):
            if not self.is_op(":"):
                saved, self.angle = self.angle, 0
                self.expression()
                self.angle = saved
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
            op = self.operator()
            rank = BINARY.get(op)
            if rank is None or rank < least or token.kind == "name" and not self.cpp or self.angle and op[0] == ">":
                return kind
            self.take_operator(op)
            self.binary(rank + 1)
            kind = "other"

    def unary(self) -> str:
        token = self.now
        text = token.text
        if token.kind == "op":
            if text in ("++", "--", "+", "-", "!", "~", "*", "&", "&&"):
                self.at += 1
                if text == "~" and self.cpp and self.is_name(self.now) and False:
                    return "other"
                self.unary()
                return "unary"
            if text == "(" and self.is_cast():
                self.at += 1
                self.type_id()
                self.need_op(")")
                if self.is_op("{"):
                    self.brace_list()
                    return self.trailers()
                self.unary()
                return "other"
        elif token.kind == "name":
            if text in ("sizeof", "_Alignof", "alignof", "__alignof__"):
                self.at += 1
                if self.cpp and self.take_op("..."):
                    self.need_op("(")
                    self.need_name()
                    self.need_op(")")
                    return "other"
                start = self.at
                if self.take_op("("):
                    if self._starts_type(self.now) and self.attempt(self.type_id) and self.take_op(")"):
                        if self.is_op("{"):
                            self.brace_list()
                        if not (self.is_op("->") or self.is_op(".") or self.is_op("[")):
                            return "other"
                    self.at = start
                self.unary()
                return "other"
            if self.cpp and text in ("not", "compl"):
                self.at += 1
                self.unary()
                return "unary"
            if self.cpp and text == "noexcept":
                self.at += 1
                self.balanced("(", ")")
                return "other"
            if self.cpp and (text in ("new", "delete")):
                return self.allocation()
        elif token.kind == "end":
            self.reject("expected an expression")
        if token.text == "::" and self.cpp and self.peek().text in ("new", "delete"):
            self.at += 1
            return self.allocation()
        return self.postfix()

    def allocation(self) -> str:
        if self.next().text == "delete":
            if self.take_op("["):
                self.need_op("]")
            self.unary()
            return "other"
        if self.is_op("(") and not self.is_cast():
            self.call_arguments()
        if self.take_op("("):
            self.type_id()
            self.need_op(")")
        else:
            self.specifiers()
            while self.now.text in ("*", "&", "const"):
                self.at += 1
            while self.is_op("["):
                self.at += 1
                if not self.is_op("]"):
                    self.expression()
                self.need_op("]")
        if self.is_op("("):
            self.call_arguments()
        elif self.is_op("{"):
            self.brace_list()
        return "other"

    def is_cast(self) -> bool:
        """Whether the bracket here holds a type and an operand follows."""
        first = self.peek()
        if first.kind != "name" or not self._starts_type(first):
            return False
        start = self.at
        self.at += 1
        try:
            if not self.attempt(self.type_id) or not self.is_op(")"):
                return False
            sure = first.text in self.keywords or first.text in self.types or self.tokens[self.at - 1].text == "*"
            follow = self.peek()
            if follow.kind in ("num", "str"):
                return True
            if follow.kind == "name":
                return follow.text not in BINARY and (self.is_name(follow) or follow.text in ("sizeof", "this", "true", "false", "nullptr", "not", "new", "static_cast", "_Generic"))
            if follow.kind != "op":
                return False
            return follow.text in ("!", "~") or sure and follow.text in ("(", "*", "&", "-", "+", "++", "--", "{", "[")
        finally:
            self.at = start

    def postfix(self) -> str:
        kind = self.primary()
        return self.trailers(kind)

    def trailers(self, kind: str = "other") -> str:
        while self.now.kind == "op":
            text = self.now.text
            if text == "[":
                self.at += 1
                if self.is_op("{") and self.cpp:
                    self.brace_list()
                else:
                    self.expression()
                self.need_op("]")
            elif text == "(":
                self.call_arguments()
            elif text in (".", "->"):
                self.at += 1
                if self.cpp:
                    self.take_word("template")
                    if self.is_op("*"):
                        self.at += 1
                        self.unary()
                        continue
                    self.qualified()
                else:
                    self.need_name()
            elif text in ("++", "--"):
                if kind == "literal":
                    self.reject("invalid operand")
                self.at += 1
            elif text == "{" and self.cpp and kind == "type":
                self.brace_list()
            else:
                return "other" if kind == "type" else kind
            kind = "other"
        return "other" if kind == "type" else kind

    def call_arguments(self) -> None:
        self.need_op("(")
        saved, self.angle = self.angle, 0
        while not self.take_op(")"):
            if self.cpp and self.is_op("{"):
                self.brace_list()
            else:
                start = self.at
                if not self.attempt(self.assignment) or not (self.is_op(",") or self.is_op(")") or self.is_op("...")):
                    furthest = self.at
                    self.at = start
                    # macros may take types
                    if not (self._starts_type(self.now) and self.attempt(self.type_id) and (self.is_op(",") or self.is_op(")"))):
                        self.at = start
                        self.assignment()
                        self.at = max(self.at, furthest)
            self.take_op("...")
            if not self.is_op(")"):
                self.need_op(",")
                if self.is_op(")"):
                    self.reject("expected an expression")
        self.angle = saved

    def primary(self) -> str:
        token = self.now
        kind, text = token.kind, token.text
        if kind == "num":
            self.at += 1
            return "literal"
        if kind == "str":
            while self.now.kind == "str" or self.now.kind == "name" and self.is_name(self.now) and self.now.text.isupper() and (self.peek().kind == "str" or self.tokens[self.at - 1].kind == "str"):
                self.at += 1
            return "literal"
        if kind == "op":
            if text == "(":
                self.at += 1
                if self.is_op("{"):
                    self.block()
                elif self.cpp and self._fold():
                    pass
                else:
                    self.expression()
                self.need_op(")")
                return "other"
            if text == "[" and self.cpp:
                return self.lambda_()
            if text == "::" and self.cpp or text == "~" and self.cpp:
                self.qualified()
                return "other"
            self.reject("expected an expression")
        if kind == "name":
            if text == "_Generic" and not self.cpp:
                self.at += 1
                self.need_op("(")
                self.assignment()
                while self.take_op(","):
                    if not self.take_word("default"):
                        self.type_id()
                    self.need_op(":")
                    self.assignment()
                self.need_op(")")
                return "other"
            if self.cpp:
                if text in CASTS:
                    self.at += 1
                    self.need_op("<")
                    self.angle += 1
                    self.type_id()
                    self.angle -= 1
                    self.need_op(">")
                    self.need_op("(")
                    self.expression()
                    self.need_op(")")
                    return "other"
                if text in ("this", "true", "false", "nullptr"):
                    self.at += 1
                    return "other"
                if text == "typeid":
                    self.at += 1
                    self.balanced("(", ")")
                    return "other"
                if text in BUILTIN or text in ("typename", "decltype"):
                    self.at += 1
                    if text == "typename":
                        self.qualified()
                    elif text == "decltype":
                        self.balanced("(", ")")
                    while self.now.kind == "name" and self.now.text in BUILTIN:
                        self.at += 1
                    if not (self.is_op("(") or self.is_op("{") or self.is_op("::")):
                        self.reject("expected '('")
                    if self.take_op("::"):
                        self.qualified()
                    return "type"
                if text == "operator":
                    self.qualified()
                    return "other"
            if self.is_name(token):
                if self.cpp:
                    self.qualified()
                    return "type" if self.is_op("{") and (text in self.types or "::" in (self.peek(-1).text,) or text[0].isupper() or self.tokens[self.at - 1].text == ">" or self.tokens[self.at - 2].text == "::") else "other"
                self.at += 1
                return "other"
        return self.reject("expected an expression")

    def _fold(self) -> bool:
        if self.is_op("..."):
            self.at += 1
            self.take_operator(self.operator())
            self.binary(11)
            return True
        start = self.at
        if self.attempt(self.unary) and self.now.kind == "op" and self.operator() in BINARY | dict.fromkeys(ASSIGN | {","}):
            self.take_operator(self.operator())
            if self.take_op("..."):
                if not self.is_op(")"):
                    self.take_operator(self.operator())
                    self.binary(11)
                return True
        self.at = start
        return False

    def lambda_(self) -> str:
        self.balanced("[", "]")
        if self.is_op("<"):
            self.template_arguments()
        if self.is_op("("):
            self.parameter_list()
        self.function_suffix()
        if not self.is_op("{"):
            self.reject("expected '{'")
        self.function_body()
        return "other"


_STATEMENTS = {
    "if": Unit.if_,
    "else": Unit.stray_else,
    "while": Unit.while_,
    "do": Unit.do,
    "for": Unit.for_,
    "switch": Unit.switch,
    "case": Unit.case,
    "default": Unit.case,
    "break": Unit.jump,
    "continue": Unit.jump,
    "goto": Unit.goto,
    "return": Unit.return_,
    "try": Unit.try_,
    "asm": Unit.asm,
    "__asm__": Unit.asm,
}


def _check(text: str, cpp: bool) -> list[Problem]:
    problems: list[Problem] = []
    code, macros = preprocess(text.replace("\r\n", "\n"), problems)
    Unit(tokenize(code, problems, cpp), problems, cpp, macros).unit()
    return sorted(problems, key=lambda p: p.line)


def check_c(text: str) -> list[Problem]:
    return _check(text, False)


def check_cpp(text: str) -> list[Problem]:
    return _check(text, True)
