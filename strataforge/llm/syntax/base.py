"""What the parsers share: tokens, errors, panic mode."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Problem:
    """One error: message, 1-based line, and a cause from a short list."""

    message: str
    line: int
    cause: str


class Reject(Exception):
    """Raised at the first token that no rule accepts."""

    def __init__(self, message: str, at: int, cause: str = "unexpected") -> None:
        super().__init__(message)
        self.message, self.at, self.cause = message, at, cause


class Token:
    """kind: name, num, str, op, tmpl, regex, end. newline: a line break stands before it."""

    __slots__ = ("kind", "text", "start", "line", "newline")

    def __init__(self, kind: str, text: str, start: int, line: int, newline: bool) -> None:
        self.kind, self.text, self.start, self.line, self.newline = kind, text, start, line, newline

    def __repr__(self) -> str:
        return f"{self.kind}:{self.text!r}@{self.line}"


class Parser:
    """A cursor over tokens."""

    keywords: frozenset[str] = frozenset()

    def __init__(self, tokens: list[Token], problems: list[Problem]) -> None:
        self.tokens, self.at, self.problems = tokens, 0, problems

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, ahead: int = 1) -> Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def next(self) -> Token:
        token = self.tokens[self.at]
        if token.kind != "end":
            self.at += 1
        return token

    def is_op(self, text: str) -> bool:
        token = self.tokens[self.at]
        return token.text == text and token.kind == "op"

    def is_word(self, text: str) -> bool:
        token = self.tokens[self.at]
        return token.text == text and token.kind == "name"

    def take_op(self, text: str) -> bool:
        token = self.tokens[self.at]
        if token.text == text and token.kind == "op":
            self.at += 1
            return True
        return False

    def take_word(self, text: str) -> bool:
        token = self.tokens[self.at]
        if token.text == text and token.kind == "name":
            self.at += 1
            return True
        return False

    def need_op(self, text: str) -> None:
        if not self.take_op(text):
            self.reject(f"expected '{text}'")

    def need_word(self, text: str) -> None:
        if not self.take_word(text):
            self.reject(f"expected '{text}'")

    def need_name(self) -> Token:
        token = self.tokens[self.at]
        if token.kind != "name" or token.text in self.keywords:
            self.reject("expected a name")
        self.at += 1
        return token

    def reject(self, message: str) -> None:
        token = self.now
        cause = "truncated" if token.kind == "end" else "conflict marker" if token.text[:2] in ("<<", ">>", "==", "||") and self._marker() else "unexpected"
        raise Reject(f"{message} at {'the end' if token.kind == 'end' else repr(token.text[:30])}", self.at, cause)

    def _marker(self) -> bool:
        token = self.now
        return (token.newline or not self.at) and "".join(t.text for t in self.tokens[self.at : self.at + 7])[:7] in ("<<<<<<<", ">>>>>>>", "=======", "|||||||")

    def record(self, error: Reject) -> None:
        self.problems.append(Problem(error.message, self.tokens[min(error.at, len(self.tokens) - 1)].line, error.cause))

    def attempt(self, rule, *args):  # noqa: ANN001, ANN002, ANN201
        """The rule's result, or None with the cursor back where it was."""
        start = self.at
        try:
            return rule(*args) or True
        except Reject:
            self.at = start
            return None

    def recover(self, start: int, opens: str = "{", closes: str = "}") -> None:
        """Panic mode: skip to behind the next ';', or to before a '}' of this level, or to the next line's first token."""
        self.at = max(self.at, start)
        depth = 0
        first = True
        while self.now.kind != "end":
            token = self.now
            if token.kind == "op":
                if token.text == closes:
                    if not depth:
                        if first:
                            self.at += 1
                        return
                    depth -= 1
                    self.at += 1
                    if not depth:
                        return
                    continue
                if token.text == opens:
                    depth += 1
                elif token.text == ";" and not depth:
                    self.at += 1
                    return
            if token.newline and not depth and not first and token.kind == "name":
                return
            first = False
            self.at += 1
