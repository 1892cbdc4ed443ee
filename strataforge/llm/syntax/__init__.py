"""Parsers that only decide whether a text is valid in its language.

Each is a lexer and a recursive-descent parser: statements by descent, expressions by precedence climbing, and
after an error panic mode to the next statement, so that one text yields all its errors.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from strataforge.llm.syntax.base import Problem
from strataforge.llm.syntax.cfamily import check_c, check_cpp
from strataforge.llm.syntax.ecmascript import check_javascript, check_typescript
from strataforge.llm.syntax.python3 import check_python

CHECKERS: dict[str, Callable[[str], list[Problem]]] = {
    "python": check_python,
    "javascript": check_javascript,
    "typescript": check_typescript,
    "c": check_c,
    "cpp": check_cpp,
}


#: Python frames that one text may need; about half a gigabyte of a worker's memory.
FRAMES = 1_500_000


class TooDeep(Exception):
    """The text nests deeper than ``FRAMES`` allow, so nothing is said of it."""


def check(language: str, text: str) -> list[Problem]:
    """All errors of a text, in order; none for a valid one. Raises KeyError for an unknown language and ``TooDeep`` for a text without verdict.

    The recursion limit follows the text's length, which bounds its nesting, up to ``FRAMES``.
    """
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, min(FRAMES, 12000 + 30 * len(text))))
    try:
        return CHECKERS[language](text)
    except (RecursionError, MemoryError) as error:
        raise TooDeep(language) from error
    finally:
        sys.setrecursionlimit(limit)
