"""Symbols of source files and semantic code chunks.

Python symbols come from the standard parser. For the other languages declarations are matched in a mask of the source
(comments and literals blanked, offsets kept) and end at their matching brace.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: default limit of a chunk.
MAX_CHARS = 4000
LANGUAGES = ("python", "javascript", "typescript", "c", "cpp")


class UnsupportedLanguage(ValueError):
    """No parser is registered for a language."""


@dataclass
class Symbol:
    name: str
    qualified_name: str
    symbol_type: str
    start_line: int
    end_line: int
    content: str
    parent: str | None = None


_MASK = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_BRACED = {
    "c": [("struct", r"\bstruct\s+(?P<name>\w+)\s*(?=\{)"), ("enum", r"\benum\s+(?P<name>\w+)\s*(?=\{)"), ("function", r"^[ \t]*(?!(?:return|else|typedef|if|for|while|switch)\b)[A-Za-z_][\w\s*]*?[\s*](?P<name>[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?=\{)")],
    "javascript": [("class", r"\bclass\s+(?P<name>[\w$]+)[^{;]*(?=\{)"), ("function", r"\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^>{}]*>)?\([^{}]*?\)\s*(?::[^{;=]+)?(?=\{)")],
}
_BRACED["cpp"] = [("namespace", r"\bnamespace\s+(?P<name>[\w:]+)\s*(?=\{)"), ("class", r"\bclass\s+(?P<name>\w+)[^{};()]*(?=\{)"), *_BRACED["c"][:1], ("enum", r"\benum\s+(?:class\s+|struct\s+)?(?P<name>\w+)[^{};]*(?=\{)"), ("function", r"^[ \t]*(?!(?:return|else|typedef|if|for|while|switch|namespace|class|struct|enum)\b)[A-Za-z_~][\w\s*&:<>,~]*?(?P<name>~?[A-Za-z_]\w*)\s*\([^;{}]*\)(?:\s*(?:const|noexcept|override|final))*(?:\s*:[^{};]*(?:\{\}|\([^)]*\))[^{};]*)?\s*(?=\{)")]
_BRACED["typescript"] = [*_BRACED["javascript"], ("interface", r"\binterface\s+(?P<name>[\w$]+)[^{;]*(?=\{)"), ("enum", r"\benum\s+(?P<name>[\w$]+)\s*(?=\{)")]
_METHOD = r"^[ \t]*(?:(?:public|private|protected|static|readonly|async|override|get|set)\s+)*(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b)[\w$]+)\s*(?:<[^>{}]*>)?\([^{}]*?\)\s*(?::[^{;=]+)?(?=\{)"
_ALIAS = re.compile(r"^[ \t]*(?:export\s+)?type\s+(?P<name>[\w$]+)\s*(?:<[^=]*>)?\s*=[^;]*;", re.M)
_COMPILED = {k: [(t, re.compile(p, re.M)) for t, p in v] for k, v in _BRACED.items()}
_COMPILED_METHOD = re.compile(_METHOD, re.M)


def _python(text: str) -> list[Symbol]:
    tree = ast.parse(text)
    lines = text.splitlines(keepends=True)
    out: list[Symbol] = []

    def walk(nodes: list[ast.stmt], parent: Symbol | None) -> None:
        for node in nodes:
            inner = parent
            if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if parent and parent.symbol_type == "class" else "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function"
                body = "".join(lines[node.lineno - 1 : node.end_lineno]).rstrip("\n")
                inner = Symbol(node.name, f"{parent.qualified_name}.{node.name}" if parent else node.name, kind, node.lineno, node.end_lineno, body[node.col_offset :] if body[: node.col_offset].isspace() or not node.col_offset else body, parent.qualified_name if parent else None)
                out.append(inner)
            for part in ("body", "orelse", "finalbody", "handlers", "cases"):
                walk(getattr(node, part, None) or [], inner)

    walk(tree.body, None)
    return out


def _masked(text: str) -> str:
    return _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _braced(text: str, language: str) -> list[Symbol]:
    mask = _masked(text)
    closes: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[{}]", mask):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            closes[stack.pop()] = m.end()
    found: dict[int, tuple[int, str, str]] = {}  # opening brace to (start, type, name)
    for kind, pattern in _COMPILED[language]:
        for m in pattern.finditer(mask):
            if m.end() in closes and m.end() not in found:
                start = m.start() + len(m[0]) - len(m[0].lstrip())
                found[m.end()] = (start, kind, m["name"])
    if language in ("javascript", "typescript"):
        for m in _COMPILED_METHOD.finditer(mask):
            inside = [b for b, (_, k, _) in found.items() if k == "class" and b < m.start() < closes[b]]
            depth = [b for b in closes if b < m.start() < closes[b]]
            if inside and m.end() in closes and m.end() not in found and max(depth) == max(inside):
                found[m.end()] = (m.start() + len(m[0]) - len(m[0].lstrip()), "method", m["name"])
    spans = [(start, closes[b], kind, name) for b, (start, kind, name) in found.items()]
    if language == "typescript":
        spans += [(m.start() + len(m[0]) - len(m[0].lstrip()), m.end(), "type", m["name"]) for m in _ALIAS.finditer(mask)]
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    out: list[Symbol] = []
    above: list[tuple[int, Symbol]] = []
    for start, end, kind, name in sorted(spans, key=lambda s: (s[0], -s[1])):
        while above and above[-1][0] <= start:
            above.pop()
        parent = above[-1][1] if above else None
        if language == "cpp" and kind == "function" and parent and parent.symbol_type in ("class", "struct"):
            kind = "method"
        symbol = Symbol(name, f"{parent.qualified_name}.{name}" if parent else name, kind, bisect_right(starts, start), bisect_right(starts, end - 1), text[start:end], parent.qualified_name if parent else None)
        out.append(symbol)
        above.append((end, symbol))
    return out


def symbols_of(language: str, text: str) -> tuple[list[Symbol], list[str]]:
    """(symbols, errors). Source that does not parse gives an error and what was found."""
    if language not in LANGUAGES:
        raise UnsupportedLanguage(language)
    try:
        return (_python(text) if language == "python" else _braced(text, language)), []
    except (SyntaxError, ValueError, RecursionError) as error:
        return [], [str(error)]


def exact_slices(text: str, first_line: int, most: int) -> Iterator[tuple[str, int, int]]:
    """(slice, first line, last line): slices that join to the text, cut behind the last line end, else space, in reach."""
    at, line = 0, first_line
    while at < len(text):
        size = len(text) - at
        if size > most:
            for mark in "\n ":
                found = text.rfind(mark, at + 1, at + most + 1)
                if found > at:
                    size = found - at + 1
                    break
            else:
                size = most
        piece = text[at : at + size]
        last = line + piece.count("\n")
        yield piece, line, last
        at, line = at + size, last


def code_chunks(path: str, symbols: list[Symbol], most: int = MAX_CHARS) -> Iterator[dict]:
    """A symbol that fits, and its children too; of one that does not only the children; an oversized leaf in slices.

    Of symbols with one qualified name the first is kept.
    """
    below: dict[str | None, list[Symbol]] = {}
    for symbol in symbols:
        below.setdefault(symbol.parent, []).append(symbol)
    seen: set[str] = set()
    queue = list(reversed(below.get(None, [])))
    while queue:
        symbol = queue.pop()
        if symbol.qualified_name in seen:
            continue
        seen.add(symbol.qualified_name)
        children = below.get(symbol.qualified_name, [])
        fits = len(symbol.content) <= most
        if fits:
            slices = [(symbol.content, symbol.start_line, symbol.end_line)]
        else:
            slices = [] if children else list(exact_slices(symbol.content, symbol.start_line, most))
        for part, (content, first, last) in enumerate(slices):
            chunk_id = hashlib.sha256(f"{path}:{symbol.qualified_name}:{part}:{content}".encode("utf-8", "surrogatepass")).hexdigest()
            yield {"chunk_id": chunk_id, "qualified_name": symbol.qualified_name, "symbol_type": symbol.symbol_type, "start_line": first, "end_line": last, "part_index": part, "content": content}
        queue += reversed(children)


def _map(files: DataFrame, keys: list[str], names: list[str], types: list[pa.DataType], schema: str, rule) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, language, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if language in LANGUAGES and content is not None:
                    rows += [(key, r) for r in rule(key, language, content)]
            columns = [pa.array([r[0] for r in rows], pa.string())] + [pa.array([r[1][n] for r in rows], t) for n, t in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [keys[0], *names])

    source = files.select(F.col(keys[0]).cast("string"), F.lower(F.trim("language")), F.col("content").cast("string"))
    return source.mapInArrow(run, schema)


def extract_symbols(files: DataFrame, path: str = "relative_path") -> DataFrame:
    """(path, name, qualified_name, symbol_type, start_line, end_line, parent); files of other languages give none."""

    def rule(_: str, language: str, content: str) -> Iterator[dict]:
        for s in symbols_of(language, content)[0]:
            yield {"name": s.name, "qualified_name": s.qualified_name, "symbol_type": s.symbol_type, "start_line": s.start_line, "end_line": s.end_line, "parent": s.parent}

    names = ["name", "qualified_name", "symbol_type", "start_line", "end_line", "parent"]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    return _map(files, [path], names, types, f"{path} string, name string, qualified_name string, symbol_type string, start_line int, end_line int, parent string", rule)


def chunk_code(files: DataFrame, path: str = "relative_path", most: int = MAX_CHARS) -> DataFrame:
    """(path, chunk_id, qualified_name, symbol_type, start_line, end_line, part_index, content, content_hash)."""
    if most <= 0:
        raise ValueError("the limit must be positive")

    def rule(key: str, language: str, content: str) -> Iterator[dict]:
        return code_chunks(key or "", symbols_of(language, content)[0], most)

    names = ["chunk_id", "qualified_name", "symbol_type", "start_line", "end_line", "part_index", "content"]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    schema = f"{path} string, chunk_id string, qualified_name string, symbol_type string, start_line int, end_line int, part_index int, content string"
    return _map(files, [path], names, types, schema, rule).withColumn("content_hash", F.sha2("content", 256))
