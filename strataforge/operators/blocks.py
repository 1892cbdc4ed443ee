"""Block structure of Markdown text: one pass over lines with an open block.

Two dialects: files (blocks keep their fences, bullets and marks) and articles (blocks hold their content). Documents are
independent, so parsing is a map over rows and needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FILE_HEADING = re.compile(r"(#{1,6})\s+(.+?)(?:\s+#+)?\s*$")
_FILE_FENCE = re.compile(r"\s*(`{3,}|~{3,})[^`~]*$")
_FILE_ITEM = re.compile(r"\s*(?:[-+*]|\d+[.)])\s+")
_ARTICLE_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*))?$")
_ARTICLE_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_ARTICLE_ITEM = re.compile(r" {0,3}(?:[-+*]|\d+[.)])[ \t]+(.*)", re.S)
_ARTICLE_QUOTE = re.compile(r" {0,3}>[ \t]?(.*)", re.S)
_LINK = re.compile(r"(?<!!)\[[^\]]+\]\(([^)\s]+)(?:\s+[^)]*)?\)")
_DELIMITER = re.compile(r"\s*:?-{3,}:?\s*")


@dataclass
class Block:
    """One block. rows and items only in the article dialect; position counts from 0."""

    type: str
    text: str
    level: int = 0
    heading_path: list[str] = field(default_factory=list)
    position: int = 0
    language: str | None = None
    url: str | None = None
    items: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)


class _Path:
    """The headings above the current line."""

    def __init__(self) -> None:
        self.levels: list[int] = []
        self.texts: list[str] = []

    def enter(self, level: int, text: str) -> None:
        keep = next((i for i, v in enumerate(self.levels) if v >= level), len(self.levels))
        # An open heading of the same or a deeper level ends, and everything opened after it.
        while self.levels and self.levels[-1] >= level:
            self.levels.pop()
            self.texts.pop()
        assert len(self.levels) >= keep
        self.levels.append(level)
        self.texts.append(text)


def _piped(line: str) -> bool:
    return line.strip().startswith("|")


def file_blocks(text: str) -> list[Block]:
    """Blocks of a Markdown file: heading, code_block, list, blockquote, table, paragraph.

    A paragraph runs to a blank line, heading, quote or fence; lists, quotes and tables are runs of their own lines; an
    open fence runs to the end.
    """
    out: list[Block] = []
    path = _Path()
    held: list[str] = []
    kind = ""
    closing: re.Pattern | None = None

    def close() -> None:
        nonlocal kind, closing
        if kind:
            out.append(Block(kind, "\n".join(held).strip(), 0, list(path.texts), len(out)))
        held.clear()
        kind, closing = "", None

    for line in text.splitlines():
        if closing is not None:
            held.append(line)
            if closing.match(line):
                close()
            continue
        bare = line.lstrip()
        if not bare:
            close()
            continue
        if heading := _FILE_HEADING.match(line):
            close()
            path.enter(len(heading[1]), heading[2].strip())
            out.append(Block("heading", heading[2].strip(), len(heading[1]), list(path.texts), len(out)))
            continue
        fenced = bare.startswith(("```", "~~~"))
        if kind == "paragraph" and not (fenced or bare[0] == ">" or re.match(r"#{1,6}\s", line)):
            held.append(line)
            continue
        now = "paragraph"
        if fenced:
            if opening := _FILE_FENCE.match(line):
                close()
                kind, closing = "code_block", re.compile(rf"\s*{opening[1][0]}{{{len(opening[1])},}}\s*$")
                held.append(line)
                continue
        elif _FILE_ITEM.match(line):
            now = "list"
        elif bare[0] == ">":
            now = "blockquote"
        elif _piped(line):
            now = "table"
        if now != kind or now == "paragraph":
            close()
            kind = now
        held.append(line)
    close()
    return out


def article_blocks(text: str) -> list[Block]:
    """Blocks of an article: heading, code, table, list, quote, link, paragraph, without their markers.

    A table needs a delimiter row; the lines of a quote are joined as they stand; a paragraph with an inline link is a link.
    """
    lines = text.splitlines(keepends=True)
    bare = [line.rstrip("\r\n") for line in lines]
    tables = {i for i in range(len(lines) - 1) if _piped(lines[i]) and _piped(lines[i + 1]) and all(_DELIMITER.fullmatch(c) for c in lines[i + 1].strip().strip("|").split("|"))}
    out: list[Block] = []
    path = _Path()
    held: list[str] = []
    kind, language = "", None
    closing: re.Pattern | None = None

    def close() -> None:
        nonlocal kind, closing
        block = Block(kind, "", 0, list(path.texts), len(out))
        if kind == "code":
            block.text, block.language = "".join(held), language
        elif kind == "table":
            block.text = "".join(held).strip()
            block.rows = [[c.strip() for c in row.strip().strip("|").split("|")] for k, row in enumerate(held) if k != 1]
        elif kind == "list":
            block.items = list(held)
            block.text = "\n".join(held)
        elif kind == "quote":
            block.text = "".join(held).strip()
        elif kind:
            block.text = "".join(held).strip()
            if link := _LINK.search(block.text):
                block.type, block.url = "link", link[1]
        if kind:
            out.append(block)
        held.clear()
        kind, closing = "", None

    for i, line in enumerate(lines):
        if closing is not None:
            if closing.match(bare[i]):
                close()
            else:
                held.append(line)
            continue
        if not line.strip():
            close()
            continue
        if kind == "table" and (len(held) == 1 or _piped(line)):
            held.append(line)
            continue
        if heading := _ARTICLE_HEADING.match(bare[i]):
            close()
            title = re.sub(r"[ \t]+#+[ \t]*$", "", (heading[2] or "").strip()).rstrip()
            path.enter(len(heading[1]), title)
            out.append(Block("heading", title, len(heading[1]), list(path.texts), len(out)))
        elif fence := _ARTICLE_FENCE.match(bare[i]):
            close()
            kind, closing = "code", re.compile(rf" {{0,3}}{fence[1][0]}{{{len(fence[1])},}}[ \t]*$")
            language = (fence[2].split() or [None])[0]
        elif i in tables:
            close()
            kind = "table"
            held.append(line)
        elif item := _ARTICLE_ITEM.match(line):
            if kind != "list":
                close()
                kind = "list"
            held.append(item[1].rstrip())
        elif quote := _ARTICLE_QUOTE.match(line):
            if kind != "quote":
                close()
                kind = "quote"
            held.append(quote[1])
        else:
            if kind != "paragraph":
                close()
                kind = "paragraph"
            held.append(line)
    close()
    return out


_SCHEMA = "position int, type string, level int, text string, heading_path array<string>, language string, url string"


def parse_blocks(documents: DataFrame, ident: str, text: str, dialect: str = "file") -> DataFrame:
    """One row per block: (ident, position, type, level, text, heading_path, language, url). Null texts have none."""
    rule = {"file": file_blocks, "article": article_blocks}[dialect]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [ident, "position", "type", "level", "text", "heading_path", "language", "url"]
        for batch in batches:
            rows = [(key, b) for key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True) for b in rule(value)]
            columns = [[r[0] for r in rows], *[[getattr(b, n) for _, b in rows] for n in names[1:]]]
            types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return documents.select(F.col(ident).cast("string").alias(ident), F.col(text).cast("string").alias("t")).where("t is not null").mapInArrow(run, f"{ident} string, {_SCHEMA}")


def sections(blocks: DataFrame, ident: str) -> DataFrame:
    """One row per section: (ident, section, heading, heading_level, heading_path, content, block_types).

    A heading opens a section; blocks before the first form section 0. A document's blocks are its own group, bounded by its length.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(ident).orderBy("position")
    is_heading = F.col("type") == "heading"
    first = F.first(is_heading).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    number = F.sum(is_heading.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - first.cast("int")
    numbered = blocks.withColumn("section", number.cast("int"))
    packed = F.sort_array(F.collect_list(F.struct("position", "type", "level", "text", "heading_path")))
    grouped = numbered.groupBy(ident, "section").agg(packed.alias("b"))
    head = F.filter("b", lambda x: x["type"] == "heading")
    body = F.filter("b", lambda x: (x["type"] != "heading") & (x["text"] != ""))
    at = F.try_element_at(head, F.lit(1))
    return grouped.select(
        ident, "section", at["text"].alias("heading"), F.coalesce(at["level"], F.lit(0)).alias("heading_level"), F.coalesce(at["heading_path"], F.array().cast("array<string>")).alias("heading_path"),
        F.array_join(F.transform(body, lambda x: x["text"]), "\n\n").alias("content"), F.array_distinct(F.transform("b", lambda x: x["type"])).alias("block_types"),
    )


def titles(blocks: DataFrame, ident: str) -> DataFrame:
    """(ident, title): the first level-1 heading, null without one."""
    top = F.when((F.col("type") == "heading") & (F.col("level") == 1), F.struct("position", "text"))
    return blocks.groupBy(ident).agg(F.min(top).alias("t")).select(ident, F.col("t.text").alias("title"))


def occurrences(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``occurrence``: how many earlier blocks of the same keys have the same type and text."""
    from pyspark.sql import Window

    return blocks.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys, "type", "text").orderBy("position")) - 1)
