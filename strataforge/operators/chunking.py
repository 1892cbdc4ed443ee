"""Chunkers: recursive, Markdown, page and article. Documents are independent: every chunker is a map over rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.functions.tokenizer import split_tokens
from strataforge.operators.blocks import Block, article_blocks, file_blocks

# Default limits.
MAX_CHARS, OVERLAP_CHARS = 4000, 400
MAX_TOKENS, OVERLAP_TOKENS = 512, 64
Cutter = Callable[[str], list[str]]


def _sha(*parts: object, separator: str = ":") -> str:
    return hashlib.sha256(separator.join(map(str, parts)).encode("utf-8", "surrogatepass")).hexdigest()


def _checked(most: int, overlap: int) -> None:
    if most <= 0 or not 0 <= overlap < most:
        raise ValueError("the limit must be positive and 0 <= overlap < limit")


def recursive_pieces(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """Sentences and paragraphs packed with one space between; a full piece hands its last ``overlap`` characters on.

    A sentence longer than the limit is cut into windows with stride most - overlap, and what was carried is dropped.
    """
    _checked(most, overlap)
    flat = re.sub(r"[ \t]+", " ", text).strip()
    if len(flat) <= most:
        return [flat]
    out: list[str] = []
    open_ = ""
    for unit in (u.strip() for u in re.split(r"(?<=\n)\n+|(?<=[.!?])\s+", flat)):
        if not unit:
            continue
        if open_ and len(open_) + 1 + len(unit) > most:
            out.append(open_)
            open_ = open_[len(open_) - overlap :].strip() if overlap else ""
        joined = f"{open_} {unit}" if open_ else unit
        if len(joined) <= most:
            open_ = joined
        else:
            out += [unit[i : i + most] for i in range(0, len(unit), most - overlap)]
            open_ = ""
    return out + [open_] if open_ else out


def preserving_pieces(text: str, most: int = MAX_CHARS) -> list[str]:
    """Cut at groups of blank lines, then at the last space or line end; all inner blanks stay."""
    source = text.strip()
    if len(source) <= most:
        return [source]
    groups: list[str] = []
    for part in re.split(r"(\n\s*\n)", source):
        if groups and len(groups[-1]) + len(part) <= most or not groups:
            groups[-1:] = ["".join(groups[-1:]) + part]
        else:
            groups.append(part)
    out: list[str] = []
    for rest in groups:
        while len(rest) > most:
            at = max(rest.rfind(" ", 1, most + 1), 0) or max(rest.rfind("\n", 1, most + 1), 0) or most
            out.append(rest[:at])
            rest = rest[at:]
        out.append(rest)
    return [p for p in out if p.strip()]


def page_pieces(text: str, cut: Cutter, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[str]:
    """Paragraphs, else lines, else token windows. Packed tokens join without separator and carry the last ``overlap`` tokens on.

    A piece of many tokens among several is not cut further.
    """
    _checked(most, overlap)
    tokens = cut(text)
    if len(tokens) <= most:
        return [text]
    units: list[str] = []
    for separator in ("\n\n", "\n"):
        units = [u.strip() for u in text.split(separator) if u.strip()]
        if len(units) != 1:
            break
    if len(units) == 1:
        return [p for i in range(0, len(tokens), most - overlap) if (p := "".join(tokens[i : i + most]).strip())]
    out: list[str] = []
    held: list[str] = []
    for unit in units:
        own = cut(unit)
        if held and len(held) + len(own) > most:
            out.append("".join(held).strip())
            held = held[len(held) - overlap :] if overlap else []
        held = held + own
    return [p for p in [*out, "".join(held).strip()] if p]


def exact_pieces(text: str, cut: Cutter, most: int = MAX_TOKENS) -> list[str]:
    """Token windows whose concatenation is the text and which keep to the limit when counted alone."""
    tokens = cut(text)
    if len(tokens) <= most:
        return [text]
    out: list[str] = []
    at = 0
    while at < len(tokens):
        n = min(most, len(tokens) - at)
        while n > 1 and len(cut("".join(tokens[at : at + n]))) > most:
            n -= 1
        out.append("".join(tokens[at : at + n]))
        at += n
    return out


def packed_parts(parts: list[str], separator: str, cut: Cutter, most: int) -> list[str]:
    """Parts joined while they fit; a part over the limit is cut by itself."""
    out: list[str] = []
    held: str | None = None
    for part in parts:
        if len(cut(part)) > most:
            if held:
                out.append(held)
            held = None
            out += exact_pieces(part, cut, most)
        elif held and len(cut(held + separator + part)) > most:
            out.append(held)
            held = part
        else:
            held = held + separator + part if held else part
    return out + [held] if held else out


def article_block_pieces(block: Block, cut: Cutter, most: int) -> list[str]:
    """Pieces of a block over the limit: lists by item, tables and code by line, the rest by tokens."""
    if block.type == "list" and block.items:
        return packed_parts(block.items, "\n", cut, most)
    if block.type in ("table", "code") and block.text:
        return packed_parts(block.text.splitlines(keepends=True), "", cut, most)
    return exact_pieces(block.text, cut, most)


def recursive_chunks(document_id: str, text: str, most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[dict]:
    for index, piece in enumerate(recursive_pieces(text, most, overlap)):
        content = piece.strip()
        if content:
            yield {"chunk_id": _sha(document_id, index, content), "content": content, "location": f"chunk:{index}", "structural_type": "prose", "content_role": "documentation", "heading_path": [], "token_count": len(content.split())}


def markdown_chunks(document_id: str, text: str, most: int = MAX_CHARS) -> Iterator[dict]:
    """One or more chunks per section of a Markdown file; a section of code only is an implementation."""
    groups: list[tuple[list[str], list[Block]]] = []
    for block in file_blocks(text):
        if block.type == "heading" or not groups or groups[-1][0] != block.heading_path:
            groups.append((block.heading_path, []))
        groups[-1][1].append(block)
    filled = [g for g in groups if any(b.type != "heading" for b in g[1])]
    for number, (path, blocks) in enumerate(filled):
        body = "\n\n".join(f"{'#' * b.level} {b.text}" if b.type == "heading" else b.text for b in blocks)
        types = sorted({b.type for b in blocks})
        code = types == ["code_block"]
        for part, piece in enumerate(preserving_pieces(body, most)):
            content = piece.strip()
            if content:
                yield {
                    "chunk_id": _sha(document_id, number, part, content), "content": content, "location": f"section:{number}:part:{part}", "structural_type": types[0] if len(types) == 1 else "section",
                    "content_role": "implementation" if code else "documentation", "heading_path": path, "token_count": len(content.split()),
                }


def article_chunks(source_uri: str, text: str, cut: Cutter, most: int = MAX_TOKENS) -> Iterator[dict]:
    """Blocks packed within their section; ids do not depend on the order of other sections' chunks."""
    groups: list[list[Block]] = []
    for block in article_blocks(text):
        if block.type == "heading" or not groups:
            groups.append([])
        groups[-1].append(block)
    index = 0
    for number, blocks in enumerate(groups):
        path = blocks[0].heading_path if blocks[0].type == "heading" else []
        seen: dict[tuple[str, str], int] = {}
        held: list[tuple[Block, str]] = []

        def made(content: str, types: list[str], local: str, path: list[str] = path, number: int = number) -> dict:
            nonlocal index
            index += 1
            kind = types[0] if len(types) == 1 else "section"
            return {
                "chunk_id": _sha(source_uri, number, " > ".join(path), local, content, separator="\0"), "content": content, "location": f"{' > '.join(path) or '<root>'}:chunk:{index - 1}", "structural_type": kind,
                "content_role": kind, "heading_path": path, "token_count": len(cut(content)),
            }

        def release(held: list[tuple[Block, str]] = held, made: Callable = made) -> Iterator[dict]:
            if held:
                yield made("\n\n".join(b.text for b, _ in held), list(dict.fromkeys(b.type for b, _ in held)), "|".join(name for _, name in held))
                held.clear()

        for block in blocks:
            if block.type == "heading" or not block.text:
                continue
            again = seen.get((block.type, block.text), 0)
            seen[block.type, block.text] = again + 1
            name = f"{block.type}:{again}:{block.text}"
            if len(cut(block.text)) > most:
                yield from release()
                for part, piece in enumerate(article_block_pieces(block, cut, most)):
                    yield made(piece, [block.type], f"{name}:part:{part}")
                continue
            if held and len(cut("\n\n".join([*(b.text for b, _ in held), block.text]))) > most:
                yield from release()
            held.append((block, name))
        yield from release()


_NAMES = ["chunk_id", "content", "location", "structural_type", "content_role", "heading_path", "token_count"]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32()]
_SCHEMA = "document_id string, chunk_id string, content string, location string, structural_type string, content_role string, heading_path array<string>, token_count int"


def chunk_documents(documents: DataFrame, method: str = "recursive", ident: str = "document_id", text: str = "text", **options: object) -> DataFrame:
    """One row per chunk with content_hash. method: recursive, markdown or article. Null texts give none; blank chunks are dropped.

    For articles the ident is the source_uri and document_id is derived from uri and content.
    """

    def rule(key: str, value: str) -> Iterator[dict]:
        if method == "article":
            return article_chunks(key, value, split_tokens(), **options)
        return {"recursive": recursive_chunks, "markdown": markdown_chunks}[method](key, value, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                owner = _sha(key, hashlib.sha256(value.encode()).hexdigest(), separator="\0") if method == "article" else key
                rows += [(owner, chunk) for chunk in rule(key, value)]
            columns = [pa.array([r[0] for r in rows], pa.string())] + [pa.array([r[1][n] for r in rows], t) for n, t in zip(_NAMES, _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["document_id", *_NAMES])

    if method not in ("recursive", "markdown", "article"):
        raise ValueError(f"unknown method {method!r}")
    source = documents.select(F.col(ident).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null")
    return source.mapInArrow(run, _SCHEMA).withColumn("content_hash", F.sha2("content", 256))


def chunk_pages(pages: DataFrame, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """pages(document_id, page, text) to (document_id, chunk_id, chunk_index, page, section, content, content_hash).

    Pages are cut one by one in a map; a window over each document then numbers its pieces through.
    """
    from pyspark.sql import Window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = split_tokens()
        for batch in batches:
            rows = [(d, p, k, piece) for d, p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, piece in enumerate(page_pieces(t, cut, most, overlap)) if piece.strip()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))], ["document_id", "page", "part", "content"])

    source = pages.select(F.col("document_id").cast("string"), F.col("page").cast("int"), F.col("text").cast("string")).where("text is not null and document_id is not null")
    cut = source.mapInArrow(run, "document_id string, page int, part int, content string")
    numbered = cut.withColumn("chunk_index", F.row_number().over(Window.partitionBy("document_id").orderBy("page", "part")) - 1)
    chunk_id = F.sha2(F.concat_ws(":", "document_id", F.col("chunk_index").cast("string"), "content"), 256)
    return numbered.select("document_id", chunk_id.alias("chunk_id"), "chunk_index", "page", "content", F.sha2("content", 256).alias("content_hash"))
