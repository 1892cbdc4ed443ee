"""Problem 1: cut oversized items at natural boundaries, with overlap.

Sizes are differences of a prefix-sum array over code points (or token offsets), boundaries one sorted
array per level. A piece ends at the last boundary under the limit, of the strongest level that
fills at least half of it, found by binary search; without one it is cut hard. The next piece
starts at the boundary nearest to ``overlap`` before that end.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("block", "paragraph", "line", "sentence", "word", "hard")
_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’)\]]*\s+")
_WORD = re.compile(r"\s+")


def boundaries(text: str, starts: list[int] | None) -> list[list[int]]:
    """Sorted cut offsets by level; a cut is the offset at which the next piece may begin."""
    size = len(text)
    levels = [sorted({s for s in starts or [] if s is not None and 0 < s < size})]
    levels += [[m.end() for m in pattern.finditer(text) if m.end() < size] for pattern in (_PARAGRAPH, _LINE, _SENTENCE, _WORD)]
    return levels


def pieces(text: str | None, max_size: int, overlap: int, starts: list[int] | None = None, prefix: list[int] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, level of the cut at end) of each piece, in code-point offsets.

    prefix: for other units than code points, the size of ``text[:i]`` for i in 0..len(text).
    None gives no piece, the empty text one empty piece; consecutive pieces overlap or touch, so nothing is lost.
    """
    if max_size <= 0 or not 0 <= overlap < max_size:
        raise ValueError("max_size must be positive and 0 <= overlap < max_size")
    if text is None:
        return []
    size = prefix or range(len(text) + 1)
    total, end_of = size[len(text)], len(text)
    if total <= max_size:
        return [(0, end_of, "end")]
    levels = boundaries(text, starts)
    merged = sorted(set().union(*levels))
    out, start, done = [], 0, 0
    while True:
        furthest = bisect_right(size, size[start] + max_size) - 1
        if furthest >= end_of:
            out.append((start, end_of, "end"))
            return out
        least = max(done, bisect_left(size, size[start] + max_size // 2))
        cut, level = 0, "hard"
        for name, marks in zip(LEVELS, levels, strict=False):
            k = bisect_right(marks, furthest) - 1
            if k >= 0 and marks[k] > least:
                cut, level = marks[k], name
                break
        if not cut:
            k = bisect_right(merged, furthest) - 1
            if k >= 0 and merged[k] > done:
                cut, level = merged[k], "word"
            else:
                cut = max(furthest, done + 1, start + 1)
                while cut > max(done, start) + 1 and unicodedata.combining(text[cut]):
                    cut -= 1
        out.append((start, cut, level))
        done = cut
        if not overlap:
            start = cut
            continue
        want = bisect_left(size, size[cut] - overlap)
        k = bisect_left(merged, want)
        near = [m for m in merged[max(0, k - 1) : k + 1] if start < m <= cut and abs(m - want) * 4 <= max(cut - want, 4)]
        after = min(near, key=lambda m: (abs(m - want), m)) if near else max(want, start + 1)
        # A start far before the last cut must still let the next piece reach beyond it.
        while size[cut + 1] - size[after] > max_size:
            after += 1
        start = after


def token_prefix(encode_offsets: Callable[[str], list[int]]) -> Callable[[str], list[int]]:
    """From a tokenizer's end offsets to prefix sums: tokens that touch ``text[:i]``."""

    def run(text: str) -> list[int]:
        ends = encode_offsets(text)
        prefix, k = [0] * (len(text) + 1), 0
        for i in range(1, len(text) + 1):
            while k < len(ends) and ends[k] < i:
                k += 1
            prefix[i] = min(k + 1, len(ends))
        return prefix

    return run


def split_items(items: DataFrame, limits: DataFrame, only_oversized: bool = True, with_text: bool = True, measure: Callable[[str], list[int]] | None = None) -> DataFrame:
    """(item_kind, item_id, text, starts array<int>) and size_limits to one row per piece.

    Columns: item_kind, item_id, piece, n_pieces, start_offset, end_offset, cut, content. Items of one id are taken
    once if their texts are equal. Items with null text or without a limit of their kind give no rows. ``limits`` has one
    row per kind; ``measure`` gives the size prefix for the unit ``tokens``.
    """
    limit = limits.where("max_size is not null").groupBy("item_kind").agg(F.max(F.struct("max_size", "overlap_size", "unit")).alias("l")).select("item_kind", "l.*")
    joined = items.where("text is not null and item_id is not null").select("item_kind", F.col("item_id").cast("string").alias("item_id"), "text", "starts").join(F.broadcast(limit), "item_kind")
    if only_oversized:
        joined = joined.where((F.col("unit") != "code_points") | (F.length("text") > F.col("max_size")))
    joined = joined.select("item_kind", "item_id", "text", "starts", "max_size", F.coalesce("overlap_size", F.lit(0)).alias("overlap"), "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item_kind", "item_id", "piece", "n_pieces", "start_offset", "end_offset", "cut", "content"]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for kind, item, text, starts, most, overlap, unit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = pieces(text, most, overlap, starts, measure(text) if unit == "tokens" and measure else None)
                if only_oversized and len(spans) < 2:
                    continue
                for k, (start, end, cut) in enumerate(spans):
                    for column, value in zip(columns, (kind, item, k, len(spans), start, end, cut, text[start:end] if with_text else None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "item_kind string, item_id string, piece int, n_pieces int, start_offset int, end_offset int, cut string, content string"
    return joined.mapInArrow(run, schema)


def items_of(documents: DataFrame, article_chunks: DataFrame) -> DataFrame:
    """Documents and article chunks as items; block starts come from ``structure``."""
    docs = documents.select(F.lit("document").alias("item_kind"), F.col("doc_id").cast("string").alias("item_id"), "text", F.transform("structure", lambda b: b["start_offset"]).alias("starts"))
    none = F.lit(None).cast("array<int>").alias("starts")
    chunks = article_chunks.select(F.lit("article_chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.col("content").alias("text"), none)
    return docs.unionByName(chunks)
