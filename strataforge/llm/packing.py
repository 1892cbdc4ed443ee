"""Problem 8: fill fixed-capacity containers, by vector bin packing with the dot-product heuristic.

Every segment (a document, or a piece of one that exceeds a container) is a vector of tokens, one segment and
loss-bearing tokens. A container is filled with the fitting segment whose vector, scaled by the limits, has the
largest dot product with the room left, until nothing fits. Segments are packed in shards of a few
thousand, one task per shard; what lies in containers that stayed under ``GOOD`` is packed again across shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.split import pieces
from strataforge.llm.tokens import FILE, FOLDER, encoding, token_prefix
from strataforge.session import written

SHARD = 4096
GOOD = 0.97
SEGMENTS = 32
#: Share of a container's tokens that may bear loss, a little above the share that documents have on average.
LOSS_SHARE = 31 / 32
#: Tasks of a round; beyond as many shards a task packs several.
TASKS = 10_000


def prompt_end(text: str) -> int:
    """Where the part that bears no loss ends: after the first paragraph, if another follows; else at 0."""
    at = text.find("\n\n")
    return at + 2 if 0 < at < len(text) - 2 else 0


def cut_to_fit(text: str, capacity: int, folder: str, file: str, ids: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of pieces of at most ``capacity`` tokens each, joined without gap or overlap."""
    encoder = encoding(folder, file)
    prefix = token_prefix(text, folder, file, ids)
    limit = capacity
    while True:
        spans = [(a, b, len(encoder.encode_ordinary(text[a:b]))) for a, b, _ in pieces(text, limit, 0, None, prefix)]
        if all(n <= capacity for _, _, n in spans) or limit == 1:
            return spans
        limit = max(1, limit - max(1, capacity // 64))  # a cut may add tokens at its edges


def segments(documents: DataFrame, capacity: int, ident: str = "doc_id", text: str = "text", folder: str = FOLDER, file: str = FILE) -> DataFrame:
    """(item_id, piece, start_offset, end_offset, tokens, loss): one row per document, or per piece of an oversized one.

    Null ids are left out; a null or empty text has no token and is no segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(folder, file)
        names = ["item_id", "piece", "start_offset", "end_offset", "tokens", "loss"]
        for batch in batches:
            rows: list[tuple] = []
            for item, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, prompt = encoder.encode_ordinary(value), prompt_end(value)
                spans = [(0, len(value), len(ids))] if len(ids) <= capacity else cut_to_fit(value, capacity, folder, file, ids)
                for k, (start, end, tokens) in enumerate(spans):
                    free = value[start : min(prompt, end)] if prompt > start else ""
                    rows.append((item, k, start, end, tokens, max(0, tokens - len(encoder.encode_ordinary(free)))))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    source = documents.select(F.col(ident).cast("bigint").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and length(t) > 0")
    return source.mapInArrow(run, "item_id bigint, piece int, start_offset int, end_offset int, tokens int, loss int")


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item (rows of ``sizes``), by the dot-product heuristic.

    An item over a limit by itself gets a container of its own. Equal vectors are one kind with a stock, so a step costs
    one product over the kinds.
    """
    kinds, kind_of = np.unique(sizes, axis=0, return_inverse=True)
    kind_of = kind_of.reshape(-1)
    kinds = kinds[::-1]
    kind_of = len(kinds) - 1 - kind_of
    stock = np.bincount(kind_of, minlength=len(kinds))
    queue = np.argsort(kind_of, kind="stable")
    next_of = np.concatenate([[0], np.cumsum(stock)[:-1]])
    scaled = kinds / limits
    out = np.empty(len(sizes), np.int64)
    bin_, left, free = 0, len(sizes), limits.astype(float).copy()
    alive = np.arange(len(kinds))
    empty = True
    while left:
        fits = alive[(kinds[alive] <= free).all(axis=1)]
        if empty and not len(fits):
            fits = alive[:1]
        if not len(fits):
            bin_, free, empty = bin_ + 1, limits.astype(float).copy(), True
            alive = alive[stock[alive] > 0]
            continue
        best = fits[np.argmax(scaled[fits] @ (free / limits))]
        out[queue[next_of[best]]] = bin_
        next_of[best] += 1
        stock[best] -= 1
        left -= 1
        free = free - kinds[best]
        empty = False
        if not stock[best]:
            alive = alive[alive != best]
    return out


def _round(items: DataFrame, limits: list[int], label: int, shard: int) -> DataFrame:
    shards = max(1, round(items.count() / shard))
    tasks = min(shards, TASKS)
    bounds = np.array(limits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        for key, rows in pd.concat(frames).groupby("shard") if frames else ():
            rows = rows.sort_values(["item_id", "piece"], kind="stable").drop(columns="shard")
            number = pack(np.stack([rows.tokens.to_numpy(), np.ones(len(rows), np.int64), rows.loss.to_numpy()], axis=1), bounds)
            rows["container"] = [f"{label}-{key}-{k}" for k in number]
            rows["filled"] = rows.groupby("container").tokens.transform("sum")
            yield rows

    sharded = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "piece"), F.lit(shards)).cast("int")).repartitionById(tasks, (F.col("shard") % tasks).cast("int"))
    return sharded.mapInPandas(run, "item_id bigint, piece int, start_offset int, end_offset int, tokens int, loss int, container string, filled bigint")


def containers(documents: DataFrame, capacity: int, max_segments: int = SEGMENTS, max_loss: int | None = None, ident: str = "doc_id", text: str = "text", folder: str = FOLDER, file: str = FILE, shard: int = SHARD) -> DataFrame:
    """(container, item_id, piece, start_offset, end_offset, tokens, loss): every segment in one container.

    No container exceeds ``capacity`` tokens, ``max_segments`` segments or ``max_loss`` loss-bearing tokens (default:
    ``LOSS_SHARE`` of the capacity), save a single segment whose own loss exceeds ``max_loss``. A repeated row is packed each time it occurs.
    """
    limits = [capacity, max_segments, max_loss or int(capacity * LOSS_SHARE)]
    first = written(_round(written(segments(documents, capacity, ident, text, folder, file), "segments"), limits, 0, shard), "packed")
    done = first.where(F.col("filled") >= GOOD * capacity)
    again = first.where(F.col("filled") < GOOD * capacity).select("item_id", "piece", "start_offset", "end_offset", "tokens", "loss")
    columns = ["container", "item_id", "piece", "start_offset", "end_offset", "tokens", "loss"]
    return done.select(*columns).unionByName(_round(again, limits, 1, shard).select(*columns))
