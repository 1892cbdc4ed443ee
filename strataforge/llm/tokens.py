"""Token counts with a public tokenizer's vocabulary file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.functions.tokenizer import FILE, FOLDER, encoding


def token_ends(text: str, folder: str = FOLDER, file: str = FILE, ids: list[int] | None = None) -> list[int]:
    """For each token the code-point offset at which it is complete; ``ids`` are the text's tokens where they are known."""
    encoder = encoding(folder, file)
    raw = b"".join(tokens := [encoder.decode_single_token_bytes(t) for t in ids or encoder.encode_ordinary(text)])
    chars, at, ends = 0, 0, []
    for token in tokens:
        at += len(token)
        chars += sum((b & 0xC0) != 0x80 for b in token)
        whole = at >= len(raw) or (raw[at] & 0xC0) != 0x80
        ends.append(chars if whole else chars - 1)
    return ends


def token_prefix(text: str, folder: str = FOLDER, file: str = FILE, ids: list[int] | None = None) -> list[int]:
    """Prefix sums: tokens begun in ``text[:i]`` for i in 0..len(text), not decreasing."""
    prefix, last = [0] * (len(text) + 1), 0
    for k, end in enumerate(token_ends(text, folder, file, ids), start=1):
        for i in range(last + 1, end + 1):
            prefix[i] = k
        last = max(last, end)
    for i in range(1, len(prefix)):
        prefix[i] = max(prefix[i], prefix[i - 1])
    return prefix


def with_counts(rows: DataFrame, text: str, extra: Callable[[str], int] | None = None, folder: str = FOLDER, file: str = FILE) -> DataFrame:
    """Replace the column ``text`` by ``tokens`` (bigint), tokens of the whole text; null counts 0.

    ``extra``: a function of the text whose part's tokens are counted as well, in the column ``extra_tokens``: it returns the
    code-point offset at which that part ends.
    """
    others = [c for c in rows.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others).schema)
    schema += ", tokens bigint" + (", extra_tokens bigint" if extra else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(folder, file)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(others)).to_pylist()]
            arrays = list(batch.columns[: len(others)]) + [pa.array([len(encoder.encode_ordinary(t)) for t in texts], pa.int64())]
            names = [*others, "tokens"]
            if extra:
                arrays.append(pa.array([len(encoder.encode_ordinary(t[: extra(t)])) for t in texts], pa.int64()))
                names.append("extra_tokens")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.select(*others, F.col(text)).mapInArrow(run, schema)
