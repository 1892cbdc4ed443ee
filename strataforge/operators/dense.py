"""Exact cosine search and the vector store."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.operators.lexical import top
from strataforge.session import written

#: Query vectors that one scan of the store carries; larger sets are searched in blocks.
BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector, null for null or vectors of different sizes."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(F.size(a) != F.size(b), None).when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, ident: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(query_id, channel, chunk_id, score, rank): the k nearest vectors of every query, exactly.

    queries(query_id, embedding) is a stated set with distinct ids, taken in blocks of ``BLOCK`` vectors that every task holds while it
    streams over its vectors and keeps the best k of each query; k rows per query and task are merged. Scores are rounded to nine places before
    ties go to the smaller id. Vectors of another size than the query's, null and zero vectors are left out.
    """
    if k <= 0:
        return queries.select("query_id", F.lit("dense").alias("channel"), F.lit("").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
    spark = vectors.sparkSession
    store = vectors.where(F.col(ident).isNotNull() & F.col(vector).isNotNull()).select(F.col(ident).cast("string"), F.col(vector).cast("array<double>"))
    wanted = queries.where("query_id is not null and embedding is not null").select(F.col("query_id").cast("string"), "embedding")

    def nearest(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([b[0] for b in block], [np.array(b[1], float) for b in block]))
        return top(store.mapInArrow(_nearest(shared, k), "query_id string, chunk_id string, score double"), k)

    out: DataFrame | None = None
    block: list = []
    for row in wanted.toLocalIterator():  # the driver holds one block at a time
        block.append((row[0], row[1]))
        if len(block) == BLOCK:
            done = written(nearest(block), "nearest")
            out, block = (done if out is None else out.unionByName(done)), []
    if block or out is None:
        last = nearest(block)
        out = last if out is None else out.unionByName(last)
    return out.select("query_id", F.lit("dense").alias("channel"), "chunk_id", "score", "rank")


def _nearest(shared, k: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), object)
            values = batch.column(1)
            sizes = np.asarray(values.value_lengths())
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                asked = [i for i, q in enumerate(wanted) if len(q) == size]
                if not asked or not size:
                    continue
                matrix = np.array([values[int(r)].as_py() for r in rows], float)
                norms = np.linalg.norm(matrix, axis=1)
                rows, matrix, norms = rows[norms > 0], matrix[norms > 0], norms[norms > 0]
                query = np.stack([wanted[i] for i in asked])
                length = np.linalg.norm(query, axis=1)
                length[length == 0] = np.inf
                similar = np.round((query @ matrix.T) / length[:, None] / norms[None, :], 9)
                for line, i in zip(similar, asked, strict=True):
                    old = best.get(i)
                    s = line if old is None else np.concatenate([old[0], line])
                    n = ids[rows] if old is None else np.concatenate([old[1], ids[rows]])
                    if len(s) > k:
                        edge = np.partition(s, len(s) - k)[len(s) - k]
                        keep = np.flatnonzero(s >= edge)
                        keep = keep[np.lexsort((n[keep].astype(str), -s[keep]))[:k]]
                        s, n = s[keep], n[keep]
                    best[i] = (s, n)
        for i, (s, n) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(s)), pa.array(n.tolist(), pa.string()), pa.array(s)], ["query_id", "chunk_id", "score"])

    return run


def upsert(store: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The store with rows replaced or added by key."""
    return store.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.dropDuplicates([key]), allowMissingColumns=True)


def delete(store: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """The store without the rows of the given documents."""
    return store.join(documents.select(key).distinct(), key, "left_anti")


def unseen(rows: DataFrame, store: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows whose key the store does not hold yet."""
    return rows.join(store.select(key).distinct(), key, "left_anti")


def checked(rows: DataFrame, size: int, vector: str = "embedding") -> DataFrame:
    """Rows unchanged; fails at run time when a vector has another size."""
    ok = F.col(vector).isNotNull() & (F.size(vector) == size)
    return rows.withColumn(vector, F.when(ok, F.col(vector)).otherwise(F.raise_error(F.lit(f"expected vectors of {size} values"))))


def hashed_embedding(text: Column, size: int = 384) -> Column:
    """A deterministic bag-of-tokens vector of unit length, for use without a model. Blank texts give the zero vector."""

    @F.pandas_udf("array<float>")
    def embed(values: pd.Series) -> pd.Series:
        def one(value: str | None) -> list[float]:
            out = np.zeros(size)
            for word in (value or "").lower().split():
                h = zlib.crc32(word.encode())
                out[h % size] += 1.0 if h & 0x80000000 else -1.0
            norm = np.linalg.norm(out)
            return (out / norm if norm else out).astype(np.float32).tolist()

        return values.map(one)

    return embed(text)
