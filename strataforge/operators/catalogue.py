"""Documents, sources and chunks as a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions import ids
from strataforge.functions.text import first_filled


class ChunksNotFound(LookupError):
    """Some requested chunks do not exist; ``ids`` are theirs, sorted and distinct."""

    def __init__(self, missing: list[str]) -> None:
        super().__init__("unknown chunks: " + ", ".join(missing))
        self.ids = missing


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, that of the highest version; of several rows with that version one is kept. Rows without key are left out.

    Select what is needed first: all columns given are carried along.
    """
    others = [c for c in rows.columns if c not in (key, version)]
    packed = F.max_by(F.struct(*others), F.col(version)) if others else None
    out = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(version).alias(version), *([packed.alias("_r")] if others else []))
    return out.select(key, *[F.col(f"_r.{c}").alias(c) for c in others], version).select(*rows.columns)


def missing(requested: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct requested ids that do not exist."""
    return requested.select("chunk_id").distinct().join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")


def retrieve(requested: DataFrame, chunks: DataFrame, check: bool = True) -> DataFrame:
    """requested(position, chunk_id) with the chunks' columns, in that order and with repetitions.

    With ``check`` all ids must exist, else ChunksNotFound names up to 1,000 that do not.
    """
    if check and (lost := [r[0] for r in missing(requested, chunks).orderBy("chunk_id").limit(1000).collect()]):
        raise ChunksNotFound(lost)
    return requested.select("position", "chunk_id").join(chunks.dropDuplicates(["chunk_id"]), "chunk_id")


def documents_from_chunks(chunks: DataFrame) -> DataFrame:
    """One row per document, described by its chunk with the lowest id: document_id, source_type, source_uri, title, chunks."""
    meta = F.col("metadata")
    title = first_filled(meta["title"], meta["filename"], meta["relative_path"], F.col("provenance.path"), F.col("source_uri"))
    described = chunks.where("document_id is not null").select("document_id", "chunk_id", "source_type", "source_uri", title.alias("title"))
    first = F.min(F.struct("chunk_id", "source_type", "source_uri", "title"))
    return described.groupBy("document_id").agg(first.alias("f"), F.countDistinct("chunk_id").alias("chunks")).select("document_id", "f.source_type", "f.source_uri", "f.title", "chunks")


def page(documents: DataFrame, limit: int = 100, offset: int = 0, source_type: str | None = None, order: str = "document_id") -> DataFrame:
    """One page in the given order. Raises ValueError for a limit outside 1..1000 or a negative offset."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1..1000 and offset not negative")
    chosen = documents if source_type is None else documents.where(F.col("source_type") == source_type)
    return chosen.orderBy(order).offset(offset).limit(limit)


def sources(chunks: DataFrame) -> DataFrame:
    """One row per source: source_id, source_type, source_uri, repository, project, documents."""
    project = F.coalesce(F.col("metadata")["project"], F.col("project"))
    named = chunks.select("document_id", "source_type", "source_uri", F.col("provenance.repository").alias("repository"), project.alias("project"))
    grouped = named.groupBy("source_type", "source_uri", "repository", "project").agg(F.countDistinct("document_id").alias("documents"))
    return grouped.select(ids.source_id(F.col("source_type"), F.col("source_uri"), F.col("repository"), F.col("project")).alias("source_id"), "source_type", "source_uri", "repository", "project", "documents")


def changes(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): NEW, MODIFIED, UNCHANGED or DELETED between two snapshots with one row per key."""
    a = old.select(key, F.sha2(content, 256).alias("a"), F.lit(True).alias("in_a"))
    b = new.select(key, F.sha2(content, 256).alias("b"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "NEW").when(F.col("in_b").isNull(), "DELETED").when(F.col("a").eqNullSafe(F.col("b")), "UNCHANGED").otherwise("MODIFIED")
    return a.join(b, key, "full").select(key, change.alias("change"))


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by an explicit order column."""
    place = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")
