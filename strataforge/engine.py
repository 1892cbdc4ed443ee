"""A facade over the operators: ingest, search, retrieve, catalogue and evaluate, on tables below one folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.operators import catalogue, chunking, code, dense, evaluation, fusion, lexical, pipeline
from strataforge.session import tune
from strataforge.sources import files, urls


class EngineNotReady(RuntimeError):
    """Nothing has been ingested yet."""


_CHUNK = ["document_id", "chunk_id", "content", "source_type", "source_uri", "language", "content_role", "structural_type", "location", "content_hash"]


class Engine:
    """Chunks and vectors are Parquet tables below ``root``; a new state is written beside the old one and published last.

    ``embed`` turns a text column into a vector column; ``extract_pages`` gives the pages of a paged file's bytes; ``fetch_article`` gives the
    Markdown behind an endpoint. Without them a deterministic embedding is used and the sources that need the others fail.
    """

    def __init__(self, spark: SparkSession, root: str, embed: Callable = dense.hashed_embedding, extract_pages: Callable[[bytes], list[str]] | None = None, fetch_article: Callable[[str], str] | None = None) -> None:
        self.spark, self.root, self.embed = tune(spark), root.rstrip("/"), embed
        self.extract_pages, self.fetch_article = extract_pages, fetch_article
        self.version = 0

    # State

    def health(self) -> dict[str, str]:
        from strataforge import __version__

        return {"status": "ok" if self.version else "empty", "version": __version__}

    def _read(self, name: str) -> DataFrame:
        if not self.version:
            raise EngineNotReady("nothing has been ingested")
        return self.spark.read.parquet(f"{self.root}/{name}/v{self.version}")

    @property
    def chunks(self) -> DataFrame:
        return self._read("chunks")

    @property
    def vectors(self) -> DataFrame:
        return self._read("vectors")

    # Ingestion

    def ingest(self, source: str, source_type: str | None = None) -> int:
        """Take in a file, folder, archive, repository or article; gives the number of new chunks.

        The kind is told by address or suffix, or by source_type (markdown, pdf, code). Known chunk ids are skipped. Raises IngestionError.
        """
        new = self.read_source(source, source_type).select(*_CHUNK).dropDuplicates(["chunk_id"])
        return self.add_chunks(new)

    def add_chunks(self, new: DataFrame) -> int:
        """Append chunks with unseen ids: vectors and chunks are written first, then the version is published."""
        if self.version:
            new = dense.unseen(new, self.chunks)
        after = self.version + 1
        rows = new if not self.version else self.chunks.unionByName(new)
        rows.write.mode("overwrite").parquet(f"{self.root}/chunks/v{after}")
        fresh = self.spark.read.parquet(f"{self.root}/chunks/v{after}")
        todo = fresh if not self.version else dense.unseen(fresh, self.vectors)
        vectors = todo.select("chunk_id", "document_id", self.embed(F.col("content")).alias("embedding"))
        (vectors if not self.version else self.vectors.unionByName(vectors)).write.mode("overwrite").parquet(f"{self.root}/vectors/v{after}")
        before = self.chunks.count() if self.version else 0
        self.version = after
        return fresh.count() - before

    def read_source(self, source: str, source_type: str | None = None) -> DataFrame:
        """Chunks of one source, not stored."""
        kind = self.spark.range(1).select(urls.kind(F.lit(source))).first()[0]
        if source_type is not None:
            if source_type not in ("markdown", "pdf", "code"):
                raise ValueError(f"unknown source_type {source_type!r}")
            kind = {"markdown": "markdown", "pdf": "pages", "code": "archive" if source.lower().endswith(".zip") else "tree"}[source_type]
        if kind is None and os.path.isdir(source):
            kind = "repository" if os.path.isdir(os.path.join(source, ".git")) else "tree"
        readers = {"markdown": self._markdown, "pages": self._pages, "archive": self._archive, "tree": self._tree, "repository": self._repository, "article": self._article}
        if kind not in readers:
            raise files.IngestionError(f"cannot tell what {source} is")
        return readers[kind](source)

    def _described(self, chunks: DataFrame, documents: DataFrame, source_type: str) -> DataFrame:
        uris = documents.select("document_id", "source_uri").dropDuplicates(["document_id"])
        return chunks.join(uris, "document_id").withColumn("source_type", F.lit(source_type)).withColumn("language", F.lit(None).cast("string")).select(*_CHUNK)

    def _markdown(self, source: str) -> DataFrame:
        documents = files.markdown_files(self.spark, source)
        return self._described(chunking.chunk_documents(documents, "markdown", "document_id", "content"), documents, "markdown")

    def _pages(self, source: str) -> DataFrame:
        if self.extract_pages is None:
            raise files.IngestionError("paged files need extract_pages")
        pages = files.page_files(self.spark, source, self.extract_pages)
        chunks = chunking.chunk_pages(pages).withColumn("location", F.concat(F.lit("page:"), F.col("page").cast("string")))
        chunks = chunks.withColumn("content_role", F.lit("documentation")).withColumn("structural_type", F.lit("page"))
        return self._described(chunks, pages.select("document_id", F.lit(source).alias("source_uri")), "pdf")

    def _code(self, rows: DataFrame, source_type: str, uri: str) -> DataFrame:
        from strataforge.functions import ids

        accepted = rows.where("status = 'accepted'")
        chunks = code.chunk_code(accepted)
        owner = accepted.select("relative_path", F.lit(uri).alias("source_uri"), "language", ids.code_document_id(F.col("relative_path"), F.col("content_hash")).alias("document_id"))
        from strataforge.operators.canonical import code_location

        place = code_location(F.col("relative_path"), F.col("start_line"), F.col("end_line"), F.col("part_index"))
        joined = chunks.drop("content_role").join(owner, "relative_path")
        return joined.select("document_id", "chunk_id", "content", F.lit(source_type).alias("source_type"), "source_uri", "language", F.lit(None).cast("string").alias("content_role"), F.col("symbol_type").alias("structural_type"), place.alias("location"), "content_hash")

    def _tree(self, source: str) -> DataFrame:
        return self._code(files.code_tree(self.spark, source), "code", source)

    def _archive(self, source: str) -> DataFrame:
        rows = files.archive_members(self.spark, source)
        if bad := rows.where("error is not null").select("error").first():
            raise files.IngestionError(bad[0])
        return self._code(rows, "code", source)

    def _repository(self, source: str) -> DataFrame:
        target = os.path.join(tempfile.mkdtemp(prefix="strataforge-clone-"), "tree")
        files.clone(source, target)
        return self._code(files.code_tree(self.spark, target), "github", source)

    def _article(self, source: str) -> DataFrame:
        if self.fetch_article is None:
            raise files.IngestionError("articles need fetch_article")
        endpoint = self.spark.range(1).select(urls.article_endpoint(F.lit(source))).first()[0]
        rows = self.spark.createDataFrame([(source, self.fetch_article(endpoint))], "source_uri string, content string")
        chunks = chunking.chunk_documents(rows, "article", "source_uri", "content")
        return self._described(chunks, chunks.select("document_id", F.lit(source).alias("source_uri")), "article")

    # Retrieval

    def search(self, queries: DataFrame, top_k: int = 20, metadata: dict[str, list[str] | None] | None = None, trace: bool = False) -> DataFrame:
        """queries(query_id, question) to ranked chunks: both channels, fusion, filters, the first top_k. With trace all stages."""
        if top_k <= 0:
            raise ValueError("top_k must be positive")
        chunks = self._full(self.chunks)
        sparse = lexical.search(lexical.build_index(chunks), queries, top_k)
        asked = queries.select("query_id", self.embed(F.col("question")).alias("embedding"))
        near = dense.search(self.vectors, asked, top_k)
        stages = pipeline.run(near, sparse, chunks, top_k, top_k, top_k, metadata=metadata)
        return pipeline.trace(stages) if trace else stages["final"]

    def _full(self, chunks: DataFrame) -> DataFrame:
        """Chunks with the columns that filters read."""
        from strataforge.operators.canonical import provenance

        text = F.lit(None).cast("string")
        empty = F.create_map().cast("map<string,string>")
        return chunks.select("*", *[text.alias(c) for c in ("project", "timestamp", "parent_structure")], empty.alias("metadata"), provenance(source_uri=F.col("source_uri")).alias("provenance"))

    def retrieve(self, chunk_ids: list[str]) -> DataFrame:
        """The chunks of the ids in their order, with repetitions; raises ChunksNotFound if one is unknown."""
        asked = self.spark.createDataFrame(list(enumerate(chunk_ids)), "position int, chunk_id string")
        return catalogue.retrieve(asked, self.chunks).orderBy("position")

    def documents(self, limit: int = 100, offset: int = 0, source_type: str | None = None) -> DataFrame:
        return catalogue.page(catalogue.documents_from_chunks(self._full(self.chunks)), limit, offset, source_type)

    def sources(self) -> DataFrame:
        return catalogue.sources(self._full(self.chunks))

    def evaluate(self, questions: DataFrame, gold: DataFrame, mode: str = "hybrid", top_k: int = 20) -> DataFrame:
        """Measures per question of the mode bm25, dense or hybrid. Gold that the corpus lacks raises ValueError first."""
        evaluation.require_gold(gold, self.chunks)
        chunks = self._full(self.chunks)
        asked = questions.select("query_id", "question")
        sparse = lexical.search(lexical.build_index(chunks), asked, top_k)
        near = dense.search(self.vectors, asked.select("query_id", self.embed(F.col("question")).alias("embedding")), top_k)
        lists = {"bm25": sparse, "dense": near}
        if mode not in (*lists, "hybrid"):
            raise ValueError(f"unknown mode {mode!r}")
        return evaluation.per_query(lists.get(mode) if mode in lists else fusion.hybrid(near, sparse, top_k, top_k), questions, gold)
