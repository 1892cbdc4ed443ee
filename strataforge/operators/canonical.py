"""Canonical documents and chunks of code files and articles, with invariants checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions import ids

PROVENANCE = "struct<source_uri:string,repository:string,branch:string,commit_sha:string,path:string,page:int,section:string,symbol:string,line_start:int,line_end:int,extra:map<string,string>>"


def provenance(**parts: Column) -> Column:
    """The provenance structure; absent parts are null, extra an empty map."""
    names = {"page": "int", "line_start": "int", "line_end": "int"}
    fields = ["source_uri", "repository", "branch", "commit_sha", "path", "page", "section", "symbol", "line_start", "line_end"]
    columns = [parts.get(f, F.lit(None)).cast(names.get(f, "string")).alias(f) for f in fields]
    extra = parts.get("extra", F.create_map().cast("map<string,string>"))
    return F.struct(*columns, extra.alias("extra"))


def code_documents(files: DataFrame) -> DataFrame:
    """(document_id, source_type, title, source_uri, content, metadata, provenance) of code files with repository, ref and commit."""
    document_id = ids.code_document_id(F.col("relative_path"), F.col("content_hash"))
    meta = F.map_filter(F.create_map(*[x for n in ("language", "relative_path", "content_hash") for x in (F.lit(n), F.col(n).cast("string"))]), lambda _, v: v.isNotNull())
    uri = F.concat(F.lit("repo://"), F.col("repository"))
    place = provenance(source_uri=uri, repository=F.col("repository"), commit_sha=F.col("commit_sha"), path=F.col("relative_path"))
    return files.select(document_id.alias("document_id"), F.lit("code").alias("source_type"), F.col("relative_path").alias("title"), uri.alias("source_uri"), "content", meta.alias("metadata"), place.alias("provenance"))


def code_location(path: Column, first: Column, last: Column, part: Column) -> Column:
    """path:lines:a-b, with :part:p for all but the first part."""
    base = F.concat(path, F.lit(":lines:"), first.cast("string"), F.lit("-"), last.cast("string"))
    return F.when(part > 0, F.concat(base, F.lit(":part:"), part.cast("string"))).otherwise(base)


def article_documents(articles: DataFrame) -> DataFrame:
    """One row per article: (document_id, source_type, title, source_uri, content, content_hash, metadata)."""
    present = ["article_id", "author", "published_at", "updated_at", "description", "series", "slug", "publication_host"]
    meta = F.map_filter(F.create_map(*[x for n in present for x in (F.lit(n), F.col(n).cast("string"))]), lambda _, v: v.isNotNull())
    rows = articles.where("source_uri is not null and content is not null")
    return rows.select(ids.article_document_id(F.col("source_uri"), F.col("content")).alias("document_id"), F.lit("article").alias("source_type"), "title", "source_uri", "content", F.sha2("content", 256).alias("content_hash"), meta.alias("metadata"))


def broken_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, problem): chunks that break an invariant, one row per problem, for quarantine.

    unknown document, wrong source_uri or source_type, content_hash that is not the content's, empty content, and ids that are missing.
    """
    docs = documents.select("document_id", F.col("source_uri").alias("d_uri"), F.col("source_type").alias("d_type"), F.lit(True).alias("known")).dropDuplicates(["document_id"])
    joined = chunks.join(docs, "document_id", "left")
    checks = {
        "unknown document": F.col("known").isNull(),
        "other source_uri": F.col("known") & ~F.col("source_uri").eqNullSafe(F.col("d_uri")),
        "other source_type": F.col("known") & ~F.col("source_type").eqNullSafe(F.col("d_type")),
        "wrong content_hash": F.col("content_hash").isNotNull() & (F.lower("content_hash") != F.sha2("content", 256)),
        "no content_hash": F.col("content_hash").isNull(),
        "empty content": F.coalesce(F.trim("content"), F.lit("")) == "",
        "no chunk_id": F.col("chunk_id").isNull(),
    }
    problems = F.filter(F.array(*[F.when(condition, F.lit(name)) for name, condition in checks.items()]), lambda p: p.isNotNull())
    return joined.select("chunk_id", F.explode(problems).alias("problem"))


def merged_metadata(*maps: Column) -> Column:
    """Maps merged, later keys win (needs spark.sql.mapKeyDedupPolicy=LAST_WIN); null maps count as empty."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_concat(*[F.coalesce(m, empty) for m in maps])
