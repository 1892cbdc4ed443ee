"""Readers of files, archives and datasets, and the report sink."""

from __future__ import annotations

import io
import json
import os
import subprocess
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.sources import discovery

# Limits of an archive.
MAX_TOTAL, MAX_FILES, MAX_MEMBER = 100 * 1024 * 1024, 10_000, 10 * 1024 * 1024
# Fixed value: seconds that a clone may take.
CLONE_TIMEOUT = 120


class IngestionError(ValueError):
    """A source that cannot be taken in."""


def binary(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def decoded(content) -> F.Column:  # noqa: ANN001
    """UTF-8 text without a byte-order mark; null where the bytes are not valid."""
    return F.regexp_replace(F.try_validate_utf8(content), "^\ufeff", "")


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, source_type, title, source_uri, content, metadata) of .md and .markdown files below a path."""
    rows = binary(spark, path).where(F.lower("path").rlike(r"\.(md|markdown)$"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    meta = F.create_map(F.lit("filename"), name, F.lit("path"), F.col("path"), F.lit("source_type"), F.lit("markdown"))
    return rows.select(F.sha2("content", 256).alias("document_id"), F.lit("markdown").alias("source_type"), F.regexp_replace(name, r"\.[^.]+$", "").alias("title"), F.col("path").alias("source_uri"), decoded(F.col("content")).alias("content"), meta.alias("metadata"))


def page_files(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(document_id, page, text, section) of paged files; ``extract`` gives the text of each page of a file's bytes.

    Pages count from 1, blank ones are skipped; the section is the first line that is not blank, cut at 80.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, k, text) for key, data in zip(batch.document_id, batch.content, strict=True) for k, text in enumerate(extract(bytes(data)), 1) if text.strip()]
            yield pd.DataFrame({"document_id": [r[0] for r in rows], "page": pd.Series([r[1] for r in rows], dtype="int32"), "text": [r[2] for r in rows]})

    rows = binary(spark, path).select(F.sha2("content", 256).alias("document_id"), "content").mapInPandas(run, "document_id string, page int, text string")
    return pages_with_sections(rows)


def pages_with_sections(pages: DataFrame) -> DataFrame:
    """Adds the section of each page and drops blank pages."""
    lines = F.filter(F.transform(F.split("text", r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    return pages.where(F.trim("text") != "").withColumn("section", F.substring(F.try_element_at(lines, F.lit(1)), 1, 80))


def code_tree(spark: SparkSession, path: str, most: int = discovery.MAX_BYTES) -> DataFrame:
    """(path, relative_path, language, content, size, content_hash, status) of all files below a folder, or of one file.

    Content is decoded for accepted files only; other rows say why they were not.
    """
    rows = binary(spark, path)
    root = "file:" + os.path.realpath(path) if "://" not in path and not path.startswith("file:") else path
    base = root if not os.path.isfile(path) else os.path.dirname(root)
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "file:/"), "^" + base.replace(".", "[.]").rstrip("/") + "/", "")
    state = discovery.status(relative, F.col("length"), F.is_valid_utf8("content"), most)
    text = F.when(state == "accepted", decoded(F.col("content")))
    return rows.select("path", relative.alias("relative_path"), discovery.language(relative).alias("language"), text.alias("content"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), state.alias("status"))


def _members(data: bytes, limits: tuple[int, int, int]) -> list[tuple[str, bytes]]:
    total, files, each = limits
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        entries = [e for e in archive.infolist() if not e.is_dir()]
        if len(entries) > files:
            raise IngestionError(f"more than {files} members")
        names: dict[str, zipfile.ZipInfo] = {}
        for entry in entries:
            name = entry.filename.replace("\\", "/")
            parts = [p for p in name.split("/") if p not in ("", ".")]
            if not parts or "\0" in name or name.startswith("/") or name[1:3] == ":/" or ".." in parts:
                raise IngestionError(f"unsafe member {entry.filename!r}")
            if entry.flag_bits & 1:
                raise IngestionError(f"encrypted member {name!r}")
            if (entry.external_attr >> 16) & 0o170000 == 0o120000:
                raise IngestionError(f"linked member {name!r}")
            if entry.file_size > each:
                raise IngestionError(f"member {name!r} is too large")
            names["/".join(parts)] = entry  # of equal names the last wins
        if sum(e.file_size for e in entries) > total:
            raise IngestionError("the archive is too large")
        out, read = [], 0
        for name, entry in names.items():
            with archive.open(entry) as member:
                content = member.read(each + 1)  # what a header declares is not trusted
            read += len(content)
            if len(content) > each or read > total:
                raise IngestionError(f"member {name!r} is larger than declared")
            out.append((name, content))
        return out


def archive_members(spark: SparkSession, path: str, total: int = MAX_TOTAL, files: int = MAX_FILES, each: int = MAX_MEMBER) -> DataFrame:
    """(archive, relative_path, content, size, content_hash, language, status, error) of the members of zip archives.

    Members are read in memory, nothing is extracted. An archive with one bad member gives one row with its error and no members.
    """
    if min(total, files, each) <= 0:
        raise ValueError("limits must be positive")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for name, data in zip(batch.path, batch.content, strict=True):
                try:
                    rows += [(name, member, content, None) for member, content in _members(bytes(data), (total, files, each))]
                except (IngestionError, zipfile.BadZipFile, RuntimeError) as error:
                    rows.append((name, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["archive", "relative_path", "bytes", "error"])

    rows = binary(spark, path).where(F.lower("path").endswith(".zip")).select("path", "content").mapInPandas(run, "archive string, relative_path string, bytes binary, error string")
    size = F.octet_length("bytes").cast("bigint")
    state = F.when(F.col("error").isNotNull(), "error").otherwise(discovery.status(F.col("relative_path"), size, F.is_valid_utf8("bytes")))
    return rows.select("archive", "relative_path", F.when(state == "accepted", decoded(F.col("bytes"))).alias("content"), size.alias("size"), F.sha2("bytes", 256).alias("content_hash"), discovery.language(F.col("relative_path")).alias("language"), state.alias("status"), "error")


def clone(url: str, target: str, ref: str | None = None, timeout: int = CLONE_TIMEOUT) -> str:
    """Shallow clone of a repository address or local path; gives the commit in lower case."""
    command = ["git", "clone", "--depth", "1", *(["--branch", ref] if ref else []), "--", url, target]
    try:
        subprocess.run(command, check=True, capture_output=True, timeout=timeout)
        done = subprocess.run(["git", "-C", target, "rev-parse", "HEAD"], check=True, capture_output=True, text=True, timeout=timeout)
    except (subprocess.CalledProcessError, subprocess.TimeoutExpired, FileNotFoundError) as error:
        raise IngestionError(f"cannot clone {url}: {error}") from error
    sha = done.stdout.strip().lower()
    if len(sha) != 40:
        raise IngestionError(f"no commit in {url}")
    return sha


def question_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, question, answerable, category, source_type) of a JSON file: an object with ``questions``, or a bare list.

    category is answerable or unanswerable whatever the file says.
    """
    rows = spark.read.option("multiLine", "true").json(path)
    if "questions" in rows.columns:
        rows = rows.select(F.explode("questions").alias("q")).select("q.*")
    elif "question" not in rows.columns:
        raise TypeError("a dataset is an object with questions or a list of them")
    answerable = F.coalesce(F.col("answerable"), F.lit(True)) if "answerable" in rows.columns else F.lit(True)
    kind = F.col("source_type") if "source_type" in rows.columns else F.lit(None).cast("string")
    return rows.select(F.col("id").cast("string").alias("query_id"), "question", answerable.alias("answerable"), F.when(answerable, "answerable").otherwise("unanswerable").alias("category"), kind.alias("source_type"))


def write_report(rows: DataFrame, path: str) -> None:
    """A small report (at most 100,000 rows, checked) as indented JSON with a final line end; folders are made."""
    taken = rows.limit(100_001).collect()
    if len(taken) > 100_000:
        raise ValueError("a report holds at most 100,000 rows; write tables instead")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(json.dumps([r.asDict(recursive=True) for r in taken], indent=2, ensure_ascii=False, default=str) + "\n")
