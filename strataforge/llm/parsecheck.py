"""Problem 4: source files that do not parse, with all their errors and rates per repository and language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm import syntax

#: Languages that have a parser; other languages get no verdict.
LANGUAGES = tuple(syntax.CHECKERS)


def newest(files: DataFrame) -> DataFrame:
    """One row per file_id, the last delivery (of equal times the one with the larger content hash); rows without id are left out.

    Deliveries of one file meet once; where the table is already parted by file_id (as ``keyed`` does) nothing is shuffled again.
    """
    order = F.struct(F.col("ingested_at"), F.xxhash64("content"))
    chosen = F.max_by(F.struct("repository", "language", "relative_path", "content"), order).alias("f")
    return files.where("file_id is not null").groupBy("file_id").agg(chosen).select("file_id", "f.repository", "f.language", "f.relative_path", "f.content")


def verdicts(files: DataFrame) -> DataFrame:
    """(file_id, repository, language, relative_path, valid, errors array<struct<message, line, cause>>).

    A null content, an unknown language and a text that nests deeper than the parsers can follow have no verdict (valid is null); an empty file is valid.
    """
    types = pa.list_(pa.struct([("message", pa.string()), ("line", pa.int32()), ("cause", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors = [], []
            for language, content in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if content is None or language not in syntax.CHECKERS:
                    valid.append(None)
                    errors.append([])
                    continue
                try:
                    found = syntax.check(language, content)
                except syntax.TooDeep:
                    valid.append(None)
                    errors.append([{"message": "nesting too deep for a verdict", "line": 1, "cause": "nesting"}])
                    continue
                valid.append(not found)
                errors.append([{"message": p.message, "line": p.line, "cause": p.cause} for p in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(valid, pa.bool_()), pa.array(errors, types)], ["file_id", "repository", "language", "relative_path", "valid", "errors"])

    schema = "file_id bigint, repository string, language string, relative_path string, valid boolean, errors array<struct<message:string,line:int,cause:string>>"
    columns = [F.col("file_id").cast("bigint").alias("file_id"), F.col("repository").cast("string").alias("repository"), F.lower(F.trim("language")).alias("language"), F.col("relative_path").cast("string").alias("relative_path"), F.col("content").cast("string").alias("content")]
    return files.select(*columns).mapInArrow(run, schema)


def report(checked: DataFrame) -> DataFrame:
    """One row per file with its first cause: (file_id, repository, language, valid, n_errors, cause, line, message)."""
    first = F.try_element_at("errors", F.lit(1))
    return checked.select("file_id", "repository", "language", "valid", F.size("errors").alias("n_errors"), first["cause"].alias("cause"), first["line"].alias("line"), first["message"].alias("message"))


def rates(checked: DataFrame) -> DataFrame:
    """(repository, language, files, invalid, rate); files without verdict count in none."""
    judged = checked.where("valid is not null").groupBy("repository", "language").agg(F.count("*").alias("files"), F.sum(F.when(~F.col("valid"), 1).otherwise(0)).alias("invalid"))
    return judged.select("repository", "language", "files", "invalid", F.round(F.col("invalid") / F.col("files"), 6).alias("rate"))


def acceptance(checked: DataFrame) -> DataFrame:
    """(language, files, accepted, acceptance) per language."""
    judged = checked.where("valid is not null").groupBy("language").agg(F.count("*").alias("files"), F.sum(F.when(F.col("valid"), 1).otherwise(0)).alias("accepted"))
    return judged.select("language", "files", "accepted", F.round(F.col("accepted") / F.col("files"), 6).alias("acceptance"))


def against_inspections(checked: DataFrame, inspections: DataFrame) -> DataFrame:
    """(language, outcome, files): the older parser's last result beside the verdict.

    outcome: agrees, missed (it has no error for an invalid file), false alarm, or no result (not inspected, or a null result).
    """
    last = inspections.where("file_id is not null").groupBy("file_id").agg(F.max(F.struct("inspected_at", F.col("parse_result").isNotNull().alias("has"), F.size("parse_result.errors").alias("n"))).alias("i"))
    joined = checked.where("valid is not null").join(last, "file_id", "left")
    flagged = F.coalesce(F.col("i.n"), F.lit(0)) > 0
    outcome = F.when(~F.coalesce(F.col("i.has"), F.lit(False)), "no result").when(flagged == ~F.col("valid"), "agrees").when(flagged, "false alarm").otherwise("missed")
    return joined.groupBy("language", outcome.alias("outcome")).agg(F.count("*").alias("files"))
