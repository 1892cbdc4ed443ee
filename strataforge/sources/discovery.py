"""Which files of a tree or archive are source files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions and their language.
EXTENSIONS = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python",
    ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp",
}
# What is never read, and the size limit.
EXCLUDED_DIRECTORIES = [".git", "node_modules", ".venv", "__pycache__", "dist", "build", "coverage", ".cache"]
EXCLUDED_NAMES = [".env", "package-lock.json", "yarn.lock", "pnpm-lock.yaml"]
EXCLUDED_SUFFIXES = [".map"]
MAX_BYTES = 10 * 1024 * 1024


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The last extension in lower case; a leading dot begins none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    """The language by extension, else null."""
    out = F.lit(None).cast("string")
    for name in sorted(set(EXTENSIONS.values())):
        out = F.when(suffix(path).isin(*[e for e, v in EXTENSIONS.items() if v == name]), name).otherwise(out)
    return out


def status(path: Column, size: Column, valid: Column | None = None, most: int = MAX_BYTES) -> Column:
    """directory, lockfile, excluded name, excluded suffix, unsupported, too large, unreadable or accepted; the first that applies."""
    if most <= 0:
        raise ValueError("the size limit must be positive")
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    out = F.when(F.arrays_overlap(folders, F.array(*[F.lit(d) for d in EXCLUDED_DIRECTORIES])), "directory")
    name = file_name(path)
    out = out.when(name.isin(*EXCLUDED_NAMES), F.when(F.contains(name, F.lit("lock")), "lockfile").otherwise("excluded name"))
    out = out.when(suffix(path).isin(*EXCLUDED_SUFFIXES), "excluded suffix").when(language(path).isNull(), "unsupported")
    out = out.when(size > most, "too large")
    return (out.when(~valid, "unreadable") if valid is not None else out).otherwise("accepted")


def statistics(found: DataFrame) -> DataFrame:
    """(status, language, files, bytes) from rows with path, size and status."""
    return found.groupBy("status", language(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def member_name(name: Column) -> Column:
    """The normalised name of an archive member, null if unsafe: empty, absolute, a drive, or with a parent step."""
    slashed = F.replace(name, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    bad = F.coalesce(name == "", F.lit(True)) | F.contains(name, F.lit("\u0000")) | slashed.startswith("/") | slashed.rlike("^[A-Za-z]:/") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))
