"""Which chunks may be evidence: structural policy, inferred roles, metadata filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.text import lines_of, metadata_form, strip, structural_form

# Roles and their eligibility.
ELIGIBLE_ROLES = ["documentation", "implementation", "evidence", "reference", "test", "configuration"]
INELIGIBLE_ROLES = ["navigation", "metadata"]
# Roles that exclude a chunk when they are inferred.
INFERRED_EXCLUDED = ["navigation", "metadata", "reference"]
# Labels and words of structural parts of a book.
STRUCTURAL_LABELS = ["contents", "table of contents", "index", "glossary", "references", "reference", "copyright", "publication information", "permissions", "legal disclaimer", "disclaimer"]
STRUCTURAL_WORDS = ["navigation", "metadata", "reference", "references", "index", "contents", "glossary", "copyright", "permissions", "legal", "disclaimer", "front_matter", "back_matter"]
# Phrases of legal notices.
LEGAL_PATTERNS = [
    r"all rights reserved", r"copyright clearance center", r"no part of this .* may be reproduced", r"may not be reproduced", r"reproduction in any form",
    r"permission to reproduce", r"published by", r"first published", r"isbn(?:[-\s]|\d)", r"library of congress",
]
# The sign of a copyright notice, and terms of its headings.
COPYRIGHT_SIGN = r"(?:©|\bcopyright\b)\s*(?:\d{4}|by\b)"
LEGAL_TERMS = ["copyright", "publication", "permissions", "legal", "disclaimer"]
# Fixed value: the shape of an entry of an index.
INDEX_ENTRY = "^[A-Za-z][A-Za-z'’ -]{1,45}(?:,|\\.{2,}|\\s+\\d|$)"
# Thresholds of the index shape.
INDEX_LINES, INDEX_WORDS, INDEX_SHORT, INDEX_ENTRIES = 8, 12, 0.72, 0.55
#: Dimensions of a metadata filter; repository and path come from the provenance.
DIMENSIONS = ["source_type", "project", "language", "repository", "path", "content_role"]


def policy(role: Column) -> Column:
    """eligible, ineligible or unknown."""
    form = metadata_form(role)
    return F.when(form.isin(*ELIGIBLE_ROLES), "eligible").when(form.isin(*INELIGIBLE_ROLES), "ineligible").otherwise("unknown")


def _any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def legal_matches(flat: Column) -> Column:
    """How many of the legal phrases a flattened lower-case text holds."""
    return reduce(lambda a, b: a + b, [F.coalesce(flat.rlike(p).cast("int"), F.lit(0)) for p in LEGAL_PATTERNS])


def is_legal(flat: Column, parent: Column) -> Column:
    """Two phrases, or a copyright sign with one phrase or a parent that speaks of it."""
    n = legal_matches(flat)
    return (n >= 2) | (F.coalesce(flat.rlike(COPYRIGHT_SIGN), F.lit(False)) & ((n >= 1) | _any_of(parent, LEGAL_TERMS)))


def is_index(content: Column) -> Column:
    """Mostly short lines, most of them shaped like entries. Lines are only looked at where there are enough of them."""
    text = F.coalesce(content, F.lit(""))
    filled = F.filter(F.transform(lines_of(text), strip), lambda x: x != "")
    n = F.size(filled)
    short = F.size(F.filter(filled, lambda x: F.regexp_count(x, F.lit(r"(?U)\s+")) < INDEX_WORDS))
    entries = F.size(F.filter(filled, lambda x: x.rlike(INDEX_ENTRY)))
    shaped = (n >= INDEX_LINES) & (short / n >= INDEX_SHORT) & (entries / n >= INDEX_ENTRIES)
    return F.when(F.regexp_count(text, F.lit(r"\R")) >= INDEX_LINES - 1, shaped).otherwise(False)


def is_contents(content: Column, parent: Column) -> Column:
    """The parent, or the first line of the stripped lower-case content, is a table of contents."""
    first = strip(F.element_at(F.split(content, r"\R"), 1))
    names = ["contents", "table of contents"]
    return parent.isin(*names) | F.coalesce(first.isin(*names), F.lit(False))


def is_reference(content: Column, parent: Column) -> Column:
    """A glossary or list of references by parent, by its first word, or by shape (content stripped, lower case)."""
    heading = content.rlike(r"^(?:glossary|references?)\s*$") | (content.rlike(r"^(?:glossary|references?)\b") & F.contains(content, F.lit("\n")))
    return parent.isin("glossary", "reference", "references") | F.coalesce(heading, F.lit(False)) | is_index(content)


def has_structural_metadata(values: Column) -> Column:
    """One of the values (an array) is a structural label, or a short text with a structural word."""
    words = F.array(*[F.lit(w) for w in STRUCTURAL_WORDS])
    return F.exists(F.transform(values, structural_form), lambda v: v.isin(*STRUCTURAL_LABELS) | ((F.length(v) <= 80) & F.arrays_overlap(F.regexp_extract_all(v, F.lit("[a-z_]+"), F.lit(0)), words)))


def inferred_role(content: Column, parent: Column, values: Column) -> Column:
    """The role of a chunk that has none: metadata, reference, navigation or null."""
    return _role(F.lower(strip(F.coalesce(content, F.lit("")))), structural_form(content), structural_form(parent), values)


def _role(lower: Column, flat: Column, above: Column, values: Column) -> Column:
    contents = is_contents(lower, above)
    structural = has_structural_metadata(values) | contents
    navigation = above.isin("index", "contents", "table of contents") | contents
    by_structure = F.when(_any_of(above, ["copyright", "publication", "permission", "legal"]), "metadata").when(above.isin("glossary", "reference", "references"), "reference").when(navigation, "navigation")
    return F.coalesce(F.when(structural, by_structure), F.when(is_legal(flat, above), "metadata"), F.when(is_reference(lower, above), "reference"))


def structural_values(chunks: DataFrame) -> Column:
    """What of a chunk names its place: type, parent, section, metadata keys and values."""
    parts = [F.array("structural_type", "parent_structure", F.col("provenance.section")), F.map_keys("metadata"), F.map_values("metadata")]
    return F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])


def with_status(chunks: DataFrame) -> DataFrame:
    """Adds ``inferred`` (the role a chunk would have without its own) and ``status`` (eligible, ineligible or unknown: by the role, else by the inferred one).

    The normalised forms are columns of their own, so each is computed once per row.
    """
    forms = {"_lower": F.lower(strip(F.coalesce("content", F.lit("")))), "_flat": structural_form(F.col("content")), "_above": structural_form(F.col("parent_structure")), "_values": structural_values(chunks)}
    roles = chunks.withColumns(forms).withColumn("inferred", _role(F.col("_lower"), F.col("_flat"), F.col("_above"), F.col("_values")))
    own = metadata_form(F.col("content_role"))
    by_inference = F.when(F.col("inferred").isin(*INFERRED_EXCLUDED), "ineligible").otherwise("unknown")
    return roles.withColumn("status", F.when(own != "", policy(own)).otherwise(by_inference)).drop(*forms)


def structurally_eligible(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked rows whose chunk is not ineligible. Ranks and scores stay as they are."""
    bad = with_status(chunks).where("status = 'ineligible'").select("chunk_id").distinct()
    return ranked.join(bad, "chunk_id", "left_anti").select(*ranked.columns)


def dimension(chunks: DataFrame, name: str) -> Column:
    return F.col(f"provenance.{name}") if name in ("repository", "path") else F.col(name)


def matches(chunks: DataFrame, wanted: dict[str, list[str] | None]) -> Column:
    """All dimensions must match, any value of a dimension suffices; None is no constraint, an empty list matches nothing."""
    out = F.lit(True)
    for name, values in wanted.items():
        if name not in DIMENSIONS:
            raise ValueError(f"unknown dimension {name!r}")
        if values is not None:
            forms = sorted({str(v or "").strip().casefold() for v in values})
            out = out & (metadata_form(dimension(chunks, name)).isin(*forms) if forms else F.lit(False))
    return out


def filter_metadata(ranked: DataFrame, chunks: DataFrame, wanted: dict[str, list[str] | None]) -> DataFrame:
    """Ranked rows whose chunk matches; ranks keep their gaps."""
    good = chunks.where(matches(chunks, wanted)).select("chunk_id").distinct()
    return ranked.join(good, "chunk_id", "left_semi").select(*ranked.columns)


def filter_per_query(ranked: DataFrame, chunks: DataFrame, filters: DataFrame) -> DataFrame:
    """As ``filter_metadata`` with a row of array columns per query_id; a null array, or no row, is no constraint."""
    named = [d for d in DIMENSIONS if d in filters.columns]
    sides = chunks.select("chunk_id", *[metadata_form(dimension(chunks, d)).alias(f"c_{d}") for d in named]).dropDuplicates(["chunk_id"])
    wants = filters.select("query_id", *[F.transform(d, metadata_form).alias(f"w_{d}") for d in named])
    joined = ranked.join(sides, "chunk_id").join(wants, "query_id", "left")
    ok = reduce(lambda a, b: a & b, [F.col(f"w_{d}").isNull() | F.array_contains(F.col(f"w_{d}"), F.col(f"c_{d}")) for d in named], F.lit(True))
    return joined.where(ok).select(*ranked.columns)
