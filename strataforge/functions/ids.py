"""Identities: SHA-256 over fixed preimages. A null part counts as the empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace of URL-based name UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def joined(separator: str, *parts: Column) -> Column:
    """Parts joined with nulls kept as empty parts."""
    return F.concat_ws(separator, *[_text(p) for p in parts])


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def code_document_id(path: Column, content_hash: Column) -> Column:
    return digest(joined("\u0000", path, content_hash))


def article_document_id(source_uri: Column, content: Column) -> Column:
    return digest(joined("\u0000", source_uri, digest(_text(content))))


def recursive_chunk_id(document_id: Column, index: Column, content: Column) -> Column:
    return digest(joined(":", document_id, index, content))


def markdown_chunk_id(document_id: Column, section: Column, part: Column, content: Column) -> Column:
    return digest(joined(":", document_id, section, part, content))


def code_chunk_id(path: Column, qualified_name: Column, part: Column, content: Column) -> Column:
    return digest(joined(":", path, qualified_name, part, content))


def article_chunk_id(source_uri: Column, section: Column, heading_path: Column, local: Column, content: Column) -> Column:
    return digest(joined("\u0000", source_uri, section, F.array_join(heading_path, " > "), local, content))


def source_id(source_type: Column, source_uri: Column, repository: Column, project: Column) -> Column:
    return digest(joined("\u0000", source_type, source_uri, repository, project))


def point_id(chunk_id: Column) -> Column:
    """The name-based UUID (version 5, URL namespace) of a chunk id."""
    name = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(chunk_id, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(name, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    hexed = F.concat(F.substring(name, 1, 12), F.lit("5"), F.substring(name, 14, 3), variant, F.substring(name, 18, 15))
    return F.concat_ws("-", *[F.substring(hexed, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
