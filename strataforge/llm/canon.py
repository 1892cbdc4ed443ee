"""Problem 6: one canonical form for text that looks alike.

A transducer is compiled once from a mapping over grapheme clusters (a base code point and its
marks): width forms, composed accents, ligatures, blanks, hyphens and look-alike letters each map
to one spelling, invisible code points map to nothing. The mapping is precomputed by rule from the
Unicode character database plus the fixed tables below, checked for conflicts (one key, two
outputs) and for idempotence, and applied in one left-to-right longest-match pass.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.llm.pairs import pairs_within

# Code points that print nothing.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
# Blanks that look like the ordinary one.
BLANKS = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Hyphens that look like the ASCII hyphen.
HYPHENS = "\u2010\u2011\ufe63\uff0d"
# Joined letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Cyrillic letters that look like Latin ones.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝ", "ABESIJKMHOPCTYXaeopcyxsijhdqw", strict=True))
# Greek letters that look like Latin ones.
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo", strict=True))
# The micro sign and the Greek letter.
OTHER = {"µ": "μ"}


def _width_forms() -> dict[str, str]:
    """Full-width and half-width forms and their ordinary code points, by the Unicode tags."""
    out = {}
    for code in range(0xFF01, 0xFFEF):
        parts = unicodedata.decomposition(chr(code)).split()
        if parts and parts[0] in ("<wide>", "<narrow>"):
            out[chr(code)] = "".join(chr(int(p, 16)) for p in parts[1:])
    return out


def _accents() -> dict[str, str]:
    """Every way of writing an accented letter and its composed form."""
    out: dict[str, str] = {}
    for code in [*range(0xC0, 0x3000), *range(0xF900, 0xFB50)]:
        char = chr(code)
        if not unicodedata.decomposition(char) or unicodedata.decomposition(char)[0] == "<":
            continue
        composed = unicodedata.normalize("NFC", char)
        if composed != char:
            out[char] = composed
        decomposed = unicodedata.normalize("NFD", char)
        if decomposed != composed and len(composed) == 1:
            out[decomposed] = composed
            if len(decomposed) > 2:  # a composed base and a further mark
                out[unicodedata.normalize("NFC", decomposed[:-1]) + decomposed[-1]] = composed
    return out


def build_mapping() -> dict[str, str]:
    """Key (a code point or a cluster) to canonical text. Raises ValueError on a conflict."""
    mapping: dict[str, str] = {}

    def add(key: str, value: str) -> None:
        if mapping.get(key, value) != value:
            raise ValueError(f"conflict: {key!r} to {mapping[key]!r} and {value!r}")
        if key != value:
            mapping[key] = value

    letters = {**CYRILLIC, **GREEK, **OTHER}
    for char in INVISIBLE:
        add(char, "")
    for char in BLANKS:
        add(char, " ")
    for char in HYPHENS:
        add(char, "-")
    for source in (LIGATURES, letters):
        for key, value in source.items():
            add(key, value)
    for key, value in _width_forms().items():
        add(key, "".join(mapping.get(c, c) for c in value))
    for key, value in _accents().items():
        base, marks = key[0], key[1:]
        if base in letters:  # an accented look-alike equals the accented Latin letter
            value = unicodedata.normalize("NFC", letters[base] + marks)
        elif not marks and (parts := unicodedata.normalize("NFD", key))[0] in letters and len(parts) > 1:
            value = unicodedata.normalize("NFC", letters[parts[0]] + parts[1:])
        elif not marks and value in mapping:
            value = mapping[value]
        add(key, value)
    # Composed look-alikes (for instance a Cyrillic letter with diaeresis) as single code points.
    for code in range(0x370, 0x530):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in letters:
            add(chr(code), unicodedata.normalize("NFC", letters[parts[0]] + parts[1:]))
    while unsettled := {k: "".join(mapping.get(c, c) for c in v) for k, v in mapping.items() if any(c in mapping for c in v)}:
        mapping.update(unsettled)  # outputs are canonical themselves: applying the mapping twice changes nothing
    return mapping


MAPPING = build_mapping()
#: A run of non-ASCII code points with the ASCII base that a mark may follow.
_RUN = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")


@lru_cache(maxsize=65536)
def _transduce(run: str) -> str:
    out: list[str] = []
    at, end = 0, len(run)
    while at < end:
        # One grapheme cluster: a base and its marks, invisible code points left out.
        if MAPPING.get(run[at]) == "":
            at += 1
            continue
        cluster, at = [MAPPING.get(run[at], run[at]) if run[at] not in " -" else run[at]], at + 1
        marks: list[str] = []
        while at < end and (unicodedata.combining(run[at]) or MAPPING.get(run[at]) == ""):
            if MAPPING.get(run[at]) != "":
                marks.append(run[at])
            at += 1
        text = cluster[0]
        if marks:  # base and marks in canonical order, composed as far as the mapping goes
            base, text = text[-1:], text[:-1]
            parts = unicodedata.normalize("NFD", base)
            base, marks = parts[:1], sorted([*parts[1:], *marks], key=unicodedata.combining)
            left: list[str] = []
            for mark in marks:
                blocked = left and unicodedata.combining(left[-1]) == unicodedata.combining(mark)
                composed = None if blocked else MAPPING.get(base + mark)
                if composed is None:
                    left.append(mark)
                else:
                    base = composed
            text += base + "".join(left)
        out.append(text)
    return "".join(out)


def canonical(text: str | None) -> str | None:
    """The canonical form. None stays None; ASCII text is already canonical."""
    if text is None or text.isascii():
        return text
    return _RUN.sub(lambda m: _transduce(m[0]), text)


def canonical_column(text: Column) -> Column:
    """``canonical`` as a vectorised column expression."""

    @F.pandas_udf("string")
    def apply(values):  # noqa: ANN001, ANN202
        return values.map(canonical, na_action="ignore")

    return apply(text)


def canonical_keys(records: DataFrame) -> DataFrame:
    """(record_kind, record_id, text) to (record_kind, record_id, canon, raw): 128-bit keys of both forms.

    Null texts have no form and are left out; the empty text has one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            raw = [xxhash.xxh3_128_digest(t) for t in texts]
            canon = [r if t.isascii() else xxhash.xxh3_128_digest(canonical(t)) for t, r in zip(texts, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(canon, pa.binary()), pa.array(raw, pa.binary())], ["record_kind", "record_id", "canon", "raw"])

    source = records.select(F.col("record_kind").cast("string"), F.col("record_id").cast("string"), F.col("text").cast("string").alias("text"))
    source = source.where("record_kind is not null and record_id is not null and text is not null")
    return source.mapInArrow(run, "record_kind string, record_id string, canon binary, raw binary").distinct()


def lookalike_classes(records: DataFrame) -> DataFrame:
    """One row per record that has a look-alike: (record_kind, record_id, class_id, form_id).

    class_id is shared by all records that read the same; form_id by those with equal code points.
    A record id delivered several times counts once per distinct text.
    """
    keys = canonical_keys(records)
    forms = keys.groupBy("record_kind", "canon", "raw").agg(F.count("*").alias("n"))
    mixed = forms.groupBy("record_kind", "canon").agg(F.count("*").alias("forms"), F.sum("n").alias("members")).where("forms > 1")
    return keys.join(mixed.drop("forms"), ["record_kind", "canon"]).select("record_kind", "record_id", F.hex("canon").alias("class_id"), F.hex("raw").alias("form_id"), "members")


def lookalike_pairs(records: DataFrame) -> DataFrame:
    """Pairs (record_kind, record_id_a, record_id_b) that read the same but differ in code points."""
    members = lookalike_classes(records)
    pairs = pairs_within(members, ["record_kind", "class_id"], "record_id", "members", carry=["form_id"])
    return pairs.where("form_id_a <> form_id_b").select("record_kind", "record_id_a", "record_id_b").distinct()
