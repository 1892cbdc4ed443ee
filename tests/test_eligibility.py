from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strataforge.operators import eligibility

SCHEMA = "chunk_id string, content string, content_role string, structural_type string, parent_structure string, metadata map<string,string>, provenance struct<section:string,repository:string,path:string>, source_type string, project string, language string"


def chunk(content, parent=None, role=None, ident="x", **more):
    return (ident, content, role, None, parent, more.get("metadata", {}), (None, more.get("repository"), None), "markdown", None, more.get("language"))


INDEX = "\n".join(f"Term {c}, 1{i}" for i, c in enumerate("abcdefghij"))


@pytest.mark.parametrize(
    ("content", "parent", "expected"),
    [
        ("Anything at all", "Contents", "navigation"),
        ("Table of Contents\nOne 1\nTwo 2", None, "navigation"),
        ("© 2020 The authors. All rights reserved. Published by the press.", None, "metadata"),
        ("Requests for permission to reproduce go to the copyright clearance center.", None, "metadata"),
        (INDEX, None, "reference"),
        ("Glossary\nterm: meaning", None, "reference"),
        ("An index speeds up queries; copyright law and a glossary are mentioned once.", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_inferred_roles(spark, content, parent, expected):
    df = spark.createDataFrame([chunk(content, parent)], SCHEMA)
    role = eligibility.inferred_role(F.col("content"), F.col("parent_structure"), eligibility.structural_values(df))
    assert df.select(role.alias("r")).first()["r"] == expected


def test_policy_table(spark):
    roles = ["documentation", "Evidence ", "navigation", "metadata", "future-role", None]
    df = spark.createDataFrame([(r,) for r in roles], "r string").select(eligibility.policy(F.col("r")).alias("p"))
    assert [r["p"] for r in df.collect()] == ["eligible", "eligible", "ineligible", "ineligible", "unknown", "unknown"]


def test_metadata_dimensions(spark):
    df = spark.createDataFrame([chunk("a", ident="a", language="EN", repository="o/n"), chunk("b", ident="b", language=None), chunk("c", ident="c", language="de")], SCHEMA)

    def kept(**wanted):
        return sorted(r["chunk_id"] for r in df.where(eligibility.matches(df, wanted)).collect())

    assert kept(language=["en", "DE "]) == ["a", "c"]
    assert kept(language=[""]) == ["b"]
    assert kept(language=[]) == []
    assert kept(language=None) == ["a", "b", "c"]
    assert kept(language=["en"], repository=["O/N"]) == ["a"]
    with pytest.raises(ValueError):
        kept(colour=["red"])
