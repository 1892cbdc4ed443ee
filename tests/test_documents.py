from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from strataforge.functions import ids, text
from strataforge.operators import blocks, canonical, catalogue, chunking, code, goldmap


def words(text_):
    return text_.split(" ")


def test_file_blocks():
    got = blocks.file_blocks("intro\n# A\ntext\n- one\n- two\n\n- x\n> q\n## B ##\n```py\n# no heading\n```\n| a | b |\n| - | - |\n# C#\n~~~\nopen")
    assert [(b.type, b.heading_path) for b in got] == [
        ("paragraph", []), ("heading", ["A"]), ("paragraph", ["A"]), ("list", ["A"]), ("blockquote", ["A"]), ("heading", ["A", "B"]), ("code_block", ["A", "B"]), ("table", ["A", "B"]), ("heading", ["C#"]), ("code_block", ["C#"]),
    ]
    assert got[2].text == "text\n- one\n- two"
    assert blocks.file_blocks("") == []


def test_article_blocks():
    got = blocks.article_blocks("  # T #\n- a\n- b\n> x\n> y\nsee [l](http://u) now\n| a | b |\n|---|---|\n| 1 | 2 |\n```js extra\ncode\n```\n#\n")
    assert [b.type for b in got] == ["heading", "list", "quote", "link", "table", "code", "heading"]
    assert got[1].text == "a\nb" and got[2].text == "x\ny" and got[3].url == "http://u"
    assert got[4].rows == [["a", "b"], ["1", "2"]] and got[5].language == "js" and got[5].text == "code\n" and got[6].text == ""


def test_sections_and_titles(spark):
    df = spark.createDataFrame([("d", "before\n\n# T\n\nbody\n\n## S\n\nmore"), ("e", ""), ("n", None)], "id string, t string")
    parsed = blocks.parse_blocks(df, "id", "t")
    got = [(r["section"], r["heading"], r["content"]) for r in blocks.sections(parsed, "id").orderBy("section").collect()]
    assert got == [(0, None, "before"), (1, "T", "body"), (2, "S", "more")]
    assert blocks.titles(parsed, "id").first()["title"] == "T"


def test_recursive_pieces():
    assert chunking.recursive_pieces("a  b\tc", 100, 10) == ["a b c"]
    got = chunking.recursive_pieces("One two. Three four. Five six.", 15, 4)
    assert all(len(p) <= 15 for p in got) and got[0] == "One two."
    assert chunking.recursive_pieces("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9, "x"]
    with pytest.raises(ValueError):
        chunking.recursive_pieces("a", 10, 10)


def test_preserving_pieces_lose_nothing_but_ends():
    source = "alpha beta\n\n" + "word " * 40 + "\n\n\nend"
    got = chunking.preserving_pieces(source, 60)
    assert "".join(got) == source.strip() and all(len(p) <= 60 for p in got)


def test_page_and_exact_pieces():
    cut = lambda t: [w + " " for w in t.split()]
    assert len(chunking.page_pieces("one two\n\nthree four", cut, 3, 1)) == 2
    text_ = "abcdefghij" * 5
    pieces = chunking.exact_pieces(text_, list, 7)
    assert "".join(pieces) == text_ and max(map(len, pieces)) <= 7


def test_article_chunk_ids_do_not_depend_on_order():
    cut = lambda t: t.split()
    first = list(chunking.article_chunks("u", "# A\n\none\n\n```\n" + "x y\n" * 10 + "```\n", cut, 5))
    assert [c["structural_type"] for c in first] == ["paragraph", "code", "code", "code", "code", "code"]
    assert "".join(c["content"] for c in first[1:]) == "x y\n" * 10
    assert list(chunking.article_chunks("u", "", cut, 5)) == []


def test_chunk_documents_handles_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "# H\n\ntext"), ("b", None), ("c", "")], "document_id string, text string")
    assert chunking.chunk_documents(df, "markdown").count() == 1
    assert chunking.chunk_documents(df.where("false"), "recursive").count() == 0
    with pytest.raises(ValueError):
        chunking.chunk_documents(df, "other")


def test_code_symbols():
    ts = "class Auth {\n  login(): void {}\n  refreshToken(a: string) { return '}' }\n}\nexport type T = string;\n"
    assert [(s.qualified_name, s.symbol_type, s.start_line) for s in code.symbols_of("typescript", ts)[0]] == [("Auth", "class", 1), ("Auth.login", "method", 2), ("Auth.refreshToken", "method", 3), ("T", "type", 5)]
    py = "class User:\n    def validate(self):\n        return 1\n\nasync def build_user():\n    pass\n"
    assert [(s.qualified_name, s.symbol_type) for s in code.symbols_of("python", py)[0]] == [("User", "class"), ("User.validate", "method"), ("build_user", "async_function")]
    cpp = "namespace n {\nclass C {\n  int f(int a) const { return a; }\n};\n}\n"
    assert [s.qualified_name for s in code.symbols_of("cpp", cpp)[0]] == ["n", "n.C", "n.C.f"]
    assert code.symbols_of("python", "def (")[0] == [] and code.symbols_of("python", "def (")[1]
    with pytest.raises(code.UnsupportedLanguage):
        code.symbols_of("cobol", "")


def test_code_chunks_split_parents_into_children_and_leaves_exactly():
    py = "class User:\n    def a(self):\n        return 1\n    def b(self):\n        return 2\n"
    symbols, _ = code.symbols_of("python", py)
    assert [c["qualified_name"] for c in code.code_chunks("p", symbols, 50)] == ["User.a", "User.b"]
    assert [c["qualified_name"] for c in code.code_chunks("p", symbols)] == ["User", "User.a", "User.b"]
    leaf, _ = code.symbols_of("python", "def f():\n" + "    x = 1\n" * 20)
    parts = list(code.code_chunks("p", leaf, 45))
    assert "".join(c["content"] for c in parts) == leaf[0].content and [c["part_index"] for c in parts] == list(range(len(parts)))


def test_text_functions(spark):
    df = spark.createDataFrame([("getUserName api.v2",)], "t string")
    assert sorted(df.select(text.lexical_tokens(F.col("t")).alias("x")).first()["x"]) == sorted(["getusername", "get", "user", "name", "api.v2", "api", "v2"])
    assert df.select(text.preview(F.lit("a \n b " * 60)).alias("x")).first()["x"].endswith("...")
    fragments = df.select(text.token_fragments(F.lit(" ".join(f"w{i}" for i in range(20)))).alias("x")).first()["x"]
    assert [f.split()[0] for f in fragments] == ["w0", "w6", "w12"]
    assert df.select(text.iso_timestamp(F.lit("2024-01-02T03:04:05Z")).isNotNull().alias("x"), text.iso_timestamp(F.lit(" ")).alias("y")).first() == (True, None)


def test_point_id_is_the_name_uuid(spark):
    assert spark.range(1).select(ids.point_id(F.lit("abc")).alias("x")).first()["x"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "abc"))


def test_retrieve_and_pages(spark):
    chunks = spark.createDataFrame([("a", "1"), ("b", "2")], "chunk_id string, content string")
    asked = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "position int, chunk_id string")
    assert [r["content"] for r in catalogue.retrieve(asked, chunks).orderBy("position").collect()] == ["2", "1", "2"]
    with pytest.raises(catalogue.ChunksNotFound) as error:
        catalogue.retrieve(asked.union(spark.createDataFrame([(3, "z")], "position int, chunk_id string")), chunks)
    assert error.value.ids == ["z"]
    with pytest.raises(ValueError):
        catalogue.page(chunks, 0)


def test_changes_and_latest(spark, rows):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, t string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "k string, t string")
    assert rows(catalogue.changes(old, new, "k", "t")) == [("a", "UNCHANGED"), ("b", "MODIFIED"), ("c", "DELETED"), ("d", "NEW")]
    versions = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "k string, v int, t string")
    assert rows(catalogue.latest(versions, "k", "v")) == [("a", 2, "y")]


def test_gold_status(spark, rows):
    evidence = spark.createDataFrame([("e1", "1", "The “quick” fox"), ("e2", "1", "runsfast"), ("e3", "1", "twice"), ("e4", "2", "quick"), ("e5", None, "quick")], "evidence_id string, page string, span string")
    chunks = spark.createDataFrame([("c1", "1", 'the "quick"  fox twice'), ("c2", "1", "runs fast twice")], "chunk_id string, page string, content string")
    got = {r["evidence_id"]: r["status"] for r in goldmap.classify(evidence, goldmap.containing(evidence, chunks)).collect()}
    assert got == {"e1": "exact", "e2": "exact", "e3": "ambiguous", "e4": "unresolved", "e5": "unresolved"}


def test_merged_metadata(spark):
    from strataforge.session import tune

    tune(spark)
    df = spark.createDataFrame([({"a": "1", "b": "1"}, {"b": "2"})], "x map<string,string>, y map<string,string>")
    assert df.select(canonical.merged_metadata(F.col("x"), F.col("y"), F.lit(None).cast("map<string,string>")).alias("m")).first()["m"] == {"a": "1", "b": "2"}
