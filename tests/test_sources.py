from __future__ import annotations

import json
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from strataforge.engine import Engine, EngineNotReady
from strataforge.operators.catalogue import ChunksNotFound
from strataforge.sources import discovery, files, urls
from strataforge.streaming import ingest


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://github.com/owner/repo", "owner/repo"), ("https://GitHub.com/owner/repo.git", "owner/repo"), ("https://github.com/owner/repo/", "owner/repo"), ("http://github.com/o/r", None),
        ("https://github.com/o/r/tree/main", None), ("https://github.com:443/o/r", None), ("https://user@github.com/o/r", None), ("https://github.com/o/r?x=1", None), ("https://github.com/o", None), ("https://github.com/o//r", None),
        ("https://evil.com/o/r", None), ("", None), (None, None),
    ],
)
def test_repository_addresses(spark, url, expected):
    assert value(spark, urls.repository(F.lit(url).cast("string"))) == expected


@pytest.mark.parametrize(("url", "expected"), [("https://a.hashnode.dev/post?x=1", "https://a.hashnode.dev/post.md"), ("https://hashnode.dev/post", None), ("https://a.hashnode.dev/", None), ("https://a.hashnode.dev/p#x", None), ("http://a.hashnode.dev/p", None)])
def test_article_addresses(spark, url, expected):
    assert value(spark, urls.article_endpoint(F.lit(url))) == expected


@pytest.mark.parametrize(("name", "expected"), [("a/b.ts", "a/b.ts"), ("./a", "a"), ("a\\b", "a/b"), ("", None), (".", None), ("/a", None), ("C:/a", None), ("a/../b", None), ("a\x00b", None)])
def test_member_names(spark, name, expected):
    assert value(spark, discovery.member_name(F.lit(name))) == expected


@pytest.mark.parametrize(
    ("path", "size", "expected"),
    [("src/a.ts", 1, "accepted"), ("node_modules/a.ts", 1, "directory"), ("yarn.lock", 1, "lockfile"), (".env", 1, "excluded name"), ("a.js.map", 1, "excluded suffix"), ("a.txt", 1, "unsupported"), ("A.PY", 1, "accepted"), ("a.c", 11 * 1024 * 1024, "too large")],
)
def test_discovery(spark, path, size, expected):
    assert value(spark, discovery.status(F.lit(path), F.lit(size))) == expected


def test_tree_archive_and_limits(spark, tmp_path, rows):
    tree = tmp_path / "tree"
    (tree / "dist").mkdir(parents=True)
    (tree / "a.py").write_text("x = 1\n")
    (tree / "dist" / "b.py").write_text("y = 1\n")
    (tree / "bad.js").write_bytes(b"\xff\xfe\xfa")
    assert rows(files.code_tree(spark, str(tree)), "relative_path", "status") == [("a.py", "accepted"), ("bad.js", "unreadable"), ("dist/b.py", "directory")]
    good, evil = tmp_path / "good.zip", tmp_path / "evil.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("src/a.py", "def f():\n    return 1\n")
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("../a.py", "x")
    assert rows(files.archive_members(spark, str(good)), "relative_path", "status") == [("src/a.py", "accepted")]
    assert "unsafe" in files.archive_members(spark, str(evil)).first()["error"]
    assert "more than" in files.archive_members(spark, str(good), files=1, each=10, total=5).first()["error"] or "large" in files.archive_members(spark, str(good), each=10).first()["error"]


def test_pages_and_datasets(spark, tmp_path):
    (tmp_path / "p.bin").write_bytes(b"First line\nbody\f \fThird")
    pages = files.page_files(spark, str(tmp_path / "p.bin"), lambda data: data.decode().split("\f"))
    assert [(r["page"], r["section"]) for r in pages.orderBy("page").collect()] == [(1, "First line"), (3, "Third")]
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "1", "question": "a?", "answerable": False, "source_type": "code"}]}))
    got = files.question_dataset(spark, str(tmp_path / "q.json")).first()
    assert (got["query_id"], got["category"]) == ("1", "unanswerable")
    files.write_report(spark.createDataFrame([("a", 1)], "x string, y int"), str(tmp_path / "new" / "r.json"))
    assert json.loads((tmp_path / "new" / "r.json").read_text()) == [{"x": "a", "y": 1}]


def test_engine_round_trip(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# Sessions\n\nThe refreshToken rotates every hour.\n\n# Other\n\nSomething else entirely.\n")
    engine = Engine(spark, str(tmp_path / "store"))
    with pytest.raises(EngineNotReady):
        engine.documents()
    assert engine.ingest(str(tmp_path / "docs" / "a.md")) == 2
    assert engine.ingest(str(tmp_path / "docs" / "a.md")) == 0
    queries = spark.createDataFrame([("q", "refreshToken")], "query_id string, question string")
    best = engine.search(queries).orderBy("rank").first()["chunk_id"]
    assert "refreshToken" in engine.retrieve([best]).first()["content"]
    assert engine.documents().count() == 1 and engine.sources().count() == 1
    with pytest.raises(ChunksNotFound):
        engine.retrieve(["none"])
    with pytest.raises(files.IngestionError):
        engine.ingest("unknown.bin")
    repository = tmp_path / "repo"
    repository.mkdir()
    (repository / "m.py").write_text("def handler():\n    return 1\n")
    for command in (["init", "-q"], ["add", "."], ["-c", "user.email=a@b", "-c", "user.name=n", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(repository), *command], check=True, capture_output=True)
    assert engine.ingest(str(repository)) == 1


def test_stream_appends_each_key_once(spark, tmp_path):
    schema = "chunk_id string, content string"
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", "1"), ("a", "1"), (None, "x")], schema).write.parquet(source)
    ingest.append_new(spark, source, target, str(tmp_path / "state")).awaitTermination()
    spark.createDataFrame([("a", "2"), ("b", "1")], schema).write.mode("append").parquet(source)
    ingest.append_new(spark, source, target, str(tmp_path / "state")).awaitTermination()
    assert sorted(r["chunk_id"] for r in spark.read.parquet(target).collect()) == ["a", "b"]
