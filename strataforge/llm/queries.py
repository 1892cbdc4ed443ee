"""Queries pN_... over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm import canon, handwritten, markup, mixing, neardup, packing, parsecheck, rankfusion, spans, split
from strataforge.session import keyed, spread, table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Kinds of chunks that hold prose.
PROSE = ("markdown", "pdf", "article", "note")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "chunks").where(F.col("source_type").isin(*PROSE)))


def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_kind, record_id, text) of documents and prose chunks."""
    docs = spread(table(spark, sf_dir, "documents")).select(F.lit("document").alias("record_kind"), F.col("doc_id").cast("string").alias("record_id"), "text")
    return docs.unionByName(prose(spark, sf_dir).select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_id"), F.col("content").alias("text")))


# Problem 1


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that the splitter had to cut."""
    items = split.items_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "article_chunks"))
    cut = split.split_items(items, table(spark, sf_dir, "size_limits"), with_text=False)
    return cut.where("piece = 0").select("item_kind", "item_id").distinct()


SQL["p1_found"] = """
SELECT DISTINCT item_kind, item_id FROM (
  SELECT 'document' AS item_kind, CAST(doc_id AS VARCHAR) AS item_id, length(text) AS n FROM documents
  UNION ALL SELECT 'article_chunk', chunk_id, length(content) FROM article_chunks) i
JOIN size_limits USING (item_kind) WHERE n > max_size
"""


@query
def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every oversized item, with its text and offsets."""
    chunks = table(spark, sf_dir, "article_chunks").dropDuplicates(["chunk_id"])
    items = split.items_of(table(spark, sf_dir, "documents"), chunks)
    return split.split_items(items, table(spark, sf_dir, "size_limits"))


# Problem 3


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading chunk of each query."""
    return rankfusion.leaders(rankfusion.fuse(table(spark, sf_dir, "ranked_chunks")))


SQL["p3_found"] = """
WITH latest AS (SELECT DISTINCT ON (query_id, channel, chunk_id) query_id, channel, chunk_id, CASE WHEN channel = 'l2' THEN -score ELSE score END AS s, rank
  FROM ranked_chunks ORDER BY query_id, channel, chunk_id, score IS NULL, recorded_at DESC),
placed AS (SELECT *, count(*) OVER (PARTITION BY query_id, channel) AS n,
  CASE WHEN s IS NULL THEN rank ELSE rank() OVER (PARTITION BY query_id, channel ORDER BY s DESC NULLS LAST) END AS place FROM latest),
summed AS (SELECT query_id, chunk_id, sum(coalesce(greatest(0, (n - place + 1) / n), 0)) AS total FROM placed GROUP BY 1, 2)
SELECT query_id, arg_min(chunk_id, (-total, chunk_id)) AS chunk_id FROM summed GROUP BY 1
"""


@query
def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole fused list of each query."""
    return rankfusion.order(rankfusion.fuse(table(spark, sf_dir, "ranked_chunks")))


# The component by power iteration over the correlation matrix.
SQL["p3_ranking"] = """
WITH RECURSIVE latest AS (SELECT DISTINCT ON (query_id, channel, chunk_id) query_id, channel, chunk_id, CASE WHEN channel = 'l2' THEN -score ELSE score END AS s, coalesce(rank, min(rank) OVER (PARTITION BY query_id, channel, chunk_id)) AS rank
  FROM ranked_chunks WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND channel IN ('dense', 'bm25', 'rerank', 'usage', 'l2') ORDER BY query_id, channel, chunk_id, score IS NULL, recorded_at DESC, score DESC, rank DESC),
placed AS (SELECT *, count(*) OVER (PARTITION BY query_id, channel) AS n, CASE WHEN s IS NULL THEN CAST(rank AS DOUBLE)
  ELSE rank() OVER (PARTITION BY query_id, channel ORDER BY s DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, channel, s) - 1) / 2.0 END AS place FROM latest),
valued AS (SELECT query_id, chunk_id, channel, least(1.0, greatest(0.0, coalesce((n - place + 1) / n, 0.0))) AS v FROM placed),
wide AS (SELECT query_id, chunk_id, [coalesce(max(v) FILTER (channel = 'dense'), 0.0), coalesce(max(v) FILTER (channel = 'bm25'), 0.0), coalesce(max(v) FILTER (channel = 'rerank'), 0.0), coalesce(max(v) FILTER (channel = 'usage'), 0.0), coalesce(max(v) FILTER (channel = 'l2'), 0.0)] AS c FROM valued GROUP BY 1, 2),
cells AS (SELECT i, j, corr(c[i], c[j]) AS r, stddev_pop(c[i]) AS d FROM wide, (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(1, 6)) AS j) GROUP BY 1, 2),
matrix AS (SELECT list(row ORDER BY i) AS m, list(round(d, 9) ORDER BY i) AS d FROM (SELECT i, list(r ORDER BY j) AS row, max(d) AS d FROM cells GROUP BY 1)),
power AS (SELECT 0 AS step, [1.0, 1.0, 1.0, 1.0, 1.0]::DOUBLE[] AS v UNION ALL SELECT step + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM
  (SELECT step, list_transform(m, lambda row: list_dot_product(row, v)) AS w FROM power, matrix WHERE step < 400)),
loading AS (SELECT list_transform(v, lambda x: round(x, 6)) AS w, d FROM power, matrix WHERE step = 400),
scored AS (SELECT query_id, chunk_id, c, round(c[1] * (w[1] / d[1]) + c[2] * (w[2] / d[2]) + c[3] * (w[3] / d[3]) + c[4] * (w[4] / d[4]) + c[5] * (w[5] / d[5]), 9) AS projection FROM wide, loading)
SELECT query_id, chunk_id, projection, CAST(len(list_filter(c, lambda x: x > 0)) AS INT) AS channels, c[1] AS value_dense, c[2] AS value_bm25, c[3] AS value_rerank, c[4] AS value_usage, c[5] AS value_l2,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY projection DESC, chunk_id) AS INT) AS position FROM scored
"""


# Problem 6


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that read the same and differ in code points."""
    return canon.lookalike_pairs(text_records(spark, sf_dir))


# The mapping as SQL functions: drop what is invisible, translate one to one, compose, and write ligatures out.
_PLAIN = "".join(k for k, v in canon.MAPPING.items() if len(k) == 1 and len(v) == 1)
_READS = "".join(canon.MAPPING[k] for k in _PLAIN).replace("'", "''")
_SEEN = f"nfc_normalize(translate(nfc_normalize(translate(translate(text, '{canon.INVISIBLE}', ''), '{_PLAIN}', '{_READS}')), '{_PLAIN}', '{_READS}'))"
for _joined, _letters in canon.LIGATURES.items():
    _SEEN = f"replace({_SEEN}, '{_joined}', '{_letters}')"
SQL["p6_found"] = f"""
WITH records AS (SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION
  SELECT 'chunk', chunk_id, content FROM chunks WHERE source_type IN ('markdown', 'pdf', 'article', 'note')),
seen AS (SELECT kind, id, text, {_SEEN} AS canon FROM records WHERE text IS NOT NULL)
SELECT DISTINCT a.kind AS record_kind, a.id AS record_id_a, b.id AS record_id_b FROM seen a JOIN seen b ON a.kind = b.kind AND a.canon = b.canon AND a.id < b.id AND a.text <> b.text
"""


@query
def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that have a look-alike, with their class."""
    return canon.lookalike_classes(text_records(spark, sf_dir)).drop("members")


@query
def p6_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record in its canonical form."""
    return text_records(spark, sf_dir).select("record_kind", "record_id", canon.canonical_column(F.col("text")).alias("text"))


# Problem 10


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with a common passage."""
    pairs = spans.shared_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b"))


SQL["p10_found"] = """
WITH grams AS (SELECT DISTINCT doc_id, hash(substring(text, CAST(i AS BIGINT), 200)) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
many AS (SELECT g FROM grams GROUP BY 1 HAVING count(*) > 1), kept AS (SELECT doc_id, g FROM grams SEMI JOIN many USING (g))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM kept a JOIN kept b ON a.g = b.g AND a.doc_id < b.doc_id
"""


@query
def p10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is shared with another."""
    return spans.coverage(table(spark, sf_dir, "documents"))


SQL["p10_coverage"] = """
WITH docs AS (SELECT DISTINCT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS copies FROM documents),
grams AS (SELECT doc_id, i, hash(substring(text, CAST(i AS BIGINT), 200)) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM docs WHERE length(text) >= 200)),
many AS (SELECT g FROM grams GROUP BY 1 HAVING count(DISTINCT doc_id) > 1), kept AS (SELECT doc_id, i, g FROM grams SEMI JOIN many USING (g)),
stretched AS (SELECT doc_id, least(200, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 200)) AS n FROM kept),
covered AS (SELECT doc_id, sum(n) AS n FROM stretched GROUP BY 1), places AS (SELECT DISTINCT doc_id, g FROM kept),
linked AS (SELECT a.doc_id, count(DISTINCT b.doc_id) AS partners FROM places a JOIN places b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1)
SELECT d.doc_id, class_id, coalesce(length(text), 0) AS n_chars, CAST(coalesce(c.n, 0) AS BIGINT) AS shared_chars, round(CASE WHEN length(text) > 0 THEN coalesce(c.n, 0) / length(text) ELSE 0.0 END, 6) AS share, copies, coalesce(partners, 0) AS partners
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN linked l ON d.doc_id = l.doc_id
"""


# Problem 7


def _prose_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose(spark, sf_dir).select(F.col("chunk_id").alias("record_id"), F.col("content").alias("text"))


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of prose chunks with a similarity of 0.5 or more."""
    pairs = neardup.similar_pairs(_prose_texts(spark, sf_dir))
    return pairs.select(F.col("record_id_a").alias("chunk_id_a"), F.col("record_id_b").alias("chunk_id_b"))


SQL["p7_found"] = f"""
WITH texts AS (SELECT DISTINCT chunk_id, content AS text FROM chunks WHERE source_type IN ('markdown', 'pdf', 'article', 'note') AND chunk_id IS NOT NULL AND content IS NOT NULL),
words AS (SELECT chunk_id, regexp_extract_all(lower({_SEEN}), '[\\p{{L}}\\p{{N}}]+') AS w FROM texts),
triples AS (SELECT DISTINCT chunk_id, hash(w[i], w[i + 1], w[i + 2]) AS t FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 12)),
sizes AS (SELECT chunk_id, count(*) AS n FROM triples GROUP BY 1),
common AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS c FROM triples a JOIN triples b ON a.t = b.t AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM common JOIN sizes x ON x.chunk_id = a JOIN sizes y ON y.chunk_id = b WHERE c >= 0.5 * (x.n + y.n - c)
"""


@query
def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prose chunk with enough words, its group, class and number of links."""
    return neardup.groups(_prose_texts(spark, sf_dir))


# Problem 8


def _capacity(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "size_limits").where("item_kind = 'container'").agg(F.max("max_size")).first()[0]


@query
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document or piece of one with its container."""
    return packing.containers(spread(table(spark, sf_dir, "documents")), _capacity(spark, sf_dir))


@query
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and fill of the containers, how near they come to each limit, and how few containers the sums would allow."""
    packed = packing.containers(spread(table(spark, sf_dir, "documents")), _capacity(spark, sf_dir))
    capacity = _capacity(spark, sf_dir)
    filled = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("segments"), F.sum("loss").alias("loss"))
    limit = int(capacity * packing.LOSS_SHARE)
    least = F.greatest(F.ceil(F.sum("tokens") / capacity), F.ceil(F.sum("segments") / packing.SEGMENTS), F.ceil(F.sum("loss") / limit))
    held = [F.count("*"), F.sum("segments"), F.max("tokens"), F.max("segments"), F.sum(F.when((F.col("loss") > limit) & (F.col("segments") > 1), 1).otherwise(0)), F.sum(F.when(F.col("loss") > limit - 8, 1).otherwise(0))]
    names = ["containers", "segments", "most_tokens", "most_segments", "over_loss", "full_of_loss"]
    return filled.agg(*[c.cast("bigint").alias(n) for c, n in zip(held, names, strict=True)], least.cast("bigint").alias("least_possible"), F.round(F.avg("tokens") / capacity, 6).alias("mean_fill"))


# Problem 9


@query
def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture in order of (slot, place)."""
    weights = table(spark, sf_dir, "source_weights")
    return mixing.mixture(mixing.sized_documents(spread(table(spark, sf_dir, "documents")), weights), weights)


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each listed source."""
    weights = table(spark, sf_dir, "source_weights")
    return mixing.report(mixing.mixture(mixing.sized_documents(spread(table(spark, sf_dir, "documents")), weights), weights), weights)


@query
def p9_shares_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a mixture of as many tokens as the listed sources hold: sources that their cap keeps short fall under their share."""
    weights = table(spark, sf_dir, "source_weights")
    sized = mixing.sized_documents(spread(table(spark, sf_dir, "documents")), weights)
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    return mixing.report(mixing.mixture(sized, weights, total=total), weights)


# Problem 5


def markup_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = spread(table(spark, sf_dir, "raw_articles")).select(F.lit("article").alias("record_kind"), F.col("source_uri").alias("record_id"), F.col("content").alias("text"))
    return articles.unionByName(text_records(spark, sf_dir))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with markup, one row per kind present."""
    return markup.found(markup_records(spark, sf_dir))


@query
def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as clean text."""
    return markup.convert(markup_records(spark, sf_dir)).withColumn("markup", F.array_join("markup", ","))


# Problem 4


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsecheck.verdicts(parsecheck.newest(keyed(table(spark, sf_dir, "code_files"), "file_id")))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not valid in their language."""
    return _verdicts(spark, sf_dir).where("not valid").select("file_id")


@query
def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its verdict and first cause."""
    return parsecheck.report(_verdicts(spark, sf_dir))


@query
def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of invalid files per repository and language."""
    return parsecheck.rates(_verdicts(spark, sf_dir))


@query
def p4_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted files per language."""
    return parsecheck.acceptance(_verdicts(spark, sf_dir))


@query
def p4_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older parser's results beside the verdicts."""
    return parsecheck.against_inspections(_verdicts(spark, sf_dir), table(spark, sf_dir, "file_inspections"))


# Problem 2


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = written(parsecheck.newest(keyed(table(spark, sf_dir, "code_files"), "file_id")), "files")
    return handwritten.classify(files, table(spark, sf_dir, "repositories"))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nobody wrote by hand in their repository."""
    return _classified(spark, sf_dir).where("not handwritten").select("file_id")


@query
def p2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with the forest's vote and the library it copies."""
    return _classified(spark, sf_dir)


@query
def p2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are copies of a file of another listed repository, with its name."""
    files = written(parsecheck.newest(keyed(table(spark, sf_dir, "code_files"), "file_id")), "files")
    return handwritten.copies(files, written(handwritten.described(files), "described"), table(spark, sf_dir, "repositories"))


@query
def p2_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the forest says of repositories that it was not fitted on."""
    files = written(parsecheck.newest(keyed(table(spark, sf_dir, "code_files"), "file_id")), "files")
    return handwritten.held_out(files)


@query
def p2_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code chunks whose file is not hand-written, by the document_id that names file and content."""
    files = parsecheck.newest(keyed(table(spark, sf_dir, "code_files"), "file_id"))
    code = table(spark, sf_dir, "code_files").where("file_id is not null").groupBy("file_id").agg(F.max("content_hash").alias("content_hash"))
    named = files.join(code, "file_id").select("file_id", F.sha2(F.concat(F.col("relative_path"), F.expr("char(0)"), F.col("content_hash")), 256).alias("document_id"))
    bad = p2_found(spark, sf_dir).join(named, "file_id").select("document_id").distinct()
    chunks = table(spark, sf_dir, "chunks").where(F.col("source_type").isin("github", "code"))
    return chunks.join(bad, "document_id", "left_semi").select("chunk_id", "document_id").distinct()
