"""Problem 2: generated, minified and vendored source files.

A random forest scores every file on compression ratio, token entropy, identifier lengths, comment density and
the repetition of line shapes. It is trained on files labelled by notices in their leading comment, which is cut off before features are
taken, so the forest has to tell such files by their bodies and finds those without a notice; names and paths play no part. Bulk data carries no
notices: a body of literals only is a label too, and therefore no feature counts literals.

Copies of another repository's files are written by hand and look it; no forest on bodies can tell them. They are a second operator (``copies``): found by
what they say (the library's name in path or first lines) and proved by shingle similarity to a file of that library.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.session import written

#: Labelled files that the forest is fitted on, per class, chosen by hash; a bound on the driver's and the fit's size.
SAMPLE = 6000
TREES = 80
DEPTH = 8
THRESHOLD = 0.5
#: Votes of the first forest from which on a file without label is not taken for hand-written in the second fit.
DOUBT = 0.05
#: Depth of the first forest, and files that a leaf of it holds at least.
FIRST_DEPTH, FIRST_LEAF = 4, 20
SIMILARITY = 0.8
#: Lines below the leading comment that may name a library, as all of the comment may.
HEAD_LINES = 8

# Marks that generators and minifiers put into leading comments by public convention.
_MARKERS = re.compile(r"@generated\b|<auto-?generated\b|^\s*/\*!", re.I | re.M)
# A notice as grammar, by sentence: what the file is (subject, "automatically", a verb of making), by what, and what is asked of the reader.
_SUBJECT = r"(?:(?:this|the|all)?\s*(?:file|code|module|source|script|header|class)\s+(?:was|is|has been)?\s*)?"
_MAKING = r"(?:generated|produced|created|emitted|compiled|built|made|written)"
_MADE = re.compile(rf"^{_SUBJECT}(?:(?:automatically|auto)[\s-]*{_MAKING}\b|(?:generated|produced|emitted|compiled)\s+(?:automatically|by|with|from|using)\b|{_MAKING}\s+(?:automatically|by (?:a|the|an)\s+(?:machine|program|script|tool|generator|compiler)\b))", re.I)
_ASKED = re.compile(r"\b(?:do not|don't|never|must not be|should not be)\s+(?:edit|modif|change|touch)|\bedit (?:the |its )?\w+ instead\b|\bchanges (?:will|would) be (?:lost|overwritten)", re.I)
# The same in German, French and Spanish.
_FOREIGN = re.compile(r"automatisch (?:erzeugt|erstellt|generiert)|nicht (?:bearbeiten|ändern)|(?:généré|créé) automatiquement|ne pas (?:modifier|éditer)|(?:generado|creado) automáticamente|no (?:editar|modificar)", re.I)
_BY_HAND = re.compile(r"\b(?:not|never) " + _MAKING + r"|\b" + _MAKING + r" by hand\b|\bhand-?written\b", re.I)
#: Literals that a body of literals only must have to be labelled as bulk data; shorter tables are typed by hand.
BULK = 120
_COMMENT_LINE = re.compile(r"\s*(?:#(?!\s*(?:include|define|ifn?def|if|pragma|endif)\b)|//|/\*|\*|\*/|\"\"\"|'''|<!--)")
_TOKEN = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|[A-Za-z_$][\w$]*|\d[\w.]*|\S")
_PREFIX = re.compile(r"\b[bBrRuUfFL]{1,2}(?=[\"'])")
_WORD = re.compile(r"\w+")
FEATURES = [
    "compression", "token_entropy", "shape_entropy", "shape_repeat", "top_shape", "identifier_length", "short_identifiers", "identifier_variety",
    "comment_density", "line_length", "longest_line", "space", "size", "keyword_share", "affix_number",
]
# Words that most hand-written code of the five languages holds.
_KEYWORDS = frozenset("if else for while return def class function const let var int void import from include namespace template struct switch case break continue try catch except in of not and or new this self public private static export default".split())


def split_head(text: str) -> tuple[str, str]:
    """(leading comment, body). A shebang or a licence counts as comment; preprocessor lines do not."""
    lines = text.split("\n")
    k, block, quote = 0, False, ""
    while k < len(lines):
        bare = lines[k].strip()
        if block:
            block = "*/" not in bare
        elif quote:
            if quote in bare:
                quote = ""
        elif bare.startswith("/*"):
            at = bare.find("*/", 2)
            if 0 <= at < len(bare) - 2:  # code follows on the line
                lines[k] = bare[at + 2 :]
                return "\n".join([*lines[:k], bare[: at + 2]]), "\n".join(lines[k:])
            block = at < 0
        elif bare[:3] in ('"""', "'''"):
            quote = bare[:3] if bare.count(bare[:3]) < 2 else ""
        elif bare and not _COMMENT_LINE.match(bare):
            break
        k += 1
    return "\n".join(lines[:k]), "\n".join(lines[k:])


def has_notice(text: str) -> bool:
    """Whether the leading comment says that a program made this very file; one that says it was written by hand says not."""
    head, _ = split_head(text)
    if not head.strip() or _BY_HAND.search(head):
        return False
    if _MARKERS.search(head) or _FOREIGN.search(head):
        return True
    sentences = (re.sub(r"^[\s/*#!;:'\"<>-]+", "", s) for s in re.split(r"[.;:\n]\s*", head))
    return any(_MADE.search(s) or _ASKED.search(s) for s in sentences if s)


def is_bulk(text: str) -> bool:
    """Whether the body is at least ``BULK`` literals or 1,500 characters of strings and next to nothing else."""
    tokens = _TOKEN.findall(_PREFIX.sub("", split_head(text)[1]))
    literals = [t for t in tokens if t[0].isdigit() or len(t) > 1 and t[0] in "\"'`"]
    words = sum(t[0].isalpha() or t[0] in "_$" for t in tokens)
    enough = len(literals) >= BULK or sum(len(t) for t in literals if len(t) > 40) >= 1500
    return enough and words * 12 <= len(literals) + sum(len(t) for t in literals) / 20 and not any(t in ("if", "for", "while", "return", "def", "function") for t in tokens)


def _entropy(counts: Counter) -> float:
    total = sum(counts.values())
    return -sum(c / total * math.log2(c / total) for c in counts.values()) if total else 0.0


def _shape(token: str) -> str:
    first = token[0]
    if first in "\"'`" and len(token) > 1:
        return "S"
    if first.isdigit():
        return "N"
    if first.isalpha() or first in "_$":
        return token if token in _KEYWORDS else "I"
    return first


def features(text: str) -> list[float]:
    """The values of ``FEATURES`` for a file's body; zeros for an empty one."""
    _, body = split_head(text)
    data = body.encode("utf-8", "surrogatepass")
    if not data.strip():
        return [0.0] * len(FEATURES)
    lines = [line for line in body.split("\n") if line.strip()]
    comments = sum(bool(_COMMENT_LINE.match(line)) for line in lines)
    tokens: list[str] = []
    shapes: Counter = Counter()
    for line in lines:
        own = _TOKEN.findall(_PREFIX.sub("", line))
        tokens += own
        shapes["".join(map(_shape, own))] += 1
    counts = Counter(tokens)
    names = [t for t in tokens if (t[0].isalpha() or t[0] in "_$") and t not in _KEYWORDS]
    repeated = sum(c for s, c in shapes.items() if c > 2 and len(s) > 2)
    numbered = sum(bool(re.search(r"\d{1,5}$|^_0x|^[a-z]\d*$", t)) for t in names)
    n = max(1, len(tokens))
    return [
        len(zlib.compress(data, 6)) / (len(data) + 60),
        _entropy(counts) / math.log2(n + 1),
        _entropy(shapes) / math.log2(len(lines) + 1),
        repeated / len(lines),
        max(c for s, c in shapes.items()) / len(lines),
        sum(map(len, names)) / max(1, len(names)),
        sum(len(t) < 3 for t in names) / max(1, len(names)),
        len(set(names)) / max(1, len(names)),
        comments / len(lines),
        min(2000.0, len(body) / len(lines)),
        min(5000.0, float(max(map(len, lines)))),
        sum(c.isspace() for c in body) / len(body),
        math.log2(len(data) + 1),
        sum(t in _KEYWORDS for t in tokens) / n,
        numbered / max(1, len(names)),
    ]


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words of the body."""
    words = _WORD.findall(split_head(text)[1])
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    return np.unique(np.array([xxhash.xxh3_64_intdigest(" ".join(words[i : i + size])) for i in range(len(words) - size + 1)], np.uint64))


_ROWS, _BANDS = 4, 24
_ODD = np.random.default_rng(11).integers(1, 2**63 - 1, _ROWS * _BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(values: np.ndarray) -> list[int]:
    """Keys of ``_BANDS`` min-hash bands; sets with a similarity of 0.8 share none with a probability under 1e-5."""
    least = (values[:, None] * _ODD[None, :]).min(axis=0)
    return [xxhash.xxh3_64_intdigest(least[i * _ROWS : (i + 1) * _ROWS].tobytes(), seed=i) - 2**63 for i in range(_BANDS)]


def naming_words(text: str) -> str:
    """The distinct words of the leading comment and the first lines of the body, one a line."""
    head, body = split_head(text)
    lines = body.split("\n", HEAD_LINES)[:HEAD_LINES]
    return "\n".join(dict.fromkeys(re.findall(r"[A-Za-z0-9_.\-]+", "\n".join([head, *lines]))))


def described(files: DataFrame) -> DataFrame:
    """(file_id, repository, relative_path, content) to one row per file with features, label (notice) and head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            values = [features(t) for t in texts]
            notice = [has_notice(t) or is_bulk(t) for t in texts]
            head = [naming_words(t) for t in texts]
            empty = [not t.strip() for t in texts]
            arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(head), pa.array(notice), pa.array(empty), pa.array(values, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["file_id", "repository", "relative_path", "head", "notice", "empty", "x"])

    columns = [F.col("file_id").cast("bigint").alias("file_id"), F.coalesce(F.col("repository").cast("string"), F.lit("")).alias("repository"), F.coalesce(F.col("relative_path").cast("string"), F.lit("")).alias("relative_path"), F.col("content").cast("string").alias("content")]
    return files.select(*columns).where("file_id is not null and content is not null").mapInArrow(run, "file_id bigint, repository string, relative_path string, head string, notice boolean, empty boolean, x array<double>")


def train(rows: DataFrame, sample: int = SAMPLE, seed: int = 5):  # noqa: ANN201
    """A fitted forest, or None where one of the classes has no file.

    Files without a notice are not all written by hand. So a first forest of shallow trees (deep ones would learn single files by heart) sees
    all of them as the other class, and those to which it still gives ``DOUBT`` of its votes are left out when the forest is fitted again.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    labelled = rows.where("not empty").select(F.col("notice").cast("double").alias("label"), array_to_vector("x").alias("features"), F.xxhash64("file_id").alias("h"))
    chosen = written(labelled.where("label = 1").orderBy("h").limit(sample).unionByName(labelled.where("label = 0").orderBy("h").limit(sample)), "labelled")
    if chosen.select("label").distinct().count() < 2:
        return None

    def fit(data: DataFrame, depth: int = DEPTH, least: int = 2):  # noqa: ANN202
        sizes = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
        weight = F.when(F.col("label") == 1, F.lit(max(1.0, sizes.get(0.0, 0) / sizes[1.0] * 0.5))).otherwise(F.lit(1.0))
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=depth, seed=seed, weightCol="w", subsamplingRate=0.8, minInstancesPerNode=least)
        return forest.fit(data.withColumn("w", weight))

    sure = score(fit(chosen, FIRST_DEPTH, FIRST_LEAF), chosen).where((F.col("label") == 1) | (F.col("p") < DOUBT)).select("label", "features")
    return fit(sure) if sure.where("label = 0").limit(1).count() else None


def score(model, rows: DataFrame) -> DataFrame:  # noqa: ANN001
    """Adds p, the share of the forest's votes for "made by a program"."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def library_names(repositories: DataFrame) -> DataFrame:
    """(library, library_repository): names of listed repositories and owner/name."""
    listed = repositories.where("owner is not null and name is not null")
    return listed.select(F.col("name").alias("library"), F.concat_ws("/", "owner", "name").alias("library_repository")).distinct()


def copies(files: DataFrame, rows: DataFrame, repositories: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(file_id, library): files that name another listed repository in path, leading comment or first lines and equal or resemble one of its files.

    Only the files that name a library and the libraries' own files are compared, by min-hash bands within the library; the exact
    similarity of five-word shingles decides. Equal files of a library count once.
    """
    names = library_names(repositories)
    text = F.concat_ws("\n", "relative_path", "head")
    mentioned = rows.select("file_id", "repository", F.explode(F.array_distinct(F.split(text, r"[^A-Za-z0-9_.\-]+"))).alias("word"))
    plain = F.regexp_replace(F.regexp_replace("word", r"[.\-]+$", ""), r"[-@_.]v?\d[\w.]*$", "")
    mentioned = mentioned.select("file_id", "repository", F.explode(F.array_distinct(F.array("word", plain))).alias("library"))
    claims = mentioned.join(names, "library").where("repository <> library_repository").select("file_id", "library", F.lit(True).alias("claim")).distinct()
    own = rows.select("file_id", "repository").join(names, F.col("repository") == F.col("library_repository"), "inner").select("file_id", "library", F.lit(False).alias("claim"))
    wanted = files.select(F.col("file_id").cast("bigint").alias("file_id"), "content").where("content is not null").join(claims.unionByName(own), "file_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            keep = [i for i, s in enumerate(sets) if len(s)]
            sets = [sets[i] for i in keep]
            sub = batch.take(pa.array(keep, pa.int64()))
            sig = pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([sub.column(0), sub.column(2), sub.column(3), sig, pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["file_id", "library", "claim", "sig", "words", "bands"])

    sets = written(wanted.select("file_id", "content", "library", "claim").mapInArrow(run, "file_id bigint, library string, claim boolean, sig bigint, words binary, bands array<bigint>"), "shingles")
    distinct = sets.groupBy("library", "claim", "sig").agg(F.first("words").alias("words"), F.first("bands").alias("bands"))
    keys = distinct.select("library", "claim", "sig", F.posexplode("bands").alias("band", "key"))
    left = keys.where("claim").select("library", "band", "key", F.col("sig").alias("copy"))
    right = keys.where("not claim").select("library", "band", "key", F.col("sig").alias("original"))
    candidates = left.join(right, ["library", "band", "key"]).select("library", "copy", "original").distinct()
    words = distinct.select("library", "claim", "sig", "words")
    joined = candidates.join(words.where("claim").select("library", F.col("sig").alias("copy"), F.col("words").alias("wa")), ["library", "copy"])
    joined = joined.join(words.where("not claim").select("library", F.col("sig").alias("original"), F.col("words").alias("wb")), ["library", "original"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["library", "copy"]).filter(pa.array(keep, pa.bool_()))

    similar = joined.select("library", "copy", "wa", "wb").mapInArrow(check, "library string, copy bigint").distinct()
    return sets.where("claim").join(similar, (sets.library == similar.library) & (sets.sig == similar.copy), "left_semi").select("file_id", "library").distinct()


def classify(files: DataFrame, repositories: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(file_id, repository, relative_path, p, notice, library, handwritten): every file with content.

    ``files`` has one row per file_id. A file is not hand-written if the forest's vote reaches the threshold or it copies a listed
    library's file. Where no file carries a notice, or all do, there is nothing to learn from: p is then null and only copies are named. An
    empty file is hand-written.
    """
    rows = written(described(files), "described")
    model = train(rows)
    if model is None:
        scored = rows.select("file_id", "repository", "relative_path", "notice", F.lit(None).cast("double").alias("p"))
    else:
        from pyspark.ml.functions import array_to_vector

        voted = score(model, rows.withColumn("features", array_to_vector("x")))
        scored = voted.select("file_id", "repository", "relative_path", "notice", F.when(F.col("empty"), 0.0).otherwise(F.round("p", 6)).alias("p"))
    copied = copies(files, rows, repositories).groupBy("file_id").agg(F.min("library").alias("library"))
    joined = scored.join(copied, "file_id", "left")
    return joined.withColumn("handwritten", (F.coalesce("p", F.lit(0.0)) < threshold) & F.col("library").isNull())


def held_out(files: DataFrame, threshold: float = THRESHOLD, folds: int = 5) -> DataFrame:
    """(label, files, flagged, share): a forest fitted on the files of four fifths of the repositories, asked about the others.

    label is whether the file carries a notice or is bulk data; share is recall in the row true, and an upper bound of the false alarms in the row false,
    where generated files without notice count as false.
    """
    from pyspark.ml.functions import array_to_vector

    rows = written(described(files), "described").where("not empty")
    fold = F.pmod(F.xxhash64("repository"), F.lit(folds))
    model = train(rows.where(fold != 0))
    if model is None:
        raise ValueError("no labelled files of both kinds")
    judged = score(model, rows.where(fold == 0).withColumn("features", array_to_vector("x")))
    flagged = F.sum(F.when(F.col("p") >= threshold, 1).otherwise(0))
    return judged.groupBy(F.col("notice").alias("label")).agg(F.count("*").alias("files"), flagged.alias("flagged"), F.round(flagged / F.count("*"), 6).alias("share"))
