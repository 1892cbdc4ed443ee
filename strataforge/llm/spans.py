"""Problem 10: long exact spans shared between documents, by De Bruijn compaction.

Equal texts are one class from the start. Tokens are the bytes of the UTF-8 text, because the wanted passages are counted in code
points and may begin inside a word. Of all token k-mers (the edges) only those that are minimal in a window of
``WINDOW`` positions are kept, a sparse De Bruijn graph: with k = 64 and a window of 46, any passage of 200 code
points (200 bytes or more) shared by two documents contains at least one kept edge that is chosen from its own bytes alone, so
both documents keep it and no link is lost. Edges seen in two documents or more are chained by their order and distance in the
documents; nonbranching paths compact by joins of predecessors and successors. An occurrence of a path is then verified by
its coordinates: the stretch of text around it (up to 200 code points to each side, all that can decide whether 200 are common) is cut out of the
source once, and two occurrences are compared byte by byte. As every shared passage of 200 lies around some shared edge, these
stretches cover all that is shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataforge.llm.pairs import BLOCK, pairs_within
from strataforge.session import spread, written

LEAST = 200
K = 64
WINDOW = 46  # (LEAST - K + 1) - 2 * (WINDOW - 1) >= WINDOW
_TABLE = np.random.default_rng(20240501).integers(1, 2**63 - 1, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at once; bounds a worker's memory whatever the batch.
SLICE = 1 << 20


def window_for(least: int, k: int) -> int:
    """The widest window that still guarantees a kept edge in every shared passage of ``least`` bytes."""
    return (least - k + 3) // 3


def _powers(size: int) -> np.ndarray:
    powers = np.empty(size, np.uint64)
    powers[0] = 1
    powers[1:] = _P
    return np.multiply.accumulate(powers)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POW = _powers(1)
_INV = np.ones(1, np.uint64)


def kmer_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-mers of an array of 64-bit codes."""
    global _POW, _INV
    n = len(values)
    if n < k:
        return np.empty(0, np.uint64)
    if len(_POW) <= n:
        _POW = _powers(n + SLICE)
        inverse = np.full(len(_POW), pow(int(_P), -1, 2**64), np.uint64)
        inverse[0] = 1
        _INV = np.multiply.accumulate(inverse)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _POW[:n], out=total[1:])
    return _mix((total[k:] - total[:-k]) * _INV[: n - k + 1])


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:  # noqa: ANN001
    """pick (np.minimum or np.maximum) over windows of ``width``, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def edges_of(data: np.ndarray, starts: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the kept edges of concatenated documents; ``starts`` has n + 1 offsets.

    A window counts only if it lies inside one document, so what is kept depends on that document alone.
    """
    span = k + window - 1
    if len(data) < span:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = kmer_hashes(_TABLE[data], k)
    least = _sliding(hashes, window, np.minimum)
    ends = np.repeat(starts[1:], np.diff(starts))
    at = np.arange(len(least))
    least[ends[: len(least)] - at < span] = 0
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    kept = np.flatnonzero((_sliding(padded, window, np.maximum)[: len(hashes)] == hashes) & (hashes != 0))
    return hashes[kept], kept


DTYPE = np.dtype([("h", np.uint64), ("d", np.int64), ("p", np.int32)])
#: Occurrences of a path from which on it is looked at by ``SPLITS`` finer keys.
COMMON_PATH = 64
SPLITS = 8


def without_runs(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a run of one repeated byte only the first and the last edge: any two passages that share a stretch with the run agree in
    its beginning, its end, or lie within it, and then the first edges meet."""
    inner = np.zeros(len(at), bool)
    if len(at) > 2:
        step = (hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1] + 1)
        inner[1:-1] = step[1:] & step[:-1]
    return hashes[~inner], at[~inner]


def repeated(rows: np.ndarray) -> np.ndarray:
    """Whether a row's hash occurs in two documents or more; rows are sorted by hash and document."""
    if not len(rows):
        return np.zeros(0, bool)
    begin = np.flatnonzero(np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]]))
    end = np.concatenate([begin[1:], [len(rows)]]) - 1
    return np.repeat(rows["d"][begin] != rows["d"][end], end - begin + 1)


def packed_edges(documents: DataFrame, parts: int, k: int, window: int) -> DataFrame:
    """(part, sure, rows): kept edges of (d, t) packed as binary (hash, document, position) by hash.

    Packing keeps the exchange at a few wide rows instead of one row per edge. Edges that a task has seen in two documents are sure and go to any
    part; one of their rows goes to the part of the hash too, so a part receives two rows of an edge from each flush, however frequent the edge.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold: list[np.ndarray] = []
        turn = 0

        def flush() -> pa.RecordBatch:
            nonlocal turn
            rows = np.concatenate(hold)
            hold.clear()
            rows = rows[np.lexsort((rows["p"], rows["d"], rows["h"]))]
            sure = repeated(rows)
            first = np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]])
            last = np.concatenate([rows["h"][1:] != rows["h"][:-1], [True]])
            told = rows[~sure | first | last]
            part = told["h"] % np.uint64(parts)  # kept hashes are minima, so only their low digits are spread evenly
            order = np.argsort(part, kind="stable")
            blobs = [b.tobytes() for b in np.split(told[order], np.searchsorted(part[order], np.arange(1, parts)))]
            keep = [i for i, b in enumerate(blobs) if b]
            known = rows[sure & ~first & ~last]
            cuts = np.array_split(known, max(1, min(parts, len(known) // 4096)))
            turn += 1
            places = [int(xxhash.xxh3_64_intdigest(known[:1].tobytes(), seed=turn + i) % parts) for i in range(len(cuts))]
            return pa.RecordBatch.from_arrays([pa.array(keep + places, pa.int32()), pa.array([False] * len(keep) + [True] * len(cuts)), pa.array([blobs[i] for i in keep] + [c.tobytes() for c in cuts], pa.binary())], ["part", "sure", "rows"])

        held = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = batch.column(1)
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
            first = 0
            while first < len(ids):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
                last = min(last, len(ids))
                starts = offsets[first : last + 1] - offsets[first]
                hashes, at = without_runs(*edges_of(data[offsets[first] : offsets[last]], starts, k, window))
                if len(at):
                    doc = np.searchsorted(starts, at, "right") - 1
                    rows = np.empty(len(at), DTYPE)
                    rows["h"], rows["d"], rows["p"] = hashes, ids[first + doc], at - starts[doc]
                    hold.append(rows)
                    held += len(rows)
                first = last
                if held > 1_000_000:
                    yield flush()
                    held = 0
        if hold:
            yield flush()

    return documents.select("d", "t").mapInArrow(run, "part int, sure boolean, rows binary")


def repeated_edges(documents: DataFrame, k: int = K, least: int = LEAST, parts: int | None = None) -> DataFrame:
    """(edge, doc, pos): every occurrence of the kept edges of (d, t) that occur in two documents or more."""
    spark = documents.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(rows), 1 << 16):
            cut = rows[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(cut["h"].view(np.int64)), pa.array(cut["d"]), pa.array(cut["p"])], ["edge", "doc", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, sure, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows = np.frombuffer(blob.as_buffer(), DTYPE)
                if sure:
                    yield from out(rows)
                else:
                    blobs.setdefault(part, []).append(rows)
        for part in sorted(blobs):
            rows = np.concatenate(blobs.pop(part))
            rows = rows[np.lexsort((rows["p"], rows["d"], rows["h"]))]
            yield from out(rows[repeated(rows)])

    return packed_edges(documents, parts, k, window_for(least, k)).repartitionById(parts, F.col("part")).mapInArrow(run, "edge bigint, doc bigint, pos int")


def compacted(edges: DataFrame, k: int = K) -> DataFrame:
    """(path, doc, pos, last): occurrences of maximal nonbranching paths; path is the id of its first edge.

    Neighbours are edges that overlap (at most k apart); edge and distance together name a neighbour, so every occurrence of a path is the
    same stretch of text. The start and the end of a run count as neighbours of their own.
    """
    walk = Window.partitionBy("doc").orderBy("pos", "edge")
    before, behind = F.col("pos") - F.lag("pos").over(walk), F.lead("pos").over(walk) - F.col("pos")
    prev = F.when(before <= k, F.struct(F.lag("edge").over(walk).alias("e"), before.alias("g"))).alias("prev")
    next_ = F.when(behind <= k, F.struct(F.lead("edge").over(walk).alias("e"), behind.alias("g"))).alias("next")
    steps = edges.select("edge", "doc", "pos", prev, next_)

    def only(side: str) -> F.Column:
        return F.when((F.count("*") == F.count(side)) & (F.min(side) == F.max(side)), F.min(side)).alias(side)

    degrees = steps.groupBy("edge").agg(only("prev"), only("next"))
    out = degrees.where("next is not null and next.e <> edge").select(F.col("edge").alias("p"), F.col("next.e").alias("edge"), F.col("next.g").alias("g"))
    inner = degrees.where("prev is not null").select("edge", F.col("prev.e").alias("p"), F.col("prev.g").alias("g")).join(out, ["p", "edge", "g"]).select("edge", F.lit(1).alias("inside"))
    marked = edges.join(inner, "edge", "left").withColumn("run", F.sum(F.when(F.col("inside").isNull(), 1).otherwise(0)).over(walk))
    return marked.groupBy("doc", "run").agg(F.min(F.struct("pos", "edge")).alias("first"), F.max("pos").alias("last")).select(F.col("first.edge").alias("path"), "doc", F.col("first.pos").alias("pos"), "last")


def stretch(data: bytes, starts: np.ndarray, pos: int, end: int, least: int) -> tuple[bytes, bytes, int, int]:
    """(left, right, n, at): up to ``least`` code points before pos and behind end, the code points that begin in data[pos:end],
    and before it. ``starts`` has the offsets at which code points begin."""
    at, to = np.searchsorted(starts, [pos, end])
    low = int(starts[at - least]) if at >= least else 0
    high = int(starts[to + least]) if to + least < len(starts) else len(data)
    return data[low:pos], data[end:high], int(to - at), int(at)


def keys_of(left: bytes, right: bytes, n: int, least: int, splits: int) -> list[int]:
    """Keys of which two occurrences of a path have one in common if ``least`` code points around it are.

    With r code points wanting, the common ones left of the path reach into one of ``splits`` equal ranges of r; its lower end fixes how many must be common
    on the left, its upper end how many on the right.
    """
    want = least - n
    if want <= 0:
        return [0]
    begin_l = [i for i, b in enumerate(left) if b & 0xC0 != 0x80]
    begin_r = [i for i, b in enumerate(right) if b & 0xC0 != 0x80]
    out = []
    for i in range(splits):
        x, y = -(-i * want // splits), (splits - 1 - i) * want // splits
        if x <= len(begin_l) and y <= len(begin_r):
            a = left[begin_l[-x] :] if x else b""
            b = right[: begin_r[y - 1] + 1] if y else b""
            out.append(xxhash.xxh3_64_intdigest(a + b"\xff" + b, seed=i + 1) - 2**63)
    return out


def around(paths: DataFrame, texts: DataFrame, k: int, least: int, splits: int) -> DataFrame:
    """(path, key, doc, left, right, n, core, places): the stretches around the path occurrences; the text of each document is read once.

    ``paths`` has the column ``often``, whether a path is looked at by finer keys. Equal stretches of a document are one row with several places.
    """
    wanted = paths.groupBy("doc").agg(F.collect_list(F.struct("path", "often", "pos", "last")).alias("occurrences"))
    joined = texts.join(wanted, texts["d"] == wanted["doc"]).select("doc", "t", "occurrences")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "key", "doc", "left", "right", "n", "core", "places"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, occurrences in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                seen: dict[tuple, list[int]] = {}
                for o in occurrences:
                    left, right, n, at = stretch(data, starts, o["pos"], o["last"] + k, least)
                    seen.setdefault((o["path"], o["often"], left, right, n, o["last"] + k - o["pos"]), []).append(at)
                for (path, often, left, right, n, core), places in seen.items():
                    rows += [(path, key, doc, left, right, n, core, places) for key in (keys_of(left, right, n, least, splits) if often else [0])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return joined.mapInArrow(run, "path bigint, key bigint, doc bigint, left binary, right binary, n int, core int, places array<int>")


def common_prefix(a: bytes, b: bytes) -> int:
    """Equal bytes at the beginning."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size
    low, high = 0, size
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _begins(data: bytes) -> int:
    return sum(b & 0xC0 != 0x80 for b in data)


def common_span(left_a: bytes, right_a: bytes, left_b: bytes, right_b: bytes, n: int) -> tuple[int, int]:
    """(code points common before the path, code points common in all) around one path of n code points."""
    before = common_prefix(left_a[::-1], left_b[::-1])
    behind = common_prefix(right_a, right_b)
    points = _begins(left_a[len(left_a) - before :])
    total = points + n + _begins(right_a[:behind])
    for rest in (right_a[behind:], right_b[behind:]):
        if rest and rest[0] & 0xC0 == 0x80:  # the last code point is cut
            return points, total - 1
    return points, total


def verified(occurrences: DataFrame, least: int) -> DataFrame:
    """(doc_a, doc_b, starts_a, starts_b, length): pairs of documents with a span of at least ``least`` code points around a common path,
    with the places of the span in either document (in code points)."""
    sizes = occurrences.groupBy("path", "key").agg(F.count("*").alias("size"), F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("path", "key", "size")
    pairs = pairs_within(occurrences.join(sizes, ["path", "key"]), ["path", "key"], "doc", "size", carry=["left", "right", "n", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(9)]
            keep, starts_a, starts_b, lengths = [], [], [], []
            for i, (_, _, la, lb, ra, rb, n, pa_, pb) in enumerate(zip(*columns, strict=True)):
                points, total = common_span(la, ra, lb, rb, n)
                if total >= least:
                    keep.append(i)
                    starts_a.append([p - points for p in pa_])
                    starts_b.append([p - points for p in pb])
                    lengths.append(total)
            kept = batch.take(pa.array(keep, pa.int64()))
            places = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(starts_a, places), pa.array(starts_b, places), pa.array(lengths, pa.int32())], ["doc_a", "doc_b", "starts_a", "starts_b", "length"])

    carried = pairs.select("doc_a", "doc_b", "left_a", "left_b", "right_a", "right_b", F.col("n_a").alias("n"), "places_a", "places_b")
    return carried.mapInArrow(run, "doc_a bigint, doc_b bigint, starts_a array<int>, starts_b array<int>, length int")


def classes(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """(d, class, n_chars): every document once, with the least id of those that have the same text."""
    rows = documents.where(F.col(ident).isNotNull()).select(F.col(ident).cast("bigint").alias("d"), F.col(text).cast("string").alias("t"))
    named = rows.groupBy("d").agg(F.max(F.struct(F.length("t").alias("n"), F.sha2("t", 256).alias("h"))).alias("m")).select("d", F.col("m.n").alias("n_chars"), F.col("m.h").alias("h"))
    least = named.where("h is not null").groupBy("h").agg(F.min("d").alias("class"))
    return named.join(least, "h", "left").select("d", F.coalesce("class", "d").alias("class"), "n_chars")


def shared_spans(documents: DataFrame, members: DataFrame, ident: str = "doc_id", text: str = "text", least: int = LEAST, k: int = K) -> DataFrame:
    """(doc_a, doc_b, starts_a, starts_b, length) between the classes of equal texts; ``members`` as ``classes`` gives them."""
    others = written(members.where("d <> class").select("d"), "others")  # read back, so that its size is known

    def texts_of(rows: DataFrame) -> DataFrame:
        return rows.where(F.octet_length(text) >= least).select(F.col(ident).cast("bigint").alias("d"), F.col(text).cast("string").alias("t")).where("d is not null").join(others, "d", "left_anti")

    edges = written(repeated_edges(texts_of(spread(documents)), k, least), "edges")
    paths = compacted(edges, k)
    often = paths.groupBy("path").agg((F.count("*") > COMMON_PATH).alias("often"))
    occurrences = written(around(written(paths.join(often, "path"), "paths"), texts_of(documents), k, least, SPLITS).dropDuplicates(["path", "key", "doc", "left", "right"]), "around")
    return verified(occurrences, least)


def shared_pairs(documents: DataFrame, ident: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_a, doc_b): pairs of documents with a common passage of at least ``least`` code points, copies expanded in blocks.

    Null texts and texts under ``least`` take no part; a repeated row (same id and text) counts once;
    an empty table gives an empty result.
    """
    members = written(classes(documents, ident, text).where(F.col("n_chars") >= least), "classes")
    links = written(shared_spans(documents, members, ident, text, least).select("doc_a", "doc_b").distinct(), "links")
    sizes = members.groupBy("class").agg(F.count("*").alias("size"))
    copies = pairs_within(members.select("d", "class").join(sizes.where("size > 1"), "class"), ["class"], "d", "size").select(F.col("d_a").alias("doc_a"), F.col("d_b").alias("doc_b"))
    blocks = sizes.select("class", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(blocks, "class").select("class", "d", F.pmod(F.xxhash64("d"), "blocks").cast("int").alias("block"))
    sided = links.join(blocks.select(F.col("class").alias("doc_a"), F.col("blocks").alias("na")), "doc_a").join(blocks.select(F.col("class").alias("doc_b"), F.col("blocks").alias("nb")), "doc_b")
    sided = sided.withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    left = placed.select(F.col("class").alias("doc_a"), F.col("block").alias("block_a"), F.col("d").alias("l"))
    right = placed.select(F.col("class").alias("doc_b"), F.col("block").alias("block_b"), F.col("d").alias("r"))
    crossed = sided.select("doc_a", "doc_b", "block_a", "block_b").join(left, ["doc_a", "block_a"]).join(right, ["doc_b", "block_b"])
    return copies.unionByName(crossed.select(F.least("l", "r").alias("doc_a"), F.greatest("l", "r").alias("doc_b"))).distinct()


def coverage(documents: DataFrame, ident: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document: (doc_id, class_id, n_chars, shared_chars, share, copies, partners).

    shared_chars counts the code points covered by at least one span shared with another document; copies the documents of the same text, which
    are not expanded into pairs; partners all other documents with a span in common.
    """
    members = written(classes(documents, ident, text), "classes")
    spans = written(shared_spans(documents, members, ident, text, least), "spans")
    size = members.groupBy("class").agg(F.count("*").alias("copies"), F.max("n_chars").alias("whole"))
    sides = [spans.select(F.col(f"doc_{x}").alias("class"), F.col(f"doc_{y}").alias("other"), F.explode(f"starts_{x}").alias("b"), "length") for x, y in ("ab", "ba")]
    placed = sides[0].unionByName(sides[1])
    linked = placed.select("class", "other").distinct().join(size.select(F.col("class").alias("other"), "copies"), "other").groupBy("class").agg(F.sum("copies").alias("linked"))
    distinct = placed.groupBy("class", "b").agg(F.max(F.col("b") + F.col("length")).alias("e"))
    before = Window.partitionBy("class").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    fresh = distinct.withColumn("seen", F.coalesce(F.max("e").over(before), F.lit(0))).select("class", F.greatest(F.lit(0), F.col("e") - F.greatest("b", "seen")).alias("n"))
    covered = fresh.groupBy("class").agg(F.sum("n").alias("covered"))
    known = size.join(covered, "class", "left").join(linked, "class", "left")
    zero = F.lit(0).cast("bigint")
    copied = (F.col("copies") > 1) & (F.col("whole") >= least)
    known = known.select("class", "copies", F.when(copied, F.col("whole").cast("bigint")).otherwise(F.coalesce("covered", zero)).alias("shared_chars"), (F.coalesce("linked", zero) + F.when(copied, F.col("copies") - 1).otherwise(0)).alias("partners"))
    n = F.coalesce("n_chars", F.lit(0)).cast("bigint")
    return members.join(known, "class").select(F.col("d").alias("doc_id"), F.col("class").alias("class_id"), n.alias("n_chars"), "shared_chars", F.round(F.coalesce(F.try_divide("shared_chars", n), F.lit(0.0)), 6).alias("share"), "copies", "partners")
