"""Problem 7: groups of near-duplicate texts, by BK-trees over sketches.

Texts become sets of word triples (canonical form of problem 6, lower case). Every distinct set is one class;
copies never meet each other again. A class has a sketch of 256 one-bit min-hashes, whose expected Hamming
distance at similarity s is 128 * (1 - s). A BK-tree (children keyed by the integer Hamming distance to
their parent; a search follows only the edges within the radius) finds the members of a shard within the radius.

One tree of a whole corpus cannot be broadcast, and at a similarity of 0.5 the radius (64 plus 5.5 standard deviations) is wider
than the spread of distances between unrelated texts, so a tree of unrelated texts leaves no edge out. Therefore each class has a
shard of its own: the tree's root is the class, the other nodes are the classes with which it has enough rare triples in common. The search
from the root then never enters a subtree whose edge exceeds the radius. What the trees find is verified by the exact similarity.

Why no similar pair misses its shard: two texts of n and m triples with a similarity of t have at least c = ceil(t(n + m) / (1 + t)) and each at least
ceil(tn) triples common. Both order their triples alike, the rarest first, and leave out the last ceil(tn) - ``COMMON`` of their own. The j-th
common triple has c - j common ones behind it, so the first min(``COMMON``, c) common triples are kept by both texts, with at least c - ``COMMON`` + 1
triples from there on. A pair that meets at fewer such places is no candidate. Where words or phrases recur does not matter, nor does the length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm.canon import canonical
from strataforge.llm.pairs import BLOCK, pairs_within
from strataforge.session import written

THRESHOLD = 0.5
LEAST_WORDS = 12
BITS = 256
#: Words of a shingle.
SIZE = 3
#: Cells of the frequency sketch; its broadcast has three bytes per cell, whatever the corpus.
CELLS = 1 << 22
_SHIFT = np.uint64(64 - 22)
#: Rare triples that a candidate pair must have in common.
COMMON = 3
#: Texts of one triple that meet in one place; a more frequent triple is cut into pairs of blocks.
MEET = 20_000
#: Bytes of packed rows that one task receives.
PART_BYTES = 32 << 20
_WORD = re.compile(r"[^\W_]+")
_ODD = np.random.default_rng(7).integers(1, 2**63 - 1, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def radius(threshold: float, bits: int = BITS, deviations: float = 5.5) -> int:
    """The Hamming distance that a pair of this similarity exceeds with a probability under 1e-7."""
    p = (1 - threshold) / 2
    return min(bits, math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p))))


def words_of(text: str) -> list[str]:
    """Longest runs of letters and digits of the canonical text in lower case."""
    return _WORD.findall(canonical(text).lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_arrays(texts: list[str], least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, starts, word hashes) of the texts with enough words."""
    known: dict[str, int] = {}
    flat: list[int] = []
    index, counts = [], [0]
    for i, text in enumerate(texts):
        words = words_of(text)
        if len(words) < max(least_words, SIZE):
            continue
        for word in words:
            h = known.get(word)
            if h is None:
                h = known[word] = xxhash.xxh3_64_intdigest(word)
            flat.append(h)
        index.append(i)
        counts.append(len(words))
    return np.array(index, np.int64), np.cumsum(counts), np.array(flat, np.uint64)


def shingle_sets(starts: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes): the sorted distinct shingles of each stretch of words; every stretch has at least ``size``."""
    if len(words) < size:
        return np.zeros(len(starts), np.int64), np.empty(0, np.uint64)
    value = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        value = _mix(value * _A + words[k : len(words) - size + 1 + k] * _B)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(value)]
    inside = np.arange(len(value)) + size <= starts[1:][owner]
    value, owner = value[inside], owner[inside]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return np.searchsorted(owner, np.arange(len(starts))), value


def unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, word hashes) of packed word sequences."""
    return np.cumsum([0, *(len(b) // 8 for b in blobs)]), np.frombuffer(b"".join(blobs), np.uint64)


def sketches(starts: np.ndarray, values: np.ndarray, bits: int = BITS) -> list[bytes]:
    """One-bit min-hash sketches of the sets values[starts[i]:starts[i+1]]."""
    out = np.empty((bits, len(starts) - 1), np.uint8)
    for k in range(bits):
        least = np.minimum.reduceat(values * _ODD[k % len(_ODD)], starts[:-1])
        out[k] = (least >> np.uint64(20)) & np.uint64(1)
    return [row.tobytes() for row in np.packbits(out, axis=0).T]


def features(records: DataFrame, least_words: int = LEAST_WORDS, size: int = SIZE) -> DataFrame:
    """(record_id, text) to (record_id, sig, n, words, sketch); sig names the set of n distinct shingles.

    Null ids and texts and texts with fewer words than ``least_words`` are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                index, limits, words = word_arrays(batch.column(1).to_pylist(), least_words)
                if not len(index):
                    continue
                starts, values = shingle_sets(limits, words, size)
                sig = np.array([xxhash.xxh3_64_intdigest(values[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)], np.uint64).view(np.int64)
                packed = [words[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:], strict=True)]
                arrays = [batch.column(0).take(pa.array(index)), pa.array(sig), pa.array(np.diff(starts), pa.int32()), pa.array(packed, pa.binary()), pa.array(sketches(starts, values), pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["record_id", "sig", "n", "words", "sketch"])

    source = records.select(F.col("record_id").cast("string"), F.col("text").cast("string")).where("record_id is not null and length(text) > 0")
    return source.mapInArrow(run, "record_id string, sig bigint, n int, words binary, sketch binary")


def frequency_sketch(feats: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, blocks, total): counts of all triples by hash cell, on a log scale in one byte each; the blocks into which the
    triples of a cell are cut (1 unless the cell exceeds the mean by more than ``MEET``); and the number of all triples.

    Each task adds its rows up before one binary row per range of cells, in the narrowest type that holds its counts, is merged.
    """
    ranges = 1 << max(3, min(9, _parts(feats.sparkSession).bit_length() - 1))
    width = CELLS // ranges

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int32)
        for batch in batches:
            for at in range(0, len(batch), 2000):
                _, triples = shingle_sets(*unpack(batch.column(0).slice(at, 2000).to_pylist()), SIZE)
                cells += np.bincount((triples >> _SHIFT).astype(np.int64), minlength=CELLS).astype(np.int32)
        if cells.any():
            parts = [cells[i * width : (i + 1) * width] for i in range(ranges)]
            packed = [p.astype(np.uint8 if p.max() < 256 else np.uint16 if p.max() < 65536 else np.int32).tobytes() for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(ranges), pa.int32()), pa.array(packed, pa.binary())], ["part", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        types = {width: np.uint8, 2 * width: np.uint16, 4 * width: np.int32}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = blob.as_buffer()
                total = sums.setdefault(part, np.zeros(width, np.int64))
                total += np.frombuffer(raw, types[raw.size])
        for part, total in sums.items():
            logs = np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8)
            load = total.sum() / width
            excess = np.maximum(0, total - load - 6 * np.sqrt(load))
            blocks = np.clip(np.ceil(excess / MEET), 1, 65535).astype(np.uint16)
            row = [[part], [logs.tobytes()], [blocks.tobytes()], [int(total.sum())]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["part", "cells", "blocks", "total"])

    order, blocks, triples = np.zeros(CELLS, np.uint8), np.ones(CELLS, np.uint16), 0
    merged = feats.select("words").mapInArrow(count, "part int, cells binary").repartitionById(ranges, F.col("part")).mapInArrow(merge, "part int, cells binary, blocks binary, total bigint")
    for part, logs, cut, total in merged.collect():  # three bytes per cell in all
        order[part * width : (part + 1) * width] = np.frombuffer(bytes(logs), np.uint8)
        blocks[part * width : (part + 1) * width] = np.frombuffer(bytes(cut), np.uint16)
        triples += total
    return order, blocks, triples


#: t and part name the triple; left is the share of the text's triples from this one on, in 255ths, rounded up; side tells the two
#: blocks of a frequent triple apart (0: not cut, or one block with itself).
ROW = np.dtype([("t", np.uint32), ("s", np.int64), ("n", np.uint16), ("left", np.uint8), ("side", np.uint8)])
#: A pair of classes and the number of common triples that it still lacks to be a candidate (counted down below zero).
PAIR = np.dtype([("a", np.int64), ("b", np.int64), ("need", np.uint8), ("have", np.uint8)])
#: Sizes from here on are not told apart; such a text fits any other.
WIDEST = 65535


def packed_rows(rows: np.ndarray, part: np.ndarray, parts: int) -> pa.RecordBatch:
    """(part, rows): records as one binary per part, which keeps an exchange at a few wide rows."""
    order = np.argsort(part, kind="stable")
    blobs = [b.tobytes() for b in np.split(rows[order], np.searchsorted(part[order], np.arange(1, parts)))]
    keep = [i for i, b in enumerate(blobs) if b]
    return pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([blobs[i] for i in keep], pa.binary())], ["part", "rows"])


def unpacked_parts(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[int, np.ndarray]]:
    """The records of each part that ``packed_rows`` made; a part is bounded by ``PART_BYTES`` on average."""
    blobs: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            blobs.setdefault(part, []).append(np.frombuffer(blob.as_buffer(), dtype))
    for part in sorted(blobs):
        yield part, np.concatenate(blobs.pop(part))


def _first_of(rows: np.ndarray, *names: str) -> np.ndarray:
    """Whether a sorted record differs from the one before it in any of the fields."""
    fresh = np.ones(len(rows), bool)
    if len(rows):
        fresh[1:] = np.logical_or.reduce([rows[n][1:] != rows[n][:-1] for n in names])
    return fresh


def meetings(rows: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """``PAIR`` records of the rows that stand in one place and can reach the threshold by size and by place; rows are ordered by t and n."""
    size = rows["n"].astype(np.int64)
    left = np.ceil(rows["left"] * (size / 255) - 1e-9)
    first = np.arange(len(rows))
    step = 0
    while True:
        step += 1
        first = first[: np.searchsorted(first, len(rows) - step)]
        first = first[(rows["t"][first] == rows["t"][first + step]) & ((size[first] >= threshold * size[first + step] - 1e-9) | (size[first + step] == WIDEST))]
        if not len(first):
            return
        other = first + step
        least = np.ceil(threshold / (1 + threshold) * (size[first] + size[other]) - 1e-9)
        fits = (np.minimum(left[first], left[other]) >= least - COMMON + 1) | (size[other] == WIDEST)
        fits &= (rows["side"][first] == 0) | (rows["side"][first] != rows["side"][other])
        a, b = rows["s"][first[fits]], rows["s"][other[fits]]
        out = np.empty(len(a), PAIR)
        out["a"], out["b"], out["have"] = np.minimum(a, b), np.maximum(a, b), 1
        out["need"] = np.minimum(COMMON, least[fits])
        yield out


def counted(pairs: np.ndarray) -> np.ndarray:
    """Equal pairs as one record, their common triples added up (to 255 at most)."""
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    at = np.flatnonzero(_first_of(pairs, "a", "b"))
    if not len(at):
        return pairs
    out = pairs[at]
    out["have"] = np.minimum(255, np.add.reduceat(pairs["have"].astype(np.int64), at))
    return out


def candidates(feats: DataFrame, frequency: tuple[np.ndarray, np.ndarray, int], threshold: float, parts: int) -> DataFrame:
    """(sig_a, sig_b) of the classes with at least ``COMMON`` of their rare triples in common (or all that they must have, if fewer).

    Of each text the most frequent triples by (estimated count, hash), an order common to all, are left out, as many as the
    threshold lets be without losing a pair (see above). Two exchanges: by triple, and by pair.
    """
    order_of_cell, blocks_of_cell, total = frequency
    shared = feats.sparkSession.sparkContext.broadcast((order_of_cell, blocks_of_cell))
    parts = max(parts, -(-total * ROW.itemsize // (2 * PART_BYTES)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of, blocks_of = shared.value
        hold: list[np.ndarray] = []
        parts_of: list[np.ndarray] = []
        held = 0

        def add(value: np.ndarray, sig: np.ndarray, size: np.ndarray, left: np.ndarray, side: np.ndarray | int) -> int:
            rows = np.empty(len(value), ROW)
            rows["t"], rows["s"], rows["n"], rows["left"], rows["side"] = value >> np.uint64(32), sig, size, left, side
            hold.append(rows)
            parts_of.append((value % np.uint64(parts)).astype(np.int64))
            return len(rows)

        def flush() -> pa.RecordBatch:
            out = packed_rows(np.concatenate(hold), np.concatenate(parts_of), parts)
            hold.clear()
            parts_of.clear()
            return out

        for batch in batches:
            sigs, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first in range(0, len(batch), 2000):
                starts, values = shingle_sets(*unpack(batch.column(2).slice(first, 2000).to_pylist()), SIZE)
                sizes = np.diff(starts)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((values, order_of[values >> _SHIFT], owner))
                common = np.ceil(threshold * sizes - 1e-9).astype(np.int64)
                rank = np.arange(len(values)) - starts[:-1][owner]
                few = rank < (sizes - np.maximum(common - COMMON, 0))[owner]
                kept = order[few]
                left = np.ceil(255 * (1 - rank / sizes[owner]) - 1e-9)[few].astype(np.uint8)
                value, of = values[kept], first + owner[kept]
                sig, size = sigs[of], np.minimum(counts[of], WIDEST).astype(np.uint16)
                blocks = blocks_of[value >> _SHIFT].astype(np.int64)
                whole = blocks == 1
                held += add(value[whole], sig[whole], size[whole], left[whole], 0)
                for i in np.flatnonzero(~whole):  # a frequent triple: the text's block meets every block once
                    others = np.arange(blocks[i])
                    own = int(np.uint64(sig[i] & np.int64(2**63 - 1)) % np.uint64(blocks[i]))
                    place = _mix(value[i] + (np.minimum(others, own) * blocks[i] + np.maximum(others, own) + 1).astype(np.uint64) * _B)
                    held += add(place, np.full(len(others), sig[i]), np.full(len(others), size[i]), np.full(len(others), left[i]), np.where(others == own, 0, np.where(own < others, 1, 2)))
                if held > 1_000_000:
                    yield flush()
                    held = 0
        if hold:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            pairs = counted(np.concatenate(hold))
            hold.clear()
            return packed_rows(pairs, (_mix(pairs["a"].view(np.uint64) * _A + pairs["b"].view(np.uint64) * _B) % np.uint64(parts)).astype(np.int64), parts)

        for _, rows in unpacked_parts(batches, ROW):
            rows = rows[np.lexsort((255 - rows["left"], rows["s"], rows["n"], rows["t"]))]
            rows = rows[_first_of(rows, "t", "s")]
            for pairs in meetings(rows, threshold):
                hold.append(pairs)
                held += len(pairs)
                if held > 2_000_000:
                    yield flush()
                    held = 0
        if hold:
            yield flush()

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pairs in unpacked_parts(batches, PAIR):
            pairs = counted(pairs)
            pairs = pairs[pairs["have"] >= pairs["need"]]
            for at in range(0, len(pairs), 1 << 16):
                cut = pairs[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(cut["a"]), pa.array(cut["b"])], ["sig_a", "sig_b"])

    packed = feats.select("sig", "n", "words").mapInArrow(pack, "part int, rows binary").repartitionById(parts, F.col("part"))
    return packed.mapInArrow(meet, "part int, rows binary").repartitionById(parts, F.col("part")).mapInArrow(enough, "sig_a bigint, sig_b bigint")


class BKTree:
    """Burkhard-Keller tree over sketches as integers."""

    def __init__(self) -> None:
        self.root: list | None = None

    def insert(self, sketch: int, item: object) -> None:
        if self.root is None:
            self.root = [sketch, [item], {}]
            return
        node = self.root
        while True:
            distance = (sketch ^ node[0]).bit_count()
            if not distance:
                node[1].append(item)
                return
            child = node[2].get(distance)
            if child is None:
                node[2][distance] = [sketch, [item], {}]
                return
            node = child

    def within(self, sketch: int, radius: int) -> list:
        """Items at most ``radius`` away; only edges whose distance is within the radius are followed."""
        found: list = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            distance = (sketch ^ node[0]).bit_count()
            if distance <= radius:
                found += node[1]
            low, high = distance - radius, distance + radius
            stack += [child for edge, child in node[2].items() if low <= edge <= high]
        return found


#: Bits of the map that says which classes may be needed; 8 MB for any corpus. A full map only lets more rows through to an exact join.
MAP_BITS = 1 << 26


def bit_map(sigs: DataFrame) -> np.ndarray:
    """A bit map of ``MAP_BITS`` bits of the column ``sig``, built by partial aggregation on the executors."""
    low = F.col("sig").bitwiseAND(F.lit(MAP_BITS - 1)) + 1
    parts = sigs.select(low.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for bucket, bits in parts.collect():  # at most MAP_BITS bits
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return out


def marked(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows whose sig has its bit set: all that are in the map, and few others."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def known(sigs: pd.Series) -> pd.Series:
        low = sigs.to_numpy() & (MAP_BITS - 1)
        return pd.Series((shared.value[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1)

    return rows.where(known("sig"))


def ends(pairs: DataFrame) -> DataFrame:
    """(sig): both ends of every pair."""
    return pairs.select(F.explode(F.array("sig_a", "sig_b")).alias("sig"))


#: Nodes of one tree; a class with more candidates has several trees, each with the class as root.
TREE = 512


def tree_pairs(pairs: DataFrame, sketches_of: DataFrame, reach: int, threshold: float) -> DataFrame:
    """(sig_a, sig_b) of the candidates within the radius, found in the BK-tree whose root is sig_a.

    The rows of a class lie together after the join; where a hot class is split over tasks, each has a tree with the same root.
    """
    side_a = sketches_of.select(F.col("sig").alias("sig_a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    side_b = sketches_of.select(F.col("sig").alias("sig_b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    joined = pairs.join(side_b, "sig_b").join(side_a, "sig_a").select("sig_a", "n_a", "sketch_a", "sig_b", "n_b", "sketch_b")

    def search(rows: list[tuple]) -> list[int]:
        sig, n, sketch = rows[0][:3]
        root, tree = int.from_bytes(sketch, "big"), BKTree()
        tree.insert(root, (sig, n))
        for _, _, _, other, m, value in rows:
            tree.insert(int.from_bytes(value, "big"), (other, m))
        return [other for other, m in tree.within(root, reach) if other != sig and min(n, m) >= threshold * max(n, m) - 1e-9]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        found: list[tuple[int, list[int]]] = []

        def emit() -> pa.RecordBatch:
            a = [sig for sig, others in found for _ in others]
            b = [other for _, others in found for other in others]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["sig_a", "sig_b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pending and (pending[0][0] != row[0] or len(pending) >= TREE):
                    found.append((pending[0][0], search(pending)))
                    pending = []
                pending.append(row)
            if len(found) > 10_000:
                yield emit()
        if pending:
            found.append((pending[0][0], search(pending)))
        if found:
            yield emit()

    return joined.sortWithinPartitions("sig_a").mapInArrow(run, "sig_a bigint, sig_b bigint")


def verified(pairs: DataFrame, feats: DataFrame, threshold: float) -> DataFrame:
    """(sig_a, sig_b, similarity) of the pairs whose exact similarity reaches the threshold.

    The words of the class with more partners are sent once, those of the other with each pair.
    """
    degree = ends(pairs).groupBy("sig").agg(F.count("*").alias("d"))
    sided = pairs.join(degree.select(F.col("sig").alias("sig_a"), F.col("d").alias("da")), "sig_a").join(degree.select(F.col("sig").alias("sig_b"), F.col("d").alias("db")), "sig_b")
    hub = F.col("da") >= F.col("db")
    turned = sided.select(F.when(hub, F.col("sig_a")).otherwise(F.col("sig_b")).alias("hub"), F.when(hub, F.col("sig_b")).otherwise(F.col("sig_a")).alias("spoke"))
    sets = marked(feats.select("sig", "words"), bit_map(degree)).join(degree, "sig", "left_semi").dropDuplicates(["sig"])
    joined = turned.join(sets.select(F.col("sig").alias("spoke"), F.col("words").alias("ws")), "spoke").join(sets.select(F.col("sig").alias("hub"), F.col("words").alias("wh")), "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                (start_a, a), (start_b, b) = (shingle_sets(*unpack(batch.column(k).to_pylist()), SIZE) for k in (2, 3))
                similarity = []
                for i in range(len(batch)):
                    joint = np.concatenate([a[start_a[i] : start_a[i + 1]], b[start_b[i] : start_b[i + 1]]])
                    joint.sort()
                    common = int((joint[1:] == joint[:-1]).sum())
                    similarity.append(common / (len(joint) - common))
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similarity, pa.float64())], ["sig_a", "sig_b", "similarity"])
                yield out.filter(pa.array([s >= threshold for s in similarity], pa.bool_()))

    ordered = joined.select(F.least("hub", "spoke").alias("sig_a"), F.greatest("hub", "spoke").alias("sig_b"), "wh", "ws")
    return ordered.mapInArrow(run, "sig_a bigint, sig_b bigint, similarity double")


def _parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def similar_classes(records: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(membership, links): (record_id, sig, n) of every record with enough words, and (sig_a, sig_b, similarity) between
    different classes. A repeated record counts once; an empty table gives two empty results."""
    feats = written(features(records, least_words), "features")
    pairs = written(candidates(feats, frequency_sketch(feats), threshold, _parts(records.sparkSession)), "candidates")
    small = marked(feats.select("sig", "n", "sketch"), bit_map(ends(pairs))).dropDuplicates(["sig"])
    found = written(tree_pairs(pairs, small, radius(threshold), threshold), "bk")
    return feats.select("record_id", "sig", "n").distinct(), written(verified(found, feats, threshold), "links")


def similar_pairs(records: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> DataFrame:
    """(record_id_a, record_id_b): all pairs of different records with the similarity or more, copies expanded."""
    membership, links = similar_classes(records, threshold, least_words)
    classes = written(membership.groupBy("sig").agg(F.count("*").alias("members")).where("members > 1"), "classes")
    membership = written(marked(membership, bit_map(ends(links).unionByName(classes.select("sig")))), "members")  # the others are in no pair
    copies = pairs_within(membership.join(classes, "sig"), ["sig"], "record_id", "members").select("record_id_a", "record_id_b")
    # A class of many copies is cut into blocks, so that no key of the joins holds more than a block of them.
    blocks = membership.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = membership.join(blocks, "sig").select("sig", "record_id", F.pmod(F.xxhash64("record_id"), "blocks").cast("int").alias("block"))
    sided = links.select("sig_a", "sig_b").join(blocks.select(F.col("sig").alias("sig_a"), F.col("blocks").alias("na")), "sig_a").join(blocks.select(F.col("sig").alias("sig_b"), F.col("blocks").alias("nb")), "sig_b")
    sided = sided.withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    left = placed.select(F.col("sig").alias("sig_a"), F.col("block").alias("block_a"), F.col("record_id").alias("l"))
    right = placed.select(F.col("sig").alias("sig_b"), F.col("block").alias("block_b"), F.col("record_id").alias("r"))
    crossed = sided.select("sig_a", "sig_b", "block_a", "block_b").join(left, ["sig_a", "block_a"]).join(right, ["sig_b", "block_b"]).where("l <> r")
    crossed = crossed.select(F.least("l", "r").alias("record_id_a"), F.greatest("l", "r").alias("record_id_b"))
    return copies.unionByName(crossed).distinct()


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(sig, group): connected components by hooking to the least neighbour and pointer jumping.

    Every round is written to the shared folder and halves the depth of the label trees; rounds stop when no label changes.
    """
    edges = written(links.select(F.col("sig_a").alias("a"), F.col("sig_b").alias("b")).unionByName(links.select(F.col("sig_b").alias("a"), F.col("sig_a").alias("b"))), "both")
    labels = written(edges.groupBy(F.col("a").alias("sig")).agg(F.min("b").alias("m")).select("sig", F.least("sig", "m").alias("group")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.sig).groupBy("a").agg(F.min("group").alias("near"))
        hooked = labels.join(near, labels.sig == near.a, "left").select("sig", "group", F.least("group", F.coalesce("near", "group")).alias("low"))
        # The label's own vertex also takes the lower label, so whole trees move at once.
        roots = hooked.groupBy(F.col("group").alias("root")).agg(F.min("low").alias("pull"))
        moved = hooked.join(roots, hooked["low"] == roots["root"], "left").select("sig", F.col("group").alias("old"), F.least("low", F.coalesce("pull", "low")).alias("group"))
        state = written(moved, "labels")
        labels = state.select("sig", "group")
        if not state.where("old <> group").limit(1).count():
            break
    return vertices.select("sig").distinct().join(labels, "sig", "left").select("sig", F.coalesce("group", "sig").alias("group"))


def groups(records: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per record: (record_id, group_id, class_id, links, copies).

    group_id is shared by all records connected by links, links counts the similar classes of the record's own class, copies the records
    with an equal set of triples.
    """
    membership, links = similar_classes(records, threshold, least_words)
    joined = components(membership, links)
    degree = ends(links).groupBy("sig").agg(F.count("*").alias("links"))
    copies = membership.groupBy("sig").agg(F.count("*").alias("copies"))
    out = membership.join(joined, "sig").join(degree, "sig", "left").join(copies, "sig")
    return out.select("record_id", F.col("group").alias("group_id"), F.col("sig").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), "copies")
