from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataforge.llm import mixing, neardup, packing, rankfusion, spans

RANKED = "query_id string, channel string, chunk_id string, score double, rank int, recorded_at timestamp"


# Problem 3


def ranked(spark, data):
    df = spark.createDataFrame(data, "query_id string, channel string, chunk_id string, score double, rank int, at long")
    return df.select("query_id", "channel", "chunk_id", "score", "rank", F.timestamp_seconds("at").alias("recorded_at"), F.lit("clash").alias("value"))


def test_one_channel_with_a_huge_range_does_not_win(spark, rows):
    data = []
    for q in range(12):
        r = random.Random(q)
        for c in range(8):
            quality = 8 - c + r.random()
            for channel, scale in (("dense", 0.1), ("bm25", 1.0), ("rerank", 3.0), ("l2", -1.0)):
                data.append((f"q{q}", channel, f"c{c}", scale * quality, None, 0))
            data.append((f"q{q}", "usage", f"c{c}", 1e6 if c == 7 else float(c), None, 0))
    fused = rankfusion.fuse(ranked(spark, data))
    assert set(rows(rankfusion.leaders(fused), "chunk_id")) <= {("c0",), ("c1",)}
    ordered = rankfusion.order(fused)
    assert ordered.where("position = 1").count() == 12 and ordered.count() == 96


def test_ranks_ties_nulls_and_repeats(spark):
    data = [("q", "dense", "a", 0.9, 1, 0), ("q", "dense", "a", 0.9, 1, 5), ("q", "dense", "b", 0.5, 2, 0), ("q", "dense", "c", 0.5, 2, 0), ("q", "dense", "d", None, 4, 0), ("q", "dense", "e", None, None, 0), ("q", "dense", None, 1.0, 1, 0), (None, "dense", "x", 1.0, 1, 0), ("q", "l2", "a", 0.1, 1, 0), ("q", "l2", "b", 0.9, 2, 0), ("q", "dense", "f", float("nan"), None, 0)]
    got = {(r["channel"], r["chunk_id"]): r["value"] for r in rankfusion.rank_transform(ranked(spark, data)).collect()}
    assert got["dense", "a"] == 1.0 and got["dense", "b"] == got["dense", "c"] == pytest.approx((6 - 2.5 + 1) / 6)
    assert got["dense", "d"] == pytest.approx(0.5) and got["dense", "e"] == 0.0 and got["dense", "f"] == 0.0
    assert got["l2", "a"] > got["l2", "b"]
    assert rankfusion.leaders(rankfusion.fuse(ranked(spark, data).where("false"))).count() == 0


@pytest.mark.parametrize("hot", [10, 100_000])
def test_rank_transform_by_ranges_equals_plain_ranking(spark, hot):
    r = random.Random(3)
    data = [("hot", "bm25", f"c{i}", float(r.randint(0, 300)), None, 0) for i in range(900)]
    got = {x["chunk_id"]: x["value"] for x in rankfusion.rank_transform(ranked(spark, data), hot=hot).collect()}
    scores = np.array([d[3] for d in data])
    for d in data:
        better, equal = (scores > d[3]).sum(), (scores == d[3]).sum()
        assert got[d[2]] == pytest.approx((900 - (better + 1 + (equal - 1) / 2) + 1) / 900)


def test_order_by_ranges(spark):
    r = random.Random(4)
    data = [("big", f"c{i:04d}", float(r.randint(0, 9))) for i in range(500)] + [("small", "c1", 0.1), ("small", "c2", 0.2)]
    df = spark.createDataFrame(data, "query_id string, chunk_id string, projection double")
    plain, ranged = ({(x["query_id"], x["chunk_id"]): x["position"] for x in rankfusion.order(df, hot).collect()} for hot in (1000, 20))
    assert plain == ranged and plain["small", "c2"] == 1 and sorted(v for k, v in plain.items() if k[0] == "big") == list(range(1, 501))


def test_principal_component_equals_the_eigenvector(spark):
    g = np.random.default_rng(3)
    base = g.normal(size=400)
    x = np.stack([base + g.normal(size=400) * s for s in (0.3, 0.5, 1.0, 2.0)], axis=1)
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], "c0 double, c1 double, c2 double, c3 double")
    mean, deviation, loading = rankfusion.principal_component(df, 4)
    _, vectors = np.linalg.eigh(np.corrcoef(x.T))
    want = np.abs(vectors[:, -1])
    assert loading == pytest.approx(want.tolist(), abs=1e-5) and mean == pytest.approx(x.mean(axis=0).tolist(), abs=1e-6)
    opposed = spark.createDataFrame([tuple(map(float, (*row[:3], -row[0]))) for row in x], "c0 double, c1 double, c2 double, c3 double")
    left = rankfusion.principal_component(opposed, 4)[2]
    assert left[3] == 0 and all(v > 0.3 for v in left[:3])


# Problem 7


def test_bk_tree_finds_all_within_the_radius():
    r = random.Random(1)
    values = [r.getrandbits(64) for _ in range(200)] + [0, 0]
    tree = neardup.BKTree()
    for i, v in enumerate(values):
        tree.insert(v, i)
    for query in values[:30]:
        assert sorted(tree.within(query, 28)) == [i for i, v in enumerate(values) if (v ^ query).bit_count() <= 28]
    assert neardup.BKTree().within(3, 64) == []


def texts_with_edits(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(40):
        words = [r.choice(vocabulary) for _ in range(r.choice([8, 12, 30, 90]))]
        out.append(words)
        for _ in range(r.randint(0, 3)):
            changed = list(words)
            for _ in range(r.randint(1, max(1, len(words) // 10))):
                at = r.randrange(len(changed))
                kind = r.randint(0, 2)
                if kind == 0:
                    changed[at] = r.choice(vocabulary)
                elif kind == 1:
                    changed.insert(at, r.choice(vocabulary))
                elif len(changed) > 12:
                    del changed[at]
            if r.random() < 0.3:
                half = len(changed) // 2
                changed = changed[half:] + changed[:half]
            out.append(changed)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_pairs_equal_brute_force(spark, rows, seed):
    texts = texts_with_edits(seed)
    data = [(f"r{i:03d}", t) for i, t in enumerate(texts)] + [("r000", texts[0]), ("copy", texts[3].upper()), ("null", None), (None, texts[3]), ("empty", ""), ("wide", texts[3].replace("w", "ｗ"))]
    df = spark.createDataFrame([(*d, "clash") for d in data], "record_id string, text string, sig string")
    sets = {}
    for ident, text in data:
        if ident and text:
            words = neardup.words_of(text)
            if len(words) >= 12:
                sets[ident] = set(zip(words, words[1:], words[2:], strict=False))
    want = sorted(tuple(sorted(p)) for p in combinations(sets, 2) if len(sets[p[0]] & sets[p[1]]) >= 0.5 * len(sets[p[0]] | sets[p[1]]))
    assert rows(neardup.similar_pairs(df)) == want
    grouped = {r["record_id"]: r["group_id"] for r in neardup.groups(df).collect()}
    assert set(grouped) == set(sets) and all(grouped[a] == grouped[b] for a, b in want)


def test_similar_pairs_of_nothing(spark):
    df = spark.createDataFrame([("a", "too short")], "record_id string, text string")
    assert neardup.similar_pairs(df).count() == 0
    assert neardup.similar_pairs(df.where("false")).count() == 0
    assert neardup.groups(df.where("false")).count() == 0


def recurring(rows_, last):
    return " ".join(f"of a{i} b{i} in the {last}" for i in range(rows_))


SENTENCES = ["red cats chase small mice", "old dogs sleep all day", "two birds sing at dawn"]


@pytest.mark.parametrize(
    "pair",
    [
        (recurring(10, "foo"), recurring(10, "bar")),
        (recurring(100, "foo"), recurring(100, "bar")),
        (" ".join(SENTENCES), " ".join(SENTENCES[::-1])),
    ],
    ids=["10 rows", "100 rows", "sentences"],
)
def test_similar_pairs_without_a_common_run_of_six_words(spark, rows, pair):
    data = [(name, text) for name, text in zip("ab", pair, strict=True)]
    runs, triples = ([set(zip(*(t.split()[k:] for k in range(n)), strict=False)) for t in pair] for n in (6, 3))
    assert not runs[0] & runs[1] and len(triples[0] & triples[1]) >= 0.5 * len(triples[0] | triples[1])
    assert rows(neardup.similar_pairs(spark.createDataFrame(data, "record_id string, text string"))) == [("a", "b")]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "sig_a long, sig_b long")
    vertices = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 200]], "sig long")
    got = {r["sig"]: r["group"] for r in neardup.components(vertices, links).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and got[200] == 200


def near_copies(count):
    base = [f"w{i}" for i in range(30)]
    return [(f"r{i}", " ".join([*base, f"x{i}", f"y{i}"])) for i in range(count)]


def test_a_triple_of_many_texts_is_cut_into_blocks(spark, rows, monkeypatch):
    frequency = neardup.frequency_sketch
    monkeypatch.setattr(neardup, "TREE", 4)
    monkeypatch.setattr(neardup, "BLOCK", 4)

    def cut(feats):
        order, blocks, total = frequency(feats)
        return order, np.where(order > 8, 3, blocks).astype(np.uint16), total

    monkeypatch.setattr(neardup, "frequency_sketch", cut)
    data = near_copies(14)
    data += [(f"copy{i}", data[0][1]) for i in range(9)]
    got = rows(neardup.similar_pairs(spark.createDataFrame(data, "record_id string, text string")))
    assert len(got) == 23 * 22 // 2


def test_frequent_triples_are_told_from_the_load_of_their_cells(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MEET", 10)
    feats = neardup.features(spark.createDataFrame(near_copies(64), "record_id string, text string"))
    _, blocks, total = neardup.frequency_sketch(feats)
    assert total == 64 * 30 and sorted(set(blocks.tolist())) == [1, 7] and (blocks > 1).sum() == 28


def test_trees_skip_what_lies_beyond_the_radius(spark):
    tree, visited = neardup.BKTree(), []
    r = random.Random(6)
    root = r.getrandbits(256)
    tree.insert(root, "root")
    for i in range(300):
        tree.insert(r.getrandbits(256), i)

    class Seen(int):
        def __xor__(self, other):
            visited.append(other)
            return int(self) ^ int(other)

    assert tree.within(Seen(root), neardup.radius(0.5)) == ["root"] and len(visited) < 10


def test_recall_on_repeated_words(spark, rows):
    r = random.Random(8)
    data = []
    for i in range(60):
        words = [r.choice(["to", "be", "or", "not", "that"]) for _ in range(r.randint(12, 40))]
        data.append((f"a{i:02d}", " ".join(words)))
        words[r.randrange(len(words))] = "is"
        data.append((f"b{i:02d}", " ".join(words)))
    sets = {i: (w := t.split()) and set(zip(w, w[1:], w[2:], strict=False)) for i, t in data}
    want = sorted(tuple(sorted(p)) for p in combinations(sets, 2) if len(sets[p[0]] & sets[p[1]]) >= 0.5 * len(sets[p[0]] | sets[p[1]]))
    assert rows(neardup.similar_pairs(spark.createDataFrame(data, "record_id string, text string"))) == want


# Problem 8


def test_pack_keeps_to_all_limits():
    r = np.random.default_rng(4)
    sizes = np.stack([r.integers(1, 900, 500), np.ones(500, int), r.integers(0, 400, 500)], axis=1)
    limits = np.array([2048, 5, 900])
    number = packing.pack(sizes, limits)
    for b in range(number.max() + 1):
        assert (sizes[number == b].sum(axis=0) <= limits).all() and (number == b).any()
    assert sorted(packing.pack(np.array([[3000, 1, 0], [10, 1, 0]]), limits)) == [0, 1]


def test_containers_hold_everything(spark):
    r = random.Random(5)
    data = [(i, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randint(0, 120)))) for i in range(200)] + [(900, "long text here. " * 400), (901, None), (902, ""), (900 + 50, "unbroken" * 900)]
    df = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, tokens int")
    got = packing.containers(df, 256, max_segments=6, shard=64).toPandas()
    filled = got.groupby("container")
    assert filled.tokens.sum().max() <= 256 and filled.size().max() <= 6
    by_item = {k: v.sort_values("piece") for k, v in got.groupby("item_id")}
    texts = {i: t for i, t in data if t}
    assert set(by_item) == set(texts)
    for item, pieces in by_item.items():
        assert "".join(texts[item][a:b] for a, b in zip(pieces.start_offset, pieces.end_offset, strict=True)) == texts[item]
        assert len(pieces) == 1 or item in (900, 950)
    assert packing.containers(df.where("false"), 256).count() == 0


def test_loss_limit_binds(spark):
    df = spark.createDataFrame([(i, "question words here\n\n" + "answer " * 40) for i in range(30)], "doc_id long, text string")
    got = packing.containers(df, 400, max_loss=100).toPandas()
    assert got.groupby("container").loss.sum().max() <= 100


def test_default_loss_limit_binds(spark):
    df = spark.createDataFrame([(i, "answer " * (20 + i % 9)) for i in range(200)], "doc_id long, text string")
    got = packing.containers(df, 512, max_segments=1000, shard=64).toPandas().groupby("container")
    free = packing.containers(df, 512, max_segments=1000, max_loss=512, shard=64).toPandas().groupby("container")
    assert got.loss.sum().max() <= 496 < free.loss.sum().max() and len(got) >= len(free)


# Problem 9


def test_plan_reaches_shares_and_caps():
    take = mixing.plan({"a": 1000, "b": 100}, {"a": (0.5, 1), "b": (0.5, 3), "gone": (0.2, 1)})
    assert take == {"a": 300, "b": 300}
    assert mixing.plan({"a": 1000, "b": 100}, {"a": (0.5, 1), "b": (0.5, 3)}, total=1000) == {"a": 500, "b": 300}
    assert mixing.plan({}, {"a": (1.0, 1)}) == {}


def test_mixture(spark):
    weights = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 4), ("c", 0.1, 2), ("gone", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    data = [(i, "abc"[min(2, i % 4)], 20 + i % 7) for i in range(4000)]
    sized = spark.createDataFrame(data, "doc_id long, source string, tokens long")
    mixed = mixing.mixture(sized, weights, block=512).cache()
    shares = {r["source"]: r for r in mixing.report(mixed, weights).collect()}
    for source, target in (("a", 0.6), ("b", 0.3), ("c", 0.1)):
        assert shares[source]["actual_share"] == pytest.approx(target / 1.0, abs=0.01)
        assert shares[source]["most_uses"] <= shares[source]["max_repeats"]
    assert shares["gone"]["tokens"] == 0
    used = mixed.select("slot", "source").distinct().groupBy("slot").count()
    assert used.where("count > 1").count() == 0  # a slot holds one source
    early = mixed.orderBy("slot", "place").limit(1500).groupBy("source").agg(F.sum("tokens").alias("t")).collect()
    total = sum(r["t"] for r in early)
    assert {r["source"]: round(r["t"] / total, 1) for r in early} == {"a": 0.6, "b": 0.3, "c": 0.1}
    assert mixed.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    assert mixing.mixture(sized.where("false"), weights).count() == 0


def test_slots_suffice_for_every_share():
    golden = 0x9E3779B97F4A7C15
    r = random.Random(1)
    for share in (0.001, 0.02, 0.3, 0.9):
        for blocks in (1, 7, 300):
            n, low = mixing.slots_for(blocks, share), r.random() * (1 - share)
            inside = sum(low <= ((i + 1) * golden % 2**64) / 2**64 < low + share for i in range(n))
            assert inside >= blocks


def test_shares_within_any_stretch_of_the_schedule(spark):
    take = {"a": 600_000, "b": 300_000, "c": 100_000}
    slots = {r["slot"]: r["which"] for r in mixing.schedule(spark, take, 1000).where("slot < 1000").collect()}
    for first in range(0, 900, 37):
        part = [slots[i] for i in range(first, first + 100)]
        assert all(abs(part.count(i) - 100 * share) <= 4 for i, share in enumerate((0.6, 0.3, 0.1)))


def test_a_stated_total_reports_what_caps_keep_short(spark):
    weights = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    sized = spark.createDataFrame([(i, "ab"[i % 20 == 0], 10) for i in range(400)], "doc_id long, source string, tokens long")
    got = {r["source"]: r for r in mixing.report(mixing.mixture(sized, weights, total=2000, block=64), weights).collect()}
    assert got["b"]["tokens"] == 400 and got["b"]["most_uses"] == 2 and got["a"]["tokens"] == 1000 and got["b"]["actual_share"] < 0.3


# Problem 10


def brute(texts, least):
    out = set()
    for (i, a), (j, b) in combinations(texts, 2):
        if a and b and i != j and {a[k : k + least] for k in range(len(a) - least + 1)} & {b[k : k + least] for k in range(len(b) - least + 1)}:
            out.add((min(i, j), max(i, j)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_pairs_equal_brute_force(spark, rows, seed):
    r = random.Random(seed)
    alphabet = "abcdefgh é🧭\n"
    make = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    passages = [make(200), make(201), make(199), make(400), "ab" * 150]
    texts = [(i, make(r.randint(0, 300)) + (r.choice(passages) if r.random() < 0.6 else "") + make(r.randint(0, 300))) for i in range(40)]
    texts += [(50, texts[0][1]), (51, None), (52, ""), (53, "z" * 900), (54, "z" * 250), (55, "z" * 199)]
    df = spark.createDataFrame([(*t, 1) for t in texts] + [(0, texts[0][1], 1)], "doc_id long, text string, edge int")
    pairs = spans.shared_pairs(df)
    assert rows(pairs, "doc_a", "doc_b") == brute([t for t in texts if t[1]], 200)


def test_coverage(spark):
    shared = "".join(random.Random(9).choice("abcdefghij ") for _ in range(300))
    df = spark.createDataFrame([(1, "x" * 100 + shared), (2, shared + "y" * 50), (3, "nothing"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_chars"], r["shared_chars"], r["partners"]) for r in spans.coverage(df).collect()}
    assert got == {1: (400, 300, 1), 2: (350, 300, 1), 3: (7, 0, 0), 4: (0, 0, 0)}
    assert spans.coverage(df.where("false")).count() == 0


def test_coverage_of_a_passage_that_stands_twice(spark):
    r = random.Random(11)
    make = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage, other = make(300), make(120)
    twice = passage + other + passage
    for texts in ((passage, twice), (twice, passage)):
        df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
        got = {r["doc_id"]: r["shared_chars"] for r in spans.coverage(df).collect()}
        assert got == {i: 600 if t == twice else 300 for i, t in enumerate(texts, 1)}


@pytest.mark.parametrize("often", [64, 0], ids=["plain keys", "finer keys"])
def test_coverage_equals_brute_force(spark, monkeypatch, often):
    monkeypatch.setattr(spans, "COMMON_PATH", often)
    r = random.Random(12)
    make = lambda n: "".join(r.choice("abcdefg ü🧭\n") for _ in range(n))
    passages = [make(n) for n in (198, 200, 203, 260, 420)] + ["-" * 230, "ab" * 120, "-" * 80]
    texts = []
    for _ in range(30):
        parts = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(passages)
            low = r.choice([0, 0, 0, 5, 60])
            parts += [make(r.randint(0, 90)), p[low : r.choice([len(p), len(p), 205])]]
        texts.append("".join(parts))
    texts += [texts[0], texts[0], passages[3], passages[3][:210] + make(50) + passages[3]]
    windows = [{t[i : i + 200] for i in range(len(t) - 199)} for t in texts]
    want = {}
    for i, t in enumerate(texts):
        others = set().union(*(w for j, w in enumerate(windows) if j != i))
        marks = {k + m for k in range(len(t) - 199) if t[k : k + 200] in others for m in range(200)}
        want[i] = (len(t), len(marks), sum(bool(windows[i] & w) for j, w in enumerate(windows) if j != i))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_chars"], x["shared_chars"], x["partners"]) for x in spans.coverage(df).collect()}
    assert got == want


def test_kept_edges_depend_on_their_document_alone():
    r = random.Random(2)
    a, b = ("".join(r.choice("abcdef ") for _ in range(400)).encode() for _ in range(2))
    alone = set(spans.edges_of(np.frombuffer(a, np.uint8), np.array([0, 400]), spans.K, spans.WINDOW)[0].tolist())
    both = spans.edges_of(np.frombuffer(a + b, np.uint8), np.array([0, 400, 800]), spans.K, spans.WINDOW)
    assert {h for h, at in zip(*both, strict=True) if at < 400} == alone
    assert spans.window_for(200, 64) == 46
