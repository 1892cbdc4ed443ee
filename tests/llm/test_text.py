from __future__ import annotations

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataforge.llm import canon, markup, split, tokens

RECORD = "record_kind string, record_id string, text string, canon string"


# Problem 6


@pytest.mark.parametrize(
    ("text", "expected"),
    [("ｆｕｌｌ１", "full1"), ("cafe\u0301", "café"), ("e\u200b\u0301", "é"), ("zero\u200bwidth\ufeff", "zerowidth"), ("a\u00a0b\u202fc", "a b c"), ("раура", "paypa"), ("ﬁne ﬂow", "fine flow"), ("co\u2011op", "co-op"), ("\u212b", "Å"), ("\u0430\u0308", "ä"), ("naïve", "naïve"), ("A\nb", "A\nb"), ("", "")],
)
def test_canonical(text, expected):
    assert canon.canonical(text) == expected


def test_canonical_of_null():
    assert canon.canonical(None) is None


@given(st.text(alphabet=st.sampled_from("aeo AÉé\u0301\u0308\u200b\u00a0ｆеоﬁ-\u2010\n🧭ñ\u0327"), max_size=40))
@settings(max_examples=200, deadline=None)
def test_canonical_is_idempotent_and_ignores_composition(text):
    once = canon.canonical(text)
    assert canon.canonical(once) == once
    assert canon.canonical(unicodedata.normalize("NFD", text)) == canon.canonical(unicodedata.normalize("NFC", text))


def test_mapping_has_no_conflict():
    mapping = canon.build_mapping()
    assert all(not any(c in mapping for c in value) for value in mapping.values())


def test_lookalike_pairs(spark, rows):
    data = [("chunk", "a", "See also"), ("chunk", "b", "See\u00a0also"), ("chunk", "b", "See\u00a0also"), ("chunk", "c", "See also"), ("chunk", "d", "see also"), ("document", "e", "See\u2002also"), ("chunk", "n", None), (None, "x", "See also"), ("chunk", "m", ""), ("chunk", "o", "\u200b")]
    df = spark.createDataFrame([(*r, "clash") for r in data], RECORD)
    assert rows(canon.lookalike_pairs(df)) == [("chunk", "a", "b"), ("chunk", "b", "c"), ("chunk", "m", "o")]
    assert canon.lookalike_pairs(df.where("false")).count() == 0


def test_pairs_of_a_group_larger_than_a_block(spark, monkeypatch):
    from strataforge.llm import pairs

    monkeypatch.setattr(pairs, "BLOCK", 4)
    df = spark.createDataFrame([("g", i, 15) for i in range(15)], "k string, i int, n int")
    got = pairs.pairs_within(df, ["k"], "i", "n")
    assert sorted((r["i_a"], r["i_b"]) for r in got.collect()) == [(a, b) for a in range(15) for b in range(a + 1, 15)]


# Problem 1


@pytest.mark.parametrize("seed", range(40))
def test_pieces_keep_to_the_limit_and_lose_nothing(seed):
    r = random.Random(seed)
    text = "".join(r.choice("ab \n.\u0301") for _ in range(r.randint(0, 300)))
    most = r.randint(2, 60)
    overlap = r.randint(0, most - 1)
    got = split.pieces(text, most, overlap, r.sample(range(len(text) + 1), min(len(text), 5)))
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(end - start <= most for start, end, _ in got)
    assert all(a[1] >= b[0] > a[0] and b[1] > a[1] for a, b in zip(got, got[1:], strict=False))


def test_pieces_cut_at_natural_places_with_about_the_overlap():
    text = "\n\n".join(" ".join(["word"] * 30) + "." for _ in range(40))
    got = split.pieces(text, 1000, 100)
    assert {level for _, _, level in got[:-1]} == {"paragraph"}
    assert all(60 <= a[1] - b[0] <= 140 for a, b in zip(got, got[1:], strict=False))
    assert split.pieces("x" * 50, 20, 5)[1][:2] == (15, 35)
    assert split.pieces(None, 10, 2) == [] and split.pieces("", 10, 2) == [(0, 0, "end")]
    with pytest.raises(ValueError):
        split.pieces("a", 5, 5)


def test_split_items(spark, rows):
    limits = spark.createDataFrame([("document", "code_points", 10, 2), ("container", "tokens", 5, 0)], "item_kind string, unit string, max_size int, overlap_size int")
    items = spark.createDataFrame([("document", "1", "x" * 10, None), ("document", "2", "é" * 11, [5, None]), ("document", None, "y" * 50, None), ("document", "3", None, None), ("other", "4", "z" * 50, None), ("document", "5", "", [])], "item_kind string, item_id string, text string, starts array<int>")
    cut = split.split_items(items, limits)
    assert rows(cut.select("item_id").distinct()) == [("2",)]
    assert "".join(r["content"] for r in cut.orderBy("piece").collect()).count("é") >= 11
    assert rows(split.split_items(items, limits, only_oversized=False), "item_id", "piece") == [("1", 0), ("2", 0), ("2", 1), ("5", 0)]
    assert split.split_items(items.where("false"), limits).count() == 0


def test_split_by_tokens(spark):
    limits = spark.createDataFrame([("document", "tokens", 6, 1)], "item_kind string, unit string, max_size int, overlap_size int")
    items = spark.createDataFrame([("document", "1", "one two three four five six seven eight nine ten", None)], "item_kind string, item_id string, text string, starts array<int>")
    got = split.split_items(items, limits, measure=tokens.token_prefix).orderBy("piece").collect()
    assert len(got) > 1 and all(len(tokens.encoding().encode_ordinary(r["content"])) <= 7 for r in got)


# Problem 5


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("plain text, R&D share 40 %, a * b, *.py or a * b, not C#.", []),
        ("snake_case_name and x < y > z, size 5 × 7", []),
        ("# Title\n\ntext", ["markdown"]),
        ("# item\n\n== Heading ==", ["wiki"]),
        ("* item\n\n[[Page|text]]", ["wiki"]),
        ("* item\n\n**bold**", ["markdown"]),
        ("text with <b>bold</b> &amp; more", ["html"]),
        ("left <!-- gone --> over", ["html"]),
        ("```\n<b>code</b> \\alpha [[x]]\n```", ["markdown"]),
        ("`<b>` and `\\cite{x}`", ["markdown"]),
        ("The bound is $x_{i}^2$ here.", ["latex"]),
        ("it costs $5 and $6", []),
        ("\\begin{verbatim}\n**no** <b>\n\\end{verbatim}", ["latex"]),
        ("a~\\cite{k} b", ["latex"]),
        ("%[https://example.org]", []),
        ("C:\\temp\\new and a\\b", []),
        ("== H ==\n\n code [[no]] <b>\n code\n", ["wiki"]),
        ("<pre><code>**no** \\alpha</code></pre>", ["html"]),
        ("Title\n=====\n\ntext", ["markdown"]),
        ("", []),
    ],
)
def test_kinds_of_markup(text, kinds):
    assert markup.parse(text).kinds() == kinds


@pytest.mark.parametrize("line", ["- item", "-   item", "-\titem", "+  item", "*  item", "1.  item", "1.\titem", "2)\titem", ":   text", ";\ttext", "\t\t\t\t== head ==", "## head", "> quote", "~~~", "=====", "-----"])
def test_short_cut_of_plain_text_lets_all_markup_through(line, monkeypatch):
    text = f"Intro\n\nfirst\n{line}\nlast"
    got = markup.parse(text)
    monkeypatch.setattr(markup, "_ANY", re.compile(""))
    want = markup.parse(text)
    assert got.nodes == want.nodes and got.kinds() == want.kinds() != []


def test_long_formulas_and_deep_nesting_are_whole():
    formula = "$" + " + ".join(f"x_{i}" for i in range(80)) + "$"
    assert markup.clean(f"Sum {formula} here.") == (f"Sum {formula} here.", ["latex"])
    braces = "core"
    for _ in range(12):
        braces = "\\textbf{" + braces + " x}"
    assert markup.clean(braces)[0] == "core" + " x" * 12
    template = "{{a}}"
    for _ in range(6):
        template = "{{b|" + template + "}}"
    assert markup.clean(f"in {template}out") == ("in out", ["wiki"])
    assert markup.clean("[a [b [c [d](u)](v)](w)](x)")[0] == "a b c d"
    assert markup.clean("_a *b _c *d* e_ f* g_")[0] == "a b c d e f g"


def test_short_cut_of_plain_text_changes_nothing(monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice(["a", "b c", "\n", "\n\n", " ", "\t", "-", "+", ":", ";", "1.", "2)", "=", "#", "_"]) for _ in range(r.randint(1, 12))) for _ in range(3000)]
    got = [markup.clean(t) for t in texts]
    monkeypatch.setattr(markup, "_ANY", re.compile(""))
    assert [g[1] for g in got] == [markup.clean(t)[1] for t in texts]
    assert markup.clean("Intro\n\n-  one\n-  two")[0] == "Intro\n\n- one\n- two"


def test_clean_text_keeps_structure():
    clean, _ = markup.clean("<h1>Head</h1><p>Some <b>bold</b> text, with &amp; more.</p><ul><li>one</li><li>two</li></ul><pre>x &lt; 1</pre>")
    assert clean == "# Head\n\nSome bold text, with & more.\n\n- one\n- two\n\n```\nx < 1\n```"
    clean, _ = markup.clean("== Head ==\n\n* ''one''\n* [[Two|two]]\n\n{|\n! a\n! b\n|-\n| 1\n| 2\n|}")
    assert clean == "# Head\n\n- one\n- two\n\na | b\n1 | 2".replace("# Head", "## Head")
    clean, _ = markup.clean("\\section{Head}\n\n\\begin{itemize}\n\\item one\n\\item \\textbf{two}\n\\end{itemize}\n\n\\begin{equation}\nx^2\n\\end{equation}")
    assert "# Head" in clean and "- one" in clean and "- two" in clean and "$$\nx^2\n$$" in clean
    assert markup.clean("1. one\n2. two\n\n<ol><li>x</li></ol>")[0] == "1. one\n2. two\n3. x"
    assert markup.clean(None) == (None, []) and markup.clean("") == ("", [])


def test_tag_path_ratios_drop_page_furniture():
    page = "<nav><a href='/'>Home</a> <a href='/x'>About</a></nav>" + "".join(f"<p>{'A sentence with some words, and a stop. ' * 6}</p>" for _ in range(8)) + "<footer>Imprint</footer>"
    clean, _ = markup.clean(page)
    assert "Home" not in clean and "Imprint" not in clean and clean.count("A sentence") == 48
    nodes = markup.parse(page).nodes
    value = markup.ratios(nodes)
    assert value[0] < value[4]


def test_long_text_and_table(spark, rows):
    long = "**b** word " * 100_000
    df = spark.createDataFrame([("chunk", "a", long), ("chunk", "b", None), ("chunk", None, "**x**"), ("chunk", "c", "**x**"), ("chunk", "c", "**x**")], "record_kind string, record_id string, text string")
    assert rows(markup.found(df)) == [("chunk", "a", "markdown"), ("chunk", "c", "markdown")]
    assert markup.convert(df).where("record_id = 'b'").first()["clean_text"] is None
    assert markup.found(df.where("false")).count() == 0


def test_token_prefix_counts():
    text = "naïve café 🧭 words"
    prefix = tokens.token_prefix(text)
    assert prefix[0] == 0 and prefix[-1] == len(tokens.encoding().encode_ordinary(text)) and prefix == sorted(prefix)


def test_counts_of_rows(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "i int, text string")
    assert [r["tokens"] for r in tokens.with_counts(df, "text").orderBy("i").collect()] == [2, 0, 0]
    assert tokens.with_counts(df, "text").where(F.col("tokens") < 0).count() == 0
