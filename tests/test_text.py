import random

import pytest
from pyspark.sql import functions as F

from kgspark.functions import text as T


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "raw,want",
    [("  Café  Noir ", "cafe noir"), ("Straße", "strasse"), ("ﬁle", "file"), ("C++ / Rust!", "c rust"), ("snake_case", "snake_case"), ("Ω-3", "ω 3"), (None, ""), ("", ""), ("…", "")],
)
def test_normalize(spark, raw, want):
    assert one(spark, T.normalize, raw) == want == T.fold(raw)


@pytest.mark.parametrize("raw,want", [("Code Artifact", "code_artifact"), ("__x--Y__", "x_y"), (None, "concept"), ("  ", "concept"), ("!!", "concept"), ("a" * 60, "a" * 40)])
def test_normalize_type(spark, raw, want):
    assert one(spark, T.normalize_type, raw) == want


@pytest.mark.parametrize(
    "raw,want",
    [
        ("partial_fit () / SGD (update API)", "partial_fit"), ("A (b)", "A (b)"), ("plain name", "plain name"),
        ("one two three four five six seven eight nine ten eleven", "one two three four five six seven eight nine"), ("x" * 60, "x" * 46),
    ],
)
def test_short_name(spark, raw, want):
    assert one(spark, T.short_name, raw) == want


@pytest.mark.parametrize("raw,want", [("The  Graph", "Graph"), ("an apple", "apple"), ("Theory", "Theory"), ("a", "a"), ("the the end", "the end")])
def test_clean_name(spark, raw, want):
    assert one(spark, T.clean_name, raw) == want


@pytest.mark.parametrize(
    "a,b,want",
    [("pc", "personal computer", True), ("pcs", "personal computer", True), ("gnn", "graph neural network", True), ("graph neural network", "gnn", True), ("pc", "people", False), ("x", "x y", False), ("сша", "соединенные штаты америки", True), ("abcdefs", "a b c d e f", True), ("p c", "personal computer", True), ("abcdefg", "a b c d e f g", False), ("ai model", "artificial intelligence", False)],
)
def test_acronyms(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(T.is_acronym_pair(F.col("a"), F.col("b"))).first()
    assert row[0] is want


@pytest.mark.parametrize("q,want", [("hi", True), ("hi what's up", True), ("Thanks!!", True), ("what's up with batch learning", False), ("", False), (None, False), ("hi " * 9, False)])
def test_small_talk(spark, q, want):
    assert one(spark, T.is_small_talk, q) is want


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_ratio_against_the_table():
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choices("abcé ", k=r.randrange(12))) for _ in "ab")
        assert T.lcs(a, b) == slow_lcs(a, b)
    assert T.ratio_of("cybercrime", "cyber crime") == pytest.approx(2000 / 21)
    assert T.ratio_of("", "") == 100 and T.ratio_of("a", "") == 0


def test_partial_ratio():
    assert T.partial_ratio_of("neo4j", "what does neo4j use") == 100
    assert T.partial_ratio_of("kubernetes", "how do kubernets work") > 82
    assert T.partial_ratio_of("", "abc") == 0 and T.partial_ratio_of("", "") == 100


def test_length_bound_is_exact(spark):
    r = random.Random(2)
    rows = [("a" * r.randrange(1, 20), "a" * r.randrange(1, 20)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.ratio_can_reach(F.col("a"), F.col("b"), 88.0).alias("ok"), T.ratio("a", "b").alias("r"))
    assert all(x.ok == (x.r >= 88) for x in df.collect())


def test_listed_and_highlight(spark):
    assert one(spark, T.listed, ["a", "b", "c"], "array<string>") == "a, b and c"
    assert one(spark, T.listed, ["a"], "array<string>") == "a"
    df = spark.createDataFrame([("AI explains ai.", "ai"), ("a.b ab", "a.b"), ("x", "")], "t string, n string")
    assert [r[0] for r in df.select(T.highlight(F.col("t"), F.col("n"))).collect()] == ["<mark>AI</mark> explains <mark>ai</mark>.", "<mark>a.b</mark> ab", "x"]


def test_snippet():
    text = "First one. " * 40 + "Here is the Node we want. " + "Last one. " * 40
    cut, trimmed = T.sentence_around(text, None, None, "node")
    assert "Here is the Node we want." in cut and trimmed and cut.startswith("… ") and cut.endswith(" …")
    assert T.sentence_around("short text", None, None, "absent") == ("short text", False)


def test_shapes(spark):
    got = {r[0]: r[1] for r in spark.createDataFrame([("person",), ("drug",), ("drug",)], "x string").select("x", T.shape_for(F.col("x"))).collect()}
    assert got["person"] == "ellipse" and got["drug"] in T.SPARE_SHAPES


def test_markdown():
    from kgspark.functions.markdown import blocks

    text = "# Head **b**\nline one\nline `two`\n\n- a\n- _c_ d\n1. n\n```\n**raw**\n```\nend <b>x</b>"
    assert blocks(text) == [
        (0, "h4", "text", "Head "), (0, "h4", "strong", "b"), (1, "p", "text", "line one"), (1, "p", "text", " "), (1, "p", "text", "line "), (1, "p", "code", "two"),
        (2, "ul", "text", "a"), (3, "ul", "em", "c"), (3, "ul", "text", " d"), (4, "ol", "text", "n"), (5, "pre", "text", "**raw**"), (6, "p", "text", "end <b>x</b>"),
    ]
    assert blocks(None) == []


def test_spans_and_client_shapes(spark):
    df = spark.createDataFrame([(["9-12", "2-4", "x", "3", "1-b"],), ([],)], "s array<string>")
    assert [[tuple(x) for x in r[0]] for r in df.select(T.parse_spans(F.col("s"))).collect()] == [[(2, 4), (9, 12)], []]
    h = 0
    for c in "drug":
        h = (h * 31 + ord(c)) % 2**32
    assert one(spark, T.rolling_shape, "Drug") == T.SPARE_SHAPES[h % 15] and one(spark, T.rolling_shape, None) == "hexagon"


def test_many_pairs_at_once_are_as_one_by_one():
    import random

    import pandas as pd

    r = random.Random(9)
    word = lambda n: "".join(r.choices("abc dé文", k=n))
    a = [word(r.choice([0, 1, 2, 5, 20, 63, 64, 90])) for _ in range(300)]
    b = [word(r.choice([0, 1, 3, 8, 40, 130])) for _ in range(300)]
    for whole, one in ((True, T.ratio_of), (False, T.partial_ratio_of)):
        got = T._ratios(pd.Series(a), pd.Series(b), whole)
        assert list(got) == pytest.approx([one(x, y) for x, y in zip(a, b)])
    assert list(T._ratios(pd.Series([None, "a"]), pd.Series(["a", None]), True)) == [0.0, 0.0]
    assert len(T._ratios(pd.Series([], dtype=str), pd.Series([], dtype=str), False)) == 0
