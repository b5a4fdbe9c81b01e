import random

import pytest

from kgspark.llm import tiling as T


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id bigint, text string, d string, item_id int")
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id bigint, text string, t string")
    return {(r.doc_id, r.item_id): r for r in T.leaks(d, i, **how).collect()}


def runs(a, b):
    """Longest common run of words, by brute force."""
    a, b = T.words(a), T.words(b)
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def texts(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [" ".join(r.choices(vocabulary, k=r.randrange(10, 40))) for _ in range(6)]
    docs = []
    for _ in range(25):
        parts = []
        for _ in range(r.randrange(1, 5)):
            w = r.choice(items).split()
            a = r.randrange(len(w))
            parts.append(r.choice([" ", ", ", "\n"]).join(w[a : a + r.randrange(1, 20)]).upper() if r.random() < 0.5 else " ".join(r.choices(vocabulary, k=5)))
        docs.append(" ... ".join(parts))
    return docs, items


@pytest.mark.parametrize("least", [5, 13])
@pytest.mark.parametrize("way", [1 << 20, 100])
def test_both_ways_find_what_brute_force_finds(spark, least, way):
    docs, items = texts(least)
    got = run(spark, list(enumerate(docs)), list(enumerate(items)), least=least, block_bytes=way)
    want = {(d, i): n for d, t in enumerate(docs) for i, u in enumerate(items) if (n := runs(t, u)) >= least}
    assert {k: r.longest for k, r in got.items()} == want


def test_reordered_passages_are_covered(spark):
    w = [f"t{i}" for i in range(40)]
    item = " ".join(w)
    doc = " ".join([*w[20:], "x", *w[:20], "y"])
    got = run(spark, [(1, doc)], [(9, item)], least=5, cover=0.9)[1, 9]
    assert got.tiles == 2 and got.words_found == 40 and got.coverage == 1.0


def test_a_word_is_used_once(spark):
    w = [f"t{i}" for i in range(15)]
    got = run(spark, [(1, " ".join(w * 3))], [(9, " ".join(w))], least=13)[1, 9]
    assert got.tiles == 1 and got.coverage == 1.0


def test_threshold_of_words(spark):
    w = [f"t{i}" for i in range(30)]
    got = run(spark, [(1, " ".join(w[:12])), (2, " ".join(w[:13])), (3, "-".join(w[5:20]).upper())], [(9, " ".join(w))])
    assert set(got) == {(2, 9), (3, 9)}


@pytest.mark.parametrize("way", [1 << 20, 100])
def test_odd_rows(spark, way):
    t = " ".join(f"a{i}" for i in range(20))
    docs = [(1, None), (2, ""), (3, "...!?"), (None, t), (4, t), (4, t), (5, "filler " * 50_000 + t)]
    items = [(1, t), (1, t), (2, None), (None, t), (3, "too short"), (4, "")]
    got = run(spark, docs, items, block_bytes=way)
    assert set(got) == {(4, 1), (5, 1)}
    assert run(spark, [], items, block_bytes=way) == {} and run(spark, docs, [], block_bytes=way) == {}


def test_a_window_that_all_share_in_one_block_and_in_many(spark):
    """A notice in every document and item: both ways give every pair, and as many rows as there are pairs."""
    notice = " ".join(f"n{i}" for i in range(15))
    docs = [(i, f"d{i} {notice} e{i}") for i in range(400)]
    items = [(i, f"q{i} {notice} " + " ".join(f"z{i}x{k}" for k in range(9))) for i in range(30)]
    one, many = (run(spark, docs, items, block_bytes=b) for b in (1 << 20, 1500))
    assert one == many and len(one) == 400 * 30 and {r.longest for r in one.values()} == {15}


def slow_tiles(a, b, least):
    """Greedy string tiling word by word."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0,)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not (ma[i + k] or mb[j + k]):
                    k += 1
                best = max(best, (k, -i, -j))
        if best[0] < least:
            return out
        k, i, j = best[0], -best[1], -best[2]
        ma[i : i + k] = mb[j : j + k] = [True] * k
        out.append((i, j, k))


@pytest.mark.parametrize("seed", range(30))
def test_tiles_against_brute_force(seed):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(r.choice([1, 2, 3, 30]))]
    a, b = r.choices(v, k=r.randrange(0, 45)), r.choices(v, k=r.randrange(0, 45))
    if r.random() < 0.5:
        a = a + b[5:30] + a[:10] + b[:12]
    assert T.tiles(a, b, 3) == slow_tiles(a, b, 3)


def test_repetitive_texts_end_soon():
    assert T.tiles(["la"] * 50_000, ["la"] * 200, 13) == [(0, 0, 200)]
    assert len(T.tiles(["la"] * 20_000 + ["x"], ["x"] + ["la"] * 300, 13)) == 1


def test_tiles_take_the_longest_first():
    a = "x a b c d e f y b c d".split()
    b = "a b c d e f z b c d".split()
    assert T.tiles(a, b, 3) == [(1, 0, 6), (8, 7, 3)]
