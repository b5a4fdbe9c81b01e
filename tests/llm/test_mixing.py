import random

import pytest

from kgspark.llm import mixing as M

DOCS = "doc_id bigint, source string, text string, key string, tokens string, copies int"
TARGETS = "source string, target_share double, max_repeats int"


def mix(spark, docs, targets, **how):
    d = spark.createDataFrame([(*x, "c", "c", 0) for x in docs], DOCS)
    m, r = M.mixture(d, spark.createDataFrame(targets, TARGETS), **how)
    return {x.doc_id: x for x in m.collect()}, {x.source: x for x in r.collect()}


def corpus(n=900, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.choice(["big-one"] * 6 + ["Big One", "mid_two"] * 1 + ["small"])
        out.append((i, s, " ".join(f"w{r.randrange(999)}" for _ in range(r.randrange(1, 60)))))
    return out


TARGET = [("big-one", 0.4, 1), ("mid-two", 0.3, 3), ("small", 0.3, 2), ("none-there", 0.1, 4)]


def test_shares_and_caps(spark):
    docs = corpus()
    got, report = mix(spark, docs, TARGET)
    assert all(g.copies <= {"big-one": 1, "mid-two": 3, "small": 2}[g.source] for g in got.values())
    for s, r in report.items():
        mine = [g for g in got.values() if g.source == s]
        assert r.mixed_tokens == sum(g.tokens * g.copies for g in mine)
        assert r.mixed_tokens == pytest.approx(r.wanted_tokens, rel=0.002, abs=1)
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    assert report["none-there"].mixed_tokens == 0


def test_a_wanted_total(spark):
    _, report = mix(spark, corpus(), [("big one", 0.75, 1), ("MID_TWO", 0.25, 1)], total_tokens=4000)
    assert report["big one"].mixed_tokens == pytest.approx(3000, abs=12)
    assert report["big one"].actual_share == pytest.approx(0.75, abs=0.01)


def test_one_large_document_among_small_ones(spark):
    """A document that holds three quarters of its source: the others make up for it, taken or not, to less than one of them."""
    docs = [(0, "s", "word " * 3000)] + [(i, "s", f"some words of {i} " * 3) for i in range(1, 80)]
    for seed, total in enumerate((500, 2500, 3500)):
        got, report = mix(spark, docs, [("s", 1.0, 4)], total_tokens=total, seed=seed)
        assert report["s"].mixed_tokens == pytest.approx(total, rel=0.01, abs=14) and max(g.copies for g in got.values()) <= 4


def test_a_small_document_is_repeated_as_often_as_it_takes(spark):
    got, report = mix(spark, [(0, "s", "word " * 5000), (1, "s", "a"), (2, "s", "b c")], [("s", 1.0, 4000)], total_tokens=3001)
    assert report["s"].mixed_tokens == 3001 and set(got) <= {1, 2} and max(g.copies for g in got.values()) <= 4000


def test_deterministic_but_for_the_seed(spark):
    docs = corpus(200)
    a, b, c = (mix(spark, docs, TARGET, seed=s)[0] for s in (1, 1, 2))
    pick = lambda x: {k: v.copies for k, v in x.items()}
    assert pick(a) == pick(b) != pick(c)


def test_inclusion_follows_the_weights(spark):
    """Texts delivered eight times weigh an eighth: over many seeds each copy is drawn about that much less often."""
    docs = [(i, "s", "same words in all of these" if i < 8 else f"own words of {i} here it is") for i in range(40)]
    drawn = {True: 0, False: 0}
    for seed in range(25):
        got, _ = mix(spark, docs, [("s", 1.0, 1)], total_tokens=120, seed=seed)
        for i in got:
            drawn[i < 8] += 1
    assert drawn[True] / 8 < 0.45 * drawn[False] / 32


def test_allotment():
    assert M.allot(100, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 1000}) == {"a": 10, "b": 90}
    assert M.allot(100, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 20}) == {"a": 10, "b": 20}
    assert M.allot(90, {"a": 1, "b": 2, "z": 0}, {"a": 99, "b": 99, "z": 9}) == {"a": 30, "b": 60, "z": 0}
    f = M.copies_per_weight({0: 100.0, 3: 80.0}, 130.0, 2)
    assert min(2, f) * 100 + min(2, f / 8) * 80 == pytest.approx(130)


def test_odd_rows(spark):
    docs = [(1, None, "a b"), (2, "s", None), (3, "s", ""), (4, " S ", "word " * 30_000), (5, "other", "x"), (6, "..", "y"), (7, "s", "tie"), (8, "s", "tie")]
    got, report = mix(spark, docs, [("s", 1.0, 1), ("t", None, None), (None, 0.5, 2)])
    assert set(got) <= {4, 7, 8} and 4 in got and set(report) == {"s", "t"}
    assert mix(spark, [], [("s", 1.0, 1)])[0] == {}
    assert mix(spark, docs, [])[0] == {}
