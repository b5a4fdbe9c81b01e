import random
from datetime import datetime, timedelta

from kgspark.llm import survivors as S

SCHEMA = "patch_no bigint, entity_no bigint, name string, type string, user_edited boolean, patched_at timestamp, value string, top int, votes string"
T0 = datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], SCHEMA)


def best(spark, rows, **how):
    strict, trust = "half_life_days" not in how, how.pop("trust", 8)
    w = S.winners(S.field_votes(frame(spark, rows), ("name", "type"), **how), strict=strict, trust=trust)
    return {(r.entity_no, r.field_name): (r.patch_no, r.value, r.rivals) for r in w.collect()}


def test_precedence(spark):
    d = timedelta(days=1)
    rows = [
        (1, 1, "old", "n/a", False, T0, ), (2, 1, "new", None, False, T0 + d), (3, 1, "user", " ", True, T0 - d), (4, 1, "late", "t", None, None),
        (5, 2, "a", "x", True, T0), (6, 2, "b", "x", True, T0), (7, 2, "c", "Unknown", True, None), (7, 2, "c", "Unknown", True, None),
        (8, 3, "lone", None, None, None), (8, 3, "lone", None, None, None), (9, None, "z", "z", True, T0),
    ]
    got = best(spark, rows)
    assert got == {
        (1, "name"): (3, "user", True), (1, "type"): (4, "t", True), (2, "name"): (6, "b", True), (2, "type"): (6, "x", True), (3, "name"): (8, "lone", False),
    }


def test_no_values(spark):
    none = ["n/a", "N.A.", "null", "NONE", " unknown ", "-", "--", "?", "tbd", "", "\t", "\u00a0", "…", None, "Not available"]
    rows = [(i, 1, v, "T", False, T0) for i, v in enumerate(none)] + [(99, 1, "NAB", None, False, T0 - timedelta(days=9))]
    assert best(spark, rows)[(1, "name")][:2] == (99, "NAB")


def test_weighted_votes_add_up(spark):
    d = timedelta(days=1)
    rows = [(1, 1, "A b", None, False, T0), (2, 1, "a  B", None, False, T0), (3, 1, "new", None, False, T0 + d)]
    assert best(spark, rows, half_life_days=30.0, as_of="2024-01-02")[(1, "name")][1] in ("A b", "a  B")
    assert best(spark, rows)[(1, "name")][1] == "new"
    assert best(spark, rows, half_life_days=0.25, as_of="2024-01-02")[(1, "name")][1] == "new"


def test_trust_outweighs(spark):
    rows = [(i, 1, "bot", None, False, T0) for i in range(5)] + [(9, 1, "user", None, True, T0)]
    assert best(spark, rows, half_life_days=10.0, as_of="2024-01-02", trust=8)[(1, "name")][1] == "user"
    assert best(spark, rows, half_life_days=10.0, as_of="2024-01-02", trust=2)[(1, "name")][1] == "bot"


def test_the_newest_vote_outweighs_all_others_together(spark):
    crowd = [(i, 1, "crowd", "many", False, T0 - timedelta(seconds=i)) for i in range(1, 400)]
    rows = crowd + [(500, 1, "new", None, False, T0)] + [(i, 2, "old edits", None, True, T0 - timedelta(days=i)) for i in range(1, 90)] + [(600, 2, "new edit", None, True, T0)]
    got = S.winners(S.field_votes(frame(spark, rows), ("name", "type")))
    assert {(r.entity_no, r.field_name): (r.patch_no, r.value) for r in got.collect()} == {(1, "name"): (500, "new"), (1, "type"): (1, "many"), (2, "name"): (600, "new edit")}
    votes = {r.entity_no: int(r.votes) for r in got.where("field_name = 'name'").collect()}
    assert votes[1] >= 400 * 0.5**4 * S.UNIT and votes[2] >= 91 * 90 * S.UNIT


def test_hot_keys_keep_their_winner(spark, monkeypatch):
    from kgspark.plans import skew

    monkeypatch.setattr(skew, "HOT_FLOOR", 5)
    rows = [(i, 1, f"v{i % 50}", None, False, T0 + timedelta(seconds=i)) for i in range(200)] + [(300, 2, "b", "t", False, T0)]
    assert {k: v[0] for k, v in best(spark, rows).items()} == {(1, "name"): 199, (2, "name"): 300, (2, "type"): 300}


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = [
        (i, r.randrange(12), r.choice(["x", "y", "X ", "n/a", None, "z" * 5000]), r.choice([None, "t"]), r.choice([True, False, None]), r.choice([None, *[T0 + timedelta(seconds=s) for s in range(4)]]))
        for i in range(300)
    ]
    want = {}
    for i, e, n, t, u, at in rows:
        for f, v in (("name", n), ("type", t)):
            if v and v != "n/a":
                k = (bool(u), at is not None, at or T0, i)
                if (e, f) not in want or k > want[e, f][0]:
                    want[e, f] = (k, i)
    assert {k: v[0] for k, v in best(spark, rows).items()} == {k: v[1] for k, v in want.items()}


def test_golden_and_empty(spark):
    rows = [(1, 1, "n/a", None, False, T0), (2, 2, "b", "t", False, T0)]
    got = {r.entity_no: (r.name, r.type) for r in S.golden(frame(spark, rows), ("name", "type")).collect()}
    assert got == {1: (None, None), 2: ("b", "t")}
    assert S.golden(frame(spark, []), ("name", "type")).count() == 0
