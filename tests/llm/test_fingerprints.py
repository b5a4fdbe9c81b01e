import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kgspark.llm import fingerprints as P

SCHEMA = "import_no bigint, workspace_id string, name string, type string, record string, _id string, n_copies int"
HOW = dict(key="import_no", scope="workspace_id", fields=("name", "type"), record="record")


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "clash", 7) for i, r in enumerate(rows, 1)], SCHEMA)


def found(spark, rows):
    return {(r.import_no, r.group_no) for r in P.copies(frame(spark, rows), **HOW).collect()}


def test_spellings(spark):
    rows = [
        ("w", "Foo Bar 3", "concept", None),
        ("w", None, None, '{"TYPE": "Concept", "Name": "foo-bar, 3"}'),
        ("w", None, None, "type = CONCEPT; name= «Foo»\u00ad Bar\u200b3;"),
        ("w", None, None, "NAME: fooBAR3 | Type: con cept"),
        ("v", "Foo Bar 3", "concept", None),
        ("w", "Foo Bar 4", "concept", None),
        ("w", "Foo Bar 3", "concepts", None),
    ]
    assert found(spark, rows) == {(1, 1), (2, 1), (3, 1), (4, 1)}
    got = {r.group_no: (r.name, r.type, r.n_copies) for r in P.collapsed(frame(spark, rows), **HOW).collect()}
    assert got[1] == ("Foo Bar 3", "concept", 4) and len(got) == 4


def test_nulls_blanks_and_broken_records(spark):
    rows = [
        (None, None, None, None), (None, None, None, None), (None, "", "..", None), ("w", None, None, "{broken"),
        ("w", None, None, ""), ("w", "x" * 100_000, "t", None), ("w", "X" * 100_000, "T", None), (None, "a", None, None),
    ]
    assert found(spark, rows) == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6)}


def test_full_case_folding(spark):
    rows = [("w", "STRASSE", "t", None), ("w", "Straße", "t", None), ("w", "Ñu", "t", None), ("w", "ñU", "t", None), ("w", "nu", "t", None)]
    assert found(spark, rows) == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_empty(spark):
    assert found(spark, []) == set()
    assert P.collapsed(frame(spark, []), **HOW).count() == 0


def test_values_do_not_swap_fields(spark):
    assert found(spark, [("w", "a", "b", None), ("w", "b", "a", None), ("w", "ab", "", None)]) == set()


def test_equal_fingerprints_of_unequal_records_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(P, "multiset_hash", lambda pairs, lane: F.lit(1).cast("bigint"))
    assert found(spark, [("w", "a", "t", None), ("w", "b", "t", None), ("w", "A", "t", None)]) == {(1, 1), (3, 1)}


def test_hot_group(spark, monkeypatch):
    from kgspark.plans import skew

    monkeypatch.setattr(skew, "HOT_FLOOR", 5)
    rows = [("w", "same" if i % 2 else "S-ame", "t", None) for i in range(30)] + [("w", "solo", "t", None), ("w", "pair", "t", None), ("w", "Pair", "t", None)]
    assert found(spark, rows) == {(i, 1) for i in range(1, 31)} | {(32, 32), (33, 32)}


def key(s):
    return "".join(c for c in s if unicodedata.category(c)[0] in "LN").casefold()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("uv"), st.text("aAbB1 .-_", max_size=4), st.text("xX ", max_size=2)), min_size=1, max_size=12))
def test_against_brute_force(spark, rows):
    first, n = {}, {}
    for i, (w, a, b) in enumerate(rows, 1):
        k = (w, key(a), key(b))
        first.setdefault(k, i)
        n[k] = n.get(k, 0) + 1
    want = {(i, first[k]) for i, (w, a, b) in enumerate(rows, 1) if n[k := (w, key(a), key(b))] > 1}
    assert found(spark, [(w, a, b, None) for w, a, b in rows]) == want
