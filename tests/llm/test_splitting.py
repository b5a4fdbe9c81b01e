import random

import pytest

from kgspark.llm import splitting as S


def check(text, limit, overlap):
    p = S.split(text, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text)
    for a, b in zip(p, p[1:]):
        assert a[1] - b[0] == overlap
    assert all(0 < e - s <= limit for s, e, _ in p)
    assert "".join([text[p[0][0] : p[0][1]], *(text[a[1] : b[1]] for a, b in zip(p, p[1:]))]) == text
    return p


@pytest.mark.parametrize("seed", range(6))
def test_round_trip(seed):
    r = random.Random(seed)
    alphabet = ["word ", "x" * 30, ". ", "\n", "\n\n", "文。", "é", "\f", "y" * 500]
    text = "".join(r.choices(alphabet, [9, 1, 3, 2, 1, 3, 1, 0.1, 0.2], k=r.randrange(50, 900)))
    limit, overlap = r.choice([(400, 60), (100, 49), (1000, 150), (50, 0)])
    if len(text) > limit:
        check(text, limit, overlap)


def test_cuts_at_blank_lines():
    text = "\n\n".join(("word " * 60).strip() for _ in range(10))
    p = check(text, 800, 100)
    assert all(k == "block" for *_, k in p)


def test_is_the_cheapest_chain():
    """Against trying all chains of candidate cuts."""
    text = "aa. bb cc.\n\ndd ee. ff gg hh.\nii jj kk. ll mm nn"
    limit, overlap = 20, 4
    pos, kinds = S.candidates(text, limit - overlap)
    n, step = len(text), limit - overlap
    share = n / max(1, -(-(n - overlap) // step))

    def cost(chain):
        c, last = 0.0, 0
        for j in chain:
            c += S.BALANCE * ((pos[j] - last) / share - 1) ** 2 + (0 if j == len(pos) - 1 else S.COST[kinds[j]])
            last = pos[j]
        return c

    best = [float("inf"), None]

    def go(chain, at):
        if at == len(pos) - 1:
            best[:] = min(best, [cost(chain), chain])
            return
        for j in range(at + 1, len(pos)):
            room = limit if not chain else step
            if pos[j] - pos[at] <= room and (chain or pos[j] > overlap):
                go([*chain, j], j)

    go([], 0)
    assert [e for _, e, _ in S.split(text, limit, overlap)] == [int(pos[j]) for j in best[1]]


def test_kinds():
    block = "word " * 700
    assert S.cut_kind(block + "\n \t\n" + block, 4000) == "block"
    assert S.cut_kind(block + "\n" + block, 4000) == "inner"
    assert S.cut_kind(" " * 900 + block + " " * 900 + "\n\n" + block, 4000) == "block"
    assert S.cut_kind("x" * 4001 + " y", 4000) == "hard"
    assert S.cut_kind("x" * 4000 + "\u3000" + "y" * 4000, 4000) == "inner"
    assert S.cut_kind("文" * 3999 + "。" + "文" * 3999, 4000) == "inner"
    assert S.cut_kind("文" * 3999 + "\u2009" + "文" * 4001, 4000) == "hard"


def plain_kind(text, limit):
    import re

    if max(len(x) for x in re.split(r"[\s。！？]", text)) > limit:
        return "hard"
    return "inner" if any(len(b.strip()) > limit for b in S.PARAGRAPHS.split(text)) else "block"


@pytest.mark.parametrize("seed", range(40))
def test_kinds_against_the_definition(seed):
    r = random.Random(seed)
    alphabet = ["ab ", "x" * 9, ". ", "\n", "\n\n", " \n \t\n ", "文。", "』", "é", "\f", "\u2003", "\r\n\r\n"]
    for _ in range(60):
        text = "".join(r.choices(alphabet, [9, 2, 3, 2, r.choice([1, 6]), 1, 3, 1, 1, 0.5, 1, 1], k=r.randrange(0, 90)))
        limit = r.choice([5, 12, 30, 60])
        assert S.cut_kind(text, limit) == plain_kind(text, limit), (text, limit)


def test_frames(spark):
    long = "One two. " * 900
    rows = [(1, long, 0, 3), (1, long, 0, 3), (2, "short", 0, 4), (3, None, 0, 5), (None, long, 0, 6), (4, "", 0, 7), (5, "z" * 9000, 0, 8)]
    df = spark.createDataFrame(rows, "chunk_no bigint, text string, piece int, cut_kind int")
    assert {tuple(r) for r in S.cut_kinds(df).collect()} == {(1, "inner"), (5, "hard")}
    assert S.cut_kinds(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.pieces(df, limit=100, overlap=60)


def test_document_pieces_follow_each_other(spark):
    doc = ("Word one. " * 450 + "\n\n") * 4
    cuts = [0, 9000, 9400, len(doc)]
    rows = [(i, 7, doc[a:b], i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    df = spark.createDataFrame(rows + rows[:1], "chunk_no bigint, document_id bigint, text string, ord int, char_start int, char_end int")
    got = S.document_pieces(df).orderBy("ord").collect()
    assert all(doc[r.char_start : r.char_end] == r.text and len(r.text) <= 4000 for r in got)
    assert [r.ord for r in got] == list(range(len(got))) and [r.chunk_no for r in got] == sorted(r.chunk_no for r in got)
    assert [(r.piece, r.cut, r.cut_kind) for r in got if r.chunk_no == 1] == [(0, None, None)]
    assert S.piece_checks(S.document_pieces(df)).where("short and shared").count() == 2
    assert S.document_pieces(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, "a", 3, 0, 1), (2, 7, "b", None, None, None), (None, 7, "c", 1, 0, 1), (3, 7, None, 0, 0, 0)], df.schema)
    assert {(r.chunk_no, r.ord) for r in S.document_pieces(odd).collect()} == {(1, 3), (2, None), (3, 0)}
