"""Cutting oversized texts at natural boundaries (problem 5).

Method: dynamic programming over boundary positions. Candidates are blank lines, line breaks and sentence ends;
spaces are added where these leave a gap wider than a piece may advance, and positions inside a run without any
boundary only where spaces leave one, too. A chain of cuts costs the penalties of its cuts plus the squared deviation
of each piece's fresh text from an even share; the cheapest chain whose pieces, each starting `overlap` characters
before the previous one's end, hold at most `limit` characters is taken. All offsets are code points.

What cutting a text takes (`cut_kind`) is told by the same programming without overlap, white space around pieces not
counted, and with steep penalties: the worst cut of the cheapest chain.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.plans.scratch import Scratch

#: Costs of a cut by kind; an even share missed by all of its length costs BALANCE.
COST = {"block": 0.0, "line": 0.25, "sentence": 0.5, "space": 1.0, "hard": 20.0}
BALANCE = 1.5
#: Characters between positions tried inside a run without boundaries.
HARD_STEP = 50

_END = r"\r\n|\n|\r"
BLANK = re.compile(rf"(?:{_END})(?:[ \t\f]*(?:{_END}))+[ \t\f]*|\f")
LINE = re.compile(_END)
SENTENCE = re.compile(r"[.!?…;؟۔।॥။።]+[\"'»”’)\]]*(?=\s)|[。！？]+[」』”’）]*")
SPACE = re.compile(r"\s+")
PARAGRAPHS = re.compile(rf"(?:{_END})(?:[ \t\f]*(?:{_END}))+")
#: Where a text may be cut inside a block: white space with a line break, or marks; then any white space, too.
INNER = (re.compile(r"[^\S\r\n]*[\r\n]\s*|[。！？]"), re.compile(r"\s+|[。！？]"))
#: Penalties so steep that a chain takes a worse kind of cut only where there is no other way.
STEEP = {"block": 0.0, "inner": 1.0, "hard": 1e9}


def cheapest(stop: np.ndarray, go: np.ndarray, penalty: np.ndarray, limit: int, balance: float = 0.0, share: float = 1.0, least: int = 0) -> list[int]:
    """The cheapest chain of cuts 0 < j1 < j2 < ... < last. A piece from cut i to cut j runs from go[i] to stop[j] and holds
    at most limit characters; the first one ends behind least. balance weighs the squared deviation of stop[j] - stop[i]
    from share."""
    n = len(stop)
    cost, back = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    cost[0] = 0.0
    first = np.searchsorted(go, stop - limit)
    for j in range(1, n):
        lo = first[j]
        if lo == 0 and stop[j] <= least:
            continue
        via = cost[lo:j] + balance * ((stop[j] - stop[lo:j]) / share - 1) ** 2
        if len(via):
            k = int(via.argmin())
            cost[j], back[j] = via[k] + penalty[j], lo + k
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = int(back[j])
    return cuts[::-1]


def _wide(spots: list[tuple[int, int, str]], limit: int) -> list[tuple[int, int]]:
    return [(a[1], b[0]) for a, b in zip(spots, spots[1:]) if b[0] - a[1] > limit]


def cut_kind(text: str, limit: int) -> str:
    """What cutting text takes: `hard` if more than limit characters run on without white space or 。！？; otherwise
    `inner` if a block longer than limit remains between blank lines; otherwise `block`.

    It is the worst cut of the cheapest chain of pieces that hold at most limit characters, the white space or mark at
    their ends not counted."""
    n = len(text)
    spots = [(0, n - len(text.lstrip()), "block")]
    for m in PARAGRAPHS.finditer(text):
        a, b = m.span()
        while a > 0 and text[a - 1].isspace():
            a -= 1
        while b < n and text[b].isspace():
            b += 1
        if a >= spots[-1][1]:
            spots.append((a, b, "block"))
    end = len(text.rstrip())
    spots = [x for x in spots if x[1] < end] + [(end, n, "block")]
    for rx in INNER:
        for a, b in _wide(spots, limit):
            spots += [(*m.span(), "inner") for m in rx.finditer(text, a, b)]
        spots.sort(key=lambda x: x[:2])
    for a, b in _wide(spots, limit):
        spots += [(p, p, "hard") for p in range(a + limit, b, limit)]
    spots.sort(key=lambda x: x[:2])
    if len(spots) < 2:
        return "block"
    stop, go = (np.array([x[i] for x in spots]) for i in (0, 1))
    penalty = np.array([STEEP[x[2]] for x in spots])
    penalty[-1] = 0.0
    kinds = {spots[j][2] for j in cheapest(stop, go, penalty, limit)[:-1]}
    return next((k for k in ("hard", "inner") if k in kinds), "block")


def _add(found: dict[int, str], spots, kind: str, n: int) -> None:
    for p in spots:
        if 0 < p < n:
            found.setdefault(p, kind)


def _gaps(found: dict[int, str], n: int, step: int) -> list[tuple[int, int]]:
    at = [0, *sorted(found), n]
    return [(a, b) for a, b in zip(at, at[1:]) if b - a > step]


def candidates(text: str, step: int) -> tuple[np.ndarray, list[str]]:
    """Positions (ends of pieces) with their kinds such that no two neighbours are more than step apart."""
    n, found = len(text), {}
    _add(found, (m.end() for m in BLANK.finditer(text)), "block", n)
    _add(found, (m.end() for m in LINE.finditer(text)), "line", n)
    _add(found, (m.end() for m in SENTENCE.finditer(text)), "sentence", n)
    for a, b in _gaps(found, n, step):
        _add(found, (m.end() for m in SPACE.finditer(text, a, b)), "space", n)
    for a, b in _gaps(found, n, step):
        for p in range(a + HARD_STEP, b, HARD_STEP):
            while p < b and unicodedata.combining(text[p]):  # a mark stays with its letter
                p += 1
            if p < b:
                _add(found, (p,), "hard", n)
    for a, b in _gaps(found, n, step):  # nothing but marks
        _add(found, range(a + step, b, step), "hard", n)
    at = sorted(found)
    return np.array([0, *at, n]), ["hard", *(found[p] for p in at), "block"]


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of cut at end) of each piece; one piece if text is not longer than limit."""
    n, step = len(text), limit - overlap
    if n <= limit:
        return [(0, n, "block")] if n else []
    pos, kinds = candidates(text, step)
    penalty = np.array([COST[k] for k in kinds])
    penalty[-1] = 0.0
    share = n / max(1, -(-(n - overlap) // step))
    # the first piece must hold the whole overlap of the second
    cuts = cheapest(pos, np.maximum(pos - overlap, 0), penalty, limit, BALANCE, share, overlap)
    starts = [0, *(int(pos[c]) - overlap for c in cuts[:-1])]
    return [(s, int(pos[c]), kinds[c]) for s, c in zip(starts, cuts)]


def pieces(
    rows: DataFrame, *, key: str = "chunk_no", text: str = "text", limit: int = 4000, overlap: int = 600
) -> DataFrame:
    """(key, piece, start, end, cut, cut_kind, text) of every row whose text is longer than limit.

    start and end are offsets in the row's text, consecutive pieces share exactly overlap characters, cut is the kind
    of the cut at a piece's end, cut_kind what the row takes as a whole. Texts up to limit, null texts and null keys
    give no rows; rows repeated with the same key and text give theirs once.
    """
    if not 0 <= overlap < limit - overlap:
        raise ValueError("the overlap must be less than half the limit")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for k, t in zip(df["k"], df["t"]):
                kind = cut_kind(t, limit)
                out += [(k, i, s, e, c, kind, t[s:e]) for i, (s, e, c) in enumerate(split(t, limit, overlap))]
            yield pd.DataFrame(out, columns=["k", "piece", "start", "end", "cut", "cut_kind", "text"])

    # char_length counts code points of the stored text without decoding it
    long = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).where((F.char_length("t") > limit) & F.col("k").isNotNull())
    made = long.mapInPandas(cut, "k bigint, piece int, start int, end int, cut string, cut_kind string, text string")
    return made.withColumnRenamed("k", key)


def cut_kinds(rows: DataFrame, *, key: str = "chunk_no", text: str = "text", limit: int = 4000) -> DataFrame:
    """(key, cut_kind) of every row whose text is longer than limit, once for each key; null texts and keys give none."""

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"k": df["k"], "cut_kind": [cut_kind(t, limit) for t in df["t"]]})

    long = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).where((F.char_length("t") > limit) & F.col("k").isNotNull())
    return long.mapInPandas(tell, "k bigint, cut_kind string").withColumnRenamed("k", key).distinct()


def _extra_before(sizes: DataFrame, span: int = 1024) -> DataFrame:
    """Running number of extra pieces before each chunk of a document, in two levels so that no task gets a whole document."""
    block = F.floor(F.col("ord") / span)
    sums = sizes.groupBy("document_id", block.alias("b")).agg(F.sum("extra").alias("s"))
    w = Window.partitionBy("document_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("document_id", "b", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("base"))
    inside = Window.partitionBy("document_id", "b").orderBy("ord", "chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("b", block)
        .join(base, ["document_id", "b"])
        .select("chunk_no", (F.col("base") + F.coalesce(F.sum("extra").over(inside), F.lit(0))).alias("before"))
    )


def document_pieces(chunks: DataFrame, limit: int = 4000, overlap: int = 600) -> DataFrame:
    """The chunk table with the pieces of oversized rows in their place: chunk_no, document_id, piece, ord, char_start,
    char_end, cut, cut_kind, text. A chunk that is not cut is its own piece 0, without cut and cut_kind.

    ord counts on over the document: every chunk moves up by the number of extra pieces made before it. Rows repeated
    with the same chunk_no count once, rows without chunk_no are left out; without document_id or ord nothing moves.
    """
    scratch = Scratch(chunks.sparkSession)
    own = chunks.select("chunk_no", "document_id", "ord", "char_start", "char_end", "text").where("chunk_no is not null").dropDuplicates(["chunk_no"])
    own = scratch.save(own)
    made = scratch.save(pieces(own, limit=limit, overlap=overlap))
    n = made.groupBy("chunk_no").agg((F.count("*") - 1).alias("extra"))
    place = own.select("chunk_no", "document_id", "ord", "char_start")
    sizes = place.where("document_id is not null and ord is not null").join(n, "chunk_no", "left")
    moved = _extra_before(sizes.select("chunk_no", "document_id", "ord", F.coalesce("extra", F.lit(0)).alias("extra")))
    moved = scratch.save(place.join(moved, "chunk_no", "left").withColumn("ord", F.col("ord") + F.coalesce("before", F.lit(0))).drop("before"))
    cut = made.join(moved, "chunk_no").select(
        "chunk_no", "document_id", "piece", F.col("ord") + F.col("piece"), F.col("char_start") + F.col("start"), F.col("char_start") + F.col("end"), "cut", "cut_kind", "text"
    )
    none = F.lit(None).cast("string")
    kept = own.join(made.select("chunk_no").distinct(), "chunk_no", "left_anti").drop("ord", "document_id", "char_start").join(moved, "chunk_no")
    kept = kept.select("chunk_no", "document_id", F.lit(0), "ord", "char_start", "char_end", none, none, "text")
    whole = cut.union(kept).toDF("chunk_no", "document_id", "piece", "ord", "char_start", "char_end", "cut", "cut_kind", "text")
    numbers = [F.col(c).cast("int").alias(c) for c in ("piece", "ord", "char_start", "char_end")]
    return scratch.result(whole.select("chunk_no", "document_id", *numbers, "cut", "cut_kind", "text"))


def piece_checks(pieces_: DataFrame, limit: int = 4000, overlap: int = 600) -> DataFrame:
    """(chunk_no, first, last, short, shared, cut_kind) of the chunks that were cut: where their pieces start and end,
    whether all keep to limit, and whether each shares overlap characters of the same text with the one before."""
    w = Window.partitionBy("chunk_no").orderBy("piece")
    p = pieces_.where("cut_kind is not null").withColumn("_end", F.lag("char_end").over(w)).withColumn("_tail", F.lag(F.right("text", F.lit(overlap))).over(w))
    shares = (F.col("_end") - F.col("char_start") == overlap) & (F.col("_tail") == F.left("text", F.lit(overlap)))
    size = F.char_length("text")
    return p.groupBy("chunk_no").agg(
        F.min("char_start").alias("first"),
        F.max("char_end").alias("last"),
        F.bool_and((size <= limit) & (size == F.col("char_end") - F.col("char_start"))).alias("short"),
        F.bool_and(F.coalesce(shares, F.col("piece") == 0)).alias("shared"),
        F.max("cut_kind").alias("cut_kind"),
    )
