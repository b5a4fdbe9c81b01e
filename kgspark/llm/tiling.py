"""Evaluation texts leaking into a corpus (problem 6).

Method: greedy string tiling [Wise, String Similarity via Greedy String Tiling and Running Karp-Rabin Matching, 1993].
Runs of `least` words that a document shares with an item are seeds; for each document and item that share a seed,
the longest match of unmarked words is marked in both, again and again, until none of `least` words is left. Matches
are found by running Karp-Rabin: hashes of all windows of a search length, which falls from the longest match there is
to `least`. The marked share of the item's words is its coverage, in whatever order its passages appear. A word is an
unbroken run of letters and digits; letter case counts for nothing.

Documents stay where they are. Items go to all tasks in blocks of a bounded size, one block after the other if there
are several: a stated query set against all rows. So a passage that very many documents or items share brings nothing together.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Items are sent to all tasks in blocks of about this many bytes of text; a worker holds four times as much for a block.
BLOCK_BYTES = 8 << 20
#: Hashes are kept modulo 2^64; windows of equal hashes are compared word by word. BASE is odd, so it has an inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def words(text: str) -> list[str]:
    return WORD.findall(text.casefold())


def numbers(listed: list[str]) -> np.ndarray:
    """A number for each word, the same in every process."""
    return np.fromiter(map(xxhash.xxh64_intdigest, listed), np.uint64, len(listed))


class Rolling:
    """Karp-Rabin hashes of the windows of one text, for any length of window, from one running sum."""

    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(ids * self.powers(n)[1], out=self.sums[1:])

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of BASE and of its inverse modulo 2^64, n at least."""
        if len(cls._powers[0]) < n + 1:
            both = []
            for b in (BASE, INVERSE):
                p = np.full(2 * n + 2, b, np.uint64)
                p[0] = 1
                both.append(np.cumprod(p))
            cls._powers = tuple(both)
        return cls._powers[0][:n], cls._powers[1][:n]

    def windows(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (self.sums[k:] - self.sums[:n]) * self.powers(len(self.sums))[0][:n]


def _free(hashes: np.ndarray, marked: np.ndarray, k: int) -> np.ndarray:
    """Where the windows of k words start in which no word is marked."""
    upto = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(upto[k:][: len(hashes)] == upto[: len(hashes)])


def _matches(a: list, b: list, ra: Rolling, rb: Rolling, ma: np.ndarray, mb: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the matches of k unmarked words or more that cannot be extended."""
    ha, hb = ra.windows(k), rb.windows(k)
    pa, pb = _free(ha, ma, k), _free(hb, mb, k)
    both = np.intersect1d(ha[pa], hb[pb])
    if not len(both):
        return []
    at = defaultdict(list)
    for j in pb[np.isin(hb[pb], both)].tolist():
        at[int(hb[j])].append(j)
    out = []
    for i in pa[np.isin(ha[pa], both)].tolist():
        for j in at[int(ha[i])]:
            if i and j and a[i - 1] == b[j - 1] and not (ma[i - 1] or mb[j - 1]):
                continue  # part of the match that starts one word earlier
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not (ma[i + n] or mb[j + n]):
                n += 1
            if n >= k:
                out.append((i, j, n))
    return out


def tiles(a: list, b: list, least: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the tiles of greedy string tiling, longest first; ties go to the earliest."""
    ra, rb = Rolling(numbers(a)), Rolling(numbers(b))
    ma, mb = np.zeros(len(a), bool), np.zeros(len(b), bool)
    out: list[tuple[int, int, int]] = []
    length = max(least, min(len(a), len(b)))
    while True:
        queue = [(-n, i, j) for i, j, n in _matches(a, b, ra, rb, ma, mb, length)]
        heapq.heapify(queue)
        while queue:
            n, i, j = heapq.heappop(queue)
            taken = ma[i : i - n] | mb[j : j - n]
            if not taken.any():
                ma[i : i - n] = mb[j : j - n] = True
                out.append((i, j, -n))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([1], taken.view(np.int8), [1]))))
            for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):  # what is still unmarked of it
                if e - s >= length:
                    heapq.heappush(queue, (s - e, i + s, j + s))
        if length <= least or mb.all():
            return out
        length = max(least, length // 2)


class Seeds:
    """The items' windows of `least` words as a sorted array of hashes, and their texts."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least, self.texts, self.cut = least, dict(items), {}
        hashed, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, t in items:
            h = np.unique(Rolling(numbers(words(t))).windows(least))
            hashed.append(h)
            owner.append(np.full(len(h), i, np.int64))
        h, o = np.concatenate(hashed), np.concatenate(owner)
        order = np.argsort(h, kind="stable")
        self.hashed, self.owner = h[order], o[order]

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """Items that share a window with a document of these words' numbers."""
        own = Rolling(ids).windows(self.least)
        lo = np.searchsorted(self.hashed, own)
        lo[lo == len(self.hashed)] = 0
        met = np.unique(own[self.hashed[lo] == own]) if len(self.hashed) else own[:0]
        lo, hi = np.searchsorted(self.hashed, met), np.searchsorted(self.hashed, met, "right")
        return np.unique(np.concatenate([self.owner[:0], *(self.owner[x:y] for x, y in zip(lo, hi))]))

    def words(self, item: int) -> list[str]:
        """An item's words; those of the last few are kept."""
        if item not in self.cut:
            if len(self.cut) > 500:
                self.cut.clear()
            self.cut[item] = words(self.texts[item])
        return self.cut[item]


RESULT = "doc_id bigint, item_id bigint, tiles int, longest int, words_found int, coverage double"


def _scanned(docs: DataFrame, items: list[tuple[int, str]], least: int, cover: float) -> DataFrame:
    """Documents against one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = Seeds(shared.value, least)
        for df in batches:
            out = []
            for d, t in zip(df["d"], df["t"]):
                w = words(t)
                if len(w) < least:
                    continue
                for i in seeds.candidates(numbers(w)).tolist():
                    own = seeds.words(i)
                    found = tiles(w, own, least)
                    n = sum(x[2] for x in found)
                    if found and n >= cover * len(own):
                        out.append((d, i, len(found), found[0][2], n, n / len(own)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return docs.mapInPandas(scan, RESULT)


def leaks(docs: DataFrame, items: DataFrame, *, least: int = 13, cover: float = 0.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, tiles, longest, words_found, coverage) of documents and items with a tile of least words.

    docs: doc_id and text; items: item_id and text. cover: least share of the item's words that the tiles must hold.
    Null ids and null texts give nothing, texts shorter than least words neither; repeated rows give repeated pairs
    once each row. Items are dealt out to blocks of about block_bytes of text by a hash of their ids, and documents are
    read once for each block.
    """
    docs = docs.select(F.col("doc_id").alias("d"), F.col("text").alias("t")).dropna()
    items = items.select(F.col("item_id").alias("d"), F.col("text").alias("t")).dropna().dropDuplicates(["d"])
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    own = items.withColumn("b", F.pmod(F.xxhash64("d"), F.lit(blocks)))
    found = [_scanned(docs, [(r.d, r.t) for r in own.where(F.col("b") == b).collect()], least, cover) for b in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
