"""Extractors turn chunks into triples. They are plug-ins; the lexical one needs no model."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.plans.scratch import Scratch

REGISTRY: dict[str, type] = {}


def register(key: str):
    """Class decorator that makes an extractor known by key."""

    def add(cls: type) -> type:
        REGISTRY[key] = cls
        return cls

    return add


class Extractor:
    """load() runs once in each worker; extract() returns (subject, predicate, object, subject_type, object_type, confidence)
    and, if it knows them, the (start, end) of subject and object in the text."""

    def load(self) -> None: ...

    def extract(self, text: str) -> list[tuple]:
        raise NotImplementedError


SCHEMA = (
    "workspace_id string, document_id string, chunk_id string, seq bigint, subject string, predicate string, object string, "
    "subject_type string, object_type string, confidence double, subject_span struct<start:int,end:int>, object_span struct<start:int,end:int>, seconds double, error string"
)
NAMES = "workspace_id document_id chunk_id seq subject predicate object subject_type object_type confidence subject_span object_span seconds error".split()


def _spanned(found: tuple) -> tuple:
    """What an extractor returned, with its spans as structs or null."""
    spans = [{"start": a, "end": b} for a, b in found[6:8]]
    return (*found[:6], *spans, *[None] * (2 - len(spans)))


def run(chunks: DataFrame, key: str) -> DataFrame:
    """Triples of all chunks; a chunk that fails yields one row with its error and no names."""
    cls = REGISTRY[key]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = cls()
        model.load()
        for df in batches:
            out = []
            for w, d, c, o, t in zip(df["workspace_id"], df["document_id"], df["chunk_id"], df["ord"], df["text"]):
                t0 = time.perf_counter()
                try:
                    found = model.extract(t)
                    took = time.perf_counter() - t0
                    out += [(w, d, c, int(o) * 100_000 + i, *_spanned(x), took, None) for i, x in enumerate(found)]
                except Exception as e:  # noqa: BLE001
                    out.append((w, d, c, int(o) * 100_000, *[None] * 8, time.perf_counter() - t0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=NAMES)

    own = chunks.select("workspace_id", F.col("document_id").cast("string").alias("document_id"), "chunk_id", "ord", "text")
    return own.mapInPandas(scan, SCHEMA)


@register("pattern")
class PatternExtractor(Extractor):
    """`X depends on Y` and the like in plain English sentences."""

    VERBS = {"depends on": "depends_on", "is part of": "part_of", "links": "related_to", "holds": "related_to", "left": "related_to"}

    def load(self) -> None:
        import re

        name = r"[A-Z][a-z]+(?: [A-Z][a-z]+)*"
        self.rx = re.compile(rf"\b({name}) ({'|'.join(self.VERBS)}) ({name})")

    def extract(self, text: str) -> list[tuple]:
        return [(m[1], self.VERBS[m[2]], m[3], "concept", "concept", 0.9, m.span(1), m.span(3)) for m in self.rx.finditer(text)]


#: A word of six letters or more, of any script, with the marks that belong to them.
WORD = r"\p{L}[\p{L}\p{M}]{5,}"


def lexical_mentions(chunks: DataFrame, least: int = 2, most: int | None = None, word: str = WORD) -> DataFrame:
    """(workspace_id, document_id, chunk_id, term, df): words that occur in least chunks of their workspace or more. Chunks
    without a workspace are nobody's and have no terms.

    With most, words of more chunks than that are left out; this is for a caller that wants rare words only."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(0))))
    seen = chunks.select("workspace_id", "document_id", "chunk_id", words.alias("term")).distinct()
    df = seen.groupBy("workspace_id", "term").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    if most is not None:
        df = df.where(F.col("df") <= most)
    return seen.join(df, ["workspace_id", "term"]).select("workspace_id", "document_id", "chunk_id", "term", "df")


def _pairs(scratch: Scratch, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered terms (workspace_id, term, mentions, no), and (a, b) with a < b, numbers of two terms, for each chunk that
    holds both. Pairs are made from the terms of each chunk, so a chunk's length bounds them and not a term's frequency."""
    m = scratch.save(mentions.where("document_id is not null and chunk_id is not null"))
    terms = mentions.groupBy("workspace_id", "term").agg(F.count("*").alias("mentions"), F.max("df").alias("df"))
    terms = scratch.save(terms.withColumn("no", F.monotonically_increasing_id()))
    numbered = m.join(terms.select("workspace_id", "term", "no"), ["workspace_id", "term"])
    lists = numbered.groupBy("workspace_id", "document_id", "chunk_id").agg(F.array_sort(F.collect_set("no")).alias("l"))
    ahead = lists.select("l", F.posexplode("l").alias("i", "a"))
    return terms, ahead.select("a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b"))


def lexical_edges(mentions: DataFrame) -> DataFrame:
    """(workspace_id, src, dst, shared, confidence): terms that share chunks, in alphabetical order. confidence is
    the share of the rarer one's chunks that are shared. mentions as lexical_mentions() yields them; terms are numbers
    while pairs are shuffled."""
    terms, pairs = _pairs(Scratch(mentions.sparkSession), mentions)
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
    end = lambda c, t, n: terms.select(F.col("no").alias(c), "workspace_id", F.col("term").alias(t), F.col("df").alias(n))
    named = counted.join(end("a", "x", "n"), "a").join(end("b", "y", "m").drop("workspace_id"), "b")
    return named.select("workspace_id", F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "shared", (F.col("shared") / F.least("n", "m")).alias("confidence"))


def lexical_degrees(mentions: DataFrame) -> DataFrame:
    """(workspace_id, term, mentions, degree): the chunks that mention a term, and the other terms in any of these.
    mentions as lexical_mentions() yields them."""
    scratch = Scratch(mentions.sparkSession)
    terms, pairs = _pairs(scratch, scratch.save(mentions))
    degree = pairs.distinct().select(F.explode(F.array("a", "b")).alias("no")).groupBy("no").agg(F.count("*").alias("degree"))
    out = terms.join(degree, "no", "left").select("workspace_id", "term", "mentions", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))
    return scratch.result(out)
