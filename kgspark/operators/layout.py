"""Running headers, footers and reference lists of paged documents."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

BAND, SHARE, LEAST_PAGES = 0.12, 0.6, 3
# Fixed value: headings of reference lists.
REFERENCES = re.compile(r"^\s*(?:\d+[.)]?\s*)?(?:references?|bibliography|works\s+cited|literature\s+cited)\s*:?\s*$", re.I)


def line_key(c: Column) -> Column:
    """A line for counting: single blanks, no letter case, digits as #."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), r"\d+", "#")


def band(y: Column) -> Column:
    return F.when(y <= BAND, "top").when(y >= 1 - BAND, "bottom")


def furniture(lines: DataFrame) -> DataFrame:
    """(document_id, band, key) of lines in the same band of most pages. lines: document_id, page, line, y.

    Documents of fewer than LEAST_PAGES pages have none."""
    keyed = lines.select("document_id", "page", band(F.col("y")).alias("band"), line_key(F.col("line")).alias("key"))
    pages = lines.groupBy("document_id").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    seen = keyed.where("band is not null and key <> ''").distinct().groupBy("document_id", "band", "key").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(LEAST_PAGES - 1), F.floor(F.col("pages") * SHARE))
    return seen.join(pages, "document_id").where(F.col("n") >= least).select("document_id", "band", "key")


def without_furniture(lines: DataFrame) -> DataFrame:
    """lines without those that stand in a band and are furniture of their document in either band."""
    marks = furniture(lines).select("document_id", "key").distinct().withColumn("_f", F.lit(True))
    keyed = lines.withColumn("key", line_key(F.col("line")))
    kept = keyed.join(marks, ["document_id", "key"], "left").where(F.col("_f").isNull() | band(F.col("y")).isNull())
    return kept.drop("key", "_f")


def bodies_of(pages: list[list[tuple[str, float]]]) -> list[list[str]]:
    """without_furniture() for the pages (lines with their place) of one document that a reader holds in memory."""

    def key(line: str) -> str:
        return re.sub(r"\d+", "#", " ".join(line.split()).casefold())

    def where(y: float) -> str | None:
        return "top" if y <= BAND else "bottom" if y >= 1 - BAND else None

    if len(pages) < LEAST_PAGES:
        return [[line for line, _ in page] for page in pages]
    seen = Counter(x for page in pages for x in {(where(y), key(line)) for line, y in page} if x[0] and x[1])
    least = max(LEAST_PAGES - 1, int(len(pages) * SHARE))
    marks = {k for (_, k), n in seen.items() if n >= least}
    return [[line for line, y in page if not (where(y) and key(line) in marks)] for page in pages]


def strip_references_of(text: str) -> str:
    """text up to a heading of references that stands in its last 40 percent of lines."""
    lines = text.splitlines(keepends=True)
    for i in range(int(len(lines) * 0.6), len(lines)):
        if REFERENCES.match(lines[i]):
            return "".join(lines[:i])
    return text


@F.pandas_udf(types.StringType())
def strip_references(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else strip_references_of(t))
