"""Vectors of texts and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types
from pyspark.sql.window import Window

from kgspark.functions.text import fold
from kgspark.plans.scratch import Scratch

DIMENSIONS, EMBED_CHARS = 384, 1200


#: Characters whose trigrams are hashed at once; rows whose vectors a worker holds at once.
SLAB_CHARS, SLAB_ROWS = 100_000, 1_000


def _xxh32(b: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """xxHash32, with seed 0, of the stretches of b of size bytes (fewer than 16) at all these starts, side by side."""
    p1, p2, p3, p4, p5 = (np.uint32(p) for p in (2654435761, 2246822519, 3266489917, 668265263, 374761393))
    turn = lambda x, n: x << np.uint32(n) | x >> np.uint32(32 - n)
    h = np.full(len(start), p5 + np.uint32(size), np.uint32)
    whole = size // 4 * 4
    for i in range(0, whole, 4):
        word = b[start + i] | b[start + i + 1] << np.uint32(8) | b[start + i + 2] << np.uint32(16) | b[start + i + 3] << np.uint32(24)
        h = turn(h + word * p3, 17) * p4
    for i in range(whole, size):
        h = turn(h + b[start + i] * p5, 11) * p1
    h = (h ^ h >> np.uint32(15)) * p2
    h = (h ^ h >> np.uint32(13)) * p3
    return h ^ h >> np.uint32(16)


def _counted(texts: list[str], size: int) -> np.ndarray:
    """Signed counts of the hashed trigrams of texts, those of all texts side by side."""
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))  # where characters start
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    within = row[:-2] == row[2:]
    start, width, row = at[:-3][within], (at[3:] - at[:-3])[within], row[:-2][within]
    b, h = raw.astype(np.uint32), np.zeros(len(start), np.uint32)
    for n in np.unique(width).tolist():
        h[width == n] = _xxh32(b, start[width == n], n)
    return np.bincount(row * size + h % np.uint32(size), np.where(h >> np.uint32(31), 1.0, -1.0), len(texts) * size).reshape(len(texts), size)


def hashing_embedder(texts: list[str], size: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors of hashed character trigrams; a stand-in that needs no model. A text without letters is the zero vector."""
    out = np.zeros((len(texts), size), np.float32)
    slab, first, chars = [], 0, 0
    for i, t in enumerate(texts):
        slab.append(f" {fold(t)} ")
        chars += len(slab[-1]) + size
        if chars >= SLAB_CHARS or i == len(texts) - 1:
            out[first : i + 1] = _counted(slab, size)
            slab, first, chars = [], i + 1, 0
    n = np.sqrt(np.einsum("ij,ij->i", out, out))  # sums of squares of whole numbers
    out /= np.where(n > 0, n, 1)[:, None]
    return out


def mean_pooled(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors of the means of token vectors (texts x tokens x size) where mask (texts x tokens) is set."""
    m = mask[..., None].astype(np.float32)
    mean = (tokens * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def pooled(rows: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, embedding): unit vectors of the means of each group's vectors, summed place by place before the shuffle; a mean
    without length stays as it is. Null vectors count for nothing."""
    places = rows.where(F.col(vector).isNotNull()).select(by, F.posexplode(vector).alias("i", "v"))
    means = places.groupBy(by, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    whole = means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p"))  # as many as there are dimensions
    m = whole.select(by, F.transform("p", lambda x: x["v"]).alias("m"))
    size = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    return m.withColumn("_n", size).select(by, F.transform("m", lambda x: x / F.greatest("_n", F.lit(1e-12))).alias("embedding"))


def _slabs(batches: Iterator[pa.RecordBatch], text: str, embed: Callable[[list[str]], np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """SLAB_ROWS rows at a time with their vectors. Only the beginnings of texts become Python's."""
    for batch in batches:
        for i in range(0, len(batch), SLAB_ROWS):
            rows = batch.slice(i, SLAB_ROWS)
            begin = pc.utf8_slice_codeunits(rows[text], 0, EMBED_CHARS)
            yield rows, np.asarray(embed([t or "" for t in begin.to_pylist()]), np.float32)


def embedded(rows: DataFrame, text: str = "text", embed: Callable[[list[str]], np.ndarray] = hashing_embedder) -> DataFrame:
    """rows with embedding, of the first EMBED_CHARS characters of text."""
    fields = [f for f in rows.schema.fields if f.name != "embedding"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in _slabs(batches, text, embed):
            ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], names=[*part.schema.names, "embedding"])

    out = types.StructType([*fields, types.StructField("embedding", types.ArrayType(types.FloatType()))])
    return rows.select(*[f.name for f in fields]).mapInArrow(scan, out)


def with_length(rows: DataFrame, text: str = "text", embed: Callable[[list[str]], np.ndarray] = hashing_embedder) -> DataFrame:
    """rows of embedded() whose vector has a length, without the vector, which stays in the worker."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in _slabs(batches, text, embed):
            yield part.filter(pa.array(v.any(axis=1)))

    return rows.mapInArrow(scan, rows.schema)


def missing(rows: DataFrame) -> DataFrame:
    return rows.where("embedding is null")


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one is null or has no length."""
    return _dot(a, b) / F.nullif(F.sqrt(_dot(a, a) * _dot(b, b)), F.lit(0.0))


def index_score(c: Column) -> Column:
    """A cosine as a score from 0 to 1."""
    return (F.lit(1.0) + c) / 2


#: Rows of a scope that one block holds; larger scopes are scored in several, so no task gets a whole one.
BLOCK_ROWS = 100_000
#: Scopes of more than k rows up to this number are sent to all tasks, so that only their rows are shuffled.
SENT_SCOPES = 10_000


def nearest(queries: DataFrame, rows: DataFrame, k: int, scope: list[str], key: str = "vec_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query, key, scope, cosine, rank): the k rows of the same scope nearest to each query, which is filtered before
    scores are taken, so no scope crowds out another. Ties go to the least key. queries: query, embedding, scope.

    A scope's rows are dealt out to blocks of about block_rows, and each query goes to every block of its scope; Spark
    keeps the best k of each task before it shuffles for the final ranks."""
    sizes = rows.groupBy(*scope).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks"))
    square = lambda c: _dot(F.col(c), F.col(c))  # noqa: E731 - once for each vector, not for each pair
    dealt = rows.select(key, *scope, "embedding", square("embedding").alias("_e2")).join(sizes, scope).withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    q = queries.select("query", *scope, F.col("embedding").alias("_q"), square("embedding").alias("_q2")).join(sizes, scope)
    q = q.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    met = dealt.drop("_blocks").join(q, [*scope, "_block"])
    score = _dot(F.col("embedding"), F.col("_q")) / F.nullif(F.sqrt(F.col("_e2") * F.col("_q2")), F.lit(0.0))
    scored = met.select("query", key, *scope, score.alias("cosine")).where("cosine is not null")
    w = Window.partitionBy("query", *scope).orderBy(F.desc("cosine"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_to_texts(queries: DataFrame, rows: DataFrame, k: int, scope: list[str], key: str = "vec_id", embed: Callable = hashing_embedder) -> DataFrame:
    """(query, key, scope) of nearest(), without scores and ranks, for the texts of queries (query, text, scope).

    All rows of a scope of k or fewer are among the k nearest if they and the query have a length, so their vectors stay
    where they are; only larger scopes are scored. Sizes and what is scored are written first, for as one plan the driver
    had to plan sizes again wherever they are read."""
    scratch = Scratch(rows.sparkSession)
    sizes = scratch.save(rows.groupBy(*scope).agg(F.count("*").alias("_n")))
    q = queries.select("query", *scope, "text").join(sizes, scope)
    large = sizes.where(F.col("_n") > k).select(*scope)
    own = rows.join(F.broadcast(large) if large.count() <= SENT_SCOPES else large, scope, "left_semi")
    scored = scratch.save(nearest(embedded(q.where(F.col("_n") > k).drop("_n"), embed=embed), own, k, scope, key).select("query", key, *scope))
    few = with_length(q.where(F.col("_n") <= k).drop("_n"), embed=embed).select("query", *scope)
    whole = few.join(rows.where(F.exists("embedding", lambda v: v != 0)).select(key, *scope), scope)
    return scored.unionByName(whole.select("query", key, *scope))
