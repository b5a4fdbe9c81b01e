"""Incremental ingest, limits and windows on streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pyspark.sql.window import Window

from kgspark.operators.chunking import chunks
from kgspark.plans.skew import lookup


def document_stream(spark: SparkSession, folder: str, schema, most_files: int = 100) -> DataFrame:
    """New Parquet files of documents as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def ingest(stream: DataFrame, out: str, checkpoint: str, **options):
    """Chunks every new document and appends the chunks to the table at out; returns the query, which ends when all
    that is there has been read. A batch that is repeated after a failure overwrites its own files."""

    def write(batch: DataFrame, number: int) -> None:
        chunks(batch, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Limiter:
    """The exact sliding limit of one key: a hit counts until it is strictly older than the window, refused hits leave no
    trace. Holds at most `limit` times."""

    def __init__(self, span: int, limit: int, hits=()):
        self.span, self.limit, self.hits = span, limit, deque(hits)

    def hit(self, t: int) -> tuple[bool, int]:
        """(allowed, seconds to wait) of a hit at t microseconds; times do not fall."""
        while self.hits and self.hits[0] < t - self.span:
            self.hits.popleft()
        if len(self.hits) >= self.limit:
            return False, (self.hits[0] - (t - self.span)) // 1_000_000 + 1 if self.hits else self.span // 1_000_000
        self.hits.append(t)
        return True, 0


def limited(events: DataFrame, key: str, at: str, seconds: int, limit: int) -> DataFrame:
    """A stream of (key, at, allowed, retry_after) by a Limiter for each key; retry_after is 0 for allowed hits."""
    kind = events.schema[key].dataType.simpleString()
    out = f"{key} {kind}, at timestamp, allowed boolean, retry_after int"
    span = seconds * 1_000_000

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Limiter(span, limit, state.get[0] if state.exists else ())
        times = sorted(t for f in frames for t in f["t"])
        rows = [(k[0], pd.Timestamp(t, unit="us"), *own.hit(t)) for t in times]
        state.update((list(own.hits),))
        yield pd.DataFrame(rows, columns=[key, "at", "allowed", "retry_after"])

    own = events.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("t"))
    return own.groupBy(key).applyInPandasWithState(step, out, "hits array<bigint>", "append", GroupStateTimeout.NoTimeout)


def limited_table(events: DataFrame, key: str, at: str, tie: str, seconds: int, limit: int) -> DataFrame:
    """(key, tie, allowed, retry_after) of a table's events, as limited() has it of a stream; equal times go by tie.

    A pause of a whole window lets a key start anew, so its hits are divided there, and each part passes a task row by
    row in the order of time, of which a Limiter holds `limit` at most. Rows without a key or a time are left out."""
    span = seconds * 1_000_000
    own = events.select(key, tie, F.unix_micros(F.col(at).cast("timestamp")).alias("_t")).dropna(subset=[key, "_t"]).withColumn("_b", F.floor(F.col("_t") / span))
    blocks = own.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(key).orderBy("_b")
    blocks = blocks.withColumn("_part", F.col("_b") - F.row_number().over(order))  # blocks in a row have one part
    parted = lookup(own, [key, "_b"], blocks, "_n", events.count()).select(key, tie, "_t", "_part")
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, tie)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_, own = None, None
        for df in batches:
            out = []
            for k, i, t, p in zip(df[key], df[tie], df["_t"], df["_part"]):
                if (k, p) != at_:
                    at_, own = (k, p), Limiter(span, limit)
                out.append((k, i, *own.hit(t)))
            yield pd.DataFrame(out, columns=[key, tie, "allowed", "retry_after"])

    return parted.repartition(key, "_part").sortWithinPartitions(key, "_part", "_t", tie).mapInPandas(run, f"{key} {kinds[key]}, {tie} {kinds[tie]}, allowed boolean, retry_after int")


def windowed(events: DataFrame, at: str, by: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of value for each window and group, late rows aside. Works on streams and tables alike."""
    e = events.withColumn(at, F.col(at).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(at, late)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return e.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, at: str, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(by, start, end, n) of each run of events with no pause of gap or more."""
    e = events.withColumn(at, F.col(at).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(at, late)
    s = F.session_window(at, gap)
    return e.groupBy(by, s.alias("s")).agg(F.count("*").alias("n")).select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def frames(events: DataFrame) -> DataFrame:
    """Each row as one JSON text, for sinks that send one frame a row."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))
