"""Mixing sources to target shares of all tokens (problem 7).

Method: Pareto order sampling [Rosén, On sampling with probability proportional to size, 1997]. Each source is
allotted tokens, and each of its documents an expected number of copies in proportion to its weight, no more than
the source's cap. The whole part of that number is certain; for the rest, documents are ranked by random odds
over the odds of their fractional part, and the first ones get one more copy until the source's remaining tokens are
filled. Large documents, of which few fit, are drawn before the others, size by size, so that these make up for what
the large ones miss or exceed. What is then left, less than the next document in rank, is filled by documents of any
size that fit and may still be repeated, those drawn least first.

Ranks are never sorted as a whole: the place where a source is full is found by sums over equal intervals of the
rank, and only the documents of the interval in which it lies are put in order.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.plans.scratch import Scratch
from kgspark.plans.skew import lookup

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Intervals of the rank a source is divided into.
INTERVALS = 1 << 16
#: A document is large if it holds more than this share of its source's remaining tokens.
LARGE = 0.01
#: Documents of a source and size (by powers of two), first in rank, that the driver draws from: more than fit of the
#: large ones, and enough to fill what is left.
MOST_LARGE, MOST_FILLING = 128, 16
#: Targets are held by the driver and all tasks.
MOST_TARGETS = 10_000
#: Classes of weights, from 1 downwards, each half of the one before.
CLASSES = 24


def source_key(c: Column) -> Column:
    """A source's name without letter case, blanks and separators; null if nothing is left."""
    bare = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    return F.when(bare != "", bare)


def counted(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, key, h, tokens): tokens of each document's whole text, and a hash of the text. The driver reads the
    vocabulary, a file of a few megabytes, and sends it to all tasks."""
    with open(tokenizer, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t.as_py() or "")) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "key", "h", "tokens"])

    own = docs.select("doc_id", source_key(F.col("source")).alias("key"), F.xxhash64("text").alias("h"), "text")
    return own.mapInArrow(scan, "doc_id bigint, key string, h bigint, tokens bigint")


def allot(total: float, shares: dict, most: dict) -> dict:
    """Tokens for each source: a common multiple of the shares, no more than most, that adds up to total or to all there is."""
    got = {}
    open_, left = {k for k in shares if shares[k] > 0 and most.get(k, 0) > 0}, float(total)
    while open_:
        scale = left / sum(shares[k] for k in open_)
        full = {k for k in open_ if most[k] <= scale * shares[k]}
        if not full:
            got |= {k: scale * shares[k] for k in open_}
            break
        for k in full:
            got[k] = float(most[k])
            left -= most[k]
        open_ -= full
    return {k: got.get(k, 0.0) for k in shares}


def copies_per_weight(tokens: dict[int, float], wanted: float, cap: int) -> float:
    """The factor of the weights 0.5^class, capped at cap copies, with which the classes' tokens add up to wanted."""
    if not tokens or wanted <= 0:
        return 0.0
    lo, hi = 0.0, cap * 2.0 ** max(tokens)
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(cap, mid * 0.5**c) * t for c, t in tokens.items()) < wanted:
            lo = mid
        else:
            hi = mid
    return hi


def _weights(rows: DataFrame, n: int) -> DataFrame:
    """Adds class: the more often a text was delivered, the less its weight (half for two, a quarter for four)."""
    groups = rows.groupBy("key", "h").agg(F.count("*").alias("n"))
    groups = groups.withColumn("class", F.least(F.round(F.log2("n")), F.lit(CLASSES)).cast("int"))
    return lookup(rows, ["key", "h"], groups, "n", n)


def _firsts(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of each key and size; Spark keeps the best n of each task before it shuffles."""
    w = Window.partitionBy("key", "size").orderBy(*order, "doc_id")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).orderBy("key", F.desc("size"), "r")


def _by_key(spark, values: dict[str, float], name: str) -> DataFrame:
    """A row for each target, for broadcasts."""
    return F.broadcast(spark.createDataFrame([(k, float(v)) for k, v in values.items()], f"key string, {name} double"))


def _large(able: DataFrame, rests: dict[str, float]) -> list[tuple[int, str, int]]:
    """(doc_id, key, tokens) drawn of the large documents: from the largest size down, in the order of rank, as many as
    come nearest to what is expected of this and the larger sizes."""
    big = able.where(F.col("tokens") > F.col("rest") * LARGE)
    due: dict[str, dict[int, float]] = {}
    for r in big.groupBy("key", "size").agg(F.sum(F.col("p") * F.col("tokens")).alias("t")).collect():  # a row for each target and size
        due.setdefault(r["key"], {})[r["size"]] = r["t"]
    got, taken = dict.fromkeys(due, 0.0), []
    for r in _firsts(big.where("tokens <= rest"), MOST_LARGE, "q").select("key", "size", "doc_id", "tokens").collect():
        k, t = r["key"], r["tokens"]
        wanted = sum(x for size, x in due[k].items() if size >= r["size"])
        if got[k] + t / 2 <= wanted and got[k] + t <= rests[k]:
            got[k] += t
            taken.append((r["doc_id"], k, t))
    return taken


def _in_order(scratch: Scratch, able: DataFrame, rests: dict[str, float]) -> tuple[DataFrame, set[str]]:
    """(doc_id, key, tokens) of the documents that come first by rank (q; z is the same between 0 and 1) up to the one
    that no longer fits their source's rest, and the sources in which there is such a one."""
    able = able.join(_by_key(able.sparkSession, rests, "rest"), "key").withColumn("step", F.floor(F.col("z") * F.lit(float(INTERVALS))).cast("int"))
    sums = able.groupBy("key", "step").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    run = sums.withColumn("upto", F.sum("t").over(Window.partitionBy("key").orderBy("step")))
    edge = run.where("upto > rest").groupBy("key").agg(F.min(F.struct("step", (F.col("upto") - F.col("t")).alias("before"))).alias("m"))
    edge = scratch.save(edge.select("key", F.col("m.step").alias("at"), F.col("m.before").alias("before")))  # a row for each target
    placed = able.join(F.broadcast(edge), "key", "left")
    w = Window.partitionBy("key").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = placed.where("step = at").withColumn("upto", F.col("before") + F.sum("tokens").over(w)).where("upto <= rest")
    first = placed.where("at is null or step < at").select("doc_id", "key", "tokens").unionByName(near.select("doc_id", "key", "tokens"))
    return first, {r["key"] for r in edge.collect()}


def _drawn(scratch: Scratch, rows: DataFrame, rests: dict[str, float]) -> DataFrame:
    """(doc_id, key, extra): copies beyond the certain ones. rows: doc_id, key, tokens, whole, cap, p, q, z, rest."""
    spark = rows.sparkSession
    rows = rows.withColumn("size", F.floor(F.log2("tokens")).cast("int"))
    able = rows.where("p > 0 and rest > 0")
    large = _large(able, rests)
    left = dict(rests)
    for _, k, t in large:
        left[k] -= t
    first, edged = _in_order(scratch, able.where(F.col("tokens") <= F.col("rest") * LARGE).drop("rest"), left)
    first = first.unionByName(spark.createDataFrame(large, "doc_id bigint, key string, tokens bigint"))
    copies = scratch.save(first.select("doc_id", "key", "tokens", F.lit(1).alias("extra")))

    def rest_of(copies: DataFrame) -> dict[str, float]:
        sums = copies.groupBy("key").agg(F.sum(F.col("tokens") * F.col("extra")).alias("t")).collect()  # a row for each target
        return {k: t - {r["key"]: r["t"] for r in sums}.get(k, 0) for k, t in rests.items()}

    def spared(copies: DataFrame, left: dict[str, float]) -> DataFrame:
        """Documents that fit and may be repeated once more; the next copy ranks behind the one before."""
        had = rows.drop("rest").join(copies.select("doc_id", "key", "extra").hint("shuffle_hash"), ["doc_id", "key"], "left").withColumn("extra", F.coalesce("extra", F.lit(0)))
        had = had.withColumn("spare", F.col("cap") - F.col("whole") - F.col("extra")).join(_by_key(spark, left, "left"), "key")
        return had.where((F.col("spare") > 0) & (F.col("tokens") <= F.col("left")))

    left = rest_of(copies)
    todo = {k for k, t in left.items() if t >= 1} - edged
    while todo:  # all that could be drawn was, and large ones did not fit: everything else is repeated
        again = scratch.save(spared(copies, {k: left[k] for k in todo}).select("doc_id", "key", "tokens", "spare", "q", "z"))
        held = {r["key"]: r["t"] for r in again.groupBy("key").agg(F.sum("tokens").alias("t")).collect()}  # a row for each target
        # all of them as often as they fit together; where they do not, the first ones by rank
        often = _by_key(spark, {k: left[k] // t for k, t in held.items() if t <= left[k]}, "often")
        all_ = again.join(often, "key").select("doc_id", "key", "tokens", F.least("spare", "often").cast("int").alias("extra"))
        ranked = again.select("doc_id", "key", "tokens", F.coalesce("z", F.lit(0.5)).alias("z"), F.coalesce("q", F.lit(1.0)).alias("q"))
        some, edged = _in_order(scratch, ranked, {k: left[k] for k, t in held.items() if t > left[k]})
        both = copies.unionByName(all_).unionByName(some.withColumn("extra", F.lit(1)))
        copies = scratch.save(both.groupBy("doc_id", "key", "tokens").agg(F.sum("extra").cast("int").alias("extra")))
        left = rest_of(copies)
        todo = {k for k in held if left[k] >= 1} - edged
    filling = []
    last = spared(copies, left)
    for r in _firsts(last, MOST_FILLING, "extra", F.asc_nulls_last("q")).select("key", "doc_id", "tokens", "spare").collect():
        n = int(min(r["spare"], left[r["key"]] // r["tokens"]))
        if n:
            left[r["key"]] -= n * r["tokens"]
            filling.append((r["doc_id"], r["key"], n))
    fill = spark.createDataFrame(filling, "doc_id bigint, key string, extra int")
    return copies.select("doc_id", "key", "extra").unionByName(fill).groupBy("doc_id", "key").agg(F.sum("extra").cast("int").alias("extra"))


def mixture(
    docs: DataFrame,
    targets: DataFrame,
    *,
    total_tokens: float | None = None,
    seed: int = 20,
    tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, tokens, copies) and its report, a row for each target.

    docs: doc_id (unique), source, text; sources are compared without letter case, blanks and separators, and documents
    of other or no sources are left out. targets: source, target_share, max_repeats. total_tokens is by default what
    the targets' documents hold once; sources that cannot supply their share leave it to the others in proportion.
    Texts without tokens have no size and never enter. Null shares and caps count as 0.
    The report: source, target_share, max_repeats, supply_tokens, wanted_tokens, mixed_tokens, actual_share.
    """
    spark = docs.sparkSession
    listed = targets.select(
        "source", source_key(F.col("source")).alias("key"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("cap")
    ).limit(MOST_TARGETS + 1).collect()
    if len(listed) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    listed = [r for r in listed if r.key]
    schema = "key string, source string, share double, cap int"
    names = spark.createDataFrame([(r.key, r.source, float(r.share), int(r.cap)) for r in listed], schema)
    scratch = Scratch(spark)
    wanted_keys = F.broadcast(names.select("key"))
    known = docs.withColumn("_key", source_key(F.col("source"))).join(wanted_keys.withColumnRenamed("key", "_key"), "_key", "left_semi")
    rows = scratch.save(counted(known, tokenizer).where("tokens > 0"))
    rows = scratch.save(_weights(rows, rows.count()))
    supply: dict[str, dict[int, float]] = {}
    for r in rows.groupBy("key", "class").agg(F.sum("tokens").alias("t")).collect():  # targets times CLASSES at most
        supply.setdefault(r["key"], {})[r["class"]] = float(r["t"])
    shares = {r.key: float(r.share) for r in listed}
    caps = {r.key: max(0, int(r.cap)) for r in listed}
    have = {k: sum(supply.get(k, {}).values()) for k in shares}
    total = sum(have.values()) if total_tokens is None else float(total_tokens)
    tokens = allot(total, shares, {k: have[k] * caps[k] for k in shares})
    factor = {k: copies_per_weight(supply.get(k, {}), tokens[k], caps[k]) for k in shares}
    certain = {
        k: sum(int(min(caps[k], factor[k] * 0.5**c) + 1e-9) * t for c, t in supply.get(k, {}).items()) for k in shares
    }
    plan = F.broadcast(
        spark.createDataFrame(
            [(k, factor[k], caps[k], max(0.0, tokens[k] - certain[k])) for k in shares],
            "key string, factor double, cap int, rest double",
        )
    )
    # certain copies, and the rank of the rest: random odds over the odds of being drawn
    copies = F.least(F.col("cap").cast("double"), F.col("factor") * F.pow(F.lit(0.5), F.col("class"))) + F.lit(1e-9)
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    drawn = (
        rows.join(plan, "key")
        .withColumn("whole", F.floor(copies).cast("int"))
        .withColumn("p", F.greatest(copies - F.floor(copies) - F.lit(2e-9), F.lit(0.0)))
        .withColumn("q", F.when(F.col("p") > 0, (u / (F.lit(1.0) - u)) / (F.col("p") / (F.lit(1.0) - F.col("p")))))
        .withColumn("z", F.col("q") / (F.lit(1.0) + F.col("q")))
        .select("doc_id", "key", "tokens", "whole", "cap", "p", "q", "z", "rest")
    )
    drawn = scratch.save(drawn)
    extra = _drawn(scratch, drawn, {k: tokens[k] - certain[k] for k in shares if tokens[k] - certain[k] > 0})
    mixed = (
        drawn.join(extra.hint("shuffle_hash"), ["doc_id", "key"], "left")
        .withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
        .where("copies > 0")
        .join(F.broadcast(names.select("key", "source")), "key")
        .select("doc_id", "source", "tokens", "copies")
    )
    mixed = scratch.result(mixed)
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"))
    ask = spark.createDataFrame(
        [(r.source, float(r.share), int(r.cap), int(have[r.key]), tokens[r.key]) for r in listed],
        "source string, target_share double, max_repeats int, supply_tokens bigint, wanted_tokens double",
    )
    both = ask.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed", F.lit(0)).cast("bigint")).drop("mixed")
    whole = mixed.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
    report = both.withColumn("actual_share", F.col("mixed_tokens") / F.lit(float(max(1, whole))))
    return mixed, report


def checked(mixed: DataFrame, report: DataFrame, docs: DataFrame, near: float = 0.01) -> DataFrame:
    """(source, own, capped, near) of each target: whether all its documents are of that source, none is repeated beyond
    the cap, and its tokens are within that share of what it was allotted, without exceeding it."""
    from_ = docs.select("doc_id", source_key(F.col("source")).alias("_s"))
    m = mixed.join(from_, "doc_id").groupBy("source").agg(
        F.bool_and(F.col("_s") == source_key(F.col("source"))).alias("own"), F.max("copies").alias("most")
    )
    both = report.join(m, "source", "left")
    fits = (F.col("mixed_tokens") <= F.col("wanted_tokens") + 0.5) & (F.col("mixed_tokens") >= F.col("wanted_tokens") * (1 - near) - 0.5)
    return both.select("source", F.coalesce("own", F.lit(True)).alias("own"), F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("capped"), fits.alias("near"))
