"""Connected components of any graph by alternating star contraction.

[Kiveris et al., Connected Components in MapReduce and Beyond, 2014]. An edge is kept as (hi, lo) with hi > lo. The large
star of u links every neighbour above u to the least of u and its neighbours; the small star of u links every neighbour
below u, and u, to the least of them. When a round of both changes nothing, every node hangs on the least of its
component. Rounds grow with the square of the logarithm of the longest chain, and hubs are never brought together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kgspark.plans.scratch import Scratch
from kgspark.plans.skew import lookup


def _edges(df: DataFrame, a, b) -> DataFrame:
    """Distinct edges (hi, lo) without loops."""
    return df.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("deg"))
    # only neighbours above u move; the edge (u, v) with v > u is (hi=v, lo=u)
    up = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    return _edges(lookup(up, ["u"], least, "deg", 2 * n), F.col("v"), F.col("m"))


def _small_star(scratch: Scratch, edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = scratch.save(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg")))
    moved = lookup(down, ["u"], least, "deg", n)
    return _edges(
        moved.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m")), F.col("v"), F.col("m")
    )


def _saved(scratch: Scratch, edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The written edges with their number and the sum of their hashes, taken while they are written."""
    seen = Observation()
    out = scratch.save(edges.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")), F.lit(0)).alias("h")))
    return out, (seen.get["n"], seen.get["h"])


def star_edges(nodes: DataFrame, links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(hi, lo) for every node hi that is not the least of its component, whose least node is lo.

    nodes: one column, numbers or text. links: two such columns. Links with a null end, with an end that is no node, or
    from a node to itself count for nothing; repeats and either direction are the same link. Empty inputs give no rows.
    Raises RuntimeError if max_rounds do not suffice.
    """
    scratch = Scratch(nodes.sparkSession)
    n, a, b = nodes.columns[0], *links.columns
    edges, (size, _) = _saved(scratch, _edges(links.dropna(), F.col(a), F.col(b)))
    # ends that are nodes, with their degree: one row an end, so this join is between unique keys
    ends = edges.select(F.explode(F.array("hi", "lo")).alias("u")).groupBy("u").agg(F.count("*").alias("deg"))
    known = scratch.save(ends.join(nodes.select(F.col(n).alias("u")).dropna().distinct(), "u", "left_semi"))
    hi = lookup(edges, ["hi"], known.withColumnRenamed("u", "hi"), "deg", 2 * size)
    edges, before = _saved(scratch, lookup(hi, ["lo"], known.withColumnRenamed("u", "lo"), "deg", 2 * size).select("hi", "lo"))
    for _ in range(max_rounds):
        if not before[0]:
            return edges
        large = scratch.save(_large_star(edges, before[0]))
        last = edges
        edges, after = _saved(scratch, _small_star(scratch, large, before[0]))
        # equal numbers and sums only suggest that nothing changed
        if after == before and not edges.join(last, ["hi", "lo"], "left_anti").limit(1).count():
            scratch.forget()
            return edges
        scratch.forget()
        before = after
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
