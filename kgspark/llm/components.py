"""Groups of records that pairwise matches link directly or indirectly (problem 1).

Method: alternating large-star and small-star edge rewrites (kgspark/plans/stars.py). When a round of both changes
nothing, every record hangs on the least record of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.plans.stars import star_edges


def linked(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, group) of every node linked with at least one other; group is the least node of its component."""
    stars = star_edges(nodes, links)
    roots = stars.select(F.col("lo").alias("node"), F.col("lo").alias("group")).distinct()
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("group")).unionByName(roots)


def grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, group) of every distinct non-null node; one that is linked with no other is its own group."""
    n = nodes.columns[0]
    ids = nodes.select(F.col(n).alias("node")).dropna().distinct()
    stars = star_edges(nodes, links).select(F.col("hi").alias("node"), F.col("lo").alias("group"))
    return ids.join(stars, "node", "left").select("node", F.coalesce("group", "node").alias("group"))


def accepted_links(pairs: DataFrame) -> DataFrame:
    """The pairs of entity_pairs whose verdict is true; a null verdict is undecided and links nothing."""
    return pairs.where(F.col("verdict")).select("left_no", "right_no")
