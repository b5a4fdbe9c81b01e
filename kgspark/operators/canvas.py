"""Analytics of the drawn graph: components, levels, sizes and places."""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.operators.graph import degree
from kgspark.plans.scratch import Scratch
from kgspark.plans.skew import lookup
from kgspark.plans.stars import star_edges

#: Tables of levels that a search reads before they are written as one.
MOST_TABLES = 20
#: Characters of an id that divide the nodes of one level and degree.
LEAD = 4
CELL_W, CELL_H, GAP = 175, 125, 80


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each node is connected with. Edges to what is no node do not connect."""
    ids = nodes.select("id").dropna().distinct()
    stars = star_edges(ids, edges.select("src", "dst")).select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return ids.join(stars, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth): steps along edges from the nodes that no edge but a loop leads to; where a component has no such
    node, from its least node. What a search does not reach stands two levels below the deepest one it did.

    Each round writes the nodes it reaches and nothing else; those reached before are never written again."""
    scratch = Scratch(nodes.sparkSession)
    ids = scratch.save(nodes.select("id").dropna().distinct())
    edges = edges.where("src <> dst").select("src", "dst").distinct().join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    edges = scratch.save(edges.select("src", "dst"))
    n = edges.count()
    roots = ids.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    comp = scratch.save(components(ids, edges))
    rooted = comp.join(roots, "id", "left_semi").select("component").distinct()
    alone = comp.join(rooted, "component", "left_anti").groupBy("component").agg(F.min("id").alias("id")).select("id")
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    reached = [scratch.save(roots.unionByName(alone).withColumn("depth", F.lit(0)))]
    for d in count(1):
        front = reached[-1].select("id").join(out, "id").withColumnRenamed("id", "src")
        nxt = lookup(edges, ["src"], front, "deg", n).select(F.col("dst").alias("id")).distinct()
        for seen in reached:
            nxt = nxt.join(seen.select("id"), "id", "left_anti")
        nxt = scratch.save(nxt.withColumn("depth", F.lit(d)))
        if not nxt.limit(1).count():
            break
        reached.append(nxt)
        if len(reached) > MOST_TABLES:  # long chains: one table again, so plans stay short
            reached = [scratch.save(reduce(DataFrame.unionByName, reached[:-1])), nxt]
    found = comp.join(reduce(DataFrame.unionByName, reached), "id", "left")
    deepest = scratch.save(found.groupBy("component").agg((F.max("depth") + 2).alias("below"), F.count("*").alias("n")))
    placed = lookup(scratch.save(found), ["component"], deepest, "n", ids.count())
    return scratch.result(placed.select("id", F.coalesce("depth", "below").alias("depth")))


def node_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, size, label_size) of every node, by the square root of its degree."""
    d = F.col("degree")
    size = F.floor(F.least(F.lit(54.0), 17 + F.sqrt(d) * 10.5) + 0.5).cast("int")
    label = F.when(d >= 6, 13.0).when(d >= 3, 11.5).otherwise(10.0)
    return degree(nodes, edges).select("id", "degree", size.alias("size"), label.alias("label_size"))


def layered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth, x, y): nodes in rows by depth, the busiest first; a row wraps at 1.6 times the root of their number.

    Places within a level are counted within each degree and behind the higher degrees, so no task orders a whole level
    unless all its nodes have one degree; these are dealt out by a hash of their ids and counted in two steps."""
    scratch = Scratch(nodes.sparkSession)
    at = scratch.save(levels(nodes, edges).join(degree(nodes, edges), "id"))
    n = at.count()
    cols = max(4, int(n**0.5 * 1.6 + 0.5))
    # text order in two steps: by the first characters, then within those
    lead = F.left("id", F.lit(LEAD))
    part = at.groupBy("depth", "degree", lead.alias("lead")).agg(F.count("*").alias("c"))
    before = Window.partitionBy("depth").orderBy(F.desc("degree"), "lead").rowsBetween(Window.unboundedPreceding, -1)
    part = scratch.save(part.withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0))))
    within = Window.partitionBy("depth", "degree", "lead").orderBy("id")
    at = at.withColumn("lead", lead).withColumn("r", F.row_number().over(within) - 1)
    at = lookup(at, ["depth", "degree", "lead"], part, "c", n).withColumn("i", F.col("base") + F.col("r"))
    per = part.groupBy("depth").agg(F.sum("c").alias("n")).withColumn("rows", F.ceil(F.col("n") / cols))
    above = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)  # one row for each level
    per = per.withColumn("rows_above", F.coalesce(F.sum("rows").over(above), F.lit(0))).withColumn("gaps", F.row_number().over(Window.orderBy("depth")) - 1)
    row = F.floor(F.col("i") / cols)
    inrow = F.least(F.lit(cols), F.col("n") - row * cols)
    per = scratch.save(per.withColumn("_n", F.col("n")))
    return scratch.result(lookup(at, ["depth"], per, "_n", n).select(
        "id", "depth",
        ((F.col("i") % cols) * CELL_W - (inrow - 1) * CELL_W / 2).cast("double").alias("x"),
        ((F.col("rows_above") + row) * CELL_H + F.col("gaps") * CELL_H * 0.35).cast("double").alias("y"),
    ))


def shelf_pack(boxes: DataFrame, by: str = "canvas") -> DataFrame:
    """(by, box, w, h, x, y): the boxes of each canvas in shelves, the largest first, without overlap.

    A shelf is as wide as the largest box or 1.35 times the root of all areas, GAP lies between boxes and shelves. Which
    box opens a shelf is a chain of searches in the running width of the sorted boxes; a canvas is what one drawing
    holds, so its boxes are numbers in one array."""

    def opened(widths: np.ndarray, wide: float) -> np.ndarray:
        """Places in the order of boxes at which shelves begin."""
        left = np.concatenate(([0.0], np.cumsum(widths + GAP)))  # where each box would stand on one endless shelf
        at, i = [], 0
        while i < len(widths):
            at.append(i)
            i = max(i + 1, int(np.searchsorted(left[1:] - GAP - left[i], wide, "right")))
        return np.array(at)

    def place(df: pd.DataFrame) -> pd.DataFrame:
        area = df["w"] * df["h"]
        df = df.assign(area=area).sort_values(["area", "box"], ascending=[False, True], kind="stable")
        w, h = df["w"].to_numpy(), df["h"].to_numpy()
        at = opened(w, max(w[0], area.sum() ** 0.5 * 1.35))
        shelf = np.searchsorted(at, np.arange(len(w)), "right") - 1
        left = np.cumsum(w + GAP) - w - GAP
        top = np.concatenate(([0.0], np.cumsum(np.maximum.reduceat(h, at) + GAP)))
        return df.assign(x=left - left[at][shelf], y=top[shelf])[[by, "box", "w", "h", "x", "y"]]

    own = boxes.select(by, "box", F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    return own.groupBy(by).applyInPandas(place, f"{by} {kinds[by]}, box {kinds['box']}, w double, h double, x double, y double")
