"""Finding and merging entities that stand for the same thing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types
from pyspark.sql.window import Window

from kgspark.functions.text import acronym_forms, acronym_of, is_acronym_pair, normalize, ratio, ratio_can_reach
from kgspark.operators import vectors
from kgspark.operators.canvas import components
from kgspark.operators.graph import degree

STRING_MERGE, FUZZY_FROM, EMBED_MERGE, EMBED_ASK, ACRONYM_ASK = 88.0, 5, 0.90, 0.55, 0.54
MOST_ASKED = 200
#: Rows of a block that are held against as many others at once.
TILE_ROWS = 2_000
#: Of these, rows whose cosines a worker holds at once; pairs that it hands over at once.
PART_ROWS, PART_PAIRS = 250, 20_000


def candidates(entities: DataFrame) -> DataFrame:
    """Entities that may be merged: those no user edited, with their block (workspace and type, concept if none)."""
    block = F.concat_ws("|", "workspace_id", F.coalesce("type", F.lit("concept")))
    return entities.where(~F.coalesce("user_edited", F.lit(False))).withColumn("block", block)


def blocked_pairs(a: DataFrame) -> DataFrame:
    """Pairs of the same block whose names may reach the threshold of the string tier: equal names, or a shared
    piece. Two names of that similarity differ by few edits, so cutting the shorter into one piece more than these
    leaves a piece whole in the other [Ukkonen; pigeonhole]; pairs meet on such pieces at about the same place
    instead of on the block alone, so no block is compared all with all."""
    n = F.length("canonical_name")
    # indel distance d of a pair with ratio >= 88: d <= 0.12 (la + lb); with la >= 0.785 lb: d <= 0.2729 la at most
    pieces = F.floor(F.lit(0.2729) * n).cast("int") + 1
    size = F.floor(n / pieces).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), pieces - 1),
        lambda i: F.struct(
            (i * size).alias("at"),
            F.substring(F.col("canonical_name"), i * size + 1, F.when(i == pieces - 1, n).otherwise(size)).alias("piece"),
        ),
    )
    fuzzy = a.where(n >= FUZZY_FROM)
    short = fuzzy.select("block", F.col("id").alias("id_a"), F.col("canonical_name").alias("name_a"), F.explode(cut).alias("c"))
    short = short.select("block", "id_a", "name_a", "c.at", "c.piece", F.length("c.piece").alias("k"))
    # the longer name offers the substrings of the sizes the pieces of shorter names have
    sizes = short.select("block", "k", F.length("name_a").alias("la")).distinct()
    longer = fuzzy.select("block", F.col("id").alias("id_b"), F.col("canonical_name").alias("name_b"))
    spots = longer.join(sizes, "block").where((F.length("name_b") >= F.col("la")) & (F.lit(200.0) * F.col("la") >= F.lit(STRING_MERGE) * (F.col("la") + F.length("name_b"))))
    spots = spots.select("block", "id_b", "name_b", "k").distinct()
    grams = F.explode(
        F.transform(
            F.sequence(F.lit(1), F.length("name_b") - F.col("k") + 1),
            lambda i: F.struct(i.alias("place"), F.substring(F.col("name_b"), i, F.col("k")).alias("piece")),
        )
    )
    spots = spots.where(F.length("name_b") >= F.col("k")).select("block", "id_b", "name_b", grams.alias("g"))
    spots = spots.select("block", "id_b", "name_b", "g.place", "g.piece")
    shift = F.floor(F.lit(0.2729) * F.length("name_a"))  # edits before a piece move it by no more than their number
    met = short.join(spots, ["block", "piece"]).where(
        (F.col("id_a") != F.col("id_b"))
        & (F.length("name_a") <= F.length("name_b"))
        & (F.abs(F.col("place") - 1 - F.col("at")) <= shift)
    )
    return met.select("block", "id_a", "name_a", "id_b", "name_b").distinct()


def string_pairs(entities: DataFrame, threshold: float = STRING_MERGE) -> DataFrame:
    """(id_a, id_b) with id_a < id_b: pairs of a block whose names have that similarity, or are equal if one is short."""
    a = candidates(entities).where("canonical_name <> ''").select("block", "id", "canonical_name").distinct()
    pairs = blocked_pairs(a).where(ratio_can_reach(F.col("name_a"), F.col("name_b"), threshold))
    alike = pairs.where((F.col("name_a") == F.col("name_b")) | (ratio("name_a", "name_b") >= threshold)).select("id_a", "id_b")
    rank = a.groupBy("block", "canonical_name").agg(F.min("id").alias("id_a"))
    equal = a.join(rank, ["block", "canonical_name"]).where("id <> id_a").select("id_a", F.col("id").alias("id_b"))
    both = alike.unionByName(equal)
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def one_row_each(entities: DataFrame, order: str) -> DataFrame:
    """entities with one row for each id: the first by order, edited by a user if any row of the id is."""
    edited = F.coalesce("user_edited", F.lit(False))
    first = entities.groupBy("id").agg(F.min_by(F.struct(*entities.columns), F.col(order)).alias("e"), F.max(edited).alias("edited"))
    return first.select("e.*", "edited").withColumn("user_edited", F.col("edited")).drop("edited")


def _tiles(named: DataFrame, embed: Callable, tile_rows: int) -> DataFrame:
    """named with embedding, once for each two tiles (_low, _high) of its block that its own tile (_t) is one of. All rows
    of an id are in one tile."""
    sizes = named.groupBy("block").agg(F.count("*").alias("_n")).where("_n > 1")
    sizes = sizes.select("block", F.ceil(F.col("_n") / tile_rows).cast("int").alias("_tiles"))
    v = vectors.embedded(named.join(sizes, "block"), "name", embed)
    v = v.withColumn("_t", F.pmod(F.xxhash64("id"), F.col("_tiles")).cast("int"))
    v = v.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return v.withColumn("_low", F.least("_t", "_o")).withColumn("_high", F.greatest("_t", "_o")).drop("_tiles", "_o")


def _tile(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of two tiles by id and name, their unit vectors, and which rows are of the one and of the other tile."""
    t = pa.Table.from_batches(batches)
    t = t.take(pc.sort_indices(t, [("id", "ascending"), ("name", "ascending")], null_placement="at_start")).combine_chunks()
    m = pc.list_flatten(t["embedding"]).to_numpy().astype(np.float64).reshape(len(t), -1)
    size = np.linalg.norm(m, axis=1)
    m = m / np.where(size > 0, size, 1)[:, None]  # a vector without length is like none
    of = t["_t"].to_numpy()
    return t, m, np.flatnonzero(of == t["_low"][0].as_py()), np.flatnonzero(of == t["_high"][0].as_py())


def _one(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def _alike(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of two tiles and, PART_PAIRS at a time, which pairs of them have that cosine or more, and the cosines. Rows
    are in the order of ids and the lesser comes first."""
    t, m, a, b = _tile(batches)
    for k in range(0, len(a), PART_ROWS):
        part = a[k : k + PART_ROWS]
        c = m[part] @ m[b].T
        i, j = np.nonzero(c >= floor)
        c, i, j = c[i, j], part[i], b[j]
        if t["_low"][0] == t["_high"][0]:
            c, i, j = c[i < j], i[i < j], j[i < j]
        for n in range(0, len(c), PART_PAIRS):
            x, y = i[n : n + PART_PAIRS], j[n : n + PART_PAIRS]
            yield t, np.minimum(x, y), np.maximum(x, y), c[n : n + PART_PAIRS]


def vector_pairs(named: DataFrame, embed: Callable, floor: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(block, id_a, name_a, id_b, name_b, score) with id_a < id_b: all pairs of a block whose names' vectors have that
    cosine or more. named: block, id, name. A block is dealt out to tiles, and each two tiles are compared all with
    all, PART_ROWS rows at a time, so no task holds a whole block or all pairs of two tiles; the work still grows with
    the square of a block."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, i, j, c in _alike(batches, floor):
            lo, hi = pa.array(i), pa.array(j)
            cols = [t["block"].take(lo), t["id"].take(lo), t["name"].take(lo), t["id"].take(hi), t["name"].take(hi), pa.array(c)]
            yield pa.RecordBatch.from_arrays([*map(_one, cols)], names=["block", "id_a", "name_a", "id_b", "name_b", "score"])

    v = _tiles(named.select("block", "id", "name"), embed, tile_rows)
    return v.groupBy("block", "_low", "_high").applyInArrow(score, "block string, id_a string, name_a string, id_b string, name_b string, score double")


def tiered_pairs(named: DataFrame, embed: Callable, floor: float, line: float = EMBED_MERGE, clear: float = 1e-9, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id_a, id_b, name_low, name_high, score, tier) of vector_pairs() that are not within clear of line: names in their
    own order, scores rounded to six places, `merge` from line on and else `ask`. All of it is told where the pairs are
    found, by whole columns, since there are very many."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = None
        for t, i, j, c in _alike(batches, floor):
            if place is None:  # names by their UTF-8 bytes, as Spark orders them
                place = np.unique(np.array([x.encode() for x in t["name"].to_pylist()], object), return_inverse=True)[1]
            ok = np.abs(c - line) > clear
            i, j, c = i[ok], j[ok], c[ok]
            swap = place[i] > place[j]
            rows = [pa.array(x) for x in (i, j, np.where(swap, j, i), np.where(swap, i, j))]
            cols = [t["id"].take(rows[0]), t["id"].take(rows[1]), t["name"].take(rows[2]), t["name"].take(rows[3])]
            tiers = pa.array(["ask", "merge"]).take(pa.array((c >= line).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*map(_one, cols), pa.array(rounded(c)), tiers], names=["id_a", "id_b", "name_low", "name_high", "score", "tier"])

    v = _tiles(named.select("block", "id", "name"), embed, tile_rows)
    return v.groupBy("block", "_low", "_high").applyInArrow(score, "id_a string, id_b string, name_low string, name_high string, score double, tier string")


def named_pairs(named: DataFrame, embed: Callable, floor: float, below: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id_a, name_a, id_b, name_b) with id_a < id_b: the different pairs of ids of vector_pairs() with scores less than
    below, each with the last name of either end among those pairs. All rows of an id and block are in one tile, so two
    tiles know the names of their pairs for good; only pairs of two ids that are in several blocks each are shuffled."""
    n = named.select("block", "id", "name").distinct()
    own = Window.partitionBy("id")
    n = n.withColumn("_several", F.coalesce(F.min("block").over(own) != F.max("block").over(own), F.lit(False)))

    def score(batches: Iterator[pa.RecordBatch], apart: bool) -> Iterator[pa.RecordBatch]:
        t, m, a, b = _tile(batches)
        no, several = _one(t["id"]).dictionary_encode().indices.to_numpy(), _one(t["_several"]).to_numpy(zero_copy_only=False)
        cuts = np.append(np.flatnonzero(np.diff(no[a], prepend=-1)), len(a))  # rows of an id stay together
        at = 0
        while at < len(a):
            k = np.searchsorted(cuts, at + PART_ROWS, "right") - 1
            end = int(cuts[k] if cuts[k] > at else cuts[k + 1])
            part, at = a[at:end], end
            c = m[part] @ m[b].T
            i, j = np.nonzero((c >= floor) & (c < below))
            i, j = part[i], b[j]
            ok = no[i] < no[j] if t["_low"][0] == t["_high"][0] else np.ones(len(i), bool)
            if apart:
                ok &= ~(several[i] & several[j])
            i, j = np.minimum(i[ok], j[ok]), np.maximum(i[ok], j[ok])
            key = no[i].astype(np.int64) * len(no) + no[j]
            if len(np.unique(no[part])) < len(part) or len(np.unique(no[b])) < len(b):
                order = np.argsort(key, kind="stable")
                i, j, key = i[order], j[order], key[order]
                start = np.flatnonzero(np.diff(key, prepend=-1))
                i, j = (np.maximum.reduceat(x, start) if len(x) else x for x in (i, j))  # names rise with the rows of an id
            for k in range(0, len(i), PART_PAIRS):
                lo, hi = pa.array(i[k : k + PART_PAIRS]), pa.array(j[k : k + PART_PAIRS])
                yield pa.RecordBatch.from_arrays([*map(_one, (t["id"].take(lo), t["name"].take(lo), t["id"].take(hi), t["name"].take(hi)))], names=["id_a", "name_a", "id_b", "name_b"])

    def pairs(rows: DataFrame, apart: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from score(batches, apart)

        return _tiles(rows, embed, tile_rows).groupBy("block", "_low", "_high").applyInArrow(run, "id_a string, name_a string, id_b string, name_b string")

    both = pairs(n.where("_several"), False).groupBy("id_a", "id_b").agg(F.max("name_a").alias("name_a"), F.max("name_b").alias("name_b"))
    return pairs(n, True).unionByName(both)


def rounded(c: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 rounded to six places as Spark's round() does it, half up by their decimal digits."""
    at = c * 1e6
    out = np.floor(at + 0.5) / 1e6
    for i in np.flatnonzero(np.abs(at - np.floor(at) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(c[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def best_pairs(named: DataFrame, embed: Callable, floor: float, below: float = EMBED_MERGE, most: int = MOST_ASKED, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(block, id_a, id_b, score) with id_a < id_b: asked() of the pairs of vector_pairs(), each once with its best score,
    rounded to six places, of those that are less than below. Since all rows of an id are in one tile, each two tiles
    know their own pairs' scores for good and pass on no more than the first `most` in asked()'s order."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, m, a, b = _tile(batches)
        no = t["id"].combine_chunks().dictionary_encode().indices.to_numpy()  # rises with the ids, which are sorted
        first = [np.flatnonzero(np.diff(no[x], prepend=-1)) for x in (a, b)]
        c = np.maximum.reduceat(np.maximum.reduceat(m[a] @ m[b].T, first[0], 0), first[1], 1)
        if t["_low"][0] == t["_high"][0]:
            c[np.tril_indices(len(c))] = -np.inf
        sure, least = c[(c >= floor) & (c < below - 1e-6)], floor
        if len(sure) > most:  # what falls short of the last place by more than rounding can't come in
            least = max(floor, np.partition(sure, len(sure) - most)[len(sure) - most] - 2e-6)
        i, j = np.nonzero((c >= least) & (c < below + 1e-6))
        c, i, j = c[i, j], a[first[0]][i], b[first[1]][j]
        i, j = np.minimum(i, j), np.maximum(i, j)
        r = rounded(c)
        r, i, j = r[r < below], i[r < below], j[r < below]
        top = np.lexsort((-no[j], -no[i], -r))[:most]
        lo, hi = pa.array(i[top]), pa.array(j[top])
        yield pa.RecordBatch.from_arrays([*map(_one, (t["block"].take(lo), t["id"].take(lo), t["id"].take(hi))), pa.array(r[top])], names=["block", "id_a", "id_b", "score"])

    v = _tiles(named.select("block", "id", "name"), embed, tile_rows)
    return asked(v.groupBy("block", "_low", "_high").applyInArrow(score, "block string, id_a string, id_b string, score double"), most)


def _initialed(named: DataFrame) -> DataFrame:
    """Different rows of named with their initials, null for a single word, and the initials (of 2 to 6 letters) that
    they may stand for."""
    n = named.select("block", "id", "name", normalize(F.col("name")).alias("n")).where("n <> ''").distinct()
    fit = lambda x: F.length(x).between(2, 6)
    first = acronym_of(F.col("n"))
    return n.select("block", "id", "name", F.when(fit(first), first).alias("initials"), F.filter(F.array_distinct(acronym_forms(F.col("n"))), fit).alias("forms"))


def _acronyms(short: DataFrame, long: DataFrame) -> DataFrame:
    """acronym_pairs() of which one row is of short and stands for one of long. Two rows that stand for each other meet
    both ways and are taken once, so no pair of rows comes twice and nothing is shuffled to find that out."""
    a = short.select("block", F.col("id").alias("x"), F.col("name").alias("xn"), F.col("initials").alias("xi"), F.explode("forms").alias("key"))
    b = long.where("initials is not null").select("block", F.col("id").alias("y"), F.col("name").alias("yn"), F.col("forms").alias("yf"), F.col("initials").alias("key"))
    low = F.col("x") < F.col("y")
    met = a.join(b, ["block", "key"]).where((F.col("x") != F.col("y")) & (low | F.col("xi").isNull() | ~F.array_contains("yf", F.col("xi"))))
    either = lambda p, q, name: F.when(low, F.col(p)).otherwise(F.col(q)).alias(name)
    return met.select("block", either("x", "y", "id_a"), either("xn", "yn", "name_a"), either("y", "x", "id_b"), either("yn", "xn", "name_b"), F.lit(ACRONYM_ASK).alias("score"))


def acronym_pairs(named: DataFrame) -> DataFrame:
    """(block, id_a, name_a, id_b, name_b, score) with id_a < id_b: pairs of a block of which one name is the other's
    initials, met on these; score is ACRONYM_ASK. named: block, id, name."""
    n = _initialed(named)
    return _acronyms(n, n)


def acronym_ids(named: DataFrame) -> DataFrame:
    """(id_a, id_b) of acronym_pairs(), each once. Only pairs with an id that has several rows can come twice, so the
    others are not shuffled again."""
    n = _initialed(named).withColumn("_rows", F.count("*").over(Window.partitionBy("id")))
    once, more = n.where("_rows = 1"), n.where("_rows > 1")
    ids = lambda short, long: _acronyms(short, long).select("id_a", "id_b")
    return ids(once, once).unionByName(ids(more, n).unionByName(ids(once, more)).distinct())


def near_pairs(entities: DataFrame, embed: Callable, ask: bool, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(block, id_a, name_a, id_b, name_b, score, tier) of the pairs that the embedding and acronym tiers merge or,
    with ask, ask about; without it there is nobody to answer, so only those to be merged are looked for."""
    named = candidates(entities).select("block", "id", F.coalesce("name", F.lit("")).alias("name")).where("name <> ''").distinct()
    found = vector_pairs(named, embed, EMBED_ASK if ask else EMBED_MERGE, tile_rows)
    if ask:
        found = found.unionByName(acronym_pairs(named))
        found = found.groupBy("block", "id_a", "name_a", "id_b", "name_b").agg(F.max("score").alias("score"))
    return found.withColumn("tier", F.when(F.col("score") >= EMBED_MERGE, "merge").otherwise("ask"))


def tier(score: Column, a: Column, b: Column) -> Column:
    """`merge`, `ask` or null by the cosine of two names' vectors; acronyms are asked about whatever their cosine."""
    return F.when(score >= EMBED_MERGE, "merge").when(score >= EMBED_ASK, "ask").when(is_acronym_pair(a, b), "ask")


def asked(pairs: DataFrame, most: int = MOST_ASKED) -> DataFrame:
    """The best-scored pairs of each block, as many as an adjudicator may be asked; a budget, as in the live system."""
    w = Window.partitionBy("block").orderBy(F.desc("score"), F.desc("id_a"), F.desc("id_b"))
    return pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def adjudicated(pairs: DataFrame, judge=None) -> DataFrame:
    """pairs with verdict. judge(list of (name_a, name_b)) -> list of bool, run in batches; without one, or where it
    fails, every verdict is false."""
    if judge is None:
        return pairs.withColumn("verdict", F.lit(False))

    # As a UDF it would keep the rows in a queue until verdicts, which are so small that they pile up in a socket's
    # buffers by the million, have been read; so the rows go along.
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            n = len(rows)
            try:
                said = list(judge(list(zip(rows["name_a"].to_pylist(), rows["name_b"].to_pylist()))))
            except Exception:  # noqa: BLE001 - an unanswered question merges nothing
                said = []
            verdict = pa.array([bool(x) for x in said[:n]] + [False] * (n - len(said)), pa.bool_())
            yield pa.RecordBatch.from_arrays([*rows.columns, verdict], names=[*rows.schema.names, "verdict"])

    return pairs.mapInArrow(ask, types.StructType([*pairs.schema.fields, types.StructField("verdict", types.BooleanType())]))


def survivors(entities: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, survivor) of every entity to be merged: the best connected of its group, then the longest name, then the least id."""
    ids = entities.select("id").distinct()
    linked = pairs.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
    inside = ids.join(linked.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")
    comp = components(inside, linked)
    ranked = comp.join(degree(inside, edges), "id").join(entities.groupBy("id").agg(F.max(F.length("name")).alias("size")), "id")
    best = ranked.groupBy("component").agg(F.min_by("id", F.struct((-F.col("degree")).alias("d"), (-F.col("size")).alias("s"), "id")).alias("survivor"))
    return comp.join(best, "component").where("id <> survivor").select("id", "survivor")


def redirected(edges: DataFrame, renames: DataFrame, keep_loops: bool = True) -> DataFrame:
    """edges with merged ends replaced by their survivor; parallel edges collapse to the best confidence."""
    s = renames.select(F.col("id").alias("src"), F.col("survivor").alias("_s"))
    d = renames.select(F.col("id").alias("dst"), F.col("survivor").alias("_d"))
    moved = edges.join(s, "src", "left").join(d, "dst", "left")
    moved = moved.withColumn("_from", F.coalesce("_s", "src")).withColumn("_to", F.coalesce("_d", "dst"))
    out = moved.groupBy(F.col("_from").alias("src"), "type", F.col("_to").alias("dst")).agg(F.max("confidence").alias("confidence"))
    return out if keep_loops else out.where("src <> dst")


def redirected_mentions(mentions: DataFrame, renames: DataFrame) -> DataFrame:
    """mentions (workspace_id, entity_id, document_id, chunk_id and spans, if there are any) of merged entities as their
    survivor's; mentions of the same chunk become one, with the spans of all."""
    to = renames.select(F.col("id").alias("entity_id"), "survivor")
    moved = mentions.join(to, "entity_id", "left").withColumn("entity_id", F.coalesce("survivor", "entity_id")).drop("survivor")
    key = ["workspace_id", "entity_id", "document_id", "chunk_id"]
    if "spans" not in mentions.columns:
        return moved.select(*key).distinct()
    own = moved.select(*key, F.explode_outer("spans").alias("s"))
    return own.groupBy(*key).agg(F.array_sort(F.collect_set("s")).alias("spans"))


def merge_counts(entities: DataFrame, renames: DataFrame) -> DataFrame:
    """(examined, groups, merged): candidates looked at, groups of two or more found in them, and entities merged away."""
    n = candidates(entities).agg(F.count("*").alias("examined"))
    return n.join(F.broadcast(renames.agg(F.countDistinct("survivor").alias("groups"), F.count("*").alias("merged"))))
