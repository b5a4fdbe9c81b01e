"""From extracted triples to entities, edges and mentions.

Provenance is kept as rows (entity_documents, edge_chunks), not as lists that grow with the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import clean_name, normalize, normalize_type

#: Confidence of extracted and of hand-made edges.
EXTRACTED, MANUAL = 0.9, 1.0
#: Names longer than this are passages, not names.
LONGEST_NAME = 60


def entity_id(workspace: Column, kind: Column, canonical: Column) -> Column:
    return F.concat_ws(":", workspace, kind, canonical)


def plausible(triples: DataFrame) -> DataFrame:
    """What extractors return, with confidences held within 0 and 1 and names of a bearable length."""
    ok = (F.length("subject") <= LONGEST_NAME) & (F.length("object") <= LONGEST_NAME)
    return triples.where(ok).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))


def clean_triples(triples: DataFrame, scope: tuple[str, ...] = ("workspace_id",), keyed: bool = False) -> DataFrame:
    """Triples with clean names of two characters or more, without loops, each once with its best confidence.

    triples: scope columns, seq, subject, predicate, object, confidence and any others. Of equal confidences the least
    seq stays. Names are compared normalised; null names drop their row. With keyed, sn and on hold the normalised names,
    which graph_of_triples() needs again.
    """
    rest = [c for c in triples.columns if c not in ("subject", "object")]
    # exploding one struct keeps filters above from being pushed below, which would evaluate the patterns again and again
    names = F.struct(clean_name(F.col("subject")).alias("subject"), clean_name(F.col("object")).alias("object"))
    named = triples.select(*rest, F.explode(F.array(names)).alias("_n")).select(*rest, "_n.subject", "_n.object")
    named = named.where((F.length("subject") >= 2) & (F.length("object") >= 2)).select(*triples.columns)
    norms = F.struct(normalize(F.col("subject")).alias("_s"), normalize(F.col("predicate")).alias("_p"), normalize(F.col("object")).alias("_o"))
    told = named.select("*", F.explode(F.array(norms)).alias("_k")).select(*named.columns, "_k.*").where("_s <> _o")
    row = F.struct(*[c for c in named.columns if c not in scope])
    best = told.groupBy(*scope, "_s", "_p", "_o").agg(F.max_by(row, F.struct("confidence", (-F.col("seq")).alias("o"))).alias("r"))
    return best.select(*scope, "r.*", *[F.col("_s").alias("sn"), F.col("_o").alias("on")] * keyed)


@dataclass
class GraphTables:
    """What an upsert yields, as DataFrames."""

    entities: DataFrame
    entity_documents: DataFrame
    edges: DataFrame
    edge_chunks: DataFrame
    mentions: DataFrame
    #: (written): the number of triples that survived.
    written: DataFrame


def graph_of_triples(triples: DataFrame) -> GraphTables:
    """Upsert tables of cleaned triples.

    triples: workspace_id, document_id, chunk_id, seq, subject, subject_type, predicate, object, object_type, confidence.
    The first name of an entity stays; an edge keeps its best confidence; rows whose names normalise to nothing vanish.
    sn and on, if there, are subject and object normalised. With subject_span and object_span (struct of start and end) mentions hold the spans of all their triples in order; a
    null span adds nothing.
    """
    for c in ("subject_span", "object_span"):
        if c not in triples.columns:
            triples = triples.withColumn(c, F.lit(None).cast("struct<start:int,end:int>"))
    t = (
        triples.withColumn("st", normalize_type(F.col("subject_type")))
        .withColumn("ot", normalize_type(F.col("object_type")))
        .withColumn("kind", normalize_type(F.col("predicate"), "related_to"))
        .withColumn("sn", F.col("sn") if "sn" in triples.columns else normalize(F.col("subject")))
        .withColumn("on", F.col("on") if "on" in triples.columns else normalize(F.col("object")))
        .where("sn <> '' and on <> ''")
        .withColumn("src", entity_id(F.col("workspace_id"), F.col("st"), F.col("sn")))
        .withColumn("dst", entity_id(F.col("workspace_id"), F.col("ot"), F.col("on")))
    )
    ends = t.select(
        "workspace_id", "document_id", "chunk_id", "seq",
        F.explode(
            F.array(
                F.struct(F.col("src").alias("id"), F.col("subject").alias("name"), F.col("sn").alias("canonical_name"), F.col("st").alias("type"), F.lit(0).alias("side"), F.col("subject_span").alias("span")),
                F.struct(F.col("dst").alias("id"), F.col("object").alias("name"), F.col("on").alias("canonical_name"), F.col("ot").alias("type"), F.lit(1).alias("side"), F.col("object_span").alias("span")),
            )
        ).alias("e"),
    ).select("workspace_id", "document_id", "chunk_id", "seq", "e.*")
    entities = ends.groupBy("workspace_id", "id").agg(
        F.min_by("name", F.struct("seq", "side")).alias("name"),
        F.first("canonical_name").alias("canonical_name"),
        F.first("type").alias("type"),
        F.min_by("document_id", F.struct("seq", "side")).alias("created_from"),
    )
    edges = t.groupBy("workspace_id", "src", F.col("kind").alias("type"), "dst").agg(F.max("confidence").alias("confidence"))
    return GraphTables(
        entities,
        ends.select("workspace_id", F.col("id").alias("entity_id"), "document_id").distinct(),
        edges,
        t.where("chunk_id is not null").select("workspace_id", "src", F.col("kind").alias("type"), "dst", "chunk_id").distinct(),
        ends.where("chunk_id is not null")
        .groupBy("workspace_id", F.col("id").alias("entity_id"), "document_id", "chunk_id")
        .agg(F.array_sort(F.collect_set("span")).alias("spans")),
        t.agg(F.count("*").alias("written")),
    )


def merge_mentions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Mentions of both, one for each entity and chunk, with the spans of all; a null list adds nothing."""
    key = ["workspace_id", "entity_id", "document_id", "chunk_id"]
    both = old.select(*key, "spans").unionByName(new.select(*key, "spans"))
    return both.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))))).alias("spans"))


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of both, one for each (workspace_id, src, type, dst), with the better confidence."""
    return old.unionByName(new).groupBy("workspace_id", "src", "type", "dst").agg(F.max("confidence").alias("confidence"))
