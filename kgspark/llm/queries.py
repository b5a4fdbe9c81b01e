"""The registered queries of this package: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.llm import components, fingerprints, mixing, provenance, sentences, splitting, survivors, tiling
from kgspark.session import table

PATCH_FIELDS = ("name", "type", "color", "notes")
COPIES = dict(key="import_no", scope="workspace_id", fields=("name", "type"), record="record")


def p1_found(spark, d):
    nodes = table(spark, d, "entities").select("entity_no")
    found = components.linked(nodes, components.accepted_links(table(spark, d, "entity_pairs")))
    return found.select(F.col("node").alias("entity_no"), F.col("group").alias("group_no"))


def p1_groups(spark, d):
    nodes = table(spark, d, "entities").select("entity_no")
    found = components.grouped(nodes, components.accepted_links(table(spark, d, "entity_pairs")))
    return found.select(F.col("node").alias("entity_no"), F.col("group").alias("group_no"))


def p2_found(spark, d):
    return fingerprints.copies(table(spark, d, "entity_imports"), **COPIES)


def p2_records(spark, d):
    return fingerprints.collapsed(table(spark, d, "entity_imports"), **COPIES)


def p3_found(spark, d):
    files = provenance.labelled(table(spark, d, "parsed_files"))
    return files.where("label <> 'hand'").select("file_no")


def p3_labels(spark, d):
    return provenance.labelled(table(spark, d, "parsed_files")).withColumn("p_hand", F.round("p_hand", 6))


def p4_found(spark, d):
    votes = survivors.field_votes(table(spark, d, "node_patches"), PATCH_FIELDS)
    return survivors.winners(votes, values=False).where("rivals").select("entity_no", "field_name", "patch_no")


def p4_nodes(spark, d):
    return survivors.golden(table(spark, d, "node_patches"), PATCH_FIELDS)


def p4_voted(spark, d):
    return survivors.golden(table(spark, d, "node_patches"), PATCH_FIELDS, strict=False, half_life_days=180.0, as_of="2026-01-01")


def p5_found(spark, d):
    return splitting.cut_kinds(table(spark, d, "chunks"))


def p5_pieces(spark, d):
    return splitting.document_pieces(table(spark, d, "chunks"))


def p5_checks(spark, d):
    """Where the pieces of each oversized chunk start and end, and whether they keep to limit and overlap."""
    return splitting.piece_checks(splitting.document_pieces(table(spark, d, "chunks")))


def p5_orders(spark, d):
    """The numbers of each document's pieces: as many as there are pieces, without gap or repetition."""
    p = splitting.document_pieces(table(spark, d, "chunks"))
    n = p.groupBy("document_id").agg(F.count("*").alias("pieces"), F.countDistinct("ord").alias("orders"), F.min("ord").alias("least"), F.max("ord").alias("most"))
    return n.select("document_id", (F.col("pieces") == F.col("orders")).alias("single"), "least", (F.col("most") - F.col("least") + 1 == F.col("pieces")).alias("gapless"))


def p6_found(spark, d):
    found = tiling.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.select("doc_id", "item_id")


def p6_coverage(spark, d):
    """Items given away to a half or more, in passages of five words or more, in any order."""
    return tiling.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), least=5, cover=0.5)


def p7_mixture(spark, d):
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark, d):
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_checks(spark, d):
    """Whether each source's part of the mixture is its own, within its cap and within 1 % of the tokens it can have."""
    docs = table(spark, d, "documents")
    return mixing.checked(*mixing.mixture(docs, table(spark, d, "mix_targets")), docs)


def p8_found(spark, d):
    return sentences.sentence_units(table(spark, d, "documents"))


def p8_sentences(spark, d):
    return sentences.sentence_units(table(spark, d, "documents"), texts=True)


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_groups, p2_found, p2_records, p3_found, p3_labels, p4_found, p4_nodes, p4_voted, p5_found, p5_pieces, p5_checks, p5_orders, p6_found, p6_coverage, p7_mixture, p7_shares, p7_checks, p8_found, p8_sentences)
}
