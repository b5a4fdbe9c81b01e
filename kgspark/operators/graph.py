"""Reading and editing the property graph.

entities: workspace_id, id, name, canonical_name, type, documents, color, notes, user_edited, one_liner, importance, ...
edges: workspace_id, src, type, dst, confidence, user_edited, ...; mentions: workspace_id, entity_id, document_id, chunk_id.
Every function returns new DataFrames; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import normalize, normalize_type
from kgspark.operators.triples import MANUAL, entity_id


def with_defaults(entities: DataFrame) -> DataFrame:
    """importance, user_edited and the lists with their defaults in place of nulls."""
    lists = [f.name for f in entities.schema.fields if f.dataType.simpleString() == "array<string>"]
    out = entities.withColumn("importance", F.coalesce("importance", F.lit("supporting")))
    out = out.withColumn("user_edited", F.coalesce("user_edited", F.lit(False)))
    for c in lists:
        out = out.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out


def trusted(edges: DataFrame, least: float) -> DataFrame:
    """Edges of that confidence or made by hand; an unknown confidence is not enough."""
    return edges.where((F.col("confidence") >= least) | (F.col("user_edited") == True))  # noqa: E712


def attached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among nodes (column id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def incident(edges: DataFrame) -> DataFrame:
    """(id, other, type, direction) of each edge from both ends; a loop counts once, as outgoing."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "type", F.lit("out").alias("direction"))
    back = edges.where("src <> dst").select(F.col("dst").alias("id"), F.col("src").alias("other"), "type", F.lit("in").alias("direction"))
    return out.unionByName(back)


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every node; 0 without edges."""
    n = incident(edges).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def one_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct edges with an end among seeds (column id), whatever their direction."""
    s = seeds.select(F.col("id")).distinct()
    from_ = edges.join(s.withColumnRenamed("id", "src"), "src", "left_semi")
    to = edges.join(s.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return from_.unionByName(to).dropDuplicates(["src", "type", "dst"])


def neighbourhood(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id) of the seeds and all nodes next to them."""
    near = one_hop(edges, seeds)
    return seeds.select("id").unionByName(near.select(F.col("src").alias("id"))).unionByName(near.select(F.col("dst").alias("id"))).distinct()


def in_document(entities: DataFrame, document: str | Column | None) -> DataFrame:
    """Entities of a document, and those of none; all of them for no document."""
    if document is None:
        return entities
    d = F.lit(document) if isinstance(document, str) else document
    return entities.where((F.size(F.coalesce("documents", F.array().cast("array<string>"))) == 0) | F.array_contains("documents", d))


def passages(mentions: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Mentions with their chunk's place and document's name, as the panel of a node lists them."""
    c = chunks.select("document_id", "chunk_id", "ord", "page", "char_start", "char_end")
    return mentions.join(c, ["document_id", "chunk_id"]).join(documents.select(F.col("doc_id").alias("document_id"), "filename"), "document_id")


def create_entity(entities: DataFrame, workspace: str, name: str, kind: str, color: str | None, notes: str | None) -> DataFrame:
    """Adds or overwrites one entity by hand: colour and notes replace what is there, and it counts as edited."""
    spark = entities.sparkSession
    row = spark.createDataFrame([(workspace, name, kind, color, notes)], "workspace_id string, name string, type string, color string, notes string")
    row = row.withColumn("canonical_name", normalize(F.col("name"))).withColumn("user_edited", F.lit(True))
    row = row.withColumn("id", entity_id(F.col("workspace_id"), F.col("type"), F.col("canonical_name")))
    old = entities.join(F.broadcast(row.select("id")), "id", "left_anti")
    kept = entities.join(F.broadcast(row.select("id")), "id", "left_semi").limit(1)
    edited = [F.col(f"n.{c}") if c in row.columns else F.col(f"o.{c}") for c in entities.columns]
    made = row.alias("n").join(kept.alias("o"), F.col("n.id") == F.col("o.id"), "left").select(*edited)
    return old.select(*entities.columns).unionByName(made)


def update_entity(entities: DataFrame, id_: str, **changes: str) -> DataFrame:
    """Sets name, type, color or notes of one entity; other and null changes are ignored. The id stays on renaming."""
    changes = {k: v for k, v in changes.items() if k in ("name", "type", "color", "notes") and v is not None}
    hit, out = F.col("id") == id_, entities
    for k, v in changes.items():
        out = out.withColumn(k, F.when(hit, F.lit(v)).otherwise(F.col(k)))
    if "name" in changes:
        out = out.withColumn("canonical_name", F.when(hit, normalize(F.lit(changes["name"]))).otherwise(F.col("canonical_name")))
    return out.withColumn("user_edited", F.when(hit, True).otherwise(F.col("user_edited"))) if changes else entities


def confirm(entities: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks entities (column id) and all their edges as edited."""
    m = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    e = entities.join(m, "id", "left").withColumn("user_edited", F.coalesce("_hit", "user_edited")).drop("_hit")
    s, d = m.select(F.col("id").alias("src"), F.col("_hit").alias("_s")), m.select(F.col("id").alias("dst"), F.col("_hit").alias("_d"))
    r = edges.join(s, "src", "left").join(d, "dst", "left").withColumn("user_edited", F.coalesce("_s", "_d", "user_edited")).drop("_s", "_d")
    return e, r


def delete_entities(entities: DataFrame, edges: DataFrame, mentions: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Removes entities (column id) with all their edges and mentions."""
    gone = ids.select("id").distinct()
    as_ = lambda c: gone.withColumnRenamed("id", c)
    return (
        entities.join(gone, "id", "left_anti"),
        edges.join(as_("src"), "src", "left_anti").join(as_("dst"), "dst", "left_anti"),
        mentions.join(as_("entity_id"), "entity_id", "left_anti"),
    )


def upsert_edge(edges: DataFrame, entities: DataFrame, src: str, kind: str, dst: str, color: str | None = None) -> DataFrame:
    """Adds or confirms one edge by hand; nothing happens unless both ends exist. A loop is allowed."""
    spark = edges.sparkSession
    want = spark.createDataFrame([(src, kind, dst, color)], "src string, type string, dst string, color string").withColumn("type", normalize_type(F.col("type"), "related_to"))
    want = attached(want, entities)
    key = ["src", "type", "dst"]
    hit = edges.join(F.broadcast(want.select(*key)), key, "left_semi")
    rest = edges.join(F.broadcast(want.select(*key)), key, "left_anti")
    new = want.alias("n").join(hit.alias("o"), key, "left")
    cols = {"color": F.col("n.color"), "user_edited": F.lit(True), "confidence": F.coalesce(F.col("o.confidence"), F.lit(MANUAL))}
    made = new.select(*[(F.col(c) if c in key else cols[c] if c in cols else F.col(f"o.{c}")).alias(c) for c in edges.columns])
    return rest.select(*edges.columns).unionByName(made)


def set_edge_color(edges: DataFrame, src: str, kind: str, dst: str, color: str | None) -> DataFrame:
    hit = (F.col("src") == src) & (F.col("type") == kind) & (F.col("dst") == dst)
    return edges.withColumn("color", F.when(hit, F.lit(color)).otherwise(F.col("color")))


def delete_edge(edges: DataFrame, src: str, kind: str, dst: str) -> DataFrame:
    return edges.where(~((F.col("src") == src) & (F.col("type") == kind) & (F.col("dst") == dst)))


def delete_documents(entities: DataFrame, gone: DataFrame) -> DataFrame:
    """Entities without the documents of gone (column document_id): taken off every list, and entities whose list
    becomes empty by that removed. Null and empty lists stay. gone is held by all tasks only while Spark finds it small."""
    keyed = entities.withColumn("_n", F.monotonically_increasing_id())
    listed = keyed.select("_n", F.posexplode("documents").alias("_p", "document_id"))
    hit = listed.join(gone.select("document_id").distinct(), "document_id", "left_semi")
    out = hit.groupBy("_n").agg(F.collect_set("document_id").alias("_gone"))
    kept = keyed.join(out, "_n", "left").withColumn("_left", F.array_except("documents", F.coalesce("_gone", F.array().cast("array<string>"))))
    kept = kept.where(F.col("_gone").isNull() | (F.size("_left") > 0))
    return kept.withColumn("documents", F.when(F.col("_gone").isNull(), F.col("documents")).otherwise(F.col("_left"))).drop("_n", "_gone", "_left")


def delete_document_subgraph(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables of a graph without the documents of gone (workspace_id, document_id).

    tables: documents (doc_id), chunks, mentions, entities and edges; each has workspace_id. Chunks, mentions and the
    documents go; entities lose the documents and go if none is left; edges of entities that went go with them, others
    stay. A workspace's documents are its own: the same number elsewhere is another document."""
    gone = gone.select("workspace_id", F.col("document_id").cast("string").alias("document_id")).distinct()
    named = lambda df, c: df.withColumn("_d", F.col(c).cast("string")).join(gone.withColumnRenamed("document_id", "_d"), ["workspace_id", "_d"], "left_anti").select(*df.columns)
    scope = lambda df: F.concat_ws("\n", "workspace_id", df)
    keyed = tables["entities"].withColumn("_own", F.col("documents")).withColumn("documents", F.transform("documents", lambda x: F.concat_ws("\n", "workspace_id", x)))
    left = delete_documents(keyed, gone.select(scope("document_id").alias("document_id")))
    cut = F.transform("documents", lambda x: F.substring_index(x, "\n", -1))
    left = left.withColumn("documents", F.when(F.size("_own") == F.size("documents"), F.col("_own")).otherwise(cut)).drop("_own")
    dead = tables["entities"].select("workspace_id", "id").join(left.select("workspace_id", "id"), ["workspace_id", "id"], "left_anti").distinct()
    end = lambda c: dead.withColumnRenamed("id", c)
    return {
        "documents": named(tables["documents"], "doc_id"),
        "chunks": named(tables["chunks"], "document_id"),
        "mentions": named(tables["mentions"], "document_id").join(end("entity_id"), ["workspace_id", "entity_id"], "left_anti").select(*tables["mentions"].columns),
        "entities": left.select(*tables["entities"].columns),
        "edges": tables["edges"].join(end("src"), ["workspace_id", "src"], "left_anti").join(end("dst"), ["workspace_id", "dst"], "left_anti").select(*tables["edges"].columns),
    }


def matched(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """wanted (key columns) with matched: whether an edit of these finds any row."""
    hit = rows.select(*key).join(wanted.select(*key), key, "left_semi").distinct().withColumn("_m", F.lit(True))
    return wanted.select(*key).distinct().join(hit, key, "left").select(*key, F.coalesce("_m", F.lit(False)).alias("matched"))


def passages_in_order(entities: DataFrame, mentions: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, filename, document_id, chunk_id, ord, page) of each entity's passages with n, their number by document name
    and ord; an entity without any keeps one row of nulls. One row a passage, so a much mentioned entity is no long list."""
    p = passages(mentions, chunks, documents).select(F.col("entity_id").alias("id"), "filename", "document_id", "chunk_id", "ord", "page").distinct()
    return entities.select("id").distinct().join(p, "id", "left")


def shared_color(entities: DataFrame) -> DataFrame:
    """(color) the one colour of all entities, null if they differ; a missing colour is a value of its own."""
    n = F.countDistinct(F.coalesce("color", F.lit("\0")))
    return entities.agg(F.when(n == 1, F.max("color")).alias("color"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key; new has the same columns, one row a key."""
    return old.join(new.select(*key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def write_chunks(chunks: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """chunks upserted by workspace, document and chunk; chunks of documents the workspace does not have are left out."""
    key = ["workspace_id", "document_id", "chunk_id"]
    known = documents.select("workspace_id", F.col("doc_id").alias("document_id"))
    return upsert(chunks, new.join(known, ["workspace_id", "document_id"], "left_semi"), key)


def merged_entities(entities: DataFrame, renames: DataFrame) -> DataFrame:
    """entities without those merged away; survivors keep their own values and gain the documents of the others.

    renames: id, survivor. Documents are united as rows and put back as a sorted list without repeats."""
    to = entities.join(renames, "id", "left").withColumn("_to", F.coalesce("survivor", "id"))
    docs = to.select("_to", F.explode("documents").alias("d")).distinct().groupBy("_to").agg(F.array_sort(F.collect_list("d")).alias("_docs"))
    touched = renames.select(F.col("survivor").alias("id")).distinct().withColumn("_t", F.lit(True))
    kept = entities.join(renames.select("id"), "id", "left_anti").join(touched, "id", "left").join(docs.withColumnRenamed("_to", "id"), "id", "left")
    return kept.withColumn("documents", F.when(F.col("_t"), F.coalesce("_docs", "documents")).otherwise(F.col("documents"))).drop("_t", "_docs")


def panel_relations(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, direction, type, other, other_name) of the edges of some nodes (column id), as their panel lists them."""
    at = incident(edges).join(ids.select("id").distinct(), "id", "left_semi")
    return at.join(nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other").select("id", "direction", "type", "other", "other_name")


def prerequisites(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, needs): names of what each node must be preceded by. edges: src, dst, prerequisite."""
    e = edges.where("prerequisite").select(F.col("src").alias("id"), F.col("dst"))
    return e.join(nodes.select(F.col("id").alias("dst"), "name"), "dst").select("id", F.col("name").alias("needs")).distinct()


def contrasts_of(contrasts: DataFrame, names: DataFrame) -> DataFrame:
    """(name, dimension, other, value): rows of the contrasts that name some concepts (column name), told apart by value."""
    long = contrasts.select("document_id", "dimension", F.explode("values").alias("other", "value"))
    mine = long.join(names.select(F.col("name").alias("other")).distinct(), "other", "left_semi").select("document_id", "dimension", F.col("other").alias("name"))
    return mine.join(long, ["document_id", "dimension"]).select("name", "dimension", "other", "value")


def headline(documents: DataFrame, selected: str | None) -> DataFrame:
    """(headline): what the selected document, or the only one, teaches; empty otherwise."""
    d = documents.where(F.col("id") == selected) if selected is not None else documents
    return d.agg(F.when(F.count("*") == 1, F.coalesce(F.max("teaches"), F.lit(""))).otherwise(F.lit("")).alias("headline"))


def canvas_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges, prerequisites) as shown below the canvas. edges: prerequisite."""
    e = edges.select(F.lit(0).alias("n"), F.lit(1).alias("e"), F.coalesce("prerequisite", F.lit(False)).cast("int").alias("p"))
    both = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e"), F.lit(0).alias("p")).unionByName(e)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return both.agg(total("n").alias("nodes"), total("e").alias("edges"), total("p").alias("prerequisites"))
