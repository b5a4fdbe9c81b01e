"""Registered queries of edits, concept maps, limits and access, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions import text as T
from kgspark.operators import canvas, conceptmap, graph, relational, triples, vectors
from kgspark.inventory import _VECTOR, letter_embedder
from kgspark.plans.workspace import Workspace
from kgspark.queries import GRAPH, places, query, sale_triples, typed_graph
from kgspark.session import table
from kgspark.streaming import ingest

# ---------------------------------------------------------------- scans and reads


def first_workspace(spark, d) -> Workspace:
    w = table(spark, d, "entities").agg(F.min("workspace_id")).first()[0]
    return Workspace(spark, d, w)


@query("SELECT entity_no, id, name FROM entities WHERE workspace_id = (SELECT min(workspace_id) FROM entities)")
def workspace_entities(spark, d):
    return first_workspace(spark, d).entities.select("entity_no", "id", "name")


@query("SELECT entity_no, name FROM entities WHERE workspace_id = (SELECT min(workspace_id) FROM entities) AND id = (SELECT min(id) FROM entities WHERE workspace_id = (SELECT min(workspace_id) FROM entities))")
def entity_lookup(spark, d):
    e = first_workspace(spark, d).entities
    return e.where(F.col("id") == e.agg(F.min("id")).first()[0]).select("entity_no", "name")


@query("WITH e AS (SELECT workspace_id, id FROM entities), p AS (SELECT DISTINCT x.workspace_id AS w, x.id AS src, y.id AS dst FROM entity_pairs p JOIN entities x ON x.entity_no = left_no JOIN entities y ON y.entity_no = right_no WHERE x.id IS NOT NULL AND y.id IS NOT NULL) SELECT src, dst FROM p WHERE src IN (SELECT id FROM e WHERE workspace_id = (SELECT min(workspace_id) FROM entities)) AND dst IN (SELECT id FROM e WHERE workspace_id = (SELECT min(workspace_id) FROM entities))")
def scoped_edges(spark, d):
    """Compared pairs as edges, within one workspace."""
    e = table(spark, d, "entities").where("id is not null").select("entity_no", "id", F.col("workspace_id").alias("w"))
    p = table(spark, d, "entity_pairs").select("left_no", "right_no")
    p = p.join(e.select(F.col("entity_no").alias("left_no"), F.col("id").alias("src"), "w"), "left_no").join(e.select(F.col("entity_no").alias("right_no"), F.col("id").alias("dst")), "right_no")
    return graph.attached(p.select("w", "src", "dst").distinct(), first_workspace(spark, d).entities).select("src", "dst")


@query(GRAPH + ", s AS (SELECT id FROM nodes WHERE id LIKE 'n:%') SELECT id FROM s UNION SELECT src FROM edges WHERE dst IN (SELECT id FROM s) UNION SELECT dst FROM edges WHERE src IN (SELECT id FROM s)")
def focus_neighbourhood(spark, d):
    nodes, edges = typed_graph(spark, d)
    return graph.neighbourhood(edges, nodes.where("id like 'n:%'"))


@query("SELECT r_regionkey AS id, r_name AS filename, n_nationkey AS ord FROM region LEFT JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 99, NULL, NULL")
def ordered_passages(spark, d):
    """Nations as passages of their regions; an entity without passages stays."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    e = r.select(F.col("r_regionkey").alias("id")).unionByName(spark.createDataFrame([(99,)], "id int"))
    m = n.select(F.col("n_regionkey").alias("entity_id"), F.col("n_regionkey").alias("document_id"), F.col("n_nationkey").alias("chunk_id"))
    c = n.select(F.col("n_regionkey").alias("document_id"), F.col("n_nationkey").alias("chunk_id"), F.col("n_nationkey").alias("ord"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("char_start"), F.lit(0).alias("char_end"))
    docs = r.select(F.col("r_regionkey").alias("doc_id"), F.col("r_name").alias("filename"))
    return graph.passages_in_order(e, m, c, docs).select("id", "filename", "ord")


@query("SELECT CASE WHEN count(*) = 1 THEN coalesce(max(r_name), '') ELSE '' END AS headline, 'all' AS scope FROM region UNION ALL SELECT max(r_name), 'one' FROM region WHERE r_regionkey = 1")
def headlines(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("teaches"))
    return graph.headline(r, None).withColumn("scope", F.lit("all")).unionByName(graph.headline(r, "1").withColumn("scope", F.lit("one")))


@query("SELECT n_name AS name, r_name AS dimension, other, value FROM (SELECT r.r_name, a.n_name, b.n_name AS other, b.n_nationkey::varchar AS value FROM region r JOIN nation a ON a.n_regionkey = r_regionkey JOIN nation b ON b.n_regionkey = r_regionkey) WHERE n_name LIKE '%1'")
def contrasts(spark, d):
    """A region as a contrast of its nations, by their numbers."""
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("string")))).alias("values"))
    c = n.join(table(spark, d, "region"), "r_regionkey").select(F.lit("d").alias("document_id"), F.col("r_name").alias("dimension"), "values")
    names = table(spark, d, "nation").where("n_name like '%1'").select(F.col("n_name").alias("name"))
    return graph.contrasts_of(c, names)


# ---------------------------------------------------------------- edits


@query("SELECT id, name, type, color, notes, user_edited FROM entities WHERE id IS DISTINCT FROM 'w:concept:new idea' UNION ALL SELECT 'w:concept:new idea', 'New Idea', 'concept', NULL, 'by hand', true")
def created_entity(spark, d):
    e = table(spark, d, "entities").where("id is not null").unionByName(table(spark, d, "entities").where("id is null"))
    return graph.create_entity(e, "w", "New Idea", "concept", None, "by hand").select("id", "name", "type", "color", "notes", "user_edited")


@query("SELECT entity_no, CASE WHEN id = (SELECT min(id) FROM entities) THEN 'Renamed Thing' ELSE name END AS name, CASE WHEN id = (SELECT min(id) FROM entities) THEN 'renamed thing' ELSE canonical_name END AS canonical_name, CASE WHEN id = (SELECT min(id) FROM entities) THEN true ELSE user_edited END AS user_edited FROM entities")
def updated_entity(spark, d):
    e = table(spark, d, "entities")
    out = graph.update_entity(e, e.agg(F.min("id")).first()[0], name="Renamed Thing", importance="core", color=None)
    return out.select("entity_no", "name", "canonical_name", "user_edited")


def colored(edges: DataFrame) -> DataFrame:
    return edges.withColumn("color", F.lit(None).cast("string"))


_KEPT = "(src = 'n:0' AND type = 'part_of' AND dst = (SELECT dst FROM edges WHERE src = 'n:0' AND type = 'part_of'))"


@query(GRAPH + ", e AS (SELECT src, type, dst, confidence, user_edited, NULL::varchar AS color FROM edges) SELECT * FROM e UNION ALL SELECT 'r:0', 'trades_with', 'r:1', 1.0::double, true, '#fff'")
def added_edge(spark, d):
    nodes, edges = typed_graph(spark, d)
    return graph.upsert_edge(colored(edges), nodes, "r:0", "Trades With", "r:1", "#fff")


@query(GRAPH + f" SELECT src, type, dst, CASE WHEN {_KEPT} THEN 1.0::double ELSE confidence END AS confidence, CASE WHEN {_KEPT} THEN true ELSE user_edited END AS user_edited FROM edges")
def confirmed_edge(spark, d):
    """An edge that is there already is confirmed and keeps its confidence, or gets that of a hand-made one."""
    nodes, edges = typed_graph(spark, d)
    region = table(spark, d, "nation").where("n_nationkey = 0").first()["n_regionkey"]
    return graph.upsert_edge(colored(edges), nodes, "n:0", "part_of", f"r:{region}").select("src", "type", "dst", "confidence", "user_edited")


@query(GRAPH + "SELECT src, type, dst FROM edges")
def refused_edge(spark, d):
    """No edge to what is no node."""
    nodes, edges = typed_graph(spark, d)
    return graph.upsert_edge(colored(edges), nodes, "r:0", "trades_with", "r:none").select("src", "type", "dst")


@query(GRAPH + f" SELECT src, type, dst, CASE WHEN {_KEPT} THEN 'red' END AS color FROM edges")
def colored_edge(spark, d):
    region = table(spark, d, "nation").where("n_nationkey = 0").first()["n_regionkey"]
    return graph.set_edge_color(colored(typed_graph(spark, d)[1]), "n:0", "part_of", f"r:{region}", "red").select("src", "type", "dst", "color")


@query(GRAPH + f" SELECT src, type, dst FROM edges WHERE NOT {_KEPT}")
def deleted_edge(spark, d):
    region = table(spark, d, "nation").where("n_nationkey = 0").first()["n_regionkey"]
    return graph.delete_edge(typed_graph(spark, d)[1], "n:0", "part_of", f"r:{region}").select("src", "type", "dst")


@query(GRAPH + "SELECT id, id LIKE 'n:1%' AS user_edited FROM nodes")
def confirmed_entities(spark, d):
    nodes, edges = typed_graph(spark, d)
    nodes = nodes.withColumn("user_edited", F.lit(False))
    return graph.confirm(nodes, edges, nodes.where("id like 'n:1%'"))[0].select("id", "user_edited")


@query(GRAPH + "SELECT id, 'node' AS part FROM nodes WHERE type <> 'location' UNION ALL SELECT id, 'mention' FROM nodes WHERE type <> 'location'")
def deleted_nodes(spark, d):
    nodes, edges = typed_graph(spark, d)
    kept = graph.delete_entities(nodes, edges, nodes.select(F.col("id").alias("entity_id")), nodes.where("type = 'location'"))
    return kept[0].select("id", F.lit("node").alias("part")).unionByName(kept[2].select(F.col("entity_id").alias("id"), F.lit("mention").alias("part")))


@query("SELECT id, id IN (SELECT id FROM entities WHERE id IS NOT NULL) AS matched FROM (SELECT DISTINCT id FROM entities WHERE id IS NOT NULL UNION SELECT 'no such id')")
def matched_edits(spark, d):
    e = table(spark, d, "entities").where("id is not null")
    return graph.matched(e, e.select("id").unionByName(spark.createDataFrame([("no such id",)], "id string")), ["id"])


@query(
    """WITH gone AS (SELECT workspace_id AS w, doc_id::varchar AS x FROM documents WHERE lang = 'de'),
    e AS (SELECT entity_no, workspace_id AS w, id, documents, list_distinct(documents) AS l FROM entities WHERE id IS NOT NULL),
    hit AS (SELECT DISTINCT entity_no FROM (SELECT entity_no, w, unnest(l) AS x FROM e) JOIN gone USING (w, x)),
    n AS (SELECT entity_no, count(*) AS n FROM (SELECT entity_no, w, unnest(l) AS x FROM e) u WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.w = u.w AND g.x = u.x) GROUP BY 1),
    stay AS (SELECT entity_no, w, id, CASE WHEN entity_no IN (SELECT entity_no FROM hit) THEN coalesce(n, 0) ELSE coalesce(len(documents), -1) END AS n FROM e LEFT JOIN n USING (entity_no) WHERE entity_no NOT IN (SELECT entity_no FROM hit) OR n > 0),
    dead AS (SELECT w, id FROM e EXCEPT SELECT w, id FROM stay)
    SELECT 'entity' AS part, entity_no::varchar AS key, n::bigint AS n FROM stay UNION ALL
    SELECT 'document', doc_id::varchar, 0 FROM documents WHERE lang IS DISTINCT FROM 'de' OR workspace_id IS NULL UNION ALL
    SELECT 'chunk', chunk_no::varchar, 0 FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.w = c.workspace_id AND g.x = c.document_id::varchar) UNION ALL
    SELECT 'mention', m.entity_no || '@' || m.x, 0 FROM (SELECT DISTINCT entity_no, w, id, unnest(documents) AS x FROM e) m WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.w = m.w AND g.x = m.x) AND NOT EXISTS (SELECT 1 FROM dead k WHERE k.w = m.w AND k.id = m.id) UNION ALL
    SELECT 'edge', p.pair_no::varchar, 0 FROM entity_pairs p JOIN e a ON a.entity_no = left_no JOIN e b ON b.entity_no = right_no WHERE NOT EXISTS (SELECT 1 FROM dead k WHERE k.w = p.workspace_id AND k.id IN (a.id, b.id))"""
)
def deleted_subgraph(spark, d):
    """All German documents deleted, with everything that hangs on them."""
    docs, e = table(spark, d, "documents"), table(spark, d, "entities").where("id is not null")
    p = table(spark, d, "entity_pairs").join(e.select(F.col("entity_no").alias("left_no"), F.col("id").alias("src")), "left_no").join(e.select(F.col("entity_no").alias("right_no"), F.col("id").alias("dst")), "right_no")
    tables = {
        "documents": docs.select("workspace_id", "doc_id", "lang"),
        "chunks": table(spark, d, "chunks").select("workspace_id", "document_id", "chunk_no"),
        "entities": e.select("workspace_id", "id", "entity_no", "documents"),
        "mentions": e.select("workspace_id", F.col("id").alias("entity_id"), "entity_no", F.explode("documents").alias("document_id")).distinct(),
        "edges": p.select("workspace_id", "src", "dst", "pair_no"),
    }
    left = graph.delete_document_subgraph(tables, docs.where("lang = 'de'").select("workspace_id", F.col("doc_id").alias("document_id")))
    row = lambda part, key, n=F.lit(0): left[part + ("ies" if part == "entit" else "s")].select(F.lit("entity" if part == "entit" else part).alias("part"), key.cast("string").alias("key"), n.cast("bigint").alias("n"))
    return (
        row("entit", F.col("entity_no"), F.coalesce(F.when(F.col("documents").isNotNull(), F.size("documents")), F.lit(-1)))
        .unionByName(row("document", F.col("doc_id"))).unionByName(row("chunk", F.col("chunk_no")))
        .unionByName(row("mention", F.concat_ws("@", "entity_no", "document_id"))).unionByName(row("edge", F.col("pair_no")))
    )


_SPANNED = "WITH t AS (SELECT 'w:concept:' || lower(p_name) AS id, l_returnflag AS document_id, l_linestatus AS chunk_id, ((l_orderkey * 10 + l_linenumber) % 10)::int AS a, ((l_orderkey * 10 + l_linenumber) % 10)::int + round(l_discount * 100)::int AS b FROM lineitem JOIN part ON p_partkey = l_partkey)"


@query(_SPANNED + " SELECT id AS entity_id, document_id, chunk_id, count(DISTINCT (a, b)) AS n, min(a)::int AS first, max({'a': a, 'b': b}).b AS last FROM t GROUP BY ALL")
def mention_spans(spark, d):
    """Places of parts in the lines that sold them: the line's number, and that plus its discount."""
    a = (F.col("seq") % 10).cast("int")
    t = sale_triples(spark, d).withColumn("object_span", F.struct(a.alias("start"), (a + F.round(F.col("confidence") * 100).cast("int")).alias("end")))
    m = triples.graph_of_triples(t).mentions.where("entity_id like 'w:concept:%'")
    both = triples.merge_mentions(m, m.where("chunk_id = 'O'"))
    return both.select("entity_id", "document_id", "chunk_id", F.size("spans").cast("bigint").alias("n"), F.col("spans")[0]["start"].alias("first"), F.element_at("spans", -1)["end"].alias("last"))


@query("SELECT count(*) AS written FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey")
def written_triples(spark, d):
    return triples.graph_of_triples(sale_triples(spark, d)).written


@query(f"SELECT chunk_no, list_transform({_VECTOR.format('left(text, 1200)')}, x -> x::int) AS vector FROM (SELECT DISTINCT chunk_no, text FROM chunks)".replace("x -> x::int", "lambda x: x::int"))
def letter_vectors(spark, d):
    c = vectors.missing(table(spark, d, "chunks").select("chunk_no", "text").distinct().withColumn("embedding", F.lit(None).cast("array<float>")))
    v = vectors.embedded(c, embed=letter_embedder)
    return v.select("chunk_no", F.transform("embedding", lambda x: x.cast("int")).alias("vector"))


@query("WITH x AS (SELECT label, unnest(embedding)::double AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM m GROUP BY 1) SELECT label, list(round(v / n, 6) ORDER BY i) AS vector FROM m JOIN n USING (label) GROUP BY label")
def pooled_labels(spark, d):
    p = vectors.pooled(table(spark, d, "embeddings"), "label")
    return p.select("label", F.transform("embedding", lambda x: F.round(x, 6)).alias("vector"))


# ---------------------------------------------------------------- concept maps

_SHORT = r"CASE WHEN length({0}) > 46 THEN regexp_replace(CASE WHEN contains(left({0}, 46), ' ') THEN regexp_extract(left({0}, 46), '^(.*) [^ ]*$', 1) ELSE left({0}, 46) END, '[ ,;:\-/]+$', '') ELSE {0} END"
_NORM = r"trim(regexp_replace(regexp_replace(lower(strip_accents({})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+', ' ', 'g'))"
_MAPS = rf"""WITH raw AS (SELECT workspace_id AS document_id, entity_no AS seq, trim(regexp_replace(name, '\s+', ' ', 'g')) AS name, coalesce(importance, 'supporting') AS importance, one_liner, coalesce(examples, []) AS examples FROM entities WHERE name IS NOT NULL AND workspace_id IS NOT NULL),
sh AS (SELECT *, {_SHORT.format('name')} AS short FROM raw), c AS (SELECT *, {_NORM.format('short')} AS key FROM sh),
ex AS (SELECT document_id, key, seq, unnest(examples) AS x, generate_subscripts(examples, 1) AS i FROM c), exn AS (SELECT *, {_NORM.format('x')} AS n FROM ex),
exu AS (SELECT document_id, key, count(DISTINCT n) AS weight FROM exn WHERE n <> '' GROUP BY ALL),
g AS (SELECT document_id, key, arg_min(short, seq) AS name, min(seq) AS seq, CASE WHEN bool_or(importance = 'core') THEN 'core' ELSE arg_min(importance, seq) END AS importance, arg_min(nullif(one_liner, ''), seq) FILTER (nullif(one_liner, '') IS NOT NULL) AS one_liner FROM c WHERE key <> '' GROUP BY ALL),
k AS (SELECT g.*, coalesce(weight, 0)::int AS weight, row_number() OVER (PARTITION BY document_id ORDER BY (importance = 'core') DESC, coalesce(weight, 0) DESC, seq) AS rank FROM g LEFT JOIN exu USING (document_id, key)), kept AS (SELECT * FROM k WHERE rank <= 14)"""


def workspace_map(spark, d, **more) -> DataFrame:
    """A workspace's entities as the concepts of one map; each requires what it was compared with."""
    e = table(spark, d, "entities").where("name is not null and workspace_id is not null")
    none = F.array().cast("array<string>")
    fields = {x: none for x in ("requires", *conceptmap.LISTS)} | {"examples": F.col("examples")} | more
    return e.select(F.col("workspace_id").alias("document_id"), F.col("entity_no").alias("seq"), "name", F.coalesce("importance", F.lit("supporting")).alias("importance"), "one_liner", F.lit(None).cast("string").alias("quote"), *[v.alias(k) for k, v in fields.items()])


@query(_MAPS + " SELECT document_id, key, name, importance, one_liner, weight, rank FROM kept")
def folded_concepts(spark, d):
    k = conceptmap.folded(workspace_map(spark, d))
    return k.select("document_id", "key", "name", "importance", "one_liner", "weight", F.col("rank").cast("bigint").alias("rank"))


@query(
    _MAPS
    + """, ask AS (SELECT e.workspace_id AS document_id, a.key, b.key AS need FROM entity_pairs p JOIN entities e ON e.entity_no = left_no JOIN c a ON a.seq = left_no JOIN c b ON b.seq = right_no WHERE a.document_id = b.document_id)
    SELECT DISTINCT k.document_id, k.key, n.key AS need FROM ask JOIN kept k ON k.document_id = ask.document_id AND k.key = ask.key JOIN kept n ON n.document_id = ask.document_id AND n.key = ask.need WHERE k.key <> n.key AND NOT (k.importance = 'core' AND n.importance <> 'core')"""
)
def concept_requirements(spark, d):
    e = table(spark, d, "entities").select(F.col("entity_no").alias("right_no"), "name")
    needs = table(spark, d, "entity_pairs").select("left_no", "right_no").join(e, "right_no").where("name is not null")
    needs = needs.groupBy(F.col("left_no").alias("seq")).agg(F.array_sort(F.collect_set("name")).alias("r"))
    c = workspace_map(spark, d).join(needs, "seq", "left").withColumn("requires", F.coalesce("r", F.array().cast("array<string>"))).drop("r")
    kept = conceptmap.folded(c)
    return conceptmap.requirements(kept).select("document_id", "key", "need")


@query(_MAPS + ", own AS (SELECT k.document_id, k.key AS a, k.name AS source, n.key AS b, n.name AS target, k.rank AS r, n.rank AS s FROM kept k JOIN kept n USING (document_id) WHERE k.key <> n.key) SELECT document_id, source, target, lower('Leads To') AS relation FROM own WHERE s = r + 1")
def tidied_links(spark, d):
    """Each concept leads to the next one, said twice in other letters, beside links that say nothing or lead nowhere."""
    kept = conceptmap.folded(workspace_map(spark, d))
    at = lambda c, r: kept.select("document_id", F.col("name").alias(c), F.col("rank").alias(r))
    pairs = at("source", "r").join(at("target", "s"), "document_id").where("s = r + 1")
    say = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("relation")) for i, w in enumerate((" leads to", "Leads To", "related_to", "Relates to", ""))])
    links = pairs.select("document_id", F.upper("source").alias("source"), "target", "r", F.explode(say).alias("x"))
    links = links.select("document_id", (F.col("r") * 10 + F.col("x.i")).alias("seq"), "source", "target", "x.relation", F.lit(None).cast("string").alias("why"))
    own = links.unionByName(links.withColumn("target", F.col("source"))).unionByName(links.withColumn("target", F.lit("no such concept")))
    return conceptmap.tidy_links(own, kept).select("document_id", "source", "target", F.lower("relation").alias("relation"))


@query(_MAPS + ", t AS (SELECT document_id, importance AS dimension, count(*) AS n, min(name) AS least FROM kept GROUP BY ALL) SELECT document_id, dimension, n::int AS n, least FROM t WHERE n >= 2")
def tidied_contrasts(spark, d):
    """The core concepts of a map against each other, and the others; two are needed."""
    kept = conceptmap.folded(workspace_map(spark, d))
    entry = F.struct(F.upper("name"), F.lit("v"))
    c = kept.groupBy("document_id", F.col("importance").alias("dimension")).agg(F.map_from_entries(F.collect_list(entry)).alias("values"))
    c = c.withColumn("seq", F.when(F.col("dimension") == "core", 1).otherwise(2))
    both = c.unionByName(c.withColumn("dimension", F.lit(" ")))
    out = conceptmap.tidy_contrasts(both, kept)
    return out.select("document_id", "dimension", F.size("values").alias("n"), F.array_min(F.map_keys("values")).alias("least"))


@query(
    GRAPH
    + """, l AS (SELECT 'd' AS document_id, src, type, dst, row_number() OVER (PARTITION BY src, dst ORDER BY type DESC) AS r FROM place WHERE src LIKE 'n:%' UNION ALL SELECT 'd', src, 'lies_in', dst, 2 FROM place WHERE src LIKE 'n:%'),
    n AS (SELECT DISTINCT src, dst FROM place WHERE type = 'part_of' OR src LIKE 's:%')
    SELECT src, type, dst, type = 'part_of' AS prerequisite FROM (SELECT src, type, dst FROM place WHERE src LIKE 'n:%' UNION ALL SELECT src, 'lies_in', dst FROM place WHERE src LIKE 'n:%')
    UNION ALL SELECT src, 'requires', dst, true FROM n WHERE src LIKE 's:%'"""
)
def map_edges(spark, d):
    """Nations' two links, of which the later one is marked, and requirements of suppliers that no link states."""
    e = places(typed_graph(spark, d)[1]).select(F.lit("d").alias("document_id"), "src", "type", "dst", F.lit(None).cast("string").alias("why"))
    own = e.where("src like 'n:%'")
    links = own.withColumn("type", F.lit("lies_in")).withColumn("seq", F.lit(1)).unionByName(own.withColumn("seq", F.lit(2)))
    needs = e.where("type = 'part_of' or src like 's:%'")
    return conceptmap.prerequisite_edges(links, needs).select("src", "type", "dst", "prerequisite")


@query(_MAPS + " SELECT document_id AS workspace_id, document_id || ':concept:' || key AS id, name, importance, one_liner FROM kept")
def map_entities(spark, d):
    return written_map(spark, d).entities.select("workspace_id", "id", "name", "importance", "one_liner")


@query(_MAPS + ", p AS (SELECT document_id, name AS s, lead(name) OVER (PARTITION BY document_id ORDER BY rank) AS t, key, lead(key) OVER (PARTITION BY document_id ORDER BY rank) AS next FROM kept) SELECT document_id || ':concept:' || key AS src, 'Leads To' AS type, document_id || ':concept:' || next AS dst, 0.9::double AS confidence FROM p WHERE next IS NOT NULL")
def map_links(spark, d):
    return written_map(spark, d).edges.select("src", "type", "dst", "confidence")


def written_map(spark, d):
    """Each workspace's map as one document of it, written to the graph."""
    from pyspark.sql.window import Window

    kept = conceptmap.folded(workspace_map(spark, d))
    nxt = F.lead("name").over(Window.partitionBy("document_id").orderBy("rank"))
    links = kept.select("document_id", F.col("rank").alias("seq"), F.col("name").alias("source"), nxt.alias("target"), F.lit("Leads To").alias("relation"), F.lit(None).cast("string").alias("why")).where("target is not null")
    needs = kept.select("document_id", "key", F.col("key").alias("need")).limit(0)
    docs = kept.select("document_id").distinct().select(F.col("document_id").alias("workspace_id"), "document_id", F.lit(1).alias("seq"), F.lit("").alias("teaches"), F.lit(None).cast("string").alias("contrasts"))
    chunks = table(spark, d, "chunks").select(F.col("workspace_id").alias("document_id"), "chunk_id", "ord", "text").limit(0)
    return conceptmap.map_tables(kept, conceptmap.tidy_links(links, kept), needs, docs, chunks)


@query(_MAPS + ", f AS (SELECT document_id, count(*) AS n FROM k WHERE rank <= 28 GROUP BY 1) SELECT f.document_id, CASE WHEN n > 14 THEN 2 ELSE n END AS concepts FROM f")
def consolidated_maps(spark, d):
    """Maps of more than fourteen concepts are brought down to two by a consolidator that joins all others to the second."""
    def join(names):
        return [{"name": names[0], "from": []}, {"name": names[1], "from": list(names[2:]), "importance": "core", "requires": [names[0]]}]

    c = workspace_map(spark, d)
    links = c.select("document_id", F.col("name").alias("source"), F.col("name").alias("target"), F.lit("r").alias("relation"))
    kept, _ = conceptmap.consolidated(c, links, join)
    return kept.groupBy("document_id").agg(F.count("*").alias("concepts"))


# ---------------------------------------------------------------- scalars

_NEXT = ("/w/1", "//evil.io", "https://evil.io", "/a\\b", "", "/", "w/1")


@query("SELECT unnest([" + ", ".join(f"'{x}'" for x in _NEXT) + "]) AS address, starts_with(address, '/') AND NOT starts_with(address, '//') AND NOT contains(address, chr(92)) AS safe UNION ALL SELECT DISTINCT '/' || event_type, true FROM events")
def safe_addresses(spark, d):
    typed = spark.createDataFrame([(x,) for x in _NEXT], "address string")
    kinds = table(spark, d, "events").select(F.concat(F.lit("/"), "event_type").alias("address")).distinct()
    return typed.unionByName(kinds).select("address", relational.safe_next(F.col("address")).alias("safe"))


@query("SELECT c_custkey AS id, CASE WHEN lower(trim(c_mktsegment)) IN ('viewer', 'editor', 'none') THEN lower(trim(c_mktsegment)) END AS as_typed, CASE c_custkey % 3 WHEN 0 THEN 'viewer' WHEN 1 THEN 'editor' ELSE 'none' END AS role, sha256(c_name) AS token FROM customer")
def share_roles(spark, d):
    """Roles as typed in odd letters and blanks, and the hashes of tokens."""
    typed = F.when(F.col("c_custkey") % 3 == 0, " Viewer").when(F.col("c_custkey") % 3 == 1, "EDITOR ").otherwise("None")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), relational.share_role(F.col("c_mktsegment")).alias("as_typed"), relational.share_role(typed).alias("role"), relational.token_hash(F.col("c_name")).alias("token"))


@query("SELECT s.event_id, c_name AS name FROM events s JOIN customer ON c_custkey = user_id WHERE ts + INTERVAL 20 DAY > TIMESTAMP '2024-02-01'")
def session_users(spark, d):
    s = table(spark, d, "events").select("event_id", "user_id", (F.col("ts") + F.expr("INTERVAL 20 DAY")).alias("expires_at"))
    u = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return relational.live_sessions(s, u, F.lit("2024-02-01").cast("timestamp_ntz")).select("event_id", F.col("c_name").alias("name"))


@query("SELECT o_orderkey AS attempt_id, p_name AS title, c_name AS email FROM orders JOIN part ON p_partkey = o_orderkey % 100 JOIN customer ON c_custkey = o_custkey")
def quiz_attempts(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("attempt_id"), (F.col("o_orderkey") % 100).alias("quiz_id"), F.col("o_custkey").alias("user_id"))
    q = table(spark, d, "part").select(F.col("p_partkey").alias("quiz_id"), F.col("p_name").alias("title"))
    u = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    return relational.attempts_of(a, q, u).select("attempt_id", "title", "email")


@query("WITH a AS (SELECT DISTINCT l_suppkey AS quiz_id, o_custkey AS user_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey), x AS (SELECT DISTINCT l_suppkey AS quiz_id, o_custkey AS user_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R') SELECT * FROM a WHERE quiz_id <> user_id AND (quiz_id, user_id) NOT IN (SELECT (quiz_id, user_id) FROM x)")
def new_attempts(spark, d):
    """Customers as users who attempt suppliers' quizzes, once each; returned lines are attempts of before."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    a = table(spark, d, "lineitem").join(o, "l_orderkey").select(F.col("l_suppkey").alias("quiz_id"), "user_id", "l_returnflag")
    quizzes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("quiz_id"), F.col("s_suppkey").alias("owner_id"))
    return relational.new_attempts(a.select("quiz_id", "user_id"), a.where("l_returnflag = 'R'").select("quiz_id", "user_id").distinct(), quizzes)


@query("SELECT p_partkey AS quiz_id, CASE WHEN p_size BETWEEN 0 AND 3 AND length(trim(p_name)) > 0 THEN 1 ELSE 0 END + 1 AS valid, left(p_name, 5) AS title FROM part")
def valid_quizzes(spark, d):
    """Quizzes of four questions: a sound one, one whose answer is the part's size, one without text, one with three options."""
    q = lambda text, n, answer: F.struct(text.alias("question"), F.array(*[F.concat(F.lit(f"o{i} "), "p_brand") for i in range(n)]).alias("options"), answer.cast("int").alias("answer"))
    name, size = F.col("p_name"), F.col("p_size")
    p = table(spark, d, "part").withColumn("q", F.array(q(name, 4, F.lit(3)), q(name, 4, size), q(F.lit("  "), 4, F.lit(1)), q(name, 3, F.lit(1))))
    return p.select(F.col("p_partkey").alias("quiz_id"), F.size(relational.valid_questions(F.col("q"), 10)).alias("valid"), relational.quiz_title(F.col("p_name"), 5).alias("title"))


_SLIDE = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
step(user_id, n, event_id, hits, allowed, wait) AS (SELECT user_id, 0::bigint, NULL::bigint, []::bigint[], NULL::boolean, NULL::bigint FROM (SELECT DISTINCT user_id FROM e) UNION ALL
  SELECT s.user_id, s.n + 1, e.event_id, CASE WHEN len(list_filter(s.hits, lambda h: h >= e.t - {span})) < {limit} THEN list_append(list_filter(s.hits, lambda h: h >= e.t - {span}), e.t) ELSE list_filter(s.hits, lambda h: h >= e.t - {span}) END,
    len(list_filter(s.hits, lambda h: h >= e.t - {span})) < {limit}, CASE WHEN len(list_filter(s.hits, lambda h: h >= e.t - {span})) < {limit} THEN 0 ELSE (list_min(list_filter(s.hits, lambda h: h >= e.t - {span})) - (e.t - {span})) // 1000000 + 1 END
  FROM step s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)"""


@query(_SLIDE.format(span=86_400_000_000, limit=3) + " SELECT user_id, event_id, allowed, wait::int AS retry_after FROM step WHERE n > 0")
def rate_limits(spark, d):
    """Three calls a day; refused ones leave no trace."""
    return ingest.limited_table(table(spark, d, "events"), "user_id", "ts", "event_id", 86_400, 3)


@query(
    " UNION ALL ".join(f"SELECT '{k}' AS rule, * FROM ({_SLIDE.format(span=s * 1_000_000, limit=n)} SELECT event_id, allowed FROM step WHERE n > 0)" for k, (n, s) in relational.LIMITS.items())
)
def limits_in_use(spark, d):
    e, out = table(spark, d, "events"), None
    for rule, (n, seconds) in relational.LIMITS.items():
        one = ingest.limited_table(e, "user_id", "ts", "event_id", seconds, n).select(F.lit(rule).alias("rule"), "event_id", "allowed")
        out = one if out is None else out.unionByName(one)
    return out


@query(_SLIDE.format(span=21_600_000_000, limit=1) + " SELECT s.event_id, NOT allowed AND ts + INTERVAL (value) HOUR > ts AS hit FROM step s JOIN events x ON x.event_id = s.event_id WHERE n > 0")
def cached_sessions(spark, d):
    """Lookups of sessions that are kept six hours, and run out after as many hours as their value says."""
    e = table(spark, d, "events").withColumn("ends", F.col("ts") + F.make_dt_interval(F.lit(0), F.col("value").cast("int")))
    return relational.from_cache(e, "user_id", "ts", "event_id", "ends", 21_600).select("event_id", "hit")


@query("SELECT event_id, CASE WHEN (event_id % 50, user_id + 60) < (3, 9) THEN (event_id % 50) || '-' || (user_id + 60) || ',3-9' ELSE '3-9,' || (event_id % 50) || '-' || (user_id + 60) END AS spans FROM events")
def parsed_spans(spark, d):
    raw = F.array(F.concat_ws("-", (F.col("event_id") % 50).cast("string"), (F.col("user_id") + 60).cast("string")), F.lit("3-9"), F.lit("x-1"), F.lit("7"), F.lit("-4-5"))
    said = F.transform(T.parse_spans(raw), lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return table(spark, d, "events").select("event_id", F.array_join(said, ",").alias("spans"))


@query("SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN w = string_split(p_name, ' ')[1] THEN '<mark>' || w || '</mark>' ELSE w END), ' ') AS marked, replace('depends_on_' || p_type, '_', ' ') AS relation FROM part")
def highlighted_names(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.highlight(F.col("p_name"), F.upper(F.split("p_name", " ")[0])).alias("marked"), T.prettify_relation(F.concat(F.lit("depends_on_"), "p_type")).alias("relation"))


# ---------------------------------------------------------------- canvas

_DEPTHS = """, loose AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst AND dst IN (SELECT id FROM nodes)), d0 AS (SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM loose)),
d1 AS (SELECT DISTINCT dst AS id FROM loose WHERE src IN (SELECT id FROM d0) AND dst NOT IN (SELECT id FROM d0)), d2 AS (SELECT DISTINCT dst AS id FROM loose WHERE src IN (SELECT id FROM d1) AND dst NOT IN (SELECT id FROM d0) AND dst NOT IN (SELECT id FROM d1)),
d3 AS (SELECT DISTINCT dst AS id FROM loose WHERE src IN (SELECT id FROM d2) AND dst NOT IN (SELECT id FROM d0 UNION SELECT id FROM d1 UNION SELECT id FROM d2)),
dep AS (SELECT id, 0 AS depth FROM d0 UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2 UNION ALL SELECT id, 3 FROM d3)"""


@query(GRAPH + _DEPTHS + " SELECT id, depth FROM dep")
def graph_levels(spark, d):
    """Of the whole graph; bfs_levels has the places only, as its SQL does."""
    return canvas.levels(*typed_graph(spark, d))


@query(
    GRAPH
    + _DEPTHS
    + """, inc AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges WHERE src <> dst), deg AS (SELECT id, count(*) AS degree FROM inc GROUP BY 1), n AS (SELECT count(*) AS total, greatest(4, floor(sqrt(count(*)) * 1.6::double + 0.5)::bigint) AS cols FROM nodes),
    spot AS (SELECT dep.id, depth, cols, row_number() OVER (PARTITION BY depth ORDER BY coalesce(degree, 0) DESC, dep.id) - 1 AS i, count(*) OVER (PARTITION BY depth) AS m FROM dep LEFT JOIN deg USING (id), n),
    per AS (SELECT depth, ceil(any_value(m) / any_value(cols)) AS rows FROM spot GROUP BY 1), up AS (SELECT depth, coalesce(sum(rows) OVER (ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, row_number() OVER (ORDER BY depth) - 1 AS gaps FROM per)
    SELECT id, depth, ((i % cols) * 175 - (least(cols, m - (i // cols) * cols) - 1) * 175 / 2)::double AS x, ((above + i // cols) * 125 + gaps * 125 * 0.35)::double AS y FROM spot JOIN up USING (depth)"""
)
def layered_positions(spark, d):
    return canvas.layered(*typed_graph(spark, d))


_HOPS = " ".join(
    f", l{i} AS (SELECT id, min(label) AS label FROM (SELECT id, label FROM l{i - 1} UNION ALL SELECT b.dst, l.label FROM both_ways b JOIN l{i - 1} l ON l.id = b.src) GROUP BY 1)" for i in range(1, 11)
)


@query(GRAPH + ", both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), l0 AS (SELECT id, id AS label FROM nodes)" + _HOPS + " SELECT id, label AS component FROM l10")
def graph_components(spark, d):
    """Of the whole graph; connected_components has the places only, as its SQL does."""
    return canvas.components(*typed_graph(spark, d))


@query(
    """WITH RECURSIVE b AS (SELECT p_brand AS canvas, p_partkey AS box, (p_size * 10)::double AS w, (p_partkey % 7 * 20 + 50)::double AS h FROM part),
    o AS (SELECT *, row_number() OVER (PARTITION BY canvas ORDER BY w * h DESC, box) AS n, greatest(first_value(w) OVER (PARTITION BY canvas ORDER BY w * h DESC, box), sqrt(sum(w * h) OVER (PARTITION BY canvas)) * 1.35::double) AS wide FROM b),
    s(canvas, n, box, w, h, x, y, tall) AS (SELECT canvas, n, box, w, h, 0.0::double, 0.0::double, h FROM o WHERE n = 1 UNION ALL
      SELECT o.canvas, o.n, o.box, o.w, o.h, CASE WHEN s.x + s.w + 80 + o.w > wide THEN 0 ELSE s.x + s.w + 80 END, CASE WHEN s.x + s.w + 80 + o.w > wide THEN s.y + s.tall + 80 ELSE s.y END, CASE WHEN s.x + s.w + 80 + o.w > wide THEN o.h ELSE greatest(s.tall, o.h) END
      FROM s JOIN o ON o.canvas = s.canvas AND o.n = s.n + 1) SELECT canvas, box, w, h, x, y FROM s"""
)
def shelves(spark, d):
    o = table(spark, d, "part").select(F.col("p_brand").alias("canvas"), F.col("p_partkey").alias("box"), (F.col("p_size") * 10).alias("w"), (F.col("p_partkey") % 7 * 20 + 50).alias("h"))
    return canvas.shelf_pack(o)
