"""The registered queries of the engine's core: name -> (spark, folder) -> DataFrame, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions import text as T
from kgspark.operators import canvas, conceptmap, graph, layout, relational, resolution, retrieval, triples, vectors
from kgspark.plans import extract, pipeline
from kgspark.plans.scratch import Scratch
from kgspark.session import table
from kgspark.sources import files
from kgspark.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that must yield the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- a typed graph over the relational tables


def typed_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """Customers, suppliers, nations, regions and parts with their relations; supplies edges are as sure as they are frequent."""
    t = lambda n: table(spark, d, n)
    node = lambda df, k, n, p, kind: df.select(F.concat(F.lit(p), F.col(k)).alias("id"), F.col(n).alias("name"), F.lit(kind).alias("type"))
    nodes = (
        node(t("customer"), "c_custkey", "c_name", "c:", "organization")
        .unionByName(node(t("supplier"), "s_suppkey", "s_name", "s:", "organization"))
        .unionByName(node(t("nation"), "n_nationkey", "n_name", "n:", "location"))
        .unionByName(node(t("region"), "r_regionkey", "r_name", "r:", "location"))
        .unionByName(node(t("part"), "p_partkey", "p_name", "p:", "product"))
    )
    edge = lambda df, a, p, b, q, kind: df.select(
        F.concat(F.lit(p), F.col(a)).alias("src"), F.lit(kind).alias("type"), F.concat(F.lit(q), F.col(b)).alias("dst"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("boolean").alias("user_edited"),
    )
    sold = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    supplies = sold.select(
        F.concat(F.lit("s:"), "l_suppkey").alias("src"), F.lit("supplies").alias("type"), F.concat(F.lit("p:"), "l_partkey").alias("dst"),
        (F.col("n") / (F.col("n") + 2)).alias("confidence"), F.lit(False).alias("user_edited"),
    )
    edges = (
        edge(t("customer"), "c_custkey", "c:", "c_nationkey", "n:", "located_in")
        .unionByName(edge(t("supplier"), "s_suppkey", "s:", "s_nationkey", "n:", "located_in"))
        .unionByName(edge(t("nation"), "n_nationkey", "n:", "n_regionkey", "r:", "part_of"))
        .unionByName(supplies)
    )
    return nodes, edges


GRAPH = """WITH nodes AS (
  SELECT 'c:' || c_custkey AS id, c_name AS name, 'organization' AS type FROM customer UNION ALL
  SELECT 's:' || s_suppkey, s_name, 'organization' FROM supplier UNION ALL SELECT 'n:' || n_nationkey, n_name, 'location' FROM nation UNION ALL
  SELECT 'r:' || r_regionkey, r_name, 'location' FROM region UNION ALL SELECT 'p:' || p_partkey, p_name, 'product' FROM part),
place AS (SELECT 'c:' || c_custkey AS src, 'located_in' AS type, 'n:' || c_nationkey AS dst FROM customer UNION ALL
  SELECT 's:' || s_suppkey, 'located_in', 'n:' || s_nationkey FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 'part_of', 'r:' || n_regionkey FROM nation),
edges AS (SELECT src, type, dst, CAST(NULL AS double) AS confidence, CAST(NULL AS boolean) AS user_edited FROM place UNION ALL
  SELECT 's:' || l_suppkey, 'supplies', 'p:' || l_partkey, count(*)::double / (count(*) + 2), false FROM lineitem GROUP BY l_suppkey, l_partkey)
"""


def places(edges: DataFrame) -> DataFrame:
    return edges.where("type <> 'supplies'")


# ---------------------------------------------------------------- scalars


@query(
    r"""SELECT entity_no, trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce(name, ''))), '[^\p{L}\p{N}_\s]', ' ', 'g'), '[\s\x{a0}\x{2000}-\x{200a}\x{3000}]+', ' ', 'g')) AS canonical FROM entities"""
)
def normalize_names(spark, d):
    return table(spark, d, "entities").select("entity_no", T.normalize(F.col("name")).alias("canonical"))


_TYPE = r"coalesce(nullif(left(regexp_replace(regexp_replace(lower(trim({})), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), 40), ''), '{}')"


@query(f"SELECT patch_no, entity_no, {_TYPE.format('type', 'concept')} AS kind FROM node_patches")
def normalize_types(spark, d):
    return table(spark, d, "node_patches").select("patch_no", "entity_no", T.normalize_type(F.col("type")).alias("kind"))


_SHAPES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.ENTITY_SHAPES.items()) + "}"
_SPARE = "[" + ", ".join(f"'{x}'" for x in T.SPARE_SHAPES) + "]"


@query(
    f"""WITH k AS (SELECT DISTINCT lower(p_brand) AS kind FROM part UNION SELECT DISTINCT type FROM entities WHERE type IS NOT NULL)
    SELECT kind, coalesce({_SHAPES}[kind], {_SPARE}[(('0x' || substr(sha1(kind), 1, 8))::bigint % {len(T.SPARE_SHAPES)}) + 1]) AS shape FROM k"""
)
def shapes(spark, d):
    kinds = table(spark, d, "part").select(F.lower("p_brand").alias("kind")).unionByName(table(spark, d, "entities").select(F.col("type").alias("kind")))
    return kinds.where("kind is not null").distinct().select("kind", T.shape_for(F.col("kind")).alias("shape"))


@query(
    r"""WITH n AS (SELECT entity_no, trim(regexp_replace(name, '\s+', ' ', 'g')) AS n FROM entities WHERE name IS NOT NULL)
    SELECT entity_no, CASE WHEN length(n) > 46 THEN regexp_replace(CASE WHEN contains(left(n, 46), ' ') THEN regexp_extract(left(n, 46), '^(.*) [^ ]*$', 1) ELSE left(n, 46) END, '[ ,;:\-/]+$', '') ELSE n END AS short
    FROM (SELECT entity_no, CASE WHEN contains(n, '(') AND length(regexp_replace(split_part(n, '(', 1), '^[ \-–—:/,]+|[ \-–—:/,]+$', '', 'g')) >= 3 THEN regexp_replace(split_part(n, '(', 1), '^[ \-–—:/,]+|[ \-–—:/,]+$', '', 'g') ELSE n END AS n FROM n)"""
)
def short_names(spark, d):
    e = table(spark, d, "entities").where("name is not null")
    return e.select("entity_no", T.short_name(F.col("name")).alias("short"))


_TALK = ("hi", "Hello there!", "hey, how are you doing today?", "thanks", "what is Neo4j", "hi what's up", "", "   ", "what's up with batch learning",
         "good morning all", "ok cool", "who wrote it?", "hi hi hi hi hi hi hi hi", "hi hi hi hi hi hi hi hi hi", "graph")
_WORDS = "[" + ", ".join(f"'{w}'" for w in sorted({*T.GREETINGS, *T.FILLER})) + "]"


@query(
    "WITH q AS (SELECT unnest(["
    + ", ".join("'" + q.replace("'", "''") + "'" for q in _TALK)
    + f"""]) AS question UNION ALL SELECT DISTINCT 'hello ' || event_type FROM events UNION ALL SELECT 'hey ' || lower(r_name) FROM region),
    w AS (SELECT question, regexp_extract_all(lower(question), '[a-z0-9]+') AS w FROM q)
    SELECT question, len(w) BETWEEN 1 AND 8 AND len(list_filter(w, lambda x: NOT list_contains({_WORDS}, x))) = 0 AS small_talk FROM w"""
)
def small_talk(spark, d):
    typed = spark.createDataFrame([(q,) for q in _TALK], "question string")
    kinds = table(spark, d, "events").select(F.concat(F.lit("hello "), "event_type").alias("question")).distinct()
    named = table(spark, d, "region").select(F.concat(F.lit("hey "), F.lower("r_name")).alias("question"))
    return typed.unionByName(kinds).unionByName(named).select("question", T.is_small_talk(F.col("question")).alias("small_talk"))


@query(
    r"""WITH f AS (SELECT file_no, regexp_replace(replace(filename, '\', '/'), '^(\./)+', '') AS p FROM parsed_files)
    SELECT file_no, NOT starts_with(p, '/') AND NOT list_contains(string_split(p, '/'), '..') AND NOT list_has_any(string_split(p, '/'), ["""
    + ", ".join(f"'{x}'" for x in files.SKIPPED)
    + r"]) AND list_contains(["
    + ", ".join(f"'{x}'" for x in files.TEXT_SUFFIXES + files.CODE_SUFFIXES)
    + r"], lower(regexp_extract(p, '\.([^./]+)$', 1))) AS kept FROM f"
)
def safe_paths(spark, d):
    p = F.regexp_replace(F.replace("filename", F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    return table(spark, d, "parsed_files").withColumn("p", p).select("file_no", files.safe_path(F.col("p")).alias("kept"))


@query(
    f"""WITH k AS (SELECT DISTINCT lower(p_brand) AS kind FROM part), h AS (SELECT kind, list_reduce(list_prepend(0::hugeint, list_transform(string_split(kind, ''), lambda x: ascii(x)::hugeint)), lambda a, x: (a * 31 + x) % 4294967296) AS h FROM k)
    SELECT kind, {_SPARE}[(h % {len(T.SPARE_SHAPES)} + 1)::int] AS shape FROM h"""
)
def rolling_shapes(spark, d):
    kinds = table(spark, d, "part").select(F.lower("p_brand").alias("kind")).distinct()
    return kinds.select("kind", T.rolling_shape(F.col("kind")).alias("shape"))


@query()
def snippets(spark, d):
    """The sentence around each term in each chunk that mentions it."""
    c = table(spark, d, "chunks").select("workspace_id", "document_id", "chunk_id", "text").distinct()
    m = extract.lexical_mentions(table(spark, d, "chunks"))
    none = F.lit(None).cast("int")
    return m.join(c, ["workspace_id", "document_id", "chunk_id"]).select("document_id", "chunk_id", "term", T.snippet("text", none, none, "term").alias("s")).select("document_id", "chunk_id", "term", "s.*")


# ---------------------------------------------------------------- documents and chunks


@query(
    """SELECT chunk_no, c.text = substr(d.text, char_start + 1, char_end - char_start) AS exact FROM (SELECT DISTINCT chunk_no, document_id, text, char_start, char_end FROM chunks) c JOIN documents d ON d.doc_id = c.document_id"""
)
def chunk_offsets(spark, d):
    c = table(spark, d, "chunks").select("chunk_no", "document_id", "text", "char_start", "char_end").distinct()
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("whole"))
    cut = F.substr("whole", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return c.join(docs, "document_id").select("chunk_no", (F.col("text") == cut).alias("exact"))


@query("WITH s AS (SELECT *, sha256(text) AS sha256 FROM documents) SELECT workspace_id, sha256, min(doc_id) AS doc_id FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.lang = 'en' AND o.workspace_id = s.workspace_id AND o.sha256 = s.sha256) GROUP BY ALL")
def new_documents(spark, d):
    """Uploads against a store that holds the English ones."""
    docs = table(spark, d, "documents").select("workspace_id", "doc_id", F.sha2("text", 256).alias("sha256"))
    have = table(spark, d, "documents").where("lang = 'en'").select("workspace_id", F.sha2("text", 256).alias("sha256")).distinct()
    return files.new_documents(docs, have)


@query("SELECT workspace_id, count(*) AS documents, count(*) > 50 AS over_cap, sum(length(text) // 4)::bigint AS tokens FROM documents GROUP BY 1")
def document_caps(spark, d):
    docs = table(spark, d, "documents").groupBy("workspace_id")
    return docs.agg(F.count("*").alias("documents"), (F.count("*") > 50).alias("over_cap"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))


_LINES = r"""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey),
s AS (SELECT o_custkey::varchar AS document_id, o_orderkey AS page, ['Statement for  ' || c_mktsegment, 'status ' || o_orderstatus, 'note', 'priority', o_orderpriority, 'note', 'total', o_totalprice::bigint::varchar, 'kept', 'Page ' || o_orderkey] AS l FROM o),
lines AS (SELECT document_id, page, unnest(l) AS line, (unnest(range(len(l))) + 0.5) / len(l) AS y FROM s),
k AS (SELECT *, CASE WHEN y <= 0.12 THEN 'top' WHEN y >= 0.88 THEN 'bottom' END AS band, regexp_replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), '\d+', '#', 'g') AS key FROM lines),
p AS (SELECT document_id, count(DISTINCT page) AS pages FROM lines GROUP BY 1 HAVING count(DISTINCT page) >= 3)"""


def page_lines(spark, d) -> DataFrame:
    """A customer's orders as the pages of one document, ten lines a page."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    lit = F.lit
    l = F.array(
        F.concat(lit("Statement for  "), "c_mktsegment"), F.concat(lit("status "), "o_orderstatus"), lit("note"), lit("priority"), F.col("o_orderpriority"), lit("note"),
        lit("total"), F.round("o_totalprice").cast("bigint").cast("string"), lit("kept"), F.concat(lit("Page "), F.col("o_orderkey").cast("string")),
    )
    o = o.select(F.col("o_custkey").cast("string").alias("document_id"), F.col("o_orderkey").alias("page"), F.posexplode(l).alias("i", "line"))
    return o.select("document_id", "page", "line", ((F.col("i") + 0.5) / 10).alias("y"))


@query(
    _LINES
    + """ SELECT document_id, band, key FROM (SELECT DISTINCT document_id, page, band, key FROM k WHERE band IS NOT NULL AND key <> '') JOIN p USING (document_id)
    GROUP BY document_id, band, key, pages HAVING count(*) >= greatest(2, floor(pages * 0.6))"""
)
def furniture_lines(spark, d):
    return layout.furniture(page_lines(spark, d))


@query(
    _LINES
    + """, f AS (SELECT DISTINCT document_id, key FROM (SELECT DISTINCT document_id, page, band, key FROM k WHERE band IS NOT NULL AND key <> '') JOIN p USING (document_id) GROUP BY document_id, band, key, pages HAVING count(*) >= greatest(2, floor(pages * 0.6)))
    SELECT document_id, page, count(*) AS lines_kept FROM k WHERE band IS NULL OR (document_id, key) NOT IN (SELECT (document_id, key) FROM f) GROUP BY ALL"""
)
def body_lines(spark, d):
    return layout.without_furniture(page_lines(spark, d)).groupBy("document_id", "page").agg(F.count("*").alias("lines_kept"))


# ---------------------------------------------------------------- extraction and upsert

_MENTIONS = r"""WITH seen AS (SELECT DISTINCT workspace_id, document_id, chunk_id, unnest(regexp_extract_all(lower(text), '\p{L}[\p{L}\p{M}]{5,}')) AS term FROM chunks),
f AS (SELECT workspace_id, term, count(*) AS df FROM seen GROUP BY ALL HAVING count(*) >= 2),
m AS (SELECT s.*, f.df FROM seen s JOIN f USING (workspace_id, term))"""


def term_rows(spark, d) -> DataFrame:
    """All terms of two chunks or more of a workspace, in all scripts."""
    return extract.lexical_mentions(table(spark, d, "chunks"))


@query(_MENTIONS + " SELECT workspace_id, document_id, chunk_id, term, df FROM m")
def entity_mentions(spark, d):
    return term_rows(spark, d)


@query(
    _MENTIONS
    + """ SELECT a.workspace_id, a.term AS src, b.term AS dst, count(*) AS shared, count(*)::double / least(min(a.df), min(b.df)) AS confidence
    FROM m a JOIN m b ON a.workspace_id = b.workspace_id AND a.document_id = b.document_id AND a.chunk_id = b.chunk_id AND a.term < b.term GROUP BY ALL"""
)
def entity_edges(spark, d):
    return extract.lexical_edges(term_rows(spark, d))


def sale_triples(spark, d) -> DataFrame:
    """supplier supplies part, by name, for every sale."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    sold = table(spark, d, "lineitem").join(s, "l_suppkey").join(p, "l_partkey")
    return sold.select(
        F.col("l_returnflag").alias("document_id"),
        F.lit("w").alias("workspace_id"), F.col("l_linestatus").alias("chunk_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.concat(F.lit("The  "), "s_name").alias("subject"), F.lit("Supplies To").alias("predicate"), F.col("p_name").alias("object"),
        F.lit("Organization").alias("subject_type"), F.lit(None).cast("string").alias("object_type"), F.col("l_discount").alias("confidence"),
    )


@query(
    """WITH t AS (SELECT s_name AS subject, p_name AS object, l_discount AS confidence, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)
    SELECT subject, object, confidence, seq FROM t QUALIFY row_number() OVER (PARTITION BY subject, object ORDER BY confidence DESC, seq) = 1"""
)
def cleaned_triples(spark, d):
    return triples.clean_triples(sale_triples(spark, d)).select("subject", "object", "confidence", "seq")


@query(
    r"""WITH t AS (SELECT lower(s_name) AS s, lower(p_name) AS o, l_discount AS c FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)
    SELECT 'w' AS workspace_id, 'w:organization:the ' || trim(regexp_replace(s, '[^a-z0-9_\s]', ' ', 'g')) AS src, 'supplies_to' AS type, 'w:concept:' || o AS dst, max(c) AS confidence FROM t GROUP BY ALL"""
)
def upserted_edges(spark, d):
    return triples.graph_of_triples(sale_triples(spark, d)).edges


@query(
    r"""WITH t AS (SELECT p_name AS name, l_orderkey * 10 + l_linenumber AS seq, l_returnflag AS doc FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT 'w:concept:' || lower(name) AS id, arg_min(name, seq) AS name, arg_min(doc, seq) AS created_from FROM t GROUP BY lower(name)"""
)
def upserted_entities(spark, d):
    e = triples.graph_of_triples(sale_triples(spark, d)).entities
    return e.where("type = 'concept'").select("id", "name", "created_from")


# ---------------------------------------------------------------- graph reads


@query(
    "SELECT entity_no, coalesce(importance, 'supporting') AS importance, coalesce(user_edited, false) AS user_edited, len(coalesce(documents, [])) AS n_documents, len(coalesce(examples, [])) AS n_examples FROM entities"
)
def graph_nodes(spark, d):
    e = graph.with_defaults(table(spark, d, "entities"))
    return e.select("entity_no", "importance", "user_edited", F.size("documents").cast("bigint").alias("n_documents"), F.size("examples").cast("bigint").alias("n_examples"))


@query(GRAPH + "SELECT src, type, dst, confidence FROM edges WHERE confidence >= 0.4 OR user_edited")
def trusted_edges(spark, d):
    return graph.trusted(typed_graph(spark, d)[1], 0.4).select("src", "type", "dst", "confidence")


@query(GRAPH + ", i AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges WHERE src <> dst) SELECT n.id, (SELECT count(*) FROM i WHERE i.id = n.id) AS degree FROM nodes n")
def degrees(spark, d):
    return graph.degree(*typed_graph(spark, d))


@query(GRAPH + ", s AS (SELECT id FROM nodes WHERE type = 'organization' AND name LIKE 'Supplier%5') SELECT DISTINCT src, type, dst, confidence FROM edges WHERE src IN (SELECT id FROM s) OR dst IN (SELECT id FROM s)")
def one_hop(spark, d):
    nodes, edges = typed_graph(spark, d)
    return graph.one_hop(edges, nodes.where("type = 'organization' and name like 'Supplier%5'")).select("src", "type", "dst", "confidence")


@query("SELECT entity_no FROM entities WHERE len(coalesce(documents, [])) = 0 OR list_contains(documents, '7')")
def document_filter(spark, d):
    return graph.in_document(table(spark, d, "entities"), "7").select("entity_no")


@query(
    _MENTIONS
    + """ SELECT m.workspace_id, m.term, m.document_id, m.chunk_id, c.ord, c.char_start, c.char_end, d.filename FROM m
    JOIN (SELECT DISTINCT document_id, chunk_id, ord, page, char_start, char_end FROM chunks) c USING (document_id, chunk_id) JOIN documents d ON d.doc_id = m.document_id"""
)
def node_passages(spark, d):
    m = term_rows(spark, d)
    c = table(spark, d, "chunks").select("document_id", "chunk_id", "ord", "page", "char_start", "char_end").distinct()
    return graph.passages(m, c, table(spark, d, "documents")).select("workspace_id", "term", "document_id", "chunk_id", "ord", "char_start", "char_end", "filename")


@query("SELECT type, CASE WHEN count(DISTINCT coalesce(color, chr(1))) = 1 THEN max(color) END AS color FROM entities WHERE type = 'person' GROUP BY type")
def shared_colors(spark, d):
    e = table(spark, d, "entities").where("type = 'person'")
    return graph.shared_color(e).select(F.lit("person").alias("type"), "color")


# ---------------------------------------------------------------- edits


@query(
    """WITH g AS (SELECT doc_id::varchar AS x FROM documents WHERE workspace_id = (SELECT min(workspace_id) FROM documents)),
    l AS (SELECT entity_no, unnest(list_distinct(documents)) AS x FROM entities), n AS (SELECT entity_no, count(g.x) AS hit, count(*) - count(g.x) AS n FROM l LEFT JOIN g USING (x) GROUP BY 1)
    SELECT entity_no, CASE WHEN coalesce(hit, 0) > 0 THEN n ELSE coalesce(len(documents), -1) END::bigint AS n_documents FROM entities LEFT JOIN n USING (entity_no) WHERE coalesce(hit, 0) = 0 OR n > 0"""
)
def delete_documents(spark, d):
    docs = table(spark, d, "documents")
    first = docs.agg(F.min("workspace_id").alias("workspace_id"))
    gone = docs.join(F.broadcast(first), "workspace_id", "left_semi").select(F.col("doc_id").cast("string").alias("document_id"))
    e = graph.delete_documents(table(spark, d, "entities"), gone)
    return e.select("entity_no", F.coalesce(F.size("documents"), F.lit(-1)).cast("bigint").alias("n_documents"))


@query(GRAPH + ", s AS (SELECT id FROM nodes WHERE id LIKE 'n:1%') SELECT src, type, dst, coalesce(CASE WHEN src IN (SELECT id FROM s) OR dst IN (SELECT id FROM s) THEN true END, user_edited) AS user_edited FROM edges")
def confirmed_edges(spark, d):
    nodes, edges = typed_graph(spark, d)
    nodes = nodes.withColumn("user_edited", F.lit(False))
    return graph.confirm(nodes, edges, nodes.where("id like 'n:1%'"))[1].select("src", "type", "dst", "user_edited")


@query(GRAPH + ", s AS (SELECT id FROM nodes WHERE type = 'location') SELECT src, type, dst FROM edges WHERE src NOT IN (SELECT id FROM s) AND dst NOT IN (SELECT id FROM s)")
def delete_entities(spark, d):
    nodes, edges = typed_graph(spark, d)
    mentions = nodes.select(F.col("id").alias("entity_id"))
    return graph.delete_entities(nodes, edges, mentions, nodes.where("type = 'location'"))[1].select("src", "type", "dst")


# ---------------------------------------------------------------- resolution


@query(
    GRAPH
    + """, g AS (SELECT id, name, min(id) OVER (PARTITION BY name) AS s FROM nodes WHERE type = 'product')
    SELECT coalesce(a.s, e.src) AS src, e.type, coalesce(b.s, e.dst) AS dst, max(confidence) AS confidence FROM edges e LEFT JOIN g a ON a.id = e.src LEFT JOIN g b ON b.id = e.dst GROUP BY ALL"""
)
def merged_edges(spark, d):
    nodes, edges = typed_graph(spark, d)
    parts = nodes.where("type = 'product'")
    first = parts.groupBy("name").agg(F.min("id").alias("survivor"))
    return resolution.redirected(edges, parts.join(first, "name").select("id", "survivor"))


# ---------------------------------------------------------------- retrieval


@query(
    """WITH q AS (SELECT vec_id AS query, label, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query, vec_id, e.label, round(list_cosine_similarity(embedding::double[], q::double[]), 6) AS cosine, list_cosine_similarity(embedding::double[], q::double[]) AS c FROM embeddings e JOIN q USING (label))
    SELECT query, vec_id, label, cosine, round((1 + c) / 2, 6) AS score, row_number() OVER (PARTITION BY query, label ORDER BY c DESC, vec_id) AS rank FROM s QUALIFY rank <= 8"""
)
def vector_topk(spark, d):
    """Queries are all rows whose id is divisible by 100, against all rows of their label."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label", "embedding")
    return vectors.nearest(q, e, 8, ["label"]).select("query", "vec_id", "label", F.round("cosine", 6).alias("cosine"), F.round(vectors.index_score(F.col("cosine")), 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    _MENTIONS
    + """, c AS (SELECT DISTINCT document_id, chunk_id, ord FROM chunks), h AS (SELECT document_id, chunk_id, ord, count(DISTINCT term) AS hits FROM m JOIN c USING (document_id, chunk_id) GROUP BY ALL)
    SELECT document_id, chunk_id, hits, row_number() OVER (PARTITION BY document_id ORDER BY hits DESC, ord, chunk_id) AS rank FROM h QUALIFY rank <= 8"""
)
def chunk_hits(spark, d):
    m = term_rows(spark, d).select("document_id", "chunk_id", F.col("term").alias("entity_id"))
    links = m.select(F.col("document_id").alias("question_id"), "document_id", F.col("entity_id").alias("id")).distinct()
    c = table(spark, d, "chunks").select("document_id", "chunk_id", "ord").distinct()
    return retrieval.gathered(links, m, c).select("document_id", "chunk_id", "hits", F.col("rank").cast("bigint").alias("rank"))


@query(
    GRAPH
    + """, q AS (SELECT id AS question_id FROM nodes WHERE id LIKE 'n:%'), b AS (SELECT DISTINCT question_id, src, type, dst, confidence FROM q JOIN edges ON src = question_id OR dst = question_id)
    SELECT question_id, src, type, dst, row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC NULLS FIRST, src, type, dst) AS rank FROM b QUALIFY rank <= 25"""
)
def expand_entities(spark, d):
    nodes, edges = typed_graph(spark, d)
    links = nodes.where("id like 'n:%'").select(F.col("id").alias("question_id"), F.lit("d").alias("document_id"), "id")
    allowed = nodes.select(F.lit("d").alias("document_id"), "id")
    return retrieval.expanded(links, edges, allowed).select("question_id", "src", "type", "dst", F.col("rank").cast("bigint").alias("rank"))


@query(
    """WITH e AS (SELECT DISTINCT workspace_id, name, unnest(documents) AS d FROM entities WHERE importance = 'core' AND name IS NOT NULL),
    r AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY workspace_id, d ORDER BY name) <= 4), g AS (SELECT workspace_id, d, list_sort(list(name)) AS n FROM r GROUP BY ALL)
    SELECT doc_id, CASE WHEN len(n) > 1 THEN 'Hello. This document covers ' || lower(left(filename, 1)) || substr(filename, 2) || chr(10) || chr(10) || 'The map has ' || array_to_string(n[1:-2], ', ') || ' and ' || n[-1] || ' on it. Ask how any of them works, what it is good or bad at, or how two of them differ.'
      WHEN len(n) = 1 THEN 'Hello. This document covers ' || lower(left(filename, 1)) || substr(filename, 2) || chr(10) || chr(10) || 'The map has ' || n[1] || ' on it. Ask how any of them works, what it is good or bad at, or how two of them differ.'
      ELSE 'Hello. This document covers ' || lower(left(filename, 1)) || substr(filename, 2) || chr(10) || chr(10) || 'Ask me anything about it.' END AS reply
    FROM documents x LEFT JOIN g ON g.workspace_id = x.workspace_id AND g.d = x.doc_id::varchar"""
)
def orientation_replies(spark, d):
    docs = table(spark, d, "documents")
    c = retrieval.core_concepts(docs, table(spark, d, "entities"))
    return docs.select("doc_id", "filename").join(c, "doc_id").select("doc_id", retrieval.orientation(F.col("filename"), F.col("concepts")).alias("reply"))


_ASPECT = "WITH q AS (SELECT document_id, chunk_no AS key, trim(regexp_replace(left(text, 80), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS q FROM (SELECT DISTINCT chunk_no, document_id, text FROM chunks)), c AS (SELECT DISTINCT document_id, chunk_id, ord, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM chunks)"


@query(
    _ASPECT
    + " SELECT document_id, key, chunk_id, strpos(t, q) - 1 AS start, strpos(t, q) - 1 + length(q) AS \"end\" FROM q JOIN c USING (document_id) WHERE q <> '' AND strpos(t, q) > 0 QUALIFY row_number() OVER (PARTITION BY document_id, key ORDER BY ord, chunk_id) = 1"
)
def ground_quotes(spark, d):
    c = table(spark, d, "chunks").select("chunk_no", "document_id", "chunk_id", "ord", "text").distinct()
    # a quote is an excerpt: here the first eighty characters of each chunk, sought in all chunks of its document
    q = c.select("document_id", F.col("chunk_no").alias("key"), F.left("text", F.lit(80)).alias("quote"))
    g = conceptmap.grounded(q, c.drop("chunk_no").distinct())
    return g.select("document_id", "key", "chunk_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


# ---------------------------------------------------------------- canvas


@query(
    GRAPH
    + """, ids AS (SELECT id FROM nodes WHERE type <> 'product'),
    region_of AS (SELECT 'n:' || n_nationkey AS n, n_regionkey AS r FROM nation),
    home AS (SELECT i.id, CASE WHEN i.id LIKE 'r:%' THEN substr(i.id, 3)::int WHEN i.id LIKE 'n:%' THEN (SELECT r FROM region_of WHERE n = i.id) ELSE (SELECT r FROM place p JOIN region_of ON n = p.dst WHERE p.src = i.id) END AS r FROM ids i)
    SELECT id, min(id) OVER (PARTITION BY r) AS component FROM home"""
)
def connected_components(spark, d):
    nodes, edges = typed_graph(spark, d)
    return canvas.components(nodes.where("type <> 'product'"), places(edges))


@query(GRAPH + "SELECT id, CASE WHEN id LIKE 'r:%' AND id IN (SELECT dst FROM place) THEN 2 WHEN id LIKE 'n:%' AND id IN (SELECT dst FROM place) THEN 1 ELSE 0 END + 0 AS depth FROM nodes WHERE type <> 'product'")
def bfs_levels(spark, d):
    nodes, edges = typed_graph(spark, d)
    return canvas.levels(nodes.where("type <> 'product'"), places(edges))


@query(
    GRAPH
    + """, i AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges WHERE src <> dst), g AS (SELECT n.id, (SELECT count(*) FROM i WHERE i.id = n.id) AS degree FROM nodes n)
    SELECT id, degree, floor(least(54.0::double, 17 + sqrt(degree) * 10.5::double) + 0.5::double)::int AS size, (CASE WHEN degree >= 6 THEN 13 WHEN degree >= 3 THEN 11.5 ELSE 10 END)::double AS label_size FROM g"""
)
def node_sizes(spark, d):
    return canvas.node_sizes(*typed_graph(spark, d))


# ---------------------------------------------------------------- relational

_QUIZ = "WITH a AS (SELECT l_orderkey AS attempt_id, list((l_partkey % 5 - 1)::int ORDER BY l_linenumber, l_partkey % 5, l_suppkey % 4) AS answers, list((l_suppkey % 4)::int ORDER BY l_linenumber, l_partkey % 5, l_suppkey % 4) AS keys FROM lineitem GROUP BY 1)"


def attempts(spark, d) -> DataFrame:
    """Each order as an attempt, its lines as answers; an order has a few lines."""
    row = F.struct("l_linenumber", (F.col("l_partkey") % 5 - 1).cast("int").alias("a"), (F.col("l_suppkey") % 4).cast("int").alias("k"))
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("attempt_id")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return a.select("attempt_id", F.transform("r", lambda x: x["a"]).alias("answers"), F.transform("r", lambda x: x["k"]).alias("keys"))


@query(
    _QUIZ
    + """ SELECT attempt_id, list_sum(list_transform(list_zip(answers, keys), lambda x: (x[1] = x[2])::int))::int AS score, len(keys)::int AS total,
    array_to_string(list_transform(list_zip(answers, keys), lambda x: CASE WHEN x[1] = -1 THEN 'skipped' WHEN x[1] = x[2] THEN 'right' ELSE 'wrong' END), ',') AS review FROM a"""
)
def quiz_scores(spark, d):
    a = attempts(spark, d).where(relational.valid_answers(F.col("answers"), F.col("keys")))
    return a.select("attempt_id", relational.score(F.col("answers"), F.col("keys")).alias("score"), F.size("keys").alias("total"), F.array_join(relational.review(F.col("answers"), F.col("keys")), ",").alias("review"))


@query("SELECT c_custkey AS quiz_id, count(o_orderkey) AS responses FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def quiz_responses(spark, d):
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("quiz_id"))
    return relational.responses(q, table(spark, d, "orders").select(F.col("o_custkey").alias("quiz_id")))


@query(
    """WITH c AS (SELECT DISTINCT document_id, chunk_id, ord, text FROM chunks), n AS (SELECT document_id, count(*) AS n, sum(length(text)) AS total FROM c GROUP BY 1),
    k AS (SELECT *, CASE WHEN total > 24000 THEN greatest(1, floor(n * 24000 / total))::bigint ELSE n END AS keep FROM n),
    r AS (SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY ord, chunk_id) - 1 AS i FROM c)
    SELECT DISTINCT r.document_id, r.chunk_id FROM r JOIN k USING (document_id) WHERE i IN (SELECT floor(m * k.n / k.keep)::bigint FROM range(k.keep) t(m))"""
)
def even_sample(spark, d):
    c = table(spark, d, "chunks").select("document_id", "chunk_id", "ord", "text").distinct()
    return relational.even_sample(c).select("document_id", "chunk_id").distinct()


@query("SELECT user_id, ts::date AS day, count(*) AS calls, count(*) > 200 AS over FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL")
def daily_usage(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "view"))
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), (F.count("*") > 200).alias("over"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    w = ingest.windowed(table(spark, d, "events"), "ts", ["event_type"], "1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 2 HOUR, true)::int AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark, d):
    return ingest.sessions(table(spark, d, "events"), "ts", "user_id", "2 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, arg_max(event_type, ts) AS status, CASE arg_max(event_type, ts) WHEN 'ready' THEN 100 ELSE coalesce(arg_max(value, ts), 0)::double END AS progress FROM events GROUP BY 1")
def job_progress(spark, d):
    now = relational.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "ts", "event_id")
    return now.select("user_id", F.col("event_type").alias("status"), relational.progress(F.col("value"), F.col("event_type")).alias("progress"))


@query(
    """WITH m AS (SELECT unnest(['GET', 'POST', 'PATCH', 'DELETE']) AS method), p AS (SELECT unnest(['/w/chat', '/w/node', '/w/edge']) AS path), r AS (SELECT unnest(['viewer', 'editor', 'none', NULL]) AS role), o AS (SELECT unnest([true, false]) AS owner)
    SELECT role, owner, method, path, CASE WHEN owner THEN 'allow' WHEN NOT coalesce(role IN ('viewer', 'editor'), false) THEN 'not_found' WHEN method = 'GET' OR (method = 'POST' AND path = '/w/chat') OR role = 'editor' THEN 'allow' ELSE 'read_only' END AS verdict FROM r, o, m, p"""
)
def role_access(spark, d):
    rows = [(r, o, m, p) for r in ("viewer", "editor", "none", None) for o in (True, False) for m in ("GET", "POST", "PATCH", "DELETE") for p in ("/w/chat", "/w/node", "/w/edge")]
    df = spark.createDataFrame(rows, "role string, owner boolean, method string, path string")
    return df.withColumn("verdict", relational.access(F.col("role"), F.col("owner"), F.col("method"), F.col("path")))


@query("SELECT to_json({event_id: event_id, user_id: user_id, event_type: event_type}) AS value FROM events")
def event_frames(spark, d):
    return ingest.frames(table(spark, d, "events").select("event_id", "user_id", "event_type"))


# ---------------------------------------------------------------- composites and the rest of the inventory

_URLS = ("https://github.com/a/b", "https://github.com/a/b.git", "http://www.github.com/x.y/z_1/", "https://github.com.evil.io/a/b", "http://localhost/a/b", "https://github.com/a", "ftp://github.com/a/b", "  https://github.com/a/b  ")


@query(
    "WITH u AS (SELECT unnest([" + ", ".join(f"'{u}'" for u in _URLS) + r"""]) AS url), m AS (SELECT url, regexp_extract(trim(url), '^https?://(?:www\.)?github\.com/([A-Za-z0-9_.-]{1,39})/([A-Za-z0-9_.-]{1,100}?)(?:\.git)?/?$', ['owner', 'repo']) AS r FROM u)
    SELECT url, nullif(r.owner, '') AS owner, nullif(r.repo, '') AS repo FROM m"""
)
def github_urls(spark, d):
    u = spark.createDataFrame([(x,) for x in _URLS], "url string").withColumn("r", files.github_repo(F.col("url")))
    return u.select("url", "r.owner", "r.repo")


@query(
    r"""WITH f AS (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY filename, file_no) - 1 AS idx, filename, text FROM parsed_files WHERE repo IS NOT NULL AND text IS NOT NULL)
    SELECT repo, sha256(string_agg('# ' || filename || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY idx)) AS digest FROM f WHERE idx < 2000 GROUP BY repo"""
)
def repository_documents(spark, d):
    from pyspark.sql.window import Window

    f = table(spark, d, "parsed_files").where("repo is not null and text is not null")
    f = f.withColumn("rn", F.row_number().over(Window.partitionBy("repo").orderBy("filename", "file_no"))).where(F.col("rn") <= files.REPO_FILES)
    f = f.withColumn("idx", F.col("rn") - 1)
    r = files.repository_document(f.select("repo", "idx", F.col("filename").alias("path"), "text"), "repo")
    return r.select("repo", F.sha2("text", 256).alias("digest"))


@query(GRAPH + ", i AS (SELECT src AS id, 'out' AS direction, type, dst AS other FROM edges UNION ALL SELECT dst, 'in', type, src FROM edges WHERE src <> dst) SELECT i.id, direction, i.type, other, n.name AS other_name FROM i JOIN nodes n ON n.id = other WHERE i.id LIKE 's:%'")
def panel_relations(spark, d):
    nodes, edges = typed_graph(spark, d)
    return graph.panel_relations(nodes, edges, nodes.where("id like 's:%'"))


@query(GRAPH + "SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, count(*) FILTER (type = 'part_of') AS prerequisites FROM edges")
def canvas_counts(spark, d):
    nodes, edges = typed_graph(spark, d)
    return graph.canvas_counts(nodes, edges.withColumn("prerequisite", F.col("type") == "part_of"))


@query(GRAPH + "SELECT DISTINCT src AS id, n.name AS needs FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.type <> 'supplies'")
def prerequisites(spark, d):
    nodes, edges = typed_graph(spark, d)
    return graph.prerequisites(nodes, edges.withColumn("prerequisite", F.col("type") != "supplies"))


@query(
    """WITH e AS (SELECT entity_no, documents, min(entity_no) OVER (PARTITION BY id) AS s FROM entities WHERE id IS NOT NULL), d AS (SELECT s, list_sort(list_distinct(flatten(list(coalesce(documents, []))))) AS docs, count(*) AS n FROM e GROUP BY s)
    SELECT d.s AS entity_no, CASE WHEN n = 1 THEN e.documents WHEN len(docs) > 0 THEN docs ELSE e.documents END AS documents FROM d JOIN e ON e.entity_no = d.s"""
)
def merged_entities(spark, d):
    """Records that repeat an id are merged into the first of them."""
    e = table(spark, d, "entities").where("id is not null").select(F.col("id").alias("key"), F.col("entity_no").alias("id"), "documents")
    first = e.groupBy("key").agg(F.min("id").alias("survivor"))
    renames = e.join(first, "key").where("id <> survivor").select("id", "survivor")
    return graph.merged_entities(e.drop("key"), renames).select(F.col("id").alias("entity_no"), "documents")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(filename) ELSE filename END AS filename FROM documents")
def upserted_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "filename")
    return graph.upsert(docs, docs.where("doc_id % 2 = 0").withColumn("filename", F.upper("filename")), ["doc_id"])


@query("SELECT chunk_no, CASE WHEN EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.document_id AND d.workspace_id = c.workspace_id AND d.lang = 'en') THEN upper(text) ELSE text END AS text FROM (SELECT DISTINCT chunk_no, workspace_id, document_id, chunk_id, text FROM chunks) c")
def written_chunks(spark, d):
    """Chunks written again in capitals, over those there are; only documents in English are known."""
    c = table(spark, d, "chunks").select("chunk_no", "workspace_id", "document_id", "chunk_id", "text").distinct()
    w = graph.write_chunks(c, c.withColumn("text", F.upper("text")), table(spark, d, "documents").where("lang = 'en'"))
    return w.select("chunk_no", "text")


def corpus(spark, d, scratch: Scratch | None = None) -> pipeline.Corpus:
    return pipeline.build(table(spark, d, "documents").where("workspace_id is not null"), scratch=scratch)


def chat(spark, d) -> DataFrame:
    """Each entity is asked about in its first document, which is also greeted and asked nothing."""
    e = table(spark, d, "entities").where(F.size("documents") > 0).select("entity_no", F.col("documents")[0].alias("document_id"), "name")
    about = F.concat(F.lit("How does "), F.coalesce("name", F.lit("it")), F.lit(" work, and what is it good for?"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), q.alias("q")) for k, q in (("a", about), ("b", F.lit("hi there")), ("c", F.lit(" ")))]))
    return e.select("entity_no", "document_id", kinds.alias("x")).select(F.concat_ws("-", "entity_no", "x.k").alias("question_id"), "document_id", F.col("x.q").alias("question"))


@query()
def retrieved_contexts(spark, d):
    return pipeline.retrieve(corpus(spark, d, Scratch(spark)), chat(spark, d))["context"]


@query()
def answers(spark, d):
    c, q = corpus(spark, d, Scratch(spark)), chat(spark, d)
    o = c.documents.select(F.col("doc_id").cast("string").alias("document_id"), retrieval.orientation(F.col("filename"), F.array().cast("array<string>")).alias("reply"))
    return pipeline.answer(pipeline.retrieve(c, q.where(retrieval.needs_material(F.col("question")))), q, o)


@query()
def resolved_entities(spark, d):
    """Over the edges found in the documents; the first row of each id counts."""
    e = resolution.one_row_each(table(spark, d, "entities").where("id is not null"), "entity_no")
    return pipeline.resolve(e, corpus(spark, d).graph.edges)


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    """Events read as a stream, counted by user and day, and written by micro-batches."""
    scratch = Scratch(spark)
    out = f"{scratch.root}/out"
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    w = ingest.windowed(stream, "ts", ["user_id"], "1 day")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    w.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))

