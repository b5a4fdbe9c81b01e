"""Registered queries of the operators that no larger query shows on its own, and their SQL for DuckDB."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions import text as T
from kgspark.functions.markdown import markdown
from kgspark.operators import chunking, layout, resolution, retrieval
from kgspark.plans import extract, pipeline
from kgspark.queries import GRAPH, answers, places, query, typed_graph
from kgspark.session import table
from kgspark.sources import files

# ---------------------------------------------------------------- chunks

#: Headings and gaps are marked with signs that no text holds, so that lengths give offsets; then each chunk is one step of a recursion.
CHUNKS = r"""WITH RECURSIVE src AS (SELECT doc_id, coalesce(filename, '') AS source, text, workspace_id FROM documents WHERE text IS NOT NULL),
blocks AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '(?m)^(#{1,6} .*|.+\n[=-]{3,})$', chr(57344) || '\1', 'g'), chr(57344))) AS b, generate_subscripts(string_split(regexp_replace(text, '(?m)^(#{1,6} .*|.+\n[=-]{3,})$', chr(57344) || '\1', 'g'), chr(57344)), 1) AS bi FROM src),
cut AS (SELECT doc_id, bi, string_split(regexp_replace(b, '(\n[ \t]*\n)', chr(57345) || '\1' || chr(57345), 'g'), chr(57345)) AS p FROM blocks),
parts AS (SELECT doc_id, bi, unnest(p) AS x, generate_subscripts(p, 1) AS pi FROM cut),
placed AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY bi, pi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS s FROM parts),
seg AS (SELECT doc_id, list(s ORDER BY s) AS ss, list(s + length(x) ORDER BY s) AS es FROM placed WHERE pi % 2 = 1 AND regexp_matches(x, '[^\s\x0b\x1c-\x1f\x{85}\p{Z}]') GROUP BY doc_id),
step(doc_id, i, s, e) AS (SELECT doc_id, 0::bigint, NULL::bigint, NULL::bigint FROM seg UNION ALL
  SELECT t.doc_id, greatest(i + 1, len(list_filter(es, lambda x: x <= ss[i + 1] + 4000))), ss[i + 1], es[greatest(i + 1, len(list_filter(es, lambda x: x <= ss[i + 1] + 4000)))] FROM step t JOIN seg USING (doc_id) WHERE i < len(ss)),
sliced AS (SELECT doc_id, unnest(range(s, e, 4000)) AS s, e FROM step WHERE s IS NOT NULL),
whole AS (SELECT doc_id, s, least(s + 4000, e) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k FROM sliced),
fold(doc_id, k, head, e, fresh) AS (SELECT doc_id, k, s, e, true FROM whole WHERE k = 1 UNION ALL
  SELECT w.doc_id, w.k, CASE WHEN w.e - w.s < 500 AND w.e - f.head <= 4000 THEN f.head ELSE w.s END, w.e, NOT (w.e - w.s < 500 AND w.e - f.head <= 4000) FROM fold f JOIN whole w ON w.doc_id = f.doc_id AND w.k = f.k + 1),
own AS (SELECT doc_id, head AS s, max(e) AS e FROM fold GROUP BY ALL),
lapped AS (SELECT doc_id, s AS own_s, CASE WHEN lag(s) OVER w IS NULL THEN s ELSE greatest(lag(s) OVER w + 1, s - 600) END AS s, e FROM own WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
shown AS (SELECT doc_id, s, e, substr(text, s + 1, e - s) AS body, CASE WHEN contains(text, chr(12)) THEN length(left(text, s)) - length(replace(left(text, s), chr(12), '')) + 1 END AS page, source, workspace_id FROM lapped JOIN src USING (doc_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS ord FROM shown WHERE regexp_matches(body, '[^\s\x0b\x1c-\x1f\x{85}\p{Z}]')),
chunk AS (SELECT doc_id AS document_id, coalesce(nullif(regexp_replace(regexp_extract(source, '([^/]*)/*$', 1), '^(.+)\.[^.]+$', '\1'), ''), 'chunk') || '-' || lpad(ord::varchar, 4, '0') || '-' || left(sha1(source || ':' || s || ':' || e), 12) AS chunk_id, ord::int AS ord, s::int AS char_start, e::int AS char_end, page::int AS page, body, workspace_id FROM c)"""


@query(CHUNKS + " SELECT document_id, chunk_id, ord, char_start, char_end, page, length(body)::int AS n_chars FROM chunk")
def chunk_documents(spark, d):
    c = chunking.chunks(table(spark, d, "documents"))
    return c.select("document_id", "chunk_id", "ord", "char_start", "char_end", "page", F.length("text").alias("n_chars"))


_TERMS = r""", seen AS (SELECT DISTINCT workspace_id, document_id, chunk_id, unnest(regexp_extract_all(lower({text}), '\p{{L}}[\p{{L}}\p{{M}}]{{5,}}')) AS term FROM {chunks}),
df AS (SELECT workspace_id, term, count(*) AS df FROM seen GROUP BY ALL HAVING count(*) >= 2),
m AS (SELECT s.*, df.df FROM seen s JOIN df USING (workspace_id, term))"""


@query(
    CHUNKS
    + _TERMS.format(text="body", chunks="chunk WHERE workspace_id IS NOT NULL")
    + """, t AS (SELECT workspace_id, term, count(*) AS mentions FROM m GROUP BY ALL),
    pair AS (SELECT DISTINCT a.workspace_id, a.term, b.term AS other FROM m a JOIN m b ON a.workspace_id = b.workspace_id AND a.document_id = b.document_id AND a.chunk_id = b.chunk_id AND a.term <> b.term)
    SELECT t.workspace_id, t.term, t.mentions, coalesce(g.degree, 0) AS degree FROM t LEFT JOIN (SELECT workspace_id, term, count(*) AS degree FROM pair GROUP BY ALL) g USING (workspace_id, term)"""
)
def flagship(spark, d):
    """Chunks of documents, the terms they mention, the graph these span, and each term's degree in its workspace."""
    c = chunking.chunks(table(spark, d, "documents").where("workspace_id is not null"), keep=("workspace_id",))
    return extract.lexical_degrees(extract.lexical_mentions(c))


_SPANS = r""", x AS (SELECT DISTINCT workspace_id, document_id, chunk_id, text FROM chunks),
b AS (SELECT *, list_filter(range(1, length(text) + 1), lambda i: text[i] IN ('.', '!', '?', chr(10))) AS ends FROM x),
f AS (SELECT m.workspace_id, m.document_id, m.chunk_id, m.term, text, ends, length(text) AS n, strpos(lower(text), m.term) - 1 AS pos FROM m JOIN b USING (workspace_id, document_id, chunk_id)),
g AS (SELECT *, coalesce(list_max(list_filter(ends, lambda p: p <= pos)), 0) AS lo, coalesce(list_min(list_filter(ends, lambda p: p > pos + length(term))), n) AS hi FROM f),
h AS (SELECT *, CASE WHEN lo - 220 <= 0 THEN 0 ELSE coalesce(list_min(list_filter(ends, lambda p: p >= lo - 220)), lo - 220) END AS a, coalesce(list_min(list_filter(ends, lambda p: p > least(n, hi + 220))), n) AS z FROM g),
s AS (SELECT *, trim(substr(text, a + 1, z - a), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(8239) || chr(12288)) AS cut FROM h)"""


@query("WITH" + _TERMS.format(text="text", chunks="chunks")[1:] + _SPANS + """ SELECT document_id, chunk_id, term, CASE WHEN pos < 0 THEN text ELSE CASE WHEN a > 0 THEN '… ' ELSE '' END || cut || CASE WHEN z < n THEN ' …' ELSE '' END END AS text, pos >= 0 AND length(cut) < length(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(8239) || chr(12288))) AS trimmed FROM s""")
def snippets(spark, d):
    """The sentence around each term in each chunk that mentions it."""
    c = table(spark, d, "chunks").select("workspace_id", "document_id", "chunk_id", "text").distinct()
    m = extract.lexical_mentions(table(spark, d, "chunks"))
    none = F.lit(None).cast("int")
    return m.join(c, ["workspace_id", "document_id", "chunk_id"]).select("document_id", "chunk_id", "term", T.snippet("text", none, none, "term").alias("s")).select("document_id", "chunk_id", "term", "s.*")


@query(
    r"""WITH RECURSIVE n AS (SELECT file_no::varchar || '/' || filename AS path, text, lower(regexp_extract(filename, '([^.]*)$', 1)) AS suffix, contains(filename, '.') AS dotted FROM parsed_files WHERE text IS NOT NULL AND filename IS NOT NULL UNION ALL
      SELECT file_no::varchar, text, lower(file_no::varchar), false FROM parsed_files WHERE text IS NOT NULL AND filename IS NULL)
    SELECT path, CASE WHEN suffix IN ('md', 'markdown') THEN 'text/markdown' WHEN suffix IN ("""
    + ", ".join(f"'{x}'" for x in files.TEXT_SUFFIXES + files.CODE_SUFFIXES)
    + """) THEN 'text/plain' END AS mime, CASE WHEN mime IS NULL THEN 'unsupported file' END AS error, CASE WHEN mime IS NOT NULL THEN length(text)::int END AS n_chars FROM n"""
)
def file_kinds(spark, d):
    """The kind of each parsed file by its bytes and name."""
    f = table(spark, d, "parsed_files").where("text is not null")
    f = f.select(F.concat_ws("/", F.col("file_no").cast("string"), "filename").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return files.parsed(f.withColumn("length", F.length("content"))).select("path", "mime", "error", F.length("text").alias("n_chars"))


@query(
    r"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])|[^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]+$') AS l FROM documents),
    r AS (SELECT *, list_min(list_filter(range(len(l)), lambda i: i >= floor(len(l) * 0.6::double) AND regexp_matches(l[i + 1], '^\s*(?:\d+[.)]?\s*)?(?i:references?|bibliography|works\s+cited|literature\s+cited)\s*:?\s*$'))) AS cut FROM d)
    SELECT doc_id, sha256(CASE WHEN cut IS NULL THEN text ELSE array_to_string(l[:cut], '') END) AS digest FROM r"""
)
def stripped_references(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(layout.strip_references(F.col("text")), 256).alias("digest"))


@query(
    r"""WITH m AS (SELECT DISTINCT workspace_id, document_id::varchar AS document_id, chunk_id, ord, text FROM chunks),
    p AS (SELECT *, regexp_extract_all(text, '\b([A-Z][a-z]+(?: [A-Z][a-z]+)*) (depends on|is part of|links|holds|left) ([A-Z][a-z]+(?: [A-Z][a-z]+)*)', 1) AS s, regexp_extract_all(text, '\b([A-Z][a-z]+(?: [A-Z][a-z]+)*) (depends on|is part of|links|holds|left) ([A-Z][a-z]+(?: [A-Z][a-z]+)*)', 2) AS v,
      regexp_extract_all(text, '\b([A-Z][a-z]+(?: [A-Z][a-z]+)*) (depends on|is part of|links|holds|left) ([A-Z][a-z]+(?: [A-Z][a-z]+)*)', 3) AS o FROM m)
    SELECT workspace_id, document_id, chunk_id, ord::bigint * 100000 + generate_subscripts(s, 1) - 1 AS seq, unnest(s) AS subject, CASE unnest(v) WHEN 'depends on' THEN 'depends_on' WHEN 'is part of' THEN 'part_of' ELSE 'related_to' END AS predicate, unnest(o) AS object, 0.9::double AS confidence, NULL AS error FROM p"""
)
def pattern_triples(spark, d):
    c = table(spark, d, "chunks").select("workspace_id", "document_id", "chunk_id", "ord", "text").distinct()
    return extract.run(c, "pattern").select("workspace_id", "document_id", "chunk_id", "seq", "subject", "predicate", "object", "confidence", "error")


@query(
    CHUNKS
    + r""", said AS (SELECT DISTINCT document_id::varchar AS d FROM chunk WHERE workspace_id IS NOT NULL AND regexp_matches(left(body, 1200), '[\p{L}\p{N}_]')),
    q AS (SELECT entity_no, documents[1] AS d, unnest(['a', 'b', 'c']) AS k FROM entities WHERE len(documents) > 0)
    SELECT entity_no || '-' || k AS question_id, CASE WHEN k = 'c' THEN 'error' WHEN k = 'b' THEN 'orientation' WHEN d IN (SELECT d FROM said) THEN 'answer' ELSE 'nothing' END AS route FROM q"""
)
def answer_routes(spark, d):
    """What becomes of the questions of `answers`: material is found wherever a document has a chunk with letters."""
    return answers(spark, d).select("question_id", "route")


_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
    f AS (SELECT *, regexp_matches(line, '^{_BLANK}*```') AS fence FROM l), o AS (SELECT *, count_if(fence) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS opened FROM f),
    k AS (SELECT *, CASE WHEN fence THEN CASE WHEN opened THEN 'open' ELSE 'close' END WHEN opened THEN 'pre' WHEN regexp_matches(line, '^{_BLANK}*$') THEN 'blank' WHEN regexp_matches(line, '^#{{1,4}}{_BLANK}+') THEN 'h' || least(6, length(regexp_extract(line, '^(#{{1,4}}){_BLANK}+', 1)) + 3)
      WHEN regexp_matches(line, '^{_BLANK}*[-*+]{_BLANK}+') THEN 'ul' WHEN regexp_matches(line, '^{_BLANK}*\p{{Nd}}+[.)]{_BLANK}+') THEN 'ol' ELSE 'p' END AS kind FROM o),
    g AS (SELECT *, kind = 'p' AND coalesce(lag(kind) OVER w = 'p', false) AS goes_on FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    n AS (SELECT *, (count_if(kind NOT IN ('close', 'pre', 'blank') AND NOT goes_on) OVER (PARTITION BY doc_id ORDER BY i) - 1)::int AS block FROM g),
    c AS (SELECT *, CASE WHEN kind LIKE 'h%' THEN regexp_replace(line, '^#{{1,4}}{_BLANK}+', '') WHEN kind = 'ul' THEN regexp_replace(line, '^{_BLANK}*[-*+]{_BLANK}+', '') WHEN kind = 'ol' THEN regexp_replace(line, '^{_BLANK}*\p{{Nd}}+[.)]{_BLANK}+', '') ELSE line END AS said FROM n WHERE kind NOT IN ('open', 'close', 'blank')),
    p AS (SELECT *, string_split(regexp_replace(said, '(`[^`]+`|\*\*[^*]+\*\*|__[^_]+__|\*[^*]+\*|_[^_]+_)', chr(57344) || '\1' || chr(57344), 'g'), chr(57344)) AS parts FROM c WHERE kind <> 'pre'),
    t AS (SELECT doc_id, block, kind, unnest(parts) AS x, generate_subscripts(parts, 1) AS j FROM p)
    SELECT doc_id, block, kind, 'text' AS tag, line AS text FROM c WHERE kind = 'pre' UNION ALL SELECT doc_id, block, kind, 'text', ' ' FROM c WHERE goes_on UNION ALL
    SELECT doc_id, block, kind, 'text', x FROM t WHERE j % 2 = 1 AND x <> '' UNION ALL
    SELECT doc_id, block, kind, CASE WHEN starts_with(x, '`') THEN 'code' WHEN starts_with(x, '**') OR starts_with(x, '__') THEN 'strong' ELSE 'em' END, CASE WHEN starts_with(x, '**') OR starts_with(x, '__') THEN substr(x, 3, length(x) - 4) ELSE substr(x, 2, length(x) - 2) END FROM t WHERE j % 2 = 0"""
)
def markdown_blocks(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.explode(markdown(F.col("text"))).alias("b")).select("doc_id", "b.*")


# ---------------------------------------------------------------- similarity

#: Longest common subsequences of pairs (x, y, a, b), a bit for each character of a, one character of b a step.
LCS = """, mask AS (SELECT x, y, a, b, (1::hugeint << length(a)) - 1 AS ones FROM pair WHERE length(a) BETWEEN 1 AND 120),
run(x, y, a, b, f, i, s) AS (SELECT x, y, a, b, ones, 1, ones FROM mask UNION ALL
  SELECT x, y, a, b, f, i + 1, ((s + u) & f) | (s - u) FROM (SELECT *, s & coalesce(list_sum(list_transform(range(length(a)), lambda k: CASE WHEN a[k + 1] = b[i] THEN 1::hugeint << k ELSE 0 END)), 0)::hugeint AS u FROM run WHERE i <= length(b))),
lcs AS (SELECT x, y, a, b, length(a) - bit_count(s) AS l FROM run WHERE i = length(b) + 1)"""


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT concat_ws('|', workspace_id, coalesce(type, 'concept')) AS block, id, canonical_name AS n FROM entities WHERE NOT coalesce(user_edited, false) AND canonical_name <> ''),
    near AS (SELECT a.id AS x, b.id AS y, a.n AS a, b.n AS b FROM e a JOIN e b ON a.block = b.block AND a.id < b.id WHERE a.n = b.n OR (length(a.n) >= 5 AND length(b.n) >= 5 AND levenshtein(a.n, b.n) <= 0.12 * (length(a.n) + length(b.n)))),
    pair AS (SELECT DISTINCT x, y, a, b FROM near WHERE a <> b)"""
    + LCS
    + " SELECT DISTINCT x AS id_a, y AS id_b FROM near WHERE a = b UNION SELECT x, y FROM lcs WHERE 200.0 * l / (length(a) + length(b)) >= 88"
)
def string_pairs(spark, d):
    return resolution.string_pairs(table(spark, d, "entities"))


@query(
    "WITH RECURSIVE pair AS (SELECT p_partkey AS x, 0 AS y, p_name AS a, lower(p_brand || ' ' || p_type) AS b FROM part)"
    + LCS
    + " SELECT x AS part, round(200.0 * l / (length(a) + length(b)), 6) AS ratio FROM lcs"
)
def name_ratios(spark, d):
    other = F.lower(F.concat_ws(" ", "p_brand", "p_type"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.round(T.ratio(F.col("p_name"), other), 6).alias("ratio"))


@query(
    """WITH RECURSIVE own AS (SELECT p_partkey, p_name, lower(p_brand || ' ' || p_type || ' ' || p_name[2:]) AS other FROM part),
    sides AS (SELECT p_partkey, CASE WHEN length(p_name) <= length(other) THEN p_name ELSE other END AS a, CASE WHEN length(p_name) <= length(other) THEN other ELSE p_name END AS t FROM own),
    pair AS (SELECT p_partkey AS x, unnest(range(1 - length(a), length(t))) AS y, a, substr(t, greatest(0, y) + 1, y + length(a) - greatest(0, y)) AS b FROM sides)"""
    + LCS
    + " SELECT x AS part, round(max(200.0 * l / (length(a) + length(b))), 6) AS ratio FROM lcs GROUP BY x"
)
def name_partial_ratios(spark, d):
    other = F.lower(F.concat_ws(" ", "p_brand", "p_type", F.substr("p_name", F.lit(2))))
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.round(T.partial_ratio(F.col("p_name"), other), 6).alias("ratio"))


def named_parts(spark, d) -> DataFrame:
    """Part names, and their initials as other names, in one block for each brand."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("block"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    short = p.select("block", F.concat(F.lit("s"), "id").alias("id"), F.concat(F.upper(F.regexp_replace("name", r"(\w)\w*\s*", "$1")), F.when(F.col("id").cast("int") % 2 == 0, "s").otherwise("")).alias("name"))
    return p.unionByName(short)


@query(
    r"""WITH p AS (SELECT p_brand AS block, p_partkey::varchar AS id, p_name AS name, lower(p_name) AS n FROM part UNION ALL
      SELECT p_brand, 's' || p_partkey, upper(regexp_replace(p_name, '(\w)\w*\s*', '\1', 'g')) || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END, lower(upper(regexp_replace(p_name, '(\w)\w*\s*', '\1', 'g')) || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END) FROM part),
    l AS (SELECT *, CASE WHEN contains(n, ' ') THEN array_to_string(list_transform(string_split(n, ' '), lambda w: w[1]), '') END AS initials FROM p),
    k AS (SELECT DISTINCT block, id, name, unnest([replace(n, ' ', ''), regexp_replace(replace(n, ' ', ''), 's+$', '')]) AS key FROM p)
    SELECT DISTINCT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM k a JOIN l b ON a.block = b.block AND a.key = b.initials AND a.id <> b.id WHERE length(a.key) BETWEEN 2 AND 6"""
)
def acronym_pairs(spark, d):
    return resolution.acronym_ids(named_parts(spark, d))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_embedder(texts: list[str]) -> np.ndarray:
    """How often each small letter occurs; an embedder whose vectors SQL can make, too."""
    return np.array([[t.count(c) for c in _LETTERS] for t in texts], np.float32).reshape(len(texts), len(_LETTERS))


_VECTOR = "list_transform(string_split('" + _LETTERS + "', ''), lambda c: (length({0}) - length(replace({0}, c, '')))::double)"
_NEAR = f"""WITH n AS (SELECT DISTINCT concat_ws('|', workspace_id, coalesce(type, 'concept')) AS block, id, name FROM entities WHERE NOT coalesce(user_edited, false) AND name <> '' AND id IS NOT NULL),
v AS (SELECT *, {_VECTOR.format("left(name, 1200)")} AS v FROM n),
p AS (SELECT a.block, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b, CASE WHEN a.id < b.id THEN a.name ELSE b.name END AS name_a, CASE WHEN a.id < b.id THEN b.name ELSE a.name END AS name_b, list_cosine_similarity(a.v, b.v) AS c
  FROM v a JOIN v b ON a.block = b.block AND (a.id < b.id OR (a.id = b.id AND a.name < b.name)) WHERE list_sum(a.v) > 0 AND list_sum(b.v) > 0),
s AS (SELECT * FROM p WHERE c >= 0.55 + 1e-9)"""


NEAR = resolution.EMBED_ASK + 1e-9  # clear of a line on which cosines of whole numbers fall


def named_entities(spark, d) -> DataFrame:
    e = table(spark, d, "entities").where("id is not null")
    return resolution.candidates(e).where("name <> ''").select("block", "id", "name").distinct()


@query(_NEAR + " SELECT id_a, id_b, least(name_a, name_b) AS name_low, greatest(name_a, name_b) AS name_high, round(c, 6) AS score, CASE WHEN c >= 0.9 THEN 'merge' ELSE 'ask' END AS tier FROM s WHERE abs(c - 0.9) > 1e-9")
def near_names(spark, d):
    """Pairs of the vector tiers; those within rounding of the line between them are left aside on both sides."""
    return resolution.tiered_pairs(named_entities(spark, d), letter_embedder, NEAR)


@query(_NEAR + ", q AS (SELECT block, id_a, id_b, max(round(c, 6)) AS score FROM s WHERE id_a <> id_b GROUP BY ALL) SELECT block, id_a, id_b, score FROM q WHERE score < 0.9 QUALIFY row_number() OVER (PARTITION BY block ORDER BY score DESC, id_a DESC, id_b DESC) <= 200")
def asked_pairs(spark, d):
    """The pairs of each block that an adjudicator would be asked about, within its budget."""
    return resolution.best_pairs(named_entities(spark, d), letter_embedder, NEAR)


@query(
    _NEAR
    + """, q AS (SELECT id_a, id_b, max(name_a) AS name_a, max(name_b) AS name_b FROM s WHERE id_a <> id_b AND c < 0.899 GROUP BY ALL)
    SELECT id_a, id_b, left(name_a, 1) = left(name_b, 1) AS verdict FROM q"""
)
def adjudicated_pairs(spark, d):
    """Verdicts of a judge that goes by first letters."""
    p = resolution.named_pairs(named_entities(spark, d), letter_embedder, NEAR, 0.899)
    return resolution.adjudicated(p, lambda pairs: [a[:1] == b[:1] for a, b in pairs]).select("id_a", "id_b", "verdict")


_VERDICTS = """link AS (SELECT DISTINCT left_no AS a, right_no AS b FROM entity_pairs WHERE verdict AND left_no <> right_no AND left_no IN (SELECT entity_no FROM entities) AND right_no IN (SELECT entity_no FROM entities)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link), reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
grp AS (SELECT a AS id, least(a, min(b)) AS g FROM reach GROUP BY a)"""
_RENAMES = f"""WITH RECURSIVE {_VERDICTS},
pairs AS (SELECT left_no AS src, right_no AS dst FROM entity_pairs), inc AS (SELECT src AS id FROM pairs UNION ALL SELECT dst FROM pairs WHERE src <> dst),
rk AS (SELECT grp.*, (SELECT count(*) FROM inc WHERE inc.id = grp.id) AS degree, length(name) AS size FROM grp JOIN entities ON entity_no = grp.id),
best AS (SELECT *, first_value(id) OVER (PARTITION BY g ORDER BY degree DESC, size DESC NULLS FIRST, id) AS survivor FROM rk), ren AS (SELECT id, survivor FROM best WHERE id <> survivor)"""


def verdict_renames(spark, d) -> DataFrame:
    """Entities by number, merged as the accepted pairs say; every pair counts as an edge."""
    e = table(spark, d, "entities").select(F.col("entity_no").alias("id"), "name")
    p = table(spark, d, "entity_pairs")
    edges = p.select(F.col("left_no").alias("src"), F.lit("pair").alias("type"), F.col("right_no").alias("dst"))
    return resolution.survivors(e, edges, p.where("verdict").select(F.col("left_no").alias("id_a"), F.col("right_no").alias("id_b")))


@query(_RENAMES + " SELECT id, survivor FROM ren")
def merge_survivors(spark, d):
    return verdict_renames(spark, d)


@query(_RENAMES + ", c AS (SELECT count(*) AS examined FROM entities WHERE NOT coalesce(user_edited, false)) SELECT examined, (SELECT count(DISTINCT survivor) FROM ren) AS groups, (SELECT count(*) FROM ren) AS merged FROM c")
def resolution_counts(spark, d):
    return resolution.merge_counts(table(spark, d, "entities"), verdict_renames(spark, d))


@query(
    _RENAMES
    + """, mention AS (SELECT workspace_id, entity_no AS e, unnest(documents) AS document_id FROM entities)
    SELECT DISTINCT workspace_id, coalesce(survivor, e) AS entity_id, document_id FROM mention LEFT JOIN ren ON ren.id = e"""
)
def redirected_mentions(spark, d):
    m = table(spark, d, "entities").select("workspace_id", F.col("entity_no").alias("entity_id"), F.explode("documents").alias("document_id"), F.lit("c").alias("chunk_id"))
    return resolution.redirected_mentions(m, verdict_renames(spark, d)).select("workspace_id", "entity_id", "document_id")


_SAME = """WITH RECURSIVE own AS (SELECT id, workspace_id, coalesce(type, 'concept') AS type, name, canonical_name, bool_or(coalesce(user_edited, false)) OVER (PARTITION BY id) AS edited, row_number() OVER (PARTITION BY id ORDER BY entity_no) AS r FROM entities WHERE id IS NOT NULL),
one AS (SELECT *, concat_ws('|', workspace_id, type) AS block FROM own WHERE r = 1), cand AS (SELECT * FROM one WHERE NOT edited),
near AS (SELECT a.id AS x, b.id AS y, a.canonical_name AS a, b.canonical_name AS b FROM cand a JOIN cand b ON a.block = b.block AND a.id < b.id WHERE a.canonical_name <> '' AND b.canonical_name <> '' AND (a.canonical_name = b.canonical_name OR (length(a.canonical_name) >= 5 AND length(b.canonical_name) >= 5 AND levenshtein(a.canonical_name, b.canonical_name) <= 0.12 * (length(a.canonical_name) + length(b.canonical_name))))),
pair AS (SELECT DISTINCT x, y, a, b FROM near WHERE a <> b)""" + LCS + f""",
v AS (SELECT block, id, name, {_VECTOR.format("left(name, 1200)")} AS v FROM cand WHERE name <> ''),
same AS (SELECT x, y FROM near WHERE a = b UNION SELECT x, y FROM lcs WHERE 200.0 * l / (length(a) + length(b)) >= 88 UNION SELECT a.id, b.id FROM v a JOIN v b ON a.block = b.block AND a.id < b.id WHERE list_sum(a.v) > 0 AND list_sum(b.v) > 0 AND list_cosine_similarity(a.v, b.v) >= 0.9),
ways AS (SELECT x, y FROM same UNION SELECT y, x FROM same), reach(x, y) AS (SELECT x, y FROM ways UNION SELECT r.x, w.y FROM reach r JOIN ways w ON w.x = r.y), grp AS (SELECT x AS id, least(x, min(y)) AS g FROM reach GROUP BY x),
rel AS (SELECT DISTINCT x.id AS src, y.id AS dst FROM entity_pairs p JOIN entities x ON x.entity_no = left_no JOIN entities y ON y.entity_no = right_no WHERE x.id IS NOT NULL AND y.id IS NOT NULL),
inc AS (SELECT src AS id FROM rel UNION ALL SELECT dst FROM rel WHERE src <> dst), deg AS (SELECT id, count(*) AS degree FROM inc GROUP BY 1),
best AS (SELECT grp.id, first_value(grp.id) OVER (PARTITION BY g ORDER BY coalesce(degree, 0) DESC, length(name) DESC NULLS FIRST, grp.id) AS survivor FROM grp JOIN one USING (id) LEFT JOIN deg ON deg.id = grp.id)"""


@query(_SAME + " SELECT id, survivor FROM best WHERE id <> survivor")
def resolved_by_letters(spark, d):
    """Resolution as a whole with an embedder of letters and without a judge, over compared pairs as edges."""
    e = resolution.one_row_each(table(spark, d, "entities").where("id is not null"), "entity_no")
    n = table(spark, d, "entities").where("id is not null").select("entity_no", "id")
    p = table(spark, d, "entity_pairs").select(F.col("left_no"), F.col("right_no"))
    edges = p.join(n.select(F.col("entity_no").alias("left_no"), F.col("id").alias("src")), "left_no").join(n.select(F.col("entity_no").alias("right_no"), F.col("id").alias("dst")), "right_no")
    edges = edges.select("src", F.lit("pair").alias("type"), "dst").distinct()
    return pipeline.resolve(e, edges, None, letter_embedder)


# ---------------------------------------------------------------- retrieval


_BARE = r"trim(regexp_replace(regexp_replace(lower(strip_accents({})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+', ' ', 'g'))"
_QUESTIONS = f"""WITH RECURSIVE k AS (SELECT entity_no AS question_id, documents[1] AS document_id, {_BARE.format("'How does ' || coalesce(name, '') || ' differ from ' || coalesce(one_liner, notes, '') || '?'")} AS q FROM entities WHERE len(documents) > 0),
    n AS (SELECT DISTINCT d AS document_id, e.entity_no AS id, e.name, {_BARE.format('e.name')} AS n FROM (SELECT *, unnest(documents) AS d FROM entities) e WHERE e.name IS NOT NULL),
    met AS (SELECT question_id, id, name, q, n FROM n JOIN k USING (document_id) WHERE n <> '' AND (length(n) > 3 OR list_contains(string_split(q, ' '), n)))"""


def entity_questions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Each entity asked about in its first document, and the names of each document's entities."""
    own = table(spark, d, "entities")
    e = own.select(F.explode("documents").alias("document_id"), F.col("entity_no").alias("id"), "name").distinct()
    none = F.lit("")
    text = F.concat(F.lit("How does "), F.coalesce("name", none), F.lit(" differ from "), F.coalesce("one_liner", "notes", none), F.lit("?"))
    return own.where(F.size("documents") > 0).select(F.col("entity_no").alias("question_id"), F.col("documents")[0].alias("document_id"), text.alias("question")), e


@query(_QUESTIONS + ", hit AS (SELECT question_id, id, name, 100.0::double AS score FROM met WHERE contains(q, n)) SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, length(name) DESC, id) AS rank FROM hit QUALIFY rank <= 8")
def linked_whole_names(spark, d):
    """Entities of a question's document whose whole name stands in the question, at a threshold of 100."""
    found = retrieval.linked_entities(*entity_questions(spark, d), 100.0)
    return found.select("question_id", "id", "name", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    _QUESTIONS
    + """, open AS (SELECT DISTINCT q, n FROM met WHERE NOT contains(q, n)), no AS (SELECT *, row_number() OVER () AS k FROM open),
    sides AS (SELECT k, CASE WHEN length(n) <= length(q) THEN n ELSE q END AS a, CASE WHEN length(n) <= length(q) THEN q ELSE n END AS t FROM no),
    pair AS (SELECT DISTINCT k AS x, 0 AS y, a, b FROM (SELECT k, a, substr(t, greatest(0, p) + 1, p + length(a) - greatest(0, p)) AS b FROM (SELECT *, unnest(range(1 - length(a), length(t))) AS p FROM sides)))"""
    + LCS
    + """, part AS (SELECT x, max(200.0 * l / (length(a) + length(b))) AS score FROM lcs GROUP BY x),
    hit AS (SELECT question_id, id, name, CASE WHEN contains(m.q, m.n) THEN 100.0 ELSE score END::double AS score FROM met m LEFT JOIN no ON no.q = m.q AND no.n = m.n LEFT JOIN part ON x = k)
    SELECT question_id, id, name, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, length(name) DESC, id) AS rank FROM hit WHERE score >= 82 QUALIFY rank <= 8"""
)
def link_entities(spark, d):
    """Entities of a question's document whose name is like a part of the question."""
    found = retrieval.linked_entities(*entity_questions(spark, d))
    return found.select("question_id", "id", "name", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def term_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """Entities and mentions of the terms of two chunks or more."""
    m = extract.lexical_mentions(table(spark, d, "chunks")).select("workspace_id", F.col("term").alias("entity_id"), F.col("document_id").cast("string").alias("document_id"), "chunk_id")
    return m.select(F.col("entity_id").alias("id"), F.col("entity_id").alias("name")).distinct(), m


@query("WITH" + _TERMS.format(text="text", chunks="chunks")[1:] + " SELECT DISTINCT document_id::varchar AS document_id, term AS id FROM m")
def document_entities(spark, d):
    return retrieval.mentioned(*term_graph(spark, d)).select("document_id", "id")


@query(
    """WITH c AS (SELECT DISTINCT document_id, chunk_id, ord FROM chunks),
    a AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ord, chunk_id) <= 3), z AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ord DESC, chunk_id DESC) <= 8),
    u AS (SELECT * FROM a UNION SELECT * FROM z) SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY ord, chunk_id) AS rank FROM u QUALIFY rank <= 8"""
)
def united_chunks(spark, d):
    """A document's first three chunks by one way and its last eight by another."""
    from pyspark.sql.window import Window

    c = table(spark, d, "chunks").select(F.col("document_id").alias("question_id"), "document_id", "chunk_id", "ord").distinct()
    top = lambda n, *by: c.withColumn("r", F.row_number().over(Window.partitionBy("document_id").orderBy(*by))).where(F.col("r") <= n).drop("r")
    u = retrieval.united(top(3, "ord", "chunk_id"), top(8, F.desc("ord"), F.desc("chunk_id")))
    return u.select("document_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


_CONTEXT = """WITH c AS (SELECT DISTINCT document_id AS q, chunk_id, ord, page, text FROM chunks QUALIFY dense_rank() OVER (PARTITION BY document_id ORDER BY ord, chunk_id) <= 8),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ord, chunk_id) AS rank FROM c),
psg AS (SELECT q, 2 AS part, rank, '[' || rank || '] (' || coalesce(nullif(filename, ''), 'document') || CASE WHEN page > 0 THEN ', page ' || page ELSE '' END || ')' || chr(10) || r.text AS t FROM r LEFT JOIN documents ON doc_id = q),
e AS (SELECT DISTINCT doc_id AS q, entity_no, name, one_liner, examples FROM (SELECT *, unnest(documents) AS x FROM entities) e JOIN documents ON doc_id::varchar = x WHERE name IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY entity_no) AS rank, concat_ws(chr(10), nullif(one_liner, ''), CASE WHEN len(examples) > 0 THEN 'Examples: ' || array_to_string(examples, '; ') END) AS said FROM e QUALIFY rank <= 8),
con AS (SELECT q, 0 AS part, rank, 'Concept: ' || name || chr(10) || said AS t FROM n WHERE said <> ''),
rel AS (SELECT q, 1 AS part, 0 AS rank, 'Relationships found in this document:' || chr(10) || string_agg('- ' || name || ' — is named in → ' || filename, chr(10) ORDER BY n.rank) AS t FROM n JOIN documents ON doc_id = q WHERE filename IS NOT NULL GROUP BY q),
p AS (SELECT * FROM psg UNION ALL SELECT * FROM con UNION ALL SELECT * FROM rel)"""


@query(_CONTEXT + " SELECT q AS question_id, left(string_agg(t, chr(10) || chr(10) ORDER BY part, rank), 12000) AS context FROM p GROUP BY q")
def context_blocks(spark, d):
    """Notes of a document's first eight entities, that they are named in it, and its first eight chunks."""
    from pyspark.sql.window import Window

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), "filename")
    c = table(spark, d, "chunks").select(F.col("document_id").alias("question_id"), "chunk_id", "ord", "page", "text").distinct()
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("ord", "chunk_id"))).where("rank <= 8")
    c = c.join(docs.withColumnRenamed("filename", "document"), "question_id", "left")
    e = table(spark, d, "entities").where("name is not null").select(F.explode("documents").alias("x"), "entity_no", "name", "one_liner", "examples").distinct()
    n = e.join(docs.withColumn("x", F.col("question_id").cast("string")), "x")
    n = n.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("entity_no"))).where("rank <= 8")
    none = [F.lit(None).cast("array<string>").alias(x) for x in retrieval.NOTES if x != "examples"]
    notes = n.select("question_id", "rank", "name", "one_liner", "examples", *none)
    said = n.where("filename is not null").select("question_id", "rank", F.col("name").alias("subject"), F.lit("is_named_in").alias("predicate"), F.col("filename").alias("object"))
    return retrieval.context(notes, said, c)


_ASKED = """WITH a AS (SELECT o_orderkey AS question_id, CASE o_orderstatus WHEN 'F' THEN 'hi there' WHEN 'O' THEN o_orderpriority ELSE ' ' END AS question, o_totalprice > 150000 AS found FROM orders),
r AS (SELECT *, CASE WHEN trim(question) = '' THEN 'error' WHEN question = 'hi there' THEN 'orientation' WHEN NOT found THEN 'nothing' ELSE 'answer' END AS route FROM a)"""


def asked(spark, d) -> DataFrame:
    q = F.when(F.col("o_orderstatus") == "F", "hi there").when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).otherwise(" ")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), q.alias("question"), F.lit("d").alias("document_id"), "o_totalprice")


@query(_ASKED + " SELECT question_id, route, CASE route WHEN 'error' THEN 'Ask a question.' WHEN 'nothing' THEN 'Nothing in this document answers that.' WHEN 'orientation' THEN 'Hello. This document covers sales' || chr(10) || chr(10) || 'Ask me anything about it.' ELSE upper(question) || ' 7' END AS answer FROM r")
def answered(spark, d):
    """Orders as questions: greeted, blank, without material, or answered by a generator that repeats them."""
    q = asked(spark, d)
    found = {"context": q.where("o_totalprice > 150000").select("question_id", F.lit("context").alias("context"))}
    o = spark.createDataFrame([("d", "Sales")], "document_id string, teaches string").select("document_id", retrieval.orientation(F.col("teaches"), F.array().cast("array<string>")).alias("reply"))
    return pipeline.answer(found, q.drop("o_totalprice"), o, lambda question, context: f"{question.upper()} {len(context)}")


@query(
    _ASKED
    + """, s AS (SELECT unnest([0, 1, 2]) AS seq) SELECT question_id, seq, CASE seq WHEN 0 THEN 'status' WHEN 2 THEN 'done' WHEN 1 THEN CASE WHEN route = 'error' THEN 'error' ELSE 'token' END END AS type, CASE seq WHEN 0 THEN 'searching' WHEN 1 THEN question ELSE '' END AS message FROM r, s"""
)
def answer_events(spark, d):
    q = asked(spark, d).select("question_id", retrieval.route(F.col("question"), F.col("o_totalprice") > 150000).alias("route"), F.col("question").alias("answer"))
    return pipeline.events(q)


@query(GRAPH + "SELECT question_id, count(DISTINCT id) AS entities, count(DISTINCT dst) AS triples, 0 AS chunks FROM (SELECT c_custkey AS question_id, 'n:' || c_nationkey AS id FROM customer) q LEFT JOIN edges ON src = q.id GROUP BY 1")
def retrieval_stats(spark, d):
    """Each customer asks about its nation."""
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("question_id"), F.concat(F.lit("n:"), "c_nationkey").alias("src"))
    said = q.join(places(typed_graph(spark, d)[1]), "src")
    return retrieval.stats(q, {"links": q, "triples": said, "chunks": said.limit(0)})


@query("SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY ord, chunk_id) AS n, left(text, 160) AS preview FROM (SELECT DISTINCT document_id, chunk_id, ord, text FROM chunks) QUALIFY n <= 8")
def answer_sources(spark, d):
    from pyspark.sql.window import Window

    c = table(spark, d, "chunks").select(F.col("document_id").alias("question_id"), "document_id", "chunk_id", "ord", "page", "text").distinct()
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy("ord", "chunk_id"))).where("rank <= 8")
    s = retrieval.sources(c.withColumn("document", F.lit("d")))
    return s.select(F.col("question_id").alias("document_id"), F.col("n").cast("bigint").alias("n"), "preview")
