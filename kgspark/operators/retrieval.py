"""Answering questions over the graph: link, expand, gather, search, and put the context together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.functions.text import is_small_talk, listed, lower_first, normalize, partial_ratio, prettify_relation

LINK, MOST_ENTITIES, MOST_TRIPLES, MOST_CHUNKS = 82.0, 8, 25, 8
CONTEXT_CHARS, PREVIEW_CHARS, QUESTION_CHARS = 12_000, 160, 2000


def _top(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def mentioned(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(document_id, id, name) of the entities each document mentions."""
    m = mentions.select("document_id", F.col("entity_id").alias("id")).distinct()
    return m.join(entities.select("id", "name"), "id").select("document_id", "id", "name")


def linked_entities(questions: DataFrame, candidates: DataFrame, threshold: float = LINK, most: int = MOST_ENTITIES) -> DataFrame:
    """(question_id, id, name, score, rank): entities of the question's document whose name appears in the question.

    questions: question_id, document_id, question; candidates: document_id, id, name. Names of three characters or
    less must be a word of it. The equi-join on the document is the block; scores are taken within it only."""
    q = questions.select("question_id", "document_id", normalize(F.col("question")).alias("q"))
    c = candidates.withColumn("n", normalize(F.col("name"))).where("n <> ''")
    met = q.join(c, "document_id").where((F.length("n") > 3) | F.array_contains(F.split("q", " "), F.col("n")))
    whole = F.contains("q", "n")
    score = F.lit(100.0) if threshold >= 100 else F.when(whole, F.lit(100.0)).otherwise(partial_ratio("n", "q"))
    met = (met.where(whole) if threshold >= 100 else met).withColumn("score", score).where(F.col("score") >= threshold)
    return _top(met, ["question_id"], [F.desc("score"), F.desc(F.length("name")), "id"], most).select("question_id", "id", "name", "score", "rank")


def expanded(links: DataFrame, edges: DataFrame, allowed: DataFrame, most: int = MOST_TRIPLES) -> DataFrame:
    """(question_id, src, type, dst, confidence, rank): edges from or to a question's entities whose other end its
    document mentions, the surest first, unknown confidences before all. links: question_id, document_id, id;
    allowed: document_id, id."""
    a = links.select("question_id", "document_id", F.col("id").alias("src")).join(edges, "src").withColumn("other", F.col("dst"))
    b = links.select("question_id", "document_id", F.col("id").alias("dst")).join(edges, "dst").withColumn("other", F.col("src"))
    cols = ["question_id", "document_id", "src", "type", "dst", "confidence", "other"]
    both = a.select(*cols).unionByName(b.select(*cols))
    ok = both.join(allowed.select("document_id", F.col("id").alias("other")).distinct(), ["document_id", "other"], "left_semi")
    ok = ok.dropDuplicates(["question_id", "src", "type", "dst"])
    return _top(ok, ["question_id"], [F.desc_nulls_first("confidence"), "src", "type", "dst"], most).drop("document_id", "other")


def gathered(links: DataFrame, mentions: DataFrame, chunks: DataFrame, most: int = MOST_CHUNKS) -> DataFrame:
    """(question_id, document_id, chunk_id, ord, hits, rank): chunks that mention most of a question's entities."""
    m = mentions.select("document_id", "chunk_id", F.col("entity_id").alias("id")).distinct()
    hits = links.select("question_id", "document_id", "id").distinct().join(m, ["document_id", "id"]).groupBy("question_id", "document_id", "chunk_id").agg(F.count("*").alias("hits"))
    placed = hits.join(chunks.select("document_id", "chunk_id", "ord"), ["document_id", "chunk_id"])
    return _top(placed, ["question_id"], [F.desc("hits"), "ord", "chunk_id"], most)


def united(by_graph: DataFrame, by_vector: DataFrame, most: int = MOST_CHUNKS) -> DataFrame:
    """(question_id, document_id, chunk_id, ord): both ways' chunks, once each, in the order of the text, the first `most`."""
    cols = ["question_id", "document_id", "chunk_id", "ord"]
    both = by_graph.select(*cols).unionByName(by_vector.select(*cols)).dropDuplicates(["question_id", "document_id", "chunk_id"])
    return _top(both, ["question_id"], ["ord", "chunk_id"], most)


#: The lists of a concept's notes.
NOTES = ("how_it_works", "strengths", "limitations", "when_to_use", "examples")


def concept_notes(entities: DataFrame) -> DataFrame:
    """(id, one_liner and NOTES) of entities; where they lack such a column it is null."""
    kinds = {"one_liner": "string", **dict.fromkeys(NOTES, "array<string>")}
    return entities.select("id", *[(F.col(c) if c in entities.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def _notes(concepts: DataFrame, triples: DataFrame) -> DataFrame:
    """(question_id, part, rank, t): concept notes and relations, the parts of a context that are a question's own."""
    # The labels of a concept's lists.
    labels = (("how_it_works", "How it works"), ("strengths", "Good at"), ("limitations", "Limits"), ("when_to_use", "Use it when"), ("examples", "Examples"))
    lines = [F.when(F.size(k) > 0, F.concat(F.lit(f"{label}: "), F.array_join(k, "; "))) for k, label in labels]
    said = F.concat_ws("\n", F.nullif(F.col("one_liner"), F.lit("")), *lines)
    c = concepts.withColumn("said", said).where("said <> ''").select("question_id", F.lit(0).alias("part"), "rank", F.concat(F.lit("Concept: "), "name", F.lit("\n"), "said").alias("t"))
    line = F.concat(F.lit("- "), "subject", F.lit(" — "), prettify_relation(F.col("predicate")), F.lit(" → "), "object")
    rel = triples.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    return c.unionByName(rel.select("question_id", F.lit(1).alias("part"), F.lit(0).alias("rank"), F.concat(F.lit("Relationships found in this document:\n"), "t").alias("t")))


def _passage() -> Column:
    """A passage behind its number: document, page and text."""
    where = F.concat(F.coalesce(F.nullif(F.col("document"), F.lit("")), F.lit("document")), F.when(F.col("page") > 0, F.concat(F.lit(", page "), F.col("page").cast("string"))).otherwise(""))
    return F.concat(where, F.lit(")\n"), "text")


def _numbered(rank: Column, passage: Column) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] ("), passage)


def _passages(chunks: DataFrame, by: str) -> DataFrame:
    """(by, part, rank, t): numbered passages."""
    return chunks.select(by, F.lit(2).alias("part"), "rank", _numbered(F.col("rank"), _passage()).alias("t"))


def _joined(parts: DataFrame, by: str, name: str) -> DataFrame:
    whole = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("part", "rank", "t"))).alias("p"))
    return whole.select(by, F.left(F.array_join(F.transform("p", lambda x: x["t"]), "\n\n"), F.lit(CONTEXT_CHARS)).alias(name))


def context(concepts: DataFrame, triples: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, context): concept notes, relations and numbered passages of a question, up to CONTEXT_CHARS.

    concepts: question_id, rank, name, one_liner and lists how_it_works, strengths, limitations, when_to_use, examples;
    triples: question_id, rank, subject, predicate, object; chunks: question_id, rank, document, page, text.
    Each of them is bounded for a question by the limits above."""
    return _joined(_notes(concepts, triples).unionByName(_passages(chunks, "question_id")), "question_id", "context")


def listed_chunks(chosen: DataFrame) -> DataFrame:
    """(question_id, list): each question's chunks (rank, document_id, chunk_id, ord) in the order of their ranks."""
    return chosen.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "document_id", "chunk_id", "ord"))).alias("list"))


def own_parts(concepts: DataFrame, triples: DataFrame, lists: DataFrame) -> DataFrame:
    """(question_id, list, notes): what is a question's own of its context, besides the list of its chunks."""
    return lists.join(_joined(_notes(concepts, triples), "question_id", "notes"), "question_id", "full")


def shared_parts(lists: DataFrame, chunks: DataFrame, documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Passages of each different list, since all questions with the same chunks share them: (document_id, chunk_id,
    passages) of lists of one chunk, whose texts are shuffled once, and (list, passages) of longer ones. lists: list of
    listed_chunks(); chunks: document_id, chunk_id, page, text and document, if documents (document_id, document) don't tell it."""
    key = ["document_id", "chunk_id"]
    named = lambda df: df if documents is None else df.join(documents, "document_id", "left")
    one = lists.where(F.size("list") == 1).select(F.col("list")[0].alias("c")).select("c.document_id", "c.chunk_id").distinct()
    single = named(one).join(chunks, key).groupBy(*key).agg(F.array_sort(F.collect_list(_passage())).alias("passages"))
    rows = lists.where(F.size("list") > 1).select("list").distinct().select("list", F.explode("list").alias("c")).select("list", "c.rank", "c.document_id", "c.chunk_id")
    return single, _joined(_passages(named(rows).join(chunks, key), "list"), "list", "passages")


def together(own: DataFrame, single: DataFrame, several: DataFrame) -> DataFrame:
    """own, its columns list and notes replaced by context. Only texts of single and several are shuffled, once for each
    list; contexts are made where they are used."""
    n = F.coalesce(F.size("list"), F.lit(0))
    one = own.where(n == 1).withColumns({k: F.col("list")[0][k] for k in ("document_id", "chunk_id")}).join(single, ["document_id", "chunk_id"], "left")
    said = F.array_join(F.transform("passages", lambda x: _numbered(F.col("list")[0]["rank"], x)), "\n\n")
    one = one.withColumn("passages", said).drop("document_id", "chunk_id")
    both = one.unionByName(own.where(n != 1).join(several, "list", "left"))
    whole = F.left(F.concat_ws("\n\n", "notes", F.nullif(F.col("passages"), F.lit(""))), F.lit(CONTEXT_CHARS))
    return both.withColumn("context", whole).drop("list", "notes", "passages")


def orientation(teaches: Column, concepts: Column) -> Column:
    """The reply to small talk, from a document's summary and its first core concepts."""
    # The three replies.
    covers = F.concat(F.lit("Hello. This document covers "), lower_first(teaches))
    return (
        F.when((teaches != "") & (F.size(concepts) > 0), F.concat(covers, F.lit("\n\nThe map has "), listed(concepts), F.lit(" on it. Ask how any of them works, what it is good or bad at, or how two of them differ.")))
        .when(teaches != "", F.concat(covers, F.lit("\n\nAsk me anything about it.")))
        .otherwise(F.lit("Hello. Ask me anything about this document - a concept on the map, or how two of them relate."))
    )


def core_concepts(documents: DataFrame, entities: DataFrame, most: int = 4) -> DataFrame:
    """(doc_id, concepts): the first core entities of each document in the order of their names; documents without any keep an empty list."""
    e = entities.where("importance = 'core'").select("workspace_id", "name", F.explode("documents").alias("d")).where("name is not null")
    ranked = _top(e.distinct(), ["workspace_id", "d"], ["name"], most)
    got = ranked.groupBy("workspace_id", "d").agg(F.array_sort(F.collect_list("name")).alias("concepts"))
    joined = documents.select("workspace_id", "doc_id", F.col("doc_id").cast("string").alias("d")).join(got, ["workspace_id", "d"], "left")
    return joined.select("doc_id", F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"))


def needs_material(question: Column) -> Column:
    """Whether the route of a question, as far as it is read, depends on what is found for it."""
    q = F.left(question, F.lit(QUESTION_CHARS))
    return (F.trim(F.coalesce(q, F.lit(""))) != "") & ~is_small_talk(q)


def route(question: Column, found: Column) -> Column:
    """What a question gets: error, orientation, nothing (no material) or answer."""
    return F.when(F.trim(F.coalesce(question, F.lit(""))) == "", "error").when(is_small_talk(question), "orientation").when(~F.coalesce(found, F.lit(False)), "nothing").otherwise("answer")


def sources(chunks: DataFrame) -> DataFrame:
    """Numbered passages of an answer with previews. chunks: question_id, rank, document, page, chunk_id, text."""
    return chunks.select("question_id", F.col("rank").alias("n"), "document", "page", "chunk_id", F.left("text", F.lit(PREVIEW_CHARS)).alias("preview"))


def stats(questions: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """(question_id, entities, triples, chunks) found for each question; 0 where there is nothing."""
    out = questions.select("question_id").distinct()
    for name, part in (("entities", "links"), ("triples", "triples"), ("chunks", "chunks")):
        n = found[part].groupBy("question_id").agg(F.count("*").alias(name))
        out = out.join(n, "question_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out
