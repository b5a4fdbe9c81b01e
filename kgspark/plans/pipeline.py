"""The engine's composite plans: building a graph, resolving it, retrieving from it and answering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import is_small_talk
from kgspark.operators import chunking, resolution, retrieval, triples, vectors
from kgspark.plans import extract
from kgspark.plans.scratch import Scratch

# What is said where there is nothing to answer from or nothing was asked.
NOTHING = "Nothing in this document answers that."
NO_QUESTION = "Ask a question."


@dataclass
class Corpus:
    """documents: workspace_id, doc_id, filename; chunks with embedding; the graph's tables."""

    documents: DataFrame
    chunks: DataFrame
    graph: triples.GraphTables


def build(documents: DataFrame, extractor: str = "pattern", embed: Callable = vectors.hashing_embedder, scratch: Scratch | None = None) -> Corpus:
    """Documents to chunks to triples to graph, with a vector for each chunk. All lazy; with scratch, chunks with their
    vectors and triples are written there, so that they are made once however many tables are read from them."""
    c = chunking.chunks(documents, keep=("workspace_id",))
    keep = scratch.save if scratch else lambda df: df
    own = keep(vectors.embedded(c, embed=embed))
    found = extract.run(own if scratch else c, extractor).where("error is null")
    clean = keep(triples.clean_triples(triples.plausible(found), ("workspace_id", "document_id"), keyed=True))
    return Corpus(documents, own, triples.graph_of_triples(clean))


def resolve(entities: DataFrame, edges: DataFrame, judge: Callable | None = None, embed: Callable = vectors.hashing_embedder, near: DataFrame | None = None) -> DataFrame:
    """(id, survivor) of entities to be merged: by their names, by their names' vectors, and where the judge calls two
    the same, asked about those whose vectors are less alike and about acronyms.

    near (id_a, id_b, name_a, name_b, block) are pairs to be scored besides those found within workspace and type."""
    scratch = Scratch(entities.sparkSession)
    pairs = scratch.save(resolution.string_pairs(entities))
    scored = resolution.near_pairs(entities, embed, judge is not None).join(pairs, ["id_a", "id_b"], "left_anti")
    if near is not None:
        v = vectors.embedded(
            near.select(F.explode(F.array("name_a", "name_b")).alias("text")).distinct(), embed=embed
        )
        a, b = v.select(F.col("text").alias("name_a"), F.col("embedding").alias("_a")), v.select(F.col("text").alias("name_b"), F.col("embedding").alias("_b"))
        own = near.join(a, "name_a").join(b, "name_b").withColumn("score", vectors.cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")
        own = own.withColumn("tier", resolution.tier(F.col("score"), F.col("name_a"), F.col("name_b")))
        low = F.when(F.col("score") < resolution.EMBED_ASK, F.lit(resolution.ACRONYM_ASK)).otherwise(F.col("score"))
        scored = scored.unionByName(own.withColumn("score", low).where("tier is not null").select(scored.columns))
    scored = scratch.save(scored)
    ask = resolution.asked(scored.where("tier = 'ask'"))
    said = resolution.adjudicated(ask, judge).where("verdict").select("id_a", "id_b")
    pairs = pairs.unionByName(scored.where("tier = 'merge'").select("id_a", "id_b")).unionByName(said).distinct()
    return scratch.result(resolution.survivors(entities, edges, pairs))


def retrieve(corpus: Corpus, questions: DataFrame, embed: Callable = vectors.hashing_embedder) -> dict[str, DataFrame]:
    """links, triples, chunks and context of every question, and own, single and several, which
    contexts are made from. questions: question_id, document_id, question.

    What several steps read is written first: as one plan, each step would hold copies of all before it, which the
    driver has no room for. Vectors and texts of chunks are read from where the corpus has them."""
    scratch = Scratch(questions.sparkSession)
    entities, mentions = scratch.save(corpus.graph.entities), scratch.save(corpus.graph.mentions.drop("spans"))
    q = scratch.save(questions.select("question_id", F.col("document_id").cast("string").alias("document_id"), "question"))
    mentioned = scratch.save(retrieval.mentioned(entities, mentions))
    links = retrieval.linked_entities(q, mentioned)
    links = scratch.save(links.join(q.select("question_id", "document_id"), "question_id"))
    edges = scratch.save(corpus.graph.edges.drop("workspace_id"))
    near = scratch.save(retrieval.expanded(links, edges, mentioned))
    chunks = corpus.chunks.withColumn("document_id", F.col("document_id").cast("string"))
    by_graph = retrieval.gathered(links, mentions, chunks)
    asked = q.select(F.col("question_id").alias("query"), "document_id", F.col("question").alias("text"))
    # a chunk's place goes along with its id, so that hits need not be joined with chunks to learn it
    placed = chunks.select(F.struct("chunk_id", "ord").alias("chunk"), "document_id", "embedding")
    hits = scratch.save(vectors.nearest_to_texts(asked, placed, retrieval.MOST_CHUNKS, ["document_id"], "chunk", embed))
    by_vector = hits.select(F.col("query").alias("question_id"), "document_id", "chunk.chunk_id", "chunk.ord")
    docs = corpus.documents.select(F.col("doc_id").cast("string").alias("document_id"), F.col("filename").alias("document"))
    lists = retrieval.listed_chunks(retrieval.united(scratch.save(by_graph), by_vector))
    names = entities.select("id", "name")
    said = scratch.save(
        near.join(names.select(F.col("id").alias("src"), F.col("name").alias("subject")), "src")
        .join(names.select(F.col("id").alias("dst"), F.col("name").alias("object")), "dst")
        .select("question_id", "rank", "subject", F.col("type").alias("predicate"), "object")
    )
    notes = links.select("question_id", "rank", "name", "id").join(retrieval.concept_notes(entities), "id", "left").drop("id")
    own = scratch.save(retrieval.own_parts(notes, said, lists))
    texts = chunks.select("document_id", "chunk_id", "page", "text")
    single, several = retrieval.shared_parts(own.select("list"), chunks.select("document_id", "chunk_id", F.col("source").alias("document"), "page", "text"))
    chosen = own.select("question_id", F.explode("list").alias("c")).select("question_id", "c.*").join(docs, "document_id", "left")
    passages = chosen.join(texts, ["document_id", "chunk_id"])
    context = retrieval.together(own, single, several)
    return {"links": links, "triples": said, "chunks": passages, "context": context, "own": own, "single": single, "several": several}


@lru_cache(maxsize=1)
def _sentences(context: str) -> list[tuple[str, set[str]]]:
    """The sentences of a context with their words; questions with the same context come one after the other."""
    lines = [x.strip() for x in context.replace("\n", ". ").split(". ") if x.strip()]
    return [(x, set(x.lower().split())) for x in lines]


def extractive(question: str, context: str) -> str:
    """A stand-in for a language model: the sentence of the context that shares most words with the question."""
    asked = set(question.lower().split())
    return max(_sentences(context), key=lambda x: len(asked & x[1]), default=("",))[0]


def answer(found: dict[str, DataFrame], questions: DataFrame, orientation: DataFrame, generate: Callable[[str, str], str] = extractive) -> DataFrame:
    """(question_id, route, answer): errors, small talk, missing material and answers. orientation: document_id, reply.

    Each kind of question goes its own way: only small talk meets replies, only what needs material meets contexts, and
    that once. As one plan in which all questions meet both, the driver had to plan and all had to be shuffled thrice."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for i, q, c in zip(df["question_id"], df["question"], df["context"]):
                try:
                    out.append((i, "answer", generate(q, c)) if c else (i, "nothing", NOTHING))
                except Exception as e:  # noqa: BLE001
                    out.append((i, "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["question_id", "route", "answer"])

    q = questions.withColumn("question", F.left("question", F.lit(retrieval.QUESTION_CHARS)))
    kind = q.schema["question_id"].dataType.simpleString()
    asked = q.where(retrieval.needs_material(F.col("question"))).select("question_id", "question")
    # contexts are put together beside their questions, for they are not to be shuffled
    met = retrieval.together(asked.join(found["own"], "question_id", "left"), found["single"], found["several"]) if "own" in found else asked.join(found["context"], "question_id", "left")
    made = met.select("question_id", "question", "context").mapInPandas(write, f"question_id {kind}, route string, answer string")
    plain = retrieval.orientation(F.lit(None).cast("string"), F.array().cast("array<string>"))
    greeted = q.where(is_small_talk(F.col("question"))).join(orientation, "document_id", "left")
    blank = q.where(F.trim(F.coalesce("question", F.lit(""))) == "")
    said = greeted.select("question_id", F.lit("orientation").alias("route"), F.coalesce("reply", plain).alias("answer"))
    return made.unionByName(said).unionByName(blank.select("question_id", F.lit("error").alias("route"), F.lit(NO_QUESTION).alias("answer")))


def events(answers: DataFrame) -> DataFrame:
    """(question_id, seq, type, message): what a client is sent for each answer, in order; one row a frame."""
    steps = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("status").alias("type"), F.lit("searching").alias("message")),
        F.struct(F.lit(1).alias("seq"), F.when(F.col("route") == "error", "error").otherwise("token").alias("type"), F.col("answer").alias("message")),
        F.struct(F.lit(2).alias("seq"), F.lit("done").alias("type"), F.lit("").alias("message")),
    )
    return answers.select("question_id", F.explode(steps).alias("e")).select("question_id", "e.*")
