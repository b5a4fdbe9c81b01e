import json

import pytest
from pyspark.sql import functions as F

from kgspark.operators import chunking, conceptmap, graph, retrieval
from kgspark.plans import pipeline
from kgspark.plans.scratch import Scratch

TEXT = "# Guide\n\nAlpha Store depends on Beta Cache. Nothing else here.\n\nGamma Tool is part of Alpha Store.\n"


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([("w", 1, "guide.md", TEXT), ("w", 2, "other.md", "Delta Unit depends on Beta Cache."), ("w", 3, "none.md", "no names in here")], "workspace_id string, doc_id bigint, filename string, text string")
    return pipeline.build(docs)


def test_build(corpus):
    assert {r.id for r in corpus.graph.entities.collect()} == {f"w:concept:{n}" for n in ("alpha store", "beta cache", "gamma tool", "delta unit")}
    assert {(r.src.rpartition(":")[2], r.type, r.dst.rpartition(":")[2]) for r in corpus.graph.edges.collect()} == {
        ("alpha store", "depends_on", "beta cache"), ("gamma tool", "part_of", "alpha store"), ("delta unit", "depends_on", "beta cache"),
    }
    assert corpus.chunks.where("embedding is null").count() == 0


def test_ask(spark, corpus):
    q = spark.createDataFrame([(1, "1", "What does Alpha Store depend on?"), (2, "1", "hello there"), (3, "1", "  "), (4, "9", "Alpha Store?")], "question_id int, document_id string, question string")
    found = pipeline.retrieve(corpus, q)
    text = {r.question_id: r.context for r in found["context"].collect()}
    assert "- Alpha Store — depends on → Beta Cache" in text[1] and "Delta" not in text[1] and "[1] (guide.md)" in text[1]
    o = spark.createDataFrame([("1", "Hello. Hi.")], "document_id string, reply string")
    got = {r.question_id: (r.route, r.answer) for r in pipeline.answer(found, q, o).collect()}
    assert got[1][0] == "answer" and "Beta Cache" in got[1][1]
    assert got[2] == ("orientation", "Hello. Hi.") and got[3] == ("error", pipeline.NO_QUESTION) and got[4] == ("nothing", pipeline.NOTHING)

    def broken(q, c):
        raise OSError("down")

    bad = pipeline.answer(found, q, o, broken)
    assert bad.where("question_id = 1").first().route == "error"
    e = pipeline.events(bad).where("question_id = 1").orderBy("seq").collect()
    assert [r.type for r in e] == ["status", "error", "done"]


def test_resolve(spark):
    names = {"a": "cyber crime", "b": "cybercrime", "c": "pc", "d": "personal computer", "e": "zebra"}
    ent = spark.createDataFrame([("w", i, n, n, "concept", False) for i, n in names.items()], "workspace_id string, id string, name string, canonical_name string, type string, user_edited boolean")
    edges = spark.createDataFrame([("d", "r", "e")], "src string, type string, dst string")
    near = spark.createDataFrame([("x", "c", "d", "pc", "personal computer"), ("x", "d", "e", "personal computer", "zebra")], "block string, id_a string, id_b string, name_a string, name_b string")
    assert {tuple(r) for r in pipeline.resolve(ent, edges).collect()} == {("b", "a")}
    assert {tuple(r) for r in pipeline.resolve(ent, edges, lambda p: [True] * len(p), near=near).collect()} == {("b", "a"), ("c", "d")}


def test_merged_documents(spark):
    e = spark.createDataFrame([("a", ["2", "1"]), ("b", ["3", "1"]), ("c", None), ("d", ["9"])], "id string, documents array<string>")
    r = spark.createDataFrame([("b", "a")], "id string, survivor string")
    assert {x.id: x.documents for x in graph.merged_entities(e, r).collect()} == {"a": ["1", "2", "3"], "c": None, "d": ["9"]}


def test_panel(spark):
    n = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    e = spark.createDataFrame([("a", "r", "b", True), ("a", "s", "a", None)], "src string, type string, dst string, prerequisite boolean")
    assert {(r.direction, r.type, r.other_name) for r in graph.panel_relations(n, e, n.where("id = 'a'")).collect()} == {("out", "r", "B"), ("out", "s", "A")}
    assert [tuple(r) for r in graph.prerequisites(n, e).collect()] == [("a", "B")]
    assert tuple(graph.canvas_counts(n, e).first()) == (2, 2, 1)
    c = spark.createDataFrame([("d", "speed", {"A": "slow", "B": "fast"})], "document_id string, dimension string, values map<string,string>")
    assert {tuple(r) for r in graph.contrasts_of(c, n.where("id = 'a'")).collect()} == {("A", "speed", "A", "slow"), ("A", "speed", "B", "fast")}
    d = spark.createDataFrame([("1", "x"), ("2", None)], "id string, teaches string")
    assert [graph.headline(d, s).first()[0] for s in ("1", "2", None, "9")] == ["x", "", "", ""]
    assert graph.headline(d.where("id = '1'"), None).first()[0] == "x"


def test_mapper_replies(spark):
    said = {"teaches": "T", "concepts": [{"name": "A", "requires": ["B"]}, {"name": None}], "links": [{"from": "A", "to": "B", "relation": "is"}, {"source": "A", "target": "B"}], "contrasts": [{"dimension": "d", "values": {"A": "1"}}, {"dimension": "e"}]}
    df = spark.createDataFrame([("1", json.dumps(said)), ("2", "not json")], "document_id string, reply string")
    m = conceptmap.parsed_maps(df)
    assert [r.name for r in m["concepts"].collect()] == ["A"] and [(r.source, r.target) for r in m["links"].collect()] == [("A", "B")]
    assert m["contrasts"].count() == 1 and {r.document_id: r.teaches for r in m["documents"].collect()} == {"1": "T", "2": ""}


def test_long_documents_are_read_in_sections(spark):
    calls = []

    def mapper(text, names):
        if "fail" in text:
            raise ValueError
        return json.dumps({"concepts": [{"name": f"c{len(names)}"}]})

    text = "# A\n" + "x " * 100 + "\n\n# B\nfail\n\n" + "# C\n" + "y " * 100
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id int, text string")
    got = {(r.document_id, r.section): json.loads(r.reply)["concepts"][0]["name"] for r in conceptmap.replies(docs, mapper, budget=52).collect()}
    assert got[("2", 0)] == "c0" and len([k for k in got if k[0] == "1"]) >= 1 and not calls
    c = spark.createDataFrame([("1", 1, 0, "x")], "document_id string, section int, seq int, name string")
    assert conceptmap.united_sections(c, c)[0].first().seq == 10_000


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert {tuple(r) for r in graph.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "C")}
    c = spark.createDataFrame([("w", 1, "c1"), ("w", 7, "c2")], "workspace_id string, document_id int, chunk_id string")
    docs = spark.createDataFrame([("w", 1), ("v", 7)], "workspace_id string, doc_id int")
    assert [r.chunk_id for r in graph.write_chunks(c.limit(0), c, docs).collect()] == ["c1"]
    assert c.where(F.lit(False)).count() == 0


def test_common_words_and_words_of_all_scripts_are_mentioned(spark):
    from itertools import combinations

    from kgspark.plans import extract

    texts = [f"alphabet {'birdhouse' if i % 2 else 'überraschung'} only{'abcdefghijkl'[i] * 6}" for i in range(12)] + ["библиотека alphabet", "библиотека ἀλφάβητος"]
    c = spark.createDataFrame([("w", i, f"c{i}", t) for i, t in enumerate(texts)], "workspace_id string, document_id bigint, chunk_id string, text string")
    m = extract.lexical_mentions(c)
    want = {"alphabet": 13, "birdhouse": 6, "überraschung": 6, "библиотека": 2}
    assert {(r.term, r.df) for r in m.select("term", "df").distinct().collect()} == set(want.items())
    pairs = {p for t in texts for p in combinations(sorted(set(t.split()) & set(want)), 2)}
    got = {r.term: (r.mentions, r.degree) for r in extract.lexical_degrees(m).collect()}
    assert got == {t: (n, sum(t in p for p in pairs)) for t, n in want.items()}
    assert {(r.src, r.dst) for r in extract.lexical_edges(m).collect()} == pairs


def test_resolve_finds_its_own_candidates(spark):
    import random

    from kgspark.operators import resolution
    from kgspark.operators.vectors import hashing_embedder

    schema = "workspace_id string, id string, name string, canonical_name string, type string, user_edited boolean, entity_no int"
    names = {"a": "graph database engine", "b": "database engine graph", "c": "ml", "d": "machine learning", "e": "MLs"}
    rows = [("w", i, n, n.lower(), "concept", None, k) for k, (i, n) in enumerate(names.items())]
    rows += [("v", "o", "graph database engine", "graph database engine", "concept", None, 9), ("w", "u", "engine graph database", "engine graph database", "concept", True, 11), ("w", "u", "engine graph database", "engine graph database", "concept", False, 10)]
    ent = resolution.one_row_each(spark.createDataFrame(rows, schema), "entity_no")
    assert {(r.id, r.entity_no, r.user_edited) for r in ent.where("id = 'u'").collect()} == {("u", 10, True)}
    none = spark.createDataFrame([], "src string, type string, dst string")
    assert {tuple(r) for r in pipeline.resolve(ent, none).collect()} == {("b", "a")}
    same = lambda p: [{x.lower().rstrip("s") for x in y} == {"ml", "machine learning"} for y in p]
    assert {tuple(r) for r in pipeline.resolve(ent, none, same).collect()} == {("b", "a"), ("c", "d"), ("e", "d")}

    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "store", "cache"]
    many = [("w", f"n{i:02d}", " ".join(rnd.sample(words, 3)), "x", "concept", False, i) for i in range(40)]
    v = hashing_embedder([r[2] for r in many])
    want = {(many[i][1], many[j][1]) for i in range(40) for j in range(i + 1, 40) if float(v[i] @ v[j]) >= 0.55}
    got = resolution.near_pairs(spark.createDataFrame(many, schema), hashing_embedder, True, tile_rows=7)
    assert {(r.id_a, r.id_b) for r in got.collect()} == want and 40 < len(want) < 780


def test_contexts_hold_the_notes_of_concepts(spark, corpus):
    from dataclasses import replace

    n = F.when(F.col("name") == "Alpha Store", "A store of alphas.")
    told = corpus.graph.entities.withColumn("one_liner", n).withColumn("strengths", F.when(n.isNotNull(), F.array(F.lit("fast"), F.lit("small"))))
    q = spark.createDataFrame([(1, "1", "What is Alpha Store?")], "question_id int, document_id string, question string")
    said = pipeline.retrieve(replace(corpus, graph=replace(corpus.graph, entities=told)), q)["context"].first().context
    assert said.startswith("Concept: Alpha Store\nA store of alphas.\nGood at: fast; small\n")
    assert pipeline.retrieve(corpus, q)["context"].first().context in said


def test_contexts_are_small_plans(spark, corpus):
    q = spark.createDataFrame([(1, "1", "What is Alpha Store?"), (2, "1", "hello there"), (3, "1", " ")], "question_id int, document_id string, question string")
    workers = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas")
    found = pipeline.retrieve(corpus, q)
    o = spark.createDataFrame([("1", "Hello. Hi.")], "document_id string, reply string")
    assert workers(found["context"]) <= 1 and workers(pipeline.answer(found, q, o)) <= 2
    some = pipeline.retrieve(corpus, q.where(retrieval.needs_material(F.col("question"))))
    assert [r.question_id for r in some["context"].collect()] == [1]
    assert sorted(map(tuple, pipeline.answer(some, q, o).collect())) == sorted(map(tuple, pipeline.answer(found, q, o).collect()))


def test_answers_put_contexts_together_beside_their_questions(spark, corpus):
    q = spark.createDataFrame([(1, "1", "What does Alpha Store depend on?"), (2, "2", "And Delta Unit?"), (3, "9", "Alpha Store?")], "question_id int, document_id string, question string")
    found = pipeline.retrieve(corpus, q)
    o = spark.createDataFrame([("1", "Hello. Hi.")], "document_id string, reply string")
    said = [pipeline.answer({k: found[k] for k in keys}, q, o) for keys in (("own", "single", "several"), ("context",))]
    own, whole = (sorted(map(tuple, x.collect())) for x in said)
    assert own == whole and [x[1] for x in own] == ["answer", "answer", "nothing"]


def test_texts_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "a.md", TEXT), (2, "b.md", " "), (3, "c.md", None)], "doc_id bigint, filename string, text string")
    c = chunking.chunks(docs)
    assert c._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r.document_id for r in c.collect()] == [1]


def test_answers_are_planned_in_small_steps(spark, corpus, monkeypatch):
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    save, seen = Scratch.save, []
    monkeypatch.setattr(Scratch, "save", lambda self, df: (seen.append(joins(df)), save(self, df))[1])
    q = spark.createDataFrame([(1, "1", "What does Alpha Store depend on?"), (2, "1", "hello there"), (3, "1", " ")], "question_id int, document_id string, question string")
    o = spark.createDataFrame([("1", "Hello. Hi.")], "document_id string, reply string")
    found = pipeline.retrieve(corpus, q.where(retrieval.needs_material(F.col("question"))))
    said = pipeline.answer(found, q, o)
    assert max([*seen, joins(said)]) <= 7
    assert sorted(r.question_id for r in said.collect()) == [1, 2, 3]
