import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.operators import relational, retrieval, vectors
from kgspark.streaming import ingest

T0 = datetime(2024, 1, 1)


def test_linking(spark):
    q = spark.createDataFrame([(1, "d", "What does Neo4j use?"), (2, "d", "explain kuberntes AI"), (3, "x", "Neo4j")], "question_id int, document_id string, question string")
    c = spark.createDataFrame([("d", "n", "Neo4j"), ("d", "k", "Kubernetes"), ("d", "ai", "AI"), ("d", "in", "in"), ("d", "z", None)], "document_id string, id string, name string")
    got = {(r.question_id, r.id) for r in retrieval.linked_entities(q, c).collect()}
    assert got == {(1, "n"), (2, "k"), (2, "ai")}


def test_expansion_and_gathering(spark):
    links = spark.createDataFrame([(1, "d", "a")], "question_id int, document_id string, id string")
    e = spark.createDataFrame([("a", "r", "b", 0.5), ("c", "r", "a", None), ("a", "r", "out", 1.0)], "src string, type string, dst string, confidence double")
    allowed = spark.createDataFrame([("d", "a"), ("d", "b"), ("d", "c")], "document_id string, id string")
    got = retrieval.expanded(links, e, allowed).orderBy("rank").collect()
    assert [(r.src, r.dst) for r in got] == [("c", "a"), ("a", "b")]
    m = spark.createDataFrame([("d", "c1", "a"), ("d", "c1", "a"), ("d", "c2", "a"), ("x", "c1", "a")], "document_id string, chunk_id string, entity_id string")
    c = spark.createDataFrame([("d", "c1", 5), ("d", "c2", 2), ("x", "c1", 0)], "document_id string, chunk_id string, ord int")
    g = retrieval.gathered(links, m, c)
    assert [(r.chunk_id, r.hits) for r in g.orderBy("rank").collect()] == [("c2", 1), ("c1", 1)]
    u = retrieval.united(g, g.withColumn("chunk_id", F.lit("c0")).withColumn("ord", F.lit(0)), most=2)
    assert [r.chunk_id for r in u.orderBy("rank").collect()] == ["c0", "c2"]


def test_context(spark):
    lists = ", ".join(f"{c} array<string>" for c in ("how_it_works", "strengths", "limitations", "when_to_use", "examples"))
    c = spark.createDataFrame([(1, 1, "Graph", "Holds nodes", ["links"], ["fast", "small"], None, None, []), (1, 2, "Bare", None, None, None, None, None, None)], f"question_id int, rank int, name string, one_liner string, {lists}")
    t = spark.createDataFrame([(1, 2, "A", "depends_on", "B"), (1, 1, "B", "uses", "C")], "question_id int, rank int, subject string, predicate string, object string")
    p = spark.createDataFrame([(1, 1, "doc.md", None, "text"), (1, 2, None, 3, "more")], "question_id int, rank int, document string, page int, text string")
    got = retrieval.context(c, t, p).first().context
    assert got == "Concept: Graph\nHolds nodes\nHow it works: links\nGood at: fast; small\n\nRelationships found in this document:\n- B — uses → C\n- A — depends on → B\n\n[1] (doc.md)\ntext\n\n[2] (document, page 3)\nmore"
    long = p.withColumn("text", F.repeat(F.lit("x"), F.lit(20_000)))
    assert len(retrieval.context(c, t, long).first().context) == retrieval.CONTEXT_CHARS


def test_questions_with_the_same_chunks_share_their_passages(spark):
    r = random.Random(11)
    chunks = [(d, f"{d}{i}", i or None, (f"text {d}{i} ") * r.choice([1, 1, 900])) for d in "abc" for i in range(4)] + [("a", "a0", 7, "twice"), ("b", "b1", 0, None)]
    docs = [("a", "a.md"), ("b", ""), ("b", "other")]
    own = [r.sample(range(4), r.choice([0, 1, 1, 1, 2, 4])) for _ in range(60)]
    chosen = [(q, d, f"{d}{i}", i, n) for q, own in enumerate(own) for d in [r.choice("abc")] for n, i in enumerate(sorted(own), 1)]
    told = [(q, 1, "N", f"note {q}", None, None, None, None, None) for q in range(0, 70, 3)]
    c = spark.createDataFrame(told, "question_id int, rank int, name string, one_liner string, " + ", ".join(f"{k} array<string>" for k in retrieval.NOTES))
    t = spark.createDataFrame([(q, 1, "A", "is", "B") for q in range(0, 70, 4)], "question_id int, rank int, subject string, predicate string, object string")
    chosen = spark.createDataFrame(chosen, "question_id int, document_id string, chunk_id string, ord int, rank int")
    chunks = spark.createDataFrame(chunks, "document_id string, chunk_id string, page int, text string")
    docs = spark.createDataFrame(docs, "document_id string, document string")
    want = retrieval.context(c, t, chosen.join(docs, "document_id", "left").join(chunks, ["document_id", "chunk_id"]))
    lists = retrieval.listed_chunks(chosen)
    single, several = retrieval.shared_parts(lists, chunks, docs)
    got = retrieval.together(retrieval.own_parts(c, t, lists), single, several)
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in want.collect()} and got.count() == want.count() > 55
    assert single.count() <= 12 and several.count() == lists.where("size(list) > 1").select("list").distinct().count()


def test_replies(spark):
    df = spark.createDataFrame([("Graph theory", ["A", "B", "C"]), ("Graph theory", []), ("", ["A"]), (None, None)], "t string, c array<string>")
    got = [r[0] for r in df.select(retrieval.orientation(F.col("t"), F.col("c"))).collect()]
    assert "covers graph theory\n\nThe map has A, B and C on it." in got[0] and got[1].endswith("Ask me anything about it.") and got[2] == got[3]
    q = spark.createDataFrame([(" ", True), ("hello", True), ("graph?", False), ("graph?", True), (None, None)], "q string, f boolean")
    assert [r[0] for r in q.select(retrieval.route(F.col("q"), F.col("f"))).collect()] == ["error", "orientation", "nothing", "answer", "error"]


def test_nearest(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(40, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], i % 2) for i in range(40)] + [(99, [0.0] * 8, 0), (98, None, 0)], "vec_id bigint, embedding array<float>, label int")
    q = df.where("vec_id < 4").select(F.col("vec_id").alias("query"), "embedding", "label")
    got = {(x.query, x["rank"]): x.vec_id for x in vectors.nearest(q, df, 5, ["label"]).collect()}
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(4):
        mine = [j for j in range(40) if j % 2 == i % 2]
        best = sorted(mine, key=lambda j: (-float(n[i] @ n[j]), j))[:5]
        assert [got[i, k + 1] for k in range(5)] == best


def test_embedding(spark):
    df = spark.createDataFrame([(1, "graph node"), (2, "Graph  NODE!"), (3, ""), (4, None)], "id int, text string")
    e = {r.id: np.array(r.embedding) for r in vectors.embedded(df).collect()}
    assert np.allclose(e[1], e[2]) and np.linalg.norm(e[1]) == pytest.approx(1, abs=1e-5) and not e[3].any() and not e[4].any()


def test_quizzes(spark):
    q = "array<struct<question:string,options:array<string>,answer:int>>"
    rows = [([("a?", ["1", "2", "3", "4"], 0), ("b?", ["1", "2", "3"], 0), (" ", ["1", "2", "3", "4"], 0), ("c?", ["1", "2", " ", "4"], 0), ("d?", ["1", "2", "3", "4"], 4), ("e?", ["1", "2", "3", "4"], 3)],)]
    got = spark.createDataFrame(rows, f"q {q}").select(relational.valid_questions(F.col("q"), 5).alias("q")).first().q
    assert [x.question for x in got] == ["a?", "e?"]
    a = spark.createDataFrame([([0, -1, 2], [0, 1, 2]), ([0], [0, 1]), ([0, 9, 1], [0, 1, 1])], "a array<int>, k array<int>")
    assert [r[0] for r in a.select(relational.valid_answers(F.col("a"), F.col("k"))).collect()] == [True, False, False]
    r = a.limit(1).select(relational.score(F.col("a"), F.col("k")), relational.review(F.col("a"), F.col("k"))).first()
    assert r[0] == 2 and r[1] == ["right", "skipped", "right"]
    quizzes = spark.createDataFrame([(1, "own"), (2, "own")], "quiz_id int, owner_id string")
    tries = spark.createDataFrame([(1, "u"), (1, "u"), (1, "own"), (2, "u")], "quiz_id int, user_id string")
    assert {tuple(x) for x in relational.new_attempts(tries, tries.where("quiz_id = 2"), quizzes).collect()} == {(1, "u")}
    assert {tuple(x) for x in relational.responses(quizzes, tries).collect()} == {(1, 3), (2, 1)}


@pytest.mark.parametrize("n", [1, 3, 10, 37])
def test_even_sample(spark, n):
    c = spark.createDataFrame([("d", f"c{i:02d}", i, "x" * 2500) for i in range(n)], "document_id string, chunk_id string, ord int, text string")
    keep = n if n * 2500 <= 24_000 else max(1, n * 24_000 // (n * 2500))
    assert sorted(r.ord for r in relational.even_sample(c).collect()) == sorted({int(i * n / keep) for i in range(keep)})


def test_access_and_roles(spark):
    df = spark.createDataFrame([(" Viewer ",), ("EDITOR",), ("none",), ("admin",), (None,)], "r string")
    assert [x[0] for x in df.select(relational.share_role(F.col("r"))).collect()] == ["viewer", "editor", "none", None, None]
    s = spark.createDataFrame([("/a", ), ("//evil", ), ("http://x", ), ("/a\\b", ), (None,)], "p string")
    assert [x[0] for x in s.select(relational.safe_next(F.col("p"))).collect()] == [True, False, False, False, False]


EVENTS = "user_id int, ts timestamp, event_type string, value double"


def test_streams_chunk_new_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", "a.md"), (2, "other text", "b.md")], "doc_id bigint, text string, filename string")
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    docs.limit(1).write.parquet(src)
    for n in (1, 2, 2):
        ingest.ingest(ingest.document_stream(spark, src, docs.schema), out, check).awaitTermination()
        assert spark.read.parquet(out).count() == n
        if n == 1:
            docs.where("doc_id = 2").write.mode("append").parquet(src)


def test_stream_limits_are_exact(spark, tmp_path):
    hits = [0, 1, 2, 3, 11, 12, 13, 30]
    rows = [(1, T0 + timedelta(seconds=s), "click", 1.0) for s in hits]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(src)
    s = ingest.limited(spark.readStream.schema(EVENTS).parquet(src), "user_id", "ts", 10, 2)
    q = s.writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    live, want = [], {}
    for t in hits:
        live = [h for h in live if h >= t - 10]
        want[t] = len(live) < 2
        if want[t]:
            live.append(t)
    got = {int((r["at"] - T0).total_seconds()): (r.allowed, r.retry_after) for r in spark.table("limits").collect()}
    assert {k: v[0] for k, v in got.items()} == want and got[2][1] == 9


def test_limits_of_tables_match_a_live_limiter(spark):
    r = random.Random(7)
    rows, want = [], {}
    for k in range(4):
        live, t = [], 0
        for i in range(120):
            t += r.choice([0, 1, 2, 9, 30])
            live = [h for h in live if h >= t - 10]
            want[k, i] = len(live) < 3
            if want[k, i]:
                live.append(t)
            rows.append((k, i, T0 + timedelta(seconds=t)))
    df = spark.createDataFrame(rows + [(None, 1, T0), (9, 2, None)], "k int, i int, at timestamp").repartition(7)
    got = {(x.k, x.i): x.allowed for x in ingest.limited_table(df, "k", "at", "i", 10, 3).collect()}
    assert got == want
    assert ingest.limited_table(df.limit(0), "k", "at", "i", 10, 3).count() == 0


def test_stream_windows_match_the_table(spark, tmp_path):
    rows = [(i % 3, T0 + timedelta(minutes=7 * i), "click", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, EVENTS)
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    want = {tuple(r) for r in ingest.windowed(df, "ts", ["event_type"], "1 hour").collect()}
    s = ingest.windowed(spark.readStream.schema(EVENTS).parquet(src), "ts", ["event_type"], "1 hour")
    q = s.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("windows").collect()} == want
    assert ingest.sessions(df, "ts", "user_id", "30 minutes").count() == 3


def test_cache_of_sessions(spark):
    at = [0, 10, 29, 31, 40, 100, 101]
    df = spark.createDataFrame([("k", T0 + timedelta(seconds=s), T0 + timedelta(seconds=101)) for s in at], "k string, at timestamp, ends timestamp")
    got = {int((r["at"] - T0).total_seconds()): r.hit for r in relational.from_cache(df.withColumn("n", F.unix_seconds("at")), "k", "at", "n", "ends").collect()}
    assert got == {0: False, 10: True, 29: True, 31: False, 40: True, 100: False, 101: False}


def test_mean_pooling():
    v = vectors.mean_pooled(np.array([[[1.0, 0], [0, 1], [9, 9]], [[0, 0], [0, 0], [0, 0]]]), np.array([[1, 1, 0], [0, 0, 0]]))
    assert np.allclose(v, [[0.5**0.5, 0.5**0.5], [0, 0]])


def test_trigrams_are_hashed_as_xxhash_does():
    import xxhash

    from kgspark.functions.text import fold

    r = random.Random(5)
    texts = ["", "  ", "a", "é", "日本語 text", "\x00", "...", *("".join(r.choice("abc de.,É日Ж𝔸") for _ in range(r.randint(0, 60))) for _ in range(50))]
    want = np.zeros((len(texts), vectors.DIMENSIONS), np.float32)
    for i, t in enumerate(texts):
        s = f" {fold(t)} "
        for j in range(len(s) - 2):
            h = xxhash.xxh32_intdigest(s[j : j + 3])
            want[i, h % vectors.DIMENSIONS] += 1.0 if h & 1 << 31 else -1.0
        want[i] /= np.linalg.norm(want[i]) or 1
    assert (vectors.hashing_embedder(texts) == want).all()


def test_small_scopes_are_near_as_a_whole(spark):
    rows = vectors.embedded(spark.createDataFrame([(s, f"{s}{i}", t) for s, n in (("a", 2), ("b", 5), ("c", 3)) for i, t in enumerate(["", "one two", "two", "three", "four"][:n])], "s string, vec_id string, text string"))
    q = spark.createDataFrame([(1, "a", "two"), (2, "b", "two"), (3, "c", ""), (4, "d", "two"), (5, "c", "one")], "query int, s string, text string")
    want = vectors.nearest(vectors.embedded(q), rows, 3, ["s"]).select("query", "vec_id", "s")
    got = vectors.nearest_to_texts(q, rows, 3, ["s"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 6
