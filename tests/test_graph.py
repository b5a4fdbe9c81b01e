import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.functions.text import ratio_of
from kgspark.inventory import letter_embedder
from kgspark.operators import canvas, conceptmap, graph, resolution, triples
from kgspark.plans import extract
from kgspark.plans.workspace import Workspace, is_scoped

ENT = "workspace_id string, id string, name string, canonical_name string, type string, documents array<string>, color string, notes string, user_edited boolean"
EDGE = "src string, type string, dst string, confidence double, color string, user_edited boolean"


def entities(spark, *rows):
    return spark.createDataFrame([("w", i, i.upper(), i, "concept", d, None, None, False) for i, d in rows], ENT)


def edges(spark, *rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], EDGE)


def triple_frame(spark, rows):
    s = "workspace_id string, document_id string, chunk_id string, seq bigint, subject string, predicate string, object string, subject_type string, object_type string, confidence double"
    return spark.createDataFrame([("w", "d", f"c{i}", i, s_, p, o, None, None, c) for i, (s_, p, o, c) in enumerate(rows)], s)


def test_clean_triples(spark):
    t = triple_frame(spark, [("The\nGraph", "uses", "Node", 0.52), ("graph", "Uses", "node", 0.94), ("x", "uses", "Node", 1.0), ("Self", "is", "self!", 1.0), (None, "is", "Node", 1.0), ("A Node", "uses", "Edge", 0.5)])
    assert {(r.subject, r.object, r.confidence) for r in triples.clean_triples(t).collect()} == {("graph", "node", 0.94), ("Node", "Edge", 0.5)}


def test_upsert(spark):
    g = triples.graph_of_triples(triple_frame(spark, [("Neo4j", "Depends On", "Java", 0.5), ("neo4j", "depends on", "JAVA", 0.9), ("!!", "x", "Java", 1.0)]))
    assert {(r.id, r.name) for r in g.entities.collect()} == {("w:concept:neo4j", "Neo4j"), ("w:concept:java", "Java")}
    assert [(r.type, r.confidence) for r in g.edges.collect()] == [("depends_on", 0.9)]
    assert g.edge_chunks.count() == 2 and g.mentions.count() == 4 and g.entity_documents.count() == 2
    assert [r.confidence for r in triples.merge_edges(g.edges, g.edges.withColumn("confidence", F.lit(0.95))).collect()] == [0.95]


def test_extractors_fail_alone(spark):
    @extract.register("broken")
    class Broken(extract.Extractor):
        def extract(self, text):
            if "bad" in text:
                raise ValueError("bad")
            return [("A", "is_a", "B", "concept", "concept", 1.0)]

    c = spark.createDataFrame([("w", 1, "c1", 0, "fine"), ("w", 1, "c2", 1, "bad")], "workspace_id string, document_id bigint, chunk_id string, ord int, text string")
    got = {r.chunk_id: (r.subject, r.error) for r in extract.run(c, "broken").collect()}
    assert got == {"c1": ("A", None), "c2": (None, "ValueError: bad")}


def test_reads(spark):
    n = entities(spark, ("a", ["A"]), ("b", ["A", "B"]), ("c", []), ("d", None))
    e = edges(spark, ("a", "r", "b", 0.9), ("b", "r", "a", None), ("a", "r", "a", 0.1), ("c", "r", "zz", 1.0))
    assert {r.id: r.degree for r in graph.degree(n, e).collect()} == {"a": 3, "b": 2, "c": 1, "d": 0}
    assert {r.id for r in graph.in_document(n, "B").collect()} == {"b", "c", "d"}
    assert graph.in_document(n, None).count() == 4
    assert graph.attached(e, n).count() == 3 and graph.trusted(e, 0.5).count() == 2
    assert {r.id for r in graph.neighbourhood(e, n.where("id = 'b'")).collect()} == {"a", "b"}
    assert graph.one_hop(e, n.where("id = 'a'")).count() == 3


def test_edits(spark):
    n, e = entities(spark, ("a", ["A"]), ("b", ["A", "B"])), edges(spark, ("a", "r", "b", 0.9))
    made = graph.create_entity(n, "w", "New Thing", "tool", "#fff", None)
    assert made.where("id = 'w:tool:new thing' and user_edited").count() == 1 and made.count() == 3
    again = graph.create_entity(made, "w", "New  thing", "tool", None, "n")
    assert [tuple(r) for r in again.where("type = 'tool'").select("name", "color", "notes").collect()] == [("New  thing", None, "n")]
    upd = graph.update_entity(n, "a", name="Álpha", color=None, secret="x")
    assert tuple(upd.where("id = 'a'").select("name", "canonical_name", "user_edited").first()) == ("Álpha", "alpha", True)
    assert graph.update_entity(n, "a", secret="x") is n
    assert graph.upsert_edge(e, n, "a", "Links To", "b").count() == 2 and graph.upsert_edge(e, n, "a", "r", "zz").count() == 1
    r = graph.upsert_edge(e, n, "a", "r", "b", "#000").first()
    assert (r.confidence, r.color, r.user_edited) == (0.9, "#000", True)
    assert graph.set_edge_color(e, "a", "r", "b", "#1").first().color == "#1" and graph.delete_edge(e, "a", "r", "b").count() == 0
    cn, ce = graph.confirm(n, e, n.where("id = 'b'"))
    assert cn.where("user_edited").count() == 1 and ce.where("user_edited").count() == 1
    m = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    assert [x.count() for x in graph.delete_entities(n, e, m, n.where("id = 'a'"))] == [1, 0, 1]


def test_delete_documents(spark):
    n = entities(spark, ("a", ["A"]), ("b", ["A", "B"]), ("c", []), ("d", None), ("e", ["A", "B", "C"]))
    gone = spark.createDataFrame([("A",), ("A",), ("B",)], "document_id string")
    got = {r.id: r.documents for r in graph.delete_documents(n, gone).collect()}
    assert got == {"c": [], "d": None, "e": ["C"]}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(80)]
    links = [(r.choice(ids), "r", r.choice(ids), 1.0) for _ in range(50)]
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, _, b, _ in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = canvas.components(entities(spark, *[(i, None) for i in ids]), edges(spark, *links))
    assert {x.id: x.component for x in got.collect()} == {i: root(i) for i in ids}


def test_levels_and_places(spark):
    n = entities(spark, *[(i, None) for i in "abcdxyz"])
    e = edges(spark, ("a", "r", "b", 1.0), ("b", "r", "c", 1.0), ("a", "r", "c", 1.0), ("c", "r", "b", 1.0), ("x", "r", "y", 1.0), ("y", "r", "x", 1.0), ("d", "r", "d", 1.0))
    assert {r.id: r.depth for r in canvas.levels(n, e).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0, "x": 0, "y": 1, "z": 0}
    at = canvas.layered(n, e).collect()
    assert len({(r.x, r.y) for r in at}) == 7 and {r.y for r in at if r.depth == 0} == {0.0}
    assert {r.id: r["size"] for r in canvas.node_sizes(n, e).collect()}["z"] == 17


def test_shelves_do_not_overlap(spark):
    r = random.Random(4)
    b = spark.createDataFrame([("c", i, r.randrange(10, 400), r.randrange(10, 300)) for i in range(40)], "canvas string, box int, w int, h int")
    t = canvas.shelf_pack(b).collect()
    for p in t:
        for q in t:
            assert p.box == q.box or p.x + p.w <= q.x or q.x + q.w <= p.x or p.y + p.h <= q.y or q.y + q.h <= p.y


def test_string_pairs_miss_none(spark):
    r = random.Random(6)
    names = set()
    while len(names) < 120:
        base = "".join(r.choices("abcdefgh ", k=r.randrange(4, 22))).strip()
        if base:
            names.add(" ".join(base.split()))
            i = r.randrange(len(base))
            names.add(" ".join((base[:i] + r.choice("xy ") + base[i:]).split()))
    names = sorted(names)
    rows = [("w", f"e{i:03d}", n, n, r.choice(["concept", None]), None, None, None, False) for i, n in enumerate(names)] + [("w", "zed", names[0], names[0], "concept", None, None, None, True), ("w", "dup", names[1], names[1], None, None, None, None, False)]
    df = spark.createDataFrame(rows, ENT)
    live = [(x[1], x[3]) for x in rows if not x[8]]
    want = {
        tuple(sorted((a, b)))
        for i, (a, x) in enumerate(live)
        for b, y in live[i + 1 :]
        if (x == y if min(len(x), len(y)) < 5 else ratio_of(x, y) >= 88)
    }
    assert {(p.id_a, p.id_b) for p in resolution.string_pairs(df).collect()} == want and len(want) > 20


def test_merge(spark):
    n = entities(spark, ("a", None), ("bb", None), ("c", None), ("d", None))
    e = edges(spark, ("a", "r", "c", 0.5), ("bb", "r", "c", 0.9), ("a", "r", "bb", 1.0))
    pairs = spark.createDataFrame([("a", "bb")], "id_a string, id_b string")
    s = resolution.survivors(n, e, pairs)
    assert [tuple(r) for r in s.collect()] == [("a", "bb")]
    assert {tuple(r) for r in resolution.redirected(e, s, keep_loops=False).collect()} == {("bb", "r", "c", 0.9)}
    assert resolution.redirected(e, s).count() == 2


def test_tiers_and_judges(spark):
    p = spark.createDataFrame([("b", "x", "y", 0.95, "pc", "pcs"), ("b", "x", "z", 0.6, "cat", "dog"), ("b", "y", "z", 0.1, "pc", "personal computer"), ("b", "u", "v", 0.1, "aa", "bb")], "block string, id_a string, id_b string, score double, name_a string, name_b string")
    got = [r[0] for r in p.select(resolution.tier(F.col("score"), F.col("name_a"), F.col("name_b"))).collect()]
    assert got == ["merge", "ask", "ask", None]
    assert resolution.asked(p, 2).count() == 2
    assert not resolution.adjudicated(p).where("verdict").count()
    assert resolution.adjudicated(p, lambda x: [a == "cat" for a, _ in x]).where("verdict").count() == 1

    def fails(x):
        raise OSError

    assert not resolution.adjudicated(p, fails).where("verdict").count()


CONCEPT = "document_id string, seq int, name string, importance string, one_liner string, quote string, requires array<string>, how_it_works array<string>, strengths array<string>, limitations array<string>, when_to_use array<string>, examples array<string>"


def concepts(spark, *rows):
    return spark.createDataFrame([("d", i, n, imp, None, None, req, ["h"] * k, None, None, None, None) for i, (n, imp, req, k) in enumerate(rows)], CONCEPT)


def test_concept_map(spark):
    k = conceptmap.folded(concepts(spark, ("Batch (mode)", None, [], 1), ("batch", "core", ["Ghost", "Detail", "Other"], 2), ("Detail", "supporting", ["Batch", "detail"], 0), ("Other", "core", [], 0), ("!!", "core", [], 0)), cap=3)
    assert {(r.key, r.importance) for r in k.collect()} == {("batch", "core"), ("detail", "supporting"), ("other", "core")}
    assert {(r.key, r.need) for r in conceptmap.requirements(k).collect()} == {("batch", "other"), ("detail", "batch")}
    assert conceptmap.folded(concepts(spark, *[(f"c{i}", "core" if i == 9 else None, [], 0) for i in range(10)]), cap=2).where("key = 'c9'").count() == 1
    links = spark.createDataFrame([("d", 0, "BATCH", "Detail", "uses", None), ("d", 1, "batch mode", "detail", "Uses", None), ("d", 2, "Batch", "Detail", "related to", None), ("d", 3, "Batch", "Batch", "is", None), ("d", 4, "Batch", "Nope", "is", None)], "document_id string, seq int, source string, target string, relation string, why string")
    assert [(r.source, r.target, r.relation) for r in conceptmap.tidy_links(links, k).collect()] == [("Batch", "Detail", "uses")]
    cs = spark.createDataFrame([("d", 0, "speed", {"Batch": "slow", "other": "fast"}), ("d", 1, "one", {"Batch": "x"}), ("d", 2, " ", {"Batch": "x", "Other": "y"})], "document_id string, seq int, dimension string, values map<string,string>")
    assert [(r.dimension, r["values"]) for r in conceptmap.tidy_contrasts(cs, k).collect()] == [("speed", {"Batch": "slow", "Other": "fast"})]


def test_items_that_normalise_alike_are_one(spark):
    rows = [("d", 0, "Batch", None, None, None, ["a", None], ["Fast", "fast", " Fast! ", "", "Größe"], None, None, None, None), ("d", 1, "batch", None, None, None, ["A.", "b"], ["GROSSE", "grösse", "slow"], None, None, None, None)]
    k = conceptmap.folded(spark.createDataFrame(rows, CONCEPT)).first()
    assert k.how_it_works == ["Fast", "Größe", "slow"] and k.requires == ["a", "b"] and k.weight == 3


def test_maps_are_written_to_the_graph(spark):
    k = conceptmap.folded(concepts(spark, ("Alpha", "core", ["Beta"], 1), ("Beta", "core", [], 0), ("Gamma", None, [], 0)))
    k = k.withColumn("quote", F.when(F.col("key") == "alpha", "alpha is\nfirst"))
    links = spark.createDataFrame([("d", 0, "ALPHA", "beta", "Leads To", "w"), ("d", 1, "Beta", "Nope", "is", None)], "document_id string, seq int, source string, target string, relation string, why string")
    docs = spark.createDataFrame([("w", "d", 1, "greek", None)], "workspace_id string, document_id string, seq int, teaches string, contrasts string")
    c = spark.createDataFrame([("d", "c0", 0, "say alpha is first here")], "document_id string, chunk_id string, ord int, text string")
    t = conceptmap.map_tables(k, conceptmap.tidy_links(links, k), conceptmap.without_cycles(conceptmap.requirements(k), k), docs, c)
    assert {(r.id, r.type) for r in t.entities.collect()} == {(f"w:concept:{x}", "concept") for x in ("alpha", "beta", "gamma")}
    assert [(r.entity_id, r.chunk_id, [tuple(x) for x in r.spans]) for r in t.mentions.collect()] == [("w:concept:alpha", "c0", [(4, 18)])]
    assert [(r.src, r.type, r.dst, r.why, r.prerequisite, r.confidence) for r in t.edges.collect()] == [("w:concept:alpha", "Leads To", "w:concept:beta", "w", True, 0.9)]
    assert t.documents.first().teaches == "greek" and t.entity_documents.count() == 3


def test_sectioned_maps_are_consolidated(spark):
    c = concepts(spark, *[(f"Topic {i}", None, [], 0) for i in range(16)])
    links = spark.createDataFrame([("d", "Topic 3", "topic 9")], "document_id string, source string, target string")

    def told(names):
        return [{"name": "Topic 0", "from": [n for n in names if n != "Topic 9"]}, {"name": "Topic 9", "importance": "core", "requires": ["Topic 3"]}]

    kept, l = conceptmap.consolidated(c, links, told)
    assert {(r.name, r.importance, tuple(r.requires)) for r in kept.collect()} == {("Topic 0", None, ()), ("Topic 9", "core", ("Topic 3",))}
    assert [tuple(r) for r in l.collect()] == [("d", "Topic 0", "Topic 9")]

    def fails(names):
        raise OSError

    kept, l = conceptmap.consolidated(c, links, fails)
    assert kept.count() == 14 and l.count() == 1
    assert conceptmap.consolidated(c.where("seq < 5"), links, fails)[0].count() == 5


def test_a_deleted_document_takes_all_that_hangs_on_it(spark):
    t = {
        "documents": spark.createDataFrame([("w", 1), ("w", 2), ("v", 1), (None, 1)], "workspace_id string, doc_id int"),
        "chunks": spark.createDataFrame([("w", 1, "a"), ("v", 1, "b")], "workspace_id string, document_id int, chunk_id string"),
        "entities": spark.createDataFrame([("w", "x", ["1"]), ("w", "y", ["1", "2"]), ("w", "z", None), ("v", "x", ["1"]), ("w", "e", [])], "workspace_id string, id string, documents array<string>"),
        "mentions": spark.createDataFrame([("w", "x", 1), ("w", "y", 2), ("v", "x", 1)], "workspace_id string, entity_id string, document_id int"),
        "edges": spark.createDataFrame([("w", "x", "y"), ("w", "y", "z"), ("v", "x", "x")], "workspace_id string, src string, dst string"),
    }
    left = graph.delete_document_subgraph(t, spark.createDataFrame([("w", 1)], "workspace_id string, document_id int"))
    rows = {k: sorted((tuple(r) for r in v.collect()), key=str) for k, v in left.items()}
    assert rows["documents"] == [("v", 1), ("w", 2), (None, 1)] or set(rows["documents"]) == {("v", 1), ("w", 2), (None, 1)}
    assert rows["chunks"] == [("v", 1, "b")] and rows["mentions"] == [("v", "x", 1), ("w", "y", 2)]
    assert rows["entities"] == sorted([("v", "x", ["1"]), ("w", "e", []), ("w", "y", ["2"]), ("w", "z", None)], key=str)
    assert rows["edges"] == [("v", "x", "x"), ("w", "y", "z")]


def test_mentions_follow_their_entity(spark):
    m = spark.createDataFrame([("w", "a", "d", "c", [(1, 2)]), ("w", "b", "d", "c", [(0, 1), (1, 2)]), ("w", "b", "d", "e", None)], "workspace_id string, entity_id string, document_id string, chunk_id string, spans array<struct<start:int,end:int>>")
    r = spark.createDataFrame([("b", "a")], "id string, survivor string")
    got = {(x.entity_id, x.chunk_id): [tuple(s) for s in x.spans] for x in resolution.redirected_mentions(m, r).collect()}
    assert got == {("a", "c"): [(0, 1), (1, 2)], ("a", "e"): []}
    assert triples.merge_mentions(m, m).count() == 3


def test_a_long_chain_has_all_its_levels(spark, monkeypatch):
    monkeypatch.setattr(canvas, "MOST_TABLES", 3)
    n = entities(spark, *[(f"n{i:03d}", None) for i in range(30)])
    e = edges(spark, *[(f"n{i:03d}", "r", f"n{i + 1:03d}", 1.0) for i in range(29)])
    assert {r.id: r.depth for r in canvas.levels(n, e).collect()} == {f"n{i:03d}": i for i in range(30)}


def test_cycles(spark):
    k = conceptmap.folded(concepts(spark, ("a", "core", ["b"], 3), ("b", "core", ["c"], 2), ("c", "core", ["a"], 1), ("s", "core", ["s", "a"], 0)))
    kept = {(r.key, r.need) for r in conceptmap.without_cycles(conceptmap.requirements(k), k).collect()}
    assert kept == {("a", "b"), ("b", "c"), ("s", "a")}


def test_grounding(spark):
    c = spark.createDataFrame([("d", "c0", 0, "zero  one two three"), ("d", "c1", 1, "zero one two three four five six"), ("x", "c9", 0, "one two three four five six")], "document_id string, chunk_id string, ord int, text string")
    q = spark.createDataFrame([("d", "a", "one two\nthree"), ("d", "b", "one two three four five six seven"), ("d", "c", "one two no"), ("d", "e", ""), ("d", "f", None)], "document_id string, key string, quote string")
    got = {r.key: (r.chunk_id, r.start, r.end) for r in conceptmap.grounded(q, c).collect()}
    assert got == {"a": ("c0", 5, 18), "b": ("c1", 5, 32)}


def test_prerequisite_edges(spark):
    l = spark.createDataFrame([("d", 0, "a", "b", "uses", None), ("d", 1, "a", "b", "is", None), ("d", 2, "b", "c", "is", None)], "document_id string, seq int, src string, dst string, type string, why string")
    n = spark.createDataFrame([("d", "a", "b"), ("d", "c", "a")], "document_id string, src string, dst string")
    assert {(r.src, r.type, r.dst, r.prerequisite) for r in conceptmap.prerequisite_edges(l, n).collect()} == {("a", "uses", "b", False), ("a", "is", "b", True), ("b", "is", "c", False), ("c", "requires", "a", True)}


def test_sections(spark):
    df = spark.createDataFrame([(1, "# A\n" + "x " * 20 + "\n# B\n" + "y " * 20 + "\n# C\nz", 0)], "doc_id int, text string, section int")
    assert [r.section for r in conceptmap.sections(df, 12).orderBy("section").collect()] == [0, 1]


def test_workspaces_are_scoped(spark):
    w = Workspace(spark, "/root/testdata/sf0.001", "some-id")
    for t in ("entities", "chunks", "documents"):
        assert is_scoped(w.table(t), "some-id") and w.table(t).count() == 0
    assert is_scoped(w.entities, "some-id")
    with pytest.raises(ValueError):
        w.table("nation")


def test_the_whole_typed_graph_is_searched(spark):
    from kgspark import queries as Q
    from kgspark import inventory_edits as QE

    d = "/root/testdata/sf0.001"
    n, e = Q.typed_graph(spark, d)
    ids, links = {r.id for r in n.collect()}, {(r.src, r.dst) for r in e.collect()}
    assert any(i.startswith("p:") for i in ids)
    near, ahead = {i: set() for i in ids}, {i: set() for i in ids}
    for a, b in links:
        near[a].add(b), near[b].add(a), ahead[a].add(b)

    def reach(start, steps):
        at, front, k = dict.fromkeys(start, 0), set(start), 0
        while front:
            k += 1
            front = {y for x in front for y in steps[x]} - set(at)
            at.update(dict.fromkeys(front, k))
        return at

    comp = {}
    for i in sorted(ids):
        if i not in comp:
            comp.update(dict.fromkeys(reach([i], near), i))
    assert {r.id: r.component for r in QE.graph_components(spark, d).collect()} == comp
    roots = ids - {b for _, b in links}
    rooted = {comp[i] for i in roots}
    depth = reach(roots | {i for i in ids if comp[i] == i and i not in rooted}, ahead)
    assert set(depth) == ids and {r.id: r.depth for r in QE.graph_levels(spark, d).collect()} == depth
    at = QE.layered_positions(spark, d).collect()
    assert {r.id: r.depth for r in at} == depth and len({(r.x, r.y) for r in at}) == len(ids)


def test_levels_have_no_limit_of_rounds():
    """By its signature only; a chain of more than 500 nodes takes too long here."""
    import inspect

    assert list(inspect.signature(canvas.levels).parameters) == ["nodes", "edges"]


@pytest.mark.parametrize("tile_rows", [3, 2000])
def test_best_pairs_are_the_first_of_all_pairs(spark, tile_rows):
    r = random.Random(3)
    rows = [(b, f"{b}{r.randrange(25)}", "".join(r.choice("abcd") for _ in range(r.randint(1, 9)))) for b in "xy" for _ in range(40)]
    rows = sorted({*rows, ("z", "z1", "ab"), ("z", "z2", "ac")})
    named = spark.createDataFrame(rows, "block string, id string, name string")
    every = resolution.vector_pairs(named, letter_embedder, 0.55, tile_rows)
    v = {n: letter_embedder([n])[0].astype(float) for _, _, n in rows}
    cos = lambda a, b: v[a] @ v[b] / np.sqrt((v[a] @ v[a]) * (v[b] @ v[b]))
    want = {(i, n, j, m) for b, i, n in rows for c, j, m in rows if b == c and (i, n) < (j, m) and cos(n, m) >= 0.55 + 1e-9}
    assert want <= {(x.id_a, x.name_a, x.id_b, x.name_b) for x in every.collect()}
    own = every.where("id_a <> id_b").groupBy("block", "id_a", "id_b").agg(F.max(F.round("score", 6)).alias("score")).where("score < 0.9")
    got = resolution.best_pairs(named, letter_embedder, 0.55, most=7, tile_rows=tile_rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, resolution.asked(own, 7).select("block", "id_a", "id_b", "score").collect()))
    assert {b: sum(x.block == b for x in got.collect()) for b in "xy"} == {"x": 7, "y": 7}


def test_rounding_is_sparks(spark):
    c = np.array([0.5546875, 0.0078125, -0.0078125, 0.1234565, 0.12345649999999, 1.0, 0.9 - 5e-7, 71 / 128 + 1e-16])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(c)], "i int, x double").select(F.round("x", 6)).orderBy("i")
    want = [x[0] for x in df.collect()]
    assert [w for w, x in zip(want, c) if x > 0] == [g for g, x in zip(resolution.rounded(c).tolist(), c) if x > 0]


def test_acronyms_are_met_once_without_a_shuffle_of_pairs(spark):
    rows = [("x", "1", "large ring"), ("x", "2", "LR"), ("x", "3", "lrs"), ("x", "4", "l r"), ("x", "5", "L. R."), ("x", "6", "ring"), ("y", "2", "LR"), ("y", "1", "long road"), ("y", "7", "lr"), ("x", "7", "LR"), ("x", "7", "l r"), ("x", "2", "LR"), ("y", "8", None)]
    named = spark.createDataFrame(rows, "block string, id string, name string")
    pairs = [tuple(r) for r in resolution.acronym_pairs(named).select("block", "id_a", "name_a", "id_b", "name_b").collect()]
    norm = lambda n: "".join(c if c.isalnum() else " " for c in n.lower()).split()
    stands = lambda a, b: len(b) > 1 and "".join(w[0] for w in b) in {"".join(a), "".join(a).rstrip("s")}
    own = sorted({r for r in rows if r[2]})
    want = [(b, i, n, j, m) for b, i, n in own for c, j, m in own if b == c and i < j and (stands(norm(n), norm(m)) or stands(norm(m), norm(n)))]
    assert sorted(pairs) == sorted(want) and len(want) > 12
    ids = resolution.acronym_ids(named)
    assert sorted(map(tuple, ids.collect())) == sorted({(i, j) for _, i, _, j, _ in want})
    plan = resolution.acronym_pairs(named)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]  # nothing is made distinct after the join


@pytest.mark.parametrize("tile_rows", [3, 2000])
def test_named_pairs_are_grouped_pairs(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(resolution, "PART_ROWS", 4)
    r = random.Random(4)
    rows = sorted({(b, f"{r.choice('xyzw')}{r.randrange(9)}", "".join(r.choice("abcd") for _ in range(r.randint(1, 9)))) for b in "xyz" for _ in range(40)})
    named = spark.createDataFrame(rows, "block string, id string, name string")
    every = resolution.vector_pairs(named, letter_embedder, 0.55, tile_rows).where("id_a <> id_b and score < 0.9")
    want = every.groupBy("id_a", "id_b").agg(F.max("name_a").alias("name_a"), F.max("name_b").alias("name_b")).select("id_a", "name_a", "id_b", "name_b")
    got = resolution.named_pairs(named, letter_embedder, 0.55, 0.9, tile_rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 200


def test_pairs_of_tiles_are_handed_over_in_parts():
    import pyarrow as pa

    rows = [("b", f"i{k:04d}", "a", 0, 0, 0, [1.0, 0.0]) for k in range(600)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("block", "id", "name", "_t", "_low", "_high", "embedding"), x)) for x in rows])

    class Tiles:
        def groupBy(self, *_):
            return self

        def applyInArrow(self, score, schema):
            return list(score(iter([batch])))

    with pytest.MonkeyPatch.context() as m:
        m.setattr(resolution, "_tiles", lambda *_: Tiles())
        m.setattr(Tiles, "select", lambda self, *_: self, raising=False)
        parts = resolution.vector_pairs(Tiles(), None, 0.5)
    assert sum(map(len, parts)) == 600 * 599 // 2 and max(map(len, parts)) <= resolution.PART_PAIRS


def test_judged_pairs_wait_in_no_queue(spark):
    p = spark.createDataFrame([(i, "a" * (i % 3 + 1), None if i == 5 else "a") for i in range(9)], "i int, name_a string, name_b string")
    said = resolution.adjudicated(p, lambda pairs: [x == y for x, y in pairs])
    assert {r.i for r in said.where("verdict").collect()} == {0, 3, 6} and said.count() == 9
    assert "ArrowEvalPython" not in said._jdf.queryExecution().executedPlan().toString()
    assert not resolution.adjudicated(p, lambda pairs: 1 / 0).where("verdict").count()
    assert resolution.adjudicated(p, lambda pairs: [True]).where("not verdict").count() >= 5


def test_pairs_get_their_tiers_where_they_are_found(spark):
    import random

    from kgspark.inventory import letter_embedder
    from kgspark.operators import resolution

    r = random.Random(4)
    rows = [(r.choice("vw"), f"n{r.randrange(50):02d}", "".join(r.choice("abcéß𝔸 ｚ") for _ in range(r.randint(1, 9)))) for _ in range(80)]
    named = spark.createDataFrame([*rows, ("w", "x", "aab"), ("w", "y", "abb")], "block string, id string, name string").distinct()
    p = resolution.vector_pairs(named, letter_embedder, 0.55, tile_rows=9).where("abs(score - 0.8) > 1e-9")
    want = p.selectExpr("id_a", "id_b", "least(name_a, name_b)", "greatest(name_a, name_b)", "round(score, 6)", "if(score >= 0.8, 'merge', 'ask')")
    got = resolution.tiered_pairs(named, letter_embedder, 0.55, 0.8, tile_rows=9)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and {x.tier for x in got.collect()} == {"ask", "merge"}
