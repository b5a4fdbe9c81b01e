"""Making a document's concept map consistent, and grounding its quotes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.functions.text import normalize, normalized_list, short_name
from kgspark.operators.triples import EXTRACTED, entity_id
from kgspark.plans.scratch import Scratch

MOST_CONCEPTS, SECTION_CAP = 14, 28
# Relations that say nothing, and the list fields of a concept.
VAGUE = ("related_to", "related to", "associated with", "relates to", "linked to")
LISTS = ("how_it_works", "strengths", "limitations", "when_to_use", "examples")


def _merged_list(c: str):
    """All items of a group's lists in order, the first spelling of each normalised form; `c` and `c`_norm are alike."""
    pairs = F.arrays_zip(F.col(c).alias("v"), F.col(f"_n_{c}").alias("n"))
    seen = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", pairs.alias("p")))), lambda x: x["p"]))
    numbered = F.transform(seen, lambda x, i: F.struct(x["v"].alias("v"), x["n"].alias("n"), i.alias("i")))
    told = F.filter(numbered, lambda x: x["n"] != "")
    first = F.filter(told, lambda x: ~F.exists(told, lambda y: (y["n"] == x["n"]) & (y["i"] < x["i"])))
    return F.transform(first, lambda x: F.trim(x["v"]))


def folded(concepts: DataFrame, cap: int = MOST_CONCEPTS) -> DataFrame:
    """One row for each concept of a document after shortening names: the core ones first, then those with most said
    about them, cap of them. Concepts: document_id, seq, name, importance, one_liner, quote, requires and LISTS.

    A document's concepts are what one reading of it yields, so its group is small."""
    c = concepts.withColumn("original", normalize(F.col("name"))).withColumn("name", short_name(F.col("name"))).withColumn("key", normalize(F.col("name")))
    c = c.where("key <> ''")
    for x in ("requires", *LISTS):
        c = c.withColumn(x, F.coalesce(x, F.array().cast("array<string>"))).withColumn(f"_n_{x}", normalized_list(F.col(x)))
    blank = lambda x: F.nullif(F.col(x), F.lit(""))
    one = c.groupBy("document_id", "key").agg(
        F.min_by("name", "seq").alias("name"),
        F.min("seq").alias("_first"),
        F.when(F.bool_or(F.col("importance") == "core"), "core").otherwise(F.min_by("importance", "seq")).alias("importance"),
        F.min_by(blank("one_liner"), F.when(blank("one_liner").isNotNull(), F.col("seq"))).alias("one_liner"),
        F.min_by(blank("quote"), F.when(blank("quote").isNotNull(), F.col("seq"))).alias("quote"),
        F.collect_set("original").alias("aliases"),
        *[_merged_list(x).alias(x) for x in ("requires", *LISTS)],
    )
    one = one.withColumnRenamed("_first", "seq")
    weight = sum((F.size(x) for x in LISTS[1:]), F.size(LISTS[0]))
    w = Window.partitionBy("document_id").orderBy(F.desc(F.col("importance") == "core"), F.desc("weight"), "seq")
    return one.withColumn("weight", weight).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def _alias(kept: DataFrame) -> DataFrame:
    names = kept.select("document_id", "key", "name", "importance", F.explode(F.array_union("aliases", F.array("key"))).alias("alias"))
    return names.dropDuplicates(["document_id", "alias"])


def requirements(kept: DataFrame) -> DataFrame:
    """(document_id, key, need, pos): what each concept requires, on the map, not itself, and no core one a supporting one."""
    asked = kept.select("document_id", F.col("key").alias("k"), F.col("importance").alias("imp"), F.posexplode("requires").alias("pos", "raw")).withColumn("alias", normalize(F.col("raw")))
    a = _alias(kept).select("document_id", "alias", F.col("key").alias("need"), F.col("importance").alias("need_imp"))
    ok = asked.join(a, ["document_id", "alias"]).where((F.col("k") != F.col("need")) & ~((F.col("imp") == "core") & (F.col("need_imp") != "core")))
    return ok.groupBy("document_id", F.col("k").alias("key"), "need").agg(F.min("pos").alias("pos"))


def without_cycles(needs: DataFrame, kept: DataFrame) -> DataFrame:
    """needs without the ones that close a loop, met in the order of the map (rank) and of each concept's list."""
    ordered = needs.join(kept.select("document_id", "key", "rank"), ["document_id", "key"])

    def prune(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["rank", "pos"])
        after: dict[str, list[str]] = {}
        for k, n in zip(df["key"], df["need"]):
            after.setdefault(k, []).append(n)
        state: dict[str, int] = {}
        closing: set[tuple[str, str]] = set()
        for root in after:
            if state.get(root):
                continue
            path = [(root, iter(after[root]))]
            state[root] = 1
            while path:
                at, rest = path[-1]
                n = next(rest, None)
                if n is None:
                    state[at] = 2
                    path.pop()
                elif state.get(n) == 1:
                    closing.add((at, n))
                elif not state.get(n):
                    state[n] = 1
                    path.append((n, iter(after.get(n, ()))))
        keep = [(k, n) not in closing for k, n in zip(df["key"], df["need"])]
        return df.loc[keep, ["document_id", "key", "need", "pos"]]

    kind = ordered.schema["document_id"].dataType.simpleString()
    return ordered.groupBy("document_id").applyInPandas(prune, f"document_id {kind}, key string, need string, pos int")


def tidy_links(links: DataFrame, kept: DataFrame) -> DataFrame:
    """Links between concepts on the map that say something, once each. links: document_id, seq, source, target, relation, why."""
    a = _alias(kept)
    s = a.select("document_id", F.col("alias").alias("s"), F.col("key").alias("skey"), F.col("name").alias("source"))
    t = a.select("document_id", F.col("alias").alias("t"), F.col("key").alias("tkey"), F.col("name").alias("target"))
    own = links.select("document_id", "seq", normalize(F.col("source")).alias("s"), normalize(F.col("target")).alias("t"), F.trim("relation").alias("relation"), "why")
    ok = own.join(s, ["document_id", "s"]).join(t, ["document_id", "t"]).where("skey <> tkey and relation <> ''").where(~F.lower("relation").isin(*VAGUE))
    row = F.struct("seq", "source", "target", "relation", "why")
    one = ok.groupBy("document_id", "skey", "tkey", F.lower("relation").alias("r")).agg(F.min_by(row, "seq").alias("x"))
    return one.select("document_id", "x.*")


def tidy_contrasts(contrasts: DataFrame, kept: DataFrame) -> DataFrame:
    """(document_id, seq, dimension, values): contrasts of two concepts on the map or more. values: map of name to text."""
    a = _alias(kept).select("document_id", "alias", "name")
    long = contrasts.select("document_id", "seq", F.trim("dimension").alias("dimension"), F.explode("values").alias("k", "v")).withColumn("alias", normalize(F.col("k")))
    ok = long.where("dimension <> ''").join(a, ["document_id", "alias"]).dropDuplicates(["document_id", "seq", "name"])
    return ok.groupBy("document_id", "seq", "dimension").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "v")))).alias("values")).where(F.size("values") >= 2)


def grounded(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, key, chunk_id, start, end): where a quote stands, in the first chunk that holds it, else its
    longest beginning of four words or more. Offsets count in the chunk's text with single blanks.

    quotes: document_id, key, quote; chunks: document_id, chunk_id, ord, text. Quotes found nowhere give no row."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    q = quotes.select("document_id", "key", flat(F.col("quote")).alias("q")).where("q <> ''")
    c = chunks.select("document_id", "chunk_id", "ord", flat(F.col("text")).alias("t"))

    def first(parts: DataFrame) -> DataFrame:
        """Of each quote's parts (part, n words) that a chunk holds, the longest in the first chunk."""
        met = parts.join(c, "document_id").withColumn("at", F.instr(F.col("t"), F.col("part"))).where("at > 0")
        where = F.struct("chunk_id", (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length("part")).alias("end"))
        best = met.groupBy("document_id", "key").agg(F.min_by(where, F.struct((-F.col("n")).alias("n"), "ord", "chunk_id")).alias("x"))
        return best.select("document_id", "key", "x.*")

    scratch = Scratch(quotes.sparkSession)
    whole = scratch.save(first(q.select("document_id", "key", F.col("q").alias("part"), F.lit(0).alias("n"))))
    # only quotes that stand nowhere as a whole are tried by their beginnings
    rest = q.join(whole.select("document_id", "key"), ["document_id", "key"], "left_anti").withColumn("w", F.split("q", " "))
    n = F.size("w")
    shorter = rest.where(n > 4).select("document_id", "key", "w", F.explode(F.sequence(n - 1, F.lit(4), F.lit(-1))).alias("n"))
    parts = shorter.select("document_id", "key", F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("part"), "n")
    return whole.unionByName(first(parts))


def prerequisite_edges(links: DataFrame, needs: DataFrame) -> DataFrame:
    """Edges of a map: links as they are, the last one of a pair that is also required being a prerequisite, and one
    `requires` edge for each requirement without a link. links: document_id, seq, src, dst, type, why; needs: document_id, src, dst."""
    w = Window.partitionBy("document_id", "src", "dst").orderBy(F.desc("seq"))
    need = needs.select("document_id", "src", "dst").distinct()
    marked = links.withColumn("_r", F.row_number().over(w)).join(need.withColumn("_n", F.lit(True)), ["document_id", "src", "dst"], "left")
    out = marked.select("document_id", "src", "type", "dst", "why", ((F.col("_r") == 1) & F.coalesce("_n", F.lit(False))).alias("prerequisite"))
    rest = need.join(links.select("document_id", "src", "dst"), ["document_id", "src", "dst"], "left_anti")
    made = rest.select("document_id", "src", F.lit("requires").alias("type"), "dst", F.lit("understand this first").alias("why"), F.lit(True).alias("prerequisite"))
    return out.unionByName(made)


@dataclass
class MapTables:
    """What a concept map adds to a graph."""

    entities: DataFrame
    entity_documents: DataFrame
    mentions: DataFrame
    edges: DataFrame
    documents: DataFrame


def map_tables(kept: DataFrame, links: DataFrame, needs: DataFrame, documents: DataFrame, chunks: DataFrame) -> MapTables:
    """Upsert tables of tidied maps. kept as folded() yields it, links as tidy_links(), needs as without_cycles();
    documents: workspace_id, document_id, seq (the order of writing), teaches, contrasts; chunks as grounded() asks for.

    All entities are concepts; the latest map that names one gives its name and fields. A concept is mentioned where its
    quote is grounded, and nowhere if it is not. Edges keep the relation as it is stated, and those whose ends are not
    on the map vanish."""
    ws = documents.select("document_id", "workspace_id", F.col("seq").alias("_w"))
    node = kept.join(ws, "document_id").withColumn("id", entity_id(F.col("workspace_id"), F.lit("concept"), F.col("key")))
    fields = ["name", "importance", "one_liner", "quote", *LISTS]
    latest = F.max_by(F.struct(*fields), F.struct("_w", "seq")).alias("f")
    entities = node.groupBy("workspace_id", "id", F.col("key").alias("canonical_name")).agg(latest).select("workspace_id", "id", "canonical_name", F.lit("concept").alias("type"), "f.*")
    at = grounded(node.select("document_id", F.col("id").alias("key"), "quote"), chunks)
    mentions = at.join(ws, "document_id").select("workspace_id", F.col("key").alias("entity_id"), "document_id", "chunk_id", F.array(F.struct("start", "end")).alias("spans"))
    ids = node.select("document_id", "key", "id", "workspace_id")
    end = lambda c, to: ids.select("document_id", F.col("key").alias(c), F.col("id").alias(to))
    l = links.withColumn("_s", normalize(F.col("source"))).withColumn("_t", normalize(F.col("target")))
    l = l.join(end("_s", "src"), ["document_id", "_s"]).join(end("_t", "dst"), ["document_id", "_t"]).select("document_id", "seq", "src", "dst", F.col("relation").alias("type"), "why")
    n = needs.join(end("key", "src"), ["document_id", "key"]).join(end("need", "dst"), ["document_id", "need"]).select("document_id", "src", "dst")
    e = prerequisite_edges(l, n).join(ws, "document_id")
    last = F.max_by(F.struct("why", "prerequisite"), F.struct("_w", "prerequisite")).alias("f")
    edges = e.groupBy("workspace_id", "src", "type", "dst").agg(last).select("workspace_id", "src", "type", "dst", "f.*", F.lit(EXTRACTED).alias("confidence"))
    return MapTables(entities, node.select("workspace_id", F.col("id").alias("entity_id"), "document_id").distinct(), mentions, edges, documents.select("workspace_id", "document_id", "teaches", "contrasts"))


def consolidated(concepts: DataFrame, links: DataFrame, consolidate, cap: int = MOST_CONCEPTS) -> tuple[DataFrame, DataFrame]:
    """Concepts (folded at cap) and links of documents whose sections were mapped one by one.

    Where more than cap concepts are left, consolidate(list of names) -> [{name, from: [names], importance, requires}]
    says which of them stay, which are one, and what these require; links follow the new names. If it fails, the first
    cap concepts stay, with all links."""
    first = folded(concepts, SECTION_CAP)
    many = first.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("l")).where(F.size("l") > cap)
    many = many.select("document_id", F.transform("l", lambda x: x["name"]).alias("names"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for d, names in zip(df["document_id"], df["names"]):
                try:
                    for c in consolidate(list(names)):
                        out += [(d, old, c["name"], c.get("importance"), c.get("requires")) for old in {c["name"], *c.get("from", [])}]
                except Exception:  # noqa: BLE001 - the first ones stay
                    out = [x for x in out if x[0] != d]
            yield pd.DataFrame(out, columns=["document_id", "old", "new", "imp", "req"])

    kind = concepts.schema["document_id"].dataType.simpleString()
    scratch = Scratch(concepts.sparkSession)
    told = scratch.save(many.mapInPandas(ask, f"document_id {kind}, old string, new string, imp string, req array<string>"))
    told = told.withColumn("_k", normalize(F.col("old"))).dropDuplicates(["document_id", "_k"]).drop("old")
    done = told.select("document_id").distinct()
    named = concepts.withColumn("_k", normalize(short_name(F.col("name")))).join(told, ["document_id", "_k"])
    named = named.withColumn("name", F.col("new")).withColumn("importance", F.coalesce("imp", "importance")).withColumn("requires", F.coalesce("req", "requires"))
    rest = concepts.join(done, "document_id", "left_anti")
    kept = folded(named.select(*concepts.columns).unionByName(rest.select(*concepts.columns)), cap)
    out = links
    for c in ("source", "target"):
        to = told.select("document_id", F.col("_k").alias("_l"), F.col("new").alias("_n"))
        out = out.withColumn("_l", normalize(short_name(F.col(c)))).join(to, ["document_id", "_l"], "left").withColumn(c, F.coalesce("_n", c)).drop("_l", "_n")
    return kept, out.select(*links.columns)


def sections(docs: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """(document_id, section, text): a document's headed sections, joined while they fit the budget of tokens."""
    from kgspark.operators.chunking import HEADING

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for d, t in zip(df["d"], df["t"]):
                cuts = [0, *(m.start() for m in HEADING.finditer(t) if m.start()), len(t)]
                parts, n = [], 0
                for s in (t[a:b].strip() for a, b in zip(cuts, cuts[1:])):
                    if s:
                        if parts and n + len(s) // 4 <= budget:
                            parts[-1] += "\n\n" + s
                            n += len(s) // 4
                        else:
                            parts.append(s)
                            n = len(s) // 4
                out += [(d, i, s) for i, s in enumerate(parts)]
            yield pd.DataFrame(out, columns=["document_id", "section", "text"])

    own = docs.select(F.col("doc_id").cast("string").alias("d"), F.col(text).alias("t")).where("t is not null")
    return own.mapInPandas(scan, "document_id string, section int, text string")




#: What a mapper's JSON may hold, with the spellings of ends that occur.
MAP_JSON = (
    "teaches string, concepts array<struct<name:string,importance:string,one_liner:string,quote:string,requires:array<string>,"
    "how_it_works:array<string>,strengths:array<string>,limitations:array<string>,when_to_use:array<string>,examples:array<string>>>, "
    "links array<struct<source:string,target:string,`from`:string,`to`:string,relation:string,why:string>>, "
    "contrasts array<struct<dimension:string,values:map<string,string>>>"
)


def parsed_maps(replies: DataFrame) -> dict[str, DataFrame]:
    """concepts, links, contrasts and documents of mappers' JSON replies (document_id, reply). Links need both ends and
    a relation, contrasts values; what does not parse yields nothing."""
    m = replies.select("document_id", F.from_json("reply", MAP_JSON).alias("m"))
    c = m.select("document_id", F.posexplode("m.concepts").alias("seq", "x")).select("document_id", "seq", "x.*").where("name is not null")
    l = m.select("document_id", F.posexplode("m.links").alias("seq", "x"))
    l = l.select("document_id", "seq", F.coalesce("x.source", "x.from").alias("source"), F.coalesce("x.target", "x.to").alias("target"), "x.relation", "x.why")
    t = m.select("document_id", F.posexplode("m.contrasts").alias("seq", "x")).select("document_id", "seq", F.coalesce("x.dimension", F.lit("")).alias("dimension"), "x.values")
    return {
        "documents": m.select("document_id", F.coalesce("m.teaches", F.lit("")).alias("teaches")),
        "concepts": c,
        "links": l.where("source is not null and target is not null and relation is not null"),
        "contrasts": t.where("values is not null"),
    }


SINGLE_PASS_TOKENS = 50_000


def replies(docs: DataFrame, mapper, budget: int = SINGLE_PASS_TOKENS) -> DataFrame:
    """(document_id, section, reply): a mapper's JSON for each document, or for each section of a long one in order.

    mapper(text, names so far) -> JSON. Sections of a document are read one after the other, as each is told the names
    found before; a section that fails is left out."""
    import json

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from kgspark.operators.chunking import segments

        for df in batches:
            out = []
            for d, t in zip(df["d"], df["t"]):
                parts, names = [t], []
                if len(t) // 4 > budget:
                    parts, n = [], 0
                    for a, b in segments(t):
                        if parts and n + (b - a) // 4 <= budget:
                            parts[-1] += "\n\n" + t[a:b]
                            n += (b - a) // 4
                        else:
                            parts.append(t[a:b])
                            n = (b - a) // 4
                for i, p in enumerate(parts):
                    try:
                        said = mapper(p, list(names))
                        names += [c.get("name") for c in json.loads(said).get("concepts", []) if c.get("name")]
                    except Exception:  # noqa: BLE001
                        continue
                    out.append((d, i, said))
            yield pd.DataFrame(out, columns=["document_id", "section", "reply"])

    own = docs.select(F.col("doc_id").cast("string").alias("d"), F.col("text").alias("t")).where("t is not null")
    return own.mapInPandas(scan, "document_id string, section int, reply string")


def united_sections(concepts: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts and links of a document's sections as of one map, in the order of the sections. Both have section and seq."""
    order = (F.col("section") * 10_000 + F.col("seq")).cast("int")
    return concepts.withColumn("seq", order).drop("section"), links.withColumn("seq", order).drop("section")
