"""Hand-written sources among generated, minified, vendored files and data saved as code (problem 3).

Method: belief propagation over directory trees. Every file has evidence for five labels from its own name and text, and
from other files with the same code; every directory has evidence from its name. A compatibility matrix couples each
file and directory with its parent, and through it with its siblings. On a tree, one pass of messages upwards and one
downwards gives exact beliefs; a file's label is its most believed one.

What a file shows weighs a few logits, about as much as its place: where it lies reaches it by messages alone.
Directories named as third-party are told apart from those that are found to hold third-party files: what lies in the
former is third-party though nothing in it says so, in the latter plain files speak for hand-written ones. The name cuts
the tie to the directory above, which may be anybody's.

Messages are arrays of five numbers: those of a directory's children are summed in map tasks before they are shuffled,
and beliefs return to the files of a large directory without bringing these together.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.plans.scratch import Scratch
from kgspark.plans.skew import lookup

LABELS = ("hand", "generated", "minified", "vendored", "blob")
#: Directories have one label more: third-party by their place, that is, named so or below one named so.
PLACES = (*LABELS, "placed")
#: Logits of a clear cue, and of a text that shows none.
CUE, NONE = 7.0, {"generated": -2.5, "minified": -3.0, "vendored": -2.5, "blob": -3.0}
#: Logits of a repository's root for hand-written.
ROOT = 8.0
#: The logarithm of 0 in messages.
NEVER = -1e9
#: Compatibility of a directory's label (row) with that of a directory in it (column), in the order of PLACES. No row
#: but the last leads to `placed`; only names do. The last row is as the first with `hand` and `placed` exchanged in part.
NESTED = (
    (0.968, 0.01, 0.01, 0.002, 0.01, 0.0),
    (0.10, 0.84, 0.02, 0.02, 0.02, 0.0),
    (0.10, 0.04, 0.82, 0.02, 0.02, 0.0),
    (0.02, 0.01, 0.02, 0.94, 0.01, 0.0),
    (0.10, 0.03, 0.02, 0.02, 0.83, 0.0),
    (0.028, 0.01, 0.01, 0.002, 0.01, 0.94),
)


def _in_place(hand: tuple, odds: float) -> tuple:
    """Compatibilities of a `placed` directory with its files: those of a hand-written one, but a file without any cue,
    while it fits both alike, is odds times as likely vendored as hand-written. So a third-party directory is not
    talked out of its name by the plain files in it, however many."""
    clean = math.exp(NONE["vendored"])
    own = (hand[0] + hand[3] * clean) / (1 + odds * clean)
    return own, hand[1], hand[2], odds * own, hand[4]


_HAND = (0.57, 0.06, 0.03, 0.30, 0.04)
#: The same for a file (column, in the order of LABELS) in a directory (row, in the order of PLACES).
COMPATIBLE = (
    _HAND,
    (0.15, 0.78, 0.02, 0.03, 0.02),
    (0.22, 0.04, 0.66, 0.06, 0.02),
    (0.05, 0.01, 0.02, 0.91, 0.01),
    (0.28, 0.04, 0.02, 0.02, 0.64),
    _in_place(_HAND, 60.0),
)

#: Directory names (lower case) with the label they speak for and its weight in logits.
DIRECTORIES = {
    **dict.fromkeys(
        "node_modules bower_components vendor _vendor third_party thirdparty third-party 3rdparty external externals deps libs extern".split(),
        ("placed", 5.0),
    ),
    **dict.fromkeys("__generated__ generated".split(), ("generated", 5.0)),
    **dict.fromkeys("gen codegen autogen".split(), ("generated", 2.0)),
    **dict.fromkeys("dist min".split(), ("minified", 2.0)),
}
#: Names that tools give to their output, and lock files.
TOOL_NAMES = re.compile(
    r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.(?:go|cc|h)|\.pb\.swift|_grpc\.pb\.go|\.g(?:\.i)?\.(?:cs|dart)|\.freezed\.dart|\.designer\.(?:cs|vb)"
    r"|[._-](?:auto)?gen(?:erated)?\.\w+|^zz_generated\..*|\.tab\.[ch](?:pp)?|(?:^|/)lex\.yy\.c|^moc_.*\.cpp|^ui_.*\.h|^qrc_.*\.cpp)$",
    re.I,
)
LOCKS = re.compile(
    r"^(?:.*[-.]lock(?:\.(?:ya?ml|json|hcl))?|.*\.lockb?|go\.sum|npm-shrinkwrap\.json|packages\.lock\.json|gradle\.lockfile|package\.resolved)$", re.I
)
#: What tools write at the head of their output.
MARKERS = re.compile(
    r"@generated\b|auto-?\s?generated|automatically (?:generated|created|produced)|^\W*(?:(?:code|file|source|this file|this code) )?(?:was |is )?generated (?:by|from|with|using)\b"
    r"|DO NOT (?:EDIT|MODIFY|CHANGE)\b|(?i:do not (?:edit|modify|change) (?:this file|by hand|manually|directly))|(?:manual )?changes (?:will be|get|are) (?:lost|overwritten)"
    r"|automatisch (?:erzeugt|generiert|erstellt)|nicht (?:von hand )?(?:bearbeiten|editieren|ändern)|(?:généré|créé) automatiquement|ne pas (?:modifier|éditer)"
    r"|(?:generado|creado) automáticamente|no (?:editar|modificar)\b|(?:gerado|criado) automaticamente|não (?:editar|edite|modifi)|generato automaticamente|non modificare"
    r"|сгенерирован|создан\w* автоматически|не редактир|自动生成|请勿(?:修改|编辑)|不要(?:手动)?(?:修改|编辑)|自動生成|編集しないで|자동.{0,4}생성",
    re.I | re.M,
)
#: What notices of third-party code say; each needs the second pattern beside it.
NOTICE = re.compile(
    r"released under the .{1,40}licen[cs]e|licensed under (?:the )?(?:mit|bsd|apache|gpl|lgpl|mpl|isc)|\bupstream:|@license\b|@preserve\b"
    r"|spdx-license-identifier|permission is hereby granted|redistribution and use in source|\b(?:mit|bsd-\d-clause|apache-2\.0|isc|mpl-2\.0) licen[cs]e\b|- (?:mit|bsd-\d-clause|apache-2\.0|isc|mpl-2\.0)\b",
    re.I,
)
FOREIGN = re.compile(r"https?://|\bv?\d+\.\d+(?:\.\d+)+\b|\bversion \d|contributors|upstream", re.I)
#: What opens a comment to the line's end, what opens and closes one over lines, and first lines that are no code.
COMMENT = re.compile(r"(?:#|//|\*|--|;|%)")
SPANS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"), ("(*", "*)"), ("{-", "-}"))
DECLARED = re.compile(r"<\?|#!|<!doctype\b|[\"']use strict[\"']|@charset\b|---$", re.I)
BLOCKS = re.compile(r"/\*.*?\*/|<!--.*?-->", re.S)
LINES = re.compile(r"^[^\S\n]*(?:#|//|--).*$", re.M)
VERSIONED = re.compile(r"[-.]v?\d+\.\d+(?:\.\d+)+\.[a-z]+$", re.I)
PROSE = frozenset("md markdown txt rst adoc".split())
NUMBER = re.compile(r"0x[0-9a-fA-F]+|[-+]?\d[\d.eE_]*")
QUOTED = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
WORDS = re.compile(r"[A-Za-z_]+|\d+")
RUN = re.compile(r"(?<![\w+/])[A-Za-z0-9+/]{40,}={0,2}")
YACC = re.compile(r"\byy(?:table|check|pact|defact|translate|r1|r2|pgoto|defgoto|stos)\b")
DECLARES = re.compile(r"^\s*(?:export|public|type|interface|class|def|func)\b")


def clean_path(path: str | None) -> str:
    """Slashes only, without a leading ./ or /."""
    p = re.sub(r"/+", "/", (path or "").replace("\\", "/"))
    return re.sub(r"^(?:\./|/)+", "", p)


def head(text: str, prose: bool) -> str:
    """The comments before the first line of code, to their end; prose has its own lines for headings and lists."""
    out, closer = [], ""
    for line in text.lstrip("\ufeff").split("\n"):
        bare = line.strip()
        if closer:
            if closer in bare:
                closer = ""
        elif bare and not DECLARED.match(bare):
            span = next(((o, c) for o, c in SPANS if bare.startswith(o)), None)
            if span:
                if span[1] not in bare[len(span[0]) :]:
                    closer = span[1]
            elif not COMMENT.match(bare):
                break
            elif prose and bare.startswith(("#", "*", "--")):
                continue
        out.append(line)
    return "\n".join(out)


def body_of(text: str) -> str:
    """The code without comments of whole lines, notices, line ends and other white space."""
    t = LINES.sub("", BLOCKS.sub("", text.replace("\r\n", "\n").replace("\r", "\n")))
    return "".join(t.split())


def repeated(lines: list[str]) -> tuple[float, int]:
    """Share and number of the lines that have the commonest shape of four signs or more; words and numbers count alike."""
    shapes = Counter(WORDS.sub("w", x.strip()).replace("-w", "w") for x in lines)
    best = max((n for s, n in shapes.items() if len(re.sub(r"[\w\s]", "", s)) >= 4), default=0)
    return best / max(1, len(lines)), best


def grown(n: float, scale: float, most: float = CUE) -> float:
    """The logits of a cue that n characters or lines show: little for few of them, most for many."""
    return most * (1 - math.exp(-n / scale))


def evidence(path: str | None, text: str | None) -> tuple[float, float, float, float, float, bool, str]:
    """Log-likelihoods of LABELS by a file's own name and text, whether a notice shows third-party code, and the code
    without comments. Directories are left to the tree."""
    name = clean_path(path).lower().rpartition("/")[2]
    ext = name.rpartition(".")[2]
    generated, minified, vendored, blob = (NONE[x] for x in LABELS[1:])
    if TOOL_NAMES.search(name) or LOCKS.match(name):
        generated += CUE
    if VERSIONED.search(name):
        vendored += 2
    minified_name = re.search(r"[-.]min\.\w+$", name)
    if not text or not text.strip():
        return 0.0, generated, 5.0 if minified_name else minified, vendored, blob, False, ""  # the name is all there is to go by
    if minified_name:
        minified += 4
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    prose, noticed = ext in PROSE, False
    top = head(text, prose)
    if MARKERS.search(top):
        generated += CUE
    if NOTICE.search(top) and FOREIGN.search(top):
        vendored += CUE
        noticed = True
    code = body_of(text)
    size = len(code)
    if not prose and size:
        rest = LINES.sub("", BLOCKS.sub("", text)).strip()
        blank = 1 - size / max(1, len(rest))
        mean = len(rest) / max(1, rest.count("\n") + 1)
        lines = [x for x in text.split("\n") if x.strip()]
        numbers = sum(map(len, NUMBER.findall(code)))
        signs = sum(code.count(c) for c in ",()[]{};:")
        base64 = sum(len(m) for m in RUN.findall(text))
        dull = (numbers + signs) / size
        if dull > 0.75 and numbers / size > 0.3:
            blob += grown(size, 100)
        if base64 / size > 0.6:
            blob += grown(size, 100)
        if YACC.search(text) and dull > 0.4:
            generated += CUE
        share, times = repeated(lines)
        if share > 0.7 and times > 1:
            if DECLARES.search(lines[len(lines) // 2]):
                generated += grown(times - 1, 10)
            else:
                blob += grown(times - 1, 10)
        else:
            quoted = sum(map(len, QUOTED.findall(text))) if ext != "json" else 0
            if (quoted + numbers + signs) / size > 0.9 and numbers / size > 0.05:
                blob += grown(size, 400)
        if blank < 0.12 and mean > 100 and base64 / size < 0.5 and re.search(r"[;{}()=]", code):
            minified += grown(size, 100)
    return 0.0, generated, minified, vendored, blob, noticed, code


def placed(path: str | None) -> bool:
    """Whether a directory on the path is named as third-party code."""
    return any(DIRECTORIES.get(x, ("", 0))[0] == "placed" for x in clean_path(path).lower().split("/")[:-1])


def _evidence_rows(files: DataFrame) -> DataFrame:
    """file_no, repo key, directory, log-likelihoods e, foreign (notice or place), and hash and length of the code."""
    import hashlib

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for no, repo, path, text in zip(df["no"], df["repo"], df["path"], df["text"]):
                *e, noticed, code = evidence(path, text)
                p = clean_path(path).split("/")[:-1]
                key = hashlib.blake2b(code.encode("utf-8", "replace"), digest_size=16).hexdigest() if code else None
                out.append((no, repo, "/".join(["", *p]), len(p), e, noticed or placed(path), key, len(code)))
            yield pd.DataFrame(out, columns=["file_no", "repo", "dir", "depth", "e", "foreign", "body", "size"])

    own = files.select(
        F.col("file_no").alias("no"),
        F.concat_ws("|", F.coalesce("workspace_id", F.lit("")), F.coalesce("repo", F.lit(""))).alias("repo"),
        F.col("filename").alias("path"),
        "text",
    ).where("no is not null")
    return own.mapInPandas(scan, "file_no bigint, repo string, dir string, depth int, e array<double>, foreign boolean, body string, size int")


def _with_copies(rows: DataFrame, n: int) -> DataFrame:
    """Adds the evidence of equal code in other files: in one known to be third-party, or in another repository. The
    longer the code, the less it coincides by chance.

    Files without a repository may be the same upload again and show nothing of the kind."""
    named = F.when(~F.col("repo").endswith("|"), F.xxhash64("repo"))
    groups = (
        rows.where("body is not null")
        .groupBy("body")
        .agg(
            F.count_if("foreign").alias("known"),
            F.coalesce(F.min(named) != F.max(named), F.lit(False)).alias("spread"),
            F.count("*").alias("n"),
        )
        .where("n > 1 and (known > 0 or spread)")
    )
    met = lookup(rows.where("body is not null").select("file_no", "body", "foreign", "size"), ["body"], groups, "n", n)
    met = met.where(F.col("spread") | (F.col("known") > F.col("foreign").cast("int")))
    more = met.groupBy("file_no").agg((F.lit(CUE) * (1 - F.exp(-F.max("size") / F.lit(100.0)))).alias("more"))
    e = F.col("e")
    added = F.when(e[1] < 0, F.coalesce("more", F.lit(0.0))).otherwise(F.lit(0.0))
    return rows.join(more, "file_no", "left").withColumn("e", F.array(e[0], e[1], e[2], e[3] + added, e[4])).drop("more")


def _directory_evidence(name: Column) -> Column:
    """Log-likelihoods of PLACES from a directory's name; a repository itself is hand-written by ROOT."""
    by = {label: F.lit(0.0) for label in PLACES}
    named = F.lower(name)
    for label in PLACES[1:]:
        for w in sorted({v[1] for v in DIRECTORIES.values() if v[0] == label}):
            words = [k for k, v in DIRECTORIES.items() if v == (label, w)]
            by[label] = F.when(named.isin(words), F.lit(w)).otherwise(by[label])
    by["hand"] = F.when(named == "", F.lit(ROOT)).otherwise(F.lit(0.0))
    by["placed"] = F.when(named == "", F.lit(NEVER)).otherwise(by["placed"])
    return F.array(*[by[x] for x in PLACES])


def _tied(name: Column, message: Column) -> Column:
    """message between a directory and the one above it; none, that is all alike, if its name tells its place."""
    cut = F.lower(name).isin([k for k, v in DIRECTORIES.items() if v[0] == "placed"])
    return F.when(cut, F.array(*[F.lit(0.0)] * len(PLACES))).otherwise(message)


def _sum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _less(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _totals(c: str) -> Column:
    """The element-wise sum of a group's messages to a directory."""
    return F.array(*[F.sum(F.col(c)[i]) for i in range(len(PLACES))])


def _through(df: DataFrame, logs: Column, upwards: bool, name: str, matrix=None) -> DataFrame:
    """Adds, as name, the log of a compatibility matrix applied to exp of logs; each sum is shifted by its largest term."""
    matrix = COMPATIBLE if matrix is None else matrix
    rows = matrix if upwards else tuple(zip(*matrix))
    table = F.array(*[F.array(*[F.lit(math.log(x) if x else NEVER) for x in row]) for row in rows])
    terms = F.transform(table, lambda row: _sum(row, F.col("_l")))
    topped = F.transform(terms, lambda t: F.struct(t.alias("t"), F.array_max(t).alias("top")))
    total = lambda r: F.aggregate(r["t"], F.lit(0.0), lambda s, v: s + F.exp(v - r["top"]))
    return df.withColumn("_l", logs).withColumn(name, F.transform(topped, lambda r: r["top"] + F.log(total(r)))).drop("_l")


def _name(c: str) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def _parent(c: Column) -> Column:
    return F.regexp_replace(c, r"/[^/]*$", "")


def labelled(files: DataFrame) -> DataFrame:
    """(file_no, label, p_hand) of every file: its most believed label and the belief that it is hand-written.

    files: file_no, workspace_id, repo, filename, text. Null or empty texts leave only the name and the directory to
    go by; null repositories of a workspace are one; repeated rows are files of their own. Rows without file_no give
    nothing. Empty tables give no rows.
    """
    scratch = Scratch(files.sparkSession)
    rows = scratch.save(_evidence_rows(files))
    n = rows.count()
    leaf = _with_copies(rows, n).select("file_no", "repo", "dir", "depth", "e")
    leaf = scratch.save(_through(leaf, F.col("e"), True, "m"))
    sums = scratch.save(leaf.groupBy("repo", "dir", "depth").agg(_totals("m").alias("m"), F.count("*").alias("files")))
    deepest = sums.agg(F.max("depth")).first()[0]
    if deepest is None:
        return leaf.select("file_no", F.lit("hand").alias("label"), F.lit(1.0).alias("p_hand"))
    levels: dict[int, DataFrame] = {}
    arriving = None
    for depth in range(deepest, -1, -1):  # upwards
        here = sums.where(F.col("depth") == depth).select("repo", "dir", "m", "files")
        if arriving is not None:
            here = here.unionByName(arriving).groupBy("repo", "dir").agg(_totals("m").alias("m"), F.sum("files").alias("files"))
        own = _directory_evidence(_name("dir"))
        levels[depth] = here = scratch.save(here.select("repo", "dir", "files", _sum(F.col("m"), own).alias("b")))
        sent = _through(here.select("repo", "dir", "b"), F.col("b"), True, "m", NESTED)
        arriving = sent.select("repo", _parent(F.col("dir")).alias("dir"), _tied(_name("dir"), F.col("m")).alias("m"), F.lit(0).cast("bigint").alias("files"))
    believed = dirs = levels[0]
    for depth in range(1, deepest + 1):  # downwards
        low = _through(levels[depth], F.col("b"), True, "m", NESTED).withColumn("up", _parent(F.col("dir")))
        high = believed.select("repo", F.col("dir").alias("up"), F.col("b").alias("u"))
        both = low.join(high, ["repo", "up"]).withColumn("m", _tied(_name("dir"), F.col("m")))
        both = _through(both, _less(F.col("u"), F.col("m")), False, "d", NESTED)
        believed = scratch.save(both.select("repo", "dir", "files", _sum(F.col("b"), _tied(_name("dir"), F.col("d"))).alias("b")))
        dirs = dirs.unionByName(believed)
    joined = lookup(leaf, ["repo", "dir"], dirs, "files", n)
    joined = _through(joined, _less(F.col("b"), F.col("m")), False, "d").select("file_no", _sum(F.col("e"), F.col("d")).alias("f"))
    top = F.array_max("f")
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.array_position("f", top).cast("int"))
    total = F.aggregate("f", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return scratch.result(joined.select("file_no", label.alias("label"), (F.exp(F.col("f")[0] - top) / total).alias("p_hand")))
