import math

import pytest

from kgspark.llm import provenance as P

CODE = "def walk(items, limit=3):\n    out = []\n    for item in items:\n        if item > limit:\n            out.append(item)\n    return sorted(out)\n\n\ndef other(a):\n    return a + 1\n"
LIB = "export function pad(text, size) {\n  // keep it short\n  let out = text;\n  while (out.length < size) {\n    out += ' ';\n  }\n  return out;\n}\n\nexport function cut(text) {\n  return text.slice(1);\n}\n"
MIN = '!function(a){a(b,"c")}();var d=e[1],f=!d&&e.length;if(d!==f)for(;a--;)d.push(f[a]);' * 20
SCHEMA = "file_no bigint, workspace_id string, repo string, filename string, text string, label string, dir string"


def label(spark, files):
    rows = [(i, "w", *f, "clash", "clash") for i, f in enumerate(files)]
    return {r.file_no: r.label for r in P.labelled(spark.createDataFrame(rows, SCHEMA)).collect()}


CASES = [
    ("src/a.py", CODE, "hand"),
    ("src/user_pb2.py", CODE, "generated"),
    ("src/zz_generated.deep.go", "func a() int { return 1 }\n", "generated"),
    ("src/b.py", "# Code generated by protoc. DO NOT EDIT.\n" + CODE, "generated"),
    ("src/c.py", "# Copyright 2020 the team.\n# Diese Datei wurde automatisch erzeugt.\n" + CODE, "generated"),
    ("src/emit.py", CODE + '\nBANNER = "// @generated by {tool}"\n', "hand"),
    ("src/note.py", CODE.replace("    out = []", "    # do not edit the list, callers share it\n    out = []"), "hand"),
    ("docs/generated.md", "# Generated by hand\n\nThis text is about files generated by tools. DO NOT EDIT them.\n" * 9, "hand"),
    ("pnpm-lock.yaml", "lockfileVersion: 5\n\npackages:\n  a@1.0.0:\n    resolution: {integrity: sha512-abc}\n", "generated"),
    ("web/app.js", MIN, "minified"),
    ("web/minimap.js", LIB, "hand"),
    ("node_modules/pad/index.js", LIB.replace("pad", "gap"), "vendored"),
    ("app/vendors/list.py", CODE, "hand"),
    ("app/pad.js", "/*!\n * pad v1.2.3\n * (c) pad contributors, released under the MIT License\n */\n" + LIB.replace("text", "word"), "vendored"),
    ("src/own.py", "# Copyright 2021 the team.\n# All rights reserved.\n" + CODE, "hand"),
    ("src/points.py", "P = [" + "".join(f"(0.{i}71, 0.{i}3, {i}),\n" for i in range(100, 200)) + "]\n", "blob"),
    ("src/hex.h", "const unsigned char x[] = {\n" + "  0xeb, 0x15, 0xbe, 0x75, 0x2e, 0xbb,\n" * 60 + "};\n", "blob"),
    ("src/seed.sql", "".join(f"INSERT INTO t VALUES ({i}, 'a', {i * 7}, 'b');\n" for i in range(60)), "blob"),
    ("src/icon.ts", LIB + 'const ICON = "data:image/png;base64,' + "Jww2IdiHuG" * 12 + '";\n', "hand"),
    ("src/weights.py", CODE * 4 + "W = [\n" + "    76,  # ledger\n    84,  # quote\n" * 7 + "]\n", "hand"),
    ("src/gram.tab.c", "static const short yytable[] = {\n" + "  122,  97,  41, -67,  62,\n" * 60 + "};\n", "generated"),
]


def test_evidence_in_one_tree(spark):
    got = label(spark, [("r", p, t) for p, t, _ in CASES])
    assert {CASES[i][0]: v for i, v in got.items()} == {p: want for p, _, want in CASES}


def test_copies_of_third_party_code_count_wherever_they_lie(spark):
    notice = "/* pad - version 1.0.2 - https://pad.invalid/ - BSD-3-Clause */\n"
    files = [("r1", "node_modules/pad/index.js", LIB), ("r2", "src\\util.js", LIB.replace("\n", "\r\n")), ("r3", "lib/x.js", notice + LIB), ("r2", "src/own.js", LIB.replace("let", "var"))]
    assert label(spark, files) == {0: "vendored", 1: "vendored", 2: "vendored", 3: "hand"}


def test_uploads_repeated_without_repository_are_no_copies(spark):
    assert label(spark, [("r1", "src/a.py", CODE), (None, "src/a.py", CODE), ("r1", "src/a.py", CODE)]) == {0: "hand", 1: "hand", 2: "hand"}


def test_odd_rows(spark):
    deep = "/".join(["d"] * 60) + "/a.py"
    files = [(None, None, None), ("r", "", ""), ("r", "vendor/x/a.c", None), ("r", deep, CODE), ("r", "a.py", "x = 1\n" * 200_000), ("r", "./src//b.py", "\ufeff" + CODE)]
    got = label(spark, files)
    assert label(spark, [("r", "web/x.min.js", None), ("r", "web/x.js", None)]) == {0: "minified", 1: "hand"}
    assert len(got) == 6 and got[2] == "vendored" and got[3] == "hand" and got[5] == "hand"
    assert label(spark, []) == {}


def test_places_reach_files_through_the_tree_alone(spark, monkeypatch):
    """Plain files below a directory named as third-party, and short data files among many: the tree tells them."""
    number = lambda n: "P = [" + "".join(f"(0.{i}71, 0.{i}3, {i}),\n" for i in range(n)) + "]\n"
    plain = lambda i: CODE.replace("walk", f"walk{i}").replace("other", f"other{i}")
    files = [("r", f"node_modules/pad/lib/f{i}.py", plain(i)) for i in range(40)]
    files += [("r", f"src/f{i}.py", plain(100 + i)) for i in range(10)]
    files += [("r", f"tables/t{i}.py", number(60 + i)) for i in range(6)] + [("r", "tables/short.py", number(4)), ("r", "src/short.py", number(5))]
    want = ["vendored"] * 40 + ["hand"] * 10 + ["blob"] * 7 + ["hand"]
    assert label(spark, files) == dict(enumerate(want))
    assert P.evidence("node_modules/pad/lib/a.py", CODE)[:5] == P.evidence("src/a.py", CODE)[:5]
    flat = tuple((0.2,) * 5 for _ in P.PLACES)
    monkeypatch.setattr(P, "COMPATIBLE", flat)
    without = label(spark, files)
    assert [without[i] for i in range(40)] == ["hand"] * 40 and sum(without[i] != w for i, w in enumerate(want)) >= 41


def test_many_plain_files_do_not_undo_a_name_nor_do_notices_take_a_repository(spark):
    notice = "/*! pad v1.2.3, (c) pad contributors, released under the MIT License */\n"
    files = [("r", f"vendor/p{i % 30}/f{i}.py", CODE.replace("walk", f"walk{i}")) for i in range(300)]
    files += [("r", f"d{i % 12}/n{i}.js", notice + LIB.replace("pad", f"pad{i}")) for i in range(36)]
    files += [("r", f"d{i % 12}/h{i}.py", CODE.replace("walk", f"go{i}")) for i in range(60)]
    got = label(spark, files)
    assert {got[i] for i in range(336)} == {"vendored"} and {got[i] for i in range(336, 396)} == {"hand"}


def test_heads_are_read_to_their_end():
    long = "/*\n" + " * all rights as stated\n" * 90 + " */\n// Code generated by tool. DO NOT EDIT.\n"
    assert P.evidence("a.js", long + LIB)[1] > 0 and P.evidence("a.js", LIB + long)[1] < 0
    assert P.evidence("a.php", "<?php\n<!-- \nsome words\n@generated\n-->\n" + LIB)[1] > 0
    assert P.evidence("a.py", '"""First line.\n\nThis file is automatically generated.\n"""\n' + CODE)[1] > 0


def brute(tree, files):
    """Beliefs of files by summing over all labels of all directories."""
    import itertools

    dirs = sorted(tree)
    out = []
    for target in range(len(files)):
        belief = [0.0] * 5
        for d in itertools.product(range(6), repeat=len(dirs)):
            at = dict(zip(dirs, d))
            w = 1.0
            for name in dirs:
                w *= math.exp(tree[name][1][at[name]])
                if tree[name][0] is not None and not name.endswith("/vendor"):
                    w *= P.NESTED[at[tree[name][0]]][at[name]]
            for i, (where, e) in enumerate(files):
                if i != target:
                    w *= sum(P.COMPATIBLE[at[where]][x] * math.exp(e[x]) for x in range(5))
            where, e = files[target]
            for x in range(5):
                belief[x] += w * P.COMPATIBLE[at[where]][x] * math.exp(e[x])
        out.append(belief[0] / sum(belief))
    return out


def own(name):
    return [0.0 if name else P.ROOT, 0.0, 0.0, 0.0, 0.0, (5.0 if name in ("vendor", "node_modules") else 0.0) if name else P.NEVER]


def test_beliefs_are_exact(spark):
    files = [("r", "a.py", CODE), ("r", "lib/x/m.min.js", MIN), ("r", "lib/x/b.py", CODE), ("r", "lib/vendor/c.c", None), ("r", "lib/d_pb2.py", CODE)]
    tree = {"": (None, own("")), "/lib": ("", own("lib")), "/lib/x": ("/lib", own("x")), "/lib/vendor": ("/lib", own("vendor"))}
    e = [P.evidence(p, t)[:5] for _, p, t in files]
    want = brute(tree, list(zip(["", "/lib/x", "/lib/x", "/lib/vendor", "/lib"], e)))
    rows = [(i, "w", *f, "c", "c") for i, f in enumerate(files)]
    got = {r.file_no: r.p_hand for r in P.labelled(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, w in enumerate(want):
        assert got[i] == pytest.approx(w, abs=1e-9)


def test_beliefs_reach_through_deep_directories(spark):
    def beliefs(files):
        rows = [(i, "w", *f, "c", "c") for i, f in enumerate(files)]
        found = P.labelled(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(found) == len(files)
        return {r.file_no: (r.label, r.p_hand) for r in found}

    names = ["web", *[f"d{i}" for i in range(27)]]
    files = [("r", "/".join([*names[:n], f"f{n}.py"]), None) for n in (0, 1, 2, 24)] + [("r", "/".join([*names, "f28_pb2.py"]), CODE)]
    got = beliefs(files)
    up = lambda m, x: [sum(m[a][b] * x[b] for b in range(len(x))) for a in range(6)]
    down = lambda m, x: [sum(x[a] * m[a][b] for a in range(6)) for b in range(len(m[0]))]
    times = lambda *v: [math.prod(x) for x in zip(*v)]
    e = [[math.exp(x) for x in P.evidence(p, t)[:5]] for _, p, t in files]
    chain = [[math.exp(x) for x in own(n)] for n in ["", *names]]
    depth = {0: 0, 1: 1, 2: 2, 24: 3, 28: 4}
    for target, at in enumerate(depth):
        local = [times(c, up(P.COMPATIBLE, e[depth[k]])) if depth.get(k, target) != target else c for k, c in enumerate(chain)]
        above = local[0]
        for k in range(1, at + 1):
            above = times(down(P.NESTED, above), local[k])
        below = [1.0] * 6
        for k in range(len(chain) - 1, at, -1):
            below = up(P.NESTED, times(local[k], below))
        belief = times(down(P.COMPATIBLE, times(above, below)), e[target])
        assert got[target][1] == pytest.approx(belief[0] / sum(belief), abs=1e-9)
        assert got[target][0] == P.LABELS[belief.index(max(belief))]
