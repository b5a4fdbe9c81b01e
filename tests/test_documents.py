import hashlib
import io
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from kgspark.operators import chunking, layout
from kgspark.sources import files

HEADED = "# Title\n\nIntro text here.\n\n## Part\n\n" + ("Some sentence of prose. " * 60 + "\n\n") * 6 + "Setext\n======\n\ntail"


def test_chunks_are_exact_and_overlap(spark):
    df = spark.createDataFrame([(1, HEADED, "dir/notes.v2.md", "w")], "doc_id bigint, text string, filename string, workspace_id string")
    c = chunking.chunks(df, keep=("workspace_id",)).orderBy("ord").collect()
    assert [x.ord for x in c] == list(range(len(c))) and {x.workspace_id for x in c} == {"w"}
    for x, nxt in zip(c, [*c[1:], None]):
        assert HEADED[x.char_start : x.char_end] == x.text and x.text.strip() and len(x.text) <= 4600
        digest = hashlib.sha1(f"dir/notes.v2.md:{x.char_start}:{x.char_end}".encode()).hexdigest()[:12]
        assert x.chunk_id == f"notes.v2-{x.ord:04d}-{digest}"
        assert nxt is None or x.char_start < nxt.char_start <= x.char_end


def test_oversized_segments_are_cut_hard():
    assert [o[:2] for o in chunking.offsets("x" * 9000, 4000, 600)] == [(0, 4000), (3400, 8000), (7400, 9000)]


def test_scraps_join_what_they_follow_if_both_fit():
    assert chunking.packed([(0, 90), (92, 95)], 100, 50) == [(0, 95)]
    assert chunking.packed([(0, 90), (92, 120), (122, 230)], 100, 50) == [(0, 90), (92, 120), (122, 222), (222, 230)]
    assert chunking.packed([(0, 100), (101, 110)], 100, 50) == [(0, 100), (101, 110)]
    assert chunking.packed([(0, 130), (131, 140)], 100, 50) == [(0, 100), (100, 140)]
    assert chunking.packed([], 100) == []


@pytest.mark.parametrize("seed", range(4))
def test_nothing_is_lost(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word ", "\n\n", "\n# Head\n", "é" * 50, "\f", "  \n \n"]) for _ in range(900))
    covered = [False] * len(text)
    for s, e, p in chunking.offsets(text, 240, 40):
        assert p == (text.count("\f", 0, s) + 1 if "\f" in text else None)
        covered[s:e] = [True] * (e - s)
    assert not "".join(ch for ch, k in zip(text, covered) if not k).strip()


def test_chunk_frames(spark):
    rows = [(1, HEADED, "a.md", 0), (2, None, "b", 0), (3, "  ", None, 0), (4, "tiny", None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, filename string, page int")
    got = chunking.chunks(df)
    assert {r[0] for r in got.select("document_id").distinct().collect()} == {1, 4}
    assert chunking.chunks(df.limit(0)).count() == 0


def lines(spark, pages):
    rows = [("d", i, t, y) for i, p in enumerate(pages) for t, y in p]
    return spark.createDataFrame(rows, "document_id string, page int, line string, y double")


def test_readers_drop_the_same_furniture(spark):
    r = random.Random(4)
    for n in (2, 3, 5, 9):
        pages = [[("Journal  of X", 0.05), (f"Body {i}", 0.5), (r.choice(["Draft", "Final"]), 0.9), (f"Page {i}", 0.95), ("Journal of x", 0.6)] for i in range(n)]
        kept = layout.without_furniture(lines(spark, pages)).groupBy("page").agg(F.sort_array(F.collect_list("line")).alias("l")).orderBy("page").collect()
        assert [sorted(p) for p in layout.bodies_of(pages)] == [list(x.l) for x in kept]


def test_furniture(spark):
    pages = [[("Journal of X", 0.05), (f"Body {i} of text", 0.5), ("repeated body", 0.4), (f"Page {i}", 0.95)] for i in range(4)]
    got = {(r.band, r.key) for r in layout.furniture(lines(spark, pages)).collect()}
    assert got == {("top", "journal of x"), ("bottom", "page #")}
    kept = [r.line for r in layout.without_furniture(lines(spark, pages)).collect()]
    assert len(kept) == 8 and "repeated body" in kept
    assert layout.furniture(lines(spark, pages[:2])).count() == 0


@pytest.mark.parametrize("head,cut", [("References", True), ("6. REFERENCES:", True), ("Works  Cited", True), ("References to trees", False)])
def test_references(spark, head, cut):
    text = "line\n" * 10 + f"{head}\n[1] a\n[2] b\n"
    want = "line\n" * 10 if cut else text
    assert layout.strip_references_of(text) == want
    assert spark.createDataFrame([(text,), (None,)], "t string").select(layout.strip_references("t")).first()[0] == want
    early = f"References\n{'line\n' * 10}"
    assert layout.strip_references_of(early) == early


def docx():
    b = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "<w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t> a </w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return b.getvalue()


def test_sniff_and_parse():
    assert files.sniff(b"%PDF-1.7", "a.txt") == "application/pdf"
    assert files.sniff(b"MZ\x90\x00", "a.pdf") is None
    assert files.sniff("é# Hi".encode(), "a.md") == "text/markdown"
    assert files.sniff(b"\xff\xfe", "a.txt") is None and files.sniff(b"plain", "a.exe") is None
    assert files.sniff(docx(), "a.docx") == files.DOCX
    assert files.parse(docx(), "a.docx")[0] == "One\n\nTwo\n\na | b"
    assert files.parse(b"PK\x03\x04junk", "a.zip")[3] == "unsupported file"
    assert files.parse(b"hello", "a.py") == ("hello", "text/plain", None, None)


def tarball(entries):
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w:gz") as t:
        for name, data in entries:
            m = tarfile.TarInfo(name)
            m.size = len(data)
            t.addfile(m, io.BytesIO(data))
    return b.getvalue()


def test_repositories(spark):
    data = tarball([("w/src/a.py", b"x = 1"), ("w/../evil.py", b"bad"), ("/abs.py", b"bad"), ("w/node_modules/m.js", b"bad"), ("w/b.bin", b"bad"), ("w/n.py", b"\0"), ("w/README.md", b"# Hi")])
    assert files.kept_member("top.py") is None and files.kept_member("w/../x.py") is None and files.kept_member("w/a/b.py") == "a/b.py"
    assert files.read_tarball(data) == [("src/a.py", "x = 1"), ("README.md", "# Hi")]
    df = spark.createDataFrame([("r1", bytearray(data))], "path string, content binary")
    assert files.repository_document(files.repository_files(df)).first()["text"] == "# src/a.py\n\nx = 1\n\n# README.md\n\n# Hi"


def test_folder_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "sub" / "b.txt").write_text("b")
    (tmp_path / "c.exe").write_text("c")
    got = files.parsed(files.scan_files(spark, str(tmp_path))).collect()
    assert sorted((r.path.rpartition("/")[2], r.text, r.error) for r in got) == [("a.md", "# A", None), ("b.txt", "b", None)]


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://github.com/a/b", ("a", "b")), (" https://www.github.com/a/b.git/ ", ("a", "b")), ("https://github.com.evil.io/a/b", None), ("http://localhost/a/b", None),
        ("https://github.com/a", None), ("https://user@github.com/a/b", None), ("file:///etc/passwd", None), (None, None),
    ],
)
def test_repository_addresses(spark, url, want):
    got = spark.createDataFrame([(url,)], "u string").select(files.github_repo(F.col("u")).alias("r")).first().r
    assert (tuple(got) if got else None) == want


def test_new_documents(spark):
    new = spark.createDataFrame([("w", "h1", 2), ("w", "h1", 1), ("w", "h2", 3), ("v", "h1", 4)], "workspace_id string, sha256 string, doc_id int")
    old = spark.createDataFrame([("w", "h2")], "workspace_id string, sha256 string")
    assert {r.doc_id for r in files.new_documents(new, old).collect()} == {1, 4}
