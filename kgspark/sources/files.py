"""Reading uploads: kinds of files, documents, archives and repositories."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.layout import bodies_of, strip_references_of

# Limits, suffixes of text and code, and directories that are not an author's own work.
MAX_BYTES, MAX_CHARS, MAX_PAGES = 25 << 20, 1_500_000, 300
REPO_FILES, REPO_FILE_BYTES = 2000, 1 << 20
TEXT_SUFFIXES = tuple("md markdown txt rst".split())
CODE_SUFFIXES = tuple("py js ts tsx jsx java go rs rb php c h cpp hpp cs sh sql yaml yml toml".split())
SKIPPED = tuple(
    "node_modules .git dist build vendor target __pycache__ .venv venv .next .nuxt coverage .mypy_cache .pytest_cache".split()
)
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
CORPUS_SUFFIXES = tuple("pdf docx md txt rst py js ts".split())


def scan_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = CORPUS_SUFFIXES) -> DataFrame:
    """path, length and content of the files below a folder; the suffix filter runs on the listing."""
    glob = "*.{" + ",".join(suffixes) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def sniff(data: bytes, name: str) -> str | None:
    """The kind of a file by its first bytes; a text suffix counts only for UTF-8 text. None if unsupported."""
    if data.startswith(b"%PDF-"):
        return "application/pdf"
    if data.startswith(b"PK\x03\x04"):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return DOCX if "word/document.xml" in z.namelist() else "application/zip"
        except zipfile.BadZipFile:
            return "application/zip"
    lead = data[:8192]
    if b"\0" in lead:
        return None
    try:
        lead.decode("utf-8")
    except UnicodeDecodeError as e:
        if len(data) <= 8192 or e.start < len(lead) - 3:
            return None
    suffix = name.rpartition(".")[2].lower()
    return "text/markdown" if suffix in ("md", "markdown") else "text/plain" if suffix in TEXT_SUFFIXES + CODE_SUFFIXES else None


def docx_text(data: bytes) -> str:
    """Paragraphs parted by blank lines, then table rows with their cells between bars."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    parts = [said(p) for p in body.findall(f"{w}p")]
    for row in body.iter(f"{w}tr"):
        cells = [said(c).strip() for c in row.findall(f"{w}tc")]
        parts.append(" | ".join(c for c in cells if c))
    return "\n\n".join(p for p in parts if p.strip())


def _page_lines(page) -> list[tuple[str, float]]:
    """(text, place from the top) of the lines of a PDF page, in reading order."""
    blocks = (b for b in page.get_text("dict", sort=True)["blocks"] if b.get("lines"))
    return [("".join(s["text"] for s in line["spans"]), line["bbox"][1]) for b in blocks for line in b["lines"]]


def parse(data: bytes, name: str) -> tuple[str | None, str | None, int | None, str | None]:
    """(text, mime, pages, error); never raises."""
    if len(data) > MAX_BYTES:
        return None, None, None, f"larger than {MAX_BYTES} bytes"
    mime = sniff(data, name)
    try:
        if mime is None or mime == "application/zip":
            return None, mime, None, "unsupported file"
        if mime == DOCX:
            return docx_text(data)[:MAX_CHARS], mime, None, None
        if mime == "application/pdf":
            try:
                import pymupdf
            except ImportError:
                return None, mime, None, "no PDF reader installed; supply page lines instead"
            with pymupdf.open(stream=data) as doc:
                if len(doc) > MAX_PAGES:
                    return None, mime, len(doc), f"more than {MAX_PAGES} pages"
                pages = [[(text, y0 / p.rect.height) for text, y0 in _page_lines(p)] for p in doc]
                text = strip_references_of("\f".join("\n".join(page) for page in bodies_of(pages)))
                return text[:MAX_CHARS], mime, len(doc), None
        return data.decode("utf-8", "replace")[:MAX_CHARS], mime, None, None
    except Exception as e:  # noqa: BLE001 - one bad file must not end the job
        return None, mime, None, f"{type(e).__name__}: {e}"


def parsed(files: DataFrame) -> DataFrame:
    """path, text, mime, pages, error of every file; too large ones are told by their length alone."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(p, *parse(bytes(c), p)) for p, c in zip(df["path"], df["content"])]
            out = pd.DataFrame(rows, columns=["path", "text", "mime", "pages", "error"])
            out["pages"] = out["pages"].astype("Int32")
            yield out

    schema = "path string, text string, mime string, pages int, error string"
    large = files.where(F.col("length") > MAX_BYTES).select(
        "path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("mime"),
        F.lit(None).cast("int").alias("pages"), F.lit(f"larger than {MAX_BYTES} bytes").alias("error"),
    )
    return files.where(F.col("length") <= MAX_BYTES).select("path", "content").mapInPandas(scan, schema).unionByName(large)


def github_repo(url: Column) -> Column:
    """struct(owner, repo) of an accepted repository address, else null."""
    # Fixed value: the addresses that are accepted.
    whole = r"^https?://(?:www\.)?github\.com/([A-Za-z0-9_.-]{1,39})/([A-Za-z0-9_.-]{1,100}?)(?:\.git)?/?$"
    u = F.trim(url)
    return F.when(u.rlike(whole), F.struct(F.regexp_extract(u, whole, 1).alias("owner"), F.regexp_extract(u, whole, 2).alias("repo")))


def safe_path(path: Column) -> Column:
    """Relative, without `..`, outside skipped directories and with a suffix of text or code."""
    parts = F.split(path, "/")
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    skipped = F.array(*[F.lit(x) for x in SKIPPED])
    return ~path.startswith("/") & ~F.array_contains(parts, "..") & ~F.arrays_overlap(parts, skipped) & suffix.isin(*TEXT_SUFFIXES, *CODE_SUFFIXES)


def kept_member(name: str) -> str | None:
    """The path of an archive's member inside its wrapping folder, or None if it is not to be kept: unsafe, outside the
    wrapper, below a skipped directory, or neither text nor code."""
    wrapper, _, inside = name.partition("/")
    parts = inside.split("/")
    wanted = inside and wrapper and not {"..", *SKIPPED}.intersection([wrapper, *parts])
    return inside if wanted and parts[-1].rpartition(".")[2].lower() in TEXT_SUFFIXES + CODE_SUFFIXES else None


def read_tarball(data: bytes) -> list[tuple[str, str]]:
    """(path without the wrapping folder, text) of the files to keep, no more than REPO_FILES."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        small = ((kept_member(m.name), m) for m in tar if m.isfile() and m.size <= REPO_FILE_BYTES)
        contents = ((path, tar.extractfile(m).read()) for path, m in small if path)
        texts = ((path, c.decode("utf-8", "replace")) for path, c in contents if b"\0" not in c[:4096])
        return list(islice(texts, REPO_FILES))


def repository_files(archives: DataFrame) -> DataFrame:
    """archive, idx, path, text of the files kept of each tarball (columns path and content)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(a, i, p, t) for a, c in zip(df["path"], df["content"]) for i, (p, t) in enumerate(read_tarball(bytes(c)))]
            yield pd.DataFrame(rows, columns=["archive", "idx", "path", "text"])

    return archives.select("path", "content").mapInPandas(scan, "archive string, idx int, path string, text string")


def repository_document(files: DataFrame, key: str = "archive", most: int = REPO_FILES) -> DataFrame:
    """One text for each repository: `# path`, a blank line and the content of each file, in order, of the first `most`."""
    one = files.where(F.col("idx") < most).select(key, F.struct("idx", F.concat(F.lit("# "), "path", F.lit("\n\n"), "text").alias("t")).alias("f"))
    return one.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["t"]), "\n\n").alias("text"))


def new_documents(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming rows whose (workspace_id, sha256) is not there yet, one for each, the earliest by doc_id."""
    first = incoming.groupBy("workspace_id", "sha256").agg(F.min("doc_id").alias("doc_id"))
    return incoming.join(first, ["workspace_id", "sha256", "doc_id"], "left_semi").join(existing.select("workspace_id", "sha256"), ["workspace_id", "sha256"], "left_anti")
