"""Readers: NDJSON, text files and lines, HTML pages, artifact lists and downloads."""

from __future__ import annotations

import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .documents import name_uuid

ARXIV_SCHEMA = (
    "id string, submitter string, authors string, title string, comments string, `journal-ref` string, doi string, `report-no` string, categories string, license string, "
    "abstract string, update_date string, versions array<struct<version: string, created: string>>, authors_parsed array<array<string>>"
)


class DownloadError(Exception):
    """A download that failed for good."""


def read_ndjson(spark: SparkSession, path: str, schema: str | T.StructType, limit: int | None = None) -> DataFrame:
    """One document a line. Blank lines are skipped; a missing file gives no rows. The schema is given, so nothing is read twice."""
    reader = spark.read.schema(schema)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath) is None or not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath):
        return spark.createDataFrame([], reader.json(spark.sparkContext.emptyRDD()).schema)
    df = reader.json(path).dropna(how="all")
    return df if limit is None else df.limit(limit)


def arxiv_documents(raw: DataFrame) -> DataFrame:
    """Paper metadata flattened to text fields, with the PDF's address."""
    versions = F.array_join(F.transform("versions", lambda v: F.concat_ws(":", v["version"], v["created"])), ",")
    authors = F.array_join(F.transform("authors_parsed", lambda a: F.trim(F.array_join(F.filter(a, lambda x: x.isNotNull()), " "))), ",")
    return raw.withColumns({"versions": versions, "authors_parsed": authors, "pdf_url": F.concat(F.lit("https://arxiv.org/pdf/"), "id"), "doc_id": name_uuid(F.col("id"))})


def read_text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(doc_id, path, text): one document for each non-blank file below ``path``; the id follows from the path."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    df = df.select(F.input_file_name().alias("path"), F.col("value").alias("text")).where(F.col("text").rlike(r"\S"))
    return df.select(name_uuid(F.col("path")).alias("doc_id"), "path", "text")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one document for each non-blank line."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text")).where(F.col("text").rlike(r"\S"))


def html_text(html: Column) -> Column:
    """The visible text of a page: scripts, styles, comments and tags go, a few entities are decoded, space is collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def page_documents(pages: DataFrame, url: str = "url", number: str | None = None, html: str = "html") -> DataFrame:
    """(doc_id, url, page, text): one document a page, named by ``url#page:n``, so that ingesting it again replaces it."""
    n = F.lit(1) if number is None else F.col(number)
    return pages.select(name_uuid(F.concat(F.col(url), F.lit("#page:"), n.cast("string"))).alias("doc_id"), F.col(url).alias("url"), n.cast("int").alias("page"), html_text(F.col(html)).alias("text"))


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, url, page, total_pages, text) of every page of the PDF files at ``path``. Needs the optional package pypdf."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            import io

            import pypdf
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the package pypdf") from e
        for batch in batches:
            for row in batch.to_pylist():
                pages = pypdf.PdfReader(io.BytesIO(row["content"])).pages
                rows = [{"url": row["path"], "page": i + 1, "total_pages": len(pages), "text": p.extract_text()} for i, p in enumerate(pages)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("url", pa.string()), ("page", pa.int32()), ("total_pages", pa.int32()), ("text", pa.string())]))

    out = raw.mapInArrow(run, "url string, page int, total_pages int, text string")
    return out.select(name_uuid(F.concat("url", F.lit("#page:"), F.col("page").cast("string"))).alias("doc_id"), "*")


BODY_SIZE = 10.0


def layout_markdown(lines: list[list[tuple[str, float, float, float]]]) -> str:
    """Markdown for laid-out lines; each is a list of (text, font size, left, right).

    A line set larger than one and a half times the body size is a heading (level 1 from 2.5 times, 2 from twice); bullets and numbers
    start list items; a line with two or more gaps wider than twice its font size is a table row.
    """
    out = []
    for line in lines:
        text = " ".join(t for t, *_ in line).strip()
        if not text:
            out.append("")
            continue
        size = max(s for _, s, *_ in line)
        gaps = sum(1 for a, b in zip(line, line[1:], strict=False) if b[2] - a[3] > 2 * max(a[1], b[1]))
        ratio = size / BODY_SIZE
        if ratio > 1.5:
            out.append(("# " if ratio >= 2.5 else "## " if ratio >= 2.0 else "### ") + text)
        elif text[0] in "*-•":
            out.append("- " + text[1:].strip())
        elif re.match(r"\d+\.\s", text):
            out.append(text)
        elif gaps > 1:
            out.append("| " + " | ".join(t.strip() for t, *_ in line) + " |")
        else:
            out.append(text)
    return "\n".join(out)


def fetch(url: str, timeout: float = 30.0, retries: int = 3, pause: float = 1.0, opener: Callable[..., object] | None = None, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body at a URL. Server and network errors are tried again, waiting longer each time; client errors (4xx) are not."""
    opener = opener or urllib.request.urlopen
    for attempt in range(1, retries + 2):
        try:
            with opener(url, timeout=timeout) as response:
                return response.read()
        except urllib.error.HTTPError as e:
            if 400 <= e.code < 500 or attempt > retries:
                raise DownloadError(f"{url}: status {e.code} after {attempt} attempts") from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if attempt > retries:
                raise DownloadError(f"{url}: {e} after {attempt} attempts") from e
        sleep(pause * attempt)
    raise AssertionError("unreachable")


def download(urls: DataFrame, url: str = "url", **options: float) -> DataFrame:
    """(url, content, error) for each row, fetched by the executors; a failure becomes a row with its message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u in batch.column(0).to_pylist():
                try:
                    content, error = fetch(u, **options), None
                except (DownloadError, ValueError) as e:
                    content, error = None, str(e)
                yield pa.RecordBatch.from_pylist([{"url": u, "content": content, "error": error}], schema=pa.schema([("url", pa.string()), ("content", pa.binary()), ("error", pa.string())]))

    return urls.select(url).mapInArrow(run, "url string, content binary, error string")


def read_artifacts(spark: SparkSession, path: str, root: str = "artifacts") -> DataFrame:
    """(name, path, description) of a YAML artifact list ``root: {name: {path, description}}``; every path must exist."""
    try:
        import yaml

        with open(path) as f:
            tree = yaml.safe_load(f)
    except ImportError:
        tree = _indented(path)
    for part in root.split("."):
        tree = tree[part]
    rows = []
    for name, item in tree.items():
        if not os.path.exists(item["path"]):
            raise FileNotFoundError(f"artifact {name!r}: no file {item['path']!r}")
        rows.append((name, item["path"], item.get("description")))
    return spark.createDataFrame(rows, "name string, path string, description string")


def _indented(path: str) -> dict:
    """Nested mappings of plain scalars: what an artifact list needs of YAML."""
    tree: dict = {}
    stack: list[tuple[int, dict]] = [(-1, tree)]
    with open(path) as f:
        for line in f:
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            depth = len(line) - len(line.lstrip())
            key, _, value = line.strip().partition(":")
            while stack[-1][0] >= depth:
                stack.pop()
            if value.strip():
                stack[-1][1][key.strip()] = value.strip().strip("'\"")
            else:
                stack[-1][1][key.strip()] = child = {}
                stack.append((depth, child))
    return tree
