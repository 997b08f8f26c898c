"""Texts of files by extension, settings from .env files, and bundled templates."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from importlib import resources
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.functions import text as X
from leafgraph.sources import tree

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_OUT = "path string, bytes long, content string, problem string"


def docx_text(raw: bytes) -> str:
    """The paragraphs that aren't blank, a line each."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    said = ("".join({f"{_WORD}t": t.text or "", f"{_WORD}tab": "\t", f"{_WORD}br": "\n"}.get(t.tag, "") for t in p.iter()) for p in body.iter(f"{_WORD}p"))
    return "\n".join(s for s in said if s.strip())


def pdf_text(raw: bytes) -> str:
    """The pages with text, joined by line breaks; needs the optional package pdfplumber."""
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("pdfplumber is needed for PDF files") from e
    with pdfplumber.open(io.BytesIO(raw)) as pdf:
        return "\n".join(s for s in (p.extract_text() for p in pdf.pages) if s)


def text_of(path: str, raw: bytes) -> tuple[str | None, str | None]:
    """The text of a file and no problem, or none and the problem; a kind without a reader has neither."""
    ext = os.path.splitext(path)[1].lower()
    try:
        if ext in X.EDITABLE:
            return raw.decode().replace("\r\n", "\n").replace("\r", "\n"), None
        if reader := {".pdf": pdf_text, ".docx": docx_text}.get(ext):
            return reader(raw), None
    except Exception as e:  # a file that can't be read is a row with its problem
        return None, f"{type(e).__name__}: {e}"
    return None, None


def read_documents(spark: SparkSession, root: str, extensions: tuple[str, ...] = tree.LISTED) -> DataFrame:
    """(path, bytes, content, problem) of a folder's documents, read where the tree source finds them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for path, size in zip(rows["path"], rows["bytes"], strict=True):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        text, problem = text_of(path, f.read())
                except OSError as e:
                    text, problem = None, str(e)
                out.append((path, size, text, problem))
            yield pd.DataFrame(out, columns=["path", "bytes", "content", "problem"])

    names = tree.files(spark, root, read=False)
    chosen = names.join(tree.document_paths(names, extensions).select("path").distinct(), "path", "left_semi")
    return chosen.select("path", "bytes").mapInPandas(run, _OUT)


def load_env(path: str, environment: dict | None = None) -> None:
    """Sets what the lines key=value of a file name and the environment lacks; blank lines and # lines are nothing."""
    environment = os.environ if environment is None else environment
    if not os.path.exists(path):
        return
    with open(path, encoding="utf-8") as f:
        for line in map(str.strip, f):
            key, equals, value = line.partition("=")
            if equals and not line.startswith("#"):
                environment.setdefault(key.strip(), value.strip().strip('"').strip("'"))


def template(name: str) -> str:
    """A bundled template."""
    return resources.files("leafgraph").joinpath("templates", name).read_text(encoding="utf-8")


def summaries(docs: DataFrame) -> DataFrame:
    """(path, content, summary) of (path, content) that isn't blank."""
    return docs.where(F.col("content").rlike(r"(?U)\S")).select("path", "content", F.substring("content", 1, tree.SUMMARY_CHARS).alias("summary"))
