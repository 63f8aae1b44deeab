"""Sources: page text of documents, and alias files."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import text as T


def document_files(spark: SparkSession, path: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """path and content of the files under ``path`` in any store that Spark reads; a listing has each file once."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(path)


def existing_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path of the files under ``path``, none where it does not exist; contents are not read."""
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(store):
        return spark.createDataFrame([], "path string")
    return document_files(spark, path, pattern).select("path")


def pypdf_pages(raw: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf; pass another backend") from e
    out = []
    for page in PdfReader(io.BytesIO(raw)).pages:
        try:
            out.append(page.extract_text() or "")
        except Exception:  # a page that cannot be read is an empty page
            out.append("")
    return out


def pdfplumber_pages(raw: bytes) -> list[str]:
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pdfplumber; pass another backend") from e
    out = []
    with pdfplumber.open(io.BytesIO(raw)) as pdf:
        for page in pdf.pages:
            try:
                out.append(page.extract_text() or "")
            except Exception:  # a page that cannot be read is an empty page
                out.append("")
    return out


def available_backend() -> Callable[[bytes], list[str]]:
    """The preferred reader that is installed."""
    import importlib.util

    for name, read in (("pdfplumber", pdfplumber_pages), ("pypdf", pypdf_pages)):
        if importlib.util.find_spec(name):
            return read
    raise RuntimeError("reading PDF files needs pdfplumber or pypdf; pass a backend")


def ocr(raw: bytes, command: tuple[str, ...] = ("ocrmypdf", "--force-ocr", "--deskew", "--clean", "--optimize", "2")) -> bytes | None:
    """The file with recognised text, or None where the tool makes none; its bytes leave the task's folder before that goes."""
    import subprocess
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as folder:
        source, target = Path(folder, "in.pdf"), Path(folder, "out.pdf")
        source.write_bytes(raw)
        subprocess.run([*command, str(source), str(target)], capture_output=True, check=False)
        return target.read_bytes() if target.exists() else None


def with_ocr(files: DataFrame, pages: DataFrame, low: DataFrame, backend: Callable[[bytes], list[str]], enabled: bool = True, recognise: Callable[[bytes], bytes | None] = ocr) -> DataFrame:
    """Pages of all documents; those of ``low`` (doc_id) read again after recognition, where it is on and its tool gives a file."""
    if not enabled:
        return pages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [(p, recognise(c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame([x for x in made if x[1] is not None], columns=["path", "content"])

    wanted = files.select("path", "content").join(low.select(F.col("doc_id").alias("path")), "path", "left_semi")
    again = page_texts(wanted.mapInPandas(run, "path string, content binary"), backend)
    kept = pages.join(again.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.unionByName(again)


@dataclass(frozen=True)
class Settings:
    """What a run takes from its session: the reviewer's model and prices (a million tokens), and whether to recognise text."""

    model: str
    price_in: float | None
    price_out: float | None
    ocr: bool

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        get = lambda name, default: spark.conf.get(f"spark.tallyframe.{name}", default)
        number = lambda x: float(x) if x else None
        return cls(get("model", "offline"), number(get("price.input", "")), number(get("price.output", "")), get("ocr", "false") == "true")


def page_texts(files: DataFrame, backend: Callable[[bytes], list[str]] = pypdf_pages) -> DataFrame:
    """doc_id, page_idx, text (normalised), raw_text of every page; a file is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                pages = backend(raw)
                yield pd.DataFrame({"doc_id": path, "page_idx": range(len(pages)), "raw_text": pages})

    pages = files.select("path", "content").mapInPandas(run, "doc_id string, page_idx int, raw_text string")
    return pages.withColumn("text", T.normalise(F.col("raw_text")))


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """statement, key, value of an alias file: sections of indented ``key: value`` lines, # comments; the last of equal keys wins, unknown sections are left out.

    A rules file is small; its lines are put in order in one task.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
    rows = lines.filter(F.btrim("line") != "").filter(~F.btrim("line").startswith("#"))
    head = F.when(~F.col("line").startswith(" "), F.regexp_replace(F.btrim("line"), ":$", ""))
    filled = rows.withColumn("statement", F.last(head, ignorenulls=True).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    pairs = filled.filter(F.col("statement").isin("balance", "income", "cash")).filter(F.col("line").startswith(" ") & F.contains("line", F.lit(":")))
    key, value = F.lower(F.btrim(F.split("line", ":", 2)[0])), F.btrim(F.regexp_replace(F.split("line", ":", 2)[1], "^:", ""))
    return pairs.groupBy("statement", key.alias("key")).agg(F.max_by(value, "n").alias("value"))
