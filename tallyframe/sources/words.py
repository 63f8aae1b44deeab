"""Positioned words of documents as a Spark data source.

    spark.dataSource.register(WordSource)
    spark.read.format("tallyframe_words").load(path)

gives doc_id (the file's path), page_idx, text, x0, x1, top of every word. A partition is a run of pages of one file, or
several small files: files are packed to ``partitionBytes`` each, and a larger file is cut into page ranges, whose
bounds a task finds when it has opened the file. A page that cannot be read gives no words, and a file
that cannot be opened none at all; with the option ``rows`` set to ``errors`` the same read gives those: doc_id, page_idx
(null for a file), error.

Options: ``path``, ``pattern`` (``*.pdf``), ``recursive`` (true), ``partitionBytes`` (64 MB), ``rows`` (``words`` or ``errors``), ``backend``
(``module:function``). A backend takes a file's bytes and returns its pages, each a function that returns (text, x0, x1,
top) tuples in the flow of the text. ``word_source`` makes a source of a backend that is at hand.
"""

from __future__ import annotations

import importlib
import io
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyframe.sources.stores import listed, read_bytes

WORDS = "doc_id string, page_idx int, text string, x0 double, x1 double, top double"
ERRORS = "doc_id string, page_idx int, error string"
PARTITION_BYTES = 64 << 20
Page = Callable[[], Iterable[tuple[str, float, float, float]]]
Backend = Callable[[bytes], Sequence[Page]]


def pdfplumber_words(raw: bytes) -> Sequence[Page]:
    """Pages of a PDF file by pdfplumber, where that is installed."""
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading words of PDF files needs pdfplumber; pass another backend") from e

    def words(page) -> list[tuple[str, float, float, float]]:
        return [(w["text"], float(w["x0"]), float(w.get("x1", w["x0"])), float(w["top"])) for w in page.extract_words(use_text_flow=True)]

    return [lambda page=page: words(page) for page in pdfplumber.open(io.BytesIO(raw)).pages]


@dataclass
class Pages(InputPartition):
    """Parts of files: path, which part, of how many."""

    parts: list[tuple[str, int, int]]

    def __post_init__(self) -> None:
        super().__init__(self.parts)


def packed(files: list[tuple[str, int]], size: int) -> list[Pages]:
    """Partitions of about ``size`` bytes in order: runs of small files, and shares of large ones."""
    out, now, held = [], [], 0
    for path, n in files:
        shares = max(1, -(-n // size))
        if now and (shares > 1 or held + n > size):
            out.append(Pages(now))
            now, held = [], 0
        if shares > 1:
            out += [Pages([(path, k, shares)]) for k in range(shares)]
        else:
            now.append((path, 0, 1))
            held += n
    return [*out, Pages(now)] if now else out


def read_pages(doc: str, raw: bytes, backend: Backend, share: tuple[int, int] = (0, 1)) -> Iterator[tuple[int | None, list[tuple], str | None]]:
    """Page number, its words and what went wrong, for a share of a file's pages; no number: the file could not be opened."""
    try:
        pages = backend(raw)
    except Exception as e:  # whatever a damaged file makes of its reader
        if share[0] == 0:
            yield None, [], f"{type(e).__name__}: {e}"
        return
    k, shares = share
    for i in range(k * len(pages) // shares, (k + 1) * len(pages) // shares):
        try:
            yield i, [(str(t), float(a), float(b), float(c)) for t, a, b, c in pages[i]()], None
        except Exception as e:
            yield i, [], f"{type(e).__name__}: {e}"


def _batch(doc: str, page: int | None, words: list[tuple], error: str | None, errors: bool) -> pa.RecordBatch | None:
    if errors:
        return pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([page], pa.int32()), pa.array([error])], names=["doc_id", "page_idx", "error"]) if error else None
    if not words:
        return None
    text, x0, x1, top = zip(*words, strict=True)
    n = len(words)
    arrays = [pa.array([doc] * n), pa.array([page] * n, pa.int32()), pa.array(text, pa.string()), *(pa.array(c, pa.float64()) for c in (x0, x1, top))]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "page_idx", "text", "x0", "x1", "top"])


class WordReader(DataSourceReader):
    def __init__(self, options: dict[str, str], backend: Backend | None) -> None:
        self.path = options.get("path")
        if not self.path:
            raise ValueError("give a path to load")
        self.pattern, self.recursive = options.get("pattern", "*.pdf"), options.get("recursive", "true").lower() == "true"
        self.size, self.errors = int(options.get("partitionbytes", PARTITION_BYTES)), options.get("rows", "words") == "errors"
        named = options.get("backend")
        if named:
            module, _, function = named.partition(":")
            backend = getattr(importlib.import_module(module), function)
        self.backend = backend or pdfplumber_words
        if self.size <= 0:
            raise ValueError("partitionBytes must be positive")

    def partitions(self) -> list[Pages]:
        return packed(listed(self.path, self.pattern, self.recursive), self.size)

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        for path, k, shares in partition.parts:
            for page, words, error in read_pages(path, read_bytes(path), self.backend, (k, shares)):
                batch = _batch(path, page, words, error, self.errors)
                if batch is not None:
                    yield batch


class WordSource(DataSource):
    backend: Backend | None = None

    @classmethod
    def name(cls) -> str:
        return "tallyframe_words"

    def schema(self) -> str:
        kind = self._option("rows", "words")
        if kind not in ("words", "errors"):
            raise ValueError(f"rows must be words or errors, not {kind}")
        return ERRORS if kind == "errors" else WORDS

    def reader(self, schema) -> WordReader:
        return WordReader({k.lower(): v for k, v in self.options.items()}, type(self).backend)

    def _option(self, name: str, default: str) -> str:
        return {k.lower(): v for k, v in self.options.items()}.get(name, default)


def word_source(read: Backend, called: str = "tallyframe_words") -> type[WordSource]:
    """A source of this backend, to be registered with a session."""

    class Given(WordSource):
        backend = staticmethod(read)

        @classmethod
        def name(cls) -> str:
            return called

    return Given


def words(files: DataFrame, backend: Backend = pdfplumber_words, errors: bool = False) -> DataFrame:
    """The same rows for files (path, content) that Spark has read, from any store that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                for page, found, error in read_pages(path, raw.as_py() or b"", backend):
                    batch = _batch(path, page, found, error, errors)
                    if batch is not None:
                        yield batch

    return files.select("path", "content").mapInArrow(run, ERRORS if errors else WORDS)
