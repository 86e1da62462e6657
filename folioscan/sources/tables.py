"""The page readers as table functions, for SQL with LATERAL: a row a page as it is read, not an array a file."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from folioscan.functions.batches import small_batches
from folioscan.operators.chunking import sentence_chunks
from folioscan.schema import DEFAULT_CHUNK_CHARS, DEFAULT_OVERLAP
from folioscan.sources.files import READERS


def _pages(path: str | None, content: bytes | None) -> list[tuple[int, str]]:
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1]
    reader = READERS.get(os.path.splitext(name)[1].lower())
    return reader(content) if reader and content is not None else []


@udtf(returnType="page int, text string, error string", useArrow=True)
class FilePages:
    """file_pages(path, content): the pages of a file by its extension. A file that can't be read is one row with the error alone; null contents and other extensions have no rows."""

    def eval(self, path: str, content: bytes) -> Iterator[tuple[int | None, str | None, str | None]]:
        try:
            pages = _pages(path, content)
        except Exception as e:  # noqa: BLE001  one bad file doesn't stop the others
            yield None, None, str(e)
            return
        for page, text in pages:
            yield page, text, None


@udtf(returnType="chunk_index int, text string, page int, error string", useArrow=True)
class FileChunks:
    """file_chunks(path, content, max_chars, overlap): sentence-aware chunks of a file's pages; sizes that are null are the defaults."""

    def eval(self, path: str, content: bytes, max_chars: int, overlap: int) -> Iterator[tuple[int | None, str | None, int | None, str | None]]:
        try:
            pages = _pages(path, content)
        except Exception as e:  # noqa: BLE001
            yield None, None, None, str(e)
            return
        for k, (text, page) in enumerate(sentence_chunks(pages, DEFAULT_CHUNK_CHARS if max_chars is None else max_chars, DEFAULT_OVERLAP if overlap is None else overlap)):
            yield k, text, page, None


def register(spark: SparkSession) -> None:
    """Makes both known to the session's SQL. Contents reach them in small batches, as Spark makes a whole batch into Python values first."""
    small_batches(spark)
    spark.udtf.register("file_pages", FilePages)
    spark.udtf.register("file_chunks", FileChunks)
