"""Files as rows: listing, hashing, reading by format. Errors stay with their file, as a status."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.batches import in_batches, small_batches, values
from folioscan.functions.scalars import MARKDOWN, clean_markdown, extension, markdown_sections, strip
from folioscan.operators.chunking import sentence_chunks, text_pages
from folioscan.sources import pdf

EXTENSIONS = (".pdf", ".txt", ".md", ".docx")
LISTED = "path string, modificationTime timestamp, length long"
PARAGRAPHS_PER_PAGE = 10
LARGE_FILE = 100 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

Page = tuple[int, str]


def _read_files(batches: Iterator) -> Iterator:
    import datetime

    import pyarrow as pa

    kinds = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary())])
    for batch in batches:
        for name in batch.column(0).to_pylist():
            data = Path(name).read_bytes()
            changed = datetime.datetime.fromtimestamp(os.path.getmtime(name), datetime.UTC)
            yield pa.RecordBatch.from_pylist([{"path": name, "modificationTime": changed, "length": len(data), "content": data}], schema=kinds)


def plain_path(path: Column) -> Column:
    """Without the scheme that Spark puts before paths of the local file system."""
    return F.regexp_replace(path, "^file:/+", "/")


def _glob(extensions: tuple[str, ...]) -> str:
    """Names with one of the extensions, whatever its case."""
    return "*{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def _outermost(paths: list[str]) -> list[str]:
    """Paths once each, without those below another."""
    plain = list(dict.fromkeys(p.rstrip("/") or "/" for p in paths))
    return [p for p in plain if not any(p != q and p.startswith(q.rstrip("/") + "/") for q in plain)]


def list_documents(spark: SparkSession, inputs: Iterable[str], extensions: tuple[str, ...] = EXTENSIONS, exclude: DataFrame | None = None, hidden: bool = False) -> DataFrame:
    """path, modificationTime, length, content of all documents below the inputs, each once, in no order.

    Only files of the extensions are opened, and contents only where they are used. Missing inputs are
    left out; names are taken literally. Spark's listing skips names that start with . or _; hidden=True
    takes them too, for folders that the driver and all executors see under one path: the driver
    lists, executors read. exclude(path): those that aren't wanted.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(p: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(conf).exists(path)

    found = _outermost([p for p in inputs if there(p)])
    if hidden:
        names = [str(f) for p in found for f in ([Path(p)] if os.path.isfile(p) else sorted(Path(p).rglob("*"))) if f.is_file() and f.suffix.lower() in extensions]
        parts = [spark.createDataFrame([(n,) for n in names], "path string").mapInArrow(_read_files, f"{LISTED}, content binary")]
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(extensions))
        parts = [reader.load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in found])] if found else []
    rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{LISTED}, content binary")
    rows = rows.withColumn("path", plain_path(F.col("path"))).filter(extension(F.col("path")).isin(*extensions))
    return rows.join(exclude.select("path"), "path", "left_anti") if exclude is not None else rows


def list_pdfs(spark: SparkSession, inputs: Iterable[str]) -> DataFrame:
    return list_documents(spark, inputs, (".pdf",))


def without_paths(rows: DataFrame, exclude: DataFrame) -> DataFrame:
    return rows.join(exclude.select("path").distinct(), "path", "left_anti")


def sha256_of(content: Column) -> Column:
    return F.sha2(content, 256)


def text_of(content: Column) -> Column:
    """UTF-8 with wrong bytes replaced, and one kind of line end; a byte-order mark stays."""
    return F.regexp_replace(F.call_function("make_valid_utf8", content.cast("string")), "\r\n?", "\n")


def title_of(path: Column, title: Column | None = None) -> Column:
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"(?<=.)\.[^.]*$", "")
    return stem if title is None else F.coalesce(F.nullif(title, F.lit("")), stem)


# Page readers: bytes to (page, text). More formats are registered by name of extension.


def decoded(data: bytes) -> str:
    return data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def read_text(data: bytes) -> list[Page]:
    return text_pages(decoded(data))


def _plain(text: str) -> str:
    """clean_markdown() in Python."""
    flags = {"(?s)": re.S, "(?d)": 0, "(?md)": re.M}
    for pattern, by in MARKDOWN:
        lead = next((f for f in flags if pattern.startswith(f)), "")
        text = re.sub(pattern[len(lead) :], by.replace("$1", r"\1"), text, flags=flags.get(lead, 0))
    return text


def read_markdown(data: bytes) -> list[Page]:
    """Sections in Python, for files; markdown_sections() is the same over columns."""
    parts = (_plain(part).strip() for part in re.split(r"(?=^#{1,6}\s)", decoded(data), flags=re.M))
    return [(k, part + "\n") for k, part in enumerate(filter(None, parts), 1)]


def paragraphs(data: bytes) -> list[str]:
    """Stripped non-blank paragraphs of a DOCX file's body, by the standard library."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p") if body is not None else ():
        text = "".join((n.text or "") if n.tag == f"{_W}t" else "\t" if n.tag == f"{_W}tab" else "\n" if n.tag in (f"{_W}br", f"{_W}cr") else "" for n in p.iter())
        if text.strip():
            out.append(text.strip())
    return out


def read_docx(data: bytes) -> list[Page]:
    lines = paragraphs(data)
    return [(k // PARAGRAPHS_PER_PAGE + 1, "\n".join(lines[k : k + PARAGRAPHS_PER_PAGE]) + "\n") for k in range(0, len(lines), PARAGRAPHS_PER_PAGE)]


def read_pdf(data: bytes) -> list[Page]:
    return pdf.pages(data)


READERS: dict[str, Callable[[bytes], list[Page]]] = {".txt": read_text, ".md": read_markdown, ".docx": read_docx, ".pdf": read_pdf}


def text_parts(name: str, data: bytes) -> list[str]:
    """The text of a file without pages: whole, or by page of a PDF or paragraph of a DOCX file. Other formats have none."""
    ext = os.path.splitext(name)[1].lower()
    if ext == ".docx":
        return [p + "\n" for p in paragraphs(data)]
    if ext == ".md":
        return [_plain(decoded(data))]
    if ext == ".txt":
        return [decoded(data)]
    return [t for _, t in read_pdf(data)] if ext == ".pdf" else []


def file_title(name: str, data: bytes) -> str:
    """The title that a PDF file gives, else the name without its extension."""
    stem = os.path.splitext(name)[0]
    try:
        return pdf.metadata(data, stem)["title"] if name.lower().endswith(".pdf") else stem
    except Exception:  # noqa: BLE001  files that can't be read keep their names
        return stem


def parsed(files: DataFrame, max_chars: int, overlap: int, readers: dict[str, Callable[[bytes], list[Page]]] | None = None) -> DataFrame:
    """One row a file: path, status (ok, empty, error), error, sha256, mtime, size, title, chunks (index, text, page)."""
    readers = READERS if readers is None else readers
    small_batches(files.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        kinds = pa.schema([("path", pa.string()), ("status", pa.string()), ("error", pa.string()), ("sha256", pa.string()), ("mtime", pa.float64()), ("size", pa.int64()), ("title", pa.string()), ("chunks", pa.list_(pa.struct([("index", pa.int32()), ("text", pa.string()), ("page", pa.int32())])))])

        def each() -> Iterator[tuple]:
            for path, mtime, data in values(batches):
                name = path.replace("\\", "/").rsplit("/", 1)[-1]
                stem, dot, ext = name.rpartition(".")
                row = {"path": path, "status": "ok", "error": None, "sha256": hashlib.sha256(data).hexdigest(), "mtime": mtime, "size": len(data), "title": file_title(name, data), "chunks": []}
                try:
                    pages = readers.get(f".{ext.lower()}" if dot and stem else "", lambda _: [])(data)
                    row["chunks"] = [{"index": k, "text": t, "page": p} for k, (t, p) in enumerate(sentence_chunks(pages, max_chars, overlap))]
                    row["status"] = "ok" if row["chunks"] else "empty"
                except Exception as e:  # noqa: BLE001  one bad file doesn't stop the others
                    row |= {"status": "error", "error": str(e)}
                yield tuple(row[c] for c in kinds.names)

        yield from in_batches(each(), kinds, lambda row: sum(len(c["text"]) for c in row[-1]))

    return files.select("path", F.col("modificationTime").cast("double").alias("mtime"), "content").mapInArrow(
        run, "path string, status string, error string, sha256 string, mtime double, size long, title string, chunks array<struct<index:int,text:string,page:int>>"
    )


def markdown_pages(rows: DataFrame, key: str) -> DataFrame:
    """key, page, text from a column of Markdown, in Catalyst."""
    return rows.select(key, F.explode(markdown_sections(F.col("text"))).alias("s")).select(key, "s.page", "s.text")


def markdown_text(text: Column) -> Column:
    return clean_markdown(text)


def table_markdown(rows: DataFrame, order: str, cells: list[str]) -> DataFrame:
    """One Markdown table of the rows in order, the first being the header."""
    clean = F.array(*(F.replace(strip(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("\n"), F.lit(" ")) for c in cells))
    lines = rows.select(F.struct(F.col(order).alias("k"), F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |")).alias("line")).alias("r")).groupBy().agg(F.sort_array(F.collect_list("r")).alias("rs"))
    rule = "| " + " | ".join(["---"] * len(cells)) + " |"
    return lines.filter(F.size("rs") > 0).select(F.array_join(F.concat(F.array(F.col("rs")[0]["line"], F.lit(rule)), F.transform(F.slice("rs", F.lit(2), F.size("rs")), lambda r: r["line"])), "\n").alias("markdown"))


def page_layout(blocks: DataFrame, tables: DataFrame, by: list[str]) -> DataFrame:
    """by, text: text blocks (x0, y0, x1, y1, text, type) without those that lie more than half in a table, and tables (x0, y0, x1, y1, markdown), from the top."""
    b, t = blocks.alias("b"), tables.alias("t")
    same = reduce(Column.__and__, [F.col(f"b.{c}") == F.col(f"t.{c}") for c in by])
    wide = F.least("b.x1", "t.x1") - F.greatest("b.x0", "t.x0")
    high = F.least("b.y1", "t.y1") - F.greatest("b.y0", "t.y0")
    area = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    inside = same & (wide > 0) & (high > 0) & (area > 0) & (wide * high > area * 0.5)
    kept = b.filter("b.type = 0").join(t, inside, "left_anti").select(*by, F.col("y0"), F.lit(0).alias("kind"), strip(F.col("text")).alias("text")).filter("text != ''")
    both = kept.unionByName(tables.filter("markdown != ''").select(*by, "y0", F.lit(1).alias("kind"), F.col("markdown").alias("text")))
    return both.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "kind", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def scan_totals(files: DataFrame) -> DataFrame:
    """One row: file_count, total_size_bytes. Columns: path, length."""
    return files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_size_bytes"))


def large_files(files: DataFrame, large: int = LARGE_FILE) -> DataFrame:
    """name, path, size_bytes of the files that are large."""
    return files.filter(F.col("length") >= large).select(F.regexp_extract("path", r"([^/\\]*)$", 1).alias("name"), "path", F.col("length").alias("size_bytes"))


def scan_stats(files: DataFrame, large: int = LARGE_FILE) -> DataFrame:
    """ext, file_count, total_size, large_count: what an input holds. Columns: path, length."""
    return files.groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_size"), F.count_if(F.col("length") >= large).alias("large_count"))


def scan_report(files: DataFrame, large: int = LARGE_FILE) -> DataFrame:
    """kind, name, file_count, total_size, large_count, in one pass and one shuffle. Columns: path, length.

    A row of kind total; one of kind type for each extension (name); one of kind large for each path
    (name) and length of large files. All large files are listed, each as a group, so no task holds
    them all; the other files are one group there, which is summed before it moves and left out.
    """
    big = F.col("length") >= large
    rows = files.select("length", big.alias("is_large"), extension(F.col("path")).alias("ext"), F.when(big, F.col("path")).alias("at"), F.when(big, F.col("length")).alias("size"), F.lit(1).cast("long").alias("n"))
    # A row that counts for nothing, so that there is a total of no files too.
    rows = rows.unionByName(files.sparkSession.range(1).select(F.lit(0).cast("long").alias("n")), allowMissingColumns=True)
    sets = rows.groupingSets([[], ["ext"], ["at", "size"]], "ext", "at", "size")
    out = sets.agg(F.grouping_id().alias("set"), F.sum("n").alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_size"), F.count_if("is_large").alias("large_count"))
    kind = F.when(F.col("set") == 3, "type").when(F.col("set") == 4, "large").otherwise("total")
    return out.filter("set = 7 OR (set = 3 AND file_count > 0) OR size IS NOT NULL").select(kind.alias("kind"), F.coalesce("ext", "at").alias("name"), "file_count", "total_size", "large_count")
