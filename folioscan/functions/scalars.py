"""Column functions: paths, text clean-up, JSON metadata, formatting. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The patterns of Markdown clean-up, in the order in which they apply, and their replacements.
MARKDOWN = [
    (r"(?s)`{1,3}[^`]*`{1,3}", ""),  # code
    (r"(?d)!\[.*?\]\([^)]*\)", ""),  # images
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),  # links keep their label
    (r"\*{1,3}([^*\n]+)\*{1,3}", "$1"),  # bold and italic
    (r"(?md)^[-*_]{3,}\s*$", ""),  # rules
    (r"(?md)^#{1,6}\s+", ""),  # heading marks
]
HEADING = r"(?md)(?=^#{1,6}\s)"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends; trim() knows spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s", "")) == 0


def normalize_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normalize_folder(folder: Column) -> Column:
    """Forward slashes and none at the end, but for a root."""
    return F.regexp_replace(normalize_path(folder), r"([^:])/+$", "$1")


def parent(path: Column) -> Column:
    """The folder of a path with forward slashes."""
    return F.when(~F.contains(path, F.lit("/")), ".").when(path.rlike("^/[^/]*$"), "/").otherwise(F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def extension(path: Column) -> Column:
    """Lower case with its dot; empty for names that only start with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))


def clean_markdown(text: Column) -> Column:
    for pattern, by in MARKDOWN:
        text = F.regexp_replace(text, pattern, by)
    return text


def markdown_sections(text: Column) -> Column:
    """Array of struct(page, text): cleaned non-blank sections, numbered densely from 1."""
    parts = F.filter(F.transform(F.split(text, HEADING, -1), lambda x: strip(clean_markdown(x))), lambda x: x != "")
    return F.transform(parts, lambda x, k: F.struct((k + 1).alias("page"), F.concat(x, F.lit("\n")).alias("text")))


def normalize_whitespace(text: Column) -> Column:
    """Lines without white space at their ends, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), "\n")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def metadata_of(text: Column) -> Column:
    """JSON metadata; {} where there is none."""
    return F.when(text.isNull() | (text == ""), "{}").otherwise(text)


def metadata_page(text: Column) -> Column:
    """The field page, null without one."""
    return F.get_json_object(metadata_of(text), "$.page").cast("int")


def snippet(text: Column, chars: int = 180) -> Column:
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, chars)


def percent(score: Column) -> Column:
    return F.floor(score * 100 + 0.5).cast("int")


def short_path(path: Column) -> Column:
    parts = F.split(path, r"[/\\]")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), "/")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def clamp_top_k(k: Column) -> Column:
    return F.greatest(F.lit(1), F.least(k, F.lit(50)))


def register_sql_functions(spark: SparkSession) -> None:
    """The scalars as temporary SQL functions; Catalyst inlines them into plans."""
    for body in (
        r"normalize_path(p STRING) RETURNS STRING RETURN replace(p, '\\', '/')",
        r"normalize_folder(p STRING) RETURNS STRING RETURN regexp_replace(replace(p, '\\', '/'), '([^:])/+$', '$1')",
        "sigmoid(x DOUBLE) RETURNS DOUBLE RETURN 1 / (1 + exp(-x))",
        "dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
