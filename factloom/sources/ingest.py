"""Pages and chunks out of source files: hashes, duplicates, page quality, printed labels, chunk spans, display names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROMAN = r"(?i)^(?=[ivxlcdm])m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
PAGE_FIELDS = "path string, sha256 string, page_index int, text string, width double, height double, error string"


def binary_pages(spark: SparkSession, path: str, parser: Callable[[bytes], Iterator[tuple[str, float, float]]], max_mb: int = 25, glob: str = "*.pdf") -> DataFrame:
    """Pages of binary documents by a parser that is passed in: (text, width, height) per page.

    A file that is empty, too large, of another kind or that the parser fails on gives one row with its error code.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)

    def run(batches):
        for rows in batches:
            out = []
            for name, size, body in zip(rows["path"], rows["length"], rows["content"]):
                import hashlib

                digest = hashlib.sha256(body).hexdigest()
                error = "empty_file" if not size else "file_too_large" if size > max_mb << 20 else None if body.lstrip()[:5] == b"%PDF-" else "not_a_pdf"
                if error is None:
                    try:
                        out += [(name, digest, k, t, w, h, None) for k, (t, w, h) in enumerate(parser(body))]
                        continue
                    except Exception:
                        error = "unreadable_pdf"
                out.append((name, digest, None, None, None, None, error))
            yield pd.DataFrame(out, columns=["path", "sha256", "page_index", "text", "width", "height", "error"])

    return files.mapInPandas(run, PAGE_FIELDS)


def first_copies(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sha256, first_id, is_duplicate): every row with the smallest key of its content; null texts are nobody's copy."""
    hashed = rows.select(key, F.sha2(F.col(text).cast("binary"), 256).alias("sha256"))
    first = hashed.where("sha256 is not null").groupBy("sha256").agg(F.min(key).alias("first_id"))
    return hashed.join(first, "sha256", "left").select(key, "sha256", F.coalesce("first_id", key).alias("first_id"), F.coalesce(F.col(key) > F.col("first_id"), F.lit(False)).alias("is_duplicate"))


def page_quality(chars: Column, width: Column, height: Column, had_error: Column, least: int = 100, floor: float = 0.35) -> tuple[Column, Column]:
    """(status, density per thousand square points) of a page."""
    density = F.when((width > 0) & (height > 0), F.round(chars / (width * height / 1000), 3))
    status = F.when(had_error, "EXTRACTION_ERROR").when(chars == 0, "EMPTY").when((chars < least) | (density < floor), "LOW_TEXT").otherwise("TEXT_EXTRACTED")
    return status, F.when(had_error, F.lit(None)).when(chars == 0, 0.0).otherwise(density)


def printed_label(text: Column, pages: Column) -> Column:
    """The page number printed as a whole line at the foot, else at the head; a number that is too large ends the search."""
    lines = F.filter(F.transform(F.split(text, "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    most = F.greatest(pages + 20, F.lit(50))

    def read(line):
        number = F.when(line.rlike(r"^\d{1,4}$"), line).when(line.rlike(r"(?i)^(?:page|p\.?)\s*\d{1,4}$"), F.regexp_extract(line, r"(\d{1,4})$", 1))
        roman = F.when((F.length(line) <= 6) & line.rlike(ROMAN), F.lower(line))
        return number, roman

    last, first = (read(F.try_element_at(lines, F.lit(k))) for k in (-1, 1))
    ok = lambda n: F.when(n.cast("int") <= most, n)
    return F.when(last[0].isNotNull(), ok(last[0])).when(last[1].isNotNull(), last[1]).when(first[0].isNotNull(), ok(first[0])).otherwise(first[1])


def _spans(text: str, target: int, overlap: int, backoff: int) -> list[dict]:
    out, at, n = [], 0, len(text)
    while at < n:
        hard = at + target
        kept = max(text.rfind(" ", hard - backoff, hard), text.rfind("\n", hard - backoff, hard)) + 1 if hard < n else 0
        stop = n if hard >= n else kept or hard
        out.append({"start": at, "stop": stop})
        at = n if stop == n else stop - overlap if stop - overlap > at else at + target - overlap
    return out


def chunk_spans(text: Column, target: int = 1200, overlap: int = 150, backoff: int = 200) -> Column:
    """array<struct<start, stop>>: overlapping windows over a text, cut behind the last blank or line feed within ``backoff`` of the limit; one pass over each text, in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else _spans(t, target, overlap, backoff))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<struct<start:int,stop:int>>")(text)


def display_name(name: Column) -> Column:
    base = F.trim(F.regexp_replace(F.substring_index(F.translate(F.coalesce(name, F.lit("")), "\\", "/"), "/", -1), r"[\x00-\x1f]", ""))
    return F.left(F.when(base.isin("", ".", ".."), "upload.pdf").otherwise(base), F.lit(255))


def json_specs(spark: SparkSession, path: str, schema) -> DataFrame:
    """Case specifications out of JSON files of all folders below ``path``.

    A file that does not fit the schema, or names a field that the schema does not know, is an error.
    """
    read = lambda s: spark.read.schema(s).option("recursiveFileLookup", "true").option("multiLine", "true").option("mode", "FAILFAST").json(path) if s is not None else spark.read.option("recursiveFileLookup", "true").option("multiLine", "true").json(path)
    rows = read(schema)
    unknown = sorted(set(read(None).columns) - set(rows.columns))
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    return rows


def write_stage(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "append") -> None:
    """One stage's rows as parquet, partitioned where asked; committed as a whole."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)
