"""Text sources as lines: (path, line_no, line), line_no from 0, as the basis of every text operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ends a line (CR LF as one), and what counts as white space at a line's ends, in Python.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
SPACE = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def strip(c: Column) -> Column:
    """Without the Unicode white space at both ends."""
    ends = F.left(c, F.lit(1)).rlike(SPACE) | F.right(c, F.lit(1)).rlike(SPACE)
    return F.when(ends, F.regexp_replace(c, f"^{SPACE}++|{SPACE}++$", "")).otherwise(c)


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}++$", "")


def split_lines(text: Column) -> Column:
    """The lines of a text, without their ends; a final line end opens no further line, and an empty text has none."""
    return _without_last(F.split(text, LINE_END, -1))


def _without_last(parts: Column) -> Column:
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def explode_lines(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line_no, line) of whole texts; null and empty texts have no lines."""
    parts = files.where(F.col(text_col).isNotNull()).select(F.col(path_col).alias("path"), F.split(F.col(text_col), LINE_END, -1).alias("_parts"))
    return parts.select("path", F.posexplode(_without_last(F.col("_parts"))).alias("line_no", "line"))


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of whole UTF-8 files; each file is one row, so files are split over tasks but not in themselves."""
    return spark.read.format("binaryFile").load(paths).select("path", F.decode("content", "UTF-8").alias("text"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return explode_lines(read_texts(spark, paths))


def with_missing(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(path, text, missing) for each requested path: a file that isn't there has null text and missing true."""
    have = files.select("path", "text", F.lit(False).alias("_missing"))
    return requests.select("path").distinct().join(have, "path", "left").select("path", "text", F.coalesce("_missing", F.lit(True)).alias("missing"))


def require(requests: DataFrame, files: DataFrame, message: str = "Missing input file: ") -> DataFrame:
    """As with_missing, but a missing file raises FileNotFoundError that names the smallest such path."""
    out = with_missing(requests, files)
    first = out.where("missing").agg(F.min("path")).first()[0]
    if first is not None:
        raise FileNotFoundError(message + first)
    return out


def render(lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, text) of lines with order keys (k1, k2, k3): joined by LF, with a final LF."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k1", "k2", "k3", "line"))), lambda x: x["line"])
    return lines.groupBy(key).agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias("text"))
