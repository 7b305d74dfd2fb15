"""Entry lists: one key, or key=value, a line; comments after #."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import values as V
from weftline.sources.lines import SPACE, strip

#: How an entry's value is read.
MODES = ("true", "=", "=b", "=n")


class EntryError(RuntimeError):
    """An entry, a map or a mode that can't be read."""


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise EntryError(f"Invalid --type value. Choose from {', '.join(MODES)}.")
    return mode


def strip_comment(line: Column) -> Column:
    """Without white space at the end and a # comment after it; # within a word stays."""
    return strip(F.when(F.instr(line, "#") > 0, F.regexp_replace(line, f"{SPACE}+(#.*)?$", "")).otherwise(line))


def token_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with the column token; blank lines and lines that begin with # fall away."""
    content = lines.where(F.col("line").rlike(f"^{SPACE}*+[^#]"))
    return content.withColumn("token", strip_comment(F.col("line"))).where(F.col("token") != "")


def parse_entries(lines: DataFrame, mode: str | Column = "true") -> DataFrame:
    """(path, seq, key, value, error) of every entry line, in the order of the lines.

    ``mode`` is one of MODES, or a column of ``lines`` with one. In mode true the whole token is the key. error is null or says
    what is wrong; nothing is dropped.
    """
    if isinstance(mode, str):
        mode = F.lit(check_mode(mode))
    # A column a step: what is used more than once is computed once, and the generated code stays small.
    t = token_lines(lines.withColumn("_mode", mode))
    token = F.col("token")
    t = t.withColumns({"_left": F.substring_index(token, "=", 1), "_right": F.regexp_replace(token, "^[^=]*=", "")})
    t = t.withColumns({"_left": strip(F.col("_left")), "_right": strip(F.col("_right"))})
    key, raw = F.col("_left"), F.col("_right")
    read = (
        F.when(F.col("_mode") == "true", F.from_json(F.lit('{"tag":"bool","b":true}'), V.VALUE))
        .when(F.col("_mode") == "=", V.string_value(raw, True))
        .when(F.col("_mode") == "=b", V.boolean_value(raw, True))
        .when(F.col("_mode") == "=n", V.number_value(raw, True))
    )
    t = t.withColumn("_value", read)
    typed, value = F.col("_mode") != "true", F.col("_value")
    error = (
        F.when(~F.col("_mode").isin(*MODES), F.concat(F.lit("Unsupported map value type: "), F.col("_mode")))
        .when(typed & (F.instr(token, "=") == 0), F.lit("Source lines must include '=' when using typed modes."))
        .when(typed & (key == ""), F.lit("Map keys may not be empty."))
        .when((F.col("_mode") == "=b") & value.isNull(), F.concat(F.lit("Expected true or false, got "), F.lit("'"), raw, F.lit("'")))
        .when((F.col("_mode") == "=n") & value.isNull(), F.concat(F.lit("Could not parse numeric value "), F.lit("'"), raw, F.lit("'")))
    )
    return t.select("path", F.col("line_no").alias("seq"), F.when(typed, key).otherwise(token).alias("key"), value.alias("value"), error.alias("error"))


def fail_on_error(rows: DataFrame, kind: type[Exception] = EntryError) -> DataFrame:
    """``rows`` without the column error; raises the first one by path and seq, if there is any."""
    # No filter: pushed down, it would bring all that error is made of into one expression.
    first = rows.agg(F.min(F.when(F.col("error").isNotNull(), F.struct("path", "seq", "error"))).alias("e")).first()["e"]
    if first is not None:
        raise kind(first["error"])
    return rows.drop("error")


def last_wins(entries: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """(by, key, seq, value): a key's last value, at its first place."""
    return entries.groupBy(*by, "key").agg(F.min("seq").alias("first_seq"), F.max_by("value", "seq").alias("value")).withColumnRenamed("first_seq", "seq")


def provided(entries: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """(by, provided): how many entry lines there are, repeated keys included."""
    return entries.groupBy(*by).agg(F.count("*").alias("provided"))
