"""Acronym lists, and the managed block of an allow map that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.lines import SPACE, explode_lines, render, strip

#: The comments around which the block is placed, an entry that allows a word, and a valid word.
MANAGED_COMMENT = "// Project-specific acronyms (imported from .config/common-acronyms)"
ROMAN_MARKER = "// Roman numerals appearing in API names"
ALLOW_ENTRY = rf'^{SPACE}*"([^"\\]+)":{SPACE}*true,{SPACE}*$'
VALID_TOKEN = "^[0-9A-Z]+$"


class AllowlistError(RuntimeError):
    """A word that isn't an acronym, or a map without a place for the block."""


def parse_acronyms(lines: DataFrame) -> DataFrame:
    """(path, first_pos, token, error): distinct upper-cased words in the order of their first lines; error names line and text."""
    word = strip(F.col("line"))
    rows = lines.where((word != "") & ~word.startswith("#")).select("path", "line_no", word.alias("raw"), F.upper(word).alias("token"))
    error = F.when(~F.col("token").rlike(VALID_TOKEN), F.concat(F.lit("Line "), (F.col("line_no") + 1).cast("string"), F.lit(" in "), F.col("path"), F.lit(" must be alphanumeric; got '"), F.col("raw"), F.lit("'.")))
    return rows.withColumn("error", error).groupBy("path", "token").agg(F.min("line_no").alias("first_pos"), F.min_by("error", "line_no").alias("error")).select("path", "first_pos", "token", "error")


def load_acronyms(lines: DataFrame) -> DataFrame:
    """As parse_acronyms, without the column error; the first error by path and line is raised."""
    rows = parse_acronyms(lines)
    first = rows.where("error is not null").agg(F.min(F.struct("path", "first_pos", "error")).alias("e")).first()["e"]
    if first is not None:
        raise AllowlistError(first["error"])
    return rows.drop("error")


def run_after(lines: DataFrame, starts: DataFrame, member: Column, one_blank: bool = True) -> DataFrame:
    """(path, start, end): the run that begins at start, and after it the lines of which ``member`` holds, and one blank line more."""
    after = lines.join(starts, "path").where("line_no > start")
    blank = strip(F.col("line")) == ""
    stop = F.min(F.when(~(member & ~blank), F.struct("line_no", blank.alias("blank"))))
    ends = after.groupBy("path").agg(stop.alias("stop"), F.max("line_no").alias("last"))
    end = F.when(F.col("stop").isNull(), F.col("last") + 1).when(F.col("stop.blank") & F.lit(one_blank), F.col("stop.line_no") + 1).otherwise(F.col("stop.line_no"))
    return starts.join(ends.select("path", end.alias("end")), "path", "left").withColumn("end", F.coalesce("end", F.col("start") + 1))


def remove_block(lines: DataFrame) -> DataFrame:
    """``lines`` without the first managed block of each path: its comment, the entries that follow, and one blank line."""
    starts = lines.where(strip(F.col("line")) == MANAGED_COMMENT).groupBy("path").agg(F.min("line_no").alias("start"))
    runs = run_after(lines, starts, F.col("line").rlike(ALLOW_ENTRY))
    return lines.join(runs, "path", "left").where("start is null or line_no < start or line_no >= end").select("path", "line_no", "line")


def allowed_words(lines: DataFrame) -> DataFrame:
    """(path, token) of every entry that allows a word, anywhere in the script."""
    return lines.where(F.col("line").rlike(ALLOW_ENTRY)).select("path", F.regexp_extract("line", ALLOW_ENTRY, 1).alias("token")).distinct()


def insertion_points(lines: DataFrame) -> DataFrame:
    """(path, at): the marker's line, else the first line that is a closing brace."""
    s = strip(F.col("line"))
    at = F.coalesce(F.min(F.when(s == ROMAN_MARKER, F.col("line_no"))), F.min(F.when(s == "}", F.col("line_no"))))
    return lines.groupBy("path").agg(at.alias("at"))


def update_allow_maps(scripts: DataFrame, acronyms: DataFrame, fail: bool = True) -> DataFrame:
    """(path, changed, managed, text, error): each script with one managed block of the acronyms that it doesn't allow yet.

    ``scripts`` has path and text; ``acronyms`` path (a script's), first_pos and token. managed lists the block's words in order. Without a
    place for the block there is an error, raised unless ``fail`` is false.
    """
    lines = remove_block(explode_lines(scripts))
    new = acronyms.join(allowed_words(lines), ["path", "token"], "left_anti")
    managed = new.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_pos", "token"))), lambda x: x["token"]).alias("managed"))
    managed = managed.join(insertion_points(lines), "path", "left")
    entry = F.transform("managed", lambda t: F.concat(F.lit('  "'), t, F.lit('": true,')))
    block = F.concat(F.array(F.lit(f"  {MANAGED_COMMENT}")), entry, F.array(F.lit("")))
    inserts = managed.where("at is not null").select("path", F.col("at").alias("k1"), F.lit(0).alias("k2"), F.posexplode(block).alias("k3", "line"))
    kept = lines.select("path", F.col("line_no").alias("k1"), F.lit(1).alias("k2"), F.lit(0).alias("k3"), "line")
    out = scripts.select("path", F.col("text").alias("old_text")).join(render(kept.unionByName(inserts)), "path", "left").join(managed, "path", "left")
    error = F.when(F.col("managed").isNotNull() & F.col("at").isNull(), F.lit("Unable to locate the allow map closing brace for insertion."))
    text = F.when(error.isNotNull(), F.col("old_text")).otherwise(F.coalesce("text", F.lit("\n")))
    out = out.select("path", (text != F.col("old_text")).alias("changed"), F.coalesce("managed", F.array().cast("array<string>")).alias("managed"), text.alias("text"), error.alias("error"))
    if fail and (worst := out.where("error is not null").agg(F.min("error")).first()[0]) is not None:
        raise AllowlistError(worst)
    return out


def report(result: DataFrame) -> DataFrame:
    """(path, message) of what an update did."""
    n = F.size("managed")
    verb = F.when(F.col("changed"), "Updated").otherwise("Already present")
    return result.select("path", F.when(n > 0, F.concat(verb, F.lit(" "), n.cast("string"), F.lit(" acronyms in "), F.col("path"), F.lit("."))).otherwise(F.lit("No project-specific acronyms to inject.")).alias("message"))
