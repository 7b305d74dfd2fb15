"""Makefiles: a variable, a phony target and a recipe, put in where they are missing.

A Makefile is one row with its lines as an array, so every step is an expression within the row: nothing is shuffled or joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.lines import SPACE, rstrip, split_lines, strip


def _none() -> Column:
    return F.array().cast("array<string>")


def _first(lines: Column, test) -> Column:  # noqa: ANN001
    """The place, from 1, of the first line for which ``test`` holds; 0 if there is none."""
    return F.coalesce(F.array_position(F.transform(lines, test), True), F.lit(0)).cast("int")


def _run(lines: Column, test) -> Column:  # noqa: ANN001
    """How many lines from the first on have what ``test`` says."""
    stop = _first(lines, lambda x: ~test(x))
    return F.when(stop > 0, stop - 1).otherwise(F.size(lines))


def _from(lines: Column, start: Column) -> Column:
    """The lines from a place, counted from 1, on."""
    return F.slice(lines, start, F.greatest(F.size(lines) - start + 1, F.lit(0)))


def build_recipe(steps: Column) -> Column:
    """The recipe's lines, with the commands of ``steps`` between the first and the last."""
    tab = lambda s: F.concat(F.lit("\t"), s)
    return F.concat(F.array(F.lit("vale: $(VALE) ## Check prose"), F.lit("\t$(VALE) sync")), F.transform(F.coalesce(steps, _none()), tab), F.array(F.lit("\t$(VALE) --no-global .")))


def _above(lines: Column, line: str) -> Column:
    """``line``, and a blank line if there are others, above all."""
    return F.concat(F.when(F.size(lines) > 0, F.array(F.lit(line), F.lit(""))).otherwise(F.array(F.lit(line))), lines)


def ensure_variable(files: DataFrame, key: str, assignment: str) -> DataFrame:
    """``files`` (path, lines, ...) with the assignment above the lines where none defines ``key``."""
    have = F.exists("lines", lambda x: x.rlike(rf"^\Q{key}\E{SPACE}*[?:]?="))
    return files.withColumn("lines", F.when(have, F.col("lines")).otherwise(_above(F.col("lines"), assignment)))


def ensure_phony(files: DataFrame, target: str) -> DataFrame:
    """``files`` with the target on the first .PHONY line, or on a new one above all."""
    rows = files.withColumn("_at", _first(F.col("lines"), lambda x: strip(x).startswith(".PHONY")))
    words = lambda x: F.split(strip(x), f"{SPACE}+")
    added = F.transform("lines", lambda x, i: F.when((i + 1 == F.col("_at")) & ~F.array_contains(words(x), target), F.concat(rstrip(x), F.lit(f" {target}"))).otherwise(x))
    return rows.withColumn("lines", F.when(F.col("_at") > 0, added).otherwise(_above(F.col("lines"), f".PHONY: {target}"))).drop("_at")


def target_bounds(files: DataFrame, header: str) -> DataFrame:
    """``files`` with start and end, places counted from 0: the first line that begins with header, its tab lines, and then its blank lines; null if there is none."""
    rows = files.withColumn("start", _first(F.col("lines"), lambda x: x.startswith(header)))
    rows = rows.withColumn("_after", F.when(F.col("start") > 0, _from(F.col("lines"), F.col("start") + 1)).otherwise(_none()))
    rows = rows.withColumn("_tabs", _run(F.col("_after"), lambda x: x.startswith("\t")))
    rows = rows.withColumn("_blank", _run(_from(F.col("_after"), F.col("_tabs") + 1), lambda x: strip(x) == ""))
    end = F.when(F.col("start") > 0, F.col("start") + F.col("_tabs") + F.col("_blank"))
    return rows.withColumn("end", end).withColumn("start", F.when(F.col("start") > 0, F.col("start") - 1)).drop("_after", "_tabs", "_blank")


def replace_target(files: DataFrame, recipe: Column, header: str = "vale:") -> DataFrame:
    """``files`` with the recipe in the target's place, or after all lines with a blank line between."""
    lines = F.col("lines")
    gap = strip(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))) != ""
    after = F.concat(lines, F.when(gap, F.array(F.lit(""))).otherwise(_none()), F.col("_recipe"))
    inside = F.concat(F.slice(lines, F.lit(1), F.col("start")), F.col("_recipe"), _from(lines, F.col("end") + 1))
    rows = target_bounds(files, header).withColumn("_recipe", recipe)
    return rows.withColumn("lines", F.when(F.col("start").isNull(), after).otherwise(inside)).drop("start", "end", "_recipe")


def update_makefiles(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(path, text) for each request (path, steps): variable, phony target and recipe, in that order; a missing file is empty."""
    rows = requests.join(files.select("path", "text"), "path", "left").withColumn("lines", split_lines(F.coalesce("text", F.lit(""))))
    rows = ensure_phony(ensure_variable(rows, "VALE", "VALE ?= vale"), "vale")
    rows = replace_target(rows, build_recipe(F.col("steps")))
    return rows.select("path", F.concat(rstrip(F.array_join("lines", "\n")), F.lit("\n")).alias("text"))
