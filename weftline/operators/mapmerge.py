"""Keyed upsert of entries into map literals of scripts, many scripts at a time.

Lines have order keys (k1, k2, k3): line i is (i, 1, 0), what is inserted before line e is (e, 0, seq). So nothing moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import values as V
from weftline.operators.entries import EntryError
from weftline.sources.lines import SPACE, explode_lines, render, strip

#: Fixed value: a line of a map: indent, quoted key, value, the comma it must have, and a // comment.
ENTRY = rf'^({SPACE}*)"((?:[^"\\]|\\.)+)"{SPACE}*:{SPACE}*(.*),({SPACE}*//.*)?{SPACE}*$'


def header_lines(lines: DataFrame, name: Column) -> DataFrame:
    """(path, start, map_indent): the first line that opens the map ``name``, alone on its line."""
    quoted = F.concat(F.lit(rf"^{SPACE}*"), F.regexp_replace(name, r"([\\^$.|?*+()\[\]{}])", r"\\$1"), F.lit(rf"{SPACE}*:={SPACE}*\{{{SPACE}*$"))
    hit = lines.where(F.regexp_like("line", quoted))
    return hit.groupBy("path").agg(F.min("line_no").alias("start"), F.min_by(F.regexp_extract("line", f"^({SPACE}*)", 1), "line_no").alias("map_indent"))


def block_ends(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(path, start, end): the first line after the start at which the depth of braces, 1 at the start, is 0; null if none is."""
    inner = lines.join(starts.select("path", "start"), "path").where("line_no > start")
    change = F.char_length(F.regexp_replace("line", "[^{]", "")) - F.char_length(F.regexp_replace("line", "[^}]", ""))
    depth = 1 + F.sum(change).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    ends = inner.withColumn("depth", depth).where("depth = 0").groupBy("path").agg(F.min("line_no").alias("end"))
    return starts.join(ends, "path", "left")


def existing_entries(lines: DataFrame, bounds: DataFrame) -> DataFrame:
    """(path, line_no, indent, key, raw_value, comment, value) of the entry lines between start and end, repeated keys included."""
    inner = lines.join(bounds.select("path", "start", "end"), "path").where("line_no > start and line_no < end")
    part = lambda k: F.regexp_extract("line", ENTRY, k)
    hit = inner.where(F.col("line").rlike(ENTRY)).select("path", "line_no", part(1).alias("indent"), part(2).alias("key"), strip(part(3)).alias("raw_value"), part(4).alias("comment"))
    return hit.withColumn("value", V.inferred_value(F.col("raw_value"), trimmed=True))


def upsert_actions(existing: DataFrame, entries: DataFrame, bounds: DataFrame) -> DataFrame:
    """A row for each key of either side, with the action keep, noop, update or insert, by a full outer join on path and key.

    Of repeated existing keys the last line is the one that counts.
    """
    last = existing.groupBy("path", "key").agg(F.max("line_no").alias("line_no"), F.max_by(F.struct("indent", "comment", "value"), "line_no").alias("old"))
    new = entries.select("path", "key", "seq", F.col("value").alias("new"))
    both = last.join(new, ["path", "key"], "full_outer").join(bounds.select("path", "end", "entry_indent"), "path")
    same = V.values_equal(F.col("old.value"), F.col("new"))
    action = F.when(F.col("seq").isNull(), "keep").when(F.col("line_no").isNull(), "insert").when(same, "noop").otherwise("update")
    return both.withColumn("action", action)


def render_entry(indent: Column, key: Column, value: Column, comment: Column) -> Column:
    return F.concat(indent, F.lit('"'), key, F.lit('": '), V.render_value(value), F.lit(","), comment)


def update_maps(scripts: DataFrame, entries: DataFrame, fail: bool = True) -> DataFrame:
    """(path, updated, changed, text, error): each script with its map brought up to the entries.

    ``scripts`` has path, text and map_name; ``entries`` path, key, seq and value (see last_wins). A different value replaces the line in
    place, with indent and comment kept; a new key goes before the closing brace; equal values leave their lines as they are.
    changed is true also if only line ends differ. A map that isn't found is an error: raised, or as data if ``fail`` is false, the text then being the old one.
    """
    lines = explode_lines(scripts)
    named = lines.join(scripts.select("path", "map_name"), "path")
    bounds = block_ends(lines, header_lines(named, F.col("map_name")))
    found = existing_entries(lines, bounds)
    first = found.groupBy("path").agg(F.min_by("indent", "line_no").alias("_indent"))
    bounds = bounds.join(first, "path", "left").withColumn("entry_indent", F.coalesce("_indent", F.concat("map_indent", F.lit("  "))))
    actions = upsert_actions(found, entries, bounds.where("end is not null"))
    updates = actions.where("action = 'update'").select("path", "line_no", render_entry(F.col("old.indent"), F.col("key"), F.col("new"), F.col("old.comment")).alias("_new"))
    kept = lines.join(updates, ["path", "line_no"], "left").select("path", F.col("line_no").alias("k1"), F.lit(1).alias("k2"), F.lit(0).alias("k3"), F.coalesce("_new", "line").alias("line"))
    inserts = actions.where("action = 'insert'").select("path", F.col("end").alias("k1"), F.lit(0).alias("k2"), F.col("seq").alias("k3"), render_entry(F.col("entry_indent"), F.col("key"), F.col("new"), F.lit("")).alias("line"))
    counts = actions.groupBy("path").agg(F.sum(F.col("action").isin("update", "insert").cast("int")).alias("updated"))
    error = (
        F.when(F.col("map_name") == "", F.lit("Map name must be provided."))
        .when(F.col("start").isNull(), F.concat(F.lit("Could not find map '"), F.col("map_name"), F.lit("' in Tengo script.")))
        .when(F.col("end").isNull(), F.lit("Failed to locate closing brace for map."))
    )
    out = scripts.select("path", F.col("text").alias("old_text"), "map_name").join(bounds.select("path", "start", "end"), "path", "left").withColumn("error", error)
    out = out.join(render(kept.unionByName(inserts)), "path", "left").join(counts, "path", "left")
    text = F.when(F.col("error").isNotNull(), F.col("old_text")).otherwise(F.coalesce("text", F.lit("\n")))
    out = out.select("path", F.coalesce("updated", F.lit(0)).cast("long").alias("updated"), (text != F.col("old_text")).alias("changed"), text.alias("text"), "error")
    if fail:
        worst = out.where("error is not null").agg(F.min(F.struct("path", "error")).alias("e")).first()["e"]
        if worst is not None:
            raise EntryError(worst["error"])
    return out


