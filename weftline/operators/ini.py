"""Sectioned configuration files: parse, merge with what is required, render in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.lines import explode_lines, rstrip, strip

#: Options and sections in the order in which they are written, and what the sections require.
ROOT_ORDER = ["Packages", "MinAlertLevel", "Vocab"]
SECTION_ORDER = ["docs/**/*.{md,markdown,mdx}", "AGENTS.md", "*.{rs,ts,js,sh,py}", "README.md"]
FOOTNOTES = r"(?m)^\[\^\d+\]:[^\n]*(?:\n[ \t]+[^\n]*)*"
#: (section, key, value); $ stands for the style's name, but in FOOTNOTES.
REQUIRED = [
    ("docs/**/*.{md,markdown,mdx}", "BasedOnStyles", "$"),
    ("docs/**/*.{md,markdown,mdx}", "BlockIgnores", FOOTNOTES),
    ("AGENTS.md", "BasedOnStyles", "$"),
    ("*.{rs,ts,js,sh,py}", "BasedOnStyles", "$"),
    ("*.{rs,ts,js,sh,py}", "$.RustNoRun", "NO"),
    ("*.{rs,ts,js,sh,py}", "$.Acronyms", "NO"),
    ("README.md", "BasedOnStyles", "$"),
    ("README.md", "$.Pronouns", "NO"),
]


def parse_ini(lines: DataFrame) -> DataFrame:
    """(path, section, sec_ord, key, key_ord, value): pairs of each section; section null is the root, before any header.

    Blank lines, # and ; comments and lines without = fall away. A repeated header goes on with its first one's section, and
    a repeated key has its last value at its first place. A section without pairs is one row with a null key.
    """
    s = strip(F.col("line"))
    rows = lines.where((s != "") & ~s.startswith("#") & ~s.startswith(";")).withColumn("s", s)
    is_header = F.col("s").startswith("[") & F.col("s").endswith("]")
    name = strip(F.expr("substring(s, 2, char_length(s) - 2)"))
    rows = rows.withColumn("header", F.when(is_header, name))
    carried = F.last("header", ignorenulls=True).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("section", carried).withColumn("is_header", is_header)
    pair = ~F.col("is_header") & (F.instr("line", "=") > 0)
    key, value = strip(F.substring_index("line", "=", 1)), strip(F.regexp_replace("line", "^[^=]*=", ""))
    named = rows.withColumn("key", F.when(pair, key)).withColumn("value", F.when(pair, value)).where(pair | F.col("is_header"))
    merged = named.groupBy("path", "section", "key").agg(F.min("line_no").alias("key_ord"), F.max_by("value", "line_no").alias("value"))
    sec_ord = F.min("key_ord").over(Window.partitionBy("path", "section"))
    return merged.select("path", "section", F.when(F.col("section").isNull(), -1).otherwise(sec_ord).alias("sec_ord"), "key", "key_ord", "value")


def required_options(requests: DataFrame) -> DataFrame:
    """(path, section, key, req_ord, value) from (path, packages_url, style_name, vocab_name, min_alert_level)."""
    root = F.array(*[F.struct(F.lit(None).cast("string").alias("section"), F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in zip(ROOT_ORDER, ("packages_url", "min_alert_level", "vocab_name"), strict=True)])
    filled = lambda t: F.replace(F.lit(t), F.lit("$"), F.col("style_name"))
    sections = F.array(*[F.struct(F.lit(section).alias("section"), filled(key).alias("key"), (F.lit(v) if v == FOOTNOTES else filled(v)).alias("value")) for section, key, v in REQUIRED])
    rows = requests.select("path", F.posexplode(F.concat(root, sections)).alias("req_ord", "x"))
    return rows.select("path", "x.section", "x.key", "req_ord", "x.value")


def merge_sections(existing: DataFrame, required: DataFrame) -> DataFrame:
    """(path, section, key, value, rank, ord): the union by section and key; required values win.

    In the root an existing key keeps its place; in a section required keys come first, then the others in their order.
    """
    old = existing.where("key is not null or section is not null").select("path", F.coalesce("section", F.lit("")).alias("_sec"), F.col("section").isNull().alias("_root"), "key", "key_ord", F.col("value").alias("old"))
    new = required.select("path", F.coalesce("section", F.lit("")).alias("_sec"), F.col("section").isNull().alias("_root"), "key", "req_ord", F.col("value").alias("new"))
    both = old.join(new, ["path", "_sec", "_root", "key"], "full_outer")
    at_once = F.when(F.col("_root"), F.coalesce("key_ord", F.lit(1_000_000_000) + F.col("req_ord"))).otherwise(F.coalesce(F.col("req_ord") - 1_000_000, F.col("key_ord")))
    return both.select("path", F.when(~F.col("_root"), F.col("_sec")).alias("section"), "key", F.coalesce("new", "old").alias("value"), at_once.alias("ord"))


def ini_lines(options: DataFrame) -> DataFrame:
    """(path, k1, k2, k3, line) of rendered options: the root in ROOT_ORDER and then as it was, sections in SECTION_ORDER and then by name."""
    root_rank = F.coalesce(F.array_position(F.lit(ROOT_ORDER), F.col("key")).cast("int"), F.lit(0))
    root_rank = F.when(root_rank == 0, 99).otherwise(root_rank)
    sec_rank = F.array_position(F.lit(SECTION_ORDER), F.col("section")).cast("int")
    place = F.when(F.col("section").isNull(), F.lit("0")).when(sec_rank > 0, F.concat(F.lit("1"), sec_rank.cast("string"))).otherwise(F.concat(F.lit("2"), F.col("section")))
    rows = options.withColumn("k1", place).withColumn("k2", F.when(F.col("section").isNull(), root_rank).otherwise(1))
    pair = F.concat(F.col("key"), F.lit(" = "), F.col("value"))
    line = F.when(F.col("key") == "BlockIgnores", F.when(F.col("section").isNotNull(), F.concat(F.lit("# Ignore for footnotes\n"), pair)).otherwise(pair)).otherwise(pair)
    body = rows.where("key is not null").select("path", "k1", "k2", F.col("ord").cast("long").alias("k3"), line.alias("line"))
    heads = rows.select("path", "k1", "section").distinct()
    least = F.lit(-(1 << 60))
    head = heads.where("section is not null").select("path", "k1", F.lit(0).alias("k2"), least.alias("k3"), F.concat(F.lit("["), "section", F.lit("]")).alias("line"))
    blank = heads.select("path", "k1", F.lit(1000).alias("k2"), F.lit(0).cast("long").alias("k3"), F.lit("").alias("line"))
    return body.unionByName(head).unionByName(blank)


def render_ini(options: DataFrame) -> DataFrame:
    """(path, text), without white space at the end but for one LF."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k1", "k2", "k3", "line"))), lambda x: x["line"])
    return ini_lines(options).groupBy("path").agg(F.concat(rstrip(F.array_join(ordered, "\n")), F.lit("\n")).alias("text"))


def update_ini(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(path, text) for each request (path, packages_url, style_name, vocab_name, min_alert_level); a file that isn't there is empty."""
    existing = parse_ini(explode_lines(files.join(requests.select("path"), "path", "left_semi")))
    return render_ini(merge_sections(existing, required_options(requests)))
