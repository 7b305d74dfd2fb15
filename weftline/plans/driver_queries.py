"""Queries on the driver tables, one for each operator family, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import values as V
from weftline.operators import allowlist, entries, ini, makefile, mapmerge, packaging, release
from weftline.sources.lines import explode_lines, strip


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_lines(_t(spark, sf_dir, "documents"), "doc_id", "text")


def line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = entries.token_lines(_doc_lines(spark, sf_dir))
    return tokens.groupBy(F.col("path").alias("doc_id")).agg(F.count("*").alias("n_entries"), F.sum(F.char_length("token")).alias("n_token_chars"))


def typed_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    raw = F.get_json_object("props", "$.k")
    pair = F.concat(F.lit("k="), raw)
    value = V.number_value(F.regexp_replace(pair, "^[^=]*=", ""))
    return e.select("event_id", F.substring_index(pair, "=", 1).alias("key"), value["i"].cast("long").alias("value"))


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), F.struct("ts", "event_id").alias("seq"), "value")
    out = entries.last_wins(e, ("user_id",))
    return out.select("user_id", F.col("key").alias("event_type"), F.col("seq.event_id").alias("first_id"), F.col("value").alias("last_value"))


def _joined(df: DataFrame, by: str, order: str, line: Column, head: str = "", tail: str = "") -> DataFrame:
    """(by, text): the lines of each key in order, a line feed after each."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    return df.groupBy(by).agg(F.concat(F.lit(head), F.array_join(lines, "\n"), F.lit("\n" + tail)).alias("text"))


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as existing entries, two to a key of the orders; the last order of each customer as the new one, at twice its number."""
    old = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("  ").alias("indent"), F.lit("").alias("comment"), F.col("c_custkey").alias("line_no"), F.expr("c_custkey % 5").cast("string").alias("raw"))
    new = _t(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("k"), F.col("o_orderkey").alias("seq"), F.expr("o_orderkey % 5").cast("string").alias("raw"))
    keyed = lambda df, *cols: df.select(F.concat(F.lit("s"), F.expr("k % 7").cast("string")).alias("path"), F.col("k").cast("string").alias("key"), *cols, V.inferred_value(F.col("raw"), trimmed=True).alias("value"))
    bounds = spark.range(7).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("path"), F.lit(1 << 40).alias("end"), F.lit("  ").alias("entry_indent"))
    return mapmerge.upsert_actions(keyed(old, "indent", "comment", "line_no"), entries.last_wins(keyed(new, "seq")), bounds)


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = V.render_value(F.coalesce("new", "old.value"))
    return _actions(spark, sf_dir).select("path", F.col("key").cast("long").alias("key"), "action", value.alias("value"))


def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _actions(spark, sf_dir).groupBy("path", "action").agg(F.count("*").alias("n"), F.sum(F.col("action").isin("insert", "update").cast("int")).alias("updated"))


def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sectioned files: a user's turn is a header, another one a pair."""
    turn = F.col("turn").cast("string")
    line = F.when(F.col("role") == "user", F.concat(F.lit("[u"), turn, F.lit("]"))).otherwise(F.concat("role", turn, F.lit(" = "), F.char_length("text").cast("string")))
    lines = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("line_no"), line.alias("line"))
    return ini.parse_ini(lines).select(F.col("path").alias("conv_id"), "section", F.col("sec_ord").cast("long").alias("sec_ord"), "key", F.col("key_ord").cast("long").alias("key_ord"), "value")


def block_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scripts of a user: a click opens a block, an error closes one; the end of the block that the first click opens."""
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    line = F.when(F.col("event_type") == "click", "f() {").when(F.col("event_type") == "error", "}").otherwise("g() {}")
    lines = _t(spark, sf_dir, "events").select(F.col("user_id").alias("path"), order.alias("line_no"), line.alias("line"))
    starts = lines.where("line = 'f() {'").groupBy("path").agg(F.min("line_no").alias("start"))
    return mapmerge.block_ends(lines, starts).select(F.col("path").alias("user_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_at"))


def _projects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A project for each region: its nations are styles of one file each; regions of even number have a manifest and no explicit styles."""
    region = F.concat(F.lit("R"), F.col("r_regionkey").cast("string"))
    nations = _t(spark, sf_dir, "nation").withColumn("project", F.concat(F.lit("R"), F.col("n_regionkey").cast("string")))
    files = nations.select("project", F.concat("n_name", F.lit("/Rule.yml")).alias("path"), F.encode(F.concat(F.lit("nation: "), F.col("n_nationkey").cast("string")), "UTF-8").alias("content"))
    first = nations.groupBy("project").agg(F.array(F.max("n_name"), F.min("n_name"), F.max("n_name")).alias("two"))
    even = F.col("r_regionkey") % 2 == 0
    toml = F.concat(F.lit('[install]\nstyle_name = " '), region, F.lit(' "\nmin_alert_level = "error"\n[[install.post_sync_steps]]\naction = "update-tengo-map"\nsource = "list of '), F.col("r_name"), F.lit('"\ndest = "d::m"\n'))
    requests = _t(spark, sf_dir, "region").withColumn("project", region).join(first, "project").select(
        "project", F.when(~even, F.col("two")).alias("explicit_styles"), F.lit(None).cast("string").alias("vocabulary"), F.lit("styles").alias("ini_styles_path"), F.concat(F.col("r_regionkey").cast("string"), F.lit(".0")).alias("version"), F.when(even, F.encode(toml, "UTF-8")).alias("manifest")
    )
    return requests, files


def joined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, files = _projects(spark, sf_dir)
    return packaging.choose_styles(requests, files).select("project", F.array_join("styles", "-").alias("stem"), "error")


def package_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of each project's archive, in order."""
    requests, files = _projects(spark, sf_dir)
    return packaging.archive_members(requests, files).select("project", "ord", "arcname", F.decode("content", "UTF-8").alias("content"))


def package_and_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's archive, and what the manifest in it asks for."""
    packed = packaging.package_styles(*_projects(spark, sf_dir)).withColumn("style_name", F.col("project"))
    got = release.read_manifests(packed, fail=False)
    return got.select("project", "archive_name", "manifest.style_name", "manifest.vocab_name", "manifest.min_alert_level", F.array_join("manifest.post_sync_steps", ";").alias("steps"), "error")


def _allow_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the words that each nation's script allows, customers as the words that it is to allow."""
    nation = F.concat(F.lit("n"), F.col("nation").cast("string"))
    words = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("k"))
    entry = F.concat(F.lit('  "A'), F.col("k").cast("string"), F.lit('": true,'))
    scripts = _joined(words.withColumn("path", nation), "path", "k", entry, "allow := {\n", "}\n")
    listed = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("line_no"), F.concat(F.lit(" a"), F.col("c_custkey").cast("string")).alias("line"))
    return allowlist.update_allow_maps(scripts, allowlist.parse_acronyms(listed.withColumn("path", nation)))


def allow_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _allow_maps(spark, sf_dir)
    return out.select("path", "changed", F.size("managed").cast("long").alias("n_managed"), "text", "error")


def ordered_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _allow_maps(spark, sf_dir).select("path", F.posexplode("managed").alias("pos", "token"))


def map_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's customers as a map in a script, brought up to the last orders of customers, and to the suppliers, which are new."""
    nation = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    c = _t(spark, sf_dir, "customer").withColumn("path", nation("c_nationkey"))
    line = F.concat(F.lit('  "C'), F.col("c_custkey").cast("string"), F.lit('": '), F.expr("c_custkey % 3").cast("string"), F.when(F.col("c_custkey") % 2 == 0, F.lit(", // even")).otherwise(F.lit(",")))
    scripts = _joined(c, "path", "c_custkey", line, "x := 1\nm := {\n", "}\nrest\n").withColumn("map_name", F.lit("m"))
    orders = _t(spark, sf_dir, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "path"), "o_custkey").select("path", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderkey").alias("seq"), F.expr("o_orderkey % 3").cast("string").alias("raw"))
    new = _t(spark, sf_dir, "supplier").select(nation("s_nationkey").alias("path"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_suppkey").alias("seq"), F.concat(F.lit('"'), "s_name", F.lit('"')).alias("raw"))
    listed = orders.unionByName(new).withColumn("value", V.inferred_value(F.col("raw"), trimmed=True))
    return mapmerge.update_maps(scripts, entries.last_wins(listed), fail=False)


def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = allowlist.parse_acronyms(_doc_lines(spark, sf_dir).withColumn("path", F.col("path").cast("string")))
    return words.select("path", F.col("first_pos").cast("long").alias("first_pos"), "token", "error")


def single_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the vocabularies of their nations."""
    files = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("project"), F.concat(F.lit("config/vocabularies/"), "s_name", F.lit("/accept.txt")).alias("path"))
    requests = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project"), F.when(F.col("n_nationkey") % 5 == 0, F.lit("")).when(F.col("n_nationkey") % 7 == 0, F.col("n_name")).alias("vocabulary"))
    return packaging.choose_vocabulary(requests, files)


def priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as releases, their lines as assets: the archive's own name, another archive, or neither."""
    name = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("o-"), F.col("l_orderkey").cast("string"), F.lit(".zip"))).otherwise(F.concat(F.lit("l"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linestatus") == "O", F.lit(".zip")).otherwise(F.lit(".txt"))))
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", name.alias("name")))).alias("assets"))
    payload = F.to_json(F.struct(F.concat(F.lit(" v"), F.col("l_orderkey").cast("string")).alias("tag_name"), F.transform("assets", lambda x: F.struct(x["name"].alias("name"))).alias("assets")))
    text = lambda v: F.lit(v).cast("string")
    requests = lines.select("l_orderkey", F.lit("w/o").alias("repo"), F.lit("o").alias("style_name"), text(None).alias("override_version"), text(None).alias("override_tag"), payload.alias("payload"))
    return release.resolve_releases(requests).select("l_orderkey", "version", "tag", "packages_url", "error")


def _brand_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as configuration files of their brands: a section for each type, a pair for each size, its last part the value."""
    p = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("k"), "p_type", "p_size")
    line = F.concat(F.lit("["), "p_type", F.lit("]\ns"), F.col("p_size").cast("string"), F.lit(" = "), F.col("k").cast("string"))
    return _joined(p, "path", "k", line, "; parts\nVocab = old\nStylesPath = styles\n\n")


def merge_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration files merged with two pairs that each section of them, and one more, is to have."""
    old = ini.parse_ini(explode_lines(_brand_files(spark, sf_dir))).where("section is not null")
    sections = old.select("path", "section").unionByName(old.select("path", F.lit("ZZ").alias("section"))).distinct()
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(i).alias("req_ord"), F.lit(v).alias("value")) for i, (k, v) in enumerate([("first", "a"), ("s7", "b")])])
    required = sections.select("path", "section", F.explode(pairs).alias("x")).select("path", "section", "x.*")
    return ini.merge_sections(old, required).where("key is not null").select("path", "section", "key", "value", F.row_number().over(Window.partitionBy("path", "section").orderBy("ord")).alias("rank"))


def ini_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's file, and one that is not there, brought up to what a style asks for."""
    files = _brand_files(spark, sf_dir)
    paths = files.select("path").unionByName(spark.range(1).select(F.lit("none").alias("path")))
    requests = paths.select("path", F.concat(F.lit("https://x/"), "path", F.lit(".zip")).alias("packages_url"), F.lit("sty").alias("style_name"), F.col("path").alias("vocab_name"), F.lit("warning").alias("min_alert_level"))
    return ini.update_ini(requests, files)


def makefile_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Makefile for each nation of some, with the target, the variable or the phony line there or not; customers' segments are the steps."""
    n = _t(spark, sf_dir, "nation").withColumn("path", F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))).withColumn("k", F.expr("n_nationkey % 4"))
    text = F.when(F.col("k") == 0, F.lit(".PHONY: all\nall:\n\techo\n")).when(F.col("k") == 1, F.lit("VALE := v\nvale: old\n\told\n\n\nlint:\n\techo\n")).when(F.col("k") == 2, F.lit("all:\n\techo\n\n"))
    steps = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_set("c_mktsegment")).alias("steps"))
    return makefile.update_makefiles(n.join(steps, "n_nationkey", "left").select("path", "steps"), n.where("k < 3").select("path", text.alias("text")))


def run_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("line_no"), F.col("event_type").alias("line"), "event_id")
    starts = e.where("line = 'error'").groupBy("path").agg(F.min("line_no").alias("start"))
    runs = allowlist.run_after(e, starts, F.col("line") == "error", one_blank=False)
    return e.join(runs, "path", "left").where("start is null or line_no < start or line_no >= end").select(F.col("path").alias("user_id"), "event_id")


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of their brands: where a block goes in, before the marker or else before the first closing brace."""
    line = F.when(F.expr("p_partkey % 97 = 0"), F.lit(f"  {allowlist.ROMAN_MARKER} ")).when(F.expr("p_size % 10 = 0"), F.lit(" }")).otherwise(F.col("p_name"))
    lines = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("line_no"), line.alias("line"))
    return allowlist.insertion_points(lines)


def reference_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and path of each page as a reference to a repository; deeper paths are none."""
    ref = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    short = F.when(F.col("page_id") % 3 == 0, F.concat(F.substring_index(ref, "/", 2), F.lit("-vale"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit(" "), F.substring_index(ref, "/", 2), F.lit(" "))).otherwise(ref)
    pages = _t(spark, sf_dir, "pages").select("page_id", V.repo_reference(short).alias("r"))
    download = release.download_url(F.concat_ws("/", "r.owner", "r.repo"), F.lit("v1"), F.col("r.style"))
    return pages.select("page_id", "r.owner", "r.repo", "r.style", F.when(F.col("r").isNotNull(), download).alias("download"))


def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.coalesce(V.trim_or(F.when(F.col("quality") == 1, F.col("lang")), V.trim_or(F.col("source"), F.lit("none")))).alias("chosen"))


def value_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals of several kinds, inferred and rendered again: integers, booleans, quoted text with and without escapes, floats, and other text."""
    o = _t(spark, sf_dir, "orders").withColumn("kind", F.expr("o_orderkey % 7"))
    key, quoted = F.col("o_orderkey").cast("string"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    raw = F.when(F.col("kind") == 0, key).when(F.col("kind") == 1, F.lit("TRUE")).when(F.col("kind") == 2, quoted(F.col("o_orderpriority"))).when(F.col("kind") == 3, quoted(F.concat("o_orderstatus", F.lit('\\t\\"'), key)))
    raw = raw.when(F.col("kind") == 4, F.concat(key, F.lit(".5"))).when(F.col("kind") == 5, F.concat(F.lit(' "'), key, F.lit('" "x" '))).otherwise(F.col("o_orderstatus"))
    # A column a step: the value is used many times and computed once.
    o = o.select("o_orderkey", raw.alias("raw")).select("o_orderkey", strip(F.col("raw")).alias("raw"))
    o = o.select("o_orderkey", V.inferred_value(F.col("raw"), trimmed=True).alias("v"))
    return o.select("o_orderkey", F.col("v.tag").alias("tag"), V.render_value(F.col("v")).alias("literal"))


def value_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's number of several kinds against another one's."""
    kinds = [F.col("n").cast("string"), F.concat(F.col("n").cast("string"), F.lit(".0")), F.when(F.col("n") == 1, F.lit("true")).otherwise(F.lit("False")), F.concat(F.lit('"'), F.col("n").cast("string"), F.lit('"')), F.lit("nan")]
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_linenumber % 3").alias("n"), F.expr("l_orderkey % 5").alias("a"), F.expr("(l_orderkey + l_linenumber) % 5").alias("b"))
    rows = rows.select("l_orderkey", "l_linenumber", *[F.element_at(F.array(*kinds), (F.col(c) + 1).cast("int")).alias(c) for c in "ab"])
    rows = rows.select("l_orderkey", "l_linenumber", *[V.inferred_value(F.col(c), trimmed=True).alias(c) for c in "ab"])
    return rows.select("l_orderkey", "l_linenumber", V.values_equal(F.col("a"), F.col("b")).alias("same"))


def entry_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entry lines in each mode, with lines that the mode can't read."""
    p = _t(spark, sf_dir, "part").withColumn("mode", F.element_at(F.array(*map(F.lit, entries.MODES)), (F.expr("p_partkey % 4") + 1).cast("int")))
    value = F.when(F.expr("p_size % 5 = 0"), F.lit("true")).when(F.expr("p_size % 5 = 1"), F.col("p_size").cast("string")).otherwise(F.col("p_type"))
    line = F.when(F.expr("p_size % 7 = 0"), F.col("p_name")).when(F.expr("p_size % 11 = 0"), F.concat(F.lit(" = "), value)).otherwise(F.concat("p_name", F.lit(" = "), value, F.lit("  # size")))
    lines = p.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("line_no"), line.alias("line"), "mode")
    out = entries.parse_entries(lines, F.col("mode"))
    return out.select("path", "seq", F.when(F.col("error").isNull(), F.col("key")).alias("key"), F.when(F.col("error").isNull(), V.render_value(F.col("value"))).alias("literal"), "error")


_QUERIES = [
    line_parse, typed_kv, last_wins, upsert, upsert_counts, section_fill, block_end, joined_names, ordered_difference, keep_first, single_or_null, priority_pick, merge_sections, run_removal, insert_if_absent, reference_split, fallback_chain, value_inference,
    value_equality, entry_errors, map_update, allow_update, ini_update, makefile_update, package_members, package_and_manifest,
]

_LINES = r"""lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM (
    SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM (
      SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]') AS ls FROM documents WHERE text IS NOT NULL)))"""

_UPSERT = """SELECT 's' || (key % 7) AS path, key, CASE WHEN new IS NULL THEN 'keep' WHEN old IS NULL THEN 'insert' WHEN old = new THEN 'noop' ELSE 'update' END AS action, coalesce(new, old)::VARCHAR AS value
FROM (SELECT c_custkey AS key, c_custkey % 5 AS old FROM customer) FULL JOIN (SELECT 2 * o_custkey AS key, arg_max(o_orderkey % 5, o_orderkey) AS new FROM orders GROUP BY 1) USING (key)"""

_MANAGED = f"""s AS (SELECT 'n' || s_nationkey AS path, string_agg('  "A' || s_suppkey || '": true,', chr(10) ORDER BY s_suppkey) AS body FROM supplier GROUP BY 1),
w AS (SELECT 'n' || c_nationkey AS path, 'A' || c_custkey AS token, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos
  FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey = c_custkey) AND c_nationkey IN (SELECT s_nationkey FROM supplier))"""

_BRANDS = """parts AS (SELECT p_brand AS path, p_type AS section, 's' || p_size AS key, min(p_partkey) AS key_ord, max(p_partkey)::VARCHAR AS value FROM part GROUP BY ALL)"""

_PROJECTS = """nations AS (SELECT 'R' || n_regionkey AS project, n_regionkey AS r, n_nationkey AS k, n_name AS name FROM nation),
chosen AS (SELECT *, name IN (min(name) OVER (PARTITION BY r), max(name) OVER (PARTITION BY r)) OR r % 2 = 0 AS taken FROM nations),
stems AS (SELECT project, r, string_agg(name, '-' ORDER BY name) AS names FROM chosen WHERE taken GROUP BY ALL)"""

_SQL = {
    "line_parse": f"""WITH {_LINES}, tokens AS (SELECT doc_id, trim(regexp_replace(line, '\\s+(#.*)?$', '')) AS token FROM lines WHERE trim(line) <> '' AND NOT regexp_matches(line, '^\\s*#'))
SELECT doc_id, count(*) AS n_entries, sum(length(token))::BIGINT AS n_token_chars FROM tokens WHERE token <> '' GROUP BY 1""",
    "typed_kv": "SELECT event_id, 'k' AS key, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events",
    "last_wins": "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1, 2",
    "run_removal": """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, min(n) AS start FROM e WHERE event_type = 'error' GROUP BY 1),
t AS (SELECT user_id, start, coalesce(min(CASE WHEN event_type <> 'error' THEN n END), 1000000000) AS stop FROM e JOIN s USING (user_id) WHERE n > start GROUP BY 1, 2)
SELECT e.user_id, event_id FROM e LEFT JOIN s USING (user_id) LEFT JOIN t USING (user_id) WHERE s.start IS NULL OR n < s.start OR n >= coalesce(t.stop, s.start + 1)""",
    "fallback_chain": "SELECT doc_id, coalesce(nullif(trim(CASE WHEN quality = 1 THEN lang END), ''), nullif(trim(source), ''), 'none') AS chosen FROM documents LEFT JOIN labels USING (doc_id)",
    "upsert": _UPSERT,
    "upsert_counts": f"SELECT path, action, count(*) AS n, sum((action IN ('insert', 'update'))::INT)::BIGINT AS updated FROM ({_UPSERT}) GROUP BY ALL",
    "section_fill": """WITH t AS (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM conversations)
SELECT conv_id, 'u' || head AS section, coalesce(head, -1)::BIGINT AS sec_ord, CASE WHEN role <> 'user' THEN role || turn END AS key, turn::BIGINT AS key_ord, CASE WHEN role <> 'user' THEN length(text)::VARCHAR END AS value FROM t""",
    "block_end": """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type FROM events),
s AS (SELECT user_id, min(n) AS start FROM e WHERE event_type = 'click' GROUP BY 1),
d AS (SELECT user_id, n, 1 + sum(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth FROM e JOIN s USING (user_id) WHERE n > start)
SELECT user_id, start, min(n) AS end_at FROM s LEFT JOIN (SELECT user_id, n FROM d WHERE depth = 0) USING (user_id) GROUP BY 1, 2""",
    "joined_names": f"WITH {_PROJECTS} SELECT project, names AS stem, NULL::VARCHAR AS error FROM stems",
    "ordered_difference": f"WITH {_MANAGED} SELECT path, pos::INT AS pos, token FROM w",
    "allow_update": f"""WITH {_MANAGED}, m AS (SELECT path, count(*) AS n, string_agg('  "' || token || '": true,', chr(10) ORDER BY pos) AS block FROM w GROUP BY 1)
SELECT path, n IS NOT NULL AS changed, coalesce(n, 0) AS n_managed, 'allow := {{' || chr(10) || body || chr(10) || coalesce('  {allowlist.MANAGED_COMMENT}' || chr(10) || block || chr(10) || chr(10), '') || '}}' || chr(10) AS text, NULL::VARCHAR AS error FROM s LEFT JOIN m USING (path)""",
    "keep_first": f"""WITH {_LINES}, up AS (SELECT doc_id::VARCHAR AS path, line_no, trim(line) AS raw, upper(replace(trim(line), 'ß', 'SS')) AS token FROM lines WHERE trim(line) <> '' AND trim(line)[1] <> '#'),
k AS (SELECT path, min(line_no) AS first_pos, token, arg_min(raw, line_no) AS raw FROM up GROUP BY path, token)
SELECT path, first_pos, token, CASE WHEN NOT regexp_full_match(token, '[0-9A-Z]+') THEN 'Line ' || (first_pos + 1) || ' in ' || path || ' must be alphanumeric; got ' || chr(39) || raw || chr(39) || '.' END AS error FROM k""",
    "single_or_null": """SELECT n_nationkey AS project, coalesce(CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 7 = 0 THEN n_name END, CASE WHEN count(s_suppkey) = 1 THEN min(s_name) END) AS vocab
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name""",
    "priority_pick": """SELECT l_orderkey, l_orderkey::VARCHAR AS version, 'v' || l_orderkey AS tag, 'https://github.com/w/o/releases/download/v' || l_orderkey || '/' ||
CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 AND count(*) FILTER (l_linestatus = 'O') > 0 THEN 'l' || min(l_linenumber) FILTER (l_linestatus = 'O') ELSE 'o-' || l_orderkey END || '.zip' AS packages_url, NULL::VARCHAR AS error FROM lineitem GROUP BY l_orderkey""",
    "merge_sections": f"""WITH {_BRANDS}, sec AS (SELECT path, section FROM parts UNION SELECT path, 'ZZ' FROM parts), req AS (SELECT * FROM sec, (VALUES ('first', 0, 'a'), ('s7', 1, 'b')) r(key, req_ord, new))
SELECT path, section, key, coalesce(new, value) AS value, row_number() OVER (PARTITION BY path, section ORDER BY coalesce(req_ord - 1000000, key_ord))::INT AS rank FROM parts FULL JOIN req USING (path, section, key)""",
    "ini_update": f"""WITH {_BRANDS}, sec AS (SELECT path, section, '[' || section || ']' || chr(10) || string_agg(key || ' = ' || value, chr(10) ORDER BY key_ord) || chr(10) AS body FROM parts GROUP BY 1, 2),
own AS (SELECT path, 'StylesPath = styles' || chr(10) AS root, string_agg(body, chr(10) ORDER BY section) AS body FROM sec GROUP BY 1 UNION ALL SELECT 'none', '', NULL)
SELECT path, 'Packages = https://x/' || path || '.zip' || chr(10) || 'MinAlertLevel = warning' || chr(10) || 'Vocab = ' || path || chr(10) || root || chr(10)
|| '[docs/**/*.{{md,markdown,mdx}}]' || chr(10) || 'BasedOnStyles = sty' || chr(10) || '# Ignore for footnotes' || chr(10) || 'BlockIgnores = {ini.FOOTNOTES}' || chr(10) || chr(10)
|| '[AGENTS.md]' || chr(10) || 'BasedOnStyles = sty' || chr(10) || chr(10) || '[*.{{rs,ts,js,sh,py}}]' || chr(10) || 'BasedOnStyles = sty' || chr(10) || 'sty.RustNoRun = NO' || chr(10) || 'sty.Acronyms = NO' || chr(10) || chr(10)
|| '[README.md]' || chr(10) || 'BasedOnStyles = sty' || chr(10) || 'sty.Pronouns = NO' || chr(10) || coalesce(chr(10) || body, '') AS text FROM own""",
    "makefile_update": """WITH steps AS (SELECT c_nationkey AS k, string_agg(DISTINCT chr(9) || c_mktsegment || chr(10), '' ORDER BY chr(9) || c_mktsegment || chr(10)) AS body FROM customer GROUP BY 1),
r AS (SELECT n_nationkey AS k, 'vale: $(VALE) ## Check prose' || chr(10) || chr(9) || '$(VALE) sync' || chr(10) || coalesce(body, '') || chr(9) || '$(VALE) --no-global .' || chr(10) AS recipe FROM nation LEFT JOIN steps ON k = n_nationkey)
SELECT 'n' || k AS path, CASE k % 4 WHEN 0 THEN E'VALE ?= vale\\n\\n.PHONY: all vale\\nall:\\n\\techo\\n\\n' || recipe WHEN 1 THEN E'.PHONY: vale\\n\\nVALE := v\\n' || recipe || E'lint:\\n\\techo\\n'
WHEN 2 THEN E'.PHONY: vale\\n\\nVALE ?= vale\\n\\nall:\\n\\techo\\n\\n' || recipe ELSE E'.PHONY: vale\\n\\nVALE ?= vale\\n\\n' || recipe END AS text FROM r""",
    "map_update": """WITH o AS (SELECT o_custkey AS k, arg_max(o_orderkey % 3, o_orderkey) AS new, min(o_orderkey) AS seq FROM orders GROUP BY 1),
c AS (SELECT 'n' || c_nationkey AS path, c_custkey AS k, coalesce(new, c_custkey % 3) AS v, new IS NOT NULL AND new <> c_custkey % 3 AS changed FROM customer LEFT JOIN o ON k = c_custkey),
m AS (SELECT path, string_agg('  "C' || k || '": ' || v || CASE WHEN k % 2 = 0 THEN ', // even' ELSE ',' END, chr(10) ORDER BY k) AS body, sum(changed::INT) AS n FROM c GROUP BY 1),
s AS (SELECT 'n' || s_nationkey AS path, string_agg('  "S' || s_suppkey || '": "' || s_name || '",' || chr(10), '' ORDER BY s_suppkey) AS body, count(*) AS n FROM supplier GROUP BY 1)
SELECT path, (m.n + coalesce(s.n, 0))::BIGINT AS updated, m.n + coalesce(s.n, 0) > 0 AS changed, E'x := 1\\nm := {\\n' || m.body || chr(10) || coalesce(s.body, '') || E'}\\nrest\\n' AS text, NULL::VARCHAR AS error FROM m LEFT JOIN s USING (path)""",
    "package_members": f"""WITH {_PROJECTS}, rows AS (
SELECT project, r, 0 AS part, '' AS name, '.vale.ini' AS file, E'StylesPath = styles\\n' AS content FROM stems
UNION ALL SELECT project, r, 1, '', '{release.MANIFEST_NAME}', '[install]' || chr(10) || 'style_name = " ' || project || ' "' || chr(10) || 'min_alert_level = "error"' || chr(10) || '[[install.post_sync_steps]]' || chr(10) || 'action = "update-tengo-map"' || chr(10) || 'source = "list of ' || r_name || '"' || chr(10) || 'dest = "d::m"' || chr(10) FROM stems JOIN region ON r_regionkey = r WHERE r % 2 = 0
UNION ALL SELECT project, r, 2, name, 'styles/' || name || '/Rule.yml', 'nation: ' || k FROM chosen WHERE taken)
SELECT project, row_number() OVER (PARTITION BY project ORDER BY part, name) - 1 AS ord, names || '-' || r || '.0/' || file AS arcname, content FROM rows JOIN stems USING (project, r)""",
    "package_and_manifest": f"""WITH {_PROJECTS} SELECT project, names || '-' || r || '.0.zip' AS archive_name, project AS style_name, project AS vocab_name, CASE WHEN r % 2 = 0 THEN 'error' ELSE 'warning' END AS min_alert_level,
CASE WHEN r % 2 = 0 THEN 'uv run {release.TOOL} update-tengo-map --source ' || chr(39) || 'list of ' || r_name || chr(39) || ' --dest d::m --type true' ELSE '' END AS steps, NULL::VARCHAR AS error FROM stems JOIN region ON r_regionkey = r""",
    "insert_if_absent": "SELECT p_brand AS path, coalesce(min(CASE WHEN p_partkey % 97 = 0 THEN p_partkey END), min(CASE WHEN p_size % 10 = 0 THEN p_partkey END)) AS at FROM part GROUP BY 1",
    "reference_split": r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS ref FROM pages), p AS (SELECT *, string_split(ref, '/') AS x FROM u),
q AS (SELECT page_id, CASE WHEN page_id % 3 <> 2 OR len(x) = 2 THEN x[1] END AS owner, CASE WHEN page_id % 3 <> 2 OR len(x) = 2 THEN x[2] || CASE WHEN page_id % 3 = 0 THEN '-vale' ELSE '' END END AS repo, x[2] AS style FROM p)
SELECT page_id, owner, repo, CASE WHEN repo IS NOT NULL THEN style END AS style, CASE WHEN repo IS NOT NULL THEN 'https://github.com/' || owner || '/' || repo || '/releases/download/v1/' || style END AS download FROM q""",
    "value_inference": r"""WITH o AS (SELECT o_orderkey, o_orderkey::VARCHAR AS k, o_orderkey % 7 AS kind, o_orderpriority AS p, o_orderstatus AS s FROM orders)
SELECT o_orderkey, CASE kind WHEN 0 THEN 'int' WHEN 1 THEN 'bool' WHEN 4 THEN 'float' ELSE 'str' END AS tag,
CASE kind WHEN 0 THEN k WHEN 1 THEN 'true' WHEN 2 THEN '"' || p || '"' WHEN 3 THEN '"' || s || '\t\"' || k || '"' WHEN 4 THEN k || '.5' WHEN 5 THEN '"' || k || '\" \"x"' ELSE '"' || s || '"' END AS literal FROM o""",
    "value_equality": """WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS n, l_orderkey % 5 AS a, (l_orderkey + l_linenumber) % 5 AS b FROM lineitem),
v AS (SELECT *, CASE a WHEN 2 THEN (n = 1)::INT WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE n END AS x, CASE b WHEN 2 THEN (n = 1)::INT WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE n END AS y FROM r)
SELECT l_orderkey, l_linenumber, coalesce(x = y, a = 3 AND b = 3) AS same FROM v""",
    "entry_errors": """WITH p AS (SELECT p_brand AS path, p_partkey AS seq, p_partkey % 4 AS mode, p_name AS name, p_size % 7 = 0 AS bare, p_size % 11 = 0 AND p_size % 7 <> 0 AS empty, p_size % 5 AS kind,
CASE p_size % 5 WHEN 0 THEN 'true' WHEN 1 THEN p_size::VARCHAR ELSE p_type END AS v FROM part),
e AS (SELECT *, CASE WHEN mode > 0 AND bare THEN 'Source lines must include ''='' when using typed modes.' WHEN mode > 0 AND empty THEN 'Map keys may not be empty.' WHEN mode = 2 AND kind <> 0 THEN 'Expected true or false, got ' || chr(39) || v || chr(39)
WHEN mode = 3 AND kind <> 1 THEN 'Could not parse numeric value ' || chr(39) || v || chr(39) END AS error FROM p)
SELECT path, seq, CASE WHEN error IS NULL THEN CASE WHEN mode > 0 OR bare THEN name WHEN empty THEN '= ' || v ELSE name || ' = ' || v END END AS key,
CASE WHEN error IS NULL THEN CASE mode WHEN 0 THEN 'true' WHEN 1 THEN '"' || v || '"' ELSE v END END AS literal, error FROM e""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
