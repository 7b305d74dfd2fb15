"""Style packages: which styles and vocabulary, the archive's members in order, and the archive."""

from __future__ import annotations

import io
import tomllib
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.release import MANIFEST_NAME

MEMBERS = "project string, ord long, arcname string, content binary"


def discovered_styles(files: DataFrame) -> DataFrame:
    """(project, style): first path segments of (project, path) below the styles folder that are directories, but config."""
    return files.where((F.instr("path", "/") > 0) & ~F.col("path").startswith("config/")).select("project", F.substring_index("path", "/", 1).alias("style")).distinct()


def choose_styles(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(project, styles, error): the explicit styles, sorted and each once, if there are any; else all that are there."""
    there = discovered_styles(files).groupBy("project").agg(F.sort_array(F.collect_list("style")).alias("found"))
    folders = files.where(F.instr("path", "/") > 0).groupBy("project").agg(F.collect_set(F.substring_index("path", "/", 1)).alias("folders"))
    r = requests.select("project", F.sort_array(F.array_distinct(F.coalesce("explicit_styles", F.array().cast("array<string>")))).alias("explicit")).join(there, "project", "left").join(folders, "project", "left")
    none = F.array().cast("array<string>")
    missing = F.array_except("explicit", F.coalesce("folders", none))
    asked = F.size("explicit") > 0
    error = F.when(asked & (F.size(missing) > 0), F.concat(F.lit("Styles not found: "), F.array_join(missing, ", "))).when(~asked & F.col("found").isNull(), F.lit("No styles found"))
    return r.select("project", F.when(asked, F.col("explicit")).otherwise(F.coalesce("found", none)).alias("styles"), error.alias("error"))


def choose_vocabulary(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(project, vocab): the one asked for, else the only one that is there, else null."""
    names = files.select("project", F.regexp_extract("path", "^config/vocabularies/([^/]+)/", 1).alias("name")).where("name <> ''").distinct()
    only = names.groupBy("project").agg(F.when(F.count("*") == 1, F.min("name")).alias("only"))
    return requests.join(only, "project", "left").select("project", F.coalesce(F.nullif("vocabulary", F.lit("")), "only").alias("vocab"))


def package_ini(styles_path: Column, vocab: Column) -> Column:
    """The archive's configuration text."""
    return F.concat(F.lit("StylesPath = "), styles_path, F.when(F.coalesce(vocab, F.lit("")) != "", F.concat(F.lit("\nVocab = "), vocab)).otherwise(F.lit("")), F.lit("\n"))


@F.pandas_udf(T.StringType())
def project_version(toml: pd.Series) -> pd.Series:
    """The version of a project file's bytes; null if it is blank or not a string. A file that isn't TOML raises."""

    def one(raw: bytes | None) -> str | None:
        v = tomllib.loads(raw.decode("utf-8")).get("project", {}).get("version") if raw is not None else None
        return v.strip() if isinstance(v, str) and v.strip() else None

    return toml.map(one)


def resolve_version(override: Column, toml: Column, installed: Column) -> Column:
    """The version asked for, else the project's, else the installed one, else 0.0.0+unknown."""
    return F.coalesce(F.nullif(override, F.lit("")), project_version(toml), installed, F.lit("0.0.0+unknown"))


def archive_members(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(project, ord, arcname, content) and error, in the order of the archive.

    A path that ends with / stands for a directory without files. ``requests``: project, explicit_styles, vocabulary, ini_styles_path, version, manifest (bytes or null); ``files``: project, path below the
    styles folder, content. First the configuration, then the manifest, then each style's files, then those of config; within one in the
    order of path components. A style config asked for comes twice.
    """
    r = requests.join(choose_styles(requests, files), "project").join(choose_vocabulary(requests, files), "project")
    stem = F.concat(F.array_join("styles", "-"), F.lit("-"), "version")
    error = F.coalesce("error", F.when(F.col("ini_styles_path").startswith("/"), F.lit("StylesPath inside the archive must be a relative directory")))
    r = r.withColumn("stem", stem).withColumn("error", error)
    head = r.select("project", F.lit(0).alias("part"), F.array().cast("array<string>").alias("components"), F.concat("stem", F.lit("/.vale.ini")).alias("arcname"), F.encode(package_ini(F.col("ini_styles_path"), F.col("vocab")), "UTF-8").alias("content"))
    manifest = r.where("manifest is not null").select("project", F.lit(1).alias("part"), F.array().cast("array<string>").alias("components"), F.concat("stem", F.lit(f"/{MANIFEST_NAME}")).alias("arcname"), F.col("manifest").alias("content"))
    folders = r.select("project", "stem", "ini_styles_path", F.posexplode(F.concat("styles", F.array(F.lit("config")))).alias("k", "folder"))
    own = files.where((F.instr("path", "/") > 0) & ~F.col("path").endswith("/")).withColumn("folder", F.substring_index("path", "/", 1))
    root = F.regexp_replace(F.regexp_replace("ini_styles_path", r"(^|/)(\./)+", "$1"), "/+$", "")
    body = folders.join(own, ["project", "folder"]).select("project", (F.col("k") + 2).alias("part"), F.split("path", "/").alias("components"), F.concat("stem", F.when(root == "", F.lit("")).otherwise(F.concat(F.lit("/"), root)), F.lit("/"), "path").alias("arcname"), "content")
    rows = head.unionByName(manifest).unionByName(body)
    order = F.row_number().over(Window.partitionBy("project").orderBy("part", "components"))
    rows = rows.withColumn("ord", (order - 1).cast("long"))
    return rows.join(r.select("project", "stem", "error"), "project").select("project", "stem", "error", "ord", "arcname", "content")


def _zip(pdf: pd.DataFrame) -> pd.DataFrame:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in pdf.sort_values("ord")[["arcname", "content"]].itertuples(index=False):
            z.writestr(zipfile.ZipInfo(name), bytes(content or b""), zipfile.ZIP_DEFLATED)
    return pd.DataFrame({"project": [pdf["project"].iloc[0]], "archive_name": [pdf["stem"].iloc[0] + ".zip"], "archive": [out.getvalue()]})


def package_styles(requests: DataFrame, files: DataFrame, fail: bool = True) -> DataFrame:
    """(project, archive_name, archive): a ZIP for each request; the same inputs give the same bytes."""
    members = archive_members(requests, files)
    if fail and (worst := members.agg(F.min("error")).first()[0]) is not None:
        raise (ValueError if "relative" in worst else RuntimeError if worst.startswith("No ") else FileNotFoundError)(worst)
    return members.where("error is null").drop("error").groupBy("project").applyInPandas(_zip, "project string, archive_name string, archive binary")
