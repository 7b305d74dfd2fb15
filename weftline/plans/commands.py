"""Whole jobs over files: update maps, sync acronyms, install a style, package styles. Texts of messages are fixed values.

Files are read by Spark (``sources.lines``, binaryFile), so a job takes many of them; paths are checked and results written on the driver.
"""

from __future__ import annotations

import os
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import values as V
from weftline.operators import allowlist, entries, ini, makefile, mapmerge, packaging, release
from weftline.sources import sink
from weftline.sources.lines import explode_lines, read_texts, require

#: A project's list of acronyms, and the script that is to allow them.
ACRONYM_LIST, ACRONYM_SCRIPT = ".config/common-acronyms", ".vale/styles/config/scripts/AcronymsFirstUse.tengo"


def _text(spark: SparkSession, **columns: str | None) -> DataFrame:
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))


def _read(spark: SparkSession, *paths: Path) -> DataFrame:
    """(path, text) of files on this machine; a missing one raises FileNotFoundError."""
    requests = spark.createDataFrame([(str(p),) for p in paths], "path string")
    there = [f"file://{p}" for p in paths if p.is_file()]
    files = read_texts(spark, there) if there else spark.createDataFrame([], "path string, text string")
    return require(requests, files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "text")).select("path", "text")


def update_maps(spark: SparkSession, requests: list[tuple[str, str]], root: str | Path = ".", mode: str = "true") -> DataFrame:
    """(path, provided, updated, changed) for each request (entry list, script[::map]), in one job; the changed scripts are written.

    A request that can't be met raises before anything is written. A script may have one request.
    """
    root = Path(root).expanduser().resolve()
    entries.check_mode(mode)
    wanted = []
    for source, dest in requests:
        source_path = sink.safe_resolve(source, root)
        to = spark.createDataFrame([(dest,)], "d string").select(V.destination(F.col("d")).alias("d")).first()["d"]
        if to is None:
            raise ValueError("Destination must include a Tengo script path.")
        wanted.append((str(source_path), str(sink.safe_resolve(to["path"], root, (".tengo",))), to["map_name"]))
    asked = spark.createDataFrame(wanted, "source string, path string, map_name string")
    sources = _read(spark, *{Path(x[0]) for x in wanted}).withColumnRenamed("path", "source")
    lines = explode_lines(asked.join(sources, "source").select("path", "text"))
    parsed = entries.parse_entries(lines, mode).cache()
    listed = entries.fail_on_error(parsed)
    scripts = _read(spark, *{Path(x[1]) for x in wanted}).join(asked, "path").select("path", "text", "map_name")
    result = mapmerge.update_maps(scripts, entries.last_wins(listed), fail=False).cache()
    if (worst := result.agg(F.min(F.when(F.col("error").isNotNull(), F.struct("path", "error"))).alias("e")).first()["e"]) is not None:
        raise entries.EntryError(worst["error"])
    sink.write_texts(result, root)
    said = result.join(entries.provided(listed), "path", "left").select("path", F.coalesce("provided", F.lit(0)).alias("provided"), "updated", "changed")
    out = spark.createDataFrame(said.collect(), said.schema)
    result.unpersist()
    parsed.unpersist()
    return out


def update_map(spark: SparkSession, source: str, dest: str, root: str | Path = ".", mode: str = "true") -> str:
    """Bring a script's map up to an entry list; what was done, as text. SystemExit says what is wrong, but of the list's path."""
    sink.safe_resolve(source, Path(root).expanduser().resolve())
    try:
        row = update_maps(spark, [(source, dest)], root, mode).first()
    except (OSError, entries.EntryError, ValueError) as e:
        raise SystemExit(str(e)) from e
    return f"{row['provided']} entries provided, {row['updated']} updated"


def sync_acronyms(spark: SparkSession, source: Path, target: Path) -> str:
    """Put the project's acronyms into the allow map; what was done, as text."""
    if not source.exists():
        raise FileNotFoundError(f"Missing {source}; create .config/common-acronyms before syncing.")
    if not target.exists():
        raise FileNotFoundError(f"AcronymsFirstUse.tengo has not been synced. Run `vale sync` first. Expected path: {target}")
    words = allowlist.load_acronyms(explode_lines(_read(spark, source).withColumn("path", F.lit(str(target)))))
    result = allowlist.update_allow_maps(_read(spark, target), words).cache()
    sink.write_texts(result, target.parent)
    return allowlist.report(result).first()["message"]


def sync_project(spark: SparkSession, root: Path) -> tuple[int, str]:
    """sync_acronyms with a project's fixed paths: the exit code, and what was done or is wrong."""
    target = root / ACRONYM_SCRIPT
    try:
        return 0, sync_acronyms(spark, root / ACRONYM_LIST, target).replace(str(target), ACRONYM_SCRIPT)
    except (FileNotFoundError, allowlist.AllowlistError) as e:
        return 1, str(e)


def install(spark: SparkSession, repo: str, root: str | Path = ".", vale_ini: str = ".vale.ini", makefile_name: str = "Makefile", release_version: str | None = None, tag: str | None = None, fetch=release.fetch_latest, download=release.fetch_archive) -> str:  # noqa: ANN001
    """Write a style's configuration and Makefile target into a project; what was done, as text."""
    parts = spark.createDataFrame([(repo,)], "ref string").select(V.repo_reference(F.col("ref")).alias("r")).first()["r"]
    if parts is None:
        raise ValueError("Repository reference must be in the form 'owner/name'.")
    root = sink.resolve(Path.cwd(), root)
    ini_path, make_path = sink.resolve(root, vale_ini), sink.resolve(root, makefile_name)
    name = f"{parts['owner']}/{parts['repo']}"
    payload = None if release_version else fetch(name, token=os.environ.get("GITHUB_TOKEN")) if fetch is release.fetch_latest else fetch(name)
    request = _text(spark, repo=name, style_name=parts["style"], override_version=release_version, override_tag=tag, payload=payload)
    resolved = release.resolve_releases(request).first()
    if resolved["error"]:
        raise RuntimeError(resolved["error"])
    archive = None
    if not release.skip_download():
        try:
            archive = download(resolved["packages_url"])
        except Exception:  # noqa: BLE001 - without the archive the defaults hold
            archive = None
    wanted = spark.createDataFrame([(parts["style"], archive)], "style_name string, archive binary")
    m = release.read_manifests(wanted).first()["manifest"]
    there = [p for p in (ini_path, make_path) if p.exists()]
    files = _read(spark, *there).cache() if there else spark.createDataFrame([], "path string, text string")
    files.count()  # both are read before either is written
    options = _text(spark, path=str(ini_path), packages_url=resolved["packages_url"], style_name=m["style_name"], vocab_name=m["vocab_name"], min_alert_level=m["min_alert_level"])
    sink.write_texts(ini.update_ini(options, files), root)
    steps = spark.createDataFrame([(str(make_path), list(m["post_sync_steps"]))], "path string, steps array<string>")
    sink.write_texts(makefile.update_makefiles(steps, files), root)
    return f"Installed {m['style_name']} {resolved['version']} from {name} into {ini_path} and {make_path}"


def package(spark: SparkSession, root: str | Path = ".", styles_path: str = "styles", output: str = "dist", styles: list[str] | None = None, vocabulary: str | None = None, ini_styles_path: str = "styles", version: str | None = None, force: bool = False, distribution: str = release.TOOL) -> Path:
    """Build a project's style package; the archive's path."""
    root = Path(root).expanduser().resolve()
    folder = sink.resolve(root, styles_path)
    if not folder.exists():
        raise FileNotFoundError(f"Styles directory {folder} does not exist")
    # Names are listed here, as empty directories count; contents are read by Spark, a row a file.
    names = [p for p in sorted(folder.rglob("*")) if p.is_file() or not any(p.iterdir())]
    listed = spark.createDataFrame([(str(root), p.relative_to(folder).as_posix() + "/" * p.is_dir(), f"file://{p}") for p in names], "project string, path string, uri string")
    there = [f"file://{p}" for p in names if p.is_file()]
    if there:
        read = spark.read.format("binaryFile").load(there).select(F.regexp_replace("path", "^file:/+", "file:///").alias("uri"), "content")
    else:
        read = spark.createDataFrame([], "uri string, content binary")
    files = listed.join(read, "uri", "left").select("project", "path", "content")
    bytes_of = lambda p: p.read_bytes() if p.exists() else None
    try:
        installed = metadata.version(distribution)
    except metadata.PackageNotFoundError:
        installed = None
    request = spark.createDataFrame(
        [(str(root), styles, vocabulary, ini_styles_path, version, bytes_of(root / "pyproject.toml"), installed, bytes_of(root / release.MANIFEST_NAME))],
        "project string, explicit_styles array<string>, vocabulary string, ini_styles_path string, override string, pyproject binary, installed string, manifest binary",
    ).withColumn("version", packaging.resolve_version(F.col("override"), F.col("pyproject"), F.col("installed")))
    return sink.write_archives(packaging.package_styles(request, files), sink.resolve(root, output), force)[0]
