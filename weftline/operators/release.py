"""Releases and install manifests: which version, tag and archive, and what the archive's manifest asks for.

The texts of errors and the addresses are fixed values.
"""

from __future__ import annotations

import io
import json
import os
import shlex
import tomllib
import urllib.error
import urllib.request
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import values as V
from weftline.operators.entries import MODES
from weftline.sources.lines import strip

_FIELDS = T.StructType([T.StructField(k, T.ArrayType(T.StringType()) if k == "post_sync_steps" else T.StringType()) for k in ("style_name", "vocab", "min_alert_level", "post_sync_steps", "error")])
PAYLOAD = "tag_name string, assets array<struct<name:string>>"
#: The tool's name: of the manifest's file, of the command in recipes, and before environment variables.
TOOL = "weftline"
MANIFEST_NAME = f"{TOOL}.toml"
#: The only action, and time-outs in seconds.
ACTION = "update-tengo-map"
LATEST_TIMEOUT, ARCHIVE_TIMEOUT = 10, 15


def pick_asset(assets: Column, expected: Column) -> Column:
    """The expected asset's name if it is there, else that of the first .zip, else the expected one."""
    names = F.transform(assets, lambda a: a["name"])
    exact = F.get(F.filter(names, lambda n: n == expected), F.lit(0))
    zipped = F.get(F.filter(names, lambda n: n.endswith(".zip")), F.lit(0))
    return F.coalesce(exact, zipped, expected)


def download_url(repo: Column, tag: Column, asset: Column) -> Column:
    return F.format_string("https://github.com/%s/releases/download/%s/%s", repo, tag, asset)


def resolve_releases(requests: DataFrame) -> DataFrame:
    """``requests`` with version, tag, packages_url and error.

    They have repo, style_name, override_version, override_tag and payload (JSON of the latest release). A version given is taken, with the
    tag given or v and the version; without one the payload decides, and a tag given is not looked at.
    """
    p = F.from_json("payload", PAYLOAD)
    given = F.coalesce(F.col("override_version") != "", F.lit(False))
    latest = F.nullif(strip(p["tag_name"]), F.lit(""))
    version = F.when(given, F.col("override_version")).otherwise(V.version_of_tag(latest))
    tag = F.when(given, F.coalesce(F.nullif("override_tag", F.lit("")), F.concat(F.lit("v"), "override_version"))).otherwise(latest)
    r = requests.withColumn("version", version).withColumn("tag", tag)
    expected = F.concat("style_name", F.lit("-"), "version", F.lit(".zip"))
    asset = F.when(given, expected).otherwise(pick_asset(p["assets"], expected))
    r = r.withColumn("packages_url", download_url(F.col("repo"), F.col("tag"), asset))
    return r.withColumn("error", F.when(F.col("tag").isNull(), F.lit("Release payload missing tag_name")))


def fetch_latest(repo: str, opener=urllib.request.urlopen, token: str | None = None) -> str:  # noqa: ANN001
    """JSON of a repository's latest release; on the driver."""
    headers = {"Accept": "application/vnd.github+json", "User-Agent": "weftline"}
    if token:
        headers["Authorization"] = f"Bearer {token}"
    try:
        with opener(urllib.request.Request(f"https://api.github.com/repos/{repo}/releases/latest", headers=headers), timeout=LATEST_TIMEOUT) as answer:
            return answer.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"Failed to read latest release for {repo}: {e.reason}") from e
    except urllib.error.URLError as e:
        raise RuntimeError(f"Network error talking to GitHub releases for {repo}: {e.reason}") from e


def fetch_archive(url: str, opener=urllib.request.urlopen) -> bytes:  # noqa: ANN001
    """An archive's bytes; on the driver."""
    try:
        with opener(urllib.request.Request(url, headers={"User-Agent": "weftline"}), timeout=ARCHIVE_TIMEOUT) as answer:
            return answer.read()
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"Failed to download archive {url}: {e.reason}") from e
    except urllib.error.URLError as e:
        raise RuntimeError(f"Network error downloading {url}: {e.reason}") from e


def _toml(raw: bytes | None) -> dict | None:
    try:
        return tomllib.loads(raw.decode("utf-8")) if raw is not None else None
    except (tomllib.TOMLDecodeError, UnicodeDecodeError):
        return None


@F.pandas_udf(T.BinaryType())
def manifest_member(archive: pd.Series) -> pd.Series:
    """Bytes of the first member whose name ends with the manifest's; null if there is none, or the archive can't be read."""

    def one(raw: bytes | None) -> bytes | None:
        if raw is None:
            return None
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                name = next((n for n in z.namelist() if n.endswith(MANIFEST_NAME)), None)
                return z.read(name) if name else None
        except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError):
            return None

    return archive.map(one)


def step_error(step: object) -> str | None:
    """What is wrong with a post-sync step; null if nothing is."""
    if not isinstance(step, dict):
        return f"install.post_sync_steps must be a list of tables; got {type(step).__name__} element"
    if step.get("action") != ACTION:
        return f"install.post_sync_steps action must be '{ACTION}' (got {step.get('action')!r})"
    for key, value in (("source", step.get("source")), ("dest", step.get("dest")), ("type", step.get("type", "true"))):
        if not isinstance(value, str):
            return f"install.post_sync_steps.{key} must be a string"
    if step.get("type", "true") not in MODES:
        return f"install.post_sync_steps.type must be one of {', '.join(MODES)}"
    return None


def step_command(step: dict) -> str:
    q = shlex.quote
    return f"uv run {TOOL} {ACTION} --source {q(step['source'])} --dest {q(step['dest'])} --type {q(step.get('type', 'true'))}"


@F.pandas_udf(_FIELDS)
def manifest_fields(toml: pd.Series) -> pd.DataFrame:
    """What a manifest's table install has, untrimmed; texts that aren't strings are null, steps are commands."""
    rows = []
    for raw in toml:
        data = _toml(None if raw is None else bytes(raw)) or {}
        own = data.get("install", {})
        own = own if isinstance(own, dict) else {}
        text = {k: own.get(k) if isinstance(own.get(k), str) else None for k in ("style_name", "vocab", "min_alert_level")}
        steps, error = own.get("post_sync_steps"), None
        if steps is not None and not isinstance(steps, list):
            error = f"install.post_sync_steps must be a list of tables; got {type(steps).__name__}"
        elif steps:
            error = next((e for s in steps if (e := step_error(s))), None)
        rows.append(text | {"post_sync_steps": [step_command(s) for s in steps or []] if not error else [], "error": error})
    return pd.DataFrame(rows, columns=["style_name", "vocab", "min_alert_level", "post_sync_steps", "error"])


def read_manifests(requests: DataFrame, fail: bool = True) -> DataFrame:
    """``requests`` (style_name, and archive or toml, binary) with manifest: struct(style_name, vocab_name, min_alert_level, post_sync_steps), and error.

    Blank or missing fields fall back: the style to the request's, the vocabulary to the style, the level to warning. An archive
    that can't be read is as one without a manifest; wrong steps are an error, raised unless ``fail`` is false.
    """
    toml = F.col("toml") if "toml" in requests.columns else manifest_member("archive")
    r = requests.withColumn("_m", manifest_fields(toml))
    style = V.trim_or(F.col("_m.style_name"), F.col("style_name"))
    fields = F.struct(style.alias("style_name"), V.trim_or(F.col("_m.vocab"), style).alias("vocab_name"), V.trim_or(F.col("_m.min_alert_level"), F.lit("warning")).alias("min_alert_level"), F.col("_m.post_sync_steps").alias("post_sync_steps"))
    r = r.withColumn("manifest", fields).withColumn("error", F.col("_m.error")).drop("_m")
    if fail and (worst := r.agg(F.min("error")).first()[0]) is not None:
        raise (ValueError if "action must be" in worst or "type must be one" in worst else TypeError)(worst)
    return r


def skip_download(environment: dict[str, str] | None = None) -> bool:
    return bool((os.environ if environment is None else environment).get(f"{TOOL.upper()}_SKIP_MANIFEST_DOWNLOAD"))


def payload_of(tag: str, *assets: str) -> str:
    return json.dumps({"tag_name": tag, "assets": [{"name": a} for a in assets]})
