"""Writing results to files, and checks of paths, on the driver. Result tables of files are streamed to it a partition at a time."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame


def resolve(root: Path, candidate: str | Path) -> Path:
    """An absolute path as it is, another one below root."""
    p = Path(candidate).expanduser()
    return p.resolve() if p.is_absolute() else (root / p).resolve()


def safe_resolve(user_path: str | Path, base: Path, suffixes: tuple[str, ...] = ()) -> Path:
    """An existing file below base, given by a relative path; ValueError or FileNotFoundError says what is wrong."""
    text = str(user_path).strip()
    if not text:
        raise ValueError("Missing file")
    if Path(text).is_absolute():
        raise ValueError("Absolute paths are not allowed")
    base, target = base.resolve(), (base / text).resolve()
    if not target.is_relative_to(base):
        raise ValueError("Attempt to escape base directory")
    if suffixes and target.suffix.lower() not in suffixes:
        raise ValueError("File type not allowed")
    if not target.is_file():
        raise FileNotFoundError("File not found")
    return target


def replace(path: Path, content: bytes) -> None:
    """Write beside the file and move over it, so that a reader sees the old or the new content."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(fd, "wb") as f:
        f.write(content)
    os.replace(temporary, path)


def write_texts(result: DataFrame, root: str | Path, only_changed: bool = True) -> list[str]:
    """Write (path, text) below root, only those with changed if there is such a column and it is asked for; the paths written."""
    rows = result.where("changed") if only_changed and "changed" in result.columns else result
    written = []
    for row in rows.select("path", "text").toLocalIterator():
        replace(resolve(Path(root), row["path"].removeprefix("file:")), row["text"].encode())
        written.append(row["path"])
    return written


def write_archives(result: DataFrame, output: str | Path, force: bool = False) -> list[Path]:
    """Write (archive_name, archive) into a folder; a file that is there raises FileExistsError unless forced."""
    output = Path(output)
    names = [r["archive_name"] for r in result.select("archive_name").collect()]
    for name in names:
        if (output / name).exists() and not force:
            raise FileExistsError(f"Archive {output / name} already exists; rerun with --force to overwrite")
    for row in result.select("archive_name", "archive").toLocalIterator():
        replace(output / row["archive_name"], bytes(row["archive"]))
    return [output / n for n in names]
