"""Command line: python -m weftline zip | update-tengo-map | install | sync-acronyms."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from weftline.operators.release import TOOL
from weftline.plans import commands

#: Options of each command: name, suffix of its environment variable, default, help.
OPTIONS = {
    "zip": [
        ("project-root", "PROJECT_ROOT", ".", "root of the repository that has the styles"), ("styles-path", "STYLES_PATH", "styles", "folder of styles below the root"), ("output-dir", "OUTPUT_DIR", "dist", "folder for archives"),
        ("style", "STYLE", None, "a style to include; may be repeated, in the environment parted by commas"), ("vocabulary", "VOCABULARY", None, "vocabulary that the archive names"),
        ("ini-styles-path", "INI_STYLES_PATH", "styles", "StylesPath inside the archive"), ("archive-version", "VERSION", None, "version in the archive's name"), ("force", "FORCE", None, "write over an archive that is there"),
    ],
    "update-tengo-map": [("source", "SOURCE", None, "entry list"), ("dest", "DEST", None, "script, and ::map for another map than allow"), ("project-root", "PROJECT_ROOT", ".", "root of relative paths"), ("type", "TYPE", "true", "how values are read: true, =, =b or =n")],
    "install": [
        ("project-root", "PROJECT_ROOT", ".", "root of the repository to install into"), ("vale-ini", "VALE_INI", ".vale.ini", "configuration file"), ("makefile", "MAKEFILE", "Makefile", "Makefile"),
        ("release-version", "RELEASE_VERSION", None, "version to install instead of the latest"), ("tag", "RELEASE_TAG", None, "its tag"),
    ],
    "sync-acronyms": [("project-root", "PROJECT_ROOT", ".", "root of the repository")],
}
POSITIONAL = {"install": ["repo"], "update-tengo-map": ["source", "dest"]}


def arguments(argv: list[str], environment: dict[str, str] | None = None) -> argparse.Namespace:
    """What the command line says, else the environment, else the defaults."""
    env = os.environ if environment is None else environment
    top = argparse.ArgumentParser(prog=TOOL, description="Packages and installs styles, and keeps maps up to date.")
    commands_ = top.add_subparsers(dest="command", required=True)
    for command, options in OPTIONS.items():
        p = commands_.add_parser(command)
        for name in POSITIONAL.get(command, []):
            p.add_argument(name, nargs="?", default=env.get(f"{TOOL.upper()}_{name.upper()}"))
        for name, suffix, default, text in options:
            given = env.get(f"{TOOL.upper()}_{suffix}")
            if name == "force":
                p.add_argument("--force", action=argparse.BooleanOptionalAction, default=(given or "").lower() in ("1", "true", "yes"), help=text)
            elif name == "style":
                p.add_argument("--style", action="append", help=text)
                p.set_defaults(style_env=[x.strip() for x in (given or "").split(",") if x.strip()])
            else:
                p.add_argument(f"--{name}", dest=f"{name}_option" if name in POSITIONAL.get(command, []) else None, default=default if given is None else given, help=text)
    args = top.parse_args(argv)
    for name in POSITIONAL.get(args.command, []):
        value = getattr(args, f"{name}_option", None) or getattr(args, name)
        if value is None:
            top.error(f"{args.command} needs {name}")
        setattr(args, name, value)
    return args


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[int, str]:
    """The exit code, and the line for standard output, or for standard error if the code isn't 0."""
    if args.command == "zip":
        return 0, str(commands.package(spark, args.project_root, args.styles_path, args.output_dir, args.style or args.style_env or None, args.vocabulary, args.ini_styles_path, args.archive_version, args.force))
    if args.command == "update-tengo-map":
        try:
            return 0, commands.update_map(spark, args.source, args.dest, args.project_root, args.type)
        except SystemExit as e:
            return 1, str(e)
    if args.command == "install":
        return 0, commands.install(spark, args.repo, args.project_root, args.vale_ini, args.makefile, args.release_version, args.tag)
    return commands.sync_project(spark, Path(args.project_root).expanduser().resolve())


def main(argv: list[str] | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName(TOOL).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    code, said = run(spark, args)
    print(said, file=sys.stderr if code else sys.stdout)
    return code


if __name__ == "__main__":
    sys.exit(main())
