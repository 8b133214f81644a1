"""Command line: convert and init."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
from pathlib import Path

from .api import convert_with_result
from .functions.types import FormatError
from .sources.files import ALIASES, FORMATS

VERSION = "0.1.0"
README = """# Table file project

    python -m tessera.cli convert input.csv output.sbdf
    python -m tessera.cli convert data/ output.sbdf --input-format parquet-dataset --row-key id
"""


class _Types(argparse.Action):
    """Gathers NAME=TYPE options into one mapping."""

    def __call__(self, parser, namespace, value, option=None):
        name, _, kind = value.partition("=")
        known = dict(getattr(namespace, self.dest) or {})
        if not name or not kind:
            raise ValueError(f"{option} takes NAME=TYPE, not {value}")
        if name in known:
            raise ValueError(f"column {name} has two types")
        setattr(namespace, self.dest, known | {name: kind})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tessera", add_help=False)
    p.add_argument("-h", "--help", "-help", action="help")
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command")
    c = sub.add_parser("convert", help="write a table file")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--input-format", "--format", default="auto", choices=[*FORMATS, *ALIASES, "auto"])
    c.add_argument("--batch-size", type=int, default=5000)
    c.add_argument("--workers", type=int)
    c.add_argument("--column-type", action=_Types, dest="column_types", metavar="NAME=TYPE")
    # each of these has a --no- form
    for flag, default in (("encoding-rle", True), ("adaptive-encoding", False), ("adaptive-workers", True), ("header", True), ("recursive", False)):
        c.add_argument(f"--{flag}", action=argparse.BooleanOptionalAction, default=default)
    c.add_argument("--infer-schema-rows", type=int, default=10_000)
    c.add_argument("--delimiter", default=",")
    c.add_argument("--row-key", action="append")
    c.add_argument("--sidecar")
    c.add_argument("--table-id")
    i = sub.add_parser("init", help="write a README")
    i.add_argument("directory", nargs="?", default=".")
    i.add_argument("--force", action="store_true")
    return p


def init(directory: str, force: bool) -> Path:
    """Writes the README in one step; one that is there stays unless force is given."""
    folder = Path(directory)
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / "README.md"
    if path.exists() and not force:
        raise FileExistsError(f"{path} is there already")
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as f:
        f.write(README)
    os.replace(f.name, path)
    return path


def _convert(args) -> str:
    named = ("input_format", "batch_size", "column_types", "encoding_rle", "adaptive_encoding", "workers", "adaptive_workers", "infer_schema_rows", "delimiter", "recursive", "table_id")
    options = {k: getattr(args, k) for k in named}
    r = convert_with_result(args.input, args.output, **options, has_header=args.header, row_key_columns=args.row_key, sidecar_path=args.sidecar)
    return f"{r.output_path}: {r.row_count} rows in {r.slice_count} slices"


def main(argv: list[str] | None = None) -> int:
    own = parser()
    try:
        args = own.parse_args(argv)
        if args.command is None:
            own.print_usage(sys.stderr)
            return 2
        print(_convert(args) if args.command == "convert" else init(args.directory, args.force))
    except (FormatError, OSError, TypeError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
