"""Commands by name, with the exit codes: 0 done, 1 failed, 2 wrong use, 3 nothing supported, 4 partial, 5 a dependency is missing, 6 corrupt."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources import files as S

from . import surface

OK, FAILED, USAGE, UNSUPPORTED, PARTIAL, DEPENDENCY, CORRUPT = range(7)


def _strings(spark: SparkSession, a) -> DataFrame:
    if a.least < 1:
        raise ValueError("strings have at least one character")
    return S.strings(S.binary_files(spark, a.path), a.least)


def _tables(spark: SparkSession, a) -> DataFrame:
    return S.numeric_tables(S.binary_files(spark, a.path), a.min_rows, a.min_columns)


def _block(spark: SparkSession, a) -> DataFrame:
    own = S.binary_files(spark, a.path)
    return own.select("path", S.byte_range(own["content"], a.offset, a.length).alias("bytes"))


def _workbook(spark: SparkSession, a) -> DataFrame:
    cells = S.binary_files(spark, a.path)
    surface.to_xlsx(S.unicode_columns(cells).orderBy("path", "ordinal"), a.out)
    return S.unicode_columns(cells).groupBy("path").count()


COMMANDS = {
    "inspect": lambda s, a: surface.inspect(s, a.path),
    "list": lambda s, a: surface.catalog(s, a.path),
    "get": lambda s, a: surface.get(s, a.path, a.item),
    "extract": lambda s, a: surface.extract(s, a.path, a.out),
    "compare": lambda s, a: surface.compare(s, a.path, a.other),
    "strings": _strings,
    "table-scan": _tables,
    "images": lambda s, a: S.images(S.binary_files(s, a.path)),
    "walk": lambda s, a: surface.walk(s, a.path),
    "artifacts": lambda s, a: surface.artifacts(s, a.path),
    "dump-block": _block,
    "xlsx": _workbook,
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone")
    commands = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        own = commands.add_parser(name)
        own.add_argument("path")
        for extra, options in {"get": {"item": {}}, "extract": {"out": {}}, "xlsx": {"out": {}}, "compare": {"other": {}}, "strings": {"--least": {"type": int, "default": 4}}, "table-scan": {"--min-rows": {"type": int, "default": 5}, "--min-columns": {"type": int, "default": 2}}, "dump-block": {"offset": {"type": int}, "length": {"type": int}}}.items():
            if extra == name:
                for flag, kw in options.items():
                    own.add_argument(flag, **kw)
    return top


def outcome(command: str, rows: list[dict]) -> int:
    """What the rows say: nothing found, a truncated file, only partly supported ones."""
    if command == "inspect":
        if any(r.get("truncated_at") is not None for r in rows):
            return CORRUPT
        if rows and all(r["detected_type"] == "unknown" for r in rows):
            return UNSUPPORTED
        return PARTIAL if any(r["support"] == "partial" for r in rows) else OK
    if command == "compare":
        return FAILED if rows else OK
    return OK if rows else UNSUPPORTED


def main(argv: list[str], spark: SparkSession | None = None, out=None, most: int = 1_000) -> int:
    """Run a command and print its first rows (`most` of them, a listing's limit) as JSON lines; the exit code."""
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return OK if not e.code else USAGE
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        rows = [r.asDict(recursive=True) for r in COMMANDS[a.command](spark, a).limit(most).collect()]
    except ValueError as e:
        print(e, file=sys.stderr)
        return USAGE
    except ModuleNotFoundError as e:
        print(e, file=sys.stderr)
        return DEPENDENCY
    except Exception as e:  # a command line's last resort: the message, and the code for it
        print(e, file=sys.stderr)
        return USAGE if "runs past the end" in str(e) else FAILED
    for r in rows:
        print(json.dumps(r, default=lambda x: x.hex() if isinstance(x, (bytes, bytearray)) else str(x)), file=out or sys.stdout)
    return outcome(a.command, rows)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
