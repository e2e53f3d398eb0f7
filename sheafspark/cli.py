"""Command line: parse files, or list what can be parsed.

python -m sheafspark.cli parse FILE... [--config FILE] [--out FOLDER] [--quiet]
python -m sheafspark.cli types
"""

from __future__ import annotations

import argparse
import sys

from sheafspark import config
from sheafspark.callbacks import Callback, Printed, observed
from sheafspark.sources import formats, packages


def arguments(args: list[str]) -> argparse.Namespace:
    own = argparse.ArgumentParser(prog="sheafspark", description="Documents as Markdown and JSON")
    sub = own.add_subparsers(dest="command", required=True)
    parse = sub.add_parser("parse", help="parse files and print, or write, their pages")
    parse.add_argument("files", nargs="+")
    parse.add_argument("--config")
    parse.add_argument("--out", help="a folder for JSON lines; without it pages are printed")
    parse.add_argument("--quiet", action="store_true")
    sub.add_parser("types", help="the kinds of files and their suffixes")
    return own.parse_args(args)


def run(spark, args: list[str]) -> int:
    """0, or 1 where a file couldn't be read."""
    own = arguments(args)
    if own.command == "types":
        for name, suffixes in formats.CATEGORIES.items():
            print(f"{name}: {' '.join(suffixes)}")
        return 0
    settings = config.resolved(config.load(own.config)) if own.config else {}
    files = formats.scan(spark, own.files if len(own.files) > 1 else own.files[0], settings.get("glob"))
    pages = packages.read(files)
    if own.out:
        counts = observed(own.out, pages, lambda df: df.write.mode("append").json(own.out), Callback() if own.quiet else Printed())
        return int(counts["errors"] > 0)
    failed = 0
    for row in pages.orderBy("path", "page_id").toLocalIterator():
        failed |= row.error is not None
        print(f"{row.path}: {row.error}" if row.error else row.content)
    return int(failed)


def main() -> None:
    from sheafspark.session import local_session

    sys.exit(run(local_session(), sys.argv[1:]))


if __name__ == "__main__":
    main()
