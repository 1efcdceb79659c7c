"""Command line: ``python -m placelink install CONFIG``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def builtin() -> dict[str, Path]:
    """Bundled configurations by name."""
    return {p.stem: p for p in sorted((Path(__file__).parent / "configs").glob("*.yaml"))}


def main(given: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="placelink")
    commands = parser.add_subparsers(dest="command", required=True)
    install = commands.add_parser("install", help="install a gazetteer")
    install.add_argument("config", help=f"a YAML file, or one of: {', '.join(builtin())}")
    install.add_argument("--root", default="gazetteers")
    install.add_argument("--keep-downloads", action="store_true")
    commands.add_parser("download", help="replaced by install")
    args = parser.parse_args(given)
    if args.command == "download":
        print("download is no longer supported: use install", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from placelink.plans.install import Store

    spark = SparkSession.builder.appName("placelink").getOrCreate()
    print(Store(spark, args.root).install(builtin().get(args.config, args.config), keep_downloads=args.keep_downloads))
    return 0


if __name__ == "__main__":
    sys.exit(main())
