"""python -m wayloom import SETTINGS, or route --config SETTINGS --profile NAME --point LAT,LON --point LAT,LON."""

from __future__ import annotations

import argparse
import json
import sys


def point(text: str) -> tuple[float, float]:
    parts = text.split(",")
    try:
        lat, lon = (float(x) for x in parts)
    except ValueError:
        raise argparse.ArgumentTypeError(f"not a point of lat,lon: {text}") from None
    return lat, lon


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="wayloom")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("import").add_argument("settings")
    asked = commands.add_parser("route")
    asked.add_argument("--config", required=True)
    asked.add_argument("--profile", required=True)
    asked.add_argument("--point", action="append", type=point, default=[])
    return parser


def main(given: list[str] | None = None) -> int:
    args = arguments().parse_args(given)
    from pyspark.sql import SparkSession

    from wayloom.plans import service
    from wayloom.sources import settings

    spark = SparkSession.builder.appName("wayloom").getOrCreate()
    try:
        if args.command == "import":
            print(f"imported: {service.import_graph(spark, settings.read(args.settings))}")
        else:
            print(json.dumps(service.route(spark, settings.read(args.config), args.point, args.profile), indent=2))
    except (ValueError, OSError) as wrong:
        print(f"error: {wrong}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
