"""Command line: ``python -m skemaforge OPERATION --path TABLES``; prints the response of ``plans.service`` as JSON."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from skemaforge.plans import service


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="skemaforge", description=__doc__)
    parser.add_argument("operation", choices=service.OPERATIONS)
    parser.add_argument("--path", required=True, help="folder of the Parquet tables")
    parser.add_argument("--graph", help="only the collections of this graph")
    parser.add_argument("--target", choices=sorted(service.TARGETS), help="of an export")
    parser.add_argument("--full", action="store_true", help="the whole snapshot, not the listing alone")
    parser.add_argument("--samples", type=int, default=0, help="rows a collection in a whole snapshot")
    parser.add_argument("--out", help="file for the response instead of the standard output")
    args = parser.parse_args(argv)
    request = {k: v for k, v in vars(args).items() if v is not None and k != "out"}
    answer = service.run(request, SparkSession.builder.getOrCreate())
    text = json.dumps(answer, indent=2, sort_keys=True, default=str)
    if args.out:
        with open(args.out, "w") as f:
            f.write(text + "\n")
    else:
        print(text)
    return 0 if answer["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
