"""python -m tesserae index|search|status|reset FOLDER --store PATH [words...]"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.text import location, shown


def main() -> None:
    parser = argparse.ArgumentParser(prog="tesserae", description=__doc__)
    parser.add_argument("command", choices=["index", "search", "status", "reset"])
    parser.add_argument("folder")
    parser.add_argument("words", nargs="*")
    parser.add_argument("--store", required=True, help="where the tables lie")
    parser.add_argument("--ignore", action="append", default=[])
    parser.add_argument("--limit", type=int, default=20)
    parser.add_argument("--settings", help="a JSON file with ignored folders and recognition languages")
    parser.add_argument("--stored", action="store_true", help="search the tables as they are, without a look at the folder")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("tesserae").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine.open(spark, args.folder, args.store, ignore=args.ignore)
    if args.settings:
        with open(args.settings, encoding="utf-8") as f:
            engine.configure(f.read())
        engine.ignore += args.ignore
    if args.command == "index":
        engine.refresh(retry_errors=True)
    elif args.command == "reset":
        engine.reset()
    if args.command == "search":
        if not args.stored:
            engine.refresh()
        found = engine.search(" ".join(args.words), limit=args.limit)
        if engine.corrected:
            print(f"Showing results for {engine.corrected}")
        where = location(F.col("page"), F.col("line"), F.col("kind"), F.col("source"))
        for r in found.select(F.concat("path", where).alias("place"), shown(F.col("snippet")).alias("text")).collect():
            print(f"{r.place}\n    {r.text}")
    else:
        print(json.dumps(engine.status()))


if __name__ == "__main__":
    main()
