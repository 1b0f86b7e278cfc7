"""python -m lumenry STORE ROOT COMMAND [QUERY] [--mode M] [--limit N]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .api import Corpus


def main() -> None:
    p = argparse.ArgumentParser(prog="lumenry")
    p.add_argument("store")
    p.add_argument("root")
    p.add_argument("command", choices=["index", "search", "graph", "pack", "map", "files", "briefing", "stale"])
    p.add_argument("query", nargs="?", default="")
    p.add_argument("--mode", default="auto")
    p.add_argument("--operation", default="def")
    p.add_argument("--ignore-case", action="store_true")
    p.add_argument("--limit", type=int, default=20)
    a = p.parse_args()
    c = Corpus(SparkSession.builder.getOrCreate(), a.root, a.store)
    if a.command == "index":
        print(c.index())
    elif a.command == "briefing":
        print(c.briefing(a.query or None))
    elif a.command == "map":
        for name, df in c.map().items():
            print(name)
            df.show(truncate=False)
    else:
        df = {"search": lambda: c.search(a.query, a.mode, ignore_case=a.ignore_case, limit=a.limit), "graph": lambda: c.graph(a.operation, a.query), "pack": lambda: c.pack(a.query), "files": lambda: c.files(a.query, a.limit), "stale": c.stale}[a.command]()
        df.show(a.limit, truncate=100)


if __name__ == "__main__":
    main()
