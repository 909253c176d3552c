"""Look-up commands over a stored library.

    python -m quire.cli --jobs JOBS --pages PAGES search WORD... [--any] [--since D] [--until D] [--n 20]
    ... hits ID WORD | read ID [--page N | --at WORD] [--chars N] | info ID | list | stats

JOBS and PAGES are Parquet folders. Only the few rows of an answer reach the driver.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.api import Library
from quire.session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire")
    p.add_argument("--jobs", required=True)
    p.add_argument("--pages", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("search", "hits", "read", "info", "list", "stats"):
        c = sub.add_parser(name)
        if name in ("hits", "read", "info"):
            c.add_argument("id")
        if name in ("search", "hits"):
            c.add_argument("words", nargs="+")
        if name in ("search", "list"):
            c.add_argument("--since")
            c.add_argument("--until")
        c.add_argument("--n", type=int, default=fv.LIST_LIMIT if name == "list" else fv.WORD_LIMIT)
        if name == "search":
            c.add_argument("--any", action="store_true")
        if name == "read":
            c.add_argument("--page", type=int)
            c.add_argument("--at")
            c.add_argument("--chars", type=int, default=fv.READ_CHARS)
    return p


def answer(lib: Library, args: argparse.Namespace):
    """The result rows of a command; None when a short id fits no single document."""
    if args.command == "search":
        return lib.word_search(args.words, args.any, args.since, args.until, args.n)
    if args.command == "list":
        return lib.listing(args.since, args.until, args.n).select("id", "filename", "created_at", "page_count")
    if args.command == "stats":
        return lib.months().orderBy("month")
    refs = lib.jobs.sparkSession.createDataFrame([(args.id,)], "ref string")
    hit = lib.resolve(refs).filter(F.col("id").isNotNull()).first()
    if hit is None:
        return None
    if args.command == "hits":
        return lib.hits(hit["id"], " ".join(args.words), args.n)
    if args.command == "read":
        return lib.read(hit["id"], args.page, args.at, args.chars)
    return lib.outline(hit["id"])


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session()
    lib = Library(spark.read.parquet(args.jobs), spark.read.parquet(args.pages))
    rows = answer(lib, args)
    if rows is None:
        print(f"no single document for {args.id}")
    else:
        for row in rows.toLocalIterator():
            print(" | ".join("" if v is None else str(v) for v in row))


if __name__ == "__main__":
    main()
