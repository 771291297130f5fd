"""python -m tessella.cli query|fetch: annotation documents (JSON lines or Parquet) by a query string, to rows or as they are."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from tessella.operators import nested, querystring
from tessella.session import session


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessella")
    p.add_argument("command", choices=["query", "fetch"])
    p.add_argument("input")
    p.add_argument("--query", default="*")
    p.add_argument("--fields", nargs="*")
    p.add_argument("--explode")
    p.add_argument("--output", help="Parquet folder; without it the first rows are shown")
    a = p.parse_args(args)
    spark = session()
    docs = spark.read.parquet(a.input) if a.input.rstrip("/").endswith("parquet") else spark.read.json(a.input)
    if "_source" in docs.columns:
        docs = docs.select("_source.*")
    rows = nested.query_annotations(docs, a.query, a.fields, exploded=a.explode) if a.command == "query" else querystring.search(docs, a.query)
    if a.output:
        rows.write.parquet(a.output)
    else:
        rows.select(*[F.col(f"`{c}`") for c in rows.columns]).show(20, truncate=60)


if __name__ == "__main__":
    main()
