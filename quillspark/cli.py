"""Command line: search, compare, tokenize and evaluate over a table of documents.

    python -m quillspark.cli --documents docs.parquet search "some words" -a char2 -k 3 -e
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import analyzers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark", description="Search a table of documents through several analyzers.")
    p.add_argument("--documents", required=True, help="Parquet with doc_id and text")
    p.add_argument("--corpus", help="Parquet with text that subwords are learned from (default: the documents)")
    p.add_argument("--merges", type=int, default=200)
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("search", help="the best documents for a query")
    x.add_argument("query")
    x.add_argument("-a", "--analyzer", default="subword")
    x.add_argument("-k", type=int, default=3)
    x.add_argument("-e", "--explain", action="store_true", help="show the terms in common")
    x = sub.add_parser("compare", help="the best document of each analyzer")
    x.add_argument("query")
    x.add_argument("-k", type=int, default=1)
    x = sub.add_parser("tokenize", help="the terms of a text under each analyzer")
    x.add_argument("text")
    x = sub.add_parser("evaluate", help="how often each analyzer hits")
    x.add_argument("cases", help="JSON lines with query and relevant (a list of doc_id)")
    x.add_argument("-k", type=int, default=3)
    return p


def _asked(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def _search(spark, docs, known, args) -> int:
    if args.analyzer not in known:
        print(f"unknown analyzer {args.analyzer!r}; there are {', '.join(analyzers.NAMES)}", file=sys.stderr)
        return 2
    engine = analyzers.Engine(docs, known[args.analyzer])
    asked = _asked(spark, [args.query])
    found = engine.search(asked, args.k)
    rows = found.join(docs, "doc_id").orderBy("rank").collect()  # k at most
    if not rows:
        print("no document has a term of the query")
    shared = {r["doc_id"]: r["terms"] for r in engine.shared_terms(asked, found).collect()} if args.explain else {}
    for r in rows:
        print(f"{r['rank']}. [{r['doc_id']}] {r['score']:.3f} {r['text'][:80]}" + (f"  ({', '.join(shared[r['doc_id']])})" if args.explain else ""))
    return 0


def _compare(spark, docs, known, args) -> int:
    asked = _asked(spark, [args.query])
    for name, analyzer in known.items():
        engine = analyzers.Engine(docs, analyzer)
        found = engine.search(asked, args.k)
        shared = {r["doc_id"]: r["terms"] for r in engine.shared_terms(asked, found).collect()}
        rows = found.orderBy("rank").collect()
        print(f"{name:16}" + ("; ".join(f"[{r['doc_id']}] {r['score']:.3f} {' '.join(shared[r['doc_id']][:6])}" for r in rows) or "nothing"))
    return 0


def _tokenize(spark, docs, known, args) -> int:
    text = spark.createDataFrame([(0, args.text)], "doc_id int, text string")
    for name, analyzer in known.items():
        print(f"{name:16}" + " | ".join(analyzer.terms(text).first()["tokens"]))
    return 0


def _evaluate(spark, docs, known, args) -> int:
    with open(args.cases, encoding="utf-8") as f:
        cases = [json.loads(line) for line in f if line.strip()]
    asked = _asked(spark, [c["query"] for c in cases])
    kind = docs.schema["doc_id"].dataType.simpleString()
    told = spark.createDataFrame([(i, c["relevant"], c["query"].isascii()) for i, c in enumerate(cases)], f"query_id int, relevant array<{kind}>, ascii boolean")
    for name, analyzer in known.items():
        engine = analyzers.Engine(docs, analyzer)
        found = engine.search(asked, args.k)
        rates = [analyzers.hit_rate(found, t).first()[0] for t in (told, told.where(~F.col("ascii")), told.where("ascii"))]
        print(f"{name:16} all {rates[0]:.0%}  not ASCII {rates[1]:.0%}  ASCII {rates[2]:.0%}  terms {len(engine)}")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code 0, or 2 for a wrong call."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillspark").getOrCreate()
    docs = spark.read.parquet(args.documents).select("doc_id", "text")
    corpus = spark.read.parquet(args.corpus).select("text") if args.corpus else docs.select("text")
    only = [args.analyzer] if args.command == "search" else None
    known = analyzers.build_analyzers(corpus, args.merges, only=only)
    return {"search": _search, "compare": _compare, "tokenize": _tokenize, "evaluate": _evaluate}[args.command](spark, docs, known, args)


if __name__ == "__main__":
    sys.exit(main())
