"""Command line: index a folder of documents, inspect an index, search it."""

from __future__ import annotations

import argparse
import runpy
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import MATCH_LABELS, TIER_LABELS
from .operators.index import Index, build_indexes
from .operators.rank import CONFIDENCE, sample_until_stable
from .plans.search import Engine
from .sources.documents import as_corpus, load_documents, read_manifest


def index(spark: SparkSession, args) -> None:
    manifest = read_manifest(spark, args.input)
    docs = as_corpus(load_documents(spark, args.input, manifest))
    if docs.isEmpty():
        print("no documents: nothing is indexed")
        return
    scorer = runpy.run_path(args.ranking)["score"] if args.ranking else None
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(args.ranking_batch_size))
    if args.definitions:
        built = build_indexes(docs, {k: dict(v) for k, v in (manifest["indexes"] or {}).items()}, args.output, scorer=scorer)
        print(f"{len(built)} indexes at {args.output}")
    else:
        Index.build(docs, scorer=scorer).save(args.output, check=True)
        print(f"an index of {docs.count()} documents at {args.output}")


def inspect(spark: SparkSession, args) -> None:
    Index.load(spark, args.path, check=True).inspect().show(truncate=False)


def search(spark: SparkSession, args) -> None:
    engine = Engine.load(spark, args.path)
    began = time.perf_counter()
    found = engine.resolve(engine.search(args.query, args.limit)).orderBy("rank")
    label = F.element_at(F.array(*[F.lit(x) for x in MATCH_LABELS]), F.col("match_type") + 1)
    tier = F.element_at(F.array(*[F.lit(TIER_LABELS[t]) for t in (1, 2, 3)]), F.col("tier"))
    found.select("rank", tier.alias("tier"), label.alias("match"), F.round("score", 2).alias("score"), "title", F.coalesce(F.concat(F.lit("#"), "section_id"), F.lit("")).alias("section")).show(args.limit, truncate=60)
    print(f"{1000 * (time.perf_counter() - began):.0f} ms")
    if args.bench:
        s = sample_until_stable(lambda: engine.search(args.query, args.limit).collect(), args.confidence, min(30, args.bench), args.bench)
        print(f"{s['mean']:.1f} ms, {args.confidence} % of {s['low']:.1f} to {s['high']:.1f} over {s['n']} runs{'' if s['stable'] else ', not stable'}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tesserae")
    sub = p.add_subparsers(required=True)
    a = sub.add_parser("index", help="build an index of a folder with a manifest")
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("--definitions", action="store_true", help="build the manifest's named indexes")
    a.add_argument("--ranking", help="a Python file whose function score(context) scores postings")
    a.add_argument("--ranking-batch-size", type=int, default=10_000, help="postings in a batch for it")
    a.set_defaults(run=index)
    a = sub.add_parser("inspect", help="show an index's tables")
    a.add_argument("path")
    a.set_defaults(run=inspect)
    a = sub.add_parser("search", help="search an index")
    a.add_argument("path")
    a.add_argument("query")
    a.add_argument("--limit", type=int, default=10)
    a.add_argument("--bench", type=int, default=0, help="at most so many further runs, until their mean is sure")
    a.add_argument("--confidence", type=int, default=95, choices=sorted(CONFIDENCE))
    a.set_defaults(run=search)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
