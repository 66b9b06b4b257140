"""python -m namewright.cli match|dupes|clean|finalize: the engine on files."""

from __future__ import annotations

import argparse
import logging
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.operators import overrides, quality
from namewright.operators.evaluate import decision_summary
from namewright.operators.review import display
from namewright.plans.config import Config
from namewright.plans.lexicon import load_lexicon
from namewright.plans.linker import Linker
from namewright.plans.session import local_session, ship
from namewright.sources import names as io


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="namewright")
    p.add_argument("--log-level", default=os.environ.get("LOG_LEVEL", "INFO"))
    p.add_argument("--no", action="append", default=[], metavar="CATEGORY", help="strip words of a category")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("match")
    m.add_argument("a")
    m.add_argument("b")
    m.add_argument("out")
    m.add_argument("--group", action="store_true")
    m.add_argument("--show", action="store_true")
    m.add_argument("--matches")
    d = sub.add_parser("dupes")
    d.add_argument("names")
    d.add_argument("--exact", action="store_true")
    c = sub.add_parser("clean")
    c.add_argument("names")
    c.add_argument("out", nargs="?")
    c.add_argument("--filter")
    f = sub.add_parser("finalize")
    f.add_argument("results")
    f.add_argument("matches")
    f.add_argument("out")
    f.add_argument("--a", help="the list that was linked: written beside out with its matches")
    f.add_argument("--b", help="the reference list: written beside out with the names matched to it")
    return p


def main(argv: list[str] | None = None) -> DataFrame:
    args = arguments().parse_args(argv)
    logging.basicConfig(level=args.log_level)
    spark = ship(local_session())
    lexicon = load_lexicon()
    lexicon.words(*args.no)  # warns of unknown ones
    config = Config().stripping(*[c for c in args.no if c in lexicon.categories])
    if args.command == "match":
        a = io.read_names(spark, args.a).withColumnsRenamed({"id": "a_id", "name": "a_name"})
        b = io.read_names(spark, args.b).withColumnsRenamed({"id": "b_id", "name": "b_name"})
        manual = io.read_manual(spark, args.matches) if args.matches else None
        sizes = a.groupBy("a_name").agg(F.min("a_id").alias("a_id"), F.count("*").alias("group_size"))
        out = Linker(config, lexicon).prepare(b).link(sizes.select("a_id", "a_name") if args.group else a, manual)
        out = out.join(sizes.select("a_name", "group_size"), "a_name") if args.group else out
        io.write_results(out, args.out)
        if args.show:
            display(out).show(50, False)
        decision_summary(out, "group_size" if args.group else None).show()
        return out
    if args.command == "dupes":
        names = io.read_names(spark, args.names)
        out = quality.exact_duplicates(names).orderBy("name") if args.exact else quality.normalized_duplicates(names, config, lexicon).orderBy("core_string")
        out.show(100, False)
        return out
    if args.command == "clean":
        out = quality.cleaned(io.read_names(spark, args.names), lexicon)
        out = quality.filtered(out, args.filter) if args.filter else out
        out.write.option("header", True).csv(args.out) if args.out else out.show(100, False)
        return out
    results = io.read_results(spark, args.results)
    out = overrides.finalize(results, io.read_manual(spark, args.matches))
    out.drop("overridden").write.parquet(args.out)
    placed = out if "ordinal" in out.columns else out.withColumn("ordinal", F.col("a_id").cast("long"))
    if args.a:
        overrides.enrich_a(io.read_names(spark, args.a).withColumnsRenamed({"id": "a_id", "name": "a_name"}), placed).write.parquet(f"{args.out}_a")
    if args.b:
        overrides.enrich_b(io.read_names(spark, args.b).withColumnsRenamed({"id": "b_id", "name": "b_name"}), placed).write.parquet(f"{args.out}_b")
    return out


if __name__ == "__main__":
    main()
