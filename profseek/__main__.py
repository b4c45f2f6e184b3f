"""Command line: python -m profseek --database DB --query FILE [options]."""

from __future__ import annotations

import argparse
import dataclasses
import sys
import typing

from pyspark.sql import SparkSession

from profseek.config import Distance, SearchConfig
from profseek.plans.run import dump, run_search
from profseek.sinks.reports import print_table
from profseek.sources.load import load_profiles

ALIASES = {"inclusion_evalue": ["--inc-e"], "report_evalue": ["--rep-e"]}
INTERNAL = ("tile_len", "query_block_bytes")


def _pair(text: str) -> tuple[float, float]:
    low, high = text.split(",")
    return float(low), float(high)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="profseek", description="Similarity search over labelled profiles")
    parser.add_argument("--database", "--db", required=True)
    parser.add_argument("--query", "-q")
    parser.add_argument("--output", "-o", default="profseek_out/")
    parser.add_argument("--overwrite", "--ow", action="store_true")
    parser.add_argument("--shuffled-db")
    parser.add_argument("--dump-db")
    parser.add_argument("--dump-shuffled-db")
    parser.add_argument("--threads", type=int, help="local cores; unset leaves the master to spark-submit")
    hints = typing.get_type_hints(SearchConfig)
    for field in dataclasses.fields(SearchConfig):
        if field.name in INTERNAL:
            continue
        names = ["--" + field.name.replace("_", "-"), *ALIASES.get(field.name, [])]
        kind = hints[field.name]
        if kind is bool:
            parser.add_argument(*names, action="store_true", default=None)
        elif field.name == "report_alignment":
            parser.add_argument(*names, choices=["fasta", "f", "stockholm", "s"])
        elif field.name == "kmer_max_seq_dist":
            parser.add_argument(*names, type=Distance.parse)
        elif typing.get_origin(kind) is tuple:
            parser.add_argument(*names, type=_pair)
        else:
            parser.add_argument(*names, type=float if "float" in str(kind) else int)
    return parser


def _joined(argv: list[str]) -> list[str]:
    """Attach pairs that start with a minus to their option, as they look like options themselves."""
    out: list[str] = []
    for word in argv:
        if "," in word and word[0] == "-" and word[1:2].isdigit() and out:
            out[-1] += "=" + word
        else:
            out.append(word)
    return out


def parse(argv: list[str]) -> tuple[argparse.Namespace, SearchConfig]:
    parser = _parser()
    args = parser.parse_args(_joined(argv))
    if args.shuffled_db and (args.dump_shuffled_db or args.db_shuffles or args.db_block_size
                             or args.db_in_block_shuffle):
        parser.error("--shuffled-db excludes the options that make a shuffled database")
    if not args.query and not (args.dump_db or args.dump_shuffled_db):
        parser.error("--query is required unless a database is dumped")
    known = {f.name for f in dataclasses.fields(SearchConfig)}
    given = {k: v for k, v in vars(args).items() if k in known and v is not None}
    short = {"f": "fasta", "s": "stockholm"}
    if "report_alignment" in given:
        given["report_alignment"] = short.get(given["report_alignment"], given["report_alignment"])
    return args, SearchConfig(**given)


def main(argv: list[str] | None = None) -> None:
    args, cfg = parse(sys.argv[1:] if argv is None else argv)
    builder = SparkSession.builder.appName("profseek")
    if args.threads:
        builder = builder.master(f"local[{args.threads}]")
    spark = builder.getOrCreate()
    if not args.query:
        dump(load_profiles(spark, args.database), args.dump_db, args.dump_shuffled_db, cfg)
        return
    print_table(run_search(spark, args.database, args.query, args.output, cfg, args.overwrite, args.shuffled_db,
                           args.dump_db, args.dump_shuffled_db))


if __name__ == "__main__":
    main()
