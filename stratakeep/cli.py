"""Command line: ``python -m stratakeep --root FOLDER COMMAND``.

    sql [--format table|json] [STATEMENT]   one statement, or a prompt (\\h for help, \\q to leave)
    kv get KEY | put KEY VALUE [--mode M] | delete KEY | range [START [STOP]] [--descending] [--limit N] [--keys-only]
    dump FILE | restore FILE                the key space as a byte stream
    export FOLDER                           a copy of the whole store
    compact [TABLE] | vacuum [--keep N] | tables
    benchmark [--keys N] [--value-size N] [--reads N] [--seed N]
    version
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from typing import TextIO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .errors import StrataError
from .operators.kv import INSERT, UPDATE, UPSERT, KV
from .sources import dump
from .sources.generator import pairs, read_keys

VERSION = "0.1.0"
_HELP = "End a statement with ; or let it be added.  \\q leaves, \\h shows this.\n"


def normalize(text: str) -> str:
    """A statement with the semicolon that people leave out."""
    text = text.strip()
    return text if not text or text.endswith(";") else text + ";"


def benchmark(engine: Engine, keys: int, value_size: int, reads: int, seed: int) -> dict:
    """Bulk load, compaction, random reads as one join, full scans; then commits of 1,000 pairs,
    single reads, and opening the store again up to its first read; operations a second."""
    spark, kv, out = engine.spark, engine.kv, {}
    batches, singles = 20, 10

    def timed(name: str, n: int, work) -> None:
        began = time.perf_counter()
        work()
        took = time.perf_counter() - began
        out[name] = {"ops": n, "sec": round(took, 4), "ops_per_sec": round(n / took, 2)}

    timed("populate", keys, lambda: kv.upsert_df(pairs(spark, keys, value_size)))
    timed("compact", keys, engine.compact)
    found = kv.get_many(read_keys(spark, keys, reads, seed)).agg(F.count("*"), F.sum(F.length("value")))
    timed("random_read", reads, found.collect)
    timed("iterate_keys", keys, lambda: kv.items().agg(F.count("key")).collect())
    timed("iterate_values", keys, lambda: kv.items().agg(F.count("key"), F.sum(F.crc32("value"))).collect())
    batch = pairs(spark, 1000, value_size)

    def commits() -> None:
        for i in range(batches):
            kv.upsert_df(batch.select(F.concat(F.lit(f"batch{i:04}-".encode()), "key").alias("key"), "value"))

    timed("batch_commits", batches * 1000, commits)
    timed("point_read", singles, lambda: [kv.get(f"{i:016}".encode()) for i in range(singles)])
    timed("reopen", 1, lambda: Engine(spark, engine.storage.files.root).kv.get(b"0" * 16))
    return out


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratakeep", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--root", default="stratakeep-data", help="folder of the store")
    commands = top.add_subparsers(dest="command", required=True)
    sql = commands.add_parser("sql")
    sql.add_argument("statement", nargs="?")
    sql.add_argument("--format", choices=("table", "json"), default="table")
    kv = commands.add_parser("kv").add_subparsers(dest="action", required=True)
    for name in ("get", "delete"):
        kv.add_parser(name).add_argument("key")
    put = kv.add_parser("put")
    put.add_argument("key")
    put.add_argument("value")
    put.add_argument("--mode", choices=(UPSERT, INSERT, UPDATE), default=UPSERT)
    ranged = kv.add_parser("range")
    ranged.add_argument("start", nargs="?", default="")
    ranged.add_argument("stop", nargs="?", default="")
    ranged.add_argument("--descending", action="store_true")
    ranged.add_argument("--keys-only", action="store_true")
    ranged.add_argument("--limit", type=int, default=0)
    for name in ("dump", "restore", "export"):
        commands.add_parser(name).add_argument("path")
    commands.add_parser("compact").add_argument("table", nargs="?")
    commands.add_parser("vacuum").add_argument("--keep", type=int, default=1)
    commands.add_parser("tables")
    bench = commands.add_parser("benchmark")
    for name, default in (("keys", 20_000), ("value-size", 128), ("reads", 20_000), ("seed", 1)):
        bench.add_argument(f"--{name}", type=int, default=default)
    commands.add_parser("version")
    return top


def _kv(kv: KV, args: argparse.Namespace, out: TextIO) -> None:
    if args.action == "get":
        print(kv.need(args.key.encode()).decode(errors="replace"), file=out)
    elif args.action == "put":
        print("updated" if kv.put_checked(args.key.encode(), args.value.encode(), args.mode) else "unchanged", file=out)
    elif args.action == "delete":
        print("deleted" if kv.delete_checked(args.key.encode()) else "not found", file=out)
    else:
        rows = kv.scan(args.start.encode(), args.stop.encode(), args.descending, args.limit, args.keys_only)
        for row in rows.toLocalIterator():
            print("\t".join(bytes(v).decode(errors="replace") for v in row), file=out)


def prompt(engine: Engine, source: TextIO, out: TextIO, style: str = "table") -> None:
    """Read statements line by line until the end of the input; errors are shown and go by."""
    pending = ""
    for line in source:
        if not pending and line.strip() in ("\\q", "\\quit"):
            return
        if not pending and line.strip() in ("\\h", "\\help", "\\?"):
            out.write(_HELP)
            continue
        pending += line
        if pending.strip() and pending.rstrip().endswith(";"):
            _statement(engine, pending, out, style)
            pending = ""
    if pending.strip():
        _statement(engine, pending, out, style)


def _statement(engine: Engine, text: str, out: TextIO, style: str) -> None:
    try:
        out.write(engine.sql(normalize(text)).render(style))
    except StrataError as e:
        out.write(f"error: {e}\n")


def run(argv: list[str], spark: SparkSession | None = None, out: TextIO = sys.stdout, source: TextIO = sys.stdin) -> int:
    args = _parser().parse_args(argv)
    if args.command == "version":
        print(VERSION, file=out)
        return 0
    spark = spark or SparkSession.builder.appName("stratakeep").getOrCreate()
    try:
        with Engine(spark, args.root if "://" in args.root else f"file://{_absolute(args.root)}") as engine:
            if args.command == "sql" and args.statement is None:
                prompt(engine, source, out, args.format)
            elif args.command == "sql":
                out.write(engine.sql(normalize(args.statement)).render(args.format))
            elif args.command == "kv":
                _kv(engine.kv, args, out)
            elif args.command == "dump":
                with open(args.path, "wb") as file:
                    print(f"{dump.dump_kv(engine.kv, file)} entries", file=out)
            elif args.command == "restore":
                with open(args.path, "rb") as file:
                    print(f"{dump.restore_kv(engine.kv, file)} entries", file=out)
            elif args.command == "export":
                engine.export(args.path if "://" in args.path else f"file://{_absolute(args.path)}")
            elif args.command == "compact":
                print(" ".join(repr(n).strip("'") for n in engine.compact(args.table)), file=out)
            elif args.command == "vacuum":
                print(f"{engine.vacuum(args.keep)} folders deleted", file=out)
            elif args.command == "tables":
                print("\n".join(engine.tables()), file=out)
            else:
                print(json.dumps(benchmark(engine, args.keys, args.value_size, args.reads, args.seed)), file=out)
    except StrataError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


def _absolute(path: str) -> str:
    import os

    return os.path.abspath(path)
