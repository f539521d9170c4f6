"""Command line: new, run, visualize, baseline, list."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .plans import config as C


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description="Graph embedding on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    new = sub.add_parser("new", help="write a template of an experiment file")
    new.add_argument("application", nargs="+")
    new.add_argument("--file")
    run = sub.add_parser("run", help="run an experiment file")
    run.add_argument("config")
    base = sub.add_parser("baseline", help="run the bundled experiment that matches all keywords")
    base.add_argument("keywords", nargs="+")
    for x in (run, base):
        x.add_argument("--no-eval", action="store_true")
        x.add_argument("--epoch", type=float)
        x.add_argument("--master", help="Spark master, if the session isn't set up otherwise")
    vis = sub.add_parser("visualize", help="lay out a file of vectors")
    vis.add_argument("file")
    vis.add_argument("--label")
    vis.add_argument("--save", default="figure.svg")
    vis.add_argument("--perplexity", type=float, default=30)
    vis.add_argument("--3d", dest="three", action="store_true")
    vis.add_argument("--epoch", type=float, default=50)
    vis.add_argument("--neighbors", type=int, default=200)
    sub.add_parser("list", help="list bundled experiments")
    return p


def tree() -> str:
    groups: dict[str, list[str]] = {}
    for name in sorted(C.baselines()):
        group, _, leaf = name.partition("/")
        groups.setdefault(group, []).append(leaf)
    return "\n".join(line for g, leaves in groups.items() for line in (g, *(f"  {x}" for x in leaves)))


def _session(master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("graphloom")
    return (builder.master(master) if master else builder).getOrCreate()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "list":
        print(tree())
    elif a.command == "new":
        kind = " ".join(a.application)
        path = a.file or f"{kind.replace(' ', '_')}.yaml"
        overwrite = False
        if os.path.exists(path):
            overwrite = sys.stdin.isatty() and input(f"{path} is there already. Overwrite? [y/N] ").lower().startswith("y")
            if not overwrite:
                print(f"{path} is there already", file=sys.stderr)
                return 1
        C.write_template(kind, path, overwrite)
    elif a.command in ("run", "baseline"):
        spark = spark or _session(a.master)
        config = a.config if a.command == "run" else C.find_baseline(a.keywords)[1]
        _, results = C.run_experiment(spark, config, not a.no_eval, a.epoch)
        for r in results:
            if isinstance(r, dict):
                print(json.dumps(r, sort_keys=True))
    else:
        spark = spark or _session()
        config = {"application": "visualization", "resource": {"dim": 3 if a.three else 2}, "graph": {"vector_file": a.file, "num_neighbor": a.neighbors, "perplexity": a.perplexity}, "build": {}, "train": {"num_epoch": a.epoch}, "evaluate": [{"task": "animation" if a.three else "visualization", "file_name": a.label, "save_file": a.save}]}
        C.run_experiment(spark, config)
    return 0


if __name__ == "__main__":
    sys.exit(main())
