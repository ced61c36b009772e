"""From a table to synthetic records and their scores in one call, and the same from a command line."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.privacy import PrivacySpec
from ..operators import evaluate, measures
from ..operators.overrides import check_domain
from ..sources import tables
from . import api, structured  # noqa: F401 (registers its methods)

# The parameters that hold where none are given.
DEFAULTS = {"epsilon": 1.0, "delta": 1e-5, "method": "marginals", "bins": 32, "rounds": 3, "degree": 2, "cells": 250_000}
#: Advanced keys that go to a method as they are.
ADVANCED = ("threshold", "rounds", "degree", "cells", "steps", "population", "records", "iterations", "set_cells", "first", "picks", "choice", "picked", "patience_rounds")


@dataclass
class Result:
    records: DataFrame
    domain: dict
    info: dict
    original: DataFrame

    def metrics(self) -> dict:
        """The number of records, the total variation distance of each column, and their mean."""
        kinds = {c: d["type"] for c, d in self.domain.items()}
        rows = evaluate.tvd_table(self.original, self.records, kinds).collect()  # a row per column
        each = {r["column"]: r["tvd"] for r in rows}
        return {"record_count": measures.record_count(self.records).first()[0], "tvd": each, "mean_tvd": sum(each.values()) / len(each) if each else 0.0}


def kinds_of(domain: dict, bins: int) -> dict[str, dict]:
    """What a method takes as public, of a table's (confirmed) metadata."""
    out = {}
    for name, d in domain.items():
        check_domain({**d, "categories": d.get("categories")} if d["type"] == "categorical" else d)
        if d["type"] == "categorical":
            out[name] = {"type": "categorical", "categories": list(d["categories"])}
        else:
            out[name] = {"type": "numerical", "min": float(d["min"]), "max": float(d["max"]), "bins": int(d.get("bin_count", bins))}
    return out


def run_synthesis(df: DataFrame, method: str = DEFAULTS["method"], epsilon: float = DEFAULTS["epsilon"], delta: float = DEFAULTS["delta"], n: int | None = None, domain: dict | None = None, seed: int | None = None, exact: bool = False, **advanced: object) -> Result:
    """Infers what is not confirmed, fits, draws as many records as the table has unless n says else.

    domain: confirmed metadata by column, as tables.metadata() gives it; columns outside it are left out. advanced: keys of
    ADVANCED; others are an error."""
    if unknown := set(advanced) - set(ADVANCED) - {"bins"}:
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    found, info = tables.metadata(df if domain is None else df.select(*domain))
    domain = found if domain is None else {c: {**found[c], **d} for c, d in domain.items()}
    kinds = kinds_of(domain, int(advanced.pop("bins", DEFAULTS["bins"])))
    rows = info["rows"] if n is None else n
    made = api.synthesize(method, df, kinds, PrivacySpec(epsilon, delta), rows, api.RunConfig(seed, dict(advanced), exact))
    return Result(made, domain, info, df.select(*kinds))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="python -m veiltab", description="Differentially private synthetic records of a table.")
    out.add_argument("input", help="a .csv, .tsv, .zip or .parquet file")
    out.add_argument("output", help="a folder for the records, as Parquet")
    out.add_argument("--method", default=DEFAULTS["method"], help=f"one of {', '.join(api.methods())}")
    out.add_argument("--epsilon", type=float, default=DEFAULTS["epsilon"])
    out.add_argument("--delta", type=float, default=DEFAULTS["delta"])
    out.add_argument("--records", type=int, help="as many as the input has, unless given")
    out.add_argument("--bins", type=int, default=DEFAULTS["bins"])
    out.add_argument("--rounds", type=int, help="update rounds")
    out.add_argument("--seed", type=int)
    out.add_argument("--exact", action="store_true", help="measure with discrete Gaussian noise, that no seed repeats")
    out.add_argument("--domain", help="a JSON file of confirmed metadata")
    out.add_argument("--metrics", action="store_true", help="print the records' scores as JSON")
    return out


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("veiltab").getOrCreate()
    domain = None
    if args.domain:
        with open(args.domain, encoding="utf-8") as f:
            domain = json.load(f)
            domain = domain.get("domain", domain)
    more = {"rounds": args.rounds} if args.rounds is not None else {}
    result = run_synthesis(tables.load(spark, args.input), args.method, args.epsilon, args.delta, args.records, domain, args.seed, args.exact, bins=args.bins, **more)
    result.records.write.mode("overwrite").parquet(args.output)
    if args.metrics:
        result.records = spark.read.parquet(args.output)
        print(json.dumps(result.metrics()))
    return 0
