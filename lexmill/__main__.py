"""python -m lexmill --job job.yaml COMMAND: whole runs from a shell; results are printed as JSON.

The job file gives Job's fields: out, corpora (name: [kind, path]), dictionary, lexicon, components, overrides, exclusions, and config with
the fields of Config's parts, script by name.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

import yaml
from pyspark.sql import SparkSession

from . import schemas
from .config import LATIN, THAI, Config
from .plans import runs
from .session import session
from .sources import readers

SCRIPTS = {s.name: s for s in (LATIN, THAI)}


def config_of(given: dict) -> Config:
    """Config with the parts given, as mappings of their fields; unknown names raise."""
    config = Config()
    parts = {k: SCRIPTS[v] if k == "script" else replace(getattr(config, k), **{a: tuple(b) if isinstance(b, list) else b for a, b in v.items()}) for k, v in given.items()}
    return replace(config, **parts)


def job_of(path: str) -> runs.Job:
    given = yaml.safe_load(Path(path).read_text("utf-8"))
    corpora = {str(k): (str(v[0]), str(v[1])) for k, v in given.pop("corpora", {}).items()}
    return runs.Job(corpora=corpora, config=config_of(given.pop("config", {})), **given)


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lexmill")
    p.add_argument("--job", required=True)
    p.add_argument("--fresh", action="store_true", help="make all stages anew")
    p.add_argument("--master", help="where Spark runs, if spark-submit does not say it")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("status", "sizes", "words", "spellings", "grams"):
        sub.add_parser(name)
    for name in ("export", "run"):
        sub.add_parser(name).add_argument("--version", default="v0.0.0")
    sub.add_parser("encode")
    for name, needed in (("check-dataset", "benchmark"), ("check-model", "benchmark"), ("search", "cases")):
        sub.add_parser(name).add_argument(needed)
    return p.parse_args(argv)


def done(spark: SparkSession, job: runs.Job, a: argparse.Namespace) -> tuple[object, bool]:
    """What a command gives, and whether it went well."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    if a.command == "status":
        return [{"corpus": n, "kind": k, "path": p, "available": readers.exists(spark, p)} for n, (k, p) in sorted(job.corpora.items())], True
    if a.command == "sizes":
        return rows(runs.sizes(spark, job).orderBy("corpus")), True
    if a.command in ("words", "spellings", "grams"):
        return {"rows": getattr(runs, a.command)(spark, job).count()}, True
    if a.command in ("export", "run"):
        out = runs.export(spark, job, a.version)
        if a.command == "export":
            return out, True
        out = {"dataset": out, "model": runs.encode(spark, job)}
        return out, not out["model"]["wrong"]
    if a.command == "encode":
        out = runs.encode(spark, job)
        return out, not out["wrong"]
    if a.command == "check-dataset":
        bench = readers.table(spark, a.benchmark, schemas.BENCHMARK, comments=True)
        return runs.store_report(runs.dataset_report(runs.entries(spark, job), bench), f"{job.out}/dataset-report"), True
    if a.command == "check-model":
        bench = readers.table(spark, a.benchmark, schemas.RANKING, comments=True)
        return runs.store_report(runs.model_report(runs.grams(spark, job), bench), f"{job.out}/model-report"), True
    model = readers.newest(job.out, "model_v*.bin")
    found = rows(runs.searched(spark, readers.cases(spark, a.cases), runs.entries(spark, job), str(model) if model else None, job.config.search).orderBy("query_id"))
    return found, all(r["status"] != "fail" for r in found)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark, job = session(a.master), job_of(a.job)
    if a.fresh:
        runs.forget(spark, job)
    out, well = done(spark, job, a)
    print(json.dumps(out, ensure_ascii=False, default=str))
    return 0 if well else 1


if __name__ == "__main__":
    sys.exit(main())
