"""Command line: init, run, resume, grade, score, predict, check, stats, systems and dialects.

A run's folder has ``run.json`` (its configuration), ``records``, ``scores``, ``details``, ``summary`` and ``coverage``.
"""

from __future__ import annotations

import argparse
import difflib
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyleaf.operators import dialects, profile, schemas
from tallyleaf.plans import grade, predict
from tallyleaf.sources import manifest, runs, tables


def read_object(value: str, flag: str) -> str:
    """JSON text of an object, given inline or as a file."""
    text = value if value.lstrip()[:1] in ("{", "[") else Path(value).read_text(encoding="utf-8-sig")
    try:
        found = json.loads(text)
    except ValueError as e:
        raise SystemExit(f"{flag}: not JSON: {e}") from None
    if not isinstance(found, dict):
        raise SystemExit(f"{flag}: a JSON object is needed")
    return text


def show(value) -> None:
    print(json.dumps(value, indent=2, ensure_ascii=False))


def _order(given: list[str] | None):
    return False if given is None else given or True


def _score(spark: SparkSession, a: argparse.Namespace) -> None:
    scores, rows = grade.score_one(spark, *(read_object(getattr(a, x), f"--{x}") for x in ("pred", "gold", "schema")), order=_order(a.order_matters))
    show(scores | ({"verdicts": rows} if a.details else {}))


def _documents(spark: SparkSession, a: argparse.Namespace):
    docs = manifest.read(spark, a.dataset, a.manifest or CONFIG["manifest"])
    return manifest.with_golds(docs, manifest.json_files(spark, f"{a.dataset}/{a.golds or CONFIG['golds']}", "gold"))


CONFIG = {"system": None, "options": {}, "dataset": "dataset", "manifest": "manifest.parquet", "golds": "gold", "order": False, "rows": {"limit": 0, "sample": 0, "only": []}, "timeout": int(predict.TIMEOUT), "workers": predict.WORKERS}


def _paths(config: dict, above: str = "") -> list[str]:
    """Dotted names of all that a configuration has."""
    return [x for k, v in config.items() for x in (f"{above}{k}", *(_paths(v, f"{above}{k}.") if isinstance(v, dict) else []))]


def configured(text: str, changes: list[str]) -> dict:
    """A configuration with changes such as dataset=x or options.dialect="strict"; values are JSON or plain texts."""
    config = json.loads(json.dumps(CONFIG)) | json.loads(text)
    for change in changes:
        name, found, value = change.partition("=")
        at, *path = config, *name.split(".")
        known = _paths(CONFIG | {k: config[k] for k in ("options",)})
        # A system's options are its own affair.
        if not found or (name not in known and path[0] != "options"):
            near = difflib.get_close_matches(name, known, 1, 0.0)
            raise ValueError(f"--set takes NAME=VALUE with a name that the configuration has, not {change!r}; the nearest is {near[0]!r}")
        for step in path[:-1]:
            at = at.setdefault(step, {})
        try:
            at[path[-1]] = json.loads(value)
        except ValueError:
            at[path[-1]] = value
    if unknown := set(config) - set(CONFIG):
        raise ValueError(f"the configuration has an unknown {min(unknown)!r}; the nearest is {difflib.get_close_matches(min(unknown), list(CONFIG), 1, 0.0)[0]!r}")
    if not config["system"]:
        raise ValueError("the configuration names no system")
    return config


def _init(spark: SparkSession | None, a: argparse.Namespace) -> None:
    predict.system(a.system)
    show(CONFIG | {"system": a.system})


def _systems(spark: SparkSession | None, a: argparse.Namespace) -> None:
    if a.name is None:
        show(sorted(predict.systems()))
    else:
        made = predict.system(a.name)
        show({"name": a.name, "dialect": made.dialect, "reader": made.reader})


def _predict(spark: SparkSession | None, a: argparse.Namespace) -> None:
    made = predict.system(a.system, json.loads(read_object(a.options, "--options")))
    sent = predict.question(read_object(a.schema, "--schema"), made.dialect)
    show({"sent": sent, "raw": made.extract(a.doc, sent)})


def _confirmed(a: argparse.Namespace, what: str) -> None:
    if not a.yes and input(f"{what} [y/N] ").strip().lower() not in ("y", "yes"):
        raise ValueError("nothing was done")


def _wanted(spark: SparkSession, config: dict):
    return runs.chosen(manifest.read(spark, config["dataset"], config["manifest"]), config["rows"])


def _asked(spark: SparkSession, a: argparse.Namespace, config: dict, folder: str, retry_failed: bool) -> None:
    """Ask for what is missing, then grade everything."""
    made = predict.system(config["system"], config["options"])
    done = predict.predict(_wanted(spark, config), made, folder, retry_failed, config["workers"], config["timeout"])
    _graded(spark, config, folder, done, made.reader, False, not a.no_details)


def _graded(spark: SparkSession, config: dict, folder: str, done, reader: str, partial: bool, details: bool) -> None:
    golds = manifest.json_files(spark, f"{config['dataset']}/{config['golds']}", "gold")
    _shown(predict.graded(predict.with_causes(_wanted(spark, config), golds, done, reader), folder, config["order"], partial, details))


def _shown(graded) -> None:
    show({k: v for k, v in json.loads(graded[1].select(F.to_json(F.struct("*"))).first()[0]).items() if v is not None})


def _config_of(folder: str) -> str:
    return f"{folder.rstrip('/')}/run.json"


def _kept_config(spark: SparkSession, folder: str) -> dict:
    return configured(tables.read_text(spark, _config_of(folder)), [])


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    config = configured(read_object(a.config, "--config"), a.set)
    if tables.exists(spark, _config_of(a.out)):
        raise ValueError(f"{a.out} has a run; resume it")
    n = _wanted(spark, config).count()
    _confirmed(a, f"Ask {config['system']} for {n} documents of {config['dataset']}?")
    tables.write_text(spark, _config_of(a.out), json.dumps(config, indent=2))
    _asked(spark, a, config, a.out, False)


def _resume(spark: SparkSession, a: argparse.Namespace) -> None:
    _asked(spark, a, _kept_config(spark, a.folder), a.folder, a.retry_failed)


def _grade(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.dataset is None or tables.exists(spark, _config_of(a.folder)):
        config = _kept_config(spark, a.folder) | {k: v for k in ("dataset", "manifest", "golds") if (v := getattr(a, k)) is not None}
        config["order"] = config["order"] if a.order_matters is None else _order(a.order_matters)
        done = predict.existing(spark, a.folder)
        if done is None:
            raise ValueError(f"{a.folder} has no records")
        _graded(spark, config, a.folder, done, predict.system(config["system"], config["options"]).reader, a.partial, not a.no_details)
        return
    docs = manifest.with_predictions(_documents(spark, a), manifest.json_files(spark, f"{a.folder}/predictions", "pred"))
    _shown(predict.graded(docs, a.folder, _order(a.order_matters), a.partial, not a.no_details))


def _check(spark: SparkSession, a: argparse.Namespace) -> None:
    show({"documents": _documents(spark, a).count()})


def _stats(spark: SparkSession, a: argparse.Namespace) -> None:
    source = f"{a.dataset.rstrip('/')}/{a.manifest or CONFIG['manifest']}"
    docs = _documents(spark, a)
    manifest.write_new(profile.described(spark.read.parquet(source), docs.select("doc_id", "gold")), a.out, (source,))


def _dialects(spark: SparkSession | None, a: argparse.Namespace) -> None:
    if a.name is None:
        show(sorted(dialects.DIALECTS))
    else:
        show(dialects.DIALECTS[a.name](schemas.stripped(schemas.overlaid(json.loads(read_object(a.schema, "--schema"))))))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyleaf", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *flags: str, order: bool = False, dataset: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for f in flags:
            c.add_argument(f"--{f}", required=True)
        if order:
            c.add_argument("--order-matters", nargs="*", metavar="ARRAY", help="arrays that keep their order; none named: all")
        if dataset:
            c.add_argument("--dataset", required=name != "grade", help="of a run's folder: that of its configuration, if none is given")
            c.add_argument("--manifest")
            c.add_argument("--golds")
        return c

    command("score", _score, "pred", "gold", "schema", order=True).add_argument("--details", action="store_true")
    c = command("grade", _grade, order=True, dataset=True)
    c.add_argument("folder")
    c.add_argument("--no-details", action="store_true")
    c.add_argument("--partial", action="store_true", help="grade a run that isn't finished")
    command("init", _init).add_argument("system")
    command("systems", _systems).add_argument("name", nargs="?")
    command("predict", _predict, "system", "doc", "schema").add_argument("--options", default="{}")
    c = command("run", _run, "config", "out")
    c.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    c.add_argument("-y", "--yes", action="store_true")
    c.add_argument("--no-details", action="store_true")
    c = command("resume", _resume)
    c.add_argument("folder")
    c.add_argument("--retry-failed", action="store_true")
    c.add_argument("--no-details", action="store_true")
    command("check", _check, dataset=True)
    command("stats", _stats, "out", dataset=True)
    c = command("dialects", _dialects)
    c.add_argument("name", nargs="?")
    c.add_argument("--schema", default="{}")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        a.run(None if a.run in (_dialects, _init, _systems, _predict) else SparkSession.builder.appName("tallyleaf").getOrCreate(), a)
    except (ValueError, TypeError, OSError, predict.SystemFailed) as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130
    return 0


if __name__ == "__main__":
    sys.exit(main())
