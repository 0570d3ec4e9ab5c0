"""Command line of a project: ``python -m lexitile.cli COMMAND …``."""

from __future__ import annotations

import argparse
from pathlib import Path

from lexitile.project import Project, ProjectError, services


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexitile")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple) -> None:
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(*a[0], **a[1])

    arg = lambda n, **k: ((n,), k)
    add("init", arg("--name", default=None))
    add("set-source", arg("dir"), arg("lang"))
    add("set-target", arg("lang"), arg("dir", nargs="?"))
    add("remove-target", arg("lang"))
    add("sync")
    add("add", arg("files", nargs="+"))
    add("remove", arg("files", nargs="+"))
    add("list")
    add("info")
    add("set-llm", arg("service"), arg("model"))
    add("set-reasoning-model", arg("service"), arg("model"))
    add("list-llms")
    add("set-typst-func-args", arg("function"), arg("args", nargs="+"))
    add("unset-typst-func-args", arg("function"))
    add("translate", arg("what", choices=["file", "all"]), arg("lang"), arg("file", nargs="?"), arg("--service", default=None), arg("--vocabulary", default=None), arg("--use-reasoning-model", action="store_true"))
    add("correct", arg("lang"), arg("file", nargs="?"))
    add("cache", arg("action", choices=["sync", "clear"]), arg("--lang"), arg("--file"), arg("--keyword"), arg("--all", action="store_true"), arg("--missing-chunks", action="store_true"))
    return p


def run(argv: list[str], cwd: Path | None = None) -> list[str]:
    """Lines to print; ``ProjectError`` for requests that cannot be met."""
    a, cwd = parser().parse_args(argv), cwd or Path.cwd()
    if a.command == "init":
        Project.init(cwd, a.name or cwd.name)
        return []
    if a.command == "list-llms":
        return services()
    p = Project.load(cwd)
    match a.command:
        case "set-source":
            p.set_source(cwd / a.dir, a.lang)
        case "set-target":
            return [str(p.add_target(a.lang, cwd / a.dir if a.dir else None))]
        case "remove-target":
            p.remove_target(a.lang)
        case "sync":
            return [str(p.sync_untranslatable())]
        case "add" | "remove":
            for f in a.files:
                p.mark(cwd / f, a.command == "add")
        case "list":
            return list(p.config.translatable)
        case "info":
            c = p.config
            return [f"name {c.name}", f"source {c.source}", *(f"target {t}" for t in c.targets), f"model {c.service} {c.model}", *(f"typst {k} {' '.join(v)}" for k, v in sorted(c.typst_args.items()))]
        case "set-llm" | "set-reasoning-model":
            p.set_model(a.service, a.model, a.command == "set-reasoning-model")
        case "set-typst-func-args":
            p.set_typst_args(a.function, a.args)
        case "unset-typst-func-args":
            p.unset_typst_args(a.function)
        case "translate":
            return translate(p, a)
        case "cache":
            return cache(p, a)
        case "correct":
            return correct(p, a)
    return []


def cache(p: Project, a: argparse.Namespace) -> list[str]:
    from pyspark.sql import SparkSession

    from lexitile.project import files

    if a.action == "clear":
        if a.all == a.missing_chunks:
            raise ProjectError("exactly one of --all and --missing-chunks")
        if a.missing_chunks and (a.lang or a.file or a.keyword):
            raise ProjectError("--lang, --file and --keyword go with --all")
    spark = SparkSession.builder.getOrCreate()
    if a.action == "sync":
        return [f"{k} {n}" for k, n in files.sync(spark, p, [a.lang] if a.lang else None).items()]
    if a.missing_chunks:
        return [str(files.clear_missing(spark, p))]
    return [str(files.clear(spark, p, a.lang, p.relative_path(Path(a.file)) if a.file else None, a.keyword))]


def terms_of(path: str | None, src: str, tgt: str) -> str:
    """``source=target`` lines of a vocabulary CSV with a column for each language; cells are trimmed, rows without either are left out."""
    import csv

    if path is None:
        return ""
    with open(path, encoding="utf-8", newline="") as f:
        rows = [{k.strip().lower(): (v or "").strip() for k, v in r.items() if k} for r in csv.DictReader(f)]
    pairs = [(r.get(src.lower(), ""), r.get(tgt.lower(), "")) for r in rows]
    return "".join(f"{a}={b}\n" for a, b in pairs if a and b)


def translate(p: Project, a: argparse.Namespace) -> list[str]:
    from pyspark.sql import SparkSession

    from lexitile.operators.translation import Ladder
    from lexitile.project import SERVICES, files, language

    service, model, second, stronger = p.route(a.use_reasoning_model)
    service = a.service or service
    for name in (service, second):
        if name is not None and name not in SERVICES:
            raise ProjectError(f"no service {name!r}")
    lang = language(a.lang)
    ladder = Ladder(SERVICES[service].model(model), SERVICES[second].model(stronger) if second and stronger else None, cooldown=SERVICES[service].cooldown)
    only = p.relative_path(Path(a.file)) if a.what == "file" else None
    terms = terms_of(a.vocabulary, p.config.source["lang"] if p.config.source else "", lang)
    done = files.translate(SparkSession.builder.getOrCreate(), p, lang, ladder, terms, only=only)
    return [" ".join(map(str, r)) for r in done.collect()]


def correct(p: Project, a: argparse.Namespace) -> list[str]:
    from pyspark.sql import SparkSession

    from lexitile.project import files, language

    only = p.relative_path(Path(a.file)) if a.file else None
    return [" ".join(map(str, r)) for r in files.correct(SparkSession.builder.getOrCreate(), p, language(a.lang), only).collect()]


if __name__ == "__main__":
    import sys

    try:
        print("\n".join(run(sys.argv[1:])))
    except ProjectError as e:
        sys.exit(str(e))
