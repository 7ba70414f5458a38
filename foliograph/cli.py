"""Command line: init, index, status, find, show, refs, backrefs, lint and cache, as text or JSON."""

from __future__ import annotations

import argparse
import json
import sys

from .functions.text import QueryError
from .functions.where import FieldError


def escape(s: str) -> str:
    """Control characters as ``\\xNN``, so that a path cannot steer a terminal."""
    return "".join(f"\\x{ord(c):02x}" if ord(c) < 32 or 127 <= ord(c) < 160 else c for c in s)


def camel(s: str) -> str:
    head, *rest = s.split("_")
    return head + "".join(x.title() for x in rest)


def _emit(rows: list[dict], name: str, as_json: bool, line, **more) -> None:
    if as_json:
        print(json.dumps({name: [{camel(k): v for k, v in r.items()} for r in rows], **more}, indent=2, ensure_ascii=False, default=str))
    else:
        for r in rows:
            print(escape(line(r)))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliograph")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str):
        c = sub.add_parser(name)
        c.add_argument("--json", action="store_true")
        return c

    command("init")
    command("index").add_argument("--rebuild", action="store_true")
    command("status")
    f = command("find")
    f.add_argument("query", nargs="?")
    for name in ("--glob", "--where", "--field", "--from"):
        f.add_argument(name, action="append", default=[], dest=name[2:] + "_")
    f.add_argument("--kind")
    f.add_argument("--link-kind")
    f.add_argument("--limit", type=int)
    for name in ("--errors", "--no-refs", "--no-backrefs"):
        f.add_argument(name, action="store_true")
    for name in ("show", "refs", "backrefs"):
        c = command(name)
        c.add_argument("path")
    c.add_argument("--link-kind")
    c.add_argument("--from", action="append", default=[], dest="from_")
    c.add_argument("--transitive", action="store_true")
    command("lint").add_argument("--rule", action="append", default=[])
    c = command("cache")
    c.add_argument("action", choices=("list", "prune"))
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--include-unreachable", action="store_true")
    return p


def run(args: list[str], spark=None, cwd: str = ".") -> int:
    """0 clean, 1 findings, 2 error."""
    a = parser().parse_args(args)
    try:
        return _run(a, spark, cwd)
    except (ValueError, FieldError, QueryError) as e:
        print(f"foliograph: {e}", file=sys.stderr)
        return 2


def _run(a, spark, cwd: str) -> int:
    from . import cache
    from .sources.workspace import Workspace

    if a.command == "init":
        print(Workspace.init(cwd).root)
        return 0
    if a.command == "cache":
        rows = cache.listing() if a.action == "list" else cache.prune(dry_run=a.dry_run, include_unreachable=a.include_unreachable)
        _emit(rows, "indexes", a.json, lambda r: f"{r['state']}  {r['bytes']}  {r['root'] or r['folder']}")
        return 0
    from .engine import Engine
    from .operators.find import FindOptions

    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("foliograph").getOrCreate()
    engine = Engine.open(spark, cwd)
    counts = engine.sweep(rebuild=getattr(a, "rebuild", False))
    if counts["unreadable"]:
        print(f"foliograph: {counts['unreadable']} files could not be read", file=sys.stderr)
    if a.command == "index":
        _emit([counts], "index", a.json, lambda r: "  ".join(f"{k} {v}" for k, v in r.items()))
    elif a.command == "status":
        _emit([engine.status()], "status", a.json, lambda r: "\n".join(f"{k} {v}" for k, v in r.items()))
    elif a.command == "find":
        options = FindOptions(a.query, a.glob_, a.kind, a.where_, a.field_, a.errors, a.no_refs, a.no_backrefs, a.from_, a.link_kind, a.limit)
        df, truncated = engine.find(options)
        rows = []
        for r in df.collect():
            d = r.asDict(recursive=True)
            fields = {k[6:]: json.loads(v) for k in list(d) if k.startswith("field:") and (v := d.pop(k)) is not None}
            row = {"path": d["path"], "kind": d["kind"], "size": d["size"], "modified": d["mtime"], "title": d.get("title")}
            row |= {"parse_error": d["parse_error"], "snippet": d.get("snippet")}
            rows.append(row | ({"fields": fields} if a.field_ else {}))

        def line(r: dict) -> str:
            shown = [f"{k}={v if isinstance(v, str) else json.dumps(v)}" for k, v in r.get("fields", {}).items()]
            first = "  ".join([r["path"], *([r["parse_error"]] if a.errors else []), *shown])
            return first + (f"\n    {r['snippet']}" if r["snippet"] else "")

        _emit(rows, "files", a.json, line, truncated=truncated)
        if truncated and not a.json:
            print(f"foliograph: showing the first {options.cap} files; --limit raises the cap", file=sys.stderr)
    elif a.command == "show":
        _emit([engine.show(a.path)], "file", a.json, lambda r: "\n".join(f"{k}: {v}" for k, v in r.items() if v is not None))
    elif a.command == "refs":
        _emit([r.asDict() for r in engine.refs(a.path).collect()], "links", a.json, lambda r: f"{r['line']}  {r['raw']} -> {r['target'] or ''} {r['target_type'] or r['type']}")
    elif a.command == "backrefs":
        rows = [r.asDict() for r in engine.backrefs(a.path, a.link_kind, a.from_, a.transitive).collect()]
        _emit(rows, "files" if a.transitive else "links", a.json, lambda r: r["path"] if a.transitive else f"{r['source']}:{r['line']}  {r['raw']}")
    elif a.command == "lint":
        for said in engine.warnings():
            print(f"foliograph: {said}", file=sys.stderr)
        rows = [r.asDict(recursive=True) for r in engine.lint(a.rule or None).collect()]
        _emit(rows, "findings", a.json, lambda r: f"{r['path']}{':' + str(r['line']) if r['line'] else ''}: {r['rule']}: {r['message']}")
        return 1 if rows else 0
    return 0


def main() -> int:
    return run(sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
