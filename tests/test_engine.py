import json
import os
import sqlite3
import time

import pytest

from foliograph import cli
from foliograph.engine import Engine
from foliograph.functions import text, where
from foliograph.functions.paths import glob_matches, resolve_text
from foliograph.operators.find import FindOptions, OptionError
from foliograph.sources import frontmatter, markdown, page, workspace


@pytest.fixture()
def notes(tmp_path):
    root = tmp_path / "notes"
    (root / "kb/sub").mkdir(parents=True)
    (root / "raw").mkdir()
    workspace.Workspace.init(root)
    (root / ".foliograph/config.json").write_text('{"bundles": ["kb"], /* ours */ "links": {"frontmatter": [{"field": "cites[]"}]},}')
    (root / "kb/index.md").write_text("---\nokf_version: '0.2'\n---\n* [A](a.md) - about foxes\n* [Gone](gone.md) - lost\n")
    (root / "kb/a.md").write_text("---\ntype: note\ndescription: about foxes\ncites: [../raw/x.png, b.md]\nrank: 3\n---\n# Foxes\nA fox and [b](b.md), [no](missing.md), [web](https://x.org).\n")
    (root / "kb/b.md").write_text("---\ntype: note\nstatus: odd\n---\nSee [a](/a.md#top). fox fox\n")
    (root / "kb/bad.md").write_text("---\na: [\n---\nbody\n")
    (root / "raw/x.png").write_bytes(b"\x89PNG")
    return root


def test_sweep_find_and_graph(spark, notes, tmp_path):
    engine = Engine.open(spark, notes, tmp_path / "index")
    counts = engine.sweep(now=4e9)
    assert (counts["files"], counts["added"], counts["hashed"]) == (5, 5, 5)
    assert engine.sweep(now=4e9)["hashed"] == 0
    paths = lambda **o: [r["path"] for r in engine.find(FindOptions(**o))[0].collect()]
    assert paths(kind="other") == ["raw/x.png"]
    assert paths(where=["rank>=3"]) == ["kb/a.md"]
    assert paths(where=["rank!=3"]) == ["kb/b.md", "kb/index.md"]
    assert paths(errors=True) == ["kb/bad.md"]
    assert paths(no_backrefs=True) == ["kb/bad.md", "kb/index.md"]
    assert paths(query="foxes")[0] == "kb/a.md" and set(paths(query="fox")) == {"kb/a.md", "kb/b.md", "kb/index.md"}
    rows, cut = engine.find(FindOptions(limit=2))
    assert cut and rows.count() == 2
    assert [r["target_type"] for r in engine.refs("kb/a.md").collect()] == ["file", "file", "file", "missing", None]
    assert [r["path"] for r in engine.backrefs("raw/x.png", transitive=True).collect()] == ["kb/a.md", "kb/b.md", "kb/index.md"]
    found = {(r["path"], r["rule"]) for r in engine.lint().collect()}
    assert {("kb/a.md", "broken-link"), ("kb/b.md", "okf-status"), ("kb/b.md", "okf-index"), ("kb/bad.md", "frontmatter-syntax"), ("kb/bad.md", "okf-type"), ("kb/index.md", "okf-index")} <= found
    (notes / "kb/b.md").unlink()
    (notes / "kb/a.md").write_text("---\ntype: note\n---\nnew\n")
    counts = engine.sweep(now=4e9 + 10)
    assert (counts["removed"], counts["updated"]) == (1, 1)


def test_cli(spark, notes, capsys, monkeypatch, tmp_path):
    monkeypatch.setenv("FOLIOGRAPH_CACHE", str(tmp_path / "cache"))
    assert cli.run(["find", "--glob", "kb/*.md", "--field", "rank", "--json"], spark, str(notes)) == 0
    files = json.loads(capsys.readouterr().out)["files"]
    assert [f["path"] for f in files] == ["kb/a.md", "kb/b.md", "kb/bad.md", "kb/index.md"] and files[0]["fields"] == {"rank": 3}
    assert cli.run(["find", "--from", "x"], spark, str(notes)) == 2
    with pytest.raises(OptionError):
        FindOptions(limit=0).check()


def test_conditions():
    assert where.parse_condition("a.b[].c>=@x") == where.Condition("a.b[].c", ">=", other="x")
    assert where.parse_condition("a=@@x").literal == "@x"
    for bad in ("=x", "a..b=1", "a[=1"):
        with pytest.raises(where.FieldError):
            where.parse_condition(bad)


def test_yaml_core_schema():
    block = frontmatter.read("﻿---\r\na: yes\nb: 0x1F\nc: '3'\nd: 2026-04-01\ne: ~\nf: 1.5\ng: .inf\n---\nbody")
    assert json.loads(block.json) == {"a": "yes", "b": 31, "c": "3", "d": "2026-04-01", "e": None, "f": 1.5, "g": ".inf"}
    assert frontmatter.read("---\na: 1\na: 2\n---\n").error and frontmatter.read("---\n- 1\n---\n").error and frontmatter.read("---\nx: 1\n").error


def test_markdown_links():
    doc = markdown.parse("# Title *x*\n[a](b.md 't') `[c](d)` ![i](p.png)\n[r][ref] <https://x.y> <me@x.y>\n\n[ref]: to.md\n\n    [code](no)\n\n```\n[no](no)\n```\n\n[^1]: see [f](f.md)\n")
    assert [(x.line, x.url, x.text) for x in doc.links] == [(2, "b.md", "a"), (2, "p.png", "i"), (3, "to.md", "r"), (3, "https://x.y", "https://x.y"), (3, "me@x.y", "me@x.y"), (13, "f.md", "f")]
    assert doc.title == "Title x"
    assert markdown.entries(markdown.parse("* [A](a.md) - said so\n* plain [b](b.md)\n")) == [(1, "a.md", "said so")]
    markdown.parse("[x](" * 20_000)


def test_paths():
    assert resolve_text("../b%20c.md#x", "a/d/p.md", "", False, True) == ("path", "a/b c.md")
    assert resolve_text("../../x", "a/p.md", "", False, True) == ("path", None)
    assert resolve_text("/x", "kb/s/p.md", "kb", False, True) == ("path", "kb/x")
    assert glob_matches("a/b/c.md", ["**/*.md"]) and not glob_matches("a/c.md", ["*.md"]) and glob_matches("x.md", ["!y.md"])


def test_page_checks():
    s = page.Settings(("kb",), ("kb",))
    p = page.parse("kb/x.md", "---\ntype: ''\nsources:\n- id: a\ngenerated: {at: 2026-01-01, by: me}\n---\nx[^q]\n\n[^q]: y\n", s)
    assert [r for r, _, _ in p.findings] == ["okf-type", "okf-source-resource", "okf-timestamp", "okf-actor", "okf-footnote"]


@pytest.mark.parametrize("tokenizer", ["porter", "trigram"])
def test_ranking_follows_sqlite(spark, tmp_path, tokenizer):
    from foliograph.operators.search import SearchIndex

    docs = [("a.md", "Running foxes", "quick", "the fox runs and relates happily"), ("b.md", "other", "", "foxes foxes run relational café"), ("c.md", "x", "fox", "nothing here"), ("d.md", "y", "", "quick brown dogs run"), ("e.md", "z", "", "more of nothing")]
    db = sqlite3.connect(":memory:")
    db.execute(f"create virtual table s using fts5(title, description, path, body, tokenize='{'porter unicode61' if tokenizer == 'porter' else 'trigram'}')")
    db.executemany("insert into s values (?,?,?,?)", [(t, d, p, b) for p, t, d, b in docs])
    frame = spark.createDataFrame(docs, "path string, title string, description string, body string")
    indexed = SearchIndex.build(frame, f"{tmp_path}/index", tokenizer, buckets=4)
    for q in ("fox", "run fox", '"foxes run"', '"foxes   run"', "relate", "quick run"):
        match = " ".join('"' + x + '"' for x in text.parse_query(q))
        want = {p: s for p, s in db.execute("select path, bm25(s, 10, 7, 5, 1) from s where s match ?", (match,))}
        got = {r["path"]: r["score"] for r in indexed.search(q).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got), q
    assert indexed.search("... !!" if tokenizer == "porter" else "ab").count() == 0
    later = indexed.replaced(f"{tmp_path}/later", frame.limit(0), frame.where("path <> 'b.md'"))
    db.execute("delete from s where path = 'b.md'")
    want = {p: s for p, s in db.execute("select path, bm25(s, 10, 7, 5, 1) from s where s match 'fox'")}
    assert {r["path"]: round(r["score"], 9) for r in later.search("fox").collect()} == {p: round(s, 9) for p, s in want.items()}


def test_search_reads_its_terms_only(spark, tmp_path):
    from foliograph.operators.search import SearchIndex

    docs = spark.range(300).selectExpr("concat(id, '.md') AS path", "'t' AS title", "'' AS description", "concat('w', id, ' common w', id + 1) AS body")
    indexed = SearchIndex.build(docs, f"{tmp_path}/index", "plain")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = indexed.of(["w7"])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "token,w7" in plan.split("PushedFilters")[1]
    assert sorted(r["path"] for r in indexed.search("w7").collect()) == ["6.md", "7.md"] and indexed.search("common").count() == 300


def test_postings_are_few_rows(spark, tmp_path):
    """One row a token and block, not one a token and page; pages that go take their places with them."""
    from foliograph.operators.search import SearchIndex

    docs = spark.range(300).selectExpr("concat(id, '.md') AS path", "'t' AS title", "'' AS description", "concat('w', id % 7, ' common common') AS body").coalesce(2)
    for tokenizer in ("plain", "trigram"):
        indexed = SearchIndex.build(docs, f"{tmp_path}/{tokenizer}", tokenizer)
        blocks = indexed.blocks.count()
        assert blocks <= 8 and indexed.postings.groupBy("token").count().where(f"count > {blocks}").count() == 0
        token = "common" if tokenizer == "plain" else "com"
        told = lambda x: tuple(x.postings.where(f"token = '{token}'").selectExpr("sum(n_pages)", "sum(n)").first())  # noqa: B023, E731
        assert told(indexed) == (300, 600)
        later = indexed.replaced(f"{tmp_path}/{tokenizer}-later", docs.limit(0), docs.where("path NOT LIKE '1%'"))
        assert told(later) == (189, 378) and later.search("common").count() == 189 == later.about["n_docs"]
        assert later.search('"common common"').where("path LIKE '1%'").count() == 0


def test_positions_and_words_are_exact():
    import random
    import unicodedata

    import numpy as np

    from foliograph.functions import blocks

    r = random.Random(3)
    for n in (0, 1, 900):
        positions = np.sort(np.array(r.sample([*range(1000), 1 << 14, 1 << 22, 1 << 29], n), np.int64))
        data, _ = blocks.encode(positions, np.zeros(min(n, 1), np.int64))
        assert n == 0 or blocks.decode(data.tobytes()).tolist() == positions.tolist()
    for _ in range(500):
        s = "".join(r.choice("aé _\u0301\u0308\u0b94\u0f71\u0f73ıİKß-\u0345ϓ한e9½") for _ in range(30))
        folded = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
        assert text.tokenize(s) == [text.stem(w) for w in text.words(folded, "plain")]


def test_snippets_follow_sqlite():
    import random

    r = random.Random(4)
    words, compared = [f"w{k}" for k in range(30)] + ["fox", "running", "dogs"], 0
    for tokenizer, size in (("porter", 20), ("trigram", 64)):
        db = sqlite3.connect(":memory:")
        db.execute(f"create virtual table s using fts5(body, tokenize='{'porter unicode61' if tokenizer == 'porter' else 'trigram'}')")
        for _ in range(400):
            body = " ".join(w + r.choice(["", "", "", "", ".", " -", ":"]) for w in r.choices(words, k=r.randint(1, 150)))
            phrases = text.parse_query(r.choice(["fox", "running dogs", '"fox w1"', "w1 w2 w3", "dogs", "ing", '"w1 w2"']))
            if tokenizer == "trigram" and any(len(p) < 3 for p in phrases):
                continue
            db.execute("delete from s")
            db.execute("insert into s values (?)", (body,))
            match = " ".join(f'"{p}"' for p in phrases)
            row = db.execute("select snippet(s, 0, char(2), char(3), char(1), ?) from s where s match ?", (size, match)).fetchone()
            if not row:
                continue
            want = row[0]
            if tokenizer == "trigram":  # words that a cut goes through are left out, unless they hold a match
                first, last = want.find(" "), want.rfind(" ")
                if want[0] == "\1" and first > 0 and not {"\2", "\3"} & set(want[:first]):
                    want = "\1" + want[first + 1 :]
                last = want.rfind(" ")
                if want[-1] == "\1" and last > 1 and not {"\2", "\3"} & set(want[last:]):
                    want = want[:last] + "\1"
            got, matches = text.snippet(body, phrases, tokenizer, size)
            for start, end in reversed(matches):
                got = f"{got[:start]}\2{got[start:end]}\3{got[end:]}"
            assert got == want.replace("\1", "..."), (body, phrases)
            compared += 1
    assert compared > 300


def test_rules_are_named_and_suppressed(spark):
    from pyspark.sql import functions as F

    from foliograph.operators import lint

    assert lint.match_rules(["okf-t*", "broken-link"]) == ["okf-type", "okf-timestamp", "broken-link"]
    with pytest.raises(ValueError):
        lint.match_rules(["okf-*", "okf-nothing"])
    rows = spark.createDataFrame([("a/b/c.md", "okf-type"), ("a/c.md", "okf-type"), ("x.md", "broken-link")], "path string, rule string")
    kept = lambda off, named=False: [r["path"] for r in rows.where(~lint.suppressed(F.col("rule"), F.col("path"), off, named)).collect()]
    assert kept([((), ("a/b",))]) == ["a/c.md", "x.md"] and kept([(("okf-*",), ())]) == ["x.md"]
    assert kept([(("okf-*",), ()), ((), ("x.md",))], named=True) == ["a/b/c.md", "a/c.md"]


def test_html_blocks_and_emphasis():
    urls = lambda s: [x.url for x in markdown.parse(s).links]
    assert urls("<div>\n[a](no.md)\n</div>\n\n[b](b.md)") == ["b.md"] and urls("<!-- [a](no) \n\n [x](no) -->\n[b](b.md)") == ["b.md"]
    assert urls("text <!-- [a](no.md) --> [b](b.md)\n<span>\n[c](c.md)") == ["b.md", "c.md"] and urls("<pre>\n\n[a](no)\n</pre>\n[b](b)") == ["b"]
    title = lambda s: markdown.parse("# " + s).title
    assert title("5*6 grid") == "5*6 grid" and title("a *b* **c** d_e_f _g_ 2 * 3") == "a b c d_e_f g 2 * 3" and title("***x*** **a*b**") == "x a*b"
    began = time.time()
    for s in ("<!-- a ", "*a ", "_a* ", "[x](", "<? "):
        markdown.parse(s * 20_000)
    assert time.time() - began < 20


def test_windows_and_statuses():
    s = page.Settings(("kb",), ("kb",))
    found = lambda front: [(r, m) for r, _, m in page.parse("kb/x.md", f"---\ntype: n\n{front}\n---\n", s).findings]
    assert found("usage_window: {from: 2026-01-01, start: never}") == [("okf-timestamp", "usage_window.from '2026-01-01' is not an ISO 8601 datetime with a UTC offset")]
    assert found("sources:\n- {resource: a, usage_window: {end: never, to: '2026-01-01T10:00:00'}}") == [("okf-timestamp", "sources[].usage_window.to '2026-01-01T10:00:00' has no UTC offset")]
    assert found("status: [draft]") == [("okf-status", "status is not draft, stable or deprecated")] and found("status: stable") == []
    root = lambda front: [r for r, _, _ in page.parse("kb/index.md", f"---\n{front}\n---\n", s).findings]
    assert root("okf_version: '0.2'") == [] and root("okf_version: '0.1'\ntitle: x") == ["okf-version", "okf-index-frontmatter"]


def test_sweeps_write_only_what_changes(spark, notes, tmp_path):
    folder = tmp_path / "index"
    engine = Engine.open(spark, notes, folder)
    engine.sweep(now=4e9)
    tables = lambda: engine.index.meta["tables"]
    first, names = tables(), set(os.listdir(folder))
    assert engine.sweep(now=4e9)["hashed"] == 0 and tables() == first and set(os.listdir(folder)) == names
    os.utime(notes / "kb/a.md", (3e9, 3e9))  # touched: the same bytes
    counts = engine.sweep(now=4e9)
    assert (counts["hashed"], counts["updated"]) == (1, 0)
    assert {k for k, v in tables().items() if v != first[k]} == {"files"}
    assert engine.files.where("path = 'kb/a.md'").first()["mtime"] == 3 * 10**16
    (notes / "kb/new.md").write_text("---\ntype: note\n---\na vixen\n")
    (notes / "kb/bad.md").unlink()
    counts = engine.sweep(now=4e9)
    assert (counts["added"], counts["removed"], counts["hashed"]) == (1, 1, 1) and len([n for n in os.listdir(folder) if n.startswith("v-")]) <= 3
    found = lambda q: {r["path"] for r in engine.find(FindOptions(query=q))[0].collect()}
    assert found("vixen") == {"kb/new.md"} and found("fox") == {"kb/a.md", "kb/b.md", "kb/index.md"}
    config = notes / ".foliograph/config.json"
    config.write_text(config.read_text().replace('{"bundles"', '{"search": {"tokenizer": "trigram"}, "bundles"'))
    engine = Engine.open(spark, notes, folder)
    assert engine.sweep(now=4e9)["hashed"] == 0 and found("ixe") == {"kb/new.md"} and found('"a  vix"') == {"kb/new.md"}
    meta = engine.index.meta
    engine.index.folder.write_text("current.json", json.dumps(meta | {"mark": "other"}))
    with pytest.raises(RuntimeError):
        engine.sweep()
    from foliograph.plans.ingest import validate_tables

    assert not any(validate_tables(engine.files, engine.links).values())


def test_unreadable_and_vanished_files(spark, notes, tmp_path, monkeypatch):
    from foliograph.plans import ingest

    (notes / "kb/gone.md").write_text("x")
    engine = Engine.open(spark, notes, tmp_path / "index")
    engine.sweep(now=4e9)
    listed = engine.workspace.scan()
    (notes / "kb/gone.md").unlink()
    (notes / "kb/b.md").unlink()
    (notes / "kb/b.md").mkdir()  # cannot be read as a file
    monkeypatch.setattr(workspace.Workspace, "scan", lambda self: [(p, f, s + 1, m) for p, f, s, m in listed if p in ("kb/gone.md", "kb/b.md")] + [x for x in listed if x[0] not in ("kb/gone.md", "kb/b.md")])
    counts = engine.sweep(now=4e9)
    assert (counts["removed"], counts["unreadable"]) == (1, 1)
    paths = {r["path"] for r in engine.files.collect()}
    assert "kb/gone.md" not in paths and "kb/b.md" in paths and engine.links.where("source = 'kb/b.md'").count() == 1
    assert ingest.read_file("kb/x.md", str(notes / "kb/x.md"), page.Settings())["fate"] == "vanished"


def test_tasks_list_large_workspaces(spark, notes, tmp_path, monkeypatch):
    from foliograph.plans import ingest

    (notes / "link.md").symlink_to(notes / "kb/a.md")
    monkeypatch.setattr(ingest, "LISTED_BY_DRIVER", 0)
    engine = Engine.open(spark, notes, tmp_path / "index")
    want = engine.workspace.scan()
    monkeypatch.setattr(workspace.Workspace, "scan", lambda self: pytest.fail("the driver listed the files"))
    assert sorted(tuple(r) for r in engine.index._listing("listing").collect()) == want and len(want) == 5
    assert engine.sweep(now=4e9)["added"] == 5
    names = sorted(os.listdir(tmp_path / "index"))
    assert engine.sweep(now=4e9)["hashed"] == 0 and sorted(os.listdir(tmp_path / "index")) == names


def test_cache_and_ignored_files(spark, notes, tmp_path):
    import subprocess

    from foliograph import cache
    from foliograph.sources.workspace import git_ignored, mount_of

    home = tmp_path / "cache"
    engine = Engine.open(spark, notes, home / "one")
    engine.sweep(now=4e9)
    for name, meta in (("two", {"root": str(tmp_path / "nowhere"), "mount": "/"}), ("three", {"root": "/mnt/gone/x", "mount": "/mnt/gone"}), ("four", None)):
        (home / name).mkdir()
        if meta:
            (home / name / "current.json").write_text(json.dumps(meta))
    states = {x["folder"].rpartition("/")[2]: x["state"] for x in cache.listing(home)}
    assert states == {"one": "live", "two": "orphaned", "three": "unreachable", "four": "unknown"}
    assert all(x["bytes"] >= 0 for x in cache.prune(home, dry_run=True)) and len(cache.prune(home)) == 1 and len(cache.prune(home, include_unreachable=True)) == 1
    assert mount_of("/mnt/nas2/x", ["/", "/mnt/nas"]) == "/" and mount_of("/mnt/nas/x", ["/", "/mnt/nas"]) == "/mnt/nas"
    assert git_ignored(notes) == (frozenset(), None)
    subprocess.run(["git", "init", "-q"], cwd=notes, check=True)
    (notes / ".gitignore").write_text("*.png\nkb/sub/\n")
    (notes / "kb/sub/x.md").write_text("x")
    names, warning = git_ignored(notes)
    assert names == {"raw/x.png", "kb/sub"} and warning is None or "raw" in names
    (notes / ".git/config").write_text("broken [")
    names, warning = git_ignored(notes)
    assert not names and warning.startswith("git could not list")


def test_equal_frontmatter_is_parsed_once(monkeypatch):
    seen = []
    loader = frontmatter._Loader
    monkeypatch.setattr(frontmatter, "_Loader", lambda s: seen.append(s) or loader(s))
    frontmatter._parsed.cache_clear()
    blocks = [frontmatter.read(f"---\ntype: note\n---\nbody {k}\n") for k in range(5)]
    assert seen == ["type: note\n"] and [b.body for b in blocks] == [f"body {k}\n" for k in range(5)] and {b.body_line for b in blocks} == {4}
    bad = [frontmatter.read("---\na: [\n---\n") for _ in range(2)]
    assert bad[0].error == bad[1].error and bad[0].error and bad[0].json is None
    assert frontmatter.read("---\r\na: b\r---\n\rx\u2028y").json == '{"a": "b"}' and frontmatter.read("---\na: b").error


def test_concepts_are_dealt_to_all_cores(spark):
    import __spark_entry__ as e

    assert e.queries()["lint_concepts"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_streams_of_pages(spark, tmp_path):
    from foliograph.streaming import sweeps

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"path": "a.md", "text": "[x](b.md)", "at": 1}\n{"path": "a.md", "text": "[x](c.md)", "at": 2}\n')
    stream = spark.readStream.schema("path string, text string, at long").json(str(tmp_path / "in"))
    held = []

    def sink(batch, number):
        last = sweeps.replace_latest(None, batch, "path", "at")
        held.extend((r["source"], r["target"]) for r in sweeps.page_links(last).collect())

    sweeps.run(stream, sink, str(tmp_path / "checkpoint")).awaitTermination(60)
    assert held == [("a.md", "c.md")]


def test_long_chains_of_links_are_followed(spark):
    from foliograph.operators import links as graph

    files = spark.range(12).selectExpr("concat(id, '.md') AS path", "concat(id, '.md') AS path_nfd")
    edges = spark.range(12).selectExpr("concat(id, '.md') AS source", "concat((id + 1) % 12, '.md') AS target_nfd", "'body' AS kind")
    got = {r["path"]: r["hops"] for r in graph.transitive_backrefs(edges, files, "0.md").collect()}
    assert got == {f"{k}.md": 12 - k for k in range(1, 12)}


def test_entry_without_training_package(tmp_path):
    """A copy without the training package and its pipeline still imports and has all other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    import __spark_entry__ as e

    root = Path(e.__file__).resolve().parent
    shutil.copytree(root / "foliograph", tmp_path / "foliograph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print('\\n'.join(sorted(e.queries())), file=open('names', 'w')); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    from foliograph.plans import registry

    assert (tmp_path / "names").read_text().split() == sorted(registry.QUERIES) and set(e.oracle_sql()) <= set(e.queries())


def test_every_link_is_typed(spark):
    import __spark_entry__ as e

    from foliograph.plans import adapter

    d = "/root/testdata/sf0.001"
    paths = {r["path"] for r in adapter.entity_files(spark, d).collect()}
    kind = lambda t: "file" if t in paths else "directory" if any(p.startswith(f"{t}/") for p in paths) else "missing"
    want = sorted((r["source"], r["line"], r["target"], kind(r["target"])) for r in adapter.entity_links(spark, d).collect())
    got = sorted(tuple(r) for r in e.queries()["refs_typed_all"](spark, d).collect())
    assert got == want and any(r[0].startswith("customer/") for r in got)
