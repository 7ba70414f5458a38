import random
import zlib
from datetime import date

import numpy as np
import pytest

from foliograph.llm import common, decontaminate, langid, line_dedup, links, ngram_join, packing, pii, quality_cnn, quality_rules, token_files, tokens, url_filter
from foliograph.llm.common import shingle_hashes, word_hashes

DOCS = "doc_id long, text string, score string"


@pytest.fixture(scope="module")
def docs():
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    out = [(0, None, "x"), (1, "", "x"), (None, "no id here", "x"), (2, " \n\t ", "x"), (3, "one two", "x"), (4, "one two", "x"), (4, "one two", "x")]
    for k in range(10, 40):
        own = r.choices(words, k=r.randint(30, 120))
        out.append((k, " ".join(own), "x"))
        for copy in range(r.randint(0, 3)):
            near = own[:]
            for _ in range(r.randint(0, 2)):
                near[r.randrange(len(near))] = "changed"
            out.append((k * 100 + copy, " ".join(near), "x"))
    out.append((9000, " ".join(r.choices(words, k=30_000)), "x"))
    return out


def test_word_and_shingle_hashes():
    assert len(set(word_hashes("a b c a\tB".encode()).tolist())) == 3
    assert len(shingle_hashes(b"a b", 4)) == 1 and len(shingle_hashes(b"a b c d e a b c d", 4)) == 5 and len(shingle_hashes(b" ", 4)) == 0


def test_ngram_join_against_all_pairs(spark, docs):
    sets = [(i, {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if (w := (t or "").split()) else set()) for i, t, _ in docs if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i != j and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    want = sorted((i, len(s), find(i)) for i, s in sets)
    got = ngram_join.classes(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == want
    kept = ngram_join.one_of_each(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({c for _, _, c in want})
    assert ngram_join.classes(spark.createDataFrame([], DOCS)).count() == 0


def test_near_duplicates_stage_links_five_words_at_80(spark):
    import corpus_pipeline

    own = [f"v{k}" for k in range(96)]
    near = own[:30] + ["other"] + own[31:60] + ["more"] + own[61:]
    rows = [(1, " ".join(own), "x"), (2, " ".join(near), "x"), (3, " ".join(f"u{k}" for k in range(96)), "x")]
    s4, s5 = ([{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in (own, near)] for n in (4, 5))
    assert len(s4[0] & s4[1]) / len(s4[0] | s4[1]) < 0.85 and len(s5[0] & s5[1]) / len(s5[0] | s5[1]) >= 0.8
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3]


def test_rtree_finds_all_that_pass_the_bound():
    r = np.random.default_rng(1)
    points = r.poisson(1.5, (500, ngram_join.GROUPS)).astype(np.int32)
    points[250:] = points[:250] + (r.random((250, ngram_join.GROUPS)) < 0.05)
    sizes, cell, part = points.sum(1), np.arange(500) % 250 % 3, np.arange(500) % 7
    rest = sizes - r.integers(0, 30, 500)
    tree = ngram_join.CountRTree(cell, part, sizes, rest, points)
    tree.PIECE = 1000
    found = [(tree.order[i], tree.order[j]) for q, p, _ in tree.search(np.arange(500)) for i, j in zip(q.tolist(), p.tolist())]

    def passes(i, j):
        most = min(np.minimum(points[i], points[j]).sum(), rest[i], rest[j])
        return cell[i] == cell[j] and part[i] != part[j] and 185 * most >= 85 * (sizes[i] + sizes[j])

    want = {(i, j) for i in range(500) for j in range(500) if passes(i, j)}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 50
    near = ngram_join.CountRTree(cell, np.arange(500), sizes, sizes, np.repeat(points[:20], 25, 0), settled=False)
    first, second, _ = near.leaf_pairs(np.ones(500, bool))
    assert len(first) > 500 and all(first < second) and all(near.cell[first] == near.cell[second])


def test_all_links_come_out_of_the_tree(spark, docs, monkeypatch):
    """Every candidate of the whole table is a pair that a tree gave for a probe; large cells and tiles included."""
    candidates, given = ngram_join._candidates, []

    def counted(cells, nodes, percent, turn):
        out = candidates(cells, nodes, percent, turn).cache()
        given.append((turn, cells.count(), {(r["a"], r["b"]) for r in out.collect()}))
        return out

    verified, tried = ngram_join._verified, []

    def checked(pairs, *rest):
        tried.extend((r["a"], r["b"]) for r in pairs.collect())
        return verified(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_candidates", counted)
    monkeypatch.setattr(ngram_join, "_verified", checked)
    ngram_join.classes(spark.createDataFrame(docs, DOCS)).collect()
    assert given[0][0] == 1 and given[0][1] > 100 and tried and set(tried) <= set().union(*(x for _, _, x in given))


def test_large_groups_of_near_copies_settle(spark, monkeypatch):
    """A chain of texts whose ends are far apart, many near copies of one text and strays that share their frequent words;
    cells are dealt out into tiles of 16 points."""
    monkeypatch.setattr(ngram_join, "TILE", 16)
    r = random.Random(9)
    base = [f"b{k}" for k in range(60)]
    rows = [(999, " ".join(base), "x")]
    for k in range(150):
        near = base[:]
        near[r.randrange(60)] = f"x{k}"
        rows.append((k + 1000, " ".join(near), "x"))
    for k in range(40):  # each link of the chain renames one more word
        rows.append((k + 2000, " ".join(f"{'d' if j < k else 'c'}{j}" for j in range(60)), "x"))
    for k in range(100):
        rows.append((k + 3000, " ".join(base[:40] + [f"own{k}-{j}" for j in range(20)]), "x"))
    sets = [(i, {tuple(w[k : k + 4]) for k in range(len(w) - 3)}) for i, w in ((i, t.split()) for i, t, _ in rows)]
    near = {i: [j for j, b in sets if 100 * len(a & b) >= 85 * len(a | b)] for i, a in sets}
    want = {i: i for i in near}
    for _ in range(60):
        want = {i: min(want[j] for j in near[i]) for i in near}
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want and len(set(want.values())) < 120


def test_a_shingle_in_100_000_texts_makes_no_quadratic_cell(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = []
    candidates = ngram_join._candidates
    monkeypatch.setattr(ngram_join, "_candidates", lambda cells, *rest: rows.append(cells.count()) or candidates(cells, *rest))
    text = F.concat(F.lit(" ".join(f"p{k}" for k in range(20))), *(F.concat(F.lit(f" {c}"), F.col("id")) for c in "abc"))
    got = ngram_join.classes(spark.range(100_000).select(F.col("id").alias("doc_id"), text.alias("text")))
    assert got.where("doc_id = component_id").count() == 100_000 and max(rows) < 1000


def test_words_that_a_polynomial_cannot_tell_apart():
    word = "ab"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        assert len(set(word_hashes(f"{word} {other}".encode()).tolist())) == 2
    r = random.Random(2)
    words = [bytes(r.choices(range(33, 256), k=r.choice([1, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(3000)]
    one = {w: int(word_hashes(w)[0]) for w in words}
    assert len(set(one.values())) == len(one)
    assert word_hashes(b"\t".join(words) + b" ").tolist() == [one[w] for w in words]


def test_scaled_points_stay_upper_bounds():
    h = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 100_000).astype(np.uint64))
    both = ngram_join.counts_of([ngram_join.point(h), ngram_join.point(h[::2])])
    assert ngram_join.overlap(both[:1], both[1:])[0] >= len(h[::2])


def test_components(spark):
    r = random.Random(5)
    pairs = [(k, k + 1) for k in range(0, 300) if k % 50] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    were = links.CHUNK, links.ONE_TASK
    for links.CHUNK, links.ONE_TASK in ((7, 0), were):
        try:
            got = {r["node"]: r["component"] for r in links.components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
        finally:
            links.CHUNK, links.ONE_TASK = were
        assert got == {x: find(x) for x in parent}


def test_line_dedup(spark):
    line = "This line is certainly longer than forty characters."
    rows = [(k, f"own {k}\n {line.upper() if k % 2 else line}\n{line}", "x") for k in range(7)] + [(None, line, "x"), (20, None, "x"), (21, "", "x"), (6, f"again\n{line}", "x")]
    got = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_dropped"]) for r in line_dedup.apply(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[(k, f"own {k}")] == (3, 2) for k in range(6))
    assert got[(6, f"own 6\n {line}\n{line}")] == (3, 0) and got[(6, f"again\n{line}")] == (2, 0)
    assert got[(None, line)] == (1, 0) and got[(20, None)] == (1, 0) and got[(21, "")] == (1, 0)
    few = spark.createDataFrame(rows[:4], DOCS)
    assert line_dedup.apply(few).agg({"n_dropped": "sum"}).first()[0] == 0
    assert line_dedup.apply(spark.createDataFrame([], DOCS)).count() == 0


def brute_distance(item, s):
    row = [0] * (len(s) + 1)
    for c in item:
        new = [row[0] + 1]
        for k, d in enumerate(s):
            new.append(min(row[k] + (c != d), row[k + 1] + 1, new[k] + 1))
        row = new
    return min(row)


def test_decontamination_against_dynamic_programming(spark):
    r = random.Random(8)
    items = [(k, " ".join("".join(r.choices("abcdef", k=r.randint(2, 7))) for _ in range(12))) for k in range(6)] + [(9, None), (10, "short")]
    rows = [(100, None, "x"), (101, "", "x")]
    for k in range(40):
        t = list(r.choice(items[:6])[1])
        for _ in range(r.randint(0, 9)):
            at = r.randrange(len(t))
            t[at : at + 1] = r.choice(["", "z", t[at] + "q"])
        rows.append((k, "Before it, " + "".join(t).upper() + " and after.", "x"))
    want = set()
    for i, t, _ in rows:
        for k, item in items[:6]:
            n = decontaminate.normalise(item)
            if t and (d := brute_distance(n, decontaminate.normalise(t))) <= int(len(n) * decontaminate.RATE):
                want.add((i, k, d))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(rows, DOCS)
    assert want and {tuple(x)[:3] for x in decontaminate.find(df, bench).collect()} == want
    assert {tuple(x)[:3] for x in decontaminate.find(df, bench, block_chars=50).collect()} == want
    assert decontaminate.clean(df, bench).count() == len(rows) - len({i for i, _, _ in want})
    assert decontaminate.find(df, bench.limit(0)).count() == 0


def test_short_items_and_items_without_an_id(spark):
    bench = spark.createDataFrame([(1, "Blue whale!"), (2, "蓝鲸是最大的动物"), (None, "a long item that has no id but stands in a text"), (3, "..."), (None, "ruby")], "item_id long, text string")
    rows = [(10, "The blue  WHALE sings", "x"), (11, "the blue whales sing", "x"), (12, "a blue whalf", "x"), (13, "众所周知蓝鲸是最大的动物之一", "x"), (14, "so a long item that has no id but stand in a text", "x"), (15, "rubys; blue whales, blue whale", "x")]
    df = spark.createDataFrame(rows, DOCS)
    got = {tuple(r)[:4] for r in decontaminate.find(df, bench).collect()}
    assert got == {(10, 1, 0, 0), (13, 2, 0, 0), (14, None, 1, 3), (15, 1, 0, 0)}
    assert sorted(r["doc_id"] for r in decontaminate.clean(df, bench).collect()) == [11, 12]


def test_decompose():
    for n in (0, 1, 2047, 2048, 5000, 123_456):
        got = packing.decompose(n)
        assert [s for s, _ in got] == list(np.cumsum([0, *[x for _, x in got]])[:-1].astype(int)) and sum(x for _, x in got) == n
        assert all(x & (x - 1) == 0 and x <= 2048 for _, x in got)


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path()).encode(text or "", add_special_tokens=False).ids + [1]


def test_tokens_packing_and_files(spark, docs, tmp_path):
    odd = [(50, "Don't STOP! <|endoftext|> naïve café x y ΟΔΟΣ. 12,345 ... \x1c #tag's", "x")]
    some = [d for d in docs if d[0] != 9000] + odd + [(60, "long word " * 6000, "x")]
    want = {(i, t): library_ids(t) for i, t, _ in some}
    df = spark.createDataFrame(some, DOCS)
    small = tokens.WordEncoder(tokens.default_path(), cache_words=3)
    assert all(small.document(None if t is None else t.encode()).tolist() == w for (_, t), w in want.items())
    pieces = packing.pack(df, with_ids=True).collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces) and all(p["length"] == len(p["ids"]) == 1 << p["bucket"] for p in pieces)
    whole = {i: w for (i, _), w in want.items()}
    assert all(p["ids"] == whole[p["doc_id"]][p["start"] : p["start"] + p["length"]] for p in pieces)
    assert all(p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in pieces)
    folder = f"file://{tmp_path}/files"
    parts = token_files.write(df, folder, length=64, batch=4, parts=3)
    got = token_files.read_digests(spark, folder).collect()
    order = sorted(some, key=lambda d: (d[0] is not None, d[0] or 0))
    ends = np.cumsum([0] + [len(want[d[:2]]) for d in order])
    assert sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == [(int(s), len(want[d[:2]]), zlib.crc32(np.array(want[d[:2]], "<u4").tobytes())) for s, d in zip(ends, order)]
    reader = token_files.PartReader(str(tmp_path / "files"), parts[0][0])
    flat = np.concatenate([reader.sequence(k)[np.array(reader.mask(k).to_pylist())] for k in range(len(reader))])
    assert flat.tolist() == [x for d in order for x in want[d[:2]]][: len(flat)]
    empty = f"{tmp_path}/empty"
    token_files.write(spark.createDataFrame([], DOCS), empty)
    assert token_files.read_digests(spark, empty).count() == 0 and packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_encoder_keeps_words_that_come_again(monkeypatch):
    letters = str.maketrans("0123456789", "abcdefghij")
    rare = [[f"{k:04}{n:04}q".translate(letters) for n in range(100)] for k in range(100)]
    texts = [" ".join(["common", "Words,", "naïve", *own]) for own in rare]
    enc, asked = tokens.encoder(tokens.default_path(), sparing=True), []
    library = enc._library
    monkeypatch.setattr(enc, "_library", lambda t, words: asked.extend(words) or library(t, words))
    got = [enc.document(t.encode()).tolist() for t in texts]
    assert got[0] == library_ids(texts[0]) and got[-1] == library_ids(texts[-1])
    assert len(enc.cache) + len(enc.older) < 300  # 3 come again; 10,000 do not, but for chance hits of their marks
    assert asked.count("common") <= 2 and {b"common", b"Words,"} <= enc.cache.keys()
    again = tokens.WordEncoder(tokens.default_path(), 3, True)
    monkeypatch.setattr(tokens, "GROUP_BYTES", 3000)
    assert [x.tolist() for x in again.documents([None, b"", *(t.encode() for t in texts)])] == [[1], [1], *got]


def test_labelled_ids_start_no_python_workers(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    docs.write.parquet(path := f"{common.work_dir(spark)}/labelled")
    rows, totals = common.labelled_sample(spark.read.parquet(path), labels, "quality", 5, learnable_only=False)
    got = sorted((r["doc_id"], r["label"], bytes(r["text"])) for r in rows.collect())
    assert totals == {0: 20, 1: 20} and len(got) == 10 and all(y == k % 2 and t == f"text {k}".encode() for k, y, t in got)
    assert "ExistingRDD" not in rows._jdf.queryExecution().toString()
    assert common.labelled_sample(spark.read.parquet(path), labels.limit(0), "quality", 5, learnable_only=False)[0].count() == 0


def test_base_counts():
    assert quality_rules.base_counts("é a# |b\n\né a# |b\nx".encode())[:4] == (7, 11, 4, 1)
    assert quality_rules.base_counts(b"a b c d a b c e")[4] == 6 and quality_rules.base_counts(None) == (0, 0, 0, 0, 0)


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(4)
    good = lambda: " ".join("".join(r.choices("etaoins", k=r.randint(2, 8))) for _ in range(80))
    rows = [(k, good() if k % 2 else good().upper().replace(" ", "!! "), "x") for k in range(240)] + [(1000, None, "x"), (1001, "", "x"), (None, good(), "x")]
    labels = [(k, k % 2, 0) for k in range(240)] + [(3, None, 0), (None, 1, 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_models(labelled):
    df, labels = labelled
    rules = quality_rules.apply(df, quality_rules.fit(df, labels)).collect()
    assert np.mean([r["kept"] == bool(r["doc_id"] % 2) for r in rules if (r["doc_id"] or 1e6) < 1000]) > 0.95
    assert all(r["base_failed"] and not r["kept"] for r in rules if r["doc_id"] in (1000, 1001)) and rules[0]["score"] == "x"
    net = quality_cnn.fit(df, labels)
    got = quality_cnn.apply(df, net).collect()
    test = [r for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert len(got) == 243 and np.mean([r["predicted"] == r["doc_id"] % 2 for r in test]) > 0.9
    constant = quality_cnn.apply(df, quality_cnn.fit(df, labels.limit(0))).collect()
    assert {r["score"] for r in constant} == {0.5}
    b, _ = quality_cnn.chunks(bytes(range(1, 256)) * 30)
    assert b.shape[1] == quality_cnn.CHUNK and len(b) * (quality_cnn.CHUNK - quality_cnn.OVERLAP) + quality_cnn.OVERLAP >= 255 * 30


def test_long_texts_calibrate_whole(spark):
    from foliograph.llm.common import HELD_OUT_FOLD, class_weights, platt

    r = random.Random(12)
    word = lambda good: "".join(r.choices("etaoins" if good else "etaoinsqxz", k=r.randint(2, 8)))
    texts = {k: " ".join(word(k % 2) for _ in range(60 if k % 3 else 4000)) for k in range(160)}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], DOCS)
    net = quality_cnn.fit(df, spark.createDataFrame([(k, k % 2, 0) for k in texts], "doc_id long, quality int, toxic int"))
    learned = [k for k in texts if zlib.crc32(str(k).encode()) % 4 != HELD_OUT_FOLD]
    own = learned[4::5]
    z, y = np.array([net.logit(texts[k].encode()) for k in own]), np.array([k % 2 for k in own], np.float64)
    totals = {c: sum(k % 2 == c for k in learned) for c in (0, 1)}
    assert np.allclose((net.slope, net.shift), platt(z, y, class_weights(y, totals)), rtol=1e-3)
    long = [x for x in quality_cnn.apply(df, net).collect() if x["held_out"] and x["doc_id"] % 3 == 0]
    assert len(long) > 5 and np.mean([x["predicted"] == x["doc_id"] % 2 for x in long]) > 0.9


def test_language(spark):
    r = random.Random(6)
    rows = [(k, " ".join("".join(r.choices("aeiou" if k % 2 else "bcdfg", k=5)) for _ in range(20)), "va" if k % 2 else "co") for k in range(80)] + [(500, None, "va"), (501, "12 !", "va"), (502, "aei", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langid.apply(df, langid.fit(df)).collect()}
    assert all(got[k]["lang_pred"] == ("va" if k % 2 else "co") for k in range(80))
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und" and got[502]["lang_pred"] == "va"
    assert langid.apply(df, langid.fit(df.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_long_texts_outweigh_the_prior():
    at = np.flatnonzero(langid.counts(b"abcd"))
    table = np.full((langid.BUCKETS, 2), -9.0)
    table[at, 1] += 0.1
    model = langid.LanguageModel(("common", "rare"), table, np.log([0.999, 0.001]))
    names, scores = model.predict([b"abcd", b"abcd " * 100])
    assert names == ["common", "rare"] and 0.5 <= scores[1] <= 1
    assert not langid.has_letter("½ ² 3 _ !".encode()) and langid.has_letter("ª".encode()) and langid.has_letter("3 é".encode())


def test_url_filter(spark):
    rows = [(k, f"https://{'casino-win' if k % 7 == 0 else f'site{k}'}.example.net/en/{k}") for k in range(300)]
    rows += [(1000, "HTTP://WWW.Example.ORG/es/1?x=://y"), (1001, None), (1002, "no url"), (1003, "http://a.com/de/"), (1004, "http://notcom/de/"), (1005, "http://example.org/en/12#f"), (1006, "http://x.org")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.apply(df, url_filter.fit(df)).collect()}
    assert np.mean([(got[k]["verdict"] == "block") == (k % 7 == 0) for k in range(300)]) > 0.97
    assert (got[1000]["host"], got[1000]["path"], got[1000]["rule"], got[1000]["verdict"]) == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert (got[1001]["host"], got[1001]["path"], got[1001]["rule"]) == ("", "", None) and got[1002]["host"] == ""
    assert got[1003]["rule"] == "com/de/" and got[1004]["rule"] is None and got[1005]["rule"] == "example.org/en/1" and got[1006]["rule"] is None


def test_url_counts_are_exact(spark):
    r = random.Random(11)
    name = lambda k: "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=k))
    rows = [(k, f"http://{'casino' if k % 3 == 0 else ''}{name(20)}.net/{name(30)}") for k in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    model = url_filter.fit(df)
    urls = [(k % 3 == 0, u[7:].encode()) for k, u in rows]
    held = [sorted((u for c, u in urls if c == k and zlib.crc32(u) % 5 == 0)) for k in (0, 1)]
    assert all(len(h) <= url_filter.CALIBRATION for h in held)
    n = {}
    for c, u in urls:
        t = b"\2\2\2\2" + u + b"\3"
        for at in range(4, len(t) if zlib.crc32(u) % 5 else 0):
            for k in range(5):
                for key in ((t[at - k : at], t[at]), (t[at - k : at], None)):
                    n.setdefault(key, [0, 0])[c] += 1
    assert sum(len(k[0]) == 4 and k[1] is not None for k in n) > 1 << 15

    def difference(u):
        t, total = b"\2\2\2\2" + u + b"\3", 0.0
        for at in range(4, len(t)):
            p = [1 / 256, 1 / 256]
            for k in range(5):
                pair, context = n.get((t[at - k : at], t[at]), (0, 0)), n.get((t[at - k : at], None), (0, 0))
                p = [(pair[c] + 2 * p[c]) / (context[c] + 2) for c in (0, 1)]
            total += np.log(p[1]) - np.log(p[0])
        return total / (len(t) - 4)

    got = {x["page_id"]: x["reject_probability"] for x in url_filter.apply(df, model).collect()}
    want = [1 / (1 + np.exp(-np.clip(model.slope * difference(u) + model.shift, -30, 30))) for _, u in urls]
    assert len(got) == 3000 and np.allclose([got[k] for k in range(3000)], want)


def test_url_rows_beyond_the_calibration_are_counted(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "CALIBRATION", 5)
    rows = [(k, f"http://{'casino' if k % 2 else 'site'}{k}.net/") for k in range(400)] + [(k, "http://same.net/") for k in range(400, 500)]
    model = url_filter.fit(spark.createDataFrame(rows, "page_id long, url string"))
    assert model.low[:, :, 3].sum() == 500 - 10  # one end mark a counted row


def test_pseudonyms(spark):
    t = "Mail Bob.7@x.example.com or +1 (317) 555-3649, (212) 555-0100; card 4539 1488 0343 6467 not 4539148803436468; 10.1.22.250 999.1.1.1; 123-45-6789; 2024-02-29 31.12.1999 12/31/1999 2024-02-30; GB82 WEST 1234 5698 7654 32."
    new, counts = pii.pseudonymise(t)
    assert counts == {"email": 1, "phone": 2, "card": 1, "ssn": 1, "iban": 1, "ip": 1, "date": 3}
    assert [c if not c.isalnum() else "" for c in new if not c.isdigit()] and pii.pseudonymise(new, back=True)[0] == t
    for same in ("4539148803436468", "999.1.1.1", "2024-02-30"):
        assert same in new
    assert pii.pseudonymise("x " + t)[0] == "x " + new and pii.pseudonymise(t, b"other")[0] != new
    assert sorted(pii.permute(k, 77, b"k", b"t") for k in range(77)) == list(range(77))
    assert pii.pseudonymise(str(date(2020, 5, 17)))[0] != "2020-05-17"
    got = pii.apply(spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "a@b.org", "x")], DOCS)).collect()
    assert [r["n_email"] for r in got] == [0, 0, 1] and got[0]["text"] is None and got[2]["score"] == "x"


def test_pii_beside_neighbours():
    """Every planted value is found among random neighbours, alone and in a text, and gets the same pseudonym everywhere."""
    r = random.Random(21)

    def card():
        d = "".join(r.choices("0123456789", k=15))
        d = next(d + c for c in "0123456789" if pii.luhn(d + c))
        return r.choice([d, " ".join(d[k : k + 4] for k in range(0, 16, 4)), "-".join(d[k : k + 4] for k in range(0, 16, 4))])

    def iban():
        body = "".join(r.choices("0123456789", k=20))
        s = f"ES{98 - pii._mod97('ES00' + body):02d}{body}"
        return r.choice([s, " ".join(s[k : k + 4] for k in range(0, 24, 4))])

    def day():
        d = date.fromordinal(r.randrange(date(1950, 1, 1).toordinal(), date(2030, 1, 1).toordinal()))
        return r.choice([d.isoformat(), f"{d.day:02d}.{d.month:02d}.{d.year}", f"{d.month:02d}/{max(d.day, 13):02d}/{d.year}"])

    makers = {"card": card, "iban": iban, "date": day, "ssn": lambda: "123-45-6789", "ip": lambda: f"10.{r.randrange(256)}.2.{r.randrange(256)}"}
    beside = ["7", "12", "2024", "ID 7", "x", "AB", "no. 3", "ABCD", "(", "), 5", "EUR 12.50"]
    for _ in range(1500):
        kind = r.choice(list(makers))
        value = makers[kind]()
        alone = pii.pseudonymise(value)[0]
        # four digits before a number in groups of four could as well be its first group
        left = [x for x in beside if not (x == "2024" and kind == "card" and " " in value)]
        text = f"{r.choice(left)} {value} {r.choice(beside)}"
        new, counts = pii.pseudonymise(text)
        assert counts[kind] == 1 and alone in new and value not in new, (text, new)
        assert pii.pseudonymise(new, back=True)[0] == text
    assert {pii.pseudonymise(x)[0] for x in ("card 4539 1488 0343 6467 12 people", "ID 7 4539148803436467", "ES9121000418450200051332 ABCD")}.isdisjoint(
        {"card 4539 1488 0343 6467 12 people", "ID 7 4539148803436467", "ES9121000418450200051332 ABCD"}
    )
    y, d, m = (pii.pseudonymise(x)[0] for x in ("2024-02-29", "29.02.2024", "02/29/2024"))
    assert y.split("-") == d.split(".")[::-1] == [m.split("/")[k] for k in (2, 0, 1)]


CLASH = ["__in0", "__n", "__known", "__lost", "__cleaned", "__id", "__rid", "__said", "__times", "__row", "__whole", "node", "component", "text2", "u", "rid"]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns named like inner ones."""
    r = random.Random(14)
    text = lambda k: " ".join("".join(r.choices("etaoinsrhl", k=r.randint(2, 8))) for _ in range(k))
    line = "This very line is longer than forty characters, and it is shared."
    rows = [(None, None), (None, ""), (1, None), (2, ""), (3, " \n\t"), (4, text(70)), (4, text(70)), (5, "½ ² 3"), (6, text(40_000))]
    rows += [(6, rows[8][1])] + [(k, f"{text(60)}\n{line}\n{line.upper()}") for k in range(10, 17)]
    full = [(*row, "de" if k % 2 else "en", None, k, *("c" * len(CLASH))) for k, row in enumerate(rows)]
    names = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(full, names)


def edge_operators(spark):
    import corpus_pipeline as p

    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (1, 1, 0), (2, 0, 0), (None, 1, None), (10, None, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (1, ""), (None, "..."), (2, "a benchmark item that stands in no text at all"), (2, "a benchmark item that stands in no text at all")], "item_id long, text string")
    pages = lambda df: df.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "url")
    return {
        "quality_rules": lambda df: quality_rules.apply(df, quality_rules.fit(df, labels)),
        "decontaminate": lambda df: decontaminate.clean(df, bench),
        "packing": lambda df: packing.pack(df).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"),
        "url_filter": lambda df: url_filter.apply(pages(df), url_filter.fit(pages(df))),
        "ngram_join": lambda df: ngram_join.classes(df),
        "one_of_each": lambda df: ngram_join.one_of_each(df),
        "quality_cnn": lambda df: quality_cnn.apply(df, quality_cnn.fit(df, labels)),
        "pii": lambda df: pii.apply(df),
        "langid": lambda df: langid.apply(df, langid.fit(df)),
        "line_dedup": lambda df: line_dedup.apply(df),
        "stage lines": lambda df: p.lines(spark, df, ""),
        "stage packing": lambda df: p.pack(spark, df, "").select("doc_id", "start", "length", "ids_crc32", "doc_tokens"),
    }


@pytest.mark.parametrize("name", ["quality_rules", "decontaminate", "packing", "url_filter", "ngram_join", "one_of_each", "quality_cnn", "pii", "langid", "line_dedup", "stage lines", "stage packing"])
def test_edges(spark, edges, name):
    operator = edge_operators(spark)[name]
    plain = edges.drop(*CLASH)
    some = lambda df, columns: sorted(map(repr, df.select(*(f"`{c}`" for c in columns)).collect()))
    out, bare = operator(edges), operator(plain)
    assert some(out, bare.columns) == some(bare, bare.columns)
    if name not in ("packing", "ngram_join", "stage packing"):
        assert set(CLASH) <= set(out.columns)
        assert name == "one_of_each" or out.count() == edges.count()
    none = operator(edges.limit(0))
    assert none.columns == out.columns and none.count() == 0
    rows = out.collect()
    if name == "langid":
        assert [r["lang_pred"] for r in rows if r["text"] in (None, "", " \n\t", "½ ² 3")] == ["und"] * 6
    if name == "line_dedup":
        assert sorted(r["n_dropped"] for r in rows) == [0] * 11 + [2] * 6
    if name == "one_of_each":
        assert sorted((r["doc_id"] or 0) for r in rows) == [0, 0, 1, 2, 3, 4, 5, 6, *range(10, 17)]
    if name == "quality_rules":
        assert all(r["base_failed"] for r in rows if not r["text"])


def test_decontamination_of_repeated_rows_and_items(spark):
    item = "a benchmark item that is long enough to have edits"
    bench = spark.createDataFrame([(1, item), (1, item), (2, item)], "item_id long, text string")
    long = " ".join(f"w{k}" for k in range(50_000))
    df = spark.createDataFrame([(1, f"x {item} y"), (1, f"x {item} y"), (2, f"{long} {item} {long}"), (3, long), (4, ""), (None, item)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.find(df, bench).collect())
    assert got == [(i, k) for i in (0, 1, 1, 2) for k in (1, 1, 2)] or sorted(set(got)) == [(i, k) for i in (0, 1, 2) for k in (1, 2)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(df, bench).collect()) == [3, 4]


def test_buckets_are_written_and_read(spark, docs, tmp_path):
    df = spark.createDataFrame(docs, DOCS)
    packed = packing.pack(df, with_ids=True)
    packing.write_buckets(packed, f"file://{tmp_path}/buckets")
    want = sorted((r["doc_id"] or -1, r["start"], tuple(r["ids"])) for r in packed.collect())
    got = []
    for k in range(12):
        rows = packing.read_bucket(spark, f"file://{tmp_path}/buckets", 1 << k).collect()
        assert all(len(r["ids"]) == 1 << k for r in rows)
        got += [(r["doc_id"] or -1, r["start"], tuple(r["ids"])) for r in rows]
    assert sorted(got) == want
    runs = [r["bucket"] for r in packing.pack(df.coalesce(1)).collect()]
    assert sum(a != b for a, b in zip(runs, runs[1:])) < 12


def test_url_evidence_after_the_path(spark):
    rows = [(k, f"https://{'casino' if k % 2 else 'site'}{k}.net/p?{'click=xxyyzz' if k % 2 else 'page=1'}#{k}") for k in range(400)]
    rows += [(1000, "https://plain.net/p?click=xxyyzz"), (1001, "https://plain.net/p?page=1")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.apply(df, url_filter.fit(df)).collect()}
    assert got[1000]["reject_probability"] > got[1001]["reject_probability"] and got[1000]["path"] == "/p"


def test_quality_rules_are_calibrated(spark):
    """On rows not learned from, the mean probability of a class-balanced mixture follows its share of good texts."""
    r = random.Random(31)
    word = lambda good: "".join(r.choices("etaoins" if good else "etaoinsqz", k=r.randint(2, 6)))
    texts = [(k, " ".join(word(r.random() < (0.65 if k % 2 else 0.35)) for _ in range(60))) for k in range(3000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1000)], "doc_id long, quality int, toxic int")
    got = [(x["probability"], x["doc_id"] % 2) for x in quality_rules.apply(df, quality_rules.fit(df, labels)).collect() if x["doc_id"] >= 1000]
    for low, high in ((0.0, 0.3), (0.3, 0.7), (0.7, 1.01)):
        own = [(p, y) for p, y in got if low <= p < high]
        assert len(own) > 30 and abs(np.mean([p for p, _ in own]) - np.mean([y for _, y in own])) < 0.12


def test_rows_of_one_hot_key(spark):
    from foliograph.llm.common import join_by_key, stored

    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, 7, id) AS k", "id")
    one = stored(rows.groupBy("k").count().selectExpr("k", "count AS n", "k * 2 AS v"), "one")
    got = join_by_key(rows, one, ["k"], "n")
    assert got.count() == 30_000 and got.where("v <> 2 * k").count() == 0
    star = spark.range(1, 20_001).selectExpr("id AS a", "0 AS b").union(spark.range(1, 20_001).selectExpr("id AS a", "id - id % 100 AS b"))
    got = links.components(star.repartition(9))
    assert got.where("component = 0").count() == 20_001


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{folder}/documents.parquet")
    df = df.withColumn("__in0", df.doc_id).withColumn("__n", df.text)
    for name, stage in p.STAGES[:-1]:
        out, none = stage(spark, df, folder), stage(spark, df.limit(0), folder)
        assert out.columns == df.columns and out.count() <= df.count()
        assert none.columns == df.columns and none.count() == 0
    assert p.run(spark, folder).count() > 0
