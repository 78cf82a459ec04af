"""Line dedup, SimHash and the license scan against brute force."""

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from kbspark.llm import licenses, line_templates, simhash
from kbspark.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest(ids, fps):
    """Components by comparing all pairs."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return [min(groups[find(i)]) for i in range(len(ids))]


def test_fingerprint_is_its_definition():
    for text in [None, "", " \n", "One", "a b c", "A B c d", "a b c d e É", "x " * 300, "tab\tline\x0bfeed  nbsp y z"]:
        assert simhash.fingerprint((text or "").encode()) == fingerprint(text)


def test_anchors_meet_for_every_pair_within_two_bits():
    r = random.Random(3)
    for _ in range(300):
        x = r.getrandbits(32)
        y = x
        for b in r.sample(range(32), r.randint(0, 2)):
            y ^= 1 << b
        a = simhash.anchors(np.array([x, y], dtype=np.uint32))
        assert set(a[0]) & set(a[1])
        assert len(set(a[0].tolist())) <= 17


def test_near_links_join_what_all_pairs_join(spark):
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(40)]
    fps = set(seeds) | {0, 1, 3, (1 << 64) - 1}
    for s in seeds[:15]:
        x = s
        for _ in range(40):  # chains and clusters
            y = x
            for b in r.sample(range(64), r.randint(1, 5)):
                y ^= 1 << b
            fps.add(y)
            x = r.choice([x, y, s])
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    roots = {row.node: row.root for row in simhash.components(simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    want = smallest(signed, fps)
    assert [roots.get(s, s) for s in signed] == want


def test_near_duplicates_on_edge_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(5, text), (3, text), (3, text), (9, None), (8, ""), (7, " "), (None, "alone here today now"), (2, "alone here today now"), (1, "other")]
    docs = spark.createDataFrame([(a, b, "f") for a, b in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs, "doc_id", "text").collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (3, 3), (9, 7), (8, 7), (7, 7), (None, 2), (2, 2), (1, 1)}
    kept = simhash.keep_one(docs, "doc_id", "text").collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3, 7] and kept[0].fp == "f"
    assert simhash.near_duplicates(docs.limit(0), "doc_id", "text").count() == 0


def test_simhash_query(spark):
    rows = duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    got = QUERIES["op7_simhash"](spark, SF).toPandas().sort_values("doc_id")
    fps = [fingerprint(t) for _, t in rows]
    assert got.fingerprint.tolist() == [f"{f:016x}" for f in fps]
    assert got.component_id.tolist() == smallest([i for i, _ in rows], fps)


def lines_left(texts, min_docs):
    """Brute force: templates as tuples of tokens, documents compared by the rest of their lines."""

    def tokens(line):
        return ["<*>" if re.search("[0-9]", t) else t for t in line.split()]

    def templates(parts):
        out = [(0, *parts)]
        rest = len(parts) - line_templates.LEADING
        if rest >= line_templates.FIELDS:
            for j in range(line_templates.FIELDS):
                a, b = (line_templates.LEADING + rest * (j + k) // line_templates.FIELDS for k in (0, 1))
                out.append((j + 1, *parts[:a], *["<*>"] * (b - a), *parts[b:]))
        return out

    places = defaultdict(list)
    for text in texts:
        own = {tuple(p) for p in map(tokens, (text or "").split("\n")) if len(p) >= line_templates.MIN_TOKENS}
        ranked = sorted(own, key=lambda p: line_templates._hash([b"0", *[t.encode() for t in p]]))
        for p in own:
            around = [q for q in ranked[:2] if q != p]
            for t in templates(list(p)):
                places[t].append(around[0] if around else None)
    found = {t for t, p in places.items() if len(set(p)) >= min_docs and 2 * len(set(p)) >= len(p)}
    out = []
    for text in texts:
        if text is None:
            out.append(None)
            continue
        keep = [x for x in text.split("\n") if len(tokens(x)) < line_templates.MIN_TOKENS or not found.intersection(templates(tokens(x)))]
        out.append("\n".join(keep))
    return out


def corpus():
    r = random.Random(2)
    own = lambda n=9: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    texts = [None, "", "\n\n", "tiny line"]
    for i in range(30):
        texts.append("\n".join([own(), "All rights reserved by us", own(), f"Posted on 2024-01-{i} by someone else here", own(), "short it"]))
    copy = "\n".join(own() for _ in range(6))
    texts += [copy] * 20  # copies of one document keep their lines
    texts += [f"{own()}\nuser logged in from host {own(1)} with a key\n{own()}" for _ in range(12)]  # a variable field without digits
    texts += ["rare words stand here\n" + own() for _ in range(5)]
    return texts


def test_line_dedup_is_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_lines int").repartition(5)
    want = lines_left(texts, 8)
    got = {r.doc_id: r for r in line_templates.dedup_lines(docs).collect()}
    assert [got[i].text for i in range(len(texts))] == want
    assert "reserved" not in want[10] and "Posted" not in want[10] and "short it" in want[10]
    assert want[40] == texts[40] and "logged" not in "".join(x or "" for x in want) and "rare words stand here" in want[-1]
    assert got[0]._n_lines == 0 and got[0].n_lines == 1 and got[1]._n_lines == 1
    assert line_templates.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_with_too_many_templates_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_templates, "sorted_values", lambda *a, **k: None)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts + texts[:6])], "doc_id long, text string, n_lines int")
    got = {r.doc_id: r.text for r in line_templates.dedup_lines(docs).collect()}
    assert [got[i] for i in range(len(texts) + 6)] == lines_left(texts + texts[:6], 8)


def left_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in line_templates.dedup_lines(docs).collect()}
    return [got[i] for i in range(len(texts))]


def own_line(r, n=9):
    return " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))


@pytest.mark.parametrize(("shared", "own"), [(2, 3), (5, 5), (10, 10), (10, 5)])
def test_line_dedup_of_lines_that_occur_together(spark, shared, own):
    r = random.Random(11)
    block = [own_line(r) for _ in range(shared)]
    mine = [[own_line(r) for _ in range(own)] for _ in range(40)]
    copy = "\n".join(own_line(r, 40) for _ in range(6))
    near = [f"{copy} {own_line(r, 1)}" for _ in range(20)]  # near copies keep their lines, like copies
    assert left_of(spark, ["\n".join(block + m) for m in mine] + near + [copy]) == ["\n".join(m) for m in mine] + near + [copy]


def test_line_dedup_with_a_hot_copied_document(spark):
    r = random.Random(12)
    line = own_line(r)
    hot, mine = [own_line(r) for _ in range(4)], [own_line(r) for _ in range(12)]
    got = left_of(spark, ["\n".join([line, *hot])] * 60 + [f"{m}\n{line}" for m in mine])
    assert got == ["\n".join(hot)] * 60 + mine


def test_line_dedup_of_long_passages_and_of_one_line_documents(spark):
    r = random.Random(13)
    passage, short = own_line(r, 60), own_line(r)
    mine = [own_line(r) for _ in range(8)]
    logs = [f"connection was closed from {own_line(r, 1)} by the other host" for _ in range(12)]
    texts = [f"{m}\n{passage}" for m in mine[:4]] + [f"{m}\n{short}" for m in mine[4:]] + logs
    assert left_of(spark, texts) == mine[:4] + texts[4:8] + [""] * 12
    copies = [f"{own_line(r, 60)}\n{mine[0]}"] * 9
    assert left_of(spark, copies) == copies


def test_line_dedup_of_short_lines_with_names(spark):
    r = random.Random(16)
    names = ["Alice", "Bob", "Carol", "Dan", "Eve", "Frank", "Grace", "Heidi", "Ivan", "Judy"]
    mine = [own_line(r) for _ in names]
    for line in ("Posted by {} in Sports", "Posted by {}", "{} has replied to you", "Ask {} again", "From 12 Mar by {}"):
        assert left_of(spark, [f"{m}\n{line.format(n)}" for m, n in zip(mine, names)]) == mine, line
    kept = [f"{m}\n{a} {n} {b}\n{a} {b}\n- {n} {b}" for m, n, a, b in zip(mine, names, names[1:] + names[:1], names[2:] + names[:2])]
    assert left_of(spark, kept) == kept  # two names of three tokens differ
    few = [f"{m}\nPosted by {n} in Sports" for m, n in zip(mine[:7], names)]
    assert left_of(spark, few) == few


def test_line_dedup_keeps_rows_of_numbers(spark):
    r = random.Random(14)
    row = lambda: f"{r.randint(1, 99)} {r.random():.3f} {r.randint(1900, 2030)} {r.randint(0, 9)} {r.random():.3f} 7 {r.randint(0, 999)}"
    texts = [f"{own_line(r)}\n{row()}\n| {row()} |\nBern {row()}\n{own_line(r)}" for _ in range(20)]
    assert left_of(spark, texts) == texts
    codes = [f"{own_line(r)}\nA1 B2 C3 D4 E5 F6 G{i}" for i in range(20)]
    assert left_of(spark, codes) == codes
    same = [f"{own_line(r)}\n12 7.5 2019 3" for _ in range(10)]
    assert left_of(spark, same) == [x.split("\n")[0] for x in same]


def test_line_dedup_query(spark):
    assert QUERIES["op9_line_dedup"](spark, SF).count() == 200


def test_license_scan_is_its_sql(spark):
    ok, message = compare(QUERIES["op4_license_scan"](spark, SF), duck(SF), ORACLES["op4_license_scan"])
    assert ok, message


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_license_inside_other_text(spark, name):
    words = licenses.TEMPLATES[name].split()
    lead = [f"w{i}" for i in range(37)]
    rows = [(1, " ".join(lead + words + lead), "x"), (2, " ".join(lead), "x"), (3, None, "x"), (4, "", "x"), (5, " ".join(words).upper(), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = {(r.doc_id, r._license): r.containment for r in licenses.scan(docs, "doc_id", "text").collect()}
    assert got[(1, name)] == 1.0 and got[(5, name)] == 1.0
    assert {d for d, _ in got} == {1, 5}


def test_license_scan_misses_no_short_notice(spark):
    """Every window of many documents, against the SQL."""
    r = random.Random(15)
    short = [licenses.TEMPLATES[k] for k in ("mit-short", "cc-by-nc-4-short", "apache-2.0-short")]
    texts = [f"{own_line(r, r.choice([0, 0, 11]))} {short[i % 3]} {own_line(r, 40)}" for i in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = licenses.scan(docs, "doc_id", "text")
    ok, message = compare(got, con, licenses.oracle())
    assert ok, message
    assert got.select("doc_id").distinct().count() == len(texts)


def test_license_keys_where_bands_would_miss():
    for n in range(1, 129):
        size = next(c for c in licenses.CLASSES if n <= c)
        for containment in (0.5, 0.8, 1.0):
            need = next(k for k in range(1, n + 1) if k >= containment * n - 1e-9)
            got = licenses.keys(list(range(n)), size, containment)
            assert len(got) > n - need if got else need / (2 * size + n - need) >= 0.19


def test_license_scan_of_an_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
