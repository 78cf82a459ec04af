"""Sharding, packing, pieces, page text and nearest neighbours against brute force and exact round trips."""

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kbspark.llm import common, html_blocks, nearest, packing, pieces, sharding
from kbspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


# --- numbering

def test_numbering_has_no_gaps(spark):
    rows = [("a" if i % 3 else None, i, i % 7) for i in range(500)] + [("b", 1, 1)] * 3
    df = spark.createDataFrame(rows, "k string, i int, _salt int").repartition(6)
    got = defaultdict(list)
    for r in common.numbered(df, ["k"], ["i"], "n", 5).collect():
        got[r.k].append(r.n)
    assert {k: sorted(v) == list(range(len(v))) for k, v in got.items()} == {None: True, "a": True, "b": True}


# --- sharding

def best_fit(sizes, capacity):
    bins = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [b for b in range(len(bins)) if bins[b] >= sizes[i]]
        if fits:
            b = min(fits, key=lambda b: (bins[b], b))
        else:
            bins.append(max(capacity, sizes[i]))
            b = len(bins) - 1
        bins[b] -= sizes[i]
        yield i, b


def test_best_fit_decreasing_is_brute_force():
    r = random.Random(4)
    for n in (0, 1, 5, 60, 300):
        sizes = [r.choice([1, 7, 7, 30, r.randint(1, 100)]) for _ in range(n)]
        for capacity in (30, 100, 250):
            want = dict(best_fit(sizes, capacity))
            assert sharding.best_fit_decreasing(sizes, capacity) == [want[i] for i in range(n)]
    assert max(sharding.balanced([10] * 80, 40)) == 39
    assert sharding.balanced([], 40) == []


def shards_hold(rows, texts, shards):
    """The contract of a shard assignment."""
    at, slots, size = {}, defaultdict(list), defaultdict(int)
    for row in rows:
        text = texts[row.doc_id]
        assert row.size == len((text or "").encode()) + 16 and row.text_crc32 == zlib.crc32((text or "").encode())
        assert at.setdefault(text, row.shard) == row.shard and 0 <= row.shard < shards
        slots[row.shard].append(row.slot)
        size[row.shard] += row.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return size


def test_sharding_query(spark):
    rows = QUERIES["op3_sharding"](spark, "/root/testdata/sf0.01").collect()
    texts = dict(duckdb.execute("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    size = shards_hold(rows, texts, 40)
    assert len(rows) == 1000 and len(size) == 40
    groups = defaultdict(int)
    for t in texts.values():
        groups[t] += len((t or "").encode()) + 16
    assert max(size.values()) <= max(max(groups.values()), 1.02 * sum(size.values()) / 40)


def test_sharding_on_edge_rows(spark):
    rows = [(i, None if i < 3 else "" if i < 6 else f"text {i % 50}", 5) for i in range(300)] + [(7, "text 7", 5)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)
    got = sharding.shard_documents(docs, "doc_id", "text", 7).collect()
    assert len(got) == 302
    shards_hold(got, {r[0]: r[1] for r in rows}, 7)
    assert sharding.shard_documents(docs.limit(0), "doc_id", "text", 7).count() == 0


# --- packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SPECIAL = ["<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> <|endoftext|><|endoftext|>", "<|endoftext|", "x <|endoftext|>\n\n y"]
ODD = [*SPECIAL, None, "", " ", "  ", "a  b", " a", "a ", "x\n y", "x \ny", "don't  't 's", "a\tb c", "nbsp a b", " 　 x", "\x1c \x1d x y", "é ü\r\n 12 3", "日本 語🙂 ok"]


def test_encoding_is_that_of_the_tokenizer():
    words = packing.encoder(packing.VOCABULARY)
    r = random.Random(8)
    noise = ["".join(r.choices(" \n\t 　\x85ab'!1é語", k=r.randint(1, 40))) for _ in range(2000)]
    for text in [*(t or "" for _, t in DOCS), *(t or "" for t in ODD), *noise]:
        ids = np.frombuffer(packing.encode(text, words), dtype="<u4").tolist()
        assert ids == TOKENIZER.encode(text, add_special_tokens=False).ids, repr(text)


def test_texts_are_encoded_whole(monkeypatch):
    """The vocabulary is asked once for a text, however many words it has; at an added token once for each part."""
    asked, real = [], tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(packing, "_loaded", {})
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda own, text: asked.append(text) or real(own, text))
    words = packing.encoder(packing.VOCABULARY)
    text = " ".join(f"word{i}x" for i in range(1000))
    for t, parts in [(text, 1), (f"{text}<|endoftext|>{text}", 2)]:
        asked.clear()
        ids = np.frombuffer(packing.encode(t, words), dtype="<u4").tolist()
        assert ids == TOKENIZER.encode(t, add_special_tokens=False).ids and len(asked) == parts


def packed_right(rows, texts):
    """The contract of a packing; returns the share of the sequences that is filled."""
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        documents[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(documents) == set(texts)
    for k, own in documents.items():
        ids = [*TOKENIZER.encode(texts[k] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(r.length for r in rows) / (2048 * len(sequences))


def test_packing_query(spark):
    assert packed_right(QUERIES["op8_packing"](spark, SF).collect(), dict(DOCS)) > 0.95


def test_packing_on_edge_rows(spark):
    texts = dict(enumerate([*ODD, *["same " * 900] * 40, "long " * 9000]))
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, class int").repartition(4)
    got = packing.pack_documents(docs, "doc_id", "text", with_ids=True).collect()
    packed_right(got, texts)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert packing.pack_documents(docs.limit(0), "doc_id", "text").count() == 0
    again = packing.pack_documents(docs.where("doc_id = 20").union(docs.where("doc_id = 20")), "doc_id", "text").collect()
    assert sum(r.length for r in again) == 2 * again[0].doc_tokens


@pytest.mark.parametrize("words", [["a"], ["a", "a b c", "a b c d e f g h i j", "w " * 100], ["a b c d e f g"]])
def test_short_texts_fill_their_sequences(spark, words):
    texts = {k: words[k % len(words)] for k in range(3000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = packing.pack_documents(docs, "doc_id", "text").collect()
    packed_right(got, texts)
    least = -(-sum(r.length for r in got) // 2048)
    assert len({r.sequence_id for r in got}) <= least * 1.05 + (len(words) > 1)


def test_null_keys_are_packed(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, "c"), (3, None)], "doc_id long, text string")
    got = packing.pack_documents(docs, "doc_id", "text").collect()
    assert len(got) == 4 and sorted(r.offset for r in got) == [0, *np.cumsum([r.length for r in sorted(got, key=lambda r: r.offset)])[:-1]]


def test_least_squares_and_plan():
    r = np.random.default_rng(3)
    columns = packing.combinations(12)
    for _ in range(20):
        target = np.append(0, r.integers(0, 50, 12)).astype(float)
        dense = np.zeros((13, len(columns)))
        for j, c in enumerate(columns):
            np.add.at(dense[:, j], c, 1)
        dense[0] = 0
        x = packing.non_negative_least_squares(columns, target)
        gradient = dense.T @ (target - dense @ x)
        assert x.min() >= 0 and gradient.max() < 1e-4 and np.abs(gradient[x > 1e-9]).max(initial=0) < 1e-4  # optimal
        found = packing.plan(target.astype(np.int64))
        used = np.zeros(13)
        for pattern, repeats in found:
            assert sum(c * m for c, m in pattern.items()) <= 12
            for c, m in pattern.items():
                used[c] += m * repeats
        assert (used == target).all()


# --- pieces

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def test_pieces_are_those_of_the_library():
    r = random.Random(9)
    noise = ["".join(r.choices(" \n▁aeinrst.,<>0é語🙂\x00", k=r.randint(1, 60))) for _ in range(1500)]
    code = [" " * n + "def f(x):\n" + " " * (2 * n) + "return x" for n in range(0, 90, 7)]
    texts = [*(t for _, t in DOCS), *noise, *code, "", " ", " " * 5000, "Hello  world", "</s> <s>", "x" * 3000]
    for text, ids in zip(texts, pieces.encoder(pieces.MODEL).encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == SP.encode(text), repr(text[:60])


def test_pieces_round_trip(spark):
    rows = [(i, t, 1) for i, t in enumerate(["", None, "a b", "  two  ", "é\n語", "▁"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = pieces.with_text(pieces.with_pieces(docs, "text"), "_ids").orderBy("doc_id").collect()
    assert [r.decoded for r in out] == ["", "", "a b", "  two  ", "é\n語", " "]
    assert out[1]._ids == b"" and out[0].ids == 1
    assert pieces.with_pieces(docs.limit(0), "text").count() == 0
    got = QUERIES["op5_sentencepiece"](spark, SF).collect()
    assert len(got) == len(DOCS) and all(r.round_trip for r in got)
    want = {k: SP.encode(t or "") for k, t in DOCS}
    assert all(r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id], dtype="<u4").tobytes()) and r.n_ids == len(want[r.doc_id]) for r in got)


# --- page text

ARTICLE = "It was the first of the days when they had all been there, and we would not have it any other way than this. " * 3
PAGES = [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("just the words of it and no tags at all, which is not that much of a text", ""),
    (f"<head><title>T</title><body><nav>Home</nav><p>{ARTICLE}<p>Short one.<p>{ARTICLE}</body>", f"{ARTICLE.strip()}\n\nShort one.\n\n{ARTICLE.strip()}"),
    (f"<body><div class='cookie-notice'>{ARTICLE}</div><h2>Head</h2><p>{ARTICLE}</p><div id=comments><p>{ARTICLE}</p></div>", f"Head\n\n{ARTICLE.strip()}"),
    (f"<article><header><h1>Title &amp; more</h1></header><p>A&nbsp;b&#x20AC; <a href=x>c</a> d<br>e</p><aside>{ARTICLE}</aside>"
     f"<form>{ARTICLE}</form><script>var a = '<p>{ARTICLE}</p>';</script><!-- <p>{ARTICLE}</p> --></article><footer>{ARTICLE}</footer>",
     "Title & more\n\nA b€ c d e"),
    (f"<body><ul><li><a href=1>{ARTICLE}</a></li></ul><div style='display: none'>{ARTICLE}</div><p hidden>{ARTICLE}</p></body>", ""),
    (f"<main><p>{ARTICLE}<div class=ad>Buy the best of it now</div><p>End.</main><p>{'x' * 300}</p>", f"{ARTICLE.strip()}\n\nEnd."),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_main_text(page, want):
    assert html_blocks.extract(page or "") == want


@pytest.mark.parametrize("name", ["page has-sidebar", "no-sidebar", "comments-open", "with-banner", "page' id='ad-free"])
@pytest.mark.parametrize("tag", ["article", "main", "div role=main", "div role=article"])
def test_main_text_inside_a_wrapper_named_like_boilerplate(name, tag):
    story, end = f"<{tag}><p>{ARTICLE}</p><div class=ad>{ARTICLE}</div></{tag.split()[0]}>", ARTICLE.strip()
    cards = f"<div class=related><article><p>{ARTICLE}</p></article></div>"
    comments = f"<div id=comments><article class=comment-body><p>{ARTICLE}</p></article></div>"
    assert html_blocks.extract(f"<body><div class='{name}'>{story}</div><nav>{ARTICLE}</nav>") == end
    assert html_blocks.extract(f"<body><div class='{name}'>{story}{cards}{comments}<p>{ARTICLE}</p></div>") == end
    assert html_blocks.extract(f"<body>{story}{cards}{comments}<aside class='{name}'>{story}</aside>") == end
    assert html_blocks.extract(f"<body><p>{ARTICLE}</p>{comments}") == end


def test_main_text_keeps_linked_titles_and_sentences():
    title, sentence = "<h2><a href='#x'>Title</a></h2>", "<p>See <a href=y>what they had to say of it when it was first shown to all of us in the old house</a>.</p>"
    plain = "See what they had to say of it when it was first shown to all of us in the old house."
    story = f"{title}<p>{ARTICLE}</p>{sentence}<p>{ARTICLE}</p>{title}{sentence}"
    want = "\n\n".join(["Title", ARTICLE.strip(), plain, ARTICLE.strip(), "Title", plain])
    assert html_blocks.extract(f"<article>{story}</article>") == want
    assert html_blocks.extract(f"<main>{story}</main><ul><li>{sentence}</ul>") == want
    assert html_blocks.extract(f"<p>{ARTICLE}</p>{sentence}") == ARTICLE.strip()  # outside an article links say menu


ITALIAN = (
    "La mattina di quel giorno il vecchio non era più nella casa sul fiume, e per questo la gente del paese si mise a cercare di lui con la luce che "
    "c'era, ma non trovò che le scarpe e il cappello di paglia, e una lettera che era di sua mano. "
)
CHINESE = "这是一个关于老人和他的船的故事，他在河边住了很多年，没有人知道他是从什么地方来的，也没有人问他。每天早上他都会把船推到水里，然后在那里等到太阳下山的时候才回家。他说他不是在等鱼，他是在等一个人，那个人很久以前说过会回来的。"
FOREIGN = {"it": [ITALIAN * 2, ITALIAN + "Poi il sole scese e la gente se ne andò, e di lui non si seppe più nulla per anni e anni. " * 2], "zh": [CHINESE, CHINESE[20:] + CHINESE[:20]]}


@pytest.mark.parametrize("wrapper", ["<div class='page has-sidebar'>", "<div class='post comments-open'>", "<div class='content with-header'>", "<form action=x>",
                                     "<div class='page has-sidebar'><form><div id='login-page' class='comments-open'>", "<div>"])
@pytest.mark.parametrize("language", ["en", "it", "zh"])
@pytest.mark.parametrize("title", ["", "<h1>Title</h1>"])
def test_pages_without_an_article_element(wrapper, language, title):
    texts = [p.strip() for p in FOREIGN.get(language, [ARTICLE, ARTICLE + "And so it was to be for them."])]
    story = title + "".join(f"<p>{t}</p>" for t in texts)
    want = "\n\n".join((["Title"] if title else []) + texts)
    menu = "<ul class=menu>" + "".join(f"<li><a href={i}>Menu entry {i}</a>" for i in range(9)) + "</ul>"
    side = f"<div class=sidebar><p>{texts[0]}</p></div>" if title else ""
    comments = "".join(f"<div class='{c}'><p>{texts[0]}</p></div>" for c in ("discussion", "usercomments", "comments")) if title else "<div class=usercomments><p>Nice.</p></div>"
    page = f"<body>{menu}{wrapper}{story}{side}</form>{'</div>' * 2}{comments}<footer>{texts[0]}</footer>" if "<form" in wrapper else f"<body>{menu}{wrapper}{story}{side}</div>{comments}<footer>{texts[0]}</footer>"
    assert html_blocks.extract(page if title else page.replace(side, "")) == want


def test_related_articles_beside_a_story_in_a_marked_wrapper():
    related = f"<div class=related><article><p>{ARTICLE}</p></article></div>"
    page = f"<body><div class='page has-sidebar'><h1>Title</h1><p>{ARTICLE}</p><p>{ARTICLE}</p>{related}</div>"
    assert html_blocks.extract(page) == "\n\n".join(["Title", ARTICLE.strip(), ARTICLE.strip()])


@pytest.mark.parametrize("part", ["<a ", "<div>", "<b>", "<p><b>", "<a '>' ", "<a \"", "</p>", "<head><div>", "<li><b><i>", "<div class=menu>", "<article>", "<form>", "<!", "<h1><a>x", "&amp", "<div>x",
                                  "<div><p><b>x</b>", "<script>", "<"])
def test_reading_takes_linear_time(part):
    import time

    page = f"<body><p>{ARTICLE}</p>" + part * (500_000 // len(part))
    start = time.process_time()
    html_blocks.extract(page)
    assert time.process_time() - start < 5


def test_tags_with_signs_in_quotes_and_left_open():
    for tag in ("<a title='>'>", "<a title=\"a > b\" href='<'>", "<a\nhref=x>", "<a x='\">\"'>", "<a<b>"):
        assert html_blocks.blocks(f"<p>one {tag}two</p>")[0].text == "one two"
    assert html_blocks.blocks("<p>a < b and <c</p>")[0].text.startswith("a < b and")
    assert html_blocks.blocks("<p>it's one <b>two</b> that's 'three'")[0].text == "it's one two that's 'three'"
    assert html_blocks.blocks("<p>x <a ' y")[0].text == "x <a ' y"


def test_page_query(spark):
    import html
    import re

    got = QUERIES["op6_html_extraction"](spark, SF).collect()
    pages = dict(duckdb.execute(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())
    assert len(got) == len(pages)
    for r in got:
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_pages_on_edge_rows(spark):
    docs = spark.createDataFrame([(i, p, 1) for i, (p, _) in enumerate(PAGES + PAGES)], "page_id long, html string, text int")
    got = {r.page_id: r._text for r in html_blocks.with_text(docs, "html").collect()}
    assert [got[i] for i in range(len(got))] == [w for _, w in PAGES + PAGES]
    assert html_blocks.with_text(docs.limit(0), "html").count() == 0


# --- nearest neighbours

def brute(ids, x, queries, k):
    x = np.asarray(x, dtype=np.float64)
    lengths = np.sqrt((x * x).sum(axis=1))
    for q in queries:
        scores = (x * x[q]).sum(axis=1) / (lengths * lengths[q])
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:k]
        yield int(ids[q]), [(int(ids[i]), float(scores[i])) for i in order]


def test_recall_of_the_query(spark):
    for sf in (SF, "/root/testdata/sf0.1"):
        rows = duckdb.execute(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet' ORDER BY vec_id").fetchall()
        ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        got = defaultdict(dict)
        for r in QUERIES["op10_nearest_neighbours"](spark, sf).collect():
            got[r.query_id][r.rank] = (r.vec_id, r.score)
        want = dict(brute(ids, x, [i for i in range(len(ids)) if ids[i] % 50 == 0], 5))
        assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
        hits = sum(len({i for i, _ in w} & {i for i, _ in got[q].values()}) for q, w in want.items())
        assert hits >= 0.9 * 5 * len(want)
        score = {(q, i): s for q, w in brute(ids, x, [i for i in range(len(ids)) if ids[i] % 50 == 0], len(ids)) for i, s in w}
        for q, own in got.items():
            assert all(abs(score[q, i] - s) < 1e-12 for i, s in own.values())
            assert [own[r] for r in sorted(own)] == sorted(own.values(), key=lambda p: (-p[1], p[0]))


def test_neighbours_on_edge_rows(spark):
    ok = [[1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [-1e30, 1e-30]]
    bad = [None, [], [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    rows = [(i, v, "x") for i, v in enumerate(ok + bad)] + [(None, [1.0, 0.0], "x"), (0, [1.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, list string")
    got = defaultdict(list)
    for r in nearest.search(df, "vec_id", "v", F.lit(True)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    assert set(got) == {0, 1, 2, 3, 4}
    assert got[0] == [(1, 1.0), (2, 1.0), (3, 0.0), (4, -1.0)]
    assert nearest.search(df.limit(0), "vec_id", "v", F.lit(True)).count() == 0


def test_many_equal_vectors(spark, monkeypatch):
    """A hot vector over several parts of a list: ties go to the smallest ids."""
    monkeypatch.setattr(nearest, "PART_ROWS", 100)
    r = np.random.default_rng(1)
    x = r.standard_normal((900, 8)).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, v array<float>")
    got = defaultdict(list)
    for row in nearest.search(df, "vec_id", "v", F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[row.query_id].append(row.vec_id)
    want = dict(brute(np.arange(900), x, range(0, 900, 50), 5))
    for q in range(0, 900, 150):
        assert got[q] == [i for i, _ in want[q]]
    assert sum(len(set(got[q]) & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * 5 * len(want)
