"""Splitters, Markdown and time rules."""

from hypothesis import given, settings, strategies as st

from kbspark.functions import splitters as sp
from kbspark.functions.urls import _normalised
from kbspark.operators import chunking, markdown as md

SEPARATORS = ["\n\n", "\n", ". ", ", ", " "]
text = st.text(alphabet="ab é😀.,\n ", max_size=300)


def folded(value, size, overlap, separators):
    """The separator splitter, part by part."""
    if len(value) <= size:
        return [value] if value.strip() else []
    separator = next((s for s in separators if s in value), None)
    if separator is None:
        starts = [0]
        while starts[-1] + size < len(value):
            starts.append(starts[-1] + size - overlap)
        return [value[i:i + size] for i in starts if value[i:i + size].strip()]
    out, current, rest = [], "", value
    while rest:
        cut = rest.find(separator)
        part, rest = (rest, "") if cut < 0 else (rest[:cut + len(separator)], rest[cut + len(separator):])
        if len(current + part) > size:
            out.append(current)
            current = ""
            if len(part) > size:
                out += folded(part, size, overlap, separators[1:])
                continue
        current += part
    return [p for p in [*out, current] if p.strip()]


@settings(max_examples=300, deadline=None)
@given(text, st.integers(5, 40), st.integers(0, 4))
def test_separator_pieces(value, size, overlap):
    pieces = sp.span_pieces(value, size, overlap, SEPARATORS)
    assert [p for _, p, _, _ in pieces] == [p.strip() for p in folded(value, size, overlap, SEPARATORS)]
    assert [n for n, *_ in pieces] == list(range(len(pieces)))
    covered = set()
    for _, piece, start, end in pieces:
        assert len(piece) <= size and value[start:end] == piece
        covered |= set(range(start, end))
    assert all(i in covered for i, c in enumerate(value) if not c.isspace())


def merged(value, size, overlap, separators):
    """The recursive splitter, part by part."""
    level = next(i for i, s in enumerate(separators) if s in value)
    separator, parts = separators[level], list(value)
    if separator:
        first, *others = value.split(separator)
        parts = [p for p in [first, *[separator + x for x in others]] if p]
    out, held = [], []
    for part in [*parts, None]:
        if part is not None and len(part) < size:
            if sum(map(len, held)) + len(part) > size:
                out.append("".join(held))
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                    held.pop(0)
            held.append(part)
            continue
        if held:
            out.append("".join(held))
            held = []
        if part is not None:
            out += merged(part, size, overlap, separators[level + 1:]) if separators[level + 1:] and separator else [part]
    return out


@settings(max_examples=300, deadline=None)
@given(text, st.integers(5, 40), st.integers(0, 4))
def test_recursive_pieces(value, size, overlap):
    separators = ["\n\n", "\n", " ", ""]
    pieces = sp.recursive_pieces(value, size, overlap, separators)
    assert [p for _, p, _, _ in pieces] == [p.strip() for p in merged(value, size, overlap, separators) if p.strip()]
    covered = set()
    for _, piece, start, end in pieces:
        assert len(piece) <= size and value[start:end] == piece
        covered |= set(range(start, end))
    assert all(i in covered for i, c in enumerate(value) if not c.isspace())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab. !", max_size=30).map(str.strip).filter(bool), max_size=12), st.integers(4, 40))
def test_packed_paragraphs(texts, limit):
    rows = [(i, i, t) for i, t in enumerate(texts)]
    out = sp.pack_paragraphs(rows, limit)
    assert all(len(t) <= limit for _, _, t in out) and [a for a, _, _ in out] == sorted(a for a, _, _ in out)
    assert "".join("".join(t for _, _, t in out).split()) == "".join("".join(texts).split())
    for (_, last, one), (first, _, two) in zip(out, out[1:]):  # neighbours that would have fitted are together
        if last != first and len(texts[last]) <= limit and texts[first] == two.split("\n\n")[0]:
            assert len(one) + 2 + len(texts[first]) > limit


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=40))
def test_greedy_batches(sizes):
    numbers = sp.greedy_batches(sizes, 60, 4)
    for b in set(numbers):
        members = [s for s, n in zip(sizes, numbers) if n == b]
        assert len(members) <= 4 and (sum(members) <= 60 or len(members) == 1)
    assert numbers == sorted(numbers)


def test_windows_end():
    assert [p for _, p, _, _ in sp.span_pieces("x" * 25, 10, 3, SEPARATORS)] == ["x" * 10, "x" * 10, "x" * 10, "x" * 4]
    assert sp.span_pieces("   ", 10, 0, SEPARATORS) == []


def test_urls():
    base = "http://Site.org/a/b?x=1#f"
    cases = {
        "": "http://site.org/a/b?x=1", "#top": "http://site.org/a/b?x=1", "/": "http://site.org/", "c/": "http://site.org/a/c", "../d": "http://site.org/d",
        "HTTPS://Z.org:443/p/": "https://z.org/p", "http://z.org:80": "http://z.org", "mailto:a@b.c": None, "//h.org/q?a=b": "http://h.org/q?a=b", "http://[bad": None,
    }
    assert {h: _normalised(base, h) for h in cases} == cases


DOC = "\n".join(
    [
        "before", "{0}" + "-" * 48, "", "# One", "text a", "```", "# no", "```", "### Deep", "", "para 1", "![i](x)", "para 1b", "", "para 2",
        "{2}" + "-" * 48, "", "## *References* 2021-03", "r", "# Two Sept 2024", "end",
    ]
)


def _facts(spark):
    return md.line_facts(spark.createDataFrame([(1, DOC)], "doc_id long, text string"))


def test_sections(spark):
    rows = {r.section_id: r for r in md.sections(_facts(spark), md.NOISE_HEADINGS).collect()}
    assert rows["sec-0002"].heading_path == "One > Deep" and rows["sec-0002"].parent_id == "sec-0001"
    assert rows["sec-0003"].parent_id == "sec-0001" and rows["sec-0003"].page_start == 3
    assert rows["sec-0004"].parent_id == "sec-root"
    assert (rows["sec-0001"].line_start, rows["sec-0001"].line_end) == (5, 19)
    for r in rows.values():
        body = "\n".join(DOC.split("\n")[r.line_start - 1:r.line_end]) + "\n"
        assert (DOC + "\n")[r.char_start:r.char_end] == body
    assert rows["sec-root"].page_end == 3


def test_pages_and_paragraphs(spark):
    pages = {r.page: r.markdown for r in md.page_texts(_facts(spark)).collect()}
    assert pages[2] == "" and pages[3].startswith("## *References*") and pages[1].startswith("before")
    paras = [(r.section_no, r.line_start, r.line_end, r.text) for r in md.paragraphs(_facts(spark)).orderBy("line_start").collect()]
    assert (2, 11, 13, "para 1\npara 1b") in paras and (2, 15, 15, "para 2") in paras
    chunks = md.pack_sections(md.paragraphs(_facts(spark)), 10).orderBy("chunk_no").collect()
    assert [c.chunk_no for c in chunks] == list(range(1, len(chunks) + 1))


def test_time(spark):
    docs = spark.createDataFrame([(1, "for the fiscal year ended March 31, 2023 and 1999"), (2, "nothing"), (3, "x")], "doc_id long, text string")
    paths = spark.createDataFrame([(3, "A > Sept 2024"), (3, "B / 2024-07"), (3, "C")], "doc_id long, heading_path string")
    rows = {r.doc_id: r for r in md.time_estimates(docs, paths, "2026-05-06").collect()}
    assert (rows[1].unit, rows[1].anchor, rows[1].anchor_reason) == ("year", "2023", "cover")
    assert (rows[2].anchor, rows[2].anchor_confidence, rows[2].unit_confidence) == ("2026", 0.1, 0.1)
    assert (rows[3].unit, rows[3].anchor, rows[3].anchor_confidence) == ("month", "2024-09", 0.7)
    assert rows[3].unit_confidence == 0.83


def test_hierarchy(spark):
    body = "SOURCE FILE: a.txt\n\n  " + ". ".join(f"Satz {i} é😀 " + "wort " * 20 for i in range(60))
    rows = chunking.split_hierarchical(spark.createDataFrame([("d", body)], "doc_id string, text string")).collect()
    clean = body.split("\n", 2)[2].strip()
    parents = {r.chunk_id: r for r in rows if r.chunk_level == "L0"}
    assert len(parents) > 2
    for r in rows:
        assert clean[r.char_start:r.char_end] == r.text
        if r.chunk_level == "L1":
            p = parents[r.parent_chunk_id]
            assert p.char_start <= r.char_start and r.char_end <= p.char_end
