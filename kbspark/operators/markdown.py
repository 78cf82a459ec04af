"""Markdown documents to pages, sections and chunks.

What a line is by itself (blank, marker, fence, heading) is a column expression over the array of lines. What depends on the lines before and
after it (fence state, page, open headings, offsets, where a section ends) is found in one pass over the flat lines of a batch of documents, each
still in its row. Lines become rows afterwards, so nothing is shuffled or sorted for the tree; chunks shuffle the paragraphs once, by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..constants import MD_MAX_CHARS
from ..functions import splitters as sp, timemarks as tm
from ..functions.text import strip

# Patterns that decide results (fixed values).
LOAD_MARKER = r"^\{(\d+)\}-{48}\s*$"
MARKER = r"^\{(\d+)\}-{10,}\s*$"
HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
FENCE = r"^\s*(```|~~~)"
IMAGE_ONLY = r"^\s*!\[[^\]]*\]\([^)]+\)\s*$"
NOISE_HEADINGS = [
    "^(table of contents|contents|toc)$", "^index$", "^glossary$", "^(references|bibliography)$", "^executive summary$",
    "^about (this|the) (document|report)$", "^acknowledge?ments?$",
]
LEVELS = range(1, 7)
ROOT = "sec-root"


def _lines_window():
    return Window.partitionBy("doc_id").orderBy("line_no")


def _so_far(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) with line numbers from 1 and the number of lines and characters of the document."""
    split = F.split("text", "\n")
    return docs.select("doc_id", F.size(split).alias("n_lines"), F.length("text").alias("n_chars"), F.posexplode(split).alias("pos", "line")).select(
        "doc_id", "n_lines", "n_chars", (F.col("pos") + 1).alias("line_no"), "line"
    )


# --- pages for loading ---------------------------------------------------------------------------------------


def has_page_marker(text: Column) -> Column:
    return text.rlike("(?m)" + LOAD_MARKER)


def marker_pages(docs: DataFrame) -> DataFrame:
    """Pages between exact page markers; text before the first one is dropped, contents are stripped."""
    rows = lines(docs).withColumn("marker", F.nullif(F.regexp_extract("line", LOAD_MARKER, 1), F.lit("")).cast("long"))
    w = _so_far(_lines_window())
    rows = rows.withColumns(
        {"page_no": F.count("marker").over(w), "page": F.last("marker", ignorenulls=True).over(w)}
    ).where(F.col("page_no") > 0)
    body = F.when(F.col("marker").isNull(), F.struct("line_no", "line"))
    pages = rows.groupBy("doc_id", "page_no").agg(F.first("page").alias("page"), F.sort_array(F.collect_list(body)).alias("body"))
    pages = pages.select("doc_id", "page_no", "page", strip(F.array_join(F.transform("body", lambda b: b["line"]), "\n")).alias("text"))
    return pages.withColumn("total_pages", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))


# --- line facts ----------------------------------------------------------------------------------------------


_HEAD = "struct<line_no: int, no: bigint, heading: string>"
_FACTS = {
    "n_lines": "int", "n_chars": "int", "line_no": "int", "line": "string", "blank": "boolean", "marker": "bigint", "start": "bigint", "max_marker": "bigint",
    "page": "bigint", "level": "int", "heading": "string", "section_no": "bigint", "para": "bigint", "page_before": "bigint", "page_after": "bigint",
    "last_page": "bigint", "last_marker": "bigint", **{f"h{lv}": _HEAD for lv in LEVELS},
    "next": "struct<line_no: int, at: bigint, page: bigint, page_before: bigint>",
}
_BATCH_DOCS = 256


def line_facts(docs: DataFrame) -> DataFrame:
    """Every line with its offset, page, paragraph, heading level, the headings that are open at it and, for a heading, the one that ends its section.

    A null text has no lines. The rows stay where the document is: nothing is shuffled.
    """
    split = F.split("text", "\n")
    each = docs.where(F.col("text").isNotNull()).select("doc_id", F.length("text").alias("n_chars"), split.alias("lines"))
    each = each.select(
        "doc_id", "n_chars", "lines",
        F.transform("lines", lambda x: ~x.rlike(r"(?U)\S")).alias("blank"),
        F.transform("lines", lambda x: F.nullif(F.regexp_extract(x, MARKER, 1), F.lit("")).cast("long")).alias("marker"),
        F.transform("lines", lambda x: x.rlike(FENCE)).alias("fence"),
        F.transform("lines", lambda x: F.length(F.regexp_extract(x, HEADING, 1))).alias("level"),
        F.transform("lines", lambda x: strip(F.regexp_extract(x, HEADING, 2))).alias("heading"),
        F.transform("lines", lambda x: F.length(x)).alias("length"),
    )
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in _FACTS.items())

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for low in range(0, batch.num_rows, _BATCH_DOCS):
                yield _facts(batch.slice(low, _BATCH_DOCS))

    return each.mapInArrow(run, schema)


def _running_max(values: np.ndarray, known: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest known value so far within each document, and whether there is one."""
    ranks, place = np.unique(values[known], return_inverse=True)
    rank = np.zeros(len(values), dtype=np.int64)
    rank[known] = place + 1
    wide = len(ranks) + 1
    best = np.maximum.accumulate(rank + doc * wide) - doc * wide
    return (ranks[np.maximum(best, 1) - 1] if len(ranks) else np.zeros(len(values), dtype=np.int64)), best > 0


def _ends(level: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each heading, the number of the first later one of its document with its level or a smaller one; -1 if none."""
    out, still = np.full(len(level), -1), []
    for k, (lv, d) in enumerate(zip(level.tolist(), doc.tolist(), strict=True)):
        while still and (still[-1][2] != d or still[-1][1] >= lv):
            j, _, of = still.pop()
            if of == d:
                out[j] = k
        still.append((k, lv, d))
    return out


def _facts(batch: pa.RecordBatch) -> pa.RecordBatch:
    flat = {n: batch.column(n).flatten() for n in ("lines", "blank", "marker", "fence", "level", "heading", "length")}
    numbers = {n: flat[n].to_numpy(zero_copy_only=False) for n in ("blank", "fence", "level", "length")}
    n_lines = np.diff(batch.column("lines").offsets.to_numpy()).astype(np.int64)
    first = n_lines.cumsum() - n_lines
    doc = np.repeat(np.arange(len(n_lines)), n_lines)
    total = len(doc)

    def within(counts: np.ndarray) -> np.ndarray:
        """Running sum within the document."""
        run = counts.cumsum()
        return run - np.repeat(run[first] - counts[first], n_lines)

    blank, fence = numbers["blank"].astype(bool), numbers["fence"].astype(bool)
    size = numbers["length"].astype(np.int64) + 1
    line_no = np.arange(total) - np.repeat(first, n_lines) + 1
    has_marker = flat["marker"].is_valid().to_numpy(zero_copy_only=False)
    marker = flat["marker"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    solid = np.flatnonzero(~blank)
    before = np.full(total, -1)  # the solid line before a solid one
    before[solid[1:]] = np.where(doc[solid[1:]] == doc[solid[:-1]], solid[:-1], -1)
    opens = (before >= 0) & has_marker[before]
    page, has_page = _running_max(np.where(opens, marker[before], 0), opens, doc)
    page = np.where(has_page, page, 0)
    max_marker, has_max = _running_max(marker, has_marker, doc)
    is_text = ~fence & (within(fence.astype(np.int64)) % 2 == 0)
    level = np.where(is_text, numbers["level"].astype(np.int64), 0)
    section_no = within((level > 0).astype(np.int64))
    start = within(size) - size
    edge = np.zeros(total, dtype=bool)
    edge[first] = True
    page_before = np.concatenate([[0], page[:-1]])
    last = np.zeros(total, dtype=bool)
    last[first + n_lines - 1] = True
    last_of = np.repeat(first + n_lines - 1, n_lines)

    def ints(values: np.ndarray, missing: np.ndarray | None = None, kind: pa.DataType = pa.int64()) -> pa.Array:
        return pa.array(values, kind, mask=missing)

    heads = np.flatnonzero(level > 0)
    out = {
        "n_lines": ints(np.repeat(n_lines, n_lines), kind=pa.int32()), "n_chars": batch.column("n_chars").take(pa.array(doc)), "line_no": ints(line_no, kind=pa.int32()),
        "line": flat["lines"], "blank": flat["blank"], "marker": flat["marker"], "start": ints(start), "max_marker": ints(max_marker, ~has_max),
        "page": ints(page), "level": ints(level, level == 0, pa.int32()), "heading": flat["heading"], "section_no": ints(section_no),
        "para": ints(within(blank.astype(np.int64))), "page_before": ints(page_before, edge), "page_after": ints(np.append(page[1:], 0), last),
        "last_page": ints(page[last_of]), "last_marker": ints(max_marker[last_of], ~has_max[last_of]),
    }
    for lv in LEVELS:
        own = np.maximum.accumulate(np.where(level == lv, np.arange(total), -1)) if total else np.zeros(0, np.int64)
        missing = own < np.repeat(first, n_lines)
        at = np.maximum(own, 0)
        parts = [ints(line_no[at], kind=pa.int32()), ints(section_no[at]), flat["heading"].take(pa.array(at))]
        out[f"h{lv}"] = pa.StructArray.from_arrays(parts, names=["line_no", "no", "heading"], mask=pa.array(missing))
    end = np.full(total, -1)
    ends = _ends(level[heads], doc[heads])
    end[heads[ends >= 0]] = heads[ends[ends >= 0]]
    at = np.maximum(end, 0)
    parts = [ints(line_no[at], kind=pa.int32()), ints(start[at]), ints(page[at]), ints(page_before[at], edge[at])]
    out["next"] = pa.StructArray.from_arrays(parts, names=["line_no", "at", "page", "page_before"], mask=pa.array(end < 0))
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *out.values()], names=["doc_id", *out])


def open_headings() -> Column:
    """The chain of headings open at a line, outermost first: a heading is open until one of a smaller or equal level follows."""
    chain = []
    for lv in LEVELS:
        here = F.col(f"h{lv}")
        closed = [F.coalesce(F.col(f"h{j}.line_no"), F.lit(0)) > F.col(f"h{lv}.line_no") for j in range(1, lv)]
        is_open = here.isNotNull() & ~reduce(lambda a, b: a | b, closed, F.lit(False))
        chain.append(F.when(is_open, F.struct(F.lit(lv).alias("level"), here["no"].alias("no"), here["heading"].alias("heading"))))
    return F.array_compact(F.array(*chain))


def heading_path(chain: Column) -> Column:
    return F.array_join(F.transform(chain, lambda h: h["heading"]), " > ")


def normalised_heading(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[*_`]+", ""))


def is_noise(chain: Column, patterns: list[str]) -> Column:
    """Whether a heading of the chain, or one above it, matches a pattern."""
    if not patterns:
        return F.lit(False)

    def hit(h: Column) -> Column:
        plain = normalised_heading(h["heading"])
        return reduce(lambda a, b: a | b, [plain.rlike("(?i)" + p) for p in patterns])

    return F.exists(chain, hit)


def section_id(no: Column) -> Column:
    return F.when(no > 0, F.format_string("sec-%04d", no)).otherwise(ROOT)


# --- outputs -------------------------------------------------------------------------------------------------


def page_texts(facts: DataFrame) -> DataFrame:
    """Markdown of every physical page (numbered from 1), markers removed, blank lines at the edges trimmed; ids without a marker are empty."""
    keep = F.when(F.col("marker").isNull(), F.struct("line_no", "line", "blank"))
    grouped = facts.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(keep)).alias("b"))
    solid = F.filter("b", lambda x: ~x["blank"])
    inner = F.filter(
        F.col("b"),
        lambda x: (x["line_no"] >= F.get(solid, F.lit(0))["line_no"]) & (x["line_no"] <= F.element_at(solid, -1)["line_no"]),
    )
    text = F.when(F.size(solid) > 0, F.array_join(F.transform(inner, lambda x: x["line"]), "\n")).otherwise("")
    texts = grouped.select("doc_id", "page", text.alias("markdown"))
    ids = facts.where("line_no = 1").select("doc_id", F.coalesce("last_marker", F.lit(0)).alias("last"))
    every = ids.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("page"))
    return every.join(texts, ["doc_id", "page"], "left").select("doc_id", (F.col("page") + 1).alias("page"), F.coalesce("markdown", F.lit("")).alias("markdown"))


def sections(facts: DataFrame, noise: list[str] | None = None) -> DataFrame:
    """Heading tree with line, character and page ranges; one root row per document."""
    heads = facts.where(F.col("level").isNotNull()).withColumn("chain", open_headings())
    body = F.col("line_no") + 1
    line_end = F.coalesce(F.col("next.line_no") - 1, F.col("n_lines"))
    parent = F.coalesce(F.get(F.col("chain"), F.size("chain") - 2)["no"], F.lit(0))
    page_start = F.coalesce("page_after", "page")
    page_end = F.when(F.col("next").isNull(), F.col("last_page")).when(F.col("next.line_no") == body, F.col("next.page")).otherwise(F.col("next.page_before"))
    out = heads.select(
        "doc_id",
        F.col("section_no").cast("long").alias("section_no"),
        section_id(F.col("section_no")).alias("section_id"),
        F.col("level").cast("long").alias("level"),
        "heading",
        heading_path(F.col("chain")).alias("heading_path"),
        section_id(parent).alias("parent_id"),
        F.col("line_no").cast("long").alias("heading_line"),
        body.cast("long").alias("line_start"),
        line_end.cast("long").alias("line_end"),
        (F.col("start") + F.length("line") + 1).alias("char_start"),
        F.coalesce(F.col("next.at"), F.col("n_chars") + 1).cast("long").alias("char_end"),
        (page_start + 1).alias("page_start"),
        (page_end + 1).alias("page_end"),
        is_noise(F.col("chain"), noise or []).alias("filtered"),
    )
    first = facts.where("line_no = 1").select("doc_id", F.col("n_lines").alias("n"), F.col("n_chars").alias("c"), F.coalesce("last_marker", F.lit(0)).alias("p"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    root = first.select(
        "doc_id", zero.alias("section_no"), F.lit(ROOT).alias("section_id"), zero.alias("level"), F.lit("").alias("heading"), F.lit("").alias("heading_path"),
        F.lit(None).cast("string").alias("parent_id"), zero.alias("heading_line"), one.alias("line_start"), F.col("n").cast("long").alias("line_end"),
        zero.alias("char_start"), (F.col("c") + 1).cast("long").alias("char_end"), one.alias("page_start"), (F.col("p") + 1).alias("page_end"),
        F.lit(False).alias("filtered"),
    )
    return root.unionByName(out)


def with_children(tree: DataFrame) -> DataFrame:
    """Sections with the ids of their direct children in order (the sections of one document)."""
    kids = tree.where(F.col("parent_id").isNotNull()).groupBy("doc_id", F.col("parent_id").alias("section_id")).agg(
        F.sort_array(F.collect_list(F.struct("section_no", F.col("section_id").alias("id")))).alias("kids")
    )
    kids = kids.select("doc_id", "section_id", F.transform("kids", lambda k: k["id"]).alias("children_ids"))
    return tree.join(kids, ["doc_id", "section_id"], "left").withColumn("children_ids", F.coalesce("children_ids", F.array().cast("array<string>")))


def paragraphs(facts: DataFrame, noise: list[str] | None = None) -> DataFrame:
    """Paragraphs of every section's own body. The path travels with the lines, so no join brings it back."""
    rows = facts.withColumn("chain", open_headings())
    keep = (
        (F.col("section_no") > 0) & F.col("level").isNull() & ~F.col("blank") & F.col("marker").isNull()
        & ~F.col("line").rlike(IMAGE_ONLY) & ~is_noise(F.col("chain"), noise or [])
    )
    kept = rows.where(keep).select("doc_id", "section_no", "para", "line_no", "line", "page", heading_path(F.col("chain")).alias("heading_path"))
    # dealt by document once: the groups below and those of the chunks are all within a document
    grouped = kept.repartition("doc_id").groupBy("doc_id", "section_no", "para").agg(
        F.min("line_no").cast("long").alias("line_start"), F.max("line_no").cast("long").alias("line_end"), F.min_by("page", "line_no").alias("page"),
        F.first("heading_path").alias("heading_path"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"),
    )
    text = strip(F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return grouped.withColumn("text", text).drop("l").where(F.col("text") != "")


_PACKED = T.ArrayType(
    T.StructType([
        T.StructField("section_no", T.LongType()), T.StructField("line_start", T.LongType()), T.StructField("line_end", T.LongType()), T.StructField("text", T.StringType()),
    ])
)


def _packed(sections: Column, limit: int) -> Column:
    def run(documents: pd.Series) -> pd.Series:
        rows = [
            [
                {"section_no": s["section_no"], "line_start": a, "line_end": b, "text": t}
                for s in own
                for a, b, t in sp.pack_paragraphs([(p["line_start"], p["line_end"], p["text"]) for p in s["p"]], limit)
            ]
            for own in documents
        ]
        return pd.Series(rows, dtype=object)

    return F.pandas_udf(run, _PACKED)(sections)


def pack_sections(paras: DataFrame, limit: int = MD_MAX_CHARS) -> DataFrame:
    """Chunks of packed paragraphs; a chunk never crosses a section. Numbered through the document."""
    item = F.struct("line_start", "line_end", "text", "page")
    grouped = paras.groupBy("doc_id", "section_no").agg(
        F.first("heading_path").alias("heading_path"), F.sort_array(F.collect_list(item)).alias("p")
    )
    # paragraphs come dealt by document, so this meets no further exchange
    whole = grouped.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("section_no", "heading_path", "p"))).alias("s"))
    pages = F.map_from_entries(F.flatten(F.transform("s", lambda s: F.transform(s["p"], lambda x: F.struct(x["line_start"], x["page"])))))
    paths = F.map_from_entries(F.transform("s", lambda s: F.struct(s["section_no"], s["heading_path"])))
    rows = whole.select("doc_id", pages.alias("pages"), paths.alias("paths"), _packed(F.col("s"), limit).alias("c"))
    # outer, since Spark would otherwise pack a second time to see whether there is something to explode
    rows = rows.select("doc_id", "pages", "paths", F.posexplode_outer("c").alias("pos", "c")).where("pos IS NOT NULL")
    return rows.select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("chunk_no"), section_id(F.col("c.section_no")).alias("section_id"),
        F.element_at("paths", F.col("c.section_no")).alias("heading_path"), (F.element_at("pages", F.col("c.line_start")) + 1).alias("page"),
        "c.line_start", "c.line_end", F.col("c.text").alias("body"),
    )


# --- time ----------------------------------------------------------------------------------------------------


def text_markers(docs: DataFrame) -> DataFrame:
    """Marker counts and maxima of whole texts, computed in the row before any shuffle."""
    cover = F.substring("text", 1, tm.COVER_LENGTH)
    columns = [(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).alias("denominator")]
    for unit in tm.UNITS:
        columns += [
            F.size(tm.markers(F.col("text"), unit)).alias(f"text_{unit}"),
            F.array_max(tm.markers(F.col("text"), unit)).alias(f"text_max_{unit}"),
            F.array_max(tm.cover_markers(cover, unit)).alias(f"cover_max_{unit}"),
        ]
    return docs.select("doc_id", *columns)


def heading_markers(paths: DataFrame) -> DataFrame:
    """Per document the headings by unit and the largest heading marker of every unit."""
    rows = paths.select("doc_id", tm.path_unit(F.col("heading_path")).alias("unit"), *[tm.path_marker(F.col("heading_path"), u).alias(f"m_{u}") for u in tm.UNITS])
    aggs = [F.count(F.lit(1)).alias("headings")]
    for unit in tm.UNITS:
        aggs += [F.count_if(F.col("unit") == unit).alias(f"heads_{unit}"), F.count(f"m_{unit}").alias(f"marks_{unit}"), F.max(f"m_{unit}").alias(f"mark_max_{unit}")]
    return rows.groupBy("doc_id").agg(*aggs)


def _ladder(cases, otherwise):
    out = otherwise
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def time_estimates(docs: DataFrame, paths: DataFrame, as_of: str) -> DataFrame:
    """Reporting unit and latest anchor of every document with confidence; ``as_of`` stands in for today."""
    rows = text_markers(docs).join(heading_markers(paths), "doc_id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in rows.columns if c.startswith(("headings", "heads_", "marks_"))}
    rows = rows.withColumns(zero)
    cases_unit, cases_conf, cases_reason = [], [], []
    for unit in tm.UNITS:
        share = F.col(f"heads_{unit}") / F.greatest(F.col("headings"), F.lit(1))
        cases_unit.append((share > 0.5, F.lit(unit)))
        cases_conf.append((share > 0.5, F.round(F.least(F.lit(0.95), 0.6 + share * 0.35), 2)))
        cases_reason.append((share > 0.5, F.lit("headings")))
    for unit in tm.UNITS:
        density = F.col(f"text_{unit}") / F.col("denominator")
        cases_unit.append((density > 0.3, F.lit(unit)))
        cases_conf.append((density > 0.3, F.round(F.least(F.lit(0.7), 0.4 + density * 0.4), 2)))
        cases_reason.append((density > 0.3, F.lit("text density")))
    any_year = (F.col("text_year") > 0) | (F.col("marks_year") > 0)
    rows = rows.withColumns(
        {
            "unit": _ladder(cases_unit, F.lit("year")),
            "unit_confidence": _ladder(cases_conf, F.when(any_year, 0.35).otherwise(0.1)),
            "unit_reason": _ladder(cases_reason, F.when(any_year, "some years").otherwise("no marker")),
        }
    )
    fallback = {"year": as_of[:4], "month": as_of[:7], "day": as_of}

    def by_unit(prefix: str) -> Column:
        return _ladder([(F.col("unit") == u, F.col(f"{prefix}{u}")) for u in tm.UNITS], F.lit(None))

    head, cover, text, marks = by_unit("mark_max_"), by_unit("cover_max_"), by_unit("text_max_"), by_unit("marks_")
    default = _ladder([(F.col("unit") == u, F.lit(v)) for u, v in fallback.items()], F.lit(None))
    return rows.select(
        "doc_id", "unit", "unit_confidence", "unit_reason",
        F.coalesce(head, cover, text, default).alias("anchor"),
        F.when(head.isNotNull(), F.when(marks >= 3, 0.9).otherwise(0.7)).when(cover.isNotNull(), 0.75).when(text.isNotNull(), 0.4).otherwise(0.1).alias("anchor_confidence"),
        F.when(head.isNotNull(), "headings").when(cover.isNotNull(), "cover").when(text.isNotNull(), "text").otherwise("as-of date").alias("anchor_reason"),
    )


def chunk_records(chunks: DataFrame, estimates: DataFrame, stem: Column, source: Column) -> DataFrame:
    """Final chunk rows: text under its heading path, ids through the document, the anchor of the own heading where there is one."""
    rows = chunks.join(estimates.select("doc_id", "unit", "anchor"), "doc_id")
    own = _ladder([(F.col("unit") == u, tm.path_marker(F.col("heading_path"), u)) for u in tm.UNITS], F.lit(None))
    text = F.when(F.col("heading_path") != "", F.concat(F.col("heading_path"), F.lit("\n\n"), F.col("body"))).otherwise(F.col("body"))
    return rows.select(
        "doc_id", F.format_string("%s-%04d", stem, F.col("chunk_no")).alias("id"), text.alias("text"), "heading_path", "section_id", "page",
        F.col("page").cast("string").alias("page_label"), "line_start", "line_end", source.alias("source"), F.col("unit").alias("time_unit"),
        F.coalesce(own, F.col("anchor")).alias("time_anchor"),
    )
