"""Rows of sheets, slides, tables and blocks to documents. A document is one file, so its parts are one bounded group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import collapse_space, strip

SHEET_TEMPLATE = "Sheet: %s\n\n%s"


def csv_field(value: Column) -> Column:
    """A value as a CSV field: empty for null, quoted where it holds a separator, a quote or a line break."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\r\n]'), quoted).otherwise(text)


def sheet_documents(rows: DataFrame, columns: list[str], template: str = SHEET_TEMPLATE) -> DataFrame:
    """One document per sheet: its rows as CSV lines in a template with the sheet's name."""
    line = F.concat(F.concat_ws(",", *[csv_field(F.col(c)) for c in columns]), F.lit("\r\n"))
    ordered = F.sort_array(F.collect_list(F.struct("row_no", line.alias("line"))))
    docs = rows.groupBy("sheet").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("csv"))
    return docs.select("sheet", F.col("sheet").alias("title"), F.format_string(template, F.col("sheet"), F.col("csv")).alias("text"))


def _lines(text: Column) -> Column:
    """Lines with their spaces collapsed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), collapse_space), lambda x: x != "")


def slide_documents(shapes: DataFrame, least: int = 50) -> DataFrame:
    """One document per slide with enough text; the page keeps the slide's index.

    Spaces collapse in every paragraph of a shape, and empty paragraphs and shapes go. Titles are the shapes named so, one per line.
    """
    solid = shapes.withColumn("lines", _lines(F.col("text"))).where(F.size("lines") > 0)
    is_title = F.contains(F.lower("name"), F.lit("title"))
    ordered = F.sort_array(F.collect_list(F.struct("shape_no", F.array_join("lines", "\n").alias("text"))))
    titles = F.sort_array(F.collect_list(F.when(is_title, F.struct("shape_no", F.array_join("lines", ", ").alias("text")))))
    slides = solid.groupBy("doc_id", "slide").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"),
        F.array_join(F.transform(titles, lambda x: x["text"]), "\n").alias("title"),
    )
    kept = slides.where(F.length("text") >= least)
    return kept.withColumns({"page": F.col("slide"), "total_pages": F.count(F.lit(1)).over(Window.partitionBy("doc_id"))})


def table_texts(cells: DataFrame) -> DataFrame:
    """Cells (table_id, row_no, col_no, text) as aligned lines ``| a | b |``; missing cells are padded."""
    lines = F.filter(F.split(strip(F.coalesce("text", F.lit(""))), "\n"), lambda x: x != "")
    clean = F.array_join(F.transform(lines, strip), "; ")
    rows = cells.select("table_id", "row_no", "col_no", clean.alias("text"))
    width = rows.withColumn("width", F.max(F.length("text")).over(Window.partitionBy("table_id", "col_no")))
    columns = F.max("col_no").over(Window.partitionBy("table_id"))
    sized = width.withColumn("columns", columns)
    widths = sized.groupBy("table_id").agg(F.map_from_entries(F.collect_set(F.struct("col_no", "width"))).alias("widths"), F.max("columns").alias("columns"))
    by_row = sized.groupBy("table_id", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", "text"))).alias("cells"))
    joined = by_row.join(widths, "table_id")
    padded = F.transform(
        F.sequence(F.lit(0), F.col("columns").cast("int")),
        lambda i: F.rpad(F.coalesce(F.element_at("cells", i), F.lit("")), F.coalesce(F.element_at("widths", i), F.lit(0)), F.lit(" ")),
    )
    line = F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))
    ordered = F.sort_array(F.collect_list(F.struct("row_no", line.alias("line"))))
    return joined.groupBy("table_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def block_documents(blocks: DataFrame) -> DataFrame:
    """Paragraphs and table cells (doc_id, block_no, kind, style, row_no, cell_no, cell_id, text) as one document each.

    Spaces collapse and empty texts go; cells and blocks join by a line break. A merged cell comes several times in its row with one
    ``cell_id`` and counts once; neighbours with equal texts stay. The titles are all texts styled so, each once, in order.
    """
    row = Window.partitionBy("doc_id", "block_no", "row_no").orderBy("cell_no")
    merged = (F.col("kind") == "table") & F.coalesce(F.lag("cell_id").over(row) == F.col("cell_id"), F.lit(False))
    rows = blocks.withColumn("merged", merged).where(~F.col("merged")).withColumn("text", collapse_space(F.coalesce("text", F.lit(""))))
    rows = rows.where(F.col("text") != "")
    place = F.struct("block_no", "row_no", "cell_no", "text")
    ordered = F.sort_array(F.collect_list(place))
    titled = F.sort_array(F.collect_list(F.when(F.col("style") == "Title", place)))
    texts = lambda x: F.transform(x, lambda p: p["text"])
    return rows.groupBy("doc_id").agg(
        F.array_join(F.array_distinct(texts(titled)), "\n").alias("content_title"), F.array_join(texts(ordered), "\n").alias("text")
    )
