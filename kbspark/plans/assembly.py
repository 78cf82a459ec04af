"""Document assembly from rows derived from the given tables."""

from pyspark.sql import functions as F

from ..operators import assembly as asm
from ..sources import files
from ..sources.tables import load
from .registry import query


@query(
    "csv_documents",
    """WITH c AS (SELECT c_mktsegment || ' ' || c_nationkey AS sheet, c_custkey,
  c_custkey || ',"' || replace(c_name, '#', '"", ') || '",' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END || chr(13) || chr(10) AS line FROM customer)
SELECT sheet, sheet AS title, md5('Sheet: ' || sheet || chr(10) || chr(10) || string_agg(line, '' ORDER BY c_custkey)) AS digest FROM c GROUP BY sheet""",
)
def csv_documents(spark, sf):
    """One sheet per market segment and nation; names hold a quote and a comma."""
    k = F.col("c_custkey")
    rows = load(spark, sf, "customer").select(
        F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("sheet"), k.alias("row_no"), k.alias("id"),
        F.replace(F.col("c_name"), F.lit("#"), F.lit('", ')).alias("name"), F.when(k % 3 != 0, F.col("c_nationkey")).alias("nation"),
    )
    out = asm.sheet_documents(rows, ["id", "name", "nation"])
    return out.select("sheet", "title", F.md5("text").alias("digest"))


LINES_SQL = """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents)"""


def _lines(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))


@query(
    "slide_documents",
    f"""WITH {LINES_SQL}, s AS (SELECT doc_id, k // 4 AS slide, k % 4 AS shape_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM ln WHERE trim(line) != ''),
g AS (SELECT doc_id, slide, string_agg(line || chr(10) || 'more ' || shape_no, chr(10) ORDER BY shape_no) AS txt,
  coalesce(string_agg(CASE WHEN shape_no < 2 THEN line || ', more ' || shape_no END, chr(10) ORDER BY shape_no), '') AS title FROM s GROUP BY ALL HAVING len(txt) >= 50)
SELECT doc_id, slide AS page, md5(txt) AS digest, md5(title) AS title_digest, count(*) OVER (PARTITION BY doc_id) AS total_pages FROM g""",
)
def slide_documents(spark, sf):
    """Two shapes of a slide are titles; every shape has an empty paragraph and one with wide spaces."""
    second = F.concat(F.col("line"), F.lit("\n \n  more   "), (F.col("k") % 4).cast("string"), F.lit(" "))
    shapes = _lines(spark, sf).select(
        "doc_id", F.floor(F.col("k") / 4).alias("slide"), (F.col("k") % 4).alias("shape_no"),
        F.when(F.col("k") % 4 < 2, "Sub Title 1").otherwise("Text 2").alias("name"), F.when(F.trim("line") != "", second).otherwise(F.col("line")).alias("text"),
    )
    return asm.slide_documents(shapes).select("doc_id", "page", F.md5("text").alias("digest"), F.md5("title").alias("title_digest"), "total_pages")


@query(
    "table_text",
    """WITH c AS (SELECT o_custkey AS t, o_orderkey AS r, unnest([0, 1, 2]) AS c, unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus || '; ' || o_orderpriority, CASE WHEN o_orderkey % 3 != 0 THEN o_orderpriority END]) AS x FROM orders),
f AS (SELECT t, r, c, coalesce(x, '') AS x, max(len(coalesce(x, ''))) OVER (PARTITION BY t, c) AS w FROM c),
l AS (SELECT t, r, '| ' || string_agg(rpad(x, CAST(w AS INTEGER), ' '), ' | ' ORDER BY c) || ' |' AS line FROM f GROUP BY t, r)
SELECT t AS table_id, string_agg(line, chr(10) ORDER BY r) AS text FROM l GROUP BY t""",
)
def table_text(spark, sf):
    cell = lambda i, v: F.struct(F.lit(i).alias("col_no"), v.alias("text"))
    o = load(spark, sf, "orders")
    third = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    cells = o.select(
        F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("row_no"),
        F.inline(F.array(cell(0, F.col("o_orderkey").cast("string")), cell(1, F.concat_ws("\n", F.lit(" "), "o_orderstatus", F.lit(""), F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")))), cell(2, third))),
    )
    # a cell without a value is missing, not empty, in every second row
    cells = cells.where(F.col("text").isNotNull() | (F.col("row_no") % 2 == 0))
    return asm.table_texts(cells.withColumn("col_no", F.col("col_no").cast("int")))


@query(
    "block_documents",
    f"""WITH {LINES_SQL}, b AS (SELECT doc_id, k, contains(line, ' | ') AS tab, unnest(string_split(line, ' | ')) AS cell, generate_subscripts(string_split(line, ' | '), 1) AS c FROM ln),
e AS (SELECT doc_id, k, tab, c, unnest(CASE WHEN tab THEN [c * 3, c * 3 + 2] ELSE [c * 3] END) AS spot, cell FROM b),
n AS (SELECT doc_id, k, spot, trim(regexp_replace(coalesce(cell, ''), '\\s+', ' ', 'g')) AS x FROM e),
t AS (SELECT doc_id, x, min(k * 100000 + spot) AS spot FROM n WHERE k % 5 = 0 AND x != '' GROUP BY ALL), tt AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY spot) AS title FROM t GROUP BY doc_id)
SELECT n.doc_id, md5(string_agg(x, chr(10) ORDER BY k, n.spot)) AS digest, md5(coalesce(any_value(title), '')) AS title_digest FROM n LEFT JOIN tt ON tt.doc_id = n.doc_id WHERE x != '' GROUP BY n.doc_id""",
)
def block_documents(spark, sf):
    """Lines with bars are table rows: each cell is merged over two columns, and a cell with an equal text stands next to it."""
    table = F.contains("line", F.lit(" | "))
    cells = _lines(spark, sf).select("doc_id", "k", table.alias("table"), F.posexplode(F.split("line", r" \| ")).alias("c", "cell"))
    cell = lambda n, i: F.struct((F.col("c") * 3 + n).alias("cell_no"), (F.col("c") * 3 + i).alias("cell_id"), F.col("cell").alias("text"))
    spread = F.when(F.col("table"), F.array(cell(0, 0), cell(1, 0), cell(2, 2))).otherwise(F.array(cell(0, 0)))
    blocks = cells.select(
        "doc_id", F.col("k").alias("block_no"), F.when(F.col("table"), "table").otherwise("paragraph").alias("kind"),
        F.when(F.col("k") % 5 == 0, "Title").otherwise("Normal").alias("style"), F.lit(0).alias("row_no"), F.inline(spread),
    )
    return asm.block_documents(blocks).select("doc_id", F.md5("text").alias("digest"), F.md5("content_title").alias("title_digest"))


# --- files ---------------------------------------------------------------------------------------------------


def _files(spark, sf):
    """Documents and pages as files of several types; some types are unsupported and some files empty."""
    k = F.col("doc_id")
    ext = F.when(k % 5 == 0, "md").when(k % 5 == 1, "TXT").when(k % 5 == 2, "xyz").when(k % 5 == 3, "docx").otherwise("txt")
    marked = F.concat(F.lit("lost\n{0}" + "-" * 48 + "\n"), F.col("text"), F.lit("\n{1}" + "-" * 48 + "\n\nsecond\n"))
    text = F.when(k % 10 == 0, marked).when(k % 20 == 4, F.lit(" \n")).otherwise(F.col("text"))
    docs = load(spark, sf, "documents").select(F.concat(F.lit("in/d"), k.cast("string"), F.lit("."), ext).alias("path"), text.alias("text"))
    pages = load(spark, sf, "pages").select(F.concat(F.lit("in/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    return docs.unionByName(pages)


@query(
    "file_dispatch",
    r"""SELECT 'in/d' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.xyz' WHEN 3 THEN '.docx' ELSE '.txt' END AS path,
  CASE WHEN doc_id % 5 = 2 THEN 'unsupported type' WHEN doc_id % 5 = 3 THEN 'no parser' WHEN doc_id % 20 = 4 THEN 'no document' ELSE 'parsed' END AS outcome,
  CAST(CASE WHEN doc_id % 10 = 0 THEN 2 WHEN doc_id % 5 IN (2, 3) OR doc_id % 20 = 4 THEN 0 ELSE 1 END AS BIGINT) AS documents,
  CASE WHEN doc_id % 10 = 0 THEN len(trim(text, ' ' || chr(10))) + 6 WHEN doc_id % 5 IN (2, 3) OR doc_id % 20 = 4 THEN 0 ELSE len(text) END AS chars FROM documents
UNION ALL SELECT 'in/p' || page_id || '.html', 'parsed', 1, -1 FROM pages""",
)
def file_dispatch(spark, sf):
    docs, rejected = files.parse_files(_files(spark, sf))
    is_html = F.col("path").endswith(".html")
    ok = docs.groupBy("path").agg(F.lit("parsed").alias("outcome"), F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("chars"))
    ok = ok.withColumn("chars", F.when(is_html, F.lit(-1)).otherwise(F.col("chars")))
    return ok.unionByName(rejected.select("path", F.col("reason").alias("outcome"), F.lit(0).cast("long").alias("documents"), F.lit(0).cast("long").alias("chars")))


@query(
    "marker_pairs",
    """SELECT 'd' || doc_id AS stem, doc_id % 3 = 0 AS valid, CASE WHEN doc_id % 3 = 0 THEN 'up/d' || doc_id || '.md' END AS text_path, CASE WHEN doc_id % 3 = 0 THEN 'up/d' || doc_id || '.pdf' END AS source_file,
  CASE WHEN doc_id % 3 = 0 THEN 'pdf' END AS source_type FROM documents""",
)
def marker_pairs(spark, sf):
    k = F.col("doc_id")
    base = F.concat(F.lit("up/d"), k.cast("string"))
    paths = F.when(k % 3 == 0, F.array(F.concat(base, F.lit(".md")), F.concat(base, F.lit(".pdf")))).when(k % 3 == 1, F.array(F.concat(base, F.lit(".md"))))
    paths = paths.otherwise(F.array(F.concat(base, F.lit(".md")), F.concat(base, F.lit(".MD")), F.concat(base, F.lit(".pdf"))))
    return files.marker_pairs(load(spark, sf, "documents").select(F.explode(paths).alias("path")))


@query(
    "bulk_sources",
    """SELECT 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.bin' END AS name, 'shared/in/d' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.bin' END AS source_file,
  CASE WHEN doc_id % 2 = 0 THEN 'md' END AS source_type, CASE WHEN doc_id % 2 = 0 THEN 'text/markdown' END AS mime FROM documents""",
)
def bulk_sources(spark, sf):
    k = F.col("doc_id")
    paths = load(spark, sf, "documents").select(F.concat(F.lit("x/y/d"), k.cast("string"), F.when(k % 2 == 0, ".md").otherwise(".bin")).alias("path"))
    return files.ingest_requests(paths, "shared/in/").drop("path")
