"""Files and stored paths as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import SOURCE_MIME
from ..functions.text import lookup, strip
from ..session import scratch_path, stored

# --- stored paths --------------------------------------------------------------------------------------------

SUBDIRECTORY = {"document_source": "/documents/", "kb_source": "/knowledge_base/"}
DEFAULT_NAMES = {"chatbot_html": "chatbot.html", "dialogue_fsm": "dialogue.json"}


def list_paths(paths: DataFrame, prefix: str) -> DataFrame:
    return paths.where(F.col("path").startswith(prefix)).orderBy("path")


def list_stored(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """Paths and lengths under a folder; the file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.where(F.contains("path", F.lit(prefix))).orderBy("path")


def source_files(paths: DataFrame, resource_type: str | None, name: str) -> DataFrame:
    """Paths of one resource type. Source files may have any extension, others must end with the name."""
    if resource_type is None:
        return paths
    part = SUBDIRECTORY.get(resource_type)
    if part is None:
        return paths.where(F.col("path").endswith(name))
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    return paths.where(F.col("path").contains(part) & stem.endswith(name))


def resource_path(root: str, resource_type: Column, project: Column, resource: Column, extension: Column) -> Column:
    """Project-specific path of a resource, null where the type needs a project and there is none."""
    base = F.concat(F.lit(f"{root}/projects/"), project)
    file = F.concat(F.lit("/source."), extension)
    return (
        F.when(resource_type.isin(*DEFAULT_NAMES), F.concat(base, F.lit("/"), lookup(DEFAULT_NAMES, resource_type)))
        .when(resource_type == "image", F.concat(F.lit(f"{root}/images/"), resource))
        .when(resource_type == "document_source", F.concat(base, F.lit("/documents/"), resource, file))
        .when(resource_type == "kb_source", F.concat(base, F.lit("/knowledge_base/"), resource, file))
    )


def resource_candidates(requests: DataFrame, root: str) -> DataFrame:
    """Candidate paths of every request by priority: the project's own, then the default."""
    none = F.lit(None).cast("string")
    resource = F.col("resource_id") if "resource_id" in requests.columns else none
    own = resource_path(root, F.col("resource_type"), F.col("project_id"), resource, F.lit("pdf"))
    default = F.when(F.col("resource_type").isin(*DEFAULT_NAMES), F.concat(F.lit(f"{root}/"), lookup(DEFAULT_NAMES, F.col("resource_type"))))
    pairs = F.array(F.struct(F.lit(0).alias("priority"), own.alias("path")), F.struct(F.lit(1).alias("priority"), default.alias("path")))
    return requests.select("request_id", F.inline(pairs)).where(F.col("path").isNotNull())


# --- file contents -------------------------------------------------------------------------------------------


def extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder as (path, text); every file is one row read by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def with_source_type(files: DataFrame) -> DataFrame:
    """Source type by extension and its MIME type; null for types nobody can parse."""
    ext = extension(F.col("path"))
    return files.withColumns({"source_type": F.when(ext.isin(*SOURCE_MIME), ext), "mime": lookup(SOURCE_MIME, ext)})


PARSERS: dict[str, object] = {}


def register_parser(source_type: str, parser) -> None:
    """Add a parser: a function from (path, text) rows to (path, page, total_pages, title, text) rows."""
    PARSERS[source_type] = parser


def _parse_text(files: DataFrame) -> DataFrame:
    one = F.lit(1).cast("long")
    return files.select("path", one.alias("page"), one.alias("total_pages"), F.lit("").alias("title"), "text")


def _parse_html(files: DataFrame) -> DataFrame:
    from ..functions.html import page_title, visible_text

    one = F.lit(1).cast("long")
    return files.select(
        "path", one.alias("page"), one.alias("total_pages"), page_title(F.col("text")).alias("title"), visible_text(F.col("text")).alias("text")
    )


def _parse_markdown(files: DataFrame) -> DataFrame:
    """Pages by marker; a file without a marker is one plain text document."""
    from ..operators.markdown import has_page_marker, marker_pages

    marked = files.withColumn("_marked", has_page_marker(F.col("text")))
    pages = marker_pages(marked.where("_marked").select(F.col("path").alias("doc_id"), "text"))
    pages = pages.select(F.col("doc_id").alias("path"), (F.col("page") + 1).alias("page"), "total_pages", F.lit("").alias("title"), "text")
    return pages.unionByName(_parse_text(marked.where(~F.col("_marked"))))


register_parser("txt", _parse_text)
register_parser("html", _parse_html)
register_parser("md", _parse_markdown)


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of all files and the files that gave none, with the reason.

    Every parser sees only the files of its type; a type without a parser, an unsupported extension and an empty
    result are rejected. The documents are stored, so that no file is parsed again for the rejects or by the caller.
    """
    typed = with_source_type(files)
    documents = None
    for source_type, parser in PARSERS.items():
        part = parser(typed.where(F.col("source_type") == source_type)).where(strip(F.coalesce("text", F.lit(""))) != "")
        documents = part if documents is None else documents.unionByName(part)
    documents = stored(documents, scratch_path(files.sparkSession, "parsed"))
    reason = (
        F.when(F.col("source_type").isNull(), "unsupported type")
        .when(~F.col("source_type").isin(*PARSERS), "no parser")
        .otherwise("no document")
    )
    rejected = typed.join(documents.select("path").distinct(), "path", "left_anti").select("path", "source_type", reason.alias("reason"))
    return documents, rejected


def marker_pairs(files: DataFrame) -> DataFrame:
    """Files grouped by stem: exactly one Markdown file gives the text and exactly one PDF the identity."""
    ext = extension(F.col("path"))
    grouped = files.groupBy(stem(F.col("path")).alias("stem")).agg(
        F.count_if(ext == "md").alias("md"),
        F.count_if(ext == "pdf").alias("pdf"),
        F.min(F.when(ext == "md", F.col("path"))).alias("text_path"),
        F.min(F.when(ext == "pdf", F.col("path"))).alias("source_file"),
    )
    ok = (F.col("md") == 1) & (F.col("pdf") == 1)
    return grouped.select(
        "stem", ok.alias("valid"), F.when(ok, F.col("text_path")).alias("text_path"), F.when(ok, F.col("source_file")).alias("source_file"),
        F.when(ok, F.lit("pdf")).alias("source_type"),
    )


def ingest_requests(files: DataFrame, source_path: str | None) -> DataFrame:
    """Bulk upload rows: the source file is the given folder and the file name, the name is the stem."""
    name = F.substring_index("path", "/", -1)
    source = F.concat(F.lit(source_path.rstrip("/") + "/"), name) if source_path else name
    return with_source_type(files).select("path", name.alias("name"), source.alias("source_file"), "source_type", "mime")
